"""Scans, stock membership, text of reactions, ranking, caching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cache, prep, ranking, stock as S
from ..session import table
from ..sources import projections as P
from .registry import query


@query(r"""
SELECT doc_id, line FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> '' AND NOT starts_with(line, '#')""")
def scan_clean_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.clean_lines(F.col("text"))).alias("line"))


@query("SELECT k, count(*) OVER () AS n FROM (SELECT p_partkey AS k FROM part WHERE p_size <= 10 UNION SELECT p_partkey FROM part WHERE p_size BETWEEN 8 AND 15)")
def stock_distinct_union(spark, sf_dir):
    a = P.stock(spark, sf_dir)
    b = table(spark, sf_dir, "part").where("p_size BETWEEN 8 AND 15").select(F.col("p_partkey").alias("k"))
    u = S.union(a, b)
    return u.crossJoin(F.broadcast(u.agg(F.count(F.lit(1)).alias("n"))))


@query(f"WITH {P.STOCK_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT k FROM stock)")
def stock_membership_semi(spark, sf_dir):
    return S.purchasable(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), P.stock(spark, sf_dir), "l_partkey")


@query(f"WITH {P.LEAVES_SQL} SELECT o, pos, k, s, in_stock FROM leaves")
def stock_membership_flag(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"))
    return S.with_flag(own, P.stock(spark, sf_dir))


@query(f"WITH {P.STOCK_SQL} SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey NOT IN (SELECT k FROM stock)")
def stock_missing_anti(spark, sf_dir):
    return S.missing(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")), P.stock(spark, sf_dir)).distinct()


@query("SELECT l_returnflag, count(*) AS n, 0::BIGINT AS n_in_stock FROM lineitem GROUP BY 1")
def stock_empty(spark, sf_dir):
    flagged = S.with_flag(table(spark, sf_dir, "lineitem"), S.empty(P.stock(spark, sf_dir)), "l_partkey")
    return flagged.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if("in_stock").alias("n_in_stock"))


@query(f"""
WITH {P.RULES_SQL}, {P.STOCK_SQL}, pairs AS (SELECT product AS target, unnest(list_append(reactants, product)) AS k FROM rules)
SELECT target, k, (k IN (SELECT k FROM stock) AND k <> target) AS in_stock FROM pairs""")
def stock_exclude_target(spark, sf_dir):
    pairs = P.rules(spark, sf_dir).select(F.col("product").alias("target"), F.explode(F.array_append("reactants", F.col("product"))).alias("k"))
    return S.with_flag(pairs, P.stock(spark, sf_dir), excluded=F.col("target"))


@query(r"""
WITH c AS (SELECT doc_id, list_filter(string_split(text, '.'), lambda x: trim(x) <> '') AS raw FROM documents),
t AS (SELECT doc_id, list_transform(raw, lambda x: trim(x)) AS p FROM c)
SELECT doc_id, len(p)::BIGINT AS n, coalesce(list_max(list_transform(p, lambda x: length(x))), 0)::BIGINT AS longest, md5(array_to_string(list_sort(p), '.')) AS canonical FROM t""")
def component_split(spark, sf_dir):
    p = T.components(F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", p.alias("p"))
    return d.select("doc_id", F.size("p").cast("long").alias("n"), F.coalesce(F.array_max(F.transform("p", F.length)), F.lit(0)).cast("long").alias("longest"), F.md5(F.array_join(F.array_sort("p"), ".")).alias("canonical"))


@query(f"""
WITH {P.LEAVES_SQL}, r AS (SELECT o, string_agg(k::VARCHAR, '.' ORDER BY pos, k, s) AS left_side FROM leaves GROUP BY o)
SELECT o, left_side || '>>' || o AS forward_text, o || '>>' || left_side AS retro_text FROM r""")
def reaction_text(spark, sf_dir):
    parts = P.leaves(spark, sf_dir).groupBy("o").agg(F.array_sort(F.collect_list(F.struct("pos", "k", "s"))).alias("x"))
    left = F.transform("x", lambda r: r["k"].cast("string"))
    return parts.select("o", T.reaction_text(left, F.col("o").cast("string")).alias("forward_text"), T.retro_text(F.col("o").cast("string"), left).alias("retro_text"))


@query("""
WITH t AS (SELECT o_orderkey AS o, o_orderpriority || '.' || o_orderstatus || '>' || (CASE WHEN o_orderkey % 3 = 0 THEN 'agent' ELSE '' END) || '>' || o_custkey || '.' || o_orderkey AS s FROM orders)
SELECT o, string_split(string_split(s, '>')[1], '.') AS left_parts, list_filter(string_split(string_split(s, '>')[2], '.'), lambda x: x <> '') AS agents,
  (CASE WHEN length(string_split(string_split(s, '>')[3], '.')[1]) >= length(string_split(string_split(s, '>')[3], '.')[2]) THEN string_split(string_split(s, '>')[3], '.')[1] ELSE string_split(string_split(s, '>')[3], '.')[2] END) AS product FROM t""")
def reaction_parse(spark, sf_dir):
    s = F.concat("o_orderpriority", F.lit("."), "o_orderstatus", F.lit(">"), F.when(F.col("o_orderkey") % 3 == 0, "agent").otherwise(""), F.lit(">"), F.col("o_custkey").cast("string"), F.lit("."), F.col("o_orderkey").cast("string"))
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), T.parse_reaction(s).alias("r"))
    return d.select("o", F.col("r.left").alias("left_parts"), F.col("r.agents").alias("agents"), T.longest(F.col("r.right")).alias("product"))


@query(f"""
WITH {P.RULES_SQL}, kept AS (SELECT rule_id FROM rules WHERE len(reactants) >= 2)
SELECT rule_id, row_number() OVER (ORDER BY rule_id) - 1 AS new_label FROM kept""")
def simplifying_filter_relabel(spark, sf_dir):
    return prep.dense_relabel(P.rules(spark, sf_dir).where(F.size("reactants") >= 2), "rule_id")


@query(f"WITH {P.RULES_SQL} SELECT count(*) AS n_in, count(*) FILTER (len(reactants) >= 2) AS n_kept, round(count(*) FILTER (len(reactants) >= 2) / count(*), 6) AS share FROM rules")
def simplifying_filter_counts(spark, sf_dir):
    return prep.filter_counts(P.rules(spark, sf_dir), F.size("reactants") >= 2).withColumn("share", F.round("share", 6))


@query(f"""
WITH {P.RULES_SQL}, p AS (SELECT rule_id, product, list_sort(reactants) AS r, score / (SELECT sum(score) FROM rules) AS prior FROM rules),
m AS (SELECT product, r, max(prior) AS prior, arg_max(rule_id, (prior, -rule_id)) AS rule_id FROM p GROUP BY product, r),
k AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY prior DESC, r) AS rank FROM m)
SELECT product, rule_id, round(prior, 9) AS prior, rank FROM k WHERE rank <= 2""")
def template_prior_topk(spark, sf_dir):
    p = ranking.normalised_priors(P.rules(spark, sf_dir).select("rule_id", "product", F.array_sort("reactants").alias("r"), F.col("score").alias("prior")))
    m = p.groupBy("product", "r").agg(F.max("prior").alias("prior"), F.max_by("rule_id", F.struct("prior", (-F.col("rule_id")).alias("n"))).alias("rule_id"))
    return ranking.top_k(m, "product", [F.desc("prior"), F.col("r")], 2).select("product", "rule_id", F.round("prior", 9).alias("prior"), F.col("rank").cast("long").alias("rank"))


_SOFTMAX = """
WITH e AS (SELECT vec_id, label AS gold, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS label, list_max(embedding)::DOUBLE AS top FROM embeddings),
p AS (SELECT vec_id, gold, label, exp(x - top) / sum(exp(x - top)) OVER (PARTITION BY vec_id) AS prob, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, label) AS rank FROM e)"""


@query(_SOFTMAX + " SELECT vec_id, label, round(prob, 6) AS prob, rank FROM p WHERE rank <= 10")
def softmax_topk(spark, sf_dir):
    top = ranking.top_classes(P.logits(spark, sf_dir), "vec_id", "embedding", 10)
    return top.select("vec_id", F.col("label").cast("long").alias("label"), F.round("prob", 6).alias("prob"), F.col("rank").cast("long").alias("rank"))


@query(_SOFTMAX + """, c AS (SELECT vec_id % 50 AS product, label % 16 AS reactants, round(prob, 9) AS prob, ((label * 37 + vec_id) % 101) / 100::DOUBLE AS center, label FROM p WHERE rank <= 10),
m AS (SELECT *, row_number() OVER (PARTITION BY product, reactants ORDER BY prob DESC, center DESC, label DESC) AS i FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY prob DESC, center DESC, label DESC, reactants) AS rank FROM m WHERE i = 1)
SELECT product, reactants, round(prob, 6) AS prob, center, label, rank FROM k WHERE rank <= 5""")
def rank_prob_center(spark, sf_dir):
    top = ranking.top_classes(P.logits(spark, sf_dir), "vec_id", "embedding", 10).withColumn("label", F.col("label").cast("long"))
    c = top.select((F.col("vec_id") % 50).alias("product"), (F.col("label") % 16).alias("reactants"), F.round("prob", 9).alias("prob"), (((F.col("label") * 37 + F.col("vec_id")) % 101) / F.lit(100.0)).alias("center"), "label")
    return ranking.merge_retro(c, 5).select("product", "reactants", F.round("prob", 6).alias("prob"), "center", "label", F.col("rank").cast("long").alias("rank"))


_PAIRS = f"pairs AS (SELECT a.n_nationkey::BIGINT AS a, b.n_nationkey::BIGINT AS b FROM nation a JOIN nation b ON a.n_nationkey <= b.n_nationkey), made AS (SELECT a, b, {P.PAIR_PRODUCT_SQL} AS product, {P.PAIR_STEP_SQL} AS step FROM pairs)"


@query(f"""
WITH {_PAIRS}, c AS (SELECT a AS input, product % 10 AS product, step AS prob, b AS label FROM made),
m AS (SELECT input, product, prob, label, row_number() OVER (PARTITION BY input, product ORDER BY prob DESC, label) AS i, count(*) OVER (PARTITION BY input, product) AS n_templates FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY input ORDER BY prob DESC, n_templates DESC, product) AS rank FROM m WHERE i = 1)
SELECT input, product, prob, label, n_templates, rank FROM k WHERE rank <= 5""")
def forward_decode(spark, sf_dir):
    c = nation_reactions(spark, sf_dir).select(F.col("a").alias("input"), (F.col("product") % 10).alias("product"), F.col("step").alias("prob"), F.col("b").alias("label"))
    return ranking.decode_forward(c, 5).withColumn("rank", F.col("rank").cast("long"))


def react(pairs):
    """The pool's reaction of a pair."""
    return pairs.select("a", "b", (F.lit(25) + (F.col("a") * 7 + F.col("b") * 3) % 50).alias("product"), (((F.col("a") + F.col("b")) % 50 + 50) / F.lit(100.0)).alias("step"))


def nation_reactions(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("a"))
    return react(n.join(n.select(F.col("a").alias("b")), F.col("a") <= F.col("b")))


@query("""
WITH p AS (SELECT a.vec_id, a.label, list_transform(a.embedding, lambda x: x::DOUBLE) AS r, list_transform(b.embedding, lambda x: x::DOUBLE) AS p FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, list_transform(list_concat(list_concat(r, p), list_concat(list_transform(range(1, len(r) + 1), lambda i: p[i] - r[i]), list_transform(range(1, len(r) + 1), lambda i: p[i] * r[i]))), lambda x: round(x, 6)) AS features FROM p""")
def dual_tower_features(spark, sf_dir):
    e = P.logits(spark, sf_dir).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("r"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("r").alias("p")), "vec_id")
    return pairs.select("vec_id", F.transform(T.dual_features(F.col("r"), F.col("p")), lambda x: T.rounded(x, 6)).alias("features"))


@query("SELECT vec_id, list_transform(range(0, 9), lambda i: (CASE WHEN label = i OR (i = 8 AND label NOT BETWEEN 0 AND 7) THEN 1 ELSE 0 END)::INTEGER) AS hot FROM embeddings")
def one_hot(spark, sf_dir):
    return P.logits(spark, sf_dir).select("vec_id", T.one_hot(F.col("label"), list(range(8)), other=True).alias("hot"))


@query(f"""
WITH {P.RULES_SQL}, r AS (SELECT product % 100 AS product, rule_id, score, ((rule_id * 31) % 97) / 97::DOUBLE AS plausibility FROM rules),
k AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY score DESC, rule_id) AS rank FROM r),
f AS (SELECT *, bool_or(plausibility >= 0.4::DOUBLE) OVER (PARTITION BY product) AS anyone FROM k WHERE rank <= 6),
s AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY rank) AS new_rank FROM f WHERE plausibility >= 0.4::DOUBLE OR (NOT anyone AND rank <= 1))
SELECT product, rule_id, rank, new_rank, round(plausibility, 6) AS plausibility FROM s WHERE new_rank <= 3""")
def plausibility_filter(spark, sf_dir):
    r = P.rules(spark, sf_dir).select((F.col("product") % 100).alias("product"), "rule_id", "score", (((F.col("rule_id") * 31) % 97) / F.lit(97.0)).alias("plausibility"))
    out = ranking.plausibility_filter(ranking.top_k(r, "product", [F.desc("score"), F.col("rule_id")], 6), "product", 0.4, 1, 3)
    return out.select("product", "rule_id", F.col("rank").cast("long").alias("rank"), F.col("new_rank").cast("long").alias("new_rank"), F.round("plausibility", 6).alias("plausibility"))


_REQUESTS = """
WITH req AS (SELECT user_id AS smiles, (event_id % 5 + 1)::INTEGER AS k FROM events),
cached AS (SELECT user_id AS smiles, max(event_id % 4 + 1)::INTEGER AS top_k FROM events WHERE event_id % 3 = 0 GROUP BY 1),
j AS (SELECT req.smiles, k, coalesce(top_k >= k, false) AS hit FROM req LEFT JOIN cached USING (smiles))"""


def _cache_tables(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    req = e.select(F.col("user_id").alias("smiles"), (F.col("event_id") % 5 + 1).cast("int").alias("k"))
    entries = e.where("event_id % 3 = 0").groupBy(F.col("user_id").alias("smiles")).agg(F.max(F.col("event_id") % 4 + 1).cast("int").alias("top_k"))
    answer = lambda d: d.withColumn("predictions", F.transform(F.sequence(F.lit(1), "top_k"), lambda i: F.concat(F.col("smiles").cast("string"), F.lit("-"), i.cast("string"))))
    return req, answer(entries), lambda m: answer(m.select("smiles", F.col("k").alias("top_k")))


@query(_REQUESTS + " SELECT smiles, k, array_to_string(list_transform(range(1, k + 1), lambda i: smiles || '-' || i), ' ') AS predictions, count(*) AS n FROM j GROUP BY ALL")
def cache_readthrough(spark, sf_dir):
    req, entries, expand = _cache_tables(spark, sf_dir)
    answers, _ = cache.read_through(req, entries, expand)
    return answers.groupBy("smiles", "k", F.array_join("predictions", " ").alias("predictions")).agg(F.count(F.lit(1)).alias("n"))


@query(_REQUESTS + " SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*), 6) AS hit_rate FROM j")
def cache_hit_rate(spark, sf_dir):
    req, entries, _ = _cache_tables(spark, sf_dir)
    return cache.hit_rate(req, entries).withColumn("hit_rate", F.round("hit_rate", 6))


@query(_REQUESTS + ", w AS (SELECT smiles, max(k) AS k FROM j WHERE NOT hit GROUP BY 1) SELECT coalesce(w.smiles, cached.smiles) AS smiles, greatest(coalesce(w.k, 0), coalesce(top_k, 0))::INTEGER AS top_k FROM w FULL JOIN cached ON w.smiles = cached.smiles")
def cache_upsert(spark, sf_dir):
    req, entries, expand = _cache_tables(spark, sf_dir)
    return cache.read_through(req, entries, expand)[1].select("smiles", "top_k")


@query("""SELECT o_orderkey AS k, (o_orderkey * 7919 + 3 * 104729) % 1000003 AS shuffled FROM orders ORDER BY shuffled, k LIMIT 500""")
def seeded_sample(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return prep.seeded_sample(o, "k", 500, 3).withColumn("shuffled", prep.mixed(F.col("k"), 3))


_FRAGMENT = r"""
WITH p AS (SELECT doc_id, list_transform(list_filter(string_split(text, '.'), lambda x: trim(x) <> ''), lambda x: trim(x)) AS p FROM documents),
f AS (SELECT doc_id, p, list_max(list_transform(p, lambda x: length(x))) AS size FROM p),
g AS (SELECT doc_id, CASE WHEN len(p) > 0 THEN list_filter(p, lambda x: length(x) = size)[1] END AS fragment, size FROM f)"""


@query(_FRAGMENT + """, ok AS (SELECT *, (doc_id * 7919 + 1 * 104729) % 1000003 AS o FROM g WHERE fragment IS NOT NULL AND size BETWEEN 40 AND 400),
one AS (SELECT *, row_number() OVER (PARTITION BY fragment ORDER BY o, doc_id) AS i FROM ok)
SELECT doc_id, fragment, size::BIGINT AS size FROM one WHERE i = 1 ORDER BY o, doc_id LIMIT 300""")
def target_sampling(spark, sf_dir):
    fragment = T.longest(T.components(F.col("text")))
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return prep.target_sample(d, "doc_id", fragment, F.length("fragment"), F.col("fragment"), 40, 400, 300, 1).withColumn("size", F.col("size").cast("long"))


@query(_FRAGMENT + " SELECT count(*) FILTER (fragment IS NULL) AS n_bad, count(*) FILTER (size < 40) AS n_small, count(*) FILTER (size > 400) AS n_large FROM g")
def target_rejects(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(T.longest(T.components(F.col("text"))).alias("f"))
    return prep.reject_counts(d, F.col("f"), F.length("f"), 40, 400)


@query("SELECT CASE o_orderkey % 20 WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END AS part, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def modulo_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(prep.split(F.col("o_orderkey")).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
WITH k AS (SELECT vec_id, label // 2 AS label, len(list_filter(embedding, lambda x: x > 0)) AS n FROM embeddings WHERE label % 2 = 0)
SELECT vec_id, label::INTEGER AS label, n, (sum(n) OVER (ORDER BY vec_id ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS start FROM k""")
def ragged_filter(spark, sf_dir):
    e = P.logits(spark, sf_dir)
    kept = e.join(e.select("label").distinct().where("label % 2 = 0"), "label", "left_semi")
    d = kept.select("vec_id", F.floor(F.col("label") / 2).cast("int").alias("label"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("n"))
    from ..operators.prefix import sum_before

    return sum_before(d, "vec_id", "n", "start")


_SCAN = r"""
SELECT p_partkey AS k, p_name AS smiles, length(p_name)::BIGINT AS n_chars, len(string_split(p_name, ' '))::BIGINT AS n_parts, string_split(p_name, ' ')[1] AS first_part FROM part WHERE p_name IS NOT NULL"""


@query(_SCAN)
def typed_scan(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_name IS NOT NULL")
    parts = F.split("p_name", " ")
    return p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("smiles"), F.length("p_name").cast("long").alias("n_chars"), F.size(parts).cast("long").alias("n_parts"), F.element_at(parts, 1).alias("first_part"))


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k_sum FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("k_sum"))
