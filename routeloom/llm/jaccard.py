"""N-gram Jaccard join: documents whose shingle sets are 80 % alike, by T-occurrence search.

Equal sets are one class, and the join works on classes. Blocks of documents
(see blocks.py) ask in how many classes each of their shingles occurs. A set of
n shingles needs ceil(0.8 n) of them in common with a partner, so a class with
more than n - ceil(0.8 n) shingles of its own alone has none and is left out;
of the others only shared shingles travel.

Every set is indexed in one place, its cell: the smallest of its shared
shingles. Two alike sets share a shingle of their prefixes (the n - ceil(0.8 n)
+ 1 shingles that come first from rare to common), so a set can have partners
only in its own cell and in cells that share a prefix shingle with its own; it
is a query there. Cells are put together to parts of about LOAD shingles, a
larger cell is split over several, and queries of a part are split as well.

A part is an inverted index of its sets, and every query searches it by
DivideSkip: a partner has at least T = ceil(0.8 n) of the query's shingles; the
longest lists are set aside, the short ones merged with a heap, and the ids that
occur often enough there are looked for in the long ones by bisection. All links
are counted; a part returns those that connect what it has, since the pairs of a
large group are not needed one by one.

Defined results: a null or empty text has no shingles and is linked with
nothing; ids may be of any type that sorts; rows are documents of their own,
also where ids repeat or are null, and equal sets are one class; a component has
the smallest id of its rows, null if it has none; further columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import by_part, kind_of, pack, pack_sorted, summed, text_blocks, texts_of, unpack, unpack_sorted
from .common import giving_back, stage, table
from .components import components
from .hashing import BASES, U, Words, rolling

SHINGLE, PERCENT = 5, 80
#: Bytes of the corpus per part of the shingle table; shingles in a part of the index and in its queries.
TABLE_LOAD, LOAD, QUERY_LOAD = 24_000_000, 400_000, 1_600_000
#: DivideSkip: weight of a list's length when long lists are chosen; entries that are merged with a heap at most, more are merged by sorting.
MU, HEAP = 0.001, 2000
#: A block's documents are fewer.
ROWS = 27
MOST = 65535


def required(n: int, percent: int = PERCENT) -> int:
    """Overlap that a set of n needs with any partner: at least percent of the union, which has n or more."""
    return -(-percent * n // 100)


def overlap(n, m, percent: int = PERCENT):
    """Smallest overlap of sets of n and m with 100 * overlap >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def _sets(sizes: bytes, data: bytes) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a block."""
    h, size = Words(1).words(texts_of(sizes, data)[2], lower=True)
    whole, out, e = rolling(h[0], SHINGLE, BASES[0]), [], 0
    for n in size.tolist():
        out.append(np.unique(whole[e : e + n - SHINGLE + 1]) if n >= SHINGLE else rolling(h[0][e : e + n], n, BASES[0]) if n else np.zeros(0, U))
        e += n
    return out


def _members(blocks: DataFrame) -> DataFrame:
    """(row, doc_id, mark, n, c, c2): size and 128-bit digest of each row's set; row numbers rows by block and place."""

    def run(batches):
        for b in batches:
            for block, marks, sizes, data in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
                sets = _sets(sizes, data)
                x = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
                c, c2 = (np.array([v >> k & (1 << 64) - 1 for v in x], U).view(np.int64) for k in (0, 64))
                ids = b.column(1).filter(pa.array(np.asarray(b.column(0)) == block)).flatten()
                yield pa.RecordBatch.from_arrays([pa.array((block << ROWS) + np.arange(len(sets))), ids, pa.array(unpack(marks, np.int64)), pa.array([len(s) for s in sets], pa.int64()), pa.array(c), pa.array(c2)], ["row", "doc_id", "mark", "n", "c", "c2"])

    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    return blocks.select("block", "ids", "marks", "sizes", "data").mapInArrow(run, f"row long, doc_id {kind}, mark long, n long, c long, c2 long")


def _chosen(blocks: DataFrame, classes: DataFrame, *answers: DataFrame) -> DataFrame:
    """Blocks (step 0), the places of their rows that stand for a class (step 1) and answers (step 2), as rows of one form."""
    first = classes.where("n > 0").groupBy(F.shiftright("r", ROWS).alias("block")).agg(F.sort_array(F.collect_list(F.col("r").bitwiseAND(F.lit((1 << ROWS) - 1)))).alias("rows"))
    none = "CAST(NULL AS array<bigint>) AS rows"
    out = blocks.selectExpr("block", "0 AS step", "0 AS part", none, "sizes", "data").unionByName(first.selectExpr("block", "1 AS step", "0 AS part", "rows", "CAST(NULL AS binary) AS sizes", "CAST(NULL AS binary) AS data"))
    for a in answers:
        out = out.unionByName(a.selectExpr("block", "2 AS step", "part", none, "CAST(NULL AS binary) AS sizes", "counts AS data"))
    return out


def _own(rows: pa.Table) -> tuple[pa.Table, int, np.ndarray, list[np.ndarray]]:
    """Of a block's rows, in order: the rest, its number, the places of those that stand for a class, and their sets."""
    rows = rows.sort_by([("step", "ascending"), ("part", "ascending")])
    own = rows.slice(0, 2).to_pydict()
    at = np.array(own["rows"][1] if len(own["rows"]) > 1 and own["step"][1] == 1 else [], np.int64)
    sets = _sets(own["sizes"][0], own["data"][0]) if len(at) else []
    return rows, own["block"][0], at, [sets[i] for i in at.tolist()]


def _shared(blocks: DataFrame, classes: DataFrame, parts: int) -> DataFrame:
    """(block, part, counts): in how many classes the distinct shingles of a block's classes occur, part by part."""

    def ask(rows: pa.Table) -> pa.Table:
        _, block, _, sets = _own(rows)
        keys, counts = np.unique(np.concatenate([np.zeros(0, U), *sets]), return_counts=True)
        place, edge = by_part(keys, parts)
        keys, counts = keys[place], counts[place].astype(np.uint32)
        full = np.flatnonzero(np.diff(edge)).tolist()
        cut = [slice(edge[p], edge[p + 1]) for p in full]
        return pa.table([pa.array([block] * len(full), pa.int64()), pa.array(full, pa.int32()), pa.array([pack_sorted(keys[c]) for c in cut], pa.binary()), pa.array([pack(counts[c]) for c in cut], pa.binary())], ["block", "part", "keys", "counts"])

    def answer(rows: pa.Table) -> pa.Table:
        counts = summed([unpack_sorted(x) for x in rows["keys"].to_pylist()], [unpack(x, np.uint32).astype(np.int64) for x in rows["counts"].to_pylist()])
        # counts only order the shingles, so large ones may be equal
        return pa.table([rows["block"], rows["part"], pa.array([pack(np.minimum(c, MOST).astype(np.uint16)) for c in counts], pa.binary())], ["block", "part", "counts"])

    asked = _chosen(blocks, classes).groupBy("block").applyInArrow(giving_back(ask), "block long, part int, keys binary, counts binary")
    return asked.groupBy("part").applyInArrow(giving_back(answer), "block long, part int, counts binary")


def _survivors(blocks: DataFrame, classes: DataFrame, shared: DataFrame, percent: int, parts: int) -> DataFrame:
    """(r, n, size, cell, s, prefix): the classes that may have a partner, with the shingles that other classes have, and those of their prefix."""

    def run(rows: pa.Table) -> pa.Table:
        rows, block, at, sets = _own(rows)
        keys = np.unique(np.concatenate([np.zeros(0, U), *sets]))
        counts, out = np.empty(len(keys), np.uint16), []
        if len(at):
            counts[by_part(keys, parts)[0]] = np.concatenate([np.zeros(0, np.uint16), *(unpack(x, np.uint16) for x in rows["data"].to_pylist()[2:])])
        for i, s in zip(at.tolist(), sets):
            c = counts[np.searchsorted(keys, s)]
            most = len(s) - required(len(s), percent)
            alone = int((c == 1).sum())
            if alone <= most:
                both = c > 1
                s2, c2 = s[both], c[both]
                prefix = s2[np.lexsort((s2, c2))[: most + 1 - alone]]
                out.append(((block << ROWS) + i, len(s), len(s2), int(s2[0].view(np.int64)), s2.tobytes(), prefix.tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], ["r", "n", "size", "cell", "s", "prefix"])

    return _chosen(blocks, classes, shared).groupBy("block").applyInArrow(giving_back(run), "r long, n long, size long, cell long, s binary, prefix binary")


def _neighbours(sets: DataFrame, percent: int) -> DataFrame:
    """(cell, other): cells with a prefix shingle in common and sizes that may be alike, both ways."""

    def run(batches):
        for b in batches:
            n, cell = (np.asarray(b.column(i)) for i in (0, 1))
            prefix = [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
            size = [len(x) for x in prefix]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *prefix])), pa.array(np.repeat(cell, size)), pa.array(np.repeat(n, size))], ["t", "cell", "n"])

    at = sets.select("n", "cell", "prefix").mapInArrow(run, "t long, cell long, n long").groupBy("t", "cell").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    many = at.groupBy("t").agg(F.min("cell").alias("a"), F.max("cell").alias("b")).where("a <> b").select("t")
    at = stage(lambda: at.join(many, "t"))
    other = at.select("t", F.col("cell").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = at.join(other, "t").where((F.col("cell") < F.col("other")) & (F.col("hi2") * 100 >= F.col("lo") * percent) & (F.col("hi") * 100 >= F.col("lo2") * percent)).select("cell", "other").distinct()
    return stage(lambda: pairs.unionByName(pairs.select(F.col("other").alias("cell"), F.col("cell").alias("other"))))


class Index:
    """Inverted lists over the places of sets, as one sorted array of (shingle, place)."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray) -> None:
        self.sizes, self.n = sizes, max(len(sets), 1)
        every = np.concatenate([np.zeros(0, U), *sets])
        place = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(every, kind="stable")
        self.shingles, first = np.unique(every[order], return_index=True)
        self.edge, self.place = np.append(first, len(every)), place[order]
        self.flat = np.repeat(np.arange(len(self.shingles)), np.diff(self.edge)) * self.n + self.place
        #: Entries merged with a heap, entries merged by sorting, bisections.
        self.work = [0, 0, 0]

    def occurring(self, s: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the sets with at least t of the shingles s, and how many they have (DivideSkip).

        The longest lists, fewer than t, are set aside; a place on t lists is
        then on t minus their number of the others at least, which are merged.
        Only such places are looked for in the long lists, by bisection.
        """
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.shingles) or t <= 0:
            return none
        i = np.minimum(np.searchsorted(self.shingles, s), len(self.shingles) - 1)
        i = i[self.shingles[i] == s]
        if len(i) < t:
            return none
        size = self.edge[i + 1] - self.edge[i]
        i = i[np.argsort(-size, kind="stable")]
        longest = int(size.max())
        aside = min(t - 1, int(t / (MU * longest * np.log2(longest + 1) + 1)))
        long, short = i[:aside], i[aside:]
        need, entries = t - aside, int((self.edge[short + 1] - self.edge[short]).sum())
        if entries <= HEAP:
            merged = np.fromiter(heapq.merge(*(self.place[self.edge[j] : self.edge[j + 1]].tolist() for j in short.tolist())), np.int64, entries)
            self.work[0] += entries
        else:
            merged = np.sort(np.concatenate([self.place[self.edge[j] : self.edge[j + 1]] for j in short.tolist()]), kind="stable")
            self.work[1] += entries
        first = np.flatnonzero(np.append(True, merged[1:] != merged[:-1])) if len(merged) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(merged)))
        place, count = merged[first][count >= need], count[count >= need]
        for k in range(0, aside, 64):
            if not len(place):
                break
            probe = long[k : k + 64, None] * self.n + place
            found = np.searchsorted(self.flat, probe)
            self.work[2] += probe.size
            count = count + (self.flat[np.minimum(found, len(self.flat) - 1)] == probe).sum(axis=0)
            enough = count >= t - max(0, aside - k - 64)
            place, count = place[enough], count[enough]
        return place, count

    def alike(self, s: np.ndarray, n: int, percent: int = PERCENT) -> np.ndarray:
        """Places of the sets that are alike to one of n shingles, of which s may be in others."""
        place, common = self.occurring(s, required(n, percent))
        return place[common >= overlap(n, self.sizes[place], percent)]


def _search(rows: pa.Table, percent: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[int]]:
    """Links that connect what a part has, how many links each of its queries has there, and the work done."""
    r, n = np.asarray(rows["r"]), np.asarray(rows["n"])
    sets, indexed = [np.frombuffer(x, U) for x in rows["s"].to_pylist()], np.asarray(rows["indexed"]).astype(bool)
    own = np.flatnonzero(indexed)
    index = Index([sets[i] for i in own.tolist()], n[own])
    parent = np.arange(len(r))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    links, degree = [], []
    for q in np.flatnonzero(np.asarray(rows["asks"]).astype(bool)).tolist():
        found = own[index.alike(sets[q], int(n[q]), percent)]
        found = found[r[found] != r[q]]
        if len(found):
            degree.append((int(r[q]), len(found)))
            for other in found.tolist():
                a, b = root(q), root(other)
                if a != b:
                    parent[a] = b
                    links.append((int(r[q]), int(r[other])))
    return links, degree, index.work


def _linked(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, k): links (a, b) between classes, which connect whatever is connected, and the number of links k of a, in one row or several."""
    cells = stage(lambda: sets.groupBy("cell").agg(F.sum("size").alias("load")))
    neighbours = _neighbours(sets, percent)
    total = cells.agg(F.sum("load")).first()[0] or 0
    parts = max(16, total // LOAD)
    subs = (F.floor(F.col("load") / LOAD) + 1).cast("int")
    # small cells share a part; a large one has parts of its own
    home = cells.select("cell", F.when(F.col("load") * 4 > LOAD, F.col("cell")).otherwise(F.pmod(F.xxhash64("cell"), F.lit(parts))).alias("p"), F.when(F.col("load") * 4 > LOAD, subs).otherwise(0).alias("subs"))
    at = sets.select("r", "cell", "size")
    indexed = at.join(home, "cell").select("r", "p", F.when(F.col("subs") > 0, F.pmod(F.xxhash64("r"), F.col("subs"))).otherwise(-1).cast("int").alias("sub"))
    goes = neighbours.unionByName(cells.select("cell", F.col("cell").alias("other")))
    goes = goes.join(home.withColumnRenamed("cell", "other"), "other").select("cell", "p", "subs").distinct()
    asks = at.join(goes, "cell").select("r", "size", "p", F.explode(F.when(F.col("subs") > 0, F.sequence(F.lit(0), F.col("subs") - 1)).otherwise(F.array(F.lit(-1)))).alias("sub"))
    load = asks.groupBy("p", "sub").agg((F.floor(F.sum("size") / QUERY_LOAD) + 1).cast("int").alias("chunks"))
    asks = asks.join(load, ["p", "sub"]).select("p", "sub", F.pmod(F.xxhash64("r"), F.col("chunks")).cast("int").alias("chunk"), "r", F.lit(0).alias("indexed"), F.lit(1).alias("asks"))
    kept = indexed.join(load, ["p", "sub"]).select("p", "sub", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "r", F.lit(1).alias("indexed"), F.lit(0).alias("asks"))
    roles = kept.unionByName(asks).groupBy("p", "sub", "chunk", "r").agg(F.max("indexed").alias("indexed"), F.max("asks").alias("asks"))

    def run(rows: pa.Table) -> pa.Table:
        links, degree, _ = _search(rows, percent)
        return pa.table([pa.array([x[0] for x in links + degree], pa.int64()), pa.array([x[1] for x in links] + [None] * len(degree), pa.int64()), pa.array([0] * len(links) + [x[1] for x in degree], pa.int64())], ["a", "b", "k"])

    return roles.join(sets.select("r", "n", "s"), "r").groupBy("p", "sub", "chunk").applyInArrow(giving_back(run), "a long, b long, k long")


def links(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (row, doc_id, mark, n, c, c2), classes (c, c2, n, r, doc_id), and (a, b, k): links between classes that connect whatever is connected (b not null), and the number of links k of a."""
    blocks = stage(lambda: text_blocks(docs))
    parts = max(64, (blocks.agg(F.sum("load")).first()[0] or 0) // TABLE_LOAD)
    members = stage(lambda: _members(blocks))
    classes = stage(lambda: members.groupBy("c", "c2", "n").agg(F.min("row").alias("r"), F.min("doc_id").alias("doc_id")))
    shared = stage(lambda: _shared(blocks, classes, parts))
    sets = stage(lambda: _survivors(blocks, classes, shared, percent, parts))
    return members, classes, stage(lambda: _linked(sets, percent))


def _joined(docs: DataFrame, percent: int) -> DataFrame:
    """(row, doc_id, mark, n, component, component_id, class_id, n_links) of each row."""
    members, classes, found = links(docs, percent)
    edges = found.where("b IS NOT NULL").select("a", "b")
    degree = found.groupBy("a").agg(F.sum("k").alias("n_links")).withColumnRenamed("a", "r")
    linked = components(edges).select(F.col("node").alias("r"), "component")
    # read twice below: as a plan, every join of it would run as often, and its broadcasts fill the driver
    at = stage(lambda: classes.where("n > 0").join(linked, "r", "left").join(degree, "r", "left").select("c", "c2", "n", "doc_id", F.coalesce("component", "r").alias("component"), "n_links"))
    # most components are one class
    several = at.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    at = at.join(several, "component").select("c", "c2", "n", "component", "component_id", F.col("doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    empty = members.where("n = 0").select("row", "doc_id", "mark", "n", F.col("row").alias("component"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return members.where("n > 0").join(at, ["c", "c2", "n"]).select(*empty.columns).unionByName(empty)


def join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id and n_links (links between its class and others) of each row."""
    return _joined(docs, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id", "n_links")


def first_of_each(docs: DataFrame) -> DataFrame:
    """Of every component the rows of one document, that with the smallest id (a null id last, then by the text's hash), with all columns of docs."""
    at = stage(lambda: _joined(docs, PERCENT).select("component", F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "mark").alias("key")))
    first = at.groupBy("component").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first <> last").select("component", "first")
    later = at.join(first, "component").where("key <> first").select("key").distinct()
    own = F.struct(docs["doc_id"].isNull().alias("x"), docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("mark"))
    return docs.join(later, own.eqNullSafe(later["key"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + least(len(w), 5) - 1], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
ws AS (SELECT doc_id, list(s ORDER BY s) AS v FROM s GROUP BY doc_id),
degree AS (SELECT a AS doc_id, count(DISTINCT y.v) - max((y.v = x.v)::INT) AS k FROM link JOIN ws x ON x.doc_id = a JOIN ws y ON y.doc_id = b GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, coalesce(k, 0)::BIGINT AS n_links
FROM (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) LEFT JOIN n USING (doc_id) LEFT JOIN degree USING (doc_id)
"""
