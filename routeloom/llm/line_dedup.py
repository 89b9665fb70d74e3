"""Line dedup: lines equal or nearly equal to an earlier line of the corpus are removed.

Two lines are nearly equal when the edit distance of their words (the fewest
words to insert, delete or replace) is at most what LEVELS allows for the number
of words of the longer one; lines of fewer words must be equal. A line is removed
when an equal or nearly equal line comes earlier: in a document with a smaller
id, or further up in its own. Lines without a word stay.

Nearly equal lines are found by a segment-partition join. For distance t, a line
has t + 1 segments at places that only depend on a bucket of its length; of two
lines within t, one segment of the one is found in the other, moved by as many
words as edits fit on its nearer side (multi-match-aware selection). So every
line gives the runs of words at those places, as hashes of (t, bucket, segment,
words), and a line of which shorter partners are of another bucket also those of
that bucket. Lines meet under equal keys. Equal lines make no pairs.

Every line is first compared with one line alone, a leader: a line of the first
document that shares a key with it. That settles a group of near copies in about
as many pairs as it has lines. Lines without an earlier partner so far then meet
the leaders of their other keys; what is still open asks, by a semi join, whether
some other line of its keys is near and comes before it. Bitmaps of the words
rule out most pairs. Pairs are verified on what is left of both lines without
their common beginning and end, where both ends take an edit: for distances of
two at most by comparing what lies between, beyond by the banded bit-parallel
edit distance. All of it is DataFrame expressions.

Defined results: a null or empty text has no lines with a word and stays as it
is; ids may be of any type that sorts, a null doc_id comes after all others;
rows with equal id and equal text are one document; of different texts under one
id (or null ids), which are documents of their own, the one with the smaller hash
comes first; further columns are ignored by ``dedup`` and kept by ``clean``; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, ordered_id, small_methods, stage, table

#: (words of the longer line, distance that is allowed from there on).
LEVELS = ((10, 1), (20, 2))
#: Line ids that are broadcast at most; beyond, both sides are shuffled.
BROADCAST_IDS = 300_000
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
MASK = (1 << 31) - 1


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, base, place, x): every line with a word; mark is the hash of its text, base what occurrence() needs of the document."""
    # the hash before the lines, or else every line would carry its whole text; outer, or else Spark splits twice to leave out texts without lines, of which there are none
    whole = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.split(F.coalesce("text", F.lit("")), "\n").alias("xs"))
    every = whole.select("doc_id", "mark", _base(docs).alias("base"), F.posexplode_outer("xs").alias("place", "x"))
    return every.where(has_word(F.col("x")))


def _base(docs: DataFrame) -> Column:
    """Of whole ids, the number of a document's place 0; decimals are slow, so it is worked out once a document."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return F.lit(None).cast("decimal(38,0)")
    step = lambda x, y: (x * F.lit(MASK + 1).cast("decimal(10,0)") + y).cast("decimal(38,0)")
    number = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))
    return step(step(number, F.col("mark").bitwiseAND(F.lit(MASK)).cast("decimal(10,0)")), F.lit(0).cast("decimal(10,0)"))


def occurrence(docs: DataFrame) -> Column:
    """What orders lines: id (null last), hash of the text, place. A number for whole ids, so that its least can be kept by hash aggregation."""
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return (F.col("base") + F.col("place").cast("decimal(10,0)")).cast("decimal(38,0)")
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "place")


def document_order(docs: DataFrame) -> Column:
    """What orders documents by id (null last): a long for whole ids, which is cheaper than occurrence()."""
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return ordered_id()
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")


def has_word(x: Column) -> Column:
    """Whether anything is not blank; trimmed on the left only, since Spark looks at every character to trim on the right."""
    return F.ltrim(x, F.lit(BLANKS)) != ""


def words_of(x: Column) -> Column:
    """Words of a line; where single blanks stand between them, the usual case, no regular expression is needed."""
    odd = F.startswith(x, F.lit(" ")) | F.endswith(x, F.lit(" "))
    for blank in ("  ", *BLANKS[1:]):
        odd |= F.contains(x, F.lit(blank))
    return F.when(odd, F.split(F.btrim(x, F.lit(BLANKS)), SPACE)).otherwise(F.split(x, " "))


def allowed(n: Column, levels=LEVELS) -> Column:
    """Distance for a longer line of n words."""
    out = F.lit(0)
    for least, t in levels:
        out = F.when(n >= least, t).otherwise(out)
    return out


def _bucket(n: Column, least: int) -> Column:
    """The largest of some lengths (two from a power of two to the next, ``least`` and more) that n words are not below."""
    width = F.call_function("shiftleft", F.lit(1), F.greatest(F.length(F.bin(n)) - 2, F.lit(0)))
    return F.greatest(n - n % width, F.lit(least))


def _runs(w: Column, t: int, length: Column) -> Column:
    """Hashes of the runs of words that may be a segment of a line within t: nulls where there is none. ``length`` is a bucket, and not above the number of words."""
    n, out = F.size(w), []
    for i in range(t + 1):
        at, after = (F.floor(length * j / (t + 1)).cast("int") for j in (i, i + 1))
        size = after - at
        # from the line's beginning or its end, whichever has fewer edits on its side
        start, reach = (at, i) if i <= t - i else (n - length + at, t - i)
        for shift in range(-reach, reach + 1):
            key = F.xxhash64(length, F.lit(i * 64 + t), F.slice(w, start + shift + 1, size))
            out.append(key if shift == 0 else F.when((start + shift >= 0) & (start + shift + size <= n), key))
    return F.array(*out)


def line_keys(w: Column, levels=LEVELS) -> Column:
    """Keys of a line, of which any two lines within their distance share one; nulls where there is none."""
    n, none, keys = F.size(w), F.array().cast("array<bigint>"), []
    for k, (least, t) in enumerate(levels):
        low, fits = max(least - t, 0), n >= least - t
        if k + 1 < len(levels):
            fits &= n < levels[k + 1][0]
        keys.append(F.when(fits, _runs(w, t, _bucket(n, low))).otherwise(none))
        for less in range(1, t + 1):  # of shorter lines, where these are of another bucket
            length = _bucket(n - less, low)
            keys.append(F.when(fits & (n >= least) & (n >= less) & (length != _bucket(n - less + 1, low)), _runs(w, t, length)).otherwise(none))
    return F.concat(*keys)


def let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), 0)


def same_beginning(a: Column, b: Column) -> Column:
    """How many elements two arrays have in common from the first on."""
    other = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return let(other, lambda p: F.when(p == 0, F.size(a)).otherwise(p - 1).cast("int"))


def banded_distance(p: Column, q: Column, distance: int) -> Column:
    """Edit distance of two arrays if it is at most ``distance``, or else something larger.

    p is not shorter than q, by ``distance`` at most, and longer than
    ``distance``. Bits 0 to 2 * distance stand for the rows of the band around
    the diagonal, which moves down by one row with every element of q.
    """
    width, full = 2 * distance + 1, (1 << (2 * distance + 1)) - 1
    n = F.size(p)

    def step(s: Column, i: Column) -> Column:
        vp, vn, d, h = (s[k] for k in ("vp", "vn", "d", "h"))
        down = i < n - distance
        x = F.aggregate(F.sequence(F.lit(0), F.lit(width - 1)), F.lit(0), lambda m, k: m + F.when((i + k >= distance) & (F.get(p, F.greatest(i + k - distance, F.lit(0))) == F.get(q, i)), F.call_function("shiftleft", F.lit(1), k)).otherwise(0))
        diagonal = lambda x: (((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn)).bitwiseAND(F.lit(full))
        flat = lambda d0: F.struct(d0.alias("d0"), vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(F.lit(full))).alias("hp"), d0.bitwiseAND(vp).alias("hn"))

        def after(v: Column) -> Column:
            d0, hp, hn = v["d0"], v["hp"], v["hn"]
            below = F.when(d0.bitwiseAND(F.lit(1 << (width - 1))) == 0, 1).otherwise(0)
            beside = F.when(hp.bitwiseAND(h) != 0, 1).when(hn.bitwiseAND(h) != 0, -1).otherwise(0)
            half = F.shiftright(d0, 1)
            return F.struct(
                hn.bitwiseOR(F.bitwise_not(half.bitwiseOR(hp)).bitwiseAND(F.lit(full))).alias("vp"),
                half.bitwiseAND(hp).alias("vn"),
                (d + F.when(down, below).otherwise(beside)).alias("d"),
                F.when(down, h).otherwise(F.shiftright(h, 1)).alias("h"),
            )

        # a pair already too far apart is only carried along
        return F.when(d > 2 * distance + 1, s).otherwise(let(let(let(x, diagonal), flat), after))

    start = F.struct(F.lit(full ^ ((1 << distance) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(distance).alias("d"), F.lit(1 << (width - 2)).alias("h"))
    return F.aggregate(F.sequence(F.lit(0), F.size(q) - 1), start, step, lambda s: s["d"])


def ends_differ(p: Column, q: Column, distance: int) -> Column:
    """Whether p and q, of which both the first and the last elements differ, are within the distance; p is not shorter and longer than ``distance``.

    Both ends take an edit, so one edit never does, and of two edits what lies between is equal.
    """
    if distance > 2:
        return banded_distance(p, q, distance) <= distance
    if distance < 2:
        return F.lit(False)
    n, m = F.size(p), F.size(q)
    # an edit at an end leaves out an element of p, of q or of both
    same = lambda x1, y1, x2, y2: F.slice(p, 1 + x1, n - x1 - y1) == F.slice(q, 1 + x2, m - x2 - y2)
    return F.when(n == m, same(1, 1, 1, 1) | same(1, 0, 0, 1) | same(0, 1, 1, 0)).when(n == m + 1, same(1, 1, 1, 0) | same(1, 1, 0, 1)).otherwise(same(1, 1, 0, 0))


def is_near(a: Column, b: Column, distance: int) -> Column:
    """Whether arrays a (not shorter) and b are within the distance: decided exactly on what their common beginning and end leave.

    All steps are bound by lambdas, since the optimizer would put an alias's
    expression wherever its name stands, also within the loops.
    """

    def rest(v: Column, then) -> Column:
        """``then`` of both arrays, turned round, without their common beginning."""
        cut = lambda x, k: F.reverse(F.slice(x, k + 1, F.size(x) - k))
        return let(same_beginning(v["a"], v["b"]), lambda k: let(F.struct(cut(v["a"], k).alias("a"), cut(v["b"], k).alias("b")), then))

    def decide(v: Column) -> Column:
        n, m = F.size(v["a"]), F.size(v["b"])
        return F.when(n <= distance, True).when((n - m > distance) | (m == 0), False).otherwise(ends_differ(v["a"], v["b"], distance))

    return let(F.struct(a.alias("a"), b.alias("b")), lambda u: rest(u, lambda v: rest(v, decide)))


def is_near_by_level(a: Column, b: Column, levels=LEVELS) -> Column:
    """Whether arrays a (not shorter) and b are within the distance that the number of words allows."""
    t, near = allowed(F.size(a), levels), F.lit(False)
    for _, d in levels:
        near = F.when(t == d, is_near(a, b, d)).otherwise(near)
    return (F.size(a) - F.size(b) <= t) & near


def within(pairs: DataFrame, levels=LEVELS) -> DataFrame:
    """Of rows with words wa (not fewer) and wb, those within the distance that the number of words allows."""
    return pairs.where(is_near_by_level(F.col("wa"), F.col("wb"), levels))


def may_be_near(levels=LEVELS) -> Column:
    """Whether the bitmaps of lines a and b allow their distance: an edit changes two bits at most."""
    return F.bit_count(F.col("bitsa").bitwiseXOR(F.col("bitsb"))) <= 2 * allowed(F.greatest("na", "nb"), levels)


def bitmap(w: Column) -> Column:
    """64 bits, set by words."""
    return F.aggregate(w, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(x).bitwiseAND(F.lit(63)).cast("int"))))


def near_later(docs: DataFrame, levels=LEVELS) -> DataFrame:
    """(h1, h2): hashes of the distinct lines that have a nearly equal line (not an equal one) before them."""
    own, f = lines(docs), occurrence(docs)
    # keys in a projection of their own, which Spark can evaluate in parts; outer, or else it would evaluate them twice, to leave out lines without any
    split = own.select(F.xxhash64("x").alias("id"), document_order(docs).alias("o"), words_of(F.col("x")).alias("w"))
    keys = split.select("id", "o", line_keys(F.col("w"), levels).alias("ks")).select("id", "o", F.explode_outer("ks").alias("k")).where("k IS NOT NULL AND o IS NOT NULL").repartition("k")
    # leaders are lines of the first documents with keys of several lines
    leaders = keys.groupBy("k").agg(F.min_by("id", "o").alias("b"), F.min("o").alias("ob"), F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select(F.col("k").alias("key"), "b", "ob")
    with small_methods(docs.sparkSession):
        # o is asked for on this side too, so that both read the same shuffle
        met = stage(lambda: keys.join(leaders.hint("shuffle_hash"), (F.col("k") == F.col("key")) & (F.col("id") != F.col("b")) & (F.col("ob") <= F.col("o"))).groupBy("k", F.col("id").alias("a"), "b", "ob").agg(F.min("o").alias("oa")).hint("rebalance"))
    ids = stage(lambda: met.select(F.col("a").alias("id")).unionByName(met.select(F.col("b").alias("id"))).distinct())
    few = ids.count() <= BROADCAST_IDS
    texts = own.withColumn("id", F.xxhash64("x")).join(F.broadcast(ids) if few else ids, "id", "left_semi").groupBy("id", "x").agg(F.min(f).alias("f"))
    texts = stage(lambda: texts.withColumn("w", words_of(F.col("x"))).select("id", "f", F.size("w").alias("n"), bitmap(F.col("w")).alias("bits"), "w", F.xxhash64(F.lit(1), "x").alias("h2")))

    def later(pairs: DataFrame) -> DataFrame:
        """(id, h2) of the later line of each pair (a, b) that is near."""
        a, b = (texts.select(*[F.col(x).alias(x + c) for x in ("f", "n", "bits", "w", "h2")], F.col("id").alias(c)) for c in "ab")
        both = pairs.join(a, "a").join(b, "b").where(may_be_near(levels))
        turned = F.col("na") < F.col("nb")
        both = both.select("a", "b", "fa", "fb", "h2a", "h2b", F.when(turned, F.col("wb")).otherwise(F.col("wa")).alias("wa"), F.when(turned, F.col("wa")).otherwise(F.col("wb")).alias("wb"))
        second = F.col("fa") > F.col("fb")
        return within(both, levels).select(F.when(second, F.col("a")).otherwise(F.col("b")).alias("id"), F.when(second, F.col("h2a")).otherwise(F.col("h2b")).alias("h2")).distinct()

    # one pair a line, with the first leader of its keys; then its other leaders, unless the later line is settled
    first = met.groupBy("a").agg(F.min(F.struct("ob", "b"))["b"].alias("b"))
    settled = stage(lambda: later(first))
    done = settled.select(F.col("id").alias("a")).distinct().withColumn("done", F.lit(True))
    others = met.select("a", "b", "oa", "ob").distinct().join(first.withColumnRenamed("b", "was"), "a").where("b <> was").join(done, "a", "left").where("done IS NULL OR oa <= ob")
    others = stage(lambda: others.select("a", "b"))
    settled = stage(lambda: settled.unionByName(later(others)).distinct())
    # keys of several lines: a line that is not settled yet asks whether some other line of its keys comes before it and is near
    lone = texts.join(settled.select("id").distinct(), "id", "left_anti").select("id")
    rows = stage(lambda: met.select("k", F.col("a").alias("id")).join(texts, "id"))
    a = rows.join(lone, "id").select("k", "id", "h2", *[F.col(x).alias(x + "a") for x in ("f", "n", "bits", "w")])
    b = rows.select(F.col("k").alias("key"), F.col("id").alias("other"), *[F.col(x).alias(x + "b") for x in ("f", "n", "bits", "w")])
    fits = (F.col("k") == F.col("key")) & (F.col("fb") < F.col("fa")) & may_be_near(levels)
    longer, shorter = (F.when((F.col("na") >= F.col("nb")) == first, F.col("wa")).otherwise(F.col("wb")) for first in (True, False))
    near = let(F.struct(longer.alias("a"), shorter.alias("b")), lambda v: is_near_by_level(v["a"], v["b"], levels))
    more = stage(lambda: a.join(b, fits & near, "left_semi").select("id", "h2"))
    return settled.unionByName(more).select(F.col("id").alias("h1"), "h2").distinct()


def removed(docs: DataFrame, levels=LEVELS) -> DataFrame:
    """(doc_id, mark, places, n_near): per document the sorted places of its removed lines, and how many of them have no equal line before them."""
    near = stage(lambda: near_later(docs, levels))
    # from here on a line is its 128-bit hash
    at = lines(docs).select("doc_id", "mark", "place", occurrence(docs).alias("f"), F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(1), "x").alias("h2"))
    at = stage(lambda: at)
    first = at.groupBy("h1", "h2").agg(F.min("f").alias("first"), F.max("f").alias("last")).where("first <> last").drop("last")
    gone = first.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "full")
    hit = at.join(gone, ["h1", "h2"]).withColumn("later", F.coalesce(F.col("f") != F.col("first"), F.lit(False)))
    hit = hit.where("later OR near")
    return stage(lambda: hit.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("place")).alias("places"), F.collect_set(F.when(~F.col("later"), F.col("place"))).alias("near")).select("doc_id", "mark", "places", F.size("near").cast("long").alias("n_near")))


def kept(text: Column, places: Column) -> Column:
    """The text without the lines at these sorted places: what lies between them, put together again."""

    def between(v: Column) -> Column:
        after = lambda i: F.when(i == 0, 0).otherwise(F.get(v["p"], i - 1) + 1)
        until = lambda i: F.coalesce(F.get(v["p"], i), F.size(v["x"]))
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(v["p"])), lambda i: F.slice(v["x"], after(i) + 1, until(i) - after(i)))), "\n")

    return F.when(places.isNull(), text).otherwise(let(F.struct(F.split(F.coalesce(text, F.lit("")), "\n").alias("x"), places.alias("p")), between))


def _applied(docs: DataFrame, levels) -> DataFrame:
    """(row, places, n_near): the rows of docs as structs, with what is removed."""
    gone = removed(docs, levels)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return rows.join(gone.hint("shuffle_hash"), F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("row.text") == F.col("mark")), "left").select("row", "places", "n_near")


def clean(docs: DataFrame, levels=LEVELS) -> DataFrame:
    """docs with the text that is left; documents of which nothing with a word is left, though there was, are dropped."""
    out = _applied(docs, levels).withColumn("left", kept(F.col("row.text"), F.col("places")))
    return out.where(F.col("places").isNull() | has_word(F.col("left"))).select(*[(F.col("left") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])


def dedup(docs: DataFrame, levels=LEVELS) -> DataFrame:
    """doc_id, n_lines, n_removed, n_near and kept_sha256 of each row."""
    n_lines = F.size(F.filter(F.split(F.coalesce("row.text", F.lit("")), "\n"), has_word))
    size = F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long")
    text = F.coalesce(kept(F.col("row.text"), F.col("places")), F.lit(""))
    return _applied(docs, levels).select("row.doc_id", n_lines.cast("long").alias("n_lines"), size.alias("n_removed"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.sha2(text, 256).alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
