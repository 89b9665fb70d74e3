import hashlib
import random

from pyspark.sql import functions as F

from routeloom.llm import line_dedup as l


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def near(a, b, levels=l.LEVELS):
    a, b = a.split(), b.split()
    d = max([t for n, t in levels if max(len(a), len(b)) >= n], default=0)
    return a != b and abs(len(a) - len(b)) <= d and distance(a, b) <= d or bool(d) and a == b


def brute(rows):
    """rows: (id, text), ids distinct."""
    at = [(i, p, x) for i, t in sorted(rows) for p, x in enumerate((t or "").split("\n")) if x.strip("\x20\x09\x0a\x0b\x0c\x0d")]
    first = {}
    for k, (_, _, x) in enumerate(at):
        first.setdefault(x, k)
    links = {x: [y for y in first if y != x and near(x, y)] for x in first}
    out = {}
    for i, t in rows:
        gone, close = set(), set()
        for k, (j, p, x) in enumerate(at):
            if j == i:
                earlier = any(first[y] < first[x] for y in links[x])
                if first[x] != k or earlier:
                    gone.add(p)
                    if first[x] == k:
                        close.add(p)
        kept = "\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in gone)
        out[i] = (sum(j == i for j, _, _ in at), len(gone), len(close), hashlib.sha256(kept.encode()).hexdigest())
    return out


def edited(rnd, w, n):
    w = list(w)
    for _ in range(n):
        k, how = rnd.randrange(len(w) + 1), rnd.randrange(3)
        if how == 0:
            w.insert(k, rnd.choice(["new", "é", "x"]))
        elif w and how == 1:
            del w[min(k, len(w) - 1)]
        elif w:
            w[min(k, len(w) - 1)] = rnd.choice(["other", "é", "y"])
    return w


def check(spark, rows, parts=4, kind="long"):
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(parts)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.n_near, r.kept_sha256) for r in l.dedup(df).collect()} == brute(rows)


def test_against_brute_force(spark):
    for seed in (8, 9):
        rnd = random.Random(seed)
        base = [[rnd.choice("abcdefgh") for _ in range(rnd.choice([3, 8, 9, 10, 11, 18, 19, 20, 21, 40]))] for _ in range(14)]
        rows = [(i * 5, "\n".join(" ".join(edited(rnd, rnd.choice(base), rnd.randrange(5))) for _ in range(rnd.randrange(6)))) for i in range(60)]
        rows += [(999, None), (998, ""), (997, "\n \n"), (996, "a " * 60), (995, "a " * 62), (994, "a  " * 63 + "\n\n" + "b " * 9)]
        check(spark, rows)


def test_group_of_near_copies_and_very_long(spark):
    """A line of which every copy differs in another word; unlike lines with a common beginning; very long lines and texts of very many lines."""
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(base[:i % 30] + [f"v{i}"] + base[i % 30 + 1 :])) for i in range(120)]
    rows += [(500 + i, " ".join(base[:15] + [f"u{i}-{k}" for k in range(15)])) for i in range(60)]
    long = [str(rnd.randrange(9)) for _ in range(800)]
    rows += [(900, " ".join(long)), (901, " ".join(edited(rnd, long, 2))), (904, "word " * 60_000), (902, "w" * 200_000), (903, "\n".join(f"line {i % 150}" for i in range(20_000)))]
    check(spark, rows)


def test_distance(spark):
    rnd = random.Random(9)
    rows = []
    for _ in range(400):
        a = [rnd.choice("ab") for _ in range(rnd.randrange(0, 14))]
        b = edited(rnd, a, rnd.randrange(5))
        rows.append((max(a, b, key=len), min(a, b, key=len)) if len(a) != len(b) else (a, b))
    for d in (1, 2, 3):
        df = spark.createDataFrame([(a, b) for a, b in rows if len(a) - len(b) <= d], "wa array<string>, wb array<string>")
        want = sorted((a, b) for a, b in rows if len(a) - len(b) <= d and distance(a, b) <= d)
        assert sorted(map(tuple, l.within(df, [(0, d)]).collect())) == want


def test_edges(spark):
    line = "this line is long enough to be compared with any other line"
    df = spark.createDataFrame([(None, line, 1), (4, line + "s\nx", 2), (4, line + "s\nx", 3), (6, None, 4), (7, line + "s", 5), (5, "shared id one", 6), (5, line + "s\nshared id two", 7), (None, "other text without an id", 8)], "doc_id long, text string, places int")
    out = sorted((str(r.doc_id), r.n_removed, r.n_near) for r in l.dedup(df).collect())
    assert out == [("4", 0, 0), ("4", 0, 0), ("5", 0, 0), ("5", 1, 0), ("6", 0, 0), ("7", 1, 0), ("None", 0, 0), ("None", 1, 1)]
    cleaned = l.clean(df)
    assert cleaned.columns == df.columns
    left = sorted((str(r.doc_id), r.text, r.places) for r in cleaned.collect())
    assert left == [("4", line + "s\nx", 2), ("4", line + "s\nx", 3), ("5", "shared id one", 6), ("5", "shared id two", 7), ("6", None, 4), ("None", "other text without an id", 8)]
    clash = df.withColumnsRenamed({"places": "row"}).withColumn("mark", F.lit(1))
    assert l.clean(clash).columns == clash.columns and l.clean(clash).count() == 6
    assert l.dedup(df.limit(0)).count() == 0


def test_any_id(spark):
    line = " ".join(f"w{i}" for i in range(12))
    check(spark, [("b", line), ("a", line + " x"), ("é", line + "\nnew")], kind="string")
    check(spark, [(2, line), (-1, line + " x")], kind="smallint")


def test_keys(spark):
    """Lines within their distance share a key, whatever their lengths; a line has few keys."""
    rnd = random.Random(5)
    pairs = []
    for n in [*range(9, 50), 62, 63, 64, 65, 66, 127, 128, 129, 200]:
        for _ in range(12):
            a = [f"{rnd.choice('abc')}{rnd.randrange(4)}" for _ in range(n)]
            b = edited(rnd, a, rnd.randrange(1, 3))
            if near(" ".join(a), " ".join(b)):
                pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    sized = df.select(F.filter(l.line_keys(F.col("a")), lambda k: k.isNotNull()).alias("ka"), F.filter(l.line_keys(F.col("b")), lambda k: k.isNotNull()).alias("kb"), F.size("a").alias("n")).cache()
    assert len(pairs) > 300 and sized.where(~F.arrays_overlap("ka", "kb")).count() == 0
    # 15 rows a line of 20 words or more before: 12 to ask and 3 to be found
    assert sized.where("size(ka) > 12").count() == 0 and sized.where("n >= 20").agg(F.avg(F.size("ka"))).first()[0] < 7


def test_words(spark):
    lines = ["a b c", " a b", "a b ", "a  b", "a\tb", "a \x0b b", "\x0ca\r", "é 日 x", "a\x85b", "a", "\x1ca b"]
    df = spark.createDataFrame([(x,) for x in [*lines, "", " ", "\t \r", " x"]], "x string")
    assert {r.x: r.w for r in df.limit(len(lines)).select("x", l.words_of(F.col("x")).alias("w")).collect()} == {x: [w.decode() for w in x.encode().split()] for x in lines}
    assert sorted(r.x for r in df.where(l.has_word(F.col("x"))).collect()) == sorted([*lines, " x"])
