import random
import re

from routeloom.llm import quality_rules as q


def brute(text):
    t = text or ""
    w = [x for x in re.split("[\x20\x09-\x0D]+", t) if x]
    lines = [x for x in t.split("\n") if x.strip("\x20\x09\x0a\x0b\x0c\x0d")]
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {p for i, s in enumerate(wins) if wins.count(s) > 1 for p in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in q.SYMBOLS for c in t), len(lines) - len(set(lines)), len(covered)


def test_measurements(spark):
    rnd = random.Random(4)
    texts = [None, "", " ", "a", "a b c d e", "a b c d e a b c d e", "x " * 50, "é日本 ✓ 𝄞!", "#*$%&|<> a\n\n \na\nb\na", "a\x0bb\x0cc\x85d e"]
    texts += [rnd.choice([" ", "\n"]).join(rnd.choice("abc") for _ in range(rnd.randrange(60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "a", 1), (0, None, 1)], "doc_id long, text string, fails int")
    led = q.ledger(df)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.fails) for r in led.collect()), key=repr)
    assert len(got) == len(texts) + 2
    for i, *m, fails in got:
        if i is not None:
            assert tuple(m) == brute(texts[i]), texts[i]
            n, _, _, _, rep = m
            assert bool(fails & q.mask(q.BASE)) == (n < 10 or 100 * rep > 20 * n)
    assert q.ledger(df.limit(0)).count() == 0


def test_ablations(spark):
    led = spark.createDataFrame([(0,), (1,), (2,), (3,), (3,), (4,)], "fails long")
    got = {r.rule: (r.n_failed, r.n_failed_alone, r.n_kept_without) for r in q.ablations(led, "base").collect()}
    assert got == {"few_words": (3, 1, 3), "repeated_words": (3, 1, 3)}
    assert q.mask("v2") == 0b1111111 and led.where(q.verdict(led, "base")).count() == 2
