import hashlib
import random

import numpy as np
import pytest

from routeloom.llm import bpe


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder()


def library(tok, text):
    e = tok.encode(text or "", add_special_tokens=False)
    return np.array(e.ids, "<u4").tobytes(), tok.decode(e.ids, skip_special_tokens=False).encode()


TEXTS = ["", None, " ", "Hello  World's café! 日本", "a <|endoftext|>b<|startoftext|>'s", "x y z ́ é", "İSTANBUL ΣΑΣ ß ﬁ", "1234 5'll!!'s&&&", "\x00\x1c\x1d \x85", "👩‍👩‍👧 नमस्ते"]


def test_whole_texts_equal_the_library(coder):
    assert list(coder(TEXTS)) == [library(coder.tok, t) for t in TEXTS]


@pytest.mark.parametrize("alphabet", ["ab", "thehing", "a'sl!", "aéß́日", "0a<|endoftext|>", "%&*$#"])
def test_tree_equals_the_library(coder, alphabet):
    rnd = random.Random(7)
    for n in (1, 50, 700, 3000):
        text = "".join(rnd.choice(alphabet) for _ in range(n))
        assert bpe.encode_tree(coder.tok, text, 64) == coder.tok.encode(text, add_special_tokens=False).ids


def test_periodic_text_and_long_pieces(coder):
    small = bpe.Coder(long=40)
    for text in ("a" * 5000, "na" * 3000, "x" * 39 + " " + "thes" * 900 + " end", "<|endoftext|>" * 400):
        assert list(small([text])) == [library(coder.tok, text)]


def test_texts_of_the_tables_use_trees(spark):
    """Every document of the smallest tables equals the library's result, and their longer pieces come from trees."""
    fresh = bpe.Coder()
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += [f"see https://www.example.org/{t.replace(' ', '_')}?q=1 for more" for t in texts[:40] if t]
    for t, got in zip(texts, fresh(texts), strict=True):
        assert got == library(fresh.tok, t)
    assert fresh.trees > 40


def test_forgetting_does_not_matter(coder):
    small = bpe.Coder(remembered=3)
    for text in ("one two three four five", "six one"):
        assert list(small([text])) == [library(coder.tok, text)]


def test_pieces_learnt_together(coder):
    rnd = random.Random(4)
    text = " ".join("".join(rnd.choice("abTHÉß") for _ in range(rnd.randrange(5))) + "".join(rnd.choice(".,%|<>!") for _ in range(rnd.randrange(3))) for _ in range(3000))
    fresh = bpe.Coder()
    assert list(fresh([text, text[:50]])) == [library(coder.tok, text), library(coder.tok, text[:50])]


def test_query_and_edge_rows(spark, coder):
    df = spark.createDataFrame([(1, "Das ist", 1), (None, None, 2), (1, "Das ist", 3), (2, "", 4)], "doc_id long, text string, ids int")
    rows = bpe.digest(df).collect()
    assert len(rows) == 4
    by = {r.doc_id: r for r in rows}
    ids, shown = library(coder.tok, "Das ist")
    assert by[1].n_tokens == len(ids) // 4 and by[1].ids_sha256 == hashlib.sha256(ids).hexdigest() and by[1].decoded_sha256 == hashlib.sha256(shown).hexdigest()
    assert by[2].n_tokens == 0 and by[None].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.digest(df.limit(0)).count() == 0
    out = {r.doc_id: r for r in bpe.encode(df).collect()}
    assert np.array(out[1].ids, "<u4").tobytes() == ids and out[1].decoded.encode() == shown
