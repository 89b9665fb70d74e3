import random
import time

import pytest

from routeloom.llm import html_extract as h


def text(page):
    found = h.blocks(page)
    best = max((k for _, k in found), default=0)
    return "\n".join(t for t, k in found if k and (best < 2 or k == best))


ARTICLE = '<article><h1>Title  here</h1><p><b>One &amp; two<br><p>Three\n <a href="/x">link</a>ed &lt;ok&gt;</p><p></p></article>'
WANT = "Title here\nOne & two\nThree linked <ok>"


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("plain &eacute;", "plain é"),
        (f"<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li>Menu</ul></nav><!-- x --><div class='ad'>Buy</div>{ARTICLE}<footer>&copy; me</footer></body></html>", WANT),
        (f"<header><h2>Site</h2></header><aside>side<p>bar</aside>{ARTICLE}<section id='comments'><article><p>reader says</p></article></section>", WANT),
        (f"<main><div class='cookie-notice'>We use</div>{ARTICLE}<form>Name <input></form></main>", WANT),
        ("<div id='content'><p>a</p><div class='sidebar'>no</div><p>b</p></div><div>other</div>", "a\nb"),
        ("<article><p>cut off &am", "cut off &am"),
        ("<article><p>cut off</p><p", "cut off"),
        ("<article><header><h1>T</h1></header><p>a < b & c</p><div class=comments><p>x</p></div></article>", "T\na < b & c"),
        ("<article><p hidden>no</p><p style='display: none'>no</p><pre>x\n  y</pre><ul><li>1<li>2</ul></article>", "x y\n1\n2"),
        ("<ARTICLE><P>Up</P></ARTICLE>", "Up"),
        ('<div id="content" class="no-sidebar"><p>all</p><div class="main-menu">x</div></div>', "all"),
        ('<div class="main-content has-sidebar"><p>all</p><div class="left-sidebar">x</div></div>', "all"),
        ('<article><p class="overflow-hidden">a</p><div class="related-work">b</div><div class="related-posts">x</div><div class="ad-box-2">x</div></article>', "a\nb"),
    ],
)
def test_blocks(page, want):
    assert text(page) == want


def brute(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment_is_longest():
    rnd = random.Random(5)
    for _ in range(300):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randrange(15))] for _ in range(2))
        for cells in (h.CELLS, 8):
            at = h.shared(a, b, cells)
            assert at == sorted(set(at)) and len(at) == brute(a, b)
            it = iter(b)
            assert all(a[i] in it for i in at)


def test_siblings_delete_what_they_share(spark):
    def page(i, body):
        return f"<div>Site name</div><div>Home of {i}</div>{body}<div>All rights</div>"

    rows = [(i, f"https://a.example/x/{i}?q=1", page(i, f"<p>Body {i}</p><p>Common words</p>" if i < 3 else f"<p>Body {i}</p>")) for i in range(6)]
    rows += [(10, "https://b.example/x", page(1, "<p>alone</p>")), (11, None, None), (None, "https://a.example/x/2?q=1", rows[2][2]), (12, "https://a.example/z", "<article>Site name</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    got = {r.page_id: (r.text, r.n_chars) for r in h.extract(df).collect()}
    assert got[0] == ("Home of 0\nBody 0", 16)
    assert got[2] == got[None] == ("Home of 2\nBody 2", 16)
    assert got[10][0] == "Site name\nHome of 1\nalone\nAll rights"
    assert got[11] == ("", 0) and got[12] == ("Site name", 9)
    assert h.extract(df.limit(0)).count() == 0


def test_differencing_equals_brute_force(spark):
    """Pages that mark no content, of a long template and few lines of their own: lines of the page before or after, by path, go."""
    rnd, rows = random.Random(3), []
    for host in ("a.example", "b.example"):
        template = [f"{host} line {i}" for i in range(30)]
        for path in rnd.sample(range(1000), 25):
            own = [f"{host} {path} text {k}" for k in range(rnd.randrange(1, 5))]
            series = [f"{host} series {path // 200}"]
            rows.append((len(rows), f"http://{host}/p/{path:04d}", template[: rnd.randrange(20, 28)] + series + own + template[29 - rnd.randrange(2) :]))
    html = [(i, u, "".join(rnd.choice([f"<div>{x}</div>", f"<p>{x}"]) for x in lines)) for i, u, lines in rows]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(html, "page_id long, url string, html string").repartition(3)).collect()}
    order = sorted(rows, key=lambda r: r[1])
    for k, (i, u, lines) in enumerate(order):
        near = [r for r in order[max(0, k - 1) : k + 2] if r[0] != i and r[1][:16] == u[:16]]
        want = [x for x in lines if not any(x in r[2] for r in near)]
        assert got[i] == "\n".join(want) and any("text" in x for x in want)


def test_deep_nesting_is_linear():
    began = time.process_time()
    for page in ("<div>" * 100_000 + "x", "<b>" * 100_000 + "</i>" * 100_000 + "x", "<ul>" + "<li>" * 100_000 + "x", "<p>" * 100_000 + "x", "<div><span>" * 50_000 + "</p>" * 50_000 + "x"):
        assert text(page) == "x"
    assert time.process_time() - began < 60


def test_table_matches_a_plain_reading(spark):
    import re
    from html import unescape

    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in h.extract(df).collect()}
    for r in df.collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)
        parts = re.split(r"</?(?:h1|p|br)>", re.sub(r"<[^>]*\Z", "", body[1])) if body else []
        want = "\n".join(x for x in (re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", "", p))).strip() for p in parts) if x)
        assert got[r.page_id] == want
