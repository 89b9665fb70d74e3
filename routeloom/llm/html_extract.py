"""Main text of web pages: marked structure first, nearest-URL differencing for the rest.

A page's text blocks are read by a tolerant tag scanner. Blocks within
containers that say what they are (menus, headers, footers, sidebars, notices,
adverts, forms, reader comments) go. If the page marks its content (article,
main, or a container named so), its blocks are the text. Otherwise pages are
paired by URL path within each host: in path order, every page is aligned with
the page before and the page after it by a longest common subsequence of their
lines, and lines shared with either are deleted. A neighbour that shares all
lines is a copy, not a sibling from the same template, and deletes nothing.

Only line hashes are sorted and paired. Positions in the sorted order come from
a table of rows per partition, so pairs are found by an equi-join of positions
and the largest host needs no task of its own.

Defined results: a null or empty html gives an empty text; a null url counts as
an empty path on an empty host; repeated rows get equal texts; null page ids
are kept; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

# Fixed values of the HTML language, and words that name a container's purpose.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg math object canvas audio video select button datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"), "th": ("th", "td")}
DROPPED = RAW | frozenset("head nav footer aside form menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu topbar breadcrumb breadcrumbs pagination pager footer sidebar aside cookie cookies consent gdpr notice notices notification alert popup modal overlay comment comments disqus reply replies respond share sharing social related recommended newsletter subscribe subscription signup login widget masthead skip banner hidden".split()
)
#: Words beside such a one that say where or what it is, and words that turn its meaning round.
BESIDE = frozenset("area articles bar block body bottom box bottom col column container content first global inner item items last left link links list main outer page panel posts primary right row secondary section site small stories top unit widgets wrap wrapper".split())
TURNED = frozenset("has no non not overflow show toggle visible with without".split())
HEADS = frozenset(("header",))
CONTENT = frozenset("article content main post entry story".split())
NOT_CONTENT = frozenset("header footer meta nav list".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")
_URL = re.compile(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)")

#: Lines of a page times lines of its neighbour up to which an alignment keeps all rows.
CELLS = 1 << 27


def _marks(name: str) -> bool:
    """Whether a class or id says that its element is not content: its last word does, or some word where all others only say which one."""
    parts = [x for x in _NAME.findall(name) if not x.isdigit()]
    if not parts or TURNED.intersection(parts):
        return False
    return parts[-1] in MARKS or bool(MARKS.intersection(parts)) and all(x in MARKS or x in BESIDE for x in parts)


def _purpose(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is dropped, and whether it says that it holds the content."""
    if name in DROPPED:
        return True, False
    content = name in ("article", "main")
    if not attributes or attributes.isspace():
        return False, content
    found = {}
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        found.setdefault(key.lower(), html.unescape(a or b or c).lower())
    role = found.get("role", "")
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "") or role in ROLES:
        return True, False
    if name in ("html", "body"):
        return False, False
    names = (found.get("class", "") + " " + found.get("id", "")).split()
    if any(_marks(x) for x in names) and (not content or any("comment" in x for x in names)):
        return True, False
    words = [set(_NAME.findall(x)) for x in names]
    return False, content or role == "main" or any(x & CONTENT and not x & NOT_CONTENT for x in words)


def blocks(page: str | None) -> list[tuple[str, int]]:
    """Text blocks in page order, each with 0 (dropped), 1 (undecided), 2 (in a container named as content) or 3 (in article or main)."""
    page = page or ""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # name, dropped, level
    opened: Counter[str] = Counter()  # names on the stack
    dropped, level, at = False, 1, 0

    def flush() -> None:
        if text:
            line = _SPACE.sub(" ", "".join(text)).strip()
            if line:
                out.append((line, 0 if dropped else level))
            text.clear()

    def pop_to(i: int) -> None:
        nonlocal dropped, level
        flush()
        opened.subtract(x[0] for x in stack[i:])
        del stack[i:]
        dropped, level = stack[-1][1:] if stack else (False, 1)

    end = len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            text.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            text.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing = name.lower(), bool(m[1] or m[4])
        if closing:
            for i in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[i][0] == name:
                    if name in BLOCKS or stack[i][1] != dropped or any(x[0] in BLOCKS for x in stack[i:]) or (stack[i - 1][1:] if i else (False, 1)) != (dropped, level):
                        pop_to(i)
                    else:
                        opened.subtract(x[0] for x in stack[i:])
                        del stack[i:]
                    break
            else:
                if name in BLOCKS:
                    flush()
            continue
        attributes = m[3] if m[2] else m[6]
        if name in RAW and not attributes.rstrip().endswith("/"):
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name in BLOCKS:
            flush()
            if name in ITEMS:
                for i in range(len(stack) - 1, -1, -1) if any(opened[x] for x in ITEMS[name]) else ():
                    if stack[i][0] in ("ul", "ol", "dl", "menu") or (stack[i][0] == "table") or (name in ("td", "th") and stack[i][0] == "tr"):
                        break
                    if stack[i][0] in ITEMS[name]:
                        pop_to(i)
                        break
            elif name != "br":
                for i in range(len(stack) - 1, -1, -1) if opened["p"] else ():
                    if stack[i][0] == "p":
                        pop_to(i)
                        break
                    if stack[i][0] in BLOCKS:
                        break
        if name in VOID:
            continue
        drop, content = _purpose(name, attributes)
        in_article = opened["article"] > 0
        if name == "header" and not in_article:
            drop = True
        elif not drop and not content and name in BLOCKS and attributes and not in_article:
            marks = set(_NAME.findall(" ".join(x for g in _ATTRIBUTE.findall(attributes) if g[0].lower() in ("class", "id") for x in g[1:]).lower()))
            drop = bool(marks & HEADS) and not marks & CONTENT
        deeper = max(level, 3 if name in ("article", "main") else 2) if content else level
        if (drop or dropped) != dropped or deeper != level:
            flush()
        stack.append((name, drop or dropped, deeper))
        opened[name] += 1
        dropped, level = drop or dropped, deeper
    flush()
    return out


def address(url: str | None) -> tuple[str, str]:
    m = _URL.match(url or "")
    return (m[1] or "").lower(), m[2].rstrip("/")


def _rows(a: list[int], b: list[int]) -> list[int]:
    """After each line of a, bits of b's lines that do not lengthen the common subsequence (Hyyro's bit-parallel rule)."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full, v, out = (1 << len(b)) - 1, (1 << len(b)) - 1, []
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        out.append(v)
    return out


def _lengths(v: int, m: int) -> np.ndarray:
    """Length of the common subsequence with each prefix of b, from a row."""
    bits = np.unpackbits(np.frombuffer(v.to_bytes((m + 7) // 8, "little"), np.uint8), bitorder="little")[:m]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared(a: list[int], b: list[int], cells: int = CELLS) -> list[int]:
    """Positions in a of one longest common subsequence with b."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    x, y = len(a), len(b)
    while x > lo and y > lo and a[x - 1] == b[y - 1]:
        x, y = x - 1, y - 1
    both = set(a[lo:x]) & set(b[lo:y])
    at = [i for i in range(lo, x) if a[i] in both]
    p, q = [a[i] for i in at], [v for v in b[lo:y] if v in both]
    return [*range(lo), *(at[i] for i in _middle(p, q, cells)), *range(x, len(a))]


def _middle(a: list[int], b: list[int], cells: int) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > cells and len(a) > 1:  # halves of a, split where b's parts add up to the most
        h = len(a) // 2
        top = _lengths(_rows(a[:h], b)[-1], len(b))
        low = _lengths(_rows(a[h:][::-1], b[::-1])[-1], len(b))[::-1]
        k = int(np.argmax(top + low))
        return _middle(a[:h], b[:k], cells) + [h + i for i in _middle(a[h:], b[k:], cells)]
    rows, i, j, out = _rows(a, b), len(a), len(b), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if i and not rows[i - 1] >> (j - 1) & 1:
            continue
        j -= 1
        out.append(i)
    return out[::-1]


def _parse(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, the lines that may be text and their hashes, whether the page marks its content, and a key of the row's address and lines."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        import xxhash

        for b in batches:
            host, path, hashes, lines, marked, key = [], [], [], [], [], []
            for url, page in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                found = blocks(page)
                best = max((k for _, k in found), default=0)
                chosen = [i for i, (_, k) in enumerate(found) if k and (best < 2 or k == best)]
                h, p = address(url)
                host.append(h)
                path.append(p)
                lines.append([found[i][0] for i in chosen])
                hashes.append([xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace")) - (1 << 63) for t in lines[-1]])
                marked.append(best != 1)
                key.append(xxhash.xxh3_128(repr((h, p, hashes[-1])).encode("utf-8", "replace")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, (host, path)), pa.array(hashes, pa.list_(pa.int64())), pa.array(lines, pa.list_(pa.string())), pa.array(marked), pa.array(key)], ["page_id", "url", "host", "path", "hashes", "lines", "marked", "key"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, host string, path string, hashes array<long>, lines array<string>, marked boolean, key string")


def _in_order(rows: DataFrame) -> DataFrame:
    """rows by host, path and key, with their position ``n`` in that order."""
    ordered = stage(lambda: rows.orderBy("host", "path", "key").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    sizes = sorted((r.part, r.size) for r in ordered.groupBy("part").agg(F.count(F.lit(1)).alias("size")).collect())  # one row per partition
    start, offsets = 0, []
    for part, size in sizes:
        offsets.append((part, start))
        start += size
    table_ = rows.sparkSession.createDataFrame(offsets, "part int, start long")
    return ordered.join(F.broadcast(table_), "part").withColumn("n", F.col("start") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "row", "start")


def siblings(pages: DataFrame) -> DataFrame:
    """(key, deleted): positions of the lines that each page without marked content shares with its neighbours by URL path."""
    rows = stage(lambda: _parse(pages).select("key", "host", "path", "hashes", "marked").dropDuplicates(["key"]))
    if rows.where(~F.col("marked")).limit(1).count() == 0:
        return rows.select("key", F.lit(None).cast("array<int>").alias("deleted")).limit(0)
    ordered = _in_order(rows)

    def neighbour(step: int, name: str) -> DataFrame:
        return ordered.select((F.col("n") + step).alias("n"), F.col("host").alias(f"{name}_host"), F.col("hashes").alias(name))

    paired = ordered.where(~F.col("marked")).join(neighbour(1, "before"), "n", "left").join(neighbour(-1, "after"), "n", "left")
    paired = paired.select("key", "hashes", *[F.when(F.col(f"{x}_host") == F.col("host"), F.col(x)).alias(x) for x in ("before", "after")])

    def run(batches):
        for b in batches:
            out = []
            for own, before, after in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                gone: set[int] = set()
                for other in (before, after):
                    if other:
                        same = shared(own, other)
                        if len(same) < len(own):
                            gone.update(same)
                out.append(sorted(gone))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], ["key", "deleted"])

    return paired.mapInArrow(run, "key string, deleted array<int>")


#: Rows of deletions that are broadcast at most; beyond, both sides are shuffled by key.
BROADCAST_ROWS = 20_000


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row."""
    deleted = stage(lambda: siblings(pages).where(F.size("deleted") > 0))
    small = deleted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    parsed = _parse(pages).select("page_id", "url", "lines", "key")
    joined = parsed.join(F.broadcast(deleted) if small else deleted, "key", "left")
    kept = F.filter("lines", lambda x, i: ~F.coalesce(F.array_contains("deleted", i), F.lit(False)))
    text = F.array_join(F.when(F.col("deleted").isNull(), F.col("lines")).otherwise(kept), "\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
