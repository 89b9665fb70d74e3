"""Substring dedup: words inside a window that occurs earlier in the corpus are removed.

Rabin-Karp hashes of every window of WINDOW words are rolled over each whole
text. Most windows are found once in the corpus, and these need not travel: a
window's smallest hash of GRAM words (its anchor) is the same wherever the
window occurs, so only windows whose anchor was counted at two places or more
go on. Their 128-bit hashes are counted, every place but the first is a
removal, and a document's removals merge into maximal intervals.

Documents become blocks, written once with their texts. Blocks ask the parts of
the anchor table and then of the window table (see blocks.py), one entry per
key and block, so a passage found in a third of all documents is as many entries
as there are blocks, and a long text or many documents are never more rows.

Defined results: a null or empty text has no words; ids may be of any type that
sorts, a null id comes after all others; rows with equal id and equal text are
one document; of different texts under one id (or null ids), which are documents
of their own, the one with the smaller hash comes first; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import by_part, kind_of, pack, pack_sorted, part_of, summed, text_blocks, texts_of, unpack, unpack_sorted
from .common import stage, table
from .hashing import BASES, U, Words, left, rolling, sliding

WINDOW, GRAM = 20, 8
#: Bytes of the corpus per part of the tables of anchors and windows.
LOAD = 12_000_000


def _sequence(ids: pa.Array, marks: np.ndarray) -> np.ndarray:
    """Place of each document in the order of ids and text hashes; equal ones have the same."""
    rank = np.asarray(pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense")).astype(np.int64)
    order = np.lexsort((marks, rank))
    new = np.append(False, (rank[order][1:] != rank[order][:-1]) | (marks[order][1:] != marks[order][:-1])) if len(order) else np.zeros(0, bool)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


class Block:
    """Texts of a block, their words' hashes and their windows."""

    def __init__(self, sizes: bytes, data: bytes, window: int, gram: int, kinds: int = 2) -> None:
        self.data, self.edge, texts = texts_of(sizes, data)
        self.h, self.size = Words(kinds).words(texts)
        self.window, self.gram = window, gram

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct anchors, how often the block has each, every window's anchor, and which windows lie in one text."""
        g = rolling(self.h[0], self.gram, BASES[0])
        reach = self.window - self.gram + 1
        low = sliding(g, reach, np.minimum) if len(g) >= reach else np.zeros(0, U)
        ok = left(self.size)[: len(low)] >= self.window
        # the places that are the smallest of some window around them
        if not len(low):
            return np.zeros(0, U), np.zeros(0, np.int64), low, ok
        edge = np.zeros(reach - 1, U)
        seen = sliding(np.concatenate([edge, np.where(ok, low, U(0)), edge]), reach, np.maximum)
        return *np.unique(g[(seen == g) & (seen > 0)], return_counts=True), low, ok

    def windows(self, ids: pa.Array, marks: bytes, shared: np.ndarray, parts: int) -> dict[str, np.ndarray]:
        """Windows whose anchor is shared: document, place and order of each (``doc``, ``place``, ``code``), their entries' index (``entry``), and the entries, one per distinct window, part by part (``first``, ``h1``, ``h2``, ``edge``)."""
        keys, _, low, ok = self.anchors()
        known = np.zeros(len(keys), bool)
        known[by_part(keys, parts)[0]] = shared
        keys = keys[known]
        hit = ok & (keys[np.minimum(np.searchsorted(keys, low), len(keys) - 1)] == low) if len(keys) else np.zeros(len(low), bool)
        at = np.flatnonzero(hit)
        doc = np.repeat(np.arange(len(self.size)), self.size)[at]
        place = at - (np.cumsum(self.size) - self.size)[doc]
        h1, h2 = (rolling(x, self.window, base)[at] for x, base in zip(self.h, BASES))
        code = _sequence(ids, unpack(marks, np.int64))[doc] << 32 | place
        order = np.argsort(code, kind="stable")
        order = order[np.argsort(h1[order], kind="stable")]
        new = np.append(True, (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])) if len(order) else np.zeros(0, bool)
        first = order[new]
        # entries go to their parts in the order of places, where neighbours differ little
        sort = np.argsort(first, kind="stable")
        part = part_of(h1[first[sort]], parts)
        sort = sort[np.argsort(part, kind="stable")]
        number = np.empty(len(first), np.int64)
        number[sort] = np.arange(len(first))
        entry = np.empty(len(at), np.int64)
        entry[order] = number[np.cumsum(new) - 1]
        first = first[sort]
        return {"doc": doc, "place": place, "code": code, "entry": entry, "first": first, "h1": h1[first], "h2": h2[first], "edge": np.searchsorted(part_of(h1[first], parts), np.arange(parts + 1))}


def _shared_anchors(blocks: DataFrame, window: int, gram: int, parts: int) -> DataFrame:
    """(block, part, bits): which anchors of a block, in the order of the parts, are found at two places or more."""

    def ask(batches):
        for b in batches:
            for block, sizes, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                keys, counts, _, _ = Block(sizes, data, window, gram, 1).anchors()
                place, edge = by_part(keys, parts)
                keys, counts = keys[place], np.minimum(counts[place], 2).astype(np.uint8)
                full = np.flatnonzero(np.diff(edge)).tolist()
                cut = [slice(edge[p], edge[p + 1]) for p in full]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(full), pa.int64()), pa.array(full, pa.int32()), pa.array([pack_sorted(keys[c]) for c in cut], pa.binary()), pa.array([pack(counts[c]) for c in cut], pa.binary())], ["block", "part", "keys", "counts"])

    def answer(rows: pa.Table) -> pa.Table:
        total = summed([unpack_sorted(x) for x in rows["keys"].to_pylist()], [unpack(x, np.uint8).astype(np.int64) for x in rows["counts"].to_pylist()])
        return pa.table([rows["block"], rows["part"], pa.array([pack(x > 1) for x in total], pa.binary())], ["block", "part", "bits"])

    asked = blocks.select("block", "sizes", "data").mapInArrow(ask, "block long, part int, keys binary, counts binary")
    return asked.groupBy("part").applyInArrow(answer, "block long, part int, bits binary")


def _bits(rows: pa.Table, step: int) -> np.ndarray:
    """The answers of a step, part by part."""
    own = rows.filter(pc.equal(rows["step"], step))
    return np.concatenate([np.zeros(0, bool), *(unpack(x, bool) for x in own["data"].to_pylist())])


def _with(blocks: DataFrame, *answers: DataFrame) -> DataFrame:
    """Blocks (step 0) and the answers that they got (steps 1 and 2), as rows of one form."""
    ids = f"CAST(NULL AS {blocks.schema['ids'].dataType.simpleString()}) AS ids"
    out = blocks.selectExpr("block", "0 AS step", "0 AS part", "ids", "marks", "sizes", "data")
    for i, a in enumerate(answers):
        out = out.unionByName(a.selectExpr("block", f"{i + 1} AS step", "part", ids, "CAST(NULL AS binary) AS marks", "CAST(NULL AS binary) AS sizes", "bits AS data"))
    return out


def _first_windows(blocks: DataFrame, shared: DataFrame, window: int, gram: int, parts: int) -> DataFrame:
    """(block, part, bits): which distinct windows of a block, in the order of the parts, occur nowhere earlier than there."""

    def ask(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("step", "ascending"), ("part", "ascending")])
        own, ids = rows.slice(0, 1).to_pydict(), rows["ids"].combine_chunks().slice(0, 1).flatten()
        w = Block(own["sizes"][0], own["data"][0], window, gram).windows(ids, own["marks"][0], _bits(rows, 1), parts)
        marks, out = unpack(own["marks"][0], np.int64), []
        for p in np.flatnonzero(np.diff(w["edge"])).tolist():
            c = slice(w["edge"][p], w["edge"][p + 1])
            docs, doc = np.unique(w["doc"][w["first"][c]], return_inverse=True)
            out.append((own["block"][0], p, docs, marks[docs].tobytes(), w["h1"][c].tobytes(), w["h2"][c].tobytes(), pack(np.diff(doc.astype(np.int32), prepend=np.int32(0))), pack(np.diff(w["place"][w["first"][c]].astype(np.int32), prepend=np.int32(0)))))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r[2]) for r in out)]), pa.int32()), ids.take(pa.array(np.concatenate([np.zeros(0, np.int64), *(r[2] for r in out)]))))
        return pa.table([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), lists, *(pa.array([r[j] for r in out], pa.binary()) for j in range(3, 8))], ["block", "part", "ids", "marks", "h1", "h2", "doc", "place"])

    def answer(rows: pa.Table) -> pa.Table:
        column = lambda c, kind: [np.frombuffer(x, kind) for x in rows[c].to_pylist()]
        marks, h1, h2 = column("marks", np.int64), column("h1", U), column("h2", U)
        delta = lambda c: [np.cumsum(unpack(x, np.int32)).astype(np.int64) for x in rows[c].to_pylist()]
        before = np.cumsum([0, *(len(m) for m in marks)])
        doc = np.concatenate([d + n for d, n in zip(delta("doc"), before)])
        code = _sequence(rows["ids"].combine_chunks().flatten(), np.concatenate(marks))[doc] << 32 | np.concatenate(delta("place"))
        a, b = np.concatenate(h1), np.concatenate(h2)
        order = np.lexsort((code, b, a))
        new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
        first = np.empty(len(order), bool)
        first[order] = code[order] == code[order][new][np.cumsum(new) - 1]
        return pa.table([rows["block"], rows["part"], pa.array([pack(x) for x in np.split(first, np.cumsum([len(h) for h in h1])[:-1])], pa.binary())], ["block", "part", "bits"])

    asked = _with(blocks, shared).groupBy("block").applyInArrow(ask, f"block long, part int, ids {blocks.schema['ids'].dataType.simpleString()}, marks binary, h1 binary, h2 binary, doc binary, place binary")
    return asked.groupBy("part").applyInArrow(answer, "block long, part int, bits binary")


def intervals(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal half-open intervals of words that the windows at these sorted starts cover."""
    if not len(starts):
        return []
    gap = np.flatnonzero(starts[1:] > starts[:-1] + window)
    return list(zip(starts[np.append(0, gap + 1)].tolist(), (starts[np.append(gap, len(starts) - 1)] + window).tolist()))


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row; with ``texts`` also the kept text and the removed intervals."""
    blocks = stage(lambda: text_blocks(docs))
    parts = max(64, (blocks.agg(F.sum("load")).first()[0] or 0) // LOAD)
    shared = stage(lambda: _shared_anchors(blocks, window, gram, parts))
    firsts = stage(lambda: _first_windows(blocks, shared, window, gram, parts))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("step", "ascending"), ("part", "ascending")])
        own, ids = rows.slice(0, 1).to_pydict(), rows["ids"].combine_chunks().slice(0, 1).flatten()
        block = Block(own["sizes"][0], own["data"][0], window, gram)
        w, first = block.windows(ids, own["marks"][0], _bits(rows, 1), parts), _bits(rows, 2)
        later = ~first[w["entry"]] | (w["code"] != w["code"][w["first"]][w["entry"]]) if len(first) else np.zeros(0, bool)
        starts, of = w["place"][later], w["doc"][later]
        cut, out = np.searchsorted(of, np.arange(len(ids) + 1)), []
        for i in range(len(ids)):
            words = block.data[block.edge[i] : block.edge[i + 1]].split()
            cover, kept, last = intervals(starts[cut[i] : cut[i + 1]], window), [], 0
            for x, y in cover:
                kept += words[last:x]
                last = y
            line = b" ".join(kept + words[last:])
            out.append((len(words), sum(y - x for x, y in cover), hashlib.sha256(line).hexdigest(), line.decode() if texts else None, [{"first": x, "after": y} for x, y in cover]))
        return pa.table([ids, *(pa.array([r[j] for r in out], f.type) for j, f in enumerate(fields))], ["doc_id", *(f.name for f in fields)])

    fields = [pa.field("n_words", pa.int64()), pa.field("n_removed", pa.int64()), pa.field("kept_sha256", pa.string())]
    if texts:
        fields += [pa.field("kept", pa.string()), pa.field("removed", pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())])))]
    extra = ", kept string, removed array<struct<first:long,after:long>>" if texts else ""
    return _with(blocks, shared, firsts).groupBy("block").applyInArrow(run, f"doc_id {kind_of(docs)}, n_words long, n_removed long, kept_sha256 string{extra}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
