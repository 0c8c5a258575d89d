"""Benchmark decontamination by Wu-Manber search over words.

The alphabet is words: A-Z lower-cased, then runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``. A window is
``WINDOW`` consecutive words of an item (an item of fewer words, but not none, is one window). For each
window length a shift table over blocks of two words says how far the search may move on, blocks with
shift 0 select a bucket of windows that end in that block, and direct comparison confirms.

The benchmark goes to the executors as windows in blocks of at most ``BLOCK_BYTES`` of text; a benchmark of
more blocks than ``BLOCKS_A_PASS`` takes several passes over the documents, whose state is written to the
shared folder between them. No document is shuffled.

Defined results: null and empty texts have no words and are clean; items without id or without words have
no windows; rows of the same item id count as one item; repeated documents give repeated rows; empty tables
give clean or no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.common import ASCII_LOWER, batched, slices, stored

WINDOW = 10
BLOCK_BYTES = 1 << 20
#: A block makes tables of some 100 times its bytes, so few are searched at once.
BLOCKS_A_PASS = 2

_WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in ASCII_LOWER)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


class WuManber:
    """All windows of one length; ``find`` yields (start, item ids) of each occurrence in a word list."""

    def __init__(self, windows: dict[tuple[bytes, ...], frozenset[str]]):
        self.length = m = len(next(iter(windows)))
        self.block = b = min(2, m)
        self.skip = m - b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list] = {}
        for window, items in windows.items():
            for end in range(b, m + 1):
                key = window[end - b : end]
                if m - end < self.shift.get(key, self.skip):
                    self.shift[key] = m - end
            self.buckets.setdefault(window[m - b :], []).append((list(window), items))

    def find(self, text: list[bytes]) -> Iterator[tuple[int, frozenset[str]]]:
        m, n, shift, skip = self.length, len(text), self.shift.get, self.skip
        at = m - 1
        if self.block == 1:
            for at, word in enumerate(text):
                if shift((word,), skip) == 0:
                    for _, items in self.buckets[(word,)]:
                        yield at, items
            return
        while at < n:
            move = shift((text[at - 1], text[at]), skip)
            if move:
                at += move
                continue
            window = text[at - m + 1 : at + 1]
            for candidate, items in self.buckets[window[-2], window[-1]]:
                if candidate == window:
                    yield at - m + 1, items
            at += 1


def tables(items: list[tuple[str, list[bytes]]]) -> list[WuManber]:
    """One search table for each window length among ``items``."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        m = min(WINDOW, len(text))
        for i in range(len(text) - m + 1 if m else 0):
            by_length.setdefault(m, {}).setdefault(tuple(text[i : i + m]), set()).add(item)
    return [WuManber({w: frozenset(s) for w, s in windows.items()}) for windows in by_length.values()]


class Search:
    """A block of items, whose tables are built when they are first wanted and then kept for as long as the worker holds the block."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        self.items = items
        self.built: list[WuManber] | None = None

    def __getstate__(self):
        return {"items": self.items, "built": None}

    def tables(self) -> list[WuManber]:
        if self.built is None:
            self.built = tables(self.items)
        return self.built


def occurrences(text: list[bytes], search: list[WuManber]) -> tuple[list[tuple[int, int]], set[str]]:
    """Disjoint ascending (start, end) runs of hit words, and the items that occur."""
    found: set[str] = set()
    runs = []
    for table in search:
        for start, items in table.find(text):
            runs.append((start, start + table.length))
            found |= items
    return _union(runs), found


def _union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    block, held = [], 0
    for item, text in benchmark.select(id_col, text_col).toLocalIterator():
        all_words = words(text) if item is not None else []
        start = 0
        while start < len(all_words):
            part, size = [], 0
            while start + len(part) < len(all_words) and (size < BLOCK_BYTES or len(part) < WINDOW):
                size += len(all_words[start + len(part)]) + 1
                part.append(all_words[start + len(part)])
            block.append((str(item), part))
            held += size
            if held >= BLOCK_BYTES:
                yield block
                block, held = [], 0
            if start + len(part) >= len(all_words):
                break
            start += len(part) - WINDOW + 1
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, hit_words, items) for each document.

    ``hit_words`` are the runs of hit words as array<struct<start, end>>, ``items`` the sorted item ids.
    """
    context = docs.sparkSession.sparkContext
    id_type = docs.schema[id_col].dataType.simpleString()
    blocks = _blocks(benchmark, item_col, item_text_col)
    runs_type = "array<struct<start:int,end:int>>"
    state = docs.select(id_col, text_col)

    def step(chunk, first: bool, last: bool):
        sent = [context.broadcast(Search(b)) for b in chunk]

        def run(batches):
            search = [t for b in sent for t in b.value.tables()]
            for part in slices(batches, text_col):
                kept = None if first else (part.column("hit_words").to_pylist(), part.column("items").to_pylist())
                rows = []
                for i, text in enumerate(part.column(text_col).to_pylist()):
                    own = words(text)
                    runs, items = occurrences(own, search)
                    if kept:
                        runs, items = _union(runs + [(r["start"], r["end"]) for r in kept[0][i]]), items.union(kept[1][i])
                    rows.append((len(own), runs, sorted(items)))
                yield _result(part, rows, id_col, None if last else text_col)

        middle = f"`{text_col}` string, " * (not last)
        return f"`{id_col}` {id_type}, {middle}n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_words {runs_type}, items array<string>", run

    chunks: list[list] = [[]]
    first = True
    for block in blocks:
        if len(chunks[0]) == BLOCKS_A_PASS:
            schema, run = step(chunks[0], first, last=False)
            state, first, chunks = stored(batched(state).mapInArrow(run, schema)), False, [[]]
        chunks[0].append(block)
    schema, run = step(chunks[0], first, last=True)
    return batched(state).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window occurs. Nothing is shuffled."""
    context = docs.sparkSession.sparkContext

    def without(kept: DataFrame, chunk: list) -> DataFrame:
        sent = [context.broadcast(Search(b)) for b in chunk]

        def run(batches):
            search = [t for b in sent for t in b.value.tables()]
            for part in slices(batches, text_col):
                hit = [any(next(t.find(own), None) for t in search) for own in map(words, part.column(text_col).to_pylist())]
                yield part.filter(pa.array([not x for x in hit], pa.bool_()))

        return batched(kept).mapInArrow(run, docs.schema)

    chunk: list = []
    for block in _blocks(benchmark, item_col, item_text_col):
        if len(chunk) == BLOCKS_A_PASS:
            docs, chunk = stored(without(docs, chunk)), []
        chunk.append(block)
    return without(docs, chunk) if chunk else docs


def _result(part: pa.RecordBatch, rows: list, id_col: str, text_col: str | None) -> pa.RecordBatch:
    offsets = [0]
    for _, runs, _ in rows:
        offsets.append(offsets[-1] + len(runs))
    flat = [r for _, runs, _ in rows for r in runs]
    spans = pa.StructArray.from_arrays([pa.array([r[0] for r in flat], pa.int32()), pa.array([r[1] for r in flat], pa.int32())], ["start", "end"])
    columns = {id_col: part.column(id_col)} | ({text_col: part.column(text_col)} if text_col else {})
    columns |= {
        "n_words": pa.array([n for n, _, _ in rows], pa.int64()),
        "n_hit": pa.array([sum(b - a for a, b in runs) for _, runs, _ in rows], pa.int64()),
        "n_items": pa.array([len(items) for _, _, items in rows], pa.int64()),
        "items_sha256": pa.array([hashlib.sha256(",".join(items).encode()).hexdigest() for _, _, items in rows], pa.string()),
        "contaminated": pa.array([bool(runs) for _, runs, _ in rows], pa.bool_()),
        "hit_words": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans),
        "items": pa.array([items for _, _, items in rows], pa.list_(pa.string())),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


#: The same rows by joining all windows of documents and items.
SQL = r"""
WITH letters AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, letters),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, letters WHERE item_id IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS window_text
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM item_windows),
doc_windows AS (
  SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS window_text
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lengths WHERE len(w) >= m)),
found AS (SELECT dw.doc_id, dw.i, dw.m, iw.item_id FROM doc_windows dw JOIN item_windows iw ON dw.m = iw.m AND dw.window_text = iw.window_text),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
