"""Benchmark decontamination: a broadcast hash set of item n-grams, scanned over token windows.

The items' windows are split into blocks of a checked size.  Each block is
broadcast and scanned over all documents in one narrow pass, so a test set of
any size costs more passes, never more memory.  A hash hit counts only after
its words have been compared.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import documents, python_ready, release

WINDOW = 10
#: Bytes of window text in one broadcast block.
BLOCK_BYTES = 16 << 20
#: Bits of the table that is asked before the hash set itself.
GATE_BITS = 22

#: Lower-cases A-Z and turns everything that is not a word byte into a space.
_TO_WORDS = bytes(
    32 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F
    else b + 32 if 0x41 <= b <= 0x5A else b
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def item_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item, win) of all items; win is the words joined by one space.

    An item with fewer words than a window is one window; one without words, or null, has none.
    """
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, wins = [], []
            for item, text in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                words = words_of(text or b"")
                for i in range(max(1, len(words) - window + 1) if words else 0):
                    items.append(item)
                    wins.append(b" ".join(words[i:i + window]))
            yield pa.record_batch([pa.array(items, pa.string()), pa.array(wins, pa.binary())], ["item", "win"])

    python_ready(benchmark.sparkSession)
    picked = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    return picked.mapInArrow(cut, "item string, win binary").distinct()


class Block:
    """One block of windows as arrays: what a task needs to scan and verify."""

    def __init__(self, rows: list[tuple[str | None, bytes]]):
        texts = sorted({win for _, win in rows})
        place = {win: i for i, win in enumerate(texts)}
        vocabulary = sorted({w for win in texts for w in win.split(b" ")})
        self.ids = {w: i + 1 for i, w in enumerate(vocabulary)}  # 0: a word of no item
        self.items: list[list[str]] = [[] for _ in texts]
        for item, win in rows:
            if item is not None:
                self.items[place[win]].append(item)
        coded = [np.array([self.ids[w] for w in win.split(b" ")], np.int32) for win in texts]
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for seed in range(100):
            rng = np.random.default_rng(seed)
            self.value = rng.integers(0, 1 << 64, len(self.ids) + 1, np.uint64)
            self.factor = np.uint64(int(rng.integers(1, 1 << 62)) * 2 + 1)
            if self._fill(coded):
                return
        raise ValueError("no seed keeps the windows' hashes apart")

    def _fill(self, coded: list[np.ndarray]) -> bool:
        for length in sorted({len(c) for c in coded}):
            which = np.array([i for i, c in enumerate(coded) if len(c) == length], np.int64)
            matrix = np.array([coded[i] for i in which], np.int32)
            hashes = self.roll(self.value[matrix].T, length, len(which))
            order = np.argsort(hashes)
            hashes = hashes[order]
            if (hashes[1:] == hashes[:-1]).any():
                return False
            gate = np.zeros(1 << GATE_BITS, bool)
            gate[hashes >> np.uint64(64 - GATE_BITS)] = True
            self.by_length[length] = (gate, hashes, matrix[order], which[order])
        return True

    def roll(self, columns: np.ndarray, length: int, n: int) -> np.ndarray:
        h = np.zeros(n, np.uint64)
        for j in range(length):
            h *= self.factor
            h += columns[j]
        return h

    def find(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per window length: (length, positions, window numbers) of the occurrences in ``ids``."""
        values = self.value[ids]
        for length, (gate, hashes, matrix, which) in self.by_length.items():
            n = len(ids) - length + 1
            if n <= 0:
                continue
            h = self.roll(np.lib.stride_tricks.sliding_window_view(values, n), length, n)
            at = np.flatnonzero(gate[h >> np.uint64(64 - GATE_BITS)])
            slot = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
            same = hashes[slot] == h[at]
            at, slot = at[same], slot[same]
            same = np.ones(len(at), bool)
            for j in range(length):
                same &= ids[at + j] == matrix[slot, j]
            yield length, at[same], which[slot[same]]


def _scan(batches: Iterable[pa.RecordBatch], block: Block, keep_text: bool) -> Iterator[pa.RecordBatch]:
    """Adds the block's hits to rows (id, text, n_words, hits, items).

    ``hits`` are word ranges, merged, as a flat list start, stop, start, stop, ...
    """
    release()
    for batch in batches:
        ids, bounds, lookup = [], [0], block.ids.get
        for text in batch["text"]:
            words = words_of(text.as_py() or b"")
            ids += [lookup(w, 0) for w in words]
            ids.append(0)  # ends the row: no window of an item holds a 0
            bounds.append(len(ids))
        ids, bounds = np.array(ids, np.int32), np.array(bounds)
        change = np.zeros(len(ids) + 1, np.int32)
        pairs = []
        for length, at, window in block.find(ids):
            np.add.at(change, at, 1)
            np.add.at(change, at + length, -1)
            row = np.searchsorted(bounds, at, "right") - 1
            pairs.append(np.unique(np.stack([row, window]), axis=1))
        for row, spans in enumerate(batch["hits"].to_pylist()):
            for s, e in zip(spans[::2], spans[1::2]):
                change[bounds[row] + s] += 1
                change[bounds[row] + e] -= 1
        hit = np.cumsum(change[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
        row = np.searchsorted(bounds, edges[::2], "right") - 1
        flat = (edges - np.repeat(bounds[row], 2)).astype(np.int32)
        offsets = np.searchsorted(row, np.arange(len(bounds))) * 2
        items = [set(x) for x in batch["items"].to_pylist()]
        for r, w in np.concatenate(pairs, axis=1).T.tolist() if pairs else ():
            items[r].update(block.items[w])
        yield pa.record_batch([
            batch["id"], batch["text"] if keep_text else pa.nulls(batch.num_rows, pa.binary()),
            pa.array(np.diff(bounds) - 1, pa.int64()),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)),
            pa.array([sorted(x) for x in items], pa.list_(pa.string())),
        ], names=["id", "text", "n_words", "hits", "items"])


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
              id_type: str = "bigint", keep_text: bool = False) -> DataFrame:
    """Hit words of every row of ``docs`` (id, text binary): id, text, n_words, hits, items."""
    spark = docs.sparkSession
    python_ready(spark)
    windows = item_windows(benchmark, window)
    total = windows.agg(F.sum(F.length("win") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    out = docs.select("id", "text", F.lit(0).cast("long").alias("n_words"),
                      F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"))
    for b in range(blocks):
        # about block_bytes by the hash, whatever the size of the test set
        part = windows.where(F.pmod(F.xxhash64("win"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast(Block([(r["item"], bytes(r["win"])) for r in part]))
        keep = keep_text or b + 1 < blocks
        out = out.mapInArrow(
            lambda batches, shared=shared, keep=keep: _scan(batches, shared.value, keep),
            f"id {id_type}, text binary, n_words bigint, hits array<int>, items array<string>")
    return out


def _n_hit() -> Column:
    return F.aggregate(F.transform("hits", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0), lambda a, x: a + x)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items, contaminated.

    Null and empty texts have no words and no hits; repeated rows each get
    their row; no documents give no rows; without items nothing is hit.  An item whose id
    is null hits words but is not listed.  Other columns, of whatever name, are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    found = find_hits(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")),
                      benchmark, window, block_bytes, kind)
    n_hit = _n_hit().cast("long")
    return found.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.array_sort("items").alias("items"), (n_hit > 0).alias("contaminated"))


def _cut_text(text: bytes, hits: list[int]) -> bytes:
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(_TO_WORDS))]
    kept, last = [], 0
    for start, stop in zip(hits[::2], hits[1::2]):
        kept.append(text[last:places[start][0]])
        last = places[stop - 1][1]
    return b"".join([*kept, text[last:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", id_col: str = "doc_id",
                  text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without what the benchmark holds; all columns stay.

    remove="spans" cuts each run of hit words out of its text, from the first
    letter to the last; remove="documents" drops every row with a hit.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(remove)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("id"),
                         F.col(text_col).cast("binary").alias("text"))
    kind = packed.schema["id"].dataType.simpleString()
    found = find_hits(packed, benchmark, window, block_bytes, kind, keep_text=remove == "spans")
    if remove == "documents":
        return found.where(F.size("hits") == 0).select("id.*")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_cut_text(t, h) if h else t for t, h in zip(batch["text"].to_pylist(), batch["hits"].to_pylist())]
            yield pa.record_batch([batch["id"], pa.array([None if t is None else t.decode() for t in texts], pa.string())],
                                  names=["id", "cut"])

    clean = found.select("id", "text", "hits").mapInArrow(cut, f"id {kind}, cut string")
    return clean.select(*[
        F.col("cut").alias(c) if c == text_col else F.col(f"id.`{c}`").alias(c) for c in docs.columns])


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op1_decontamination": op1_decontamination}

ORACLE_SQL = {"op1_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), p AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n
), h AS (
  SELECT doc_id, i, p.n, item FROM p JOIN g ON g.n = p.n AND g.win = array_to_string(w[i:i + p.n - 1], ' ')
), c AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM h WHERE item IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""}
