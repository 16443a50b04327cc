"""Packing of documents into sequences by length patterns and non-negative least squares.

Few-document patterns of length classes are enumerated; how often each is to be
used is fitted to the histogram of lengths by non-negative least squares and
rounded; what is left goes, longest first, where it leaves the least room.  All of
that is done on the histogram, whose size is the length of a sequence; pieces
find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..sources.store import materialize
from .common import documents, in_worker, python_ready
from .word_encoder import WordEncoder

#: Tokens in a sequence.
LENGTH = 2048
#: Classes of lengths for the patterns, and the most documents in a pattern.
CLASSES, PATTERN_DOCS = 128, 3

#: One row of a plan: pieces of ``length`` with ranks from ``rank`` on, ``n`` of them, ``each`` to a sequence
#: from ``sequence`` on, the first of them at ``offset``.
PLAN = ("length", "rank", "n", "sequence", "each", "offset")


def patterns(units: int, most: int) -> list[tuple[int, ...]]:
    """All multisets of at most ``most`` classes 1..units, largest first, that add up to ``units``."""
    def grow(left: int, top: int, room: int) -> Iterator[tuple[int, ...]]:
        if left == 0:
            yield ()
        elif room:
            for first in range(min(left, top), -(-left // room) - 1, -1):
                for rest in grow(left - first, first, room - 1):
                    yield (first, *rest)

    return list(grow(units, units, most))


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, steps: int | None = None) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by the active-set method on the normal equations."""
    gram, right = a.T @ a, a.T @ b
    x = np.zeros(a.shape[1])
    free = np.zeros(a.shape[1], bool)
    slack = 1e-9 * max(1.0, np.abs(right).max(initial=0))
    for _ in range(steps or 3 * a.shape[0]):
        gradient = right - gram @ x
        gradient[free] = -np.inf
        best = int(np.argmax(gradient)) if len(gradient) else 0
        if not len(gradient) or gradient[best] <= slack:
            break
        free[best] = True
        while True:
            own = np.flatnonzero(free)
            z = np.linalg.lstsq(gram[np.ix_(own, own)], right[own], rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[own] = z
                break
            low = np.flatnonzero(z <= 0)
            step = (x[own][low] / np.maximum(x[own][low] - z[low], 1e-300)).min()
            x[own] += step * (z - x[own])
            x[own[x[own] <= 1e-12 * (1 + x.max())]] = 0
            x[own[low][x[own][low] <= 0]] = 0
            if not (free & (x <= 0)).any():  # rounding: the worst goes
                x[own[low[np.argmin(z[low])]]] = 0
            free &= x > 0
    return x


class _Rests:
    """Open sequences by the room they have left, as runs of numbers: (first, how many)."""

    def __init__(self, length: int):
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.rooms = np.zeros(length + 1, bool)

    def add(self, room: int, first: int, n: int) -> None:
        if n and room:
            self.runs[room].append((first, n))
            self.rooms[room] = True

    def tightest(self, size: int) -> int | None:
        found = np.flatnonzero(self.rooms[size:])
        return None if not len(found) else size + int(found[0])

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        self.rooms[room] = bool(self.runs[room])
        return run


def _fill(pattern: tuple[int, ...], of_class: dict[int, list[int]], left: dict[int, int], sizes: np.ndarray,
          length: int, grain: int) -> list[int] | None:
    """Lengths for a pattern: the longest left of each class, and for the last the longest that still fits."""
    slots: list[int] = []
    for k in pattern[:-1] if len(pattern) > 1 else pattern:
        found = next((s for s in of_class[k] if left[s] > slots.count(s)), None)
        if found is None:
            return None
        slots.append(found)
    if len(pattern) > 1:
        # a class holds no longer piece than the room that it was counted with
        at = int(np.searchsorted(sizes, length - sum(slots), side="right")) - 1
        while at >= 0 and left[int(sizes[at])] <= slots.count(int(sizes[at])):
            at -= 1
        # a shorter one than the pattern's would leave room that the best fit can use better
        if at < 0 or -(-int(sizes[at]) // grain) < pattern[-1]:
            return None
        slots.append(int(sizes[at]))
    return slots


def plan_packing(histogram: dict[int, int], length: int = LENGTH, classes: int = CLASSES, most: int = PATTERN_DOCS
                 ) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of PLAN that place every piece of the histogram {length: how many}; sequences are numbered from 0.

    Its work and size depend on the lengths that occur, not on how many pieces
    there are.  Full pieces are sequences of their own.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    used = dict.fromkeys(left, 0)
    plan: list[tuple[int, int, int, int, int, int]] = []
    rests, following = _Rests(length), 0

    def place(size: int, n: int, sequence: int, each: int, offset: int) -> None:
        plan.append((size, used[size], n, sequence, each, offset))
        used[size] += n
        left[size] -= n

    if left.get(length):
        n = left[length]
        place(length, n, 0, 1, 0)
        following = n

    # a piece of class k is at most k * grain long, so classes that add up to the whole always fit
    grain = -(-length // min(classes, length))
    units = length // grain
    of_class: dict[int, list[int]] = defaultdict(list)
    for size in sorted((s for s in left if s < length), reverse=True):
        if -(-size // grain) <= units:
            of_class[-(-size // grain)].append(size)
    offered = [p for p in patterns(units, most) if all(k in of_class for k in p)]
    if offered:
        rows = {k: i for i, k in enumerate(sorted(of_class))}
        counts = np.array([sum(left[s] for s in of_class[k]) for k in rows], float)
        weights = np.zeros((len(rows), len(offered)))
        for j, pattern in enumerate(offered):
            for k in pattern:
                weights[rows[k], j] += 1
        sizes = np.array(sorted(left))
        repeats = np.rint(non_negative_least_squares(weights, counts)).astype(np.int64)
        for j in np.argsort(-repeats, kind="stable").tolist():
            want = int(repeats[j])
            while want > 0:
                slots = _fill(offered[j], of_class, left, sizes, length, grain)
                if slots is None:
                    break
                n = min(want, *(left[s] // slots.count(s) for s in slots))
                offset = 0
                for s in slots:
                    place(s, n, following, 1, offset)
                    offset += s
                rests.add(length - offset, following, n)
                following += n
                want -= n

    for size in sorted((s for s in left if s < length), reverse=True):
        while left[size]:
            room = rests.tightest(size)
            if room is None:
                each = length // size
                whole, rest = divmod(left[size], each)
                if whole:
                    place(size, whole * each, following, each, 0)
                    rests.add(length - each * size, following, whole)
                if rest:
                    place(size, rest, following + whole, rest, 0)
                    rests.add(length - rest * size, following + whole, 1)
                following += whole + (rest > 0)
                continue
            first, n = rests.take(room)
            each = room // size
            whole = min(n, left[size] // each)
            if whole:
                place(size, whole * each, first, each, length - room)
                rests.add(room - each * size, first, whole)
            elif left[size]:
                rest, whole = left[size], 1
                place(size, rest, first, rest, length - room)
                rests.add(room - rest * size, first, 1)
            rests.add(room, first + whole, n - whole)
    return plan


def encode_pieces(docs: DataFrame, tokenizer_json: str, length: int = LENGTH, end_id: int = 0,
                  id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Texts as pieces of at most ``length`` ids: id, piece, start, length, ids_crc32, part, rank [, ids].

    ``end_id`` follows each text; null and empty texts are that id alone.  Texts
    longer than a sequence are cut into whole sequences and a rest.  ``rank``
    counts the pieces of the same length in the same ``part`` before this one; write the rows
    before they are read twice, as parts are tasks.  ``ids`` are little-endian unsigned 32-bit integers.
    """
    spark = docs.sparkSession
    python_ready(spark)
    shared = spark.sparkContext.broadcast(tokenizer_json)
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = in_worker(("words", hash(shared.value)), lambda: WordEncoder(shared.value))
        part, seen = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, starts = own.encode(batch["text"])
            rows, piece, sizes, crcs, held = [], [], [], [], []
            for r, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                told = ids[a:b].tobytes() + end
                for k, at in enumerate(range(0, len(told), 4 * length)):
                    cut = told[at:at + 4 * length]
                    rows.append(r)
                    piece.append(k)
                    sizes.append(len(cut) // 4)
                    crcs.append(zlib.crc32(cut))
                    if keep_ids:
                        held.append(cut)
            sizes, k = np.array(sizes, np.int64), np.array(piece, np.int64)
            order = np.argsort(sizes, kind="stable")
            runs = sizes[order]
            rank = np.empty(len(sizes), np.int64)
            rank[order] = np.arange(len(runs)) - np.searchsorted(runs, runs) + seen[runs]
            seen += np.bincount(sizes, minlength=length + 1)
            columns = [batch["id"].take(pa.array(rows, pa.int64())), k.astype(np.int32), k * length, sizes,
                       np.array(crcs, np.int64), np.full(len(k), part), rank]
            names = ["id", "piece", "start", "length", "ids_crc32", "part", "rank"]
            if keep_ids:
                columns, names = [*columns, pa.array(held, pa.binary())], [*names, "ids"]
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        encode, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, rank bigint"
        + (", ids binary" if keep_ids else ""))


def place_pieces(pieces: DataFrame, length: int = LENGTH, classes: int = CLASSES, most: int = PATTERN_DOCS) -> DataFrame:
    """Adds sequence_id and offset to written pieces; drops part and rank.

    The histogram, at most ``length`` rows, is all that the driver gathers, and
    the plan that follows from it is all that tasks are sent.  A length that many pieces share is
    split by part, and ranks run on from part to part.
    """
    spark = pieces.sparkSession
    python_ready(spark)
    counts = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = np.array(plan_packing(histogram, length, classes, most), np.int64).reshape(-1, len(PLAN))
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    # one ascending key for (length, rank): where the pieces of a length begin among all
    sizes = np.array(sorted(histogram), np.int64)
    begin = np.cumsum([0, *(histogram[s] for s in sizes.tolist())])[:-1]
    keys = begin[np.searchsorted(sizes, plan[:, 0])] + plan[:, 1]
    shared = spark.sparkContext.broadcast((plan, keys, sizes, begin))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    ranked = pieces.join(counts.select("part", "length", before.alias("before")), ["part", "length"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, keys, sizes, begin = shared.value
        for batch in batches:
            own, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = rows[np.searchsorted(keys, begin[np.searchsorted(sizes, own)] + rank, side="right") - 1]
            k = rank - at[:, 1]
            table = batch.drop_columns(["rank"])
            yield table.append_column("sequence_id", pa.array(at[:, 3] + k // at[:, 4])).append_column(
                "offset", pa.array(at[:, 5] + k % at[:, 4] * own))

    kinds = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c != "rank")
    return ranked.mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer_json: str, length: int = LENGTH, end_id: int = 0,
                   id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Every piece of every document and its place: id, piece, start, length, ids_crc32 [, ids], sequence_id, offset.

    Null and empty texts are one ``end_id``; rows that share an id are packed
    each for itself, null ids too; other columns of ``docs`` are not read, whatever their names; an empty table gives no rows.
    Which of two pieces of one length goes where depends on how rows are dealt
    to tasks; how many sequences there are does not.
    """
    pieces = materialize(encode_pieces(docs, tokenizer_json, length, end_id, id_col, text_col, keep_ids), "pieces")
    return place_pieces(pieces, length)


def assemble(placed: DataFrame) -> DataFrame:
    """Whole sequences from placed pieces that kept their ids: sequence_id, ids binary; a sequence is one bounded row."""
    own = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(own.alias("own")).select(
        "sequence_id", F.unhex(F.array_join(F.transform("own.ids", lambda b: F.hex(b)), "")).alias("ids"))


def op13_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        tokenizer = file.read()
    return pack_documents(documents(spark, sf_dir), tokenizer).withColumnRenamed("id", "doc_id")


QUERIES = {"op13_pattern_packing": op13_pattern_packing}
