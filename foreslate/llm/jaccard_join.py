"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Documents with equal sets are one row of the incidence matrix.  Rows that can
overlap enough are found by their rarest n-grams: two sets with Jaccard of at
least ``p/q`` share one among the first ``n - ceil(n p/q) + 1`` of each, in any
fixed order of n-grams.  The order here is by the counts of a fixed-size
sketch over all documents, so passages that many documents hold come last; the
sketch decides speed alone, never the result.  Of the rows that share such an
n-gram, pairs are discarded whose bitmaps (a bit per n-gram hash, flipped by
each of its n-grams) differ in more places than the two sizes allow.  The rows
that stay connected are multiplied block by block: overlaps are accumulated over
the n-gram columns, and a pair is kept if its overlap reaches the bound that
its two sizes give.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.store import materialize
from .common import buckets, documents, free_names, python_ready, release
from .components import connected_components
from .shingles import mix, shingle_sets

#: Counters of the sketch, its slices, rows of a block, and columns from which a dense product is used.
SKETCH_BITS, SLICES, BLOCK_ROWS, DENSE = 22, 64, 384, 48


@dataclass(frozen=True)
class Measure:
    """Shingles of ``words`` words; sets link when q * intersection >= p * union."""

    words: int = 3
    p: int = 90
    q: int = 100

    def least_overlap(self, sizes):
        """Smallest overlap of sets whose sizes sum to ``sizes``: (p + q) i >= p (s1 + s2)."""
        return -(-self.p * sizes // (self.p + self.q))

    def most_different(self, sizes):
        """Most elements that are in one alone of two sets that link."""
        return sizes - 2 * self.least_overlap(sizes)

    def prefix(self, n: int) -> int:
        return n - -(-self.p * n // self.q) + 1

    def size_classes(self, largest: int) -> list[int]:
        """Lower bounds of size classes; sets that link are in one class or in neighbours."""
        bounds = [1]
        while bounds[-1] <= largest:
            bounds.append(max(bounds[-1] + 1, bounds[-1] * self.q // self.p + 1))
        return bounds


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch["text"].to_pylist()]


def _steps(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _digest(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def bitmap(own: np.ndarray) -> bytes:
    """Parities of the hashes in twice to four times as many places as there are n-grams."""
    places = 64
    while places < 2 * len(own):
        places *= 2
    at = (mix(own ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(places - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=places) & 1).astype(bool)).tobytes()


def describe_sets(docs: DataFrame, measure: Measure) -> DataFrame:
    """Rows (id, node, n, check, bitmap) of every document, and rows (slice, counts) of the tasks' sketches."""
    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts = np.zeros(1 << SKETCH_BITS, np.uint8)
        names = ["id", "node", "n", "check", "bitmap", "slice", "counts"]
        for batch in _steps(batches):
            sets = shingle_sets(_texts(batch), measure.words)
            nodes = [_digest(s) for s in sets]
            once = {node: s for node, s in zip(nodes, sets)}
            add = np.bincount((np.concatenate(list(once.values())) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64),
                              minlength=len(counts))
            counts = np.minimum(counts + add, 255).astype(np.uint8)
            k = len(sets)
            yield pa.record_batch([
                batch["id"], pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([bitmap(s) for s in sets], pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        yield pa.record_batch([
            pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()),
            pa.nulls(SLICES, pa.binary()), pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()),
            pa.array([x.tobytes() for x in np.split(counts, SLICES)], pa.binary())], names=names)

    return docs.mapInArrow(describe, "id bigint, node bigint, n bigint, check binary, bitmap binary, slice int, counts binary")


def merge_sketches(slices: DataFrame) -> np.ndarray:
    """The sketch of all tasks as one byte per counter, on a log scale: of a fixed size, whatever the data."""
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, counts in zip(batch["slice"].to_pylist(), batch["counts"].to_pylist()):
                own = np.frombuffer(counts, np.int64 if len(counts) > (1 << SKETCH_BITS) // SLICES else np.uint8)
                sums[s] = sums.get(s, 0) + own.astype(np.int64)
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())],
                              names=["slice", "counts"])

    def scale(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in add(batches):
            sums = [np.frombuffer(c, np.int64) for c in batch["counts"].to_pylist()]
            told = [np.minimum(np.log2(x + 1.0) * 6, 255).astype(np.uint8).tobytes() for x in sums]
            yield pa.record_batch([batch["slice"], pa.array(told, pa.binary())], names=["slice", "counts"])

    kind = "slice int, counts binary"
    spread = F.pmod(F.xxhash64("counts"), F.lit(32))
    first = slices.repartition(buckets(slices.sparkSession), "slice", spread).mapInArrow(add, kind)
    merged = first.repartition(min(SLICES, buckets(slices.sparkSession)), "slice").mapInArrow(scale, kind).collect()
    whole = np.zeros(1 << SKETCH_BITS, np.uint8)
    step = len(whole) // SLICES
    for row in merged:
        whole[row["slice"] * step:(row["slice"] + 1) * step] = np.frombuffer(row["counts"], np.uint8)
    return whole


def shared_grams(docs: DataFrame, measure: Measure, sketch: np.ndarray) -> DataFrame:
    """(cluster, id, n): nodes that share a rare n-gram with another of a size that allows a link."""
    spark = docs.sparkSession
    shared, parts = spark.sparkContext.broadcast(sketch), buckets(spark)

    def prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            grams, nodes, sizes, seen = [], [], [], set()
            for step in _steps([batch]):
                for own in shingle_sets(_texts(step), measure.words):
                    node = _digest(own)
                    if node in seen or not len(own):
                        continue
                    seen.add(node)
                    rank = order[own >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(56) | mix(own) >> np.uint64(8)
                    k = measure.prefix(len(own))
                    grams.append(own[np.argpartition(rank, k - 1)[:k]] if k < len(own) else own)
                    nodes.append(node)
                    sizes.append(len(own))
            if not nodes:
                continue
            lengths = [len(g) for g in grams]
            gram = np.concatenate(grams)
            node, size = np.repeat(np.array(nodes, np.int64), lengths), np.repeat(np.array(sizes, np.uint32), lengths)
            part = (mix(gram ^ np.uint64(0x5BD1E995)) % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[by], np.arange(parts + 1))
            full = [b for b in range(parts) if cuts[b] < cuts[b + 1]]
            yield pa.record_batch([
                pa.array(full, pa.int32()),
                *[pa.array([x[by[cuts[b]:cuts[b + 1]]].tobytes() for b in full], pa.binary()) for x in (gram, node, size)]],
                names=["part", "gram", "node", "size"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes, bytes]] = []
        for batch in batches:
            held += zip(*(batch[c].to_pylist() for c in ("gram", "node", "size")))
        gram, node, size = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*held) if held else ([],) * 3, (np.uint64, np.int64, np.uint32)))
        by = np.lexsort((node, size, gram))
        gram, node, size = gram[by], node[by], size[by].astype(np.int64)
        once = np.concatenate([[True], (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])])[:len(gram)]
        gram, node, size = gram[once], node[once], size[once]
        # sizes are in order, so a row that can't link to its neighbours can't link to any
        near = (gram[1:] == gram[:-1]) & (size[:-1] * measure.q >= size[1:] * measure.p)
        some = np.concatenate([near, [False]])[:len(gram)] | np.concatenate([[False], near])[:len(gram)]
        yield pa.record_batch([pa.array(gram[some].view(np.int64)), pa.array(node[some]), pa.array(size[some])],
                              names=["cluster", "id", "n"])

    packed = docs.select("text").mapInArrow(prefixes, "part int, gram binary, node binary, size binary")
    return packed.repartition(parts, "part").mapInArrow(meet, "cluster bigint, id bigint, n bigint")


def _spans(count: int, pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of the pairs of 0..count-1, as many as join all that they join."""
    parent, out = list(range(count)), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in pairs:
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def near_pairs(maps: list[bytes], sizes: np.ndarray, sides: np.ndarray, measure: Measure) -> Iterator[tuple[int, int]]:
    """Pairs whose bitmaps leave a link possible: each n-gram of one set alone flips one place."""
    level = np.array([len(m).bit_length() for m in maps])
    across = sides.any()
    for low in np.unique(level):
        small = np.flatnonzero(level == low)
        a = np.frombuffer(b"".join(maps[i] for i in small), np.uint64).reshape(len(small), -1)
        for high in np.unique(level[level >= low]):
            big = np.flatnonzero(level == high)
            if sizes[small].max() * measure.q < sizes[big].min() * measure.p:
                continue
            # a larger map is folded: its parts' parities add up to those of the smaller
            b = np.bitwise_xor.reduce(
                np.frombuffer(b"".join(maps[i] for i in big), np.uint64).reshape(len(big), -1, a.shape[1]), axis=1)
            step = max(1, 1_000_000 // max(1, b.size))
            for at in range(0, len(small), step):
                own = small[at:at + step]
                differ = np.bitwise_count(a[at:at + step, None, :] ^ b[None]).sum(axis=2, dtype=np.int64)
                total = sizes[own][:, None] + sizes[big][None]
                ok = differ <= measure.most_different(total)
                ok &= np.minimum(sizes[own][:, None], sizes[big][None]) * measure.q >= np.maximum(
                    sizes[own][:, None], sizes[big][None]) * measure.p
                ok &= own[:, None] != big[None]
                if across:
                    ok &= sides[own][:, None] != sides[big][None]
                yield from zip(own[np.nonzero(ok)[0]].tolist(), big[np.nonzero(ok)[1]].tolist())


def candidate_edges(rows: DataFrame, measure: Measure) -> DataFrame:
    """(a, b): pairs that join, in each block of each n-gram's rows, all that can link.

    ``rows`` are (cluster, block, side, id, n, bitmap); a task holds its blocks, each of bounded size.
    """
    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple]] = {}
        for batch in batches:
            for cluster, block, *row in zip(*(batch[c].to_pylist() for c in ("cluster", "block", "side", "id", "n", "bitmap"))):
                held.setdefault((cluster, block), []).append(row)
        edges = set()
        for own in held.values():
            if len(own) > 1:
                sides, ids, sizes, maps = zip(*own)
                pairs = near_pairs(list(maps), np.array(sizes), np.array(sides), measure)
                # to the smallest id of each part, so that the lists of one group give the same edges
                least = {i: i for i in range(len(own))}
                parts_of = {i: [i] for i in range(len(own))}
                for i, j in _spans(len(own), pairs):
                    a, b = least[i], least[j]
                    small, large = (a, b) if ids[a] <= ids[b] else (b, a)
                    for k in parts_of[large]:
                        least[k] = small
                    parts_of[small] += parts_of.pop(large)
                edges.update((ids[k], ids[i]) for i, k in least.items() if k != i)
        a, b = zip(*edges) if edges else ((), ())
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    parts = buckets(rows.sparkSession)
    return rows.repartition(parts, "cluster", "block").mapInArrow(compare, "a bigint, b bigint")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Product of the incidence matrix with its transpose: overlap counts of all pairs of a block."""
    rows = len(sets)
    row = np.repeat(np.arange(rows), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    by = np.argsort(column, kind="stable")
    row, starts = row[by], np.cumsum(count) - count
    total = np.zeros((rows, rows), np.float32)
    full = np.flatnonzero(count >= DENSE)
    for at in range(0, len(full), 4096):
        own = full[at:at + 4096]
        block = np.zeros((len(own), rows), np.float32)
        for i, c in enumerate(own):
            block[i, row[starts[c]:starts[c] + count[c]]] = 1
        total += block.T @ block
    for size in np.unique(count[(count > 1) & (count < DENSE)]):
        own = starts[count == size]
        left, right = np.triu_indices(size, 1)
        for at in range(0, len(own), max(1, 4_000_000 // len(left))):
            member = row[own[at:at + max(1, 4_000_000 // len(left)), None] + np.arange(size)]
            a, b = member[:, left].ravel(), member[:, right].ravel()
            total += np.bincount(a * rows + b, minlength=rows * rows).reshape(rows, rows)
    return np.maximum(total, total.T)


def multiply_blocks(rows: DataFrame, measure: Measure) -> DataFrame:
    """Links of every block pair: rows (a, b, null) that span its links, and (a, null, links) counts."""
    def multiply(table: pa.Table) -> pa.Table:
        held = {}
        for i, side, copies, own in zip(*(table[c].to_pylist() for c in ("id", "side", "copies", "grams"))):
            held[i, side] = (copies, np.frombuffer(own, np.uint64))
        keys = sorted(held)
        sets = [held[k][1] for k in keys]
        ids, sides = np.array([k[0] for k in keys]), np.array([k[1] for k in keys])
        size, copies = np.array([len(s) for s in sets]), np.array([held[k][0] for k in keys])
        linked = overlaps(sets) >= measure.least_overlap(size[:, None] + size[None, :])
        np.fill_diagonal(linked, False)
        if sides.max() > 0:  # two blocks: pairs across, as each block is multiplied by itself elsewhere
            linked &= sides[:, None] != sides[None, :]
        pairs = ((int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(linked))))
        spans = [(int(ids[i]), int(ids[j])) for i, j in _spans(len(keys), pairs)]
        n = linked @ copies
        some = np.flatnonzero(n)
        return pa.table({
            "a": pa.array([a for a, _ in spans] + ids[some].tolist(), pa.int64()),
            "b": pa.array([b for _, b in spans] + [None] * len(some), pa.int64()),
            "links": pa.array([None] * len(spans) + n[some].tolist(), pa.int64())})

    return rows.groupBy("cluster", "block").applyInArrow(multiply, "a bigint, b bigint, links bigint")


def _blocks(members: DataFrame, measure: Measure) -> DataFrame:
    """``members`` (cluster, id, n, ...) with block and side: which products each row takes part in.

    A cluster that fits is one block.  A larger one is cut by size class, and
    a class by the id's hash; a block is multiplied by itself and by the
    blocks of its own and the next class, which hold all sizes that can link.
    """
    largest = members.agg(F.max("n")).first()[0] or 1
    bounds = F.array(*[F.lit(b) for b in measure.size_classes(largest)])
    sized = members.withColumn("class", F.size(F.filter(bounds, lambda b: b <= F.col("n"))))
    counted = sized.groupBy("cluster", "class").count()
    whole = counted.groupBy("cluster").agg(
        F.sum("count").alias("total"), F.map_from_entries(F.collect_list(F.struct("class", F.ceil(F.col("count") / BLOCK_ROWS)))).alias("cuts"))
    placed = sized.join(whole, "cluster").withColumn(
        "own", F.pmod(F.xxhash64("id"), F.coalesce(F.element_at("cuts", F.col("class")), F.lit(1))))

    def name(level, part):
        return F.concat_ws(".", level, part)

    own = name(F.col("class"), F.col("own"))
    every = F.flatten(F.transform(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1), lambda level: F.transform(
        F.when(F.element_at("cuts", level).isNull(), F.array().cast("array<bigint>"))
        .otherwise(F.sequence(F.lit(0).cast("long"), F.element_at("cuts", level) - 1)), lambda part: name(level, part))))
    other = F.transform(every, lambda o: F.struct(
        F.concat(F.least(own, o), F.lit("|"), F.greatest(own, o)).alias("block"),
        F.when(own > o, 1).otherwise(0).alias("side")))
    alone = F.array(F.struct(F.lit("all").alias("block"), F.lit(0).alias("side")))
    return placed.select(*members.columns, F.explode(
        F.when(F.col("total") <= BLOCK_ROWS, alone).otherwise(other)).alias("in")).select(*members.columns, "in.*")


def jaccard_components(docs: DataFrame, measure: Measure = Measure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, n_links.

    ``n_links`` counts the other documents that link to this one, those with
    an equal set included.  Null and empty texts, and texts of white space
    alone, have an empty set and link with nothing; so do rows whose id is
    null (their ``component_id`` is null).  A repeated row is one more
    document with an equal set.  No rows give no rows; other columns are not read.
    Sets are told apart by 64-bit digests; should two sets ever share one, a
    second digest of 128 bits finds it and the job stops.
    """
    spark = docs.sparkSession
    python_ready(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    told = materialize(describe_sets(source, measure), "sets")
    sketch = merge_sketches(told.where("slice is not null").select("slice", "counts"))
    named = told.where("slice is null").select("id", "node", "n", "check", "bitmap")
    same = F.when(F.min("check") != F.max("check"), F.raise_error(F.lit("two sets share a digest"))).otherwise(F.min("id"))
    nodes = materialize(
        named.where("n > 0 and id is not null").groupBy("node", "n").agg(
            same.alias("id"), F.count(F.lit(1)).alias("copies"), F.first("bitmap").alias("bitmap")), "nodes")
    meeting = materialize(shared_grams(source.where("id is not null"), measure, sketch), "meeting")
    blocks = _blocks(meeting, measure).withColumnRenamed("id", "node").join(nodes.select("node", "id", "bitmap"), "node")
    edges = candidate_edges(blocks, measure).distinct()
    clusters = connected_components(edges)
    members = materialize(nodes.join(clusters, "id").select("id", "n", "copies", "node", F.col("component").alias("cluster")), "members")

    def grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            sets = shingle_sets(_texts(batch), measure.words)
            keep = [i for i, (s, node) in enumerate(zip(sets, batch["node"].to_pylist())) if _digest(s) == node]
            yield pa.record_batch([batch["id"].take(pa.array(keep, pa.int64())), pa.array([sets[i].tobytes() for i in keep], pa.binary())],
                                  names=["id", "grams"])

    sets = source.join(members.select("id", "node"), "id").mapInArrow(grams, "id bigint, grams binary")
    links = materialize(multiply_blocks(_blocks(members, measure).join(sets, "id"), measure), "links")
    parts = connected_components(links.where("b is not null"))
    counts = links.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    verdict = nodes.join(parts, "id", "left").join(counts, "id", "left").select(
        "node", F.coalesce("component", "id").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    verdict = materialize(verdict, "verdict")
    linked = F.col("n") > 0
    return named.join(verdict, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(linked & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.when(linked & F.col("id").isNotNull(), F.col("n_links")).otherwise(0).alias("n_links"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


QUERIES = {"op10_jaccard_join": op10_jaccard_join}


def without_near_copies(docs: DataFrame, measure: Measure, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the smallest id of each component alone, all columns untouched.

    Rows that share an id are one document and stay or go together; rows
    without an id stay.  Columns may have any other names.
    """
    told = jaccard_components(docs, measure, id_col, text_col)
    own, stays = free_names(docs, "__id", "__stays")
    staying = told.groupBy(F.col(id_col).alias(own)).agg(F.max(F.col("component_id") == F.col(id_col)).alias(stays))
    return docs.join(staying.where(~F.col(stays)), F.col(id_col) == F.col(own), "left_anti")
