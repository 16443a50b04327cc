"""Centroid clustering in exact integers, nearest centroids found by Orchard search.

Every centroid keeps the others in order of their distance from it.  A vector
walks the list of its current centroid, jumps to the list of a closer one
whenever it finds one, passes by those it has visited, and stops where the list
is strictly more than twice as far as the vector is.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.store import materialize
from .common import python_ready

#: Fixed values of the query: components, centroids, rounds, scale, and what is put before an id to choose the first centroids.
DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, "3:"
#: Sums are dealt in limbs of so many bits, so that any size of component adds up exactly.
LIMB = 56
LARGEST = (1 << 63) - 1


class Orchard:
    """Nearest of some integer centroids: by squared distance, then by number."""

    def __init__(self, centroids: list[tuple[int, ...]]):
        self.top = max((abs(x) for c in centroids for x in c), default=0)
        self.exact = np.array([list(c) for c in centroids], object)
        k = len(centroids)
        apart = ((self.exact[:, None, :] - self.exact[None, :, :]) ** 2).sum(axis=2) if k else np.zeros((0, 0), object)
        self.order = np.array([sorted((j for j in range(k) if j != i), key=lambda j: (apart[i, j], j)) for i in range(k)],
                              np.int64).reshape(k, max(0, k - 1))
        self.apart = np.array([apart[i, self.order[i]] for i in range(k)], object).reshape(self.order.shape)
        # far apart and yet in 64 bits: four times a distance is compared with these
        self.apart_long = np.minimum(self.apart, LARGEST).astype(np.int64) if k else self.apart

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For rows of integers (int64 or Python's): centroid, squared distance, and how many distances were computed."""
        n, k = vectors.shape[0], len(self.exact)
        largest = max(self.top, int(np.abs(vectors).max(initial=0)))
        small = 4 * vectors.shape[1] * (2 * largest) ** 2 <= LARGEST
        kind = np.int64 if small else object
        vectors, centroids = vectors.astype(kind), self.exact.astype(kind)
        apart = self.apart_long if small else self.apart

        def distance(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
            return ((vectors[rows] - centroids[to]) ** 2).sum(axis=1)

        every = np.arange(n)
        now, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        best = distance(every, now) if n else np.zeros(0, kind)
        visited = np.zeros((n, k), bool)
        visited[:, 0] = True
        walking, computed = every if k > 1 else every[:0], n
        while len(walking):
            here = now[walking], place[walking]
            going = apart[here] <= 4 * best[walking]
            walking = walking[going.astype(bool)]
            to = self.order[now[walking], place[walking]]
            place[walking] += 1
            fresh = ~visited[walking, to]
            rows, to = walking[fresh], to[fresh]
            visited[rows, to] = True
            computed += len(rows)
            found = distance(rows, to) if len(rows) else best[:0]
            closer = (found < best[rows]) | ((found == best[rows]) & (to < now[rows]))
            closer = closer.astype(bool)
            rows, to = rows[closer], to[closer]
            now[rows], best[rows], place[rows] = to, found[closer], 0
            walking = walking[place[walking] < k - 1]
        return now, best, computed


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, exactly: int64 where all fit, else Python's integers."""
    if (np.abs(values) < 2.0 ** 40).all():
        return np.floor(values * scale).astype(np.int64)
    return np.array([[math.floor(x * scale) if abs(x) < 2.0 ** 53 else int(x) * scale for x in row] for row in values.tolist()], object)


def usable(vectors: DataFrame, dimensions: int = DIMENSIONS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector of doubles) of the rows with exactly ``dimensions`` components, none null or non-finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(
        (F.size("vector") == dimensions) & F.forall("vector", finite))


def first_centroids(vectors: DataFrame, k: int, key: Column, scale: int) -> list[tuple[int, ...]]:
    """The ``k`` vectors with the smallest keys, ties by components; fewer if there are fewer."""
    rows = vectors.select(key.alias("key"), "vector").orderBy("key", "vector").limit(k).collect()
    return [tuple(int(x) for x in scaled(np.array([r["vector"]], float), scale)[0]) for r in rows]


def _matrix(batch: pa.RecordBatch, dimensions: int, scale: int) -> np.ndarray:
    column = batch["vector"]
    return scaled(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimensions), scale)


def _round_sums(vectors: DataFrame, centroids: list[tuple[int, ...]], dimensions: int, scale: int) -> dict:
    """Per centroid: how many vectors are nearest to it, and the exact sums of their components."""
    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, total, count = Orchard(centroids), {}, {}
        for batch in batches:
            own = _matrix(batch, dimensions, scale)
            cluster, _, _ = search.nearest(own)
            wide = own.dtype == object or len(own) * float(np.abs(own).max(initial=0)) >= 2.0 ** 62
            for c in np.unique(cluster).tolist():
                part = own[cluster == c]
                added = (part.astype(object) if wide else part).sum(axis=0).tolist()
                total[c] = [a + b for a, b in zip(total[c], added)] if c in total else added
                count[c] = count.get(c, 0) + len(part)
        rows = [(c, -1, 0, n) for c, n in count.items()]
        for c, own in total.items():
            for d, x in enumerate(own):
                limb = 0
                while x and x != -1 or limb == 0:  # the last limb carries the sign
                    low = x & ((1 << LIMB) - 1)
                    rows.append((c, d, limb, low))
                    x, limb = x >> LIMB, limb + 1
                if x:
                    rows.append((c, d, limb, -1))
        names = ("cluster", "dimension", "limb", "value")
        yield pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=list(names))

    told = vectors.select("vector").mapInArrow(sums, "cluster bigint, dimension bigint, limb bigint, value bigint")
    told = told.groupBy("cluster", "dimension", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    out: dict = {}
    for r in told:
        own = out.setdefault(r["cluster"], {"n": 0, "sums": [0] * dimensions})
        if r["dimension"] < 0:
            own["n"] = int(r["value"])
        else:
            own["sums"][r["dimension"]] += int(r["value"]) << (LIMB * r["limb"])
    return out


def assign(vectors: DataFrame, centroids: list[tuple[int, ...]], dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(id, cluster, distance) of every vector; a distance beyond a long is null."""
    kind = dict(vectors.dtypes)["id"]

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        for batch in batches:
            cluster, distance, _ = search.nearest(_matrix(batch, dimensions, scale))
            distance = distance if distance.dtype == np.int64 else [x if x <= LARGEST else None for x in distance.tolist()]
            yield pa.record_batch([batch["id"], pa.array(cluster.astype(np.int32)), pa.array(distance, pa.int64())],
                                  names=["id", "cluster", "distance"])

    return vectors.mapInArrow(nearest, f"id {kind}, cluster int, distance bigint")


def cluster_vectors(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE,
                    seed: str = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[tuple[int, ...]]]:
    """(id, cluster, distance) of every usable vector, and the centroids.

    Components become floor(scale * x).  The first centroids are the vectors with the
    smallest sha256 of ``seed`` and id.  A round moves every centroid that has vectors to the
    floor of their mean, in exact integers whatever their size; it stops early
    only when nothing moved, which further rounds would not change.

    Vectors that are null, of another length, or hold nulls or non-finite numbers
    are left out.  Rows that share an id are vectors of their own, and tie for a
    first centroid by their components; a null id counts as empty text.  Fewer than ``k`` vectors
    give as many centroids; none give no rows.  Other columns are not read,
    whatever their names.  Each round reads the vectors once; k * dimensions
    sums, added up by Spark, are all that the driver gathers.
    """
    spark = vectors.sparkSession
    python_ready(spark)
    kept = materialize(usable(vectors, dimensions, id_col, vector_col), "vectors")
    key = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    centroids = first_centroids(kept, k, key, scale)
    if not centroids:
        return kept.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        sums = _round_sums(kept, centroids, dimensions, scale)
        moved = [tuple(s // sums[c]["n"] for s in sums[c]["sums"]) if c in sums else own for c, own in enumerate(centroids)]
        if moved == centroids:
            break
        centroids = moved
    return assign(kept, centroids, dimensions, scale), centroids


def op11_orchard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with their inertia and the digest of their centroid; an inertia beyond a long is null."""
    told, centroids = cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    told = materialize(told, "clusters")
    digests = [(c, hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()) for c, own in enumerate(centroids)]
    total = lambda: F.sum(F.col("distance").cast("decimal(38,0)"))
    bounded = lambda x: F.when(x <= LARGEST, x.cast("long"))
    each = {r["cluster"]: r for r in told.groupBy("cluster").agg(
        total().alias("s"), F.count_if(F.col("distance").isNull()).alias("beyond")).collect()}
    none_beyond = all(not r["beyond"] for r in each.values())
    whole = sum(int(r["s"]) for r in each.values()) if none_beyond else None
    known = spark.createDataFrame(
        [(c, int(each[c]["s"]) if c in each and not each[c]["beyond"] and each[c]["s"] <= LARGEST else None,
          whole if whole is not None and whole <= LARGEST else None, d) for c, d in digests],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return told.withColumnRenamed("id", "vec_id").join(known, "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    parts = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {DIMENSIONS}
), x AS MATERIALIZED (
  SELECT r, generate_subscripts(v, 1) AS d, floor({SCALE} * unnest(v))::BIGINT AS x FROM kept
), chosen AS MATERIALIZED (
  SELECT r, row_number() OVER (ORDER BY sha256('{SEED}' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c FROM kept
  ORDER BY 2 LIMIT {CENTROIDS}
), m0 AS MATERIALIZED (SELECT c, d, x FROM x JOIN chosen USING (r))"""]
    for i in range(ROUNDS + 1):
        parts.append(f"""
n{i} AS MATERIALIZED (
  SELECT r, min({{'s': s, 'c': c}}) AS best
  FROM (SELECT x.r, m.c, sum((x.x - m.x) * (x.x - m.x)) AS s FROM x JOIN m{i} m USING (d) GROUP BY ALL) GROUP BY r
)""")
        if i < ROUNDS:
            parts.append(f"""
m{i + 1} AS MATERIALIZED (
  SELECT m.c, m.d, coalesce(g.x, m.x) AS x FROM m{i} m LEFT JOIN (
    SELECT n.best.c AS c, x.d, ((sum(x.x) - ((sum(x.x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
    FROM x JOIN n{i} n USING (r) GROUP BY ALL) g USING (c, d)
)""")
    return ",".join(parts) + f"""
SELECT k.vec_id, n.best.c::INTEGER AS cluster, n.best.s::BIGINT AS distance,
       (sum(n.best.s) OVER (PARTITION BY n.best.c))::BIGINT AS cluster_inertia, (sum(n.best.s) OVER ())::BIGINT AS inertia,
       h.centroid_sha256
FROM n{ROUNDS} n JOIN kept k USING (r)
JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM m{ROUNDS} GROUP BY c) h ON h.c = n.best.c"""


QUERIES = {"op11_orchard_clusters": op11_orchard_clusters}

ORACLE_SQL = {"op11_orchard_clusters": _oracle()}
