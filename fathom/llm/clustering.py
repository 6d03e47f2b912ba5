"""Operator 12: Lloyd's algorithm over whole numbers, so that every run gives the same clusters.

Vectors become integers once and are written.  Each round sends the centroids out with a broadcast; tasks find every
vector's nearest one in NumPy and give back, for each centroid, how many vectors it has and their sums; a groupBy adds
those up.  Only the centroids ever come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import store

DIMENSIONS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3
#: Differences below this can be squared and added up 64 times in a signed long.
PLAIN = 1 << 28


def quantised(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and q, the components as longs: floor(scale * x), x as double.

    Vectors that are null, of another length, or hold a null or non-finite component are left out.  Other columns are
    ignored.  A component beyond the range of a long is an error, as no distance to it fits in a long.
    """
    held = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")).filter(F.size("v") == dimensions)
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return held.filter(~odd).select("vec_id", F.transform("v", lambda x: F.floor(x * float(scale))).alias("q"))


def first_centroids(q: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors with the smallest SHA-256 of ``seed:vec_id``, in that order; ties and null ids (last) by components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r.q) for r in q.select("q", order.alias("h")).orderBy(F.col("h").asc_nulls_last(), "q").limit(clusters).collect()]


def nearest(block: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of block the lowest number of its nearest centroid, and the squared distance to it."""
    far = []
    for c in centroids:
        d = block - c
        if d.size and max(int(d.max()), -int(d.min())) >= PLAIN:  # exact, but slow
            d = d.astype(object)
        far.append((d * d).sum(axis=1))
    far = np.stack(far, axis=1)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(block)), best]


def _blocks(frames: Iterator[pd.DataFrame], dimensions: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for frame in frames:
        if len(frame):
            yield frame, np.concatenate(frame["q"].to_list()).astype(np.int64).reshape(-1, dimensions)


def moved(q: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: each the floor of its vectors' mean; those without a vector stay."""
    k, dimensions = len(centroids), len(centroids[0])
    sent = q.sparkSession.sparkContext.broadcast(np.array(centroids, np.int64))

    def add_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), object)
        for _, block in _blocks(frames, dimensions):
            best, _ = nearest(block, sent.value)
            for c in np.unique(best):
                mine = block[best == c]
                counts[c] += len(mine)
                sums[c] += mine.sum(axis=0) if abs(mine).max() < 1 << 48 else mine.astype(object).sum(axis=0)
        for c in np.flatnonzero(counts):
            yield pd.DataFrame({"cluster": int(c), "n": int(counts[c]), "place": range(dimensions), "total": sums[c].astype(np.int64)})

    parts = q.select("q").mapInPandas(add_up, "cluster int, n long, place int, total long")
    rows = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    sent.unpersist()
    new = [list(c) for c in centroids]
    for r in rows:  # at most clusters x dimensions
        new[r.cluster][r.place] = r.total // r.n
    return new


def assigned(q: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance (squared)."""
    dimensions, sent = len(centroids[0]), q.sparkSession.sparkContext.broadcast(np.array(centroids, np.int64))

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, block in _blocks(frames, dimensions):
            best, far = nearest(block, sent.value)
            yield pd.DataFrame({"vec_id": frame["vec_id"], "cluster": best.astype(np.int32), "distance": far.astype(np.int64)})

    return q.mapInPandas(find, f"vec_id {q.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and centroid of every vector kept by ``quantised``.

    Equal distances go to the smaller number.  Repeated rows are vectors of their own, also as first centroids, and
    null vec_ids are clustered like others.  With fewer vectors than clusters there are as many clusters as vectors;
    without vectors there are no rows.  Distances and sums that don't fit in a long are an error.
    """
    spark = vectors.sparkSession
    q = store.written(quantised(vectors, dimensions, scale), "vectors")
    centroids = first_centroids(q, clusters, seed)
    if not centroids:
        empty = f"vec_id {q.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"
        return spark.createDataFrame([], empty)
    for _ in range(rounds):
        centroids = moved(q, centroids)
    found = store.written(assigned(q, centroids), "clusters")
    store.discard(q)
    inertia = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    whole = sum(inertia.values())
    about = [(c, s, whole, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest(), centroids[c]) for c, s in inertia.items()]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    # one row a cluster
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")


def clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op12: all embeddings."""
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("centroid")


def _sql() -> str:
    """The rounds one after the other, as DuckDB says them."""
    parts = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS})""",
        f"""c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), q) - 1)::INT AS cluster, q
  FROM v QUALIFY row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), q) <= {CLUSTERS})""",
    ]
    for k in range(ROUNDS + 1):
        parts.append(f"""a{k} AS MATERIALIZED (
  SELECT r, vec_id, v.q, cluster, list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance
  FROM v, c{k} c QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)""")
        if k < ROUNDS:
            parts.append(f"""c{k + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m.q, c.q) AS q FROM c{k} c LEFT JOIN (
    SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q FROM (
      SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, unnest(range(1, {DIMENSIONS + 1})) AS i FROM a{k}) GROUP BY cluster, i)
    GROUP BY cluster) m USING (cluster))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, a.cluster, distance, (sum(distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c USING (cluster)"""


SQL = _sql()
