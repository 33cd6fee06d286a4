"""R5/R6 with exact pruning: clusters around pivots, skipped where the triangle inequality excludes them.

Angles between vectors obey the triangle inequality.  ``build`` gives each
vector to its nearest of a few pivots and stores the clusters as partitions,
with the smallest and largest angle to the pivot.  For a question at angle a to
a pivot, no vector of its cluster is nearer than max(a - largest, smallest - a, 0).
``pruned_topk`` reads clusters in the order of that bound until it has k vectors,
then only those whose bound is not beyond the k-th of them.  The result is the
same k rows as of a full scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigsight.functions.vectors import cosine_from_parts, dot, norm, similarity_score
from sigsight.operators.vector_search import _vectors

#: Pivots, and so clusters: what the driver holds of an index.
PIVOTS = 64
#: Angles are compared with this much room for rounding.
ROOM = 1e-6
#: The cluster of vectors without a direction or of another length: no similarity, ranked last.
NONE = -1


def _assign(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = _vectors(batch.column("embedding"), pivots.shape[1])
            with np.errstate(invalid="ignore", divide="ignore"):
                cos = np.clip(vecs / np.linalg.norm(vecs, axis=1, keepdims=True) @ pivots.T, -1, 1)
            real = ~np.isnan(cos).any(axis=1)
            cos[~real] = 0
            best = cos.argmax(axis=1)
            angle = np.arccos(cos[np.arange(len(cos)), best])
            cluster = np.where(real, best, NONE).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("event_id", "id", "event_date", "embedding")),
                                              pa.array(cluster), pa.array(np.where(real, angle, 0.0))],
                                             names=["event_id", "id", "event_date", "embedding", "cluster", "angle"])
    return run


def build(events: DataFrame, path: str, pivots: int = PIVOTS) -> None:
    """The vectors of (event_id, id, event_date, embedding) by cluster, with each cluster's pivot, angles and size."""
    spark = events.sparkSession
    rows = events.select("event_id", F.col("id").cast("long").alias("id"), "event_date", F.col("embedding").cast("array<float>").alias("embedding"))
    # Pivots are rows taken by a hash of their keys, of the first such row's length.
    chosen = _first(rows.where((F.size("embedding") > 0) & (norm(F.col("embedding")) > 0)), pivots, F.xxhash64("event_id", "id"), "event_id", "id") \
        .orderBy("rank").select("embedding").collect()
    dim = len(chosen[0].embedding) if chosen else 1
    mat = np.array([r.embedding for r in chosen if len(r.embedding) == dim], dtype=np.float64).reshape(-1, dim)
    mat = mat / np.linalg.norm(mat, axis=1, keepdims=True) if len(mat) else np.ones((1, dim))
    schema = "event_id string, id long, event_date date, embedding array<float>, cluster int, angle double"
    rows.mapInArrow(_assign(mat), schema).repartition("cluster", F.pmod(F.xxhash64("event_id"), F.lit(8))) \
        .write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/vectors")
    spark.read.parquet(f"{path}/vectors").groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.min("angle").alias("nearest"), F.max("angle").alias("farthest")) \
        .join(F.broadcast(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(mat)], "cluster int, pivot array<double>")), "cluster", "left") \
        .write.mode("overwrite").parquet(f"{path}/clusters")


def pruned_topk(spark: SparkSession, path: str, qvec: list[float], k: int) -> tuple[DataFrame, float]:
    """(event_id, id, event_date, cos, similarity_score, rank) of the k nearest, and the share of rows never read."""
    clusters = spark.read.parquet(f"{path}/clusters").collect()  # one row a pivot
    q = np.array(qvec, dtype=np.float64)
    size = math.sqrt(q @ q)
    bounds = []
    for c in clusters:
        if c.pivot is None or size == 0 or len(c.pivot) != len(q):
            bounds.append((math.inf, c))
            continue
        a = math.acos(max(-1.0, min(1.0, float(np.dot(q, c.pivot)) / size)))
        bounds.append((max(a - c.farthest, c.nearest - a, 0.0), c))
    bounds.sort(key=lambda b: (b[0], b[1].cluster))
    taken, held = 0, 0
    while taken < len(bounds) and held < k:
        held += bounds[taken][1].n
        taken += 1
    first = _scan(spark, path, [c.cluster for _, c in bounds[:taken]], qvec, k)
    kth = [r.cos for r in first.orderBy("rank").select("cos").collect()]
    beyond = math.inf if len(kth) < k or kth[-1] is None else math.acos(max(-1.0, min(1.0, kth[-1]))) + ROOM
    read = [c for i, (bound, c) in enumerate(bounds) if i < taken or bound <= beyond]
    total = sum(c.n for c in clusters)
    skipped = 1 - sum(c.n for c in read) / total if total else 0.0
    return _scan(spark, path, [c.cluster for c in read], qvec, k), skipped


def _scan(spark: SparkSession, path: str, clusters: list[int], qvec: list[float], k: int) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in qvec])
    rows = spark.read.parquet(f"{path}/vectors").where(F.col("cluster").isin(clusters))
    fits = F.size("embedding") == len(qvec)
    cos = F.when(fits, cosine_from_parts(dot(q, F.col("embedding")), norm(q), norm(F.col("embedding"))))
    found = rows.select("event_id", "id", "event_date", cos.alias("cos")).withColumn("similarity_score", similarity_score(F.col("cos")))
    return _first(found, k, F.col("cos").desc_nulls_last(), "event_id", "id")


def _first(rows: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows with their ``rank``; each task hands on n at most."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") <= n)
