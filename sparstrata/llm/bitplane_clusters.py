"""Centroid clustering by popcounts of bit planes.

A vector of 64 components becomes whole numbers, and these become bit planes:
plane p is one 64-bit word that holds bit p of each component, in two's
complement, so the highest plane weighs less than nothing. The dot product of a
vector and a centroid is the sum of popcount(plane of one AND plane of the other)
over all pairs of planes, each with the product of their weights; with the squared
norms it gives exact squared distances. A row takes as many planes as its
values need, and floating point is left once planes are made.

Planes are written once. Each round is one pass that sends a row of sums for each
cluster and component of a task, and the driver sees the centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, saved

WIDTH = 64
#: Whole numbers lie within this, so that every squared distance fits into 63 bits.
LIMIT = 1 << 27


def planes_of(values: np.ndarray) -> np.ndarray:
    """(rows, planes) words of (rows, 64) whole numbers."""
    most = int(max(values.max(initial=0), (~values).max(initial=0))).bit_length() + 1
    bits = [np.packbits((values >> p & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8") for p in range(most)]
    return np.concatenate(bits, axis=1)


def values_of(planes: np.ndarray) -> np.ndarray:
    """The (rows, 64) whole numbers of (rows, planes) words."""
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(len(planes), -1, 8), axis=2, bitorder="little")
    return np.einsum("npc,p->nc", bits, weights(planes.shape[1]), dtype=np.int64)


def weights(n: int) -> np.ndarray:
    """What each of n planes weighs; the last one holds the sign."""
    out = 1 << np.arange(n, dtype=np.int64)
    out[-1] *= -1
    return out


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(rows, centroids) exact dot products of two tables of planes."""
    own, others = weights(x.shape[1]), weights(c.shape[1])
    columns = [np.ascontiguousarray(x[:, p]) for p in range(x.shape[1])]
    out = np.zeros((len(x), len(c)), np.int64)
    for k, centroid in enumerate(c):
        for column, weight in zip(columns, own, strict=True):
            part = np.zeros(len(x), np.int64)
            for word, other in zip(centroid, others, strict=True):
                if word:
                    part += np.bitwise_count(column & word) * other
            out[:, k] += part * weight
    return out


def norms(x: np.ndarray) -> np.ndarray:
    own, out = weights(x.shape[1]), np.zeros(len(x), np.int64)
    for p in range(x.shape[1]):
        for q in range(p, x.shape[1]):
            out += np.bitwise_count(x[:, p] & x[:, q]) * (own[p] * own[q] * (1 if p == q else 2))
    return out


def _words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, planes) of a column of planes, by the number of planes."""
    starts = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data, sizes = np.frombuffer(column.buffers()[2] or b"", np.uint8), np.diff(starts)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, data[starts[at][:, None] + np.arange(size)].view("<u8")


def pack_planes(vectors: DataFrame, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, planes) of vectors with exactly 64 components, none of them null or not finite; others are left out.

    Components become floor(scale * x); beyond 2**27 they are refused with an
    error, for their distances would not fit into a long. Null ids and repeated
    rows stay rows of their own. An empty table gives no rows. Narrow: no shuffle.
    """
    kept = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = kept.where((F.size("v") == WIDTH) & finite)
    schema = T.StructType([T.StructField("id", vectors.schema[id_col].dataType), T.StructField("planes", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            scaled = np.floor(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH) * scale)
            if not (np.abs(scaled) < LIMIT).all():
                raise ValueError(f"a component times {scale} is beyond {LIMIT}")
            words = np.ascontiguousarray(planes_of(scaled.astype(np.int64)))
            ends = np.arange(len(words) + 1, dtype=np.int32) * (8 * words.shape[1])
            column = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(words.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), column], ["id", "planes"])

    return kept.mapInArrow(pack, schema)


def seeds(packed: DataFrame, k: int, seed: int) -> np.ndarray:
    """(k, 64) values of the rows whose ids, behind the seed, have the smallest digests; null ids come last, ties go by planes."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = packed.orderBy(digest.asc_nulls_last(), "planes").limit(k).collect()
    return np.array([values_of(np.frombuffer(r["planes"], "<u8")[None])[0] for r in first], np.int64).reshape(-1, WIDTH)


def _nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row, ties to the smaller number."""
    c = planes_of(centroids)
    far = norms(planes)[:, None] - 2 * dots(planes, c) + norms(c)[None]
    best = far.argmin(axis=1)
    return best, far[np.arange(len(far)), best]


def moved(packed: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of the exact means of what is nearest to each, as they were where nothing is."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((len(centroids), WIDTH), np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, planes in _words(batch.column(0)):
                best, _ = _nearest(planes, centroids)
                np.add.at(total, best, values_of(planes))
                count += np.bincount(best, minlength=len(centroids))
        c, d = np.divmod(np.arange(total.size), WIDTH)
        full = count[c] > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[full]) for x in (c, d, total.ravel(), count[c])], ["c", "d", "s", "n"])

    parts = packed.select("planes").mapInArrow(sums, "c long, d long, s long, n long")
    found = parts.groupBy("c", "d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    out = centroids.copy()
    for r in found.collect():  # a row for each component of each centroid
        out[r["c"], r["d"]] = int(r["s"]) // int(r["n"])
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Rows (id, cluster, distance) of the vectors that ``pack_planes`` keeps, and the (k, 64) final centroids.

    Centroids start as the k rows that ``seeds`` picks, all rows if there are
    fewer. In each round every vector goes to the nearest centroid (squared
    Euclidean distance, ties to the smaller number) and centroids move; then
    vectors are assigned once more. All arithmetic is exact.
    """
    packed = saved(pack_planes(vectors, scale, id_col, vector_col), "planes")
    centroids = seeds(packed, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(packed, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for at, planes in _words(batch.column(1)):
                cluster[at], distance[at] = _nearest(planes, centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array(distance)], ["id", "cluster", "distance"])

    schema = T.StructType([packed.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    assigned = saved(packed.mapInArrow(assign, schema), "assigned")
    forget(packed)
    return assigned, centroids


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one for each vector that is kept.

    Vectors that are null, of another length than 64, or with a null or
    non-finite component are left out. Other columns are ignored, repeated rows
    are rows of their own, an empty table gives no rows. The digest is that of
    the final centroid's components as decimal numbers joined by commas.
    """
    assigned, centroids = cluster(vectors, k, rounds, seed, scale, id_col, vector_col)
    spark = vectors.sparkSession
    digests = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    by_cluster = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    # k rows at most
    sums = {r["cluster"]: int(r["own"]) for r in by_cluster.collect()}
    table = [(c, sums.get(c, 0), sum(sums.values()), digest) for c, digest in digests]
    known = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
