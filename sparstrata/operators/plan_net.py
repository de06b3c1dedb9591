"""A network that tells for every plan at once how likely it is a good one for a matrix.

Its input are powers and products of a matrix's features, its outputs one
probability a plan. It is learned in rounds over all matrices: tasks sum the
gradients of their rows, the sums of tasks are added up in groups of ``FAN``
until few are left, and the driver takes one step with the total.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparstrata.functions.storage import forget, written
from sparstrata.operators.tune import GOOD

HIDDEN = (64, 64, 64)
DEGREE = 4
#: Sums of tasks that are added up at once.
FAN = 16
SUMS = "part long, total binary"


@dataclass(frozen=True)
class PlanNet:
    """Features, plans in ascending order, the model that makes scaled powers, and the weights and offsets of each layer in turn."""

    features: list[str]
    plans: list[int]
    powers: PipelineModel
    weights: list[np.ndarray]


def first_weights(sizes: list[int], seed: int) -> list[np.ndarray]:
    """Uniform weights, in a range by the number of inputs of a layer, and offsets of zero."""
    rng = np.random.default_rng(seed)
    layers = []
    for n, m in zip(sizes, sizes[1:]):
        layers += [rng.uniform(-1, 1, (n, m)) * math.sqrt(6 / n), np.zeros(m)]
    return layers


def activations(weights: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """The input and what each layer makes of it, the last one probabilities."""
    found = [x]
    for k in range(0, len(weights), 2):
        z = found[-1] @ weights[k] + weights[k + 1]
        found.append(np.maximum(z, 0) if k + 2 < len(weights) else 1 / (1 + np.exp(-np.clip(z, -500, 500))))
    return found


def gradient_sums(weights: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Summed cross-entropy, the number of known labels, and the sum's gradient by each weight, in one array; a label that is not a number is unknown."""
    layers = activations(weights, x)
    known = ~np.isnan(y)
    p = np.clip(layers[-1], 1e-12, 1 - 1e-12)
    loss = -np.log(np.where(y == 1, p, 1 - p))[known].sum()
    slope, parts = np.where(known, layers[-1] - np.where(known, y, 0), 0), []
    for k in range(len(weights) - 2, -1, -2):
        own = layers[k // 2]
        parts[:0] = [(own.T @ slope).ravel(), slope.sum(axis=0)]
        slope = (slope @ weights[k].T) * (own > 0)
    return np.concatenate([[loss, known.sum()], *parts])


def steps(weights: list[np.ndarray], rate: float, decay: float, slopes) -> list[np.ndarray]:
    """The weights after a step for each total of ``slopes``, which is a function of the weights, with moments of first and second order."""
    flat = np.concatenate([w.ravel() for w in weights])
    ends = np.cumsum([w.size for w in weights])[:-1]
    shaped = lambda f: [p.reshape(w.shape) for p, w in zip(np.split(f, ends), weights, strict=True)]
    mean, square = np.zeros_like(flat), np.zeros_like(flat)
    for t, slope in enumerate(slopes, 1):
        total = slope(shaped(flat))
        g = total[2:] / max(total[1], 1) + decay * flat
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        flat = flat - rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return shaped(flat)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def summed_gradients(rows: DataFrame, weights: list[np.ndarray], parts: int) -> np.ndarray:
    """``gradient_sums`` over all rows(x, y), which are in about so many partitions."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                more = gradient_sums(weights, _matrix(batch["x"]), _matrix(batch["y"]))
                total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "total": [total.tobytes()]})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(t) for t in table["total"].to_pylist())
        return pa.table({"part": table["part"][:1], "total": [total.tobytes()]})

    sums = rows.mapInArrow(own, SUMS)
    while parts > FAN:
        parts = -(-parts // FAN)
        sums = sums.withColumn("part", F.expr(f"part div {FAN}")).groupBy("part").applyInArrow(add, SUMS)
    found = [np.frombuffer(r.total) for r in sums.collect()]  # FAN arrays of the network's size
    return np.sum(found, axis=0) if found else np.zeros(2 + sum(w.size for w in weights))


def examples(log: DataFrame, features: list[str], plans: list[int]) -> DataFrame:
    """(matrix, features, y): for each plan 1 if it has ``GOOD`` of its matrix's best speed, 0 if not, NaN if the matrix has not run it.

    Of repeated runs the fastest counts; runs without a matrix, plan or time take no part.
    """
    runs = log.dropna(subset=["matrix", "plan", "time"]).groupBy("matrix", "plan")
    runs = runs.agg(F.min("time").alias("_time"), *[F.max(f).cast("double").alias(f) for f in features])
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("plan").cast("long"), "_time")))  # as many as there are plans
    each = runs.groupBy("matrix").agg(F.min("_time").alias("_best"), pairs.alias("_times"), *[F.max(f).alias(f) for f in features])
    good = F.transform(F.array(*[F.lit(p).cast("long") for p in plans]), lambda p: F.coalesce((F.col("_best") / F.try_element_at("_times", p) >= GOOD).cast("double"), F.lit(float("nan"))))
    return each.select("matrix", *features, good.alias("y"))


def plan_net(
    log: DataFrame, features: list[str], degree: int = DEGREE, hidden: tuple[int, ...] = HIDDEN, rounds: int = 50, rate: float = 1e-2, decay: float = 1e-6, seed: int = 0
) -> PlanNet:
    """A network learned from log(matrix, plan, time, features).

    Matrices with a feature that is null or not a number take no part; a plan that a
    matrix has not run has no say in its loss. An empty log is refused. The
    plans and the weights are held by the driver and sent to each task; neither
    grows with the log.
    """
    plans = sorted(r.plan for r in log.where("plan is not null").select(F.col("plan").cast("long").alias("plan")).distinct().collect())
    if not plans:
        raise ValueError("no run to learn from")
    table = written(examples(log, features, plans), "runs")
    stages = [
        VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip"),
        PolynomialExpansion(degree=degree, inputCol="_raw", outputCol="_powers"),
        StandardScaler(inputCol="_powers", outputCol="_scaled", withMean=True),
    ]
    powers = Pipeline(stages=stages).fit(table)
    rows = written(powers.transform(table).select(vector_to_array("_scaled").alias("x"), "y"), "examples")
    parts = (rows.select(F.spark_partition_id().alias("part")).agg(F.max("part")).first()[0] or 0) + 1
    inputs = math.comb(len(features) + degree, degree) - 1
    start = first_weights([inputs, *hidden, len(plans)], seed)
    weights = steps(start, rate, decay, [lambda w: summed_gradients(rows, w, parts)] * rounds)
    forget(table, rows)
    return PlanNet(features, plans, powers, weights)


def chosen_by_net(net: PlanNet, matrices: DataFrame) -> DataFrame:
    """(matrix, plan, likely) for matrices(matrix, features): the likeliest plan, of equal ones the smallest, and its probability.

    Matrices with a feature that is null or not a number get no row, repeated rows a row each.
    """
    rows = matrices.select("matrix", *[F.col(f).cast("double").alias(f) for f in net.features])
    rows = net.powers.transform(rows).select("matrix", vector_to_array("_scaled").alias("x"))
    plans, weights = np.array(net.plans), net.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                p = activations(weights, _matrix(batch["x"]))[-1]
                best = p.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch["matrix"], pa.array(plans[best]), pa.array(p[np.arange(len(p)), best])], ["matrix", "plan", "likely"])

    kind = rows.schema["matrix"].dataType.simpleString()
    return rows.mapInArrow(run, f"matrix {kind}, plan long, likely double")


def save_net(spark: SparkSession, net: PlanNet, path: str) -> None:
    """Write a network into a new folder: its powers as a pipeline model, one row of names, and a row for each array."""
    net.powers.write().save(f"{path}/powers")
    spark.createDataFrame([(net.features, net.plans)], "features array<string>, plans array<long>").coalesce(1).write.parquet(f"{path}/names")
    rows = [(k, list(w.shape), bytearray(w.tobytes())) for k, w in enumerate(net.weights)]
    spark.createDataFrame(rows, "k int, shape array<int>, data binary").coalesce(1).write.parquet(f"{path}/weights")


def load_net(spark: SparkSession, path: str) -> PlanNet:
    names = spark.read.parquet(f"{path}/names").first()
    rows = spark.read.parquet(f"{path}/weights").orderBy("k").collect()
    return PlanNet(list(names.features), list(names.plans), PipelineModel.load(f"{path}/powers"), [np.frombuffer(r.data).reshape(r.shape) for r in rows])
