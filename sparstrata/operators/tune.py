"""Plans: their space, labels from a log of times, the best of each matrix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the plan space.
SPACE = {
    "tbs": [64, 256, 1024],
    "sws": [1, 4, 8],
    "rp": [0, 1, 2],
    "alpha": [1, 4, 8, 16, 32],
    "lp": [0, 1],
    "ls": [1],
    "ws": [0, 1, 2],
    "rg": [0, 1],
}
GOOD = 0.85


def plan_space(spark: SparkSession) -> DataFrame:
    """All plans; row-wise partitions allow neither several lanes nor balanced packs."""
    plans = spark.range(1).select()
    plans = reduce(lambda df, kv: df.select("*", F.explode(F.array(*map(F.lit, kv[1]))).alias(kv[0])), SPACE.items(), plans)
    return plans.where("not (lp = 1 and sws > 1) and not (lp = 1 and rg = 1)")


def labels(log: DataFrame) -> DataFrame:
    """(matrix, plan, good): whether a plan has ``GOOD`` of its matrix's best speed."""
    best = F.min("time").over(Window.partitionBy("matrix"))
    return log.select("matrix", "plan", (best / F.col("time") >= GOOD).alias("good"))


def best_plans(log: DataFrame) -> DataFrame:
    return log.groupBy("matrix").agg(F.min_by("plan", F.struct("time", "plan")).alias("plan"), F.min("time").alias("time"))


def popular_plan(log: DataFrame, held_out: int) -> DataFrame:
    """(matrix, plan, ratio): the plan that is good for most other matrices, and its share of the best speed on a held-out one."""
    trained = labels(log.where(F.col("matrix") != held_out))
    votes = trained.groupBy("plan").agg(F.sum(F.col("good").cast("long")).alias("votes"))
    # one row
    chosen = votes.agg(F.max_by("plan", F.struct("votes", -F.col("plan"))).alias("plan"))
    own = log.where(F.col("matrix") == held_out).withColumn("best", F.min("time").over(Window.partitionBy("matrix")))
    return own.join(F.broadcast(chosen), "plan").select("matrix", "plan", (F.col("best") / F.col("time")).alias("ratio"))


def informed(log: DataFrame, info: DataFrame, least: int = 1000) -> DataFrame:
    """The log of matrices that have a row of information and ``least`` entries or more, with that row's columns."""
    return log.join(info.where(F.col("nnz") >= least), "matrix")


def complete(log: DataFrame, plans: int) -> DataFrame:
    """The log of matrices that have run all ``plans`` plans."""
    full = log.groupBy("matrix").agg(F.countDistinct("plan").alias("n")).where(F.col("n") == plans).select("matrix")
    return log.join(full, "matrix")


def split_by_matrix(log: DataFrame, share: float = 0.8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two parts of a log; all runs of a matrix are in one, by a hash of its name."""
    first = F.pmod(F.xxhash64(F.col("matrix").cast("string"), F.lit(seed)), F.lit(10_000)) < int(share * 10_000)
    return log.where(first), log.where(~first)


def score(chosen: DataFrame, log: DataFrame) -> DataFrame:
    """One row (n, hits, ratio) of chosen(matrix, plan): how many are good plans, and the mean share of the best speed."""
    best = log.withColumn("best", F.min("time").over(Window.partitionBy("matrix")))
    ran = best.join(chosen, ["matrix", "plan"]).withColumn("ratio", F.col("best") / F.col("time"))
    return ran.agg(F.count("*").alias("n"), F.sum((F.col("ratio") >= GOOD).cast("long")).alias("hits"), F.avg("ratio").alias("ratio"))


def plan_chooser(training: DataFrame, features: list[str], degree: int = 2, iterations: int = 50):
    """A model that predicts the best plan from a matrix's features: their powers and products, scaled, and a multinomial regression.

    ``training`` has matrix, plan, time and the features; of each matrix its
    fastest plan is learned. The model is saved and loaded as any pipeline model.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler

    best = best_plans(training).select("matrix", F.col("plan").cast("double").alias("label"))
    rows = training.select("matrix", *features).distinct().join(best, "matrix")
    steps = [
        VectorAssembler(inputCols=features, outputCol="raw"),
        PolynomialExpansion(degree=degree, inputCol="raw", outputCol="powers"),
        StandardScaler(inputCol="powers", outputCol="scaled", withMean=True),
        LogisticRegression(featuresCol="scaled", labelCol="label", maxIter=iterations, regParam=1e-3, family="multinomial"),
    ]
    return Pipeline(stages=steps).fit(rows)


def chosen_plans(model, matrices: DataFrame) -> DataFrame:
    """(matrix, plan) that a plan chooser predicts for matrices(matrix, features)."""
    return model.transform(matrices).select("matrix", F.col("prediction").cast("long").alias("plan"))
