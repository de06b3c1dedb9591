"""Exhaustive search for the best plan of a matrix, with a log that it can be taken up from."""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import astuple, fields
from itertools import product

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparstrata.functions.storage import forget, written
from sparstrata.operators import solve
from sparstrata.operators.analysis import Plan, solve_planned
from sparstrata.operators.counters import Held

LOG = "matrix string, strategy string, alpha int, by_level boolean, reorder boolean, turns long, time double, max_error double"
#: Answers are right up to this largest error.
TOLERANCE = 1e-4


def space(strategies: Iterable[str] = ("ROW_BLOCK", "ROW_BLOCK_THRESH", "ROW_BLOCK_AVG", "ROW_BLOCK_NODEP"), alphas: Iterable[int] = (1, 4, 8, 16, 32)) -> list[Plan]:
    """All plans of these strategies and thresholds, by level or not, reordered or not."""
    return [Plan(*x) for x in product(strategies, alphas, (True, False), (False, True))]


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log at a path, empty if there is none."""
    try:
        return spark.read.schema(LOG).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def search(a: DataFrame, b: DataFrame, matrix: str, plans: Iterable[Plan], path: str) -> DataFrame:
    """Solve by each plan that the log at ``path`` does not hold for this matrix, verify the answer, and append time and error; the matrix's log.

    A plan is logged once its answer is written and verified, in one append, so
    a search that was interrupted goes on with the plan it was at. Matrix, by row and
    by column, and sides are written once, so that times are those of the solves and
    a check shuffles its products alone.
    """
    spark = a.sparkSession
    own = read_log(spark, path).where(F.col("matrix") == matrix)
    columns = [f.name for f in fields(Plan)]
    known = {tuple(r) for r in own.select(*columns).collect()}  # a row for each plan
    todo = [plan for plan in dict.fromkeys(plans) if astuple(plan) not in known]
    a, b = Held(a), written(b, "search-sides")
    if todo:
        a.columns, a.diagonal, a.triangular  # noqa: B018
    for plan in todo:
        start = time.perf_counter()
        x, turns = solve_planned(a, b, plan)
        x = written(x, "search-answer")
        seconds = time.perf_counter() - start
        error = float(solve.residual(a.columns, x.hint("shuffle_hash"), b).first()["max_error"])
        spark.createDataFrame([(matrix, *astuple(plan), turns, seconds, error)], LOG).coalesce(1).write.mode("append").parquet(path)
        forget(x)
    a.drop()
    forget(b)
    return read_log(spark, path).where(F.col("matrix") == matrix)


def best_plan(log: DataFrame) -> DataFrame:
    """(matrix, plan, turns, time): the fastest plan of each matrix whose answer is right; equal times go by the plan's fields."""
    plan = F.struct(*[f.name for f in fields(Plan)])
    right = log.where(F.col("max_error") <= TOLERANCE)
    return right.groupBy("matrix").agg(F.min(F.struct("time", plan.alias("plan"), "turns")).alias("best")).select("matrix", "best.plan", "best.turns", "best.time")
