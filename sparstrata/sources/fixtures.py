"""Matrices derived from the driver's tables; all values are dyadic, so sums do not depend on their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tiers(spark: SparkSession, sf_dir: str) -> tuple[int, int, int, int]:
    """The first row of the parts, of the orders, of the customers, and the number of rows; suppliers come first."""
    supplier, part, orders, customer = (_read(spark, sf_dir, t).count() for t in ("supplier", "part", "orders", "customer"))
    return supplier, supplier + part, supplier + part + orders, supplier + part + orders + customer


def size(spark: SparkSession, sf_dir: str) -> int:
    return tiers(spark, sf_dir)[3]


def lower_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower triangular (i, j, v), diagonal 8, with a row for each supplier, part, order and customer.

    Parts depend on their suppliers and orders on their parts, by all rows of
    ``lineitem``, and customers on their orders. It grows with all four tables.
    """
    parts, orders, customers, m = tiers(spark, sf_dir)
    lines = _read(spark, sf_dir, "lineitem")
    pair = lambda table, i, j: table.select(i.cast("long").alias("i"), j.cast("long").alias("j"))
    pairs = (
        pair(lines, F.col("l_partkey") + parts, F.col("l_suppkey"))
        .unionByName(pair(lines, F.col("l_orderkey") + orders, F.col("l_partkey") + parts))
        .unionByName(pair(_read(spark, sf_dir, "orders"), F.col("o_custkey") + customers, F.col("o_orderkey") + orders))
    )
    below = pairs.groupBy("i", "j").agg(F.count("*").alias("n"))
    below = below.select("i", "j", (((F.col("n") * 5 + F.col("i") + F.col("j")) % 7 + 1) / 16.0).cast("double").alias("v"))
    return below.unionByName(spark.range(m).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(8.0).alias("v")))


def right_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, b) for each row of ``lower_triangle``."""
    return spark.range(size(spark, sf_dir)).select(F.col("id").alias("i"), ((F.col("id") % 5 + 1) / 8.0).cast("double").alias("b"))


def square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """General square pattern with values: all pairs of an order and a part of ``lineitem``; most rows have entries below the diagonal, some above."""
    pairs = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("i"), F.col("l_partkey").cast("long").alias("j")).distinct()
    return pairs.withColumn("v", (((F.col("i") * 7 + F.col("j")) % 9 + 1) / 16.0).cast("double"))


def skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern with one long row, of a quarter of all ``events``, and rows of at most eight others."""
    i = F.when(F.col("event_id") % 4 == 0, 0).otherwise(F.expr("event_id div 8 + 1")).cast("long")
    return _read(spark, sf_dir, "events").select(i.alias("i"), F.col("event_id").cast("long").alias("j")).distinct()


def perf_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuning history (matrix, plan, time) from ``events``, of plans of each kind of event: a matrix for each user."""
    events = _read(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").cast("long").alias("matrix"), (F.col("event_id") % 12).cast("long").alias("plan")).agg((F.min("value") + 1).alias("time"))


def order_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower triangular (i, j, v) with a row for each of ``orders``, which grows with the table.

    An order depends on its customer's order before and on the third before; the diagonal is 8.
    """
    own = Window.partitionBy("o_custkey").orderBy("i")
    rows = _read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("long").alias("i"))
    back = rows.select("i", F.lag("i", 1).over(own).alias("one"), F.lag("i", 3).over(own).alias("three"))
    entry = lambda j, v: F.struct(j.alias("j"), v.cast("double").alias("v"))
    value = lambda j: (F.col("i") + F.col(j)) % 5 + 1
    entries = F.array(entry(F.col("one"), value("one")), entry(F.col("three"), value("three")), entry(F.col("i"), F.lit(8)))
    return back.select("i", F.explode(entries).alias("e")).where("e.j is not null").select("i", "e.j", "e.v")


def order_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right-hand side (i, b) of ``order_chain``."""
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("i"), (F.col("o_orderkey") % 7 + 1).cast("double").alias("b"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuning history (matrix, plan, time) that grows with ``events``: a matrix for each user; not all have run all plans."""
    events = _read(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").cast("long").alias("matrix"), (F.col("event_id") % 12).cast("long").alias("plan")).agg((F.min("value") + 1).alias("time"))


def matrix_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(matrix, m, nnz): size of each user's matrix of ``events``."""
    events = _read(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").cast("long").alias("matrix")).agg(F.countDistinct("ts").alias("m"), (F.count("*") * 10).alias("nnz"))


def nation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower triangular (i, j, v) with a row for each of ``orders`` and as many levels as the busiest nation has orders.

    An order depends on the order before and on the third before among those of
    its nation's customers; the diagonal is 16. Rows and levels grow with the table.
    """
    homes = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    own = Window.partitionBy("c_nationkey").orderBy("i")
    rows = _read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("long").alias("i")).join(homes, "o_custkey")
    back = rows.select("i", F.lag("i", 1).over(own).alias("one"), F.lag("i", 3).over(own).alias("three"))
    entry = lambda j, v: F.struct(j.alias("j"), v.cast("double").alias("v"))
    value = lambda j: (F.col("i") + F.col(j)) % 5 + 1
    entries = F.array(entry(F.col("one"), value("one")), entry(F.col("three"), value("three")), entry(F.col("i"), F.lit(16)))
    return back.select("i", F.explode(entries).alias("e")).where("e.j is not null").select("i", "e.j", "e.v")
