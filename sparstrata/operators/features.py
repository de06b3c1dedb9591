"""Structural features of a matrix and measures of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparstrata.functions.scan import prefix


def features(a: DataFrame, levels: DataFrame) -> DataFrame:
    """One row: size, entries, averages and variation of rows and levels, distance of dependencies, level count."""
    rows = a.groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("i") - F.col("j")).alias("distance"))
    per_row = rows.agg(
        F.count("*").alias("m"), F.sum("n").alias("nnz"), F.avg("n").alias("avg_rnnz"), F.max("n").alias("max_rnnz"),
        (F.stddev_pop("n") / F.avg("n")).alias("cov_rnnz"), (F.sum("distance") / F.count("*")).alias("dep_dist"),
    )
    per_level = levels.groupBy("level").agg(F.count("*").alias("n")).agg(
        F.avg("n").alias("avg_lnnz"), F.max("n").alias("max_lnnz"), (F.stddev_pop("n") / F.avg("n")).alias("cov_lnnz"), F.count("*").alias("n_levels")
    )
    # one row each
    return per_row.crossJoin(F.broadcast(per_level))


def later_above(levels: DataFrame) -> DataFrame:
    """(i, n): how many earlier rows of levels(i, level) have a higher level, for rows that have any.

    Counted by bits of the level: two levels differ first, from the top, in one
    bit, so rows are split by the bits above it, and of these a row with a 0
    counts the earlier ones with a 1, by a prefix scan inside the split. All bits
    are scanned together; no row meets another.
    """
    top = levels.agg(F.max("level")).first()[0]
    bits = max(1, int(top or 0).bit_length())
    split = levels.select("i", "level", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
    split = split.select("i", "bit", F.expr("shiftright(level, bit + 1)").alias("above"), F.expr("shiftright(level, bit) & 1").alias("one"))
    counted = prefix(split, "i", "one", "n", by=("bit", "above"))
    return counted.where("one = 0 and n > 0").groupBy("i").agg(F.sum("n").alias("n"))


def reverse_level(levels: DataFrame) -> DataFrame:
    """One row: the mean share of earlier rows that have a higher level."""
    shares = later_above(levels).agg(F.coalesce(F.sum(F.col("n") / (F.col("i") + 1)), F.lit(0.0)).alias("s"))
    # one row each
    return levels.agg(F.count("*").alias("m")).crossJoin(F.broadcast(shares)).select((F.col("s") / F.col("m")).alias("reverse_level"))


def throughput(nnz, m, micros):
    """Columns of GFLOP/s (binary) and bytes moved by one solve."""
    return ((2 * nnz + m) / 2.0**30 * 2.0**20 / micros).alias("gflops"), (nnz * 12 + m * 20).alias("bytes")
