"""Level sets: the longest path of dependencies that ends in each row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparstrata.functions.scan import prefix
from sparstrata.functions.storage import dealt, forget, written


def triangular(a: DataFrame) -> bool:
    """Whether all entries off the diagonal lie on one side of it, which leaves no cycle of dependencies."""
    sides = a.where("i <> j").agg(F.max(F.col("i") > F.col("j")), F.max(F.col("i") < F.col("j"))).first()
    return not (sides[0] and sides[1])


def level_sets(a: DataFrame) -> DataFrame:
    """(i, level), 0 for rows without dependencies; a turn of the loop for each level.

    The matrix is triangular; others, which may have cycles, are refused.
    """
    deps = dealt(a.where("i <> j").select("i", "j"), "deps", "j")
    levels = levels_of(deps, a.select("i").distinct())
    forget(deps)
    return levels


def levels_of(deps: DataFrame, rows: DataFrame) -> DataFrame:
    """``level_sets`` of rows(i) with the entries deps(i, j) off the diagonal, dealt by j.

    A row is reached anew each time a row that it depends on is; its level is the
    last turn. Dependencies lie in buckets, so a turn shuffles the rows reached alone.
    """
    if not triangular(deps):
        raise ValueError("entries on both sides of the diagonal")
    reached, depth = written(rows.withColumn("level", F.lit(0).cast("long")), "level"), 0
    turns = [reached]
    while True:
        depth += 1
        # all rows are reached by turn 0, of which what none depends on is no matter
        own = deps if depth == 1 else deps.join(reached.select(F.col("i").alias("j")).hint("shuffle_hash"), "j", "left_semi")
        step = own.select("i").distinct()
        reached = written(step.withColumn("level", F.lit(depth).cast("long")), "level")
        if reached.isEmpty():
            break
        turns.append(reached)
    levels = written(reduce(DataFrame.unionByName, turns).groupBy("i").agg(F.max("level").alias("level")), "levels")
    forget(reached, *turns)
    return levels


def level_graph(a: DataFrame, levels: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (i, level, n_in, n_out) of the first ``depth`` levels and the edges (src, dst) between them."""
    own = levels.where(F.col("level") < depth)
    src, dst = own.select(F.col("i").alias("src")), own.select(F.col("i").alias("dst"))
    edges = a.where("i <> j").select(F.col("j").alias("src"), F.col("i").alias("dst")).join(src, "src").join(dst, "dst").select("src", "dst")
    n_in, n_out = edges.groupBy(F.col("dst").alias("i")).agg(F.count("*").alias("n_in")), edges.groupBy(F.col("src").alias("i")).agg(F.count("*").alias("n_out"))
    nodes = own.join(n_in, "i", "left").join(n_out, "i", "left")
    return nodes.select("i", "level", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_in", "n_out")]), edges


def level_sizes(a: DataFrame, levels: DataFrame) -> DataFrame:
    """(level, n_rows, nnz, max_row) of each level."""
    rows = a.groupBy("i").agg(F.count("*").alias("n"))
    return levels.join(rows, "i").groupBy("level").agg(F.count("*").alias("n_rows"), F.sum("n").alias("nnz"), F.max("n").alias("max_row"))


def level_summary(levels: DataFrame) -> DataFrame:
    """One row: levels, rows, rows per level at least, at most and on average."""
    sizes = levels.groupBy("level").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("n_levels"), F.sum("n").alias("n_rows"), F.min("n").alias("least"), F.max("n").alias("most"), (F.sum("n") / F.count("*")).alias("parallelism"))


def level_order(levels: DataFrame, backward: bool = False) -> DataFrame:
    """(i, place): rows by level, then number; ``backward`` is the reverse of it.

    Ranks inside a level, levels by the sum of those before.
    """
    sizes = levels.groupBy("level").agg(F.count("*").alias("n"))
    base = prefix(sizes, "level", "n", "base").select("level", "base")
    rank = F.row_number().over(Window.partitionBy("level").orderBy("i")).cast("long")
    place = levels.withColumn("rank", rank).join(base, "level").select("i", (F.col("base") + F.col("rank") - 1).alias("place"))
    if not backward:
        return place
    # one row
    last = levels.agg((F.count("*") - 1).alias("last"))
    return place.crossJoin(F.broadcast(last)).select("i", (F.col("last") - F.col("place")).alias("place"))


def regrouped(groups: DataFrame, levels: DataFrame) -> DataFrame:
    """(g, place, first): groups(g, n_rows) of levels(g, level) by level, then number, and the row that each now starts at."""
    order = level_order(levels.withColumnRenamed("g", "i")).withColumnRenamed("i", "g")
    return prefix(groups.join(order, "g").select("g", "place", "n_rows"), "place", "n_rows", "first").select("g", "place", "first")
