"""Triangular systems: forward and backward, by levels, by series, by blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparstrata.functions.storage import dealt, forget, fresh_path, written
from sparstrata.operators.levels import level_sets, triangular
from sparstrata.operators.matrix import checked_diagonal, multiply, subtracted, transpose


def solve_many(a: DataFrame, b: DataFrame) -> DataFrame:
    """(r, i, x) of right-hand sides b(r, i, b): for each level one division and one push.

    Rows lie in a folder for each level and entries in one for each level of
    their column, so a turn reads what belongs to its level alone: it divides,
    writes its part of x, and pushes the products to the rows that wait for them,
    summed, into the folder of their level. Each entry is read once. The matrix is
    dealt by row first, unless it comes so, which spares the shuffles by row.
    """
    spark, given = a.sparkSession, a
    a = dealt(a, "entries", "i")
    levels = level_sets(a)
    root = fresh_path(spark, "solve")
    by_column = levels.select(F.col("i").alias("j"), F.col("level").alias("at"))
    rows = b.join(checked_diagonal(a), "i").join(levels, "i").select("r", "i", "b", "d", F.col("level").alias("at"))
    rows.repartition("at", "i").write.partitionBy("at").parquet(f"{root}/rows")
    # by row, then by column, where they stay: a task writes its part of each level
    entries = a.where("i <> j").join(levels.hint("shuffle_hash"), "i").select("i", "j", "v", F.col("level").alias("waits"))
    entries.join(by_column.hint("shuffle_hash"), "j").select("i", "j", "v", "at", "waits").write.partitionBy("at").parquet(f"{root}/entries")
    if a is not given:
        forget(a)
    depths = {r[0] for r in by_column.select("at").distinct().collect()}  # numbers of levels, one turn of the loop each
    columns = {r[0] for r in spark.read.parquet(f"{root}/entries").select("at").distinct().collect()} if len(depths) > 1 else set()
    for at in sorted(depths):
        own = spark.read.schema("r long, i long, b double, d double").parquet(f"{root}/rows/at={at}")
        if at:
            pushed = spark.read.schema("r long, i long, s double").parquet(f"{root}/pushed/waits={at}")
            own = own.join(pushed.groupBy("r", "i").agg(F.sum("s").alias("s")), ["r", "i"], "left").withColumn("b", F.col("b") - F.coalesce("s", F.lit(0.0)))
        own.select("r", "i", (F.col("b") / F.col("d")).alias("x")).write.parquet(f"{root}/x/at={at}")
        if at in columns:
            x = spark.read.schema("r long, i long, x double").parquet(f"{root}/x/at={at}").withColumnRenamed("i", "j")
            entry = spark.read.schema("i long, j long, v double, waits long").parquet(f"{root}/entries/at={at}")
            push = entry.join(x, "j").groupBy("r", "i", "waits").agg(F.sum(F.col("v") * F.col("x")).alias("s"))
            push.write.mode("append").partitionBy("waits").parquet(f"{root}/pushed")
    if not depths:
        return rows.select("r", "i", F.col("b").alias("x"))
    return spark.read.schema("r long, i long, x double").parquet(*[f"{root}/x/at={at}" for at in sorted(depths)])


def solve_levels(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, x) of one right-hand side b(i, b)."""
    return solve_many(a, b.select(F.lit(0).cast("long").alias("r"), "i", "b")).select("i", "x")


def solve_series(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, x) as the finite sum of powers of the strict part applied to b / d; general values may cancel badly."""
    if not triangular(a):
        raise ValueError("entries on both sides of the diagonal")
    diagonal = written(checked_diagonal(a), "diagonal")
    strict = written(a.where("i <> j"), "strict")
    term = written(b.join(diagonal, "i").select("i", (F.col("b") / F.col("d")).alias("x")), "term")
    terms = [term]
    while True:
        step = multiply(strict, term).join(diagonal, "i").select("i", (-F.col("y") / F.col("d")).alias("x"))
        term = written(step, "term")
        if term.isEmpty():
            break
        terms.append(term)
    return reduce(DataFrame.unionByName, terms).groupBy("i").agg(F.sum("x").alias("x"))


def solve_backward(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, x) of the transposed system."""
    return solve_levels(transpose(a), b)


def block_bounds(m: int, depth: int) -> list[tuple[int, str, int, int, int, int]]:
    """(block, kind, up, down, left, right) of recursive bisection in the order of solving; the last ones reach to m."""
    n = 1 << depth
    size = m // n
    cuts = [k * size for k in range(n)] + [m]
    blocks = []
    for k in range(n):
        blocks.append((2 * k, "triangle", cuts[k], cuts[k + 1], cuts[k], cuts[k + 1]))
        if k + 1 < n:
            width = (k + 1) & -(k + 1)  # rectangles grow with the size of the half that is done
            blocks.append((2 * k + 1, "rectangle", cuts[k + 1], cuts[k + 1 + width], cuts[k + 1 - width], cuts[k + 1]))
    return blocks


def block_depth(m: int, smallest: int) -> int:
    depth = 1
    while m // (1 << (depth + 1)) >= smallest:
        depth += 1
    return depth


def solve_blocks(a: DataFrame, b: DataFrame, m: int, depth: int) -> DataFrame:
    """(i, x): solve a diagonal block, take its product with the rectangle beside it off b, go on."""
    a, rest, parts = written(a, "blocks"), b, []
    for _, kind, up, down, left, right in block_bounds(m, depth):
        block = a.where(F.col("i").between(up, down - 1) & F.col("j").between(left, right - 1))
        if kind == "triangle":
            parts.append(solve_levels(block, rest.where(F.col("i").between(up, down - 1))))
        else:
            done = reduce(DataFrame.unionByName, parts)
            rest = written(subtracted(rest, multiply(block, done)), "rest")
    return reduce(DataFrame.unionByName, parts)


def solve_blocks_backward(a: DataFrame, b: DataFrame, m: int, depth: int) -> DataFrame:
    """(i, x) of an upper triangular system by blocks from the last to the first: the forward one with rows counted from the end."""
    turned = a.select((m - 1 - F.col("i")).alias("i"), (m - 1 - F.col("j")).alias("j"), "v")
    return solve_blocks(turned, b.select((m - 1 - F.col("i")).alias("i"), "b"), m, depth).select((m - 1 - F.col("i")).alias("i"), "x")


# Fixed values of the choice of methods.
MANY_LEVELS, WIDE_ROW, FEW_LEVELS, SOME_LEVELS = 20_000, 15, 20, 100
LONG_ROW, MEAN_ROW, EMPTY_SHORT, EMPTY_LONG = 2048, 12, 0.5, 0.15


def block_methods(a: DataFrame, bounds: DataFrame) -> DataFrame:
    """(block, kind, n_rows, nnz, n_levels, method) of bounds(block, kind, up, down, left, right).

    Triangles: 0 if diagonal, 1 with very many levels, 2 for short rows and few
    levels, else 3. Rectangles: by the mean entries of their rows, long ones
    aside, and by the share of empty rows. There are few blocks; they are broadcast.
    """
    inside = F.expr("i >= up and i < down and j >= left and j < right")
    return methods_of(written(a.join(F.broadcast(bounds), inside).select("block", "kind", "i", "j", "v"), "block-entries"), bounds)


def methods_of(held: DataFrame, bounds: DataFrame) -> DataFrame:
    """``block_methods`` of written entries held(block, kind, i, j, v)."""
    own = held.where("kind = 'triangle'")
    depth = level_sets(own).join(own.select("block", "i").distinct(), "i").groupBy("block").agg((F.max("level") + 1).alias("n_levels"))
    rows = held.groupBy("block", "i").agg(F.count("*").alias("n"))
    short = F.when(F.col("n") <= LONG_ROW, F.col("n"))
    sizes = rows.groupBy("block").agg(F.count("*").alias("full"), F.sum("n").alias("nnz"), F.sum(short).alias("short"))
    table = bounds.join(sizes, "block", "left").join(depth, "block", "left")
    table = table.select("block", "kind", (F.col("down") - F.col("up")).alias("n_rows"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("full", "nnz", "short", "n_levels")])
    n, levels = F.expr("nnz div n_rows"), F.col("n_levels")
    triangle = (
        F.when(F.col("nnz") == F.col("n_rows"), 0)
        .when(levels > MANY_LEVELS, 1)
        .when(((n <= WIDE_ROW) & (levels <= FEW_LEVELS)) | ((n == 1) & (levels <= SOME_LEVELS)), 2)
        .otherwise(3)
    )
    mean, empty = F.expr("short div n_rows"), 1 - F.col("full") / F.col("n_rows")
    rectangle = F.when(mean <= MEAN_ROW, F.when(empty <= EMPTY_SHORT, 0).otherwise(1)).otherwise(F.when(empty <= EMPTY_LONG, 2).otherwise(3))
    return table.select("block", "kind", "n_rows", "nnz", "n_levels", F.when(F.col("kind") == "triangle", triangle).otherwise(rectangle).alias("method"))


def known_solution(a: DataFrame, m: int, sides: int) -> tuple[DataFrame, DataFrame]:
    """x(r, i, x) of whole numbers from 1 to 10, and b(r, i, b) = a x."""
    spark = a.sparkSession
    x = spark.range(m * sides).select(F.expr(f"id div {m}").alias("r"), (F.col("id") % m).alias("i"))
    value = lambda i, r: (F.pmod(i * 7 + r * 3, F.lit(10)) + 1).cast("double")
    x = x.withColumn("x", value(F.col("i"), F.col("r")))
    # a column's x follows from its number, so no join by column; all sides of a row are summed at once
    sums = a.groupBy("i").agg(*[F.sum(F.col("v") * value(F.col("j"), F.lit(r))).alias(f"b{r}") for r in range(sides)])
    each = F.explode(F.array(*[F.struct(F.lit(r).cast("long").alias("r"), F.col(f"b{r}").alias("b")) for r in range(sides)]))
    return x, sums.select("i", each.alias("s")).select("s.r", "i", "s.b")


def relative_error(x: DataFrame, known: DataFrame) -> DataFrame:
    """(r, max_error, rel_l1): each solution against the known one."""
    both = known.withColumnRenamed("x", "k").join(x, ["r", "i"], "left").select("r", "k", F.abs(F.col("k") - F.coalesce("x", F.lit(0.0))).alias("e"))
    return both.groupBy("r").agg(F.max("e").alias("max_error"), (F.sum("e") / F.sum(F.abs("k"))).alias("rel_l1"))


def residual(a: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the largest |b - a x|, where it is, and the relative error of sums."""
    diff = b.join(multiply(a, x), "i", "left").select("i", F.abs(F.col("b") - F.coalesce("y", F.lit(0.0))).alias("e"), F.abs("b").alias("size"))
    return diff.agg(F.max("e").alias("max_error"), F.max_by("i", F.struct("e", -F.col("i"))).alias("at"), (F.sum("e") / F.sum("size")).alias("rel_l1"))
