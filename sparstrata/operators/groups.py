"""Row groups: blocks, thresholds, averages; their levels and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparstrata.functions.scan import BLOCK, prefix
from sparstrata.functions.storage import dealt, forget, written
from sparstrata.operators.levels import levels_of
from sparstrata.operators.matrix import ends_of, row_counts

CAP = 32
BUFFER = 8


def by_block(rows: DataFrame, alpha: int) -> DataFrame:
    """(i, n, g): ``alpha`` neighbouring rows each; g is the group's first row."""
    return rows.select("i", "n", F.expr(block_of(alpha, "i")).alias("g"))


def block_of(alpha: int, column: str) -> str:
    """SQL of the group of ``by_block`` of a column of rows."""
    return f"({column} div {alpha}) * {alpha}"


def by_threshold(rows: DataFrame, alpha: int, cap: int = CAP) -> DataFrame:
    """Rows over ``alpha`` entries stay alone; runs of others are cut every ``cap`` rows from the run's start.

    A run's start is the place after the last long row, a running maximum.
    """
    long = F.when(F.col("n") > alpha, F.col("i") + 1)
    start = F.coalesce("last", F.lit(0))
    cut = start + F.floor((F.col("i") - start) / cap) * cap
    placed = prefix(rows.withColumn("after", long), "i", "after", "last", "max")
    return placed.select("i", "n", F.when(F.col("n") > alpha, F.col("i")).otherwise(cut).alias("g"))


def _chained(rows: DataFrame, following: DataFrame) -> DataFrame:
    """(i, n, g): groups that start at row 0 and, from each start s of following(s, next), at the next.

    Starts are found by pointer doubling: a turn joins the starts known with jumps
    over twice as many groups, so the turns are the logarithm of the groups.
    """
    jumps = written(following, "jumps")
    starts = written(jumps.where("s = 0").select("s"), "starts")
    known = -1
    while known < (known := starts.count()):
        ahead = starts.join(jumps, "s").where("next is not null").select(F.col("next").alias("s"))
        past_starts, starts = starts, written(starts.unionByName(ahead).distinct(), "starts")
        twice = jumps.join(jumps.select(F.col("s").alias("next"), F.col("next").alias("later")), "next", "left")
        past_jumps, jumps = jumps, written(twice.select("s", F.col("later").alias("next")), "jumps")
        forget(past_starts, past_jumps)
    marked = rows.join(starts.select(F.col("s").alias("i"), F.col("s").alias("start")), "i", "left")
    carried = prefix(marked, "i", "start", "before", "max")
    return carried.select("i", "n", F.coalesce("start", "before").alias("g"))


def by_independence(a: DataFrame, rows: DataFrame, alpha: int) -> DataFrame:
    """(i, n, g): a group goes on while no row depends on another of it and it has fewer than ``alpha`` rows.

    Rows are numbered from 0 without gaps.
    """
    nearest = a.where("j < i").groupBy("i").agg(F.max("j").alias("p"))
    # the first row within reach of s that depends on s or a later one, or the row after the longest group
    near = rows.select("i").join(nearest, "i", "left").where("p is not null and i - p < " + str(alpha))
    cut = near.select(F.col("i"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("i") - alpha + 1), F.col("p"))).alias("s")).groupBy("s").agg(F.min("i").alias("stop"))
    ends = rows.select(F.col("i").alias("s")).join(cut, "s", "left").withColumn("next", F.coalesce("stop", F.col("s") + alpha))
    last = rows.select(F.col("i").alias("next"), F.lit(True).alias("there"))
    following = ends.join(last, "next", "left").select("s", F.when(F.col("there"), F.col("next")).alias("next"))
    return _chained(rows, following)


def by_pattern(a: DataFrame, rows: DataFrame, cap: int = CAP) -> DataFrame:
    """(i, n, g): a group goes on while a row has the dependencies of its first row outside the group, and has fewer than ``cap`` rows.

    Patterns are compared by length and two sums of hashes of their columns
    before each possible start. Rows are numbered from 0 without gaps. A row travels
    once: what it depends on before all its possible starts is summed, the few
    columns behind the first of them go with it, and starts look at the rows that
    follow them inside a block, which also has the first rows of the next block.
    """
    mark = lambda salt: F.shiftright(F.xxhash64("j", F.lit(salt)), 24)
    far, column = F.col("j") < F.col("i") - cap + 1, F.struct("j", mark(1).alias("x"), mark(2).alias("y"))
    whole = lambda value, name: F.sum(F.when(far, value).otherwise(F.lit(0))).cast("long").alias(name)
    seen = a.where("j < i").groupBy("i").agg(whole(F.lit(1), "n0"), whole(mark(1), "x0"), whole(mark(2), "y0"), F.collect_list(F.when(~far, column)).alias("near"))
    none = F.array().cast("array<struct<j:bigint,x:bigint,y:bigint>>")
    zero = F.lit(0).cast("long")
    row = rows.select("i").join(seen, "i", "left").select("i", *[F.coalesce(c, zero).alias(c) for c in ("n0", "x0", "y0")], F.coalesce("near", none).alias("near"))
    own, before = F.expr(f"i div {BLOCK}"), F.expr(f"(i - {cap - 1}) div {BLOCK}")
    blocks = F.when((F.col("i") >= cap - 1) & (before < own), F.array(own, before)).when((F.col("i") < cap - 1) | (before == own), F.array(own))
    placed = row.withColumn("block", F.explode(blocks))
    behind = Window.partitionBy("block").orderBy("i").rowsBetween(1, max(1, cap - 1))
    ahead = placed.withColumn("ahead", F.collect_list(F.struct("i", "n0", "x0", "y0", "near")).over(behind)).where(own == F.col("block"))

    def pattern(r, s):
        """What row r depends on before s."""
        held = F.filter(r["near"], lambda e: e["j"] < s)
        total = lambda c: r[c + "0"] + F.aggregate(held, zero, lambda t, e: t + e[c])
        return F.struct((r["n0"] + F.size(held)).alias("n"), total("x").alias("x"), total("y").alias("y"))

    s = F.col("i")
    other = F.filter("ahead", lambda r: (r["i"] < s + cap) & (pattern(r, s) != pattern({c: F.col(c) for c in ("n0", "x0", "y0", "near")}, s)))
    ends = ahead.select(s.alias("s"), F.coalesce(F.array_min(F.transform(other, lambda r: r["i"])), s + cap).alias("next"))
    last = rows.select(F.col("i").alias("next"), F.lit(True).alias("there"))
    return _chained(rows, ends.join(last, "next", "left").select("s", F.when(F.col("there"), F.col("next")).alias("next")))


def by_average(rows: DataFrame, alpha: int, cap: int = CAP) -> DataFrame:
    """``cap`` rows are one group if their whole average of entries is under ``alpha``, else each is its own."""
    block = (F.expr(f"i div {cap}") * cap).alias("block")
    totals = rows.groupBy(block).agg(F.sum("n").alias("nnz"), F.count("*").alias("rows"))
    joined = rows.withColumn("block", block).join(totals, "block")
    return joined.select("i", "n", F.when(F.expr("nnz div rows") < alpha, F.col("block")).otherwise(F.col("i")).alias("g"))


#: Each takes a matrix, the entries of its rows(i, n), and a threshold.
STRATEGIES = {
    "ROW_BLOCK": lambda a, rows, alpha: by_block(rows, alpha),
    "ROW_BLOCK_THRESH": lambda a, rows, alpha: by_threshold(rows, alpha),
    "ROW_BLOCK_AVG": lambda a, rows, alpha: by_average(rows, alpha),
    "ROW_BLOCK_NODEP": by_independence,
    "SUPERNODE_BLOCK": lambda a, rows, alpha: by_pattern(a, rows),
}


def grouped(a: DataFrame, strategy: str, alpha: int) -> DataFrame:
    """(i, n, g) by one of the strategies; others are not implemented."""
    if strategy not in STRATEGIES:
        raise NotImplementedError(f"row grouping {strategy}")
    return STRATEGIES[strategy](a, written(row_counts(a), "rows"), alpha)


def group_table(a: DataFrame, groups: DataFrame, lanes: int = 1) -> DataFrame:
    """(g, n_rows, nnz, level, flags) of each group.

    Levels follow dependencies between groups. Flag 1: rows depend on each
    other or are 8 or more; flag 2: entries beyond the buffer; flag 256: no row
    depends on another of the group.
    """
    groups = dealt(groups.select("i", "n", "g"), "groups", "i")
    of = groups.select("i", "g")
    ends = dealt(ends_of(a.where("i <> j").select("i", "j"), of).select(F.col("g").alias("i"), F.col("h").alias("j")), "ends", "j")
    inner = written(ends.where("i = j").select(F.col("i").alias("g")).distinct().withColumn("inner", F.lit(True)), "inner")
    sizes = written(groups.groupBy("g").agg(F.count("*").alias("n_rows"), F.sum("n").alias("nnz")), "sizes")
    levels = levels_of(ends.where("j < i"), sizes.select(F.col("g").alias("i"))).withColumnRenamed("i", "g")
    forget(groups, ends)
    joined = sizes.join(levels, "g").join(inner, "g", "left")
    depends = F.coalesce("inner", F.lit(False))
    flags = (
        F.when(depends | (F.col("n_rows") >= 8), 1).otherwise(0)
        + F.when(F.col("nnz") > BUFFER * 32 // lanes, 2).otherwise(0)
        + F.when(~depends, 256).otherwise(0)
    )
    return joined.select("g", "n_rows", "nnz", "level", flags.cast("long").alias("flags"))
