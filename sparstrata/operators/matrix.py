"""Sparse matrices as tables (i, j, v): layout, products, reordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparstrata.functions.scan import prefix
from sparstrata.functions.storage import written

#: Numbers of long rows are broadcast up to so many (8 bytes each), beyond that joined by shuffle.
BROADCAST_ROWS = 1_000_000


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def lower_part(a: DataFrame, m: int, dominant: bool = True) -> DataFrame:
    """Entries below the diagonal and a diagonal in every row.

    ``dominant`` sets the diagonal to 1 + the row's number of entries.
    """
    below = a.where("j < i")
    counts = below.groupBy("i").agg((F.count("*") + 1).alias("n"))
    diagonal = a.sparkSession.range(m).select(F.col("id").alias("i")).join(counts, "i", "left")
    value = (F.coalesce("n", F.lit(1)) + 1).cast("double") if dominant else F.lit(1.0)
    return below.unionByName(diagonal.select("i", F.col("i").alias("j"), value.alias("v")))


def expand_symmetric(stored: DataFrame) -> DataFrame:
    """The stored triangle and its mirror image, the diagonal once."""
    return stored.unionByName(transpose(stored.where("i <> j")))


def row_counts(a: DataFrame) -> DataFrame:
    return a.groupBy("i").agg(F.count("*").alias("n"))


def row_pointers(a: DataFrame, m: int) -> DataFrame:
    """(i, ptr): entries before each row, empty rows included."""
    counts = a.sparkSession.range(m).select(F.col("id").alias("i")).join(row_counts(a), "i", "left").select("i", F.coalesce("n", F.lit(0)).alias("n"))
    return prefix(counts, "i", "n", "ptr").select("i", "ptr")


def multiply(a: DataFrame, x: DataFrame) -> DataFrame:
    """(i, y): the product with x(i, x). Partial sums make a long row one row per task."""
    right = x.select(F.col("i").alias("j"), "x")
    return a.join(right, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def multiply_split(a: DataFrame, x: DataFrame, longest: int, pieces: int = 16) -> DataFrame:
    """As ``multiply``, with rows over ``longest`` entries summed in pieces first.

    There are few such rows: their numbers are broadcast up to ``BROADCAST_ROWS``,
    so that no join sends a long row to one task.
    """
    long = written(long_rows(a, longest).select("i", F.lit(True).alias("long")), "long-rows")
    long = F.broadcast(long) if long.count() <= BROADCAST_ROWS else long
    piece = F.when(F.col("long"), F.pmod("j", F.lit(pieces))).otherwise(F.lit(0))
    marked = a.join(long, "i", "left").withColumn("piece", piece)
    part = marked.join(x.select(F.col("i").alias("j"), "x"), "j").groupBy("i", "piece").agg(F.sum(F.col("v") * F.col("x")).alias("y"))
    return part.groupBy("i").agg(F.sum("y").alias("y"))


def long_rows(a: DataFrame, longest: int) -> DataFrame:
    return row_counts(a).where(F.col("n") > longest)


def compact_rows(a: DataFrame) -> DataFrame:
    """(i, row): numbers of the non-empty rows."""
    rows = a.select("i").distinct().withColumn("one", F.lit(1).cast("long"))
    return prefix(rows, "i", "one", "row").select("i", "row")


def roots(a: DataFrame) -> DataFrame:
    """Rows that depend on no other."""
    rows = a.select("i").distinct()
    return rows.join(a.where("i <> j").select("i"), "i", "left_anti")


def edges(a: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct dependencies (src, dst) between groups(i, g) of rows."""
    source = groups.select(F.col("i").alias("j"), F.col("g").alias("src"))
    return a.where("i <> j").join(source, "j").join(groups.withColumnRenamed("g", "dst"), "i").where("src < dst").select("src", "dst").distinct()


def ends_of(a: DataFrame, of: DataFrame) -> DataFrame:
    """Entries with the groups g of their rows and h of their columns; ``of`` (i, g) is built in memory, a share of a shuffle at a time."""
    columns = of.select(F.col("i").alias("j"), F.col("g").alias("h"))
    return a.join(of.hint("shuffle_hash"), "i").join(columns.hint("shuffle_hash"), "j")


def checked_diagonal(a: DataFrame) -> DataFrame:
    """(i, d); raises where a row has no diagonal or a zero there."""
    found = a.groupBy("i").agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("v"))).alias("d"))
    bad = F.col("d").isNull() | (F.col("d") == 0)
    return found.select("i", F.when(bad, F.raise_error(F.concat(F.lit("no pivot in row "), F.col("i")))).otherwise(F.col("d")).alias("d"))


def permuted(a: DataFrame, order: DataFrame) -> DataFrame:
    """Rows and columns renumbered by order(i, place)."""
    rows = order.select("i", F.col("place").alias("row"))
    columns = order.select(F.col("i").alias("j"), F.col("place").alias("column"))
    return a.join(rows, "i").join(columns, "j").select(F.col("row").alias("i"), F.col("column").alias("j"), "v")


def permuted_axis(a: DataFrame, order: DataFrame, axis: str) -> DataFrame:
    """Rows (axis i) or columns (axis j) alone renumbered by order(i, place)."""
    if axis not in ("i", "j"):
        raise ValueError(f"no axis {axis}")
    own = order.select(F.col("i").alias(axis), F.col("place").alias("to"))
    return a.join(own, axis).withColumn(axis, F.col("to")).select("i", "j", "v")


def permuted_vector(x: DataFrame, order: DataFrame, back: bool = False) -> DataFrame:
    """A vector (i, x) in a new order(i, place), or with ``back`` from it to the old one."""
    to, at = ("i", "place") if back else ("place", "i")
    return x.withColumnRenamed("i", "from").join(order.select(F.col(at).alias("from"), F.col(to).alias("i")), "from").select("i", "x")


def subtracted(b: DataFrame, y: DataFrame) -> DataFrame:
    """(i, b): b less y(i, y), which counts as 0 where it has no row."""
    return b.join(y, "i", "left").select("i", (F.col("b") - F.coalesce("y", F.lit(0.0))).alias("b"))


def block(a: DataFrame, up: int, down: int, left: int, right: int) -> DataFrame:
    """The entries of rows [up, down) and columns [left, right), both renumbered from 0."""
    inside = (F.col("i") >= up) & (F.col("i") < down) & (F.col("j") >= left) & (F.col("j") < right)
    return a.where(inside).select((F.col("i") - up).alias("i"), (F.col("j") - left).alias("j"), "v")


def segment_sums(values: DataFrame) -> DataFrame:
    """(segment, v) of values(i, v, flag): a flag opens a segment at its place; values before the first one are segment 0."""
    flags = values.withColumn("flag", F.col("flag").cast("long"))
    placed = prefix(flags, "i", "flag", "before").withColumn("segment", F.col("before") + F.col("flag"))
    return placed.groupBy("segment").agg(F.sum("v").alias("v"))


def seeded_values(a: DataFrame, seed: int = 0) -> DataFrame:
    """All values replaced by numbers in [1, 2) that depend on place and seed alone."""
    share = F.pmod(F.xxhash64("i", "j", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    return a.select("i", "j", (1.0 + share).alias("v"))


def padded_rows(a: DataFrame, height: int) -> DataFrame:
    """(g, slot, lane, j, v): groups of ``height`` rows padded to their longest row, the diagonal in the last slot."""
    inner = Window.partitionBy("i").orderBy(F.expr("i = j"), "j")
    placed = a.withColumn("g", F.expr(f"i div {height}")).withColumn("at", F.row_number().over(inner).cast("long") - 1)
    sizes = placed.groupBy("g", "i").agg(F.count("*").alias("n"))
    widths = sizes.groupBy("g").agg(F.max("n").alias("width"))
    cells = sizes.join(widths, "g").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)))
    at = F.when(F.col("slot") == F.col("width") - 1, F.col("n") - 1).when(F.col("slot") < F.col("n") - 1, F.col("slot"))
    found = cells.withColumn("at", at).join(placed.select("i", "at", "j", "v"), ["i", "at"], "left")
    return found.select("g", "slot", (F.col("i") % height).alias("lane"), F.coalesce("j", F.lit(0)).alias("j"), F.coalesce("v", F.lit(0.0)).alias("v"))
