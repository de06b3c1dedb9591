"""A matrix kept as recursive blocks, and a solve that picks a method for each of them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparstrata.functions.storage import fresh_path
from sparstrata.operators import groups, matrix
from sparstrata.operators.counters import solve_by_counters, solve_by_groups
from sparstrata.operators.pieces import MOST, solve_fused
from sparstrata.operators.solve import LONG_ROW, block_bounds, block_depth, methods_of

#: Blocks are halved until a triangle has fewer rows than twice this.
SMALLEST = 1 << 20
BOUNDS = "block long, kind string, up long, down long, left long, right long"


@dataclass(frozen=True)
class BlockStore:
    """Entries in a folder for each block, the blocks' bounds in the order of solving, and the method of each."""

    spark: SparkSession
    path: str
    bounds: list[tuple[int, str, int, int, int, int]]
    methods: dict[int, int]
    nnz: dict[int, int]

    def entries(self, block: int) -> DataFrame:
        return self.spark.read.schema("i long, j long, v double").parquet(f"{self.path}/block={block}")


def store_blocks(a: DataFrame, m: int, depth: int | None = None) -> BlockStore:
    """Write each entry of a lower triangular matrix of m rows once, into its block.

    The table of bounds is short (fewer than 2 ** (depth + 1) rows) and is
    broadcast; nothing is shuffled. Methods come from counts of the written blocks.
    """
    spark, path = a.sparkSession, fresh_path(a.sparkSession, "blocks")
    bounds = block_bounds(m, block_depth(m, SMALLEST) if depth is None else depth)
    table = spark.createDataFrame(bounds, BOUNDS)
    inside = F.expr("i >= up and i < down and j >= left and j < right")
    a.join(F.broadcast(table), inside).select("i", "j", "v", "block", "kind").write.partitionBy("block").parquet(path)
    held = spark.read.schema("i long, j long, v double, kind string, block long").parquet(path)
    rows = methods_of(held, table).collect()  # a row for each block
    return BlockStore(spark, path, bounds, {r["block"]: r["method"] for r in rows}, {r["block"]: r["nnz"] for r in rows})


def _triangle(a: DataFrame, b: DataFrame, method: int) -> DataFrame:
    """(i, x): 0 divides, 1 substitutes connected pieces, 2 counts row by row, 3 counts by groups of neighbouring rows."""
    if method == 0:
        return b.join(matrix.checked_diagonal(a), "i").select("i", (F.col("b") / F.col("d")).alias("x"))
    if method == 1:
        return solve_fused(a, b)[0]
    if method == 2:
        return solve_by_counters(a, b)
    return solve_by_groups(a, b, groups.by_block(matrix.row_counts(a), MOST))[0]


def _rectangle(a: DataFrame, x: DataFrame, method: int) -> DataFrame:
    """(i, y): 1 and 3, for many empty rows, send only the x that some row needs; 2 and 3, for long rows, sum these in parts first."""
    if method in (1, 3):
        x = x.join(a.select(F.col("j").alias("i")).distinct(), "i", "left_semi")
    return matrix.multiply_split(a, x, LONG_ROW) if method in (2, 3) else matrix.multiply(a, x)


def solve_store(store: BlockStore, b: DataFrame) -> DataFrame:
    """(i, x) of b(i, b): each block is read once, by its own method, in the order of the bounds.

    Right-hand sides lie in a folder for each triangle; a rectangle adds its
    product, negative, to the folders of the rows it covers.
    """
    spark, root = store.spark, fresh_path(store.spark, "block-solve")
    triangles = [(block, up, down) for block, kind, up, down, _, _ in store.bounds if kind == "triangle"]
    leaves = F.broadcast(spark.createDataFrame(triangles, "leaf long, up long, down long"))
    keep = lambda rows: rows.join(leaves, F.expr("i >= up and i < down")).select("i", "b", "leaf").write.mode("append").partitionBy("leaf").parquet(f"{root}/b")
    keep(b)
    solved = lambda leaf: spark.read.schema("i long, x double").parquet(f"{root}/x/leaf={leaf}")
    for block, kind, _, _, left, right in store.bounds:
        if kind == "triangle":
            own = spark.read.schema("i long, b double").parquet(f"{root}/b/leaf={block}").groupBy("i").agg(F.sum("b").alias("b"))
            _triangle(store.entries(block), own, store.methods[block]).write.parquet(f"{root}/x/leaf={block}")
        elif store.nnz[block]:
            known = reduce(DataFrame.unionByName, [solved(leaf) for leaf, up, _ in triangles if left <= up < right])
            keep(_rectangle(store.entries(block), known, store.methods[block]).select("i", (-F.col("y")).alias("b")))
    return reduce(DataFrame.unionByName, [solved(leaf) for leaf, _, _ in triangles])


def solve_blocks_by_method(a: DataFrame, b: DataFrame, m: int, depth: int | None = None) -> DataFrame:
    """(i, x) of a lower triangular system of m rows, without empty triangles, through a block store."""
    return solve_store(store_blocks(a, m, depth), b)
