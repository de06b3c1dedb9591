"""Pieces of a matrix: connected rows, in groups of bounded size whose graph has no cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparstrata.functions.components import components_by_blocks
from sparstrata.functions.scan import prefix
from sparstrata.functions.storage import dealt, forget, written
from sparstrata.operators.counters import levels_by_groups, lifted_by_groups, solve_by_groups
from sparstrata.operators.levels import triangular

#: Rows of a piece at most.
MOST = 4096
#: Pieces of a component that may take a turn each; more are solved at once, and then their few rows that others need.
TURNS = 8


def pieces(a: DataFrame, most: int = MOST) -> DataFrame:
    """(i, g) of a triangular matrix: connected rows together, larger components cut every ``most`` rows in the order of rows.

    g is the first row of the piece. Rows before a cut do not depend on rows
    behind it (or the other way round), so a component's pieces form a chain at
    worst and a matrix of thin levels takes a turn for each piece, not for each level.
    """
    return _cut(a, most)[0]


def _cut(a: DataFrame, most: int) -> tuple[DataFrame, int]:
    """``pieces``, and how many the largest component has."""
    if not triangular(a):
        raise ValueError("entries on both sides of the diagonal")
    off = a.where("i <> j")
    roots = components_by_blocks(off.select(F.col("i").alias("a"), F.col("j").alias("b"))).withColumnRenamed("node", "i")
    rows = written(a.select("i").distinct().join(roots, "i", "left").select("i", F.coalesce("root", "i").alias("root"), F.lit(1).cast("long").alias("one")), "roots")
    ranked = prefix(rows, "i", "one", "rank", by=("root",)).select("i", "root", F.expr(f"rank div {most}").alias("cut"))
    ranked = written(ranked, "ranked")
    forget(rows)
    first = ranked.groupBy("root", "cut").agg(F.min("i").alias("g"))
    chain = ranked.agg(F.max("cut")).first()[0]
    return ranked.join(first, ["root", "cut"]).select("i", "g"), 0 if chain is None else chain + 1


def solve_fused(a: DataFrame, b: DataFrame, most: int = MOST) -> tuple[DataFrame, int]:
    """(i, x) of b(i, b) by pieces of connected rows, and the number of turns."""
    a = dealt(a, "entries", "i")
    own, chain = _cut(a, most)
    return solve_by_groups(a, b, own, (lambda rest, sides: solve_fused(rest, sides, most)) if chain > TURNS else None)


def levels_fused(a: DataFrame, most: int = MOST) -> tuple[DataFrame, int]:
    """(i, level) by pieces of connected rows, and the number of turns."""
    a = dealt(a, "entries", "i")
    own, chain = _cut(a, most)
    return levels_by_groups(a, own, (lambda rest, least: _lifted_fused(rest, least, most)) if chain > TURNS else None)


def _lifted_fused(a: DataFrame, least: DataFrame, most: int) -> tuple[DataFrame, int]:
    own, chain = _cut(a, most)
    x, turns = lifted_by_groups(a, least, own, (lambda rest, sides: _lifted_fused(rest, sides, most)) if chain > TURNS else None)
    return x.withColumnRenamed("level", "x"), turns
