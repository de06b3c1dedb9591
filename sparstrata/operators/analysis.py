"""One entry: a plan's groups and levels, and a solution by them with its check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparstrata.functions.storage import dealt, forget, written
from sparstrata.operators import counters, groups, levels, matrix, solve

#: Rows of a part at least, where groups are not kept apart by level; a part ends with a group.
PART = 4096


@dataclass(frozen=True)
class Plan:
    """How to group rows, whether levels of groups are kept apart, and whether the system is reordered by level before it is solved."""

    strategy: str = "ROW_BLOCK_THRESH"
    alpha: int = 4
    by_level: bool = True
    reorder: bool = False


def analyse(a: DataFrame, plan: Plan) -> DataFrame:
    """(g, n_rows, nnz, level, flags, part): the groups of a plan; all are one part if levels are not kept apart."""
    entries = dealt(a.select("i", "j"), "entries", "i")
    table = groups.group_table(entries, groups.grouped(entries, plan.strategy, plan.alpha))
    forget(entries)
    return table.withColumn("part", F.col("level") if plan.by_level else F.lit(0).cast("long"))


def planned_groups(a: DataFrame, plan: Plan) -> DataFrame | Callable[[str], Column]:
    """(i, g): rows that are substituted at once: a plan's groups, or without levels whole groups of neighbouring rows up to ``PART`` rows.

    Groups that a row's number tells are a function of it (``counters``).
    """
    if plan.strategy == "ROW_BLOCK":
        part = "" if plan.by_level else f" div {PART}"
        return lambda column: F.expr(f"({groups.block_of(plan.alpha, column)}){part}")
    own = groups.grouped(a, plan.strategy, plan.alpha).select("i", "g")
    return own if plan.by_level else own.withColumn("g", F.expr(f"g div {PART}"))


def solve_planned(a: DataFrame | counters.Held, b: DataFrame, plan: Plan) -> tuple[DataFrame, int]:
    """(i, x) by the plan's groups, and the turns that it took: the levels of the graph of groups."""
    a = counters.held(a)
    if not a.triangular:
        raise ValueError("entries on both sides of the diagonal")
    if not plan.reorder:
        return counters.solve_by_groups(a, b, planned_groups(a.rows, plan))
    order = written(levels.level_order(levels.level_sets(a.rows)), "order")
    turned = counters.Held(matrix.permuted(a.rows, order))
    side = matrix.permuted_vector(b.withColumnRenamed("b", "x"), order).withColumnRenamed("x", "b")
    x, turns = counters.solve_by_groups(turned, side, planned_groups(turned.rows, plan))
    return matrix.permuted_vector(x, order, back=True), turns


def solve_and_verify(a: DataFrame, b: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """The solution (i, x) by the plan, and one row of its largest error, where that is, and the relative error."""
    a = counters.held(a)
    x, _ = solve_planned(a, b, plan)
    return x, solve.residual(a.columns, x.hint("shuffle_hash"), b)
