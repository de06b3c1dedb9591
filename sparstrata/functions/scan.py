"""Prefix sums and maxima over all rows of a table, without a window or a join by order that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def prefix(rows: DataFrame, key: str, value: str, name: str, how: str = "sum", by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``name``: the sum (0 for none) or maximum (null for none) of ``value`` over rows with a smaller ``key``.

    With ``by`` only over rows that are equal in these columns, of which none is
    null. Keys are distinct (for each ``by``), not null and not negative. Blocks
    of keys are scanned by themselves; their totals are scanned in the same way, in
    blocks of blocks, and joined back by block.
    """
    top = rows.agg(F.max(key)).first()[0]
    if top is not None and top < 0:
        raise ValueError(f"{key} is negative")
    return _prefix(rows, key, value, name, how, 0 if top is None else int(top), by)


def _prefix(rows: DataFrame, key: str, value: str, name: str, how: str, top: int, by: tuple[str, ...], depth: int = 0) -> DataFrame:
    whole = {"sum": F.sum, "max": F.max}[how]
    block, local, total, base = (f"_{x}{depth}" for x in ("block", "local", "total", "base"))
    blocked = rows.withColumn(block, F.expr(f"`{key}` div {BLOCK}"))
    inside = Window.partitionBy(*by, block).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    placed = blocked.withColumn(local, whole(value).over(inside))
    found = F.col(local)
    if top >= BLOCK:
        totals = blocked.groupBy(*by, block).agg(whole(value).alias(total))
        before = _prefix(totals, block, total, base, how, top // BLOCK, by, depth + 1).select(*by, block, base)
        placed = placed.join(before, [*by, block])
        found = F.coalesce(base, F.lit(0)) + F.coalesce(local, F.lit(0)) if how == "sum" else F.greatest(base, local)
    return placed.withColumn(name, F.coalesce(found, F.lit(0)) if how == "sum" else found).drop(block, local, base)
