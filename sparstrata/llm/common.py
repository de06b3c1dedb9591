"""What the operators of this subpackage share: ids that pass through Python and component labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.storage import forget, fresh_path
from ..functions.storage import written as saved

__all__ = ["carried", "components", "forget", "fresh_path", "ranked", "restored", "saved", "small", "text_of", "with_groups"]


def small(table: DataFrame, rows: int) -> DataFrame:
    """A saved table, marked for broadcast if it has no more than so many rows; a join shuffles it otherwise."""
    return F.broadcast(table) if table.count() <= rows else table


#: Groups that are broadcast whole; of more, those with more than one in ``HOT`` of all rows are, which are fewer than ``HOT``.
FEW, HOT = 500_000, 100_000


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, salt: Column) -> DataFrame:
    """``rows`` left-joined by ``keys`` with a saved table of groups, one row a key, of ``size`` rows each.

    Few groups are broadcast and no row is shuffled. Of many groups only the hot
    ones are, and their rows, spread by ``salt``, meet no other group in the
    shuffle that joins the rest; so no task gets a hot group.
    """
    if groups.count() <= FEW:
        return rows.join(F.broadcast(groups), keys, "left")
    values = [c for c in groups.columns if c not in keys]
    # rows that are in no group only add to the true total, so more groups count as hot, still fewer than HOT
    least = groups.agg(F.sum(size)).first()[0] // HOT
    hot = groups.where(F.col(size) > least).select(*keys, F.struct(*values).alias("_hot"))
    rest = groups.where(F.col(size) <= least).select(*keys, F.lit(0).cast("long").alias("_salt"), F.struct(*values).alias("_rest"))
    spread = F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(salt), F.lit(100_000)) + 1)
    found = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", spread).join(rest, [*keys, "_salt"], "left")
    return found.select(*rows.columns, *[F.coalesce(F.col("_hot")[c], F.col("_rest")[c]).alias(c) for c in values])


def text_of(column: str):
    """The column as a string, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def carried(id_col: str) -> Column:
    """An id as a string, the form in which it passes through pandas: there whole numbers beside nulls become doubles."""
    return F.col(f"`{id_col}`").cast("string")


def restored(column: str, kind: T.DataType) -> Column:
    """A carried id in its own type."""
    return F.col(f"`{column}`").cast(kind)


def ranked(id_col: str, kind: T.DataType) -> Column:
    """An id that keeps its order through pandas: null as the smallest of its type, with which it ties."""
    least = {T.ByteType: -(1 << 7), T.ShortType: -(1 << 15), T.IntegerType: -(1 << 31), T.LongType: -(1 << 63)}.get(type(kind))
    return F.col(f"`{id_col}`") if least is None else F.coalesce(F.col(f"`{id_col}`"), F.lit(least).cast(kind))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows (node, root), root the smallest node.

    Each round hooks a node to its smallest smaller neighbour, shortens the
    resulting trees by pointer jumping and relabels the edges; edges inside a
    component vanish. Only aggregates and joins on node keys, each written, so
    no component is gathered in one task. Nodes without edges do not appear.
    """
    live = saved(
        edges.where("a <> b")
        .select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        .distinct(),
        "edges",
    )
    labels = None
    while not live.isEmpty():
        tree = saved(live.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")), "hooks")
        while True:
            up = tree.select(F.col("node").alias("root"), F.col("root").alias("above"))
            joined = tree.join(up, "root", "left")
            past, tree = tree, saved(
                joined.select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")),
                "jumps",
            )
            forget(past)
            still = not tree.where("moved").isEmpty()
            tree = tree.drop("moved")
            if not still:
                break
        if labels is None:
            labels = tree
        else:
            higher = tree.select(F.col("node").alias("root"), F.col("root").alias("above"))
            before = labels
            labels = labels.join(higher, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            labels = saved(labels.unionByName(tree.join(labels, "node", "left_anti")), "labels")
            forget(before)
        lo = tree.select(F.col("node").alias("lo"), F.col("root").alias("lo_root"))
        hi = tree.select(F.col("node").alias("hi"), F.col("root").alias("hi_root"))
        ends = live.join(lo, "lo", "left").join(hi, "hi", "left").select(
            F.coalesce("lo_root", "lo").alias("a"), F.coalesce("hi_root", "hi").alias("b")
        )
        past, live = live, saved(
            ends.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(),
            "edges",
        )
        forget(past)
    if labels is None:
        return live.select(F.col("lo").alias("node"), F.col("hi").alias("root"))
    return labels
