"""Connected components of a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import forget, written

#: Nodes of a block have equal numbers but for so many last bits; edges that a task takes at a time.
BITS, HELD = 14, 200_000


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows (node, root), root the smallest node.

    Each round hooks a node to its smallest smaller neighbour, shortens the
    resulting trees by pointer jumping and relabels the edges; edges inside a
    component vanish. Only aggregates and joins on node keys, each written, so
    no component is gathered in one task. Nodes without edges do not appear.
    """
    live = written(
        edges.where("a <> b")
        .select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        .distinct(),
        "edges",
    )
    labels = None
    while not live.isEmpty():
        tree = written(live.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")), "hooks")
        while True:
            up = tree.select(F.col("node").alias("root"), F.col("root").alias("above"))
            joined = tree.join(up, "root", "left")
            past, tree = tree, written(
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
            labels = written(labels.unionByName(tree.join(labels, "node", "left_anti")), "labels")
            forget(before)
        lo = tree.select(F.col("node").alias("lo"), F.col("root").alias("lo_root"))
        hi = tree.select(F.col("node").alias("hi"), F.col("root").alias("hi_root"))
        ends = live.join(lo, "lo", "left").join(hi, "hi", "left").select(
            F.coalesce("lo_root", "lo").alias("a"), F.coalesce("hi_root", "hi").alias("b")
        )
        past, live = live, written(
            ends.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(),
            "edges",
        )
        forget(past)
    if labels is None:
        return live.select(F.col("lo").alias("node"), F.col("hi").alias("root"))
    return labels


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, root of each) of edges (a, b), the root being the smallest node of a component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(u):
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        apart = low != high
        u, v = u[apart], v[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root != (further := root[root])).any():
            root = further
    return nodes, nodes[root]


def _inside_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root, leaves) of batches (block, a, b), sorted by block, with a = b where an edge leaves the block.

    Of a block that goes on in the next batch its nodes and their roots are kept, not its edges.
    """

    def trees(held: list) -> tuple:
        block, a, b = (np.concatenate(c) for c in zip(*held))
        nodes, roots = _joined(a, b)
        leaves = np.zeros(len(nodes), bool)
        leaves[np.searchsorted(nodes, a[a == b])] = True
        return block[-1], nodes, roots, leaves

    def rows(nodes, roots, leaves) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots), pa.array(leaves)], ["node", "root", "leaves"])

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy() for c in batch.columns])
        size += batch.num_rows
        if size < HELD:
            continue
        last, nodes, roots, leaves = trees(held)
        on = nodes >> BITS == last
        yield rows(nodes[~on], roots[~on], leaves[~on])
        own, marked = nodes[on], nodes[on & leaves]
        tree = on & (roots != nodes)
        held = [[np.full(n, last), x, y] for n, x, y in ((tree.sum(), nodes[tree], roots[tree]), (len(marked), marked, marked))]
        size = 0
    if held:
        yield rows(*trees(held)[1:])


def components_by_blocks(edges: DataFrame) -> DataFrame:
    """``components`` of nodes of which near ones are joined more often than far ones; roots appear too.

    Nodes of a block are joined inside a task. What is left are the edges between
    blocks, whose ends are the roots of their trees: with long chains of near nodes
    there are few, and few turns are needed for them.
    """
    block = lambda c: F.shiftright(c, BITS)
    row = lambda c, a, b: F.struct(block(c).alias("block"), a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    apart = edges.where("a <> b").select(a.cast("long").alias("a"), b.cast("long").alias("b"))
    parts = F.when(block(a) == block(b), F.array(row(a, a, b))).otherwise(F.array(row(a, a, a), row(b, b, b)))
    dealt_out = apart.select(F.explode(parts).alias("e")).select("e.*").repartition("block").sortWithinPartitions("block")
    trees = written(dealt_out.mapInArrow(_inside_blocks, "node long, root long, leaves boolean"), "trees")
    ends = trees.where("leaves and node <> root")
    end = lambda c: ends.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    between = apart.where(block(a) != block(b)).join(end("a"), "a", "left").join(end("b"), "b", "left")
    rest = components(between.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")))
    return trees.join(rest.select(F.col("node").alias("root"), F.col("root").alias("first")), "root", "left").select("node", F.coalesce("first", "root").alias("root"))
