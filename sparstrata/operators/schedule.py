"""Packs, workers and launches of row groups."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparstrata.functions.scan import prefix

UNITS = 80
WARP = 32


def packs(groups: DataFrame, lanes: int, by_level: bool = True, balanced: bool = False) -> DataFrame:
    """(g, part, pack, lane, nnz): groups of a partition, in row order or heaviest first, ``lanes`` to a pack."""
    part = F.col("level") if by_level else F.lit(0).cast("long")
    order = [F.desc("nnz"), F.col("g")] if balanced else [F.col("g")]
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("long") - 1
    ranked = groups.withColumn("part", part).withColumn("rank", rank)
    return ranked.select("g", "part", F.floor(F.col("rank") / lanes).alias("pack"), (F.col("rank") % lanes).alias("lane"), "nnz")


def ordinals(packed: DataFrame) -> DataFrame:
    """(part, pack, ordinal, load): packs numbered over all partitions, partition after partition."""
    each = packed.groupBy("part", "pack").agg(F.sum("nnz").alias("load"), F.min("g").alias("first"))
    before = prefix(each.groupBy("part").agg(F.count("*").alias("n")), "part", "n", "base").select("part", "base")
    return each.join(before, "part").select("part", "pack", (F.col("base") + F.col("pack")).alias("ordinal"), "load", "first")


def round_robin(numbered: DataFrame, workers: int) -> DataFrame:
    return numbered.select("part", "pack", "ordinal", "load", (F.col("ordinal") % workers).alias("worker"))


def interleaved(numbered: DataFrame, workers: int, stride: int = 4) -> DataFrame:
    """Workers in strides: 0, 4, 8 ... and then the next offset."""
    at = F.col("ordinal") % workers
    per = workers // stride
    return numbered.select("ordinal", ((at % per) * stride + F.floor(at / per)).alias("worker"))


def least_loaded(numbered: DataFrame, workers: int) -> DataFrame:
    """(part, pack, ordinal, load, worker): each pack in turn to the worker with the least load, the first of equals.

    A decision depends on all before it, so packs of one partition (a level) are
    dealt in one task, which bounds a task by a level; loads start anew at each.
    """

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        heap = [(0, w) for w in range(workers)]
        pdf = pdf.sort_values("ordinal")
        chosen = []
        for load in pdf["load"].tolist():
            held, w = heap[0]
            chosen.append(w)
            heapq.heapreplace(heap, (held + load, w))
        return pdf.assign(worker=chosen)[["part", "pack", "ordinal", "load", "worker"]]

    return numbered.groupBy("part").applyInPandas(deal, "part long, pack long, ordinal long, load long, worker long")


def imbalance(assigned: DataFrame) -> DataFrame:
    loads = assigned.groupBy("worker").agg(F.sum("load").alias("load"))
    return loads.agg(F.count("*").alias("n_workers"), F.min("load").alias("least"), F.max("load").alias("most"))


def launches(numbered: DataFrame, kind: str, threshold: int = UNITS) -> DataFrame:
    """(part, n_packs, launch): which partitions run together.

    INDEP_LEVEL: each alone. ONE_LEVEL: all. THRESH_LEVEL: a launch ends with
    each partition of ``threshold`` packs or more.
    """
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n_packs"))
    if kind == "ONE_LEVEL":
        return sizes.withColumn("launch", F.lit(0).cast("long"))
    if kind == "INDEP_LEVEL":
        return sizes.select("part", "n_packs", F.col("part").alias("launch"))
    if kind != "THRESH_LEVEL":
        raise NotImplementedError(f"launch policy {kind}")
    big = (F.col("n_packs") >= threshold).cast("long")
    return prefix(sizes.withColumn("big", big), "part", "big", "launch").drop("big")
