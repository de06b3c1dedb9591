"""Matrices in SQL text: views of a matrix, and table functions for levels and solutions of its parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import arrow_udtf

from sparstrata.operators.counters import deepen, substitute
from sparstrata.operators.pieces import levels_fused, pieces, solve_fused
from sparstrata.sources import market_source

#: Entries that a part may have; whoever has a larger one takes the view of levels or of the solution.
LARGEST = 2_000_000


class _Part:
    """Collects the entries of one part, which has all rows that its rows depend on."""

    def __init__(self):
        self.held, self.size = [], 0

    def eval(self, entries: pa.RecordBatch) -> Iterator[pa.Table]:
        self.size += len(entries)
        if self.size > LARGEST:
            raise ValueError(f"a part has more than {LARGEST} entries")
        self.held.append(entries)
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        if not self.held:
            return
        table = pa.Table.from_batches(self.held)
        if any(table[c].null_count for c in self.needed):
            raise ValueError("an entry has a null")
        i, j = table["i"].to_numpy(), table["j"].to_numpy()
        rows, at = np.unique(i, return_inverse=True)
        columns = np.searchsorted(rows, j).clip(0, len(rows) - 1)
        if len(outside := np.flatnonzero(rows[columns] != j)):
            raise ValueError(f"row {i[outside[0]]} depends on row {j[outside[0]]}, which is not in its part")
        yield self.result(table, rows, at, columns)


@arrow_udtf(returnType="i bigint, level bigint")
class TriangleLevels(_Part):
    """(i, level) of a part's entries (i, j), the diagonal among them; other columns are ignored."""

    needed = ("i", "j")

    def result(self, table, rows, at, columns):
        level = deepen(at, columns, np.ones(len(at)), np.zeros(len(rows)), rows)
        return pa.table({"i": rows, "level": level.astype(np.int64)})


@arrow_udtf(returnType="i bigint, x double")
class TriangleSolve(_Part):
    """(i, x) of a part's entries (i, j, v, b), b the right-hand side of row i; entries with equal places add up off the diagonal."""

    needed = ("i", "j", "v", "b")

    def result(self, table, rows, at, columns):
        sides = np.zeros((len(rows), 1))
        sides[at, 0] = table["b"].to_numpy()
        return pa.table({"i": rows, "x": substitute(at, columns, table["v"].to_numpy(), sides, rows)[:, 0]})


def register(spark: SparkSession) -> None:
    """Make ``triangle_levels``, ``triangle_solve`` and the source ``matrix_market`` known to SQL of this session.

    Both functions take ``table(...) partition by piece``. A part without entries gives no rows; nulls, parts
    beyond ``LARGEST`` entries, cycles, rows without pivot and dependencies on rows of another part raise.
    """
    spark.udtf.register("triangle_levels", TriangleLevels)
    spark.udtf.register("triangle_solve", TriangleSolve)
    market_source.register(spark)


def publish(spark: SparkSession, name: str, a: DataFrame, b: DataFrame | None = None, solved: bool = False) -> None:
    """Views of a triangular matrix for SQL: ``name`` (i, j, v), ``name_pieces`` (i, piece), with ``b`` also ``name_sides`` (i, b).

    With ``solved`` also ``name_levels`` (i, level) and, with ``b``, ``name_solution`` (i, x),
    of a matrix of any shape: there pieces of one component may depend on each
    other, which the table functions refuse.
    """
    register(spark)
    a.createOrReplaceTempView(name)
    pieces(a).withColumnRenamed("g", "piece").createOrReplaceTempView(f"{name}_pieces")
    if b is not None:
        b.createOrReplaceTempView(f"{name}_sides")
    if solved:
        levels_fused(a)[0].createOrReplaceTempView(f"{name}_levels")
        if b is not None:
            solve_fused(a, b)[0].createOrReplaceTempView(f"{name}_solution")


LEVELS = "select i, level from triangle_levels(table(select p.piece, a.i, a.j from chain a join chain_pieces p on p.i = a.i) partition by piece)"
SOLUTION = """select i, round(x, 9) x from triangle_solve(table(select p.piece, a.i, a.j, a.v, s.b
 from chain a join chain_pieces p on p.i = a.i join chain_sides s on s.i = a.i) partition by piece)"""
FEATURES = f"""with r as (select i, count(*) n, sum(i - j) d from chain group by i), l as (select count(*) n from ({LEVELS}) group by level)
 select * from (select count(*) m, sum(n) nnz, round(avg(n), 6) avg_rnnz, max(n) max_rnnz, round(sum(d) / count(*), 6) dep_dist from r)
 cross join (select count(*) n_levels, round(avg(n), 6) avg_lnnz, max(n) max_lnnz from l)"""
