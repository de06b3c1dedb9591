"""Levels and solutions by counters of open dependencies, row by row or by groups of rows.

A counter tells how many entries a row, or a group of rows, still waits for. A
turn takes what is ready, pushes its products to the rows that depend on it, summed
for each, and lowers their counters by the numbers that were summed; at zero a
row, or a group, is ready for the next turn. A row leaves once, and nothing
that still waits is written again, so all turns together write no more rows than
the matrix has rows and entries.

By rows there are as many turns as levels. By groups of bounded size there are as
many as levels of the graph of groups: inside a group its rows are substituted at
once, many whole groups at a time, in arrays. Long chains of groups that depend on few
rows of each other take no turn for each group: all groups tell at once how their
rows that others need follow from the rows that they need, which is a smaller
system of the same kind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparstrata.functions.storage import dealt, forget, fresh_path, written
from sparstrata.operators.levels import triangular
from sparstrata.operators.matrix import checked_diagonal, ends_of

#: Rows and entries that a task substitutes at once, in whole groups; a group that is larger is taken alone.
BATCH = 200_000
#: Rows of other groups that a group depends on at most, and rows for each row that others need at least, for a smaller system.
WIDE, SHARE = 16, 4


class Held:
    """A matrix that solves look at more than once: dealt by row, by column, and its diagonal, each written when it is first needed."""

    def __init__(self, a: DataFrame):
        self.rows, self._given = dealt(a, "entries", "i"), a

    @cached_property
    def columns(self) -> DataFrame:
        return dealt(self.rows.select("i", "j", "v"), "columns", "j", order="j")

    @cached_property
    def diagonal(self) -> DataFrame:
        """(i, j, v) of a row for each row; raises where it is missing or zero."""
        return written(checked_diagonal(self.rows).select("i", F.col("i").alias("j"), F.col("d").alias("v")), "diagonal")

    @cached_property
    def triangular(self) -> bool:
        return triangular(self.rows)

    def drop(self) -> None:
        """Delete what was written; nothing still to run reads it."""
        made = vars(self)
        forget(*[made.get(name) for name in ("columns", "diagonal")], self.rows if self.rows is not self._given else None)


def held(a: DataFrame | Held) -> Held:
    return a if isinstance(a, Held) else Held(a)


class Turns:
    """The written tables of a loop, a folder for each turn."""

    def __init__(self, spark: SparkSession, label: str, schema: str):
        self.spark, self.root, self.schema, self.n = spark, fresh_path(spark, label), schema, 0

    def add(self, table: DataFrame) -> DataFrame:
        path = f"{self.root}/turn={self.n}"
        table.write.parquet(path)
        self.n += 1
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        if not self.n:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/turn={k}" for k in range(self.n)])

    def drop(self) -> None:
        """Delete all turns; nothing still to run reads them."""
        if self.n:
            forget(self.all())


def _span(table: DataFrame, key: str) -> tuple[int, int] | None:
    """Least and largest key, None for an empty table."""
    low, high = table.agg(F.min(key), F.max(key)).first()
    return None if low is None else (low, high)


def levels_by_counters(a: DataFrame) -> DataFrame:
    """(i, level), 0 for rows without dependencies; one turn for each level.

    Matrices with a cycle of dependencies are refused.
    """
    spark = a.sparkSession
    deps = written(a.where("i <> j").select("i", "j").repartitionByRange("j").sortWithinPartitions("j"), "deps")
    waits = written(deps.groupBy("i").agg(F.count("*").alias("n")), "waits")
    rows = a.select("i").distinct()
    ready, pushes = Turns(spark, "ready", "i long, level long"), Turns(spark, "pushes", "i long, n long")
    now = ready.add(rows.join(waits, "i", "left_anti").select("i", F.lit(0).cast("long").alias("level")))
    depth = 0
    while (span := _span(now, "i")) is not None:
        depth += 1
        own = deps.where(F.col("j").between(*span)).join(now.select(F.col("i").alias("j")), "j")
        pushed = pushes.add(own.groupBy("i").agg(F.count("*").alias("n")))
        lowered = pushes.all().join(pushed.select("i"), "i", "left_semi").groupBy("i").agg(F.sum("n").alias("n"))
        now = ready.add(lowered.join(waits, ["i", "n"]).select("i", F.lit(depth).cast("long").alias("level")))
    found = ready.all()
    if found.count() < rows.count():
        raise ValueError("dependencies form a cycle")
    forget(deps, waits)
    pushes.drop()
    return found


def solve_by_counters(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, x) of b(i, b): rows are divided in the turn in which their counter is zero; levels are not needed."""
    spark = a.sparkSession
    rows = written(b.join(checked_diagonal(a), "i").select("i", "b", "d"), "rows")
    entries = written(a.where("i <> j").select("i", "j", "v").repartitionByRange("j").sortWithinPartitions("j"), "entries")
    waits = written(entries.groupBy("i").agg(F.count("*").alias("n")), "waits")
    solved, pushes = Turns(spark, "solved", "i long, x double"), Turns(spark, "pushes", "i long, n long, s double")
    now = solved.add(rows.join(waits, "i", "left_anti").select("i", (F.col("b") / F.col("d")).alias("x")))
    while (span := _span(now, "i")) is not None:
        own = entries.where(F.col("j").between(*span)).join(now.withColumnRenamed("i", "j"), "j")
        pushed = pushes.add(own.groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("v") * F.col("x")).alias("s")))
        lowered = pushes.all().join(pushed.select("i"), "i", "left_semi").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        done = lowered.join(waits, ["i", "n"]).join(rows, "i")
        now = solved.add(done.select("i", ((F.col("b") - F.col("s")) / F.col("d")).alias("x")))
    found = solved.all()
    if found.count() < rows.count():
        raise ValueError("dependencies form a cycle")
    forget(rows, entries, waits)
    pushes.drop()
    return found


def _ready_in_order(n: int, rows: np.ndarray, columns: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows that are ready, their entries) again and again until all n rows were; ``rows`` and ``columns`` are the entries' ends."""
    order = np.argsort(columns, kind="stable")
    starts = np.searchsorted(columns[order], np.arange(n + 1))
    waits = np.bincount(rows, minlength=n)
    now, left = np.flatnonzero(waits == 0), n
    while len(now):
        left -= len(now)
        sizes = starts[now + 1] - starts[now]
        shift = np.repeat(starts[now] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        own = order[np.arange(sizes.sum()) + shift]
        yield now, own
        np.subtract.at(waits, rows[own], 1)
        reached = np.unique(rows[own])
        now = reached[waits[reached] == 0]
    if left:
        raise ValueError("dependencies form a cycle")


def substitute(i: np.ndarray, j: np.ndarray, v: np.ndarray, sides: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """x of entries (i, j, v), diagonals among them, and sides (rows, right-hand sides); i and j are places in ``rows``."""
    on, x = i == j, np.array(sides, np.float64)
    diagonal = np.zeros(len(rows))
    diagonal[i[on]] = v[on]
    if len(missing := np.flatnonzero(diagonal == 0)):
        raise ValueError(f"no pivot in row {rows[missing[0]]}")
    i, j, v = i[~on], j[~on], v[~on]
    for now, own in _ready_in_order(len(rows), i, j):
        x[now] /= diagonal[now, None]
        np.subtract.at(x, i[own], v[own, None] * x[j[own]])
    return x


def deepen(i: np.ndarray, j: np.ndarray, v: np.ndarray, least: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Levels of rows that have at least the levels ``least``, one column or more; an entry v lifts by v."""
    level = np.array(least, np.float64)
    off = i != j
    i, j, v = i[off], j[off], v[off].reshape(-1, *[1] * (level.ndim - 1))
    for _, own in _ready_in_order(len(rows), i, j):
        np.maximum.at(level, i[own], level[j[own]] + v[own])
    return level


def _grouped(kernel: Callable, combine: Callable, sides: int, units: int = 0):
    """A function for batches (g, i, j, v), sorted by g, that gives (g, i, j, v): the values v of row i for right-hand side j.

    Rows with j < 0 hold the sides: side -1 - j of row i. With ``units`` so many more
    sides follow, which begin with what ``combine`` leaves as it is, and values
    are given of those rows alone that have a row with j = -1 - sides - units.
    """
    most = sides + units

    def solved(table: pa.Table) -> pa.RecordBatch:
        g, i, j, v = (c.to_numpy() for c in table.columns)
        entry = j >= 0
        rows, first = np.unique(i[entry], return_index=True)
        own = np.zeros((len(rows), most))
        own[:, sides:] = {np.add: 0.0, np.maximum: -np.inf}[combine]
        asked = np.full(len(rows), not units)
        # sides of rows without entries have no row in the matrix
        at = np.searchsorted(rows, i[~entry]).clip(0, max(len(rows) - 1, 0))
        known = rows[at] == i[~entry] if len(rows) else np.zeros(len(at), bool)
        at, side, value = at[known], -1 - j[~entry][known], v[~entry][known]
        asked[at[side == most]] = True
        combine.at(own, (at[side < most], side[side < most]), value[side < most])
        place = lambda x: np.searchsorted(rows, x)
        x = kernel(place(i[entry]), place(j[entry]), v[entry], own, rows)[asked]
        rows, first = rows[asked], first[asked]
        columns = [np.repeat(g[entry][first], most), np.repeat(rows, most), np.tile(np.arange(most), len(rows)), x.ravel()]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["g", "i", "j", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < BATCH:
                continue
            # whole groups leave, the last one may go on in the next batch
            table = pa.Table.from_batches(held)
            g = table.column("g").to_numpy()
            stop = int(np.searchsorted(g, g[-1]))
            if stop:
                yield solved(table.slice(0, stop))
            held = table.slice(stop).to_batches()
            size = table.num_rows - stop
        if size:
            yield solved(pa.Table.from_batches(held))

    return run


ENTRY = "g long, i long, j long, v double"


def _by_interfaces(inner: DataFrame, outer: DataFrame, rows: int, kernel: Callable, combine: Callable, again: Callable) -> tuple[DataFrame, int] | None:
    """(i, x) of the rows that other groups need, and the turns that it took; None where these are many or sums would lose digits.

    Each group is solved for its side and for each row that it needs, as if that
    were 1 (or level 0) and the others 0. ``again`` solves what this leaves,
    (i, j, v) and (i, b), a row for each row that others need, with ones on the diagonal.
    """
    need = Window.partitionBy("g").orderBy("j")
    needs = written(outer.select("g", "j").distinct().withColumn("side", F.row_number().over(need).cast("long")), "needs")
    wide = needs.agg(F.max("side")).first()[0] or 0
    asked = written(outer.select(F.col("h").alias("g"), F.col("j").alias("i")).distinct(), "asked")
    if not 0 < wide <= WIDE or asked.count() * SHARE > rows:
        forget(needs, asked)
        return None
    units = outer.join(needs, ["g", "j"]).select("g", "i", (-1 - F.col("side")).alias("j"), "v")
    marks = asked.select("g", "i", F.lit(-2 - wide).cast("long").alias("j"), F.lit(0.0).alias("v"))
    own = inner.unionByName(units).unionByName(marks).repartition("g").sortWithinPartitions("g")
    told = written(own.mapInArrow(_grouped(kernel, combine, 1, wide), ENTRY), "told")
    nothing = {np.add: 0.0, np.maximum: float("-inf")}[combine]
    left = told.where((F.col("j") > 0) & (F.col("v") != nothing)).select("g", "i", F.col("j").alias("side"), "v").join(needs, ["g", "side"]).select("i", "j", "v")
    left = dealt(left.unionByName(asked.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))), "left", "i")
    # beyond 1 the errors of the rows needed would grow with each group
    most = left.where("i <> j").groupBy("i").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s")).first()[0] if combine is np.add else 0
    found = again(left, told.where("j = 0").select("i", F.col("v").alias("b"))) if (most or 0) <= 1 else None
    forget(needs, asked, told, left)
    return found


def _by_groups(entries: DataFrame, on: DataFrame, groups: DataFrame | Callable[[str], Column], sides: DataFrame, n_sides: int, kernel: Callable, combine: Callable, product: Callable, again: Callable | None = None) -> tuple[DataFrame, int]:
    """(i, j, v): value v of row i for right-hand side j, and the number of turns.

    ``on`` are the entries on the diagonal, one for each row, ``entries`` has those off it, dealt
    by row; or dealt by column if ``groups`` is a function from the name of a column of
    rows to their group, which does not fall as rows grow: then neither end needs a
    join, and nothing of the entries is written again but those inside groups. ``sides`` are rows (i, j, v) with j = -1 - side; ``product`` makes what an
    entry v pushes of a value x. What is pushed to a row is one more side of it.
    Entries between groups lie in buckets of their column, so a turn shuffles x alone.
    ``again`` is for one right-hand side and groups in long chains (``_by_interfaces``).
    """
    spark, off, rest = entries.sparkSession, entries.where("i <> j").select("i", "j", "v"), sides.unionByName(on)
    if told := callable(groups):
        of = on.select(groups("i").alias("g"))
        ends = off.select(groups("i").alias("g"), "i", "j", "v", groups("j").alias("h"))
        rest = rest.select(groups("i").alias("g"), "i", "j", "v")
    else:
        of = dealt(groups.select("i", "g"), "groups", "i")
        ends = dealt(ends_of(off, of).select("g", "i", "j", "v", "h"), "ends", "j", order="h", placed=True)
        rest = rest.join(of, "i").select("g", "i", "j", "v")
    made_here = () if told else (ends, of)
    inner = written(ends.where("g = h").select("g", "i", "j", "v").unionByName(rest).repartitionByRange("g").sortWithinPartitions("g"), "inner")
    outer = ends.where("g <> h")
    run, combined = _grouped(kernel, combine, n_sides), {np.add: F.sum, np.maximum: F.max}[combine]
    if again:
        between = written(outer, "between")
        if (known := _by_interfaces(inner, between, on.count(), kernel, combine, again)) is not None:
            x, turns = known
            x = written(x.select(F.col("i").alias("j"), "x"), "known")
            made = between.join(x, "j").groupBy("g", "i").agg(combined(product(F.col("v"), F.col("x"))).alias("v"))
            own = inner.unionByName(made.select("g", "i", F.lit(-1).cast("long").alias("j"), "v"))
            values = written(own.repartition("g").sortWithinPartitions("g").mapInArrow(run, ENTRY), "found")
            forget(inner, between, x, *made_here)
            return values.select("i", "j", "v"), turns + 2
        forget(between)
    waits = written(outer.groupBy("g").agg(F.count("*").alias("n")), "waits")
    pushes, found, ready = Turns(spark, "pushes", ENTRY + ", n long"), Turns(spark, "found", ENTRY), Turns(spark, "ready", "g long")
    now = ready.add(of.select("g").distinct().join(waits, "g", "left_anti"))
    while (span := _span(now, "g")) is not None:
        within = F.col("g").between(*span)
        own = inner.where(within).unionByName(pushes.all().select("g", "i", "j", "v").where(within)).join(now, "g", "left_semi")
        values = found.add(own.repartition("g").sortWithinPartitions("g").mapInArrow(run, ENTRY))
        # files are in the order of the column, or of its group
        near = outer.where(F.col("j").between(*_span(values, "i")) if told else F.col("h").between(*span))
        if near.isEmpty():
            break
        x = values.select(F.col("i").alias("j"), F.col("j").alias("side"), F.col("v").alias("x"))
        sums = (combined(product(F.col("v"), F.col("x"))).alias("v"), F.count("*").alias("n"))
        made = near.join(x.hint("shuffle_hash"), "j").groupBy(*([] if told else ["g"]), "i", "side").agg(*sums)
        pushed = pushes.add(made.select(groups("i").alias("g") if told else "g", "i", (-1 - F.col("side")).alias("j"), "v", "n"))
        # each entry is counted once, with its first side
        counted = pushes.all().where("j = -1").join(pushed.select("g").distinct(), "g", "left_semi").groupBy("g").agg(F.sum("n").alias("n"))
        now = ready.add(counted.join(waits, ["g", "n"]).select("g"))
    values = found.all()
    if values.count() < n_sides * on.count():
        raise ValueError("groups depend on each other in a cycle")
    forget(inner, waits, *made_here)
    pushes.drop()
    ready.drop()
    return values.select("i", "j", "v"), found.n


def solve_many_by_groups(a: DataFrame | Held, b: DataFrame, groups: DataFrame | Callable[[str], Column], again: Callable | None = None) -> tuple[DataFrame, int]:
    """(r, i, x) of right-hand sides b(r, i, b) by groups(i, g), and the number of turns.

    ``groups`` may be a function of the row's number, as in ``_by_groups``.
    The graph of groups has no cycle, as with runs of rows of a triangular matrix. A
    group is substituted as a whole once all that it waits for has come; what a
    task holds is bounded by ``BATCH`` and the largest group. A side without
    a row in b is 0 there. Right-hand sides are few; their numbers pass the driver. With one
    of them ``again`` solves the smaller system of groups in long chains.
    """
    spark = b.sparkSession
    numbers = sorted(r[0] for r in b.select("r").distinct().collect())
    if not numbers:
        return b.select("r", "i", F.col("b").alias("x")), 0
    known = F.broadcast(spark.createDataFrame([(r, k) for k, r in enumerate(numbers)], "r long, side long"))
    sides = b.join(known, "r").select("i", (-1 - F.col("side")).alias("j"), F.col("b").alias("v"))
    own = held(a)
    values, turns = _by_groups(own.columns if callable(groups) else own.rows, own.diagonal, groups, sides, len(numbers), substitute, np.add, lambda v, x: -v * x, again if len(numbers) == 1 else None)
    if own is not a:
        own.drop()
    return values.join(known, F.col("j") == F.col("side")).select("r", "i", F.col("v").alias("x")), turns


def solve_by_groups(a: DataFrame | Held, b: DataFrame, groups: DataFrame | Callable[[str], Column], again: Callable | None = None) -> tuple[DataFrame, int]:
    """(i, x) of one right-hand side b(i, b), and the number of turns; ``again`` solves the smaller system of groups in long chains."""
    x, turns = solve_many_by_groups(a, b.select(F.lit(0).cast("long").alias("r"), "i", "b"), groups, again)
    return x.select("i", "x"), turns


def levels_by_groups(a: DataFrame, groups: DataFrame, again: Callable | None = None) -> tuple[DataFrame, int]:
    """(i, level) by groups(i, g) whose graph has no cycle, and the number of turns; ``again`` solves the smaller system of groups in long chains."""
    a = dealt(a, "entries", "i")
    return lifted_by_groups(a.select("i", "j", F.lit(1.0).alias("v")), None, groups, again)


def lifted_by_groups(a: DataFrame, least: DataFrame | None, groups: DataFrame, again: Callable | None = None) -> tuple[DataFrame, int]:
    """``levels_by_groups`` of rows that have at least the levels least(i, b), where an entry v lifts its row v above its column."""
    sides = a.sparkSession.createDataFrame([], "i long, j long, v double") if least is None else least.select("i", F.lit(-1).cast("long").alias("j"), F.col("b").cast("double").alias("v"))
    on = written(a.select("i").distinct().select("i", F.col("i").alias("j"), F.lit(1.0).alias("v")), "rows")
    values, turns = _by_groups(a, on, groups, sides, 1, deepen, np.maximum, lambda v, x: x + v, again)
    return values.select("i", F.col("v").cast("long").alias("level")), turns
