"""Jobs that look at a matrix more than once make it once: its source is read once, whatever it was derived by."""

import pytest
from pyspark.sql import functions as F

from sparstrata.functions.storage import dealt, forget
from sparstrata.operators import analysis, groups, matrix, solve
from sparstrata.sources import market_source


@pytest.fixture
def counted(spark):
    """A matrix, and how many of its rows were made so far."""
    entries = [(i, i, 4.0) for i in range(40)] + [(i, i // 2, 0.5) for i in range(1, 40)] + [(i, i - 1, 1.0) for i in range(9, 40, 3)]
    made = spark.sparkContext.accumulator(0)

    def mark(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    a = spark.createDataFrame(entries, "i long, j long, v double").mapInArrow(mark, "i long, j long, v double")
    return a, made, len(entries)


def test_groups_make_the_matrix_once(counted):
    a, made, n = counted
    table = analysis.analyse(a, analysis.Plan()).collect()
    assert sum(r.nnz for r in table) == n == made.value


def test_dealt_rows_stay_in_place(spark):
    """A join by the bucketed key shuffles the other side alone; dropped tables leave the catalogue."""
    left = dealt(spark.range(100).select(F.col("id").alias("i"), (F.col("id") * 2).alias("x")), "left", "i")
    right = spark.range(50).select(F.col("id").alias("i"))
    found = left.join(right.hint("shuffle_hash"), "i", "left_semi")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r.x for r in found.collect()} == {2 * i for i in range(50)}
    assert dealt(left, "left", "i") is left
    name = left._dealt[0]
    forget(left)
    assert not spark.catalog.tableExists(name)


def test_solves_make_the_matrix_once(spark, counted):
    a, made, n = counted
    b = spark.range(40).select(F.col("id").alias("i"), F.lit(1.0).alias("b"))
    x, _ = analysis.solve_planned(a, b, analysis.Plan(reorder=True))
    assert x.count() == 40 and made.value == n
    solve.solve_levels(a, b).count()
    assert made.value == 2 * n


def test_known_sides_are_products(spark, counted):
    """Right-hand sides of known solutions are the matrix times them, without a join by column."""
    a, _, _ = counted
    known, b = solve.known_solution(a, 40, 3)
    wanted = a.join(known.withColumnRenamed("i", "j"), "j").groupBy("r", "i").agg(F.sum(F.col("v") * F.col("x")).alias("b"))
    assert set(map(tuple, b.select("r", "i", "b").collect())) == set(map(tuple, wanted.collect()))
    assert "Join" not in b._jdf.queryExecution().executedPlan().toString()


def test_pattern_rows_travel_once(spark, monkeypatch):
    """Groups over the seams of blocks, and no row for each pair of a row and a start."""
    monkeypatch.setattr(groups, "BLOCK", 16)
    rows = {(i, i) for i in range(100)} | {(i, i - 13) for i in range(20, 90)} | {(i, i // 9) for i in range(1, 100)} | {(i, i - 2) for i in range(30, 100, 11)}
    a = spark.createDataFrame([(i, j, 1.0) for i, j in rows], "i long, j long, v double")
    start, wanted = 0, {}
    before = lambda i, s: {j for k, j in rows if k == i and j < s}
    for i in range(100):
        if i - start >= 8 or before(i, start) != before(start, start):
            start = i
        wanted[i] = start
    jumps, run = [], groups._chained
    monkeypatch.setattr(groups, "_chained", lambda r, f: jumps.append(f) or run(r, f))
    assert {r.i: r.g for r in groups.by_pattern(a, matrix.row_counts(a), 8).collect()} == wanted
    assert "sequence(" not in jumps[0]._jdf.queryExecution().optimizedPlan().toString()


def test_source_holds_a_chunk_at_a_time(tmp_path, monkeypatch):
    path = tmp_path / "m.mtx"
    path.write_text("%%MatrixMarket matrix coordinate real general\n900 900 900\n" + "".join(f"{i + 1} {i // 3 + 1} {i}.5\n" for i in range(900)))
    monkeypatch.setattr(market_source, "CHUNK", 200)
    reader = market_source.MarketReader(str(path), 3000)
    batches = [batch for split in reader.partitions() for batch in reader.read(split)]
    assert max(batch.num_rows for batch in batches) <= 50
    found = [tuple(row.values()) for batch in batches for row in batch.to_pylist()]
    assert found == [(i, i // 3, i + 0.5) for i in range(900)]
