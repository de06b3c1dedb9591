"""Counters, groups, pieces, plans and block stores against substitution row by row."""

import random

import pytest
from pyspark.sql import functions as F

from sparstrata.operators import analysis, blocks, counters, features, groups, levels, matrix, pieces, search, solve
from sparstrata.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def system(spark, m, most, seed, back=10**9):
    """Entries of a lower triangle with up to ``most`` dependencies a row, and right-hand sides."""
    rng = random.Random(seed)
    rows = {(i, i): 4.0 for i in range(m)}
    for i in range(1, m):
        for _ in range(rng.randrange(most + 1)):
            rows[i, rng.randrange(max(0, i - back), i)] = rng.choice([0.5, -1.0, 1.0])
    b = {i: float(rng.randrange(-5, 6)) for i in range(m)}
    return rows, b, spark.createDataFrame([(i, j, v) for (i, j), v in rows.items()], "i long, j long, v double"), spark.createDataFrame(list(b.items()), "i long, b double")


def substituted(rows, b):
    x, level, own = {}, {}, {}
    for (i, j), v in rows.items():
        own.setdefault(i, []).append((j, v))
    for i in sorted(b):
        x[i] = (b[i] - sum(v * x[j] for j, v in own[i] if j != i)) / rows[i, i]
        level[i] = max((level[j] + 1 for j, _ in own[i] if j != i), default=0)
    return x, level


def near(found, wanted):
    return set(found) == set(wanted) and all(abs(found[i] - wanted[i]) < 1e-9 for i in wanted)


@pytest.mark.parametrize("job", ["counters", "blocks", "pieces", "plan"])
def test_solves_and_levels(spark, job, monkeypatch):
    monkeypatch.setattr(counters, "BATCH", 40)
    rows, b, a, sides = system(spark, 30, 3, 5, back=14)
    wanted, level = substituted(rows, b)
    by_block = groups.by_block(matrix.row_counts(a), 16)
    if job == "counters":
        x, found = counters.solve_by_counters(a, sides), counters.levels_by_counters(a)
    elif job == "blocks":
        (x, turns), (found, _) = counters.solve_by_groups(a, sides, by_block), counters.levels_by_groups(a, by_block)
        assert turns == 2
    elif job == "pieces":
        (x, turns), (found, _) = pieces.solve_fused(a, sides, 20), pieces.levels_fused(a, 20)
        assert turns <= 2 < max(level.values())
    else:
        (x, _), found = analysis.solve_planned(a, sides, analysis.Plan("ROW_BLOCK_NODEP", 8, reorder=True)), levels.level_sets(a)
    assert near({r.i: r.x for r in x.collect()}, wanted)
    assert {r.i: r.level for r in found.collect()} == level


def test_turns_write_no_more_than_rows_and_entries(spark, monkeypatch):
    """A matrix with many paths: a row is reached by each path, but leaves once."""
    m, width = 10, 4
    entries = [(i, i, 2.0) for i in range(m)] + [(i, j, 0.125) for i in range(m) for j in range(max(0, i - width), i)]
    a = spark.createDataFrame(entries, "i long, j long, v double")
    written = []
    add = counters.Turns.add
    monkeypatch.setattr(counters.Turns, "add", lambda self, table: written.append((found := add(self, table)).count()) or found)
    assert counters.levels_by_counters(a).agg(F.max("level")).first()[0] == m - 1
    assert sum(written) <= len(entries)
    written.clear()
    b = spark.range(m).select(F.col("id").alias("i"), F.lit(1.0).alias("b"))
    assert solve.residual(a, counters.solve_by_counters(a, b), b).first().max_error < 1e-12
    assert sum(written) <= len(entries)


def test_pieces_are_bounded_and_connected(spark):
    chains = [(i, i, 2.0) for i in range(200)] + [(i, i - 4, 1.0) for i in range(4, 160)]
    a = spark.createDataFrame(chains, "i long, j long, v double")
    by = {r.i: r.g for r in pieces.pieces(a, 10).collect()}
    members = {}
    for i, g in by.items():
        members.setdefault(g, []).append(i)
    assert len(by) == 200 and all(len(own) <= 10 and min(own) == g and len({i % 4 for i in own}) == 1 for g, own in members.items())
    assert all(len(members[by[i]]) == 1 for i in range(160, 200))
    assert pieces.pieces(a.where("1 = 0"), 10).count() == 0


def test_hundreds_of_levels_in_few_turns(spark):
    a, b = fx.nation_chain(spark, SF), fx.order_sides(spark, SF)
    x, turns = pieces.solve_fused(a, b, 16)
    depth = a.groupBy("i").count().count()
    found, _ = pieces.levels_fused(a, 16)
    deepest = found.agg(F.max("level")).first()[0]
    assert turns <= deepest / 10 and x.count() == depth
    assert solve.residual(a, x, b).first().max_error < 1e-9


def test_plans_differ_in_turns(spark):
    rows, b, a, sides = system(spark, 36, 2, 11, back=20)
    wanted, _ = substituted(rows, b)
    turns = {}
    for plan in (analysis.Plan("ROW_BLOCK", 9), analysis.Plan("ROW_BLOCK", 20), analysis.Plan("ROW_BLOCK_NODEP", 8), analysis.Plan("ROW_BLOCK", 9, by_level=False)):
        x, turns[plan] = analysis.solve_planned(a, sides, plan)
        assert near({r.i: r.x for r in x.collect()}, wanted)
    assert len(set(turns.values())) >= 3 and turns[analysis.Plan("ROW_BLOCK", 9, by_level=False)] == 1


def test_cycles_and_pivots(spark):
    loop = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0), (0, 1, 1.0), (1, 0, 1.0)], "i long, j long, v double")
    bare = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0)], "i long, j long, v double")
    b = spark.createDataFrame([(0, 1.0), (1, 1.0)], "i long, b double")
    alone = spark.createDataFrame([(0, 0), (1, 1)], "i long, g long")
    for job in (lambda: counters.levels_by_counters(loop), lambda: counters.solve_by_counters(loop, b), lambda: counters.solve_by_groups(loop, b, alone), lambda: pieces.pieces(loop)):
        with pytest.raises(ValueError):
            job()
    for job in (lambda: counters.solve_by_counters(bare, b), lambda: counters.solve_by_groups(bare, b, alone)):
        with pytest.raises(Exception, match="no pivot"):
            job()


def test_block_store_reads_each_entry_once(spark, monkeypatch):
    rows, b, a, sides = system(spark, 32, 3, 3)
    store = blocks.store_blocks(a, 32, 2)
    taken = []
    read = blocks.BlockStore.entries
    monkeypatch.setattr(blocks.BlockStore, "entries", lambda self, block: taken.append(block) or read(self, block))
    wanted, _ = substituted(rows, b)
    assert near({r.i: r.x for r in blocks.solve_store(store, sides).collect()}, wanted)
    assert len(taken) == len(set(taken)) and sum(read(store, block).count() for block in taken) == len(rows)


@pytest.mark.parametrize("triangle", [0, 1, 2, 3])
def test_block_methods_agree(spark, triangle):
    rows, b, a, sides = system(spark, 24, 0 if triangle == 0 else 3, 4, back=24)
    wanted, _ = substituted(rows, b)
    assert near({r.i: r.x for r in blocks._triangle(a, sides, triangle).collect()}, wanted)
    x = spark.createDataFrame(list(wanted.items()), "i long, x double")
    product = {r.i: r.y for r in blocks._rectangle(a, x, triangle).collect()}
    assert near(product, {i: sum(v * wanted[j] for (k, j), v in rows.items() if k == i) for i in wanted})


def test_later_above_against_pairs(spark):
    rng = random.Random(2)
    own = [(i, rng.randrange(37)) for i in range(300)]
    table = spark.createDataFrame(own, "i long, level long")
    wanted = {i: n for i, level in own if (n := sum(other > level for k, other in own if k < i))}
    assert {r.i: r.n for r in features.later_above(table).collect()} == wanted
    plan = features.later_above(table)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert abs(features.reverse_level(table).first()[0] - sum(n / (i + 1) for i, n in wanted.items()) / 300) < 1e-12
    assert features.reverse_level(table.where("level = 0").limit(1)).first()[0] == 0


def test_pattern_groups_against_a_loop(spark):
    rng = random.Random(9)
    rows = {(i, i) for i in range(90)} | {(i, rng.randrange(max(1, i // 20 * 20 - 3))) for i in range(1, 90) for _ in range(rng.randrange(2))}
    a = spark.createDataFrame([(i, j, 1.0) for i, j in rows], "i long, j long, v double")
    start, wanted = 0, {}
    before = lambda i, s: {j for k, j in rows if k == i and j < s}
    for i in range(90):
        if i - start >= 8 or before(i, start) != before(start, start):
            start = i
        wanted[i] = start
    assert {r.i: r.g for r in groups.by_pattern(a, matrix.row_counts(a), 8).collect()} == wanted


def test_search_is_taken_up_where_it_stopped(spark, monkeypatch, tmp_path):
    rows, b, a, sides = system(spark, 32, 2, 6, back=12)
    plans = [search.Plan("ROW_BLOCK", 8), search.Plan("ROW_BLOCK", 16), search.Plan("ROW_BLOCK_NODEP", 8)]
    path, solved = f"file://{tmp_path}/log", []
    run = search.solve_planned

    def stops(a, b, plan):
        if len(solved) == 2:
            solved.append("stop")
            raise RuntimeError("lost")
        solved.append(plan)
        return run(a, b, plan)

    monkeypatch.setattr(search, "solve_planned", stops)
    assert search.read_log(spark, path).count() == 0
    with pytest.raises(RuntimeError):
        search.search(a, sides, "m", plans, path)
    assert search.read_log(spark, path).count() == 2
    log = search.search(a, sides, "m", plans, path).collect()
    assert solved == [*plans[:2], "stop", plans[2]] and len(log) == 3
    assert all(r.max_error < 1e-9 for r in log) and len({r.turns for r in log}) > 1
    best = search.best_plan(search.read_log(spark, path)).collect()
    assert [(r.matrix, r.time) for r in best] == [("m", min(r.time for r in log))]
    assert len(search.space()) == len(set(search.space())) == 80
