"""Long chains of groups: few turns, whatever the number of groups, and the same answers."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_solves import near, substituted, system

from sparstrata.functions import components
from sparstrata.operators import pieces


def test_long_chains_take_few_turns(spark):
    """Sixty pieces in a chain took sixty turns."""
    rng = random.Random(8)
    rows = {(i, i): 4.0 for i in range(240)} | {(i, i - k): rng.choice([0.5, -1.0, 1.0]) for i in range(240) for k in (1, 2) if i >= k}
    b = {i: float(rng.randrange(-5, 6)) for i in range(240)}
    a = spark.createDataFrame([(i, j, v) for (i, j), v in rows.items()], "i long, j long, v double")
    wanted, level = substituted(rows, b)
    x, turns = pieces.solve_fused(a, spark.createDataFrame(list(b.items()), "i long, b double"), 8)
    assert near({r.i: r.x for r in x.collect()}, wanted) and turns <= 12
    found, turns = pieces.levels_fused(a, 8)
    assert {r.i: r.level for r in found.collect()} == level and turns <= 12


@pytest.mark.parametrize("off", [1.0, -6.0])
def test_chains_that_grow_or_are_wide_take_turns(spark, off):
    """Sums that would lose digits, or rows that need many others, are left to the turns."""
    if off < 0:
        rows = {(i, i): 4.0 for i in range(40)} | {(i, i - 1): off for i in range(1, 40)}
        b = {i: 1.0 for i in range(40)}
        a, sides = spark.createDataFrame([(i, j, v) for (i, j), v in rows.items()], "i long, j long, v double"), spark.createDataFrame(list(b.items()), "i long, b double")
    else:
        rows, b, a, sides = system(spark, 40, 4, 3)
    wanted, _ = substituted(rows, b)
    x, turns = pieces.solve_fused(a, sides, 4)
    found = {r.i: r.x for r in x.collect()}
    assert turns == 10 or off > 0
    assert set(found) == set(wanted) and all(abs(found[i] - wanted[i]) <= 1e-9 * max(1, abs(wanted[i])) for i in wanted)


def test_components_by_blocks(spark, monkeypatch):
    """Chains that cross all blocks, a hot node and loose edges, against the plain way."""
    rng = random.Random(4)
    edges = [(i, i - 3) for i in range(3, 300)] + [(1000, 1000 + i) for i in range(1, 90)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)] + [(-7, -90), (5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    plain = {r.node: r.root for r in components.components(df).collect()}
    for bits in (4, 14):
        monkeypatch.setattr(components, "BITS", bits)
        found = {r.node: r.root for r in components.components_by_blocks(df).collect()}
        assert {k: v for k, v in found.items() if k != v} == plain
    assert components.components_by_blocks(df.where("a = b")).count() == 0


def test_a_block_is_joined_across_batches(monkeypatch):
    monkeypatch.setattr(components, "BITS", 6)
    monkeypatch.setattr(components, "HELD", 5)
    ends = [(0, i, i - 2) for i in range(2, 60)] + [(0, 58, 58)] + [(1, 70, 65), (1, 65, 65), (1, 100, 70)]
    random.Random(1).shuffle(ends)
    ends.sort(key=lambda e: e[0])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*ends[k : k + 3])], ["block", "a", "b"]) for k in range(0, len(ends), 3)]
    rows = [tuple(r.values()) for batch in components._inside_blocks(iter(batches)) for r in batch.to_pylist()]
    assert sorted(rows) == [(i, i % 2, i == 58) for i in range(60)] + [(65, 65, True), (70, 65, False), (100, 65, False)]
    assert np.array_equal(components._joined(np.array([9, 4, 2]), np.array([4, 7, 2]))[1], [2, 4, 4, 4])
