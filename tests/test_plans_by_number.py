"""Groups that a row's number tells need no join, and a search lays its matrix out once for all plans."""

from test_solves import near, substituted, system

from sparstrata.operators import analysis, counters, groups, matrix, search


def test_groups_by_number_are_those_of_the_table(spark):
    rows, b, a, sides = system(spark, 36, 2, 11, back=20)
    wanted, _ = substituted(rows, b)
    held = counters.Held(a)
    for plan in (analysis.Plan("ROW_BLOCK", 9), analysis.Plan("ROW_BLOCK", 9, by_level=False), analysis.Plan("ROW_BLOCK", 5, reorder=True)):
        x, turns = analysis.solve_planned(held, sides, plan)
        assert near({r.i: r.x for r in x.collect()}, wanted)
        if plan.by_level and not plan.reorder:
            assert turns == counters.solve_by_groups(a, sides, groups.by_block(matrix.row_counts(a), 9))[1] > 1


def test_a_search_lays_the_matrix_out_once(spark, monkeypatch, tmp_path):
    """Each plan dealt all entries anew, and its check once more."""
    _, _, a, sides = system(spark, 32, 2, 6, back=12)
    labels, lay, checks, check = [], counters.dealt, [], search.solve.residual
    monkeypatch.setattr(counters, "dealt", lambda df, label, *rest, **named: labels.append(label) or lay(df, label, *rest, **named))
    monkeypatch.setattr(search.solve, "residual", lambda a, x, b: checks.append((a, x)) or check(a, x, b))
    plans = [search.Plan("ROW_BLOCK", 8), search.Plan("ROW_BLOCK", 16), search.Plan("ROW_BLOCK", 8, by_level=False)]
    log = search.search(a, sides, "m", plans, f"file://{tmp_path}/log").collect()
    assert len(log) == 3 and all(r.max_error < 1e-9 for r in log)
    assert sorted(labels) == ["columns", "entries"]
    assert len(checks) == 3 and all(a._dealt[1] == "j" for a, _ in checks)
