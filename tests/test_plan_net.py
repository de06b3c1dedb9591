"""The plan network against the same network in NumPy, and what it chooses."""

import random

import numpy as np
import pytest

from sparstrata.operators import plan_net, tune


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(5)
    rows = []
    for k in range(300):
        m = rng.uniform(0, 1)
        rows += [(k, p * 10, abs(m - p / 2) + 0.1, m, 1.0) for p in range(3) if (k, p) != (3, 1)]
    odd = [(None, 0, 1.0, 0.5, 1.0), (7, None, 1.0, 0.5, 1.0), (8, 20, None, 0.5, 1.0), (900, 10, 0.4, None, 1.0), (4, 10, 50.0, rows[12][3], 1.0)]
    return spark.createDataFrame(rows + odd, "matrix long, plan long, time double, m double, other double")


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    weights = plan_net.first_weights([3, 5, 4, 2], 1)
    x, y = rng.normal(size=(6, 3)), rng.integers(0, 2, (6, 2)).astype(float)
    y[2, 1] = np.nan
    found = plan_net.gradient_sums(weights, x, y)
    assert found[1] == 11
    at = 2
    for w in weights:
        for k in range(w.size):
            old, ends = w.flat[k], []
            for e in (1e-6, -1e-6):
                w.flat[k] = old + e
                ends.append(plan_net.gradient_sums(weights, x, y)[0])
            w.flat[k] = old
            assert abs((ends[0] - ends[1]) / 2e-6 - found[at]) < 1e-4
            at += 1


def test_rounds_equal_those_of_one_array(spark, log, monkeypatch):
    net = plan_net.plan_net(log, ["m", "other"], degree=2, hidden=(6, 5), rounds=4)
    rows = net.powers.transform(plan_net.examples(log, ["m", "other"], net.plans)).orderBy("matrix").collect()
    assert len(rows) == 300  # not the one without a feature, nor runs without matrix, plan or time
    y = np.array([r.y for r in rows])
    assert np.isnan(y).sum() == 1 and y.shape[1] == 3
    x = np.array([r["_scaled"].toArray() for r in rows])
    start = plan_net.first_weights([5, 6, 5, 3], 0)
    wanted = plan_net.steps(start, 1e-2, 1e-6, [lambda w: plan_net.gradient_sums(w, x, y)] * 4)
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(net.weights, wanted, strict=True))
    # sums of many tasks, in groups of two
    monkeypatch.setattr(plan_net, "FAN", 2)
    many = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], "x array<double>, y array<double>").repartition(11)
    assert np.allclose(plan_net.summed_gradients(many, wanted, 11), plan_net.gradient_sums(wanted, x, y))
    assert not plan_net.summed_gradients(many.limit(0), wanted, 1).any()


def test_choice_save_and_load(spark, log, tmp_path):
    train, test = tune.split_by_matrix(log.dropna())
    net = plan_net.plan_net(train, ["m"], rounds=40)
    plan_net.save_net(spark, net, f"file://{tmp_path}/net")
    found = plan_net.chosen_by_net(plan_net.load_net(spark, f"file://{tmp_path}/net"), test.select("matrix", "m").distinct())
    score = tune.score(found.select("matrix", "plan"), test).first()
    assert score.ratio > 0.9 and score.hits > 0.8 * score.n
    assert plan_net.chosen_by_net(net, test.limit(0)).count() == 0
    with pytest.raises(ValueError):
        plan_net.plan_net(log.limit(0), ["m"])
