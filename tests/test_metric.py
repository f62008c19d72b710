"""The metric fit against finite differences, a plain version of its pairs, and itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import metric as M


def points(n=600, dims=6, seed=2):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(4, dims)) * 0.6
    labels = [0 if i % 2 else int(rng.integers(1, 4)) for i in range(n)]
    return [(i, (middles[k] + rng.normal(size=dims)).tolist(), k) for i, k in enumerate(labels)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(points(), "id long, v array<double>, l int")


def learner(**more):
    return M.MetricLearner("id", "v", "l", 6, out=3, **({"epochs": 4, "rate": 0.05} | more))


def test_partners_in_plain_python():
    rng = np.random.default_rng(1)
    for n, turn in ((1, 0), (2, 0), (7, 0), (30, 3), (30, 40)):
        labels = rng.integers(0, 3, n)
        i, j, ks = M.partners(labels, turn, 4)
        want = []
        for a in range(n):
            ring = [(a + s) % n for s in range(1, n)]
            same, other = [x for x in ring if labels[x] == labels[a]], [x for x in ring if labels[x] != labels[a]]
            if same and other:
                want.append((a, same[turn % len(same)], [other[(turn + q) % len(other)] for q in range(4)]))
        assert [(a, b, list(c)) for a, b, c in zip(i, j, ks, strict=True)] == want


def test_slopes_equal_finite_differences():
    rng = np.random.default_rng(4)
    x, labels, weights = rng.normal(size=(12, 5)), rng.integers(0, 3, 12), rng.uniform(0.5, 2, 12)
    x[3] = x[2]
    w, b = rng.normal(size=(4, 5)) * 0.4, rng.normal(size=4) * 0.1 + 0.2
    loss = lambda w, b: M.group_loss(x, labels, weights, w, b, 1, 3, 0.4, 0.98, False)[1]
    _, _, dw, db = M.group_loss(x, labels, weights, w, b, 1, 3, 0.4, 0.98)
    assert (np.sqrt((np.maximum(x @ w.T + b, 0) ** 2).sum(1)) > 0.98).any()  # some are clipped
    h = 1e-6
    for at in np.ndindex(w.shape):
        step = np.zeros_like(w)
        step[at] = h
        assert abs((loss(w + step, b) - loss(w - step, b)) / (2 * h) - dw[at]) < 1e-5
    for at in range(4):
        step = np.eye(4)[at] * h
        assert abs((loss(w, b + step) - loss(w, b - step)) / (2 * h) - db[at]) < 1e-5


def test_loss_of_held_out_rows_falls_and_partitions_do_not_matter(rows):
    one, other = learner(epochs=12).fit(rows), learner(epochs=12).fit(rows.repartition(7))
    assert one.history == other.history and np.array_equal(one.weight, other.weight)
    assert one.history[-1][2] < one.history[0][2] - 0.1
    assert min(h[2] for h in one.history) == one.history[one.epoch][2]
    placed = one.transform(rows.limit(1)).first()
    hidden = np.maximum(one.weight @ np.array(placed.v) + one.bias, 0)
    n = np.linalg.norm(hidden)
    t = hidden * (0.98 / (n + 1e-8) if n > 0.98 else 1.0)
    nt = np.linalg.norm(t)
    assert np.allclose(placed.projected, t * np.tanh(nt) / nt if nt else t, atol=1e-9)


def test_a_stopped_fit_goes_on(rows, tmp_path):
    through = learner().fit(rows)
    learner(epochs=2, store=f"{tmp_path}/m").fit(rows)
    resumed = learner(store=f"{tmp_path}/m").fit(rows)
    assert resumed.history == through.history and resumed.epoch == through.epoch
    assert np.array_equal(resumed.weight, through.weight) and np.array_equal(resumed.bias, through.bias)
    with pytest.raises(ValueError):
        M.MetricLearner("id", "v", "l", 6, out=4, store=f"{tmp_path}/m").fit(rows)


def test_groups_hold_each_usable_row_once(spark, rows):
    odd = spark.createDataFrame([(1, [9.0] * 6, 1), (7001, None, 1), (7002, [1.0], 1), (7003, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (None, [1.0] * 6, 1), (7004, [1.0] * 6, None), (7005, [float("nan")] * 6, 1)], "id long, v array<double>, l int")
    g = M.grouped(rows.union(odd).union(rows), "id", "v", "l", 6).collect()
    assert sum(len(r["labels"]) for r in g) == 600 and max(len(r["labels"]) for r in g) < 2 * M.GROUP
    for held in (False, True):
        sums = {}
        for r in g:
            for k, w in zip(r["labels"], r["weights"], strict=True):
                sums[r["held_out"], k] = sums.get((r["held_out"], k), 0) + w
        own = [v for (h, _), v in sums.items() if h == held]
        assert np.allclose(own, own[0])
    with pytest.raises(ValueError):
        M.grouped(rows, "id", "v", "l", 6, most_labels=1)


def test_tables_without_anchors(spark, rows):
    for df in (rows.limit(0), rows.where("l = 0").limit(5)):
        m = learner(epochs=1).fit(df)
        assert [h[1:] for h in m.history] == [(0.0, 0.0)] * 2
        assert np.array_equal(m.weight.ravel(), M.untrained(3, 6, 0)["theta"][:18])


def test_extra_columns_stay(rows):
    df = rows.withColumns({"group": F.lit(1), "k": F.lit("x"), "held_out": F.lit(2)})
    m = learner(epochs=1).fit(df)
    assert set(m.transform(df).columns) == {"id", "v", "l", "group", "k", "held_out", "projected"}
