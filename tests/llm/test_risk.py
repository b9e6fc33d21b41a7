"""The classifier's risk, its minimum and the class prior against plain sums over single rows."""

import math

import numpy as np

from gneiss.llm import quality as Q


def sample(spark, seed, n=400, shift=1.5):
    r = np.random.default_rng(seed)
    good = r.random(n) < 0.4
    x = r.normal(0, 1, (n, Q.N_FEATURES)) + shift * good[:, None] * (np.arange(Q.N_FEATURES) % 3 == 0)
    positive = good & (r.random(n) < 0.5)
    rows = spark.createDataFrame([(v.tobytes(), bool(p)) for v, p in zip(x, positive)], "x binary, positive boolean").repartition(3)
    return rows, x, positive


def plain_risk(w, x, positive, model):
    """prior * E+[l(f)] + max(0, E[l(-f)] - prior * E+[l(-f)]), a row at a time, with the ridge."""
    near = far = unlabelled = 0.0
    for row, p in zip(x, positive):
        z = [1.0] + [min(8.0, max(-8.0, (a - m) / s)) for a, m, s in zip(row, model.mean, model.scale)]
        f = sum(a * b for a, b in zip(z, w))
        unlabelled += math.log1p(math.exp(-abs(f))) + max(f, 0.0)
        if p:
            near += math.log1p(math.exp(-abs(f))) + max(-f, 0.0)
            far += math.log1p(math.exp(-abs(f))) + max(f, 0.0)
    n, k = len(x), int(positive.sum())
    return model.prior * near / k + max(0.0, unlabelled / n - model.prior * far / k) + Q.RIDGE * sum(a * a for a in w) / 2


def test_fit_is_a_minimum_of_the_plain_risk(spark):
    rows, x, positive = sample(spark, 1, n=2500, shift=0.4)
    model = Q.fit(rows)
    at = plain_risk(model.weights, x, positive, model)
    r = np.random.default_rng(2)
    for size in (0.3, 0.03):
        assert all(plain_risk(model.weights + size * r.normal(0, 1, len(model.weights)), x, positive, model) > at for _ in range(5))
    for k in range(0, len(model.weights), 4):
        step = np.zeros(len(model.weights))
        step[k] = 1e-4
        slope = (plain_risk(model.weights + step, x, positive, model) - plain_risk(model.weights - step, x, positive, model)) / 2e-4
        assert abs(slope) < 5e-3, k


def test_statistics_give_the_plain_gradient(spark):
    r = np.random.default_rng(3)
    d = Q.N_FEATURES + 1
    z, positive, w = r.normal(0, 1, (50, d)), r.random(50) < 0.4, r.normal(0, 0.3, d)
    (known, every), mean = Q._parts(Q._statistics(z, positive, w))
    f = z @ w
    s = 1 / (1 + np.exp(-f))
    for (n, near, far, gradient, hessian), some in ((known, positive), (every, np.ones(50, bool))):
        assert n == some.sum() and np.isclose(near, np.log1p(np.exp(f[some])).mean()) and np.isclose(far, np.log1p(np.exp(-f[some])).mean())
        assert np.allclose(gradient, (s[some][:, None] * z[some]).mean(0)) and np.allclose(hessian, np.mean([p * (1 - p) * np.outer(a, a) for p, a in zip(s[some], z[some])], axis=0))
    assert np.allclose(mean, z[positive].mean(0))


def test_prior_equals_a_plain_walk_over_thresholds(spark):
    rows, x, positive = sample(spark, 4)
    mean, scale, w = x.mean(0), x.std(0), np.random.default_rng(5).normal(0, 0.5, Q.N_FEATURES + 1)
    got = Q.estimate_prior(rows, mean, scale, w, int(positive.sum()), len(x))
    z = np.hstack([np.ones((len(x), 1)), np.clip((x - mean) / scale, -8, 8)])
    cell = [min(Q.CELLS - 1, int(Q.CELLS * 0.5 * (1 + math.tanh(f / 2)))) for f in z @ w]
    slack = math.sqrt(math.log(4 / Q.DELTA) / 2 / len(x)) + math.sqrt(math.log(4 / Q.DELTA) / 2 / positive.sum())
    best = None
    for low in range(Q.CELLS - 1, -1, -1):
        p = sum(c >= low for c, k in zip(cell, positive) if k) / positive.sum()
        u = sum(c >= low for c in cell) / len(x)
        if p and (best is None or (u + slack) / p < best[0]):
            best = ((u + slack) / p, u / p)
    assert math.isclose(got, min(0.999, max(0.001, best[1])), rel_tol=1e-9)


def test_prior_is_near_the_share_of_positives(spark):
    rows, x, positive = sample(spark, 6, n=3000, shift=3.0)
    assert abs(Q.fit(rows).prior - 0.4) < 0.08
