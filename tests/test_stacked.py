"""Linear models fitted together against the same fits made one by one in numpy."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from pandwerk.learning import prep, stacked, train, tune
from pandwerk.learning.linear_svr import LinearSVR


def alone(x, y, fit, on):
    """Reweighted least squares of one model over the rows `on`."""
    x, y = np.column_stack([x, np.ones(len(x))])[on], y[on]
    use = list(range(x.shape[1])) if fit.columns is None else [*fit.columns, x.shape[1] - 1]
    x = x[:, use]
    w, best, best_w, stale, status, step = np.zeros(x.shape[1]), np.inf, None, 0, "limit", 0
    while True:
        r = y - x @ w
        beyond = np.maximum(np.abs(r) - fit.epsilon, 0)
        weight, target = np.full(len(y), fit.C), y
        if step:
            objective = fit.C * (beyond**2 if fit.squared else beyond).sum() + w @ w / 2
            gain, slack = best - objective, fit.tol * abs(objective)
            if objective < best:
                best, best_w = objective, w
            stale = 0 if gain > slack else stale + 1
            status = "settled" if abs(gain) <= slack else "stalled" if stale >= 5 else "limit"
            if status != "limit" or step >= fit.maxIter:
                break
            weight = fit.C * (beyond > 0) * (2.0 if fit.squared else 1 / np.maximum(beyond, 1e-3))
            target = y - np.sign(r) * fit.epsilon
        w = np.linalg.solve((x * weight[:, None]).T @ x + np.eye(len(use)), (x * weight[:, None]).T @ target)
        step += 1
    return best_w, status, step, use


@pytest.fixture(scope="module")
def data(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(400, 5))
    y = x @ [1.0, -2.0, 0.0, 0.5, 3.0] + 4 + draw.standard_t(2, size=400)
    rows = [(f"{i:04d}", float(t), Vectors.dense(v)) for i, (v, t) in enumerate(zip(x, y))]
    frame = spark.createDataFrame(rows, ["bag_id", "clean_floors", prep.FEATURES]).withColumn("part", F.col("bag_id").cast("int") % 5)
    return x, y, frame


FITS = [stacked.Fit(), stacked.Fit(C=0.1, epsilon=0.5), stacked.Fit(C=0.7, epsilon=0.1, loss="squared_epsilon_insensitive", tol=1e-6),
        stacked.Fit(maxIter=2), stacked.Fit(columns=(0, 4)), stacked.Fit(columns=(1, 2, 3), loss="squared_epsilon_insensitive")]


def test_fits_together_equal_fits_alone(data):
    x, y, frame = data
    rows, width = stacked.rows_of(frame, "clean_floors", {"part": F.col("part")})
    fits = [f for f in FITS for _ in range(5)] * 2  # more than one chunk of models
    out = [k % 5 for k in range(len(fits))]
    found = stacked.fit_together(rows, width, fits, lambda meta: (meta[:, :1] != np.array(out)).astype(float))
    part = np.arange(len(y)) % 5
    for f, k, got in zip(fits, out, found):
        want, status, steps, use = alone(x, y, f, part != k)
        assert np.allclose(got.weights[use], want, atol=1e-8) and (got.status, got.steps) == (status, steps)
        assert set(np.flatnonzero(got.weights)) <= set(use)
    scored = stacked.scores(rows, width, [f.weights for f in found], lambda meta: (meta[:, :1] == np.array(out)).astype(float))
    for k, got, (n, rmse, r2) in zip(out, found, scored):
        error = y[part == k] - np.column_stack([x, np.ones(len(x))])[part == k] @ got.weights
        assert n == (part == k).sum() and np.isclose(rmse, np.sqrt((error**2).mean()))
        assert np.isclose(r2, 1 - (error**2).mean() / y[part == k].var())


def test_fits_that_differ_in_their_stopping_rule_share_their_steps(data, monkeypatch):
    x, y, frame = data
    rows, width = stacked.rows_of(frame, "clean_floors", {"part": F.col("part")})
    fits = [stacked.Fit(epsilon=0.1, tol=tol, maxIter=limit) for tol in (1e-3, 1e-6) for limit in (3, 1000) for _ in range(5)]
    out = [k % 5 for k in range(len(fits))]
    made, one_pass = [], stacked._pass

    def counted(rows, width, fits, *rest):
        made.append(len(fits))
        return one_pass(rows, width, fits, *rest)

    monkeypatch.setattr(stacked, "_pass", counted)
    found = stacked.fit_together(rows, width, fits, lambda meta: (meta[:, :1] != np.array(out)).astype(float), sees=out)
    assert max(made) == 5
    part = np.arange(len(y)) % 5
    for f, k, got in zip(fits, out, found):
        want, status, steps, _ = alone(x, y, f, part != k)
        assert np.allclose(got.weights, want, atol=1e-8) and (got.status, got.steps) == (status, steps)


def test_limits_are_read_off_one_path(data):
    x, y, frame = data
    rows, width = stacked.rows_of(frame, "clean_floors", {})
    long = stacked.fit_together(rows, width, [stacked.Fit(tol=1e-9, maxIter=40)], path=True)[0]
    for limit in (1, 2, 7, 40):
        want = alone(x, y, stacked.Fit(tol=1e-9, maxIter=limit), np.ones(len(y), bool))[0]
        assert np.allclose([w for step, _, w in long.path if step <= limit][-1], want, atol=1e-8)


def test_estimator_reports_how_it_ended(data):
    _, _, frame = data
    assert LinearSVR().fit(frame).converged
    short = LinearSVR(maxIter=1).fit(frame)
    assert not short.converged and short.getOrDefault(short.status) == "limit"


def register(spark):
    rows = [(f"{i:05d}", float(i % 9 + 1), 2.7 * (i % 9 + 1) + (i % 5) * 0.1, float(i % 13), "ab"[i % 2]) for i in range(600)]
    return spark.createDataFrame(rows, "bag_id string, clean_floors double, height double, units double, kind string")


def test_search_feeds_the_refit(spark):
    df, features = register(spark), ["height", "units", "kind"]
    best, table = tune.random_search(df, features, "svr", n=6, folds=3)
    rows = table.collect()
    assert len(rows) == 6 and sum(r.is_best for r in rows) == 1
    assert max(rows, key=lambda r: r.score).is_best and str(sorted(best.items())) == next(r.parameters for r in rows if r.is_best)
    models = train.refit(df, {"all": features, "tall": ["height"], "coded": ["kind", "units"]}, "svr", best)
    for name, chosen in (("all", features), ("tall", ["height"]), ("coded", ["kind", "units"])):
        want = train.fit(df, chosen, "svr", best)[0].stages[-1]
        assert np.allclose(models[name].stages[-1].getOrDefault("weights"), want.getOrDefault("weights"), atol=1e-6)
        assert train.predict(models[name], df).count() == 600


def test_curves_are_nested_and_match_single_fits(spark):
    df, features = register(spark), ["height", "units", "kind"]
    curve = tune.learning_curve(df, features, "svr", shares=(0.3, 1.0), repeats=2, metric="rmse").collect()
    assert len(curve) == 4 and all(r.fit_seconds > 0 for r in curve)
    _, ready = train.prepared(df, features)
    for r in curve:
        on, held = tune.shuffle_splits(ready, 2, 0.2, 42)[r.repeat]
        on = on.where(tune._place("size-42") < int(r.share * tune.PLACES))
        (a, b), _ = tune._scores("svr", {}, on, (on, held), "rmse")
        assert on.count() == r.rows and np.allclose((a, b), (r.train_score, r.validation_score), atol=1e-6)
    values = tune.validation_curve(df, features, "svr", "C", [0.1, 1.0], repeats=2)
    assert values.count() == 4 and values.where("validation_score > 0.9").count() == 4
    grid = tune.iteration_tolerance_grid(df.where("bag_id < '00400'"), df.where("bag_id >= '00400'"), features, iterations=(1, 50),
                                         tolerances=(1e-3, 1e-6)).collect()
    assert [(r.tol, r.max_iter) for r in grid] == [(1e-3, 1), (1e-3, 50), (1e-6, 1), (1e-6, 50)]
