"""Closed-form cases and properties."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vibrary.operators import compare, conditions, extract, models, signals, spectra, tables


def long(spark, values, sweep=1):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(sweep, "AE", i, float(v)) for i, v in enumerate(values)], "sweep long, sensor string, i long, v double")


def test_viscosities_meet_their_fixed_points(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(999.0, 40.0), (1000.0, 100.0)], "rpm double, t double")
    nu = conditions.walther_viscosity(F.col("t"), F.lit(22.0), F.lit(4.1))
    a, b = df.select(nu.alias("nu"), conditions.min_viscosity(F.col("rpm")).alias("n1")).collect()
    assert a.nu == pytest.approx(22.0) and b.nu == pytest.approx(4.1)
    assert a.n1 == pytest.approx(45000 * 999**-0.83 * 38**-0.5) and b.n1 == pytest.approx(4500 * 1000**-0.5 * 38**-0.5)


def test_gaps_spikes_and_flat_runs(spark) -> None:  # noqa: ANN001
    nan, inf = float("nan"), float("inf")
    got = [r.v for r in signals.fill_nonfinite(long(spark, [nan, 1, nan, nan, 4, inf])).orderBy("i").collect()]
    assert got == [1, 1, 2, 3, 4, 4]
    wave = [math.sin(i) for i in range(200)]
    wave[100] = 500.0
    out = signals.despike(long(spark, wave)).orderBy("i").collect()
    assert [r.i for r in out if r.spike] == [100]
    assert out[100].v == pytest.approx(np.median([*wave[95:100], *wave[101:106]]))
    flat = signals.saturation(long(spark, [*range(10), *[7.0] * 61, 1, 2])).first()
    assert (flat.saturation_longest_run, flat.is_saturated) == (60, True)


def test_rejections(spark) -> None:  # noqa: ANN001
    nan = float("nan")
    df = long(spark, [1] * 63, 1).union(long(spark, [0] * 64, 2)).union(long(spark, [nan] * 64, 3)).union(long(spark, [1] * 64, 4))
    assert {r.sweep: r.rejection_reason for r in signals.validate(df).collect()} == {1: "too short (63 < 64)", 2: "all-zero signal", 3: "all-NaN signal", 4: None}


def test_sine(spark) -> None:  # noqa: ANN001
    x = [3 * math.sin(2 * math.pi * 50 * i / 1000) for i in range(1000)]
    t = signals.time_features(long(spark, x)).first()
    assert t.rms == pytest.approx(3 / math.sqrt(2)) and t.kurtosis == pytest.approx(1.5)
    arrays = spectra.to_arrays(long(spark, x), 1000.0)
    f = extract.frequency_features(arrays).first()
    assert f.dominant_frequency == pytest.approx(50)
    env = np.array(spectra.envelope(arrays).first().voltage)
    assert env == pytest.approx(np.full(1000, 3.0))
    assert np.abs(spectra.bandpass(arrays, 100, 300).first().voltage).max() < 0.01
    assert np.abs(spectra.bandpass(arrays, 600, 900).first().voltage).max() == 0


def test_parseval(spark) -> None:  # noqa: ANN001
    x = np.random.default_rng(1).normal(size=64)
    f, p = spectra.welch(x, 1000.0, 64)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 64)
    assert p.sum() * (f[1] - f[0]) == pytest.approx((((x - x.mean()) * w) ** 2).sum() / (w**2).sum())


def test_redundant_features() -> None:
    pairs = {(a, b): r for a, b, r in (("x", "y", 0.95), ("y", "x", 0.95), ("x", "z", 0.1), ("z", "x", 0.1), ("y", "z", 0.1), ("z", "y", 0.1))}
    assert tables.reduce_redundant(pairs, {"x": 20, "y": 20, "z": 1}, {"x": 0.5, "y": 0.7, "z": 0.2}, ["x", "y", "z"]) == ["y", "z"]


def test_collinear_is_inflated(spark) -> None:  # noqa: ANN001
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"), F.sin("id").alias("c"))
    got = {r.feature: r.vif for r in tables.vif(df, ["a", "b", "c"]).collect()}
    assert got["a"] == got["b"] == float("inf") and got["c"] < 1.1


def test_folds_are_disjoint_and_cover(spark) -> None:  # noqa: ANN001
    df = spark.range(103).select(F.col("id").alias("file"))
    folds = models.kfold(df, ["file"], 5, repeats=2).collect()
    for r in (0, 1):
        assert sorted(x.file for x in folds if x.repeat == r) == list(range(103))
        sizes = np.bincount([x.fold for x in folds if x.repeat == r])
        assert sizes.max() - sizes.min() <= 1
    assert models.split_holdout(df, ["file"]).filter("is_holdout").count() == 21


def test_elastic_net_without_penalty_is_least_squares(spark) -> None:  # noqa: ANN001
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3
    df = spark.createDataFrame([(*map(float, r), float(t), i % 5) for i, (r, t) in enumerate(zip(x, y, strict=True))], "a double, b double, c double, y double, fold int")
    best, w, b = models.elastic_net_cv(df, ["a", "b", "c"], "y", "fold", [1e-9, 1.0], [0.5])
    assert best["alpha"] == 1e-9 and w == pytest.approx([1, -2, 0.5], abs=1e-5) and b == pytest.approx(3, abs=1e-5)


def folded_rows(spark, seed: int, columns: int = 3):  # noqa: ANN001, ANN201
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(150, columns)) * range(1, columns + 1) + 5
    y = x[:, 0] - 0.3 * x[:, 1] * x[:, 2] + rng.normal(size=150)
    fold, inner = np.arange(150) % 5, np.arange(150) // 5 % 5
    names = [f"c{j}" for j in range(columns)]
    rows = [(*map(float, r), float(t), int(f), int(i)) for r, t, f, i in zip(x, y, fold, inner, strict=True)]
    return x, y, fold, inner, names, spark.createDataFrame(rows, ", ".join([*(f"{n} double" for n in names), "y double, fold int, inner int"]))


def test_elastic_net_predicts_held_folds(spark) -> None:  # noqa: ANN001
    x, y, fold, inner, names, df = folded_rows(spark, 4)

    def fit(rows, a, l):  # noqa: ANN001, ANN202
        g = np.column_stack([np.ones(rows.sum()), x[rows], y[rows]])
        return models.elastic_net(g.T @ g, a, l, 10_000)

    error = lambda rows, w, b: float(np.mean((y[rows] - x[rows] @ w - b) ** 2))
    fits = models.elastic_net_nested(models.gram(df, names, "y", ["fold", "inner"]))
    assert len(models.ALPHAS) * len(models.L1_RATIOS) == 54 and set(fits) == {0, 1, 2, 3, 4, None}
    for held in (0, None):
        own = fold != held if held is not None else np.ones(150, bool)
        score = {(a, l): np.mean([error(own & (inner == i), *fit(own & (inner != i), a, l)) for i in range(5)]) for a in models.ALPHAS for l in models.L1_RATIOS}
        assert score[fits[held]["alpha"], fits[held]["l1_ratio"]] == pytest.approx(min(score.values()))
    got = {r.fold: r.rmse for r in models.fold_scores(models.out_of_fold(df, names, "fold", fits), "y", "fold", fits, ["alpha"]).collect()}
    want = {f: error(fold == f, *fit(fold != f, fits[f]["alpha"], fits[f]["l1_ratio"])) ** 0.5 for f in range(5)}
    assert {f: got[f] for f in range(5)} == pytest.approx(want) and got[None] == pytest.approx(np.mean([v * v for v in want.values()]) ** 0.5)


def test_poly_ridge_by_fold(spark) -> None:  # noqa: ANN001
    x, y, fold, _, names, df = folded_rows(spark, 5, 6)
    made, columns, fits = models.poly_ridge_nested(df, names, "y", "fold", 3)
    got = {r.fold: r.rmse for r in models.fold_scores(models.out_of_fold(made, columns, "fold", fits), "y", "fold", fits, ["alpha"]).collect()}
    for held in (1, 3):
        train = fold != held
        r = [abs(np.corrcoef(x[train, j], y[train])[0, 1]) for j in range(6)]
        top = sorted(np.argsort(r)[::-1][:3])
        z = (x[:, top] - x[train][:, top].mean(0)) / x[train][:, top].std(0)
        p = np.column_stack([z, *(z[:, i] * z[:, j] for i in range(3) for j in range(i, 3))])

        def fit(rows, a):  # noqa: ANN001, ANN202
            m, t = p[rows].mean(0), y[rows].mean()
            w = np.linalg.solve((p[rows] - m).T @ (p[rows] - m) + a * np.eye(9), (p[rows] - m).T @ (y[rows] - t))
            return w, t - m @ w

        def left_out(a):  # noqa: ANN001, ANN202
            e = 0.0
            for i in np.flatnonzero(train):
                w, b = fit(train & (np.arange(150) != i), a)
                e += (y[i] - p[i] @ w - b) ** 2
            return e

        best = min(models.RIDGE_ALPHAS, key=left_out)
        w, b = fit(train, best)
        assert fits[held]["alpha"] == best and fits[held]["top"] == [names[j] for j in top]
        assert got[held] == pytest.approx(np.mean((y[~train] - p[~train] @ w - b) ** 2) ** 0.5) == fits[held]["rmse"]


def test_bayesian_ridge_has_not_seen_the_fold(spark) -> None:  # noqa: ANN001
    x, y, fold, _, names, df = folded_rows(spark, 6)
    fits = models.bayesian_ridge_folds({k[0]: g for k, g in models.gram(df, names, "y", ["fold"]).items()})
    moved = df.withColumn("y", F.when(F.col("fold") == 2, 1000.0).otherwise(F.col("y")))
    again = models.bayesian_ridge_folds({k[0]: g for k, g in models.gram(moved, names, "y", ["fold"]).items()})
    assert again[2]["w"] == pytest.approx(fits[2]["w"]) and again[2]["b"] == pytest.approx(fits[2]["b"]) and abs(again[None]["b"] - fits[None]["b"]) > 1
    rows = models.out_of_fold(df, names, "fold", fits, std="std").filter("fold = 2").collect()
    assert all(r.yhat == pytest.approx(float(np.dot([r[c] for c in names], fits[2]["w"]) + fits[2]["b"])) and r.std**2 >= fits[2]["noise"] for r in rows)


def test_all_folds_of_trees_are_scored(spark) -> None:  # noqa: ANN001
    from vibrary.plans import more_queries

    rows = {r.fold: r.n for r in more_queries.gbt_cv(spark, "/root/testdata/sf0.001").collect()}
    assert sorted(f for f in rows if f is not None) == [0, 1, 2, 3, 4] and rows[None] == sum(n for f, n in rows.items() if f is not None)


def test_student_probabilities() -> None:
    assert compare.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-5)
    assert compare.t_two_sided(0.0, 5) == pytest.approx(1.0)


def test_holm(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.02), ("d", None)], "t string, p double")
    got = {r.t: (r.reject, r.holm_threshold and round(r.holm_threshold, 6)) for r in compare.holm(df).collect()}
    assert got == {"a": (True, round(0.05 / 3, 6)), "c": (True, 0.025), "b": (True, 0.05), "d": (None, None)}


def test_unknown_choices_fail(spark) -> None:  # noqa: ANN001
    with pytest.raises(ValueError):
        tables.handle_nonfinite(spark.range(1), [], "guess")
    with pytest.raises(ValueError):
        tables.outliers(spark.range(1), [], "guess")
