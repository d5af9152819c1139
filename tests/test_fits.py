"""Queries that SQL does not express, against plain versions on the smallest tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vibrary.operators import chunks, compare, extract, models, signals, skew, spectra, tables, wavelets
from vibrary.operators import trees as G
from vibrary.plans import extract_queries, more_queries, queries
from vibrary.plans.registry import QUERIES
from vibrary.sources import fixtures

DATA = "/root/testdata/sf0.001"
INPUTS = more_queries.INPUTS


@pytest.fixture(scope="module")
def table(spark) -> pd.DataFrame:  # noqa: ANN001
    return fixtures.feature_table(spark, DATA).toPandas()


def scaled(train: pd.DataFrame, rows: pd.DataFrame, columns: list[str]) -> np.ndarray:
    return ((rows[columns] - train[columns].mean()) / train[columns].std(ddof=0)).to_numpy()


def net(x: np.ndarray, y: np.ndarray, alpha: float, l1: float) -> tuple[np.ndarray, float]:
    """Elastic net by proximal gradient steps on the rows."""
    w, b, n = np.zeros(x.shape[1]), y.mean(), len(y)
    step = 1 / (np.linalg.norm(x, 2) ** 2 / n + alpha * (1 - l1))
    for _ in range(3000):
        g = x.T @ (x @ w + b - y) / n + alpha * (1 - l1) * w
        w = w - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * alpha * l1, 0)
    return w, b


def test_elastic_net_by_rows(spark, table) -> None:  # noqa: ANN001
    got = {None if pd.isna(r.fold) else int(r.fold): r for r in QUERIES["elastic_net_cv"](spark, DATA).toPandas().itertuples()}
    fold, inner = table.file % 5, table.file // 5 % 5
    for held in (0, 3):
        train, test = table[fold != held], table[fold == held]
        chosen = got[held]
        w, b = net(scaled(train, train, INPUTS), train.target.to_numpy(), chosen.alpha, chosen.l1_ratio)
        error = test.target - (scaled(train, test, INPUTS) @ w + b)
        assert chosen.rmse == pytest.approx(math.sqrt((error**2).mean()), abs=2e-5) and chosen.n == len(test)

        def inner_error(alpha: float, l1: float) -> float:
            out = []
            for i in range(5):
                own, rest = train[inner[train.index] == i], train[inner[train.index] != i]  # noqa: B023
                w, b = net(scaled(rest, rest, INPUTS), rest.target.to_numpy(), alpha, l1)
                out.append(((own.target - (scaled(rest, own, INPUTS) @ w + b)) ** 2).mean())
            return sum(out)

        best = inner_error(chosen.alpha, chosen.l1_ratio)
        assert all(best <= inner_error(a, l) * (1 + 1e-6) for a, l in ((1e-4, 0.1), (0.01, 0.5), (0.1, 1.0)))  # noqa: E741


def test_poly_ridge_by_rows(spark, table) -> None:  # noqa: ANN001
    got = {None if pd.isna(r.fold) else int(r.fold): r for r in QUERIES["poly_ridge_cv"](spark, DATA).toPandas().itertuples()}
    fold = table.file % 5
    for held in (1, 4):
        train, test = table[fold != held], table[fold == held]

        def products(rows: pd.DataFrame) -> np.ndarray:
            z = scaled(train, rows, INPUTS)  # noqa: B023
            return np.column_stack([z, *(z[:, i] * z[:, j] for i in range(len(INPUTS)) for j in range(i, len(INPUTS)))])

        x, y = products(train), train.target.to_numpy()
        m = x.mean(0)
        errors = {}
        for alpha in models.RIDGE_ALPHAS:
            inverse = np.linalg.inv((x - m).T @ (x - m) + alpha * np.eye(x.shape[1]))
            w = inverse @ (x - m).T @ (y - y.mean())
            leverage = 1 / len(y) + np.einsum("ij,jk,ik->i", x - m, inverse, x - m)
            errors[alpha] = (((y - y.mean() - (x - m) @ w) / (1 - leverage)) ** 2).sum(), w
        best = min(errors, key=lambda a: errors[a][0])
        error = test.target.to_numpy() - (y.mean() + (products(test) - m) @ errors[best][1])
        assert got[held].alpha == pytest.approx(best) and got[held].rmse == pytest.approx(math.sqrt((error**2).mean()), abs=1e-5)


def test_bayesian_ridge_by_rows(spark, table) -> None:  # noqa: ANN001
    got = QUERIES["bayesian_ridge_cv"](spark, DATA).toPandas()
    held = got[got.fold == 2]
    train = table[table.file % 5 != 2]
    x, y = scaled(train, train, INPUTS), train.target.to_numpy()
    noise, weight = len(y) / max(((y - y.mean()) ** 2).sum(), 1e-12), 1.0
    for _ in range(300):
        cov = np.linalg.inv(noise * x.T @ x + weight * np.eye(x.shape[1]))
        w = noise * cov @ x.T @ (y - y.mean())
        used = x.shape[1] - weight * np.trace(cov)
        weight, noise = (used + 1e-6) / (w @ w + 1e-6), (len(y) - used + 1e-6) / (((y - y.mean() - x @ w) ** 2).sum() + 1e-6)
    test = table[table.file % 5 == 2]
    z = scaled(train, test, INPUTS)
    want = pd.DataFrame({"yhat": y.mean() + z @ w, "std": np.sqrt(1 / noise + np.einsum("ij,jk,ik->i", z, np.linalg.inv(noise * x.T @ x + weight * np.eye(x.shape[1])), z))})
    assert np.allclose(np.sort(held.yhat), np.sort(want.yhat), atol=1e-4) and np.allclose(np.sort(held["std"]), np.sort(want["std"]), atol=1e-4)


def test_intervals_of_mean_and_value(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "a double, b double")
    fit = {"w": np.array([1.0, 2.0]), "b": 0.5, "mean": np.array([0.0, 1.0]), "cov": np.array([[0.25, 0.0], [0.0, 1.0]]), "noise": 4.0}
    value, mean = (models.predict_interval(df, ["a", "b"], fit, p).orderBy("a").collect() for p in (True, False))
    assert [r.yhat for r in value] == [2.5, 4.5] and [r.std for r in mean] == [0.0, 1.0] and [r.std for r in value] == pytest.approx([2.0, math.sqrt(5)])


def test_pca_by_rows(spark, table) -> None:  # noqa: ANN001
    got = QUERIES["pca_project"](spark, DATA).toPandas()
    z = scaled(table, table, INPUTS)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    order = np.argsort(-values)
    for k in (0, 1):
        v = vectors[:, order[k]]
        assert np.allclose(np.sort(got[f"pc{k + 1}"]), np.sort(z @ (v * np.sign(v[0]))), atol=1e-4)
        assert got[f"explained{k + 1}"].iloc[0] == pytest.approx(values[order[k]] / values.sum(), abs=1e-5)


def test_maps_by_cell(spark) -> None:  # noqa: ANN001
    rng = np.random.default_rng(2)
    x = rng.normal(size=100)
    df = spark.createDataFrame([(1, "AE", 1000.0, x.tolist()), (2, "AE", 1000.0, [])], "sweep long, sensor string, fs double, voltage array<double>")
    got = {(r.centre, r.width): r.info for r in spectra.infogram(df, [100.0, 250.0, 480.0], [50.0, 120.0, 230.0]).filter("sweep = 1").collect()}
    assert len(got) == 9
    for (c, w), info in got.items():
        lo, hi = c - w / 2, c + w / 2
        if lo < 1 or hi >= 500:
            assert info is None
            continue
        f = np.fft.rfftfreq(100, 1 / 1000)
        band = np.fft.irfft(np.fft.rfft(x) * spectra.band_gain(f, 1000.0, lo, hi), 100)
        ses = np.abs(np.fft.rfft(np.abs(spectra.analytic(band)) ** 2))[1:]
        p = ses / ses.sum()
        assert info == pytest.approx(math.log(len(p)) - 1 + 0.5772156649015329 + sum(v * math.log(v) for v in p if v > 0))
    rows = {(r.frequency, r.damping): (r.rms, r.kurtosis) for r in wavelets.wavelet_map(chunks.from_arrays(df), 1000.0, [50.0, 200.0], [20.0]).filter("sweep = 1").collect()}
    for (f0, a), (rms, kurtosis) in rows.items():
        t = np.arange(100) / 1000
        kernel = np.exp(-a * t + 2j * np.pi * f0 * t)
        kernel /= math.sqrt(sum(abs(kernel) ** 2))
        y = np.array([abs(sum(x[i + j - 50] * np.conj(kernel[j]) for j in range(100) if 0 <= i + j - 50 < 100)) for i in range(100)])
        assert rms == pytest.approx(math.sqrt((y * y).mean())) and kurtosis == pytest.approx(((y - y.mean()) ** 4).mean() / y.var() ** 2)


def test_blur_fills_and_restores_gaps(spark) -> None:  # noqa: ANN001
    cells = [(y, x, None if (y, x) == (2, 3) else float(y + 2 * x)) for y in range(6) for x in range(7)]
    df = spark.createDataFrame(cells, "y long, x long, z double")
    got = {(int(r.y), int(r.x)): r.gradient for r in spectra.map_gradient(df, 0.5).collect()}
    assert got[2, 3] is None and len(got) == 42 and got[4, 5] == pytest.approx(math.sqrt(5), rel=0.2)
    flat = spectra.blurred(spark.createDataFrame([(y, x, 3.0) for y in range(4) for x in range(4)], "y long, x long, z double"))
    assert all(r.z == pytest.approx(3.0) and not r.gap for r in flat.collect())


def test_band_shapes() -> None:
    f = np.linspace(0, 500, 101)
    gain = lambda lo, hi: spectra.band_gain(f, 1000.0, lo, hi)
    assert gain(0, 100)[0] == 1 and gain(0, 100)[-1] < 1e-6 and not gain(500, 900).any()
    high = gain(300, 200)
    assert high[0] == 0 and high[60] == pytest.approx(0.5) and high[-1] > 0.999 and (np.diff(high) >= 0).all()
    assert np.allclose(gain(499.99, 2000), gain(499.99, 10)) and gain(100, 2000)[50] > 0.99


def test_array_cleaning_is_the_long_one(spark) -> None:  # noqa: ANN001
    samples = fixtures.samples(spark, DATA)
    long, quality = signals.clean(samples)
    arrays = extract.clean_arrays(spectra.to_arrays(samples, 1000.0))
    want = {(r.sweep, r.sensor): r for r in quality.collect()}
    for r in arrays.collect():
        w = want[r.sweep, r.sensor]
        assert (r.rejection_reason, r.is_clipped, r.saturation_longest_run, r.n_nan_inf_replaced, r.n_outlier_samples_replaced) == (w.rejection_reason, w.is_clipped, w.saturation_longest_run, w.n_nan_inf_replaced, w.n_outlier_samples_replaced)
    a = {(r.sweep, r.i): r.v for r in long.collect()}
    b = {(r.sweep, i): v for r in arrays.filter("is_valid").collect() for i, v in enumerate(r.voltage)}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    off = extract.Cleaning(min_length=1, fix_nonfinite=False, check_clipping=False, check_saturation=False, spikes=None)
    out, found = extract.cleaned(np.array([1.0, np.nan, 3.0]), off)
    assert np.isnan(out[1]) and found["n_nan_inf_replaced"] == 0


def test_quantiles_and_ranks(spark) -> None:  # noqa: ANN001
    rng = np.random.default_rng(3)
    x = np.round(rng.exponential(size=5000), 2)
    y = np.where(rng.random(5000) < 0.4, 7.0, rng.normal(size=5000))
    df = spark.createDataFrame([(float(a), float(b), k) for k, (a, b) in enumerate(zip(x, y, strict=True))], "x double, y double, k long")
    got = skew.quantiles(df.withColumn("none", df["x"] * None), ["x", "y", "none"], [0.0, 0.25, 0.5, 0.999, 1.0])
    assert got["none"] == [None] * 5
    for c, v in (("x", x), ("y", y)):
        assert np.allclose(got[c], np.quantile(v, [0.0, 0.25, 0.5, 0.999, 1.0]))
    long = tables.melted(df, ["x", "y"], ["k"])
    ranks = skew.average_ranks(long, ["feature"], "value", "r").toPandas()
    for c, v in (("x", x), ("y", y)):
        own = ranks[ranks.feature == c].sort_values("k").r.to_numpy()
        assert np.allclose(own, pd.Series(v).rank().to_numpy())
    order = skew.numbered(df, [], "y", ["k"], "place").toPandas().sort_values("place")
    assert list(order.place) == list(range(5000)) and order.y.is_monotonic_increasing
    both = tables.spearman_matrix(df, ["x", "y"], ["k"]).filter("a = 'x' AND b = 'y'").first().rho
    assert both == pytest.approx(pd.Series(x).rank().corr(pd.Series(y).rank()))


def test_wide_gram(spark) -> None:  # noqa: ANN001
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 22))
    df = spark.createDataFrame([(*map(float, r), k % 3) for k, r in enumerate(x)], ", ".join([*(f"c{k} double" for k in range(22)), "fold int"]))
    got = models.gram(df, [f"c{k}" for k in range(21)], "c21", ["fold"])
    one = np.column_stack([np.ones(300), x])
    assert len(got) == 3 and all(np.allclose(g, one[np.arange(300) % 3 == k[0]].T @ one[np.arange(300) % 3 == k[0]]) for k, g in got.items())
    assert np.allclose(models.gram(df, [f"c{k}" for k in range(21)], "c21", [])[()], one.T @ one)
    r = {(x.a, x.b): x.r for x in tables.corr_matrix(df, [f"c{k}" for k in range(22)]).collect()}
    assert np.allclose([[r[f"c{i}", f"c{j}"] for j in range(22)] for i in range(22)], np.corrcoef(x.T))


def test_redundant_features_by_visits() -> None:
    """The closed form against visits one by one, on random tables with distinct worths."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        names = [f"f{k}" for k in range(7)]
        pairs = {}
        for i, a in enumerate(names):
            for b in names[i:]:
                pairs[a, b] = pairs[b, a] = 1.0 if a == b else float(rng.choice([0.2, 0.95]))
        factors = {c: float(rng.choice([2.0, 20.0])) for c in names}
        worth = dict(zip(names, rng.permutation(7).astype(float), strict=True))
        there = set(names)
        for c in sorted(names, key=worth.get):
            for d in names:
                if c in there and d in there and c != d and pairs[c, d] >= 0.9 and factors[d] >= 10:
                    there.discard(d if worth[c] >= worth[d] else c)
        assert tables.reduce_redundant(pairs, factors, worth, names) == [c for c in names if c in there]


def test_probabilities(spark) -> None:  # noqa: ANN001
    rows = [("A", "B", float(a), float(b)) for a, b in np.random.default_rng(6).normal(size=(60, 2)) * [1.0, 1.3]]
    df = spark.createDataFrame(rows, "model_a string, model_b string, a double, b double")
    both, less, greater = (compare.diebold_mariano(df, alternative=x).first() for x in ("two-sided", "less", "greater"))
    assert less.p + greater.p == pytest.approx(1) and both.p == pytest.approx(2 * min(less.p, greater.p))
    w = compare.wilcoxon(df).first()
    d = np.array([abs(r[2]) - abs(r[3]) for r in rows])
    r = pd.Series(np.abs(d)).rank().to_numpy()
    low = min(r[d > 0].sum(), r[d < 0].sum())
    assert w.w == pytest.approx(low) and w.p == pytest.approx(math.erfc(abs(low - 60 * 61 / 4) / math.sqrt(60 * 61 * 121 / 24) / math.sqrt(2)))
    same = compare.wilcoxon(spark.createDataFrame([("A", "B", 1.0, 1.0)], df.schema)).first()
    assert (same.n, same.w, same.p) == (0, 0.0, 1.0)
    r = spark.createDataFrame([("x", 0.5), ("y", 1.0), ("z", 0.0)], "feature string, r double")
    p = {x.feature: x.p_r for x in compare.correlation_p(r, "r", 12).collect()}
    t = 0.5 * math.sqrt(10 / 0.75)
    assert p["x"] == pytest.approx(compare.t_two_sided(t, 10)) and p["y"] == pytest.approx(0, abs=1e-9) and p["z"] == 1.0


def test_pair_tests_put_the_tests_together(spark) -> None:  # noqa: ANN001
    got = QUERIES["pair_tests"](spark, DATA).first()
    assert got.dm_stat == pytest.approx(QUERIES["diebold_mariano"](spark, DATA).first().dm, abs=1e-4) and got.cv_t_stat == pytest.approx(QUERIES["ttest_corrected"](spark, DATA).first().t, abs=1e-4)
    assert got.ci_95_lo < got.delta_rmse < got.ci_95_hi < 0 and got.reject is True


def test_summary_of_fits(spark) -> None:  # noqa: ANN001
    got = {r.model: r for r in QUERIES["fit_summary"](spark, DATA).collect()}
    cv = QUERIES["elastic_net_cv"](spark, DATA).filter("fold IS NULL").first()
    assert (got["elastic_net"].rmse, got["elastic_net"].alpha) == (cv.rmse, cv.alpha) and got["elastic_net"].n_features == 4 >= got["elastic_net"].n_nonzero
    assert got["poly_ridge"].n_features == 14 and got["poly_ridge"].l1_ratio is None


def test_boosted_trees_and_nested_scores(spark, table) -> None:  # noqa: ANN001
    out, trees = G.gbt_cv(more_queries.folded(spark, DATA), INPUTS, "target", "fold", 5, **more_queries.SMALL_TREES)
    rows = out.toPandas()
    assert len(rows) == len(table) and len(trees) == 5 and min(trees) >= 1
    got = {None if pd.isna(r.fold) else int(r.fold): r for r in QUERIES["gbt_cv"](spark, DATA).toPandas().itertuples()}
    for held in (None, 0, 4):
        own = rows if held is None else rows[rows.fold == held]
        assert got[held].n == len(own) and got[held].rmse == pytest.approx(math.sqrt(((own.target - own.yhat) ** 2).mean()), abs=1e-5) and got[held].rmse < table.target.std()
    assert got[None].n_trees == max(1, round(np.mean(trees)))
    tuned = QUERIES["gbt_tune"](spark, DATA).collect()
    assert len({(r.max_depth, r.step_size, r.least_rows) for r in tuned}) == len(tuned) == 27
    assert sorted([r.round for r in tuned]) == [0] * 18 + [1] * 6 + [2] * 2 + [3] and {(r.round, r.n_trees) for r in tuned} == {(0, 1), (1, 3), (2, 9), (3, 27)}
    assert [r.round for r in tuned if r.best] == [3]
    used = {r.feature: r for r in QUERIES["shap_tree"](spark, DATA).collect()}
    assert sum(r.importance for r in used.values()) == pytest.approx(1, abs=1e-5) and max(used, key=lambda c: used[c].rise) == max(INPUTS, key=lambda c: abs(table[c].corr(table.target)))


def test_nested_scores_by_rows(spark, table) -> None:  # noqa: ANN001
    got = QUERIES["nested_cv_scores"](spark, DATA).toPandas()
    assert got.groupby(["model", "feature_set", "repeat"]).size().eq(5).all() and got.feature_set.nunique() == 3 and got.repeat.nunique() == 5
    folds = models.kfold(fixtures.feature_table(spark, DATA), ["file", "sweep"], 5, repeats=5).filter("repeat = 2").toPandas()
    rows = table.merge(folds, on=["file", "sweep"])
    one = got[(got.model == "elastic_net") & (got.feature_set == "rates") & (got.repeat == 2) & (got.fold == 1)].iloc[0]
    train, test = rows[rows.fold != 1], rows[rows.fold == 1]
    columns = more_queries.SETS["rates"]
    w, b = net(scaled(train, train, columns), train.target.to_numpy(), one.alpha, one.l1_ratio)
    assert one.rmse == pytest.approx(math.sqrt(((test.target - (scaled(train, test, columns) @ w + b)) ** 2).mean()), abs=2e-5)
    best = QUERIES["best_params"](spark, DATA).toPandas().merge(got.groupby(["model", "feature_set"]).rmse.min().reset_index(), on=["model", "feature_set"])
    assert len(best) == 6 and np.allclose(best.rmse_x, best.rmse_y)


def test_permuted_columns(spark, table) -> None:  # noqa: ANN001
    """The column that the target hangs on most matters most; one that it does not hang on hardly."""
    rise = {r.feature: r.rise for r in QUERIES["permutation_importance"](spark, DATA).collect()}
    worth = {c: abs(table[c].corr(table.target)) for c in INPUTS}
    assert max(rise, key=rise.get) == max(worth, key=worth.get) and abs(rise["price"]) < 0.02
    assert extract_queries and queries


def test_search_does_not_hang_on_threads(spark) -> None:  # noqa: ANN001
    f = more_queries.folded(spark, DATA).withColumn("inner", (F.col("file") % 2).cast("int")).limit(1500).cache()
    settings = G.drawn_settings({"maxDepth": (1, 3), "stepSize": (0.02, 0.5)}, 6)
    assert all(1 <= s["maxDepth"] <= 3 and 0.02 <= s["stepSize"] <= 0.5 for s in settings)
    found = [sorted(map(tuple, G.gbt_search(f, more_queries.INPUTS, "target", "inner", 2, settings, keep=2, threads=n).collect())) for n in (1, 5)]
    assert found[0] == found[1] and len(found[0]) == 6 and sum(r[-1] for r in found[0]) == 1
    # a setting's error is that of a fit by itself
    model = G.learner("target", **settings[0], maxIter=1)
    plain = [model.fit(G.assembled(f.filter(F.col("inner") != k), more_queries.INPUTS)).transform(G.assembled(f.filter(F.col("inner") == k), more_queries.INPUTS)).select(F.sqrt(F.avg((F.col("target") - F.col("prediction")) ** 2))).first()[0] for k in (0, 1)]
    first = G.gbt_search(f, more_queries.INPUTS, "target", "inner", 2, settings[:1], keep=2).first()
    assert first.rmse == pytest.approx(sum(plain) / 2) and first.best


def test_fits_on_cells_are_those_on_rows(spark, monkeypatch) -> None:  # noqa: ANN001
    """Of columns with few values, and without draws, cells give the same trees, stops and errors as rows."""
    r = np.random.default_rng(20)
    a, b, fold = r.integers(0, 6, 3000), r.integers(0, 8, 3000), r.integers(0, 3, 3000)
    y = np.where(a > 3, 2.0, 0.0) + np.where((b > 2) & (a > 1), 1.0, 0.0) + 0.1 * b + r.normal(size=3000) * 0.3
    df = spark.createDataFrame([(float(i), float(j), float(v), int(k)) for i, j, v, k in zip(a, b, y, fold, strict=True)], "a double, b double, y double, fold int").persist()
    exact = {"subsamplingRate": 1.0, "featureSubsetStrategy": "all", "maxDepth": 3, "minInstancesPerNode": 200, "stepSize": 0.4}
    found = []
    for rows in (10**9, 0):
        monkeypatch.setattr(G, "ROWS", rows)
        scores = G.gbt_scores(df, ["a", "b"], "y", "fold", 3, **exact, maxIter=8).orderBy("fold").collect()
        tuned = G.gbt_search(df, ["a", "b"], "y", "fold", 3, G.every_setting({"maxDepth": [1, 3], "stepSize": [0.1, 0.5]}), keep=2, **{k: v for k, v in exact.items() if k not in ("maxDepth", "stepSize")}).collect()
        found.append([v for x in (*scores, *tuned) for v in x])
        model, cuts = G.gbt_final(df, ["a", "b"], "y", [5], **exact)
        found[-1] += [p.prediction for p in model.transform(G.assembled(df, ["a", "b"], cuts)).orderBy("a", "b", "y").select("prediction").collect()]
        assert (cuts is None) == bool(rows) and max(x.n_trees for x in scores) > 1
    assert [v is None for v in found[0]] == [v is None for v in found[1]]
    assert [v for v in found[0] if v is not None] == pytest.approx([v for v in found[1] if v is not None], rel=1e-9)


def test_metrics_of_groups_and_all_in_one_pass(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(0, 1.0, 1.5), (0, 2.0, 2.0), (1, 5.0, 4.0)], "fold int, y double, yhat double")
    both = {r.fold: tuple(r)[1:] for r in models.regression_metrics(df, "y", "yhat", ["fold"], total=True).collect()}
    assert both == {r.fold: tuple(r)[1:] for r in models.regression_metrics(df, "y", "yhat", ["fold"]).collect()} | {None: tuple(models.regression_metrics(df, "y", "yhat").first())}


def test_columns_are_moved_in_one_pass(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(k, float(k % 7), float(k % 5), 2.0 * (k % 7)) for k in range(300)], "k long, a double, b double, y double")
    calls = []

    def predict(d):  # noqa: ANN001, ANN202
        calls.append(1)
        return d.withColumn("yhat", 2 * F.col("a"))

    rise = {r.feature: r.rise for r in models.permutation_importance(df, ["a", "b"], "y", predict, ["k"]).collect()}
    assert len(calls) == 1 and rise["a"] > 1 and rise["b"] == 0


def test_rows_look_up_predictions_of_their_cells_in_one_scan(spark, monkeypatch, tmp_path) -> None:  # noqa: ANN001
    monkeypatch.setattr(G, "ROWS", 0)
    r = np.random.default_rng(19)
    a, b, fold = r.normal(size=2000), r.integers(0, 4, 2000), r.integers(0, 4, 2000)
    y = 2 * a + 0.5 * b + r.normal(size=2000) * 0.2
    spark.createDataFrame([(i, float(p), float(q), float(v), int(k)) for i, (p, q, v, k) in enumerate(zip(a, b, y, fold, strict=True))], "i int, a double, b double, y double, fold int").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t").withColumn("fold", F.when(F.col("fold") < 3, F.col("fold")))  # and some of no fold, which nothing predicts
    found = []
    for numbers in (10**9, 0):
        monkeypatch.setattr(G, "LOOKED_UP", numbers)
        out, trees = G.gbt_cv(df, ["a", "b"], "y", "fold", 3, maxIter=6, maxDepth=3, stepSize=0.4)
        leaves = out._jdf.queryExecution().withCachedData().collectLeaves()
        scans = sum(leaves.apply(k).getClass().getSimpleName() == "LogicalRelation" for k in range(leaves.size()))
        found.append((out.columns, trees, sorted(map(tuple, out.collect())), scans))
    assert found[0][:3] == found[1][:3] and found[0][0] == [*df.columns, "yhat"] and max(found[0][1]) > 1
    assert len(found[0][2]) == int((fold < 3).sum()) and len({row[-1] for row in found[0][2]}) > 10
    assert [x[3] for x in found] == [1, 3]
