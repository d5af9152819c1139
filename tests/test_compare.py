"""Ranks over several ranges and frequent values, exact signed-rank probabilities, resamples: against plain versions."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vibrary.operators import compare, conditions, skew


@pytest.mark.parametrize("rows", [200, 1000, 10**6])
def test_ranks_over_ranges(spark, monkeypatch, rows) -> None:  # noqa: ANN001
    """About 25, 5 and 1 ranges; a value of a third of the rows fills several of them."""
    monkeypatch.setattr(skew, "RANGE_ROWS", rows)
    r = np.random.default_rng(9)
    v = np.where(r.random(5000) < 0.34, 2.5, np.where(r.random(5000) < 0.3, np.round(r.normal(size=5000), 1), r.normal(size=5000)))
    data = [(k, g, None if k % 501 == 0 else float(x)) for k, x in enumerate(v) for g in ("a", "b", None)][:12_000]
    df = spark.createDataFrame(data, "k long, g string, v double")
    got = skew.average_ranks(df, ["g"], "v", "r").toPandas()
    want = pd.DataFrame(data, columns=["k", "g", "v"]).dropna(subset=["v"]).fillna({"g": ""})
    want["r"] = want.groupby("g").v.rank()
    both = got.fillna({"g": ""}).merge(want, on=["k", "g"], suffixes=("", "_want"))
    assert len(both) == len(got) == len(want) and np.allclose(both.r, both.r_want)
    cut = skew.in_ranges(df, ["g"], "v")
    assert cut.agg(F.countDistinct("_range")).first()[0] >= min(10, 4000 // rows)
    order = skew.numbered(df.filter("g = 'a' AND v IS NOT NULL"), [], "v", ["k"], "place").toPandas().sort_values("place")
    assert list(order.place) == list(range(len(order))) and order.v.is_monotonic_increasing


def test_more_ranges_than_one_step_compares(spark, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(skew, "RANGE_ROWS", 20)
    df = spark.range(4000).select((F.col("id") * 7919 % 4000).cast("double").alias("v"))
    got = skew.in_ranges(df, [], "v").groupBy("_range").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("_range").collect()
    assert len(got) > 150 and sum(r.n for r in got) == 4000 and all(a.hi < b.lo for a, b in itertools.pairwise(got))
    ranks = skew.average_ranks(df, [], "v", "r").collect()
    assert len(ranks) == 4000 and all(x.r == x.v + 1 for x in ranks)


def test_no_rows_have_no_ranks(spark) -> None:  # noqa: ANN001
    assert skew.average_ranks(spark.createDataFrame([], "g string, v double"), ["g"], "v", "r").collect() == []


@pytest.mark.parametrize("n", range(1, 13))
def test_signed_ranks_by_enumeration(n) -> None:  # noqa: ANN001
    sums = [sum(k for k, up in zip(range(1, n + 1), signs) if up) for signs in itertools.product((0, 1), repeat=n)]
    assert list(compare.signed_rank_counts(n)) == [sums.count(s) for s in range(n * (n + 1) // 2 + 1)]
    for w in range(n * (n + 1) // 4 + 1):
        assert compare.signed_rank_p(w, n) == pytest.approx(min(1.0, 2 * np.mean(np.array(sums) <= w)))


def test_wilcoxon_is_exact_for_few_and_normal_for_many_or_tied(spark) -> None:  # noqa: ANN001
    r = np.random.default_rng(2)
    rows = [("few", float(x), 0.0) for x in (1.0, 2.0, 3.5, 4.0, 5.5)] + [("tied", 1.0, 0.0)] * 5 + [("same", 1.0, -1.0)] * 3
    rows += [("many", float(a), float(b)) for a, b in r.normal(size=(60, 2))]
    got = {x.model_a: x for x in compare.wilcoxon(spark.createDataFrame(rows, "model_a string, a double, b double").withColumn("model_b", F.lit("z"))).collect()}
    assert (got["few"].n, got["few"].w) == (5, 0.0) and got["few"].p == pytest.approx(2 / 32)
    assert got["same"].p == 1.0 and got["same"].n == 0
    assert got["tied"].p == pytest.approx(math.erfc((5 * 6 / 4) / math.sqrt(5 * 6 * 11 / 24 - (125 - 5) / 48) / math.sqrt(2)))
    w, n = got["many"].w, 60
    assert got["many"].p == pytest.approx(math.erfc((n * (n + 1) / 4 - w) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24) / math.sqrt(2)))
    assert compare.signed_rank_p(400, 50) == pytest.approx(math.erfc((637.5 - 400) / math.sqrt(50 * 51 * 101 / 24) / math.sqrt(2)), abs=3e-3)


def test_resamples(spark) -> None:  # noqa: ANN001
    r = np.random.default_rng(6)
    a, b = r.normal(0, 1.0, 700), r.normal(0, 1.3, 700)
    rows = [(g, f"{g}{k}", float(x), float(y)) for g in ("p", "q") for k, (x, y) in enumerate(zip(a, b if g == "p" else a, strict=True))]
    df = spark.createDataFrame(rows, "g string, key string, a double, b double").repartition(5)
    got = {x.g: x for x in compare.bootstrap_rmse(df, 999, by=["g"]).collect()}
    import hashlib

    h = np.array([int(hashlib.md5(f"42:p{k}".encode()).hexdigest()[:8], 16) for k in range(700)], np.uint32)
    w = compare.draws(h, 0, 500)[:, :999]
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:, :200].T) - np.eye(200)).max() < 0.25
    d = np.sqrt(w.T @ a**2 / w.sum(0)) - np.sqrt(w.T @ b**2 / w.sum(0))
    assert got["p"].delta_rmse == pytest.approx(np.sqrt((a**2).mean()) - np.sqrt((b**2).mean()))
    assert (got["p"].ci_lo, got["p"].ci_hi) == pytest.approx(tuple(np.quantile(d, [0.025, 0.975])))
    assert got["q"].delta_rmse == got["q"].ci_lo == got["q"].ci_hi == 0
    one = compare.bootstrap_rmse(df.filter("g = 'p'"), 999).first()
    assert (one.ci_lo, one.ci_hi) == pytest.approx((got["p"].ci_lo, got["p"].ci_hi))


def test_no_band_above_the_highest_frequency(spark) -> None:  # noqa: ANN001
    df = spark.range(2)
    assert conditions.bands_fixed(df, 500.0, 400.0, 100.0).count() == 0 and conditions.bands_fixed(df, 0.0, 200.0, 100.0).count() == 4


@pytest.mark.parametrize("df", [1, 2, 5, 24, 300])
def test_student_by_integration(df) -> None:  # noqa: ANN001
    x = np.linspace(0, 1, 200_001)
    density = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    for t in (0.1, 1.0, 2.5, 6.0):
        y = density * (1 + (x * t) ** 2 / df) ** (-(df + 1) / 2)
        inside = t * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) / 600_000
        assert compare.t_two_sided(t, df) == pytest.approx(1 - 2 * inside, abs=1e-9)


def test_probabilities_of_pairs(spark) -> None:  # noqa: ANN001
    """Of both tests, against t_two_sided of statistics from plain formulas."""
    r = np.random.default_rng(3)
    a, b = r.normal(0.2, 1, 25), r.normal(0, 1, 25)
    df = spark.createDataFrame([("a", "b", float(x), float(y)) for x, y in zip(a, b, strict=True)], "model_a string, model_b string, a double, b double")
    d, e = a - b, a * a - b * b
    got = compare.ttest_corrected(df, 5).first()
    t = d.mean() / math.sqrt((1 / 25 + 1 / 4) * d.var(ddof=1))
    assert (got.t, got.p) == pytest.approx((t, compare.t_two_sided(t, 24)))
    got = compare.diebold_mariano(df, alternative="less").first()
    t = e.mean() / math.sqrt(e.var(ddof=1) / 25) * math.sqrt(24 / 25)
    both = compare.t_two_sided(t, 24)
    assert (got.dm, got.p) == pytest.approx((t, both / 2 if t < 0 else 1 - both / 2))
