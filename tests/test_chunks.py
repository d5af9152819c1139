"""Signals in chunks: equal to plain versions and to the SQL whatever the length of the chunks."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vibrary.operators import chunks, signals, skew
from vibrary.plans import queries  # noqa: F401
from vibrary.plans.registry import ORACLES
from vibrary.sources import fixtures

DATA = "/root/testdata/sf0.001"
N = 23


def plain_filled(v: np.ndarray) -> np.ndarray:
    good = np.flatnonzero(np.isfinite(v))
    return np.interp(np.arange(len(v)), good, v[good]) if len(good) else np.zeros(len(v))


def plain_flat(v: np.ndarray) -> int:
    best = run = 0
    for step in np.abs(np.diff(v)) < 1e-10:
        run = run + 1 if step else 0
        best = max(best, run)
    return best


def plain_despiked(v: np.ndarray, z: float, near: int = 5) -> np.ndarray:
    spike = np.abs(v - v.mean()) / v.std() > z if v.std() >= 1e-30 else np.zeros(len(v), bool)
    out = v.copy()
    for k in np.flatnonzero(spike):
        some = np.arange(max(0, k - near), min(len(v), k + near + 1))
        sound = v[some[~spike[some]]]
        out[k] = np.median(sound) if len(sound) else v.mean()
    return out


@pytest.fixture(scope="module")
def waves() -> dict[int, np.ndarray]:
    r = np.random.default_rng(7)
    out = {k: r.normal(0, 1, N) for k in range(8)}
    out[0][[0, 1, 5, 6, 7, 8, 22]] = np.nan
    out[1][:] = np.inf
    out[2][3:17] = 1.5
    out[3][:] = 2.0
    out[4][[4, 11]] = 40
    out[5][10:16] = 30.0
    out[6][[2, 9]] = np.nan, -np.inf
    out[7] = r.integers(0, 2, N).astype(float)
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 6, 7, 11, 12, 22, 23, 24])
def test_any_length_of_chunk(spark, waves, size) -> None:  # noqa: ANN001
    rows = [(k, "AE", i, float(x)) for k, w in waves.items() for i, x in enumerate(w)]
    df = spark.createDataFrame(rows, "sweep long, sensor string, i long, v double")
    got = {k: np.zeros(N) for k in waves}
    for r in signals.fill_nonfinite(df, size).collect():
        got[r.sweep][r.i] = r.v
    full = {k: plain_filled(w) for k, w in waves.items()}
    assert all(np.allclose(got[k], full[k], rtol=0, atol=1e-12) for k in waves)
    df = spark.createDataFrame([(k, "AE", i, float(x)) for k, w in full.items() for i, x in enumerate(w)], df.schema)
    assert {r.sweep: r.saturation_longest_run for r in signals.saturation(df, size=size).collect()} == {k: plain_flat(w) for k, w in full.items()}
    for r in signals.despike(df, 2.0, size=size).collect():
        got[r.sweep][r.i] = r.v
    assert all(np.allclose(got[k], plain_despiked(w, 2.0), rtol=0, atol=1e-12) for k, w in full.items())
    for r in signals.time_features(df, size).collect():
        w = full[r.sweep]
        d = w - w.mean()
        d1, d2 = np.diff(w), np.diff(w, 2)
        want = [w.std(), (w.max() - w.min()) / 2, np.sqrt((w * w).mean())] + ([(d**3).mean() / w.std() ** 3, (d**4).mean() / w.std() ** 4, d1.std() / w.std(), d2.std() / d1.std() / (d1.std() / w.std())] if w.std() > 0 else [0, 0])
        assert np.allclose([x for x in (r.std, r.peak, r.rms, r.skewness, r.kurtosis, r.mobility, r.complexity) if x is not None], want, atol=1e-9)


def plain(rows: list) -> list:
    value = lambda x: round(x, 6) + 0.0 if isinstance(x, float) else x
    return sorted((tuple(map(value, r)) for r in rows), key=str)


@pytest.mark.parametrize("size", [1, 2, 9, 40])
def test_chunks_are_as_in_sql(spark, size) -> None:  # noqa: ANN001
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    out, quality = signals.clean(fixtures.samples(spark, DATA), size=size)
    for df, name in ((out, "sig_clean"), (quality, "sig_quality_table")):
        want = con.sql(ORACLES[name])
        assert plain(df.select(want.columns).collect()) == plain(want.fetchall())


def test_gaps_in_numbers_and_no_samples(spark) -> None:  # noqa: ANN001
    rows = [(1, "AE", i, float(i)) for i in (3, 50, 51, 1000)] + [(1, "AE", 20, None), (1, "AE", 900, float("nan"))]
    df = spark.createDataFrame(rows, "sweep long, sensor string, i long, v double")
    for size in (1, 10, 10_000):
        assert {r.i: r.v for r in signals.fill_nonfinite(df, size).collect()} == {i: float(i) for i in (3, 20, 50, 51, 900, 1000)}
    assert signals.clean(df.limit(0))[0].collect() == [] and signals.time_features(df.limit(0)).collect() == []


def test_chunks_are_no_longer_than_asked(spark) -> None:  # noqa: ANN001
    df = spark.range(1000).select(F.lit(1).alias("sweep"), F.lit("AE").alias("sensor"), F.col("id").alias("i"), F.rand(3).alias("v"))
    out, filled, _ = chunks.repaired(df, size=64)
    assert out.count() == 16 and out.agg(F.max(F.size("v"))).first()[0] == 64 and filled.agg(F.max(F.size("head") + F.size("tail"))).first()[0] == 10


def test_quantiles_by_key(spark) -> None:  # noqa: ANN001
    shares = [0.0, 0.001, 0.25, 0.5, 0.999, 1.0]
    df = spark.range(40_000).select((F.col("id") % 3 * (F.col("id") % 2)).alias("k"), F.expr("cast(xxhash64(id) % 5000 as double)").alias("v"))
    few = spark.createDataFrame([(9, 4.0), (9, None), (8, None), (7, 1.0), (7, 2.0), (None, 3.0)], "k long, v double")
    for rows in (df, few, df.withColumn("v", F.lit(2.5)), df.withColumn("v", F.floor(F.col("v") / 1000))):
        want = {r.k: [r[f"q{j}"] for j, _ in enumerate(shares)] for r in rows.filter("v is not null").groupBy("k").agg(*(F.percentile("v", s).alias(f"q{j}") for j, s in enumerate(shares))).collect()}
        for accuracy in (20, 1000):
            got = {r.k: r.quantiles for r in skew.keyed_quantiles(rows, ["k"], "v", shares, accuracy).collect()}
            assert got.keys() == want.keys() - {None} and all(np.allclose(got[k], want[k], atol=1e-9) for k in got)
    for rows in (df, few, df.limit(7), df.withColumn("v", F.lit(2.5))):
        if rows.count():
            every = skew.quantiles(rows, ["v"], shares)["v"]
            assert np.allclose(every, rows.agg(F.percentile("v", F.array(*map(F.lit, shares)))).first()[0])
