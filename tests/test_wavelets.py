"""Responses by block convolution against direct correlation, for chunks shorter and longer than the kernels."""

from __future__ import annotations

import numpy as np
import pytest

from pyspark.sql import functions as F

from vibrary.operators import chunks, spectra, wavelets

FS, F0S, DAMPINGS = 1000.0, [40.0, 210.0], [400.0, 60.0, 20.0]  # kernels of 12, 83 and 250 samples
LENGTHS = {1: 300, 2: 97, 3: 64, 4: 5, 5: 2}


def direct(x: np.ndarray, f0: float, damping: float) -> tuple[float, float]:
    w = wavelets.kernel(f0, damping, FS, max(2, min(len(x), int(5.0 / damping * FS))))
    y = np.abs(np.correlate(x, w, "same"))
    d = y - y.mean()
    v = (d * d).mean()
    return float(np.sqrt((y * y).mean())), float((d**4).mean() / v**2) if v > 1e-30 else 0.0


@pytest.fixture(scope="module")
def signals() -> dict[int, np.ndarray]:
    r = np.random.default_rng(15)
    return {k: r.normal(size=n) for k, n in LENGTHS.items()} | {6: np.zeros(50)}


@pytest.mark.parametrize(("size", "together"), [(7, 1), (33, 4000), (64, 1 << 20), (1000, 1 << 20)])
def test_every_length_of_chunk(spark, signals, monkeypatch, size, together) -> None:  # noqa: ANN001
    monkeypatch.setattr(wavelets, "TOGETHER", together)
    rows = [(k, "AE", i + 3, float(v)) for k, x in signals.items() for i, v in enumerate(x)]
    cut = chunks.to_chunks(spark.createDataFrame(rows, "sweep long, sensor string, i long, v double"), size)
    got = {(r.sweep, r.frequency, r.damping): (r.rms, r.kurtosis) for r in wavelets.wavelet_map(cut, FS, F0S, DAMPINGS, size=size).collect()}
    assert len(got) == len(signals) * len(F0S) * len(DAMPINGS)
    for (k, f0, a), value in got.items():
        assert value == pytest.approx(direct(signals[k], f0, a), rel=1e-9, abs=1e-9), (k, f0, a)


def test_arrays_as_chunks(spark, signals) -> None:  # noqa: ANN001
    rows = [(k, "AE", [float(v) for v in x]) for k, x in signals.items()] + [(8, "AE", None), (9, "AE", [])]
    df = spark.createDataFrame(rows, "sweep long, sensor string, voltage array<double>")
    got = {k: {} for k in signals}
    for r in chunks.to_samples(chunks.from_arrays(df, 10), "v").collect():
        got[r.sweep][r.i] = r.v
    assert {k: list(x) for k, x in signals.items()} == {k: [v for _, v in sorted(x.items())] for k, x in got.items()}
    assert wavelets.wavelet_map(chunks.from_arrays(df.limit(0)), FS, F0S, DAMPINGS).collect() == []


def test_few_bytes_are_work_for_all_cores(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(k, "AE", FS, [float(x) for x in np.random.default_rng(k).normal(size=40)]) for k in range(60)], "sweep long, sensor string, fs double, voltage array<double>").coalesce(1)
    for made in (wavelets.wavelet_map(chunks.from_arrays(df), FS, F0S, DAMPINGS), spectra.infogram(df, [100.0, 250.0], [50.0, 120.0])):
        assert made.select(F.spark_partition_id()).distinct().count() > 4


def test_gains_of_several_bands() -> None:
    f = np.fft.rfftfreq(90, 1 / FS)
    bands = [(1.0, 20.0), (100.0, 130.0), (240.0, 499.99), (499.96, 499.99)]
    assert np.allclose(spectra.band_gains(f, FS, bands), [spectra.band_gain(f, FS, *b) for b in bands], rtol=1e-12, atol=0)
