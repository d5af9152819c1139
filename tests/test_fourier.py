"""Transforms by blocks against numpy, for lengths with and without small factors."""

from __future__ import annotations

import numpy as np
import pytest

from vibrary.operators import chunks, extract, fourier, spectra

LENGTHS = {1: 64, 2: 97, 3: 120, 4: 101, 5: 5, 6: 1, 7: 36, 8: 97, 9: 2, 10: 128, 11: 118}


@pytest.fixture(scope="module")
def signals() -> dict[int, np.ndarray]:
    r = np.random.default_rng(11)
    return {k: r.normal(0, 1, n) + np.sin(np.arange(n)) for k, n in LENGTHS.items()} | {12: np.zeros(40)}


@pytest.fixture(scope="module")
def cut(spark, signals):  # noqa: ANN001, ANN201
    rows = [(k, "AE", i, float(v)) for k, x in signals.items() for i, v in enumerate(x)]
    return chunks.to_chunks(spark.createDataFrame(rows, "sweep long, sensor string, i long, v double"), 17)


def whole(rows, signals: dict, at: str, value: str) -> dict[int, np.ndarray]:  # noqa: ANN001
    out = {k: np.full(len(x), np.nan) for k, x in signals.items()}
    for r in rows.collect():
        out[r.sweep][r[at]] = r[value]
    return out


def test_factors() -> None:
    assert fourier.split(120, 12) == (10, 12) and fourier.split(120, 10) is None and fourier.split(97, 50) is None and fourier.split(1 << 36, 1 << 18) == (1 << 18, 1 << 18)


@pytest.mark.parametrize("limit", [16, 50, 1 << 18])
def test_transform_and_back(signals, cut, limit) -> None:  # noqa: ANN001
    """Limit 16: four steps for 64, 120, 128 and 36, chirps of 256 numbers in blocks for 97, 101 and 118."""
    found = fourier.transform(fourier.pieces(cut), limit=limit)
    got = {k: np.full(len(x), np.nan, complex) for k, x in signals.items()}
    for r in found.collect():
        assert len(r.at) <= limit
        got[r.sweep][r.at] = np.array(r.re) + 1j * np.array(r.im)
    assert all(np.allclose(got[k], np.fft.fft(x), atol=1e-9) for k, x in signals.items())
    back = fourier.transform(found, inverse=True, limit=limit)
    for r in back.collect():
        assert np.allclose(signals[r.sweep][r.at], r.re, atol=1e-10) and np.allclose(r.im, 0, atol=1e-10)


@pytest.mark.parametrize("limit", [16, 1 << 18])
def test_bands_and_envelopes(signals, cut, limit) -> None:  # noqa: ANN001
    env = whole(chunks.to_samples(fourier.envelope(cut, limit), "v"), signals, "i", "v")
    assert all(np.allclose(env[k], np.abs(spectra.analytic(x)), atol=1e-9) for k, x in signals.items())
    band = whole(chunks.to_samples(fourier.bandpass(cut, 1000.0, 50.0, 200.0, limit=limit), "v"), signals, "i", "v")
    want = lambda x: np.fft.irfft(np.fft.rfft(x) * spectra.band_gain(np.fft.rfftfreq(len(x), 1e-3), 1000.0, 50.0, 200.0), len(x))
    assert all(np.allclose(band[k], want(x), atol=1e-9) for k, x in signals.items())


@pytest.mark.parametrize("limit", [16, 1 << 18])
def test_statistics_of_spectra(signals, cut, limit) -> None:  # noqa: ANN001
    got = {r.sweep: r for r in fourier.frequency_features(cut, 1000.0, limit).collect()}
    for k, x in signals.items():
        mag = np.abs(np.fft.fft(x))[: len(x) // 2]
        want = extract.frequency_statistics(mag, np.arange(len(mag)) * 1000.0 / len(x))
        assert np.allclose([got[k][c] for c in extract.FREQUENCY], want, rtol=1e-7, atol=1e-9), k


def test_no_signals(cut) -> None:  # noqa: ANN001
    assert fourier.spectrum(cut.limit(0), 1000.0).collect() == [] and fourier.frequency_features(cut.limit(0), 1000.0).collect() == []
