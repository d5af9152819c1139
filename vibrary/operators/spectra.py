"""Spectra, band limits and envelopes of array signals (sweep, sensor, fs, voltage), and statistics of spectra.

Signals are transformed row by row in Arrow batches without a shuffle; the long results aggregate in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .signals import KEY

NPERSEG, ORDER, TINY = 4096, 5, 1e-30
#: Samples by cells of a map up to which gains are kept for the next signal of that length.
KEPT = 1 << 17
#: By how much the entropy of exponentially distributed shares falls short of the largest: 1 less the Euler constant.
NOISE_LOSS = 1 - 0.5772156649015329


def to_arrays(samples: DataFrame, fs: float) -> DataFrame:
    """Long samples as one row a signal."""
    ordered = F.array_sort(F.collect_list(F.struct("i", "v")))
    return samples.groupBy(*KEY).agg(F.transform(ordered, lambda s: s["v"]).alias("voltage")).select(*KEY, F.lit(fs).alias("fs"), "voltage")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt over all cores by a hash of by. Tasks are made by bytes, so where much is computed of few bytes they would be few and long."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)


def each_signal(df: DataFrame, make: Callable[[np.ndarray, float], dict[str, np.ndarray]], fields: str) -> DataFrame:
    """Key columns, fs and what make returns for each row's signal, as array columns."""
    kinds = dict(x.split(" ") for x in fields.split(", "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                made = [make(np.array(v.as_py() or [], float), fs.as_py()) for v, fs in zip(part.column(3), part.column(2), strict=True)]
                ends = {k: np.cumsum([0, *(len(m[k]) for m in made)]) for k in kinds}
                columns = [pa.ListArray.from_arrays(pa.array(ends[k], pa.int32()), pa.array(np.concatenate([np.asarray(m[k], float) for m in made]))) for k in kinds]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], names=[*KEY, "fs", *kinds])

    head = df.select(*KEY, F.col("fs").cast("double").alias("fs"), "voltage")
    types = dict(head.dtypes)
    return head.mapInArrow(run, ", ".join([*(f"{k} {types[k]}" for k in KEY), "fs double", *(f"{k} array<double>" for k in kinds)]))


def spectrum(df: DataFrame) -> DataFrame:
    """One row for each frequency bin (k, f, mag): magnitudes of the transform, with the zero bin and without the Nyquist bin, not scaled."""
    mags = each_signal(df, lambda x, fs: {"mag": np.abs(np.fft.fft(x))[: len(x) // 2] if len(x) else x, "n": np.array([float(len(x))])}, "mag array, n array")
    rows = mags.select(*KEY, "fs", F.col("n")[0].alias("n"), F.posexplode("mag").alias("k", "mag"))
    return rows.select(*KEY, "k", (F.col("k") * F.col("fs") / F.col("n")).alias("f"), "mag")


def band_gain(f: np.ndarray, fs: float, lo: float, hi: float, order: int = ORDER) -> np.ndarray:
    """Gain of a zero-phase Butterworth band, as of filtering forth and back: 1 / (1 + W ** 2 order) with warped frequencies.

    The upper limit is held below half the sampling rate. A band without a lower limit is a lowpass, one above half the
    rate silent, one whose upper limit is not above the lower a highpass.
    """
    low, high = lo / (fs / 2), min(hi / (fs / 2), 0.9999)
    if low >= 1:
        return np.zeros(len(f))
    w = np.tan(np.pi * np.minimum(f / fs, 0.4999999))
    below, top = math.tan(math.pi * max(low, 0) / 2), math.tan(math.pi * high / 2)
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        if low <= 0:
            return 1 / (1 + (w / top) ** (2 * order))
        warped = below / w if low >= high else (w * w - below * top) / (w * (top - below))
        return np.where(w > 0, 1 / (1 + warped ** (2 * order)), 0.0)


def band_gains(f: np.ndarray, fs: float, bands: list[tuple[float, float]]) -> np.ndarray:
    """The same of several bands that have both limits within the spectrum, a row a band."""
    lo, hi = np.array(bands).T / (fs / 2)
    hi = np.minimum(hi, 0.9999)
    w = np.tan(np.pi * np.minimum(f / fs, 0.4999999))
    below, top = (np.tan(np.pi * x / 2)[:, None] for x in (lo, hi))
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        warped = (w * w - below * top) / (w * (top - below))
        square = warped * warped
        gains = np.where(w > 0, 1 / (1 + square**2 * square**2 * square), 0.0)
    for k in np.flatnonzero((lo <= 0) | (lo >= hi)):
        gains[k] = band_gain(f, fs, *bands[k])
    return gains


def bandpass(df: DataFrame, lo: float, hi: float, order: int = ORDER) -> DataFrame:
    """voltage limited to a band: the spectrum times the gain, transformed back."""

    def make(x: np.ndarray, fs: float) -> dict[str, np.ndarray]:
        return {"voltage": np.fft.irfft(np.fft.rfft(x) * band_gain(np.fft.rfftfreq(len(x), 1 / fs), fs, lo, hi, order), len(x)) if len(x) else x}

    return each_signal(df, make, "voltage array")


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signals along the last axis."""
    n = x.shape[-1]
    gain = np.zeros(n)
    gain[: (n + 1) // 2] = 2
    gain[:1] = 1
    if n and n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * gain) if n else x


def envelope(df: DataFrame) -> DataFrame:
    """voltage replaced by its envelope, the size of the analytic signal."""
    return each_signal(df, lambda x, fs: {"voltage": np.abs(analytic(x))}, "voltage array")


def welch(x: np.ndarray, fs: float, nperseg: int = NPERSEG) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided power density: periodic Hann segments overlapping by half, each less its mean."""
    n = min(nperseg, len(x))
    if not n:
        return x, x
    hop = max(1, n - n // 2)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) if n > 1 else np.ones(1)
    parts = np.lib.stride_tricks.sliding_window_view(x, n)[::hop]
    parts = (parts - parts.mean(1, keepdims=True)) * window
    power = (np.abs(np.fft.rfft(parts)) ** 2).mean(0) / (fs * (window**2).sum())
    power[1 : (n + 1) // 2] *= 2
    return np.fft.rfftfreq(n, 1 / fs), power


def welch_psd(df: DataFrame, nperseg: int = NPERSEG) -> DataFrame:
    """One row for each bin (k, f, psd) of each signal's power density."""
    made = each_signal(df, lambda x, fs: dict(zip(("f", "psd"), welch(x, fs, nperseg), strict=True)), "f array, psd array")
    return made.select(*KEY, F.posexplode(F.arrays_zip("f", "psd")).alias("k", "z")).select(*KEY, "k", "z.f", "z.psd")


def flatness(psd: DataFrame) -> DataFrame:
    """Geometric over arithmetic mean of each signal's power density."""
    p = F.greatest("psd", F.lit(TINY))
    return psd.groupBy(*KEY).agg((F.exp(F.avg(F.ln(p))) / F.avg(p)).alias("envelope_flatness"))


def envelope_mean(df: DataFrame) -> DataFrame:
    """Mean of each signal's envelope."""
    total = F.aggregate("voltage", F.lit(0.0), lambda a, x: a + x)
    return envelope(df).select(*KEY, F.when(F.size("voltage") > 0, total / F.size("voltage")).alias("envelope_mean"))


def envelope_psd(df: DataFrame, nperseg: int = 256) -> DataFrame:
    """Power density of each signal's envelope (k, f, psd)."""
    return welch_psd(envelope(df), nperseg)


def amplitudes(df: DataFrame, lo: float = 0.0, hi: float = float("inf"), of_envelope: bool = False) -> DataFrame:
    """Size of each signal's transform over its length (k, f, mag) between two frequencies, the Nyquist bin included; for envelopes with zero at frequency zero."""

    def make(x: np.ndarray, fs: float) -> dict[str, np.ndarray]:
        if not len(x):
            return {"f": x, "mag": x}
        mag = np.abs(np.fft.rfft(np.abs(analytic(x)) if of_envelope else x)) / len(x)
        if of_envelope:
            mag[0] = 0.0
        return {"f": np.fft.rfftfreq(len(x), 1 / fs), "mag": mag}

    rows = each_signal(df, make, "f array, mag array").select(*KEY, F.posexplode(F.arrays_zip("f", "mag")).alias("k", "z"))
    return rows.select(*KEY, "k", "z.f", "z.mag").filter((F.col("f") >= lo) & (F.col("f") <= hi))


def psd_rows(psd: DataFrame, limits: dict[str, float]) -> DataFrame:
    """The bins of each signal's power density up to its sensor's highest frequency; sensors without one keep all."""
    if not limits:
        return psd
    top = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))[F.col("sensor")]
    return psd.filter(top.isNull() | (F.col("f") <= top))


def mean_by_regime(rows: DataFrame, regimes: DataFrame, value: str, at: list[str]) -> DataFrame:
    """Number of signals and mean of a value at each bin (columns at), by sensor and regime (sweep, regime); signals without a regime have none."""
    return rows.join(regimes, "sweep").groupBy("sensor", "regime", *at).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


#: The usual grid of a map: so many centres and widths, evenly spaced up to half the sampling rate.
CENTRES, WIDTHS = 40, 30


def usual_grid(fs: float, centres: int = CENTRES, widths: int = WIDTHS) -> tuple[list[float], list[float]]:
    """Centres and widths of a map of signals sampled at fs."""
    return np.linspace(fs / 40, fs / 2 * 0.95, centres).tolist(), np.linspace(fs / 50, fs / 4, widths).tolist()


@lru_cache(maxsize=64)
def map_bands(cells: tuple[tuple[float, float], ...], n: int, fs: float) -> tuple[list[int], list[tuple[float, float]], np.ndarray | None]:
    """Which cells (centre, width) lie within the spectrum of n samples, their bands and, if these are few numbers, their gains."""
    inside = [i for i, (c, w) in enumerate(cells) if c - w / 2 >= 1 and c + w / 2 < fs / 2] if n >= 4 else []
    bands = [(cells[i][0] - cells[i][1] / 2, cells[i][0] + cells[i][1] / 2) for i in inside]
    return inside, bands, band_gains(np.fft.rfftfreq(n, 1 / fs), fs, bands) if inside and n * len(cells) <= KEPT else None


def infogram(df: DataFrame, centres: list[float], widths: list[float]) -> DataFrame:
    """For each signal and cell (centre, width) that lies within the spectrum: entropy of noise less that of the squared envelope's spectrum. Signals are dealt over all cores, and all cells of one are made at once."""
    cells = tuple((c, w) for c in centres for w in widths)

    def make(x: np.ndarray, fs: float) -> dict[str, np.ndarray]:
        n, out = len(x), np.full(len(cells), np.nan)
        inside, bands, kept = map_bands(cells, n, fs)
        if not inside:
            return {"info": out}
        one_sided = np.fft.rfft(x)
        one_sided[1 : (n + 1) // 2] *= 2  # the spectrum of the analytic signal, which has no negative frequencies
        for start in range(0, len(inside), 64):  # so many cells at once are in memory
            some = inside[start : start + 64]
            gains = band_gains(np.fft.rfftfreq(n, 1 / fs), fs, bands[start : start + 64]) if kept is None else kept[start : start + 64]
            z = np.fft.ifft(one_sided * gains, n)
            ses = np.abs(np.fft.rfft(z.real**2 + z.imag**2))[:, 1:]
            total = ses.sum(1, keepdims=True)
            p = np.where(total > TINY, ses / np.maximum(total, TINY), ses)
            loss = (p * np.log(np.where(p > 0, p, 1.0))).sum(1)
            out[some] = np.where((p > 0).any(1), math.log(ses.shape[1]) - NOISE_LOSS + loss, np.nan)
        return {"info": out}

    made = each_signal(spread(df, *KEY), make, "info array")
    grid = F.expr(f"transform(sequence(0, {len(cells) - 1}), i -> i)")
    middles, spans = (F.array(*(F.lit(float(v)) for v in vs)) for vs in (centres, widths))
    rows = made.select(*KEY, F.explode(F.arrays_zip(grid.alias("i"), "info")).alias("z")).select(*KEY, "z.i", "z.info")
    return rows.select(*KEY, F.get(middles, F.floor(F.col("i") / len(widths)).cast("int")).alias("centre"), F.get(spans, F.col("i") % len(widths)).alias("width"), F.when(~F.isnan("info"), F.col("info")).alias("info"))


def blurred(grid: DataFrame, sigma: float = 1.5) -> DataFrame:
    """A map (y, x, z) with its gaps as the mean of the rest and blurred by a Gaussian along both axes, mirrored at the edges; gap says where.

    A map is a grid of a bounded number of cells, whatever the signals it is made of; it is one group.
    """

    def run(part: pa.Table) -> pa.Table:
        ys, yi = np.unique(part.column("y").to_numpy(), return_inverse=True)
        xs, xi = np.unique(part.column("x").to_numpy(), return_inverse=True)
        z = np.full((len(ys), len(xs)), np.nan)
        z[yi, xi] = part.column("z").to_numpy(zero_copy_only=False)
        gap = np.isnan(z)
        z[gap] = z[~gap].mean() if (~gap).any() else 0.0
        if sigma > 0:
            r = int(4 * sigma + 0.5)
            weights = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
            weights /= weights.sum()
            for axis in (0, 1):
                wide = np.pad(z, [(r, r) if a == axis else (0, 0) for a in (0, 1)], "symmetric")
                z = sum(w * np.take(wide, np.arange(k, k + z.shape[axis]), axis) for k, w in enumerate(weights))
        i, j = np.indices(z.shape)
        return pa.table({"y": ys[i.ravel()].astype(float), "x": xs[j.ravel()].astype(float), "z": z.ravel(), "gap": gap.ravel()})

    every = grid.select(F.lit("map").alias("of"), F.col("y").cast("double"), F.col("x").cast("double"), F.col("z").cast("double"))
    return every.groupBy("of").applyInArrow(run, "y double, x double, z double, gap boolean")


def map_gradient(grid: DataFrame, sigma: float = 0.0) -> DataFrame:
    """Size of the gradient of a map (y, x, z): central differences, one-sided at the edges; with sigma, of the blurred map, and null where it has gaps."""
    if sigma > 0:
        smooth = blurred(grid, sigma)
        found = map_gradient(smooth.select("y", "x", "z")).join(smooth.select("y", "x", "gap"), ["y", "x"])
        return found.select("y", "x", F.when(~F.col("gap"), F.col("gradient")).alias("gradient"))

    def step(along: str, across: str):  # noqa: ANN202
        w = Window.partitionBy(across).orderBy(along)
        back, on, z = F.lag("z").over(w), F.lead("z").over(w), F.col("z")
        return F.when(back.isNull(), on - z).when(on.isNull(), z - back).otherwise((on - back) / 2)

    d = grid.select("y", "x", step("x", "y").alias("dx"), step("y", "x").alias("dy"))
    return d.select("y", "x", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("gradient"))
