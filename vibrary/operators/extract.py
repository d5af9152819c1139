"""From raw array signals to feature rows: cleaning, band limits and 26 statistics in one pass over each row, map-only.

A row is one signal (sweep, sensor, fs, voltage). Each Arrow batch is worked on a few rows at a time, so memory is that
of the longest signals, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .signals import CLIPPED, FLAT, FLAT_RUN, KEY, MIN_LENGTH, NEAR, RAIL, SPIKE
from .spectra import TINY, band_gain

TIME = "peak rms std variance skewness kurtosis crest_factor shape_factor impulse_factor margin_factor mobility complexity".split()
FREQUENCY = (
    "dominant_frequency spectral_mean spectral_std center_frequency spectral_skewness spectral_kurtosis rms_frequency spectral_flatness frequency_weighted_std peak_frequency "
    "normalized_frequency_std frequency_skewness frequency_kurtosis normalized_bandwidth"
).split()
Band = tuple[float, float, str]
ROWS = 64  # signals that are numpy arrays at once


@dataclass(frozen=True)
class Cleaning:
    """What is checked and repaired, in this order, and what rejects a signal."""

    min_length: int = MIN_LENGTH
    fix_nonfinite: bool = True
    check_clipping: bool = True
    clipped: float = CLIPPED
    check_saturation: bool = True
    flat_run: int = FLAT_RUN
    spikes: float | None = SPIKE
    near: int = NEAR
    reject_clipped: bool = False
    reject_saturated: bool = False


def longest_run(flags: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def cleaned(x: np.ndarray, how: Cleaning) -> tuple[np.ndarray | None, dict]:
    """The repaired signal, None if it is rejected, and what was found."""
    found = {"rejection_reason": None, "clipping_fraction": 0.0, "is_clipped": False, "saturation_longest_run": 0, "is_saturated": False, "n_nan_inf_replaced": 0, "n_outlier_samples_replaced": 0}

    def rejected(reason: str) -> tuple[None, dict]:
        return None, found | {"rejection_reason": reason}

    if len(x) < how.min_length:
        return rejected(f"too short ({len(x)} < {how.min_length})")
    if not x.any():
        return rejected("all-zero signal")
    if np.isnan(x).all():
        return rejected("all-NaN signal")
    good = np.isfinite(x)
    if how.fix_nonfinite and not good.all():
        found["n_nan_inf_replaced"] = int((~good).sum())
        at = np.flatnonzero(good)
        x = np.interp(np.arange(len(x)), at, x[at]) if len(at) else np.zeros(len(x))
    if how.check_clipping:
        lo, hi = np.percentile(x, [100 * (1 - RAIL), 100 * RAIL])
        share = float(((x <= lo) | (x >= hi)).mean())
        found |= {"clipping_fraction": share, "is_clipped": share >= how.clipped}
        if how.reject_clipped and found["is_clipped"]:
            return rejected(f"clipping detected ({share:.1%} at rail)")
    if how.check_saturation:
        run = longest_run(np.abs(np.diff(x)) < FLAT)
        found |= {"saturation_longest_run": run, "is_saturated": run >= how.flat_run}
        if how.reject_saturated and found["is_saturated"]:
            return rejected(f"saturation detected (flat run = {run} samples)")
    if how.spikes and x.std() >= TINY:
        mean = x.mean()
        bad = np.abs(x - mean) / x.std() > how.spikes
        out = x.copy()
        for i in np.flatnonzero(bad):
            part = slice(max(0, i - how.near), i + how.near + 1)
            sound = x[part][~bad[part]]
            out[i] = np.median(sound) if len(sound) else mean
        found["n_outlier_samples_replaced"] = int(bad.sum())
        x = out
    return x, found


def signals(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, list[np.ndarray], np.ndarray]]:
    """Stretches of a batch (columns KEY, fs, voltage) with their signals as arrays; a null sample is NaN, a null signal empty."""
    for start in range(0, batch.num_rows, ROWS):
        part = batch.slice(start, ROWS)
        flat = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(float)
        sizes = np.array([n or 0 for n in part.column(3).value_lengths().to_pylist()], int)
        yield start, part, np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else [], part.column(2).to_numpy(zero_copy_only=False)


def each_row(df: DataFrame, make: Callable[[str, np.ndarray, float], dict], fields: str) -> DataFrame:
    """Key columns, fs and what make(sensor, signal, fs) returns for each row."""
    head = df.select(*KEY, F.col("fs").cast("double").alias("fs"), F.col("voltage").cast("array<double>").alias("voltage"))
    types = dict(head.dtypes)
    schema = df.sparkSession.createDataFrame([], ", ".join([*(f"{k} {types[k]}" for k in KEY), "fs double", fields])).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part, xs, fs in signals(batch):
                made = [make(s, x, f) for s, x, f in zip(part.column(1).to_pylist(), xs, fs, strict=True)]
                columns = [pa.array([m[c.name] for m in made], c.type, from_pandas=True) for c in list(arrow)[3:]]
                yield pa.RecordBatch.from_arrays([*(part.column(k).cast(arrow.field(k).type) for k in range(3)), *columns], schema=arrow)

    return head.mapInArrow(run, schema)


QUALITY = "rejection_reason string, clipping_fraction double, is_clipped boolean, saturation_longest_run long, is_saturated boolean, n_nan_inf_replaced long, n_outlier_samples_replaced long"


def clean_arrays(df: DataFrame, how: Cleaning = Cleaning()) -> DataFrame:  # noqa: B008
    """Key, fs, the repaired voltage (null for a rejected signal) and the quality columns of every signal."""

    def make(_: str, x: np.ndarray, __: float) -> dict:
        out, found = cleaned(x, how)
        return {"voltage": out, **found, "is_valid": out is not None}

    return each_row(df, make, f"voltage array<double>, {QUALITY}, is_valid boolean")


def time_statistics(x: np.ndarray) -> list[float]:
    """The TIME statistics; mobility and complexity are NaN for a constant signal."""
    if not len(x):
        return [float("nan")] * len(TIME)
    size, d1 = np.abs(x), np.diff(x)
    d2 = np.diff(d1)
    std, var = float(x.std()), float(x.var())
    peak, rms, mean, root = float(x.max() - x.min()) / 2, float(np.sqrt((x * x).mean())), float(size.mean()), float(np.sqrt(size).mean()) ** 2
    z = (x - x.mean()) / std if std >= TINY else np.zeros(1)
    v1, v2 = (float(d.var()) if len(d) else 0.0 for d in (d1, d2))
    mobility = np.sqrt(v1 / var) if var > 0 else float("nan")
    complexity = np.sqrt(v2 / v1) / mobility if v1 > 0 and var > 0 else float("nan")
    ratio = lambda a, b: a / b if b > 0 else 0.0
    return [peak, rms, std, var, float((z**3).mean()), float((z**4).mean()), ratio(peak, rms), ratio(rms, mean), ratio(peak, mean), ratio(peak, root), mobility, complexity]


def frequency_statistics(mag: np.ndarray, f: np.ndarray) -> list[float]:
    """The FREQUENCY statistics of a one-sided spectrum without the Nyquist bin; all zero for a silent one."""
    total = float(mag.sum())
    if not len(mag) or total < TINY:
        return [0.0] * len(FREQUENCY)
    k, mean, sd, fc = len(mag), float(mag.mean()), float(mag.std()), float(f @ mag) / total
    d = f - fc
    m3, m4, f2, f4 = float(d**3 @ mag), float(d**4 @ mag), float(f**2 @ mag), float(f**4 @ mag)
    fw, hm = float(np.sqrt((d * d).mean())), float(np.sqrt(np.abs(d)) @ mag)
    ratio = lambda a, b, least=0.0: a / b if b > least else 0.0
    return [
        float(f[np.argmax(mag * mag)]), mean, sd, fc, ratio(m3, sd**3 * total, TINY), ratio(m4, sd**4 * total, TINY), float(np.sqrt(f2 / total)), float(np.exp(np.log(mag[mag > 0]).mean())) / mean, fw,
        float(np.sqrt(f4 / f2)) if f2 > 0 else 0.0, ratio(fw, fc), ratio(m3, k * fw**3), ratio(m4, k * fw**4), ratio(hm, k * np.sqrt(fw)),
    ]


def all_statistics(x: np.ndarray, fs: float, bands: list[tuple[float, float] | None]) -> list[list[float]]:
    """TIME and FREQUENCY statistics of a signal limited to each band (None: not limited). One transform serves all; a band's bins are the signal's own times the gain."""
    n = len(x)
    if not n:
        return [[float("nan")] * len(TIME) + [0.0] * len(FREQUENCY) for _ in bands]
    bins, f = np.fft.rfft(x), np.fft.rfftfreq(n, 1 / fs)
    out = []
    for band in bands:
        gain = band_gain(f, fs, *band) if band else np.ones(len(f))
        y = np.fft.irfft(bins * gain, n) if band else x
        half = slice(0, n // 2)
        out.append(time_statistics(y) + frequency_statistics((np.abs(bins) * gain)[half], f[half]))
    return out


def frequency_features(df: DataFrame) -> DataFrame:
    """Fourteen statistics of each signal's spectrum."""
    return each_row(df, lambda _, x, fs: dict(zip(FREQUENCY, all_statistics(x, fs, [None])[0][len(TIME) :], strict=True)), ", ".join(f"{c} double" for c in FREQUENCY)).drop("fs")


def band_features(df: DataFrame, bands: list[Band]) -> DataFrame:
    """The 26 statistics of each band-limited signal, a row for each signal and band (column band). Bands are arguments, so few."""
    names = [*TIME, *FREQUENCY]
    made = each_row(df, lambda _, x, fs: {"s": all_statistics(x, fs, [(lo, hi) for lo, hi, _ in bands])}, "s array<array<double>>")
    labels = F.array(*(F.lit(label) for _, _, label in bands))
    rows = made.select(*KEY, F.explode(F.arrays_zip(labels.alias("band"), F.col("s"))).alias("z"))
    number = lambda c: F.when(~F.isnan(c), c)
    return rows.select(*KEY, F.col("z.band").alias("band"), *(number(F.col("z.s")[k]).alias(c) for k, c in enumerate(names)))


def extract_features(df: DataFrame, bands: dict[str, list[Band]], prefilter: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """A wide row for each signal that is not null: 26 statistics of the signal (limited to its sensor's prefilter if it has one) and, as {label}__{statistic}, 26 of each of its sensor's bands.

    Bands are of the signal before the prefilter. Columns of other sensors' bands are null.
    """
    names, labels = [*TIME, *FREQUENCY], [b[2] for each in bands.values() for b in each]
    columns = [*names, *(f"{label}__{c}" for label in dict.fromkeys(labels) for c in names)]

    def make(sensor: str, x: np.ndarray, fs: float) -> dict:
        own = bands.get(sensor, [])
        made = all_statistics(x, fs, [(prefilter or {}).get(sensor), *((lo, hi) for lo, hi, _ in own)])
        row = dict.fromkeys(columns, None) | dict(zip(names, made[0], strict=True))
        for (_, _, label), values in zip(own, made[1:], strict=True):
            row |= {f"{label}__{c}": v for c, v in zip(names, values, strict=True)}
        return row

    return each_row(df.filter("voltage IS NOT NULL"), make, ", ".join(f"`{c}` double" for c in columns)).drop("fs")


def sensor_prefilter(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """voltage of the listed sensors limited to their band, that of others as it is."""

    def make(sensor: str, x: np.ndarray, fs: float) -> dict:
        if sensor not in limits or not len(x):
            return {"voltage": x}
        return {"voltage": np.fft.irfft(np.fft.rfft(x) * band_gain(np.fft.rfftfreq(len(x), 1 / fs), fs, *limits[sensor]), len(x))}

    return each_row(df, make, "voltage array<double>")


def unprefix_band(features: DataFrame, label: str) -> DataFrame:
    """One band's statistics of a wide table under their plain names; an error if the band is not there."""
    own = [c for c in features.columns if c.startswith(f"{label}__")]
    if not own:
        raise ValueError(f"no columns of band {label!r}")
    return features.select(*(c for c in ("file", "sweep", "sensor") if c in features.columns), *(F.col(f"`{c}`").alias(c[len(label) + 2 :]) for c in own))
