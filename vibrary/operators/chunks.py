"""Long signals in chunks: checks, repairs and statistics of samples (sweep, sensor, i, v) of which no task holds more than a chunk.

A chunk is a row: the samples whose number i lies in one stretch of a given length, in order. What crosses the edges
of chunks goes through small rows, one a chunk, that are scanned in order: the last and first known value for gaps,
the length of the flat run at either end, a few samples of the neighbours for medians and differences. Each of these
merges associatively, so results do not hang on the length of the chunks. Moments are merged about the common mean.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.store import kept
from .skew import keyed_quantiles

KEY = ("sweep", "sensor")
AT = (*KEY, "chunk")
#: Samples of a chunk, at most.
CHUNK = 1 << 15
MIN_LENGTH, RAIL, CLIPPED, FLAT, FLAT_RUN, SPIKE, NEAR = 64, 0.999, 0.01, 1e-10, 50, 6.0, 5
#: Rows that are worked on at once.
SLICE = 64
MOMENTS = "n long, mean double, m2 double, m3 double, m4 double"


def in_order() -> WindowSpec:
    """The chunks of a signal in order. A signal has few: its samples by the length of a chunk."""
    return Window.partitionBy(*KEY).orderBy("chunk")


def before() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, -1)


def to_chunks(samples: DataFrame, size: int = CHUNK) -> DataFrame:
    """sweep, sensor, chunk and the arrays i and v of each chunk's samples by i; null values are NaN."""
    v = F.coalesce(F.col("v").cast("double"), F.lit(float("nan")))
    rows = samples.select(*KEY, F.floor(F.col("i") / size).alias("chunk"), F.struct(F.col("i").cast("long").alias("i"), v.alias("v")).alias("x"))
    by = rows.groupBy(*AT).agg(F.sort_array(F.collect_list("x")).alias("x"))
    return by.select(*AT, F.col("x.i").alias("i"), F.col("x.v").alias("v"))


def from_arrays(signals: DataFrame, size: int = CHUNK) -> DataFrame:
    """Chunks of signals that are arrays (sweep, sensor, voltage), where they are; a null sample is NaN."""
    v = F.transform(F.col("voltage").cast("array<double>"), lambda x: F.coalesce(x, F.lit(float("nan"))))
    cut = F.transform(F.sequence(F.lit(0), F.size(v) - 1, F.lit(size)), lambda k: F.struct(k.alias("k"), F.slice(v, k + 1, size).alias("v")))
    rows = signals.filter(F.size("voltage") > 0).select(*KEY, F.explode(cut).alias("x"))
    return rows.select(*KEY, F.floor(F.col("x.k") / size).alias("chunk"), F.sequence(F.col("x.k").cast("long"), F.col("x.k") + F.size("x.v") - 1).alias("i"), "x.v")


def to_samples(chunks: DataFrame, *columns: str) -> DataFrame:
    """Chunks as rows (sweep, sensor, i and the columns)."""
    each = chunks.select(*KEY, F.explode(F.arrays_zip("i", *columns)).alias("x"))
    return each.select(*KEY, "x.i", *(F.col(f"x.{c}").alias(c) for c in columns))


def each(df: DataFrame, given: list[str], make: Callable[..., tuple], fields: str, keep: tuple[str, ...] = AT) -> DataFrame:
    """The kept columns and fields, which make returns for each row's given columns; arrays come as numpy arrays."""
    df = df.select(*keep, *given)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema[: len(keep)])
    schema = f"{head}, {fields}"
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def value(x: pa.Scalar) -> object:
        return x.values.to_numpy(zero_copy_only=False) if isinstance(x, pa.ListScalar) and x.values is not None else x.as_py()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                made = [make(*map(value, row)) for row in zip(*part.columns[len(keep) :], strict=True)]
                columns = [pa.array(c, arrow.field(len(keep) + k).type) for k, c in enumerate(zip(*made, strict=True))]
                yield pa.RecordBatch.from_arrays([c.cast(arrow.field(k).type) for k, c in enumerate(part.columns[: len(keep)])] + columns, schema=arrow)

    return df.mapInArrow(run, schema)


# --- checks


def known_ends(i: np.ndarray, v: np.ndarray) -> tuple:
    """Number of samples, of zeros and of NaN, and the first and last finite sample."""
    good = np.flatnonzero(np.isfinite(v))
    ends = (int(i[good[0]]), float(v[good[0]]), int(i[good[-1]]), float(v[good[-1]])) if len(good) else (None,) * 4
    return len(v), int(np.count_nonzero(v == 0)), int(np.count_nonzero(np.isnan(v))), *ends


def known(chunks: DataFrame) -> DataFrame:
    return each(chunks, ["i", "v"], known_ends, "n long, zeros long, nans long, first_i long, first_v double, last_i long, last_v double")


def rejected(counts: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """n and rejection_reason (the first that holds, or NULL) of each signal, from rows of counts n, zeros and nans."""
    by = counts.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in ("n", "zeros", "nans")))
    reason = (
        F.when(F.col("n") < min_length, F.format_string(f"too short (%d < {min_length})", F.col("n")))
        .when(F.col("zeros") == F.col("n"), "all-zero signal")
        .when(F.col("nans") == F.col("n"), "all-NaN signal")
    )
    return by.select(*KEY, "n", reason.alias("rejection_reason"))


# --- gaps


def around(ends: DataFrame) -> DataFrame:
    """For each chunk the last known sample before it (i0, v0) and the first one after it (i1, v1)."""
    after = in_order().rowsBetween(1, Window.unboundedFollowing)
    pair = lambda i, v: F.when(F.col(i).isNotNull(), F.struct(F.col(i).alias("i"), F.col(v).alias("v")))
    both = ends.select(*AT, F.last(pair("last_i", "last_v"), True).over(before()).alias("a"), F.first(pair("first_i", "first_v"), True).over(after).alias("b"))
    return both.select(*AT, F.col("a.i").alias("i0"), F.col("a.v").alias("v0"), F.col("b.i").alias("i1"), F.col("b.v").alias("v1"))


def filled(i: np.ndarray, v: np.ndarray, i0: int | None, v0: float | None, i1: int | None, v1: float | None) -> tuple[np.ndarray, np.ndarray]:
    """v with gaps filled, linear between known neighbours, the nearest at the ends, zero if nothing is known; and where."""
    gap = ~np.isfinite(v)
    if not gap.any():
        return v, gap
    good = np.flatnonzero(~gap)
    at = np.concatenate(([i0] if i0 is not None else [], i[good], [i1] if i1 is not None else [])).astype(np.int64)
    values = np.concatenate(([v0] if i0 is not None else [], v[good], [v1] if i1 is not None else []))
    if not len(at):
        return np.zeros(len(v)), gap
    out, x = v.copy(), i[gap]
    right = np.searchsorted(at, x)
    left = right - 1
    a, b = np.maximum(left, 0), np.minimum(right, len(at) - 1)
    inner = (left >= 0) & (right < len(at))
    step = np.where(inner, at[b] - at[a], 1)
    out[gap] = np.where(inner, values[a] + (values[b] - values[a]) * (x - at[a]) / step, np.where(left >= 0, values[a], values[b]))
    return out, gap


# --- flat runs


def flat_ends(v: np.ndarray, tolerance: float = FLAT) -> tuple[int, int, int, float, float]:
    """Flat steps at the start and at the end of a chunk and in its longest run, and its first and last value."""
    flat = np.abs(np.diff(v)) < tolerance
    breaks = np.flatnonzero(~flat)
    if not len(breaks):
        return len(flat), len(flat), len(flat), float(v[0]), float(v[-1])
    longest = max(int(np.diff(breaks).max(initial=1)) - 1, int(breaks[0]), len(flat) - 1 - int(breaks[-1]))
    return int(breaks[0]), len(flat) - 1 - int(breaks[-1]), longest, float(v[0]), float(v[-1])


def longest_flat(ends: DataFrame, tolerance: float = FLAT, run: int = FLAT_RUN) -> DataFrame:
    """Longest run of flat steps of each signal, and whether it is too long, from rows (n, prefix, suffix, longest, first, last) a chunk.

    A chunk that is flat throughout and joins the one before flatly lengthens the run that reaches it; any other chunk starts
    a new one with its suffix.
    """
    w = in_order()
    joined = F.coalesce(F.abs(F.col("first") - F.lag("last").over(w)) < tolerance, F.lit(False))
    rows = ends.select(*AT, "n", "prefix", "suffix", "longest", joined.alias("joined"))
    goes_on = F.col("joined") & (F.col("prefix") == F.col("n") - 1)
    rows = rows.withColumn("island", F.count_if(~goes_on).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("adds", F.when(goes_on, F.col("n")).otherwise(F.col("suffix")))
    inside = Window.partitionBy(*KEY, "island").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("reach", F.sum("adds").over(inside))
    across = F.when(F.col("joined"), F.lag("reach").over(w) + 1 + F.col("prefix")).otherwise(0)
    by = rows.select(*KEY, F.greatest("longest", across).alias("run")).groupBy(*KEY).agg(F.max("run").alias("saturation_longest_run"))
    return by.withColumn("is_saturated", F.col("saturation_longest_run") >= run)


# --- moments and spikes


def moments(v: np.ndarray) -> tuple[int, float, float, float, float]:
    """n, the mean, and the sums of the second to fourth powers of what differs from it."""
    if not len(v):
        return 0, 0.0, 0.0, 0.0, 0.0
    m = float(v.mean())
    d = v - m
    return len(v), m, *(float((d**k).sum()) for k in (2, 3, 4))


def merged_moments(name: str = "") -> list[Column]:
    """Aggregates {name}n, {name}mean, {name}m2, {name}m3 and {name}m4 of each group of moments; rows have the group's mean as {name}common."""
    n, d, m2, m3, m4 = F.col(f"{name}n"), F.col(f"{name}mean") - F.col(f"{name}common"), F.col(f"{name}m2"), F.col(f"{name}m3"), F.col(f"{name}m4")
    return [
        F.sum(n).alias(f"{name}n"), F.first(f"{name}common").alias(f"{name}mean"), F.sum(m2 + n * d * d).alias(f"{name}m2"), F.sum(m3 + 3 * d * m2 + n * d**3).alias(f"{name}m3"),
        F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * d**4).alias(f"{name}m4"),
    ]


def with_common(rows: DataFrame, names: tuple[str, ...] = ("",), by: tuple[str, ...] = KEY) -> DataFrame:
    """rows with the mean over all chunks of their signal as {name}common."""
    all_of = Window.partitionBy(*by)
    return rows.select("*", *((F.sum(F.col(f"{c}n") * F.col(f"{c}mean")).over(all_of) / F.sum(f"{c}n").over(all_of)).alias(f"{c}common") for c in names))


def with_halo(ends: DataFrame, near: int) -> DataFrame:
    """Rows (head, tail: at most near samples of each chunk) with left and right: the near samples before and after each chunk, of as many chunks as it takes."""
    left = F.flatten(F.collect_list("tail").over(in_order().rowsBetween(-near, -1)))
    right = F.flatten(F.collect_list("head").over(in_order().rowsBetween(1, near)))
    last = F.when(F.size(left) > near, F.slice(left, -near, near)).otherwise(left)
    return ends.withColumn("left", last).withColumn("right", F.slice(right, 1, near))


def despiked(v: np.ndarray, left: np.ndarray, right: np.ndarray, mean: float, std: float, z: float = SPIKE, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """v with samples beyond z deviations as the median of the sound ones up to near places away, or the mean if there are none; and where."""
    wide = np.concatenate((left, v, right))
    spike = np.abs(wide - mean) / std > z if std >= 1e-30 else np.zeros(len(wide), bool)
    own = spike[len(left) : len(left) + len(v)]
    if not own.any():
        return v, own
    out = v.copy()
    for k in np.flatnonzero(own):
        at = k + len(left)
        some = slice(max(0, at - near), at + near + 1)
        sound = wide[some][~spike[some]]
        out[k] = np.median(sound) if len(sound) else mean
    return out, own


# --- all of it


def filled_chunks(chunks: DataFrame, ends: DataFrame, near: int = NEAR, tolerance: float = FLAT) -> DataFrame:
    """Chunks without gaps (i, v, replaced) with the facts about each that later steps scan; written once and read by columns."""

    def make(i: np.ndarray, v: np.ndarray, *known_around: object) -> tuple:
        v, gap = filled(i, v, *known_around)
        return i, v, gap, int(gap.sum()), *moments(v), *flat_ends(v, tolerance), v[:near], v[-near:]

    fields = f"i array<long>, v array<double>, replaced array<boolean>, n_replaced long, {MOMENTS}, prefix long, suffix long, longest long, first double, last double, head array<double>, tail array<double>"
    return each(chunks.join(around(ends), list(AT)), ["i", "v", "i0", "v0", "i1", "v1"], make, fields)


def clipping(filled: DataFrame, threshold: float = CLIPPED, rail: float = RAIL) -> DataFrame:
    """Share of each signal's samples at or beyond its outer percentiles, and whether that is too much."""
    rails = keyed_quantiles(to_samples(filled, "v"), list(KEY), "v", [1 - rail, rail]).select(*KEY, F.col("quantiles")[0].alias("lo"), F.col("quantiles")[1].alias("hi"))
    counts = each(filled.join(rails, list(KEY)), ["v", "lo", "hi"], lambda v, lo, hi: (len(v), int(np.count_nonzero((v <= lo) | (v >= hi)))), "n long, clipped long")
    by = counts.groupBy(*KEY).agg((F.sum("clipped") / F.sum("n")).alias("clipping_fraction"))
    return by.withColumn("is_clipped", F.col("clipping_fraction") >= threshold)


def without_spikes(filled: DataFrame, z: float = SPIKE, near: int = NEAR) -> DataFrame:
    """Chunks (i, v, spike) of filled ones without spikes, and how many there were."""
    stats = with_common(filled.select(*AT, "n", "mean", "m2", "m3", "m4")).groupBy(*KEY).agg(*merged_moments())
    stats = stats.select(*KEY, "mean", F.sqrt(F.col("m2") / F.col("n")).alias("std"))
    facts = with_halo(filled.select(*AT, "head", "tail"), near).select(*AT, "left", "right").join(stats, list(KEY))
    rows = filled.select(*AT, "i", "v").join(facts, list(AT))

    def make(i: np.ndarray, v: np.ndarray, left: np.ndarray, right: np.ndarray, mean: float, std: float) -> tuple:
        v, spike = despiked(v, left, right, mean, std, z, near)
        return i, v, spike, int(spike.sum())

    return each(rows, ["i", "v", "left", "right", "mean", "std"], make, "i array<long>, v array<double>, spike array<boolean>, n_spikes long")


def repaired(samples: DataFrame, spikes: float | None = SPIKE, size: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cleaned chunks (i, v, n_spikes) of valid signals, the same before spikes were taken out, and what is wrong with each signal."""
    chunks = kept(to_chunks(samples, size), "chunks")
    ends = kept(known(chunks), "known")
    checked = rejected(ends)
    valid = checked.filter("rejection_reason IS NULL").select(*KEY)
    filled = kept(filled_chunks(chunks.join(valid, list(KEY), "left_semi"), ends), "filled")
    out = without_spikes(filled, spikes) if spikes else filled.select(*AT, "i", "v", F.lit(0).cast("long").alias("n_spikes"))
    return out, filled, checked


def clean(samples: DataFrame, spikes: float | None = SPIKE, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The cleaned chunks (i, v) of valid signals, and the quality table of all signals."""
    out, filled, checked = repaired(samples, spikes, size)
    flat = longest_flat(filled.select(*AT, "n", "prefix", "suffix", "longest", "first", "last"))
    counts = filled.groupBy(*KEY).agg(F.sum("n_replaced").alias("n_nan_inf_replaced"))
    spiked = out.groupBy(*KEY).agg(F.sum("n_spikes").alias("n_outlier_samples_replaced"))
    quality = checked.drop("n")
    for part in (clipping(filled), flat, counts, spiked):
        quality = quality.join(part, list(KEY), "left")
    quality = quality.na.fill(0).na.fill(False).withColumn("is_valid", F.col("rejection_reason").isNull())
    return out.select(*AT, "i", "v"), quality


def time_features(chunks: DataFrame) -> DataFrame:
    """Twelve statistics of each signal from its chunks (i, v); mobility and complexity are NULL for a constant signal.

    First and second differences look back over two samples of the chunks before.
    """
    ends = each(chunks, ["v"], lambda v: (v[:2], v[-2:]), "head array<double>, tail array<double>")
    rows = chunks.select(*AT, "v").join(with_halo(ends, 2).select(*AT, "left"), list(AT))

    def make(v: np.ndarray, left: np.ndarray) -> tuple:
        wide = np.concatenate((left, v))
        d1 = np.diff(wide)
        d2 = np.diff(d1)
        d1, d2 = d1[max(0, len(left) - 1) :], d2[max(0, len(left) - 2) :]  # those that end in this chunk
        a = np.abs(v)
        return float(v.min()), float(v.max()), float((v * v).sum()), float(a.sum()), float(np.sqrt(a).sum()), *moments(v), *moments(d1), *moments(d2)

    names = ("", "d1_", "d2_")
    fields = "lo double, hi double, squares double, sizes double, roots double, " + ", ".join(f"{p}n long, {p}mean double, {p}m2 double, {p}m3 double, {p}m4 double" for p in names)
    facts = with_common(each(rows, ["v", "left"], make, fields), names)
    c = F.col
    a = facts.groupBy(*KEY).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), *(F.sum(x).alias(x) for x in ("squares", "sizes", "roots")), *(x for p in names for x in merged_moments(p))
    )
    ratio = lambda top, by: F.when(by > 0, top / by).otherwise(0.0)
    a = a.select(
        *KEY, "n", ((c("hi") - c("lo")) / 2).alias("peak"), F.sqrt(c("squares") / c("n")).alias("rms"), (c("m2") / c("n")).alias("variance"), F.sqrt(c("m2") / c("n")).alias("std"),
        (c("m3") / c("n")).alias("m3"), (c("m4") / c("n")).alias("m4"), (c("sizes") / c("n")).alias("size"), (c("roots") / c("n")).alias("root"),
        (c("d1_m2") / F.nullif("d1_n", F.lit(0))).alias("v1"), (c("d2_m2") / F.nullif("d2_n", F.lit(0))).alias("v2"),
    )
    still = c("std") < 1e-30
    mobility = F.when(c("variance") > 0, F.sqrt(c("v1") / c("variance")))
    return a.select(
        *KEY, "n", "peak", "rms", "std", "variance", F.when(still, 0.0).otherwise(c("m3") / c("std") ** 3).alias("skewness"), F.when(still, 0.0).otherwise(c("m4") / c("std") ** 4).alias("kurtosis"),
        ratio(c("peak"), c("rms")).alias("crest_factor"), ratio(c("rms"), c("size")).alias("shape_factor"), ratio(c("peak"), c("size")).alias("impulse_factor"),
        ratio(c("peak"), c("root") * c("root")).alias("margin_factor"), mobility.alias("mobility"), F.when(c("v1") > 0, F.sqrt(c("v2") / c("v1")) / mobility).alias("complexity"),
    )
