"""Checks, repairs and statistics of sampled signals in long form (sweep, sensor, i, v), of any length: see chunks.

NULL counts as NaN. Every function keeps all signals; what is wrong with one is a column, not an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import kept
from . import chunks as C
from .chunks import CLIPPED, FLAT, FLAT_RUN, KEY, MIN_LENGTH, NEAR, RAIL, SPIKE


def finite(v: Column) -> Column:
    """v, or NULL if it is NaN or infinite."""
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def validate(samples: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """n and rejection_reason (the first that holds, or NULL) of each signal."""
    v = F.col("v")
    counts = samples.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if(v == 0).alias("zeros"), F.count_if(v.isNull() | F.isnan(v)).alias("nans"))
    return C.rejected(counts, min_length)


def fill_nonfinite(samples: DataFrame, size: int = C.CHUNK) -> DataFrame:
    """v with gaps filled: linear between neighbours, the nearest value at the ends, zero if nothing is known; replaced says where."""
    chunks = kept(C.to_chunks(samples, size), "chunks")
    return C.to_samples(C.filled_chunks(chunks, C.known(chunks)), "v", "replaced")


def clipping(samples: DataFrame, threshold: float = CLIPPED, rail: float = RAIL, size: int = C.CHUNK) -> DataFrame:
    """Share of each signal's samples at or beyond its outer percentiles, and whether that is too much."""
    return C.clipping(C.to_chunks(samples, size), threshold, rail)


def saturation(samples: DataFrame, tolerance: float = FLAT, run: int = FLAT_RUN, size: int = C.CHUNK) -> DataFrame:
    """Longest run of steps smaller than tolerance in each signal, and whether it is too long."""
    ends = C.each(C.to_chunks(samples, size), ["v"], lambda v: (len(v), *C.flat_ends(v, tolerance)), "n long, prefix long, suffix long, longest long, first double, last double")
    return C.longest_flat(ends, tolerance, run)


def despike(samples: DataFrame, z: float = SPIKE, near: int = NEAR, size: int = C.CHUNK) -> DataFrame:
    """Samples beyond z population standard deviations become the median of the sound samples up to near places away, or the mean if there are none."""
    facts = C.each(C.to_chunks(samples, size), ["i", "v"], lambda i, v: (i, v, *C.moments(v), v[:near], v[-near:]), f"i array<long>, v array<double>, {C.MOMENTS}, head array<double>, tail array<double>")
    return C.to_samples(C.without_spikes(kept(facts, "facts"), z, near), "v", "spike")


def clean(samples: DataFrame, spikes: float | None = SPIKE, size: int = C.CHUNK) -> tuple[DataFrame, DataFrame]:
    """The cleaned samples of valid signals, and the quality table of all signals."""
    chunks, quality = C.clean(samples, spikes, size)
    return C.to_samples(chunks, "v"), quality


def time_features(samples: DataFrame, size: int = C.CHUNK) -> DataFrame:
    """Twelve statistics of each signal; mobility and complexity are NULL for a constant signal."""
    return C.time_features(C.to_chunks(samples, size))


def quality_string(quality: DataFrame) -> DataFrame:
    """One line on each signal."""
    c = F.col
    notes = F.concat_ws(
        ", ",
        F.when(c("n_nan_inf_replaced") > 0, F.format_string("nan/inf fixed=%d", "n_nan_inf_replaced")),
        F.when(c("is_clipped"), F.concat(F.lit("clipped "), F.call_function("format_number", c("clipping_fraction") * 100, F.lit("0.000")), F.lit("%"))),
        F.when(c("is_saturated"), F.format_string("saturated run=%d", "saturation_longest_run")),
        F.when(c("n_outlier_samples_replaced") > 0, F.format_string("spikes fixed=%d", "n_outlier_samples_replaced")),
    )
    ok = F.when(notes == "", "OK").otherwise(F.concat(F.lit("OK ["), notes, F.lit("]")))
    return quality.select(*KEY, F.when(c("is_valid"), ok).otherwise(F.concat(F.lit("REJECTED: "), "rejection_reason")).alias("summary"))


def quality_summary(quality: DataFrame) -> DataFrame:
    """Totals and rates over all signals, in one row."""
    n = F.count("*")
    fixed, spiked = F.col("n_nan_inf_replaced") > 0, F.col("n_outlier_samples_replaced") > 0
    return quality.agg(
        n.alias("n_signals"), F.count_if("is_valid").alias("n_valid"), (F.count_if(~F.col("is_valid")) / n).alias("rejection_rate"),
        F.count_if(fixed).alias("n_fixed"), F.sum("n_nan_inf_replaced").alias("samples_fixed"), F.count_if("is_clipped").alias("n_clipped"),
        F.avg(F.when(F.col("is_clipped"), F.col("clipping_fraction"))).alias("mean_clip_fraction"), F.count_if("is_saturated").alias("n_saturated"),
        F.count_if(spiked).alias("n_despiked"), F.sum("n_outlier_samples_replaced").alias("samples_despiked"),
    )
