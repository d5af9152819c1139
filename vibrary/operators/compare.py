"""Paired comparisons of models: statistics by aggregates, p-values finished on the small table of tests."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.store import kept
from .skew import numbered

#: Up to so many differences the signed-rank test is exact.
EXACT = 50
#: The step from resample to resample, and the shifts and factors that mix 32 bits.
STEP, MIXES = 0x9E3779B1, ((16, 0x85EBCA6B), (13, 0xC2B2AE35))
#: 16-bit numbers from each of these on mean one more copy: a Poisson variable of mean 1.
COPIES = [math.ceil(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(n + 1))) for n in range(8)]
WEIGHTS = np.searchsorted(COPIES, np.arange(65536), "right").astype(float)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f = c = 1.0
    d = 0.0
    for i in range(300):
        m = i // 2
        t = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + t * d or 1e-300)
        c = 1 + t / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def paired(scores: DataFrame, keys: list[str], value: str) -> DataFrame:
    """model_a, model_b, keys, a and b for each pair of models with model_a before model_b."""
    a, b = (scores.select(*keys, F.col("model").alias(f"model_{x}"), F.col(value).alias(x)) for x in "ab")
    return a.join(b, keys).filter("model_a < model_b")


def ttest_corrected(pairs: DataFrame, k: int) -> DataFrame:
    """Corrected resampled t statistic of each pair's differences; (0, 1) if they do not vary."""
    d = F.col("a") - F.col("b")
    s = pairs.groupBy("model_a", "model_b").agg(F.count("*").alias("n"), F.avg(d).alias("m"), F.var_samp(d).alias("v"))
    t = F.when(F.col("v") > 0, F.col("m") / F.sqrt((1 / F.col("n") + 1 / (k - 1)) * F.col("v"))).otherwise(0.0)
    return with_p(s.select("model_a", "model_b", "n", t.alias("t")), "t")


def with_p(tests: DataFrame, stat: str, alternative: str = "two-sided", name: str = "p", lost: int = 1) -> DataFrame:
    """tests with the Student probability of stat with n - lost degrees of freedom, for a difference (two-sided), a smaller (less) or a larger (greater) first of a pair (a row is a pair of models)."""
    if alternative not in ("two-sided", "less", "greater"):
        raise ValueError(f"unknown alternative {alternative!r}: two-sided, less or greater")
    schema = T.StructType([*tests.schema.fields, T.StructField(name, T.DoubleType())])

    def chance(t: float | None, n: int) -> float:
        if n <= lost or not t or t != t:
            return 1.0
        both = t_two_sided(t, n - lost)
        return both if alternative == "two-sided" else both / 2 if (t < 0) == (alternative == "less") else 1 - both / 2

    def run(batches):  # noqa: ANN001, ANN202
        for df in batches:
            df[name] = [chance(t, n) for t, n in zip(df[stat], df["n"], strict=True)]
            yield df

    return tests.mapInPandas(run, schema)


def correlation_p(correlations: DataFrame, r: str, n: int) -> DataFrame:
    """correlations with p_{r}: two-sided probability of a correlation of n rows under independence, by Student's t."""
    t = F.when(F.abs(r) < 1, F.col(r) * F.sqrt((n - 2) / (1 - F.col(r) * F.col(r)))).otherwise(F.lit(float("inf")))
    return with_p(correlations.withColumn("_t", t).withColumn("n", F.lit(n).cast("long")), "_t", name=f"p_{r}", lost=2).drop("_t", "n")


def diebold_mariano(pairs: DataFrame, loss: str = "squared", alternative: str = "two-sided") -> DataFrame:
    """Diebold-Mariano statistic for residuals a and b with the small-sample factor for one step."""
    size = (lambda c: F.col(c) * F.col(c)) if loss == "squared" else (lambda c: F.abs(c))
    d = size("a") - size("b")
    s = pairs.groupBy("model_a", "model_b").agg(F.count("*").alias("n"), F.avg(d).alias("m"), F.var_samp(d).alias("v"))
    stat = F.when(F.col("v") > 0, F.col("m") / F.sqrt(F.col("v") / F.col("n")) * F.sqrt((F.col("n") - 1) / F.col("n"))).otherwise(0.0)
    return with_p(s.select("model_a", "model_b", "n", stat.alias("dm")), "dm", alternative)


@lru_cache(EXACT + 1)
def signed_rank_counts(n: int) -> tuple[int, ...]:
    """How many of the 2 ** n ways to give the ranks 1 to n their signs have each sum of positive ranks."""
    counts = [1]
    for rank in range(1, n + 1):
        longer = counts + [0] * rank
        for k, c in enumerate(counts):
            longer[k + rank] += c
        counts = longer
    return tuple(counts)


def signed_rank_p(w: float, n: int) -> float:
    """Two-sided probability of a smaller signed-rank sum of at most w of n untied differences."""
    return min(1.0, 2 * sum(signed_rank_counts(n)[: int(w) + 1]) / 2**n)


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """w, the smaller sum of signed ranks of the differences in absolute errors, and two-sided p: exact for up to EXACT differences without ties, else by the normal approximation, corrected for ties; equal errors are left out, and a pair without others has w 0 and p 1."""
    key = ["model_a", "model_b"]
    d = pairs.select(*key, (F.abs("a") - F.abs("b")).alias("d")).withColumn("size", F.abs("d"))
    # equal sizes are one row before anything is sorted
    sizes = kept(d.filter("d IS NOT NULL").groupBy(*key, "size").agg(F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down")), "sizes")
    c = (F.col("up") + F.col("down")).alias("c")
    ranked = numbered(sizes.filter("size <> 0").select("*", c), key, "size", [], "before", F.col("c"))
    twice = 2 * F.col("before") + F.col("c") + 1  # the average rank, twice: a whole number
    many = F.col("c").cast("double")
    sums = [(F.sum(F.col(x) * twice) / 2).alias(x) for x in ("up", "down")]
    s = ranked.groupBy(*key).agg(F.sum("c").alias("n"), *sums, F.sum(many**3 - many).alias("ties"))
    n = F.col("n").cast("double")  # its third power is more than a long holds from 1.7 million on
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    z = F.when(sd > 0, (F.least("up", "down") - n * (n + 1) / 4) / sd).otherwise(0.0)
    found = s.select(*key, "n", F.least("up", "down").alias("w"), z.alias("z"), (F.col("ties") > 0).alias("tied"))
    every = sizes.select(*key).distinct().join(found, key, "left").na.fill({"n": 0, "w": 0.0, "z": 0.0, "tied": False})
    schema = T.StructType([*[f for f in every.schema.fields if f.name not in ("z", "tied")], T.StructField("p", T.DoubleType())])

    def chance(n: int, w: float, z: float, tied: bool) -> float:
        return signed_rank_p(w, n) if n <= EXACT and not tied else math.erfc(abs(z) / math.sqrt(2))

    def run(batches):  # noqa: ANN001, ANN202
        for df in batches:
            df["p"] = [chance(*x) for x in zip(df["n"], df["w"], df["z"], df["tied"], strict=True)]
            yield df[[f.name for f in schema]]

    return every.mapInPandas(run, schema)


def best_per_set(scores: DataFrame) -> DataFrame:
    """feature_set, model and mean_rmse of the model with the least mean score of each set (scores: feature_set, model, rmse)."""
    by = scores.groupBy("feature_set", "model").agg(F.avg("rmse").alias("mean_rmse"))
    return by.groupBy("feature_set").agg(F.min_by("model", "mean_rmse").alias("model"), F.min("mean_rmse").alias("mean_rmse"))


def pairs_within(scores: DataFrame) -> DataFrame:
    """model_a and model_b, in order, of every two models of a feature set."""
    m = scores.select("feature_set", "model").distinct()
    a, b = (m.select("feature_set", F.col("model").alias(f"model_{x}")) for x in "ab")
    return a.join(b, "feature_set").filter("model_a < model_b")


def pairs_cross(scores: DataFrame) -> DataFrame:
    """set_a, model_a, set_b and model_b of the best models of every two feature sets (a row a set, so few)."""
    best = best_per_set(scores)
    a, b = (best.select(F.col("feature_set").alias(f"set_{x}"), F.col("model").alias(f"model_{x}")) for x in "ab")
    return a.join(b, F.col("set_a") < F.col("set_b"))


def holm(tests: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """tests with holm_threshold and reject: p-values ascending, rejected while they pass alpha over the number left. Unknown p-values take no part. A table of tests is small."""
    known = tests.filter(F.col(p).isNotNull() & ~F.isnan(p))
    order = Window.orderBy(p, *[c for c in tests.columns if c != p])
    ranked = known.withColumn("_i", F.row_number().over(order)).withColumn("_m", F.count("*").over(Window.partitionBy()))
    ranked = ranked.withColumn("holm_threshold", alpha / (F.col("_m") - F.col("_i") + 1))
    ok = F.min((F.col(p) <= F.col("holm_threshold")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    done = ranked.withColumn("reject", ok == 1).drop("_i", "_m")
    rest = tests.exceptAll(known).withColumn("holm_threshold", F.lit(None).cast("double")).withColumn("reject", F.lit(None).cast("boolean"))
    return done.unionByName(rest)


def draws(hashes: np.ndarray, first: int, count: int) -> np.ndarray:
    """How often each row (a 32-bit hash) enters the resamples 2 first to 2 (first + count) - 1: a counter is mixed with the hash, and each half of the bits looked up."""
    with np.errstate(over="ignore"):
        x = hashes[:, None] + np.arange(first, first + count, dtype=np.uint32)[None] * np.uint32(STEP)
        for shift, factor in MIXES:
            x ^= x >> np.uint32(shift)
            x *= np.uint32(factor)
        x ^= x >> np.uint32(16)
    return WEIGHTS[x.view(np.uint16)]  # low half first


def bootstrap_rmse(errors: DataFrame, resamples: int = 10_000, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """Observed difference of RMSE of residuals a and b (key, a, b; a row a prediction) and its 2.5 and 97.5 percentiles over resamples, for each by (of few values).

    Each row enters a resample as often as a Poisson variable of mean 1 says: rows need no positions and resamples no
    shuffle of rows. A row's draws come from a hash of seed and key and the resample's number, in arrays; a task multiplies them with the
    squares of its rows and sends three sums for each resample.
    """
    by = by or []
    number = F.conv(F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("key").cast("string"))), F.lit(8)), 16, 10).cast("long")
    square = lambda c: F.col(c) * F.col(c)
    rows = errors.select(*by, number.alias("hash"), square("a").alias("aa"), square("b").alias("bb"))
    head = "".join(f"`{c}` {errors.schema[c].dataType.simpleString()}, " for c in by)
    pairs = (resamples + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(len(by))), strict=True)) if by else [()] * batch.num_rows
            for key in dict.fromkeys(keys):
                mine = table.filter(pa.array([k == key for k in keys])) if by else table
                h, aa, bb = (mine.column(c).to_numpy() for c in ("hash", "aa", "bb"))
                values = np.stack([aa, bb, np.ones(len(aa))])
                total = sums.setdefault(key, np.zeros((3, 2 * pairs)))
                for start in range(0, len(h), 1024):
                    part, v = h[start : start + 1024].astype(np.uint32), values[:, start : start + 1024]
                    for first in range(0, pairs, 256):
                        count = min(256, pairs - first)
                        total[:, 2 * first : 2 * (first + count)] += v @ draws(part, first, count)
        for key, total in sums.items():
            columns = [pa.array([v] * resamples) for v in key] + [pa.array(np.arange(resamples)), *(pa.array(x[:resamples]) for x in total)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    kind = errors.sparkSession.createDataFrame([], f"{head}j long, aa double, bb double, n double").schema
    arrow = to_arrow_schema(kind)
    each = rows.mapInArrow(run, kind).groupBy(*by, "j").agg(*(F.sum(c).alias(c) for c in ("aa", "bb", "n")))
    d = F.sqrt(F.col("aa") / F.col("n")) - F.sqrt(F.col("bb") / F.col("n"))
    ci = each.groupBy(*by).agg(F.percentile(d, 0.025).alias("ci_lo"), F.percentile(d, 0.975).alias("ci_hi"))
    seen = errors.groupBy(*by).agg((F.sqrt(F.avg(square("a"))) - F.sqrt(F.avg(square("b")))).alias("delta_rmse"))
    return seen.join(ci, by) if by else seen.join(ci)


def perf_summary(scores: DataFrame) -> DataFrame:
    """Mean, sample deviation, their difference and number of each model's scores."""
    a = scores.groupBy("model").agg(F.avg("rmse").alias("mean_rmse"), F.stddev_samp("rmse").alias("std_rmse"), F.count("*").alias("n_scores"))
    return a.withColumn("mean_minus_std", F.col("mean_rmse") - F.col("std_rmse"))


def importance_agreement(weights: DataFrame, top: int = 10) -> DataFrame:
    """Features in some model's top by importance, in how many models' tops, and each model's rank (weights: model, feature, importance)."""
    order = Window.partitionBy("model").orderBy(F.desc("importance"))
    tied = Window.partitionBy("model", "importance")
    rank = F.floor(F.rank().over(order) + (F.count("*").over(tied) - 1) / 2).cast("int")
    ranked = weights.withColumn("rank", rank).withColumn("top", F.row_number().over(order.orderBy(F.desc("importance"), "feature")) <= top)
    return ranked.groupBy("feature").agg(F.count_if("top").alias("n_top"), F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank")).filter("n_top > 0")
