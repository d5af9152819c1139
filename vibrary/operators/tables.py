"""Cleaning and relevance of feature tables: one pass of aggregates each, whatever the number of rows."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import models as M
from .signals import finite
from .skew import average_ranks, quantiles, with_ranks

STRATEGIES = ("drop", "median", "mean", "zero")


def handle_nonfinite(df: DataFrame, columns: list[str], strategy: str = "drop") -> DataFrame:
    """Infinite and NaN become missing, then rows are dropped or values filled by column."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}: one of {', '.join(STRATEGIES)}")
    df = df.withColumns({c: finite(F.col(c)) for c in columns})
    if strategy == "drop":
        return df.dropna(subset=columns)
    if strategy == "zero":
        return df.fillna(0.0, subset=columns)
    if strategy == "median":
        by = {c: q[0] for c, q in quantiles(df, columns, [0.5]).items()}
    else:
        by = df.agg(*(F.avg(c).alias(c) for c in columns)).first().asDict()
    return df.fillna({c: by[c] for c in columns if by[c] is not None})


def constant_features(df: DataFrame, columns: list[str], threshold: float = 0.0) -> list[str]:
    """Columns whose sample variance is known and not above threshold; that of equal values is zero, whatever merged sums of parts leave of it."""
    by = df.agg(*(f(finite(F.col(c))).alias(f"{n}_{c}") for c in columns for n, f in (("v", F.var_samp), ("lo", F.min), ("hi", F.max)))).first()
    var = {c: 0.0 if by[f"v_{c}"] is not None and by[f"lo_{c}"] == by[f"hi_{c}"] else by[f"v_{c}"] for c in columns}
    return [c for c in columns if var[c] is not None and var[c] <= threshold]


def clean_features(
    df: DataFrame, columns: list[str], rpm_max: float | None = None, strategy: str = "drop", drop_constant: bool = True, outliers_by: str | None = None, threshold: float = 3.0, outlier_columns: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """The table after speeds, non-finite values, constant columns and outliers are dealt with, in this order, and the rows and features left after each step."""
    from .conditions import filter_operating

    steps, names = [("input", df, len(columns))], list(columns)
    if rpm_max is not None:
        df = filter_operating(df, rpm_max=rpm_max)
        steps.append(("rpm", df, len(names)))
    df = handle_nonfinite(df, names, strategy)
    steps.append(("nonfinite", df, len(names)))
    if drop_constant:
        gone = constant_features(df, names)
        df, names = df.drop(*gone), [c for c in names if c not in gone]
        steps.append(("constant", df, len(names)))
    if outliers_by:
        tested = [c for c in outlier_columns or names if c in names]
        df = outliers(df, tested, outliers_by, threshold).filter(~F.col("is_outlier")).drop("is_outlier")
        steps.append(("outliers", df, len(names)))
    counts = [(step, part.count(), n) for step, part, n in steps]
    return df, df.sparkSession.createDataFrame(counts, "step string, n_rows long, n_features int")


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(t, F.lit(False)) for t in tests), F.lit(False))


def outliers(df: DataFrame, columns: list[str], method: str = "iqr", threshold: float = 3.0) -> DataFrame:
    """df with is_outlier: some column is beyond threshold interquartile ranges from its quartiles, or sample deviations from its mean."""
    if method == "iqr":
        by = quantiles(df, columns, [0.25, 0.75])
        room = {c: threshold * (by[c][1] - by[c][0]) for c in columns if by[c][0] is not None}
        tests = [(F.col(c) < by[c][0] - room[c]) | (F.col(c) > by[c][1] + room[c]) for c in room]
    elif method == "zscore":
        by = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp), ("lo", F.min), ("hi", F.max)))).first()
        tests = [F.abs(F.col(c) - by[f"m_{c}"]) / by[f"s_{c}"] > threshold for c in columns if by[f"s_{c}"] and by[f"lo_{c}"] != by[f"hi_{c}"]]
    else:
        raise ValueError(f"unknown method {method!r}: iqr or zscore")
    return df.withColumn("is_outlier", any_of(tests))


def melted(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """A row (keep, feature, value) for each column's value."""
    return df.select(*keep, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(keep, columns, "feature", "value")


def pearson_target(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """feature and r, one aggregate for all features."""
    by = df.agg(*(F.corr(c, target).alias(c) for c in columns))
    return by.unpivot([], columns, "feature", "r")


def spearman_target(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """feature and rho: the correlation of average ranks, over the rows whose target is known."""
    known = df.select(*(F.col(c).cast("double").alias(c) for c in columns), F.col(target).cast("double").alias("_t")).filter("_t IS NOT NULL")
    ranks = with_ranks(known, [*columns, "_t"], "_r_")
    return ranks.agg(*(F.corr(f"_r_{c}", "_r__t").alias(c) for c in columns)).unpivot([], columns, "feature", "rho")


def spearman_matrix(df: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """a, b and rho of every ordered pair of columns; of very many columns, rows are known by key (unique)."""
    if len(columns) <= M.WIDE:
        ranks = with_ranks(df.select(*(F.col(c).cast("double").alias(c) for c in columns)), columns, "_r_")
        return corr_matrix(ranks.select(*(F.col(f"_r_{c}").alias(c) for c in columns)), columns).withColumnRenamed("r", "rho")
    row = F.struct(*key).alias("_row")
    ranks = average_ranks(melted(df.select(row, *columns), columns, ["_row"]), ["feature"], "value", "r")
    wide = ranks.groupBy("_row").pivot("feature", columns).agg(F.first("r"))
    return corr_matrix(wide, columns).withColumnRenamed("r", "rho")


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b and r of every ordered pair of columns, from one aggregate; of many columns, from the Gram matrix of the standardised ones."""
    if len(columns) > M.WIDE:
        r = correlations(df, columns)
        rows = [(a, b, float(r[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
        return df.sparkSession.createDataFrame(rows, "a string, b string, r double")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    by = df.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs)).unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r")
    half = by.select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "r")
    return half.union(half.filter("a <> b").select("b", "a", "r"))


def correlations(df: DataFrame, columns: list[str]) -> np.ndarray:
    """The p x p matrix, from rows without missing values; columns are centred first, so that sums of products keep their digits."""
    z = M.standardize(df.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna(), columns, F.lit(True))
    g = M.gram(z, columns[:-1], columns[-1], [])[()]
    return g[1:, 1:] / g[0, 0]


def relevance(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """rho, r, their mean size and the descending average rank of each feature."""
    both = spearman_target(df, columns, target).join(pearson_target(df, columns, target), "feature").withColumn("combined", (F.abs("rho") + F.abs("r")) / 2)
    tied = Window.partitionBy("combined")
    return both.withColumn("rank", F.rank().over(Window.orderBy(F.desc("combined"))) + (F.count("*").over(tied) - 1) / 2)


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature and variance inflation: the diagonal of the inverse correlation matrix, infinite if that is singular. Only the p x p matrix reaches the driver."""
    r = {(x.a, x.b): x.r for x in corr_matrix(df, columns).collect()}
    m = np.array([[1.0 if a == b else r[a, b] for b in columns] for a in columns], float)
    out = []
    for i, c in enumerate(columns):
        rest = [k for k in range(len(columns)) if k != i]
        share = float(m[i, rest] @ np.linalg.pinv(m[np.ix_(rest, rest)]) @ m[rest, i]) if rest else 0.0
        out.append((c, float("inf") if share >= 1 - 1e-12 else 1 / (1 - share)))
    return df.sparkSession.createDataFrame(out, "feature string, vif double")


def redundancy(pairs: DataFrame, factors: DataFrame, corr: float = 0.9, factor: float = 10.0) -> DataFrame:
    """feature, vif, high_vif, partners (others as correlated as corr) and redundant (both) for each feature, from pairs (a, b, rho) and factors (feature, vif)."""
    close = pairs.filter((F.col("a") != F.col("b")) & (F.abs("rho") >= corr)).groupBy(F.col("a").alias("feature")).agg(F.count("*").alias("partners"))
    both = factors.join(close, "feature", "left").select("feature", "vif", (F.col("vif") >= factor).alias("high_vif"), F.coalesce("partners", F.lit(0)).cast("long").alias("partners"))
    return both.withColumn("redundant", F.col("high_vif") & (F.col("partners") > 0))


def reduce_redundant(pairs: dict[tuple[str, str], float], factors: dict[str, float], worth: dict[str, float], columns: list[str], corr: float = 0.9, factor: float = 10.0) -> list[str]:
    """The columns left of groups of close ones, from tables of p x p numbers; worths are taken as distinct (of equal ones the earlier column's is the greater).

    A column goes if it is close to an inflated one of more worth. It also goes if it is inflated itself and close to
    one of more worth that stays, or that would go only by a column later than this one.
    """
    order = {c: k for k, c in enumerate(columns)}
    close = {c: [d for d in columns if d != c and abs(pairs[c, d]) >= corr] for c in columns}
    better = {c: [d for d in close[c] if (worth[d], -order[d]) > (worth[c], -order[c])] for c in columns}
    first = {c: min((order[d] for d in better[c] if factors[d] >= factor), default=len(columns)) for c in columns}
    return [c for c in columns if first[c] == len(columns) and not (factors[c] >= factor and any(order[c] < first[d] for d in better[c]))]


def binned_trend(df: DataFrame, x: str, y: str, bins: int = 12) -> DataFrame:
    """Mean of y in each of the equal, right-closed bins of x that has rows, with the bin's middle; the first bin takes its lower edge."""
    span = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.greatest(F.ceil(F.round((F.col(x) - F.col("lo")) / width, 9)), F.lit(1)).cast("int")
    rows = df.join(F.broadcast(span)).select(b.alias("bin"), (F.col("lo") + (b - 0.5) * width).alias("middle"), F.col(y).alias("_y"))
    return rows.groupBy("bin", "middle").agg(F.avg("_y").alias("mean"), F.count("*").alias("n"))


def mutual_information_matrix(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """a, b and mi of every ordered pair of columns, as binned_mutual_information has it; a column with itself gives its binned entropy."""
    half = None
    for k, c in enumerate(columns):  # one pass a column, over all that follow it
        part = binned_mutual_information(df.select(*columns, F.col(c).alias("_other")), columns[k:], "_other", bins).select(F.lit(c).alias("a"), F.col("feature").alias("b"), "mi")
        half = part if half is None else half.unionByName(part)
    return half.unionByName(half.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "mi"))


def binned_mutual_information(df: DataFrame, columns: list[str], target: str, bins: int = 10) -> DataFrame:
    """Plug-in mutual information of each feature and the target over equal-width bins."""
    names = [*columns, target]
    span = df.agg(*(F.min(c).alias(f"lo_{c}") for c in names), *(F.max(c).alias(f"hi_{c}") for c in names)).first()
    cell = lambda c: F.least(F.floor((F.col(c) - span[f"lo_{c}"]) / ((span[f"hi_{c}"] - span[f"lo_{c}"]) or 1.0) * bins), F.lit(bins - 1)).cast("int")
    long = df.select(cell(target).alias("_t"), *(cell(c).alias(c) for c in columns)).unpivot(["_t"], columns, "feature", "b")
    joint = long.groupBy("feature", "b", "_t").agg(F.count("*").alias("n"))
    w = lambda *by: Window.partitionBy("feature", *by)
    part = joint.select("feature", "n", F.sum("n").over(w("b")).alias("nb"), F.sum("n").over(w("_t")).alias("nt"), F.sum("n").over(w()).alias("total"))
    return part.groupBy("feature").agg(F.sum(F.col("n") / F.col("total") * F.ln(F.col("n") * F.col("total") / (F.col("nb") * F.col("nt")))).alias("mi"))
