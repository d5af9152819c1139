"""Splits, linear models from sufficient statistics, scores and predictions.

Linear fits need the number of rows, sums and products of columns only. One aggregate over the data gives them
for every fold; training statistics are the total less the fold's. Solving is on p x p numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def order_key(seed: int, *keys: str) -> Column:
    """The same shuffle in any engine: the md5 of seed and keys as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def bucketed_rank(df: DataFrame, key: Column, out: str, rows: int) -> DataFrame:
    """df (of so many rows) with the 0-based rank of a key of evenly spread hexadecimal digits: buckets of its first digits are numbered each, after the sum of the buckets before. A bucket has some 100,000 rows; there are 16 ** 5 at most."""
    digits = min(5, max(2, math.ceil(math.log(max(rows, 1) / 100_000, 16)))) if rows > 100_000 else 2
    df = df.withColumn("_k", key).withColumn("_b", F.left("_k", F.lit(digits)))
    first = df.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_first"))
    df = df.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_k")) - 1)
    return df.join(F.broadcast(first), "_b").withColumn(out, F.col("_first") + F.col("_r")).drop("_k", "_b", "_r", "_first")


def split_holdout(df: DataFrame, keys: list[str], share: float = 0.2, seed: int = 42) -> DataFrame:
    """Distinct keys with is_holdout: the share of keys that come first in the shuffled order."""
    distinct = df.select(*keys).distinct()
    n = distinct.count()
    return bucketed_rank(distinct, order_key(seed, *keys), "_place", n).select(*keys, (F.col("_place") < math.ceil(n * share)).alias("is_holdout"))


def kfold(df: DataFrame, keys: list[str], k: int = 5, repeats: int = 1, seed: int = 42) -> DataFrame:
    """Distinct keys with repeat and fold; each repeat shuffles anew."""
    distinct = df.select(*keys).distinct()
    n, out = distinct.count(), None
    for r in range(repeats):
        part = bucketed_rank(distinct, order_key(seed + r, *keys), "_place", n).select(*keys, F.lit(r).alias("repeat"), (F.col("_place") % k).cast("int").alias("fold"))
        out = part if out is None else out.union(part)
    return out


#: Rows of a shuffle's partition, about, where whole rows are sorted.
SORTED = 1_000_000


def with_folds(df: DataFrame, keys: list[str], keep: Callable[..., DataFrame], k: int = 5, repeats: int = 1, seed: int = 42) -> DataFrame:
    """df with folds, whose digits to the base k are the folds (see fold_of) that kfold gives each row's keys; rows with a null key are left out.

    Rows go to the buckets of a repeat's order with all they have, so nothing is joined but counts; keep(df, name, instead_of) writes
    them, a repeat in place of the one before. A key is numbered in its bucket, and the buckets before are added as the rows are read.
    """
    df = df.dropna(subset=keys).withColumn("folds", F.lit(0))
    n, before = df.count(), None
    digits = min(5, max(2, math.ceil(math.log(max(n, 1) / 100_000, 16)))) if n > 100_000 else 2
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // SORTED)
    for r in range(repeats):
        order = order_key(seed + r, *keys)
        dealt = df.withColumn("_b", F.conv(F.left(order, F.lit(digits)), 16, 10).cast("int")).repartition(parts, "_b")
        place = F.dense_rank().over(Window.partitionBy("_b").orderBy(order)) - 1
        rows = keep(dealt.withColumn("_place", place), f"repeat{r}", before)
        before = f"repeat{r}"
        sizes = rows.groupBy("_b").agg((F.max("_place") + 1).cast("long").alias("_n"))
        first = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_first"))
        fold = F.pmod(F.col("_first") + F.col("_place"), F.lit(k)).cast("int")
        df = rows.join(F.broadcast(first), "_b").withColumn("folds", F.col("folds") + fold * k**r).drop("_b", "_place", "_first")
    return df


def fold_of(repeat: int, k: int = 5) -> Column:
    """The fold of a repeat, from folds as with_folds has them."""
    return F.pmod(F.floor(F.col("folds") / k**repeat), F.lit(k)).cast("int")


def standardize(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Columns less their mean over their population deviation, both from training rows."""
    by = df.filter(train).agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    return df.withColumns({c: (F.col(c) - by[f"m_{c}"]) / (by[f"s_{c}"] or 1.0) for c in columns})


def gram(df: DataFrame, columns: list[str], target: str, by: list[str]) -> dict[tuple, np.ndarray]:
    """For each value of by, the matrix of sums of products of (1, columns, target)."""
    names = [F.lit(1.0), *(F.col(c).cast("double") for c in columns), F.col(target).cast("double")]
    p = len(names)
    if p > WIDE:
        return wide_gram(df, names, by)
    sums = [F.sum(names[i] * names[j]).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)]
    out = {}
    for r in df.groupBy(*by).agg(*sums).collect():  # one row a fold
        m = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                m[i, j] = m[j, i] = r[f"g{i}_{j}"]
        out[tuple(r[b] for b in by)] = m
    return out


#: Columns from which on products are summed in blocks by numpy; as expressions of their own they would be too many for generated code.
WIDE = 20


def wide_gram(df: DataFrame, names: list[Column], by: list[str]) -> dict[tuple, np.ndarray]:
    """The same as gram, from one matrix product a batch and value of by; partial sums are added up in two steps."""
    p = len(names)
    rows = df.select(*by, *(c.alias(f"x{i}") for i, c in enumerate(names)))
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), "_slot int", "_g array<double>"])

    def products(batches):  # noqa: ANN001, ANN202
        import pandas as pd
        from pyspark import TaskContext

        task = TaskContext.get()
        slot, sums = (task.partitionId() if task else 0) % 64, {}
        for batch in batches:
            for key, part in batch.groupby(by, dropna=False) if by else [((), batch)]:
                x = part[[f"x{i}" for i in range(p)]].to_numpy(float)
                sums[key] = sums.get(key, 0) + x.T @ x
        yield pd.DataFrame([(*k, slot, g.ravel().tolist()) for k, g in sums.items()], columns=[*by, "_slot", "_g"])

    def added(part):  # noqa: ANN001, ANN202
        out = part.iloc[:1].copy()
        out["_g"] = [np.sum(np.stack(part["_g"].to_numpy()), axis=0).tolist()]
        return out[[*by, "_slot", "_g"]]

    partial = rows.mapInPandas(products, schema).groupBy(*by, "_slot").applyInPandas(added, schema)
    out: dict[tuple, np.ndarray] = {}
    for r in partial.collect():  # at most 64 matrices a fold
        key = tuple(r[b] for b in by)
        out[key] = out.get(key, 0) + np.array(r["_g"]).reshape(p, p)
    return out


def centred(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Standardised second moments: correlations-like X'X / n and X'y / n, with means and deviations, from a Gram matrix."""
    n, mean = g[0, 0], g[0, 1:-1] / g[0, 0]
    cov, sd = g[1:-1, 1:-1] / n - np.outer(mean, mean), None
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd[sd < 1e-12] = 1.0
    y = g[0, -1] / n
    return cov / np.outer(sd, sd), (g[1:-1, -1] / n - mean * y) / sd, np.array([mean, sd]), y, n


def ridge(g: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients (of raw columns) and intercept of ridge on standardised columns."""
    xx, xy, (mean, sd), y, n = centred(g)
    w = np.linalg.solve(xx + alpha / n * np.eye(len(xy)), xy) / sd
    return w, y - float(mean @ w)


def elastic_net(g: np.ndarray, alpha: float, l1: float, rounds: int = 2000) -> tuple[np.ndarray, float]:
    """The same for elastic net, by coordinate descent on the moments: squared error over 2 n plus alpha (l1 |w| + (1 - l1) w w / 2)."""
    xx, xy, (mean, sd), y, _ = centred(g)
    w = np.zeros(len(xy))
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(w)):
            rho = xy[j] - xx[j] @ w + xx[j, j] * w[j]
            w[j] = np.sign(rho) * max(abs(rho) - alpha * l1, 0) / (xx[j, j] + alpha * (1 - l1))
        if np.abs(w - before).max() < 1e-12:
            break
    w = w / sd
    return w, y - float(mean @ w)


def squared_error(g: np.ndarray, w: np.ndarray, b: float) -> float:
    """Sum of squared residuals of a fit over the rows of a Gram matrix."""
    v = np.array([-b, *-w, 1.0])
    return float(v @ g @ v)


def elastic_net_cv(df: DataFrame, columns: list[str], target: str, fold: str, alphas: list[float], l1s: list[float]) -> tuple[dict, np.ndarray, float]:
    """Best alpha and l1 ratio by squared error over the folds, and the fit on all rows; the data are read once."""
    folds = gram(df, columns, target, [fold])
    total = sum(folds.values())
    error = lambda a, l: sum(squared_error(g, *elastic_net(total - g, a, l)) for g in folds.values())
    best = min(((error(a, l), a, l) for a in alphas for l in l1s), key=lambda x: x[0])
    w, b = elastic_net(total, best[1], best[2])
    return {"alpha": best[1], "l1_ratio": best[2], "mse": best[0] / total[0, 0]}, w, b


#: The reference's penalties.
ALPHAS, L1_RATIOS = (0.0001, 0.001, 0.01, 0.1, 0.5, 1.0, 5.0, 10.0, 100.0), (0.1, 0.3, 0.5, 0.7, 0.9, 1.0)
RIDGE_ALPHAS = tuple(float(a) for a in np.logspace(-3, 4, 15))


def elastic_net_grid(g: np.ndarray, grid: np.ndarray, rounds: int = 10_000) -> np.ndarray:
    """elastic_net for each row (alpha, l1) of the grid at once: rows of the intercept and the coefficients."""
    xx, xy, (mean, sd), y, _ = centred(g)
    one, two = grid[:, 0] * grid[:, 1], grid[:, 0] * (1 - grid[:, 1])
    w = np.zeros((len(grid), len(xy)))
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(xy)):
            rho = xy[j] - w @ xx[j] + xx[j, j] * w[:, j]
            w[:, j] = np.sign(rho) * np.maximum(np.abs(rho) - one, 0) / (xx[j, j] + two)
        if np.abs(w - before).max() < 1e-12:
            break
    w = w / sd
    return np.column_stack([y - w @ mean, w])


def elastic_net_nested(grams: dict[tuple, np.ndarray], alphas: tuple = ALPHAS, l1s: tuple = L1_RATIOS) -> dict:
    """For each fold of Gram matrices by (fold, inner), and for None, the final fit on all folds: alpha, l1_ratio, w, b.

    Penalties have the least mean squared error over the inner parts of the other folds' rows; scaling is from the rows of each fit.
    """
    grid = np.array([(a, l) for a in alphas for l in l1s])
    out = {}
    for held in [*sorted({f for f, _ in grams}), None]:
        parts: dict = {}
        for (f, i), g in grams.items():
            if f != held:
                parts[i] = parts.get(i, 0) + g
        total, error = sum(parts.values()), np.zeros(len(grid))
        for g in parts.values():
            if len(parts) > 1:
                v = np.column_stack([-elastic_net_grid(total - g, grid), np.ones(len(grid))])
                error += np.einsum("mi,ij,mj->m", v, g, v) / g[0, 0]
        best = grid[int(np.argmin(error))]
        fit = elastic_net_grid(total, best[None])[0]
        out[held] = {"alpha": float(best[0]), "l1_ratio": float(best[1]), "w": fit[1:], "b": float(fit[0])}
    return out


def poly_plans(grams: dict, columns: list[str], names: list[str], top_k: int = 5, alphas: tuple = RIDGE_ALPHAS) -> dict:
    """For each fold of Gram matrices of poly_expand's names, and for None, what ridge on the other folds' rows needs.

    The top_k columns by correlation with the target are scaled, multiplied by pairs, centred and turned to principal
    axes; all is linear in the names: row @ axes - shift. coef has a column an alpha.
    """
    out = {}
    at = {n: j for j, n in enumerate(names)}
    for held in [*sorted(grams), None]:
        g = sum(m for f, m in grams.items() if f != held)
        n, p = g[0, 0], len(columns)
        mean, y = g[0, 1:-1] / n, g[0, -1] / n
        var, cov_y = np.diag(g)[1 : p + 1] / n - mean[:p] ** 2, g[1 : p + 1, -1] / n - mean[:p] * y
        sd = np.sqrt(np.maximum(var, 0))
        ok = sd > 1e-12
        sd = np.where(ok, sd, 1.0)
        r = np.where(ok, np.abs(cov_y) / sd, -1.0)  # the target's deviation is the same for all
        top = sorted(sorted(range(p), key=lambda j: -r[j])[:top_k])
        wide = []  # rows: what stands for each scaled column and product, over (1, names)
        for a in top:
            row = np.zeros(len(names) + 1)
            row[0], row[1 + a] = -mean[a] / sd[a], 1 / sd[a]
            wide.append(row)
        for i, a in enumerate(top):
            for b in top[i:]:
                row = np.zeros(len(names) + 1)
                s = sd[a] * sd[b]
                row[1 + at[f"{columns[a]}*{columns[b]}"]] = 1 / s
                row[1 + a] -= mean[b] / s
                row[1 + b] -= mean[a] / s
                row[0] = mean[a] * mean[b] / s
                wide.append(row)
        t = np.array(wide)
        m = t @ g[:-1, 0] / n
        xx = t @ g[:-1, :-1] @ t.T - n * np.outer(m, m)
        xy = t @ g[:-1, -1] - n * m * y
        values, vectors = np.linalg.eigh((xx + xx.T) / 2)
        values = np.maximum(values, 0)
        axes = t[:, 1:].T @ vectors
        coef = (vectors.T @ xy)[:, None] / (values[:, None] + np.array(alphas))
        out[held] = {"n": n, "y": y, "axes": axes, "shift": (m - t[:, 0]) @ vectors, "values": values, "coef": coef, "top": [columns[j] for j in top]}
    return out


def leave_one_out(df: DataFrame, names: list[str], target: str, fold: str, plans: dict, alphas: tuple = RIDGE_ALPHAS) -> dict:
    """For each plan the sums of squared leave-one-out residuals of the rows it trains on, an alpha each; one map-only pass and one row a plan and partition."""
    keys = list(plans)

    def sums(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        out = np.zeros((len(keys), len(alphas)))
        for batch in batches:
            x, y, f = batch[names].to_numpy(float), batch[target].to_numpy(float), batch[fold].to_numpy()
            for k, held in enumerate(keys):
                plan, train = plans[held], f != held if held is not None else np.ones(len(f), bool)
                u = x[train] @ plan["axes"] - plan["shift"]
                rest = 1 - 1 / plan["n"] - (u * u) @ (1 / (plan["values"][:, None] + np.array(alphas)))
                e = (y[train] - plan["y"])[:, None] - u @ plan["coef"]
                out[k] += ((e / np.maximum(rest, 1e-12)) ** 2).sum(0)
        yield pd.DataFrame({"k": np.arange(len(keys)), "e": list(out)})

    rows = df.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in names), target, fold).mapInPandas(sums, "k int, e array<double>")
    found = rows.groupBy("k").agg(*(F.sum(F.col("e")[i]).alias(f"e{i}") for i in range(len(alphas)))).collect()
    return {keys[r["k"]]: np.array(r[1:], float) for r in found}


def poly_ridge_nested(df: DataFrame, columns: list[str], target: str, fold: str, top_k: int = 5, alphas: tuple = RIDGE_ALPHAS) -> tuple[DataFrame, list[str], dict]:
    """df with products of columns, their names, and for each fold and None the ridge fit on the other folds' rows: alpha by leave-one-out, w, b, and the fold's rmse.

    Columns are scaled by all rows' moments first, for precision only: each fit scales anew by its own rows.
    """
    df, names = poly_expand(standardize(df, columns, F.lit(True)), columns)
    safe = df.toDF(*(c.replace("*", "_x_") for c in df.columns))
    found = {k[0]: g for k, g in gram(safe, [c.replace("*", "_x_") for c in names], target, [fold]).items()}
    plans = poly_plans(found, columns, names, top_k, alphas)
    errors = leave_one_out(df, names, target, fold, plans, alphas)
    fits = {}
    for held, plan in plans.items():
        best = int(np.argmin(errors[held]))
        w = plan["axes"] @ plan["coef"][:, best]
        b = plan["y"] - plan["shift"] @ plan["coef"][:, best]
        fits[held] = {"alpha": float(alphas[best]), "w": w, "b": float(b), "top": plan["top"]}
        if held is not None:
            fits[held]["rmse"] = math.sqrt(max(squared_error(found[held], w, b), 0) / found[held][0, 0])
    return safe, [c.replace("*", "_x_") for c in names], fits


def bayesian_ridge_folds(grams: dict) -> dict:
    """For each fold and None, bayesian_ridge on the other folds' rows, their columns scaled; coefficients are of raw columns."""
    out = {}
    for held in [*sorted(grams), None]:
        g = sum(m for f, m in grams.items() if f != held)
        _, _, (mean, sd), _, _ = centred(g)
        t = np.eye(len(g))
        t[1:-1, 0], t[1:-1, 1:-1] = -mean / sd, np.diag(1 / sd)
        fit = bayesian_ridge(t @ g @ t.T)
        w = fit["w"] / sd
        out[held] = fit | {"w": w, "b": fit["b"] - float(mean @ w), "mean": mean, "cov": fit["cov"] / np.outer(sd, sd)}
    return out


def out_of_fold(df: DataFrame, columns: list[str], fold: str, fits: dict, yhat: str = "yhat", std: str | None = None) -> DataFrame:
    """df with each row's prediction by the fit that has not seen its fold, by a join of the coefficients on fold, and its deviation if std is named."""
    kept = [(int(f), x) for f, x in fits.items() if f is not None]
    values = lambda x: [[float(v) for v in r] for r in x.get("cov", [])]
    rows = [(f, [float(v) for v in x["w"]], float(x["b"]), [float(v) for v in x.get("mean", [])], values(x), float(x.get("noise", 0))) for f, x in kept]
    table = df.sparkSession.createDataFrame(rows, "_f int, _w array<double>, _b double, _m array<double>, _c array<array<double>>, _n double")
    df = df.join(F.broadcast(table), F.col(fold) == F.col("_f"))
    out = F.col("_b")
    for j, c in enumerate(columns):
        out = out + F.col(c) * F.col("_w")[j]
    df = df.withColumn(yhat, out)
    if std:
        form = F.col("_n")
        for i, a in enumerate(columns):
            for j, b in enumerate(columns):
                form = form + (F.col(a) - F.col("_m")[i]) * (F.col(b) - F.col("_m")[j]) * F.col("_c")[i][j]
        df = df.withColumn(std, F.sqrt(form))
    return df.drop("_f", "_w", "_b", "_m", "_c", "_n")


def fold_scores(df: DataFrame, target: str, fold: str, fits: dict, extra: list[str]) -> DataFrame:
    """regression_metrics of yhat by fold and, with a null fold, of all rows; extra are figures of the fits (for the null fold, of the final fit)."""
    each = regression_metrics(df, target, "yhat", [fold]).withColumn(fold, F.col(fold).cast("int"))
    whole = regression_metrics(df, target, "yhat").select(F.lit(None).cast("int").alias(fold), "n", "r2", "mae", "rmse")
    rows = [(None if f is None else int(f), *(float(x[e]) for e in extra)) for f, x in fits.items()]
    table = df.sparkSession.createDataFrame(rows, ", ".join(["_f int", *(f"{e} double" for e in extra)]))
    both = each.unionByName(whole)
    return both.join(F.broadcast(table), both[fold].eqNullSafe(table["_f"])).drop("_f")


def linear(columns: list[str], w: np.ndarray, b: float) -> Column:
    out = F.lit(float(b))
    for c, x in zip(columns, w, strict=True):
        out = out + F.col(c) * float(x)
    return out


def poly_expand(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """df with all products of two of the columns, and the names of the columns and products."""
    more = {f"{a}*{b}": F.col(a) * F.col(b) for i, a in enumerate(columns) for b in columns[i:]}
    return df.withColumns(more), [*columns, *more]


def regression_metrics(df: DataFrame, y: str, yhat: str, by: list[str] = (), total: bool = False) -> DataFrame:
    """n, r2, mae and rmse, in one aggregate; with total also of all rows, where by (one column, never null) is null."""
    e = F.col(y) - F.col(yhat)
    a = (df.rollup(*by) if total else df.groupBy(*by)).agg(F.count("*").alias("n"), F.sum(e * e).alias("_ss"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("_v"))
    return a.select(*by, "n", F.when(F.col("_v") > 0, 1 - F.col("_ss") / (F.col("n") * F.col("_v"))).alias("r2"), "mae", F.sqrt(F.col("_ss") / F.col("n")).alias("rmse"))


def clip_predictions(df: DataFrame, yhat: str, lo: float, hi: float) -> DataFrame:
    return df.withColumn(yhat, F.least(F.greatest(yhat, F.lit(lo)), F.lit(hi)))


def shap_linear(df: DataFrame, columns: list[str], w: np.ndarray) -> DataFrame:
    """Each row's contribution of each column to a linear prediction: its weight times the distance from the mean."""
    by = df.agg(*(F.avg(c).alias(c) for c in columns)).first()
    return df.withColumns({f"shap_{c}": (F.col(c) - by[c]) * float(x) for c, x in zip(columns, w, strict=True)})


def bayesian_ridge(g: np.ndarray, rounds: int = 300) -> dict:
    """Ridge whose noise and weight precisions maximise the evidence, by fixed-point steps on the eigenvalues of the centred moments."""
    n, mean, y = g[0, 0], g[0, 1:-1] / g[0, 0], g[0, -1] / g[0, 0]
    xx = g[1:-1, 1:-1] - n * np.outer(mean, mean)
    xy, yy = g[1:-1, -1] - n * mean * y, g[-1, -1] - n * y * y
    values, vectors = np.linalg.eigh(xx)
    values = np.maximum(values, 0)
    noise, weight = n / max(yy, 1e-12), 1.0
    for _ in range(rounds):
        cov = (vectors / (noise * values + weight)) @ vectors.T
        w = noise * cov @ xy
        used = float((noise * values / (noise * values + weight)).sum())
        rest = max(float(yy - 2 * w @ xy + w @ xx @ w), 1e-12)
        before, weight, noise = w, (used + 1e-6) / (float(w @ w) + 1e-6), (n - used + 1e-6) / (rest + 1e-6)
    return {"w": before, "b": y - float(mean @ before), "mean": mean, "cov": (vectors / (noise * values + weight)) @ vectors.T, "noise": 1 / noise}


def predict_interval(df: DataFrame, columns: list[str], fit: dict, predictive: bool = True) -> DataFrame:
    """df with yhat and std: the deviation of a new value (noise plus the quadratic form of the weights' covariance), or of the mean alone (without the noise)."""
    d = [F.col(c) - float(m) for c, m in zip(columns, fit["mean"], strict=True)]
    form = F.lit(float(fit["noise"]) if predictive else 0.0)
    for i, x in enumerate(d):
        for j, z in enumerate(d):
            form = form + x * z * float(fit["cov"][i, j])
    return df.withColumn("yhat", linear(columns, fit["w"], fit["b"])).withColumn("std", F.sqrt(form))


def permutation_importance(df: DataFrame, columns: list[str], target: str, predict, keys: list[str], rows: int = 100_000) -> DataFrame:  # noqa: ANN001
    """feature and rise of the RMSE when the feature comes from the next row in hash order, within buckets of the keys' hash of about so many rows."""
    buckets = max(64, df.count() // rows)
    order = Window.partitionBy(F.pmod(F.xxhash64(*keys), F.lit(buckets))).orderBy(F.xxhash64(*keys, F.lit(1)), *keys)
    following = df.select("*", *(F.coalesce(F.lead(c).over(order), F.first(c).over(order)).alias(f"_next{k}") for k, c in enumerate(columns)))  # of all columns by one sort
    variants = following.withColumn("_moved", F.explode(F.array(*(F.lit(k) for k in range(-1, len(columns))))))
    moved = variants.withColumns({c: F.when(F.col("_moved") == k, F.col(f"_next{k}")).otherwise(F.col(c)) for k, c in enumerate(columns)})
    rmse = {r["_moved"]: r["rmse"] for r in regression_metrics(predict(moved), target, "yhat", ["_moved"]).collect()}
    return df.sparkSession.createDataFrame([(c, rmse[k] - rmse[-1]) for k, c in enumerate(columns) if k in rmse], "feature string, rise double")


def feature_weights(spark: SparkSession, columns: list[str], w: np.ndarray) -> DataFrame:
    """feature, coefficient (signed; of trees, the importance), its size and its place by size, of a fit: a row a column, so few."""
    rows = sorted(zip(columns, map(float, w), strict=True), key=lambda x: (-abs(x[1]), x[0]))
    return spark.createDataFrame([(c, x, abs(x), k + 1) for k, (c, x) in enumerate(rows)], "feature string, coefficient double, size double, place int")


def fit_summary(df: DataFrame, columns: list[str], target: str, fold: str, fits: dict, name: str, extra: list[str]) -> DataFrame:
    """One row on a family of fits by fold: metrics of all rows by the fits that have not seen them, spread of the folds' rmse, coefficients, those that are not zero, and the final fit's figures."""
    each = fold_scores(out_of_fold(df, columns, fold, fits), target, fold, fits, extra)
    whole = each.filter(F.col(fold).isNull()).drop(fold)
    spread = each.filter(F.col(fold).isNotNull()).agg(F.stddev_samp("rmse").alias("rmse_std"))
    final = fits[None]["w"]
    return whole.crossJoin(spread).select(F.lit(name).alias("model"), "*", F.lit(len(final)).alias("n_features"), F.lit(int((np.abs(final) > 1e-10).sum())).alias("n_nonzero"))
