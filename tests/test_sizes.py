"""What shows only on more rows than the given tables have, or on rows made to meet it."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vibrary.operators import compare, signals, skew, tables
from vibrary.plans import extract_queries, more_queries  # noqa: F401
from vibrary.plans.registry import ORACLES, QUERIES

from test_oracles import rows



def test_wilcoxon_of_two_million(spark) -> None:  # noqa: ANN001
    n = 2_000_000
    d = F.when(F.col("id") % 2 == 0, F.col("id") + 1).otherwise(-F.col("id") - 1).cast("double")
    pairs = spark.range(n).select(F.lit("A").alias("model_a"), F.lit("B").alias("model_b"), F.when(d > 0, d).otherwise(0.0).alias("a"), F.when(d < 0, d).otherwise(0.0).alias("b"))
    got = compare.wilcoxon(pairs).first()
    w = (n // 2) ** 2  # the sum of the odd numbers
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    assert (got.n, got.w) == (n, w)
    assert math.isclose(got.p, math.erfc(abs(z) / math.sqrt(2)), rel_tol=1e-9)


def test_percent_of_clipping_is_rounded_from_the_exact_value(spark) -> None:  # noqa: ANN001
    """17 of 64 is 26.5625 %: halfway, so to the even digit; 26.5635 lies below its last digit."""
    shares = [17 / 64, 0.265635, 1.0]
    fields = "sweep long, sensor string, rejection_reason string, clipping_fraction double, is_clipped boolean, saturation_longest_run long, is_saturated boolean, n_nan_inf_replaced long, n_outlier_samples_replaced long, is_valid boolean"
    df = spark.createDataFrame([(k, "AE", None, s, True, 0, False, 0, 0, True) for k, s in enumerate(shares)], fields)
    got = {r.sweep: r.summary for r in signals.quality_string(df).collect()}
    assert got == {k: f"OK [clipped {s * 100:.3f}%]" for k, s in enumerate(shares)}


@pytest.mark.parametrize("name", ["sig_quality_string", "sig_reject", "assemble_metadata"])
def test_rails_between_equal_values(spark, tmp_path, name) -> None:  # noqa: ANN001
    """The two lowest of 73 samples are 0.12, and so is the lower rail; another signal has 17 of 64 at its rail."""
    draw = random.Random(1)
    events = [(k, 60, 0.12 if k < 2 else 1 + draw.random() * 200) for k in range(73)] + [(200 + k, 63, 70.0 if k < 17 else 1 + k / 2) for k in range(64)]
    spark.createDataFrame(events, "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.sql(ORACLES[name]).df())


def test_equal_means_are_ties(spark, tmp_path) -> None:  # noqa: ANN001
    """All groups have the same discounts, each in another order, so sums of doubles differ in their last digits."""
    draw, values = random.Random(2), [k % 11 / 100 for k in range(997)]
    lines = [(g, v) for g in range(20) for v in draw.sample(values, len(values))]
    spark.createDataFrame(lines, "l_suppkey long, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = QUERIES["holm"](spark, str(tmp_path)).toPandas()
    assert got.sort_values("holm_threshold").test.tolist() == list(range(20))
    assert rows(got) == rows(con.sql(ORACLES["holm"]).df())


@pytest.mark.parametrize("few", [10, 60, 10_000])
def test_ranks_with_and_without_a_join(spark, monkeypatch, few) -> None:  # noqa: ANN001
    """Columns of few and of many values, some null, and one that half of the rows share."""
    monkeypatch.setattr(skew, "FEW", few)
    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    r = np.random.default_rng(3)
    data = [(int(r.integers(0, 5)), None if k % 7 == 0 else float(r.integers(0, 40)), 1.5 if k % 2 else float(r.normal()), k) for k in range(600)]
    df = spark.createDataFrame(data, "x int, y double, z double, k long")
    got = skew.with_ranks(df, ["x", "y", "z"]).toPandas()
    assert sorted(got.k) == list(range(600))
    for c in "xyz":
        assert np.allclose(got[f"_r_{c}"], got[c].rank(), equal_nan=True)
    want = got[["x", "y", "z"]].corr(method="spearman")
    for a in tables.spearman_matrix(df, ["x", "y", "z"], ["k"]).collect():
        if "y" not in (a.a, a.b):
            assert math.isclose(a.rho, want.loc[a.a, a.b], abs_tol=1e-12)


def test_ranks_move_no_rows(spark) -> None:  # noqa: ANN001
    """Where columns have few values, their ranks go to the rows: no exchange above the counts."""
    df = spark.range(1000).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 11).cast("double").alias("y"))
    plan = skew.with_ranks(df, ["x", "y"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_nested_folds_hold_each_row_once(spark, monkeypatch) -> None:  # noqa: ANN001
    """No pass of nested_cv_scores reads a row once for each repeat."""
    from vibrary.operators import models

    counts = []
    monkeypatch.setattr(models, "gram", lambda df, *a: counts.append(df.cache().count()) or {(0, 0): np.eye(6)})
    monkeypatch.setattr(models, "elastic_net_nested", lambda own: {})
    monkeypatch.setattr(models, "poly_ridge_nested", lambda df, *a: counts.append(df.count()) or (None, None, {}))
    monkeypatch.setattr(spark, "createDataFrame", lambda *a: spark.range(0))
    QUERIES["nested_cv_scores"](spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert counts == [n] * 20


def test_equal_values_have_no_variance(spark, tmp_path) -> None:  # noqa: ANN001
    """Merged after another, a part of 49 rows leaves a trace: 49 times a 49th is not one in doubles."""
    df = spark.range(0, 98, 1, 2).select(F.lit(1.0).alias("flat"), F.col("id").cast("double").alias("x"))
    assert df.agg(F.var_samp("flat")).first()[0] > 0
    assert tables.constant_features(df, ["flat", "x"]) == ["flat"]
    assert tables.outliers(df, ["flat"], "zscore", 0.5).filter("is_outlier").count() == 0
    lines = spark.range(0, 98, 1, 2).select(
        F.col("id").alias("l_orderkey"), (51 + F.col("id") % 40).alias("l_partkey"), (F.col("id") % 9).alias("l_suppkey"), (F.col("id") % 7).cast("int").alias("l_linenumber"),
        (1 + F.col("id") % 50).cast("double").alias("l_quantity"), (F.col("id") * 3.5).alias("l_extendedprice"), (F.col("id") % 11 / 100).alias("l_discount"), (F.col("id") % 9 / 100).alias("l_tax"),
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("clean_features", "cleaned_features"):
        assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.sql(ORACLES[name]).df())


def test_folds_travel_with_their_rows(spark) -> None:  # noqa: ANN001
    """The folds of every repeat are kfold's, equal keys have one, null keys none; nothing that was written is left, and no row is joined to its folds."""
    import os

    from vibrary.operators import models
    from vibrary.sources import store

    df = spark.range(0, 500, 1, 3).select((F.col("id") % 97).alias("a"), F.when(F.col("id") % 50 != 49, F.col("id") % 11).alias("b"), F.col("id").alias("x"))
    want = df.join(models.kfold(df.dropna(), ["a", "b"], 5, repeats=3), ["a", "b"]).select("x", "repeat", "fold").toPandas()
    base = store.scratch(spark, "").removeprefix("file:")
    there = set(os.listdir(base)) if os.path.isdir(base) else set()
    with store.passing(spark, "folds") as keep:
        f = models.with_folds(df, ["a", "b"], keep, 5, 3)
        plan = f._jdf.queryExecution().executedPlan().toString()
        got = f.select("x", *(models.fold_of(r).alias(str(r)) for r in range(3))).toPandas().melt("x", var_name="repeat", value_name="fold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert set(os.listdir(base)) == there
    assert {(int(r.x), int(r.repeat), int(r.fold)) for r in got.itertuples()} == {(r.x, r.repeat, r.fold) for r in want.itertuples()} and len(got) == 490 * 3
