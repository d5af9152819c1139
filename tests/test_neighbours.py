"""Mutual information from neighbours against an estimator over all pairs of rows."""

from __future__ import annotations

import itertools
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vibrary.operators import neighbours, skew
from vibrary.sources import store


def plain_digamma(n: np.ndarray) -> np.ndarray:
    top = int(np.max(n))
    return -0.5772156649015329 + np.append(0.0, np.cumsum(1 / np.arange(1, top + 1)))[np.asarray(n, int) - 1]


def plain_information(x: np.ndarray, y: np.ndarray, k: int) -> float:
    dx, dy = (np.abs(v[:, None] - v[None]) for v in (x, y))
    for d in (dx, dy):
        np.fill_diagonal(d, np.inf)
    r = np.sort(np.maximum(dx, dy), axis=1)[:, k - 1 : k]
    a, b = ((d < r).sum(axis=1) for d in (dx, dy))
    return max(0.0, float(plain_digamma(np.array([len(x)]))[0] + plain_digamma(np.array([k]))[0] - (plain_digamma(a + 1) + plain_digamma(b + 1)).mean()))


@pytest.fixture(scope="module")
def table(spark):  # noqa: ANN001, ANN201
    r = np.random.default_rng(12)
    n = 2000
    x = r.normal(size=n)
    columns = {
        "x": x, "line": 2 * x + 0.1 * r.normal(size=n), "circle": np.cos(3 * x) + 0.05 * r.normal(size=n), "noise": r.exponential(size=n) * 1e4, "few": np.round(x), "same": np.full(n, 3.0),
        "third": np.where(r.random(n) < 0.34, 1.0, r.normal(size=n) * 100),
    }
    rows = [(k, *(float(c[k]) for c in columns.values())) for k in range(n)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in columns)).repartition(4)


@pytest.mark.parametrize("cell", [40, 5000])
def test_information_of_all_pairs(table, monkeypatch, cell) -> None:  # noqa: ANN001
    monkeypatch.setattr(neighbours, "CELL", cell)
    monkeypatch.setattr(neighbours, "ASKED", 50)
    pairs = list(itertools.combinations([c for c in table.columns if c != "id"], 2))
    k = 5
    got = {(r.a, r.b): r.mi for r in neighbours.mutual_information(table, pairs, ["id"], k).collect()}
    planes = neighbours.planes(table, pairs, ["id"]).toPandas()
    for i, pair in enumerate(pairs):
        own = planes[planes.pair == i]
        assert got[pair] == pytest.approx(plain_information(own.x.to_numpy(), own.y.to_numpy(), k), abs=1e-9), pair
    assert got["x", "line"] > 2 and got["x", "circle"] > 1 and got["x", "noise"] < 0.05 and got["x", "few"] > 0.8


def test_scaling_and_noise(table) -> None:  # noqa: ANN001
    p = neighbours.planes(table, [("noise", "few")], ["id"]).toPandas()
    assert p.x.std(ddof=0) == pytest.approx(1) and p.y.nunique() == len(p) and (p.y * table.agg(F.stddev_pop("few")).first()[0]).round(6).nunique() < 12


def test_unknown_values_and_few_rows(spark) -> None:  # noqa: ANN001
    rows = [(k, float(k), float(k * k)) for k in range(9)] + [(10, None, 1.0), (11, float("nan"), 1.0), (12, 1.0, float("inf"))]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    assert neighbours.planes(df, [("x", "y")], ["id"]).count() == 9
    assert neighbours.mutual_information(df, [("x", "y")], ["id"], 3).first().mi > 0.3
    assert neighbours.mutual_information(df, [("x", "y")], ["id"], 9).first().mi is None
    assert neighbours.mutual_information(df.limit(0), [("x", "y")], ["id"]).first().mi is None


def test_digamma(spark) -> None:  # noqa: ANN001
    got = [r[0] for r in spark.range(1, 60).select(neighbours.digamma(F.col("id").cast("double"))).collect()]
    assert np.allclose(got, plain_digamma(np.arange(1, 60)), atol=1e-12)


@pytest.mark.parametrize("gaps", [2, 1000])
def test_counts_over_ranges(table, monkeypatch, gaps) -> None:  # noqa: ANN001
    """Ends that lie in other ranges, in gaps that all tasks know or not, and cells of few rows without a bound on their number."""
    monkeypatch.setattr(neighbours, "GAPS", gaps)
    monkeypatch.setattr(neighbours, "CELL", 40)
    monkeypatch.setattr(skew, "RANGE_ROWS", 150)
    pairs = [("x", "few"), ("few", "third"), ("line", "noise")]
    got = {(r.a, r.b): r.mi for r in neighbours.mutual_information(table, pairs, ["id"], 5).collect()}
    planes = neighbours.planes(table, pairs, ["id"]).toPandas()
    for i, pair in enumerate(pairs):
        own = planes[planes.pair == i]
        assert got[pair] == pytest.approx(plain_information(own.x.to_numpy(), own.y.to_numpy(), 5), abs=1e-9), pair


def test_neighbours_take_work_in_step_with_rows() -> None:
    """Forty thousand rows of a cell, tied or not, in seconds: each is compared with few others."""
    r = np.random.default_rng(5)
    for xy in (r.normal(size=(40_000, 2)), np.round(r.normal(size=(40_000, 2))) + 1e-10 * r.normal(size=(40_000, 2))):
        start = time.process_time()
        near = neighbours.nearest(xy, xy, 5, True)
        assert time.process_time() - start < 6
        some = r.integers(0, len(xy), 50)
        for k in some:
            d = np.abs(xy - xy[k]).max(axis=1)
            assert np.array_equal(np.sort(d)[1:6], near[k])


def test_nothing_is_left_on_disk(spark, table) -> None:  # noqa: ANN001
    """What a pair writes is gone before the result is read, so disk does not grow with the number of pairs; settings are as before."""
    before = spark.conf.get(store.SHUFFLES_GO)
    base = store.scratch(spark, "").removeprefix("file:")
    there = set(os.listdir(base)) if os.path.isdir(base) else set()
    assert len(neighbours.mutual_information(table, [("x", "line"), ("x", "few")], ["id"]).collect()) == 2
    assert set(os.listdir(base)) == there and spark.conf.get(store.SHUFFLES_GO) == before


def test_cells_are_cut_between_equal_values() -> None:
    """Ten values of one column, parted by noise only: no cut goes through one of them, though cells of halves would."""
    r = np.random.default_rng(8)
    sample = np.stack([r.integers(0, 10, 4000) + 1e-10 * r.normal(size=4000), r.uniform(size=4000)], axis=1)
    cells = neighbours.cut(sample, 4)
    at = cells.value[cells.axis == 0]
    assert len(at) and np.abs(at - np.round(at)).min() > 1e-3
    sizes = np.bincount(neighbours.leaf_of(cells, sample), minlength=4)
    assert sizes.sum() == 4000 and sizes.max() < 1.5 * 1000


def test_known_gaps_and_open_ends() -> None:
    """Counts before ends that lie between runs are known, those of ends within a run are not."""
    axis = neighbours.Axis(np.array([5.0]), np.array([0, 3]), np.array([1.0, 8.0]), np.array([4.0, 9.0]), np.array([0, 3, 7]))
    end = np.array([0.5, 1.0, 2.0, 4.0, 6.0, 8.0, 8.5, 9.0, 10.0])
    assert neighbours.before(axis, end, True).tolist() == [0, 0, -1, -1, 3, 3, -1, -1, 7]  # how many are less
    assert neighbours.before(axis, end, False).tolist() == [0, -1, -1, 3, 3, -1, -1, 7, 7]  # how many are not greater
    assert np.allclose(neighbours.psi(np.arange(1, 60)), plain_digamma(np.arange(1, 60)), atol=1e-13)
