"""Correlations and elimination of 2,000 columns against plain loops."""

from __future__ import annotations

import numpy as np
import pytest

from vibrary.operators import tables, wide


@pytest.fixture(scope="module")
def x() -> np.ndarray:
    r = np.random.default_rng(21)
    base = r.normal(size=(120, 500))
    x = np.concatenate([base + s * r.normal(size=base.shape) for s in (0.0, 0.2, 0.45, 0.6)], axis=1)
    x[:, 7] = 3.0
    return x * 1e3 + 1e5


def test_close_pairs_and_what_stays(spark, x, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(wide, "MET", 2)
    monkeypatch.setattr(wide, "HELD", 8 * wide.BLOCK**2 * 20)  # two readings of the rows
    n, p = x.shape
    names = [f"c{k}" for k in range(p)]
    rows = [([float(v) for v in row],) for row in x] + [([float("nan")] * p,), (None,), ([1.0],)]
    df = spark.createDataFrame(rows, "x array<double>").repartition(5)
    edges = wide.close_pairs(df, names, 0.9)
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.nan_to_num(np.corrcoef(x.T))
    got = {(e.a, e.b): e.r for e in edges.collect()}
    want = {(names[i], names[j]): r[i, j] for i, j in zip(*np.nonzero(np.abs(r) >= 0.9)) if i != j}
    assert got.keys() == want.keys() and len(got) > 2000 and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)
    g = np.random.default_rng(22)
    worth, inflation = g.integers(0, 400, p) / 400, g.uniform(0, 20, p)
    table = spark.createDataFrame([(c, k, float(w), float(f)) for k, (c, w, f) in enumerate(zip(names, worth, inflation, strict=True))], "feature string, place int, worth double, inflation double")
    stays = {row.feature for row in wide.without_close(edges, table).collect()}

    class Pairs(dict):
        def __missing__(self, key: tuple) -> float:
            return 0.0

    assert stays == set(tables.reduce_redundant(Pairs(got), dict(zip(names, inflation, strict=True)), dict(zip(names, worth, strict=True)), names))
    # and by the rule itself: from the least worth on, each column meets its inflated close ones in order, until it is the lesser
    order = {c: k for k, c in enumerate(names)}
    rank = lambda c: (worth[order[c]], -order[c])
    near: dict[str, list[str]] = {}
    for a, b in got:
        near.setdefault(a, []).append(b)
    gone: set[str] = set()
    for c in sorted(names, key=rank):
        for d in sorted(near.get(c, []), key=order.get):
            if c not in gone and d not in gone and inflation[order[d]] >= 10:
                gone.add(min(c, d, key=rank))
    assert stays == set(names) - gone


def test_nothing_to_compare(spark) -> None:  # noqa: ANN001
    assert wide.close_pairs(spark.createDataFrame([], "x array<double>"), ["a"], 0.5).collect() == []
    one = spark.createDataFrame([([1.0, 2.0],), ([2.0, 4.0],)], "x array<double>")
    assert {(e.a, e.b) for e in wide.close_pairs(one, ["a", "b"], 0.9).collect()} == {("a", "b"), ("b", "a")}
