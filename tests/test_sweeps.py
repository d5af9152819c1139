"""Sweep files: round trip, and which files a filter opens."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vibrary.sources import sweeps


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory) -> str:  # noqa: ANN001
    path = f"file://{tmp_path_factory.mktemp('sweeps')}"
    rows = [(k, s, 800_000.0, [float(k), -0.5, float("nan")][: k % 4], f"r{k}" if k % 2 else None, k * 1.5) for k in range(12) for s in ("AE", "UL")]
    df = spark.createDataFrame(rows, "sweep long, sensor string, fs double, voltage array<double>, run string, rpm double")
    assert sweeps.write_sweeps(df.repartition(3), path) == 24
    assert sweeps.write_sweeps(df.filter("sweep = 3"), path) == 2  # again
    return path


def opened(df) -> tuple[int, str]:  # noqa: ANN001
    """Files that a query reads, and its plan."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    while node.children().size():
        node = node.children().head()
    return node.metrics().apply("numFiles").value(), node.toString()


def test_round_trip(spark, folder) -> None:  # noqa: ANN001
    got = {(r.sweep, r.sensor): r for r in sweeps.read_sweeps(spark, folder).collect()}
    assert len(got) == 24
    for (k, _), r in got.items():
        assert r.fs == 800_000.0 and np.allclose(r.voltage, [float(k), -0.5, float("nan")][: k % 4], equal_nan=True)
        assert r.attributes == ({"run": f"r{k}"} if k % 2 else {}) | {"rpm": str(k * 1.5)}
    assert not [f for _, _, fs in os.walk(folder.removeprefix("file://")) for f in fs if f.startswith("_")]


def test_filters_choose_files(spark, folder) -> None:  # noqa: ANN001
    every = sweeps.read_sweeps(spark, folder)
    assert opened(every)[0] == 24
    some = every.filter((F.col("sweep").between(4, 6)) & (F.col("sensor") == "UL")).select("sweep", F.size("voltage").alias("n"))
    n, plan = opened(some)
    assert n == 3 and "PartitionFilters: [" in plan and {(r.sweep, r.n) for r in some.collect()} == {(4, 0), (5, 1), (6, 2)}
    assert opened(every.filter("sweep IN (1, 11)"))[0] == 4


def test_listing_opens_nothing(spark, folder) -> None:  # noqa: ANN001
    listed = sweeps.files(spark, folder).select("sweep", "sensor", "length")
    assert listed.count() == 24 and "content" not in opened(listed)[1].split("ReadSchema")[-1]


def test_kinds_and_broken_files() -> None:
    x = np.array([1.0, -2.0, 3.0])
    for kind in sweeps.KINDS:
        fs, attributes, got = sweeps.decoded(sweeps.encoded(1.0, {"ü": "é\n"}, x, kind))
        assert fs == 1.0 and attributes == {"ü": "é\n"} and (got == x).all()
    with pytest.raises(ValueError, match="2 samples where 3"):
        sweeps.decoded(sweeps.encoded(1.0, {}, x)[:-8])
    with pytest.raises(ValueError, match="not known"):
        sweeps.decoded(sweeps.encoded(1.0, {}, x).replace(b"<f8", b"<c8"))
