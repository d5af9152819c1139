"""Partitions replaced in place, stopped at any step."""

from __future__ import annotations

import os

import pytest

from vibrary.sources import store

OLD = [("AE", 1, 1.0), ("AE", 2, 2.0), ("UL", 1, 3.0), (None, 1, 4.0)]
NEW = [("UL", 1, 30.0), ("UL", 7, 70.0), ("new one/ü", 1, 5.0)]
AFTER = sorted([*OLD[:2], OLD[3], *NEW], key=str)


def table(spark, path: str) -> list:  # noqa: ANN001
    return sorted((tuple(r) for r in store.read_in_place(spark, path).select("sensor", "sweep", "v").collect()), key=str)


@pytest.fixture
def path(spark, tmp_path) -> str:  # noqa: ANN001
    at = f"file://{tmp_path}/features"
    store.upsert_in_place(spark.createDataFrame(OLD, "sensor string, sweep long, v double"), at, sort=["sweep"])
    assert table(spark, at) == sorted(OLD, key=str)
    return at


@pytest.fixture
def new(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame(NEW, "sensor string, sweep long, v double")


def files(path: str) -> dict[str, float]:
    root = path.removeprefix("file://")
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root) for f in fs if f.startswith("part-")}


def test_other_partitions_are_not_touched(spark, path, new) -> None:  # noqa: ANN001
    before = {f: t for f, t in files(path).items() if "sensor=UL" not in f}
    store.upsert_in_place(new, path, sort=["sweep"])
    assert table(spark, path) == AFTER
    assert before.items() <= files(path).items() and not any("staged" in f for f in files(path))


def test_stopped_before_the_commit(spark, path, new) -> None:  # noqa: ANN001
    store.stage(new, path)
    assert sorted((tuple(r) for r in spark.read.parquet(path).select("sensor", "sweep", "v").collect()), key=str) == sorted(OLD, key=str)  # readers do not see it
    assert table(spark, path) == sorted(OLD, key=str) and not any("staged" in f for f in files(path))


@pytest.mark.parametrize("renames", [0, 1, 2])
def test_stopped_after_the_commit(spark, path, new, monkeypatch, renames) -> None:  # noqa: ANN001
    staged = store.stage(new, path)
    store.commit(spark, path, staged)
    with pytest.raises(FileExistsError):
        store.commit(spark, path, staged)
    real = store._files
    done = []

    class Stopping:
        """A file system that fails at a rename after some."""

        def __init__(self, fs) -> None:  # noqa: ANN001
            self.fs = fs

        def __getattr__(self, name: str):  # noqa: ANN204
            return getattr(self.fs, name)

        def rename(self, a, b) -> bool:  # noqa: ANN001
            if len(done) == renames:
                raise RuntimeError("stopped")
            done.append(b)
            return self.fs.rename(a, b)

    monkeypatch.setattr(store, "_files", lambda spark, p: (Stopping(real(spark, p)[0]), real(spark, p)[1]))
    if renames < 2:
        with pytest.raises(RuntimeError):
            store.recover(spark, path)
    else:
        store.recover(spark, path)
    monkeypatch.setattr(store, "_files", real)
    assert table(spark, path) == AFTER
    store.upsert_in_place(new, path)
    assert table(spark, path) == AFTER


def test_more_columns_and_no_rows(spark, path) -> None:  # noqa: ANN001
    store.upsert_in_place(spark.createDataFrame([("XX", 1, 2.0, "more")], "sensor string, sweep long, v double, note string"), path)
    got = {r.sensor: r.note for r in store.read_in_place(spark, path).collect()}
    assert got["XX"] == "more" and got["AE"] is None
    store.upsert_in_place(spark.createDataFrame([], "sensor string, sweep long, v double"), path)
    assert {r.sensor for r in store.read_in_place(spark, path).collect()} == {"AE", "UL", "XX", None}
