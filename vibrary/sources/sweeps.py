"""A source of sweep files: one file a recording, in folders by sensor and sweep, with its attributes before its samples.

A file begins with a line of JSON (sampling rate, kind of number, attributes); little-endian samples follow. Folders are the
partitions of Spark's binary file source, so filters on sensor and sweep decide which files are opened, and a query that
asks for no samples or attributes reads no contents. Files are read by Spark, from any store that it reads.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIX = ".sweep"
CONTENT = "struct<fs:double,attributes:map<string,string>,voltage:array<double>>"
KINDS = ("<f8", "<f4", "<i2")


def encoded(fs: float, attributes: dict[str, str], voltage: np.ndarray, kind: str = "<f8") -> bytes:
    head = {"fs": fs, "kind": kind, "n": len(voltage), "attributes": attributes}
    return json.dumps(head, ensure_ascii=False).encode() + b"\n" + np.asarray(voltage).astype(kind).tobytes()


def decoded(content: bytes) -> tuple[float, dict[str, str], np.ndarray]:
    """Sampling rate, attributes and samples; an error for what is not such a file or was cut off."""
    line, _, data = content.partition(b"\n")
    head = json.loads(line)
    if head["kind"] not in KINDS:
        raise ValueError(f"samples of kind {head['kind']!r} are not known: {', '.join(KINDS)}")
    x = np.frombuffer(data, head["kind"])
    if len(x) != head["n"]:
        raise ValueError(f"{len(x)} samples where {head['n']} were written")
    return head["fs"], head["attributes"], x.astype(float)


def write_sweeps(signals: DataFrame, folder: str, kind: str = "<f8") -> int:
    """A file for each row of signals (sweep, sensor, fs, voltage; other columns are its attributes, as text); the number of files.

    A file gets its name when it is complete, and a task that runs again writes the same files.
    """
    names = [c for c in signals.columns if c not in ("sweep", "sensor", "fs", "voltage")]
    rows = signals.select(F.col("sweep").cast("long"), F.col("sensor").cast("string"), F.col("fs").cast("double"), F.col("voltage").cast("array<double>"), *(F.col(c).cast("string") for c in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs as stores

        store, home = stores.FileSystem.from_uri(folder)
        count = 0
        for batch in batches:
            for sweep, sensor, rate, voltage, *more in zip(*batch.columns, strict=True):
                at = f"{home}/sensor={sensor.as_py()}/sweep={sweep.as_py()}"
                store.create_dir(at, recursive=True)
                hidden = f"{at}/_{uuid.uuid4().hex}"
                with store.open_output_stream(hidden) as out:
                    out.write(encoded(rate.as_py(), {c: x.as_py() for c, x in zip(names, more, strict=True) if x.is_valid}, np.array(voltage.as_py() or [], float), kind))
                store.move(hidden, f"{at}/samples{SUFFIX}")
                count += 1
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["n"])

    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def files(spark: SparkSession, folder: str) -> DataFrame:
    """sweep, sensor, path and length of each file, without opening any."""
    found = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary, sensor string, sweep long").option("pathGlobFilter", f"*{SUFFIX}").load(folder)
    return found.select("sweep", "sensor", "path", "length", "content")


def read_sweeps(spark: SparkSession, folder: str) -> DataFrame:
    """sweep, sensor, fs, attributes and voltage of each file. Filters on sweep and sensor, also those set on the result, choose the files that are opened."""

    @F.arrow_udf(CONTENT)
    def parts(content: pa.Array) -> pa.Array:
        made = [decoded(x.as_py()) for x in content]
        edges = pa.array(np.append(0, np.cumsum([len(v) for _, _, v in made])), pa.int32())
        voltage = pa.ListArray.from_arrays(edges, pa.array(np.concatenate([np.zeros(0), *(v for _, _, v in made)])))
        attributes = pa.array([list(a.items()) for _, a, _ in made], pa.map_(pa.string(), pa.string()))
        return pa.StructArray.from_arrays([pa.array([fs for fs, _, _ in made], pa.float64()), attributes, voltage], names=["fs", "attributes", "voltage"])

    return files(spark, folder).select("sweep", "sensor", parts("content").alias("x")).select("sweep", "sensor", "x.fs", "x.attributes", "x.voltage")
