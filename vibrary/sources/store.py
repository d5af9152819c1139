"""Tables in and out: discovery by name, writing by sensor, replacing a sensor's rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A place all executors see: below spark.checkpoint.dir. Where that is unset, a local session gets a temporary folder; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written below the shared folder and read again, for what is used more than once."""
    path = scratch(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Whether the files of a query's shuffles go as soon as it is done.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing(spark: SparkSession, name: str) -> Iterator[Callable[..., DataFrame]]:
    """What keeps a DataFrame (under a name of its own) until the end of the block, where all that was kept is deleted, or until another is kept in place of it. Files of shuffles in the block go with the query that made them."""
    folder, before = scratch(spark, f"{name}-{uuid.uuid4().hex}"), spark.conf.get(SHUFFLES_GO, "false")

    def keep(df: DataFrame, part: str, instead_of: str | None = None) -> DataFrame:
        df.write.parquet(f"{folder}/{part}")
        if instead_of:
            fs, make = _files(spark, folder)
            fs.delete(make(f"{folder}/{instead_of}"), True)
        return spark.read.schema(df.schema).parquet(f"{folder}/{part}")

    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield keep
    finally:
        spark.conf.set(SHUFFLES_GO, before)
        fs, make = _files(spark, folder)
        fs.delete(make(folder), True)


def discover(spark: SparkSession, folder: str, patterns: list[str]) -> DataFrame:
    """The Parquet files of a folder whose stem matches one of the patterns, each once and with its name in column file; an error if there are none."""
    if not patterns:
        raise FileNotFoundError(f"no pattern given for {folder}")
    try:  # one pattern of alternatives, so that a file that several match is read once
        found = spark.read.option("mergeSchema", True).parquet(f"{folder}/{{{','.join(patterns)}}}.parquet")
    except AnalysisException as e:
        raise FileNotFoundError(f"no file in {folder} matches {', '.join(patterns)}") from e
    return found.withColumn("file", F.regexp_replace(F.col("_metadata.file_name"), r"\.parquet$", ""))


def first_available(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The first of the paths that can be read."""
    for p in paths:
        try:
            return spark.read.parquet(p)
        except AnalysisException:
            continue
    return None


def feature_pair(spark: SparkSession, folder: str, names: tuple[str, str] = ("features", "metadata")) -> tuple[DataFrame, DataFrame]:
    """The feature and the metadata table of a folder; an error that names what is missing."""
    found = [first_available(spark, [f"{folder}/{n}.parquet"]) for n in names]
    missing = [n for n, df in zip(names, found, strict=True) if df is None]
    if missing:
        raise FileNotFoundError(f"no {' and '.join(missing)} in {folder}")
    return found[0], found[1]


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """Each table as folder/name.kind (parquet, csv with a header, or json)."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite").option("header", True)
        writer.format(kind).save(f"{folder}/{name}.{kind}")


def write_eda_cache(features: DataFrame, conditions: DataFrame, folder: str) -> None:
    """Features, and one row of conditions for each distinct sweep, as the pair that feature_pair reads."""
    key = [c for c in ("file", "sweep") if c in conditions.columns]
    write_tables({"features": features, "metadata": conditions.dropDuplicates(key)}, folder)


def write_by_sensor(df: DataFrame, path: str) -> None:
    """One folder a sensor, so that a sensor can be read or replaced alone."""
    df.write.partitionBy("sensor").mode("overwrite").parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the key values that new has, and new. The values (sensors) are few and known before the rows are read, so rows are filtered where they are."""
    gone = [r[0] for r in new.select(key).distinct().collect()]
    kept = old.filter(~F.coalesce(F.col(key).isin(gone), F.lit(False))) if gone else old
    return kept.unionByName(new, allowMissingColumns=True)


# --- replacing a sensor's rows in place

COMMIT = "_commit"


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    """The file system of a path and what makes paths of it."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def stage(new: DataFrame, path: str, key: str = "sensor", sort: list[str] | None = None) -> str:
    """new written below path, where no reader of path looks, a folder for each key value, sorted within files; the name of the folder."""
    name = f"_staged-{uuid.uuid4().hex}"
    rows = new.sortWithinPartitions(key, *(sort or []))
    rows.write.partitionBy(key).parquet(f"{path}/{name}")
    return name


def commit(spark: SparkSession, path: str, staged: str) -> None:
    """From here on the staged rows are the table's: a file, put there in one step, names their folder."""
    fs, make = _files(spark, path)
    written = make(f"{path}/{COMMIT}-{uuid.uuid4().hex}")
    out = fs.create(written, False)
    out.write(bytearray(staged.encode()))
    out.close()
    if not fs.rename(written, make(f"{path}/{COMMIT}")):
        fs.delete(written, False)
        raise FileExistsError(f"another change of {path} is not done yet")


def recover(spark: SparkSession, path: str) -> None:
    """Carries out a committed change of the table at path to its end, from wherever it was stopped; a change that was not committed leaves nothing.

    Every step can be done again: a partition goes only while its staged one is there to take its place.
    """
    fs, make = _files(spark, path)
    named = make(f"{path}/{COMMIT}")
    if fs.exists(named):
        stream = fs.open(named)
        staged = bytes(stream.readAllBytes()).decode()
        stream.close()
        home = make(f"{path}/{staged}")
        for part in fs.listStatus(home) if fs.exists(home) else []:
            name = part.getPath().getName()
            if part.isDirectory() and "=" in name:
                target = make(f"{path}/{name}")
                fs.delete(target, True)
                if not fs.rename(part.getPath(), target):
                    raise OSError(f"{name} could not be put in its place")
        fs.delete(home, True)
        fs.delete(named, False)
    for left in fs.listStatus(make(path)) if fs.exists(make(path)) else []:
        if left.getPath().getName().startswith("_staged-"):
            fs.delete(left.getPath(), True)


def upsert_in_place(new: DataFrame, path: str, key: str = "sensor", sort: list[str] | None = None) -> None:
    """The table at path with the partitions of new's key values replaced by new's rows; those of other values are not read or written.

    The new rows are staged, committed and put in place. Whoever is stopped on the way leaves the old table or, after
    the commit, one that recover (which every change and read_in_place begins with) completes. One writer at a time.
    """
    spark = new.sparkSession
    recover(spark, path)
    commit(spark, path, stage(new, path, key, sort))
    recover(spark, path)


def read_in_place(spark: SparkSession, path: str) -> DataFrame:
    """The table that upsert_in_place keeps at path; columns that only some partitions have are null in the others."""
    recover(spark, path)
    return spark.read.option("mergeSchema", True).parquet(path)
