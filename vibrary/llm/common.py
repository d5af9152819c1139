"""Pieces that several corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that parts words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For str.translate: A-Z to lower case and nothing else.
TO_LOWER = str.maketrans(UPPER, LOWER)


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text's UTF-8 bytes, A-Z lowered; bytes part at the same six blanks as WORD."""
    return text.lower().split() if text else []


class Hashes(dict):
    """64-bit hashes of words, kept for those met so far up to a number."""

    REMEMBERED = 120_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see; where that is unset, a local session, as in tests, gets a temporary one, and on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: later jobs start from the files, also after an executor is lost."""
    path = f"{shared_folder(df.sparkSession)}-{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: Arrow batches of this session have at most so many rows from here on, so that neither JVM nor Python holds many texts at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def let_go() -> None:
    """Gives memory that nothing uses back to the system, at the end of a task: workers live on, and so would what they hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems have no such call
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower(text: Column | str) -> Column:
    return F.translate(text, UPPER, LOWER)


def map_batches(df: DataFrame, make: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """make gets the rows of an Arrow batch as a dict of lists and returns the dict of lists that replaces it."""
    kind = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):  # long texts: few rows are Python objects at once
                out = make(batch.slice(start, 2000).to_pydict())
                yield pa.RecordBatch.from_pydict(out, schema=arrow)
        let_go()

    return df.mapInArrow(run, kind)
