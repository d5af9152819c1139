"""Dropping lines that many documents share, with levelled sorted runs of line hashes.

The texts are read once for the hashes of their lines, a row for each distinct line of a document. These come in
batches. A run is a table (hash, number of documents) in the shared folder, bucketed and sorted by hash, so a
new batch joins them without another shuffle of theirs. Every batch is merge-anti-joined with each run,
which takes out the hashes that have reached the limit there, and is added as a run of level 0; when a level has
FAN_IN runs, they are merged into one of the next level. So a hash lies in few runs however many batches came, and
a new batch never rereads old documents. A line's hash has 128 bits.

The texts are read a second time to drop lines. The hashes of shared lines, proven to be few, are broadcast for
that, and no text is moved; where they are more than that, they reach their documents by a join.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, let_go, lower, settled, shared_folder, table

BATCHES, FAN_IN = 4, 4
#: Line hashes of a bucket of a run, about.
BUCKET_ROWS = 2_000_000
#: Up to so many shared lines (two longs each) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 400_000
#: Texts that lines are dropped from at once.
SLICE = 500
KEY = ["h", "h2"]
TRIMMED = BLANKS.encode()
#: Spark's xxhash64 of 1, with which it starts the second hash.
SECOND = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42)


def hashes(text: Column, min_chars: int) -> Column:
    """Distinct keys of a text's lines, each as a struct of two hashes."""
    keys = F.transform(F.split(lower(F.coalesce(text, F.lit(""))), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)))
    keys = F.array_distinct(F.filter(keys, lambda x: F.length(x) >= min_chars))
    return F.transform(keys, lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("h2")))


def line_hashes(docs: DataFrame, min_chars: int, batches: int = BATCHES) -> DataFrame:
    """h, h2 and batch of each distinct line of each doc_id; all lines of an id are in one batch, and all null ids are one."""
    lines = docs.select(F.col("doc_id").alias("_id"), F.explode(hashes(F.col("text"), min_chars)).alias("k")).select("_id", "k.*").distinct()
    return settled(lines.select(*KEY, F.pmod(F.xxhash64("_id"), F.lit(batches)).cast("int").alias("batch")), "lines")


class LineRuns:
    """How many documents each line was found in, as levelled runs in the shared folder."""

    def __init__(self, min_docs: int, buckets: int = 8, fan_in: int = FAN_IN) -> None:
        self.min_docs, self.buckets, self.fan_in = min_docs, buckets, fan_in
        self.levels: dict[int, list[tuple[DataFrame, DataFrame]]] = defaultdict(list)
        self.names: list[str] = []

    def runs(self) -> list[tuple[DataFrame, DataFrame]]:
        """Each run as a bucketed table and as plain files."""
        return [r for level in self.levels.values() for r in level]

    def counts(self) -> DataFrame:
        return self._merged(self.runs())

    def _merged(self, runs: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
        """The runs' counts added up; a single run needs nothing. Files are read as such: Spark 4.1 takes a union of bucketed scans for dealt by hash, which it is not."""
        if len(runs) == 1:
            return runs[0][0]
        return reduce(DataFrame.union, (files for _, files in runs)).repartition(self.buckets, *KEY).groupBy(*KEY).agg(F.sum("n").alias("n"))

    def shared(self) -> DataFrame:
        """Hashes of the lines found in min_docs documents or more."""
        return self.counts().filter(F.col("n") >= self.min_docs).select(*KEY)

    def add(self, lines: DataFrame) -> None:
        """A batch of line_hashes. What a run takes out of it is shared whatever else is counted."""
        new = lines.groupBy(*KEY).agg(F.count("*").alias("n"))
        for run, _ in self.runs():
            new = new.join(run.filter(F.col("n") >= self.min_docs).select(*KEY).hint("merge"), KEY, "left_anti")
        self._put(0, new)

    def _put(self, level: int, run: DataFrame) -> None:
        spark, name = run.sparkSession, f"line_run_{uuid.uuid4().hex}"
        path = f"{shared_folder(spark)}-run{level}"
        self.names.append(name)
        run.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        self.levels[level].append((spark.table(name), spark.read.schema("h long, h2 long, n long").parquet(path)))
        if len(self.levels[level]) == self.fan_in:
            self._put(level + 1, self._merged(self.levels.pop(level)))

    def close(self, spark: SparkSession) -> None:
        """Takes the runs out of the catalogue; their files stay in the shared folder."""
        for name in self.names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names, self.levels = [], defaultdict(list)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_hash(line: bytes) -> tuple[int, int]:
    """The two hashes of a line's key, as Spark's xxhash64 gives them."""
    key = line.strip(TRIMMED).lower()
    return signed(xxhash.xxh64_intdigest(key, 42)), signed(xxhash.xxh64_intdigest(key, SECOND))


def without_shared_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES, counts: tuple[str, str] | None = None) -> DataFrame:
    """All columns of docs with shared lines taken out of text. counts names two more columns, of a text's lines and those taken out; they replace columns of docs with such names.

    A line is shared if its key (ends stripped of blanks, A-Z lowered, min_chars code points or more) is in texts
    of min_docs different doc_ids or more; rows of one id count once, and rows without id once together. A null
    or empty text is one empty line and stays, as empty text. An empty table gives an empty result. Lines keep
    their order.
    """
    docs = docs.drop(*(counts or ()))
    lines = line_hashes(docs, min_chars, batches)
    runs = LineRuns(min_docs, max(8, lines.count() // BUCKET_ROWS))
    try:
        for b in range(batches):
            runs.add(lines.filter(F.col("batch") == b))
        shared = settled(runs.shared(), "shared")
    finally:
        runs.close(docs.sparkSession)
    kept = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema), *(T.StructField(c, T.LongType()) for c in counts or ())])
    at, width = docs.columns.index("text"), len(docs.columns)
    known = None
    if shared.count() <= BROADCAST_ROWS:
        known = docs.sparkSession.sparkContext.broadcast(frozenset((r.h, r.h2) for r in shared.toLocalIterator()))
        rows = docs
    else:
        own = docs.select(F.col("doc_id").alias("_id"), F.explode(hashes(F.col("text"), min_chars)).alias("_k"))
        found = own.join(shared.select(F.struct(*KEY).alias("_k")), "_k").groupBy("_id").agg(F.collect_set("_k").alias("_k"))
        found = found.toDF(*(f"{c}{uuid.uuid4().hex}" for c in found.columns))
        rows = docs.join(found, docs["doc_id"].eqNullSafe(found[found.columns[0]]), "left").drop(found.columns[0])

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in given:
            for start in range(0, whole.num_rows, SLICE):  # few texts are held twice at once
                batch = whole.slice(start, SLICE)
                texts, n_lines, n_dropped = [], [], []
                for k, text in enumerate(batch.column(at).cast(pa.binary())):
                    lines = (text.as_py() or b"").split(b"\n")
                    drop = known.value if known else {(x["h"], x["h2"]) for x in batch.column(width)[k].as_py() or ()}
                    left = [x for x in lines if line_hash(x) not in drop] if drop else lines
                    texts.append(b"\n".join(left))
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(left))
                columns = batch.columns[:width]
                columns[at] = pa.array(texts, pa.binary()).cast(batch.schema.field(at).type)
                both = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())] if counts else []
                yield pa.RecordBatch.from_arrays([*columns, *both], names=[*kept.names])
        let_go()

    return rows.mapInArrow(run, kept)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=("n_lines", "n_dropped"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key
GROUP BY k.doc_id
"""
