"""Sharding by a Feistel permutation of global row numbers.

Every row gets a global row number: rows are dealt by a hash of their key into buckets, the buckets' counts
are summed up to first numbers, and each bucket numbers its own rows. A Feistel network over the smallest grid
a x b that holds all n numbers permutes the grid; cycle walking applies it again while the result is n or
more, which leaves a permutation of 0..n-1. Its value p gives shard p mod k and slot p div k, so shards
differ by one row at most, slots have no gaps, and both can be computed from the row number alone.

A bucket is a hash of the row's own columns, so row numbers do not hang on how the rows lie in files.
Columns stay in the JVM: no Python runs on executors and only one number, the row count, reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

ROUNDS, SEED = 6, 20261128
#: Rows that one bucket numbers, about, and buckets at most: their first numbers are broadcast, two longs each.
BUCKET_ROWS, BUCKETS = 100_000, 400_000


def grid(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square grid with at least n cells."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def drawn(*parts: Column) -> Column:
    """A number of 32 bits that hangs on the parts alone, from their md5, so that other engines draw the same."""
    return F.conv(F.left(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), F.lit(8)), 16, 10).cast("long")


def feistel(x: Column, n: int, seed: int = SEED) -> Column:
    """One pass of the permutation of the grid's cells."""
    a, b = grid(n)
    side = lambda r, other, size: drawn(F.lit(seed), r, other) % size

    def turn(s: Column, r: Column) -> Column:
        return F.when(r % 2 == 0, F.struct(((s["l"] + side(r, s["r"], a)) % a).alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), ((s["r"] + side(r, s["l"], b)) % b).alias("r"))
        )

    start = F.struct(F.call_function("div", x, F.lit(b)).alias("l"), (x % b).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * b + s["r"])


def permuted(df: DataFrame, x: str, out: str, n: int, seed: int = SEED) -> DataFrame:
    """df with column out, the permutation of column x (0..n-1)."""
    a, b = grid(n)
    df = df.withColumn(out, feistel(F.col(x), n, seed))
    for _ in range(3):  # almost every walk ends here
        df = df.withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(feistel(F.col(out), n, seed)))
    if a * b > n:  # a walk meets each of the cells beyond n once at most
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(a * b - n)), F.col(out), lambda y, _: F.when(y < n, y).otherwise(feistel(y, n, seed)))
        df = df.withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(walk))
    return df


def numbered(df: DataFrame, by: list[str], out: str, n: int) -> DataFrame:
    """df with column out: 0..n-1, in an order that by alone decides (rows equal in by share their numbers out in any order)."""
    buckets = min(BUCKETS, max(8, -(-n // BUCKET_ROWS)))
    df = df.withColumn("_bucket", drawn(*map(F.col, by)) % buckets)
    first = df.groupBy("_bucket").agg(F.count("*").alias("_n"))
    first = first.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*by)) - 1
    return df.withColumn("_place", place).join(F.broadcast(first), "_bucket").withColumn(out, F.col("_first") + F.col("_place")).drop("_bucket", "_place", "_first")


def shard(docs: DataFrame, shards: int = 24, seed: int = SEED) -> DataFrame:
    """Shard and slot of every row of docs (doc_id, text; other columns are left out).

    A null text has size 8 and CRC 0; a null doc_id is a key like any other; repeated rows are rows of their
    own. An empty table gives an empty result. The table of the buckets' first numbers that is broadcast has
    one row for each BUCKET_ROWS rows and BUCKETS rows at most (beyond, buckets grow).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    n = docs.select("doc_id").count()
    rows = permuted(numbered(rows, ["doc_id", "text_crc32", "size"], "row_number", n), "row_number", "_p", n, seed)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_p") % shards).cast("int").alias("shard"),
        F.call_function("div", F.col("_p"), F.lit(shards)).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


def op10_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT range AS i, range AS c, 0 AS k FROM range(256) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8
), crcs AS (SELECT list(c ORDER BY i) AS crcs FROM bits WHERE k = 8),
s AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS text_crc32
  FROM documents, crcs
), g AS (
  SELECT count(*) AS n, CAST(floor(sqrt(greatest(count(*) - 1, 0))) AS BIGINT) + 1 AS a, least({BUCKETS}, greatest(8, CAST(ceil(count(*) / {BUCKET_ROWS}) AS BIGINT))) AS buckets FROM documents
), h AS (SELECT n, a, greatest(1, CAST(ceil(n / a) AS BIGINT)) AS b, buckets FROM g),
m AS (
  SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY ('0x' || substr(md5(concat_ws(':', doc_id, text_crc32, size)), 1, 8))::BIGINT % buckets, doc_id NULLS FIRST, text_crc32, size) - 1 AS x FROM s, h
), w AS (
  SELECT x, x // b AS l, x % b AS r, 0 AS step FROM m, h
  UNION ALL
  SELECT x, CASE WHEN step % 2 = 0 THEN (l + ('0x' || substr(md5('{SEED}:' || (step % {ROUNDS}) || ':' || r), 1, 8))::BIGINT % a) % a ELSE l END,
    CASE WHEN step % 2 = 1 THEN (r + ('0x' || substr(md5('{SEED}:' || (step % {ROUNDS}) || ':' || l), 1, 8))::BIGINT % b) % b ELSE r END, step + 1
  FROM w, h WHERE NOT (step > 0 AND step % {ROUNDS} = 0 AND l * b + r < n)
), p AS (SELECT x, l * b + r AS p FROM w, h WHERE step > 0 AND step % {ROUNDS} = 0 AND l * b + r < n)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(p % 24 AS INTEGER) AS shard, CAST(p // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(m.x AS BIGINT) AS row_number
FROM m JOIN p USING (x)
"""
