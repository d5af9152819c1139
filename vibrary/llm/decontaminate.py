"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact similarity.

1. Where a document shares a shingle with the benchmark, windows are laid, of the sizes of the items that have the
   shingle and so that it lies where it lies in them. This says where to look; a passage similar enough to an
   item shares a shingle with it, so none goes without its window. Equal windows are one from here on.
2. Windows and items get SimHash fingerprints of 64 bits of their words (an edit changes one word but five
   shingles, so words leave fingerprints closer). Fingerprints are cut into BLOCKS blocks of equal size; two
   within the radius differ in RADIUS blocks at most, so they agree in BLOCKS - RADIUS of them. Every choice of so many
   blocks, with their bits, is a key of the index: a join on size and key finds all pairs within the radius.
3. These candidates are verified by the exact similarity of the bags of shingles: a shingle weighs as often as it
   occurs, common weight over joint weight.

Columns and joins only; no Python runs on executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, lower, settled, table

#: Words of a shingle; an item of fewer words is one shingle. At similarity 0.8 word fingerprints of passages of 15 to 60 words differ in 4 to 9 bits.
SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 13, 16
#: Tables of at most so many bytes are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 16 << 20
WINDOW = ["_k", "_size", "_first"]


def words(text: Column) -> Column:
    """Lower-cased words of a text; a blank text has none."""
    trimmed = F.btrim(lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS))
    return F.filter(F.split(trimmed, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def shingles(w: Column, n: int = SHINGLE) -> Column:
    """Hashes of all runs of n words, in order."""
    places = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))


def simhash(w: Column) -> Column:
    """Bit j is set if most of the words' hashes have it set."""
    bit = lambda j: F.aggregate(w, F.lit(0), lambda a, x: a + F.call_function("shiftright", F.xxhash64(x), j).bitwiseAND(F.lit(1)).cast("int") * 2 - 1)
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.when(bit(j) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def index_keys(fingerprint: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """A key for each choice of blocks - radius of the fingerprint's blocks: their numbers and their bits."""
    width = 64 // blocks
    block = lambda i: F.call_function("shiftrightunsigned", fingerprint, (i * width).cast("int")).bitwiseAND(F.lit((1 << width) - 1))

    def choose(n: int, start: Column, key: Column) -> Column:
        if not n:
            return F.array(key)
        each = F.transform(F.sequence(start, F.lit(blocks - n)), lambda i: choose(n - 1, i + 1, (key * blocks + i) * (1 << width) + block(i)))
        return F.flatten(each)

    return choose(blocks - radius, F.lit(0), F.lit(0).cast("long"))


def bag_similarity(a: Column, b: Column) -> Column:
    """Common over joint weight of two bags of shingles."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    common = F.aggregate(F.array_distinct(b), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    return common / (F.size(a) + F.size(b) - common)


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if what it holds is proven to be small: 16 bytes a value, and arrays by their length."""
    arrays = [F.size(c) for c, kind in df.dtypes if kind.startswith("array")]
    held = df.agg(F.sum(reduce(lambda a, b: a + b, arrays, F.lit(len(df.columns))).cast("long") * 24)).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def windows_of(docs: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """_id, _text (hash of the text) and the windows that shared runs of k words lay, each with its size and first word."""
    # the words are a column of their own: within a lambda they would be split anew for each shingle
    keys = docs.select("_id", "_text", words(F.col("text")).alias("_w")).select("_id", "_text", F.size("_w").alias("_words"), shingles(F.col("_w"), k).alias("_all"))
    # outer: for plain posexplode, the optimizer would evaluate the shingles twice to filter out empty arrays
    each = keys.select("_id", "_text", "_words", F.posexplode_outer("_all").alias("_at", "_h"))
    hits = each.join(small(known.filter(F.col("_k") == k)), "_h")
    first = F.greatest(F.lit(0), F.least(F.col("_at") - F.col("_off"), F.col("_words") - F.col("_size")))
    return hits.select("_id", "_text", F.struct("_k", "_size", first.alias("_first")).alias("_window"))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row for each distinct row of docs (doc_id, text) and benchmark item (item_id, text) it holds: doc_id, item_id, similarity, first_word, n_words of the best window, and text_hash.

    Null and blank texts hold no item, as null or blank items are held by none; an item of fewer than SHINGLE words
    is held where all its words stand in its order. Repeated rows of docs give one row, repeated items count
    once, null ids are ids like any other. Other columns are left out. An empty table on either side gives an
    empty result. Of equally similar windows the first is given.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("_w")).filter(F.size("_w") > 0).select("item_id", "_w", F.least(F.size("_w"), F.lit(SHINGLE)).alias("_k"))
    bag = reduce(lambda c, k: c.when(F.col("_k") == k, shingles(F.col("_w"), k)), range(2, SHINGLE + 1), F.when(F.col("_k") == 1, shingles(F.col("_w"), 1)))
    items = items.select("item_id", "_k", bag.alias("_item"), F.size("_w").alias("_size"), simhash(F.col("_w")).alias("_mark")).distinct()
    items = settled(items.withColumn("_ikey", F.xxhash64("_k", "_item")), "items")
    bags = items.select("_ikey", "_k", "_item", "_size", "_mark").dropDuplicates(["_ikey"])
    known = bags.select("_k", "_size", F.posexplode("_item").alias("_off", "_h")).distinct()
    runs = [r[0] for r in items.select("_k").distinct().collect()]  # SHINGLE of them at most

    keyed = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), "text")
    laid = reduce(DataFrame.union, (windows_of(keyed, known, k) for k in runs or [SHINGLE]))
    laid = settled(laid.groupBy("_id", "_text").agg(F.collect_set("_window").alias("_windows")), "windows")

    found = small(laid).withColumnsRenamed({"_id": "_k_id", "_text": "_k_text"})
    texts = keyed.join(found, keyed["_id"].eqNullSafe(found["_k_id"]) & (keyed["_text"] == found["_k_text"])).select("_id", "_text", words(F.col("text")).alias("_w"), "_windows")
    each = texts.select("_id", "_text", "_w", F.explode_outer("_windows").alias("_x")).select("_id", "_text", *(F.col(f"_x.{c}").alias(c) for c in WINDOW), F.slice("_w", F.col("_x._first") + 1, F.col("_x._size")).alias("_w"))
    own = reduce(lambda c, k: c.when(F.col("_k") == k, shingles(F.col("_w"), k)), runs, F.when(F.lit(False), F.array().cast("array<bigint>")))
    marked = settled(each.distinct().withColumn("_bag", own).withColumn("_wkey", F.xxhash64("_size", "_w")), "marked")
    distinct = settled(marked.dropDuplicates(["_wkey"]).select("_wkey", "_k", "_size", "_bag", simhash(F.col("_w")).alias("_fp")), "fingerprints")

    near = distinct.select("_wkey", "_size", "_fp", F.explode(index_keys(F.col("_fp"), radius)).alias("_key"))
    index = bags.select("_ikey", "_size", "_mark", F.explode(index_keys(F.col("_mark"), radius)).alias("_key"))
    pairs = near.join(small(index), ["_size", "_key"]).filter(F.bit_count(F.col("_fp").bitwiseXOR(F.col("_mark"))) <= radius).select("_wkey", "_ikey").distinct()
    pairs = pairs.join(distinct.select("_wkey", "_bag", "_k"), "_wkey").join(small(bags.select("_ikey", "_item", "_k")), ["_ikey", "_k"])
    scored = pairs.withColumn("similarity", bag_similarity(F.col("_bag"), F.col("_item"))).filter(F.col("similarity") >= similarity)
    scored = settled(scored.select("_wkey", "_ikey", "similarity"), "scored")
    held = marked.select("_id", "_text", "_wkey", "_first", F.size("_w").alias("_n")).join(small(scored), "_wkey").join(items.select("_ikey", "item_id"), "_ikey")
    best = held.groupBy("_id", "_text", "item_id").agg(F.max(F.struct("similarity", (-F.col("_first")).alias("f"), F.col("_n").alias("n"))).alias("_best"))
    return best.select(F.col("_id").alias("doc_id"), "item_id", F.col("_best.similarity").alias("similarity"), (-F.col("_best.f")).alias("first_word"), F.col("_best.n").alias("n_words"), F.col("_text").alias("text_hash"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 9).alias("similarity"), "first_word", "n_words")


OP3_SQL = r"""
WITH wd AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), wi AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark
), d AS (
  SELECT doc_id, len(w) AS words, unnest(range(0, len(w) - 4)) AS pos, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS h FROM wd WHERE len(w) >= 5
), i AS (
  SELECT item_id, len(w) AS size, unnest(range(0, len(w) - 4)) AS off, unnest([array_to_string(w[k:k + 4], ' ') FOR k IN range(1, len(w) - 3)]) AS h FROM wi WHERE len(w) >= 5
), windows AS (
  SELECT DISTINCT doc_id, item_id, words, size, greatest(0, least(pos - off, words - size)) AS f FROM d JOIN i USING (h)
), bag AS (SELECT item_id, h, count(*) AS n FROM i GROUP BY item_id, h),
own AS (
  SELECT v.doc_id, v.item_id, v.f, d.h, count(*) AS n FROM windows v JOIN d ON d.doc_id = v.doc_id AND d.pos >= v.f AND d.pos <= v.f + v.size - 5 GROUP BY ALL
), scored AS (
  SELECT v.doc_id, v.item_id, v.f, least(v.size, v.words) AS n_words,
    sum(least(own.n, coalesce(bag.n, 0))) / (least(v.size, v.words) - 4 + v.size - 4 - sum(least(own.n, coalesce(bag.n, 0)))) AS similarity
  FROM windows v JOIN own USING (doc_id, item_id, f) LEFT JOIN bag ON bag.item_id = v.item_id AND bag.h = own.h GROUP BY v.doc_id, v.item_id, v.f, v.size, v.words
)
SELECT doc_id, item_id, round(similarity, 9) AS similarity, CAST(f AS INTEGER) AS first_word, CAST(n_words AS INTEGER) AS n_words FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, f) AS k FROM scored WHERE similarity >= 0.8) WHERE k = 1
"""
