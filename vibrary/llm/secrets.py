"""Secrets in texts, told from examples by who has them.

Patterns propose candidates: the base kinds, which always stay, and generators of high recall (bearer tokens,
passwords in addresses, keys with well-known beginnings, private keys, upper-case hex and long mixed strings). What a
candidate protects (its value) is hashed, and the hashes are counted over the whole corpus: in how many repositories, and of
how many owners, a value is found. A value that several owners have was copied from a manual or a test; one that
a single owner has, however often they copied it, and that looks like a key and not like a placeholder, looks live.
Generated candidates are added where they look live; base spans are told apart in columns of their own.

Columns and joins only; no Python runs on executors. A value that much of the corpus has is counted by owner and
repository before it is counted by value, with partial sums where rows are, and its verdict reaches its rows by a
salted join. Patterns are possessive where they can be: their time is linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.skew import met
from .common import settled, table

BLANK = r"\x20\x09-\x0D"
#: Equal to the contract's patterns; a match of fewer characters (in its value) than LEAST is dropped, and no other is tried there.
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""",
    "access": r"(AKIA[A-Z0-9]++)",
    "hex": r"([0-9a-f]{32,}+)",
}
GENERATORS = {
    "bearer": r"(?i:bearer)\x20++([A-Za-z0-9._~+/=-]{16,}+)",
    "login": rf"://[^{BLANK}/:@]++:([^{BLANK}/:@]++)@[A-Za-z0-9.-]++",
    "prefix": r"((?:gh[opsu]_|sk-|xox[abps]-|AIza|glpat-)[A-Za-z0-9_-]{16,}+)",
    "pem": r"(-----BEGIN [A-Z\x20]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*+)",
    "upper": r"([0-9A-F]{32,}+)",
    "mixed": r"([A-Za-z0-9+/_-]{24,}+)",
}
KINDS = BASE | GENERATORS
NAMES = tuple(KINDS)
#: Code points of a base value, at least; the generators' patterns have their own.
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: What must be in a text for a pattern to be tried.
NEEDS = {"assign": "[:=]", "access": "AKIA", "bearer": "(?i)bearer", "login": "://", "prefix": "_|-|AIza", "pem": "PRIVATE KEY"}
#: A value that more owners have is an example; so is one in more repositories of those owners.
OWNERS, REPOSITORIES = 2, 1000
#: A value that looks live has so many different characters, digits and letters.
DISTINCT, DIGITS, LETTERS = 10, 3, 3
PLACEHOLDER = "(?i)example|sample|changeme|placeholder|dummy|your[_-]|xxxx|0000000|1234567|abcdef0|deadbeef"


def matches(text: Column, kind: str) -> Column:
    """For each match of a kind, the length of what stands before it (since the last match), the match and its value."""
    pattern = KINDS[kind]
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    each = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("found"), F.regexp_extract(m, pattern, 1).alias("value")))
    each = F.filter(each, lambda x: x["found"].isNotNull())  # what stands after the last match has none
    return F.when(text.rlike(NEEDS[kind]), each) if kind in NEEDS else each


def proposals(docs: DataFrame) -> DataFrame:
    """_id, _hash (of the text), _owner, kind, start, end and value of every match; rows equal in the first three count once."""
    kinds = F.array(*(F.struct(F.lit(i).alias("kind"), matches(F.col("_text"), k).alias("m")) for i, k in enumerate(NAMES)))
    rows = docs.select("_id", F.xxhash64("_text").alias("_hash"), "_owner", F.explode_outer(F.filter(kinds, lambda x: F.size(x["m"]) > 0)).alias("k"))
    # outer: for plain explode, the optimizer would match the patterns twice to filter out empty arrays
    rows = rows.filter("k.kind IS NOT NULL").select("_id", "_hash", "_owner", "k.kind", F.posexplode("k.m").alias("at", "m")).select("_id", "_hash", "_owner", "kind", "at", "m.*")
    rows = rows.dropDuplicates(["_id", "_hash", "_owner", "kind", "at"])
    upto = Window.partitionBy("_id", "_hash", "_owner", "kind").orderBy("at")
    end = F.sum(F.col("gap") + F.length("found")).over(upto)
    spans = rows.select("_id", "_hash", "_owner", "kind", (end - F.length("found")).cast("long").alias("start"), end.cast("long").alias("end"), "value")
    least = F.element_at(F.array(*(F.lit(LEAST.get(k, 0)) for k in NAMES)), F.col("kind") + 1)
    return spans.filter(F.length("value") >= least)  # after the ends are known: a dropped match still stands before the next


def looks_live(value: Column) -> Column:
    """Whether a value has enough different characters, digits and letters and no placeholder in it. A private key has, and a password of an address needs no more than 8 characters."""
    count = lambda chars: F.length(value) - F.length(F.regexp_replace(value, f"[{chars}]", ""))
    distinct = F.size(F.array_distinct(F.split(value, "")))
    form = (distinct >= DISTINCT) & (count("0-9") >= DIGITS) & (count("A-Za-z") >= LETTERS)
    return ~value.rlike(PLACEHOLDER) & F.when(F.col("kind") == NAMES.index("login"), F.length(value) >= 8).otherwise(form)


def ownership(candidates: DataFrame) -> DataFrame:
    """_value (hash), n (rows), owners and repositories of each value; a repository is an owner's document."""
    repositories = candidates.groupBy("_value", "_owner", "_id").agg(F.count("*").alias("n"))
    by_owner = repositories.groupBy("_value", "_owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("_value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"))


def added(spans: DataFrame) -> DataFrame:
    """The generated candidates that look live and overlap no base span; those that overlap each other are one, of the first's kind in the order of GENERATORS."""
    per = Window.partitionBy("_id", "_hash").orderBy("start", "end", "kind")
    back = Window.partitionBy("_id", "_hash").orderBy(F.desc("start"), F.desc("end"), F.desc("kind"))
    base = F.col("kind") < len(BASE)
    before = F.coalesce(F.max(F.when(base, F.col("end"))).over(per.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    after = F.coalesce(F.min(F.when(base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1 << 60))
    free = spans.withColumn("_free", ~base & (before <= F.col("start")) & (after >= F.col("end"))).filter(F.col("_free") & F.col("live"))
    upto = F.coalesce(F.max("end").over(per.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    islands = free.withColumn("_new", (upto <= F.col("start")).cast("int")).withColumn("_island", F.sum("_new").over(per))
    return islands.groupBy("_id", "_hash", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("kind").alias("kind"), F.lit(False).alias("example"), F.lit(True).alias("live")).drop("_island")


def find_secrets(docs: DataFrame, owner: str = "source", owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """For each row of docs (doc_id, text and the column that names the owner), doc_id, counts by base kind, base and all spans, and of all spans those that look live and those that are examples.

    A span is an example if its value is found with more than owners owners or in more than repositories documents; it
    looks live if it is none and has the form of a key. A base span can be neither. Offsets are code points of the whole text, ends
    exclusive. A null or empty text has no spans; a null owner is an owner like any other, a null doc_id a document. Rows
    equal in doc_id and text get equal results; if their owners differ, all count. Other columns are left out, an empty table gives
    an empty result.
    """
    keyed = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_owner"))
    found = settled(proposals(keyed).withColumn("live", looks_live(F.col("value"))).withColumn("_value", F.md5("value")).drop("value"), "secrets")
    counts = settled(ownership(found), "owners")
    example = (F.col("owners") > owners) | (F.col("repositories") > repositories)
    judged = met(found, counts.select("_value", "n", example.alias("example")), ["_value"], "n", "_id")
    judged = judged.select("_id", "_hash", "kind", "start", "end", "example", (F.col("live") & ~F.col("example")).alias("live")).distinct()
    judged = settled(judged, "judged")
    spans = judged.filter(F.col("kind") < len(BASE)).unionByName(added(judged))
    name = F.element_at(F.array(*map(F.lit, NAMES)), F.col("kind") + 1)
    each = F.struct("start", "kind", F.concat_ws(":", name, F.col("start"), F.col("end")).alias("said"), (F.col("kind") < len(BASE)).alias("base"), "live", "example")
    by = spans.groupBy("_id", "_hash").agg(F.array_sort(F.collect_list(each)).alias("_spans"), *(F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(BASE)))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    rows = rows.join(by, rows["doc_id"].eqNullSafe(by["_id"]) & (rows["_h"] == by["_hash"]), "left")
    said = lambda which: F.coalesce(F.array_join(F.transform(F.filter("_spans", which), lambda x: x["said"]), ","), F.lit(""))
    return rows.select(
        "doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE), said(lambda x: x["base"]).alias("base_spans"), said(lambda x: F.lit(True)).alias("spans"),
        said(lambda x: x["live"]).alias("live_spans"), said(lambda x: x["example"]).alias("example_spans"),
    )


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in BASE), F.sha2("base_spans", 256).alias("base_sha256"), "spans", "live_spans", "example_spans")


def _plain(pattern: str) -> str:
    """A pattern for engines that never go back over a match, which have no possessive signs."""
    return pattern.replace("++", "+").replace("*+", "*").replace("?+", "?").replace("}+", "}").replace("'", "''")


def _matched(i: int, kind: str) -> str:
    p = _plain(KINDS[kind])
    return f"SELECT doc_id, source, {i} AS kind, text, '{p}' AS p, regexp_extract_all(text, '{p}', 0) AS found, regexp_extract_all(text, '{p}', 1) AS value, regexp_split_to_array(text, '{p}') AS gaps FROM d"


def _count(chars: str) -> str:
    return f"length(value) - length(regexp_replace(value, '[{chars}]', '', 'g'))"


OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(_matched(i, k) for i, k in enumerate(NAMES))}),
n AS (SELECT doc_id, source, kind, unnest(range(1, len(found) + 1)) AS place, unnest(found) AS found, unnest(value) AS value, unnest(gaps[1:len(found)]) AS gap FROM m WHERE len(found) > 0),
s AS (
  SELECT doc_id, source, kind, value, CAST(sum(length(gap) + length(found)) OVER (PARTITION BY doc_id, kind ORDER BY place) AS BIGINT) AS "end", length(found) AS size FROM n
), t AS (
  SELECT doc_id, source, kind, value, "end" - size AS start, "end", NOT regexp_matches(value, '{PLACEHOLDER}') AND CASE WHEN kind = {NAMES.index("login")} THEN length(value) >= 8
    ELSE len(list_distinct(string_split(value, ''))) >= {DISTINCT} AND {_count("0-9")} >= {DIGITS} AND {_count("A-Za-z")} >= {LETTERS} END AS form
  FROM s WHERE length(value) >= CASE kind WHEN 0 THEN 8 WHEN 1 THEN 16 WHEN 2 THEN 32 ELSE 0 END
), o AS (SELECT value, count(DISTINCT source) > {OWNERS} OR count(DISTINCT (source, doc_id)) > {REPOSITORIES} AS example FROM t GROUP BY value),
j AS (SELECT doc_id, kind, start, "end", example, form AND NOT example AS live FROM t JOIN o USING (value)),
f AS (
  SELECT * FROM j WHERE kind > 2 AND live AND NOT EXISTS (FROM j b WHERE b.doc_id = j.doc_id AND b.kind < 3 AND b.start < j."end" AND b."end" > j.start)
), g AS (
  SELECT *, CASE WHEN coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY start, "end", kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) <= start THEN 1 ELSE 0 END AS new FROM f
), h AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY start, "end", kind) AS island FROM g),
every AS (
  SELECT doc_id, kind, start, "end", example, live FROM j WHERE kind < 3
  UNION ALL SELECT doc_id, min(kind), min(start), max("end"), false, true FROM h GROUP BY doc_id, island
), said AS (SELECT *, {list(NAMES)}[kind + 1] || ':' || start || ':' || "end" AS said FROM every),
grouped AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(said, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
    string_agg(said, ',' ORDER BY start, kind) AS spans, string_agg(said, ',' ORDER BY start, kind) FILTER (live) AS live_spans, string_agg(said, ',' ORDER BY start, kind) FILTER (example) AS example_spans FROM said GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(live_spans, '') AS live_spans, coalesce(example_spans, '') AS example_spans
FROM d LEFT JOIN grouped USING (doc_id)
"""
