"""Personal data: base patterns with checks, and further spans chosen by boosted trees.

Generators with high recall propose spans that may overlap. Spans of the base patterns that pass their checks
always stay. For the other proposals, gradient-boosted trees over features of format and of the words before
give a score; thresholds calibrated on a held-out quarter of all candidates, one for each generator, select what is
added. The training labels are remote and do not look at a proposal's own form: it counts as personal if it
overlaps a checked base span, if a generator that goes by context and one that goes by form meet in it, or if the
words before it name something personal. The trees see the form and the signs before it, not those words.

All of it is DataFrame expressions and the JVM's own tree trainer; no Python runs on executors. Patterns use
possessive groups: their time is linear and long runs of digits or letters need no stack.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settled, table

LOCAL, HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Equal to the contract's patterns: a match can only start after another match or where its first run starts.
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{HOST}++(?:\.{HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A candidate's kind, its generator.
GENERATORS = {
    "secret": r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,3}+[=:]\s{0,3}+[\"']?+[^\s\"',;]++",
    "key": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+",
    "number": r"(?<![A-Za-z0-9=])[(+]?+[0-9](?:[().\x20/:-]{0,2}+[0-9])*+",
    "address": r"(?i)[a-z0-9._%+-]++\s?+[\[(](?:at|@)[\])]\s?+[a-z0-9-]++(?:\s?+(?:\.|[\[(]dot[\])])\s?+[a-z0-9-]++)++",
}
#: What must be in a text for a pattern to be tried.
NEEDS = {"email": "@", "address": r"(?i)[\[(](?:at|@)[\])]", "secret": "[=:]"}
KINDS = (*BASE, *GENERATORS)
#: Generators whose patterns name what they look for: without a threshold their proposals are added, those of the others are not.
NAMING = ("secret", "address")
#: Words before a proposal that say it is personal.
HINTS = r"(?i)(?<![a-z])(?:pass\w*|pwd|token|secret|key|card|tel|phone|call|mobile|mail|ssn|account|iban|id)\W{0,4}$"
#: Candidates the trees are trained on, at most (of each generator and class, those with the smallest hashes).
SAMPLE, TREES, DEPTH, PRECISION = 20_000, 10, 3, 0.98


def matches(text: Column, kind: str) -> Column:
    """For each match of a kind in the text, what stands before it (since the last match) and the match."""
    pattern = BASE.get(kind) or GENERATORS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    each = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.right(g, F.lit(24)).alias("before"), m.alias("found")))
    each = F.filter(each, lambda x: x["found"].isNotNull())  # what stands after the last match has none
    needs = text.rlike(NEEDS[kind]) if kind in NEEDS else text.rlike(r"\+[0-9]") if kind == "phone" else text.rlike("[0-9]")
    return F.when(needs, each)


def proposals(docs: DataFrame) -> DataFrame:
    """_id, _hash (of the text), kind, start, end, found and before of every match; rows equal in both keys count once."""
    keys = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    kinds = F.array(*(F.struct(F.lit(i).alias("kind"), matches(F.col("_text"), k).alias("m")) for i, k in enumerate(KINDS)))
    rows = keys.select("_id", F.xxhash64("_text").alias("_hash"), F.explode_outer(F.filter(kinds, lambda x: F.size(x["m"]) > 0)).alias("k"))
    # outer: for plain explode, the optimizer would match the patterns twice to filter out empty arrays
    rows = rows.filter("k.kind IS NOT NULL").select("_id", "_hash", "k.kind", F.posexplode("k.m").alias("at", "m")).select("_id", "_hash", "kind", "at", "m.*")
    rows = rows.dropDuplicates(["_id", "_hash", "kind", "at"])
    upto = Window.partitionBy("_id", "_hash", "kind").orderBy("at")
    end = F.sum(F.col("gap") + F.length("found")).over(upto)
    return rows.select("_id", "_hash", "kind", "found", "before", (end - F.length("found")).cast("long").alias("start"), end.cast("long").alias("end"))


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def passes(kind: Column, found: Column) -> Column:
    """The base patterns' checks."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?+"
    ip = found.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    card = F.when(n.between(16, 19), luhn(digits)).otherwise(F.lit(False))
    return F.when(kind == 0, True).when(kind == 1, ip).when(kind == 2, card).when(kind == 3, n.between(8, 15)).otherwise(False)


def features(rows: DataFrame) -> DataFrame:
    """Numbers about a proposal's format and about what stands before it, as vector column features."""
    found, size = F.col("found"), F.greatest(F.length("found"), F.lit(1))
    share = lambda chars: F.length(F.regexp_replace(found, f"[^{chars}]", "")) / size
    digits = F.regexp_replace(found, "[^0-9]", "")
    columns = {
        "_size": F.least(F.length("found"), F.lit(200)),
        "_digits": F.least(F.length(digits), F.lit(200)),
        "_digit_share": share("0-9"),
        "_upper_share": share("A-Z"),
        "_hex_share": share("0-9a-f"),
        "_other_share": 1 - share("A-Za-z0-9"),
        "_groups": F.least(F.size(F.split(found, "[^A-Za-z0-9]+")), F.lit(20)),
        "_distinct": F.size(F.array_distinct(F.split(F.left(found, F.lit(200)), ""))),
        "_plus": found.startswith("+").cast("int"),
        "_luhn": F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False)).cast("int"),
        "_quote": F.col("before").rlike(r"[=:\"']\s*$").cast("int"),
        **{f"_is_{k}": (F.col("kind") == KINDS.index(k)).cast("int") for k in GENERATORS},
    }
    rows = rows.withColumns({k: c.cast("double") for k, c in columns.items()})
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(rows).drop(*columns)


def touching(rows: DataFrame, base: DataFrame) -> DataFrame:
    """rows with on_base, on_secret and on_key: whether the span overlaps a checked base span or a proposal of that generator (intervals are swept by start, with the furthest end so far, and back)."""
    marked = rows.withColumn("_b", F.lit(0)).unionByName(base.withColumn("_b", F.lit(1)))
    per = Window.partitionBy("_id", "_hash").orderBy("start", F.desc("_b"), "kind")
    back = Window.partitionBy("_id", "_hash").orderBy(F.desc("start"), F.desc("_b"), F.desc("kind"))
    flags = {"on_base": F.col("_b") == 1, **{f"on_{k}": (F.col("_b") == 0) & (F.col("kind") == KINDS.index(k)) for k in ("secret", "key")}}
    ends = {k: F.coalesce(F.max(F.when(f, F.col("end"))).over(per.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)) for k, f in flags.items()}
    starts = {k: F.coalesce(F.min(F.when(f, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1 << 60)) for k, f in flags.items()}
    return marked.select("*", *((ends[k] > F.col("start")).alias(f"_e_{k}") for k in flags), *((starts[k] < F.col("end")).alias(f"_s_{k}") for k in flags)).select(
        *marked.columns, *((F.col(f"_e_{k}") | F.col(f"_s_{k}")).alias(k) for k in flags)
    ).filter("_b = 0").drop("_b")


def remote_label() -> Column:
    """Whether something besides its own form says that a proposal is personal."""
    kind = lambda k: F.col("kind") == KINDS.index(k)
    met = kind("secret") & F.col("on_key") | kind("key") & F.col("on_secret")
    return F.col("on_base") | met | F.coalesce(F.col("before").rlike(HINTS), F.lit(False))


def added(candidates: DataFrame) -> DataFrame:
    """The candidates off base spans that the trees score at or above their generator's threshold.

    The trees are fitted on a sample of SAMPLE candidates at most, with equal room for each generator's positive and
    other candidates: all of those that are rare. Thresholds come from all held-out candidates: the lowest score from
    which on PRECISION of them are positive, none if that holds for every score. Where no score has it, a generator
    has no held-out candidates, or one class is missing from all that train, what NAMING generators propose is
    added and the others abstain.
    """
    kind = lambda k: F.col("kind") == KINDS.index(k)
    naming = reduce(lambda c, k: c | kind(k), NAMING, F.lit(False))
    marked = candidates.withColumn("label", remote_label().cast("double")).withColumn("_o", F.xxhash64("_id", "_hash", "kind", "start"))
    strata = [marked.filter(kind(k) & (F.col("label") == y) & (F.col("_o") % 4 != 0)) for k in GENERATORS for y in (0.0, 1.0)]
    sample = reduce(DataFrame.unionByName, (s.orderBy("_o").limit(SAMPLE // len(strata)) for s in strata))
    train, held = settled(features(sample).select("features", "label"), "pii_sample"), marked.filter("_o % 4 = 0")
    classes = {r["label"] for r in train.select("label").distinct().collect()}
    if classes != {0.0, 1.0}:  # nothing to tell apart
        return candidates.filter(~F.col("on_base") & naming).withColumn("p", F.lit(1.0))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=1, stepSize=0.3, minInstancesPerNode=5).fit(train)
    score = lambda rows: model.transform(rows).withColumn("p", vector_to_array("probability")[1])
    bins = score(features(held)).groupBy("kind", F.floor(F.col("p") * 50).cast("int").alias("bin")).agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()
    limits = thresholds([tuple(r) for r in bins])
    chosen = reduce(lambda c, k: c.when(kind(k), F.col("p") >= limits[k] if k in limits else naming), GENERATORS, F.when(F.lit(False), False)).otherwise(False)
    return score(features(candidates.filter(~F.col("on_base")))).filter(chosen).drop("features", "rawPrediction", "probability", "prediction")


def thresholds(bins: list[tuple[int, int, float, int]]) -> dict[str, float]:
    """Each generator's threshold from (kind, fiftieth of the score, positives, candidates), for generators that have one."""
    limits = {}
    for k in GENERATORS:
        good = n = 0.0
        for _, b, g, m in sorted((r for r in bins if r[0] == KINDS.index(k)), key=lambda r: -r[1]):
            good, n = good + g, n + m
            if good < PRECISION * n:
                break
            limits[k] = b / 50
        else:
            if n:
                limits[k] = 0.0
    return limits


def islands(rows: DataFrame) -> DataFrame:
    """Overlapping spans of a text as one span with the kind of the best score."""
    per = Window.partitionBy("_id", "_hash").orderBy("start", "end", "kind")
    before = F.max("end").over(per.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", (F.coalesce(before, F.lit(-1)) <= F.col("start")).cast("int")).withColumn("_island", F.sum("_new").over(per))
    return rows.groupBy("_id", "_hash", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max_by("kind", F.struct("p", -F.col("kind"))).alias("kind"))


def find_pii(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text), doc_id, counts by base kind and the spans, base ones and all.

    Offsets are code points of the whole text, ends exclusive. A null or empty text has no spans. Repeated rows
    get equal results, null ids are keys like any other, other columns are left out, an empty table gives an
    empty result. Added spans do not overlap each other or base spans.
    """
    found = settled(proposals(docs), "pii")
    base = found.filter(F.col("kind") < len(BASE)).filter(passes(F.col("kind"), F.col("found")))
    candidates = settled(touching(found.filter(F.col("kind") >= len(BASE)), base), "pii_candidates")
    more = islands(added(candidates))
    columns = ["_id", "_hash", "kind", "start", "end"]
    spans = base.select(columns).unionByName(more.select(columns))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    each = F.struct("kind", "start", F.concat_ws(":", kind, F.col("start"), F.col("end")).alias("said"), (F.col("kind") < len(BASE)).alias("base"))
    by = spans.groupBy("_id", "_hash").agg(F.array_sort(F.collect_list(each)).alias("spans"), *(F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(BASE)))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_h"))
    rows = rows.join(by, rows["doc_id"].eqNullSafe(by["_id"]) & (rows["_h"] == by["_hash"]), "left")
    said = lambda s: F.coalesce(F.array_join(F.transform(s, lambda x: x["said"]), ","), F.lit(""))
    return rows.select(
        "doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE),
        said(F.filter("spans", lambda x: x["base"])).alias("base_spans"), said(F.col("spans")).alias("spans"),
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    n_spans = F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long").alias("n_spans")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", n_spans)
