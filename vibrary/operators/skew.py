"""Joins, ranks and quantiles that keep no key and no range of values in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import kept

#: A key is hot if it has more than this share of a join's rows; there are fewer hot keys than its inverse, so a table of them is small.
HOT, HOT_ROWS = 1 / 10_000, 1000
#: Rows of a range that a column's values are cut into, about; ranges at most; the accuracy of quantiles that only bracket the exact ones.
RANGE_ROWS, RANGES, ACCURACY = 200_000, 4096, 10_000
#: Different values, of all columns together, whose ranks go to every task.
FEW = 2_000_000
#: Cuts that are compared with a value in one step.
BLOCK = 64


def met(rows: DataFrame, known: DataFrame, keys: list[str], weight: str, by: str, how: str = "inner") -> DataFrame:
    """rows joined to known on keys, where weight is how many of rows have a key of known (and is left out). Rows of hot keys are dealt by a hash of their column by, and meet a copy each."""
    most, every = known.agg(F.max(weight), F.sum(weight)).first()
    limit = max(HOT_ROWS, (every or 0) * HOT)
    if (most or 0) <= limit:
        return rows.join(known.drop(weight), keys, how)
    hot = F.broadcast(known.filter(F.col(weight) > limit).select(*keys, F.ceil(F.col(weight) / limit).alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    dealt = rows.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(by), salts)).drop("_salts")
    copies = known.drop(weight).join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("_salts")
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


def cuts_of(df: DataFrame, by: list[str], value: str) -> list:
    """by and cuts: where each by's values (of few) are cut into ranges of about RANGE_ROWS rows, RANGES at most; by that are one range have none."""
    counts = df.groupBy(*by).agg(F.count(value).alias("n")).collect()
    ranges = min(RANGES, max((-(-r["n"] // RANGE_ROWS) for r in counts), default=1))
    if ranges <= 1:
        return [(*r[: len(by)], []) for r in counts]
    at = F.array(*(F.lit(k / ranges) for k in range(1, ranges)))
    found = df.groupBy(*by).agg(F.percentile_approx(value, at, F.lit(max(ACCURACY, 10 * ranges))).alias("cuts")).collect()
    return [(*r[: len(by)], r["cuts"] or []) for r in found]


def with_table(df: DataFrame, by: list[str], rows: list[tuple], fields: str) -> DataFrame:
    """df with the fields of a table of one row a by, nulls alike; the by are few."""
    names = [f"_by{k}" for k, _ in enumerate(by)]
    head = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, by, strict=True))
    table = F.broadcast(df.sparkSession.createDataFrame(rows, f"{head}, {fields}" if by else fields))
    same = reduce(lambda a, b: a & b, (df[c].eqNullSafe(table[n]) for c, n in zip(by, names, strict=True)), F.lit(True))
    return df.join(table, same).drop(*names)


def in_ranges(df: DataFrame, by: list[str], value: str, cuts: list | None = None) -> DataFrame:
    """df with _range: the number of the range that value lies in, by the cuts of its by. Cuts are looked up in two steps of BLOCK comparisons, which is generated code."""
    cuts = cuts_of(df, by, value) if cuts is None else cuts
    most = max((len(r[-1]) for r in cuts), default=0)
    if not most:
        return df.withColumn("_range", F.lit(0))
    kind = df.schema[value].dataType.simpleString()
    df = with_table(df, by, cuts, f"_cuts array<{kind}>")
    less = lambda k: F.coalesce((F.get("_cuts", k) < F.col(value)).cast("int"), F.lit(0))
    df = df.withColumn("_block", reduce(lambda a, k: a + less(F.lit(k)), range(BLOCK - 1, most, BLOCK), F.lit(0)))
    own = reduce(lambda a, k: a + less(F.col("_block") * BLOCK + k), range(min(BLOCK, most)), F.lit(0))
    return df.withColumn("_range", F.col("_block") * BLOCK + own).drop("_cuts", "_block")


def numbered(df: DataFrame, by: list[str], value: str, ties: list[str], out: str, amount: Column | None = None) -> DataFrame:
    """df with the sum of amount (1 by default) over the rows before each, within by (of few values), in the order of value and ties: range by range, after the sums of the ranges before."""
    amount = F.lit(1) if amount is None else amount
    cut = in_ranges(df.withColumn("_amount", amount.cast("long")), by, value)
    sums = cut.groupBy(*by, "_range").agg(F.sum("_amount").alias("_n"))
    upto = Window.partitionBy(*by).orderBy("_range")
    first = sums.select(*by, "_range", (F.sum("_n").over(upto) - F.col("_n")).alias("_first"))
    inside = Window.partitionBy(*by, "_range").orderBy(value, *ties).rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("_upto", F.sum("_amount").over(inside)).join(F.broadcast(first), [*by, "_range"])
    return cut.withColumn(out, F.col("_first") + F.col("_upto") - F.col("_amount")).drop("_range", "_amount", "_upto", "_first")


def average_ranks(long: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """long with the average rank of value within by (of few values); rows without a value are left out.

    Rows are sorted within ranges of values after one shuffle, and the counts of the ranges before are added. A value that fills
    whole ranges is a cut more than once: its rank comes from counts alone, and its rows stay where they are. long is
    read three times, so what is dear to make is better written first.
    """
    long = long.filter(F.col(value).isNotNull())
    cuts = cuts_of(long, by, value)
    hot = {(*r[:-1], v) for r in cuts for v, w in zip(r[-1], r[-1][1:]) if v == w}
    cut = in_ranges(long, by, value, cuts)
    kind = long.schema[value].dataType.simpleString()
    often = [(*key, sorted(h[-1] for h in hot if h[:-1] == key)) for key in {h[:-1] for h in hot}]
    if hot:
        mine = [(*r[:-1], next((o[-1] for o in often if o[:-1] == r[:-1]), [])) for r in cuts]
        cut = with_table(cut, by, mine, f"_often array<{kind}>").withColumn("_hot", F.when(F.array_contains("_often", F.col(value)), F.col(value))).drop("_often")
    else:
        cut = cut.withColumn("_hot", F.lit(None).cast(kind))
    counts = cut.groupBy(*by, "_range", "_hot").agg(F.count("*").alias("n")).collect()  # a range's own rows, then those of the value that ends it
    before: dict[tuple, int] = {}
    cold, warm = [], []
    for r in sorted(counts, key=lambda r: (r["_range"], r["_hot"] is not None)):
        key = tuple(r[: len(by)])
        first = before.get(key, 0)
        before[key] = first + r["n"]
        if r["_hot"] is None:
            cold.append((*key, r["_range"], first))
        else:
            warm.append((*key, r["_hot"], first + (r["n"] + 1) / 2))
    w = Window.partitionBy(*by, "_range").orderBy(value)
    peers = F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow))
    rows = with_table(cut.filter("_hot IS NULL"), [*by, "_range"], cold, "_first long")
    rows = rows.withColumn(out, F.col("_first") + F.rank().over(w) + (peers - 1) / 2.0).drop("_first", "_range", "_hot")
    if not hot:
        return rows
    same = with_table(cut.filter("_hot IS NOT NULL"), [*by, "_hot"], warm, f"{out} double")
    return rows.unionByName(same.drop("_range", "_hot"))


def with_ranks(df: DataFrame, columns: list[str], prefix: str = "_r_") -> DataFrame:
    """df with the average rank of each column's value among that column's values (of no value: null) as prefix and the column's name.

    Values are counted and the counts' sums taken in the order of the values, so equal values are one row before anything is
    sorted. A column of up to FEW different values gets its ranks where its rows are; one of more by a join on its values, in which those
    that many rows share are salted.
    """
    long = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "_feature", "_value").filter("_value IS NOT NULL")
    counts = kept(long.groupBy("_feature", "_value").agg(F.count("*").alias("_c")), "counts")
    before = numbered(counts, ["_feature"], "_value", [], "_before", F.col("_c"))
    ranks = kept(before.select("_feature", "_value", "_c", (F.col("_before") + (F.col("_c") + 1) / 2).alias("_rank")), "ranks")
    different = {r["_feature"]: r["n"] for r in ranks.groupBy("_feature").agg(F.count("*").alias("n")).collect()}
    room, few = FEW, set()
    for c in sorted(columns, key=lambda c: different.get(c, 0)):
        room -= different.get(c, 0)
        few |= {c} if room >= 0 else set()
    row = [F.xxhash64(*(c for c, _ in df.dtypes)).alias("_deal")] if len(few) < len(set(columns)) else []
    out = df.select("*", *row)
    for c in columns:
        mine = ranks.filter(F.col("_feature") == c).select(F.col("_value").alias("_v"), "_c", F.col("_rank").alias(prefix + c))
        out = out.withColumn("_v", F.col(c).cast("double"))
        out = (out.join(F.broadcast(mine.drop("_c")), "_v", "left") if c in few else met(out, mine, ["_v"], "_c", "_deal", "left")).drop("_v")
    return out.drop("_deal")


def keyed_quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], accuracy: int = 1000) -> DataFrame:
    """by and quantiles: the exact quantiles of value within each of any number of keys, linear between neighbours; keys without values and null keys have none.

    Approximate quantiles bracket each exact one, with room for their error; of the values in a bracket, six in
    accuracy of the key's rows, counts by value give those of the right ranks. A key of few rows is its own bracket. So a task holds
    sketches and brackets, not keys.
    """
    room = 3 / accuracy
    low, high = ([min(1.0, max(0.0, q + d)) for q in shares] for d in (-room, room))
    sketch = lambda at: F.percentile_approx(value, F.array(*map(F.lit, at)), F.lit(accuracy))
    bounds = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), sketch(low).alias("_low"), sketch(high).alias("_high"))
    few = F.col("_n") <= 2 * accuracy
    cells = F.array(*(F.struct(F.lit(j).alias("j"), F.when(few, F.col("_lo")).otherwise(F.col("_low")[j]).alias("lo"), F.when(few, F.col("_hi")).otherwise(F.col("_high")[j]).alias("hi"), (q * (F.col("_n") - 1)).alias("at")) for j, q in enumerate(shares)))
    bounds = kept(bounds.select(*by, "_n", cells.alias("_cells")), "bounds")
    known = bounds.withColumn("_w", F.col("_n"))
    rows = met(df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias(value)), known, by, "_w", value)
    # a row is below a bracket, which is counted, or in it, or of no matter; both go by value, so equal ones are one row before they move
    place = F.transform("_cells", lambda c: F.struct(c["j"].alias("j"), c["at"].alias("at"), F.when(F.col(value) < c["lo"], F.lit(None).cast("double")).otherwise(F.col(value)).alias("v"), (F.col(value) > c["hi"]).alias("out")))
    each = rows.select(*by, F.explode(place).alias("c")).filter(~F.col("c.out")).groupBy(*by, "c.j", "c.at", "c.v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by, "j").orderBy(F.asc_nulls_first("v")))
    ranked = each.select(*by, "j", "at", "v", "n", upto.alias("upto")).filter("v IS NOT NULL")
    holds = lambda k: F.max(F.when((F.col("upto") > k) & (F.col("upto") - F.col("n") <= k), F.col("v")))
    k = F.floor("at")
    ends = ranked.groupBy(*by, "j").agg(holds(k).alias("v0"), holds(F.ceil("at")).alias("v1"), F.first(F.col("at") - k).alias("part"))
    one = ends.select(*by, F.struct("j", (F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("part")).alias("q")).alias("q"))
    return one.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("q")), lambda x: x["q"]).alias("quantiles"))


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of each column, linear between neighbours; None without values.

    Approximate quantiles a little below and above bracket each exact one; of the values in the bracket, a few in
    ACCURACY of all, counts by value give the one of the right rank.
    """
    low = F.array(*(F.lit(max(0.0, q - 3 / ACCURACY)) for q in shares))
    high = F.array(*(F.lit(min(1.0, q + 3 / ACCURACY)) for q in shares))
    around = df.agg(*(f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("n", F.count), ("min", F.min), ("max", F.max), ("lo", lambda c: F.percentile_approx(c, low, F.lit(ACCURACY))), ("hi", lambda c: F.percentile_approx(c, high, F.lit(ACCURACY)))))).first()
    known = [i for i, _ in enumerate(columns) if around[f"n_{i}"]]
    cells, below = [], []
    for i in known:
        c = F.col(columns[i])
        for j, _ in enumerate(shares):
            lo, hi = around[f"lo_{i}"][j], around[f"hi_{i}"][j]
            if around[f"n_{i}"] <= 2 * ACCURACY:  # a bracket of few rows could miss the second of two neighbours
                lo, hi = around[f"min_{i}"], around[f"max_{i}"]
            cells.append(F.when((c >= lo) & (c <= hi), F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), c.cast("double").alias("v"))))
            below.append(F.count_if(c < lo).alias(f"b_{i}_{j}"))
    out: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    if not known:
        return out
    less = df.agg(*below).first()
    counts = df.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).groupBy("x.i", "x.j", "x.v").agg(F.count("*").alias("n"))
    per = Window.partitionBy("i", "j").orderBy("v")
    ranked = counts.select("i", "j", "v", "n", F.sum("n").over(per).alias("upto"))
    wanted = F.lit(False)
    places = {}
    for i in known:
        for j, q in enumerate(shares):
            at = q * (around[f"n_{i}"] - 1)
            places[i, j] = at
            for k in {int(at), min(int(at) + 1, around[f"n_{i}"] - 1)}:
                k -= less[f"b_{i}_{j}"]
                wanted = wanted | ((F.col("i") == i) & (F.col("j") == j) & (F.col("upto") > k) & (F.col("upto") - F.col("n") <= k))
    found = ranked.filter(wanted).collect()  # two values a column and share
    for (i, j), at in places.items():
        own = sorted((r["upto"] - r["n"] + less[f"b_{i}_{j}"], r["upto"] + less[f"b_{i}_{j}"], r["v"]) for r in found if (r["i"], r["j"]) == (i, j))
        value = lambda k: next(v for a, b, v in own if a <= k < b)  # noqa: B023, E731
        k = int(at)
        v0, v1 = value(k), value(min(k + 1, around[f"n_{i}"] - 1))
        out[columns[i]][j] = v0 + (v1 - v0) * (at - k)
    return out
