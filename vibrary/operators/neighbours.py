"""Mutual information from nearest neighbours, over columns of any number of rows.

The distance to the k-th neighbour in the plane of two columns (the larger of the two differences) and the numbers of
rows as near on each axis give the estimate psi(n) + psi(k) - mean psi(a + 1) - mean psi(b + 1). Columns are scaled to unit
deviation, and noise far below their digits, drawn from each row's key, parts equal values.

The plane is cut into cells of a bounded number of rows, always across the longer side of a cell, in gaps near medians of a
sample; where the cuts lie changes the work, not the result. In a cell, rows lie in a tree of small leaves and are compared
with those of the leaves that their square touches. A row whose square leaves its cell asks the other cells the square touches for
their nearest rows, of which only those go there that lie as near their cell's edge as the largest square that asks. Counts on an axis
come from ranges of sorted values and the counts before them; an end in another range is mostly in one of the widest gaps, which all tasks
know, and asks that range else. Pairs go one after another, and what one writes is deleted before the next.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import passing
from . import skew
from .signals import finite

K, NOISE, EDGE = 5, 1e-10, 1e-15
#: Rows of a cell, about; cells of a pair of columns at most; rows of the sample for each cell; questions to a cell that are one task's.
CELL, CELLS, SAMPLED, ASKED = 20_000, 1 << 16, 32, 100_000
#: Rows of a leaf at most, but for a few; asking rows that go through a tree at once; gaps of a range that all tasks know.
LEAF, AT_ONCE, GAPS = 24, 4096, 64
#: Ranges of skew.RANGE_ROWS that may be one range of an axis here, where a task holds two numbers a row (a range is also one task's questions), and ranges there are while none is that large.
WIDER, SPREAD = 10, 16
#: How far from the median a cell is cut, as a share of its rows, and as far as for a gap so many times wider.
OFF, FAR = (0.07, 0.18), 1000


class Cells(NamedTuple):
    """Where the plane is cut: axis and value of each inner node (children 2i + 1 and 2i + 2), and the bounds of the leaves."""

    axis: np.ndarray
    value: np.ndarray
    low: np.ndarray
    high: np.ndarray


def middle(rows: np.ndarray) -> float:
    """The middle of a gap of sorted values: of the widest near the median or, if that is far wider, of the widest farther off, so that equal values that only noise parts stay together. The median of few."""
    found = []
    for off in OFF:
        start, end = int(len(rows) * (0.5 - off)), math.ceil(len(rows) * (0.5 + off))
        if end - start > 1:
            at = start + int(np.argmax(np.diff(rows[start:end])))
            found.append((rows[at + 1] - rows[at], rows[at]))
    if not found:
        return float(np.median(rows))
    wide, low = found[-1] if found[-1][0] > FAR * found[0][0] else found[0]
    return float(low + wide / 2)


def cut(sample: np.ndarray, cells: int) -> Cells:
    """Cells by gaps about medians of the sample (rows x, y), across the side along which it spreads most."""
    depth = max(0, math.ceil(math.log2(max(1, cells))))
    nodes, leaves = 2**depth - 1, 2**depth
    axis, value = np.zeros(nodes, np.int64), np.zeros(nodes)
    low, high = np.full((leaves, 2), -np.inf), np.full((leaves, 2), np.inf)

    def split(node: int, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        if node >= nodes:
            low[node - nodes], high[node - nodes] = lo, hi
            return
        a = int(np.argmax(np.ptp(rows, axis=0))) if len(rows) else 0
        at = middle(np.sort(rows[:, a])) if len(rows) else 0.0
        at = min(max(at, lo[a]), hi[a])
        axis[node], value[node] = a, at
        left_hi, right_lo = hi.copy(), lo.copy()
        left_hi[a] = right_lo[a] = at
        right = rows[:, a] > at
        split(2 * node + 1, rows[~right], lo, left_hi)
        split(2 * node + 2, rows[right], right_lo, hi)

    split(0, sample, np.full(2, -np.inf), np.full(2, np.inf))
    return Cells(axis, value, low, high)


def leaf_of(cells: Cells, xy: np.ndarray) -> np.ndarray:
    """The leaf of each row of xy."""
    node = np.zeros(len(xy), np.int64)
    while len(cells.axis) and node[0] < len(cells.axis):
        node = 2 * node + 1 + (xy[np.arange(len(xy)), cells.axis[node]] > cells.value[node])
    return node - len(cells.axis)


def touched(cells: Cells, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the square (rows of lo and hi) and leaf for each leaf a square touches, by square."""
    square, node = np.arange(len(lo)), np.zeros(len(lo), np.int64)
    while len(node) and len(cells.axis) and node[0] < len(cells.axis):
        axis, value = cells.axis[node], cells.value[node]
        left, right = lo[square, axis] <= value, hi[square, axis] >= value
        square, node = np.concatenate((square[left], square[right])), np.concatenate((2 * node[left] + 1, 2 * node[right] + 2))
    order = np.argsort(square, kind="stable")
    return square[order], node[order] - len(cells.axis)


class Tree(NamedTuple):
    """Rows in leaves of one size (filled up with infinite ones), their places, and the bounds of the nodes of each level."""

    leaves: np.ndarray
    place: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]


def tree_of(xy: np.ndarray) -> Tree:
    """A balanced tree, cut across the longer side of each node at its median."""
    depth = max(0, math.ceil(math.log2(max(1, len(xy)) / LEAF)))
    size = max(1, -(-len(xy) // 2**depth))
    rows = np.full((1, size * 2**depth, 2), np.inf)
    rows[0, : len(xy)] = xy
    place = np.arange(rows.shape[1])[None]
    for level in range(depth):
        half = rows.shape[1] // 2
        known = np.isfinite(rows)
        side = np.where(known, rows, -np.inf).max(axis=1) - rows.min(axis=1)  # of nodes without rows: minus infinity
        axis = np.argmax(side, axis=1)
        by = np.take_along_axis(rows, axis[:, None, None], axis=2)[..., 0]
        order = np.argpartition(by, half, axis=1)
        rows = np.take_along_axis(rows, order[..., None], axis=1).reshape(2 ** (level + 1), half, 2)
        place = np.take_along_axis(place, order, axis=1).reshape(2 ** (level + 1), half)
    low, high = [rows.min(axis=1)], [np.where(np.isfinite(rows), rows, -np.inf).max(axis=1)]
    for _ in range(depth):
        low.insert(0, low[0].reshape(-1, 2, 2).min(axis=1))
        high.insert(0, high[0].reshape(-1, 2, 2).max(axis=1))
    return Tree(rows, place, low, high)


def least(d: np.ndarray, k: int) -> np.ndarray:
    """The k smallest of each row, ascending, infinite where there are fewer."""
    if d.shape[1] > k:
        d = np.partition(d, k - 1, axis=1)[:, :k]
    elif d.shape[1] < k:
        d = np.concatenate((d, np.full((len(d), k - d.shape[1]), np.inf)), axis=1)
    return np.sort(d, axis=1)


def within(tree: Tree, asking: np.ndarray, r: np.ndarray, near: np.ndarray, own: np.ndarray | None = None) -> None:
    """Puts into near (k a row) the distances of the asking rows to rows of leaves that their squares of size r touch, but for their own leaves."""
    k, last = near.shape[1], len(tree.low) - 1
    for start in range(0, len(asking), AT_ONCE):
        at, size = asking[start : start + AT_ONCE], r[start : start + AT_ONCE, None]
        lo, hi = at - size, at + size
        row, node = np.arange(len(at)), np.zeros(len(at), np.int64)
        for level in range(last + 1):
            if level:
                row, node = np.repeat(row, 2), (2 * node[:, None] + np.arange(2)).ravel()
            meets = ((lo[row] <= tree.high[level][node]) & (hi[row] >= tree.low[level][node])).all(axis=1)
            row, node = row[meets], node[meets]
        if own is not None:
            other = node != own[start + row]
            row, node = row[other], node[other]
        turn = np.arange(len(row)) - np.searchsorted(row, row)  # rows are ascending
        order = np.argsort(turn, kind="stable")
        ends = np.searchsorted(turn[order], np.arange(turn.max(initial=-1) + 2))
        for a, b in zip(ends, ends[1:]):  # each row once a turn
            for c in range(a, b, AT_ONCE):
                mine = order[c : min(b, c + AT_ONCE)]
                d = np.abs(at[row[mine], None] - tree.leaves[node[mine]])
                who = start + row[mine]
                near[who] = least(np.concatenate((near[who], np.maximum(d[..., 0], d[..., 1])), axis=1), k)


def nearest(asking: np.ndarray, rows: np.ndarray, k: int, itself: bool, r: np.ndarray | None = None) -> np.ndarray:
    """The k smallest distances of each asking row to rows, ascending, infinite where there are fewer; with itself, rows are the asking ones and none counts itself. With r, only those of at most r are sure to be found."""
    near = np.full((len(asking), k), np.inf)
    if not len(asking) or not len(rows):
        return near
    tree, own = tree_of(rows), None
    if itself:
        own, size = np.empty(len(rows), np.int64), tree.leaves.shape[1]
        for start in range(0, len(tree.leaves), 256):
            part, place = tree.leaves[start : start + 256], tree.place[start : start + 256].ravel()
            with np.errstate(invalid="ignore"):
                d = np.abs(part[:, :, None] - part[:, None]).max(axis=3) if size == 1 else np.maximum(*(np.abs(part[:, :, None, x] - part[:, None, :, x]) for x in (0, 1)))
            d[:, np.arange(size), np.arange(size)] = np.inf
            real = place < len(rows)
            near[place[real]] = least(d.reshape(-1, size)[real], k)
            own[place[real]] = np.repeat(np.arange(start, start + len(part)), size)[real]
    within(tree, asking, near[:, -1].copy() if r is None else r, near, own)
    return near


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(values))


def normal(*parts: Column) -> Column:
    """A standard normal number that hangs on parts alone."""
    u = lambda seed: (F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.ln(u(1))) * F.cos(2 * math.pi * u(2))


def digamma(x: Column) -> Column:
    """The digamma function from 1 on."""
    y = x + 8
    far = F.ln(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8)
    for i in range(8):
        far = far - 1 / (x + i)
    return far


def psi(x: np.ndarray) -> np.ndarray:
    """digamma of numbers from 1 on, of an array."""
    x = np.asarray(x, float)
    out, x = np.zeros(x.shape), x.copy()
    while (low := x < 12).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def scaled(df: DataFrame, names: list[str], key: list[str], noise: float = NOISE) -> DataFrame:
    """id (the key, unique) and the named columns as finite numbers or null, scaled, with noise."""
    rows = df.select(F.struct(*key).alias("id"), *(finite(F.col(c).cast("double")).alias(c) for c in names))
    by = rows.agg(*(f(c).alias(f"{n}_{i}") for i, c in enumerate(names) for n, f in (("s", F.stddev_pop), ("m", lambda c: F.avg(F.abs(c)))))).first()
    out = []
    for i, c in enumerate(names):
        s = by[f"s_{i}"] or 1.0
        out.append((F.col(c) / s + noise * max(1.0, (by[f"m_{i}"] or 0.0) / s) * normal(F.col("id"), F.lit(c))).alias(c))
    return rows.select("id", *out)


def exploded(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    each = F.array(*(F.struct(F.lit(i).alias("pair"), F.col(a).alias("x"), F.col(b).alias("y")) for i, (a, b) in enumerate(pairs)))
    return rows.select("id", F.explode(each).alias("z")).select("z.pair", "id", "z.x", "z.y").filter("x IS NOT NULL AND y IS NOT NULL")


def planes(df: DataFrame, pairs: list[tuple[str, str]], key: list[str], noise: float = NOISE) -> DataFrame:
    """pair, id, x and y of each row with both columns known, scaled, with noise; rows are known by key (unique)."""
    return exploded(scaled(df, list(dict.fromkeys(c for pair in pairs for c in pair)), key, noise), pairs)


def samples(rows: DataFrame, pairs: list[tuple[str, str]]) -> list[tuple[int, np.ndarray]]:
    """For each pair of columns of rows (id and columns) how many rows have both, and x and y of those whose hashes are small: about SAMPLED for each cell."""
    both = [F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()) for a, b in pairs]
    counts = list(rows.agg(*(c.alias(f"n{i}") for i, c in enumerate(both))).first())
    shares = [min(1.0, SAMPLED * cells_for(n) / n) if cells_for(n) > 1 else 0.0 for n in counts]
    found: list = []
    if max(shares, default=0) > 0:
        hashed = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
        share = F.element_at(F.array(*map(F.lit, shares)), F.col("pair") + 1)
        found = exploded(rows.filter(hashed < max(shares) * float(1 << 40)), pairs).filter(hashed < share * float(1 << 40)).select("pair", "x", "y").collect()
    sample = np.array([tuple(r) for r in found]).reshape(-1, 3)
    return [(n, sample[sample[:, 0] == i, 1:]) for i, n in enumerate(counts)]


def cells_for(n: int) -> int:
    return min(CELLS, -(-n // CELL))


def distances(rows: DataFrame, cells: Cells, k: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """x, y and r, the distance of each row (x, y) to its k-th neighbour; infinite if there are fewer rows."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xy = np.stack([batch.column(c).to_numpy() for c in ("x", "y")], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(leaf_of(shared.value, xy).astype(np.int32)), *batch.columns], names=["leaf", "x", "y"])

    def own(part: pa.Table) -> pa.Table:
        """Distances within a cell; for rows that must ask other cells, the distances to the nearest and those cells."""
        cells, leaf = shared.value, part.column("leaf")[0].as_py()
        xy = np.stack([part.column(c).to_numpy() for c in ("x", "y")], axis=1)
        near = nearest(xy, xy, k, True)
        lo, hi = xy - near[:, -1:], xy + near[:, -1:]
        out = np.flatnonzero(((lo <= cells.low[leaf]) | (hi >= cells.high[leaf])).any(axis=1))
        square, to = touched(cells, lo[out], hi[out])
        square, to = out[square[to != leaf]], to[to != leaf]
        asked = np.bincount(square, minlength=len(xy))
        asks = asked > 0
        one = [pa.array(near[:, -1]), pa.array((leaf << 32) + np.arange(len(xy)), mask=~asks), lists(near[asks].ravel(), np.where(asks, k, 0)), lists(to.astype(np.int32), asked)]
        return pa.table([*part.select(["leaf", "x", "y"]).columns, *one], names=["leaf", "x", "y", "r", "id", "near", "others"])

    first = rows.select("x", "y").mapInArrow(place, "leaf int, x double, y double").groupBy("leaf").applyInArrow(own, "leaf int, x double, y double, r double, id long, near array<double>, others array<int>")
    first = keep(first, "near")
    done, asking = (first.filter(c) for c in (F.size("others") == 0, F.size("others") > 0))
    asks = asking.select("id", "x", "y", "r", F.explode("others").alias("to"))
    asked = [(r["to"], r["chunks"], r["most"] * (1 + 1e-9)) for r in asks.groupBy("to").agg(F.ceil(F.count("*") / ASKED).alias("chunks"), F.max("r").alias("most")).collect()]  # a row a cell
    if not asked:
        return done.select("x", "y", "r")
    bounds = [(*a, *map(float, cells.low[a[0]]), *map(float, cells.high[a[0]])) for a in asked]
    known = F.broadcast(spark.createDataFrame(bounds, "to int, chunks long, most double, lx double, ly double, hx double, hy double"))
    asks = asks.join(known.select("to", "chunks"), "to").withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks")).drop("chunks")
    edge = F.least(F.col("x") - F.col("lx"), F.col("hx") - F.col("x"), F.col("y") - F.col("ly"), F.col("hy") - F.col("y"))  # a square from outside that holds a row is larger than the row's way to the edge
    there = first.select(F.col("leaf").alias("to"), "x", "y").join(known, "to").filter(edge <= F.col("most"))
    copies = there.select(F.col("to").alias("t"), F.col("x").alias("u"), F.col("y").alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("c"))

    def answer(asking: pa.Table, there: pa.Table) -> pa.Table:
        a, b = (np.stack([t.column(c).to_numpy() for c in names], axis=1) for t, names in ((asking, "xy"), (there, "uv")))
        near = nearest(a, b, k, False, asking.column("r").to_numpy())
        return pa.table([asking.column("id"), lists(near.ravel(), np.full(len(a), k))], names=["id", "near"])

    answers = asks.groupBy("to", "chunk").cogroup(copies.groupBy("t", "c")).applyInArrow(answer, "id long, near array<double>")
    every = asking.select("id", "x", "y", "near").unionByName(answers, allowMissingColumns=True)
    by = every.groupBy("id").agg(F.max("x").alias("x"), F.max("y").alias("y"), F.flatten(F.collect_list("near")).alias("near"))
    more = keep(by.select("x", "y", F.element_at(F.sort_array("near"), k).alias("r")), "asked")
    return done.select("x", "y", "r").unionByName(more)


class Axis(NamedTuple):
    """Where an axis is cut, how many values lie before each range, and the runs of values between known gaps: their ends and how many values lie before each."""

    cuts: np.ndarray
    first: np.ndarray
    low: np.ndarray
    high: np.ndarray
    below: np.ndarray


def marks_of(sample: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a sample's values are cut into so many ranges of about as many, in the widest gap near each place, and these cuts with the middles of each range's widest gaps."""
    v = np.sort(sample)
    if ranges < 2 or len(v) < 2:
        return np.empty(0), np.empty(0)
    wide, middle = np.diff(v), v[:-1] + np.diff(v) / 2
    near = max(1, len(v) // (4 * ranges))
    at = []
    for k in range(1, ranges):
        start = min(max(0, len(v) * k // ranges - near), len(wide) - 1)
        at.append(start + int(np.argmax(wide[start : start + 2 * near])))
    at = sorted(set(at))
    gaps = [s + np.argsort(-wide[s:e], kind="stable")[:GAPS] for s, e in zip([0, *at], [*at, len(wide)])]
    cuts = np.unique(middle[at])
    return cuts, np.unique(np.concatenate((cuts, *(middle[g] for g in gaps))))


def axes_of(points: DataFrame, marks: list[tuple[np.ndarray, np.ndarray]]) -> list[Axis]:
    """What is known of both axes of points (x, y) by counts, least and greatest values between the marks; a pass that moves no rows."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = ([np.full(len(m) + 1, z) for _, m in marks] for z in (0, np.inf, -np.inf))
        for batch in batches:
            for a, c in enumerate(("x", "y")):
                v = np.sort(batch.column(c).to_numpy())
                ends = np.append(np.searchsorted(v, marks[a][1], "right"), len(v))
                starts = np.append(0, ends[:-1])
                some = np.flatnonzero(ends > starts)
                n[a][some] += (ends - starts)[some]
                low[a][some] = np.minimum(low[a][some], v[starts[some]])
                high[a][some] = np.maximum(high[a][some], v[ends[some] - 1])
        for a, _ in enumerate(marks):
            some = np.flatnonzero(n[a])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), a, np.int32)), pa.array(some.astype(np.int32)), pa.array(n[a][some].astype(np.int64)), pa.array(low[a][some]), pa.array(high[a][some])], names=["axis", "run", "n", "low", "high"])

    runs = points.select("x", "y").mapInArrow(counts, "axis int, run int, n long, low double, high double")
    found = np.array([tuple(r) for r in runs.groupBy("axis", "run").agg(F.sum("n"), F.min("low"), F.max("high")).collect()], float).reshape(-1, 5)
    out = []
    for a, (cuts, m) in enumerate(marks):
        own = found[found[:, 0] == a]
        own = own[np.argsort(own[:, 1])]
        n = np.zeros(len(m) + 2, np.int64)
        n[own[:, 1].astype(int) + 1] = own[:, 2].astype(np.int64)
        upto = np.cumsum(n)  # values before each run
        out.append(Axis(cuts, np.append(0, upto[np.searchsorted(m, cuts) + 1]), own[:, 3], own[:, 4], np.append(upto[own[:, 1].astype(int)], upto[-1])))
    return out


def before(axis: Axis, end: np.ndarray, right: bool) -> np.ndarray:
    """How many values of the axis lie before each right end, or up to each left end, as far as its known gaps say; -1 where they do not."""
    run = np.searchsorted(axis.high, end, "left" if right else "right")
    low = np.append(axis.low, np.inf)[run]
    return np.where((low >= end) if right else (low > end), axis.below[run], -1)


def psi_near(points: DataFrame, n: int, sample: np.ndarray, keep: Callable[[DataFrame, str], DataFrame]) -> tuple[int, float]:
    """How many points (x, y, r; about n, with a sample of x and y), and the sum over them and both axes of psi(a + 1), a being how many others are nearer than r on the axis."""
    spark = points.sparkSession
    rows = min(WIDER * skew.RANGE_ROWS, max(skew.RANGE_ROWS, -(-n // SPREAD)))
    marks = [marks_of(sample[:, a], -(-n // rows)) for a in (0, 1)]
    axes = axes_of(points, marks)
    shared = spark.sparkContext.broadcast(axes)
    each = F.array(*(F.struct(F.lit(a).alias("axis"), F.col(c).alias("v")) for a, c in enumerate(("x", "y"))))
    long = points.select("r", F.explode(each).alias("z")).select("z.axis", "z.v", "r")
    ranged = skew.in_ranges(long, ["axis"], "v", [(a, [float(c) for c in axis.cuts]) for a, axis in enumerate(axes)])
    fields = "axis int, n long, psi double, id long, side int, to int, end double, base long"

    def count(part: pa.Table) -> pa.Table:
        """The sum over those rows of a range whose ends lie in it or in known gaps, and the other ends; a row on an end does not count, so ends are drawn in by what sums of doubles may lose."""
        a, j = part.column("axis")[0].as_py(), part.column("_range")[0].as_py()
        axis, v, r = shared.value[a], part.column("v").to_numpy(), part.column("r").to_numpy()
        order = np.argsort(v)
        v, r = v[order], r[order]
        r = r - EDGE * (np.abs(v) + r)
        found, ends, to = [], [v - r, v + r], []
        for side, end in enumerate(ends):
            to.append(np.searchsorted(axis.cuts, end))
            here = to[side] == j
            at = np.empty(len(v), np.int64)
            at[here] = axis.first[j] + np.searchsorted(v, end[here], "left" if side else "right")
            at[~here] = before(axis, end[~here], bool(side))
            found.append(at)
        open_ = [f < 0 for f in found]
        known = ~(open_[0] | open_[1])
        near = found[1][known] - found[0][known] - 1
        least = np.bincount(np.minimum(near, 4096), minlength=4097)
        total = float(least[:-1] @ TABLE) + float(psi(near[near >= 4096] + 1.0).sum())
        out = [pa.table({"axis": [a], "n": [len(near)], "psi": [total], "id": [None], "side": [None], "to": [None], "end": [None], "base": [None]}, schema=kind)]
        for side in (0, 1):
            i = np.flatnonzero(open_[side])
            # the count is right - left - 1; of two open ends the left one has the 1
            base = np.where(open_[1 - side][i], side - 1, (found[1][i] if side == 0 else -found[0][i]) - 1)
            more = [np.full(len(i), a, np.int32), None, None, (j << 40) + i, np.full(len(i), side, np.int32), to[side][i].astype(np.int32), ends[side][i], base]
            out.append(pa.table([pa.nulls(len(i), f.type) if x is None else pa.array(x, f.type) for x, f in zip(more, kind, strict=True)], schema=kind))
        return pa.concat_tables(out)

    i4, i8, d8 = pa.int32(), pa.int64(), pa.float64()
    kind = pa.schema(list(zip(["axis", "n", "psi", "id", "side", "to", "end", "base"], [i4, i8, d8, i8, i4, i4, d8, i8])))
    counted = keep(ranged.groupBy("axis", "_range").applyInArrow(count, fields), "counted")
    size, total = counted.filter("n IS NOT NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("psi"), F.lit(0.0))).first()
    asks = counted.filter("n IS NULL").select("axis", "to", "id", "side", "end", "base")
    asked = [tuple(r) for r in asks.groupBy("axis", "to").agg(F.ceil(F.count("*") / rows)).collect()]  # a row a range
    if asked:
        chunks = F.broadcast(spark.createDataFrame(asked, "axis int, to int, chunks long"))
        asks = asks.join(chunks, ["axis", "to"]).withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks")).drop("chunks")
        copies = ranged.select("axis", F.col("_range").alias("to"), "v").join(chunks, ["axis", "to"])
        copies = copies.select(F.col("axis").alias("a"), F.col("to").alias("t"), "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("c"))

        def answer(asking: pa.Table, there: pa.Table) -> pa.Table:
            if not len(asking):
                return asking.select(["axis", "id", "base"])
            first = shared.value[asking.column("axis")[0].as_py()].first[asking.column("to")[0].as_py()]
            v, end, side = np.sort(there.column("v").to_numpy()), asking.column("end").to_numpy(), asking.column("side").to_numpy()
            found = first + np.where(side == 1, np.searchsorted(v, end, "left"), np.searchsorted(v, end, "right"))
            part = asking.column("base").to_numpy() + np.where(side == 1, found, -found)
            return pa.table([asking.column("axis"), asking.column("id"), pa.array(part, pa.int64())], names=["axis", "id", "base"])

        answers = asks.groupBy("axis", "to", "chunk").cogroup(copies.groupBy("a", "t", "c")).applyInArrow(answer, "axis int, id long, base long")
        near = answers.groupBy("axis", "id").agg(F.sum("base").alias("near"))
        more, rest = near.agg(F.count("*"), F.sum(digamma(F.col("near").cast("double") + 1))).first()
        size, total = size + more, total + rest
    return size // 2, total


#: psi of 1, 2, ... as far as most counts go.
TABLE = psi(np.arange(1, 4097))


def mutual_information(df: DataFrame, pairs: list[tuple[str, str]], key: list[str], k: int = K, noise: float = NOISE) -> DataFrame:
    """a, b and mi (not below zero) of each pair of columns, from the rows where both are known; null with k rows or fewer."""
    spark = df.sparkSession
    rows, out = scaled(df, list(dict.fromkeys(c for pair in pairs for c in pair)), key, noise), []
    for (a, b), (n, sample) in zip(pairs, samples(rows, pairs), strict=True):
        mi = None
        if n > k:
            with passing(spark, "neighbours") as keep:
                plane = rows.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
                size, total = psi_near(distances(plane, cut(sample, cells_for(n)), k, keep), n, sample, keep)
            mi = max(0.0, float(psi(size) + psi(k)) - total / size)
        out.append((a, b, mi))
    return spark.createDataFrame(out, "a string, b string, mi double")
