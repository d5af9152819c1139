"""Correlations and elimination of very many columns, as a table of close pairs that stays on executors.

Rows are vectors (column x). Sums of products are made a block of columns by a block of columns, a task's own rows first; the
blocks meet by their numbers, become correlations, and what reaches the threshold is an edge. Which of close columns go is
decided by joins over the edges. The driver holds a few numbers a column.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import kept

#: Columns of a block; bytes of products that a task sums up in one reading of the rows; tasks whose sums meet in one step.
BLOCK, HELD, MET = 256, 256 << 20, 16


def matrix(batch: pa.RecordBatch, p: int) -> np.ndarray:
    """The vectors of a batch; a row with a missing or infinite number is left out."""
    x = batch.column(0)
    rows = np.flatnonzero(x.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == p)
    flat = x.take(pa.array(rows)).flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), p)
    return flat[np.isfinite(flat).all(axis=1)]


def centre(vectors: DataFrame, p: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, and mean and sum of squares about it of each column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m2 = 0, np.zeros(p), np.zeros(p)
        for batch in batches:
            x = matrix(batch, p)
            if len(x):
                own, more = x.mean(axis=0), len(x)
                d = own - mean
                m2 += ((x - own) ** 2).sum(axis=0) + d * d * n * more / (n + more)
                mean += d * more / (n + more)
                n += more
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(p)), pa.array(np.full(p, n)), pa.array(mean), pa.array(m2)], names=["k", "n", "mean", "m2"])

    parts = kept(vectors.select("x").mapInArrow(run, "k long, n long, mean double, m2 double"), "centre")
    means = parts.groupBy("k").agg(F.sum("n").alias("every"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("common"))
    d = F.col("mean") - F.col("common")
    rows = parts.join(means, "k").groupBy("k").agg(F.first("every").alias("n"), F.first("common").alias("mean"), F.sum(F.col("m2") + F.col("n") * d * d).alias("m2")).orderBy("k").collect()
    return (rows[0]["n"] if rows else 0), np.array([r["mean"] for r in rows]), np.array([r["m2"] for r in rows])


def close_pairs(vectors: DataFrame, names: list[str], least: float) -> DataFrame:
    """a, b and r of every two columns whose correlation is at least least in size, each pair both ways; a constant column has none."""
    p, spark = len(names), vectors.sparkSession
    vectors = vectors.select(F.col("x").cast("array<double>").alias("x"))
    n, mean, m2 = centre(vectors, p)
    if not n:
        return spark.createDataFrame([], "a string, b string, r double")
    scale = np.where(m2 > 0, 1 / np.sqrt(np.where(m2 > 0, m2, 1.0)), 0.0)
    pairs = list(combinations_with_replacement(range(-(-p // BLOCK)), 2))
    each = max(1, HELD // (8 * BLOCK * BLOCK))
    shared = spark.sparkContext.broadcast((mean, scale, names))
    own = lambda k: slice(k * BLOCK, min(p, (k + 1) * BLOCK))

    def products(some: list[tuple[int, int]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                z = matrix(batch, p)
                z = (z - shared.value[0]) * shared.value[1]
                for i, j in some:
                    g = z[:, own(i)].T @ z[:, own(j)]
                    sums[i, j] = sums[i, j] + g if (i, j) in sums else g
            task = TaskContext.get()
            for (i, j), g in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([task.partitionId() if task else 0], pa.int64()), pa.array([g.tobytes()], pa.binary())], names=["i", "j", "task", "g"])

        return vectors.mapInArrow(run, "i int, j int, task long, g binary")

    def added(part: pa.Table) -> np.ndarray:
        return sum(np.frombuffer(g.as_py()) for g in part.column("g"))

    def step(part: pa.Table) -> pa.Table:
        return pa.table({"i": part.column("i")[:1], "j": part.column("j")[:1], "task": pa.array([part.column("task")[0].as_py() // MET], pa.int64()), "g": pa.array([added(part).tobytes()], pa.binary())})

    def edges(part: pa.Table) -> pa.Table:
        i, j = part.column("i")[0].as_py(), part.column("j")[0].as_py()
        r = added(part).reshape(own(i).stop - own(i).start, -1)
        a, b = np.nonzero(np.abs(r) >= least)
        r, a, b = r[a, b], a + own(i).start, b + own(j).start
        if i == j:
            r, a, b = r[a != b], a[a != b], b[a != b]
        else:
            r, a, b = np.append(r, r), np.append(a, b), np.append(b, a)
        names = shared.value[2]
        return pa.table({"a": pa.array([names[k] for k in a], pa.string()), "b": pa.array([names[k] for k in b], pa.string()), "r": pa.array(r, pa.float64())})

    out = None
    for start in range(0, len(pairs), each):
        sums = products(pairs[start : start + each])
        tasks = vectors.rdd.getNumPartitions()
        while tasks > MET:  # so that no group holds many tasks' sums
            sums, tasks = sums.groupBy("i", "j", F.floor(F.col("task") / MET)).applyInArrow(step, "i int, j int, task long, g binary"), -(-tasks // MET)
        found = sums.groupBy("i", "j").applyInArrow(edges, "a string, b string, r double")
        out = found if out is None else out.unionByName(found)
    return kept(out, "edges")


def without_close(edges: DataFrame, columns: DataFrame, factor: float = 10.0) -> DataFrame:
    """The rows of columns (feature, place, worth, inflation) that stay where those of edges (a, b) are close; places are distinct.

    A column goes if it is close to an inflated one of more worth. It also goes if it is inflated itself and close to
    one of more worth that stays, or that would go only by a column later than this one. Of equal worths the earlier is the greater.
    """
    facts = kept(columns.select("feature", "place", "worth", (F.col("inflation") >= factor).alias("high")), "columns")
    side = lambda n: facts.select(*(F.col(c).alias(f"{n}_{c}") for c in facts.columns))
    both = edges.select(F.col("a").alias("a_feature"), F.col("b").alias("b_feature")).join(side("a"), "a_feature").join(side("b"), "b_feature")
    better = kept(both.filter((F.col("b_worth") > F.col("a_worth")) | ((F.col("b_worth") == F.col("a_worth")) & (F.col("b_place") < F.col("a_place")))), "better")
    first = kept(better.filter("b_high").groupBy(F.col("a_feature").alias("f")).agg(F.min("b_place").alias("first")), "first")
    later = better.filter("a_high").join(first.select(F.col("f").alias("b_feature"), F.col("first").alias("b_first")), "b_feature", "left")
    gone = later.filter(F.col("b_first").isNull() | (F.col("a_place") < F.col("b_first"))).select(F.col("a_feature").alias("f"))
    return columns.join(first.select("f").union(gone).distinct(), F.col("feature") == F.col("f"), "left_anti")
