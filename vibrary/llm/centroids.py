"""Clustering of vectors around centroids, in whole numbers, by a tournament of bisectors.

Two centroids i < j have a bisector: x is nearer to j if and only if x . (2 (c_j - c_i)) > |c_j|^2 - |c_i|^2. Normals and
thresholds of all pairs are whole numbers and worked out once a round. A vector finds its centroid in a knock-out
tournament: neighbours in the list play first, winners go on, and each of the k - 1 games is the sign of one bisector
test. On the bisector itself the smaller number wins; as the left part of the list always has the smaller numbers, ties end
at the smallest number. The distance is worked out for the winner only.

Vectors stay where they are. A task sends a row for each cluster it met (count and sums), so a round's shuffle has k rows a
task at most whatever the sizes of the clusters, and k x d numbers reach the driver, which makes the next centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, table

K, ROUNDS, SIZE, SCALE, SEED = 40, 5, 64, 256.0, 2
#: Vectors that play at once.
SLICE = 2000
#: Up to these sizes of components sums over 64 products fit a double's or a long's digits; larger ones are Python's whole numbers.
EXACT_DOUBLE, EXACT_LONG = 1 << 22, 1 << 27
#: Components of this size and more are no numbers to cluster by, like infinite ones: sums of them fit no column.
TOO_LARGE = 1e25
LONG = (1 << 63) - 1


def whole_vectors(column: pa.Array, size: int = SIZE, scale: float = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold exactly size known, finite components, and those rows as whole numbers floor(scale * x)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == size)
    values = column.take(pa.array(rows)).flatten()
    x = values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), size)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(x * scale)
        good = (np.abs(x) < TOO_LARGE).all(axis=1)
    x = x[good]
    if len(x) and np.abs(x).max() >= EXACT_LONG:
        return rows[good], np.array([[int(v) for v in row] for row in x], object)
    return rows[good], x.astype(np.int64)


class Bisectors:
    """Normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: list[list[int]]) -> None:
        self.k = len(centroids)
        self.centroids = np.array(centroids, object).reshape(self.k, -1)
        i, j = np.triu_indices(self.k, 1)
        self.at = np.zeros((self.k, self.k), np.int64)
        self.at[i, j] = np.arange(len(i))
        self.normals = 2 * (self.centroids[j] - self.centroids[i])
        square = (self.centroids * self.centroids).sum(axis=1)
        self.thresholds = square[j] - square[i]
        self.largest = max((abs(v) for row in centroids for v in row), default=0)
        self.forms: dict[type, tuple[np.ndarray, ...]] = {}

    def form(self, x: np.ndarray) -> type:
        """The kind of number in which all tests on x are exact."""
        if x.dtype == object or self.largest >= EXACT_LONG:
            return object
        return float if max(self.largest, int(np.abs(x).max(initial=0))) < EXACT_DOUBLE else np.int64

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each vector's nearest centroid, and its squared distance."""
        kind = self.form(x)
        if kind not in self.forms:
            self.forms[kind] = tuple(a.astype(kind) for a in (self.normals, self.thresholds, self.centroids))
        normals, thresholds, centroids = self.forms[kind]
        y = x.astype(kind)
        # first games: all vectors meet the same neighbours, so they are one product of matrices
        first = self.at[np.arange(0, self.k - 1, 2), np.arange(1, self.k, 2)]
        right = (y @ normals[first].T > thresholds[first]).astype(np.int64)
        left = [2 * g + right[:, g] for g in range(len(first))]
        winners = left + ([np.full(len(y), self.k - 1)] if self.k % 2 else [])
        while len(winners) > 1:
            after = []
            for a, b in zip(winners[::2], winners[1::2]):
                game = self.at[a, b]
                beyond = (y * normals[game]).sum(axis=1) > thresholds[game]
                after.append(np.where(beyond, b, a))
            winners = after + (winners[-1:] if len(winners) % 2 else [])
        apart = y - centroids[winners[0]]
        squared = (apart * apart).sum(axis=1)
        return winners[0], squared if kind is object else squared.astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The kept rows of each batch without their vectors, a slice at a time, and their whole vectors."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            rows, x = whole_vectors(part.column("embedding"))
            if len(rows):
                yield part.drop_columns(["embedding"]).take(pa.array(rows)), x


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k kept vectors whose sha256 of seed and number is smallest; of rows with one number, the smaller vector first."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column("_order"), pa.array([[Decimal(int(v)) for v in row] for row in x], pa.list_(pa.decimal128(38, 0)))], names=["_order", "x"])

    some = vectors.select("embedding", order.alias("_order"))
    known = F.expr(f"size(embedding) = {SIZE}")
    # the bound on the hash is a filter before Python: only rows that can be among the first reach it
    for bound in (hash_bound(some.filter(known), k), "g"):
        found = some.filter(known & (F.col("_order") < bound)).mapInArrow(kept, "_order string, x array<decimal(38,0)>").orderBy("_order", "x").limit(k).collect()
        if len(found) == k:
            break
    return [[int(v) for v in row["x"]] for row in found]


def hash_bound(some: DataFrame, k: int) -> str:
    """A hash below which there are a few times k rows if hashes are spread evenly, from the number of rows."""
    share = min(1.0, 8 * (k + 8) / max(some.count(), 1))
    return "g" if share >= 1 else f"{int(share * (1 << 64)):016x}"


def sums(vectors: DataFrame, bisectors: Bisectors) -> list:
    """cluster, n and the 64 sums of every cluster that has vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast(bisectors)
    names = [f"s{d}" for d in range(SIZE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        game = shared.value
        total, count = np.zeros((game.k, SIZE), object), np.zeros(game.k, np.int64)
        for _, x in slices(batches):
            won, _ = game.nearest(x)
            met, at = np.unique(won, return_inverse=True)
            if x.dtype == object:
                for c, row in zip(won, x, strict=True):
                    total[c] += row
            else:
                part = np.zeros((len(met), SIZE), np.int64)
                np.add.at(part, at, x)
                total[met] += part.astype(object)
            count += np.bincount(won, minlength=game.k)
        met = np.flatnonzero(count)
        columns = [pa.array(met, pa.int32()), pa.array(count[met], pa.int64()), *(pa.array([Decimal(int(v)) for v in total[met, d]], pa.decimal128(38, 0)) for d in range(SIZE))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", *names])

    each = vectors.select("embedding").mapInArrow(run, "cluster int, n long, " + ", ".join(f"{c} decimal(38,0)" for c in names))
    found = each.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names)).collect()
    shared.unpersist()
    return found


def moved(centroids: list[list[int]], found: list) -> list[list[int]]:
    """The centroids after a round: floor(sum / count) of each component; one without vectors stays."""
    after = list(centroids)
    for row in found:
        after[row["cluster"]] = [int(v) // row["n"] for v in row[2:]]
    return after


def trained(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> list[list[int]]:
    """The centroids after all rounds: k lists of whole numbers, fewer if fewer vectors are kept."""
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(centroids, sums(vectors, Bisectors(centroids)))
    return centroids


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster and distance (squared; null beyond a long) of every kept vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(Bisectors(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in slices(batches):
            won, squared = shared.value.nearest(x)
            apart = pa.array([int(v) if v <= LONG else None for v in squared] if squared.dtype == object else squared, pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), pa.array(won, pa.int32()), apart], names=["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Cluster, squared distance, inertias and the centroid's digest of every kept row of vectors (vec_id, embedding).

    A row is kept if its vector has exactly SIZE components, none null, NaN, infinite or of TOO_LARGE after scaling;
    others give no row. Repeated rows are rows of their own; a null vec_id is a number like any other (as empty
    text where first centroids are drawn). Of fewer than k kept vectors each starts a centroid; an empty table gives an empty result.
    A distance or inertia beyond a long is null. Other columns are left out.
    """
    vectors = vectors.select("vec_id", "embedding")
    centroids = trained(vectors, k, rounds, seed)
    rows = settled(assigned(vectors, centroids), "assigned") if centroids else assigned(vectors.limit(0), [[0] * SIZE])
    by = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("beyond"))
    own = {r["cluster"]: None if r["beyond"] else int(r["s"]) for r in by.collect()}  # k rows at most
    whole = None if None in own.values() else sum(own.values())
    fits = lambda v: v if v is not None and v <= LONG else None
    facts = [(c, fits(v), fits(whole), digest(centroids[c])) for c, v in own.items()]
    facts = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _rounds() -> str:
    """The rounds one after the other, each from the centroids before it."""
    parts = []
    for r in range(ROUNDS + 1):
        parts.append(f"""a{r} AS (SELECT row, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT x.row, any_value(x.v) AS v, c.c, list_sum(list_transform(list_zip(any_value(x.v), any_value(c.v)), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM x, c{r} c GROUP BY x.row, c.c) GROUP BY row, v)""")
        if r < ROUNDS:
            parts.append(f"""c{r + 1} AS (SELECT c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
    SELECT c, i, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c) m USING (c))""")
    return ",\n".join(parts)


OP13_SQL = f"""
WITH x AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {SIZE}
), c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS c, v FROM x QUALIFY c < {K}),
{_rounds()}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(z.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN x USING (row) JOIN c{ROUNDS} z ON z.c = a.c
"""
