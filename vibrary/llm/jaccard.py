"""Exact Jaccard self-join of documents on word shingles, by a token-group matrix.

1. Sharing: every document's distinct shingles are dealt by hash to shards, packed a chunk of documents to a
   row; a shard counts which occur in more than one document. A document whose shared shingles are fewer than
   the threshold's share of its set links with nothing and is done. Equal sets are one class from here on, and
   sharing is counted again among classes.
2. Groups: what is left is partitioned into groups of similar documents: each class is compared with the
   most central class that has the same minimum hash, and linked to it if the pair reaches the threshold exactly;
   later rounds do so with more minimum hashes and any class as head where groups differ.
3. Matrix: the classes of a larger group, and those of small groups with the same first minimum hash, form blocks of
   bounded size, and the union of a block's token sets is stored. A class meets the blocks that hold a token of its own prefix (its rarest tokens, one
   more than a link may miss), a member of a larger group and a member of a size that fits. Its overlap with
   the block's union bounds its overlap with every member; only the members of blocks whose bound reaches the
   threshold are read, and compared exactly.
4. Components of all links found. Classes of one group need no further comparison, so groups of copies cost
   few comparisons a class, and no link between different groups is lost.

Sets are kept as 64-bit hashes; classes by a 128-bit hash of the sorted set. Where many rows share a key (a large
class, group or common token), the join on it is salted, see skew.met.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.skew import met
from .common import Hashes, let_go, settled, table, words_of

SHINGLE, PERCENT = 4, 85
#: Shingles of the documents in a chunk, and those of a shard, about.
CHUNK, SHARD = 300_000, 1_000_000
#: Classes of a block, and classes compared with a block at once, about.
BLOCK, QUERIES = 250, 1000
#: Classes of a group from which on it has blocks of its own.
GATHERED = 16
#: Comparisons with one head that are one task's, and blocks in one row of a token, about.
FOLLOWERS, TOGETHER = 1000, 1000
#: Up to so many keys are broadcast to pick their documents; more are joined by shuffle.
BROADCAST_ROWS = 300_000
#: Minimum hashes compared in each round of step 2: one is enough for most copies, later rounds are for what is still apart.
ROUNDS = (1, 1, 8)
#: For so many minimum hashes the head of a group is its most central class, for the others any class.
CENTRAL = 2
STARS = [int(x) | 1 for x in np.random.default_rng(8).integers(1 << 63, size=sum(ROUNDS))]
_hashes = Hashes()


def shingle_set(text: bytes | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of n words; a shorter text is one run, a blank one none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def set_mark(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def least_common(a: Column, b: Column, percent: int) -> Column:
    """Whether a set of size a can have percent of a union in common if b of it are shared."""
    return (a > 0) & (100 * b >= percent * a)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, _h (hash of the text) and text as bytes: rows equal in the first two are equal in all."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("_h"), F.col("text").cast("binary").alias("text"))


def sharing(docs: DataFrame, shards: int, n: int = SHINGLE) -> DataFrame:
    """doc_id, _h, mark, n and shared (shingles that another row has, too) of each row of docs (doc_id, _h, text).

    A chunk sends a shard the hashes that are the shard's own and how many each of its documents has, documents
    without any left out; so the bytes follow the number of shingles, not documents by shards.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        chunk = (task.partitionId() if task else 0) << 32
        ids: list = []
        hashes: list = []
        sets: list[np.ndarray] = []

        def rows() -> pa.RecordBatch:
            sizes = np.array([len(s) for s in sets])
            tokens, of = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
            shard = (tokens >> np.uint64(32)) % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
            low, of = (tokens & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order], of[order]
            out: list[list] = [[] for _ in range(9)]
            home = (chunk % (1 << 32) + (chunk >> 32) * 31) % shards  # this shard's row carries the chunk's ids
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                if k != home and a == b:
                    continue
                head = (ids, hashes, [set_mark(s) for s in sets], sizes.tolist()) if k == home else (None,) * 4
                starts = np.flatnonzero(np.append(True, of[a + 1 : b] != of[a : b - 1])) if b > a else np.zeros(0, np.int64)
                counts = np.diff(np.append(starts, b - a)).astype(np.uint32)
                for values, x in zip(out, (chunk, k, *head, of[a:b][starts].tobytes(), counts.tobytes(), low[a:b].tobytes()), strict=True):
                    values.append(x)
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), *[pa.binary()] * 3)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["chunk", "shard", "ids", "hashes", "marks", "sizes", "owners", "counts", "keys"])

        held = 0
        for batch in batches:
            for doc_id, h, text in zip(*batch.columns, strict=True):
                ids.append(doc_id.as_py())
                hashes.append(h.as_py())
                sets.append(shingle_set(text.as_py(), n))
                held += len(sets[-1]) + 20
                if held >= CHUNK:
                    yield rows()
                    chunk, held, ids, hashes, sets = chunk + 1, 0, [], [], []
        if ids:
            yield rows()
        _hashes.clear()
        let_go()

    def count(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        tokens = np.concatenate([np.frombuffer(k.as_py(), np.uint32) for k in part.column("keys")])
        order = np.argsort(tokens, kind="stable")
        same = tokens[order][1:] == tokens[order][:-1]
        again = np.zeros(len(tokens), bool)
        again[order] = np.append(same, False) | np.append(False, same) if len(tokens) else False
        sums, owners, counts, at = np.append(0, np.cumsum(again)), [], [], 0
        for o, c in zip(part.column("owners"), part.column("counts"), strict=True):
            ends = at + np.cumsum(np.frombuffer(c.as_py(), np.uint32).astype(np.int64))
            shared = sums[ends] - sums[np.append(at, ends[:-1])] if len(ends) else ends
            owners.append(np.frombuffer(o.as_py(), np.uint32)[shared > 0].tobytes())
            counts.append(shared[shared > 0].astype(np.uint32).tobytes())
            at = int(ends[-1]) if len(ends) else at
        part = part.select(["chunk", "ids", "hashes", "marks", "sizes"])
        return part.append_column("owners", pa.array(owners, pa.binary())).append_column("counts", pa.array(counts, pa.binary()))

    def total(part: pa.Table) -> pa.Table:
        head = part.filter(pa.compute.is_valid(part.column("ids"))).to_pylist()[0]
        shared = np.zeros(len(head["ids"]), np.int64)
        for o, c in zip(part.column("owners"), part.column("counts"), strict=True):
            shared[np.frombuffer(o.as_py(), np.uint32)] += np.frombuffer(c.as_py(), np.uint32)
        return pa.table({"doc_id": pa.array(head["ids"], pa.int64()), "_h": pa.array(head["hashes"], pa.int64()), "mark": pa.array(head["marks"], pa.binary()), "n": pa.array(head["sizes"], pa.int64()), "shared": pa.array(shared)})

    head = "ids array<long>, hashes array<long>, marks array<binary>, sizes array<long>, owners binary, counts binary"
    dealt = docs.select("doc_id", "_h", "text").mapInArrow(deal, f"chunk long, shard int, {head}, keys binary")
    return dealt.groupBy("shard").applyInArrow(count, f"chunk long, {head}").groupBy("chunk").applyInArrow(total, "doc_id long, _h long, mark binary, n long, shared long")


def picked(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and _h are in keys; in files if they came by a shuffle, so that they are in one order whoever reads them."""
    few = keys.count() <= BROADCAST_ROWS
    keys = keys.toDF("_k", "_kh")
    both = docs.join(F.broadcast(keys) if few else keys, docs["doc_id"].eqNullSafe(keys["_k"]) & (docs["_h"] == keys["_kh"]), "left_semi")
    return both if few else settled(both, "picked")


def token_sets(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """mark, node (half of the mark), n, tokens (as bytes) and the minimum hashes of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                sets = [shingle_set(t.as_py(), n) for t in batch.column(0).slice(start, 1000)]
                marks = [set_mark(s) for s in sets]
                nodes = [int.from_bytes(m[:8], "little", signed=True) for m in marks]
                stars = [[int((s * np.uint64(k)).min().astype(np.int64)) if len(s) else 0 for k in STARS] for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(stars, pa.list_(pa.int64()))], names=["mark", "node", "n", "tokens", "stars"])
        _hashes.clear()
        let_go()

    return docs.select("text").mapInArrow(run, "mark binary, node long, n long, tokens binary, stars array<long>")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose token sets reach the threshold; followers says how many have this b."""
    a, b = (sets.select(F.col("node").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
    pairs = settled(pairs.withColumn("part", F.pmod(F.xxhash64("a"), F.ceil(F.col("followers") / FOLLOWERS))), "pairs")
    heads = pairs.select("b", "part").distinct().join(b, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, "a").join(heads, ["b", "part"]).select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and group, the smallest node that edges (a, b) reach from it, for all nodes.

    Least labels spread over edges, and from labels that got a smaller label themselves to all that bear them, until
    none changes. A node with many edges and a label that many bear are hot keys.
    """
    both = settled(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    degrees = both.groupBy("b").agg(F.count("*").alias("degree"))
    degrees = settled(degrees, "degrees")
    labels = settled(nodes.select("node", F.col("node").alias("group")), "labels")
    while True:
        known = degrees.join(labels.select(F.col("node").alias("b"), "group"), "b")
        near = met(both, known, ["b"], "degree", "a").groupBy("a").agg(F.min("group").alias("near"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", "group", F.least("group", F.coalesce("near", "group")).alias("to"))
        step = settled(step, "labels")
        if step.filter("to <> group").isEmpty():
            return step.select("node", "group")
        changed = step.filter("to <> node").select(F.col("node").alias("to"), F.col("to").alias("far"))
        changed = settled(changed.join(step.groupBy("to").agg(F.count("*").alias("bearers")), "to"), "changed")
        labels = met(step.select("node", "to"), changed, ["to"], "bearers", "node", "left").select("node", F.coalesce("far", "to").alias("group"))
        labels = settled(labels, "labels")


def link_groups(docs: DataFrame, percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach, its own included) of each row of docs (doc_id, text).

    Null, empty and blank texts have no shingles and link with nothing; texts of fewer than n words are one
    shingle. Repeated rows are equal sets and so linked; a null doc_id counts as larger than all others and
    is its own component_id if nothing else is in its component. Other columns are left out; an empty table
    gives an empty result. Nothing is capped: links between all different sets count.
    """
    return grouped(docs, percent, n).select("doc_id", "n_shingles", F.coalesce("least.doc_id", "doc_id").alias("component_id"))


def grouped(docs: DataFrame, percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """doc_id, _h, n_shingles and least, the first row (no_id, doc_id, _h) of its component, of each row of docs; null for rows without shingles."""
    docs = identified(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(8, int(size / 6 / SHARD) + 1)
    rows = settled(sharing(docs, shards, n), "sharing")
    first_row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_h")
    classes = rows.filter("n > 0").groupBy("mark").agg(F.min(first_row).alias("least"), F.first("n").alias("n"), F.max("shared").alias("shared"), F.count("*").alias("copies"))
    classes = settled(classes, "classes")
    named = component_names(docs, classes, shards, percent, n)
    found = classes.select("mark", "least", "copies").join(named, "mark", "left").select("mark", "copies", F.coalesce("of", "least").alias("least"))
    found = settled(found, "found")
    blank = rows.filter("n = 0").select("doc_id", "_h", F.col("n").alias("n_shingles"), F.lit(None).cast(found.schema["least"].dataType).alias("least"))
    return met(rows.filter("n > 0"), found, ["mark"], "copies", "doc_id", "left").select("doc_id", "_h", F.col("n").alias("n_shingles"), "least").union(blank)


def component_names(docs: DataFrame, classes: DataFrame, shards: int, percent: int, n: int) -> DataFrame:
    """mark and of, the first row of the component, of the classes that may link with another."""
    spark = docs.sparkSession
    some = least_common(F.col("n"), F.col("shared"), percent)
    first = classes.filter(some)
    one = lambda df: df.select("least.doc_id", "least._h")
    among = sharing(picked(docs, one(first)), shards, n)
    left = among.filter(some).join(first.select("mark", "least"), "mark", "left_semi").dropDuplicates(["mark"]).select("mark", "doc_id", "_h")
    left = settled(left, "left")
    sets = token_sets(picked(docs, left.select("doc_id", "_h")), n).join(left.select("mark"), "mark", "left_semi").dropDuplicates(["mark"])
    sets = settled(sets, "sets")
    unpacked = settled(_unpacked(sets), "tokens")
    df = settled(unpacked.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1").withColumn("w", F.col("df")), "df")
    shared = settled(met(unpacked, df, ["token"], "w", "node"), "shared_tokens")
    central = shared.groupBy("node").agg((F.sum("df") / F.first("n")).alias("central"))
    stars = settled(sets.select("node", "stars").join(central, "node"), "stars")
    groups = settled(sets.select("node", F.col("node").alias("group")), "groups")
    links = spark.createDataFrame([], "a long, b long")
    done = 0
    for width in ROUNDS:
        each = F.posexplode(F.slice("stars", done + 1, width)).alias("k", "star")
        star = settled(stars.select("node", "central", each).join(groups, "node"), "star")
        order = F.when(F.col("k") < CENTRAL - done, -F.col("central")).otherwise(F.xxhash64("node", "k").cast("double"))
        head = star.groupBy("k", "star").agg(F.min(F.struct(order.alias("order"), "node", "group")).alias("head"), F.count("*").alias("c")).filter("c > 1")
        head = settled(head.select("k", "star", F.col("head.node").alias("b"), F.col("head.group").alias("b_group"), "c", F.col("c").alias("followers")), "heads")
        pairs = met(star, head, ["k", "star"], "c", "node").filter(F.col("group") != F.col("b_group")).groupBy(F.col("node").alias("a"), "b").agg(F.sum("followers").alias("followers"))
        links = settled(links.union(linked(pairs, sets, percent)), "links")
        groups = components(sets, links)
        done += width
    # rare tokens first; tokens of one class only fill the prefix and meet nothing
    allowed = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    order = Window.partitionBy("node").orderBy("df", "token")
    ranked = shared.withColumn("rank", F.row_number().over(order)).withColumn("alone", F.col("n") - F.count("*").over(Window.partitionBy("node")))
    prefix = ranked.filter(F.col("alone") + F.col("rank") <= allowed).select("node", "token", "n")
    sizes = settled(groups.groupBy("group").agg(F.count("*").alias("members")).withColumn("w", F.col("members")), "sizes")
    placed = blocks(stars, settled(met(groups, sizes, ["group"], "w", "node"), "members"))
    placed = settled(placed.select("node", "block", F.struct("members", "group").alias("at")), "placed")
    asks = settled(meetings(prefix.join(placed, "node"), percent), "asks")
    links = settled(links.union(opened(asks, placed, sets, percent)), "links")
    groups = settled(components(sets, links).join(sets.select("node", "mark"), "node").join(classes.select("mark", "least"), "mark"), "groups")
    of = settled(groups.groupBy("group").agg(F.min("least").alias("of"), F.count("*").alias("w")), "of")
    return met(groups.select("mark", "group"), of, ["group"], "w", "mark").select("mark", "of")


def meetings(prefix: DataFrame, percent: int) -> DataFrame:
    """q and block of the blocks that a class meets: they hold a token of its prefix and a member of a larger group, and sizes fit.

    A token's blocks are gathered before they meet its classes, TOGETHER to a row, and a class's meetings are
    made distinct within its own arrays, so a common token makes no row for each class and block.
    """
    prefix = settled(prefix, "prefix")
    cells = prefix.groupBy("token", "block").agg(F.max("at").alias("top"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    rows = cells.groupBy("token").agg(F.count("*").alias("_blocks"))
    counts = prefix.groupBy("token").agg(F.count("*").alias("asked"))
    known = rows.join(counts, "token").filter("asked > 1").withColumn("_rows", F.ceil(F.col("_blocks") / TOGETHER))
    row = cells.join(known, "token").groupBy("token", "asked", F.pmod(F.xxhash64("block"), "_rows").alias("row")).agg(F.collect_list(F.struct("block", "top", "lo", "hi")).alias("cells"))
    row = settled(row.drop("row"), "matrix")
    asks = prefix.select(F.col("node").alias("q"), "token", F.col("at").alias("q_at"), F.col("n").alias("q_n"))
    fits = lambda x: (x["top"] > F.col("q_at")) & (100 * x["hi"] >= percent * F.col("q_n")) & (percent * x["lo"] <= 100 * F.col("q_n"))
    found = met(asks, row, ["token"], "asked", "q").select("q", F.transform(F.filter("cells", fits), lambda x: x["block"]).alias("blocks")).filter(F.size("blocks") > 0)
    return found.groupBy("q").agg(F.array_distinct(F.flatten(F.collect_set("blocks"))).alias("blocks")).select("q", F.explode("blocks").alias("block"))


def blocks(stars: DataFrame, members: DataFrame) -> DataFrame:
    """node, group, members and block: the classes of a larger group in as few blocks of about BLOCK as hold them, those of smaller groups with the classes that have the same first minimum hash."""
    star = stars.select("node", F.col("stars")[0].alias("star"))
    together = F.col("members") >= GATHERED
    keyed = settled(members.join(star, "node").select("node", "group", "members", together.alias("_large"), F.when(together, F.col("group")).otherwise(F.col("star")).alias("_of")), "keyed")
    parts = settled(keyed.groupBy("_large", "_of").agg(F.ceil(F.count("*") / BLOCK).alias("parts"), F.count("*").alias("w")), "parts")
    placed = met(keyed, parts, ["_large", "_of"], "w", "node")
    return placed.select("node", "group", "members", F.xxhash64("_large", "_of", F.pmod(F.xxhash64("node"), "parts")).alias("block"))


def unions(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """The matrix: block and the union of its members' token sets (sorted, as bytes)."""

    def run(part: pa.Table) -> pa.Table:
        held = np.unique(np.concatenate([np.frombuffer(t.as_py(), np.uint64) for t in part.column("tokens")]))
        return pa.table({"block": part.column("block")[:1], "tokens": pa.array([held.tobytes()], pa.binary())})

    return placed.select("node", "block").join(sets.select("node", "tokens"), "node").select("block", "tokens").groupBy("block").applyInArrow(run, "block long, tokens binary")


def opened(met_blocks: DataFrame, placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the classes q with members of the blocks they met (q, block) whose group is larger than q's: one for each such group.

    First the stored union of a block bounds the overlap; then those that pass are compared with the members. In
    both steps at most about QUERIES of the classes that met a block are one task's group; more classes get copies.
    """

    def chunked(asks: DataFrame) -> tuple[DataFrame, DataFrame]:
        chunks = settled(asks.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).alias("chunks"), F.count("*").alias("w")), "chunks")
        rows = met(asks, chunks, ["block"], "w", "q").select(F.col("block").alias("q_block"), F.pmod(F.xxhash64("q"), "chunks").alias("q_chunk"), "q")
        rows = rows.join(sets.select(F.col("node").alias("q"), F.col("tokens").alias("q_tokens")), "q")
        return rows, chunks.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))

    def overlap(union: np.ndarray, tokens: bytes) -> np.ndarray:
        """For each token of the union, 1 if it is among tokens."""
        own = np.frombuffer(tokens, np.uint64)
        places = np.minimum(np.searchsorted(union, own), len(union) - 1)
        flags = np.zeros(len(union), np.int64)
        flags[places[union[places] == own]] = 1
        return flags

    def bound(ask: pa.Table, block: pa.Table) -> pa.Table:
        keep = []
        if block.num_rows:
            union = np.frombuffer(block.column("tokens")[0].as_py(), np.uint64)
            keep = [100 * int(overlap(union, t.as_py()).sum()) >= percent * (len(t.as_py()) // 8) for t in ask.column("q_tokens")]
        return ask.select(["q", "q_block"]).filter(pa.array(keep or [False] * ask.num_rows, pa.bool_())).rename_columns(["q", "block"])

    def compare(ask: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        held = [np.frombuffer(t.as_py(), np.uint64) for t in block.column("tokens")]
        if held and ask.num_rows:
            union, at = np.unique(np.concatenate(held), return_inverse=True)
            n = np.array([len(x) for x in held])
            starts = np.cumsum(n) - n
            node, group, members = (block.column(c).to_numpy() for c in ("node", "group", "members"))
            for q, tokens, size, own in zip(*(ask.column(c).to_pylist() for c in ("q", "q_tokens", "q_members", "q_group")), strict=True):
                common = np.add.reduceat(overlap(union, tokens)[at], starts)
                fits = (100 * common >= percent * (n + len(tokens) // 8 - common)) & ((members > size) | ((members == size) & (group > own)))
                _, first = np.unique(group[fits], return_index=True)
                out += [(q, int(x)) for x in node[fits][first]]
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    matrix = settled(unions(placed, sets), "unions")
    asks, copies = chunked(met_blocks)
    matrix = copies.join(matrix, "block")
    passed = asks.groupBy("q_block", "q_chunk").cogroup(matrix.groupBy("block", "chunk")).applyInArrow(bound, "q long, block long")
    asks, copies = chunked(settled(passed, "passed"))
    at = placed.select("node", "block", F.col("at.members").alias("members"), F.col("at.group").alias("group"))
    asks = asks.join(at.select(F.col("node").alias("q"), F.col("members").alias("q_members"), F.col("group").alias("q_group")), "q")
    inside = at.join(sets.select("node", "tokens"), "node").join(copies, "block")
    return asks.groupBy("q_block", "q_chunk").cogroup(inside.groupBy("block", "chunk")).applyInArrow(compare, "a long, b long")


def one_of_each(docs: DataFrame, percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """docs, all columns, with one row of each component: the one with the smallest doc_id (of equal ids one of any text). Rows without words stay; rows without id go only if their component has another row."""
    found = settled(grouped(docs, percent, n), "components")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_h")
    gone = found.filter("n_shingles > 0").filter(own != F.col("least")).select("doc_id", "_h").distinct()
    twice = found.filter("n_shingles > 0").filter(own == F.col("least")).groupBy("doc_id", "_h").agg(F.count("*").alias("c")).filter("c > 1").select("doc_id", "_h")
    kept = without(docs, gone)
    if twice.isEmpty():
        return kept
    own_hash = f"h{uuid.uuid4().hex}"  # no column of docs
    keys = docs.select("*", F.xxhash64("text").alias(own_hash))
    few = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
    once = keys.join(few, keys["doc_id"].eqNullSafe(few["doc_id"]) & (keys[own_hash] == few["_h"]), "left_semi").dropDuplicates(["doc_id", own_hash])
    return without(kept, twice).union(once.select(docs.columns))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id and hash of the text are in gone (doc_id, _h), null ids included; gone is broadcast if it is proven to be small."""
    gone = gone.toDF("_gone_id", "_gone_h")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_gone_id"]) & (F.xxhash64(docs["text"]) == gone["_gone_h"]), "left_anti").select(docs.columns)


def _unpacked(sets: DataFrame) -> DataFrame:
    """A row (node, n, token) for each token of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                each = [np.frombuffer(t.as_py(), np.int64) for t in part.column(2)]
                sizes = [len(x) for x in each]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), sizes)), pa.array(np.repeat(part.column(1).to_numpy(), sizes)), pa.array(np.concatenate(each))], names=["node", "n", "token"])
        let_go()

    return sets.select("node", "n", "tokens").mapInArrow(run, "node long, n long, token long")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_groups(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_sort(list_distinct([array_to_string(words[i:i + 3], ' ') FOR i IN range(1, len(words) - 2)])) END AS shingles FROM w
), e AS (SELECT doc_id, len(shingles) AS n, CASE WHEN len(shingles) = 0 THEN 'none ' || doc_id ELSE md5(array_to_string(shingles, '|')) END AS mark, shingles FROM s),
c AS (SELECT mark, min(doc_id) AS first, any_value(n) AS n, any_value(shingles) AS shingles FROM e GROUP BY mark),
t AS (SELECT first, n, hash(unnest(shingles)) AS shingle FROM c),
k AS (SELECT a.first AS a, b.first AS b FROM t a JOIN t b ON a.shingle = b.shingle AND a.first < b.first AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.first, b.first, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT first AS a, first AS b FROM c UNION SELECT r.a, edges.b FROM r JOIN edges ON r.b = edges.a),
lowest AS (SELECT a AS first, min(b) AS component_id FROM r GROUP BY a)
SELECT e.doc_id, e.n AS n_shingles, component_id FROM e JOIN c USING (mark) JOIN lowest ON lowest.first = c.first
"""
