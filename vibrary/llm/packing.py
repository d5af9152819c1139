"""Packing tokenised documents into sequences of fixed size by hierarchical best fit.

Documents become pieces of at most SIZE tokens. Pieces of full size are sequences of their own. The others are
dealt evenly into parts; each part is packed by best fit and emits its nearly full sequences. What is underfull
goes up a tree: a node takes the underfull sequences of FAN nodes as items, packs them by best fit, emits what is
nearly full and passes on the rest, until the root emits all. Nothing is capped: items of one length are alike, so
a node works on how many there are of each length (SIZE numbers a child at most, however many rows these stand
for) and says for ranges of them where they go. On the way down each part learns where its sequences went, and a
part has PART_ROWS rows or so. Every level is written to the shared folder, so a lost executor costs the parts it
was packing.
"""

from __future__ import annotations

import base64
import json
import math
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let_go, settled, table

SIZE, END = 1024, 2
PART_ROWS, FAN = 50_000, 8
#: A sequence with at most so many tokens free is nearly full.
SLACK = 4
#: Words of which a task remembers the tokens.
REMEMBERED = 300_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Where n sequences of a node's child go that are filled to fill, from the lo-th on: each to a place at offset off of a
#: sequence of its own, numbered from seq on if that is emitted, else the to_lo-th and following of those filled to to_fill.
MOVES = "node long, child long, fill long, lo long, n long, off long, seq long, to_fill long, to_lo long"
PLACES = "node long, fill long, lo long, n long, off long, seq long"
ODD_BLANKS = re.compile(r"\s \s")


class Tokens(dict):
    """Words to the token ids (as bytes) of a space and the word, of the byte-level BPE whose ranks lie in path.

    A space followed by a visible character always starts a new piece of the BPE's splitting pattern, so a
    text without a blank on both sides of a space is the sum of its words; other texts are encoded whole.
    Special tokens part the text before all else, as where their strings are not asked to be ordinary text.
    """

    def __init__(self, path: str, pattern: str, special: dict[str, int] | None = None) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = {s: array("I", [i]).tobytes() for s, i in (special or {}).items()}
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if special else None

    def whole(self, text: str) -> bytes:
        return array("I", self.bpe.encode_ordinary(text)).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.whole(" " + word)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) < 100:
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if not any(map(text.__contains__, self.special)):
            return self.ordinary(text)
        between = map(self.ordinary, self.marks.split(text))
        return next(between) + b"".join(self.special[m] + x for m, x in zip(self.marks.findall(text), between, strict=True))

    def ordinary(self, text: str) -> bytes:
        if "  " in text or ODD_BLANKS.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return (self.whole(first) if first else b"") + b"".join(map(self.__getitem__, rest))


@lru_cache(1)
def tokens(path: str | None = None, ranks: str | None = None) -> Tokens:
    """The tokeniser of path (a file of the tokenizers library), by the ranks of the same vocabulary."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return Tokens(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special)


def cut(ids: bytes, size: int = SIZE) -> Iterator[tuple[int, int, int, int]]:
    """piece, start, length and CRC of the ids' pieces; all but the first have size tokens."""
    n = len(ids) // 4
    end = n % size or min(size, n)
    start = piece = 0
    while start < n:
        yield piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end])
        piece, start, end = piece + 1, end, end + size


def pieces(docs: DataFrame, parts: int, size: int = SIZE) -> DataFrame:
    """The pieces of each row of docs (doc_id, text) with a part number, or -1 and a sequence of their own if full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = tokens(), np.array([END], np.dtype("<u4")).tobytes()
        task = TaskContext.get()
        number = task.partitionId() if task else 0
        count = 0
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                for piece, start, length, crc in cut(bpe.ids(text.as_py() or "") + end, size):
                    count += 1
                    full = length == size
                    for values, x in zip(out, (doc_id.as_py(), piece, start, length, crc, -1 if full else (number * 7919 + count) % parts, (1 << 62) + (number << 38) + count if full else None), strict=True):
                        values.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[*"doc_id piece start length ids_crc32 part sequence_id".split()])
        bpe.clear()
        let_go()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + ", part long, sequence_id long")


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """How often each filling of a sequence is used, and the lengths in it, for so many items of each length: longest first, each into the fullest sequence that has room."""
    room: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(size + 1)]
    free = 0  # bit r is set if a sequence has r tokens free

    def put(r: int, times: int, held: tuple[int, ...]) -> None:
        nonlocal free
        if times:
            room[r].append((times, held))
            free |= 1 << r

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            fits = free >> s
            if fits:
                r = s + (fits & -fits).bit_length() - 1
                times, held = room[r].pop()
                if not room[r]:
                    free &= ~(1 << r)
            else:
                r, times, held = size, n, ()
            each = min(r // s, n)  # the sequence just filled is the fullest for the next item, too
            used = min(times, n // each)
            put(r - each * s, used, held + (s,) * each)
            if held:
                put(r, times - used, held)
            n -= used * each
    return [x for at in room for x in at]


def moved(children: dict[int, dict[int, int]], node: int, first: int, last: bool, size: int) -> Iterator[tuple]:
    """Rows of MOVES for the underfull sequences of a node's children, which come as how many there are of each fill; emitted sequences are numbered from first on."""
    total: dict[int, int] = {}
    queues: dict[int, list[list[int]]] = {}  # of each fill: child, its next sequence, how many are left
    for child in sorted(children):
        for fill, n in children[child].items():
            total[fill] = total.get(fill, 0) + n
            queues.setdefault(fill, []).append([child, 0, n])
    for q in queues.values():
        q.reverse()
    passed: dict[int, int] = {}
    for times, held in best_fit(total, size):
        fill = sum(held)
        out = last or size - fill <= SLACK
        start = first if out else passed.get(fill, 0)
        off = 0
        for s in held:
            done = 0
            while done < times:
                child, lo, n = queues[s][-1]
                take = min(n, times - done)
                yield node, child, s, lo, take, off, start + done if out else None, None if out else fill, None if out else start + done
                done += take
                if take == n:
                    queues[s].pop()
                else:
                    queues[s][-1] = [child, lo + take, n - take]
            off += s
        if out:
            first += times
        else:
            passed[fill] = start + times


def as_table(rows: list[tuple], fields: str) -> pa.Table:
    names = fields.replace(",", "").split()[::2]
    return pa.table({c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(names)})


def first_number(level: int, node: int) -> int:
    """The first of a node's numbers for sequences: as many as all of its parts could need."""
    return (level << 58) + (node * FAN**level << 20)


def packed(rows: DataFrame, last: bool, size: int) -> DataFrame:
    """rows, part by part, with sequence_id and offset, or, for what goes up, fill and the sequence's place among the part's of that fill."""

    def run(part: pa.Table) -> pa.Table:
        lengths = part.column("length").to_numpy()
        order = np.argsort(lengths, kind="stable")
        kinds, starts, counts = np.unique(lengths[order], return_index=True, return_counts=True)
        start = dict(zip(kinds.tolist(), starts.tolist(), strict=True))
        number = part.column("part")[0].as_py()
        out = {c: np.full(len(lengths), -1, np.int64) for c in ("sequence_id", "offset", "fill", "place")}
        for _, _, s, lo, n, off, seq, fill, place in moved({0: dict(zip(kinds.tolist(), counts.tolist(), strict=True))}, number, first_number(0, number), last, size):
            at = order[start[s] + lo : start[s] + lo + n]
            out["offset"][at] = off
            if seq is None:
                out["fill"][at], out["place"][at] = fill, place + np.arange(n)
            else:
                out["sequence_id"][at] = seq + np.arange(n)
        part = part.drop_columns(["sequence_id"])
        for c, x in out.items():
            part = part.append_column(c, pa.array(x, mask=x < 0))
        return part

    return rows.groupBy("part").applyInArrow(run, PIECES + ", part long, sequence_id long, offset long, fill long, place long")


def merged(counts: DataFrame, level: int, last: bool, size: int) -> DataFrame:
    """MOVES of a level's nodes for counts (child, fill, n)."""

    def run(part: pa.Table) -> pa.Table:
        children: dict[int, dict[int, int]] = {}
        for child, fill, n in zip(*(part.column(c).to_pylist() for c in ("child", "fill", "n")), strict=True):
            children.setdefault(child, {})[fill] = n
        node = part.column("node")[0].as_py()
        return as_table(list(moved(children, node, first_number(level, node), last, size)), MOVES)

    return counts.withColumn("node", F.floor(F.col("child") / FAN).cast("long")).groupBy("node").applyInArrow(run, MOVES)


def placed(moves: DataFrame, above: DataFrame) -> DataFrame:
    """PLACES of the children of a level's nodes: where the sequences they passed on are in the end, from the nodes' own moves and PLACES of the nodes."""

    def run(mine: pa.Table, nodes: pa.Table) -> pa.Table:
        at: dict[int, list[tuple]] = {}
        for fill, lo, n, off, seq in zip(*(nodes.column(c).to_pylist() for c in ("fill", "lo", "n", "off", "seq")), strict=True):
            at.setdefault(fill, []).append((lo, n, off, seq))
        for x in at.values():
            x.sort()
        starts = {fill: [x[0] for x in xs] for fill, xs in at.items()}
        out = []
        for child, fill, lo, n, off, to_fill, to_lo in zip(*(mine.column(c).to_pylist() for c in ("child", "fill", "lo", "n", "off", "to_fill", "to_lo")), strict=True):
            done = 0
            k = bisect_right(starts[to_fill], to_lo) - 1
            while done < n:
                their_lo, their_n, their_off, seq = at[to_fill][k]
                skip = to_lo + done - their_lo
                take = min(n - done, their_n - skip)
                out.append((child, fill, lo + done, take, off + their_off, seq + skip))
                done, k = done + take, k + 1
        return as_table(out, PLACES)

    ended = moves.filter("seq IS NOT NULL").select(F.col("child").alias("node"), "fill", "lo", "n", "off", "seq")
    passed = moves.filter("seq IS NULL").groupBy("node").cogroup(above.groupBy("node")).applyInArrow(run, PLACES)
    return ended.union(passed)


def settled_rows(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The rows that went up, part by part, with their sequence_id and offset by the parts' PLACES."""
    columns = [*PIECES.replace(",", "").split()[::2], "sequence_id", "offset"]

    def run(part: pa.Table, known: pa.Table) -> pa.Table:
        if not part.num_rows:
            return part.select(columns)
        their = [known.column(c).to_numpy() for c in ("fill", "lo", "off", "seq")]
        order = np.lexsort((their[1], their[0]))
        fill, lo, off, seq = (x[order] for x in their)
        place = part.column("place").to_numpy()
        k = np.searchsorted((fill << 40) + lo, (part.column("fill").to_numpy() << 40) + place, "right") - 1
        part = part.set_column(part.schema.get_field_index("sequence_id"), "sequence_id", pa.array(seq[k] + place - lo[k]))
        return part.set_column(part.schema.get_field_index("offset"), "offset", pa.array(part.column("offset").to_numpy() + off[k])).select(columns)

    return rows.groupBy("part").cogroup(places.groupBy("node")).applyInArrow(run, PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """One row for each piece of each row of docs (doc_id, text) with its sequence_id and offset there.

    A null or empty text is the end token alone. Repeated rows and null ids are packed as rows of their own,
    other columns are left out, an empty table gives an empty result. Texts are tokenised whole. Of equal lengths
    any may come first.
    """
    parts = max(1, math.ceil(docs.select("doc_id").count() / PART_ROWS))
    rows = settled(pieces(docs, parts, size), "pieces")
    columns = [*PIECES.replace(",", "").split()[::2], "sequence_id", "offset"]
    full = rows.filter("part < 0").withColumn("offset", F.lit(0).cast("long")).select(columns)
    return full.union(tree_packed(rows.filter("part >= 0"), parts, size).select(columns))


def tree_packed(rows: DataFrame, parts: int, size: int = SIZE) -> DataFrame:
    """PIECES, sequence_id and offset of rows (PIECES, part, sequence_id) dealt into so many parts."""
    rows = settled(packed(rows, parts == 1, size), "packed")
    if parts == 1:
        return rows
    open_rows = rows.filter("fill IS NOT NULL")
    # a sequence's pieces share its place; the one at offset 0 stands for it
    counts = open_rows.filter("offset = 0").groupBy(F.col("part").alias("child"), "fill").agg(F.count("*").alias("n"))
    levels = []
    while parts > 1:
        parts = math.ceil(parts / FAN)
        moves = settled(merged(counts, len(levels) + 1, parts == 1, size), "moves")
        levels.append(moves)
        counts = moves.filter("seq IS NULL AND off = 0").groupBy(F.col("node").alias("child"), F.col("to_fill").alias("fill")).agg(F.sum("n").alias("n"))
    places = None
    for moves in reversed(levels):
        above = places if places is not None else moves.sparkSession.createDataFrame([], PLACES)
        places = settled(placed(moves, above), "places")
    return rows.filter("fill IS NULL").select(*PIECES.replace(",", "").split()[::2], "sequence_id", "offset").union(settled_rows(open_rows, places))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
