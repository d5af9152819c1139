"""Periodic runs of words, found on harmonic grids and measured by a run-length grammar.

A run of period q that is at least four periods long holds four neighbours of the grid 0, q, 2q, ... with one word, and two
stretches of two periods each, a period apart, that are equal. So for every q the grid's words are compared, some words
of the stretches are probed, and what is left are candidates: few in most texts. The texts that have any get a
grammar by recompression (see grammar), and how far places i and i + q agree, on and back, gives the run through i exactly.
No suffix array or table of all pairs of places is made. Candidates inside a run that is known, whose period divides theirs, give
the same run again and are left out.

A text is one row and is worked on where it lies; texts are joined to slices of a bounded number of bytes, longer
ones are slices of their own. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let_go, table
from .grammar import Grammar

SHORTEST, TIMES = 6, 4
#: Bytes of text that are worked on at once, and candidates that are measured at once.
SLICE, TOGETHER = 1 << 21, 100_000
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
NOTHING = hashlib.sha256(b"").hexdigest()


class Numbers(dict):
    """Words numbered in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def picked(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a text whose id plants a repetition; None for the others."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one sequence, with numbers that occur once around and between them, and where each begins."""
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(lengths + 1) - lengths
    most = max((int(t.max()) for t in texts if len(t)), default=0) + 1
    out = np.empty(int(lengths.sum()) + len(texts) + 1, np.int64)
    out[np.append(begins - 1, len(out) - 1)] = most + np.arange(len(texts) + 1)
    for t, b in zip(texts, begins, strict=True):
        out[b : b + len(t)] = t
    return out, begins


def on_grid(words: np.ndarray, q: int, wanted: Callable[[np.ndarray, int], np.ndarray] | None = None) -> np.ndarray:
    """Multiples i of q with equal words at i, i + q, i + 2q and i + 3q, between which words that are probed equal those a period on; wanted says which of them matter."""
    grid = words[::q]
    same = np.flatnonzero(grid[1:] == grid[:-1])
    at = same[:-2][same[2:] == same[:-2] + 2] * q if len(same) > 2 else same[:0]
    if wanted is not None and len(at):
        at = at[wanted(at, q)]
    for t in {1, q // 2, q + 1, q + q // 3, 2 * q - 1} if q > 1 and len(at) else ():
        at = at[words[at + t] == words[at + t + q]]
    return at


def longest_first(texts: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """The order of texts by falling length, and, for each q from 1 on, how many of them are long enough for a run of period q."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    lengths = np.array([len(texts[k]) for k in order], np.int64)
    most = int(lengths[0]) // TIMES if len(lengths) and lengths[0] >= SHORTEST else 0
    enough = np.maximum(SHORTEST, TIMES * np.arange(1, most + 1))
    return order, np.searchsorted(-lengths, -enough, "right").tolist()


def with_candidates(texts: list[np.ndarray]) -> list[int]:
    """Numbers of the texts that have a candidate of any period."""
    order, room = longest_first(texts)
    words, begins = joined([texts[k] for k in order])
    ends = np.append(begins[1:] - 1, len(words) - 1)
    found = np.zeros(len(texts), bool)
    for q, n in enumerate(room, 1):
        if found[:n].all():  # those after it are shorter
            break
        at = on_grid(words[: ends[n - 1]], q)
        for k in np.unique(np.searchsorted(begins, at, "right") - 1).tolist():
            found[k] = True
            words[begins[k] : ends[k]] = -1 - np.arange(begins[k], ends[k])  # no more of this text
    return sorted(order[k] for k in np.flatnonzero(found))


def runs(texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """text, start, end and period of every run, by text, start and period."""
    order, room = longest_first(texts)
    words, begins = joined([texts[k] for k in order])
    ends = np.append(begins[1:] - 1, len(words) - 1)
    grammar = Grammar(words, len(texts))
    until, every = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)  # end and period of a known run through a place
    found: dict[tuple[int, int], int] = {}

    def unknown(at: np.ndarray, q: np.ndarray | int) -> np.ndarray:
        return (until[at] <= at + (TIMES - 1) * q) | (q % every[at] != 0)

    def measured(at: np.ndarray, q: np.ndarray) -> None:
        for k in range(0, len(at), TOGETHER):
            i, p = at[k : k + TOGETHER], q[k : k + TOGETHER]
            left = unknown(i, p)
            i, p = i[left], p[left]
            end = i + p + grammar.agree(i, i + p)
            start = i - grammar.agree(i - 1, i + p - 1, -1)
            long = end - start >= np.maximum(SHORTEST, TIMES * p)
            for s, e, own in sorted(set(zip(start[long].tolist(), end[long].tolist(), p[long].tolist()))):
                if found.setdefault((s, e), own) >= own:  # of the periods of one stretch the smallest is its own
                    found[s, e] = own
                    until[s:e], every[s:e] = e, own

    q = 1
    while q <= len(room):
        at: list[np.ndarray] = []
        of: list[np.ndarray] = []
        last, count = min(len(room), 2 * q - 1), 0
        while q <= last and count < TOGETHER:  # no period's multiple is among those taken together
            i = on_grid(words[: ends[room[q - 1] - 1]], q, unknown)
            if len(i):
                at.append(i)
                of.append(np.full(len(i), q))
                count += len(i)
            q += 1
        if count:
            i, p = np.concatenate(at), np.concatenate(of)
            if count > 1000:  # a few first: long runs then cover most of the others
                some = np.zeros(count, bool)
                some[:: max(1, count // 1000)] = True
                measured(i[some], p[some])
                i, p = i[~some], p[~some]
            measured(i, p)
    s, e, p = (np.array(x, np.int64) for x in zip(*((s, e, p) for (s, e), p in found.items()))) if found else (np.zeros(0, np.int64),) * 3
    k = np.searchsorted(begins, s, "right") - 1
    text = np.array(order, np.int64)[k] if len(k) else k
    s, e = (s - begins[k], e - begins[k]) if len(k) else (s, e)
    by = np.lexsort((p, s, text))
    return text[by], s[by], e[by], p[by]


def described(ids: list[int | None], texts: list[list[bytes]]) -> pa.RecordBatch:
    """A row of SCHEMA for each text, given as its words."""
    numbers = Numbers()
    coded = [np.fromiter(map(numbers.__getitem__, t), np.int64, len(t)) for t in texts]
    picks = [picked(i, len(t)) for i, t in zip(ids, texts, strict=True)]
    coded = [c if p is None else c[p] for c, p in zip(coded, picks, strict=True)]
    some = with_candidates(coded)
    text, start, end, period = runs([coded[k] for k in some]) if some else (np.zeros(0, np.int64),) * 4
    edges = np.searchsorted(text, np.arange(len(some) + 1))
    of = {k: slice(a, b) for k, a, b in zip(some, edges, edges[1:]) if b > a}
    rows = []
    for k, (doc_id, words) in enumerate(zip(ids, texts, strict=True)):
        pick = picks[k]
        if k not in of:
            left = words if pick is None else [words[i] for i in pick]
            rows.append((doc_id, 0, None, None, None, None, NOTHING, hashlib.sha256(b" ".join(left)).hexdigest()))
            continue
        s, e, p = start[of[k]], end[of[k]], period[of[k]]
        best = np.lexsort((p, s, s - e))[0]
        length = int(e[best] - s[best])
        said = "".join(f"{a},{b - a},{c}\n" for a, b, c in zip(s.tolist(), e.tolist(), p.tolist()))
        inside = np.cumsum(np.bincount(s + p, minlength=len(words) + 1) - np.bincount(e, minlength=len(words) + 1))[: len(words)]
        kept = np.flatnonzero(inside == 0)
        left = [words[i] for i in (kept if pick is None else pick[kept])]
        rows.append((doc_id, len(s), int(s[best]), length, int(p[best]), 1000 * length // int(p[best]), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest()))
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds, strict=True)], names=re.findall(r"(\w+) \w+", SCHEMA))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Number of runs, the longest one, and digests of all runs and of the text without repetitions for every row of docs (doc_id, text).

    A null, empty or blank text has no words, so no runs and the digests of nothing. A null doc_id counts as empty
    text where ids plant repetitions. Repeated rows get equal rows, other columns are left out, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[list[bytes]] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or b""
                ids.append(doc_id.as_py())
                texts.append(text.split())
                size += len(text) + 64
                if size >= SLICE:
                    yield described(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield described(ids, texts)
        let_go()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, SCHEMA)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"))
