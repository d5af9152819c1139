"""Scoring texts with an n-gram model (n = 2) that the corpus itself trains, kept as an Elias-Fano trie.

Documents are tokenised in chunks. A chunk sends its distinct words and bigrams, with its training counts, to
shards by hash, packed one row to a shard. A shard adds up the counts of the training documents and builds the trie of
the bigrams seen in them. Each chunk's bigrams are then looked up in the trie; the answers and the tries' bytes are
written to the shared folder. Chunks then score their documents. A word or bigram reaches its shard once from each
chunk however frequent it is, and no task or driver holds the model: it is as large as the corpus makes it and lies
spread over the shards.

The levels hold the quantised probabilities of pairs. A pair's first word's and second word's own probabilities lie in
other shards, so a chunk makes the smoothed conditional probability of the three as it scores:

P1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), and P(w | v) = (c(v w) + MU P1(w)) / (c(v) + MU): both sum to one over the
known words and one unknown word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Hashes, settled, table, words_of
from .elias_fano import BigramTrie, counts_of

MU = 400.0
#: Tokens of a chunk, and those of a shard, about.
CHUNK, SHARD = 2_500_000, 2_500_000
END = b"\n"  # no word
START_HASH, MIX = np.uint64(0x5851F42D4C957F2D), np.uint64(0x9E3779B97F4A7C15)
ZSTD = pa.Codec("zstd", 1)
DEALT = "chunk long, shard int, ids array<long>, held array<boolean>, sizes array<long>, tokens binary, words binary, counts binary, contexts binary, runs binary, seconds binary, pairs binary"
ANSWERED = "chunk long, shard int, ids array<long>, held array<boolean>, sizes array<long>, tokens binary, counts binary, codes binary, total long, distinct long, trie binary"


def packed(x: np.ndarray) -> bytes:
    """Bytes of x, the first bytes of all numbers first, compressed, after their length."""
    data = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() if len(x) else b""
    return len(x).to_bytes(8, "little") + (ZSTD.compress(data, asbytes=True) if data else b"")


def unpacked(data: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(ZSTD.decompress(data[8:], n * size, asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(flat.reshape(size, n).T).view(kind).ravel() if n else np.zeros(0, kind)


def local_bigrams(tokens: np.ndarray, sizes: np.ndarray, shard_of: np.ndarray, shards: int) -> tuple[np.ndarray, ...]:
    """Of a chunk: distinct bigrams as (context, word) in the order they are sent in, the shard of each, and each token's place in that order. Word number len(shard_of) is the start."""
    start = len(shard_of)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = start
    codes, at = np.unique(before.astype(np.uint64) * np.uint64(start + 1) + tokens.astype(np.uint64), return_inverse=True)
    context, word = (codes // np.uint64(start + 1)).astype(np.int64), (codes % np.uint64(start + 1)).astype(np.int64)
    # a context's children lie in up to a sixth of the shards: few for the many rare contexts, enough for one that makes up much of the corpus
    shard = (np.append(shard_of, 1)[context] + shard_of[word] % -(-shards // 6)) % shards
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return context[order], word[order], shard[order], place[at]


class Numbers(dict):
    """Words numbered in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def deal(docs: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        chunk = (task.partitionId() if task else 0) << 32
        known, hashes = Numbers(), Hashes()
        ids: list = []
        texts: list[np.ndarray] = []
        count = 0

        def rows() -> pa.RecordBatch:
            h = np.fromiter(map(hashes.__getitem__, known), np.uint64, len(known))
            order = np.argsort(h % np.uint64(shards), kind="stable")  # words are renumbered by shard
            number = np.empty(len(h), np.uint32)
            number[order] = np.arange(len(h), dtype=np.uint32)
            h = h[order]
            shard_of = (h % np.uint64(shards)).astype(np.int64)
            tokens, sizes = number[np.concatenate(texts)], np.array([len(t) for t in texts])
            held = [held_out(i) for i in ids]
            training = np.repeat(~np.array(held), sizes)
            counts = np.bincount(tokens[training], minlength=len(h)).astype(np.uint32)
            context, word, shard, place = local_bigrams(tokens, sizes, shard_of, shards)
            pairs = np.bincount(place[training], minlength=len(word)).astype(np.uint32)
            before = np.append(h, START_HASH)
            first = (before >> np.uint64(32)).astype(np.uint32)
            # the word's half of the key depends on the whole context, so two contexts with equal halves share no key
            second = (((before[context] * MIX + h[word]) * MIX) >> np.uint64(32)).astype(np.uint32)
            every = np.arange(shards + 1)
            w_edges, b_edges = np.searchsorted(shard_of, every), np.searchsorted(shard, every)
            out: dict[str, list] = {c: [] for c in DEALT.replace(",", "").split()[::2]}
            home = (chunk % (1 << 32) + (chunk >> 32) * 31) % shards  # this shard's row carries the chunk's documents
            for s, (a, b, c, d) in enumerate(zip(w_edges, w_edges[1:], b_edges, b_edges[1:])):
                if s != home and a == b and c == d:
                    continue
                turns = np.flatnonzero(np.append(True, context[c + 1 : d] != context[c : d - 1])) if d > c else np.zeros(0, np.int64)
                head = {"ids": ids, "held": held, "sizes": sizes.tolist(), "tokens": packed(tokens)} if s == home else {}
                row = {
                    "chunk": chunk, "shard": s, **head, "words": h[a:b].tobytes(), "counts": packed(counts[a:b]), "contexts": first[context[c:d][turns]].tobytes(),
                    "runs": packed(np.diff(np.append(turns, d - c)).astype(np.uint32)), "seconds": second[c:d].tobytes(), "pairs": packed(pairs[c:d]),
                }
                for k, values in out.items():
                    values.append(row.get(k))
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), *[pa.binary()] * 7]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text.as_py())
                words.append(END)
                ids.append(doc_id.as_py())
                texts.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
                count += len(words)
                if count >= CHUNK:
                    yield rows()
                    chunk, count, known, ids, texts = chunk + 1, 0, Numbers(), [], []
        if ids:
            yield rows()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, DEALT)


def trained(keys: list[np.ndarray], seen: list[np.ndarray]) -> bytes:
    """The trie of the keys seen in training, from each chunk's keys and counts."""
    of = np.concatenate([k[n > 0] for k, n in zip(keys, seen, strict=True)])
    distinct, place = np.unique(of, return_inverse=True)
    return BigramTrie.packed(distinct, np.bincount(place, np.concatenate([n[n > 0] for n in seen]), len(distinct)))


def answer(dealt: DataFrame) -> DataFrame:
    """A shard's answers to the chunks, with how many training tokens and distinct training words are the shard's own, and its trie; these are in the shard's first row."""

    def run(part: pa.Table) -> pa.Table:
        words = [np.frombuffer(w, np.uint64) for w in part.column("words").to_pylist()]
        _, at = np.unique(np.concatenate(words), return_inverse=True)
        counts = np.bincount(at, np.concatenate([unpacked(c, np.uint32) for c in part.column("counts").to_pylist()])).astype(np.uint64)
        keys = []
        for c, r, s in zip(*(part.column(n).to_pylist() for n in ("contexts", "runs", "seconds")), strict=True):
            context = np.repeat(np.frombuffer(c, np.uint32), unpacked(r, np.uint32)).astype(np.uint64)
            keys.append((context << np.uint64(32)) | np.frombuffer(s, np.uint32))
        seen = [unpacked(p, np.uint32) for p in part.column("pairs").to_pylist()]
        trie = trained(keys, seen)
        model = BigramTrie(trie)
        codes = [packed(model.find(k)) for k in keys]
        w_edges = np.append(0, np.cumsum([len(x) for x in words]))
        out = part.select(["chunk", "shard", "ids", "held", "sizes", "tokens"])
        out = out.append_column("counts", pa.array([packed(counts[at[a:b]]) for a, b in zip(w_edges, w_edges[1:])], pa.binary()))
        out = out.append_column("codes", pa.array(codes, pa.binary()))
        totals = [(int(counts.sum()), int((counts > 0).sum()))] + [(0, 0)] * (part.num_rows - 1)
        for k, name in enumerate(("total", "distinct")):
            out = out.append_column(name, pa.array([t[k] for t in totals], pa.int64()))
        return out.append_column("trie", pa.array([trie] + [None] * (part.num_rows - 1), pa.binary()))

    return dealt.groupBy("shard").applyInArrow(run, ANSWERED)


def scored(answers: DataFrame, total: int, distinct: int, shards: int, mu: float) -> DataFrame:
    scale = total + 0.5 * (distinct + 1)

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("shard")
        head = part.filter(pa.compute.is_valid(part.column("ids"))).to_pylist()[0]
        each = [unpacked(c, np.uint64) for c in part.column("counts").to_pylist()]
        counts = np.concatenate(each).astype(np.float64)
        shard_of = np.repeat(part.column("shard").to_numpy(), [len(x) for x in each]).astype(np.int64)
        codes = np.concatenate([unpacked(c, np.uint16) for c in part.column("codes").to_pylist()])
        tokens, sizes = unpacked(head["tokens"], np.uint32), np.array(head["sizes"])
        context, word, _, place = local_bigrams(tokens, sizes, shard_of, shards)
        p1 = (counts + 0.5) / scale
        ends = counts[tokens[np.cumsum(sizes) - 1][0]]  # of the end, so training documents
        p2 = np.log10((counts_of(codes) + mu * p1[word]) / (np.append(counts, ends)[context] + mu))
        starts = np.cumsum(sizes) - sizes
        sums = lambda x: np.add.reduceat(x, starts)
        return pa.table({
            "doc_id": pa.array(head["ids"], pa.int64()), "held_out": pa.array(head["held"], pa.bool_()), "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(sums((counts > 0)[tokens].astype(np.int64))),
            "train_tokens": pa.array([total] * len(sizes), pa.int64()), "base_score": pa.array(sums(np.log10(p1)[tokens])), "score": pa.array(sums(p2[place])),
        })

    return answers.groupBy("chunk").applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_texts(docs: DataFrame, mu: float = MU) -> DataFrame:
    """Token counts and log10 probabilities of each row of docs (doc_id, text).

    Trains on rows whose crc32 of doc_id (as text, null as the empty text) mod 5 is not 1. A null, empty or
    blank text is the end token alone. Repeated rows count and are scored each; other columns are left out; an
    empty table gives an empty result; without training rows every probability is that of an unknown word.
    """
    docs = docs.select("doc_id", "text")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(8, int(chars / 6 / SHARD) + 1)
    answers = settled(answer(deal(docs, shards)), "answers")
    sums = answers.agg(F.sum("total"), F.sum("distinct")).first()
    return scored(answers.drop("total", "distinct", "trie"), sums[0] or 0, sums[1] or 0, shards, mu)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
