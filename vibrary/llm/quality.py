"""Quality by weak supervision.

Rules vote good, vote bad or abstain on each document. How often each rule says what about good and about bad
documents is not known; expectation-maximisation estimates it from the counts of vote patterns over all
documents, of which there are three to the number of rules at most, so the driver holds a bounded table. The
posterior probability that a document is good replaces "must pass every rule".
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, let_go, map_batches, settled, table

WINDOW = 8
#: What is known of the rules before any text is seen: they are written so that they accuse about this share of good
#: documents, and that counts as much as STRENGTH times the documents' own votes. It keeps the classes from changing their sense.
FALSE_ALARM, STRENGTH = 0.002, 10.0
SYMBOLS = re.compile(r"[#*$%&|<>]")
WORDS = re.compile(WORD)
HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Measure, the value up to which a rule votes good, the value beyond which it votes bad; between them it abstains.
RULES = (
    ("symbols_per_word", 0.03, 0.15),
    ("dup_line_share", 0.02, 0.30),
    ("repeat_share", 0.05, 0.25),
    ("upper_share", 0.15, 0.50),
    ("exclaims_per_word", 0.05, 0.30),
    ("top_word_share", 0.15, 0.30),
    ("wordless_share", 0.05, 0.20),
    ("length_off", 1.00, 2.00),
)
#: Mean word lengths from LEAST to MOST are usual; length_off is by what factor the mean is outside, plus 1.
LEAST, MOST = 3.0, 12.0


def repeated_words(words: list[str]) -> int:
    """Words in windows of WINDOW words that occur at least twice. Windows are compared exactly: by ids of halves, thrice."""
    n = len(words)
    if n <= WINDOW:
        return 0
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) == n:
        return 0
    span = 1
    while span < WINDOW:
        ids = ids[:-span] * (int(ids.max()) + 1) + ids[span:]
        distinct, ids = np.unique(ids, return_inverse=True)
        if len(distinct) == len(ids):
            return 0
        span *= 2
    again = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def counts_of(text: str | None) -> tuple[dict[str, int], dict[str, float]]:
    """The base counts and the measures of the rules."""
    text = text or ""
    words = WORDS.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    seen: set[str] = set()
    lines = dups = 0
    for line in text.split("\n"):
        if HAS_WORD.search(line):
            lines += 1
            dups += line in seen
            seen.add(line)
    symbols, repeats = len(SYMBOLS.findall(text)), repeated_words(words)
    base = dict(zip(COUNTS, (n, chars, symbols, dups, repeats), strict=True))
    tally = Counter(words)
    mean = chars / n if n else 0.0
    ascii_text = text.encode("ascii", "ignore")
    upper = len(ascii_text) - len(ascii_text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(ascii_text) - len(ascii_text.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    measures = {
        "symbols_per_word": symbols / n if n else 9.0,
        "dup_line_share": dups / lines if lines else 0.0,
        "repeat_share": repeats / n if n else 0.0,
        "upper_share": upper / (upper + lower) if upper + lower else 0.0,
        "exclaims_per_word": text.count("!") / n if n else 0.0,
        "top_word_share": max(tally.values()) / n if n >= 40 else 0.2,
        "wordless_share": sum(c for w, c in tally.items() if not any(map(str.isalpha, w))) / n if n else 1.0,
        "length_off": 1 + max(0.0, LEAST - mean, (mean - MOST) / MOST * 4),
    }
    return base, measures


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and votes: a string of one character a rule (g good, b bad, - abstains)."""

    def make(rows: dict) -> dict:
        out: dict = {"doc_id": rows["doc_id"], **{c: [] for c in COUNTS}, "votes": []}
        for text in rows["text"]:
            base, measures = counts_of(text)
            for c in COUNTS:
                out[c].append(base[c])
            out["votes"].append(votes_of(measures))
        return out

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", votes string")


def posteriors(patterns: dict[str, int], rounds: int = 60) -> dict[str, float]:
    """Probability of good for each vote pattern, by expectation-maximisation over the patterns' counts.

    Each rule has its own vote frequencies for good and for bad documents, and rules are independent given
    that. Estimates are a posteriori: one pseudo-count a vote keeps frequencies from zero, and how often rules
    accuse good documents has the prior above. The start takes a document as bad if and only if a rule votes
    bad. Without documents there is nothing to estimate.
    """
    if not patterns:
        return {}
    keys = sorted(patterns)
    weight = np.array([patterns[k] for k in keys], float)
    votes = np.array([["gb-".index(v) for v in k] for k in keys])
    good = np.where((votes == 1).any(1), 0.02, 0.999)
    for _ in range(rounds):
        log = []
        for p in (good, 1 - good):
            w = weight * p
            score = np.full(len(keys), np.log((w.sum() + 1) / (weight.sum() + 2)))
            for j in range(votes.shape[1]):
                share = np.bincount(votes[:, j], w, 3) + 1
                # an abstention says nothing: frequencies are among votes
                prior = STRENGTH * weight.sum() if p is good else 0.0
                bad = (share[1] + prior * FALSE_ALARM) / (share[:2].sum() + prior)
                share = np.log([1 - bad, bad, 1.0])
                score += share[votes[:, j]]
            log.append(score)
        good = 1 / (1 + np.exp(np.clip(log[1] - log[0], -700, 700)))
    return dict(zip(keys, good.tolist(), strict=True))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def fitted(rows: DataFrame) -> dict[str, float]:
    """Probability of good by vote pattern, from the measured rows that pass the base rules."""
    return posteriors({r["votes"]: r["n"] for r in rows.filter(~base_failed()).groupBy("votes").agg(F.count("*").alias("n")).collect()})


def votes_of(measures: dict[str, float]) -> str:
    return "".join("g" if measures[m] <= good else "b" if measures[m] > bad else "-" for m, good, bad in RULES)


def good_rows(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score_quality keeps, with all columns. Texts are measured twice rather than moved: once for the vote patterns, once to filter."""
    known = fitted(measured(docs))
    at = docs.columns.index("text")

    def keep(text: str | None) -> bool:
        base, measures = counts_of(text)
        failed = base["n_words"] < 20 or 100 * base["n_repeat_words"] > 30 * base["n_words"]
        return not failed and known.get(votes_of(measures), 0.0) >= threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):  # few texts are held twice at once
                batch = whole.slice(start, 1000)
                yield batch.filter(pa.array([keep(t.as_py()) for t in batch.column(at)], pa.bool_()))
        let_go()

    return docs.mapInArrow(run, docs.schema)


def score_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Base counts, base_failed, p_good and kept for each row of docs (doc_id, text).

    A null or blank text has no words and fails the base rules. Repeated rows are judged each, null ids pass
    through, other columns are left out, an empty table gives an empty result. Vote patterns are counted
    over all rows that pass the base rules (those that fail are decided, and what ails them would blur what
    the rules say about the rest; their p_good is null unless the pattern occurs elsewhere); at most 3 ** len(RULES) patterns reach the driver.
    """
    rows = settled(measured(docs), "quality")
    failed = base_failed()
    p = fitted(rows)
    known = docs.sparkSession.createDataFrame(list(p.items()), "votes string, p_good double")
    return rows.join(F.broadcast(known), "votes", "left").select(
        "doc_id", *COUNTS, failed.alias("base_failed"), (~failed & (F.col("p_good") >= threshold)).alias("kept"), "p_good", "votes"
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"))
