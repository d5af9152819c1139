"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Weights are trained by follow-the-regularised-leader with an elastic-net penalty on a bounded sample of
labelled documents (SAMPLE rows, those with the smallest hashes); a temperature fitted on a fifth of the
sample makes the scores probabilities. Whole texts are turned into n-gram counts on executors, for training
and for prediction; the driver gets the sample's sparse counts only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, table

#: Labelled documents the classifier is fitted on, at most, and their n-gram counts in all, at most: both bound what reaches the driver.
SAMPLE, PAIRS = 3000, 8_000_000
BITS, ORDERS = 15, (1, 2, 3)
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.05, 1e-4, 3
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def code_points(text: str) -> np.ndarray:
    """Lower-case letters as code points; all else is a space."""
    if not _letters:
        _letters.append(np.array([0xD800 <= c < 0xE000 or not chr(c).isalpha() for c in range(1 << 16)]))
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(x) and x.max() >= 1 << 16:
        return np.array([c if chr(c).isalpha() else 32 for c in x], np.uint32)
    return np.where(_letters[0][x], np.uint32(32), x)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text's character n-grams, and how often each occurs."""
    x = code_points(text)
    counts = np.zeros(1 << BITS, np.int64)
    for n in ORDERS:
        if len(x) >= n:
            h = np.zeros(len(x) - n + 1, np.uint32) + np.uint32(n)
            for k in range(n):
                h = (h ^ x[k : len(x) - n + 1 + k]) * np.uint32(2654435761)
            counts += np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS)
    found = np.flatnonzero(counts)
    return found, counts[found]


class Classifier:
    """Weights by language, inverse document frequencies and a temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float = 1.0) -> None:
        self.langs, self.idf, self.weights, self.temperature = langs, idf, weights, temperature

    def features(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = counts * self.idf[found]
        return x / max(float(np.sqrt(x @ x)), 1e-12)

    def logits(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.features(found, counts) @ self.weights[found] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*ngram_counts(text)) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]]) -> Classifier:
    """FTRL-proximal over the rows in their order; every fifth row is left for the temperature."""
    langs = sorted({r[2] for r in rows})
    size, at = (1 << BITS) + 1, {x: i for i, x in enumerate(langs)}
    df = np.zeros(size - 1)
    for found, _, _ in rows:
        df[found] += 1
    model = Classifier(langs, np.log((1 + len(rows)) / (1 + df)) + 1, np.zeros((size, len(langs))))
    z, n = np.zeros((size, len(langs))), np.zeros((size, len(langs)))
    train, rest = [r for i, r in enumerate(rows) if i % 5], rows[::5]
    for _ in range(PASSES):
        for found, counts, lang in train:
            ids = np.append(found, size - 1)
            x = np.append(model.features(found, counts), 1.0)
            zi, ni = z[ids], n[ids]
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = softmax(x @ w)
            p[at[lang]] -= 1
            g = np.outer(x, p)
            z[ids] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[ids] += g * g
    model.weights = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    scores = [(model.logits(f, c), at[lang]) for f, c, lang in rest]
    loss = lambda t: -sum(np.log(max(softmax(s / t)[k], 1e-12)) for s, k in scores)
    model.temperature = min(np.geomspace(0.01, 5, 60), key=loss) if scores else 1.0
    return model


def remainder(doc_id: Column, m: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def train(docs: DataFrame, eligible: Column, size: int = SAMPLE) -> Classifier:
    """Fits on the size eligible rows of docs (doc_id, text, lang) that have the smallest hashes."""
    key = F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary")), "lang")
    labelled = docs.filter(eligible & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang", key.alias("_key"))
    keys = [r[0] for r in labelled.select("_key").orderBy("_key").limit(size).collect()]
    if not keys:
        return Classifier([], np.ones(1 << BITS), np.zeros(((1 << BITS) + 1, 0)))
    chosen = labelled.filter(F.col("_key") <= keys[-1]).dropDuplicates(["_key"])

    def make(rows: dict) -> dict:
        pairs = [ngram_counts(t) for t in rows["text"]]
        return {"_key": rows["_key"], "lang": rows["lang"], "found": [f.tolist() for f, _ in pairs], "counts": [c.tolist() for _, c in pairs]}

    sample = map_batches(chosen.select("_key", "text", "lang"), make, "_key long, lang string, found array<int>, counts array<int>")
    upto = F.sum(F.size("found")).over(Window.orderBy("_key"))  # over SAMPLE rows at most
    sample = sample.withColumn("_upto", upto).filter(F.col("_upto") <= PAIRS).drop("_upto").collect()
    sample.sort(key=lambda r: r["_key"])
    return fit([(np.array(r["found"], np.int64), np.array(r["counts"], np.float64), r["lang"]) for r in sample])


def identify(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, lang_pred and score of each row of docs.

    Null, empty and letterless texts are und with score 0, as is all if no language was learned. Texts are
    read whole. Repeated rows and null ids get rows of their own; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 ** BITS rows by the number of languages

    def make(rows: dict) -> dict:
        m = shared.value
        found = [m.predict(t) for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, remainder(F.col("doc_id"), 4) != 2)
    return identify(docs, model).select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
