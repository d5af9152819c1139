"""Fourier transforms of signals of any length, of which no task holds more than a block.

A signal is rows (keys, n, at, re, im): stretches of its n numbers, those that are not given are zero. Short signals
are gathered to one row. A longer one of n = n1 n2 numbers is a matrix of n1 rows: its columns are transformed, a block of
columns a group, every number is turned by its twiddle factor, and the rows are transformed, a block of rows a group;
the blocks move between the two as pieces. A length without such factors becomes a convolution with a chirp, whose length is a
power of two; the chirp's own transform is made once for each length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.store import kept
from .chunks import AT, KEY, each, in_order
from .skew import met
from .spectra import ORDER, TINY, band_gain

#: Complex numbers of a block, at most. Signals of up to its square are transformed; without two such factors, of up to a quarter of that.
LIMIT = 1 << 18
PIECE = "at array<long>, re array<double>, im array<double>"


@lru_cache(4096)
def split(n: int, limit: int) -> tuple[int, int] | None:
    """Two factors of n, as equal as they can be and neither above limit; None if there are none."""
    for a in range(math.isqrt(n), max(1, -(-n // limit)) - 1, -1):
        if n % a == 0:
            return a, n // a
    return None


def chirp(at: np.ndarray, n: int, inverse: bool) -> np.ndarray:
    """exp(-i pi at^2 / n), or its conjugate; squares are taken modulo 2n, so that no digits are lost."""
    turn = at % (2 * n)
    return np.exp((1j if inverse else -1j) * np.pi * ((turn * turn) % (2 * n)) / n)


def pieces(chunks: DataFrame) -> DataFrame:
    """The samples of chunks (i, v) as numbers by their place in the signal."""
    counts = chunks.select(*AT, F.size("v").cast("long").alias("c"))
    places = counts.select(*AT, (F.sum("c").over(in_order()) - F.col("c")).alias("first"), F.sum("c").over(Window.partitionBy(*KEY)).alias("n"))
    at = F.sequence("first", F.col("first") + F.size("v") - 1)
    return chunks.select(*AT, "v").join(places, list(AT)).select(*KEY, "n", at.alias("at"), F.col("v").alias("re"), F.array_repeat(F.lit(0.0), F.size("v")).alias("im"))


def listed(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    edges = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(parts) if parts else np.zeros(0), kind))


def as_rows(head: list[pa.Scalar], schema: pa.Schema, made: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    """Rows (head, block, at, re, im) of pieces (block, at, complex numbers)."""
    columns = [pa.array([h.as_py()] * len(made), schema.field(k).type) for k, h in enumerate(head)]
    columns.append(pa.array([b for b, _, _ in made], pa.int64()))
    columns += [listed([a.ravel() for _, a, _ in made], pa.int64()), listed([z.real.ravel() for _, _, z in made], pa.float64()), listed([z.imag.ravel() for _, _, z in made], pa.float64())]
    return pa.Table.from_arrays(columns, names=schema.names)


def numbers(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places and numbers of all pieces of a group."""
    at, re, im = (part.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("at", "re", "im"))
    return at, re + 1j * im


def scaled(rows: DataFrame, factor: Callable[[np.ndarray, int], np.ndarray], by: str, keep: tuple[str, ...]) -> DataFrame:
    """rows times factor(at, column by)."""

    def make(n: int, at: np.ndarray, re: np.ndarray, im: np.ndarray) -> tuple:
        z = (re + 1j * im) * factor(at, n)
        return at, z.real, z.imag

    return each(rows.withColumn("_by", F.col(by)), ["_by", "at", "re", "im"], make, PIECE, keep)


def transform(rows: DataFrame, inverse: bool = False, limit: int = LIMIT, keys: tuple[str, ...] = KEY) -> DataFrame:
    """The transforms (keys, n, block, at, re, im; a row a block) of rows (keys, n, at, re, im); the inverse is over n."""
    split_up = F.pandas_udf(lambda n: pd.Series([split(int(x), limit) is not None for x in n], dtype=bool), "boolean")
    rows = rows.select(*keys, "n", "at", "re", "im")
    short = whole_rows(rows.filter(F.col("n") <= limit), inverse, keys)
    long = rows.filter(F.col("n") > limit)
    if long.isEmpty():
        return short
    long = kept(long.withColumn("_two", split_up("n")), "long")
    out = short.unionByName(four_steps(long.filter("_two").drop("_two"), inverse, limit, keys))
    odd = long.filter("NOT _two").drop("_two")
    return out if odd.isEmpty() else out.unionByName(by_chirps(odd, inverse, limit, keys))


def whole_rows(rows: DataFrame, inverse: bool, keys: tuple[str, ...]) -> DataFrame:
    """Transforms of signals that are one block each."""
    one = rows.groupBy(*keys, "n").agg(F.collect_list(F.struct("at", "re", "im")).alias("p"))
    one = one.select(*keys, "n", F.col("n").alias("_n"), *(F.flatten(f"p.{c}").alias(c) for c in ("at", "re", "im")))

    def make(n: int, at: np.ndarray, re: np.ndarray, im: np.ndarray) -> tuple:
        x = np.zeros(n, complex)
        x[at] = re + 1j * im
        y = (np.fft.ifft if inverse else np.fft.fft)(x)
        return 0, np.arange(n), y.real, y.imag

    return each(one, ["_n", "at", "re", "im"], make, f"block long, {PIECE}", (*keys, "n"))


def four_steps(rows: DataFrame, inverse: bool, limit: int, keys: tuple[str, ...]) -> DataFrame:
    """Transforms of signals whose length has two factors within limit, by columns and by rows."""
    head = (*keys, "n")
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in head) + f", block long, {PIECE}"
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    fft, sign = (np.fft.ifft, 1) if inverse else (np.fft.fft, -1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each stretch by the block of columns its numbers lie in."""
        for batch in batches:
            for k in range(batch.num_rows):
                part = pa.Table.from_batches([batch.slice(k, 1)])
                at, z = numbers(part)
                n1, n2 = split(part.column("n")[0].as_py(), limit)
                block = at % n2 // max(1, limit // n1)
                order = np.argsort(block, kind="stable")
                found, first = np.unique(block[order], return_index=True)
                made = [(int(b), at[own], z[own]) for b, own in zip(found, np.split(order, first[1:]), strict=True)]
                yield from as_rows([part.column(c)[0] for c in head], arrow, made).to_batches()

    def columns(part: pa.Table) -> pa.Table:
        at, z = numbers(part)
        n, block = part.column("n")[0].as_py(), part.column("block")[0].as_py()
        n1, n2 = split(n, limit)
        lo = block * max(1, limit // n1)
        width = min(max(1, limit // n1), n2 - lo)
        x = np.zeros((n1, width), complex)
        x[at // n2, at % n2 - lo] = z
        i = lo + np.arange(width)
        y = fft(x, axis=0)
        made = []
        for k in range(0, n1, high := max(1, limit // n2)):
            own = np.arange(k, min(n1, k + high))[:, None]
            made.append((k // high, own * n2 + i, y[k : k + high] * np.exp(sign * 2j * np.pi * (own * i % n) / n)))
        return as_rows([part.column(c)[0] for c in head], arrow, made)

    def lines(part: pa.Table) -> pa.Table:
        at, z = numbers(part)
        n, block = part.column("n")[0].as_py(), part.column("block")[0].as_py()
        n1, n2 = split(n, limit)
        lo = block * max(1, limit // n2)
        x = np.zeros((min(max(1, limit // n2), n1 - lo), n2), complex)
        x[at // n2 - lo, at % n2] = z
        own = lo + np.arange(len(x))[:, None]
        return as_rows([part.column(c)[0] for c in head], arrow, [(block, own + n1 * np.arange(n2), fft(x, axis=1))])

    dealt = rows.select(*head, "at", "re", "im").mapInArrow(deal, schema)
    return dealt.groupBy(*head, "block").applyInArrow(columns, schema).groupBy(*head, "block").applyInArrow(lines, schema)


def by_chirps(rows: DataFrame, inverse: bool, limit: int, keys: tuple[str, ...]) -> DataFrame:
    """Transforms of signals of any length: at k^2 + j^2 - (k - j)^2 = 2jk, a product with a chirp, a convolution and a product."""

    def room(n: int) -> int:
        m = 1 << (2 * n - 2).bit_length()
        if split(m, limit) is None:
            raise ValueError(f"a signal of {n} numbers is too long for blocks of {limit}")
        return m

    longer = F.pandas_udf(lambda n: pd.Series([room(int(x)) for x in n], dtype="int64"), "long")
    own = (*keys, "length")
    turned = scaled(rows, lambda at, n: chirp(at, n, inverse), "n", (*keys, "n")).withColumnRenamed("n", "length").withColumn("n", longer("length"))
    a = kept(transform(turned, False, limit, own), "turned")

    def around_zero(m: int, n: int, first: int) -> tuple:
        at = np.arange(first, min(n, first + limit))
        z = np.conj(chirp(at, n, inverse))
        back = at[at > 0]
        at, z = np.append(at, m - back), np.append(z, np.conj(chirp(back, n, inverse)))
        return at, z.real, z.imag

    lengths = rows.select(F.col("n").alias("length")).distinct().withColumn("n", longer("length"))
    starts = lengths.select("length", "n", F.col("n").alias("_m"), F.col("length").alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(limit).cast("long"))).alias("_first"))
    chirps = transform(each(starts, ["_m", "_n", "_first"], around_zero, PIECE, ("length", "n")), False, limit, ("length",))
    asked = a.groupBy("length", "n", "block").agg(F.count("*").alias("w"))
    known = kept(chirps.join(asked, ["length", "n", "block"]).select("length", "n", "block", F.col("at").alias("_at"), F.col("re").alias("_re"), F.col("im").alias("_im"), "w"), "chirps")
    both = met(a, known, ["length", "n", "block"], "w", keys[0])

    def product(at: np.ndarray, re: np.ndarray, im: np.ndarray, _at: np.ndarray, _re: np.ndarray, _im: np.ndarray) -> tuple:
        z = (re + 1j * im) * (_re + 1j * _im)  # one block of one length is in one order
        return at, z.real, z.imag

    folded = transform(each(both, ["at", "re", "im", "_at", "_re", "_im"], product, PIECE, (*own, "n")), True, limit, own)

    def ended(n: int, at: np.ndarray, re: np.ndarray, im: np.ndarray) -> tuple:
        own = at < n
        z = (re[own] + 1j * im[own]) * chirp(at[own], n, inverse) / (n if inverse else 1)
        return at[own], z.real, z.imag

    out = each(folded.drop("n").withColumnRenamed("length", "n").withColumn("_n", F.col("n")), ["_n", "at", "re", "im"], ended, PIECE, (*keys, "n", "block"))
    return out.filter(F.size("at") > 0)


# --- what is asked of long signals


def spectrum_blocks(chunks: DataFrame, fs: float, limit: int = LIMIT) -> DataFrame:
    """Blocks (sweep, sensor, k, f, mag) of magnitudes, with the zero bin and without the Nyquist bin, not scaled."""

    def make(n: int, at: np.ndarray, re: np.ndarray, im: np.ndarray) -> tuple:
        own = at < n // 2
        return at[own], at[own] * fs / n, np.hypot(re[own], im[own])

    found = transform(pieces(chunks), False, limit).withColumn("_n", F.col("n"))
    return each(found, ["_n", "at", "re", "im"], make, "k array<long>, f array<double>, mag array<double>", KEY)


def spectrum(chunks: DataFrame, fs: float, limit: int = LIMIT) -> DataFrame:
    """One row for each frequency bin (k, f, mag) of each signal."""
    rows = spectrum_blocks(chunks, fs, limit).select(*KEY, F.explode(F.arrays_zip("k", "f", "mag")).alias("x"))
    return rows.select(*KEY, F.col("x.k").cast("int").alias("k"), "x.f", "x.mag")


def filtered(chunks: DataFrame, gain: Callable[[np.ndarray, int], np.ndarray], limit: int = LIMIT) -> DataFrame:
    """Blocks (sweep, sensor, n, block, at, re, im) of the signals whose transforms are multiplied by gain(k, n)."""
    found = transform(pieces(chunks), False, limit)
    return transform(scaled(found, gain, "n", (*KEY, "n")), True, limit)


def bandpass(chunks: DataFrame, fs: float, lo: float, hi: float, order: int = ORDER, limit: int = LIMIT) -> DataFrame:
    """Blocks (sweep, sensor, i, v) of the signals limited to a band; i is the place in the signal."""
    gain = lambda k, n: band_gain(np.minimum(k, n - k) * fs / n, fs, lo, hi, order)
    return filtered(chunks, gain, limit).select(*KEY, F.col("at").alias("i"), F.col("re").alias("v"))


def analytic_gain(k: np.ndarray, n: int) -> np.ndarray:
    """2 for positive frequencies, 1 for zero and the Nyquist bin, 0 for negative ones."""
    return np.where(k == 0, 1.0, np.where(2 * k < n, 2.0, np.where(2 * k == n, 1.0, 0.0)))


def envelope(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Blocks (sweep, sensor, i, v) of the signals' envelopes, the sizes of their analytic signals; i is the place in the signal."""
    found = filtered(chunks, analytic_gain, limit)
    return each(found, ["at", "re", "im"], lambda at, re, im: (at, np.hypot(re, im)), "i array<long>, v array<double>", KEY)


def frequency_features(chunks: DataFrame, fs: float, limit: int = LIMIT) -> DataFrame:
    """Fourteen statistics of each signal's spectrum, all zero for a silent one: sums over blocks, then sums about the centre they give."""
    blocks = kept(spectrum_blocks(chunks, fs, limit), "spectrum")

    def first(f: np.ndarray, mag: np.ndarray) -> tuple:
        at = int(np.argmax(mag)) if len(mag) else None
        positive = mag[mag > 0]
        top = (float(mag[at]), -float(f[at])) if len(mag) else (None, None)
        return len(mag), float(mag.sum()), float(f @ mag), float(f**2 @ mag), float(f**4 @ mag), float(np.log(positive).sum()), len(positive), float(f.sum()), *top

    names = "k total moment f2 f4 logs positive fs top low".split()
    fields = "k long, total double, moment double, f2 double, f4 double, logs double, positive long, fs double, top double, low double"
    c = F.col
    sums = each(blocks, ["f", "mag"], first, fields, KEY).groupBy(*KEY).agg(*(F.sum(x).alias(x) for x in names[:8]), F.max(F.struct("top", "low")).alias("top"))
    sums = sums.withColumn("fc", F.when(c("total") >= TINY, c("moment") / c("total")).otherwise(0.0)).withColumn("mean", F.when(c("k") > 0, c("total") / c("k")).otherwise(0.0))
    sums = kept(sums, "sums")

    def about(f: np.ndarray, mag: np.ndarray, fc: float, mean: float) -> tuple:
        d = f - fc
        return float(d**3 @ mag), float(d**4 @ mag), float(d @ d), float(np.sqrt(np.abs(d)) @ mag), float(((mag - mean) ** 2).sum())

    more = each(blocks.join(sums.select(*KEY, "fc", "mean"), list(KEY)), ["f", "mag", "fc", "mean"], about, "m3 double, m4 double, dd double, hm double, vv double", KEY)
    a = sums.join(more.groupBy(*KEY).agg(*(F.sum(x).alias(x) for x in ("m3", "m4", "dd", "hm", "vv"))), list(KEY))
    sd, fw = F.sqrt(c("vv") / c("k")), F.sqrt(c("dd") / c("k"))
    ratio = lambda top, by, least=0.0: F.when(by > least, top / by).otherwise(0.0)
    found = {
        "dominant_frequency": -c("top.low"), "spectral_mean": c("mean"), "spectral_std": sd, "center_frequency": c("fc"), "spectral_skewness": ratio(c("m3"), sd**3 * c("total"), TINY),
        "spectral_kurtosis": ratio(c("m4"), sd**4 * c("total"), TINY), "rms_frequency": F.sqrt(c("f2") / c("total")), "spectral_flatness": F.exp(c("logs") / c("positive")) / c("mean"), "frequency_weighted_std": fw,
        "peak_frequency": F.when(c("f2") > 0, F.sqrt(c("f4") / c("f2"))).otherwise(0.0), "normalized_frequency_std": ratio(fw, c("fc")), "frequency_skewness": ratio(c("m3"), c("k") * fw**3),
        "frequency_kurtosis": ratio(c("m4"), c("k") * fw**4), "normalized_bandwidth": ratio(c("hm"), c("k") * F.sqrt(fw)),
    }
    return a.select(*KEY, *(F.when(c("total") >= TINY, x).otherwise(0.0).alias(name) for name, x in found.items()))
