"""Responses of signals of any length to damped oscillations, by block convolution.

A chunk takes as many samples of its neighbours as a kernel is long (half on either side), and its correlation with a kernel is a product of
transforms: of the chunks once for all kernels, of a kernel once for all chunks that are worked on together. So a chunk costs
n log n a kernel, not n times the kernel's length. Chunks and kernels of one length are worked on together, as arrays. What leaves a chunk is
five moments a kernel, merged over the signal, or the result if the chunk is the signal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .chunks import AT, CHUNK, KEY, each, in_order, merged_moments, with_common
from .spectra import TINY, spread

#: Numbers of the chunks that are worked on together, at most (or one chunk), and of their transforms times kernels (or one).
TOGETHER, BANK = 1 << 20, 1 << 17


def kernel(f0: float, damping: float, fs: float, size: int) -> np.ndarray:
    """A damped oscillation of unit energy."""
    t = np.arange(size) / fs
    w = np.exp(-damping * t + 2j * np.pi * f0 * t)
    return w / np.sqrt((np.abs(w) ** 2).sum())


def kernel_size(damping: float, fs: float, decays: float) -> int:
    return max(2, int(decays / damping * fs))


def with_neighbours(chunks: DataFrame, left: int, right: int, size: int) -> DataFrame:
    """Chunks (i, v) of consecutive samples with the left samples before and the right samples after each, fewer at the ends, and the signal's number of samples n."""
    ends = each(chunks, ["v"], lambda v: (v[:right], v[max(0, len(v) - left) :], len(v)), "head array<double>, tail array<double>, c long")
    w = in_order()
    reach = lambda n: -(-n // size) + 1  # noqa: E731  the first and last chunk may be shorter
    before = F.flatten(F.collect_list("tail").over(w.rowsBetween(-reach(left), -1)))
    after = F.flatten(F.collect_list("head").over(w.rowsBetween(1, reach(right))))
    facts = ends.select(*AT, before.alias("before"), F.slice(after, 1, max(1, right)).alias("after"), F.sum("c").over(Window.partitionBy(*KEY)).alias("n"))
    last = F.when(F.size("before") > left, F.slice("before", -max(1, left), max(1, left))).otherwise(F.col("before"))
    return chunks.join(facts.withColumn("before", last), list(AT))


def response_moments(v: list[np.ndarray], before: list[np.ndarray], after: list[np.ndarray], n: list[int], fs: float, cells: list[tuple[float, float]], decays: float) -> np.ndarray:
    """Mean square, mean and sums of the second to fourth powers of what differs from it, of the sizes of the correlation at every chunk's samples: an array of these by chunk and cell."""
    longest = max(min(max(n), kernel_size(a, fs, decays)) for _, a in cells)
    left, right = longest // 2, longest - 1 - longest // 2
    m = 1 << int(max(map(len, v)) + longest - 2).bit_length()
    x = np.zeros((len(v), m))
    for k, (a, b, c) in enumerate(zip(before, v, after, strict=True)):
        a, c = a[max(0, len(a) - left) :], c[:right]
        x[k, left - len(a) : left + len(b) + len(c)] = np.concatenate((a, b, c))
    spectra = np.fft.fft(x)
    counts, lengths = np.array([len(y) for y in v]), np.maximum(n, 2)
    out = np.empty((5, len(v), len(cells)))
    order = sorted(range(len(cells)), key=lambda j: kernel_size(cells[j][1], fs, decays))  # kernels of one length together
    width = max(1, BANK // m)
    for start in range(0, len(cells), width):
        some = order[start : start + width]
        sizes = [kernel_size(cells[j][1], fs, decays) for j in some]
        kinds = np.stack((np.minimum(lengths, max(sizes)), counts), 1)  # kernels and samples of rows of a kind are alike
        for limit, count in np.unique(kinds, axis=0):
            bank = np.zeros((len(some), m), complex)
            for k, (j, size) in enumerate(zip(some, sizes, strict=True)):
                size = min(size, int(limit))
                bank[k, :size] = kernel(*cells[j], fs, size)
                bank[k] = np.roll(bank[k], -(size // 2))  # a kernel's middle stands at the sample
            bank = np.conj(np.fft.fft(bank))
            rows = np.flatnonzero((kinds == (limit, count)).all(1))
            step = max(1, BANK // (m * len(some)))
            for at in range(0, len(rows), step):
                r = rows[at : at + step]
                z = np.fft.ifft(spectra[r, None] * bank)[..., left : left + count]
                squares = z.real**2 + z.imag**2
                y = np.sqrt(squares)
                mean = y.mean(-1)
                d = y - mean[..., None]
                d2 = d * d
                for to, value in zip(out, (squares.sum(-1), mean, d2.sum(-1), (d2 * d).sum(-1), (d2 * d2).sum(-1)), strict=True):
                    to[np.ix_(r, some)] = value
    return out


def wavelet_map(chunks: DataFrame, fs: float, f0s: list[float], dampings: list[float], decays: float = 5.0, size: int = CHUNK) -> DataFrame:
    """For each signal and damped oscillation (frequency, damping) of unit energy: rms and kurtosis of the size of its correlation with the signal.

    chunks (i, v) are of consecutive samples, size at most. A kernel is decays over its damping long, or as long as the signal.
    """
    cells = [(f, a) for f in f0s for a in dampings]
    longest = max(kernel_size(a, fs, decays) for _, a in cells)
    rows = with_neighbours(chunks.select(*AT, "i", "v"), longest // 2, longest - 1 - longest // 2, size).select(*AT, "v", "before", "after", "n")
    head = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in AT)

    def made(some: DataFrame, names: list[str], figures: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> DataFrame:
        """The key of each chunk, its samples (n) and arrays with a figure a cell, made of the chunks' moments and numbers of samples."""
        schema = f"{head}, n long, {', '.join(f'{c} array<double>' for c in names)}"
        arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = batch.column("v").value_lengths().to_numpy() + 2 * longest
                together = max(1, TOGETHER // int(sizes.max(initial=1)))
                for start in range(0, batch.num_rows, together):
                    part = batch.slice(start, together)
                    v, before, after = ([x.values.to_numpy(zero_copy_only=False) for x in part.column(c)] for c in ("v", "before", "after"))
                    found = figures(response_moments(v, before, after, part.column("n").to_pylist(), fs, cells, decays), np.array([[len(x)] for x in v]))
                    ends = pa.array(np.arange(len(v) + 1) * len(cells), pa.int32())
                    arrays = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in found]
                    columns = [*(part.column(c) for c in AT), pa.array([len(x) for x in v], pa.int64()), *arrays]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        return spread(some, *AT).mapInArrow(run, schema)

    def whole(x: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        variance = x[2] / n
        return [np.sqrt(x[0] / n), np.where(variance > TINY, x[4] / n / np.where(variance > TINY, variance, 1.0) ** 2, 0.0)]

    alone = F.col("n") == F.size("v")  # chunks that are whole signals have their figures at once; others are merged
    single = made(rows.filter(alone), ["rms", "kurtosis"], whole).select(*KEY, F.posexplode(F.arrays_zip("rms", "kurtosis")).alias("cell", "x")).select(*KEY, "cell", "x.rms", "x.kurtosis")
    names = ["squares", "mean", "m2", "m3", "m4"]
    each_cell = made(rows.filter(~alone), names, lambda x, n: list(x)).select(*KEY, "n", F.posexplode(F.arrays_zip(*names)).alias("cell", "x")).select(*KEY, "n", "cell", "x.*")
    by = with_common(each_cell, by=(*KEY, "cell")).groupBy(*KEY, "cell").agg(F.sum("squares").alias("squares"), *merged_moments())
    variance = F.col("m2") / F.col("n")
    kurtosis = F.when(variance > TINY, F.col("m4") / F.col("n") / variance**2).otherwise(0.0)
    merged = by.select(*KEY, "cell", F.sqrt(F.col("squares") / F.col("n")).alias("rms"), kurtosis.alias("kurtosis"))
    frequency, damping = (F.get(F.array(*(F.lit(float(x)) for x in xs)), at) for xs, at in ((f0s, F.floor(F.col("cell") / len(dampings)).cast("int")), (dampings, F.col("cell") % len(dampings))))
    return single.union(merged).select(*KEY, frequency.alias("frequency"), damping.alias("damping"), "rms", "kurtosis")
