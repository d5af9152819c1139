"""Queries for feature rows, band limits, densities and envelopes, with their SQL put together from pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks as K
from ..operators import conditions as O
from ..operators import extract as E
from ..operators import fourier as W
from ..operators import signals as S
from ..operators import spectra as X
from ..sources import fixtures as D
from .queries import CHAIN, REGIME, cleaned, cleaned_chunks, conditions
from .registry import query, rounded

BANDS: list[E.Band] = [(0.0, 100.0, "low"), (100.0, 300.0, "mid"), (300.0, 600.0, "high"), (600.0, 900.0, "above"), (450.0, 440.0, "rest")]
OWN = {"AE": BANDS[:3], "UL": BANDS[1:2]}
PREFILTER = {"AE": (0.0, 350.0)}

# --- SQL pieces; a source has rows (sweep, sensor, i, v)

#: The samples of the array signals.
SAMPLED = "sampled AS (SELECT sweep, sensor, unnest(range(0, len(voltage))) AS i, unnest(voltage) AS v FROM arrays)"


def transform_sql(source: str, out: str) -> str:
    """out (sweep, sensor, n, k, re, im): the one-sided transform."""
    return f"""{out}_n AS (SELECT *, count(*) OVER (PARTITION BY sweep, sensor) AS n FROM {source}),
{out} AS (SELECT sweep, sensor, n, k, sum(v * cos(2 * pi() * ((k * i) % n) / n)) AS re, -sum(v * sin(2 * pi() * ((k * i) % n) / n)) AS im
  FROM {out}_n, LATERAL (SELECT unnest(range(0, n // 2 + 1)) AS k) GROUP BY sweep, sensor, n, k)"""


def gains_sql(transform: str, out: str, bands: list[tuple[str | None, float | None, float | None, str]]) -> str:
    """out: the transform once for each band (sensor or None for all, limits or None for no limits, label) with its gain g."""
    rows = ", ".join(f"({'NULL' if s is None else repr(s)}, {'NULL' if lo is None else lo}::DOUBLE, {'NULL' if hi is None else hi}::DOUBLE, '{label}')" for s, lo, hi, label in bands)
    return f"""{out}_b(whose, lo, hi, band) AS (VALUES {rows}),
{out}_w AS (SELECT *, tan(pi() * least(k / n, 0.4999999)) AS w, tan(pi() * lo / 1000) AS wl, tan(pi() * least(hi / 500, 0.9999) / 2) AS wh FROM {transform} JOIN {out}_b ON whose IS NULL OR whose = sensor),
{out} AS (SELECT sweep, sensor, band, n, k, re, im, CASE WHEN lo IS NULL THEN 1 WHEN lo >= 500 THEN 0 WHEN lo <= 0 THEN 1 / (1 + power(w / wh, 10)) WHEN k = 0 THEN 0
    WHEN lo / 500 >= least(hi / 500, 0.9999) THEN 1 / (1 + power(wl / w, 10)) ELSE 1 / (1 + power((w * w - wl * wh) / (w * (wh - wl)), 10)) END AS g FROM {out}_w)"""


def limited_sql(gains: str, out: str) -> str:
    """out (sweep, sensor, band, i, v): the signals of the gains, transformed back."""
    return f"""{out} AS (SELECT sweep, sensor, band, i, sum((CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END) * g * (re * cos(2 * pi() * ((k * i) % n) / n) - im * sin(2 * pi() * ((k * i) % n) / n))) / any_value(n) AS v
  FROM {gains}, LATERAL (SELECT unnest(range(0, n)) AS i) GROUP BY sweep, sensor, band, i)"""


def time_sql(source: str, out: str) -> str:
    """out: the time statistics of (sweep, sensor, band)."""
    key = "sweep, sensor, band"
    return f"""{out}_1 AS (SELECT *, v - lag(v) OVER (PARTITION BY {key} ORDER BY i) AS d1 FROM {source}),
{out}_2 AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY {key} ORDER BY i) AS d2 FROM {out}_1),
{out}_3 AS (SELECT {key}, (max(v) - min(v)) / 2 AS peak, sqrt(avg(v * v)) AS rms, stddev_pop(v) AS std, var_pop(v) AS variance, avg(v) AS m, avg(abs(v)) AS a, avg(sqrt(abs(v))) AS r, var_pop(d1) AS v1, var_pop(d2) AS v2 FROM {out}_2 GROUP BY {key}),
{out}_4 AS (SELECT {key}, avg(power(v - m, 3)) AS m3, avg(power(v - m, 4)) AS m4 FROM {source} JOIN {out}_3 USING ({key}) GROUP BY {key}),
{out} AS (SELECT {key}, peak, rms, std, variance, CASE WHEN std < 1e-30 THEN 0 ELSE m3 / power(std, 3) END AS skewness, CASE WHEN std < 1e-30 THEN 0 ELSE m4 / power(std, 4) END AS kurtosis,
    CASE WHEN rms > 0 THEN peak / rms ELSE 0 END AS crest_factor, CASE WHEN a > 0 THEN rms / a ELSE 0 END AS shape_factor, CASE WHEN a > 0 THEN peak / a ELSE 0 END AS impulse_factor,
    CASE WHEN r > 0 THEN peak / (r * r) ELSE 0 END AS margin_factor, CASE WHEN variance > 0 THEN sqrt(v1 / variance) END AS mobility,
    CASE WHEN v1 > 0 AND variance > 0 THEN sqrt(v2 / v1) / sqrt(v1 / variance) END AS complexity FROM {out}_3 JOIN {out}_4 USING ({key}))"""


def frequency_sql(gains: str, out: str) -> str:
    """out: the frequency statistics of (sweep, sensor, band)."""
    key = "sweep, sensor, band"
    return f"""{out}_1 AS (SELECT {key}, k, k * 1000.0::DOUBLE / n AS f, sqrt(re * re + im * im) * g AS mag FROM {gains} WHERE k < n // 2),
{out}_2 AS (SELECT *, sum(mag) OVER p AS tot, CASE WHEN sum(mag) OVER p >= 1e-30 THEN sum(f * mag) OVER p / sum(mag) OVER p ELSE 0 END AS fc, count(*) OVER p AS kk FROM {out}_1 WINDOW p AS (PARTITION BY {key})),
{out}_3 AS (SELECT {key}, any_value(tot) AS tot, any_value(fc) AS fc, any_value(kk) AS kk, avg(mag) AS mean, stddev_pop(mag) AS sd, sum(power(f - fc, 3) * mag) AS m3, sum(power(f - fc, 4) * mag) AS m4, sum(f * f * mag) AS f2,
    sum(power(f, 4) * mag) AS f4, avg(ln(CASE WHEN mag > 0 THEN mag END)) AS lnm, sqrt(avg(power(f - fc, 2))) AS fw, sum(sqrt(abs(f - fc)) * mag) AS hm, arg_max(f, mag) AS top FROM {out}_2 GROUP BY {key}),
{out} AS (SELECT {key}, {', '.join(f'CASE WHEN tot >= 1e-30 THEN {value} ELSE 0 END AS {name}' for name, value in (
        ('dominant_frequency', 'top'), ('spectral_mean', 'mean'), ('spectral_std', 'sd'), ('center_frequency', 'fc'), ('spectral_skewness', 'CASE WHEN power(sd, 3) * tot > 1e-30 THEN m3 / (power(sd, 3) * tot) ELSE 0 END'),
        ('spectral_kurtosis', 'CASE WHEN power(sd, 4) * tot > 1e-30 THEN m4 / (power(sd, 4) * tot) ELSE 0 END'), ('rms_frequency', 'sqrt(f2 / tot)'), ('spectral_flatness', 'exp(lnm) / mean'), ('frequency_weighted_std', 'fw'),
        ('peak_frequency', 'CASE WHEN f2 > 0 THEN sqrt(f4 / f2) ELSE 0 END'), ('normalized_frequency_std', 'CASE WHEN fc > 0 THEN fw / fc ELSE 0 END'), ('frequency_skewness', 'CASE WHEN fw > 0 THEN m3 / (kk * power(fw, 3)) ELSE 0 END'),
        ('frequency_kurtosis', 'CASE WHEN fw > 0 THEN m4 / (kk * power(fw, 4)) ELSE 0 END'), ('normalized_bandwidth', 'CASE WHEN fw > 0 THEN hm / (kk * sqrt(fw)) ELSE 0 END')))} FROM {out}_3)"""


def welch_sql(source: str, out: str, nperseg: int) -> str:
    """out (sweep, sensor, n, k, psd): power densities of segments of nperseg samples or the whole signal, overlapping by half, by periodic Hann windows."""
    return f"""{out}_1 AS (SELECT *, least({nperseg}, count(*) OVER (PARTITION BY sweep, sensor)) AS n, count(*) OVER (PARTITION BY sweep, sensor) AS size FROM {source}),
{out}_2 AS (SELECT sweep, sensor, n, s, i - s AS j, v FROM {out}_1, LATERAL (SELECT unnest(range(0, size - n + 1, greatest(1, n - n // 2))) AS s) WHERE i >= s AND i < s + n),
{out}_3 AS (SELECT *, 0.5 - 0.5 * cos(2 * pi() * j / n) AS h, v - avg(v) OVER (PARTITION BY sweep, sensor, s) AS d FROM {out}_2),
{out}_4 AS (SELECT sweep, sensor, n, s, k, power(sum(h * d * cos(2 * pi() * ((k * j) % n) / n)), 2) + power(sum(h * d * sin(2 * pi() * ((k * j) % n) / n)), 2) AS p, sum(h * h) AS hh
  FROM {out}_3, LATERAL (SELECT unnest(range(0, n // 2 + 1)) AS k) GROUP BY sweep, sensor, n, s, k),
{out} AS (SELECT sweep, sensor, n, k, avg(p) / (1000.0 * any_value(hh)) * CASE WHEN k > 0 AND 2 * k < n + n % 2 THEN 2 ELSE 1 END AS psd FROM {out}_4 GROUP BY sweep, sensor, n, k)"""


def envelope_sql(source: str, transform: str, out: str) -> str:
    """out (sweep, sensor, i, v): the envelopes of a source with its transform."""
    return f"""{out} AS (SELECT sweep, sensor, i, sqrt(v * v + power(coalesce(q, 0), 2)) AS v FROM {source} LEFT JOIN (
    SELECT sweep, sensor, i, 2 * sum(re * sin(2 * pi() * ((k * i) % n) / n) + im * cos(2 * pi() * ((k * i) % n) / n)) / any_value(n) AS q FROM {transform}, LATERAL (SELECT unnest(range(0, n)) AS i) WHERE k > 0 AND 2 * k < n GROUP BY sweep, sensor, i)
  USING (sweep, sensor, i))"""


def rounded_sql(columns: list[str], digits: int) -> str:
    return ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in columns)


def significant(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Columns rounded to so many significant digits, for values of very different size; NaN as NULL."""

    def short(c: str):  # noqa: ANN202
        x = F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`"))
        scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
        return F.when(F.abs(x) < 1e-12, 0.0).otherwise(F.round(x * scale) / scale).alias(c)

    return df.select(*(short(c) if c in columns else F.col(f"`{c}`") for c in df.columns))


def significant_sql(columns: list[str], digits: int = 6) -> str:
    one = 'CASE WHEN abs("{c}") < 1e-12 THEN 0 ELSE round("{c}" * power(10.0, {d} - 1 - floor(log10(abs("{c}"))))) / power(10.0, {d} - 1 - floor(log10(abs("{c}")))) END AS "{c}"'
    return ", ".join(one.format(c=c, d=digits) for c in columns)


ALL = [*E.TIME, *E.FREQUENCY]
SIGNALS = f"{SAMPLED},\n{transform_sql('sampled', 'dft')}"
ENVELOPES = f"{SIGNALS},\n{envelope_sql('sampled', 'dft', 'env')}"

# --- features of bands


@query(
    f"WITH {transform_sql('cleaned', 'dft')},\n{gains_sql('dft', 'banded', [(None, lo, hi, label) for lo, hi, label in BANDS])},\n{limited_sql('banded', 'part')},\n{time_sql('part', 'tf')},\n{frequency_sql('banded', 'ff')}\n"
    f"SELECT sweep, sensor, band, {significant_sql(ALL, 5)} FROM tf JOIN ff USING (sweep, sensor, band)",
    CHAIN,
)
def band_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 26 statistics of each band: two usual ones, one capped at half the sampling rate, a silent one and a highpass."""
    return significant(E.band_features(X.to_arrays(cleaned(spark, sf_dir), D.FS), BANDS), ALL, 5)


WIDE = [*ALL, *(f"{label}__{c}" for _, _, label in BANDS[:3] for c in ALL)]


def wide_sql() -> str:
    bands = [(s, *limits, "all") for s, limits in PREFILTER.items()] + [("UL", None, None, "all")] + [(s, lo, hi, label) for s, each in OWN.items() for lo, hi, label in each]
    parts = ", ".join(f"max({c}) FILTER (band = '{band}') AS \"{c if band == 'all' else f'{band}__{c}'}\"" for band in ("all", *(b[2] for b in BANDS[:3])) for c in ALL)
    return (
        f"WITH {transform_sql('cleaned', 'dft')},\n{gains_sql('dft', 'banded', bands)},\n{limited_sql('banded', 'part')},\n{time_sql('part', 'tf')},\n{frequency_sql('banded', 'ff')},\n"
        f"wide AS (SELECT sweep, sensor, {parts} FROM tf JOIN ff USING (sweep, sensor, band) GROUP BY sweep, sensor)\n"
    )


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw signals to feature rows: checked and repaired, limited to the sensor's band, with its bands; map-only once the samples are arrays."""
    repaired = E.clean_arrays(X.to_arrays(D.samples(spark, sf_dir), D.FS))
    return E.extract_features(repaired, OWN, PREFILTER)


@query(f"{wide_sql()} SELECT sweep, sensor, {significant_sql(WIDE, 5)} FROM wide", CHAIN)
def feature_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return significant(wide(spark, sf_dir), WIDE, 5)


@query(f"{wide_sql()}, mid AS (SELECT sweep, sensor, {', '.join(f'mid__{c} AS {c}' for c in ALL)} FROM wide) SELECT sweep, sensor, {significant_sql(ALL, 5)} FROM mid", CHAIN)
def unprefix_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One band's statistics under their plain names."""
    return significant(E.unprefix_band(wide(spark, sf_dir), "mid"), ALL, 5)


@query(
    """SELECT c.sweep, c.sensor, coalesce(q.rejection_reason, CASE WHEN q.is_clipped THEN printf('clipping detected (%.1f%% at rail)', q.clipping_fraction * 100) WHEN q.is_saturated THEN printf('saturation detected (flat run = %d samples)', q.saturation_longest_run) END) AS rejection_reason,
  round(q.clipping_fraction, 6) AS clipping_fraction, q.n_nan_inf_replaced FROM checked c JOIN quality q USING (sweep, sensor)""",
    f"{CHAIN} exact_quality",
)
def sig_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning that rejects clipped and saturated signals, with the reasons."""
    q = E.clean_arrays(X.to_arrays(D.samples(spark, sf_dir), D.FS), E.Cleaning(reject_clipped=True, reject_saturated=True, spikes=None))
    return rounded(q.select("sweep", "sensor", "rejection_reason", "clipping_fraction", "n_nan_inf_replaced"))


def energy(df: DataFrame) -> DataFrame:
    """Number, rms and first value of each signal."""
    square = F.aggregate("voltage", F.lit(0.0), lambda a, x: a + x * x)
    return rounded(df.select("sweep", "sensor", F.size("voltage").cast("long").alias("n"), F.sqrt(square / F.size("voltage")).alias("rms"), F.col("voltage")[0].alias("first_v")))


ENERGY = "SELECT sweep, sensor, count(*) AS n, round(sqrt(avg(v * v)), 6) AS rms, round(arg_min(v, i), 6) AS first_v FROM {source} GROUP BY sweep, sensor"


@query(f"WITH {SIGNALS},\n{gains_sql('dft', 'banded', [(None, 100, 300, 'b')])},\n{limited_sql('banded', 'part')}\n{ENERGY.format(source='part')}", "arrays")
def bandpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return energy(X.bandpass(D.array_sweeps(spark, sf_dir), 100.0, 300.0))


@query(f"WITH {SIGNALS},\n{gains_sql('dft', 'banded', [('UL', 0, 200, 'b'), ('AE', None, None, 'b')])},\n{limited_sql('banded', 'part')}\n{ENERGY.format(source='part')}", "arrays")
def sensor_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sensor limited to its band, the other as it is."""
    return energy(E.sensor_prefilter(D.array_sweeps(spark, sf_dir), {"UL": (0.0, 200.0)}))


@query("SELECT s AS sensor, count(*) AS n_signals, count(DISTINCT b) AS n_bands FROM arrays JOIN (VALUES ('AE', 'low'), ('AE', 'mid'), ('AE', 'high'), ('UL', 'mid')) t(s, b) ON s = sensor GROUP BY s", "arrays")
def bands_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signal with the bands of its sensor, from the table of arguments."""
    bands = O.band_table(spark, OWN, PREFILTER, {"AE": (0.0, 450.0)}).filter("kind = 'band'")
    both = D.array_sweeps(spark, sf_dir).select("sweep", "sensor").join(F.broadcast(bands), "sensor")
    return both.groupBy("sensor").agg(F.count("*").alias("n_signals"), F.countDistinct("label").alias("n_bands"))


@query(f"WITH {transform_sql('cleaned', 'dft')},\n{gains_sql('dft', 'banded', [(None, 100, 300, 'b')])},\n{limited_sql('banded', 'part')} SELECT sweep, sensor, i, round(v, 6) AS v FROM part", CHAIN)
def sample_bandpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of signals of any length limited to a band, from block transforms."""
    return rounded(K.to_samples(W.bandpass(cleaned_chunks(spark, sf_dir), D.FS, 100.0, 300.0), "v"))


@query(f"WITH {transform_sql('cleaned', 'dft')},\n{envelope_sql('cleaned', 'dft', 'env')} SELECT sweep, sensor, i, round(v, 6) AS v FROM env", CHAIN)
def sample_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of the envelopes of signals of any length, from block transforms."""
    return rounded(K.to_samples(W.envelope(cleaned_chunks(spark, sf_dir)), "v"))


# --- densities and envelopes


@query(f"WITH {SAMPLED},\n{welch_sql('sampled', 'w', 32)} SELECT sweep, sensor, CAST(k AS INTEGER) AS k, round(k * 1000.0::DOUBLE / n, 9) AS f, round(psd, 9) AS psd FROM w", "arrays")
def welch_psd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.welch_psd(D.array_sweeps(spark, sf_dir), 32), 9)


@query(f"WITH {SAMPLED},\n{welch_sql('sampled', 'w', 32)} SELECT sensor, count(*) AS n, round(max(k * 1000.0::DOUBLE / n), 6) AS top, round(avg(psd), 9) AS mean FROM w WHERE sensor <> 'UL' OR k * 1000.0 / n <= 200 GROUP BY sensor", "arrays")
def psd_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Densities up to each sensor's highest frequency."""
    rows = X.psd_rows(X.welch_psd(D.array_sweeps(spark, sf_dir), 32), {"UL": 200.0})
    return rounded(rows.groupBy("sensor").agg(F.count("*").alias("n"), F.max("f").alias("top"), F.avg("psd").alias("mean")), 9)


@query(f"WITH {SIGNALS} SELECT sweep, sensor, CAST(k AS INTEGER) AS k, round(k * 1000.0::DOUBLE / n, 6) AS f, round(sqrt(re * re + im * im) / n, 6) AS mag FROM dft WHERE k * 1000.0 / n BETWEEN 100 AND 400", "arrays")
def spectrum_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.amplitudes(D.array_sweeps(spark, sf_dir), 100.0, 400.0))


@query(f"WITH {ENVELOPES},\n{transform_sql('env', 'edft')} SELECT sweep, sensor, CAST(k AS INTEGER) AS k, round(k * 1000.0::DOUBLE / n, 6) AS f, round(CASE WHEN k = 0 THEN 0 ELSE sqrt(re * re + im * im) / n END, 6) AS mag FROM edft", "arrays")
def envelope_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.amplitudes(D.array_sweeps(spark, sf_dir), of_envelope=True))


@query(f"WITH {ENVELOPES} {ENERGY.format(source='env')}", "arrays")
def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return energy(X.envelope(D.array_sweeps(spark, sf_dir)))


@query(f"WITH {ENVELOPES} SELECT sweep, sensor, round(avg(v), 6) AS envelope_mean FROM env GROUP BY sweep, sensor", "arrays")
def envelope_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.envelope_mean(D.array_sweeps(spark, sf_dir)))


@query(f"WITH {ENVELOPES},\n{welch_sql('env', 'w', 256)} SELECT sweep, sensor, CAST(k AS INTEGER) AS k, round(k * 1000.0::DOUBLE / n, 9) AS f, round(psd, 9) AS psd FROM w", "arrays")
def envelope_psd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.envelope_psd(D.array_sweeps(spark, sf_dir)), 9)


@query(f"WITH {ENVELOPES},\n{welch_sql('env', 'w', 256)} SELECT sweep, sensor, round(exp(avg(ln(greatest(psd, 1e-30)))) / avg(greatest(psd, 1e-30)), 6) AS envelope_flatness FROM w GROUP BY sweep, sensor", "arrays")
def envelope_flatness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.flatness(X.envelope_psd(D.array_sweeps(spark, sf_dir))))


def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conditions(spark, sf_dir).select("sweep", O.kappa_regime(F.col("kappa")).alias("regime"))


BY_REGIME = f"SELECT sensor, {REGIME} AS regime, CAST(k AS INTEGER) AS k, round(k * 1000.0::DOUBLE / n, 6) AS f, count(*) AS n, round(avg(psd), 6) AS mean FROM w JOIN conditions USING (sweep) GROUP BY sensor, 2, k, w.n"


@query(f"WITH {welch_sql('cleaned', 'w', 32)} {BY_REGIME}", f"{CHAIN} meta conditions")
def psd_by_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean density at every bin, by sensor and regime; segments of one length give all signals the same bins."""
    psd = X.welch_psd(X.to_arrays(cleaned(spark, sf_dir), D.FS), 32)
    return rounded(X.mean_by_regime(psd.withColumn("f", F.round("f", 6)), regimes(spark, sf_dir), "psd", ["k", "f"]))


@query(f"WITH {ENVELOPES},\n{welch_sql('env', 'w', 256)} {BY_REGIME}", "arrays meta conditions")
def envelope_psd_by_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    psd = X.envelope_psd(D.array_sweeps(spark, sf_dir))
    return rounded(X.mean_by_regime(psd.withColumn("f", F.round("f", 6)), regimes(spark, sf_dir), "psd", ["k", "f"]))


@query(
    f"""WITH {transform_sql('cleaned', 'dft')},\n{envelope_sql('cleaned', 'dft', 'env')}, r AS (SELECT sweep, coalesce({REGIME}, 'unknown') AS regime FROM conditions),
s AS (SELECT regime, min(n) AS shortest FROM (SELECT sweep, sensor, count(*) AS n FROM env GROUP BY sweep, sensor) JOIN r USING (sweep) GROUP BY regime)
SELECT regime, CAST(i AS INTEGER) AS i, count(*) AS n, round(avg(v), 6) AS mean FROM env JOIN r USING (sweep) JOIN s USING (regime) WHERE i < shortest GROUP BY regime, i""",
    f"{CHAIN} meta conditions",
)
def envelope_by_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean envelope by regime, as long as the regime's shortest one."""
    regime = F.coalesce(O.kappa_regime(F.col("kappa")), F.lit("unknown")).alias("regime")
    env = X.envelope(X.to_arrays(cleaned(spark, sf_dir), D.FS)).join(conditions(spark, sf_dir).select("sweep", regime), "sweep")
    short = env.groupBy("regime").agg(F.min(F.size("voltage")).alias("shortest"))
    rows = env.join(F.broadcast(short), "regime").select("regime", F.posexplode(F.slice("voltage", F.lit(1), F.col("shortest"))).alias("i", "v"))
    return rounded(rows.groupBy("regime", "i").agg(F.count("*").alias("n"), F.avg("v").alias("mean")))


# --- tables about signals


@query(
    """SELECT q.sweep, q.sensor, round(CASE WHEN isnan(c.rpm) THEN NULL ELSE c.rpm END, 6) AS rpm, c.viscosity_40c_cst, 38.0::DOUBLE AS pitch_mm, q.is_clipped AS sig_clipped, round(q.clipping_fraction, 6) AS sig_clipping_frac, q.n_nan_inf_replaced AS sig_nan_inf_replaced
FROM quality q JOIN conditions c USING (sweep)""",
    f"{CHAIN} exact_quality meta conditions",
)
def assemble_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of the sweep, its file's lubricant and bearing, and the signal's quality, joined by key."""
    c = conditions(spark, sf_dir).withColumn("file", F.lit("f"))
    quality = S.clean(D.samples(spark, sf_dir))[1].select(
        F.lit("f").alias("file"), "sweep", "sensor", F.col("is_clipped").alias("sig_clipped"), F.col("clipping_fraction").alias("sig_clipping_frac"), F.col("n_nan_inf_replaced").alias("sig_nan_inf_replaced")
    )
    lubricant = spark.createDataFrame([("f", "oil")], "file string, lubricant string")
    bearing = spark.createDataFrame([("f", O.PITCH)], "file string, pitch_mm double")
    made = O.assemble_metadata(c.select("file", "sweep", "rpm", "viscosity_40c_cst"), lubricant, bearing, quality, ["file", "sweep"])
    return rounded(made.select("sweep", "sensor", "rpm", "viscosity_40c_cst", "pitch_mm", "sig_clipped", "sig_clipping_frac", "sig_nan_inf_replaced"))


@query("SELECT sensor, count(*) AS n, round(sum(price), 2) AS price, round(sum(tax), 4) AS tax FROM features GROUP BY sensor", "features")
def retain_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list given by hand goes before the selected one."""
    f = O.retain_columns(D.feature_table(spark, sf_dir), ["quantity"], ["price", "tax", "absent"])
    assert f.columns == ["file", "sweep", "sensor", "price", "tax"]
    return f.groupBy("sensor").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price"), F.round(F.sum("tax"), 4).alias("tax"))
