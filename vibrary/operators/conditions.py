"""Operating conditions of sweeps: names, viscosities, the viscosity ratio and its regimes, filters."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Telemetry names of the canonical parameters, viscosities (cSt) of the usual lubricant, pitch diameter (mm).
ALIASES = {"rpm": "telem_rpm_meas", "temperature_c": "telem_omron_pv_c", "load_g": "telem_mass_g"}
VISCOSITY = {"viscosity_40c_cst": 22.0, "viscosity_100c_cst": 4.1}
PITCH = 38.0
REGIMES = ((None, 0.5, "boundary"), (0.5, 1.0, "mixed"), (1.0, None, "full film"))
COLD, HOT = math.log10(40.0 + 273.15), math.log10(100.0 + 273.15)


def number(c: Column | str) -> Column:
    """NaN as NULL: comparisons with it are then unknown, not true."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def normalize_params(meta: DataFrame) -> DataFrame:
    """Canonical names, filled from the telemetry column where the canonical one is absent or NULL."""
    for name, alias in ALIASES.items():
        have = [F.col(c) for c in (name, alias) if c in meta.columns]
        if have:
            meta = meta.withColumn(name, F.coalesce(*have))
    return meta.drop(*ALIASES.values())


def viscosity_fallback(meta: DataFrame) -> DataFrame:
    """Missing viscosities become the usual lubricant's; viscosity_imputed says where."""
    missing = reduce(lambda a, c: a | F.col(c).isNull(), VISCOSITY, F.lit(False))
    return meta.withColumn("viscosity_imputed", missing).withColumns({c: F.coalesce(c, F.lit(v)) for c, v in VISCOSITY.items()})


def min_viscosity(rpm: Column, pitch: float = PITCH) -> Column:
    """The viscosity a bearing needs at a speed; slow shafts follow another power."""
    return F.when(rpm < 1000, 45000 * F.pow(rpm, F.lit(-0.83)) / math.sqrt(pitch)).when(~F.isnan(rpm), 4500 * F.pow(rpm, F.lit(-0.5)) / math.sqrt(pitch))


def walther_viscosity(temp_c: Column, nu_40: Column, nu_100: Column) -> Column:
    """Kinematic viscosity at a temperature: a double logarithm is linear in the logarithm of absolute temperature."""
    at_40, at_100 = (F.log10(F.log10(nu + 0.7)) for nu in (nu_40, nu_100))
    slope = (at_100 - at_40) / (HOT - COLD)
    return F.pow(F.lit(10.0), F.pow(F.lit(10.0), at_40 + slope * (F.log10(temp_c + 273.15) - COLD))) - 0.7


def with_kappa(meta: DataFrame, pitch: float = PITCH) -> DataFrame:
    """Adds kappa, the viscosity over the one needed; NULL where the speed is NaN or missing."""
    nu = walther_viscosity(F.col("temperature_c"), F.col("viscosity_40c_cst"), F.col("viscosity_100c_cst"))
    return meta.withColumn("kappa", nu / min_viscosity(F.col("rpm"), pitch))


def conditions(meta: DataFrame) -> DataFrame:
    return with_kappa(viscosity_fallback(normalize_params(meta)))


def kappa_regime(kappa: Column) -> Column:
    """Name of the left-closed interval a kappa lies in; an unknown one, NaN included, lies in none."""
    kappa = number(kappa)
    out = F.when(kappa.isNull(), F.lit(None).cast("string"))
    for _, hi, label in REGIMES:
        out = out.otherwise(label) if hi is None else out.when(kappa < hi, label)
    return out


def filter_operating(df: DataFrame, rpm_max: float | None = None, rpm_min: float | None = None, temp_min: float | None = None, temp_max: float | None = None) -> DataFrame:
    """Speed below rpm_max and from rpm_min, temperature from temp_min to temp_max; a bound whose column is absent is ignored, NaN and NULL fail."""
    rpm, temp = number("rpm") if "rpm" in df.columns else None, number("temperature_c") if "temperature_c" in df.columns else None
    for column, bound, test in ((rpm, rpm_max, "__lt__"), (rpm, rpm_min, "__ge__"), (temp, temp_min, "__ge__"), (temp, temp_max, "__le__")):
        if column is not None and bound is not None:
            df = df.filter(getattr(column, test)(bound))
    return df


def filter_sweep_range(df: DataFrame, rpm_min: float, rpm_max: float) -> DataFrame:
    """Speed within both bounds; unlike filter_operating, an unknown speed stays."""
    rpm = number("rpm")
    return df.filter(F.coalesce((rpm >= rpm_min) & (rpm <= rpm_max), F.lit(True)))


def rpm_band(rpm: Column, width: float = 1000.0) -> Column:
    return F.floor(number(rpm) / width).cast("long")


def bands_fixed(df: DataFrame, f_min: float, f_max: float, width: float) -> DataFrame:
    """Each row of df once for each band of fixed width; the last band may go beyond f_max."""
    n = max(0, math.ceil((f_max + width - f_min) / width) - 1)
    bands = F.explode(F.array(*map(F.lit, range(n))).cast("array<int>")).alias("band")
    return df.select("*", bands).select("*", (f_min + F.col("band") * width).alias("lo"), (f_min + (F.col("band") + 1) * width).alias("hi"))


def fused(df: DataFrame, key: list[str], sensors: tuple[str, str], columns: list[str], keep: str | None = None) -> DataFrame:
    """One row for each key that both sensors have: their columns as {sensor}__{column}, and keep of the first. Rows meet by one aggregate on the key, no join."""
    pick = lambda s, c: F.max(F.when(F.col("sensor") == s, F.col(c)))
    there = [F.count_if(F.col("sensor") == s).alias(f"_n_{s}") for s in sensors]
    by = df.filter(F.col("sensor").isin(*sensors)).groupBy(*key).agg(*there, *(pick(s, c).alias(f"{s}__{c}") for s in sensors for c in columns), *([pick(sensors[0], keep).alias(keep)] if keep else []))
    return by.filter((F.col(f"_n_{sensors[0]}") > 0) & (F.col(f"_n_{sensors[1]}") > 0)).drop(*(f"_n_{s}" for s in sensors))


def fused_counts(df: DataFrame, key: list[str], sensors: tuple[str, str]) -> DataFrame:
    """How many keys each sensor has and how many are left when they are fused."""
    by = df.groupBy(*key).agg(*(F.max((F.col("sensor") == s).cast("int")).alias(s) for s in sensors))
    a, b = (F.col(s) == 1 for s in sensors)
    return by.agg(*(F.count_if(F.col(s) == 1).alias(f"n_{s}") for s in sensors), F.count_if(a & b).alias("n_both"))


def band_table(spark: SparkSession, bands: dict[str, list[tuple[float, float, str]]], prefilter: dict[str, tuple[float, float]] | None = None, limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """The bands of each sensor (sensor, kind, lo, hi, label) with the limits of its prefilter and of the sensor itself: a table of arguments, so small."""
    rows = [(s, "band", lo, hi, label) for s, each in bands.items() for lo, hi, label in each]
    rows += [(s, kind, lo, hi, kind) for kind, of in (("prefilter", prefilter), ("sensor", limits)) for s, (lo, hi) in (of or {}).items()]
    return spark.createDataFrame([(s, k, float(lo), float(hi), label) for s, k, lo, hi, label in rows], "sensor string, kind string, lo double, hi double, label string")


def assemble_metadata(sweeps: DataFrame, lubricant: DataFrame, bearing: DataFrame, quality: DataFrame, key: list[str]) -> DataFrame:
    """One row for each row of quality (file, sweep, sensor, ...): the sweep's attributes, the file's lubricant and bearing, the signal's quality. Of equal names the later wins."""
    out = quality.select(*key, "sensor")
    for part, on in ((sweeps, key), (lubricant, key[:1]), (bearing, key[:1]), (quality, [*key, "sensor"])):
        new = [c for c in part.columns if c not in on]
        out = out.drop(*(c for c in new if c in out.columns)).join(part, on, "left")
    return out


def retain_columns(df: DataFrame, selected: list[str], override: list[str] | None = None) -> DataFrame:
    """Key columns and the features of the override list if there is one, else the selected ones; those that df lacks are left out."""
    names = override or selected
    return df.select(*(c for c in ("file", "sweep", "sensor") if c in df.columns), *(c for c in names if c in df.columns))


def split_sensor(df: DataFrame, sensor: str, candidates: list[str]) -> DataFrame:
    """Rows of one sensor without the candidate columns that hold no number there (one aggregate decides)."""
    df = df.filter(F.col("sensor") == sensor)
    known = df.agg(*(F.count(number(c)).alias(c) for c in candidates)).first()
    return df.drop(*(c for c in candidates if not known[c]))


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.filter(reduce(lambda a, c: a & number(c).isNotNull(), columns, F.lit(True)))
