"""Queries by name, each with its equivalent in DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fixtures import SQL as TABLES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, tables: str = "") -> Callable[[Query], Query]:
    """Registers a query under its function's name. tables names the common table expressions that sql starts with."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            start = ",\n".join(CTE[t] for t in tables.split())
            more = sql.lstrip()
            if start and more.startswith("WITH "):
                more = ",\n" + more[5:]
            ORACLES[f.__name__] = (f"WITH {start}\n" if start else "") + more
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show; NaN as NULL."""
    return df.select(*(F.round(F.when(~F.isnan(c), F.col(c)), digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


CTE = TABLES | {
    "valid": """checked AS (
  SELECT sweep, sensor, count(*) AS n, CASE WHEN count(*) < 64 THEN 'too short (' || count(*) || ' < 64)' WHEN count(*) FILTER (v = 0) = count(*) THEN 'all-zero signal'
    WHEN count(*) FILTER (isnan(v)) = count(*) THEN 'all-NaN signal' END AS rejection_reason
  FROM samples GROUP BY sweep, sensor)""",
    "filled": """g AS (SELECT sweep, sensor, i, CASE WHEN isnan(v) OR isinf(v) THEN NULL ELSE v END AS g FROM samples SEMI JOIN (FROM checked WHERE rejection_reason IS NULL) USING (sweep, sensor)),
near AS (SELECT *, last_value(g IGNORE NULLS) OVER a AS g0, last_value(CASE WHEN g IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i0,
    first_value(g IGNORE NULLS) OVER b AS g1, first_value(CASE WHEN g IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i1
  FROM g WINDOW a AS (PARTITION BY sweep, sensor ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY sweep, sensor ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT sweep, sensor, i, g IS NULL AS replaced,
    coalesce(g, CASE WHEN g0 IS NOT NULL AND g1 IS NOT NULL THEN g0 + (g1 - g0) * (i - i0) / (i1 - i0) END, g0, g1, 0.0) AS v FROM near)""",
    "cleaned": """z AS (SELECT *, avg(v) OVER p AS m, stddev_pop(v) OVER p AS s FROM filled WINDOW p AS (PARTITION BY sweep, sensor)),
marked AS (SELECT *, s >= 1e-30 AND abs(v - m) / s > 6 AS spike FROM z),
cleaned AS (SELECT sweep, sensor, i, replaced, spike, CASE WHEN spike THEN coalesce(median(v) FILTER (NOT spike) OVER w, m) ELSE v END AS v
  FROM marked WINDOW w AS (PARTITION BY sweep, sensor ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))""",
    "quality": """rails AS (SELECT sweep, sensor, quantile_cont(v, 0.001) AS lo, quantile_cont(v, 0.999) AS hi FROM filled GROUP BY sweep, sensor),
clip AS (SELECT sweep, sensor, avg(CASE WHEN v <= lo OR v >= hi THEN 1.0 ELSE 0.0 END) AS clipping_fraction FROM filled JOIN rails USING (sweep, sensor) GROUP BY sweep, sensor),
steps AS (SELECT *, coalesce(abs(v - lag(v) OVER (PARTITION BY sweep, sensor ORDER BY i)) < 1e-10, false) AS flat FROM filled),
islands AS (SELECT *, count(*) FILTER (NOT flat) OVER (PARTITION BY sweep, sensor ORDER BY i) AS island FROM steps),
runs AS (SELECT sweep, sensor, max(n) AS saturation_longest_run FROM (SELECT sweep, sensor, island, count(*) FILTER (flat) AS n FROM islands GROUP BY ALL) GROUP BY sweep, sensor),
counts AS (SELECT sweep, sensor, count(*) FILTER (replaced) AS n_nan_inf_replaced, count(*) FILTER (spike) AS n_outlier_samples_replaced FROM cleaned GROUP BY sweep, sensor),
quality AS (SELECT sweep, sensor, rejection_reason, coalesce(clipping_fraction, 0) AS clipping_fraction, coalesce(clipping_fraction >= 0.01, false) AS is_clipped,
    coalesce(saturation_longest_run, 0) AS saturation_longest_run, coalesce(saturation_longest_run >= 50, false) AS is_saturated, coalesce(n_nan_inf_replaced, 0) AS n_nan_inf_replaced,
    coalesce(n_outlier_samples_replaced, 0) AS n_outlier_samples_replaced, rejection_reason IS NULL AS is_valid
  FROM checked LEFT JOIN clip USING (sweep, sensor) LEFT JOIN runs USING (sweep, sensor) LEFT JOIN counts USING (sweep, sensor))""",
    "timed": """dd AS (SELECT *, v - lag(v) OVER (PARTITION BY sweep, sensor ORDER BY i) AS d1 FROM cleaned),
ddd AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY sweep, sensor ORDER BY i) AS d2 FROM dd),
mom AS (SELECT sweep, sensor, count(*) AS n, (max(v) - min(v)) / 2 AS peak, sqrt(avg(v * v)) AS rms, stddev_pop(v) AS std, var_pop(v) AS variance, avg(v) AS m, avg(abs(v)) AS a, avg(sqrt(abs(v))) AS r,
    var_pop(d1) AS v1, var_pop(d2) AS v2 FROM ddd GROUP BY sweep, sensor),
high AS (SELECT sweep, sensor, avg(power(v - m, 3)) AS m3, avg(power(v - m, 4)) AS m4 FROM cleaned JOIN mom USING (sweep, sensor) GROUP BY sweep, sensor),
timed AS (SELECT sweep, sensor, n, peak, rms, std, variance, CASE WHEN std < 1e-30 THEN 0 ELSE m3 / power(std, 3) END AS skewness, CASE WHEN std < 1e-30 THEN 0 ELSE m4 / power(std, 4) END AS kurtosis,
    CASE WHEN rms > 0 THEN peak / rms ELSE 0 END AS crest_factor, CASE WHEN a > 0 THEN rms / a ELSE 0 END AS shape_factor, CASE WHEN a > 0 THEN peak / a ELSE 0 END AS impulse_factor,
    CASE WHEN r > 0 THEN peak / (r * r) ELSE 0 END AS margin_factor, CASE WHEN variance > 0 THEN sqrt(v1 / variance) END AS mobility,
    CASE WHEN v1 > 0 AND variance > 0 THEN sqrt(v2 / v1) / sqrt(v1 / variance) END AS complexity FROM mom JOIN high USING (sweep, sensor))""",
    "conditions": """named AS (SELECT sweep, telem_rpm_meas AS rpm, telem_omron_pv_c AS temperature_c, viscosity_40c_cst IS NULL OR viscosity_100c_cst IS NULL AS viscosity_imputed,
    coalesce(viscosity_40c_cst, 22.0) AS viscosity_40c_cst, coalesce(viscosity_100c_cst, 4.1) AS viscosity_100c_cst FROM meta),
walther AS (SELECT *, log10(log10(viscosity_40c_cst + 0.7)) AS a1, log10(log10(viscosity_100c_cst + 0.7)) AS a2 FROM named),
conditions AS (SELECT sweep, rpm, temperature_c, viscosity_imputed, viscosity_40c_cst, viscosity_100c_cst,
    CASE WHEN isnan(rpm) THEN NULL ELSE (power(10.0, power(10.0, a1 + (a2 - a1) / (log10(373.15) - log10(313.15)) * (log10(temperature_c + 273.15) - log10(313.15)))) - 0.7)
      / (CASE WHEN rpm < 1000 THEN 45000 * power(rpm, -0.83) / sqrt(38.0) ELSE 4500 * power(rpm, -0.5) / sqrt(38.0) END) END AS kappa FROM walther)""",
    "spectrum": """nn AS (SELECT *, count(*) OVER (PARTITION BY sweep, sensor) AS n FROM cleaned),
bins AS (SELECT sweep, sensor, k, k * 1000.0 / n AS f, sqrt(power(sum(v * cos(2 * pi() * ((k * i) % n) / n)), 2) + power(sum(v * sin(2 * pi() * ((k * i) % n) / n)), 2)) AS mag
  FROM nn, LATERAL (SELECT unnest(range(0, n // 2)) AS k) GROUP BY sweep, sensor, k, n)""",
}

#: The same with rails as the queries have them, linear between neighbours: quantile_cont weighs both, and of two equal ones it can make a value just beside them.
RAILS = """ordered AS (SELECT sweep, sensor, v, row_number() OVER (PARTITION BY sweep, sensor ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY sweep, sensor) AS n FROM filled),
ends AS (SELECT sweep, sensor, low, high, max(v) FILTER (k = floor(low)) AS l0, max(v) FILTER (k = ceil(low)) AS l1, max(v) FILTER (k = floor(high)) AS h0, max(v) FILTER (k = ceil(high)) AS h1
  FROM (SELECT *, (1 - 0.999::DOUBLE) * (n - 1) AS low, 0.999::DOUBLE * (n - 1) AS high FROM ordered) GROUP BY sweep, sensor, low, high),
rails AS (SELECT sweep, sensor, l0 + (l1 - l0) * (low - floor(low)) AS lo, h0 + (h1 - h0) * (high - floor(high)) AS hi FROM ends),
clip AS (SELECT sweep, sensor, count(*) FILTER (v <= lo OR v >= hi) / count(*) AS clipping_fraction FROM filled JOIN rails USING (sweep, sensor) GROUP BY sweep, sensor),
"""
CTE["exact_quality"] = RAILS + CTE["quality"][CTE["quality"].index("steps AS") :]
