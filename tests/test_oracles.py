"""Every registered query of the sensor pipeline against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from vibrary.plans import extract_queries, more_queries  # noqa: F401
from vibrary.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
#: Without SQL; test_fits.py, test_neighbours.py and test_wavelets.py compare them with plain versions.
ELSEWHERE = set("elastic_net_cv poly_ridge_cv bayesian_ridge_cv nested_cv_scores gbt_cv gbt_tune fit_summary best_params permutation_importance shap_tree pca_project infogram wavelet_map mutual_info_neighbours mi_matrix_neighbours pair_tests".split())


def plain(value: object) -> object:
    if value is None or str(value) == "<NA>" or isinstance(value, float) and math.isnan(value):
        return None
    return str(value) if isinstance(value, str) else round(float(value), 6) + 0.0


def rows(df) -> list:  # noqa: ANN001
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


def test_every_query_has_sql_or_a_plain_version() -> None:
    assert set(QUERIES) - set(ORACLES) == ELSEWHERE


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name: str) -> None:  # noqa: ANN001
    got = QUERIES[name](spark, DATA).toPandas()
    con = duckdb.connect()
    for t in ("events", "embeddings", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
