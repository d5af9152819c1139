"""Queries for the rest of the sensor pipeline: tables in and out, joins, regimes, redundancy, nested fits, comparisons."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import chunks as K
from ..operators import compare as C
from ..operators import conditions as O
from ..operators import models as M
from ..operators import neighbours as N
from ..operators import spectra as X
from ..operators import tables as T
from ..operators import trees as G
from ..operators import wavelets as V
from ..operators import wide as L
from ..operators.skew import numbered
from ..sources import fixtures as D
from ..sources import store
from ..sources import sweeps as R
from .queries import CHAIN, COLUMNS, FUSED, HOLDOUT, PEARSON, PREDICTIONS, RANKS, SCORES, array_features, cleaned, cleaned_chunks, conditions, predictions, residuals, scores
from .registry import query, rounded

INPUTS = ["quantity", "discount", "tax", "price"]

# --- tables in and out


@query("SELECT sweep, sensor, n, round(rms, 5) AS rms FROM timed", f"{CHAIN} timed")
def sink_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features written by sensor and read again."""
    path = store.scratch(spark, f"features-{uuid.uuid4().hex}")
    store.write_by_sensor(rounded(K.time_features(cleaned_chunks(spark, sf_dir)).select("sweep", "sensor", "n", "rms"), 5), path)
    return spark.read.parquet(path).select("sweep", "sensor", "n", "rms")


@query("SELECT sensor, sweep, round(sqrt(list_sum(list_transform(voltage, lambda x: x * x)) / len(voltage)), 6) + CASE WHEN sensor = 'UL' THEN 1 ELSE 0 END AS rms FROM arrays", "arrays")
def upsert_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written table in which the rows of one sensor are replaced by recomputed ones; the other's files stay as they are."""
    a = D.array_sweeps(spark, sf_dir)
    old = a.select("sensor", "sweep", F.round(F.sqrt(F.aggregate("voltage", F.lit(0.0), lambda s, x: s + x * x) / F.size("voltage")), 6).alias("rms"))
    path = store.scratch(spark, f"upsert-{uuid.uuid4().hex}")
    store.upsert_in_place(old, path, sort=["sweep"])
    store.upsert_in_place(old.filter("sensor = 'UL'").withColumn("rms", F.col("rms") + 1), path, sort=["sweep"])
    return store.read_in_place(spark, path).select("sensor", "sweep", "rms")


@query("SELECT sensor, sweep, round(sqrt(list_sum(list_transform(voltage, lambda x: x * x)) / len(voltage)), 6) + CASE WHEN sensor = 'UL' THEN 1 ELSE 0 END AS rms FROM arrays", "arrays")
def keep_other_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union form, for tables that are not files: rows of other sensors, and the recomputed ones."""
    a = D.array_sweeps(spark, sf_dir)
    old = a.select("sensor", "sweep", F.round(F.sqrt(F.aggregate("voltage", F.lit(0.0), lambda s, x: s + x * x) / F.size("voltage")), 6).alias("rms"))
    return store.upsert(old, old.filter("sensor = 'UL'").withColumn("rms", F.col("rms") + 1), "sensor")


@query("SELECT sensor, sweep, 1000.0::DOUBLE AS fs, CAST(len(voltage) AS BIGINT) AS n, 'sweep ' || sweep AS label, round(sqrt(list_sum(list_transform(voltage, lambda x: x * x)) / len(voltage)), 6) AS rms FROM arrays WHERE sensor = 'UL' AND sweep BETWEEN 10 AND 90", "arrays")
def sweep_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals written as sweep files, and some of them read by sensor and sweep; only their files are opened."""
    path = store.scratch(spark, f"sweeps-{uuid.uuid4().hex}")
    R.write_sweeps(D.array_sweeps(spark, sf_dir).withColumn("label", F.concat(F.lit("sweep "), "sweep")), path)
    some = R.read_sweeps(spark, path).filter((F.col("sensor") == "UL") & F.col("sweep").between(10, 90))
    rms = F.sqrt(F.aggregate("voltage", F.lit(0.0), lambda s, x: s + x * x) / F.size("voltage"))
    return rounded(some.select("sensor", "sweep", "fs", F.size("voltage").cast("long").alias("n"), F.col("attributes")["label"].alias("label"), rms.alias("rms")))


PAIR = "SELECT sensor, count(*) AS n, count(conditions.sweep) AS n_known, round(avg(rms), 6) AS mean_rms, round(avg(kappa), 6) AS mean_kappa FROM r LEFT JOIN conditions USING (sweep) GROUP BY sensor"


def pair_read(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """A written pair of features and metadata, read and joined."""
    features, meta = store.feature_pair(spark, folder)
    both = features.join(meta.select("sweep", F.col("sweep").alias("known"), "kappa"), "sweep", "left")
    return rounded(both.groupBy("sensor").agg(F.count("*").alias("n"), F.count("known").alias("n_known"), F.avg("rms").alias("mean_rms"), F.avg("kappa").alias("mean_kappa")))


@query(f"WITH {FUSED} {PAIR}", "arrays meta conditions")
def scan_feature_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and metadata written as a pair and read as one."""
    folder = store.scratch(spark, f"pair-{uuid.uuid4().hex}")
    store.write_tables({"features": array_features(spark, sf_dir), "metadata": conditions(spark, sf_dir)}, folder)
    return pair_read(spark, sf_dir, folder)


@query(f"WITH {FUSED} {PAIR}", "arrays meta conditions")
def sink_eda_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata with repeated sweeps, kept once each."""
    folder, c = store.scratch(spark, f"eda-{uuid.uuid4().hex}"), conditions(spark, sf_dir)
    store.write_eda_cache(array_features(spark, sf_dir), c.union(c), folder)
    return pair_read(spark, sf_dir, folder)


@query(f"WITH {SCORES} SELECT fold, model, round(rmse, 6) AS rmse FROM scores")
def sink_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores written as CSV and as JSON, a half of each read again."""
    folder, table = store.scratch(spark, f"tables-{uuid.uuid4().hex}"), rounded(scores(spark, sf_dir))
    for kind in ("csv", "json"):
        store.write_tables({"scores": table}, folder, kind)
    types = "fold long, model string, rmse double"
    columns = ["fold", "model", "rmse"]
    from_csv = spark.read.schema(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)).option("header", True).csv(f"{folder}/scores.csv").filter("model = 'A'")
    return from_csv.select(columns).union(spark.read.schema(types).json(f"{folder}/scores.json").filter("model = 'B'").select(columns))


@query(f"WITH {FUSED} SELECT sensor, count(*) AS n FROM r GROUP BY sensor", "arrays")
def scan_first_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several places that holds a table."""
    folder = store.scratch(spark, f"first-{uuid.uuid4().hex}")
    store.write_tables({"features": array_features(spark, sf_dir)}, folder)
    found = store.first_available(spark, [f"{folder}/nothing.parquet", f"{folder}/features.parquet", f"{sf_dir}/events.parquet"])
    return found.groupBy("sensor").agg(F.count("*").alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT user_id) AS n_users FROM events")
def discover_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files whose names match a pattern, read together."""
    return store.discover(spark, sf_dir, ["event*", "*vents"]).agg(F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_users"))


@query("SELECT sweep, any_value(voltage[1]) AS first_v, CAST(any_value(len(voltage)) AS INTEGER) AS n FROM arrays WHERE sensor = 'AE' AND sweep IN (1, 5, 9) GROUP BY sweep", "arrays")
def scan_sweeps_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.array_sweeps(spark, sf_dir).filter(F.col("sweep").isin(1, 5, 9) & (F.col("sensor") == "AE")).select("sweep", F.col("voltage")[0].alias("first_v"), F.size("voltage").alias("n"))


@query("SELECT sweep, sensor, len(list_slice(voltage, 1, 20)) AS n, round(list_sum(list_slice(voltage, 1, 20)), 6) AS total FROM arrays", "arrays")
def waveform_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.slice("voltage", 1, F.floor(F.col("fs") * 0.020).cast("int"))
    return rounded(D.array_sweeps(spark, sf_dir).select("sweep", "sensor", F.size(part).cast("long").alias("n"), F.aggregate(part, F.lit(0.0), lambda a, x: a + x).alias("total")))


@query("WITH o AS (SELECT sweep, kappa, row_number() OVER (ORDER BY kappa, sweep) - 1 AS r, count(*) OVER () AS n FROM conditions WHERE kappa IS NOT NULL) SELECT sweep, round(kappa, 6) AS kappa FROM o WHERE r IN (0, CAST(floor((n - 1) / 4) AS INT), CAST(floor((n - 1) / 2) AS INT), CAST(floor(3 * (n - 1) / 4) AS INT), n - 1)", "meta conditions")
def signal_select_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sweeps evenly spaced in the order of kappa; ranks are numbered range by range of kappa."""
    c = conditions(spark, sf_dir).filter("kappa IS NOT NULL").select("sweep", "kappa")
    n = c.count()
    ranked = numbered(c, [], "kappa", ["sweep"], "r")
    return rounded(ranked.filter(F.col("r").isin([k * (n - 1) // 4 for k in range(5)])).select("sweep", "kappa"))


# --- filters and joins


@query("SELECT sensor, count(*) AS n, round(sum(price), 3) AS price FROM features WHERE sensor = 'AE' GROUP BY sensor", "features")
def split_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.feature_table(spark, sf_dir).withColumn("ul_only", F.when(F.col("sensor") == "UL", F.col("price")))
    part = O.split_sensor(f, "AE", ["price", "ul_only"])
    assert "ul_only" not in part.columns
    return rounded(part.groupBy("sensor").agg(F.count("*").alias("n"), F.sum("price").alias("price")), 3)


@query("SELECT count(*) AS n FROM features WHERE sweep % 50 <> 0 AND discount > 0.02", "features")
def complete_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.feature_table(spark, sf_dir).withColumn("quantity", F.when(F.col("sweep") % 50 == 0, float("nan")).otherwise(F.col("quantity"))).withColumn("discount", F.when(F.col("discount") > 0.02, F.col("discount")))
    return O.complete_cases(f, ["quantity", "discount"]).agg(F.count("*").alias("n"))


@query("WITH b AS (SELECT unnest([{'s': 'AE', 'b': 'low', 'lo': 0, 'hi': 100}, {'s': 'AE', 'b': 'mid', 'lo': 100, 'hi': 300}, {'s': 'UL', 'b': 'low', 'lo': 0, 'hi': 100}], recursive := true)) SELECT sensor, b AS band, count(*) AS n FROM arrays JOIN b ON s = sensor GROUP BY 1, 2", "arrays")
def join_band_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sweep with its sensor's bands; the band table is an argument and broadcast."""
    bands = spark.createDataFrame([("AE", "low", 0.0, 100.0), ("AE", "mid", 100.0, 300.0), ("UL", "low", 0.0, 100.0)], "sensor string, band string, lo double, hi double")
    return D.array_sweeps(spark, sf_dir).join(F.broadcast(bands), "sensor").groupBy("sensor", "band").agg(F.count("*").alias("n"))


WEIGHTS = "w AS (SELECT l_returnflag AS model, 'brand' || (l_partkey % 40) AS feature, sum(l_quantity) AS importance FROM lineitem GROUP BY 1, 2)"


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.concat(F.lit("brand"), F.col("l_partkey") % 40).alias("feature")).agg(F.sum("l_quantity").alias("importance"))


@query(f"WITH {WEIGHTS} SELECT coalesce(a.feature, b.feature) AS feature, a.importance AS a, b.importance AS b FROM (FROM w WHERE model = 'A' AND importance > 400) a FULL JOIN (FROM w WHERE model = 'N' AND importance > 800) b ON a.feature = b.feature")
def join_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weights(spark, sf_dir)
    a = w.filter("model = 'A' AND importance > 400").select("feature", F.col("importance").alias("a"))
    b = w.filter("model = 'N' AND importance > 800").select("feature", F.col("importance").alias("b"))
    return a.join(b, "feature", "full_outer")


#: Least squares of the target on quantity and tax, and each row's attribution.
TWO = """m AS (SELECT avg(quantity) AS mq, avg(tax) AS mt, var_pop(quantity) AS vq, var_pop(tax) AS vt, covar_pop(quantity, tax) AS c, covar_pop(quantity, target) AS cq, covar_pop(tax, target) AS ct FROM features),
w AS (SELECT mq, mt, (vt * cq - c * ct) / (vq * vt - c * c) AS wq, (vq * ct - c * cq) / (vq * vt - c * c) AS wt FROM m),
shap AS (SELECT sensor, 'quantity' AS feature, wq * (quantity - mq) AS shap FROM features, w UNION ALL SELECT sensor, 'tax', wt * (tax - mt) FROM features, w)"""


def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sensor, feature and shap of each row and feature of a linear fit."""
    f, names = D.feature_table(spark, sf_dir), ["quantity", "tax"]
    w, _ = M.ridge(sum(M.gram(f, names, "target", []).values()), 0.0)
    long = M.shap_linear(f, names, w).select("sensor", *(F.col(f"shap_{c}").alias(c) for c in names))
    return long.unpivot(["sensor"], names, "feature", "shap")


@query(f"WITH {TWO}, i AS (SELECT sensor, feature, avg(abs(shap)) AS mean_abs FROM shap GROUP BY sensor, feature) SELECT sensor, round(sum(mean_abs), 6) AS contribution FROM i GROUP BY sensor", "features")
def sensor_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum over features of the mean size of their attribution, by sensor."""
    by = attributions(spark, sf_dir).groupBy("sensor", "feature").agg(F.avg(F.abs("shap")).alias("mean_abs"))
    return rounded(by.groupBy("sensor").agg(F.sum("mean_abs").alias("contribution")))


@query(f"WITH {TWO} SELECT feature, round(avg(abs(shap)), 6) AS mean_abs FROM shap GROUP BY feature", "features")
def mean_abs_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(attributions(spark, sf_dir).groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs")))


@query(f"WITH {TWO} SELECT feature, round(c, 6) AS coefficient, round(abs(c), 6) AS size, CAST(row_number() OVER (ORDER BY abs(c) DESC, feature) AS INTEGER) AS place FROM (SELECT 'quantity' AS feature, wq AS c FROM w UNION ALL SELECT 'tax', wt FROM w)", "features")
def feature_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed coefficients of a fit, by size."""
    names = ["quantity", "tax"]
    w, _ = M.ridge(sum(M.gram(D.feature_table(spark, sf_dir), names, "target", []).values()), 0.0)
    return rounded(M.feature_weights(spark, names, w))


@query(f"WITH {WEIGHTS} SELECT a.model AS model_a, b.model AS model_b, count(*) AS n FROM w a JOIN w b ON a.feature = b.feature AND a.model < b.model GROUP BY 1, 2")
def join_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weights(spark, sf_dir)
    a, b = (w.select("feature", F.col("model").alias(f"model_{x}")) for x in "ab")
    return a.join(b, "feature").filter("model_a < model_b").groupBy("model_a", "model_b").agg(F.count("*").alias("n"))


# --- neighbours


@query()
def mutual_info_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual information of each feature and the target by the distances to the fifth neighbour, over all rows."""
    return rounded(N.mutual_information(marked(spark, sf_dir), [(c, "target") for c in NAMES], ["row_file", "row"]))


@query()
def mi_matrix_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of every two features."""
    pairs = [(a, b) for k, a in enumerate(NAMES) for b in NAMES[k + 1 :]]
    return rounded(N.mutual_information(marked(spark, sf_dir), pairs, ["row_file", "row"]))


# --- maps


@query()
def infogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of the squared envelope's spectrum for a grid of centres and widths, against that of noise."""
    return rounded(X.infogram(X.to_arrays(cleaned(spark, sf_dir), D.FS), *X.usual_grid(D.FS)))


@query()
def wavelet_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and kurtosis of each signal's response to damped oscillations."""
    f0s, dampings = X.usual_grid(D.FS)
    return rounded(V.wavelet_map(K.from_arrays(D.array_sweeps(spark, sf_dir)), D.FS, f0s, dampings))


@query(
    """WITH g AS (SELECT l_linenumber AS y, CAST(l_quantity AS BIGINT) AS x, avg(l_extendedprice) AS z FROM lineitem GROUP BY 1, 2),
d AS (SELECT y, x, CASE WHEN lag(z) OVER h IS NULL THEN lead(z) OVER h - z WHEN lead(z) OVER h IS NULL THEN z - lag(z) OVER h ELSE (lead(z) OVER h - lag(z) OVER h) / 2 END AS dx,
  CASE WHEN lag(z) OVER v IS NULL THEN lead(z) OVER v - z WHEN lead(z) OVER v IS NULL THEN z - lag(z) OVER v ELSE (lead(z) OVER v - lag(z) OVER v) / 2 END AS dy FROM g WINDOW h AS (PARTITION BY y ORDER BY x), v AS (PARTITION BY x ORDER BY y))
SELECT y, x, round(sqrt(dx * dx + dy * dy), 4) AS gradient FROM d"""
)
def map_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.read(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("y"), F.col("l_quantity").cast("long").alias("x")).agg(F.avg("l_extendedprice").alias("z"))
    return rounded(X.map_gradient(g), 4)


# --- relevance


CLEAN = """r AS (SELECT *, 50.0::DOUBLE + sweep % 5000 AS rpm, CASE WHEN sweep % 50 = 0 THEN NULL ELSE quantity END AS q FROM features), a AS (SELECT * FROM r WHERE rpm < 4000), b AS (SELECT * FROM a WHERE q IS NOT NULL),
k AS (SELECT avg(price) AS m, stddev_samp(price) AS s, avg(q) AS mq, stddev_samp(q) AS sq, avg(tax) AS mt, stddev_samp(tax) AS st FROM b),
o AS (SELECT b.* FROM b, k WHERE NOT (abs(price - m) / s > 1.6 OR abs(q - mq) / sq > 1.6 OR abs(tax - mt) / st > 1.6))"""


def cleaned_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = D.feature_table(spark, sf_dir).withColumn("rpm", 50.0 + F.col("sweep") % 5000).withColumn("quantity", F.when(F.col("sweep") % 50 == 0, float("nan")).otherwise(F.col("quantity")))
    return T.clean_features(f, ["quantity", "tax", "flat", "price"], rpm_max=4000, outliers_by="zscore", threshold=1.6)


@query(
    f"WITH {CLEAN} SELECT 'input' AS step, count(*) AS n_rows, 4 AS n_features FROM r UNION ALL SELECT 'rpm', count(*), 4 FROM a UNION ALL SELECT 'nonfinite', count(*), 4 FROM b UNION ALL SELECT 'constant', count(*), 3 FROM b UNION ALL SELECT 'outliers', count(*), 3 FROM o",
    "features",
)
def clean_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and features left after each cleaning step."""
    return cleaned_table(spark, sf_dir)[1]


@query(f"WITH {CLEAN} SELECT sensor, count(*) AS n, round(sum(q), 4) AS quantity, round(sum(price), 2) AS price FROM o GROUP BY sensor", "features")
def cleaned_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned table itself."""
    f = cleaned_table(spark, sf_dir)[0]
    assert "flat" not in f.columns
    return f.groupBy("sensor").agg(F.count("*").alias("n"), F.round(F.sum("quantity"), 4).alias("quantity"), F.round(F.sum("price"), 2).alias("price"))


NAMES = ["quantity", "tax", "collinear", "price"]
RHOS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr(r_{a}, r_{b}) AS rho FROM ranks" for a in NAMES for b in NAMES)


@query(f"WITH {RANKS} SELECT a, b, round(rho, 6) AS rho FROM ({RHOS})", "features")
def spearman_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.spearman_matrix(marked(spark, sf_dir), NAMES, ["row_file", "row"]))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table with a number for each row, the same whenever it is read."""
    return D.feature_table(spark, sf_dir).select("*", F.col("_metadata.file_path").alias("row_file"), F.col("_metadata.row_index").alias("row"))


@query(f"WITH {RANKS}, p AS (SELECT a AS feature, count(*) FILTER (a <> b AND abs(rho) >= 0.9) AS partners FROM ({RHOS}) GROUP BY a) SELECT feature, feature <> 'price' AS high_vif, partners, feature <> 'price' AND partners > 0 AS redundant FROM p", "features")
def flag_redundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which features are inflated (three depend on each other exactly, the price on none), how many others each is close to, and which are both."""
    return T.redundancy(T.spearman_matrix(marked(spark, sf_dir), NAMES, ["row_file", "row"]), T.vif(D.feature_table(spark, sf_dir), NAMES)).drop("vif")


@query(
    f"""WITH {RANKS}, p AS ({RHOS}), w AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, abs(corr(r_{c}, r_target)) AS worth FROM ranks" for c in NAMES)}),
k AS (SELECT p.a, p.b FROM p JOIN w x ON x.feature = p.a JOIN w y ON y.feature = p.b WHERE p.a <> p.b AND abs(rho) >= 0.9 AND p.b <> 'price' AND (y.worth > x.worth OR y.worth = x.worth AND p.b = 'quantity'))
SELECT feature FROM w WHERE feature NOT IN (SELECT a FROM k)""",
    "features",
)
def reduce_redundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of close features: relevance and closeness are by rank."""
    f = D.feature_table(spark, sf_dir)
    pairs = {(r.a, r.b): r.rho for r in T.spearman_matrix(marked(spark, sf_dir), [*NAMES, "target"], ["row_file", "row"]).collect()}
    factors = {r.feature: r.vif for r in T.vif(f, NAMES).collect()}
    worth = {c: abs(pairs[c, "target"]) for c in NAMES}
    return spark.createDataFrame([(c,) for c in T.reduce_redundant(pairs, factors, worth, NAMES)], "feature string")


@query(f"SELECT feature, round(r, 6) AS r FROM (SELECT feature, r, row_number() OVER (ORDER BY abs(r) DESC, feature) AS k FROM ({PEARSON})) WHERE k <= 2", "features")
def topk_by_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = T.pearson_target(D.feature_table(spark, sf_dir), COLUMNS, "target")
    return rounded(r.withColumn("k", F.row_number().over(Window.orderBy(F.desc(F.abs("r")), "feature"))).filter("k <= 2").drop("k"))


@query()
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two principal components of the standardised inputs, with the sign of their first weight made positive."""
    z = VectorAssembler(inputCols=INPUTS, outputCol="z").transform(M.standardize(D.feature_table(spark, sf_dir), INPUTS, F.lit(True)))
    model = PCA(k=2, inputCol="z", outputCol="pc").fit(z)
    signs = np.sign(model.pc.toArray()[0])
    pc = vector_to_array("pc")
    share = [F.lit(float(x)).alias(f"explained{k + 1}") for k, x in enumerate(model.explainedVariance)]
    return rounded(model.transform(z).select("file", "sweep", (pc[0] * float(signs[0] or 1)).alias("pc1"), (pc[1] * float(signs[1] or 1)).alias("pc2"), *share))


# --- models


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.feature_table(spark, sf_dir).withColumn("fold", (F.col("file") % 5).cast("int"))


@query()
def poly_ridge_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold errors of ridge on products of the fold's five best inputs, its penalty chosen by leave-one-out on the other folds; the null fold has those of all rows and the final fit's penalty."""
    f, names, fits = M.poly_ridge_nested(folded(spark, sf_dir), INPUTS, "target", "fold")
    return rounded(M.fold_scores(M.out_of_fold(f, names, "fold", fits), "target", "fold", fits, ["alpha"]))


@query()
def bayesian_ridge_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence-tuned ridge: each row's prediction and deviation by the fit on the other folds, and by the final fit on all rows."""
    f = folded(spark, sf_dir)
    fits = M.bayesian_ridge_folds({k[0]: g for k, g in M.gram(f, INPUTS, "target", ["fold"]).items()})
    final = M.predict_interval(f, INPUTS, fits[None]).withColumnsRenamed({"yhat": "final_yhat", "std": "final_std"})
    return rounded(M.out_of_fold(final, INPUTS, "fold", fits, std="std").select("file", "sweep", "fold", "target", "yhat", "std", "final_yhat", "final_std"))


#: The sets of inputs that models are compared on.
SETS = {"load": ["quantity", "price"], "rates": ["discount", "tax"], "combined": INPUTS}


@query()
def nested_cv_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outer-fold errors, for each repeat and set of inputs, of elastic nets (a Gram pass a repeat) and of ridge on products (two passes a repeat and set); penalties are chosen within the other folds' rows."""
    table, out = D.feature_table(spark, sf_dir).select("file", "sweep", *INPUTS, "target"), []
    with store.passing(spark, "nested") as keep:
        inner = lambda r: F.pmod(F.xxhash64("file", "sweep", F.lit(r)), F.lit(5)).cast("int")
        f = M.with_folds(table, ["file", "sweep"], keep, repeats=5)
        f = keep(f.select(*INPUTS, "target", *(x for r in range(5) for x in (M.fold_of(r).alias(f"fold{r}"), inner(r).alias(f"inner{r}")))), "folds", "repeat4")  # a row once, with its folds of all repeats
        repeats = [f.select(*INPUTS, "target", F.col(f"fold{r}").alias("fold"), F.col(f"inner{r}").alias("inner")) for r in range(5)]
        grams = [M.gram(part, INPUTS, "target", ["fold", "inner"]) for part in repeats]
        for name, columns in SETS.items():
            at = [0, *(1 + INPUTS.index(c) for c in columns), len(INPUTS) + 1]
            for r, part in enumerate(repeats):
                own = {k: g[np.ix_(at, at)] for k, g in grams[r].items()}
                for held, fit in M.elastic_net_nested(own).items():
                    if held is not None:
                        g = sum(m for k, m in own.items() if k[0] == held)
                        out.append(("elastic_net", name, r, held, float(np.sqrt(M.squared_error(g, fit["w"], fit["b"]) / g[0, 0])), fit["alpha"], fit["l1_ratio"]))
                _, _, fits = M.poly_ridge_nested(part, columns, "target", "fold")
                out += [("poly_ridge", name, r, held, fit["rmse"], fit["alpha"], None) for held, fit in fits.items() if held is not None]
    return rounded(spark.createDataFrame(out, "model string, feature_set string, repeat int, fold int, rmse double, alpha double, l1_ratio double"))


#: Smaller than USUAL, so that a run takes seconds.
SMALL_TREES = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.2}
SETTINGS = {"maxDepth": [2, 4, 6], "stepSize": [0.05, 0.1, 0.3], "minInstancesPerNode": [1, 10, 50]}


@query()
def gbt_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees that stop early, scored on each held-out fold and on all of them."""
    return rounded(G.gbt_scores(folded(spark, sf_dir), INPUTS, "target", "fold", 5, **SMALL_TREES))


@query()
def gbt_tune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth, step size and rows a leaf: all 27 settings by inner folds of the training rows, with 1, 3, 9 and 27 trees for ever fewer of them."""
    f = folded(spark, sf_dir).filter("fold <> 0").withColumn("inner", (F.floor(F.col("file") / 5) % 3).cast("int"))
    tuned = G.gbt_search(f, INPUTS, "target", "inner", 3, G.every_setting(SETTINGS))
    return rounded(tuned.select(F.col("maxDepth").cast("int").alias("max_depth"), F.col("stepSize").alias("step_size"), F.col("minInstancesPerNode").cast("int").alias("least_rows"), F.col("round").cast("int").alias("round"), F.col("n_trees").cast("int").alias("n_trees"), "rmse", "best"))


@query()
def shap_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What trees go by: how their error grows when a column is moved to other rows, and their own importances."""
    f = folded(spark, sf_dir)
    model, cuts = G.gbt_final(f, INPUTS, "target", [10], **SMALL_TREES)
    predict = lambda df: model.transform(G.assembled(df, INPUTS, cuts)).withColumnRenamed("prediction", "yhat")
    moved = M.permutation_importance(f, INPUTS, "target", predict, ["file", "sweep"])
    return rounded(moved.join(G.importances(model, INPUTS, f).select("feature", F.col("size").alias("importance")), "feature"))


@query(
    f"""WITH {HOLDOUT}, t AS (SELECT f.*, p.place < ceil(n * 0.2) AS held FROM features f JOIN places p USING (file, sweep)),
m AS (SELECT avg(quantity) AS m, avg(target) AS y, covar_pop(quantity, target) / var_pop(quantity) AS w FROM t WHERE NOT held)
SELECT file, round(sum(y + w * (quantity - m)), 5) AS yhat, round(sum(target - (y + w * (quantity - m))), 5) AS residual FROM t, m WHERE held GROUP BY file""",
    "features",
)
def holdout_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.feature_table(spark, sf_dir)
    f = f.join(M.split_holdout(f, ["file", "sweep"]), ["file", "sweep"])
    w, b = M.ridge(sum(M.gram(f.filter("NOT is_holdout"), ["quantity"], "target", []).values()), 0.0)
    p = f.filter("is_holdout").withColumn("yhat", M.linear(["quantity"], w, b))
    return rounded(p.groupBy("file").agg(F.sum("yhat").alias("yhat"), F.sum(F.col("target") - F.col("yhat")).alias("residual")), 5)


@query(f"WITH {PREDICTIONS}, r AS (SELECT l_orderkey, CAST(floor(y) AS BIGINT) AS band, y - a AS e FROM p) SELECT band, count(*) AS n, round(avg(e), 6) AS mean_residual, round(stddev_samp(e), 6) AS std_residual FROM r GROUP BY band")
def residual_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("y") - F.col("a")
    return rounded(predictions(spark, sf_dir).groupBy(F.floor("y").alias("band")).agg(F.count("*").alias("n"), F.avg(e).alias("mean_residual"), F.stddev_samp(e).alias("std_residual")))


@query()
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the error of a fit grows when a column is moved to other rows of its order of hashes."""
    f = D.feature_table(spark, sf_dir)
    w, b = M.ridge(sum(M.gram(f, INPUTS, "target", []).values()), 1.0)
    return rounded(M.permutation_importance(f, INPUTS, "target", lambda df: df.withColumn("yhat", M.linear(INPUTS, w, b)), ["file", "sweep"]))


def set_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold errors of both models on the parts of three suppliers' groups, which stand for feature sets."""
    p = D.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey"), F.col("l_suppkey"), (0.01 * F.col("l_quantity") - 2 * F.col("l_discount") + 5 * F.col("l_tax") * F.col("l_tax") + 0.3 * (F.col("l_suppkey") % 7)).alias("y"), "l_partkey"
    )
    p = p.withColumns({"A": F.col("y") + 0.1 * F.sin("l_partkey"), "B": F.col("y") + 0.15 * F.cos("l_partkey"), "fold": F.col("l_orderkey") % 25, "feature_set": F.concat(F.lit("set"), F.col("l_suppkey") % 3)})
    both = p.select("fold", "feature_set", "y", F.explode(F.create_map(F.lit("A"), F.col("A"), F.lit("B"), F.col("B"))).alias("kind", "yhat"))
    both = both.withColumn("model", F.concat_ws("_", "kind", "feature_set"))
    return M.regression_metrics(both, "y", "yhat", ["fold", "feature_set", "model"]).select("fold", "feature_set", "model", "rmse")


SET_SCORES = """t AS (SELECT l_orderkey % 25 AS fold, 'set' || (l_suppkey % 3) AS feature_set, l_partkey, 0.01::DOUBLE * l_quantity - 2 * l_discount + 5 * l_tax * l_tax + 0.3::DOUBLE * (l_suppkey % 7) AS y FROM lineitem),
ss AS (SELECT fold, feature_set, 'A_' || feature_set AS model, sqrt(avg(power(y - (y + 0.1::DOUBLE * sin(l_partkey)), 2))) AS rmse FROM t GROUP BY 1, 2 UNION ALL SELECT fold, feature_set, 'B_' || feature_set, sqrt(avg(power(y - (y + 0.15::DOUBLE * cos(l_partkey)), 2))) FROM t GROUP BY 1, 2),
best AS (SELECT feature_set, arg_min(model, m) AS model, min(m) AS mean_rmse FROM (SELECT feature_set, model, avg(rmse) AS m FROM ss GROUP BY 1, 2) GROUP BY 1)"""


@query(f"WITH {SET_SCORES} SELECT feature_set, model, round(mean_rmse, 6) AS mean_rmse FROM best")
def best_per_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.best_per_set(set_scores(spark, sf_dir)))


@query(f"WITH {SET_SCORES} SELECT DISTINCT x.feature_set, x.model AS model_a, y.model AS model_b FROM ss x JOIN ss y ON x.feature_set = y.feature_set AND x.model < y.model")
def pairs_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pairs_within(set_scores(spark, sf_dir))


@query(f"WITH {SET_SCORES} SELECT x.feature_set AS set_a, x.model AS model_a, y.feature_set AS set_b, y.model AS model_b FROM best x JOIN best y ON x.feature_set < y.feature_set")
def pairs_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best model of each set against that of each other set."""
    return C.pairs_cross(set_scores(spark, sf_dir))


@query()
def pair_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tests of each pair of models in one row, with Holm's decision on the resampled t test."""
    keys = ["model_a", "model_b"]
    t = C.ttest_corrected(C.paired(scores(spark, sf_dir), ["fold"], "rmse"), 5).select(*keys, F.col("t").alias("cv_t_stat"), F.col("p").alias("cv_p_value"))
    r = residuals(spark, sf_dir)
    dm = C.diebold_mariano(r).select(*keys, F.col("dm").alias("dm_stat"), F.col("p").alias("dm_p"))
    w = C.wilcoxon(r).select(*keys, F.col("w").alias("wilcoxon_stat"), F.col("p").alias("wilcoxon_p"))
    errors = r.select(*keys, F.concat_ws(":", "file", "sweep").alias("key"), "a", "b")
    ci = C.bootstrap_rmse(errors, by=keys).select(*keys, "delta_rmse", F.col("ci_lo").alias("ci_95_lo"), F.col("ci_hi").alias("ci_95_hi"))
    return rounded(C.holm(t.join(dm, keys).join(w, keys), "cv_p_value").join(ci, keys), 5)


METRICS = "round(1 - sum(power(y - {x}, 2)) / (count(*) * var_pop(y)), 6) AS {p}r2, round(avg(abs(y - {x})), 6) AS {p}mae, round(sqrt(avg(power(y - {x}, 2))), 6) AS {p}rmse"
SUMMARY = "s AS (SELECT model, avg(rmse) AS cv_rmse, stddev_samp(rmse) AS cv_std FROM scores GROUP BY model), h AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, {METRICS.format(x=m.lower(), p='holdout_')} FROM p WHERE l_orderkey % 5 = 0" for m in "AB") + ")"


@query(f"WITH {SCORES}, {SUMMARY} SELECT model, round(cv_rmse, 6) AS cv_rmse, round(cv_std, 6) AS cv_std, holdout_r2, holdout_mae, holdout_rmse FROM s JOIN h USING (model)")
def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated and holdout errors of each model."""
    cv = scores(spark, sf_dir).groupBy("model").agg(F.avg("rmse").alias("cv_rmse"), F.stddev_samp("rmse").alias("cv_std"))
    p = predictions(spark, sf_dir).filter("file % 5 = 0")
    both = p.select("y", F.explode(F.create_map(F.lit("A"), F.col("a"), F.lit("B"), F.col("b"))).alias("model", "yhat"))
    held = M.regression_metrics(both, "y", "yhat", ["model"]).select("model", *(F.col(c).alias(f"holdout_{c}") for c in ("r2", "mae", "rmse")))
    return rounded(cv.join(held, "model"))


@query()
def fit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each linear family, the metrics of held-out folds, how many coefficients it has and how many are not zero, and the final fit's penalties."""
    f = folded(spark, sf_dir).withColumn("inner", (F.floor(F.col("file") / 5) % 5).cast("int"))
    nets = M.elastic_net_nested(M.gram(f, INPUTS, "target", ["fold", "inner"]))
    wide, names, ridges = M.poly_ridge_nested(f, INPUTS, "target", "fold")
    out = [M.fit_summary(f, INPUTS, "target", "fold", nets, "elastic_net", ["alpha", "l1_ratio"]), M.fit_summary(wide, names, "target", "fold", ridges, "poly_ridge", ["alpha"])]
    return rounded(out[0].unionByName(out[1], allowMissingColumns=True))


@query()
def best_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The penalties of each model's best outer fold."""
    s = nested_cv_scores(spark, sf_dir)
    return s.groupBy("model", "feature_set").agg(F.min_by(F.struct("alpha", "l1_ratio"), "rmse").alias("best"), F.min("rmse").alias("rmse")).select("model", "feature_set", "best.alpha", "best.l1_ratio", "rmse")


# --- very many columns

CLOSE = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM features" for a in NAMES for b in NAMES if a != b)


@query(f"SELECT a, b, round(r, 6) AS r FROM ({CLOSE}) WHERE abs(r) >= 0.5", "features")
def close_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that are close to each other, as edges from block products."""
    vectors = D.feature_table(spark, sf_dir).select(F.array(*(F.col(c).cast("double") for c in NAMES)).alias("x"))
    return rounded(L.close_pairs(vectors, NAMES, 0.5))


@query(
    f"""WITH v(feature, place, inflation) AS (VALUES ('quantity', 0, 99.0), ('tax', 1, 99.0), ('collinear', 2, 99.0), ('price', 3, 1.0)), e AS (SELECT * FROM ({CLOSE}) WHERE abs(r) >= 0.5),
w AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, round(abs(corr({c}, target)), 9) AS worth FROM features" for c in NAMES)}), c AS (SELECT * FROM v JOIN w USING (feature)),
b AS (SELECT e.a, x.place AS a_place, x.inflation >= 10 AS a_high, e.b, y.place AS b_place, y.inflation >= 10 AS b_high FROM e JOIN c x ON x.feature = e.a JOIN c y ON y.feature = e.b WHERE y.worth > x.worth OR y.worth = x.worth AND y.place < x.place),
f AS (SELECT a, min(b_place) AS first FROM b WHERE b_high GROUP BY a)
SELECT feature, worth FROM c WHERE feature NOT IN (SELECT a FROM f) AND feature NOT IN (SELECT b.a FROM b LEFT JOIN f ON f.a = b.b WHERE a_high AND (f.first IS NULL OR b.a_place < f.first))""",
    "features",
)
def columns_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of close columns by joins over their edges; worth is by correlation with the target, three columns depend on each other exactly."""
    f = D.feature_table(spark, sf_dir)
    edges = L.close_pairs(f.select(F.array(*(F.col(c).cast("double") for c in NAMES)).alias("x")), NAMES, 0.5)
    worth = T.pearson_target(f, NAMES, "target").select("feature", F.round(F.abs("r"), 9).alias("worth"))
    facts = spark.createDataFrame([(c, k, 1.0 if c == "price" else 99.0) for k, c in enumerate(NAMES)], "feature string, place int, inflation double")
    return L.without_close(edges, facts.join(worth, "feature")).select("feature", "worth")
