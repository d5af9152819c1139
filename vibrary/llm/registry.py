"""The queries of this package and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from .centroids import OP13_SQL, op13_centroid_clustering
from .decontaminate import OP3_SQL, op3_benchmark_decontamination
from .html import op1_html_extraction
from .jaccard import OP8_SQL, op8_ngram_jaccard_join
from .language import op9_language_id
from .lines import OP4_SQL, op4_line_dedup
from .packing import op2_best_fit_packing
from .periods import op12_periodic_runs
from .pii import op6_pii
from .quality import op5_quality_rules
from .scoring import op7_lm_scoring
from .secrets import OP11_SQL, op11_secret_scans
from .sharding import OP10_SQL, op10_feistel_sharding

QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_best_fit_packing, op3_benchmark_decontamination, op4_line_dedup, op5_quality_rules, op6_pii, op7_lm_scoring, op8_ngram_jaccard_join,
        op9_language_id, op10_feistel_sharding, op11_secret_scans, op12_periodic_runs, op13_centroid_clustering,
    )
}
SQL = {
    "op3_benchmark_decontamination": OP3_SQL, "op4_line_dedup": OP4_SQL, "op8_ngram_jaccard_join": OP8_SQL, "op10_feistel_sharding": OP10_SQL,
    "op11_secret_scans": OP11_SQL, "op13_centroid_clustering": OP13_SQL,
}
