"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .centroid_clustering import OP12_SQL, op12_centroid_clustering
from .importance import OP13_SQL, op13_importance_resampling
from .jaccard_join import op7_jaccard_join
from .language_id import op3_language_id
from .lattice_scores import op11_lattice_scores
from .license_scan import op4_license_scan
from .line_dedup import OP10_SQL, op10_line_dedup
from .multiset_hash import op5_multiset_hash
from .packing import op2_packing
from .positional_index import op6_decontamination
from .sharding import op1_kd_sharding
from .token_records import op9_token_records
from .warc import op8_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_kd_sharding": op1_kd_sharding,
        "op2_packing": op2_packing,
        "op3_language_id": op3_language_id,
        "op4_license_scan": op4_license_scan,
        "op5_multiset_hash": op5_multiset_hash,
        "op6_decontamination": op6_decontamination,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_warc": op8_warc,
        "op9_token_records": op9_token_records,
        "op10_line_dedup": op10_line_dedup,
        "op11_lattice_scores": op11_lattice_scores,
        "op12_centroid_clustering": op12_centroid_clustering,
        "op13_importance_resampling": op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_line_dedup": OP10_SQL, "op12_centroid_clustering": OP12_SQL, "op13_importance_resampling": OP13_SQL}
