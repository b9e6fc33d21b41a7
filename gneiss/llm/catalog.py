"""The operators' queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_models as models
from . import queries_native as native
from . import queries_python as python


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": models.op1_lm_scoring,
        "op2_packing": python.op2_packing,
        "op3_jaccard_join": models.op3_jaccard_join,
        "op4_token_codes": python.op4_token_codes,
        "op5_line_dedup": native.op5_line_dedup,
        "op6_decontamination": python.op6_decontamination,
        "op7_media_columns": python.op7_media_columns,
        "op8_quality_classifier": python.op8_quality_classifier,
        "op9_sharding": native.op9_sharding,
        "op10_secret_scans": native.op10_secret_scans,
        "op11_prefix_trie": python.op11_prefix_trie,
        "op12_personal_data": python.op12_personal_data,
        "op13_ranked_search": python.op13_ranked_search,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": models.OP3_SQL, "op5_line_dedup": native.OP5_SQL, "op6_decontamination": python.OP6_SQL, "op9_sharding": native.OP9_SQL, "op10_secret_scans": native.OP10_SQL, "op11_prefix_trie": python.OP11_SQL, "op13_ranked_search": python.OP13_SQL}
