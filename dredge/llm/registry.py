"""The queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dredge.llm import chat_format, langid_cnn, media_avi, minhash, mixing, packing, quality_llr, quality_qda, toxicity_gru, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": quality_qda.op1_quality_classifier,
        "op2_toxicity": toxicity_gru.op2_toxicity,
        "op3_quality_rules": quality_llr.op3_quality_rules,
        "op4_chat_format": chat_format.op4_chat_format,
        "op5_mixing": mixing.op5_mixing,
        "op6_media": media_avi.op6_media,
        "op7_language": langid_cnn.op7_language,
        "op8_packing": packing.op8_packing,
        "op9_minhash": minhash.op9_minhash,
        "op10_url_filter": url_filter.op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": chat_format.SQL, "op5_mixing": mixing.SQL, "op9_minhash": minhash.SQL, "op10_url_filter": url_filter.SQL}
