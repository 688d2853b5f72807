"""The training-data queries: ``queries()`` and ``oracle_sql()`` of the subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_chat, q_collocations, q_lang, q_license, q_lines, q_media, q_near, q_pack, q_pieces, q_quality, q_search, q_url, q_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": q_chat.op1_chat_format,
        "op2_near_dedup": q_near.op2_near_dedup,
        "op3_sentencepiece": q_pieces.op3_sentencepiece,
        "op4_warc": q_warc.op4_warc,
        "op5_line_dedup": q_lines.op5_line_dedup,
        "op6_media_columns": q_media.op6_media_columns,
        "op7_language_id": q_lang.op7_language_id,
        "op8_packing": q_pack.op8_packing,
        "op9_url_filter": q_url.op9_url_filter,
        "op10_quality_rules": q_quality.op10_quality_rules,
        "op11_license_scan": q_license.op11_license_scan,
        "op12_collocations": q_collocations.op12_collocations,
        "op13_lexical_search": q_search.op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": q_chat.OP1_SQL,
        "op2_near_dedup": q_near.OP2_SQL,
        "op4_warc": q_warc.OP4_SQL,
        "op5_line_dedup": q_lines.OP5_SQL,
        "op10_quality_rules": q_quality.OP10_SQL,
        "op11_license_scan": q_license.OP11_SQL,
        "op12_collocations": q_collocations.OP12_SQL,
        "op13_lexical_search": q_search.OP13_SQL,
    }
