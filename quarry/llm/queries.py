"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .conversations import op11_conversation_repair
from .decontaminate import op5_decontaminate
from .fingerprints import op10_fingerprints
from .licenses import op2_licenses
from .line_dedup import op13_line_dedup
from .lm_score import op7_lm_score
from .ngram_join import op1_ngram_join
from .packing import op3_packing
from .pii import op6_pii
from .quality import op8_quality
from .sql import DECONTAMINATE, LINE_DEDUP, NGRAM_JOIN, SUBSTRING_DEDUP, TARGET_ENCODING
from .substrings import op4_substring_dedup
from .target_encoding import op12_target_encoding
from .urls import op9_urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_licenses": op2_licenses,
        "op3_packing": op3_packing,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_decontaminate": op5_decontaminate,
        "op6_pii": op6_pii,
        "op7_lm_score": op7_lm_score,
        "op8_quality": op8_quality,
        "op9_urls": op9_urls,
        "op10_fingerprints": op10_fingerprints,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_target_encoding": op12_target_encoding,
        "op13_line_dedup": op13_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": NGRAM_JOIN, "op4_substring_dedup": SUBSTRING_DEDUP, "op5_decontaminate": DECONTAMINATE, "op12_target_encoding": TARGET_ENCODING, "op13_line_dedup": LINE_DEDUP}
