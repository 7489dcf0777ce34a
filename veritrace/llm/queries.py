"""The registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veritrace.llm import filter_audit, licenses, quality_rules, resampling, substring_dedup
from veritrace.llm.embedding_dedup import op4_embedding_dedup
from veritrace.llm.filter_audit import op12_filter_audit
from veritrace.llm.language_id import op10_language_id
from veritrace.llm.language_model import op3_lm_scoring
from veritrace.llm.licenses import op1_license_scans
from veritrace.llm.packing import op7_best_fit_packing
from veritrace.llm.pieces import op9_sentencepiece
from veritrace.llm.quality_classifier import op6_quality_classifier
from veritrace.llm.quality_rules import op2_quality_rules
from veritrace.llm.resampling import op13_resampling
from veritrace.llm.simhash import op8_simhash
from veritrace.llm.substring_dedup import op11_substring_dedup
from veritrace.llm.token_counts import op5_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scans": op1_license_scans,
    "op2_quality_rules": op2_quality_rules,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_simhash": op8_simhash,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_language_id": op10_language_id,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_resampling": op13_resampling,
}
ORACLES: dict[str, str] = {"op1_license_scans": licenses.ORACLE, "op2_quality_rules": quality_rules.ORACLE, "op11_substring_dedup": substring_dedup.ORACLE, "op12_filter_audit": filter_audit.ORACLE, "op13_resampling": resampling.ORACLE}
