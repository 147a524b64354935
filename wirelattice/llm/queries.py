"""The training-data queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wirelattice.llm.ann import op8_ann
from wirelattice.llm.bpe import op3_bpe
from wirelattice.llm.chat import OP9_SQL, op9_chat_formatting
from wirelattice.llm.classifier import op4_quality_classifier
from wirelattice.llm.jaccard import OP5_SQL, op5_jaccard_join
from wirelattice.llm.licenses import op7_license_scan, op7_sql
from wirelattice.llm.mixing import op2_source_mixing
from wirelattice.llm.pii import op6_pii
from wirelattice.llm.quality import op1_quality_rules
from wirelattice.llm.warc import OP10_SQL, op10_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_source_mixing": op2_source_mixing,
    "op3_bpe": op3_bpe,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_pii": op6_pii,
    "op7_license_scan": op7_license_scan,
    "op8_ann": op8_ann,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_warc": op10_warc,
}

ORACLE_SQL: dict[str, str] = {"op5_jaccard_join": OP5_SQL, "op7_license_scan": op7_sql(), "op9_chat_formatting": OP9_SQL, "op10_warc": OP10_SQL}
