"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumbung.llm.bpe import op8_bpe
from lumbung.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from lumbung.llm.jaccard_join import op9_jaccard_join
from lumbung.llm.langid import op10_language_id
from lumbung.llm.mixing import OP7_SQL, op7_mixing
from lumbung.llm.pu_quality import op3_pu_quality
from lumbung.llm.quality_rules import op6_quality_rules
from lumbung.llm.records import op1_token_records
from lumbung.llm.secrets import op5_secret_scan
from lumbung.llm.suffix_dedup import op4_suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_records": op1_token_records,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_pu_quality": op3_pu_quality,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_rules": op6_quality_rules,
    "op7_mixing": op7_mixing,
    "op8_bpe": op8_bpe,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_language_id": op10_language_id,
}
ORACLE_SQL: dict[str, str] = {"op2_exact_dedup": OP2_SQL, "op7_mixing": OP7_SQL}
