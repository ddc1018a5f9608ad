"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veridock.llm.op1 import ORACLE as OP1_SQL
from veridock.llm.op1 import op1_topk_search
from veridock.llm.op2 import ORACLE as OP2_SQL
from veridock.llm.op2 import op2_mixing
from veridock.llm.op10 import op10_toxicity
from veridock.llm.op3 import op3_token_counts
from veridock.llm.op4 import op4_quality_classifier
from veridock.llm.op5 import op5_url_filter
from veridock.llm.op6 import ORACLE as OP6_SQL
from veridock.llm.op6 import op6_minhash_near_dedup
from veridock.llm.op7 import op7_language_id
from veridock.llm.op8 import op8_decontamination
from veridock.llm.op9 import ORACLE as OP9_SQL
from veridock.llm.op9 import op9_substring_dedup

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_topk_search, op2_mixing, op3_token_counts, op4_quality_classifier, op5_url_filter, op6_minhash_near_dedup, op7_language_id, op8_decontamination, op9_substring_dedup, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": OP1_SQL, "op2_mixing": OP2_SQL, "op6_minhash_near_dedup": OP6_SQL, "op9_substring_dedup": OP9_SQL}
