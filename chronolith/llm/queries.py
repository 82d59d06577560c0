"""The registered queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import ORACLE_SQL as OP10_SQL
from .decontaminate import op10_decontamination
from .embeddings import op2_embedding_dedup
from .langid import op1_language_id
from .licences import op7_licences
from .licences import oracle as op7_sql
from .mixing import op4_mixing
from .pii import op8_pii
from .quality import op3_quality
from .simhash import op6_simhash
from .substring import ORACLE_SQL as OP5_SQL
from .substring import op5_substring_dedup
from .toxicity import op9_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_quality": op3_quality,
    "op4_mixing": op4_mixing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_simhash": op6_simhash,
    "op7_licences": op7_licences,
    "op8_pii": op8_pii,
    "op9_toxicity": op9_toxicity,
    "op10_decontamination": op10_decontamination,
}
ORACLES: dict[str, str] = {"op5_substring_dedup": OP5_SQL, "op7_licences": op7_sql(), "op10_decontamination": OP10_SQL}
