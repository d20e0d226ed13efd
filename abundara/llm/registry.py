"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import op1_pii as op1
from . import op10_near_dedup as op10
from . import op11_search as op11
from . import op12_vector_codes as op12
from . import op13_exact_topk as op13
from . import op2_token_files as op2
from . import op3_warc as op3
from . import op4_quality_rules as op4
from . import op5_toxicity as op5
from . import op6_lm as op6
from . import op7_bpe as op7
from . import op8_packing as op8
from . import op9_exact_dedup as op9


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_pii": op1.op1_pii,
        "op2_token_files": op2.op2_token_files,
        "op3_warc": op3.op3_warc,
        "op4_quality_rules": op4.op4_quality_rules,
        "op5_toxicity": op5.op5_toxicity,
        "op6_lm": op6.op6_lm,
        "op7_bpe": op7.op7_bpe,
        "op8_packing": op8.op8_packing,
        "op9_exact_dedup": op9.op9_exact_dedup,
        "op10_near_dedup": op10.op10_near_dedup,
        "op11_search": op11.op11_search,
        "op12_vector_codes": op12.op12_vector_codes,
        "op13_exact_topk": op13.op13_exact_topk,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": op3.ORACLE, "op9_exact_dedup": op9.ORACLE, "op10_near_dedup": op10.ORACLE, "op11_search": op11.ORACLE, "op12_vector_codes": op12.ORACLE, "op13_exact_topk": op13.ORACLE}
