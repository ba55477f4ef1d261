"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fluora.llm import chat, clustering, topk
from fluora.llm.alignment import op11_alignment
from fluora.llm.chat import op10_chat
from fluora.llm.clustering import op12_clustering
from fluora.llm.line_dedup import op7_line_dedup
from fluora.llm.lm_scoring import op3_lm_scoring
from fluora.llm.mixing import op1_mixing
from fluora.llm.ngram_join import op2_ngram_join
from fluora.llm.packing import op13_packing
from fluora.llm.quality import op8_quality
from fluora.llm.sentencepiece_bpe import op4_sentencepiece
from fluora.llm.sharding import op5_sharding
from fluora.llm.topk import op9_topk
from fluora.llm.warc import op6_warc

OPERATORS = (op1_mixing, op2_ngram_join, op3_lm_scoring, op4_sentencepiece, op5_sharding, op6_warc, op7_line_dedup, op8_quality, op9_topk, op10_chat, op11_alignment, op12_clustering, op13_packing)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op9_topk": topk.ORACLE, "op10_chat": chat.ORACLE, "op12_clustering": clustering.ORACLE}
