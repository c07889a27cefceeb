"""The queries of this package and the SQL statements that check them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnscope.llm.byte_cnn import op3_quality_classifier
from turnscope.llm.chat import SQL as CHAT_SQL
from turnscope.llm.chat import op8_chat
from turnscope.llm.decontaminate import op5_decontaminate
from turnscope.llm.jaccard_join import op1_jaccard_join
from turnscope.llm.language_profiles import op13_language
from turnscope.llm.line_dedup import SQL as LINE_DEDUP_SQL
from turnscope.llm.line_dedup import op7_line_dedup
from turnscope.llm.pii import op2_pii
from turnscope.llm.quality_rules import op10_quality_rules
from turnscope.llm.secrets import op6_secrets
from turnscope.llm.segment_sampling import op9_segment_sampling
from turnscope.llm.sentence_spans import op4_sentence_spans
from turnscope.llm.spelling import SQL as SPELLING_SQL
from turnscope.llm.spelling import op12_spelling
from turnscope.llm.turn_repair import SQL as TURN_REPAIR_SQL
from turnscope.llm.turn_repair import op11_turn_repair

QUERIES = (
    op1_jaccard_join, op2_pii, op3_quality_classifier, op4_sentence_spans, op5_decontaminate, op6_secrets,
    op7_line_dedup, op8_chat, op9_segment_sampling, op10_quality_rules,
    op11_turn_repair, op12_spelling, op13_language,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op7_line_dedup": LINE_DEDUP_SQL, "op8_chat": CHAT_SQL, "op11_turn_repair": TURN_REPAIR_SQL,
        "op12_spelling": SPELLING_SQL,
    }
