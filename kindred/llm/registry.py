"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kindred.llm.conversation_trie import OP12_SQL, op12_conversation_trie
from kindred.llm.decontaminate import op8_decontaminate
from kindred.llm.html_text import op1_html_text
from kindred.llm.language_model import op4_language_model
from kindred.llm.line_dedup import OP2_SQL, op2_line_dedup
from kindred.llm.neighbours import op3_neighbours
from kindred.llm.packing import op9_packing
from kindred.llm.toxicity import op7_toxicity
from kindred.llm.url_filter import OP5_SQL, op5_url_filter
from kindred.llm.parity_join import op6_jaccard_join
from kindred.llm.secret_ledger import OP11_SQL, op11_secret_scan
from kindred.llm.spelling import OP13_SQL, op13_spelling_variants
from kindred.llm.token_counts import op10_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": op1_html_text,
        "op2_line_dedup": op2_line_dedup,
        "op3_neighbours": op3_neighbours,
        "op4_language_model": op4_language_model,
        "op5_url_filter": op5_url_filter,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_toxicity": op7_toxicity,
        "op8_decontaminate": op8_decontaminate,
        "op9_packing": op9_packing,
        "op10_token_counts": op10_token_counts,
        "op11_secret_scan": op11_secret_scan,
        "op12_conversation_trie": op12_conversation_trie,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": OP2_SQL,
        "op5_url_filter": OP5_SQL,
        "op11_secret_scan": OP11_SQL,
        "op12_conversation_trie": OP12_SQL,
        "op13_spelling_variants": OP13_SQL,
    }
