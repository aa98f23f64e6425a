"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm.bpe import op8_byte_bpe
from quillmark.llm.decontaminate import op4_decontaminate
from quillmark.llm.jaccard import op3_ngram_jaccard
from quillmark.llm.langid import op1_language_id
from quillmark.llm.lines import OP9_SQL, op9_line_dedup
from quillmark.llm.lm import op7_lm_scoring
from quillmark.llm.media import op2_media_columns
from quillmark.llm.neighbours import OP11_SQL, op11_embedding_near_dedup
from quillmark.llm.pii import op10_pii
from quillmark.llm.substrings import op6_substring_dedup
from quillmark.llm.trie import OP12_SQL, op12_conversation_trie
from quillmark.llm.urls import OP5_SQL, op5_url_filter
from quillmark.llm.variants import OP13_SQL, op13_spelling_variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_media_columns, op3_ngram_jaccard, op4_decontaminate, op5_url_filter, op6_substring_dedup, op7_lm_scoring, op8_byte_bpe, op9_line_dedup, op10_pii, op11_embedding_near_dedup, op12_conversation_trie, op13_spelling_variants)}
ORACLE_SQL = {"op5_url_filter": OP5_SQL, "op9_line_dedup": OP9_SQL, "op11_embedding_near_dedup": OP11_SQL, "op12_conversation_trie": OP12_SQL, "op13_spelling_variants": OP13_SQL}
