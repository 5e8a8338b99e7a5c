"""The operators as queries over the whole tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabulens.llm import bpe, chat, exact, language, lexical, near, packing, pages, quality, substrings, token_files, warc, whitening
from tabulens.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def over(name: str, function: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: function(table(spark, folder, name))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": over("documents", quality.quality_documents),
    "op2_substring_dedup": over("documents", substrings.substring_documents),
    "op3_warc_salvage": over("pages", warc.warc_pages),
    "op4_bpe_codec": over("documents", bpe.bpe_documents),
    "op5_token_orc": over("documents", token_files.token_file_documents),
    "op6_exact_dedup": over("documents", exact.exact_documents),
    "op7_best_fit_packing": over("documents", packing.packed_documents),
    "op8_near_dedup": over("documents", near.near_documents),
    "op9_chat_format": over("conversations", chat.chat_conversations),
    "op10_html_text": over("pages", pages.page_texts),
    "op11_language_id": over("documents", language.language_documents),
    "op12_lexical_search": lexical.ranked_documents,
    "op13_whitening": over("embeddings", whitening.whitened_embeddings),
}

#: Tokenizing, packing, learning and eigenvectors (4, 5, 7, 11, 13) are beyond SQL; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op1_quality_rules": quality.ORACLE,
    "op2_substring_dedup": substrings.ORACLE,
    "op3_warc_salvage": warc.ORACLE,
    "op6_exact_dedup": exact.ORACLE,
    "op8_near_dedup": near.ORACLE,
    "op9_chat_format": chat.ORACLE,
    "op10_html_text": pages.ORACLE,
    "op12_lexical_search": lexical.ORACLE,
}
