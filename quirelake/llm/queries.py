"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann_search, bpe_chunks, html_text, language_id, line_dedup, media_audio, mixing, ngram_join, packing, prefix_trie, secret_scan, token_alignment, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_multiprobe_ann": ann_search.query,
    "op2_lexical_packing": packing.query,
    "op3_bpe_chunk_reuse": bpe_chunks.query,
    "op4_line_dedup": line_dedup.query,
    "op5_language_id": language_id.query,
    "op6_token_counts": token_counts.query,
    "op7_html_main_text": html_text.query,
    "op8_media_audio": media_audio.query,
    "op9_secret_scan": secret_scan.query,
    "op10_ngram_jaccard_join": ngram_join.query,
    "op11_token_alignment": token_alignment.query,
    "op12_source_mixing": mixing.query,
    "op13_prefix_trie": prefix_trie.query,
}

ORACLES: dict[str, str] = {
    "op4_line_dedup": line_dedup.ORACLE,
    "op9_secret_scan": secret_scan.ORACLE,
    "op12_source_mixing": mixing.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
