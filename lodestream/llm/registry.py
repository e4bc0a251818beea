"""The queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestream.llm import bpe, chat, filter_audit, html_extract, iblt, mixing, patricia, repair, runs, suffixes, superminhash, toxicity, url_filters

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_chat": chat.op1_chat,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_minhash": superminhash.op3_minhash,
        "op4_bpe": bpe.op4_bpe,
        "op5_token_files": repair.op5_token_files,
        "op6_suffix_dedup": suffixes.op6_suffix_dedup,
        "op7_mixing": mixing.op7_mixing,
        "op8_html": html_extract.op8_html,
        "op9_exact_dedup": patricia.op9_exact_dedup,
        "op10_fingerprints": iblt.op10_fingerprints,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_runs": runs.op12_runs,
        "op13_urls": url_filters.op13_urls,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat": chat.OP1_SQL,
        "op3_minhash": superminhash.OP3_SQL,
        "op6_suffix_dedup": suffixes.OP6_SQL,
        "op7_mixing": mixing.OP7_SQL,
        "op8_html": html_extract.OP8_SQL,
        "op9_exact_dedup": patricia.OP9_SQL,
        "op11_filter_audit": filter_audit.OP11_SQL,
        "op12_runs": runs.OP12_SQL,
        "op13_urls": url_filters.OP13_SQL,
    }
