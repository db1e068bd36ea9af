"""Operators for training-data pipelines.  Nothing outside this subpackage imports it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The query of every operator."""
    from logspark.llm.bpe import op9_bpe
    from logspark.llm.langid import op10_language_id
    from logspark.llm.licenses import op2_license_scan
    from logspark.llm.media import op7_media
    from logspark.llm.ngram_join import op3_ngram_join, op3_ngram_links
    from logspark.llm.packing import op1_best_fit_packing
    from logspark.llm.quality import op5_quality_rules
    from logspark.llm.secret_scan import op4_secret_scan
    from logspark.llm.toxicity import op8_toxicity
    from logspark.llm.urls import op6_url_filter

    return {f.__name__: f for f in (op1_best_fit_packing, op2_license_scan, op3_ngram_join, op3_ngram_links, op4_secret_scan, op5_quality_rules, op6_url_filter, op7_media, op8_toxicity, op9_bpe, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the operators that SQL can express."""
    from logspark.llm import ngram_join

    return {"op3_ngram_join": ngram_join.ORACLE_SQL, "op3_ngram_links": ngram_join.LINKS_SQL}
