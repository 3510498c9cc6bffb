"""Cleaning a corpus and counting what was kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import count_tokens
from pageloom.operators.html import clean_html, page_blocks


def clean_pages(corpus: DataFrame, nested: str = "once") -> DataFrame:
    """corpus(url, content, type, …) with text, n_tokens and status instead of content.

    status is ok, no_content, unknown_type or empty_after_clean; text is null
    unless it is ok. Markdown passes as it is. Nothing is shuffled.
    """
    kind = F.coalesce(F.col("type"), F.lit("html"))
    empty = F.coalesce(F.col("content"), F.lit("")) == ""
    parsed = corpus.withColumn("_kind", kind).withColumn(
        "_parsed", page_blocks(F.when(~empty & (kind == "html"), F.col("content")), nested)
    )
    text = F.when(F.col("_kind") == "markdown", F.col("content")).when(
        F.col("_kind") == "html", clean_html(F.col("_parsed"))
    )
    cleaned = parsed.withColumn("_text", text)
    status = (
        F.when(empty, "no_content")
        .when(~F.col("_kind").isin("html", "markdown"), "unknown_type")
        .when(F.coalesce(F.col("_text"), F.lit("")) == "", "empty_after_clean")
        .otherwise("ok")
    )
    done = cleaned.withColumn("status", status)
    done = done.withColumn("text", F.when(F.col("status") == "ok", F.col("_text")))
    return done.withColumn("n_tokens", count_tokens(F.col("text"))).drop("content", "_kind", "_parsed", "_text")


def clean_summary(clean: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pages given, processed and skipped by kind."""
    return clean.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_input"),
        F.count_if(F.col("status") == "ok").alias("n_processed"),
        F.count_if(F.col("status") == "no_content").alias("n_no_content"),
        F.count_if(F.col("status").isin("unknown_type", "empty_after_clean")).alias("n_empty"),
    )
