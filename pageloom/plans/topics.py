"""A topic for every page or seed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.topics import combine_topic, domain_topic, parse_topic, path_topic
from pageloom.functions.urls import strip_fragment
from pageloom.operators.html import clean_html, page_blocks, page_heading, page_title
from pageloom.operators.ledger import ask
from pageloom.operators.requests import attach_responses, topic_requests
from pageloom.operators.storage import materialize
from pageloom.settings import Settings


def infer_topics(pages: DataFrame, responses: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """topics(url, topic, topic_source) of pages(url, html).

    A model's answer in responses(url, response) counts first, then heading,
    title and path of a page with html, then the host; null without a host.
    """
    read = pages.select(
        "url",
        page_heading(F.col("html")).alias("heading"),
        page_title(F.col("html"), strict).alias("title"),
        path_topic(F.col("url")).alias("path"),
        domain_topic(F.col("url")).alias("by_host"),
        (F.coalesce(F.col("html"), F.lit("")) != "").alias("has_html"),
    )
    if responses is None:
        read = read.withColumn("by_model", F.lit(None).cast("string"))
    else:
        parsed = responses.select("url", parse_topic(F.col("response")).alias("by_model"))
        read = read.join(parsed, "url", "left")
    combined = F.when(
        F.col("has_html"), combine_topic(F.col("heading"), F.col("title"), F.col("path"))
    )
    named = read.withColumn("by_page", combined)
    source = (
        F.when(F.col("by_host").isNull(), F.lit(None))
        .when(F.col("by_model").isNotNull(), "model")
        .when(F.col("by_page").isNotNull(), "page")
        .otherwise("host")
    )
    topic = F.when(F.col("by_host").isNotNull(), F.coalesce("by_model", "by_page", "by_host"))
    return named.select("url", topic.alias("topic"), source.alias("topic_source"))


def name_seeds(
    seeds: DataFrame,
    pages: DataFrame,
    responder: Callable[[DataFrame], DataFrame] | None = None,
    model: str = Settings.rating_model,
    max_tokens: int = Settings.topic_tokens,
    strict: bool = False,
    retries: int = Settings.retries,
) -> DataFrame:
    """seeds(seed_id, start_url[, topic], …) with a topic each, and topic_source: given, model, page, host or url.

    A seed without a topic, or with a blank one, gets that of its start page in
    pages(url, html): the responder is asked about its cleaned text, then its
    heading, title, path and host count; see infer_topics. Where not even a host is
    known, the start URL is the topic. The model is asked once for each start URL, however many
    seeds share it, and its answers are written, so that no later action asks again.
    """
    topic = F.col("topic") if "topic" in seeds.columns else F.lit(None).cast("string")
    known = seeds.withColumn("topic", F.when(F.trim(topic) != "", topic)).withColumn("_url", strip_fragment(F.col("start_url")))
    given = F.when(F.col("topic").isNotNull(), F.lit("given"))
    bare = known.filter("topic IS NULL").select(F.col("_url").alias("url")).distinct()
    if bare.isEmpty():
        return known.withColumn("topic_source", given).drop("_url")
    one = pages.filter("html IS NOT NULL").join(bare, "url", "left_semi").groupBy("url").agg(F.min_by("html", F.xxhash64("html")).alias("html"))
    start = materialize(bare.join(one, "url", "left"))
    responses = None
    if responder is not None:
        texts = start.filter("html IS NOT NULL").select("url", clean_html(page_blocks(F.col("html"))).alias("text"))
        asked = materialize(topic_requests(texts, model, max_tokens))
        responses = attach_responses(asked, ask(asked, responder, retries)).select("url", "response")
    found = materialize(infer_topics(start, responses, strict))
    found = found.select(F.col("url").alias("_url"), F.col("topic").alias("_topic"), F.col("topic_source").alias("_source"))
    joined = known.join(found, "_url", "left")
    return joined.withColumn("topic_source", F.coalesce(given, "_source", F.lit("url"))).withColumn(
        "topic", F.coalesce("topic", "_topic", "start_url")).drop("_url", "_topic", "_source")
