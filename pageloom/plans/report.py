"""The whole job: from seeds and pages to rated documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import count_tokens
from pageloom.functions.urls import url_netloc
from pageloom.operators.chunk import chunk_documents
from pageloom.operators.clean import clean_summary
from pageloom.operators.joins import lookup_join
from pageloom.operators.ledger import ask
from pageloom.operators.models import cost_estimate, token_totals
from pageloom.operators.requests import (
    attach_responses,
    extract_requests,
    extract_summary,
    parse_ratings,
    rating_requests,
    valid_extracts,
)
from pageloom.operators.sequence import with_sequence
from pageloom.operators.storage import materialize
from pageloom.plans.crawl import crawl_summary
from pageloom.plans.ingest import ingest
from pageloom.plans.merge import merge_topics
from pageloom.plans.topics import name_seeds
from pageloom.settings import Settings
from pageloom.sources.readers import read_documents
from pageloom.sources.writers import write_compiled, write_documents, write_ratings, write_raw

Responder = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class CorpusReport:
    """Every table of a run."""

    corpus: DataFrame
    crawl_log: DataFrame
    crawl_counts: DataFrame
    clean_counts: DataFrame
    chunks: DataFrame
    extracts: DataFrame
    extract_counts: DataFrame
    costs: DataFrame
    merges: DataFrame  # seed_id, level, status: done, failed or stuck
    documents: DataFrame
    ratings: DataFrame


def with_topic_vectors(seeds: DataFrame, embedder: Responder | None) -> DataFrame:
    """seeds(topic, …) with topic_vector, the embedder's for each different topic, unless they have one."""
    if embedder is None or "topic_vector" in seeds.columns:
        return seeds
    texts = materialize(seeds.select(F.col("topic").alias("text")).distinct())
    vectors = materialize(embedder(texts).select(F.col("text").alias("topic"), F.col("vector").alias("topic_vector")))
    return seeds.join(vectors, "topic", "left")


def build_corpus_report(
    seeds: DataFrame,
    pages: DataFrame,
    files: DataFrame,
    responder: Responder,
    settings: Settings = Settings(),
    vectors: DataFrame | None = None,
    links: DataFrame | None = None,
    merge_limit: int | None = None,
    listing: DataFrame | None = None,
    embedder: Responder | None = None,
) -> CorpusReport:
    """Documents for seeds(seed_id, start_url[, topic][, topic_vector]).

    Seeds without a topic get one from their start page; see name_seeds. With an
    embedder, which turns texts(text) into texts(text, vector), their topics become
    the topic vectors of the crawl where none are given. Crawl or read repositories, chunk, extract, merge level by level and rate;
    responder answers the request tables. A page many seeds share is chunked
    and extracted once.
    """
    seeds = materialize(with_topic_vectors(name_seeds(seeds, pages, responder, settings.rating_model, settings.topic_tokens, retries=settings.retries), embedder))
    corpus, crawl_log = ingest(seeds, pages, files, settings.max_depth, settings.relevance_threshold, vectors, links, listing)
    corpus = materialize(corpus)
    status = F.when(F.coalesce(F.col("text"), F.lit("")) == "", "empty_after_clean").otherwise("ok")
    clean = corpus.select(
        "seed_id", "url", "text", status.alias("status"), count_tokens(F.col("text")).alias("n_tokens")
    )

    unique = clean.filter("status = 'ok'").groupBy("url").agg(F.min("text").alias("text"))
    chunks = materialize(
        chunk_documents(unique, settings.chunk_tokens, settings.sentence_sep, settings.separator_tokens)
    )
    requests = extract_requests(chunks, settings.extraction_model)
    extracts = materialize(
        valid_extracts(attach_responses(requests.drop("prompt", "system"), ask(requests, responder, settings.retries))).select(
            "url", "chunk_no", "outcome", "analysis"
        )
    )

    # Extracts follow the order pages were found in, then their place on the
    # page. Only keys are numbered; the texts are joined once they have a place.
    read = corpus.select("seed_id", "url", "depth")
    kept = extracts.filter("outcome = 'kept'").select("url", "chunk_no", "analysis")
    places = lookup_join(read, kept.select("url", "chunk_no"), ["url"], ["seed_id"], "inner")
    numbered = with_sequence(places, ["seed_id"], ["depth", "url", "chunk_no"])
    titled = lookup_join(numbered, seeds.select("seed_id", "topic"), ["seed_id"], ["url"], "inner", counted=read)
    texts = lookup_join(titled, kept, ["url", "chunk_no"], ["seed_id"], "inner", counted=places).select(
        F.col("seed_id").cast("string").alias("topic"), F.col("topic").alias("name"), "seq",
        F.col("analysis").alias("text"),
    )
    named = seeds.select(
        F.col("seed_id").cast("string").alias("_seed"), F.col("topic").alias("_topic"),
        F.col("start_url").alias("source_url"), url_netloc(F.col("start_url")).alias("domain"),
    )
    merged = materialize(merge_topics(texts, responder, settings.merge_model, settings.max_merge_levels, merge_limit, settings.retries))
    documents = merged.filter("status = 'done'").join(named, F.col("topic") == F.col("_seed")).select(
        F.col("_seed").alias("seed_id"), F.col("_topic").alias("topic"), "domain", "source_url", "level",
        F.col("text").alias("body"),
    )
    documents = materialize(documents)

    to_rate = rating_requests(
        documents.select(F.col("seed_id").alias("topic"), F.col("topic").alias("name"), F.col("body").alias("text")), settings.rating_model
    )
    ratings = parse_ratings(attach_responses(to_rate.drop("prompt", "system"), ask(to_rate, responder, settings.retries)))
    # Written, so that a second action does not ask the model again.
    ratings = materialize(ratings.withColumnRenamed("topic", "seed_id").join(documents.select("seed_id", "topic", "domain"), "seed_id"))

    kept_tokens = texts.groupBy(F.col("topic").alias("seed_id")).agg(
        F.sum(count_tokens(F.col("text"))).alias("input_tokens")
    )
    steps = (
        token_totals(clean.withColumn("seed_id", F.col("seed_id").cast("string")), ["seed_id"])
        .select("seed_id", F.lit("extraction").alias("step"), F.col("joined_tokens").alias("input_tokens"))
        .unionByName(kept_tokens.select("seed_id", F.lit("merge").alias("step"), "input_tokens"))
    )
    return CorpusReport(
        corpus=corpus,
        crawl_log=crawl_log,
        crawl_counts=crawl_summary(crawl_log),
        clean_counts=clean_summary(clean, ["seed_id"]),
        chunks=chunks,
        extracts=extracts,
        extract_counts=extract_summary(extracts),
        costs=cost_estimate(steps, settings),
        merges=merged.select(F.col("topic").alias("seed_id"), "level", "status"),
        documents=documents,
        ratings=ratings,
    )


def write_report(
    report: CorpusReport,
    directory: str,
    generated_at: str,
    settings: Settings = Settings(),
    save_raw: bool = False,
    skip_compilation: bool = False,
    rating_per_document: bool = False,
) -> None:
    """Write a report's files below a directory that all executors reach.

    output/ has one text per document, output_quality/ the ratings (as lines, or as one file per document), output_raw/
    the kept pages if asked for, and documentation/ all texts of output/ in one.
    """
    spark = report.documents.sparkSession
    output = f"{directory.rstrip('/')}/output"
    write_documents(report.documents.select("topic", "domain", "source_url", "body"), output, generated_at, settings)
    write_ratings(report.ratings, f"{directory.rstrip('/')}/output_quality", rating_per_document)
    if save_raw:
        write_raw(report.corpus, f"{directory.rstrip('/')}/output_raw")
    if not skip_compilation and not report.documents.isEmpty():
        compiled = f"{directory.rstrip('/')}/documentation"
        write_compiled(read_documents(spark, output), compiled, generated_at, output)
