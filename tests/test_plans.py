"""Physical plans: where Python runs, what is shuffled, what is broadcast and what is read."""

import os

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import __spark_entry__ as contract
from pageloom.operators import chunk, clean, html, models, relevance
from pageloom.operators import requests as rq
from pageloom.operators.joins import estimated_bytes, lookup_join
from pageloom.operators.storage import checkpoint_dir, drop_steps, materialize, materialize_by

NO_PYTHON = (
    "page_corpus", "url_parts", "base_paths", "page_links", "relative_links", "queue_decisions", "repo_urls",
    "raw_file_names", "document_file_names", "token_counts", "squeezed_texts", "document_chunks", "cosine_scores",
    "relevance_filter", "selected_repo_items", "path_topics", "extract_requests", "extract_outcomes",
    "parsed_ratings", "model_prices", "model_limits", "cost_estimate", "joined_texts", "compiled_document",
)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NO_PYTHON)
def test_columns_stay_in_the_jvm(spark, sf, name):
    text = plan(contract.queries()[name](spark, sf))
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.fixture
def pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet")


def test_clean_to_requests_is_one_narrow_chain(pages):
    corpus = pages.select("url", F.col("html").alias("content"), F.lit("html").alias("type"))
    text = plan(rq.extract_requests(chunk.chunk_documents(clean.clean_pages(corpus).filter("status = 'ok'"))))
    assert "Exchange" not in text and text.count("ArrowEvalPython") == 1
    assert "page_id" not in text


def test_links_are_worked_out_once_without_a_shuffle(pages):
    text = plan(html.extract_links(pages))
    assert "Exchange" not in text and text.count("regexp_extract_all") == 1
    assert "ReadSchema: struct<url:string,html:string>" in text


def test_model_tables_are_broadcast(spark):
    df = spark.range(5).withColumn("model", F.concat(F.lit("gpt-4o-"), F.col("id").cast("string")))
    for joined in (models.with_model_price(df), models.with_model_limit(df)):
        assert "BroadcastHashJoin" in plan(joined)


def test_filters_reach_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("embedding", "vector")
    judged = relevance.relevance_filter(df.withColumn("text", F.lit("x")).withColumn("topic_vector", F.col("vector")))
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,3)]" in plan(judged.filter("label = 3"))


def test_spreading_depends_on_size(spark):
    rows, table = spark.range(10), spark.range(5).withColumn("v", F.lit(1))
    assert estimated_bytes(rows) < 1000
    assert "_salt" not in plan(lookup_join(rows, table, ["id"], ["id"]))
    assert "_salt" in plan(lookup_join(rows, table, ["id"], ["id"], small_bytes=0))
    with pytest.raises(ValueError):
        lookup_join(rows, table, ["id"], ["id"], "full")


def test_steps_are_written_to_the_named_folder(spark):
    df = materialize(spark.range(3))
    folder = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_dir(spark) == folder and all(folder in f for f in df.inputFiles())


def test_functions_that_write_steps_travel_without_the_sessions(spark):
    """Functions of the package are pickled by value, with the list of steps."""
    other = spark.newSession()
    materialize(other.range(3))
    travelled = cloudpickle.loads(cloudpickle.dumps((materialize, drop_steps)))
    assert travelled[1](other) == 0 and drop_steps(other) == 1


def test_steps_are_removed_on_request(spark):
    """In a session of its own: only its own tables go, the other session's stay."""
    kept = materialize(spark.range(3))
    other = spark.newSession()
    paths = [materialize(other.range(3)).inputFiles()[0], materialize_by(other.range(3), "id").inputFiles()[0]]
    assert drop_steps(other) == 2 and drop_steps(other) == 0
    assert not any(os.path.exists(p.removeprefix("file://")) for p in paths)
    assert kept.count() == 3
