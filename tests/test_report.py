import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from pageloom.operators.requests import echo_responses
from pageloom.plans.report import build_corpus_report, write_report
from pageloom.settings import Settings


def answers(requests):
    """Extracts are the prompt, ratings are fixed; chunks that hold `secret` fail."""
    rating = F.lit("**Overall Quality Rating:** 7\n**Justification:**\nClear.\n**Suggestions for Improvement:**\nNone.")
    text = F.when(F.col("step") == "rate", rating).otherwise(F.col("prompt"))
    failed = (F.col("step") == "extract") & F.col("prompt").contains("secret")
    return requests.select(
        "request_id", text.alias("text"), F.when(failed, "refused").alias("error")
    )


@pytest.fixture(scope="module")
def report(spark):
    def page(text, *links):
        return f"<h1>{text}</h1><p>{text} body</p>" + "".join(f"<a href='{x}'>x</a>" for x in links)

    pages = spark.createDataFrame(
        [("http://h.com/d/a", page("first page", "b", "c")), ("http://h.com/d/b", page("second page")), ("http://h.com/d/c", page("secret page"))],
        "url string, html string",
    )
    files = spark.createDataFrame(
        [("o", "r", f"{i}.md", f"https://github.com/o/r/blob/{i}.md", f"# File {i}\n\nwords of file {i}") for i in range(3)],
        "owner string, repo string, path string, html_url string, content string",
    )
    seeds = spark.createDataFrame(
        [("s1", "http://h.com/d/a", "Topic One"), ("s2", "http://h.com/d/b", "Topic Two"), ("s3", "https://github.com/o/r", "Topic One"),
         ("s4", "http://h.com/none", "Nothing")],
        "seed_id string, start_url string, topic string",
    )
    return build_corpus_report(seeds, pages, files, answers, Settings(chunk_tokens=5))


def test_documents(report):
    docs = {r.seed_id: r for r in report.documents.collect()}
    assert sorted(docs) == ["s1", "s2", "s3"]
    assert docs["s1"].topic == docs["s3"].topic == "Topic One" and docs["s1"].domain == "h.com"
    body = docs["s1"].body
    assert body.index("first page") < body.index("second page") and "secret" not in body and "Topic One" in body
    assert [docs["s3"].body.index(f"words of file {i}") for i in range(3)] == sorted(docs["s3"].body.index(f"words of file {i}") for i in range(3))


def test_shared_pages_are_chunked_once(report):
    assert report.chunks.groupBy("url", "chunk_no").count().filter("count > 1").count() == 0
    assert report.corpus.filter("url = 'http://h.com/d/b'").count() == 2


def test_counts(report):
    crawl = {r.seed_id: r for r in report.crawl_counts.collect()}
    assert crawl["s1"].n_passed == 3 and crawl["s4"].n_failed == 1 and crawl["s3"].n_passed == 3
    clean = {r.seed_id: r for r in report.clean_counts.collect()}
    assert clean["s1"].n_processed == 3
    outcomes = {r.outcome: r.n for r in report.extract_counts.collect()}
    assert outcomes["failed"] >= 1 and outcomes["kept"] == report.chunks.count() - outcomes["failed"]
    costs = report.costs.filter("seed_id = 's1'").collect()
    assert {(c.step, c.option) for c in costs} == {("extraction", 1), ("extraction", 2), ("merge", 1), ("merge", 2)}
    assert all(c.cost_usd > 0 for c in costs)


def test_ratings(report):
    rated = report.ratings.collect()
    assert {r.seed_id for r in rated} == {"s1", "s2", "s3"}
    assert {(r.rating_score, r.rating_suggestions) for r in rated} == {(7, "*\nNone.")}


def test_report_is_written(spark, report, tmp_path):
    write_report(report, str(tmp_path), "NOW", save_raw=True)
    names = sorted(os.listdir(tmp_path / "output"))
    assert names == ["topic_one_github.com.txt", "topic_one_h.com.txt", "topic_two_h.com.txt"]
    compiled = "".join(p.read_text("utf-8") for p in sorted((tmp_path / "documentation").glob("part-*")))
    at = [compiled.index(f"Source File: {n}") for n in names]
    assert at == sorted(at) and compiled.endswith("=\n")
    assert spark.read.json(str(tmp_path / "output_quality")).count() == 3
    assert spark.read.parquet(str(tmp_path / "output_raw")).count() == report.corpus.count()


def test_a_rating_file_for_each_document(report, tmp_path):
    write_report(report, str(tmp_path), "NOW", skip_compilation=True, rating_per_document=True)
    names = sorted(os.listdir(tmp_path / "output_quality"))
    assert names == [n.replace(".txt", "_quality_assessment.json") for n in sorted(os.listdir(tmp_path / "output"))]


def test_entry_gives_documents(spark):
    df = contract.entry(spark)
    assert df.columns == ["seed_id", "topic", "domain", "source_url", "level", "n_chars", "body"]
    assert df.count() > 0


def test_echo_keeps_to_the_cap(spark):
    df = spark.createDataFrame([("a", "p" * 50, 5), ("b", "p" * 5000, None)], "request_id string, prompt string, max_completion int")
    assert {r.request_id: len(r.text) for r in echo_responses(df).collect()} == {"a": 20, "b": 4000}


def test_topics_become_the_vectors_of_the_crawl(spark):
    """Seeds without topics are named, their names embedded, and pages far from them are left out; all topics have an end."""
    pages = spark.createDataFrame(
        [("http://h.com/d/a", "<h1>Cats at Home</h1><p>about cats and more cats in the house</p><a href=b>b</a><a href=c>c</a>"),
         ("http://h.com/d/b", "<p>cats again and again and again</p>"), ("http://h.com/d/c", "<p>only dogs here and nothing else</p>")],
        "url string, html string")
    embedded = []

    def embed(texts):
        embedded.extend(r.text for r in texts.collect())
        return texts.select("text", F.when(F.col("text").contains("Cats"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).cast("array<float>").alias("vector"))

    vectors = spark.createDataFrame(
        [("http://h.com/d/a", [1.0, 0.0]), ("http://h.com/d/b", [0.9, 0.1]), ("http://h.com/d/c", [0.0, 1.0])], "url string, vector array<float>")
    files = spark.createDataFrame([], "owner string, repo string, path string, html_url string, content string")
    seeds = spark.createDataFrame([("s", "http://h.com/d/a", None), ("t", "http://h.com/d/c", "Dogs")], "seed_id string, start_url string, topic string")

    def answer(requests):
        return answers(requests).withColumn("error", F.when(F.col("text").contains("Beginning of the web page"), "refused").otherwise(F.col("error")))

    report = build_corpus_report(seeds, pages, files, answer, vectors=vectors, embedder=embed)
    assert sorted(embedded) == ["Cats at Home", "Dogs"]
    assert {(r.seed_id, r.url[-1], r.status) for r in report.crawl_log.collect()} == {
        ("s", "a", "passed"), ("s", "b", "passed"), ("s", "c", "filtered"), ("t", "c", "passed")}
    assert {r.seed_id: r.status for r in report.merges.collect()} == {"s": "done", "t": "done"}
    assert {r.seed_id: r.topic[:4] for r in report.documents.collect()} == {"s": "Cats", "t": "Dogs"}
