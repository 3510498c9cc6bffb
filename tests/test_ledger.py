"""Asking a model: once for each request, again only for what failed."""

from pyspark.sql import functions as F

from pageloom.operators.ledger import ask
from pageloom.plans.merge import merge_topics


def counted(fails):
    """A responder that notes what it is asked, row by row; fails(column of ids, attempt) says which fail, and `lost` get no row."""
    calls = []

    def answer(requests):
        rows = sorted(r.request_id for r in requests.select("request_id").collect())
        calls.append(rows)
        said = requests.filter(F.col("request_id") != "lost")
        bad = fails(F.col("request_id"), len(calls))
        return said.select("request_id", F.when(~bad, F.concat(F.lit("to "), "request_id")).alias("text"), F.when(bad, F.concat(F.lit("no "), F.lit(len(calls)))).alias("error"))

    return answer, calls


def test_only_open_requests_are_asked_again(spark):
    requests = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "p"), ("lost", "p")], "request_id string, prompt string")
    answer, calls = counted(lambda id_, n: (id_ == "c") | ((id_ == "b") & F.lit(n < 2)))
    said = ask(requests, answer, 2)
    expected = [("a", "to a", None, 1), ("b", "to b", None, 2), ("c", None, "no 3", 3), ("lost", None, "no answer", 3)]
    for _ in range(3):
        assert sorted(tuple(r) for r in said.collect()) == expected
    assert calls == [["a", "b", "c", "lost"], ["b", "c", "lost"], ["c", "lost"]]
    none, calls = counted(lambda id_, n: F.lit(True))
    assert ask(requests.filter("false"), none).count() == 0 and calls == [[]]
    once, calls = counted(lambda id_, n: F.lit(False))
    assert ask(requests.filter("request_id <> 'lost'"), once).count() == 3 and len(calls) == 1


def test_an_empty_answer_is_an_answer(spark):
    requests = spark.createDataFrame([("a", "p")], "request_id string, prompt string")
    calls = []

    def silent(rows):
        calls.append(1)
        return rows.select("request_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("error"))

    assert [tuple(r) for r in ask(requests, silent).collect()] == [("a", None, None, 1)] and len(calls) == 1


def test_merging_asks_once_a_level(spark):
    """Whatever is done with the result, the model is called once a level, and once more for the batch that failed."""
    df = spark.createDataFrame([("t", i, "word " * 30) for i in range(6)], "topic string, seq bigint, text string")
    calls = []

    def answer(requests):
        calls.append(requests.count())
        bad = (F.col("level") == 0) & (F.col("batch_no") == 1) & F.lit(len(calls) == 1)
        return requests.select("request_id", F.when(~bad, F.lit("short answer")).alias("text"), F.when(bad, "busy").alias("error"))

    merged = merge_topics(df, answer, limit=80)
    for _ in range(3):
        assert [r.status for r in merged.collect()] == ["done"]
    assert calls == [3, 1, 1]
