"""Asking a model once: answers are written with their attempt, and only what failed is asked again."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.operators.storage import materialize
from pageloom.settings import Settings

Responder = Callable[[DataFrame], DataFrame]


def ask(requests: DataFrame, responder: Responder, retries: int = Settings.retries) -> DataFrame:
    """responses(request_id, text, error, attempt), one for each of requests(request_id, …).

    responder turns a request table into a response table (request_id, text,
    error), with one row a request at most. What it says is written before it is
    read, so no later action calls it again. Requests with an error or without a
    row are asked again, up to `retries` times; then the last error stands,
    or `no answer`. The calls are spread as the requests are; a request answered
    without an error is never asked again, an empty answer is an answer.
    """
    answered: list[DataFrame] = []
    asked = requests
    for attempt in range(1, retries + 2):
        said = materialize(responder(asked).select("request_id", "text", "error").withColumn("attempt", F.lit(attempt)))
        answered.append(said.filter("error IS NULL"))
        known = reduce(DataFrame.unionByName, answered).select("request_id")
        left = requests.join(known, "request_id", "left_anti")
        if left.select("request_id").isEmpty():
            return reduce(DataFrame.unionByName, answered)
        asked = left
    failed = left.select("request_id").join(said.select("request_id", "error"), "request_id", "left").select(
        "request_id", F.lit(None).cast("string").alias("text"), F.coalesce("error", F.lit("no answer")).alias("error"), F.lit(retries + 1).alias("attempt"))
    return reduce(DataFrame.unionByName, answered).unionByName(failed)
