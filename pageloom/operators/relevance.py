"""Scoring texts against topics and keeping those that are close enough."""

from __future__ import annotations

from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import WS_CLASS, one_line, truncate_tokens
from pageloom.functions.vectors import cosine, norm
from pageloom.operators.joins import lookup_join


def score_topics(vectors: DataFrame, topics: DataFrame, key: str = "topic_id", spread_by: str = "vec_id") -> DataFrame:
    """vectors(topic_id, vector, …) with the cosine to topics(topic_id, topic_vector).

    The join is on the topic each row belongs to. Spark broadcasts the topics
    when they are small; a topic with a large share of the rows is spread.
    """
    measured = topics.select(key, "topic_vector", norm(F.col("topic_vector")).alias("_norm"))
    joined = lookup_join(vectors, measured, [key], [spread_by])
    score = cosine(F.col("vector"), F.col("topic_vector"), F.col("_norm"))
    return joined.withColumn("score", score).drop("topic_vector", "_norm")


def relevance_columns(
    has_text: Column, vector: Column | None, topic_vector: Column | None, threshold: float
) -> tuple[Column, Column]:
    """(status, score): passed or filtered, and the cosine where one was computed.

    Without vectors, or with a threshold above 1, all that has text passes.
    """
    if threshold > 1.0 or vector is None or topic_vector is None:
        return F.when(has_text, "passed").otherwise("filtered"), F.lit(None).cast("double")
    no_vector = F.coalesce(F.size(vector), F.lit(0)) <= 0
    score = F.when(has_text & topic_vector.isNotNull() & ~no_vector, cosine(vector, topic_vector))
    status = (
        F.when(~has_text, "filtered")
        .when(topic_vector.isNull(), "passed")
        .when(no_vector, "filtered")
        .when(score >= threshold, "passed")
        .otherwise("filtered")
    )
    return status, score


def relevance_filter(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """df(text, vector, topic_vector, …) with status and score.

    Empty text is filtered. A threshold above 1 or a missing topic vector lets
    all else pass; a missing text vector is filtered.
    """
    has_text = F.coalesce(F.col("text"), F.lit("")) != ""
    status, score = relevance_columns(has_text, F.col("vector"), F.col("topic_vector"), threshold)
    return df.withColumn("status", status).withColumn("score", score)


def text_vectors(docs: DataFrame, dims: int = 256, max_tokens: int | None = None, idf: bool = False) -> DataFrame:
    """docs(text, …) with a unit `vector` of hashed word counts.

    A lexical stand-in for vectors from an outside service; its scores are not
    the service's. Newlines become spaces. The whole text counts; with max_tokens
    (8190 for the service) it is cut to these first. idf=True weighs words by
    rarity, which takes one more pass over the texts.
    """
    text = one_line(F.col("text"))
    text = F.lower(truncate_tokens(text, max_tokens) if max_tokens else text)
    words = F.filter(F.split(text, rf"[{WS_CLASS}]+"), lambda w: w != "")
    counted = HashingTF(numFeatures=dims, inputCol="_words", outputCol="_tf").transform(
        docs.withColumn("_words", F.coalesce(words, F.array().cast("array<string>")))
    )
    weighed = "_tf"
    if idf:
        weighed = "_weighed"
        counted = IDF(inputCol="_tf", outputCol=weighed).fit(counted).transform(counted)
    unit = Normalizer(p=2.0, inputCol=weighed, outputCol="_unit").transform(counted)
    return unit.withColumn("vector", vector_to_array(F.col("_unit"), "float32")).drop("_words", "_tf", "_weighed", "_unit")
