"""Merging extracts into one text per topic, level by level, under a token limit.

Nothing is cut on the way. Texts that a request has no room for are split into
numbered parts beforehand; a batch that keeps to the limit of the plan, which
counts bare texts, but with a mark for each text would not fit into a request, is
planned again with the marks counted. So a batch is bounded in characters and in
parts, and it is put together from a sorted partition, one batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import count_tokens
from pageloom.operators.batches import plan_batches
from pageloom.operators.ledger import ask
from pageloom.operators.requests import (
    MAX_NAME_CHARS,
    NEXT_MARK,
    NEXT_TITLE,
    RAW_MARK,
    RAW_TITLE,
    attach_responses,
    merge_requests,
    merge_room,
)
from pageloom.operators.sequence import with_sequence
from pageloom.operators.storage import materialize
from pageloom.settings import Settings, context_tokens

# Tokens of a request's text that are kept for its title.
TITLE_TOKENS = -(-(max(len(RAW_TITLE), len(NEXT_TITLE)) + MAX_NAME_CHARS) // 4)


def batch_limit(model: str) -> int:
    """Tokens a merge batch may hold: 80 % of the model's context."""
    return int(context_tokens(model) * 0.80)


def merge_plan(texts: DataFrame, model: str = Settings.merge_model, level: int = 0, limit: int | None = None) -> DataFrame:
    """merge_plan(topic, level, seq, n_tokens, batch_no) of texts(topic, seq, n_tokens)."""
    plan = plan_batches(texts, limit or batch_limit(model))
    return plan.select("topic", F.lit(level).alias("level"), "seq", "n_tokens", "batch_no")


def charged_tokens(text: Column, level: int = 0) -> Column:
    """Tokens of a text and its mark in a request, rounded up, so that a sum of them is never too low."""
    mark = len(RAW_MARK if level == 0 else NEXT_MARK)
    return F.floor((F.coalesce(F.length(text), F.lit(0)) + mark + 3) / 4)


def part_room(model: str = Settings.merge_model, completion: int = Settings.merge_completion) -> int:
    """Charged tokens that a request has room for, beside its title."""
    return max(1 + len(RAW_MARK) // 4, merge_room(model, completion) - TITLE_TOKENS)


def _part_chars(room: int) -> int:
    return 4 * room - max(len(RAW_MARK), len(NEXT_MARK))


def _charged_in_parts(text: Column, room: int) -> Column:
    """What a text will be charged on the next level, where it is split if it is above the room."""
    size = _part_chars(room)
    full = F.floor((F.length(text) - 1) / size)
    return full * ((size + len(NEXT_MARK) + 3) // 4) + F.floor((F.length(text) - full * size + len(NEXT_MARK) + 3) / 4)


def text_parts(texts: DataFrame, room: int) -> DataFrame:
    """texts(…, text) with `part`: a text above the room in several numbered rows, any other in one."""
    size = _part_chars(room)
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / size).cast("int"))
    numbered = texts.withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))
    piece = F.when(F.length("text") <= size, F.col("text")).otherwise(F.substring("text", F.col("part") * size + 1, F.lit(size)))
    return numbered.withColumn("text", piece)


def finer_batches(placed: DataFrame, over: DataFrame, room: int) -> DataFrame:
    """placed(topic, seq, part, n_charged, batch_no) with the batches of over(topic, batch_no) planned on charged tokens.

    batch_no stays dense in each topic; later batches move on.
    """
    inside = F.concat(F.col("batch_no").cast("string"), F.lit(":"), F.col("topic"))
    again = placed.join(over, ["topic", "batch_no"], "left_semi").select(inside.alias("topic"), "seq", "part", F.col("n_charged").alias("n_tokens"))
    finer = plan_batches(again, room).select(F.col("topic").alias("_inside"), "seq", "part", F.col("batch_no").alias("_sub"))
    marked = placed.withColumn("_inside", inside).join(finer, ["_inside", "seq", "part"], "left").drop("_inside").fillna(0, ["_sub"])
    marked = materialize(marked)
    order = with_sequence(marked.select("topic", "batch_no", "_sub").distinct(), ["topic"], ["batch_no", "_sub"], "_new")
    return marked.join(order, ["topic", "batch_no", "_sub"]).drop("batch_no", "_sub").withColumnRenamed("_new", "batch_no")


_BATCH = ("topic", "level", "batch_no")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, a batch at a time: its texts under a title, each after a mark."""
    key, held, schema = None, {}, None

    def out() -> pa.RecordBatch:
        title, mark = (RAW_TITLE, RAW_MARK) if held["level"] == 0 else (NEXT_TITLE, NEXT_MARK)
        text = title + (held["name"] or "")[:MAX_NAME_CHARS] + "".join(mark + t for t in held["texts"])
        row = {c: held[c] for c in ("topic", "name", "level", "batch_no", "n_texts")}
        row |= {"n_parts": len(held["texts"]), "n_chars": sum(map(len, held["texts"])), "text": text, "first_text": held["texts"][0]}
        row["n_charged"] = sum((len(t) + len(mark) + 3) // 4 for t in held["texts"])
        return pa.RecordBatch.from_pylist([row], schema=schema)

    for batch in batches:
        if schema is None:
            fields = [batch.schema.field(c) for c in ("topic", "name", "level", "batch_no")]
            schema = pa.schema([*fields, *((c, pa.int64()) for c in ("n_texts", "n_parts", "n_chars", "n_charged")), ("text", pa.string()), ("first_text", pa.string())])
        for row in batch.to_pylist():
            if (row["topic"], row["level"], row["batch_no"]) != key:
                if held:
                    yield out()
                key, held = (row["topic"], row["level"], row["batch_no"]), row | {"texts": [], "n_texts": 0}
            held["texts"].append(row["text"] or "")
            held["n_texts"] += row["part"] == 0
    if held:
        yield out()


def join_texts(batches: DataFrame) -> DataFrame:
    """The texts of each batch under a title: batches(topic, level, batch_no, seq, text[, part][, name]).

    name is what the topic is called, by default the topic itself. n_texts
    counts the texts that begin in a batch, n_parts, n_chars and n_charged what it holds. The
    rows of a batch meet sorted, and only one batch is held at a time.
    """
    if "name" not in batches.columns:
        batches = batches.withColumn("name", F.col("topic"))
    if "part" not in batches.columns:
        batches = batches.withColumn("part", F.lit(0))
    rows = batches.select("topic", "name", "level", "batch_no", "seq", "part", "text")
    rows = rows.repartition(*_BATCH).sortWithinPartitions(*_BATCH, "seq", "part")
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("topic", "name", "level", "batch_no")}
    return rows.mapInArrow(
        _joined, ", ".join(f"{c} {t}" for c, t in kind.items()) + ", n_texts bigint, n_parts bigint, n_chars bigint, n_charged bigint, text string, first_text string",
    )


def plan_requests(
    texts: DataFrame, level: int = 0, model: str = Settings.merge_model, limit: int | None = None, completion: int = Settings.merge_completion,
) -> DataFrame:
    """The batches of texts(topic, name, seq, text), joined and written, of which each fits into a request whole.

    They are those of the plan on bare texts, unless one with its marks exceeds the room.
    """
    room = part_room(model, completion)
    parts = text_parts(texts, room)
    keys = ["topic", "seq", "part"]
    sized = parts.select(*keys, count_tokens(F.col("text")).alias("n_tokens"), charged_tokens(F.col("text"), level).alias("n_charged"))
    plan = plan_batches(sized, min(limit or batch_limit(model), room)).select(*keys, "batch_no")
    joined = materialize(join_texts(parts.join(plan, keys).withColumn("level", F.lit(level))))
    over = joined.filter(F.col("n_charged") > room).select("topic", "batch_no")
    if over.isEmpty():
        return joined
    placed = finer_batches(materialize(sized.join(plan, keys).select(*keys, "n_charged", "batch_no")), over, room)
    return materialize(join_texts(parts.join(placed.select(*keys, "batch_no"), keys).withColumn("level", F.lit(level))))


def merge_coverage(batches: DataFrame, requests: DataFrame) -> DataFrame:
    """By topic: texts and characters that went into batches, marks and characters found in the prompts, characters cut.

    `requests` are those of the batches; marks and characters are counted in the prompts themselves.
    """
    mark = F.when(F.col("level") == 0, RAW_MARK).otherwise(NEXT_MARK)
    held = requests.select("topic", "level", "batch_no", "prompt", "n_chars_cut").join(
        batches.select("topic", "level", "batch_no", "n_texts", "n_parts", "n_chars"), list(_BATCH))
    marks = (F.length("prompt") - F.length(F.replace("prompt", mark, F.lit("")))) / F.length(mark)
    found = held.withColumn("_marks", marks.cast("bigint"))
    return found.groupBy("topic").agg(
        F.count(F.lit(1)).alias("n_batches"), F.sum("n_texts").alias("n_texts"), F.sum("n_parts").alias("n_parts"), F.sum("n_chars").alias("n_chars"),
        F.sum("_marks").alias("n_marks"), F.sum(F.length("prompt").cast("bigint")).alias("n_prompt_chars"), F.sum("n_chars_cut").alias("n_chars_cut"),
    )


def merge_topics(
    extracts: DataFrame,
    responder: Callable[[DataFrame], DataFrame],
    model: str = Settings.merge_model,
    max_levels: int | None = None,
    limit: int | None = None,
    retries: int = Settings.retries,
) -> DataFrame:
    """topics(topic, level, status, text) from extracts(topic, seq, text[, name]); all topics advance together.

    On each level a topic with one text is done, one whose texts fit into one
    request is merged for the last time, and any other is merged batch by batch.
    Failed batches drop out. Every topic with a text ends with one row: done with
    its text; failed if no batch was answered; stuck if a level does not lessen
    its tokens, marks counted, or is the last of max_levels. Since these shrink on
    each level, the loop ends. responder turns a request table into a response
    table and is called once a level, and again for what failed; see ask.
    """
    spark = extracts.sparkSession
    ends: list[DataFrame] = []
    named = extracts if "name" in extracts.columns else extracts.withColumn("name", F.col("topic"))
    texts = named.select("topic", "name", "seq", "text").filter(F.coalesce(F.col("text"), F.lit("")) != "")
    level = 0
    while max_levels is None or level < max_levels:
        batches = plan_requests(texts, level, model, limit)
        topics = batches.groupBy("topic").agg(
            F.count(F.lit(1)).alias("n_batches"), F.sum("n_texts").alias("n_texts"), F.sum("n_charged").alias("n_charged"))

        # A topic has reached its last step when its texts make one batch. Only
        # first batches are joined, so a topic of many batches is no hot key.
        state = topics.select("topic", (F.col("n_batches") == 1).alias("is_last"), (F.col("n_texts") == 1).alias("is_single"))
        first = batches.filter("batch_no = 0").join(state, "topic")
        later = batches.filter("batch_no > 0").withColumns({"is_last": F.lit(False), "is_single": F.lit(False)})
        ends.append(first.filter("is_single AND is_last").select(
            "topic", F.lit(level).alias("level"), F.lit("done").alias("status"), F.col("first_text").alias("text")))
        # A single text in several parts is done too; it is taken whole.
        whole = state.filter("is_single AND NOT is_last").select("topic")
        if not whole.isEmpty():
            whole = materialize(whole)
            ends.append(texts.join(whole, "topic", "left_semi").select("topic", F.lit(level).alias("level"), F.lit("done").alias("status"), "text"))
            later = later.join(whole, "topic", "left_anti")
        asked = first.filter("NOT is_single").unionByName(later)
        requests = merge_requests(asked, model)
        marked = requests.select("request_id", "topic", "level", "batch_no").join(asked.select("topic", "name", "batch_no", "is_last"), ["topic", "batch_no"])
        answered = materialize(
            attach_responses(marked, ask(requests, responder, retries))
            .filter(F.col("response").isNotNull())
            .select("topic", "name", "level", "batch_no", "is_last", F.col("response").alias("text"))
        )
        ends.append(answered.filter("is_last").select("topic", "level", F.lit("done").alias("status"), "text"))

        left = answered.groupBy("topic").agg(F.max("is_last").alias("is_last"), F.sum(_charged_in_parts(F.col("text"), part_room(model))).alias("n_next"))
        open_topics = topics.filter("n_texts > 1").join(left, "topic", "left")
        verdict = (
            F.when(F.col("n_next").isNull(), "failed").when(F.col("is_last"), "done")
            .when((F.col("n_next") >= F.col("n_charged")) | F.lit(level + 1 == max_levels), "stuck").otherwise("open")
        )
        judged = open_topics.select("topic", verdict.alias("status")).filter("status <> 'done'")
        found = {r["status"] for r in judged.select("status").distinct().collect()}  # three at most
        judged = materialize(judged) if found else judged
        if found - {"open"}:
            ends.append(judged.filter("status <> 'open'").select("topic", F.lit(level).alias("level"), "status", F.lit(None).cast("string").alias("text")))
        if "open" not in found:
            break
        still = judged.filter("status = 'open'").select("topic")
        texts = answered.join(still, "topic", "left_semi").select("topic", "name", F.col("batch_no").alias("seq"), "text")
        level += 1
    if not ends:
        return spark.createDataFrame([], "topic string, level int, status string, text string")
    return reduce(DataFrame.unionByName, ends)


def merge_levels(
    extracts: DataFrame,
    responder: Callable[[DataFrame], DataFrame],
    model: str = Settings.merge_model,
    max_levels: int | None = Settings.max_merge_levels,
    limit: int | None = None,
) -> DataFrame:
    """documents(topic, level, text): the topics of merge_topics that are done."""
    return merge_topics(extracts, responder, model, max_levels, limit).filter("status = 'done'").select("topic", "level", "text")
