import random

import numpy as np
from pyspark.sql import functions as F

from pageloom.operators import batches
from pageloom.operators.batches import block_steps, enter, follow_steps, plan_batches
from pageloom.operators.requests import digest_responses, merge_requests
from pageloom.plans.merge import RAW_MARK, batch_limit, join_texts, merge_coverage, merge_levels, merge_plan, merge_topics, part_room, plan_requests


def fill(tokens, limit, open_with=None):
    """(batch number of each text, what the open batch holds at the end)."""
    room, number, numbers = (None if open_with is None else limit - open_with), -1, []
    for t in tokens:
        if room is None or t > room:
            number, room = number + 1, limit
        room = room - t if t <= limit else None
        numbers.append(number)
    return numbers, None if room is None else limit - room


def test_steps_describe_every_entry_state():
    rng = random.Random(5)
    for _ in range(800):
        limit, n = rng.randint(1, 15), rng.randint(1, 25)
        tokens = [rng.choice([0, 1, 2, rng.randint(0, 20)]) for _ in range(n)]
        cuts = sorted(rng.sample(range(1, n), min(n - 1, rng.randint(0, 4))))
        steps = None
        for part in np.split(np.array(tokens), cuts):
            own = block_steps(part, limit)
            steps = own if steps is None else follow_steps(steps, own)
        for state in range(-1, limit + 1):
            numbers, held = fill(tokens, limit, None if state < 0 else state)
            assert enter(steps, state) == (-1 if held is None else held, max(numbers[-1], -1) + 1)


def test_plan_equals_the_plain_loop_across_blocks(spark):
    rng = random.Random(7)
    texts = {t: [rng.choice([0, 3, 5, rng.randint(0, 60)]) for _ in range(rng.randint(1, 150))] for t in "abcd"}
    texts["hot"] = [rng.randint(0, 12) for _ in range(2000)]
    rows = [(t, i * (3 if t == "b" else 1), n) for t, sizes in texts.items() for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "topic string, seq bigint, n_tokens bigint")
    for block_rows, fan_in in ((65536, 32), (150, 3)):
        got = {}
        for r in sorted(plan_batches(df, 40, block_rows, fan_in).collect(), key=lambda r: r.seq):
            got.setdefault(r.topic, []).append(r.batch_no)
        assert got == {t: fill(sizes, 40)[0] for t, sizes in texts.items()}


def test_edges(spark):
    cases = {
        "one": [99], "fit": [10, 20, 10], "exact": [40, 40], "first": [41, 5, 5], "middle": [5, 41, 5], "last": [5, 41],
        "zero": [0, 0, 41, 0],
    }
    df = spark.createDataFrame([(t, i, n) for t, s in cases.items() for i, n in enumerate(s)], "topic string, seq int, n_tokens int")
    plan = merge_plan(df, limit=40)
    assert plan.columns == ["topic", "level", "seq", "n_tokens", "batch_no"]
    got = {t: [r.batch_no for r in sorted(plan.filter(plan.topic == t).collect(), key=lambda r: r.seq)] for t in cases}
    assert got == {
        "one": [0], "fit": [0, 0, 0], "exact": [0, 1], "first": [0, 1, 1], "middle": [0, 1, 2], "last": [0, 1],
        "zero": [0, 0, 1, 2],
    }
    assert batch_limit("gpt-4o") == 102400 and batch_limit("gpt-3.5-turbo-x") == 13108


def test_joined_texts_keep_their_order(spark):
    df = spark.createDataFrame(
        [("t", 0, 0, 2, "b"), ("t", 0, 0, 10, "c"), ("t", 0, 0, 1, "a"), ("t", 1, 4, 0, "d")],
        "topic string, level int, batch_no bigint, seq bigint, text string",
    )
    got = {r.level: r for r in join_texts(df).collect()}
    gap = "\n\n---\n[Extracted Chunk Details]\n---\n\n"
    assert got[0].text == f"# Raw Extracted Details for: t{gap}a{gap}b{gap}c" and got[0].n_texts == 3
    assert got[1].text == "# Intermediate Summaries for: t\n\n---\n[Intermediate Summary]\n---\n\nd"


def responder(fail=()):
    """Answers with the size of the prompt, so that each level is short; some requests fail."""
    from pyspark.sql import functions as F

    def answer(requests):
        bad = F.lit(False)
        for topic, level, batch in fail:
            bad = bad | ((F.col("topic") == topic) & (F.col("level") == level) & (F.col("batch_no") == batch))
        text = F.concat(F.lit("x" * 36), "topic", F.lit(" L"), F.col("level").cast("string"), F.lit("B"), F.col("batch_no").cast("string"))
        return requests.select("request_id", F.when(~bad, text).alias("text"), F.when(bad, "timeout").alias("error"))

    return answer


def test_levels(spark):
    texts = [("one", 0, "w" * 4000), ("fits", 0, "a" * 40), ("fits", 1, "b" * 40)]
    texts += [("deep", i, "c" * 60) for i in range(12)]
    texts += [("part", i, "d" * 100) for i in range(4)]
    texts += [("none", i, "e" * 100) for i in range(2)]
    df = spark.createDataFrame(texts, "topic string, seq bigint, text string")
    fail = [("part", 0, 1), ("none", 0, 0), ("none", 0, 1)]
    got = {r.topic: (r.level, r.text) for r in merge_levels(df, responder(fail), limit=30).collect()}
    x = "x" * 36
    assert got == {
        "one": (0, "w" * 4000), "fits": (0, f"{x}fits L0B0"), "deep": (3, f"{x}deep L3B0"), "part": (2, f"{x}part L2B0"),
    }
    assert merge_levels(df.filter("topic = 'deep'"), responder(), max_levels=3, limit=30).count() == 0


def test_names_reach_the_prompt(spark):
    seen = []

    def answer(requests):
        seen.extend(r.prompt for r in requests.collect())
        return responder()(requests)

    df = spark.createDataFrame([("k", i, "a" * 40, "Real Name") for i in range(2)], "topic string, seq bigint, text string, name string")
    assert merge_levels(df, answer).first().topic == "k"
    assert len(seen) == 1 and "Real Name" in seen[0]


def test_assignment_survives_small_arrow_batches(spark):
    df = spark.range(500).selectExpr("'t' AS topic", "id AS seq", "id % 7 AS n_tokens")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = [r.batch_no for r in batches.plan_batches(df, 20).orderBy("seq").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == fill([i % 7 for i in range(500)], 20)[0]


SMALL = "gpt-3.5-turbo"


def covered(spark, texts, limit=None):
    df = spark.createDataFrame([(t, t, i, x) for t, i, x in texts], "topic string, name string, seq bigint, text string")
    batches_ = plan_requests(df, model=SMALL, limit=limit)
    prompts = merge_requests(batches_, SMALL)
    return {r.topic: r.asDict() for r in merge_coverage(batches_, prompts).collect()}, prompts


def test_no_text_is_cut(spark):
    """Many tiny and empty-looking texts, and texts above a request's room, reach the prompts whole and in order."""
    tiny = [("tiny", i, str(i % 10)) for i in range(14_000)]
    long = [("long", i, "".join(chr(97 + (i + j) % 26) for j in range(n))) for i, n in enumerate((10, 130_000, 47_000, 3))]
    got, prompts = covered(spark, tiny + long)
    assert got["tiny"]["n_texts"] == got["tiny"]["n_marks"] == 14_000 and got["tiny"]["n_chars"] == 14_000
    assert got["long"]["n_texts"] == 4 and got["long"]["n_parts"] == got["long"]["n_marks"] > 6 and got["long"]["n_chars"] == 177_013
    assert got["tiny"]["n_chars_cut"] == got["long"]["n_chars_cut"] == 0 and got["tiny"]["n_batches"] > 10
    for topic, whole in (("tiny", "".join(x for _, _, x in tiny)), ("long", "".join(x for _, _, x in long))):
        rows = prompts.filter(F.col("topic") == topic).orderBy("batch_no").collect()
        assert [r.batch_no for r in rows] == list(range(len(rows)))
        held = [p.split('\n"""\n\nDocument:')[0] for r in rows for p in r.prompt.split(RAW_MARK)[1:]]
        assert "".join(held) == whole


def test_batches_that_fit_are_those_of_the_plain_plan(spark):
    texts = [("t", i, "x" * (37 * i % 400)) for i in range(1, 300)]
    df = spark.createDataFrame([(t, t, i, x) for t, i, x in texts], "topic string, name string, seq bigint, text string")
    plain = merge_plan(df.selectExpr("topic", "seq", "cast(length(text) / 4 as bigint) AS n_tokens"), limit=2000)
    expected = {r.batch_no: r.n for r in plain.groupBy("batch_no").agg(F.count("*").alias("n")).collect()}
    assert {r.batch_no: r.n_texts for r in plan_requests(df, limit=2000).collect()} == expected


def test_every_topic_ends(spark):
    """done, failed and stuck; a single text above the room is done as it is."""
    room = 4 * part_room(SMALL)
    texts = [("single", 0, "s" * (2 * room)), ("grows", 0, "g" * room), ("grows", 1, "h" * room), ("none", 0, "n" * 50), ("none", 1, "m" * 50)]
    texts += [("deep", i, "d" * 3000) for i in range(400)]
    df = spark.createDataFrame(texts, "topic string, seq bigint, text string")

    def answer(requests):
        text = F.when(F.col("topic") == "grows", F.repeat(F.lit("y"), room)).otherwise(F.substring("prompt", 1, 9000))
        return requests.select("request_id", text.alias("text"), F.when(F.col("topic") == "none", "refused").alias("error"))

    got = {r.topic: r for r in merge_topics(df, answer, SMALL).collect()}
    assert {t: r.status for t, r in got.items()} == {"single": "done", "grows": "stuck", "none": "failed", "deep": "done"}
    assert got["single"].text == "s" * (2 * room) and got["grows"].text is None and got["deep"].level > 1
    assert merge_levels(df, answer, SMALL).count() == 2
    few = {r.topic: r.status for r in merge_topics(df.filter("topic = 'deep'"), answer, SMALL, max_levels=1).collect()}
    assert few == {"deep": "stuck"}
    assert merge_topics(df.filter("false"), answer).count() == 0


def test_the_digest_answer_shows_the_whole_prompt(spark):
    df = spark.createDataFrame([("a", "p" * 50 + "x", 30), ("b", "p" * 50 + "y", 30)], "request_id string, prompt string, max_completion int")
    texts = [r.text for r in digest_responses(df).collect()]
    assert len(set(texts)) == 2 and all(len(t) == 87 and t.startswith("51 ") for t in texts)
