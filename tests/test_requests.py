import pytest
from pyspark.sql import functions as F

from pageloom.functions.ratings import parse_rating
from pageloom.functions.topics import combine_topic, domain_topic, parse_topic, path_topic, title_case
from pageloom.functions.vectors import cosine
from pageloom.operators import requests as rq
from pageloom.operators.models import cost_estimate, token_totals, with_model_limit, with_model_price
from pageloom.operators.relevance import relevance_filter, text_vectors
from pageloom.plans.topics import infer_topics
from pageloom.settings import Settings, context_tokens

A, B, C = F.col("a"), F.col("b"), F.col("c")


def test_extract_requests(spark):
    chunks = spark.createDataFrame(
        [("u", 0, "x" * 40, 10), ("u", 1, "y", 2000), ("u", 2, "z", 99999), ("u", 3, "", 0)],
        "url string, chunk_no int, text string, n_tokens bigint",
    )
    got = {r.chunk_no: r for r in rq.extract_requests(chunks).collect()}
    assert {n: r.max_completion for n, r in got.items()} == {0: 600, 1: 800, 2: 4096}
    assert len({r.request_id for r in got.values()}) == 3 and got[0].temperature == 0.05
    assert "u" in got[0].prompt and "x" * 40 in got[0].prompt and got[0].model == "gpt-4o"


def test_templates_fill_columns_not_texts(column):
    whole = rq.fill("<{url}|{text}|{url}>{other}", url=A, text=B)
    assert column(whole, ("{text}", "{url}")) == ["<{text}|{url}|{text}>{other}"]


def test_rating_and_topic_requests_cut_the_text(spark):
    docs = spark.createDataFrame([("t", "q" * 500000, "u"), ("e", "", "v")], "topic string, text string, url string")
    (rating,) = rq.rating_requests(docs, "gpt-3.5-turbo").collect()
    assert rating.prompt.count("q") == 4 * 15385 and rating.max_completion is None and rating.temperature == 0.3
    (topic,) = rq.topic_requests(docs).collect()
    assert topic.prompt.count("q") == 6000 and topic.max_completion == 50


def test_merge_request_room(spark):
    joined = spark.createDataFrame([("t", 0, 0, "q" * 600000), ("t", 1, 0, "w")], "topic string, level int, batch_no int, text string")
    got = {r.level: r for r in rq.merge_requests(joined).collect()}
    assert got[0].prompt.count("q") == 4 * (128000 - 4096 - 500)
    assert got[0].system != got[1].system and got[1].max_completion == 4096


def test_outcomes(spark):
    requests = spark.createDataFrame([(str(i),) for i in range(7)], "request_id string")
    answers = spark.createDataFrame(
        [("0", "x" * 30, None), ("1", "x" * 29, None), ("2", " irrelevant\n", None), ("3", "  ", None), ("4", "y" * 50, "timeout"), ("5", None, None)],
        "request_id string, text string, error string",
    )
    extracts = rq.valid_extracts(rq.attach_responses(requests, answers))
    assert [r.outcome for r in extracts.orderBy("request_id").collect()] == [
        "kept", "too_short", "irrelevant", "failed", "failed", "failed", "failed"
    ]
    assert {r.outcome: (r.n, r.n_tokens) for r in rq.extract_summary(extracts).collect()} == {
        "kept": (1, 7), "too_short": (1, 0), "irrelevant": (1, 0), "failed": (4, 0)
    }


RATINGS = {
    "Overall Quality Rating: 8": (8, 8), "**Overall Quality Rating:** 8": (8, None), "overall quality rating - 8/10": (8, 8),
    "Overall Quality Rating: 10": (10, 10), "Overall Quality Rating: 0": (None, None), "Overall Quality Rating 8.5": (8, 8),
    "Overall Quality Rating: 11": (None, None), "nothing": (None, None),
}


def test_rating_scores(column):
    for strict in (False, True):
        got = column(parse_rating(A, strict), *RATINGS)
        assert [g.rating_score for g in got] == [v[strict] for v in RATINGS.values()]


def test_rating_sections(column):
    texts = [
        "**Justification:**\n- Good.\n**Suggestions for Improvement:**\n* Shorten.", "Suggestions for Improvement: none",
        "Justification: a", "x", None,
    ]
    got = column(parse_rating(A), *texts)
    assert [(g.rating_justification, g.rating_suggestions) for g in got[:4]] == [
        ("*\n- Good.\n**", "*\n* Shorten."), ("Justification section not found.", "none"),
        ("a", "Suggestions section not found."), ("Justification section not found.", "Suggestions section not found."),
    ]
    assert got[0].raw_rating_output == texts[0] and got[4] is None


def test_topics(column):
    assert column(title_case(A), "a-b's 3rd c", "ÉCOLE élan", "漢字abc") == ["A-B'S 3Rd C", "École Élan", "漢字Abc"]
    urls = {
        "http://x.io/docs/how-to/my-first_app": "My First App", "http://x.io/docs/api/": None, "http://x.io": None,
        "http://x.io/a%20b%2Fcd/v1+x": "A B V1+X", "http://x.io/bad%zzesc": "Bad%Zzesc",
    }
    assert column(path_topic(A), *urls) == list(urls.values())
    hosts = {
        "http://docs.python.org/": "Python", "http://my-lib.io/x": "My Lib", "http://www.com": "Www", "http://docs.x.io:80": "X",
        "http://localhost/": "Localhost", "/path": None,
    }
    assert column(domain_topic(A), *hosts) == list(hosts.values())
    rows = [("Intro", "intro", "Intro"), ("A B", "C A", "B D"), (None, None, None), (None, "Tiny", None), ("Same Page", None, "same page")]
    assert column(combine_topic(A, B, C), *rows) == [None, "A B - C D", None, None, "Same Page"]
    answers = {' "Using Streams" ': "Using Streams", "'a'": None, "abc": None, "x" * 100: None, '""""': None, "x" * 99: "x" * 99}
    assert column(parse_topic(A), *answers) == list(answers.values())


def test_inferred_topics(spark):
    pages = spark.createDataFrame(
        [("http://x.io/a", "<h1>Heading One</h1>"), ("http://x.io/b", None), ("/none", "<h1>Heading</h1>"), ("http://x.io/c", "<h1>Heading</h1>")],
        "url string, html string",
    )
    answers = spark.createDataFrame([("http://x.io/c", '"Model Topic"'), ("http://x.io/a", "no")], "url string, response string")
    got = {r.url: (r.topic, r.topic_source) for r in infer_topics(pages, answers).collect()}
    assert got == {
        "http://x.io/a": ("Heading One", "page"), "http://x.io/b": ("X", "host"), "/none": (None, None), "http://x.io/c": ("Model Topic", "model"),
    }


def test_models(spark):
    names = ["gpt-4o", "gpt-4o-mini-x", "gpt-4o-x", "gpt-4-turbo-preview", "gpt-4-turbo-2", "gpt-3.5-turbo-0125", "gpt-3.5-turbo-z", "llm", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, model string")
    limits = [r.context_tokens for r in with_model_limit(df).orderBy("i").collect()]
    assert limits == [128000] * 5 + [16385, 16385, 100000, 100000]
    assert limits[:8] == [context_tokens(n) for n in names[:8]]
    prices = {r.model: (r.input_usd, r.output_usd) for r in with_model_price(df).collect()}
    assert prices["gpt-4o"] == (5.0, 15.0) and prices["gpt-4o-x"] == (0.0, 0.0) and prices[None] == (0.0, 0.0)


def test_costs(spark):
    totals = spark.createDataFrame([("extraction", 1001), ("merge", 1001)], "step string, input_tokens bigint")
    got = {(r.step, r.option): r for r in cost_estimate(totals).collect()}
    assert got[("extraction", 1)].model == "gpt-4o" and got[("extraction", 2)].model == "gpt-4o-mini"
    assert got[("extraction", 1)].output_tokens == 350 and got[("merge", 1)].output_tokens == 400 + 340
    assert got[("merge", 1)].cost_usd == pytest.approx(1001e-6 * 5 + 740e-6 * 15)
    mini = {r.model for r in cost_estimate(totals, Settings(extraction_model="gpt-4o-mini")).filter("step = 'extraction'").collect()}
    assert mini == {"gpt-4o-mini", "gpt-4o"}


def test_token_totals(spark):
    df = spark.createDataFrame([("a" * 7,), ("b" * 5,), (None,)], "text string")
    assert token_totals(df).first().asDict() == {"n_texts": 2, "joined_tokens": 4, "sum_tokens": 2}


def test_cosine(spark):
    rows = [
        ([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [-2.0, 0.0], -1.0), ([1.0, 2.0], [2.0], 0.0), (None, [1.0], 0.0),
        ([], [], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([1.0, 1.0], [1.0, 0.0], 0.5**0.5), ([None, 1.0], [1.0, 1.0], 0.0),
        ([float("nan"), 1.0], [1.0, 1.0], 0.0),
    ]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>, e double")
    for r in df.select(cosine(A, B).alias("ab"), cosine(B, A).alias("ba"), "e").collect():
        assert r.ab == pytest.approx(r.e, abs=1e-9) and r.ab == r.ba and -1 <= r.ab <= 1


def test_relevance(spark):
    v, t = [3.0, 4.0], [1.0, 0.0]
    rows = [(1, "x", v, t), (2, "", v, t), (3, "x", None, t), (4, "x", v, None), (5, "x", [0.0, 1.0], t), (6, None, v, None)]
    df = spark.createDataFrame(rows, "i int, text string, vector array<float>, topic_vector array<float>")

    def passed(threshold):
        return [r.i for r in relevance_filter(df, threshold).filter("status = 'passed'").orderBy("i").collect()]

    assert passed(0.3) == [1, 4] and passed(0.6) == [1, 4] and passed(0.61) == [4]
    assert passed(1.1) == [1, 3, 4, 5]


def test_text_vectors(spark):
    df = spark.createDataFrame([(1, "spark joins\nfast"), (2, "Spark joins fast"), (3, "cats"), (4, "")], "i int, text string")
    for idf in (False, True):
        got = {r.i: r.vector for r in text_vectors(df, 64, idf=idf).collect()}
        assert got[1] == got[2] and len(got[1]) == 64 and set(got[4]) == {0.0}
        assert sum(x * x for x in got[1]) == pytest.approx(1, abs=1e-5)
