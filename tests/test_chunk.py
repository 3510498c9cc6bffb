"""Chunks against a plain second implementation and by their properties."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.operators.chunk import chunk_documents

END = re.compile(r"\n---\nCODE BLOCK:.*?\n---\n|\n\n+", re.S)


def size(text):
    return len(text) // 4


def paragraphs(text):
    at = 0
    for match in END.finditer(text):
        yield text[at : match.end()].strip()
        at = match.end()
    yield text[at:].strip()


def packed(parts, limit, gap, glue):
    """Greedy groups of parts; a part above the limit is a group of its own."""
    groups, room = [], None
    for part in parts:
        need = size(part) + (gap if room is not None else 0)
        if room is not None and need <= room:
            groups[-1].append(part)
            room -= need
        else:
            groups.append([part])
            room = limit - size(part) if size(part) <= limit else None
    return [glue.join(g) for g in groups]


def slices(part, limit):
    """A part above the limit in parts of the limit."""
    return [part[k : k + 4 * limit] for k in range(0, len(part), 4 * limit)] if size(part) > limit else [part]


def expected(text, limit, glue, gap, strict=False):
    out, run = [], []
    for paragraph in filter(None, paragraphs(text)):
        if size(paragraph) <= int(limit * 1.2):
            run.append(paragraph)
            continue
        out += packed(run, limit, gap, "\n\n")
        run = []
        parts, between = re.split(r"(?<=[.!?])\s+", paragraph), glue
        if len(parts) < 2:
            parts, between = paragraph.splitlines(keepends=True), ""
        if not strict:
            parts = [s for part in parts for s in slices(part, limit)]
        for group in packed(parts, limit, 0, between):
            # Only a single part can exceed the limit here.
            whole = size(group) > limit and group in parts
            out.append((group[: 4 * limit] if whole else group).strip())
    return out + packed(run, limit, gap, "\n\n")


def chunked(spark, texts, limit, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for row in chunk_documents(df, limit, **options).collect():
        got.setdefault(row.id, {})[row.chunk_no] = row
    return [[got[i][n] for n in range(len(got.get(i, {})))] for i in range(len(texts))]


def check(spark, texts, limit, glue=" ", gap=0, strict=False):
    got = chunked(spark, texts, limit, sentence_sep=glue, separator_tokens=gap, strict=strict)
    for text, rows in zip(texts, got):
        assert [r.text for r in rows] == expected(text, limit, glue, gap, strict), text
        squashed = re.sub(r"\s", "", "".join(r.text for r in rows))
        assert strict or (squashed == re.sub(r"\s", "", text) and not any(r.n_chars_lost for r in rows)), text
        assert [r.n_tokens for r in rows] == [size(r.text) for r in rows]


SENTENCE = "Word word word. "
CODE = "\n---\nCODE BLOCK:\nx = 1\n\ny = 2\n---\n"


def test_edges(spark):
    ten = "x" * 40  # ten tokens
    texts = [
        "", " \n\n ", ten, f"{ten}\n\n{ten}", f"{ten}\n\n{ten}\n\nabcd", "y" * 44, "y" * 48, "y" * 49,
        f"{ten}\n\n" + SENTENCE * 20 + f"\n\n{ten}", SENTENCE * 20 + "\n\nab", "ab\n\n" + SENTENCE * 20,
        "line\n" * 40, "z" * 500, "z" * 500 + ". " + "short end here", f"a{CODE}b{CODE}{CODE}c", "One.  Two!\tThree? " * 9,
        " nbsp \n\n em", "a\x01b\n\nc",
    ]
    texts = [t.replace("\x01", "") for t in texts]
    for limit in (10, 20):
        check(spark, texts, limit)
        check(spark, texts, limit, "", 1)
        check(spark, texts, limit, strict=True)


def test_long_texts_span_strides(spark):
    sentence = "Some words in a sentence here. "
    texts = [
        "".join(sentence[: 5 + i % 27] + ". " for i in range(1700)), "".join(f"{sentence}{i}\n\n" for i in range(1600)),
        "\n\n".join(sentence * (1 + 9 * (i % 5 == 0)) for i in range(700)), "x" * 3 + "\n\n" + "y. " * 2000,
    ]
    check(spark, texts, 20)
    check(spark, texts, 150, "", 1)


def test_strict_counts_lost_characters(spark):
    (rows,) = chunked(spark, ["z" * 500], 10, strict=True)
    assert [(r.text, r.n_chars_lost) for r in rows] == [("z" * 40, 460)]
    (rows,) = chunked(spark, ["z" * 500], 10)
    assert [(r.text, r.n_chars_lost) for r in rows] == [("z" * 40, 0)] * 12 + [("z" * 20, 0)]


def test_other_columns_are_kept(spark):
    df = spark.createDataFrame([(1, "a", "one\n\ntwo")], "id int, k string, text string")
    assert chunk_documents(df, 7000).first().asDict() == {
        "id": 1, "k": "a", "chunk_no": 0, "text": "one\n\ntwo", "n_tokens": 2, "n_chars_lost": 0
    }


PIECES = st.lists(
    st.sampled_from(["word ", "Stop. ", "Ask? ", "\n", "\n\n", "\n\n\n", CODE, "long" * 12, "\t", "é", ".", "\r\n"]),
    max_size=60,
).map("".join)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(PIECES, min_size=40, max_size=80), st.integers(3, 30), st.integers(0, 2))
def test_random_texts(spark, texts, limit, gap):
    check(spark, texts, limit, " ", gap)


def test_properties_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = chunk_documents(docs, 50).collect()
    # Each part's estimate is rounded down, so a chunk may hold one token more per part.
    assert all(r.n_tokens <= 60 + len(re.split(r"[.!?\n]\s*", r.text)) for r in rows)
    squash = lambda t: re.sub(r"\s", "", t)
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.chunk_no)):
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc in docs.collect():
        parts = by_doc.get(doc.doc_id, [])
        assert squash("".join(p.text for p in parts)) == squash(doc.text)


def test_no_shuffle_and_no_python(spark):
    df = spark.range(3).select("id", F.lit("a").alias("text"))
    plan = chunk_documents(df, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
