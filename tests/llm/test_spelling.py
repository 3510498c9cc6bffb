"""Spelling variants against a comparison of all words, with odd rows and divided partitions."""

import collections
import random
import re
import zlib

import pytest

from pageloom.llm import queries, spelling


def plain_counts(docs):
    counts = collections.Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_near(words):
    """Near words by what deletion and replacement at each place leave."""
    found = collections.defaultdict(set)
    masks = collections.defaultdict(list)
    for w in words:
        for i in range(len(w)):
            masks[w[:i], w[i + 1:]].append(w)
            if (short := w[:i] + w[i + 1:]) in words:
                found[w].add(short)
                found[short].add(w)
    for same in masks.values():
        for w in same:
            found[w].update(x for x in same if x != w)
    return found


def plain(words):
    near = plain_near(words)
    forms = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 10 * n:
            forms[w] = best
    rows = []
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        rows.append((w, forms.get(w), root, n, len(near[w]), words[forms[w]] if w in forms else None))
    return sorted(rows, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def test_query_against_plain_version(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    expected = plain(plain_counts(docs))
    got = rows(queries.op12_spelling_variants(spark, sf))
    assert got == expected and any(r[1] for r in got)


def random_words(seed, n, letters, lengths):
    rng = random.Random(seed)
    found = {"".join(rng.choice(letters) for _ in range(rng.choice(lengths))): rng.choice([2, 3, 30, 400, 5000]) for _ in range(n)}
    return found


@pytest.mark.parametrize("max_words, max_rest", [(4096, 64), (4, 64), (2, 1), (4096, 2)])
def test_divided_partitions(spark, max_words, max_rest):
    """Words of two letters are near to many others, in runs of equal letters too; a prefix is shared by most."""
    words = random_words(1, 400, "ab", [7, 8, 9]) | {"prefix" + w: n for w, n in random_words(2, 300, "abé", [3, 4, 5]).items()}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert rows(spelling.spelling_variants(df, max_words=max_words, max_rest=max_rest)) == plain(words)


def test_near_pairs():
    rng = random.Random(9)
    for _ in range(200):
        size = rng.randint(1, 4)
        short = sorted({"".join(rng.choice("abc") for _ in range(size)) for _ in range(rng.randint(1, 20))})
        long = sorted({"".join(rng.choice("abc") for _ in range(size + 1)) for _ in range(rng.randint(0, 20))})
        expected = {(u, v) for u in short for v in short if u < v and sum(x != y for x, y in zip(u, v)) == 1}
        expected |= {(u, v) for u in short for v in long if any(v[:i] + v[i + 1:] == u for i in range(size + 1))}
        found = list(spelling.near_pairs(short, long, True))
        assert len(found) == len(expected) and {tuple(sorted(p, key=lambda w: (len(w), w))) for p in found} == expected
        inside = list(spelling.near_pairs(short, long, False))
        assert set(inside) == {(u, v) for u, v in found if len(u) == len(v) or v[:-1] != u}


def test_acceptor_is_minimal():
    arcs, register = [{}], {}
    machine = spelling.Acceptor([a + b + "end" for a in "xyz" for b in "pq"], arcs, register)
    # x, y and z lead to one state, p and q to the next: six states and the accepting one less than 6 words of 5 letters.
    assert len(arcs) == 6 and len(set(arcs[machine.start].values())) == 1


def test_odd_rows(spark):
    long = "a" * 300
    docs = [
        (1, None), (2, ""), (3, "short words only"), (None, "Naïveté naïveté NAÏVETÉ"), (4, "spelling spelling speling " * 30), (4, "spelling spelling speling " * 30),
        (5, f"{long} {long} {long}b {long}b {long[1:]}c {long[1:]}c"), (6, "tieworda tiewordb tiewordc " * 3), (7, "xtieword " * 50), (8, "under_score1234567words " * 3),
        (9, ("filler " * 200_000) + "spelling"),
    ]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, word string, n int")
    counts = spelling.word_counts(df, damage=31)
    assert {tuple(r) for r in counts.collect()} == set(plain_counts(docs).items())
    assert rows(spelling.spelling_variants(counts)) == plain(plain_counts(docs))


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert rows(spelling.spelling_variants(spelling.word_counts(none))) == []
