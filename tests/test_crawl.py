import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from pageloom.operators.joins import lookup_join
from pageloom.operators.sequence import with_sequence
from pageloom.operators import storage
from pageloom.plans import crawl as crawling
from pageloom.plans.crawl import crawl, crawl_summary, first_discovery, seed_sets, start_frontier
from pageloom.plans.ingest import chosen_files, ingest, walk_listing
from pageloom.plans.topics import name_seeds


def page(*links):
    return "<body><p>text of a page</p>" + "".join(f"<a href='{x}'>x</a>" for x in links) + "</body>"


SITE = "http://h.com/docs/"
PAGES = {
    SITE + "start": page("a", "b#frag", "/docs/c", "/other", "https://x.org/", "pic.PNG", "start"),
    SITE + "a": page("d", "b", "missing"),
    SITE + "b": page("a", "start"),
    SITE + "c": "<nav>nothing left</nav><a href='e'>e</a>",
    SITE + "d": page("e"),
    SITE + "e": page(),
    "http://h.com/other": page(),
}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(list(PAGES.items()), "url string, html string")


def run(spark, pages, depth, **options):
    seeds = spark.createDataFrame([("s", SITE + "start#top"), ("bad", "ftp://h.com/")], "seed_id string, start_url string")
    corpus, log = crawl(seeds, pages, depth, **options)
    return corpus, log


def test_levels_statuses_and_summary(spark, pages):
    first = {"start": (0, "passed"), "a": (1, "passed"), "b": (1, "passed"), "c": (1, "filtered")}
    assert {r.url.removeprefix(SITE): (r.depth, r.status) for r in run(spark, pages, 1)[1].collect()} == first
    corpus, log = run(spark, pages, 3)
    seen = {r.url.removeprefix(SITE): (r.depth, r.status) for r in log.collect()}
    assert seen == first | {"d": (2, "passed"), "missing": (2, "failed"), "e": (3, "passed")}
    got = {r.url.removeprefix(SITE): r for r in corpus.collect()}
    assert sorted(got) == ["a", "b", "d", "e", "start"]
    assert got["a"].content == PAGES[SITE + "a"] and got["a"].text == "text of a page"
    assert (got["a"].type, got["a"].path, got["a"].depth) == ("html", "/docs/a", 1)
    assert crawl_summary(log).first().asDict() == {
        "seed_id": "s", "n_seen": 7, "n_passed": 5, "n_failed": 1, "n_filtered": 1, "max_depth": 3
    }


def test_relevance_stops_expansion(spark, pages):
    seeds = spark.createDataFrame(
        [("s", SITE + "start", [1.0, 0.0]), ("free", SITE + "start", None)],
        "seed_id string, start_url string, topic_vector array<float>",
    )
    vectors = spark.createDataFrame(
        [(SITE + "start", [3.0, 4.0]), (SITE + "a", [0.0, 1.0]), (SITE + "b", [0.3, 0.9539392])], "url string, vector array<float>"
    )
    _, log = crawl(seeds, pages, 2, vectors=vectors)
    got = {(r.seed_id, r.url.removeprefix(SITE)): (r.status, r.score and round(r.score, 4)) for r in log.collect()}
    assert got[("s", "start")] == ("passed", 0.6) and got[("s", "a")] == ("filtered", 0.0)
    assert got[("s", "b")][0] == "passed" and ("s", "d") not in got
    assert got[("free", "a")] == ("passed", None) and ("free", "d") in got
    _, log = crawl(seeds, pages, 1, threshold=1.1, vectors=vectors)
    assert log.filter("seed_id = 's' and status = 'passed'").count() == 3


def test_depth_is_the_shortest_distance(spark):
    rng = random.Random(3)
    names = [f"http://h.com/{i}" for i in range(40)]
    edges = {(rng.choice(names), rng.choice(names)) for _ in range(70)}
    df = spark.createDataFrame([(n, page()) for n in names], "url string, html string")
    links = spark.createDataFrame(list(edges), "src_url string, dst_url string")
    seeds = spark.createDataFrame([(n, n) for n in names[:6]], "seed_id string, start_url string")
    _, log = crawl(seeds, df, 3, links=links)
    rows = log.collect()
    for seed in names[:6]:
        far, todo = {seed: 0}, deque([seed])
        while todo:
            at = todo.popleft()
            for a, b in edges:
                if a == at and b not in far and far[at] < 3:
                    far[b] = far[at] + 1
                    todo.append(b)
        assert {r.url: r.depth for r in rows if r.seed_id == seed} == far


def test_start_frontier(spark):
    seeds = spark.createDataFrame([("a", "http://h/x/y#z"), ("b", "h/x"), ("c", "http://")], "seed_id string, start_url string")
    assert [tuple(r) for r in start_frontier(seeds).collect()] == [("a", "http://h/x/y", 0, "http://h/x/")]


def test_ingest_routes_seeds(spark, pages):
    seeds = spark.createDataFrame(
        [("web", SITE + "e"), ("repo", "https://github.com/o/r/tree/main/sub")], "seed_id string, start_url string"
    )
    files = spark.createDataFrame(
        [("o", "r", "a.md", "u1", "# A"), ("o", "r", "b.md", "u2", None), ("o", "r", "c.md", "u3", ""), ("o", "x", "d.md", "u4", "D")],
        "owner string, repo string, path string, html_url string, content string",
    )
    corpus, log = ingest(seeds, pages, files)
    assert {(r.seed_id, r.url, r.type) for r in corpus.collect()} == {("web", SITE + "e", "html"), ("repo", "u1", "markdown")}
    assert {(r.url, r.status) for r in log.filter("seed_id = 'repo'").collect()} == {
        ("u1", "passed"), ("u2", "failed"), ("u3", "filtered")
    }


@pytest.mark.parametrize("how", ["left", "inner"])
def test_spread_keys_give_the_same_join(spark, how):
    rows = spark.range(3000).selectExpr("IF(id % 3 = 0, 'hot', concat('k', id % 50)) AS k", "id")
    table = spark.range(40).selectExpr("IF(id = 0, 'hot', concat('k', id)) AS k", "id * 2 AS v")
    plain = rows.join(table, "k", how)
    spread = lookup_join(rows, table, ["k"], ["id"], how, hot_rows=100, salts=8, small_bytes=0)
    assert sorted(map(str, spread.select("k", "id", "v").collect())) == sorted(map(str, plain.select("k", "id", "v").collect()))
    parts = spread.select("k", F.spark_partition_id().alias("p")).filter("k = 'hot'").distinct().count()
    assert parts > 1


def test_keys_hot_on_both_sides(spark):
    rows = spark.range(400).selectExpr("IF(id % 2 = 0, 'hot', concat('k', id % 50)) AS k", "id")
    table = spark.range(300).selectExpr("IF(id % 3 = 0, 'hot', concat('k', id % 50)) AS k", "id AS v")
    plain = rows.join(table, "k")
    spread = lookup_join(rows, table, ["k"], ["id"], "inner", hot_rows=50, salts=4, small_bytes=0, spread_table_by=["v"])
    assert plain.count() > 20000 and spread.exceptAll(plain.select(*spread.columns)).count() == 0 and spread.count() == plain.count()


def test_sequence_is_dense_with_a_hot_group(spark):
    rows = spark.range(4000).selectExpr("IF(id % 3 = 0, concat('g', id % 7), 'hot') AS g", "(id * 7919) % 4001 AS o")
    got = {}
    for r in with_sequence(rows, ["g"], ["o"], partitions=6).collect():
        got.setdefault(r.g, []).append((r.o, r.seq))
    for values in got.values():
        assert [s for _, s in sorted(values)] == list(range(len(values)))
    assert len(got["hot"]) > 2000


def many_seeds(spark, n):
    """Seeds of two base paths, one inside the other, over a ring of pages."""
    names = [f"http://h.com/{i}" for i in range(12)] + [f"http://h.com/in/{i}" for i in range(12)]
    pages = spark.createDataFrame([(u, page()) for u in names], "url string, html string")
    links = [(names[i], names[(i + k) % 24]) for i in range(24) for k in (1, 5)]
    seeds = [(i, names[i % 24] + "#x") for i in range(n)]
    return names, links, seeds, pages, spark.createDataFrame(links, "src_url string, dst_url string"), spark.createDataFrame(seeds, "seed_id int, start_url string")


def test_sets_of_seeds_give_the_same_log(spark, monkeypatch):
    """One row for 64 seeds: with fewer on a base path, a level has no more rows than URLs; 300 seeds need five words."""
    for n, words in ((40, 1), (300, 5)):
        names, links, seeds, pages, edges, df = many_seeds(spark, n)
        steps = []
        monkeypatch.setattr(crawling, "materialize", lambda d: steps.append(storage.materialize(d)) or steps[-1])
        corpus, log = crawl(df, pages, 3, links=edges)
        monkeypatch.undo()
        levels = [s for s in steps if "passed" in s.columns]
        assert len(levels) == 4
        for step in levels:
            assert step.groupBy("base_path", "url").count().agg(F.max("count")).first()[0] <= words
            assert step.count() <= 24 * 2 * words and step.groupBy("base_path").agg(F.countDistinct("url"), F.count("*")).filter("count(DISTINCT url) * {} < count(1)".format(words)).count() == 0
        got = {(r.seed_id, r.url): r.depth for r in log.collect()}
        expected = {}
        for seed, start in seeds:
            start = start.split("#")[0]
            base, far, todo = start[: start.rindex("/") + 1], {start: 0}, deque([start])
            while todo:
                at = todo.popleft()
                for a, b in links:
                    if a == at and b not in far and far[at] < 3 and b.startswith(base):
                        far[b] = far[at] + 1
                        todo.append(b)
            expected |= {(seed, u): d for u, d in far.items()}
        assert got == expected and corpus.count() == len(expected)


def test_the_loop_reads_keys_only(spark, pages, monkeypatch):
    """html is read to be parsed and once at the end; no step of the loop has it, and none shuffles the facts again."""
    plans = []

    def watched(df, *keys, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return storage.materialize_by(df, *keys, **options) if keys else storage.materialize(df)

    monkeypatch.setattr(crawling, "materialize", watched)
    monkeypatch.setattr(crawling, "materialize_by", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with tables too large to send
    try:
        corpus, log = run(spark, pages, 3)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.undo()
    held = [p for p in plans if "html#" in p]
    assert len(held) == 1 and held[0].count("ArrowEvalPython") == 1
    looped = [p for p in plans if "fetched" in p or "bit_or" in p]
    assert len(looped) == 4 and not any("html" in p or "text#" in p.replace("has_text#", "") for p in looped)
    steps = [p for p in plans if "fetched" in p]
    assert len(steps) == 4 and all("Bucketed: true" in p for p in steps)
    end = corpus._jdf.queryExecution().executedPlan().toString()
    assert end.count("ArrowEvalPython") == 0
    assert "html" not in log._jdf.queryExecution().executedPlan().toString()


def test_one_page_for_each_url(spark):
    """Pages with one URL count once, whichever order they come in; repeated seeds are one."""
    rows = [("http://h.com/a", page("b")), ("http://h.com/a", page("c")), ("http://h.com/b", page()), ("http://h.com/c", page()), ("http://h.com/b", page())]
    seeds = spark.createDataFrame([("s", "http://h.com/a")] * 3, "seed_id string, start_url string")
    seen = []
    for order in (rows, rows[::-1]):
        corpus, log = crawl(seeds, spark.createDataFrame(order, "url string, html string"), 1)
        seen.append((sorted(map(tuple, corpus.collect())), sorted(map(str, log.collect()))))
    assert seen[0] == seen[1] and len(seen[0][0]) == len(seen[0][1]) == 2


def test_sets_are_subtracted(spark):
    schema = "base_path string, url string, no bigint, bits bigint"
    found = spark.createDataFrame([("b", "u", 0, 5), ("b", "u", 0, -(1 << 63)), ("b", "u", 1, 1), ("b", "v", 0, 2)], schema)
    visited = spark.createDataFrame([("b", "u", 0, 4), ("b", "v", 0, 3), ("b", "w", 0, 1)], schema)
    assert sorted(map(tuple, first_discovery(found, visited).collect())) == [("b", "u", 0, 1 - (1 << 63)), ("b", "u", 1, 1)]
    seeds = spark.createDataFrame([(i, "http://h/x/") for i in range(70)], "seed_id int, start_url string")
    members, frontier = seed_sets(seeds)
    assert sorted((r.no, len(r.members)) for r in members.collect()) == [(0, 64), (1, 6)]
    assert sorted((r.no, r.bits) for r in frontier.collect()) == [(0, -1), (1, 63)]


LISTING = "owner string, repo string, dir string, path string, type string, html_url string, download_url string"


def test_a_listing_is_walked(spark):
    rows = [
        ("", "a", "dir", "u", None), ("a", "a/b", "dir", "u", None), ("a/b", "a", "dir", "u", None),  # leads back
        ("", "lost", "dir", None, None), ("lost", "lost/x.md", "file", "h/lost", "d"), ("gone", "gone/x.md", "file", "h/gone", "d"),
        ("", "top.md", "file", "h/top", "d1"), ("a", "a/one.MDX", "file", "h/one", "d2"), ("a/b", "a/b/two.markdown", "file", "h/two", "d3"),
        ("a/b", "a/b/two.txt", "file", "h/txt", "d4"), ("a/b", "a/b/again.md", "file", "h/top", "d5"), ("a", "a/none.md", "file", "h/none", None),
    ]
    listing = spark.createDataFrame([("o", "r", *r) for r in rows] + [("o", "other", "", "x.md", "file", "h/x", "d")], LISTING)
    roots = spark.createDataFrame([("o", "r"), ("o", "r"), ("o", "empty")], "owner string, repo string")
    got = {(r.html_url, r.path, r.download_url) for r in walk_listing(roots, listing).collect()}
    assert got == {("h/top", "a/b/again.md", "d5"), ("h/one", "a/one.MDX", "d2"), ("h/two", "a/b/two.markdown", "d3")}
    assert walk_listing(roots.filter("false"), listing).count() == 0
    seeds = spark.createDataFrame([("s", "https://github.com/o/r"), ("t", "https://github.com/o/r")], "seed_id string, start_url string")
    contents = spark.createDataFrame([("d5", "text"), ("d2", None), ("d3", ""), ("d5", "text")], "download_url string, content string")
    pages_ = spark.createDataFrame([], "url string, html string")
    corpus, log = ingest(seeds, pages_, contents, listing=listing)
    assert sorted(tuple(r) for r in corpus.select("seed_id", "url", "path", "content").collect()) == [(s, "h/top", "a/b/again.md", "text") for s in "st"]
    assert {(r.url, r.status) for r in log.collect()} == {("h/top", "passed"), ("h/one", "failed"), ("h/two", "filtered")}


def test_files_are_chosen_once(spark):
    rows = [("o", "r", "b.md", "u", "B"), ("o", "r", "a.md", "u", "A"), ("o", "r", "a.md", "u", "A"), ("o", "r", "c.txt", "v", "C"), ("o", "r", "d.md", None, "D")]
    files = spark.createDataFrame(rows, "owner string, repo string, path string, html_url string, content string")
    assert [(r.html_url, r.path, r.content) for r in chosen_files(files).collect()] == [("u", "a.md", "A")]


def test_seeds_get_topics(spark):
    """The model is asked once for each start URL that lacks one, and not again by later actions."""
    asked = []

    def answer(requests):
        asked.append(requests.count())
        said = F.when(F.col("prompt").contains("known to the model"), "'A Model Title'")
        return requests.select("request_id", said.alias("text"), F.lit(None).cast("string").alias("error"))

    rows = [
        ("given", "http://h.com/a", "Own Topic", 1), ("model", "http://h.com/a#x", None, 2), ("model2", "http://h.com/a", " ", 3), ("page", "http://h.com/b", "", 4),
        ("host", "http://docs.my-lib.io/", None, 5), ("url", "no host", None, 6),
    ]
    seeds = spark.createDataFrame(rows, "seed_id string, start_url string, topic string, n int")
    pages_ = spark.createDataFrame(
        [("http://h.com/a", "<p>known to the model</p>"), ("http://h.com/b", "<h1>Heading One</h1>"), ("http://h.com/b", "<h1>Heading One</h1>")], "url string, html string")
    named = name_seeds(seeds, pages_, answer)
    for _ in range(2):
        got = {r.seed_id: (r.topic, r.topic_source, r.n) for r in named.collect()}
        assert got == {
            "given": ("Own Topic", "given", 1), "model": ("A Model Title", "model", 2), "model2": ("A Model Title", "model", 3), "page": ("Heading One", "page", 4),
            "host": ("My Lib", "host", 5), "url": ("no host", "url", 6),
        }
    assert asked == [2]
    plain = {r.seed_id: r.topic_source for r in name_seeds(seeds.drop("topic"), pages_).collect()}
    assert plain == {"given": "host", "model": "host", "model2": "host", "page": "page", "host": "host", "url": "url"}
    assert name_seeds(seeds.filter("false"), pages_, answer).count() == 0
