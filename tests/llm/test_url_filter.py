"""URL filters against plain Python, with odd URLs, listed keys of both kinds, and filters dealt into shards."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pageloom.llm import queries, url_filter

RULES = queries.URL_RULES
ODD = [
    None, "", "no scheme", "://", "https://", "http://Example.ORG", "http://example.org/", "http://example.org/en/1", "http://a.EXAMPLE.org/en/12?x=/es/",
    "http://notexample.org/es/1", "http://example.org/es/", "https://x.com/de/1#a", "https://x.com/fr/", "https://com/de/", "https://x.com/De/",
    "a://b://c/d", "http://x.net?q://y", "http://ÄÖ.net/a", "http://casino.net/", "http://x.casino-y.net:80/a", "http://" + "a." * 500 + "net/", "http://..../",
    "http://bad.net/page", "http://bad.net/page/2", "http://sub.worse.net/", "http://x.org?y", "line\nhttp://worse.net/\n",
] * 2


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match("[^?#]*", rest[len(host):]).group()


def plain(url, listed):
    host, path = parts(url)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.name), default=None)
    labels = host.split(".")
    hit = host + path in listed or any(".".join(labels[i:]) in listed for i in range(len(labels)))
    return host, path, rule and rule.name, hit, rule.verdict if rule else "block" if hit else "allow"


def judged(spark, urls, listed, **options):
    pages = spark.createDataFrame([(i, u, "x", True) for i, u in enumerate(urls)], "page_id int, url string, key string, listed boolean")
    keys = spark.createDataFrame([(k,) for k in listed], "key string")
    found = url_filter.url_verdicts(pages, RULES, keys, **options)
    assert found.columns == ["page_id", "url", "key", "listed", "host", "path", "rule", "verdict"]
    return found


def check(spark, urls, listed, **options):
    found = judged(spark, urls, listed, **options).orderBy("page_id").select("host", "path", "rule", "listed", "verdict").collect()
    assert [tuple(r) for r in found] == [plain(u, set(listed)) for u in urls]


@pytest.mark.parametrize("listed", [[], ["bad.net/page", "worse.net", None, "worse.net", "casino.net", ""], ["net"], ["absent.example"]])
def test_odd_urls(spark, listed):
    check(spark, ODD, listed)


def random_urls(n):
    rng = random.Random(4)
    return [f"http://h{rng.randrange(400)}.d{rng.randrange(30)}.net/p{rng.randrange(9)}" for _ in range(n)]


@pytest.mark.parametrize("max_bytes", [1 << 20, 16])
def test_many_keys(spark, max_bytes):
    """Several levels, and shards of the keys asked one after another, give exact answers."""
    urls = random_urls(3000)
    listed = [f"h{i}.d{j}.net" for i in range(0, 400, 7) for j in range(0, 30, 4)] + ["d3.net"] + [u[7:] for u in urls[::9]]
    check(spark, urls + [u + "x" for u in urls[::5]], listed, max_bytes=max_bytes)


def test_levels_end_exact(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") % 40 == 0).alias("listed"))
    levels = url_filter.build_cascade(keys)
    found = url_filter.with_listed(keys, "found", [F.col("key")], levels)
    assert len(levels) > 2 and found.filter("found <> listed").count() == 0
    # Small beside the keys: a few bits for each listed one.
    assert sum(level.n_bits for level in levels) < 20 * 500


def test_rows_do_not_carry_the_filters(spark):
    plan = judged(spark, random_urls(50), ["d1.net"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan.replace("BroadcastExchange", "") and "Python" not in plan and "Arrow" not in plan
    assert "AS held_" not in plan


def test_no_pages(spark):
    assert judged(spark, [], ["a"]).count() == 0
