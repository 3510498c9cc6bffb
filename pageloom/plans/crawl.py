"""Breadth-first crawl of a stored page table from many seeds at once.

The loop runs on keys. Pages are parsed once, where they lie, into a table of
facts bucketed by url; the links likewise; html is fetched once, at the end, for
the pages that passed. What a URL has been reached by is a set of seeds: the seeds
of one base path are numbered, and a row (base_path, url, no) holds 64 of them as
the bits of one number, so that sets are joined, subtracted and written as whole
numbers, and a URL that many seeds reach is one row for 64 of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.urls import base_path, queue_decision, strip_fragment, url_path, url_site, valid_url
from pageloom.operators.html import clean_html, page_blocks, with_links
from pageloom.operators.relevance import relevance_columns
from pageloom.operators.sequence import with_sequence
from pageloom.operators.storage import materialize, materialize_by
from pageloom.settings import Settings

# Sites of seeds that are sent to all tasks to skip other sites' pages; with more, all pages are parsed.
MAX_SENT_SITES = 100_000

SET = ("base_path", "url", "no")


def start_frontier(seeds: DataFrame) -> DataFrame:
    """frontier(seed_id, url, depth, base_path) of the seeds with a usable start URL."""
    return seeds.filter(valid_url(F.col("start_url"))).select(
        "seed_id",
        strip_fragment(F.col("start_url")).alias("url"),
        F.lit(0).alias("depth"),
        base_path(F.col("start_url")).alias("base_path"),
    )


def _bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), number.cast("int"))


def _has(bits: Column, number: Column) -> Column:
    return F.getbit(bits, number.cast("int")) == 1


def seed_sets(seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, frontier) of the seeds with a usable start URL.

    members(base_path, no, members) has the seeds, up to 64, that the bits of a
    set stand for; frontier(base_path, url, no, bits) the sets that start URLs
    are reached by. A seed_id is one seed, whatever rows repeat it.
    """
    extra = [c for c in ("topic_vector",) if c in seeds.columns]
    starts = start_frontier(seeds).drop("depth").join(seeds.select("seed_id", *extra).dropDuplicates(["seed_id"]), "seed_id").dropDuplicates(["seed_id", "url"])
    numbered = with_sequence(starts, ["base_path"], ["seed_id", "url"], "_n")
    no = F.floor(F.col("_n") / 64).alias("no")
    bit = (F.col("_n") % 64).cast("int").alias("bit")
    members = numbered.select("base_path", no, F.struct(bit, "seed_id", *extra).alias("m")).groupBy("base_path", "no")
    members = members.agg(F.array_sort(F.collect_list("m"), lambda x, y: x["bit"] - y["bit"]).alias("members"))
    frontier = numbered.select("base_path", "url", no, bit).groupBy(*SET).agg(F.bit_or(_bit(F.col("bit"))).alias("bits"))
    return materialize(members), frontier


def first_discovery(found: DataFrame, visited: DataFrame) -> DataFrame:
    """found(base_path, url, no, bits), one set each, less the seeds that visited has for it; empty sets go.

    One aggregation does both: sets are joined bit by bit before they are shuffled.
    """
    none = F.lit(0).cast("bigint")
    both = found.select(*SET, "bits", none.alias("old")).unionByName(visited.select(*SET, none.alias("bits"), F.col("bits").alias("old")))
    sets = both.groupBy(*SET).agg(F.bit_or("bits").alias("bits"), F.bit_or("old").alias("old"))
    return sets.select(*SET, F.col("bits").bitwiseAND(F.bitwise_not("old")).alias("bits")).filter("bits <> 0")


def _of_seeds(pages: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pages of the seeds' sites, where these are few enough to be sent; no seed leaves its site."""
    sites = seeds.filter(valid_url(F.col("start_url"))).select(url_site(F.col("start_url")).alias("_site")).distinct()
    if sites.limit(MAX_SENT_SITES + 1).count() > MAX_SENT_SITES:
        return pages
    return pages.withColumn("_site", url_site(F.col("url"))).join(F.broadcast(sites), "_site", "left_semi").drop("_site")


def page_facts(pages: DataFrame, with_hrefs: bool) -> DataFrame:
    """facts(url, page_hash, has_text, text[, links]) of pages(url, html), once per URL, bucketed by url.

    Each page is parsed where it lies. Of pages with one URL the least hash counts.
    """
    read = with_links(pages, same_site=True) if with_hrefs else pages
    read = read.withColumn("text", clean_html(page_blocks(F.col("html"))))
    columns = ["page_hash", "has_text", "text", *(["links"] if with_hrefs else [])]
    read = read.select("url", F.xxhash64("html").alias("page_hash"), (F.col("text") != "").alias("has_text"), *columns[2:])
    unique = read.groupBy("url").agg(F.min_by(F.struct(*columns), "page_hash").alias("_page")).select("url", "_page.*")
    return materialize_by(unique, "url", dealt=True)


def fetch_from_corpus(frontier: DataFrame, facts: DataFrame) -> DataFrame:
    """frontier(…, url, …) with the columns of facts(url, …); `fetched` is false where there is no page."""
    return frontier.join(facts.withColumn("fetched", F.lit(True)), "url", "left").fillna(False, ["fetched"])


def crawl(
    seeds: DataFrame,
    pages: DataFrame,
    max_depth: int = Settings.max_depth,
    threshold: float = Settings.relevance_threshold,
    vectors: DataFrame | None = None,
    links: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(corpus, crawl_log) of seeds(seed_id, start_url[, topic_vector]) over pages(url, html).

    URLs are unique in vectors(url, vector); of pages with one URL one is read.
    Pages that pass the relevance filter give links, each confined to its
    seed's base path; depth is the least number of links from the seed.
    links(src_url, dst_url) may be given in place of the links in the pages.
    The corpus has the page's html as content and its cleaned text.
    """
    if max_depth < 0:
        raise ValueError("max_depth must not be negative")
    use_topics = vectors is not None and "topic_vector" in seeds.columns and threshold <= 1.0
    seeds = materialize(seeds.select("seed_id", "start_url", *(["topic_vector"] if use_topics else [])))
    # The base path names scheme and host, so no link out of a site can be admitted.
    source = _of_seeds(pages.select("url", "html").filter(F.col("html").isNotNull()), seeds)
    facts = page_facts(source, max_depth > 0 and links is None)
    if max_depth == 0:
        edges = None
    elif links is None:
        edges = facts.select("url", F.explode("links").alias("_to"))
    else:
        edges = materialize_by(links.select(F.col("src_url").alias("url"), F.col("dst_url").alias("_to")).distinct(), "url")
    seen = facts.select("url", "has_text")
    if use_topics:
        seen = materialize_by(seen.join(vectors.select("url", "vector"), "url", "left"), "url")
    members, frontier = seed_sets(seeds)
    has_text = F.coalesce(F.col("has_text"), F.lit(False))
    refusal = queue_decision(F.col("url"), F.col("depth"), F.col("base_path"), max_depth)
    steps: list[DataFrame] = []
    for depth in range(max_depth + 1):
        step = fetch_from_corpus(frontier, seen)
        if use_topics:
            step = _judged(step.join(members, ["base_path", "no"]), has_text, threshold)
        else:
            status, _ = relevance_columns(has_text, None, None, threshold)
            step = step.withColumn("status", F.when(F.col("fetched"), status).otherwise("failed"))
            step = step.withColumn("passed", F.when(F.col("status") == "passed", F.col("bits")).otherwise(0))
        judged = "judged" if use_topics else "status"
        step = materialize(step.select(*SET, "bits", "passed", F.lit(depth).alias("depth"), judged))
        steps.append(step)
        if depth == max_depth or step.isEmpty():
            break
        found = step.filter("passed <> 0").select("base_path", "url", "no", "passed").join(edges, "url")
        found = found.select("base_path", F.col("_to").alias("url"), "no", F.col("passed").alias("bits"))
        admitted = found.withColumn("depth", F.lit(depth + 1)).filter(refusal.isNull())
        visited = reduce(DataFrame.unionByName, [part.select(*SET, "bits") for part in steps])
        frontier = first_discovery(admitted, visited)
    reached = reduce(DataFrame.unionByName, steps)
    return _corpus(reached, members, source, facts), _log(reached, members, use_topics)


def _judged(step: DataFrame, has_text: Column, threshold: float) -> DataFrame:
    """Sets with `judged`, status and score of each seed in them, and `passed`, the seeds that the page passes for."""

    def judge(member: Column) -> Column:
        verdict, score = relevance_columns(has_text, F.col("vector"), member["topic_vector"], threshold)
        status = F.when(F.col("fetched"), verdict).otherwise("failed")
        return F.struct(member["bit"].alias("bit"), member["seed_id"].alias("seed_id"), status.alias("status"), F.when(F.col("fetched"), score).alias("score"))

    own = F.filter("members", lambda m: _has(F.col("bits"), m["bit"]))
    passed = F.aggregate("judged", F.lit(0).cast("bigint"), lambda bits, j: F.when(j["status"] == "passed", bits.bitwiseOR(_bit(j["bit"]))).otherwise(bits))
    return step.withColumn("judged", F.transform(own, judge)).withColumn("passed", passed)


def _log(reached: DataFrame, members: DataFrame, judged: bool) -> DataFrame:
    """crawl_log(seed_id, url, depth, status, score): the sets as a row for each seed."""
    if judged:
        return reached.select("url", "depth", F.explode("judged").alias("j")).select("j.seed_id", "url", "depth", "j.status", "j.score")
    own = F.filter("members", lambda m: _has(F.col("bits"), m["bit"]))["seed_id"]
    rows = reached.join(members, ["base_path", "no"]).select(F.explode(own).alias("seed_id"), "url", "depth", "status")
    return rows.withColumn("score", F.lit(None).cast("double"))


def _corpus(reached: DataFrame, members: DataFrame, source: DataFrame, facts: DataFrame) -> DataFrame:
    """The pages that passed, for each seed; html is fetched once and repeated inside its row only."""
    own = F.filter("members", lambda m: _has(F.col("passed"), m["bit"]))["seed_id"]
    kept = reached.filter("passed <> 0").join(members, ["base_path", "no"]).select("url", "depth", own.alias("seeds"))
    texts = facts.select("url", "page_hash", "text").join(kept, "url")
    html = source.select("url", F.xxhash64("html").alias("page_hash"), F.col("html").alias("content")).dropDuplicates(["url", "page_hash"])
    found = texts.join(html, ["url", "page_hash"])
    return found.select(
        F.explode("seeds").alias("seed_id"), "url", "content", F.lit("html").alias("type"), "depth", url_path(F.col("url")).alias("path"), "text"
    )


def crawl_summary(crawl_log: DataFrame) -> DataFrame:
    """Pages seen, passed, failed and filtered of each seed."""
    return crawl_log.groupBy("seed_id").agg(
        F.count(F.lit(1)).alias("n_seen"),
        F.count_if(F.col("status") == "passed").alias("n_passed"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.count_if(F.col("status") == "filtered").alias("n_filtered"),
        F.max("depth").alias("max_depth"),
    )
