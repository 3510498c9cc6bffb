"""One corpus from web seeds and repository seeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.urls import path_extension, repo_url
from pageloom.operators.joins import lookup_join
from pageloom.operators.relevance import relevance_columns
from pageloom.operators.storage import materialize
from pageloom.plans.crawl import crawl
from pageloom.settings import Settings
from pageloom.sources.readers import select_repo_items


def split_seeds(seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page seeds, repository seeds with owner and repo)."""
    routed = seeds.withColumn("_repo", repo_url(F.col("start_url")))
    pages = routed.filter(~F.col("_repo.is_repo")).drop("_repo")
    repos = routed.filter("_repo.is_repo").withColumns({"owner": F.col("_repo.owner"), "repo": F.col("_repo.repo")})
    return pages, repos.drop("_repo")


def walk_listing(roots: DataFrame, listing: DataFrame, extensions: tuple[str, ...] = Settings.markdown_extensions) -> DataFrame:
    """The files to be downloaded below the top folders of roots(owner, repo).

    listing(owner, repo, dir, path, type, html_url, download_url) has the items of
    each folder; the top folder's dir is empty. Folders are walked level by level
    on their keys alone; a folder that no listed one leads to is not reached, and
    one that leads back is not walked again. Then the files of all reached folders
    are chosen at once; see select_repo_items.
    """
    keys = ["owner", "repo", "dir"]
    given = (F.coalesce("path", F.lit("")) != "") & (F.coalesce("html_url", F.lit("")) != "")
    folders = materialize(listing.filter((F.col("type") == "dir") & given).select(*keys, "path").distinct())
    reached = [materialize(roots.select("owner", "repo", F.lit("").alias("dir")).distinct())]
    while True:
        below = folders.join(reached[-1], keys).select("owner", "repo", F.col("path").alias("dir")).distinct()
        level = materialize(below.join(reduce(DataFrame.unionByName, reached), keys, "left_anti"))
        if level.isEmpty():
            break
        reached.append(level)
    found = listing.join(reduce(DataFrame.unionByName, reached), keys, "left_semi")
    return select_repo_items(found, extensions)


def chosen_files(files: DataFrame, extensions: tuple[str, ...] = Settings.markdown_extensions) -> DataFrame:
    """files(owner, repo, path, html_url, content) with one of the endings, once per html_url; of repeated rows the least path counts."""
    wanted = files.filter(path_extension(F.col("path")).isin(*extensions) & (F.coalesce("html_url", F.lit("")) != ""))
    row = F.min_by(F.struct("owner", "repo", "path", "content"), F.struct("path", F.xxhash64("content")))
    return wanted.groupBy("html_url").agg(row.alias("_file")).select("html_url", "_file.*")


def read_repositories(
    seeds: DataFrame,
    files: DataFrame,
    threshold: float = Settings.relevance_threshold,
    vectors: DataFrame | None = None,
    listing: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(corpus, log) of repository seeds over files(owner, repo, path, html_url, content).

    With a listing its files are those of walk_listing, and files(download_url,
    content) has what was downloaded. Null content is a failed download. A
    repository with many files is spread over tasks by file.
    """
    use_topics = vectors is not None and "topic_vector" in seeds.columns and threshold <= 1.0
    if listing is None:
        files = chosen_files(files)
    else:
        items = walk_listing(seeds.select("owner", "repo"), listing).select("owner", "repo", "path", "html_url", "download_url")
        downloaded = files.select("download_url", "content").filter("content IS NOT NULL")
        downloaded = downloaded.groupBy("download_url").agg(F.min_by("content", F.xxhash64("content")).alias("content"))
        files = items.join(downloaded, "download_url", "left")
    listed = files.select("owner", "repo", "path", F.col("html_url").alias("url"), "content")
    if use_topics:
        listed = listed.join(vectors.select("url", "vector"), "url", "left")
    wanted = seeds.select("seed_id", "owner", "repo", *(["topic_vector"] if use_topics else []))
    rows = lookup_join(listed, wanted, ["owner", "repo"], ["url"], "inner")
    vector, topic_vector = (F.col("vector"), F.col("topic_vector")) if use_topics else (None, None)
    verdict, score = relevance_columns(F.coalesce(F.col("content"), F.lit("")) != "", vector, topic_vector, threshold)
    fetched = F.col("content").isNotNull()
    judged = rows.withColumns(
        {
            "status": F.when(fetched, verdict).otherwise("failed"),
            "score": F.when(fetched, score),
            "depth": F.lit(0),
        }
    )
    corpus = judged.filter("status = 'passed'").select(
        "seed_id", "url", "content", F.lit("markdown").alias("type"), "depth", "path", F.col("content").alias("text")
    )
    return corpus, judged.select("seed_id", "url", "depth", "status", "score")


def ingest(
    seeds: DataFrame,
    pages: DataFrame,
    files: DataFrame,
    max_depth: int = Settings.max_depth,
    threshold: float = Settings.relevance_threshold,
    vectors: DataFrame | None = None,
    links: DataFrame | None = None,
    listing: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(corpus, log): repository seeds read their Markdown files, all others crawl pages; see read_repositories and crawl."""
    page_seeds, repo_seeds = split_seeds(seeds)
    corpus, log = crawl(page_seeds, pages, max_depth, threshold, vectors, links)
    repo_corpus, repo_log = read_repositories(repo_seeds, files, threshold, vectors, listing)
    return corpus.unionByName(repo_corpus), log.unionByName(repo_log)
