"""Reading pages, Markdown files, listings and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.text import decode_utf8_lenient
from pageloom.functions.urls import path_extension, url_path
from pageloom.operators.joins import SMALL_BYTES, estimated_bytes
from pageloom.settings import Settings

# The corpus extensions in any case, as a file-name pattern, so that no other
# file is opened.
MARKDOWN_GLOB = "*.{[mM][dD],[mM][dD][xX],[mM][aA][rR][kK][dD][oO][wW][nN]}"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; one too small to fill the cores with its own splits is dealt out to them.

    A file with one row group is one task however many cores there are, which
    counts when each row is dear to process. Above SMALL_BYTES the table has
    splits enough and is read as it lies, without a shuffle.
    """
    df = spark.read.parquet(path)
    if estimated_bytes(df) < SMALL_BYTES:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


def load_pages(spark: SparkSession, path: str) -> DataFrame:
    """corpus(url, content, type, depth, path) of a Parquet table with url and html."""
    return read_table(spark, path).select(
        "url",
        F.col("html").alias("content"),
        F.lit("html").alias("type"),
        F.lit(0).alias("depth"),
        url_path(F.col("url")).alias("path"),
    )


def load_markdown_tree(spark: SparkSession, directory: str) -> DataFrame:
    """corpus of the Markdown files at any depth below a directory; bytes that are not UTF-8 are dropped."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", MARKDOWN_GLOB)
        .load(directory)
    )
    root = directory.rstrip("/") + "/"
    below = F.instr(F.col("path"), root) + len(root)
    return files.select(
        F.col("path").alias("url"),
        decode_utf8_lenient(F.col("content")).alias("content"),
        F.lit("markdown").alias("type"),
        F.lit(0).alias("depth"),
        F.substring("path", below, F.length("path")).alias("path"),
    )


def select_repo_items(listing: DataFrame, extensions: tuple[str, ...] = Settings.markdown_extensions) -> DataFrame:
    """The files of a listing(path, type, html_url, download_url) to be downloaded, once per html_url.

    Rows without path, type or html_url, other extensions and files without
    download_url are skipped. Of repeated rows the least path counts.
    """

    def given(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) != ""

    files = listing.filter(
        given("path") & given("html_url") & (F.col("type") == "file")
        & path_extension(F.col("path")).isin(*extensions) & given("download_url")
    )
    others = [c for c in listing.columns if c != "html_url"]
    order = F.struct("path", "download_url")
    return files.groupBy("html_url").agg(F.min_by(F.struct(*others), order).alias("_row")).select("html_url", "_row.*")


def html_only(responses: DataFrame) -> DataFrame:
    """responses(url, content_type, body) as pages(url, html); other types have null html (failed)."""
    is_html = F.coalesce(F.lower("content_type").contains("text/html"), F.lit(False))
    return responses.select("url", F.when(is_html, decode_utf8_lenient(F.col("body"))).alias("html"))


def read_documents(spark: SparkSession, directory: str) -> DataFrame:
    """documents(file_name, text) of the .txt files directly in a directory."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(directory)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), decode_utf8_lenient(F.col("content")).alias("text")
    )
