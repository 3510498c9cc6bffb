"""Quality rules on documents and on lines that many documents of a host share; columns only."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import GAP, row_key
from pageloom.operators.storage import materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _once(value: Column) -> Column:
    """A column that later steps read and do not work out again: the outer explode of one element."""
    return F.explode_outer(F.array(value))


def word_list(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def normal_line(line: Column) -> Column:
    """A line for comparing: ASCII lower case, digits as 0, runs of white space as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(F.translate(line, _UPPER + "123456789", _LOWER + "0" * 9), GAP, " "), F.lit(_SPACES))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "")


def repeat_words(words: Column) -> Column:
    """How many words lie in a window of five words that occurs twice or more.

    Windows are compared by 64-bit hashes. Sorted with their places, a window is
    repeated if a neighbour has its hash; each repeated place then covers five
    words, or as many as there are up to the next one.
    """

    def hashes(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - WINDOW)
        return let(
            F.transform(w, lambda x: F.xxhash64(x)),
            lambda h: F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])),
        )

    def places(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # Places of repeated windows; -1 for the others.
        twice = let(
            placed,
            lambda s: F.transform(
                s,
                lambda x, k: F.when(
                    (x["h"] == F.get(s, k + 1)["h"]) | ((k > 0) & (x["h"] == F.get(s, F.greatest(k - 1, F.lit(0)))["h"])), x["i"]
                ).otherwise(F.lit(-1)),
            ),
        )
        return F.array_sort(F.filter(twice, lambda i: i >= 0))

    def covered(p: Column) -> Column:
        parts = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(parts, F.lit(0), lambda a, x: a + x)

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(places(w), covered))

    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(let(hashes(words), count))


def base_columns(text: Column) -> Column:
    """The struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text; null counts as empty."""

    def counted(t: Column) -> Column:
        bare = F.translate(t, _SPACES, "")
        symbols = F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))
        dup = let(lines_with_words(t), lambda x: F.size(x) - F.size(F.array_distinct(x)))
        return let(
            word_list(t),
            lambda w: F.struct(
                F.size(w).cast("bigint").alias("n_words"), F.length(bare).cast("bigint").alias("word_chars"),
                symbols.cast("bigint").alias("n_symbols"), dup.cast("bigint").alias("n_dup_lines"),
                repeat_words(w).cast("bigint").alias("n_repeat_words"),
            ),
        )

    return counted(F.coalesce(text, F.lit("")))


def host_lines(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """A narrow row for each line with a word: key, doc_id, content, host, line_no, line (hash), n_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(
        row_key(id_col, text_col).alias("key"), F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("content"),
        F.xxhash64(F.col(host_col), F.col(host_col).isNull()).alias("host"), F.posexplode(F.split(text, "\n")).alias("line_no", "raw"),
    )
    normal = split.withColumn("raw", normal_line(F.col("raw"))).filter(F.col("raw") != "")
    # In a normal line each blank stands between two words.
    n_words = (F.length("raw") - F.length(F.replace("raw", F.lit(" "), F.lit(""))) + 1).cast("bigint")
    return normal.select("key", "doc_id", "content", "host", "line_no", F.xxhash64("raw").alias("line"), n_words.alias("n_words"))


def frequent_lines(lines: DataFrame, min_docs: int, min_share: float, many_docs: int) -> DataFrame:
    """host, line and first (the content that holds it first) of the lines above the limits.

    A line is above them if more than min_docs different documents of the host
    hold it and these are more than min_share of the host's different documents,
    or if more than many_docs hold it, whatever their share. Exact copies count as
    one document.
    """
    held = lines.groupBy("host", "line", "content").agg(F.min(F.struct("doc_id", "content")).alias("at"))
    counts = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"), F.min("at").alias("at"))
    many = counts.filter(F.col("n_docs") > min(min_docs, many_docs))
    hosts = lines.groupBy("host", "content").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count(F.lit(1)).alias("n_host"))
    above = (F.col("n_docs") > many_docs) | (F.col("n_docs") > min_share * F.col("n_host"))
    return many.join(hosts, "host").filter(above).select("host", "line", F.col("at.content").alias("first"))


def removed_lines(docs: DataFrame, id_col: str, text_col: str, host_col: str, min_docs: int, min_share: float, many_docs: int) -> DataFrame:
    """key, the numbers of the lines to remove and their words, of each document that loses lines."""
    lines = materialize(host_lines(docs, id_col, text_col, host_col))
    frequent = frequent_lines(lines, min_docs, min_share, many_docs)
    # Rows equal in id and text share the key; each place is counted once.
    lost = lines.join(frequent, ["host", "line"]).filter(F.col("content") != F.col("first")).select("key", "line_no", "n_words").distinct()
    return lost.groupBy("key").agg(F.collect_list("line_no").alias("line_nos"), F.sum("n_words").alias("lost_words"))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 10,
    min_share: float = 0.02, min_words: int = 10, max_repeat: int = 20, min_left: int = 50, many_docs: int = 100,
) -> DataFrame:
    """doc_id, the base columns, base_failed, lost_words and kept of every document.

    base_failed: fewer than min_words words, or more than max_repeat percent of
    them in repeated windows. A line above the limits of frequent_lines is
    removed from every document of its host but those with the content that
    holds it first, so that no text is lost altogether. kept: not base_failed,
    and the lines left hold at least min_left percent of the words. Null texts
    are empty, a null host is a host of its own, null ids come first; equal rows
    are judged alike. No documents give no rows.
    """
    lost = removed_lines(docs, id_col, text_col, host_col, min_docs, min_share, many_docs).select("key", "lost_words")
    base = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), _once(base_columns(F.col(text_col))).alias("b"))
    base = base.select("doc_id", "key", "b.*")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    judged = base.withColumn("base_failed", failed).join(lost, "key", "left").withColumn("lost_words", F.coalesce("lost_words", F.lit(0)))
    left = 100 * (F.col("n_words") - F.col("lost_words")) >= min_left * F.col("n_words")
    return judged.withColumn("kept", ~F.col("base_failed") & left).drop("key")


def clean_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 10,
    min_share: float = 0.02, min_words: int = 10, max_repeat: int = 20, min_left: int = 50, many_docs: int = 100,
) -> DataFrame:
    """The documents that quality_rules keeps, all their columns, without the lines it removes."""
    # Names that the table cannot have.
    mark = uuid.uuid4().hex
    base, key, line_nos, lost_words = (f"{name}_{mark}" for name in ("base", "key", "line_nos", "lost_words"))
    lost = removed_lines(docs, id_col, text_col, host_col, min_docs, min_share, many_docs)
    lost = lost.withColumnsRenamed({"key": key, "line_nos": line_nos, "lost_words": lost_words})
    b = F.col(base)
    judged = docs.withColumn(base, _once(base_columns(F.col(text_col)))).filter(
        (b["n_words"] >= min_words) & (100 * b["n_repeat_words"] <= max_repeat * b["n_words"])
    )
    judged = judged.withColumn(key, row_key(id_col, text_col)).join(lost, key, "left")
    kept = judged.filter(100 * (b["n_words"] - F.coalesce(lost_words, F.lit(0))) >= min_left * b["n_words"])
    parts = F.split(F.col(text_col), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(line_nos))
    text = F.when(F.col(line_nos).isNull(), F.col(text_col)).otherwise(
        F.element_at(F.transform(F.array(parts), lambda p: F.array_join(F.transform(left, lambda i: F.get(p, i)), "\n")), 1))
    return kept.withColumn(text_col, text).select(*[f"`{c}`" for c in docs.columns])
