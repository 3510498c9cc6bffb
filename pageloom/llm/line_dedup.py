"""Line dedup by deletion neighbourhoods: lines within one edit of an earlier line go; columns only.

Two lines are within one edit if deleting one character from one or both, at
one place, makes them equal. So each line emits a hashed key for each of its
deletions and for itself, equal keys meet, and the earliest line of a meeting
stands for the rest: lines that delete at the same place differ in that place
only, and a line that is itself another's deletion differs from it by it.

Emitting costs about the length to the power 1.5: a line is cut in windows of
about the root of its length, and a key is made of hashes of what is before and
after the window and of the window without the character. And only lines emit
that share their first or last half with another line of nearly the same length,
which lines within one edit always do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import row_key
from pageloom.llm.line_rules import let
from pageloom.operators.storage import materialize

_SPACES = " \t\n\x0b\x0c\r"


def normal(line: Column) -> Column:
    """Lower case without white space at the ends."""
    return F.btrim(F.lower(line), F.lit(_SPACES))


def _halves(line: Column, n: Column) -> list[Column]:
    """Keys of a line's first and last half for a common length of n (the line is the shorter) and n - 1 (it loses a character)."""

    def keys(length: Column) -> list[Column]:
        h = F.floor(length / 2).cast("int")
        return [F.xxhash64(length, F.lit(0), F.left(line, h)), F.xxhash64(length, F.lit(1), F.right(line, h))]

    return [*keys(n), *keys(n - 1)]


def _key(length: Column, i: Column, before: Column, after: Column, window: Column) -> Column:
    return F.xxhash64(length, i, before, after, window)


def variants(line: Column, n: Column, met: list[Column]) -> Column:
    """The entries (key, place) of a line of n characters: place -1 for the line itself, else the deleted character's.

    met tells which of the line's _halves another line has. The edit lies outside
    a half that is the same, so only windows there have entries.
    """

    def width(length: Column) -> Column:
        return F.greatest(F.lit(8), F.ceil(F.sqrt(length))).cast("int")

    def last_window(length: Column, w: Column) -> Column:
        return F.greatest(F.ceil(length / w).cast("int") - 1, F.lit(0))

    def windows(length: Column, w: Column, first_half: Column, last_half: Column) -> Column:
        h, last = F.floor(length / 2), last_window(length, w)
        low = F.when(last_half, F.lit(0)).otherwise(F.least(F.floor(h / w).cast("int"), last))
        high = F.when(first_half, last).otherwise(F.least(F.floor((length - h) / w).cast("int"), last))
        none = F.array().cast("array<int>")
        return F.when(first_half | last_half, F.sequence(low, high)).otherwise(none)

    def itself(w: Column) -> Column:
        return F.transform(
            windows(n, w, met[0], met[1]),
            lambda i: F.struct(
                _key(n, i, F.xxhash64(F.left(line, i * w)), F.xxhash64(F.substring(line, (i + 1) * w + 1, n)), F.substring(line, i * w + 1, w)).alias("key"),
                F.lit(-1).alias("place"),
            ),
        )

    def deletions(w: Column) -> Column:
        length = n - 1
        last = last_window(length, w)

        def of_window(i: Column) -> Column:
            held = F.when(i == last, n).otherwise(w + 1)  # characters of the line in the window
            return let(
                F.struct(
                    F.xxhash64(F.left(line, i * w)).alias("before"), F.xxhash64(F.substring(line, i * w + held + 1, n)).alias("after"),
                    F.substring(line, i * w + 1, held).alias("window"),
                ),
                lambda c: F.transform(
                    F.sequence(F.lit(0), F.when(i == last, F.length(c["window"]) - 1).otherwise(w - 1)),
                    lambda j: F.struct(
                        _key(length, i, c["before"], c["after"], F.concat(F.left(c["window"], j), F.substring(c["window"], j + 2, n))).alias("key"),
                        (i * w + j).alias("place"),
                    ),
                ),
            )

        return F.flatten(F.transform(windows(length, w, met[2], met[3]), of_window))

    return F.concat(let(width(n), itself), let(width(n - 1), deletions))


def _at(doc_id: str, key: str, line_no: str) -> Column:
    """The place of a line as one number, in the order of id (null first), row and line."""
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    first = F.coalesce(whole(doc_id), F.lit("-9223372036854775809").cast("decimal(38,0)"))
    at = first * F.lit("10000000000000000000").cast("decimal(20,0)") + F.pmod(F.col(key), F.lit(10**8)) * F.lit(10**10) + F.col(line_no)
    return at.cast("decimal(38,0)")


def removed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """key and line_nos (the numbers of lines to remove) of each document that loses a line."""
    keyed = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    line, n = F.col("line"), F.length("line")
    lines = keyed.select("key", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).withColumn("line", normal(F.col("raw"))).filter(line != "")
    names = ["h0", "h1", "h2", "h3"]
    halves = [F.when(n >= min_chars, h).alias(name) for name, h in zip(names, _halves(line, n))]
    narrow = materialize(lines.select("key", "doc_id", "line_no", F.xxhash64(line).alias("id"), *halves))
    places = narrow.withColumn("at", _at("doc_id", "key", "line_no"))
    # Distinct lines with their earliest place.
    known = materialize(places.groupBy("id").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n_places"), *[F.min(h).alias(h) for h in names]))

    half = known.filter("h0 IS NOT NULL").select("id", F.posexplode(F.array(*names)).alias("which", "half"))
    met = materialize(half.groupBy("half").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select("half"))
    flags = [F.bool_or(F.col("which") == k).alias(f"m{k}") for k in range(4)]
    candidates = materialize(half.join(met, "half").groupBy("id").agg(*flags).join(known.select("id", "at"), "id"))

    # The candidates' texts, each from the earliest row that holds it.
    where = places.join(candidates, ["id", "at"]).select("key", "line_no", "id", "at", "m0", "m1", "m2", "m3").dropDuplicates(["id"])
    where = materialize(where)
    # A merge join at every size, here and for the result: a plan that holds when neither side can be sent to all tasks.
    held = keyed.join(where.select("key").distinct().hint("merge"), "key", "left_semi").dropDuplicates(["key"])
    texts = held.select("key", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).join(where, ["key", "line_no"])
    texts = materialize(texts.select("id", "at", normal(F.col("raw")).alias("line"), "m0", "m1", "m2", "m3"))

    entries = texts.select("id", F.explode(variants(line, n, [F.col(f"m{k}") for k in range(4)])).alias("v")).select("id", "v.key", "v.place")
    entries = materialize(entries)
    shared = materialize(entries.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select("key"))
    meeting = materialize(entries.join(shared, "key").join(texts.select("id", "at"), "id").select("key", "place", F.struct("at", "id").alias("own")))
    # Of each key: the earliest line at each place, the line that is the key itself, and the earliest of all.
    at_place = meeting.groupBy("key", "place").agg(F.min("own").alias("first"))
    of_key = meeting.groupBy("key").agg(F.min("own").alias("lowest"), F.min(F.when(F.col("place") < 0, F.col("own"))).alias("itself"))
    earlier = F.when(F.col("place") < 0, F.col("lowest")).otherwise(F.least("first", F.coalesce("itself", "own")))
    pairs = meeting.join(at_place, ["key", "place"]).join(of_key, "key").withColumn("earlier", earlier).filter(F.col("earlier") < F.col("own"))
    pairs = pairs.select(F.col("own.id").alias("id"), F.col("earlier.id").alias("other")).distinct()
    left, right = texts.select("id", F.col("line").alias("x")), texts.select(F.col("id").alias("other"), F.col("line").alias("y"))
    close = pairs.join(left, "id").join(right, "other").filter(F.levenshtein("x", "y", 1) >= 0).select("id").distinct()

    judged = known.select("id", F.col("at").alias("first"), "n_places").join(close.withColumn("near", F.lit(True)), "id", "left")
    judged = materialize(judged.filter(F.col("near") | (F.col("n_places") > 1)).select("id", "first", F.coalesce("near", F.lit(False)).alias("near")))
    gone = places.join(judged, "id").filter(F.col("near") | (F.col("at") > F.col("first")))
    return gone.groupBy("key").agg(F.array_sort(F.collect_set("line_no")).alias("line_nos"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """The documents with their text less repeated lines, and n_lines and n_removed.

    Lines are compared in lower case without white space at the ends, in the
    order of id (null first), row and place; n_lines counts those with anything
    left. A line goes if an earlier one equals it or, for lines of at least
    min_chars characters, is within one edit of it, whether that one itself goes
    or not. Lines shorter than that go only if an equal one is earlier; empty
    lines stay. Texts that are null stay null; rows equal in id and text are one
    document and lose the same lines. No document is dropped.
    """
    lost = removed_lines(docs, id_col, text_col, min_chars).select(F.col("key").alias("_line_key"), F.col("line_nos").alias("_line_nos"))
    base = docs.drop("n_lines", "n_removed")
    joined = base.withColumn("_line_key", row_key(id_col, text_col)).join(lost.hint("merge"), "_line_key", "left")
    split = F.split(F.col(text_col), "\n")
    parts = F.filter(split, lambda x, i: ~F.array_contains(F.col("_line_nos"), i))
    text = F.when(F.col("_line_nos").isNotNull(), F.array_join(parts, "\n")).otherwise(F.col(text_col))
    n_lines = F.size(F.filter(F.coalesce(split, F.array().cast("array<string>")), lambda x: F.btrim(x, F.lit(_SPACES)) != ""))
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in base.columns], n_lines.cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_line_nos"), F.lit(0)).cast("bigint").alias("n_removed"),
    )
