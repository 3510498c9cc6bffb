"""Splitting texts into chunks of bounded token counts, in order, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import WS_CLASS, bind, count_tokens, strip

# A paragraph ends after a code block or after blank lines.
PARAGRAPH_END = r"(\n---\nCODE BLOCK:[\s\S]*?\n---\n|\n\n+)"
LINE_END = r"(?<=[\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029])|(?<=\r)(?!\n)"
_CUT = "\x01"

# Units that one inner pass over a text takes.
_STRIDE = 512

# Kinds of unit: a paragraph, the first piece of a forced paragraph, a later piece.
_WHOLE, _FIRST_PIECE, _NEXT_PIECE = 0, 1, 2
# What the open chunk holds: nothing, paragraphs, pieces.
_NONE, _WHOLES, _PIECES = 0, 1, 2


def _units(text: Column, force_tokens: int, piece_tokens: int | None) -> Column:
    """array<struct<text, kind, by_line, n_tokens>>: the smallest parts that stay whole.

    With piece_tokens, a sentence or line of more tokens is cut in parts of so
    many, which are units of their own.
    """
    plain = F.replace(text, F.lit(_CUT), F.lit(""))
    marked = F.regexp_replace(plain, PARAGRAPH_END, "$1" + _CUT)
    paragraphs = F.filter(F.transform(F.split(marked, _CUT), strip), lambda p: p != "")

    def unit(part: Column, kind: Column, by_line: Column) -> Column:
        return F.struct(
            part.alias("text"), kind.alias("kind"), by_line.alias("by_line"), count_tokens(part).alias("n_tokens")
        )

    # Each transform binds what the next one reads, so that a long paragraph is
    # split once and not once for each of its pieces.
    sentences = F.transform(
        paragraphs,
        lambda p: F.struct(
            p.alias("text"),
            F.when(count_tokens(p) > force_tokens, F.split(p, rf"(?<=[.!?])[{WS_CLASS}]+")).alias("sentences"),
        ),
    )
    pieces = F.transform(
        sentences,
        lambda p: F.struct(
            p["text"].alias("text"),
            (F.size(p["sentences"]) <= 1).alias("by_line"),
            # Without sentences: lines, each with its line end.
            F.when(F.size(p["sentences"]) <= 1, F.split(p["text"], LINE_END)).otherwise(p["sentences"]).alias("parts"),
        ),
    )

    def bounded(parts: Column) -> Column:
        """Parts above piece_tokens in slices of that size; tokens are quarters of the characters."""
        width = 4 * (piece_tokens or 1)
        slices = lambda s: F.transform(
            F.sequence(F.lit(0), F.floor((F.length(s) - 1) / width).cast("int")), lambda k: F.substring(s, k * width + 1, F.lit(width))
        )
        long = lambda s: count_tokens(s) > piece_tokens
        cut = F.flatten(F.transform(parts, lambda s: F.when(long(s), slices(s)).otherwise(F.array(s))))
        return F.when(F.exists(parts, long), cut).otherwise(parts)

    if piece_tokens:
        pieces = F.transform(
            pieces,
            lambda p: F.struct(p["text"].alias("text"), p["by_line"].alias("by_line"), F.when(p["parts"].isNotNull(), bounded(p["parts"])).alias("parts")),
        )
    return F.flatten(
        F.transform(
            pieces,
            lambda p: F.when(
                p["parts"].isNotNull(),
                F.transform(
                    F.filter(p["parts"], lambda s: s != ""),
                    lambda s, i: unit(
                        s, F.when(i == 0, F.lit(_FIRST_PIECE)).otherwise(F.lit(_NEXT_PIECE)), p["by_line"]
                    ),
                ),
            ).otherwise(F.array(unit(p["text"], F.lit(_WHOLE), F.lit(False)))),
        )
    )


def _chunk_starts(units: Column, max_tokens: int, separator_tokens: int) -> Column:
    """Index of the first unit of each chunk: one pass that fills chunks in order.

    Spark copies the state of an aggregate at every step, the starts found so
    far included. So an inner pass over _STRIDE units collects the starts of
    these alone, and the growing list is touched once per stride.
    """
    no_starts = F.array().cast("array<int>")
    start = F.struct(
        F.lit(0).cast("bigint").alias("filled"),
        F.lit(_NONE).alias("holds"),
        F.lit(0).alias("at"),
        no_starts.alias("starts"),
    )

    def step(state: Column, unit: Column) -> Column:
        tokens, kind = unit["n_tokens"], unit["kind"]
        joins = ((kind == _WHOLE) & (state["holds"] == _WHOLES)) | (
            (kind == _NEXT_PIECE) & (state["holds"] == _PIECES)
        )
        gap = F.when(kind == _WHOLE, F.lit(separator_tokens)).otherwise(F.lit(0))
        fits = joins & (state["filled"] + tokens + gap <= max_tokens)
        return F.struct(
            F.when(fits, state["filled"] + tokens + gap).otherwise(tokens).alias("filled"),
            F.when(fits, state["holds"])
            .when(tokens > max_tokens, F.lit(_NONE))
            .when(kind == _WHOLE, F.lit(_WHOLES))
            .otherwise(F.lit(_PIECES))
            .alias("holds"),
            (state["at"] + 1).alias("at"),
            F.when(fits, state["starts"]).otherwise(F.array_append(state["starts"], state["at"])).alias("starts"),
        )

    def fresh(state: Column) -> Column:
        return F.struct(*[state[n].alias(n) for n in ("filled", "holds", "at")], no_starts.alias("starts"))

    def stride(state: Column, part: Column) -> Column:
        def append(done: Column) -> Column:
            return F.struct(
                *[done[n].alias(n) for n in ("filled", "holds", "at")],
                F.concat(state["starts"], done["starts"]).alias("starts"),
            )

        return bind(F.aggregate(part, fresh(state), step), append)

    last = ((F.size(units) - 1) / _STRIDE).cast("int")
    strides = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(units, i * _STRIDE + 1, F.lit(_STRIDE)))
    return F.aggregate(strides, start, stride, lambda state: state["starts"])


def chunk_documents(
    clean: DataFrame,
    max_tokens: int = 7000,
    sentence_sep: str = " ",
    separator_tokens: int = 0,
    strict: bool = False,
) -> DataFrame:
    """chunks(…, chunk_no, text, n_tokens, n_chars_lost) of clean(…, text).

    Paragraphs are packed in order while they fit. One above max_tokens stands
    alone; above 1.2 times that it is split after sentences, or after lines if
    it has one sentence, and packed again. A piece above max_tokens is divided
    into pieces of max_tokens, so that no text is lost. With strict it is cut to
    its first max_tokens tokens instead; n_chars_lost says what that cost. A
    text without content gives no chunk. All other columns are carried along.
    """
    force_tokens = int(max_tokens * 1.2)
    keep = [c for c in clean.columns if c not in ("text", "n_tokens", "chunk_no", "n_chars_lost")]
    split = clean.select(*keep, _units(F.col("text"), force_tokens, None if strict else max_tokens).alias("_units"))
    started = split.withColumn("_starts", _chunk_starts(F.col("_units"), max_tokens, separator_tokens))

    def members(first: Column, number: Column) -> Column:
        following = F.coalesce(F.get(F.col("_starts"), number + 1), F.size("_units"))
        return F.slice(F.col("_units"), first + 1, following - first)

    def chunk(units: Column, number: Column) -> Column:
        head = F.get(units, F.lit(0))
        glue = (
            F.when(head["kind"] == _WHOLE, F.lit("\n\n")).when(head["by_line"], F.lit("")).otherwise(F.lit(sentence_sep))
        )
        cut = (head["kind"] != _WHOLE) & (head["n_tokens"] > max_tokens)
        whole = F.call_function("array_join", F.transform(units, lambda u: u["text"]), glue)
        kept = strip(F.when(cut, F.substring(head["text"], 1, 4 * max_tokens)).otherwise(whole))
        lost = F.when(cut, F.greatest(F.length(head["text"]) - 4 * max_tokens, F.lit(0))).otherwise(F.lit(0))
        return F.struct(number.alias("chunk_no"), kept.alias("text"), lost.alias("n_chars_lost"))

    exploded = started.select(*keep, F.inline(F.transform(F.transform("_starts", members), chunk)))
    return exploded.select(*keep, "chunk_no", "text", count_tokens(F.col("text")).alias("n_tokens"), "n_chars_lost")
