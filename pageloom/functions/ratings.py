"""Parsing of a model's rating."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.text import WS_CLASS, strip

# Headings of the rating format and the texts for a missing section.
JUSTIFICATION_HEADER = "Justification:"
SUGGESTIONS_HEADER = "Suggestions for Improvement:"
NO_JUSTIFICATION = "Justification section not found."
NO_SUGGESTIONS = "Suggestions section not found."


def parse_rating(response: Column, strict: bool = False) -> Column:
    """struct(rating_score, rating_justification, rating_suggestions, raw_rating_output).

    The rating format puts `**` between the colon and the number. By default
    that is accepted; strict=True accepts blanks only, which leaves the score of
    an obedient answer null.
    """
    gap = r"\s*" if strict else r"[\s*]*"
    score = F.regexp_extract(response, rf"(?i)Overall Quality Rating{gap}[:\-]?{gap}\b(10|[1-9])\b", 1)

    after = F.split(response, JUSTIFICATION_HEADER)
    inner = F.split(F.get(after, F.lit(1)), SUGGESTIONS_HEADER)
    outer = F.split(response, SUGGESTIONS_HEADER)
    has_justification = F.size(after) > 1
    justification = F.when(has_justification, strip(F.get(inner, F.lit(0)))).otherwise(F.lit(NO_JUSTIFICATION))
    suggestions = F.coalesce(
        F.when(has_justification, strip(F.get(inner, F.lit(1)))).otherwise(strip(F.get(outer, F.lit(1)))),
        F.lit(NO_SUGGESTIONS),
    )

    def bare(text: Column) -> Column:
        return F.regexp_replace(text, rf"\A[{WS_CLASS}]*[-*]?[{WS_CLASS}]*", "")

    return F.when(
        F.coalesce(response, F.lit("")) != "",
        F.struct(
            F.when(score != "", score).cast("int").alias("rating_score"),
            bare(justification).alias("rating_justification"),
            bare(suggestions).alias("rating_suggestions"),
            response.alias("raw_rating_output"),
        ),
    )
