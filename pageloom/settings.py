"""Settings and the two small model tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# US dollars per million tokens, (input, output).
MODEL_PRICING = {
    "gpt-4o-mini": (0.15, 0.60),
    "gpt-4o": (5.00, 15.00),
    "gpt-4-turbo": (10.00, 30.00),
    "gpt-4-turbo-preview": (10.00, 30.00),
    "gpt-3.5-turbo-0125": (0.50, 1.50),
    "gpt-3.5-turbo": (0.50, 1.50),
    "text-embedding-3-small": (0.02, 0.0),
    "text-embedding-3-large": (0.13, 0.0),
    "text-embedding-ada-002": (0.10, 0.0),
}

# Context window in tokens.
MODEL_CONTEXT = {
    "gpt-4o-mini": 128000,
    "gpt-4o": 128000,
    "gpt-4-turbo": 128000,
    "gpt-4-turbo-preview": 128000,
    "gpt-3.5-turbo-0125": 16385,
    "gpt-3.5-turbo": 16385,
}

# Names that also stand for every model name they begin.
MODEL_PREFIXES = ("gpt-4o-mini", "gpt-4o", "gpt-4-turbo", "gpt-3.5-turbo")

DEFAULT_CONTEXT = 100000


# The defaults below.
@dataclass(frozen=True)
class Settings:
    """Limits and model names; every operator takes what it needs as arguments."""

    max_depth: int = 1
    extraction_model: str = "gpt-4o"
    merge_model: str = "gpt-4o"
    rating_model: str = "gpt-4o-mini"
    embedding_model: str = "text-embedding-3-small"
    chunk_tokens: int = 7000
    relevance_threshold: float = 0.3
    markdown_extensions: tuple[str, ...] = (".md", ".mdx", ".markdown")
    embedding_tokens: int = 8190
    topic_tokens: int = 1500
    merge_completion: int = 4096
    # How often a failed request is asked again.
    retries: int = 2
    # None: until every topic is done, failed or stuck.
    max_merge_levels: int | None = None
    separator_tokens: int = 0
    sentence_sep: str = " "


def context_tokens(model: str) -> int:
    """Context window of one model name: exact, then by prefix, then the default."""
    if model in MODEL_CONTEXT:
        return MODEL_CONTEXT[model]
    known = [p for p in MODEL_PREFIXES if model.startswith(p)]
    return MODEL_CONTEXT[max(known, key=len)] if known else DEFAULT_CONTEXT


def alternative_model(model: str) -> str:
    """The second model offered next to a default in a cost estimate."""
    return "gpt-4o" if "mini" in model else "gpt-4o-mini"


def _small_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A few rows as one constant expression, without a Python row source."""
    structs = [F.struct(*[F.lit(v).alias(k) for k, v in row.items()]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def model_pricing(spark: SparkSession) -> DataFrame:
    """Nine rows: model, input_usd, output_usd."""
    return _small_table(
        spark, [{"model": m, "input_usd": i, "output_usd": o} for m, (i, o) in MODEL_PRICING.items()]
    )


def model_limits(spark: SparkSession) -> DataFrame:
    """Six rows: model, context_tokens."""
    return _small_table(spark, [{"model": m, "context_tokens": c} for m, c in MODEL_CONTEXT.items()])
