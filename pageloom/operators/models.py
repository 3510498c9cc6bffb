"""Joins with the two fixed model tables and cost estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import count_tokens
from pageloom.settings import (
    DEFAULT_CONTEXT,
    MODEL_CONTEXT,
    MODEL_PREFIXES,
    Settings,
    alternative_model,
    model_limits,
    model_pricing,
)


def with_model_price(df: DataFrame, model: str = "model") -> DataFrame:
    """df with input_usd and output_usd per million tokens; 0 for an unknown model."""
    prices = model_pricing(df.sparkSession).withColumnRenamed("model", model)
    priced = df.join(F.broadcast(prices), model, "left")  # nine rows
    return priced.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("input_usd", "output_usd")})


def with_model_limit(df: DataFrame, model: str = "model") -> DataFrame:
    """df with context_tokens: by exact name, else by longest known beginning, else the default."""
    longest_first = sorted(MODEL_PREFIXES, key=len, reverse=True)
    beginning = F.regexp_extract(F.col(model), "^(" + "|".join(p.replace(".", r"\.") for p in longest_first) + ")", 1)
    known = F.when(F.col(model).isin(*MODEL_CONTEXT), F.col(model)).otherwise(beginning)
    limits = model_limits(df.sparkSession).withColumnRenamed("model", "_known")
    found = df.withColumn("_known", known).join(F.broadcast(limits), "_known", "left").drop("_known")  # six rows
    return found.withColumn("context_tokens", F.coalesce("context_tokens", F.lit(DEFAULT_CONTEXT)))


def token_totals(clean: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Tokens of all texts joined by blank lines, without joining them, and their plain sum."""
    text = F.col("text")
    return clean.groupBy(*(by or [])).agg(
        F.count(text).alias("n_texts"),
        F.floor((F.coalesce(F.sum(F.length(text)), F.lit(0)) + 2 * F.count(text)) / 4).alias("joined_tokens"),
        F.coalesce(F.sum(count_tokens(text)), F.lit(0)).alias("sum_tokens"),
    )


def extraction_output(tokens: Column) -> Column:
    """Estimated output tokens of the extraction step."""
    return F.floor(tokens * F.lit(0.35))


def merge_output(tokens: Column) -> Column:
    """Estimated output tokens of merging: the intermediate texts and the final one."""
    first = F.floor(tokens * F.lit(0.40))
    return first + F.floor(first * F.lit(0.85))


def cost_estimate(totals: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """totals(step, input_tokens, …), step extraction or merge → one row per offered model.

    Adds option (1 the default model, 2 its alternative), model, output_tokens
    and cost_usd.
    """
    extraction, merge = settings.extraction_model, settings.merge_model
    models = F.when(
        F.col("step") == "extraction", F.array(F.lit(extraction), F.lit(alternative_model(extraction)))
    ).otherwise(F.array(F.lit(merge), F.lit(alternative_model(merge))))
    output = F.when(F.col("step") == "extraction", extraction_output(F.col("input_tokens"))).otherwise(
        merge_output(F.col("input_tokens"))
    )
    offered = totals.withColumn("output_tokens", output).select("*", F.posexplode(models).alias("_at", "model"))
    cost = F.col("input_tokens") / 1e6 * F.col("input_usd") + F.col("output_tokens") / 1e6 * F.col("output_usd")
    priced = with_model_price(offered.withColumn("option", F.col("_at") + 1).drop("_at"))
    return priced.withColumn("cost_usd", cost).drop("input_usd", "output_usd")
