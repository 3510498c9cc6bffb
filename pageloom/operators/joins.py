"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The list of hot keys that is broadcast never has more rows than this. Keys
# beyond it are joined the ordinary way, so the result does not depend on it.
MAX_HOT_KEYS = 1000

# Rows that Spark estimates below this size in all cannot hide a hot key.
SMALL_BYTES = 256 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own size estimate of a plan; for a written table, the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _spread(
    many: DataFrame, other: DataFrame, on: list[str], counted: DataFrame, by: list[str], hot_rows: int, salts: int, salt: str
) -> tuple[DataFrame, DataFrame]:
    """many with a salt for its hot keys, and other with each row of these keys once per salt."""
    counts = counted.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    hot = counts.orderBy(F.col("_n").desc()).limit(MAX_HOT_KEYS).select(*on, F.lit(True).alias("_hot"))
    part = F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    salted = many.join(F.broadcast(hot), on, "left").withColumn(salt, F.when(F.col("_hot"), part).otherwise(F.lit(0)))
    repeated = other.join(F.broadcast(hot), on, "left").withColumn(
        salt, F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0))))
    )
    return salted.drop("_hot"), repeated.drop("_hot")


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "left",
    hot_rows: int = 1_000_000,
    salts: int = 64,
    small_bytes: int = SMALL_BYTES,
    counted: DataFrame | None = None,
    spread_table_by: list[str] | None = None,
) -> DataFrame:
    """Join rows with a table, spreading keys that hold more than `hot_rows` rows.

    A hot key's rows are divided among `salts` tasks by a hash of `spread_by`,
    and its table rows are repeated once for each; every other key is joined
    once. Only left and inner joins are offered, where this leaves the result
    unchanged. With spread_table_by, for inner joins, keys that are hot in the
    table are spread as well. Keys are counted, and the size is taken, in
    `counted` where rows are dear to compute twice or their size is not known.
    """
    if how not in ("left", "inner") or (spread_table_by and how != "inner"):
        raise ValueError(f"lookup_join cannot do this {how} join")
    counted = rows if counted is None else counted
    spread_rows = estimated_bytes(counted) >= small_bytes
    spread_table = spread_table_by is not None and estimated_bytes(table) >= small_bytes
    keys = list(on)
    if spread_rows:
        rows, table = _spread(rows, table, on, counted, spread_by, hot_rows, salts, "_salt")
        keys.append("_salt")
    if spread_table:
        table, rows = _spread(table, rows, on, table, spread_table_by, hot_rows, salts, "_table_salt")
        keys.append("_table_salt")
    return rows.join(table, keys, how).drop("_salt", "_table_salt")
