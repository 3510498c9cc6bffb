"""Dense numbering of ordered rows without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.operators.storage import materialize


def with_sequence(
    df: DataFrame, group: list[str], order: list[str], name: str = "seq", partitions: int | None = None
) -> DataFrame:
    """Number the rows of each group 0, 1, 2, … in the order of unique keys.

    Rows are range-partitioned by (group, order), so that a large group lies in
    many consecutive partitions; each partition numbers its own part and adds
    the number of the group's rows before it. The ranges are drawn from a
    sample, hence they are written down once before both passes read them.
    """
    spark = df.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = materialize(
        df.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id())
    )
    counts = ranged.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per group and partition: at most `partitions` rows in a group.
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*group, "_part").orderBy(*order)
    numbered = ranged.withColumn("_row", F.row_number().over(within))
    return (
        numbered.join(starts, [*group, "_part"])
        .withColumn(name, (F.col("_start") + F.col("_row") - 1).cast("bigint"))
        .drop("_start", "_row", "_part")
    )
