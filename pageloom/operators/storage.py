"""Cutting the lineage of a loop through a table in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


class _Steps(WeakKeyDictionary):
    """The step tables each session has written and not removed. What travels to a task with a function is empty: sessions stay on the driver."""

    def __reduce__(self):
        return _Steps, ()


_STEPS: WeakKeyDictionary[SparkSession, list[str]] = _Steps()


def _new_step(spark: SparkSession, name: str) -> str:
    path = f"{checkpoint_dir(spark)}/{name}"
    _STEPS.setdefault(spark, []).append(path)
    return path


def drop_steps(spark: SparkSession) -> int:
    """Remove the step tables this session has written so far; their number.

    Results read from them lazily are lost, so this comes after they are
    written. Each table is removed by its own path, in whatever store it lies.
    """
    paths = _STEPS.pop(spark, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or by setCheckpointDir.

    Only a local session without either gets a temporary folder; on a cluster a
    missing setting is an error, since executors would not see such a folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="pageloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the checkpoint folder and read it back.

    The table survives the loss of executors, keeps column pruning and gives
    later joins a real size to plan with.
    """
    path = _new_step(df.sparkSession, f"step-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, *keys: str, dealt: bool = False) -> DataFrame:
    """Write df in the checkpoint folder, bucketed and sorted by keys, and read it back.

    `dealt` says that df is partitioned by the keys already, as after a grouping.

    There are as many buckets as shuffle partitions, so that joins on the keys
    take the table as it lies. Its name leaves the catalog at once; the files stay
    like those of other steps.
    """
    spark = df.sparkSession
    name = f"step_{uuid.uuid4().hex}"
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = _new_step(spark, name)
    (df if dealt else df.repartition(n, *keys)).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    held = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return held
