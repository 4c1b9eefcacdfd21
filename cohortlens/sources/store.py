"""Where intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir. Where that is unset a local master gets a folder of its own; on a
    cluster, whose executors would not see it, that is an error."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if top is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(top)
    return f"{top}/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """`df` written once and read back: what follows neither repeats its work nor carries its plan."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession, rows: int, each: int) -> int:
    """How many tasks share `rows` rows, about `each` a task, so that a task's groups fit its memory at any size; not fewer
    than a shuffle has anyway."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))
