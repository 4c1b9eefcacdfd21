"""The ingest as a stream that reads what is there and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.facts import enrich
from ..sources.ingest import new_messages

HISTORY = "id long, student_id long, started long, created_at timestamp_ntz"
COLUMNS = ["history_id", "pseudonym", "session_started", "created_at", "batch", "week"]


def ingest_available(spark: SparkSession, source: str, students: DataFrame, key: bytes, target: str, checkpoint: str, *, repeats_within: str | None = None) -> StreamingQuery:
    """Files of history rows in `source` become pseudonymised messages in `target`, partitioned by batch and week.

    The stream itself knows the ids that it has had, as keyed state beside its checkpoint; the target is never read. With
    `repeats_within` (an interval, by created_at) ids are forgotten after that long, and rows that come later than that
    are left out; without it they are kept for good. A batch replaces its own partitions and sees the state it saw before,
    so one that is repeated after a failure is not written twice.
    """
    stream = spark.readStream.schema(HISTORY).parquet(source)
    if repeats_within is None:
        fresh = stream.dropDuplicates(["id"])
    else:
        fresh = stream.withColumn("seen", F.col("created_at").cast("timestamp")).withWatermark("seen", repeats_within).dropDuplicatesWithinWatermark(["id"]).drop("seen")

    def write(batch: DataFrame, number: int) -> None:
        rows = enrich(new_messages(batch, students, -1, key)).withColumn("batch", F.lit(number).cast("long"))
        rows.select(COLUMNS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "week").parquet(target)

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
