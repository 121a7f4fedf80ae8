"""Streams over the journal: validated events and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.sources import events as source
from strandline.sources.eventstore import EventStore, insert_again

LINES = "value string"


def journal_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Lines of journal files as they are finished; unfinished ones don't match."""
    return spark.readStream.schema(LINES).option("pathGlobFilter", "*.ndjson.gz").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).text(path)


def ingest(lines: DataFrame, store: EventStore, bad: str, checkpoint: str) -> StreamingQuery:
    """Add the valid new events to the event store and the lines of others to ``bad``.

    A batch that is run again finds its ids stored and adds nothing, and
    replaces its folder of bad lines.  An id counts once, whatever its days."""

    def batch(df: DataFrame, number: int) -> None:
        parsed = source.parse_lines(df)
        valid, rest = source.split_valid(parsed)
        insert_again(store, valid, facts={"batch": number})
        keep = {"partitionOverwriteMode": "dynamic"}
        rest.select("value", F.lit(number).alias("batch_no")).write.mode("overwrite").options(**keep).partitionBy("batch_no").parquet(bad)

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(events: DataFrame, late: str = "5 minutes") -> DataFrame:
    """Events of each monitor an hour; hours close ``late`` after their end."""
    timed = events.withColumn("at", F.timestamp_millis("ts_utc")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 hour").alias("w"), "monitor").agg(F.count(F.lit(1)).alias("events")).select(F.unix_millis("w.start").alias("hour_ms"), "monitor", "events")
