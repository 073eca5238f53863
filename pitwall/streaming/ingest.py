"""Continuous ingestion: raw frames of finished sessions arrive as Parquet files and become dataset tables.

Channels and laps need a whole session, so a file holds whole sessions, and each micro-batch is one
batch run of the operators. A batch writes into folders of its own number, which a repeated batch
overwrites, so tables hold every session once even after a restart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pitwall.config import DEFAULT, Thresholds
from pitwall.operators import channels, events, laps


def ingest(spark: SparkSession, source: str, schema: str, output: str, config: Thresholds = DEFAULT, once: bool = True) -> StreamingQuery:
    """Start the query; with ``once`` it ends when all present files are processed. Tables: samples, laps and the five of events."""

    def batch(frames: DataFrame, number: int) -> None:
        staged = f"{output}/derived/batch={number}"
        channels.derive(frames.repartition("session_id"), config).write.mode("overwrite").parquet(staged)
        derived = frames.sparkSession.read.parquet(staged)
        found = events.detect_all(derived, config)
        tables = {"samples": channels.samples(derived), "laps": laps.with_event_counts(laps.build(derived), found), **found}
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{output}/{name}/batch={number}")

    writer = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", f"{output}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
