"""Log files as a stream: every micro-batch's edges and first-seen nodes are appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grainline.sources.logs import event_edges, record_lines, vertices


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Parses new files of JSON lines in folder, appending to out/vertices and out/edges.

    Batches are keyed by their id, so a batch that is run again overwrites its own output.
    """
    lines = spark.readStream.text(folder)

    def append(batch: DataFrame, number: int) -> None:
        records = record_lines(batch).persist()
        for name, df in (("vertices", vertices(records)), ("edges", event_edges(records))):
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        records.unpersist()

    return lines.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n) of a stream of events (ts, event_type), closed once `late` has passed."""
    d = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return d.select(F.col("window.start").alias("start"), "event_type", "n")
