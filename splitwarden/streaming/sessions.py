"""Gap sessions over a stream, with the same boundary as in batch: exactly one gap later still joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions(events: DataFrame, ts: str, by: list[str], gap: str, watermark: str) -> DataFrame:
    """by, start, end, n: sessions that end once nothing comes for longer than the gap.

    For streams and tables alike. Late rows beyond the watermark are dropped by the stream only.
    """
    stamped = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("__ts", watermark)
    w = stamped.groupBy(*by, F.session_window("__ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("__ts").alias("end"))
    return w.select(*by, F.col("w.start").alias("start"), "end", "n")


def write_sessions(sessions: DataFrame, path: str, checkpoint: str):
    """Appends closed sessions to a Parquet table; returns the running query."""
    return sessions.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).start(path)
