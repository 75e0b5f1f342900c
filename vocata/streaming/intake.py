"""Intake of new resumes as a stream (an extension: the batch loads have no counterpart)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_resumes(spark: SparkSession, path: str, schema: str, late: str = "7 days") -> DataFrame:
    """Resumes as they arrive, one per content hash within the watermark."""
    rows = spark.readStream.schema(schema).parquet(path).withColumn("content_hash", F.sha2("doc_id", 256))
    rows = rows.withColumn("parsed_status", F.when(F.length(F.trim("raw_text")) > 0, "parsed").otherwise("failed"))
    return rows.withWatermark("arrived_at", late).dropDuplicatesWithinWatermark(["content_hash"])


def run(df: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there now to ``target`` and stops; the checkpoint makes it exactly once."""
    return df.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
