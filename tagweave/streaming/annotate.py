"""Line-at-a-time annotation as a stateless Structured Streaming job.

Row windows are not allowed on streams, so the span offsets use the in-row
form of the regex scan (no shuffle, no state).  Each input line is
``<id>\\t<text>``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave import constants as C
from tagweave.operators.spans import regex_span_items

SPAN_SCHEMA = "doc_id long, ord int, start int, end int, text string, label string"


def annotation_frame(lines: DataFrame) -> DataFrame:
    """``value`` lines -> metric-value spans (works on batch and stream)."""
    parts = F.split(F.col("value"), "\t", 2)
    d = lines.select(F.get(parts, 0).cast("long").alias("doc_id"), F.get(parts, 1).alias("text"))
    d = d.where(F.col("text").rlike(r"\d"))
    items = regex_span_items(F.col("text"), C.METRIC_VALUE_PATTERN, C.YEAR_LIKE_PATTERN)
    return (d.select("doc_id", F.posexplode(items).alias("ord", "s"))
            .select("doc_id", F.col("ord").cast("int").alias("ord"), F.col("s.start").alias("start"),
                    F.col("s.end").alias("end"), F.col("s.text").alias("text"),
                    F.lit(C.METRIC_LABEL).alias("label")))


def annotate_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint_dir: str,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """Run the stream over everything available in ``in_dir`` (trigger
    ``availableNow``), append spans to Parquet in ``out_dir`` with exactly-
    once file sink semantics, and return the written result."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    stream = annotation_frame(reader.load(in_dir))
    q = (stream.writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(SPAN_SCHEMA).parquet(out_dir)
