"""Streams: line ingest into concepts and links, and a feedback stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hyperspark.functions import text as T


def concept_of_line(line):
    """The first six significant tokens among the first 16 of a line, joined; null with fewer than two."""
    found = F.slice(F.filter(T.tokens(T.sanitise_label(line, 4096), 16), T.is_significant), 1, 6)
    return F.when((F.length(line) >= 4) & (F.size(found) >= 2), F.array_join(found, " "))


def line_concepts(lines: DataFrame, key: str = "source", order: str = "line_no", line: str = "line") -> DataFrame:
    """``(key, order, concept)`` of lines that have one; a concept met again in the same source counts where it is first met."""
    rows = lines.select(key, order, concept_of_line(F.col(line)).alias("concept")).where("concept is not null")
    return rows.groupBy(key, "concept").agg(F.min(order).alias(order)).select(key, order, "concept")


def line_links(concepts: DataFrame, key: str = "source", order: str = "line_no", width: int = 8) -> DataFrame:
    """``(a, b, n)``: concepts within the next ``width`` lines of the same source."""
    near = Window.partitionBy(key).orderBy(order).rowsBetween(-width, -1)
    seen = concepts.select(F.col("concept").alias("b"), F.collect_list("concept").over(near).alias("before"))
    return seen.select("b", F.explode("before").alias("a")).where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str, progress: Callable[[int, int], None] | None = None, max_files: int = 64) -> StreamingQuery:
    """Read text files as they arrive and append their concepts and links under ``target``; each batch is written under its own number,
    so a batch that is run again replaces itself. ``progress`` gets the batch number and its lines."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(source).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("line"))

    def write(batch: DataFrame, number: int) -> None:
        # A file's lines arrive in order within a partition; the running number keeps that order inside a batch.
        numbered = batch.withColumn("line_no", F.monotonically_increasing_id())
        found = line_concepts(numbered).persist()
        try:
            found.write.mode("overwrite").parquet(f"{target}/concepts/batch={number}")
            line_links(found).write.mode("overwrite").parquet(f"{target}/links/batch={number}")
            if progress is not None:
                progress(number, found.count())
        finally:
            found.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame]:
    """All concepts and links written so far, over all batches."""
    concepts = spark.read.parquet(f"{target}/concepts").select("source", "concept").distinct()
    links = spark.read.parquet(f"{target}/links").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return concepts, links


def feedback_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, late: str = "7 days") -> StreamingQuery:
    """Hourly sums of clamped rewards per user from a stream of Parquet files ``(event_id, user_id, ts, reward)``.

    Repeated events within the watermark count once; events later than the watermark are dropped, as the window's result is final.
    """
    events = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))
    clean = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    sums = clean.groupBy(F.window("ts", "1 hour"), "user_id").agg(F.sum(F.greatest(F.least("reward", F.lit(1.0)), F.lit(-1.0))).alias("reward"), F.count(F.lit(1)).alias("n"))
    flat = sums.select(F.col("window.start").alias("hour"), "user_id", "reward", "n")
    return flat.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
