"""Queries that run the streams over the input tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hyperspark.plans.runtime import checkpoint_dir, table
from hyperspark.streaming import ingest

QUERIES: dict = {}
SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


#: The stream gives a window once the watermark, seven days behind the latest event, has passed its end.
SQL["stream_feedback"] = (
    "WITH e AS (SELECT DISTINCT event_id, user_id, ts, CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.6 WHEN 'click' THEN 0.3 WHEN 'view' THEN 0.0 ELSE -0.8 END::DOUBLE AS r FROM events), "
    "h AS (SELECT date_trunc('hour', ts) AS hour, user_id, round(sum(r), 6) + 0.0 AS reward, count(*) AS n FROM e GROUP BY 1, 2) SELECT * FROM h WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 7 DAY"
)


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"


@query
def stream_ingest(spark, sf_dir):
    """All document texts as files through the line stream; the concepts found and how often they were linked."""
    base = _folder(spark)
    table(spark, sf_dir, "documents").where("text is not null").select(F.regexp_replace("text", "[\r\n]+", "\n").alias("value")).write.text(f"{base}/in")
    ingest.ingest_stream(spark, f"{base}/in", f"{base}/out", f"{base}/state").awaitTermination()
    return ingest.ingested(spark, f"{base}/out")[1]


@query
def stream_feedback(spark, sf_dir):
    """All events as a feedback stream: hourly rewards per user."""
    from hyperspark.plans.queries_graph import _rewards

    base = _folder(spark)
    _rewards(spark, sf_dir).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "reward").write.parquet(f"{base}/in")
    ingest.feedback_stream(spark, f"{base}/in", "event_id long, user_id long, ts timestamp, reward double", f"{base}/out", f"{base}/state").awaitTermination()
    out = spark.read.schema("hour timestamp, user_id long, reward double, n long").parquet(f"{base}/out")
    return out.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "user_id", (F.round("reward", 6) + 0.0).alias("reward"), "n")
