"""Streams over the events table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sedimenta.plans.records import scratch
from sedimenta.sources.tables import table
from sedimenta.streaming import streams


def stream_hourly_counts(spark, d):
    stream = streams.events_stream(spark, f"{d}/events.parquet").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return streams.run_to_table(streams.windowed_counts(stream, "ts", ["event_type"], "cents"))


def stream_batch_faults(spark, d):
    """Users as streams, the events' ids modulo 7 as batch numbers."""
    batches = table(spark, d, "events").select(F.col("user_id").alias("stream_id"), (F.col("event_id") % 7).alias("batch_index"))
    return streams.batch_faults(batches)


def stream_first_seen(spark, d):
    """Users' kinds of events as they first come."""
    stream = streams.events_stream(spark, f"{d}/events.parquet")
    return streams.run_to_table(streams.first_seen(stream, "ts", ["user_id", "event_type"], "3650 days").select("user_id", "event_type"), "append")


def stream_manifest(spark, d):
    """Users as streams and their events as batches, out of order and in three parts, a manifest in the second. Some lack a batch
    or a manifest, some have a batch twice, one too many or the wrong number of rows."""
    path = scratch(spark, "messages")
    user, place = F.col("user_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    batches = table(spark, d, "events").select(user.alias("stream_id"), place.cast("long").alias("number"), (F.col("event_id") % 5).alias("rows"))
    told = batches.groupBy("stream_id").agg(F.count(F.lit(1)).alias("number"), (F.sum("rows") + F.when(F.col("stream_id") % 13 == 0, 1).otherwise(0)).alias("rows"))
    sent = batches.where(~((F.col("stream_id") % 10 == 0) & (F.col("number") == 3)))
    more = sent.where((F.col("stream_id") % 7 == 0) & (F.col("number") == 1)).withColumn("rows", F.lit(0).cast("long"))
    beyond = told.where("stream_id % 9 = 0").select("stream_id", (F.col("number") + 5).alias("number"), F.lit(0).cast("long").alias("rows"))
    manifest = told.where("stream_id % 11 <> 0").withColumn("kind", F.lit("manifest"))
    end = spark.createDataFrame([(-1, 0, 0, "manifest")], "stream_id long, number long, rows long, kind string")
    part = lambda i: sent.where(F.col("number") % 3 == i).withColumn("kind", F.lit("batch"))
    extra = more.union(beyond).withColumn("kind", F.lit("batch"))
    for i, rows in enumerate((part(0).unionByName(extra), part(1).unionByName(manifest), part(2), end)):
        at = F.lit(f"2024-01-01 0{i}:00:00" if i < 3 else "2030-01-01 00:00:00").cast("timestamp")
        rows.withColumn("ts", at).write.mode("append").parquet(path)
    return streams.run_to_table(streams.manifest_integrity(streams.events_stream(spark, path), late="12 hours"), "append").where("stream_id >= 0")


QUERIES = {q.__name__: q for q in (stream_hourly_counts, stream_batch_faults, stream_first_seen, stream_manifest)}

ORACLE_SQL = {
    "stream_hourly_counts": """
        SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total
        FROM events GROUP BY 1, 2""",
    "stream_batch_faults": """
        WITH b AS (SELECT user_id AS stream_id, count(*) AS n, count(DISTINCT event_id % 7) AS d, max(event_id % 7) AS l FROM events GROUP BY 1)
        SELECT stream_id, 'duplicate' AS fault FROM b WHERE n > d UNION ALL SELECT stream_id, 'gap' FROM b WHERE l + 1 > d""",
    "stream_first_seen": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_manifest": """
        WITH b AS (
            SELECT user_id AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS number, event_id % 5 AS n FROM events
        ), t AS (
            SELECT s, count(*) AS total, sum(n) AS told, count(*) FILTER (NOT (s % 10 = 0 AND number = 3)) AS sent, CAST(sum(n) FILTER (NOT (s % 10 = 0 AND number = 3)) AS BIGINT) AS got FROM b GROUP BY s
        ), f AS (
            SELECT *, s % 11 = 0 AS no_manifest, s % 10 = 0 AND total > 3 AS gap FROM t
        )
        SELECT s AS stream_id, sent + CAST(s % 9 = 0 AS INT) AS batches, got AS "rows",
            concat_ws(',', CASE WHEN no_manifest THEN 'unterminated' WHEN gap THEN 'gap' END, CASE WHEN s % 7 = 0 AND total > 1 THEN 'duplicate' END, CASE WHEN s % 9 = 0 AND NOT no_manifest THEN 'beyond' END,
                CASE WHEN NOT no_manifest AND got <> told + CAST(s % 13 = 0 AS INT) THEN 'rows' END) AS faults FROM f""",
}
