"""Queries on streams, each run over the whole events table until it is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.sources.shared import read, scratch
from loomline.streaming import stateful

_S = "CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT)"
SETTLE = 6 * 3600


def _observed(df: DataFrame) -> DataFrame:
    return df.select("user_id", F.when(F.col("event_id") % 3 == 0, "x").otherwise("y").alias("fingerprint"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long").alias("at"))


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there and gives back the table it wrote to the shared folder."""
    spark = stream.sparkSession
    out = scratch(spark, name)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, f"{name}-state")).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def settled_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM1: when each user's last kind of event had stayed the same for six hours."""
    return stateful.settled(_observed(read(spark, sf_dir, "events")), "user_id", "fingerprint", "at", SETTLE)


def settled_folders_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM1, STM2: the same from a stream, micro-batch by micro-batch with the state in a table."""
    held = read(spark, sf_dir, "events")
    stream = spark.readStream.schema(held.schema).parquet(f"{sf_dir}/events.parque[t]")
    folder = scratch(spark, "settled")
    stateful.settle_stream(_observed(stream), folder, "user_id", "fingerprint", "at", SETTLE).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long, fingerprint string, since long, ready_at long").parquet(f"{folder}/out").drop("batch")


SETTLED = f"""WITH o AS (SELECT user_id, CASE WHEN event_id % 3 = 0 THEN 'x' ELSE 'y' END AS fingerprint, {_S} AS tm FROM events),
c AS (SELECT *, CASE WHEN fingerprint = lag(fingerprint) OVER w THEN 0 ELSE 1 END AS c FROM o WINDOW w AS (PARTITION BY user_id ORDER BY tm, fingerprint)),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY tm, fingerprint ROWS UNBOUNDED PRECEDING) AS run FROM c), s AS (SELECT *, min(tm) OVER (PARTITION BY user_id, run) AS since FROM r)
SELECT user_id, fingerprint, since, min(tm) AS ready_at FROM s WHERE tm - since >= {SETTLE} GROUP BY user_id, run, fingerprint, since"""


def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM4: how long each user has to wait after each error."""
    rows = read(spark, sf_dir, "events").where("event_type IN ('error', 'click')").select("user_id", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long").alias("at"))
    return stateful.rate_limits(rows, "user_id", "at", "event_id", forget=48 * 3600).select("user_id", "event_id", "n", "wait")


LIMITS = f"""WITH e AS (SELECT user_id, event_id, {_S} AS tm FROM events WHERE event_type IN ('error', 'click')), f AS (SELECT *, CASE WHEN tm - lag(tm) OVER w > 172800 OR lag(tm) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM e WINDOW w AS (PARTITION BY user_id ORDER BY tm, event_id)),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY tm, event_id ROWS UNBOUNDED PRECEDING) AS s FROM f), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, s ORDER BY tm, event_id) AS n FROM s)
SELECT user_id, event_id, n, CAST(CASE WHEN n < 3 THEN 0 ELSE least(900, pow(2, least(n, 60) - 2)) END AS BIGINT) AS wait FROM n"""


def edit_sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM6: sessions from a stream with a watermark; those still open at the end of the data are not sent."""
    held = read(spark, sf_dir, "events")
    stream = spark.readStream.schema(held.schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("at", F.col("ts").cast("timestamp"))
    return run_to_end(stateful.edit_sessions_stream(stream, "user_id", "event_type", "at", "6 hours", "1 hour"), "edits").select("user_id", "event_type", F.unix_micros("start").alias("start_us"), "n")


QUERIES = {f.__name__: f for f in (settled_folders, settled_folders_stream, rate_limits, edit_sessions_stream)}
ORACLES = {"settled_folders": SETTLED, "settled_folders_stream": SETTLED, "rate_limits": LIMITS}
