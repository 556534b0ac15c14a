"""Queries that show streams and solvers on the common tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfold.functions.columns import micros
from ringfold.operators import fits
from ringfold.operators.graph import settle
from ringfold.plans.registry import Registry, Tables
from ringfold.streaming import frames

queries = Registry()


def _folder(spark: SparkSession, name: str) -> str:
    settle(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@queries.add("""
    WITH m AS (SELECT user_id AS pixel, user_id % 7 AS bin, 1.0 / (1 + user_id % 3) AS f FROM (SELECT DISTINCT user_id FROM events))
    SELECT event_type, CAST(bin AS BIGINT) AS bin, round(sum(value * f) / sum(f), 6) AS mean, round(sum(f), 6) AS area FROM events JOIN m ON pixel = user_id GROUP BY 1, 2""")
def streamed_integration(t: Tables) -> DataFrame:
    """Frames from a file stream, integrated with a static map, batch by batch, and read back."""
    spark, home = t.spark, _folder(t.spark, "stream")
    t.events.select("event_type", "user_id", "value").repartition(1).write.parquet(f"{home}/in")
    bins = t.events.select("user_id").distinct().select("user_id", (F.col("user_id") % 7).alias("bin"), (1.0 / (1 + F.col("user_id") % 3)).alias("fraction"))
    frames.integrated(frames.file_stream(spark, f"{home}/in", "event_type string, user_id long, value double"), bins, f"{home}/out", f"{home}/state", "event_type", "user_id", "value")
    return spark.read.parquet(f"{home}/out").select("event_type", "bin", F.round("mean", 6).alias("mean"), F.round("area", 6).alias("area"))


@queries.add("""
    SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def windowed_counts(t: Tables) -> DataFrame:
    """Tumbling windows of a day over a file stream, with a watermark, as a complete result."""
    spark, home = t.spark, _folder(t.spark, "windows")
    t.events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").repartition(2).write.parquet(f"{home}/in")
    stream = frames.file_stream(spark, f"{home}/in", "ts timestamp, event_type string, value double").withWatermark("ts", "1 day")
    counted = stream.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    frames.drain(counted, lambda batch, number: batch.write.mode("overwrite").parquet(f"{home}/out"), f"{home}/state", "complete")
    return spark.read.parquet(f"{home}/out").select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@queries.add("""
    WITH e AS (SELECT event_type, epoch_us(ts) / 1e6 AS moment, value FROM events), g AS (SELECT *, CASE WHEN moment - lag(moment) OVER (PARTITION BY event_type ORDER BY moment) > 3600 THEN 1 ELSE 0 END AS cut FROM e), c AS (SELECT *, sum(cut) OVER (PARTITION BY event_type ORDER BY moment ROWS UNBOUNDED PRECEDING) AS chain FROM g)
    SELECT event_type, min(moment) AS first, max(moment) AS last, count(*) AS rows, round(sum(value), 4) AS total FROM c GROUP BY event_type, chain""")
def streamed_chains(t: Tables) -> DataFrame:
    """Chains of each type's events, closed by a gap of an hour, with state kept over the batches of a file stream; the last ones, still open, are there too."""
    spark, home = t.spark, _folder(t.spark, "chains")
    e = t.events.select("event_type", (micros("ts") / 1e6).alias("at"), "value")
    cuts = e.agg(F.percentile_approx("at", [0.3, 0.6])).first()[0] or [0.0, 0.0]
    for lo, hi in ((float("-inf"), cuts[0]), (cuts[0], cuts[1]), (cuts[1], float("inf"))):
        e.where((F.col("at") > lo) & (F.col("at") <= hi)).coalesce(1).write.mode("append").parquet(f"{home}/in")
    stream = frames.chains(frames.file_stream(spark, f"{home}/in", "event_type string, at double, value double"), "event_type", "at", "value", 3600.0)
    frames.drain(stream, lambda batch, number: batch.write.mode("overwrite").parquet(f"{home}/out/batch={number}"), f"{home}/state")
    return frames.latest_chains(spark.read.parquet(f"{home}/out"), "event_type").withColumn("total", F.round("total", 4))


@queries.add()
def peak_fits(t: Tables) -> DataFrame:
    """A peak for each brand's mean price by size."""
    points = t.part.groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("y"))
    return fits.fit_peaks(points.withColumn("x", F.col("p_size").cast("double")), "p_brand", "x", "y").select("p_brand", F.round("centre", 3).alias("centre"))


@queries.add()
def strain_fits(t: Tables) -> DataFrame:
    """Six strain parts for each label from directions and changes."""
    v = t.embeddings.select("label", *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(("x", "y", "z", "s"))])
    size = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    unit = v.withColumn("n", size).where("n > 0").select("label", *[(F.col(c) / F.col("n")).alias(c) for c in "xyz"], "s")
    return fits.fit_strain(unit, "label", ("x", "y", "z"), "s")


@queries.add()
def slice_reconstruction(t: Tables) -> DataFrame:
    """A slice from the sums of line items by angle and place."""
    s = t.lineitem.groupBy("l_linestatus", (F.col("l_partkey") % 36 * 5.0).alias("angle"), (F.col("l_suppkey") % 32).alias("place")).agg(F.sum("l_quantity").alias("v"))
    return fits.reconstruct(s, "l_linestatus", "angle", "place", "v", 32)


@queries.add()
def claimed_volumes(t: Tables) -> DataFrame:
    """Non-negative volumes of suppliers that explain the orders' totals."""
    c = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("w"), F.first("o_totalprice").alias("target"))
    return fits.volumes(c, "l_orderkey", "l_suppkey", "w", "target")
