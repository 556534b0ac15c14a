"""Operators over ordered rows: sessions, runs, smoothing, extrema, rolling statistics. Every window has a total order and, where data grow, a partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringfold.operators.graph import settle


def renumber(df: DataFrame, name: str, order: list[str | Column], keys: list[str] | None = None, start: int = 1) -> DataFrame:
    """Rows numbered from ``start`` in the order given, without gaps.

    Without keys the numbers run over the whole table without one task sorting it: rows are
    dealt by range, counted in each partition, and numbered from the sum before.
    """
    if keys:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) + (start - 1))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    # settled, because ranges are sampled anew each time that they are computed
    place = settle(ranged.withColumn("__k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = place.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__b")
    return place.join(F.broadcast(before), "__p").withColumn(name, F.col("__b") + F.col("__k") + start).drop("__p", "__k", "__b")


def sessions(df: DataFrame, keys: list[str], time: str, tie: str, gap: Column) -> DataFrame:
    """Adds ``session`` (from 1 in each key): a new one begins where ``gap``, over the columns ``__dt`` (time since the last row), holds."""
    w = Window.partitionBy(*keys).orderBy(time, tie)
    timed = df.withColumn("__dt", F.col(time).cast("double") - F.lag(F.col(time).cast("double")).over(w))
    return timed.withColumn("session", F.sum(F.when(F.col("__dt").isNull() | gap, 1).otherwise(0)).over(w)).drop("__dt")


def accumulate(df: DataFrame, keys: list[str], weight: str, means: list[str], order: Column, code: str) -> DataFrame:
    """Chain totals: weighted means, extremes, the last value of each mean in order, and the first code that isn't 0."""
    mean = [F.when(F.sum(weight) != 0, F.sum(F.col(m) * F.col(weight)) / F.sum(weight)).alias(f"{m}_mean") for m in means]
    last = [F.max_by(m, order).alias(f"{m}_last") for m in means]
    sticky = F.coalesce(F.min_by(F.when(F.col(code) != 0, F.col(code)), F.when(F.col(code) != 0, order)), F.lit(0)).alias("first_code")
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(weight).alias("weight"), *mean, *last, sticky)


def runs(df: DataFrame, keys: list[str], order: str, flag: Column, least: int) -> DataFrame:
    """(keys, first, last, length) of runs of consecutive rows for which the flag holds, at least ``least`` long."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.select(*keys, order, flag.alias("__f"), F.row_number().over(w).alias("__n")).where("__f")
    island = marked.withColumn("__g", F.col("__n") - F.row_number().over(w))
    return island.groupBy(*keys, "__g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).where(F.col("length") >= least).drop("__g")


def rolling_percentile(df: DataFrame, keys: list[str], order: str, value: str, q: float, half: int, name: str = "background") -> DataFrame:
    """The q-quantile over ``half`` rows on either side; the frame is cut at the ends."""
    return df.withColumn(name, F.percentile(value, q).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)))


def padded_median(df: DataFrame, keys: list[str], order: str, value: str, window: int, name: str = "background") -> DataFrame:
    """Rolling median whose ends are padded by repeating the end values; an even window counts one more. ``order`` is an integer without gaps."""
    half = window // 2
    edges = df.groupBy(*keys).agg(F.min_by(value, order).alias("__a"), F.max_by(value, order).alias("__b"), F.min(order).alias("__lo"), F.max(order).alias("__hi"))
    step = F.explode(F.sequence(F.lit(1), F.lit(half))).alias("__k")
    if not half:
        return df.withColumn(name, F.col(value).cast("double"))
    low = edges.select(*keys, "__a", "__lo", step).select(*keys, (F.col("__lo") - F.col("__k")).alias(order), F.col("__a").alias(value), F.lit(True).alias("__pad"))
    high = edges.select(*keys, "__b", "__hi", step).select(*keys, (F.col("__hi") + F.col("__k")).alias(order), F.col("__b").alias(value), F.lit(True).alias("__pad"))
    every = df.withColumn("__pad", F.lit(False)).unionByName(low, allowMissingColumns=True).unionByName(high, allowMissingColumns=True)
    return every.withColumn(name, F.percentile(value, 0.5).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half))).where("NOT __pad").drop("__pad")


def circular_smooth(df: DataFrame, keys: list[str], index: str, value: str, size: int, weights: list[float], name: str = "smooth") -> DataFrame:
    """Weighted mean over neighbours on a ring of ``size`` places; weights are for offsets -k to k."""
    half = len(weights) // 2
    table = F.array(*[F.struct(F.lit(k - half).alias("o"), F.lit(float(w)).alias("w")) for k, w in enumerate(weights)])
    spread = df.select(*keys, F.col(index).alias("__i"), F.col(value).alias("__v"), F.explode(table).alias("__w")).withColumn(index, F.pmod(F.col("__i") + F.col("__w.o"), F.lit(size)))
    return spread.groupBy(*keys, index).agg((F.sum(F.col("__v") * F.col("__w.w")) / F.sum("__w.w")).alias(name))


def second_difference_peaks(df: DataFrame, keys: list[str], order: str, value: str, least: float) -> DataFrame:
    """Rows that lie above both neighbours by a negative second difference of ``least`` or more."""
    w = Window.partitionBy(*keys).orderBy(order)
    near = df.withColumns({"__a": F.lag(value).over(w), "__b": F.lead(value).over(w)})
    bend = 2 * F.col(value) - F.col("__a") - F.col("__b")
    return near.where((F.col(value) >= F.col("__a")) & (F.col(value) > F.col("__b")) & (bend >= least)).withColumn("bend", bend).drop("__a", "__b")


def difference_to_mean(df: DataFrame, keys: list[str], value: str, variance: str) -> DataFrame:
    """Adds ``delta`` against the mean over the keys' rows, and its variance: (1 - 1/T)^2 var + (sum var - var) / T^2."""
    w = Window.partitionBy(*keys)
    t = F.count("*").over(w)
    var = (1 - 1 / t) * (1 - 1 / t) * F.col(variance) + (F.sum(variance).over(w) - F.col(variance)) / (t * t)
    return df.withColumns({"delta": F.col(value) - F.avg(value).over(w), "delta_variance": var})


def margin(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """(keys, best, margin): the best score's row and its lead over the next, the score itself where there is none."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    led = df.withColumns({"__n": F.row_number().over(w), "__next": F.lead(score).over(w)}).where("__n = 1")
    return led.select(*keys, F.col(tie).alias("best"), (F.col(score) - F.coalesce("__next", F.lit(0))).alias("margin"))


def top_rows(df: DataFrame, keys: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first k rows of each key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def snip(df: DataFrame, keys: list[str], order: str, value: str, width: int) -> DataFrame:
    """Adds ``background`` by statistics-sensitive peak clipping with falling window; a key's profile is one task's work."""
    import numpy as np
    import pandas as pd

    def clip(y: np.ndarray) -> np.ndarray:
        v = np.log(np.log(np.sqrt(np.maximum(y, 0) + 1) + 1) + 1)
        for p in range(width, 0, -1):
            if 2 * p < len(v):
                v[p:-p] = np.minimum(v[p:-p], (v[: -2 * p] + v[2 * p :]) / 2)
        return np.maximum((np.exp(np.exp(v) - 1) - 1) ** 2 - 1, 0)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        return rows.assign(background=clip(rows[value].to_numpy(float).copy()))

    kept = df.select(*keys, order, value)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.groupBy(*keys).applyInPandas(run, f"{kinds}, background double")
