"""Operators on images in long form, (keys, y, x, v), and on cakes and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def _spread(image: DataFrame, keys: list[str], steps: list[tuple[int, int]], value: str = "v") -> DataFrame:
    """Each pixel's value sent to the places that have it as a neighbour: (keys, y, x, w)."""
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])).alias("s")
    return image.select(*keys, F.col("y").alias("__y"), F.col("x").alias("__x"), F.col(value).alias("w"), table).select(*keys, (F.col("__y") - F.col("s.i")).alias("y"), (F.col("__x") - F.col("s.j")).alias("x"), "w")


def corrected(image: DataFrame, dark: DataFrame, flood: DataFrame, mask: DataFrame, threshold: Column) -> DataFrame:
    """Dark taken off (not below 0), divided by the flood (1 where it has none), masked pixels dropped, only what exceeds the threshold."""
    met = image.join(mask.select("y", "x"), ["y", "x"], "left_anti").join(dark.select("y", "x", F.col("v").alias("__d")), ["y", "x"], "left").join(flood.select("y", "x", F.col("v").alias("__f")), ["y", "x"], "left")
    out = met.withColumn("v", F.greatest((F.col("v") - F.coalesce("__d", F.lit(0.0))) / F.coalesce("__f", F.lit(1.0)), F.lit(0.0)))
    return out.where(F.col("v") > threshold).drop("__d", "__f")


def spatial_median(image: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """3x3 median in ``median``; pixels of the border keep their value. Missing pixels don't count."""
    near = _spread(image, keys, AROUND).groupBy(*keys, "y", "x").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY w)").alias("__m"))
    inner = F.col("y").between(1, height - 2) & F.col("x").between(1, width - 2)
    return image.join(near, [*keys, "y", "x"]).withColumn("median", F.when(inner, F.col("__m")).otherwise(F.col("v"))).drop("__m")


def zero_crossings(image: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Inner pixels with a neighbour of the other sign (0 counts as positive)."""
    signed = image.withColumn("s", (F.col("v") >= 0).cast("int"))
    near = _spread(signed, keys, AROUND, "s").groupBy(*keys, "y", "x").agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    return near.where("lo <> hi").join(image, [*keys, "y", "x"]).where(F.col("y").between(1, height - 2) & F.col("x").between(1, width - 2)).drop("lo", "hi")


def lower_edge(value: Column, edges: list[float]) -> Column:
    """Index of the last edge that isn't above the value, clipped to the edges (left bisection)."""
    out = F.lit(0)
    for e in edges[1:]:
        out = out + F.when(value > e, 1).otherwise(0)
    return F.least(out, F.lit(len(edges) - 2))


def regrouped(cake: DataFrame, keys: list[str], radius: str, value: str, grid: DataFrame, place: str) -> DataFrame:
    """Azimuthal means, then linear interpolation on a common grid (keys, place), clamped at the ends."""
    from ringfold.operators.joins import as_of

    mean = cake.groupBy(*keys, radius).agg(F.avg(value).alias("v"))
    return as_of(grid, mean.withColumnRenamed(radius, place), place, "v", keys, "linear")


def combined(parts: DataFrame, keys: list[str], value: str, sigma: str) -> DataFrame:
    """(keys, value, sigma, n): several detectors on one grid, weighted by inverse variance; without a usable sigma the plain mean and no sigma."""
    fine = F.col(sigma) > 0
    w = F.when(fine, 1 / (F.when(fine, F.col(sigma)) * F.when(fine, F.col(sigma))))
    return parts.groupBy(*keys).agg(F.coalesce(F.sum(w * F.col(value)) / F.sum(w), F.avg(value)).alias("value"), (1 / F.sqrt(F.sum(w))).alias("sigma"), F.count("*").alias("n"))


def moments(df: DataFrame, keys: list[str], place: str, weight: str, least: int) -> DataFrame:
    """(keys, n, centre, fwhm, skewness, total) by weight; keys with fewer than ``least`` rows are dropped, and those without weight."""
    w, x = F.col(weight), F.col(place)
    sums = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(w).alias("s0"), F.sum(w * x).alias("s1"), F.sum(w * x * x).alias("s2"), F.sum(w * x * x * x).alias("s3")).where((F.col("n") >= least) & (F.col("s0") > 0))
    m = F.col("s1") / F.col("s0")
    var = F.greatest(F.col("s2") / F.col("s0") - m * m, F.lit(0.0))
    third = F.col("s3") / F.col("s0") - 3 * m * F.col("s2") / F.col("s0") + 2 * m * m * m
    return sums.select(*keys, "n", m.alias("centre"), (2.3548200450309493 * F.sqrt(var)).alias("fwhm"), F.when(var > 0, third / F.pow(F.when(var > 0, var), 1.5)).alias("skewness"), F.col("s0").alias("total"))


def posterior(shapes: DataFrame, scores: DataFrame, grain: str, voxel: str, shape: str, score: str) -> DataFrame:
    """(grain, voxel, p): each grain's shape over its maximum, times the orientation's score."""
    top = shapes.withColumn("__m", F.max(shape).over(Window.partitionBy(grain)))
    return top.join(scores, [grain, voxel]).select(grain, voxel, F.when(F.col("__m") > 0, F.col(shape) / F.col("__m") * F.col(score)).otherwise(0.0).alias("p"))


def owned(cells: DataFrame, spot: str, grain: str, value: str, share: str) -> DataFrame:
    """Cells of spots that several grains claim, times the grain's share; other cells as they are."""
    many = cells.groupBy(spot).agg(F.count_distinct(grain).alias("__n"))
    return cells.join(many, spot).withColumn(value, F.when(F.col("__n") > 1, F.col(value) * F.col(share)).otherwise(F.col(value))).drop("__n")


def coverage(df: DataFrame, ring: str, masked: Column) -> DataFrame:
    """(ring, coverage): the share of rows that aren't masked."""
    return df.groupBy(ring).agg((F.count_if(~masked) / F.count("*")).alias("coverage"))
