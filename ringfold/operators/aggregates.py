"""Grouped aggregates: weighted and variance-carrying means, robust statistics, budgets, votes, histograms.

All combine on the map side where the aggregate allows it; medians use Spark's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Sum of w*v over sum of w; null where no weight is left. Rows with a null or NaN side leave both sums."""
    v, w = _c(value), _c(weight)
    fine = v.isNotNull() & w.isNotNull() & ~F.isnan(v.cast("double")) & ~F.isnan(w.cast("double"))
    total = F.sum(F.when(fine, w))
    return F.when(total != 0, F.sum(F.when(fine, v * w)) / total)


def weighted_variance(variance: Column | str, weight: Column | str) -> Column:
    """Variance of a weighted mean: sum of w^2 * var over the square of the sum of w."""
    v, w = _c(variance), _c(weight)
    return F.when(F.sum(w) != 0, F.sum(w * w * v) / (F.sum(w) * F.sum(w)))


def lower_median(value: Column | str) -> Column:
    """The middle value, the lower one of an even number."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})") if isinstance(value, str) else F.element_at(F.sort_array(F.collect_list(value)), F.floor((F.count(value) + 1) / 2).cast("int"))


def signed_cube_root(x: Column | str) -> Column:
    return F.signum(_c(x)) * F.pow(F.abs(_c(x)), F.lit(1 / 3))


def integrate(frames: DataFrame, bins: DataFrame, frame: str, pixel: str, value: str, bin_column: str, fraction: str, variance: str | None = None, least_area: float = 1e-9) -> DataFrame:
    """(frame, bin, mean, area[, variance]): a sparse map applied to frames. ``bins`` (bin, pixel, fraction).

    Frames are joined with the map on the pixel and summed before the shuffle by (frame, bin).
    """
    met = frames.join(bins, pixel)
    sums = [F.sum(F.col(value) * F.col(fraction)).alias("__s"), F.sum(fraction).alias("area")]
    if variance:
        sums.append(F.sum(F.col(fraction) * F.col(fraction) * F.col(variance)).alias("__v"))
    out = met.groupBy(frame, bin_column).agg(*sums).where(F.col("area") > least_area).withColumn("mean", F.col("__s") / F.col("area"))
    if variance:
        out = out.withColumn("variance", F.col("__v") / (F.col("area") * F.col("area")))
    return out.select(frame, bin_column, "mean", "area", *(["variance"] if variance else []))


def robust_spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, centre, spread): median, and 1.4826 times the median absolute deviation, the population deviation where that is 0."""
    centre = df.groupBy(*keys).agg(F.median(value).alias("centre"), F.stddev_pop(value).alias("__sd"))
    away = df.join(centre, keys).withColumn("__away", F.abs(F.col(value) - F.col("centre")))
    spread = away.groupBy(*keys, "centre", "__sd").agg((F.median("__away") * 1.4826).alias("spread"))
    return spread.select(*keys, "centre", F.when(F.col("spread") > 0, F.col("spread")).otherwise(F.col("__sd")).alias("spread"))


def sigma_clip(df: DataFrame, keys: list[str], value: str, n_sigma: float = 5.0, mode: str = "flag", least: int = 1) -> DataFrame:
    """Values further than n_sigma spreads from their group's median: flagged in ``clipped``, replaced by the median, or set to null. Groups of fewer than ``least`` rows stay."""
    stats = robust_spread(df, keys, value).join(df.groupBy(*keys).agg(F.count(value).alias("__n")), keys)
    out = df.join(stats, keys).withColumn("clipped", (F.abs(F.col(value) - F.col("centre")) > n_sigma * F.col("spread")) & (F.col("__n") >= least))
    if mode == "replace":
        out = out.withColumn(value, F.when(F.col("clipped"), F.col("centre")).otherwise(F.col(value)))
    elif mode == "null":
        out = out.withColumn(value, F.when(~F.col("clipped"), F.col(value)))
    elif mode != "flag":
        raise ValueError(f"unknown mode {mode}")
    return out.drop("centre", "spread", "__n")


def shared_budget(claims: DataFrame, owner: str, item: str, quality: str) -> DataFrame:
    """(owner, owned, claimed, shared, contested): items that one owner claims are owned; a contested one goes to the claimant of best quality (NaN and null lowest, then the smaller owner)."""
    mark = F.coalesce(F.nanvl(F.col(quality).cast("double"), F.lit(float("-inf"))), F.lit(float("-inf")))
    once = claims.groupBy(owner, item).agg(F.max(mark).alias("__q"))
    best = once.groupBy(item).agg(F.count("*").alias("__n"), F.max(F.struct("__q", (-F.col(owner)).alias("o"))).alias("__best"))
    met = once.join(best, item).withColumn("__mine", -F.col("__best.o") == F.col(owner))
    return met.groupBy(owner).agg(
        F.count_if("__mine").alias("owned"), F.count("*").alias("claimed"),
        F.count_if(F.col("__n") > 1).alias("shared"), F.count_if((F.col("__n") > 1) & ~F.col("__mine")).alias("contested"),
    )


def coverage_budget(claims: DataFrame, group: str, owner: str, item: str, most: int = 1, least_new: int = 1) -> DataFrame:
    """(group, owner, new): greedily the owner that adds most items not yet covered ``most`` times, until none adds ``least_new``. Sequential within a group, which is one task's work.

    Gains only fall: when an item is covered, its owners lose one each, so a claim is looked at
    once, and the best owner stands on top of a heap, put back where its gain is stale.
    """
    import heapq

    import numpy as np
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own, owners = pd.factorize(rows[owner], sort=True)
        held, _ = pd.factorize(rows[item])
        use = (own >= 0) & (held >= 0)
        own, held = own[use], held[use]
        by_own, by_item = np.argsort(own, kind="stable"), np.argsort(held, kind="stable")
        items, claimants = held[by_own], own[by_item]
        gains = np.bincount(own, minlength=len(owners))
        begin = np.concatenate([[0], np.cumsum(gains)])
        ends = np.concatenate([[0], np.cumsum(np.bincount(held))])
        seen, out = np.zeros(len(ends) - 1, np.int64), []
        heap = [(-int(g), k) for k, g in enumerate(gains)]
        heapq.heapify(heap)
        while heap:
            gain, best = heapq.heappop(heap)
            if -gain != gains[best]:
                heapq.heappush(heap, (-int(gains[best]), best))
                continue
            if -gain < least_new:
                break
            out.append((rows[group].iloc[0], owners[best], -gain))
            mine = items[begin[best] : begin[best + 1]]
            seen[mine] += 1
            full = mine[seen[mine] == most]
            if len(full):
                size = ends[full + 1] - ends[full]
                at = np.repeat(ends[full] - np.cumsum(size) + size, size) + np.arange(size.sum())
                gains -= np.bincount(claimants[at], minlength=len(gains)) if len(at) > len(gains) else 0
                if len(at) <= len(gains):
                    np.subtract.at(gains, claimants[at], 1)
        return pd.DataFrame(out, columns=[group, owner, "new"])

    kinds = dict(claims.dtypes)
    return claims.select(group, owner, item).distinct().groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {owner} {kinds[owner]}, new long")


def worst_first_budget(df: DataFrame, keys: list[str], size: str, quality: str, tie: str, budget: Column) -> DataFrame:
    """Adds ``dropped``: worst quality first (NaN and null are worst), rows go while what is left exceeds the budget."""
    mark = F.coalesce(F.nanvl(F.col(quality).cast("double"), F.lit(float("-inf"))), F.lit(float("-inf")))
    every = Window.partitionBy(*keys)
    before = Window.partitionBy(*keys).orderBy(mark, tie).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(size).over(every) - F.coalesce(F.sum(size).over(before), F.lit(0))
    return df.withColumn("dropped", left > budget)


def plurality(votes: DataFrame, keys: list[str], candidate: str, residual: str, order: str) -> DataFrame:
    """The most frequent candidate of each key; ties go to the smaller median residual, then to the first seen."""
    counted = votes.groupBy(*keys, candidate).agg(F.count("*").alias("votes"), F.median(residual).alias("__r"), F.min(order).alias("__o"))
    best = counted.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("votes"), "__r", "__o")))
    return best.where("__n = 1").select(*keys, candidate, "votes")


def log_histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) of log10 of positive values in equal bins of [low, high)."""
    step = (high - low) / bins
    return df.where(F.col(value) > 0).select(F.floor((F.log10(value) - low) / step).cast("long").alias("bin")).where((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy("bin").agg(F.count("*").alias("n"))


def antimodes(histogram: DataFrame, bins: int) -> DataFrame:
    """Bins whose count lies below both neighbours'; empty bins count as 0. The histogram is small by construction."""
    grid = histogram.sparkSession.range(bins).withColumnRenamed("id", "bin").join(histogram, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.orderBy("bin")
    return grid.withColumns({"__a": F.lag("n").over(w), "__b": F.lead("n").over(w)}).where("n < __a AND n < __b").select("bin", "n")


def divergence(df: DataFrame, group: str, bucket: str, one: object, two: object, eps: float = 1e-12) -> DataFrame:
    """(kl, js) of the bucket distributions of two groups, in nats; buckets missing on a side count ``eps``."""
    counts = df.where(F.col(group).isin(one, two)).groupBy(bucket).agg(F.count_if(F.col(group) == one).alias("a"), F.count_if(F.col(group) == two).alias("b"))
    every = Window.partitionBy()
    p, q = F.greatest(F.col("a") / F.sum("a").over(every), F.lit(eps)), F.greatest(F.col("b") / F.sum("b").over(every), F.lit(eps))
    m = (F.col("p") + F.col("q")) / 2
    shares = counts.select(p.alias("p"), q.alias("q"))
    return shares.agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"), (F.sum(F.col("p") * F.log(F.col("p") / m)) / 2 + F.sum(F.col("q") * F.log(F.col("q") / m)) / 2).alias("js"))


def stratified_trim(df: DataFrame, keys: list[str], residual: str, tie: str, k: float = 3.0, least: int = 10) -> DataFrame:
    """Rows whose absolute residual lies within median + k * MAD of its cell's, and in any case the ``least`` smallest of each cell."""
    away = df.withColumn("__r", F.abs(residual))
    middle = away.groupBy(*keys).agg(F.median("__r").alias("__m"))
    spread = away.join(middle, keys).groupBy(*keys, "__m").agg(F.median(F.abs(F.col("__r") - F.col("__m"))).alias("__d"))
    ranked = away.join(spread, keys).withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("__r", tie)))
    return ranked.where((F.col("__r") <= F.col("__m") + k * F.col("__d")) | (F.col("__n") <= least)).drop("__r", "__m", "__d", "__n")


def multiple_of_mean_cut(df: DataFrame, residual: str, factor: float, rounds: int = 100) -> DataFrame:
    """Rows whose absolute residual is at most ``factor`` times the mean of those kept, cut until nothing changes. One number comes to the driver each round."""
    kept, limit = df, float("inf")
    for _ in range(rounds):
        mean = kept.agg(F.avg(F.abs(residual))).first()[0]
        if mean is None or mean * factor >= limit:
            break
        limit = mean * factor
        kept = df.where(F.abs(residual) <= limit)
    return kept


def poisson_draws(hashed: Column) -> Column:
    """A Poisson(1) number by a 64-bit hash, eight at most."""
    u = (F.pmod(hashed, F.lit(1 << 52)) + 0.5) / float(1 << 52)
    steps, total, p = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 9):
        total += p
        steps = steps + F.when(u > total, 1).otherwise(0)
        p /= k
    return steps


def bootstrap(df: DataFrame, key: str, value: str, draws: int = 100, seed: int = 1) -> DataFrame:
    """(p16, p50, p84) of the mean over resamples: a row's number of draws in a resample is Poisson(1) by its hash, so no row is drawn on the driver."""
    drawn = df.select(key, value, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("b")).withColumn("w", poisson_draws(F.xxhash64(F.col(key), F.col("b"), F.lit(seed))))
    means = drawn.groupBy("b").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("m"))
    return means.agg(*[F.percentile("m", q).alias(n) for q, n in ((0.16, "p16"), (0.5, "p50"), (0.84, "p84"))])


def leave_one_out(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``jackknife``: the mean of the other rows of the group, null for a single one."""
    w = Window.partitionBy(*keys)
    return df.withColumn("jackknife", F.when(F.count(value).over(w) > 1, (F.sum(value).over(w) - F.col(value)) / (F.count(value).over(w) - 1)))


def geometric_scale(df: DataFrame, keys: list[str], observed: str, predicted: str) -> DataFrame:
    """(keys, scale): geometric mean of observed / predicted over rows where both are positive, 1 where none is."""
    fine = (F.col(observed) > 0) & (F.col(predicted) > 0)
    return df.groupBy(*keys).agg(F.coalesce(F.exp(F.avg(F.when(fine, F.log(F.when(fine, F.col(observed)) / F.when(fine, F.col(predicted)))))), F.lit(1.0)).alias("scale"))
