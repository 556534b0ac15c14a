"""Grouped summaries of spots, grains, voxels, cakes and sinograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringfold.functions.columns import at


def accumulated(peaks: DataFrame, chain: str, order: str, weight: str, weighted: list[str], largest: list[str], summed: list[str], latest: list[str], flag: str, code: str, omega: str) -> DataFrame:
    """One row for each chain of peaks: means by weight, extremes of omega, maxima, sums, the values of the last peak, whether any is flagged, and the first code that isn't 0."""
    total = F.sum(weight)
    safe = F.when(total != 0, total).otherwise(1.0)
    return peaks.groupBy(chain).agg(
        total.alias(weight), *[(F.sum(F.col(c) * F.col(weight)) / safe).alias(c) for c in weighted], F.min(omega).alias(f"least_{omega}"), F.max(omega).alias(f"most_{omega}"),
        *[F.max(c).alias(c) for c in largest], *[F.sum(c).alias(c) for c in summed], *[F.max_by(c, order).alias(c) for c in latest],
        F.max((F.col(flag) > 0).cast("int")).alias(flag), F.coalesce(F.min_by(code, F.when(F.col(code) != 0, F.col(order))), F.lit(0)).alias(code), F.count("*").alias("n"),
    )


def spot_volume(theta: Column, eta: Column, span: Column, images: Column, intensity: Column, powder: Column, gauge: float, multiplicity: float = 1.0) -> tuple[Column, Column]:
    """(volume, radius) of the grain behind a spot, from its share of the ring's powder intensity; angles in degrees. The radius is that of a sphere, and takes the volume's sign."""
    t, d = F.radians(theta), F.radians(span)
    sine = F.sin(t) * F.cos(d) + F.cos(t) * F.abs(F.sin(F.radians(eta))) * F.sin(d)
    wide = F.asin(F.least(F.greatest(sine, F.lit(-1.0)), F.lit(1.0))) - t
    volume = 0.5 * multiplicity * wide * F.cos(t) * gauge * intensity / (images * powder)
    return volume, F.signum(volume) * F.pow(F.abs(volume) * (3 / (4 * math.pi)), F.lit(1 / 3))


def fused(maps: list[DataFrame], weight: str) -> DataFrame:
    """Several pixel maps as one that averages them: each entry's weight over the number of maps."""
    out = None
    for m in maps:
        out = m if out is None else out.unionByName(m)
    return out.withColumn(weight, F.col(weight) / len(maps))


def mean_orientation(grains: DataFrame, key: str, q: str) -> DataFrame:
    """(key, n, q): the normalised mean of unit quaternions, each turned to the side of its group's first (smallest) one."""
    first = F.min(F.col(q))
    sides = grains.join(grains.groupBy(key).agg(first.alias("__f")), key)
    dot = sum((at(F.col(q), k) * at(F.col("__f"), k) for k in range(4)), F.lit(0.0))
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    sums = sides.groupBy(key).agg(F.count("*").alias("n"), *[F.sum(at(F.col(q), k) * sign).alias(f"__s{k}") for k in range(4)])
    size = F.sqrt(sum((F.col(f"__s{k}") * F.col(f"__s{k}") for k in range(4)), F.lit(0.0)))
    return sums.select(key, "n", F.array(*[F.col(f"__s{k}") / size for k in range(4)]).alias("q"))


def weighted_line(df: DataFrame, keys: list[str], x: str, y: str, weight: str) -> DataFrame:
    """(keys, n, slope, intercept): weighted regression; without spread in x the slope is 0."""
    w = F.col(weight)
    s = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * F.col(x)).alias("wx"), F.sum(w * F.col(y)).alias("wy"), F.sum(w * F.col(x) * F.col(x)).alias("wxx"), F.sum(w * F.col(x) * F.col(y)).alias("wxy"))
    mx, my = F.col("wx") / F.col("w"), F.col("wy") / F.col("w")
    var, cov = F.col("wxx") / F.col("w") - mx * mx, F.col("wxy") / F.col("w") - mx * my
    slope = F.when(var > 1e-12, cov / F.when(var > 1e-12, var)).otherwise(0.0)
    return s.select(*keys, "n", slope.alias("slope"), (my - slope * mx).alias("intercept"))


def balanced_stress(grains: DataFrame, keys: list[str], stress: str, volume: str, applied: tuple[float, ...] = (0.0,) * 6) -> DataFrame:
    """Stresses shifted so that their mean by volume is the applied one: adds ``balanced``, its mean part ``hydrostatic`` and the rest ``deviatoric`` (six parts each)."""
    every = Window.partitionBy(*keys)
    shift = [F.lit(applied[k]) - F.sum(at(F.col(stress), k) * F.col(volume)).over(every) / F.sum(volume).over(every) for k in range(6)]
    out = grains.withColumn("balanced", F.array(*[at(F.col(stress), k) + shift[k] for k in range(6)]))
    out = out.withColumn("hydrostatic", (at(F.col("balanced"), 0) + at(F.col("balanced"), 1) + at(F.col("balanced"), 2)) / 3)
    return out.withColumn("deviatoric", F.array(*[at(F.col("balanced"), k) - (F.col("hydrostatic") if k < 3 else F.lit(0.0)) for k in range(6)]))


def cell_report(df: DataFrame, keys: list[str], residual: str, factor: float) -> DataFrame:
    """(keys, n, median, flagged): each cell's median residual, flagged above ``factor`` times the median over all.

    The median over all is taken from an exact histogram of distinct values, so no task sorts the column.
    """
    counts = df.groupBy(residual).agg(F.count("*").alias("__n"))
    whole = counts.agg(F.percentile(residual, 0.5, F.col("__n")).alias("__g"))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile(residual, 0.5).alias("median")).crossJoin(F.broadcast(whole)).withColumn("flagged", F.col("median") > factor * F.col("__g")).drop("__g")


def ring_chi_squared(cake: DataFrame, rings: DataFrame, radius: str, eta: str, value: str, capture: float) -> DataFrame:
    """(ring, n, chi): sums of each azimuth within ``capture`` of the ring, their squared deviations from the mean over a Poisson variance of 1 at least, by degrees of freedom; null for a single azimuth. ``rings``: (ring, centre)."""
    from ringfold.operators.joins import band_join

    sums = band_join(cake, rings, radius, "centre", capture, strict=False).groupBy("ring", eta).agg(F.sum(value).alias("__i"))
    mean = sums.withColumn("__m", F.avg("__i").over(Window.partitionBy("ring")))
    chi = F.sum(F.pow(F.col("__i") - F.col("__m"), 2) / F.greatest("__i", F.lit(1.0))) / F.nullif(F.count("*") - 1, F.lit(0))
    return mean.groupBy("ring").agg(F.count("*").alias("n"), chi.alias("chi"))


def pair_histogram(points: DataFrame, id_column: str, axes: list[str], reach: float, width: float) -> DataFrame:
    """(bin, n) of distances of all pairs below ``reach``."""
    import math

    import numpy as np
    import pandas as pd

    from ringfold.operators.matching import gaps, in_blocks

    bins = math.ceil(reach / width)

    def run(mine, theirs):
        """Counts of a block's rows against all around it; a pair stands in the block of its later row."""
        at, ids = mine[[f"__a_{x}" for x in axes]].to_numpy(float), mine["__a"].to_numpy()
        own, names = theirs[[f"__b_{x}" for x in axes]].to_numpy(float), theirs["__b"].to_numpy()
        order = np.lexsort(np.floor(own / (reach / 4)).T)
        n, along = np.zeros(bins + 1, np.int64), np.argsort(at[:, 0], kind="stable")
        first, far = at[along, 0], reach * (1 + 1e-9)
        for k in range(0, len(own), 64):
            some = order[k : k + 64]
            low, high = own[some].min(axis=0) - far, own[some].max(axis=0) + far
            about = along[np.searchsorted(first, low[0]) : np.searchsorted(first, high[0], "right")]
            about = about[((at[about, 1:] >= low[1:]) & (at[about, 1:] <= high[1:])).all(axis=1) & (ids[about] < names[some].max())]
            for m in range(0, len(about), 1 << 10):
                part = about[m : m + (1 << 10)]
                d = gaps(own[some], at[part])
                d[(ids[part][None, :] >= names[some][:, None]) | (d >= reach)] = bins * width
                n += np.bincount(np.minimum(d / width, bins).astype(np.int64).ravel(), minlength=bins + 1)
        yield pd.DataFrame({"bin": np.flatnonzero(n[:bins]), "n": n[:bins][n[:bins] > 0]})

    kept = points.where(F.col(id_column).isNotNull())
    a, b = (kept.select(F.col(id_column).alias(f"__{p}"), *[F.col(x).cast("double").alias(f"__{p}_{x}") for x in axes]) for p in "ab")
    counts = in_blocks(a, b, [f"__a_{x}" for x in axes], [f"__b_{x}" for x in axes], reach, run, "bin long, n long")
    return counts.groupBy("bin").agg(F.sum("n").alias("n"))


def sinograms(cells: DataFrame, translation: str, frame: str, values: list[str], last: int, snake: bool = True) -> DataFrame:
    """Cells with the frames of odd translations counted from the other end, all their values together."""
    turned = F.when((F.col(translation) % 2 == 1) & F.lit(snake), last - F.col(frame)).otherwise(F.col(frame))
    return cells.withColumn(frame, turned).select(*[c for c in cells.columns if c not in values], *values)


def is_snake(cells: DataFrame, translation: str, frame: str, value: str, last: int, gain: float = 1.05) -> DataFrame:
    """(as_is, turned, snake): mean correlation of neighbouring translations as they are and with odd ones turned; a snake if that is ``gain`` times better. Needs three translations at least, else null."""
    def agreement(df: DataFrame) -> DataFrame:
        nxt = df.select((F.col(translation) - 1).alias(translation), frame, F.col(value).alias("__w"))
        each = df.join(nxt, [translation, frame]).groupBy(translation).agg(F.corr(value, "__w").alias("__r"))
        return each.where(F.col("__r").isNotNull() & ~F.isnan("__r")).agg(F.avg("__r").alias("r"))

    n = cells.agg(F.count_distinct(translation).alias("n"))
    both = agreement(cells).select(F.col("r").alias("as_is")).crossJoin(agreement(sinograms(cells, translation, frame, [value], last)).select(F.col("r").alias("turned"))).crossJoin(n)
    fine = F.col("n") >= 3
    return both.select(F.when(fine, F.col("as_is")).alias("as_is"), F.when(fine, F.col("turned")).alias("turned"), F.when(fine, F.col("turned") > gain * F.col("as_is")).alias("snake"))


def concentration(sino: DataFrame, grain: str, omega: str, position: str, value: str, least_band: float) -> DataFrame:
    """(grain, a, b, band, share): the curve a sin + b cos (omega in degrees) through the rows' centroids by least squares, a band about it as wide as a uniform object of the rows' median spread, and the share of intensity inside."""
    rows = sino.where(F.col(value) > 0).groupBy(grain, omega).agg(F.sum(value).alias("__w"), F.sum(F.col(value) * F.col(position)).alias("__x"), F.sum(F.col(value) * F.col(position) * F.col(position)).alias("__xx"))
    rows = rows.withColumns({"__c": F.col("__x") / F.col("__w"), "__s": F.sin(F.radians(omega)), "__k": F.cos(F.radians(omega))})
    rows = rows.withColumn("__v", F.greatest(F.col("__xx") / F.col("__w") - F.col("__c") * F.col("__c"), F.lit(0.0)))
    p = rows.groupBy(grain).agg(*[F.sum(F.col(a) * F.col(b)).alias(n) for n, a, b in (("ss", "__s", "__s"), ("kk", "__k", "__k"), ("sk", "__s", "__k"), ("sc", "__s", "__c"), ("kc", "__k", "__c"))], F.percentile(F.sqrt(12 * F.col("__v")), 0.5).alias("spread"))
    d = F.col("ss") * F.col("kk") - F.col("sk") * F.col("sk")
    safe = F.when(F.abs(d) > 1e-12, d)
    curve = p.select(grain, ((F.col("sc") * F.col("kk") - F.col("kc") * F.col("sk")) / safe).alias("a"), ((F.col("kc") * F.col("ss") - F.col("sc") * F.col("sk")) / safe).alias("b"), (F.greatest("spread", F.lit(least_band)) / 2).alias("band"))
    met = sino.join(curve, grain)
    inside = F.abs(F.col(position) - F.col("a") * F.sin(F.radians(omega)) - F.col("b") * F.cos(F.radians(omega))) <= F.col("band")
    return met.groupBy(grain, "a", "b", "band").agg((F.sum(F.when(inside, F.col(value)).otherwise(0.0)) / F.sum(value)).alias("share"))


def projected_mask(cells: DataFrame, voxels: DataFrame, grain: str, omega: str, position: str, x: str, y: str, tolerance: float) -> DataFrame:
    """Cells (grain, omega, position) that some voxel of their grain projects on, or on whose mirror image one does."""
    turned = cells.select(grain, omega).distinct().join(voxels.select(grain, x, y), grain)
    s = F.col(x) * F.sin(F.radians(omega)) + F.col(y) * F.cos(F.radians(omega))
    # positions meet in bins as wide as the tolerance
    shadow = turned.select(grain, omega, F.explode(F.array(s, -s)).alias("__s")).select(grain, omega, "__s", F.explode(F.sequence(F.floor(F.col("__s") / tolerance) - 1, F.floor(F.col("__s") / tolerance) + 1)).alias("__bin"))
    binned = cells.withColumn("__bin", F.floor(F.col(position) / tolerance))
    same = (binned[grain] == shadow[grain]) & (binned[omega] == shadow[omega]) & (binned["__bin"] == shadow["__bin"]) & (F.abs(binned[position] - shadow["__s"]) <= tolerance)
    return binned.join(shadow, same, "left_semi").drop("__bin")


def clipped_rings(pixels: DataFrame, keys: list[str], value: str, n_sigma: float = 5.0, least: int = 16) -> DataFrame:
    """Adds ``outlier`` and ``clean``: values above their ring's median by ``n_sigma`` scaled median deviations, and the median in their place. Rings of fewer than ``least`` pixels, or without spread, stay."""
    middle = pixels.groupBy(*keys).agg(F.percentile(value, 0.5).alias("__m"), F.count("*").alias("__n"))
    spread = pixels.join(middle, keys).groupBy(*keys).agg(F.first("__m").alias("__m"), F.first("__n").alias("__n"), (1.4826 * F.percentile(F.abs(F.col(value) - F.col("__m")), 0.5)).alias("__s"))
    met = pixels.join(spread, keys).withColumn("outlier", (F.col("__n") >= least) & (F.col("__s") > 0) & (F.col(value) > F.col("__m") + n_sigma * F.col("__s")))
    return met.withColumn("clean", F.when(F.col("outlier"), F.col("__m")).otherwise(F.col(value))).drop("__m", "__n", "__s")


def despiked(image: DataFrame, height: int, width: int, n_sigma: float = 5.0) -> DataFrame:
    """(y, x, v, outlier, clean) of a dense image: pixels whose five-point Laplacian (edges repeated) lies ``n_sigma`` scaled deviations off its median, with the 3x3 mean, over the image's ends, in their place."""
    from ringfold.operators.images import AROUND

    clip = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))
    cross = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).alias("w")) for i, j, w in ((-1, 0, 1.0), (1, 0, 1.0), (0, -1, 1.0), (0, 1, 1.0), (0, 0, -4.0))])).alias("s")
    asked = image.select("y", "x", cross).select("y", "x", clip(F.col("y") + F.col("s.i"), height).alias("__y"), clip(F.col("x") + F.col("s.j"), width).alias("__x"), "s.w")
    given = image.select(F.col("y").alias("__y"), F.col("x").alias("__x"), F.col("v").alias("__v"))
    lap = asked.join(given, ["__y", "__x"]).groupBy("y", "x").agg(F.sum(F.col("w") * F.col("__v")).alias("__l"))
    middle = lap.agg(F.percentile("__l", 0.5).alias("__m"))
    spread = lap.crossJoin(F.broadcast(middle)).agg(F.first("__m").alias("__m"), F.percentile(F.abs(F.col("__l") - F.col("__m")), 0.5).alias("__d"), F.stddev_pop("__l").alias("__t"))
    sigma = F.when(F.col("__d") > 0, 1.4826 * F.col("__d")).when(F.col("__t") > 0, F.col("__t")).otherwise(1.0)
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in AROUND])).alias("s")
    near = image.select("y", "x", around).select("y", "x", F.pmod(F.col("y") + F.col("s.i"), F.lit(height)).alias("__y"), F.pmod(F.col("x") + F.col("s.j"), F.lit(width)).alias("__x"))
    mean = near.join(given, ["__y", "__x"]).groupBy("y", "x").agg((F.sum("__v") / 9).alias("__a"))
    met = image.join(lap, ["y", "x"]).join(mean, ["y", "x"]).crossJoin(F.broadcast(spread)).withColumn("outlier", F.abs(F.col("__l") - F.col("__m")) > n_sigma * sigma)
    return met.select("y", "x", "v", "outlier", F.when(F.col("outlier"), F.col("__a")).otherwise(F.col("v")).alias("clean"))


def smoothed_azimuth(cake: DataFrame, keys: list[str], eta: str, value: str, n: int, half: int, periodic: bool = True) -> DataFrame:
    """(keys, eta, median) over 2 * half + 1 azimuth bins 0 to n - 1, over the turn's end or mirrored at it."""
    shifted = F.col(eta) + F.col("__k")
    place = F.pmod(shifted, F.lit(n)) if periodic else F.when(shifted < 0, -shifted - 1).when(shifted >= n, 2 * n - 1 - shifted).otherwise(shifted)
    asked = cake.select(*keys, eta, F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("__k")).withColumn("__e", place)
    given = cake.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(eta).alias("__g"), F.col(value).alias("__v"))
    same = F.col("__e") == F.col("__g")
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    return asked.join(given, same).groupBy(*keys, eta).agg(F.percentile("__v", 0.5).alias("median"))


def first_leader(nodes: DataFrame, pairs: DataFrame, node: str, order: str) -> DataFrame:
    """(node, leader): walking nodes by ``order``, one not yet taken leads and takes all later ones that it is paired with; each goes to the first leader that it meets. ``pairs``: (a, b), in any direction; orders are unique."""
    from ringfold.operators.matching import first_independent

    named = nodes.select(node, F.col(order).alias("__o"))
    both = pairs.join(named.select(F.col(node).alias("a"), F.col("__o").alias("__p")), "a").join(named.select(F.col(node).alias("b"), F.col("__o").alias("__q")), "b")
    links = both.select(F.least("__p", "__q").alias("__lo"), F.greatest("__p", "__q").alias("__hi")).where("__lo < __hi").distinct()
    marked = first_independent(named.select("__o"), links, "__o", "__lo", "__hi")
    leads = marked.where("NOT duplicate").select(F.col("__o").alias("__lo"))
    met = links.join(leads, "__lo").groupBy("__hi").agg(F.min("__lo").alias("__lead"))
    own = named.join(met, F.col("__o") == F.col("__hi"), "left").withColumn("__lead", F.coalesce("__lead", "__o"))
    return own.join(named.select(F.col(node).alias("leader"), F.col("__o").alias("__lead")), "__lead").select(node, "leader")
