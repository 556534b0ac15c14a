"""Joins by tolerance, nearness and order, as equi-joins on bins with the exact condition after.

None of them builds a product of two tables: a tolerance becomes bins at least as wide as
the tolerance, so a row meets only rows of its own and neighbouring bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a side that is broadcast without asking Spark's own statistics.
BROADCAST_ROWS = 10_000


def _bin(x: Column | str, width: float) -> Column:
    return F.floor((F.col(x) if isinstance(x, str) else x) / width).cast("long")


def near_bins(x: Column | str, reach: float, width: float) -> Column:
    """All bins of ``width`` that [x - reach, x + reach] touches; one row for each."""
    c = F.col(x) if isinstance(x, str) else x
    return F.explode(F.sequence(_bin(c - reach, width), _bin(c + reach, width)))


def band_join(left: DataFrame, bands: DataFrame, value: str, centre: str, half: float, strict: bool = True) -> DataFrame:
    """One row for every band whose centre lies within ``half`` of the value; a row in no band is dropped."""
    gap = F.abs(F.col(value) - F.col(centre))
    fits = gap < half if strict else gap <= half
    binned = bands.withColumn("__bin", near_bins(centre, half, 2 * half))
    return left.withColumn("__bin", _bin(value, 2 * half)).join(binned, "__bin").where(fits).drop("__bin")


def tolerance_join(left: DataFrame, right: DataFrame, keys: list[str], tolerances: dict[str, float], prefix: str = "r_") -> DataFrame:
    """Pairs of equal keys whose columns all differ by less than their tolerance. The right side's columns get a prefix."""
    first, *_ = tolerances
    width = tolerances[first]
    other = right.select(*[F.col(c).alias(prefix + c) for c in right.columns])
    probe = left.withColumn("__bin", near_bins(first, width, width))
    index = other.withColumn("__bin", _bin(prefix + first, width))
    same = probe["__bin"] == index["__bin"]
    for k in keys:
        same = same & (probe[k] == index[prefix + k])
    inside = F.lit(True)
    for c, t in tolerances.items():
        inside = inside & (F.abs(F.col(c) - F.col(prefix + c)) < t)
    return probe.join(index, same).where(inside).drop("__bin")


def pairs_within(points: DataFrame, id_column: str, axes: list[str], radius: float, keys: list[str] | None = None) -> DataFrame:
    """(keys, a, b, distance) of points of equal keys nearer than ``radius`` (Euclid), a < b."""
    keys = keys or []
    base = points.select(*keys, F.col(id_column).alias("a"), *[F.col(x).alias(f"a_{x}") for x in axes])
    cells = base.select("*", *[_bin(f"a_{x}", radius).alias(f"__c{k}") for k, x in enumerate(axes)])
    other = base.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("a").alias("b"), *[F.col(f"a_{x}").alias(f"b_{x}") for x in axes])
    for k, x in enumerate(axes):
        other = other.withColumn(f"__d{k}", F.explode(F.sequence(_bin(f"b_{x}", radius) - 1, _bin(f"b_{x}", radius) + 1)))
    same = F.lit(True)
    for k in range(len(axes)):
        same = same & (F.col(f"__c{k}") == F.col(f"__d{k}"))
    for k in keys:
        same = same & (cells[k] == other[f"__{k}"])
    distance = F.sqrt(sum(((F.col(f"a_{x}") - F.col(f"b_{x}")) * (F.col(f"a_{x}") - F.col(f"b_{x}")) for x in axes), F.lit(0.0)))
    # rows that stand in all cells around are more than statistics tell: neither side is broadcast
    return cells.join(other.hint("merge"), same & (F.col("a") < F.col("b"))).withColumn("distance", distance).where(F.col("distance") < radius).select(*keys, "a", "b", "distance")


def interval_lookup(left: DataFrame, intervals: DataFrame, value: str, start: str, stop: str, label: str, absent: int = -1) -> DataFrame:
    """The label of the half-open interval [start, stop) that holds the value, ``absent`` if none does. Intervals don't overlap."""
    starts = intervals.select(F.col(start).alias("__at"), F.col(stop).alias("__stop"), F.col(label).alias("__label"))
    if intervals.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        found = left.join(F.broadcast(starts), (F.col(value) >= F.col("__at")) & (F.col(value) < F.col("__stop")), "left")
    else:
        # each interval lies in bins of the median length, so that few bins hold it
        width = max(1.0, float(starts.agg(F.percentile_approx(F.col("__stop") - F.col("__at"), 0.5)).first()[0]))
        spread = starts.withColumn("__bin", F.explode(F.sequence(_bin("__at", width), _bin("__stop", width))))
        inside = (F.col("__v") == F.col("__bin")) & (F.col(value) >= F.col("__at")) & (F.col(value) < F.col("__stop"))
        found = left.withColumn("__v", _bin(value, width)).join(spread, inside, "left").drop("__bin", "__v")
    return found.withColumn(label, F.coalesce("__label", F.lit(absent))).drop("__at", "__stop", "__label")


def as_of(left: DataFrame, right: DataFrame, time: str, value: str, keys: list[str] | None = None, mode: str = "previous") -> DataFrame:
    """Adds ``value`` of the right side as of each row's time: the previous sample, linear between two, or the nearest (ties to the earlier).

    Times outside the samples take the first or last sample. Right times are unique for each
    key. One sort by key and time: samples and rows are laid together, and the neighbours come
    from windows.
    """
    keys = keys or []
    mine = left.withColumns({"__t": F.col(time).cast("double"), "__v": F.lit(None).cast("double"), "__row": F.lit(1)})
    samples = right.select(*keys, F.col(time).cast("double").alias("__t"), F.col(value).cast("double").alias("__v"), F.lit(0).alias("__row"))
    both = mine.unionByName(samples, allowMissingColumns=True).withColumn("__s", F.when(F.col("__row") == 0, F.struct("__t", "__v")))
    base = Window.partitionBy(*keys).orderBy("__t", "__row")
    before = F.last("__s", ignorenulls=True).over(base.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # samples at the row's own time sort before it, so the next one is later
    after = F.first("__s", ignorenulls=True).over(base.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    placed = both.withColumns({"__a": before, "__b": after}).where("__row = 1")
    a, b = F.coalesce("__a", "__b"), F.coalesce("__b", "__a")
    if mode == "previous":
        out = a["__v"]
    elif mode == "nearest":
        out = F.when(F.col("__t") - a["__t"] <= b["__t"] - F.col("__t"), a["__v"]).when(F.col("__t") < a["__t"], a["__v"]).otherwise(b["__v"])
    elif mode == "linear":
        span = b["__t"] - a["__t"]
        out = F.when((span == 0) | F.col("__a").isNull() | F.col("__b").isNull(), a["__v"]).otherwise(a["__v"] + (b["__v"] - a["__v"]) * (F.col("__t") - a["__t"]) / span)
    else:
        raise ValueError(f"unknown mode {mode}")
    return placed.withColumn(value, out).drop("__t", "__v", "__row", "__s", "__a", "__b")


def nearest_within(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_value: str, right_value: str, tolerance: float) -> DataFrame:
    """Left rows with the right id nearest in value (ties to the smaller id), null beyond the tolerance."""
    width = tolerance if tolerance else 1.0
    probe = left.withColumn("__bin", near_bins(left_value, tolerance, width))
    index = right.select(F.col(right_id).alias("__id"), F.col(right_value).alias("__v"), _bin(right_value, width).alias("__rb"))
    met = probe.join(index, F.col("__bin") == F.col("__rb"), "left").withColumn("__gap", F.abs(F.col(left_value) - F.col("__v"))).withColumn("__gap", F.when(F.col("__gap") <= tolerance, F.col("__gap")))
    best = met.groupBy(left_id, left_value).agg(F.min(F.when(F.col("__gap").isNotNull(), F.struct("__gap", "__id"))).alias("__best"))
    return best.select(left_id, left_value, F.col("__best.__id").alias(right_id), F.col("__best.__gap").alias("gap"))


def mutual_nearest(pairs: DataFrame, a: str, b: str, distance: str) -> DataFrame:
    """Pairs in which each side is the other's nearest (ties to the smaller id)."""
    best_a = pairs.groupBy(a).agg(F.min(F.struct(distance, b)).alias("__b"))
    best_b = pairs.groupBy(b).agg(F.min(F.struct(distance, a)).alias("__a"))
    return best_a.select(a, F.col(f"__b.{b}").alias(b), F.col(f"__b.{distance}").alias(distance)).join(best_b.select(F.col(b).alias("__k"), F.col(f"__a.{a}").alias("__m")), (F.col(b) == F.col("__k")) & (F.col(a) == F.col("__m"))).select(a, b, distance)


def overlap_match(left: DataFrame, right: DataFrame, cell: list[str], a: str, b: str) -> DataFrame:
    """(a, b, shared): for each a the b with which it shares most cells, kept where a is also b's best. Ties to the smaller id."""
    shared = left.join(right, cell).groupBy(a, b).agg(F.count("*").alias("shared"))
    ahead = shared.groupBy(a).agg(F.max(F.struct("shared", (-F.col(b)).alias("n"))).alias("m")).select(a, (-F.col("m.n")).alias(b), F.col("m.shared").alias("shared"))
    back = shared.groupBy(b).agg(F.max(F.struct("shared", (-F.col(a)).alias("n"))).alias("m")).select(F.col(b).alias("__b"), (-F.col("m.n")).alias("__a"))
    return ahead.join(back, (F.col(b) == F.col("__b")) & (F.col(a) == F.col("__a"))).select(a, b, "shared")


def shared_member_pairs(members: DataFrame, group: str, member: str, least: float, most_groups: int | None = None) -> DataFrame:
    """(a, b, shared, jaccard) of groups that share members, by an inverted index; Jaccard at least ``least``.

    Without ``most_groups`` the result is whole; a member of more groups than that is left out where it is given.
    """
    held = members.select(F.col(group).alias("g"), F.col(member).alias("m")).distinct()
    if most_groups:
        held = held.join(held.groupBy("m").agg(F.count("*").alias("n")).where(F.col("n") <= most_groups).select("m"), "m", "left_semi")
    sizes = held.groupBy("g").agg(F.count("*").alias("size"))
    shared = held.select(F.col("g").alias("a"), "m").join(held.select(F.col("g").alias("b"), "m"), "m").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = shared.join(sizes.select(F.col("g").alias("a"), F.col("size").alias("sa")), "a").join(sizes.select(F.col("g").alias("b"), F.col("size").alias("sb")), "b")
    return out.withColumn("jaccard", F.col("shared") / (F.col("sa") + F.col("sb") - F.col("shared"))).where(F.col("jaccard") >= least).select("a", "b", "shared", "jaccard")


def outer_report(left: DataFrame, right: DataFrame, key: str, fill: dict[str, object]) -> DataFrame:
    """Rows of both sides by key, what is missing on a side filled."""
    return left.join(right, key, "full_outer").na.fill(fill)


def with_default(left: DataFrame, lookup: DataFrame, key: str, value: str, default: float) -> DataFrame:
    """Left rows with the lookup's value, the default where it has none."""
    return left.join(lookup.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def nearest_reference(left: DataFrame, references: DataFrame, left_id: str, cost: Column, reference: str) -> DataFrame:
    """(left id, reference, cost): the cheapest of a small fixed list of references for each row, ties to the smaller."""
    met = left.crossJoin(F.broadcast(references)).withColumn("cost", cost)
    best = met.groupBy(left_id).agg(F.min(F.struct("cost", reference)).alias("m"))
    return best.select(left_id, F.col(f"m.{reference}").alias(reference), F.col("m.cost").alias("cost"))


def greedy_assignment(pairs: DataFrame, group: str, a: str, b: str, cost: str) -> DataFrame:
    """Cheapest pairs first within each group, each a and b used once (ties to smaller a, then b). A group is one task's work."""
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, used_a, used_b, keep = rows.sort_values([cost, a, b]), set(), set(), []
        for k, x, y in zip(rows.index, rows[a], rows[b], strict=True):
            if x not in used_a and y not in used_b:
                used_a.add(x), used_b.add(y), keep.append(k)
        return rows.loc[keep]

    kept = pairs.select(group, a, b, cost)
    return kept.groupBy(group).applyInPandas(run, kept.schema)


def optimal_assignment(pairs: DataFrame, group: str, a: str, b: str, cost: str) -> DataFrame:
    """One-to-one pairs of least total cost within each group (Hungarian method); pairs that aren't listed can't be chosen."""
    import numpy as np
    import pandas as pd

    from ringfold.functions.solvers import hungarian

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = sorted(rows[a].unique()), sorted(rows[b].unique())
        far = float(rows[cost].abs().max() + 1) * (len(left) + len(right) + 1)
        table = np.full((len(left), len(right)), far)
        at_a, at_b = {x: k for k, x in enumerate(left)}, {x: k for k, x in enumerate(right)}
        for x, y, c in zip(rows[a], rows[b], rows[cost], strict=True):
            table[at_a[x], at_b[y]] = min(table[at_a[x], at_b[y]], c)
        picked = [(left[i], right[j], table[i, j]) for i, j in hungarian(table) if table[i, j] < far]
        return pd.DataFrame({group: rows[group].iloc[0], a: [p[0] for p in picked], b: [p[1] for p in picked], cost: [p[2] for p in picked]})

    kept = pairs.select(group, a, b, cost)
    return kept.groupBy(group).applyInPandas(run, kept.schema)
