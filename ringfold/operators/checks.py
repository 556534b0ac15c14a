"""Filters and rule tables: each rule is a boolean column, each result a plain table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_of(boxes: list[Column]) -> Column:
    """Or of predicates; none holds where the list is empty."""
    return reduce(lambda a, b: a | b, boxes, F.lit(False))


def kept_or_zero(df: DataFrame, keep: Column, columns: list[str]) -> DataFrame:
    """Rows that aren't kept stay with zeros in the columns."""
    return df.select(*[F.when(keep, F.col(c)).otherwise(F.lit(0).cast(dict(df.dtypes)[c])).alias(c) if c in columns else F.col(c) for c in df.columns])


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row breaks; a rule that comes to null is broken."""
    broken = F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    return df.select(key, F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"))


def tiers(gates: list[Column], names: tuple[str, str, str] = ("gold", "silver", "bronze")) -> Column:
    """Gold where all gates hold, silver where all but one do, else bronze; a null gate doesn't hold."""
    held = reduce(lambda a, b: a + b, [F.when(F.coalesce(g, F.lit(False)), 1).otherwise(0) for g in gates])
    return F.when(held == len(gates), names[0]).when(held == len(gates) - 1, names[1]).otherwise(names[2])


def fixed_places(df: DataFrame, row: str, column: str, order: str, cell: float, least: int, span: float) -> DataFrame:
    """Rows in cells with at least ``least`` entries that span at least ``span`` of the order (fixed-pixel artefacts)."""
    cells = df.withColumns({"__r": F.round(F.col(row) / cell), "__c": F.round(F.col(column) / cell)})
    bad = cells.groupBy("__r", "__c").agg(F.count("*").alias("n"), (F.max(order) - F.min(order)).alias("s")).where((F.col("n") >= least) & (F.col("s") >= span))
    return cells.join(bad.select("__r", "__c"), ["__r", "__c"], "left_semi").drop("__r", "__c")


def quality_gate(df: DataFrame, value: str, bins: int = 200, least_share: float = 0.05, least_separation: float = 2.0) -> DataFrame:
    """Rows above the crossing of a two-Gaussian mixture, if the mixture is clearly better than one Gaussian, its parts well apart (Ashman's D) and neither tiny; else all rows. Only a histogram comes to the driver."""
    import numpy as np

    from ringfold.functions.solvers import mixture_of_two

    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None or high <= low:
        return df
    step = (high - low) / bins
    rows = df.where(F.col(value).isNotNull()).groupBy(F.least(F.floor((F.col(value) - low) / step), F.lit(bins - 1)).alias("b")).agg(F.count("*").alias("n")).collect()
    x, n = (np.array(v, float) for v in zip(*[(low + (r.b + 0.5) * step, r.n) for r in sorted(rows, key=lambda r: r.b)], strict=True))
    share, mean, deviation, two, one = mixture_of_two(x, n)
    apart = np.sqrt(2) * abs(mean[1] - mean[0]) / np.sqrt((deviation**2).sum())
    if one - two < 10 or apart < least_separation or share.min() < least_share:
        return df
    a, b = np.argsort(mean)
    grid = np.linspace(mean[a], mean[b], 512)
    density = [share[k] / deviation[k] * np.exp(-0.5 * ((grid - mean[k]) / deviation[k]) ** 2) for k in (a, b)]
    cut = float(grid[int(np.argmax(density[1] >= density[0]))])
    return df.where(F.col(value) >= cut)
