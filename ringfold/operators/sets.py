"""Set operations on tables and on spot sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfold.operators.windows import renumber


def concatenated(parts: dict[object, DataFrame], label: str, order: list[str], number: str) -> DataFrame:
    """All parts under a label, without dedup, renumbered from 1 by label and order."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn(label, F.lit(k)) for k, df in parts.items()))
    return renumber(every, number, [label, *order])


def orphans(observed: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    return observed.join(covered.select(key).distinct(), key, "left_anti")


def earlier_wins(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; a value of the first stands before one of the second."""
    names = [c for c in first.columns if c != key]
    other = second.select(key, *[F.col(c).alias(f"__{c}") for c in names])
    return first.join(other, key, "full_outer").select(key, *[F.coalesce(c, f"__{c}").alias(c) for c in names])


def differences(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """(key, first, second) where the two differ or one is missing."""
    a, b = first.select(key, F.col(value).alias("first")), second.select(key, F.col(value).alias("second"))
    return a.join(b, key, "full_outer").where(~F.col("first").eqNullSafe(F.col("second")))


def canonical_unique(df: DataFrame, form: list, tie: str) -> DataFrame:
    """One row of each canonical form, the smallest in ``tie``."""
    forms = [f.alias(f"__f{k}") for k, f in enumerate(form)]
    names = df.columns
    keyed = df.select("*", *forms)
    best = keyed.groupBy(*[f"__f{k}" for k in range(len(form))]).agg(F.min_by(F.struct(*names), tie).alias("r"))
    return best.select(*[F.col(f"r.{c}").alias(c) for c in names])
