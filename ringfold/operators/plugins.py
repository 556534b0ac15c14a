"""Plug-in points: statistics and solvers by name, and a decorator that lifts a statistic over resamples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An aggregate expression of a column.
Statistic = Callable[[str], Column]
_STATISTICS: dict[str, Statistic] = {}
_SOLVERS: dict[str, Callable] = {}


def statistic(name: str) -> Callable[[Statistic], Statistic]:
    """Registers a statistic; a name that is taken is an error."""

    def put(f: Statistic) -> Statistic:
        if name in _STATISTICS:
            raise ValueError(f"there is a statistic {name} already")
        _STATISTICS[name] = f
        return f

    return put


statistic("mean")(F.avg)
statistic("median")(lambda c: F.percentile(c, 0.5))
statistic("spread")(lambda c: F.percentile(c, 0.84) - F.percentile(c, 0.16))
statistic("deviation")(F.stddev_samp)


def summarise(df: DataFrame, keys: list[str], value: str, name: str | Statistic) -> DataFrame:
    """(keys, value): a statistic by name, or any aggregate that the caller gives."""
    f = name if callable(name) else _STATISTICS.get(name)
    if f is None:
        raise ValueError(f"no statistic {name}; there are {sorted(_STATISTICS)}")
    return df.groupBy(*keys).agg(f(value).alias("value"))


def solver(name: str) -> Callable[[Callable], Callable]:
    """Registers a function of a group's pandas rows; a name that is taken is an error."""

    def put(f: Callable) -> Callable:
        if name in _SOLVERS:
            raise ValueError(f"there is a solver {name} already")
        _SOLVERS[name] = f
        return f

    return put


def solve(df: DataFrame, keys: list[str], name: str, schema: str) -> DataFrame:
    """The named solver on each group."""
    if name not in _SOLVERS:
        raise ValueError(f"no solver {name}; there are {sorted(_SOLVERS)}")
    return df.groupBy(*keys).applyInPandas(_SOLVERS[name], schema)


def bootstrapped(name: str | Statistic, draws: int = 200, seed: int = 1) -> Callable[[DataFrame, str, str], DataFrame]:
    """The statistic lifted over resamples: a function (df, unit, value) to (p16, p50, p84).

    Units (a column's values, such as grains) are drawn with replacement: in each resample a
    unit counts as often as a Poisson number of its hash says, all its rows with it.
    """
    def run(df: DataFrame, unit: str, value: str) -> DataFrame:
        from ringfold.operators.aggregates import poisson_draws

        drawn = df.select(unit, value, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("b"))
        copies = drawn.withColumn("__n", poisson_draws(F.xxhash64(F.col(unit), F.col("b"), F.lit(seed)))).where("__n > 0").withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("__n"))))
        each = summarise(copies, ["b"], value, name)
        return each.agg(*[F.percentile("value", q).alias(n) for q, n in ((0.16, "p16"), (0.5, "p50"), (0.84, "p84"))])

    return run
