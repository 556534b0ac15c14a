"""Domain tables made of the common ones, by the same expressions in Spark and in DuckDB.

Every expression is written once and means the same in both dialects: whole-number
arithmetic, division of doubles, and casts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfold.operators.graph import settle
from ringfold.plans.registry import Tables

#: Spots of orders: ids, ring, angles in degrees, detector place, intensity.
SPOTS = [
    "o_orderkey AS spot", "CAST(o_custkey % 5 + 1 AS INT) AS ring", "CAST(o_orderkey * 37 % 3600 AS DOUBLE) / 10 - 180 AS omega", "CAST(o_custkey * 53 % 3600 AS DOUBLE) / 10 - 180 AS eta",
    "CAST(o_custkey * 11 % 997 AS DOUBLE) AS y", "CAST(o_orderkey * 13 % 991 AS DOUBLE) AS z", "o_totalprice AS ii", "CAST(o_orderkey % 24 AS INT) AS frame", "CAST(o_orderkey % 6 AS INT) AS scan", "CAST(o_custkey % 40 AS INT) AS grain",
]
SPOTS_SQL = f"(SELECT {', '.join(SPOTS)} FROM orders)"
#: Grains of customers: place, size, and an orientation as a quaternion (w, x, y, z) of whole numbers over their norm.
GRAINS = [
    "c_custkey AS grain", "CAST(c_custkey * 29 % 307 AS DOUBLE) AS x", "CAST(c_custkey * 31 % 311 AS DOUBLE) AS y", "CAST(c_custkey * 37 % 97 AS DOUBLE) AS z", "CAST(c_nationkey AS INT) AS layer",
    "CAST(c_custkey * 7 % 50 + 5 AS DOUBLE) AS radius", "CAST(c_custkey * 17 % 101 AS DOUBLE) / 100 AS confidence", "CAST(c_custkey % 3 AS INT) AS variant",
    "CAST(c_custkey * 7 % 23 + 20 AS DOUBLE) AS w0", "CAST(c_custkey * 5 % 19 AS DOUBLE) - 9 AS w1", "CAST(c_custkey * 11 % 17 AS DOUBLE) - 8 AS w2", "CAST(c_custkey * 3 % 13 AS DOUBLE) - 6 AS w3",
]
GRAINS_SQL = f"(SELECT {', '.join(GRAINS)} FROM customer)"


def spots(t: Tables) -> DataFrame:
    return t.orders.selectExpr(*SPOTS)


def grains(t: Tables) -> DataFrame:
    return t.customer.selectExpr(*GRAINS)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    settle(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, all else as it is."""
    return df.select(*[F.round(c, digits).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes])
