"""What several operators need of the session: the shared folder, and tables cut off from their lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """Sets the checkpoint folder from spark.checkpoint.dir. Only a local session, as in tests, may do without and gets a temporary folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ringfold-"))
    return spark


def settled(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared checkpoint folder; they survive lost executors and aren't computed again."""
    with_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def privately(docs: DataFrame, own: set[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on docs whose columns, but for those named in ``own``, go under private names, and have theirs again after it; so none clashes with a name that ``work`` uses."""
    names = {c: c if c in own else f"__kept{k}" for k, c in enumerate(docs.columns)}
    hidden = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in names.items()])
    return work(hidden).select(*[F.col(p).alias(c) for c, p in names.items()])
