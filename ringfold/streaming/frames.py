"""Streams of frames: integration with a static map, normalisers, chains over frames, a ledger of what is done."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfold.operators.aggregates import integrate


def file_stream(spark: SparkSession, path: str, schema: str, each: int = 1, kind: str = "parquet") -> DataFrame:
    """Files of a landing folder as they come, ``each`` a trigger (back-pressure)."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", each).load(path)


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs all that has landed through ``sink`` (a foreachBatch function) and ends."""
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def integrated(stream: DataFrame, bins: DataFrame, out: str, checkpoint: str, frame: str, pixel: str, value: str, monitor: DataFrame | None = None) -> None:
    """Every frame's bins, appended to a Parquet folder by batch; a batch is written whole under its number, so a repeated one replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch
        if monitor is not None:
            rows = rows.join(monitor, frame, "left").withColumn(value, F.col(value) / F.greatest(F.coalesce("monitor", F.lit(1.0)), F.lit(1e-30)))
        integrate(rows, bins, frame, pixel, value, "bin", "fraction").write.mode("overwrite").parquet(f"{out}/batch={number}")

    drain(stream, write, checkpoint)


def chains(stream: DataFrame, key: str, time: str, value: str, gap: float) -> DataFrame:
    """(key, first, last, rows, total) of each chain over a stream; a gap ends a chain. Rows of a key come in the order of time.

    Every batch also gives the chain that is still open as far as it goes, so that none is
    missing when the stream ends; a later row of the same key and first supersedes it, see
    ``latest_chains``.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first, last, rows, total = state.get if state.exists else (None, None, 0, 0.0)
        made = []
        for x, v in sorted((x, v) for b in batches for x, v in zip(b[time], b[value], strict=True)):
            if last is not None and x - last > gap:
                made.append((k[0], first, last, rows, total))
                first, rows, total = None, 0, 0.0
            first, last, rows, total = (x if first is None else first), x, rows + 1, total + v
        if rows:
            state.update((first, last, rows, total))
            made.append((k[0], first, last, rows, total))
        yield pd.DataFrame(made, columns=[key, "first", "last", "rows", "total"])

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, first double, last double, rows long, total double", "first double, last double, rows long, total double", "append", "NoTimeout")


def latest_chains(written: DataFrame, key: str) -> DataFrame:
    """Each chain as it was last given."""
    best = written.groupBy(key, "first").agg(F.max(F.struct("rows", "last", "total")).alias("m"))
    return best.select(key, "first", "m.last", "m.rows", "m.total")


def run_once(spark: SparkSession, ledger: str, stage: str, inputs: str, out: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The stage's output, made only if the ledger has no row of that stage and inputs (a digest)."""
    from pyspark.errors import AnalysisException

    try:
        done = spark.read.parquet(ledger).where((F.col("stage") == stage) & (F.col("inputs") == inputs)).select("out").first()
    except AnalysisException:
        done = None
    if done is None:
        make().write.mode("overwrite").parquet(out)
        spark.createDataFrame([(stage, inputs, out)], "stage string, inputs string, out string").write.mode("append").parquet(ledger)
        return spark.read.parquet(out)
    return spark.read.parquet(done.out)
