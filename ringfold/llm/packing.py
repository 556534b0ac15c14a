"""Best-fit packing under several capacities at once.

A document's token ids, with an end id after them, are cut into pieces only where they are
longer than a sequence. Pieces go to sequences by vector best-fit: each sequence has a
residual of every capacity (tokens, pieces, attention cost as the sum of squared lengths),
a piece may only enter a sequence that can bear it in all of them, and among those it takes
the one with the smallest weighted norm of what would be left ("norm"), or the largest
weighted dot product of its demand with the residual's direction ("dot"). Pieces come in
the order of falling demand.

Pieces are dealt by hash to groups of about ``GROUP`` and each group is packed by itself, so
no task grows with the corpus; a group leaves at most a few sequences partly empty. A piece
that fills a sequence alone needs no search.

Rows: null and empty texts have just the end id. Rows that repeat are documents of their
own, told apart by their order in the result only. A null doc_id stays null. An empty table
gives no rows. Where two sequences are as good, the one opened first is taken. Capacities that can't bear a single piece raise ValueError before any work
if none could, and in the task that meets such a piece otherwise.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfold.llm.shared import settled
from ringfold.llm.text import buffers, bytes_of, slices
from ringfold.llm.tokens import encoder

GROUP = 8192


@dataclass(frozen=True)
class Capacity:
    """What a sequence can bear; None is without a limit. ``weights``: of tokens, pieces and cost in the choice."""

    tokens: int = 4096
    pieces: int | None = None
    cost: float | None = None
    rule: str = "norm"
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)

    def __post_init__(self) -> None:
        if self.tokens < 1 or (self.pieces is not None and self.pieces < 1) or (self.cost is not None and self.cost < 1) or self.rule not in ("norm", "dot"):
            raise ValueError(f"no piece fits {self}")

    @classmethod
    def whole(cls, tokens: int = 4096) -> Capacity:
        """What the query and the pipeline take: every capacity has a limit, and none excludes what the tokens allow, so no sequence is spent on them; they decide, with the tokens, which of the sequences that could bear a piece is left with the least room."""
        return cls(tokens, tokens, float(tokens) ** 2)

    @property
    def longest(self) -> int:
        """The longest piece that fits alone."""
        return self.tokens if self.cost is None else min(self.tokens, int(self.cost**0.5))


def best_fit(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece (from 0) and its offset there."""
    n = len(lengths)
    limits = np.array([cap.tokens, np.inf if cap.pieces is None else cap.pieces, np.inf if cap.cost is None else cap.cost], float)
    need = np.stack([lengths, np.ones(n), lengths.astype(float) ** 2], axis=1)
    if n and (need > limits).any():
        raise ValueError("a piece exceeds a sequence's capacity")
    bound = np.flatnonzero(np.isfinite(limits))
    scale, weights = limits[bound], np.array(cap.weights)[bound]
    # demands and residuals as shares of the capacities would round; they are kept as they are, weights hold the scale
    factor = weights / scale**2
    need = np.ascontiguousarray(need[:, bound].T)
    left = np.empty((len(bound), n))
    place, offset, filled = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
    open_, bins, live = np.empty(n, np.int64), 0, 0
    order = np.argsort(-(need * (weights / scale)[:, None]).sum(axis=0), kind="stable")
    least = np.minimum.accumulate(need[:, order][:, ::-1], axis=1)[:, ::-1] if n else need
    for step, i in enumerate(order):
        if live and step % 256 == 0:
            keep = np.flatnonzero((left[:, :live] >= least[:, step, None]).all(axis=0))
            live = len(keep)
            left[:, :live], open_[:live] = left[:, keep], open_[keep]
        fits = left[0, :live] >= need[0, i]
        for k in range(1, len(bound)):
            fits &= left[k, :live] >= need[k, i]
        if (at := np.flatnonzero(fits)).size:
            room = left[:, at]
            if cap.rule == "norm":
                room -= need[:, i, None]
                score = factor @ (room * room)
            else:
                score = -((need[:, i] * factor) @ room) / np.maximum(np.sqrt(factor @ (room * room)), 1e-12)
            k = int(at[np.argmin(score)])
            left[:, k] -= need[:, i]
        else:
            k, live = live, live + 1
            left[:, k], open_[k], bins = scale - need[:, i], bins, bins + 1
        b = open_[k]
        place[i], offset[i] = b, filled[b]
        filled[b] += lengths[i]
    return place, offset


def token_pieces(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, longest: int = 4096) -> DataFrame:
    """(doc_id, tie, piece, start, length, ids_crc32) for each piece of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, counts = encoder(vocabulary).encode_all(*buffers(batch.column(2)))
            rows: list[list[int]] = [[], [], [], [], []]
            at = 0
            for d, n in enumerate(counts.tolist()):
                raw = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                at += n
                for piece, start in enumerate(range(0, n + 1, longest)):
                    part = raw[start : start + longest]
                    for column, x in zip(rows, (d, piece, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(x)
            of = pa.array(rows[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(of), batch.column(1).take(of), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])],
                ["doc_id", "tie", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), bytes_of("text").alias("body"))
    return rows.mapInArrow(run, "doc_id long, tie long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: Capacity | None = None, vocabulary: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece; sequences are gapless from offset 0."""
    cap = capacity or Capacity.whole()
    pieces = settled(token_pieces(docs, vocabulary, end_id, cap.longest))
    groups = max(1, -(-pieces.count() // GROUP))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "tie", "piece"], kind="stable")
        place, offset = best_fit(rows["length"].to_numpy(), cap)
        return rows.assign(sequence_id=place + (np.int64(key[0]) << 32), offset=offset)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "tie", "piece", F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    return dealt.groupBy("part").applyInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
