"""Token ids in files of byte-aligned variable-length codes.

An id is written as its rank by frequency over the corpus, in one to four bytes. The lengths
stand apart from the bytes: two bits for each id, four ids to a control byte, so a reader
finds all lengths of a control byte by one look into a table of 256 rows, their sum tells
where each id begins, and all ids are put together at once.

A shard is a block of bytes: magic (which tells whether its documents have ids), counts of
documents and of token ids, the document ids, the lengths of the documents, the control bytes, the code bytes. Shards are rows of a Parquet
table (part, number, n_docs, n_ids, shard), because only Spark's writers reach every shared
folder and commit whole files when executors are lost; the ranks are a table beside it.
Shards hold documents in ascending doc_id, and (part, number) orders shards.

Texts are encoded once. Their ids rest in the shared folder, packed, while frequencies are
counted; then they are ranked and dealt to parts by ranges of doc_id; an id that holds more
than a part's share of the rows, and rows without an id, are dealt further by ranges of the
texts' hash. Parts grow in number with the bytes of ids. The table of ranks is bounded by the
vocabulary, not by the corpus.

Rows: null and empty texts have just the end id. Equal doc_ids are ordered by a hash of
their texts; rows alike in both stand side by side. Rows without a doc_id come last. An
empty table gives an empty table of shards, and reading it no rows.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringfold.llm.shared import settled, with_checkpoints
from ringfold.llm.text import buffers, bytes_of, partitions, ranges, slices
from ringfold.llm.tokens import encoder

MAGIC, MAGIC_NO_IDS = b"RFV1", b"RFV0"
#: Compressed ids of a part, about; a task holds one part at a time, in about eight times that.
PART_BYTES = 16 << 20
#: Ids of a shard, about.
SHARD_IDS = 4 << 20
#: Shards whose places are broadcast, 24 bytes each; beyond it they are joined by a shuffle.
INDEX_ROWS = 1_000_000
_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and code bytes of uint32 values."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    quads = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    quads[: len(ranks)] = size - 1
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    used = np.arange(4) < size[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_ranks(control: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """The values again, by the table of lengths."""
    size = _LENGTHS[control].reshape(-1)[:n].astype(np.int64)
    begin = np.cumsum(size) - size
    padded = np.concatenate([codes, np.zeros(3, np.uint8)])
    out = padded[begin].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not more.size:
            break
        out[more] |= padded[begin[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_shard(doc_ids: np.ndarray, lengths: np.ndarray, ranks: np.ndarray, no_ids: bool = False) -> bytes:
    control, codes = encode_ranks(ranks)
    return b"".join([MAGIC_NO_IDS if no_ids else MAGIC, struct.pack("<QQ", len(doc_ids), len(ranks)), doc_ids.astype("<i8").tobytes(), lengths.astype("<i8").tobytes(), control, codes])


def read_shard(shard: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, lengths, and ranks of all ids."""
    if shard[:4] not in (MAGIC, MAGIC_NO_IDS):
        raise ValueError("not a shard of token ids")
    docs, n = struct.unpack_from("<QQ", shard, 4)
    ids = np.frombuffer(shard, "<i8", docs, 20)
    lengths = np.frombuffer(shard, "<i8", docs, 20 + 8 * docs)
    control = np.frombuffer(shard, np.uint8, -(-n // 4), 20 + 16 * docs)
    return ids, lengths, decode_ranks(control, np.frombuffer(shard, np.uint8, -1, 20 + 16 * docs + len(control)), n)


def _packed(ids: np.ndarray, ties: np.ndarray, counts: np.ndarray, values: np.ndarray) -> bytes:
    """Documents' ids, ties and counts, and all their values, compressed; two bytes for each value where that is enough."""
    width = 2 if not len(values) or values.max() < 1 << 16 else 4
    meta = ids.astype("<i8").tobytes() + ties.astype("<i8").tobytes() + counts.astype("<i8").tobytes()
    return struct.pack("<IB", len(ids), width) + zstandard.ZstdCompressor(level=1).compress(meta + values.astype(f"<u{width}").tobytes())


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, width = struct.unpack_from("<IB", blob)
    raw = zstandard.ZstdDecompressor().decompress(blob[5:])
    ids, ties, counts = (np.frombuffer(raw, "<i8", n, 8 * n * k) for k in range(3))
    return ids, ties, counts, np.frombuffer(raw, f"<u{width}", -1, 24 * n).astype(np.uint32)


def token_blobs(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(blob): the ids of all documents, each with the end id, packed by slices of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, counts = encoder(vocabulary).encode_all(*buffers(batch.column(2)))
            whole = np.insert(ids, np.cumsum(counts), end_id)
            yield pa.RecordBatch.from_arrays([pa.array([_packed(batch.column(0).to_numpy(), batch.column(1).to_numpy(), counts + 1, whole)], pa.binary())], ["blob"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("ord"), _tie().alias("tie"), bytes_of("text").alias("body"))
    return rows.mapInArrow(run, "blob binary")


def _tie() -> Column:
    """63 bits of the text's hash; below zero, by their complement, for rows without a doc_id."""
    tie = F.shiftrightunsigned(F.xxhash64("text"), 1)
    return F.when(F.col("doc_id").cast("long").isNull(), -tie - 1).otherwise(tie)


def frequency_ranks(blobs: DataFrame) -> list[int]:
    """Token ids by falling frequency over all documents, ties to the smaller id; ids that never occur are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                seen = np.bincount(_unpacked(blob)[3], minlength=len(total)).astype(np.int64)
                seen[: len(total)] += total
                total = seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "n"])

    counts = blobs.mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return [r.id for r in counts.orderBy(F.desc("n"), "id").collect()]


class Parts:
    """Which part a document belongs to; parts in ascending order hold documents in ascending order, those without an id last.

    ``cuts`` are ids at equal steps of the table's rows: one that comes up again and again
    holds several steps' rows, and gets as many parts. ``no_ids`` parts are for rows without one.
    """

    def __init__(self, cuts: list[int], no_ids: int):
        self.cuts, times = np.unique(np.array(cuts, np.int64), return_counts=True)
        self.heavy = np.where(times > 1, times, 0)
        self.begin = np.arange(len(self.cuts) + 1) + np.concatenate([[0], np.cumsum(self.heavy)])
        self.no_ids, self.last = no_ids, int(self.begin[-1]) + 1

    def of(self, ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
        none = ties < 0
        share = np.where(none, -(ties + 1), ties) / 2.0**63
        at = np.searchsorted(self.cuts, ids)
        part = self.begin[at]
        if len(self.cuts):
            near = np.minimum(at, len(self.cuts) - 1)
            split = (self.cuts[near] == ids) & (self.heavy[near] > 0)
            part = part + np.where(split, 1 + np.minimum((share * self.heavy[near]).astype(np.int64), self.heavy[near] - 1), 0)
        return np.where(none, self.last + np.minimum((share * self.no_ids).astype(np.int64), self.no_ids - 1), part)


def _parts(docs: DataFrame, n: int) -> Parts:
    """Parts of about equal rows; only the id column is read."""
    d = F.col("doc_id").cast("long").alias("d")
    found = docs.select(d).agg(F.percentile_approx("d", [k / n for k in range(1, n)] or [0.5], 10_000).alias("q"), F.count("*").alias("rows"), F.count("d").alias("ids")).first()
    return Parts(found.q or [], max(1, -(-(found.rows - found.ids) * n // max(1, found.rows))))


def write_ids(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2) -> None:
    """Writes path/ranks and path/shards."""
    spark = docs.sparkSession
    blobs = settled(token_blobs(docs, vocabulary, end_id))
    by_rank = frequency_ranks(blobs)
    spark.createDataFrame(pa.table({"rank": pa.array(range(len(by_rank)), pa.int32()), "id": pa.array(by_rank, pa.int32())})).coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max(by_rank, default=0) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    size = blobs.agg(F.sum(F.octet_length("blob"))).first()[0] or 0
    parts = _parts(docs, max(2 * partitions(docs), -(-size // PART_BYTES)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                ids, ties, counts, values = _unpacked(blob)
                ranks, first = rank_of[values], np.cumsum(counts) - counts
                part = parts.of(ids, ties)
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
                out = []
                for at in np.split(order, cuts[1:]):
                    out.append(_packed(ids[at], ties[at], counts[at], ranks[ranges(first[at], counts[at])]))
                yield pa.RecordBatch.from_arrays([pa.array(part[order][cuts].astype(np.int32)), pa.array(out, pa.binary())], ["part", "blob"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(part: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
            ids, ties, counts, ranks = (np.concatenate(x) for x in zip(*map(_unpacked, held), strict=True))
            no_ids = bool(ties[0] < 0)
            order = np.argsort(-ties) if no_ids else np.lexsort((ties, ids))
            first, size = np.cumsum(counts) - counts, np.cumsum(counts[order])
            for number, at in enumerate(np.split(order, np.flatnonzero(np.diff(size // SHARD_IDS)) + 1)):
                blob = write_shard(ids[at], counts[at], ranks[ranges(first[at], counts[at])], no_ids)
                cells = [(part, pa.int32()), (number, pa.int32()), (len(at), pa.int64()), (int(counts[at].sum()), pa.int64()), (blob, pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in cells], ["part", "number", "n_docs", "n_ids", "shard"])

        now, held = None, []
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and part != now:
                    yield from finish(now, held)
                    held = []
                now = part
                held.append(blob)
        if held:
            yield from finish(now, held)

    dealt = blobs.mapInArrow(deal, "part int, blob binary").repartition("part").sortWithinPartitions("part")
    dealt.mapInArrow(shards, "part int, number int, n_docs long, n_ids long, shard binary").write.parquet(f"{path}/shards")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; ids are little-endian unsigned 32-bit."""
    by_rank = np.array([r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], "<u4")
    files = spark.read.parquet(f"{path}/shards")
    index = files.select("part", "number", "n_ids")
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("total")).withColumn("base", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    small = index.count() <= INDEX_ROWS
    begins = index.withColumn("inside", inside).join(parts.select("part", "base"), "part").select("part", "number", (F.col("base") + F.col("inside")).alias("begin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, shard in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = shard.as_buffer().to_pybytes()
                ids, lengths, ranks = read_shard(raw)
                none = np.full(len(ids), raw[:4] == MAGIC_NO_IDS)
                values, before = by_rank[ranks], np.cumsum(lengths) - lengths
                for k in range(0, len(ids), 1024):
                    s = slice(k, k + 1024)
                    blobs = [values[a : a + n].tobytes() for a, n in zip(before[s].tolist(), lengths[s].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[s], mask=none[s]), pa.array(before[s] + begin), pa.array(lengths[s]), pa.array(blobs, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return files.join(F.broadcast(begins) if small else begins, ["part", "number"]).select("begin", "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{with_checkpoints(spark).sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"

