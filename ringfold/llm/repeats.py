"""Exact substring dedup by fixed-block anchors.

A window of W words that occurs twice holds, in its earlier place, a whole block of
B = (W + 1) // 2 words that starts at a multiple of B. So the non-overlapping blocks of all
documents are indexed by hash and probed with every rolling window of B words: a block
that some other place matches is an anchor, at both ends. Only windows of W words around an
anchor can repeat; their own hashes are met, the earliest place of each is kept, and the
later windows, merged, are the maximal repeats.

Blocks, probes and windows never travel as rows. A slice of documents sends one blob to each
bucket of the hash's range: 4 bytes of hash for a probe (a false meeting only costs a look,
buckets grow with the data), 12 for a window, and the packed positions. Buckets are read one
by one, in numpy, and what they find goes back in the same form to the documents' buckets.
A passage that many documents share is a long run in one bucket's sort, nothing more.
Windows count as equal if two hashes of their words agree, one modulo 2**64 and one modulo the
prime 2**31 - 1, 95 bits in all: of 10**12 different windows, two meet by chance once in
40,000 corpora, and words made to collide in one of the hashes don't in the other.

Rows: null and wordless texts have no words, and kept text "". Rows alike in doc_id and text
are one document, and each gets its result. Rows with one doc_id and several texts follow a
hash of the text; rows without a doc_id come last. An empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringfold.llm.text import buffers, bytes_of, partitions, prime_windows, prime_words, ranges, slices, window_hashes, word_hashes, words

#: Text of a bucket, about; a task holds one bucket at a time, in about ten times that.
BUCKET_BYTES = 32 << 20
#: The place of rows without a doc_id among ids; the largest id itself comes just before it, told apart by the tie.
_NO_ID = np.iinfo(np.int64).max
_OUT = "bucket int, blob binary"


class Entries:
    """Places (a document, a word in it), with a hash of each or without."""

    def __init__(self, ids: np.ndarray, ties: np.ndarray, doc: np.ndarray, pos: np.ndarray, hashes: np.ndarray | None = None):
        self.ids, self.ties, self.doc, self.pos, self.hashes = ids, ties, doc, pos, hashes

    def blobs(self, bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """One blob for each bucket that gets a place; ``bucket`` names each place's. Places must lie in the order of doc, pos."""
        if not len(bucket):
            return
        order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 1 << 16 else bucket, kind="stable")
        bucket, doc, pos = bucket[order], self.doc[order], self.pos[order]
        hashes = None if self.hashes is None else self.hashes[order]
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        packer = zstandard.ZstdCompressor(level=1)
        for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
            d, p = doc[a:b], pos[a:b]
            new = np.append(True, d[1:] != d[:-1])
            at = np.flatnonzero(new)
            step = np.diff(p, prepend=0)
            step[at] = p[at]
            ids = self.ids[d[at]]
            meta = packer.compress(b"".join([np.diff(ids, prepend=0).astype("<i8").tobytes(), self.ties[d[at]].astype("<u4").tobytes(), np.diff(at, append=b - a).astype("<u4").tobytes(), step.astype("<u4").tobytes()]))
            yield int(bucket[a]), struct.pack("<III", len(at), b - a, len(meta)) + meta + (b"" if hashes is None else hashes[a:b].tobytes())

    @classmethod
    def of(cls, blobs: list[bytes], kind: np.dtype | None) -> Entries:
        """All places of these blobs, with hashes of that kind or none. doc counts over the blobs' lists of documents."""
        unpack = zstandard.ZstdDecompressor()
        ids, ties, doc, pos, hashes, n = [], [], [], [], [], 0
        for blob in blobs:
            docs, places, size = struct.unpack_from("<III", blob)
            meta = unpack.decompress(blob[12 : 12 + size])
            ids.append(np.cumsum(np.frombuffer(meta, "<i8", docs)))
            ties.append(np.frombuffer(meta, "<u4", docs, 8 * docs))
            counts = np.frombuffer(meta, "<u4", docs, 12 * docs).astype(np.int64)
            total = np.cumsum(np.frombuffer(meta, "<u4", places, 16 * docs).astype(np.int64))
            first = np.cumsum(counts) - counts
            pos.append(total - np.repeat(np.where(first > 0, total[first - 1], 0), counts))
            doc.append(np.repeat(np.arange(n, n + docs, dtype=np.int64), counts))
            if kind is not None:
                hashes.append(np.frombuffer(blob, kind, places, 12 + size))
            n += docs
        if not blobs:
            return cls(np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), None if kind is None else np.zeros(0, kind))
        return cls(np.concatenate(ids), np.concatenate(ties), np.concatenate(doc), np.concatenate(pos), None if kind is None else np.concatenate(hashes))

    def to_documents(self, keep: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
        """The places ``keep``, for the buckets of their documents."""
        keep = keep[np.lexsort((self.pos[keep], self.doc[keep]))]
        home = document_bucket(self.ids, self.ties, parts)
        yield from Entries(self.ids, self.ties, self.doc[keep], self.pos[keep]).blobs(home[self.doc[keep]])


def document_bucket(ids: np.ndarray, ties: np.ndarray, parts: int) -> np.ndarray:
    """The same as ``_home``, in numpy."""
    return ((ids % parts) * 31 + ties.astype(np.int64)) % parts


def _home(parts: int) -> Column:
    return F.pmod(F.pmod("ord", F.lit(parts)) * 31 + F.col("tie"), F.lit(parts)).cast("int")


def _rows(pairs: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    buckets: list[int] = []
    blobs: list[bytes] = []
    for b, blob in pairs:
        buckets.append(b)
        blobs.append(blob)
        if len(blobs) == 256:
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])
            buckets, blobs = [], []
    if blobs:
        yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def _each_bucket(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[Entries]:
    """The places of one bucket after the other; rows come sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and b != now:
                yield Entries.of(held, kind)
                held = []
            now = b
            held.append(blob)
    if held:
        yield Entries.of(held, kind)


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_NO_ID))).alias("ord"),
        F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).bitwiseOR(F.when(F.col("doc_id").isNull(), 1 << 31).otherwise(0)).alias("tie"), bytes_of("text").alias("body"),
    )


def _probes(docs: DataFrame, block: int, parts: int) -> DataFrame:
    """Every rolling window of ``block`` words, dealt by hash; those at multiples of ``block`` are the index's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=8 << 20):
            buf, off = buffers(batch.column(2))
            start, end, first = words(buf, off)
            h, at = window_hashes(word_hashes(buf, start, end), first, block)
            doc = np.searchsorted(first, at, "right") - 1
            places = Entries(batch.column(0).to_numpy(), batch.column(1).to_numpy(), doc, at - first[doc], h.astype("<u4"))
            yield from _rows(places.blobs(((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)))

    return _documents(docs).select("ord", "tie", "body").mapInArrow(run, _OUT)


def _anchors(probes: DataFrame, block: int, parts: int) -> DataFrame:
    """Places whose hash a block has and another place too, for the documents' buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in _each_bucket(batches, np.dtype("<u4")):
            order = np.argsort(e.hashes, kind="stable")
            h = e.hashes[order]
            cuts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            size = np.diff(cuts, append=len(h))
            anchored = np.logical_or.reduceat(e.pos[order] % block == 0, cuts) & (size > 1)
            yield from _rows(e.to_documents(order[np.repeat(anchored, size)], parts))

    return probes.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _OUT)


def _matched(found: pa.Table, ids: np.ndarray, ties: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indices, among all words of the bucket's documents, of the places found; a repeated row gets them each time."""
    e = Entries.of(found.column("blob").to_pylist(), None)
    if not len(e.pos):
        return e.pos
    keys = np.rec.fromarrays([ids, ties.astype(np.int64)])
    asked = np.rec.fromarrays([e.ids, e.ties.astype(np.int64)])
    kinds, kind = np.unique(np.concatenate([keys, asked]), return_inverse=True)
    mine, theirs = kind[: len(ids)], kind[len(ids) :][e.doc]
    order = np.argsort(theirs, kind="stable")
    begin = np.searchsorted(theirs[order], mine)
    many = np.searchsorted(theirs[order], mine, "right") - begin
    return np.repeat(first[:-1], many) + e.pos[order[ranges(begin, many)]]


_PAIR = np.dtype([("wide", "<u8"), ("prime", "<u4")])


def _windows(docs: DataFrame, anchors: DataFrame, window: int, block: int, parts: int) -> DataFrame:
    """Every window that holds an anchor, dealt by hash."""

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        none = pa.table({"bucket": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
        if not rows.num_rows or not found.num_rows:
            return none
        buf, off = buffers(rows.column("body"))
        ids, ties = rows.column("ord").to_numpy(), rows.column("tie").to_numpy()
        start, end, first = words(buf, off)
        hit = _matched(found, ids, ties, first)
        near = np.zeros(len(start) + 1, np.int64)
        np.add.at(near, np.maximum(hit - (window - block), 0), 1)
        np.add.at(near, hit + 1, -1)
        h, at = window_hashes(word_hashes(buf, start, end), first, window)
        use = np.cumsum(near)[at] > 0
        h, at = h[use], at[use]
        both = np.empty(len(h), _PAIR)
        both["wide"], both["prime"] = h, prime_windows(prime_words(buf, start, end), at, window)
        doc = np.searchsorted(first, at, "right") - 1
        places = Entries(ids, ties, doc, at - first[doc], both)
        out = list(_rows(places.blobs(((h >> np.uint64(40)) % np.uint64(parts)).astype(np.int64))))
        return pa.Table.from_batches(out) if out else none

    return docs.groupBy("bucket").cogroup(anchors.groupBy("bucket")).applyInArrow(run, _OUT)


def _later(windows: DataFrame, parts: int) -> DataFrame:
    """Windows that also start earlier, for the documents' buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in _each_bucket(batches, _PAIR):
            id_, tie = e.ids[e.doc], e.ties[e.doc]
            order = np.lexsort((e.pos, tie, id_, e.hashes["prime"], e.hashes["wide"]))
            h, id_, tie, pos = e.hashes[order], id_[order], tie[order], e.pos[order]
            new = np.append(True, (h["wide"][1:] != h["wide"][:-1]) | (h["prime"][1:] != h["prime"][:-1]))
            top = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = (id_ != id_[top]) | (tie != tie[top]) | (pos != pos[top])
            yield from _rows(e.to_documents(order[later], parts))

    return windows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _OUT)


def _parts(docs: DataFrame, most: int) -> int:
    """Buckets: as many as the session has shuffle partitions, and so many at least that none gets more than about ``most`` bytes of text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(partitions(docs), -(-size // most))


def remove_repeats(docs: DataFrame, window: int = 20, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, repeats, kept) for each row: ``repeats`` are the maximal runs of words removed, [start, stop), ``kept`` the other words joined by one space."""
    block, parts = (window + 1) // 2, _parts(docs, bucket_bytes)

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        buf, off = buffers(rows.column("body"))
        start, end, first = words(buf, off)
        hit = _matched(found, rows.column("ord").to_numpy(), rows.column("tie").to_numpy(), first)
        near = np.zeros(len(start) + 1, np.int64)
        np.add.at(near, hit, 1)
        np.add.at(near, np.minimum(hit + window, len(start)), -1)
        gone = np.cumsum(near)[: len(start)] > 0
        raw, kept, spans, removed = buf.tobytes(), [], [], []
        for k in range(rows.num_rows):
            a, b = int(first[k]), int(first[k + 1])
            mine = gone[a:b]
            removed.append(int(mine.sum()))
            if not removed[-1]:
                kept.append(b" ".join(raw[off[k] : off[k + 1]].split()))
                spans.append([])
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
            spans.append([{"start": s, "stop": t} for s, t in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)])
            stay = np.flatnonzero(~mine) + a
            kept.append(b" ".join([raw[s:t] for s, t in zip(start[stay].tolist(), end[stay].tolist(), strict=True)]))
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.table({"doc_id": rows.column("doc_id"), "n_words": pa.array(np.diff(first)), "n_removed": pa.array(removed, pa.int64()), "repeats": pa.array(spans, span), "kept": pa.array(kept, pa.binary())})

    homes = _documents(docs).withColumn("bucket", _home(parts))
    later = _later(_windows(homes, _anchors(_probes(docs, block, parts), block, parts), window, block, parts), parts)
    out = homes.groupBy("bucket").cogroup(later.groupBy("bucket")).applyInArrow(run, "doc_id long, n_words long, n_removed long, repeats array<struct<start: bigint, stop: bigint>>, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))
