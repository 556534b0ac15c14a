"""SimHash near-duplicates, with candidates from the pigeonring principle.

A fingerprint's 64 bits are a ring of eight segments of eight bits. If two fingerprints
differ in at most tau bits, then from some segment on every chain of k consecutive segments
differs in at most floor(k * tau / 8) bits, for k = 1 to 8. With tau = 3 the budgets of the
chain's first five links are 0, 0, 1, 1, 1: two segments agree, and of the next three at
most one holds the single difference, so at least two of them agree. Those four equal
segments are the join key: eight places on the ring by three choices, 32 bits each.
Pairs that meet under a key must pass the whole chain of budgets before the full Hamming
distance is taken.

Documents with equal fingerprints are one node, so exact copies cost nothing. Fingerprints
that share a key are compared in blocks of a bounded size; of the links found in a block
only a spanning forest leaves the task. A key with more fingerprints than a block holds is
dealt over pairs of blocks, each its own group, so no group is unbounded.

Texts: null and wordless texts have fingerprint zero and link like any other; a text of
fewer words than a shingle has one shingle, all its words. Rows that repeat stay, each with
its component. A null doc_id has a component, but never names one while another member does.
Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfold.llm.components import components
from ringfold.llm.shared import privately, settled
from ringfold.llm.text import bytes_of, slices

SEGMENTS, BITS = 8, 8
BLOCK = 2048
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint_of(text: bytes, shingle: int = 3) -> int:
    """SimHash of one text: bit i is set if more than half of the shingles' hashes set it."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed=42)
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], ends + 1])[: len(words) - shingle + 1].tolist()
    stops = np.concatenate([ends, [len(joined)]])[shingle - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), 1 << 16):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[k : k + (1 << 16)], stops[k : k + (1 << 16)], strict=True)], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        prints = np.array([fingerprint_of(x) for x in batch.column(2).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], ["doc_id", "tie", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, fp) for each row; fp holds the 64 bits as a signed long, tie is a hash of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), bytes_of("text").alias("body"))
    return rows.mapInArrow(_fingerprints, "doc_id long, tie long, fp long")


def _keyed(prints: DataFrame) -> DataFrame:
    """(place, key, fp): for each place on the ring and each of the three segments left out, the four that must agree."""
    def rolled(i: int):
        return F.shiftleft("fp", i * BITS).bitwiseOR(F.shiftrightunsigned("fp", 64 - i * BITS)) if i else F.col("fp")

    rows = []
    for i in range(SEGMENTS):
        for left_out in range(3):
            mask = 0xFFFF << 48 | sum(0xFF << (40 - 8 * j) for j in range(3) if j != left_out)
            signed = mask - (1 << 64)
            rows.append(F.struct(F.lit(i * 3 + left_out).alias("place"), rolled(i).bitwiseAND(F.lit(signed)).alias("key")))
    return prints.select("fp", F.explode(F.array(*rows)).alias("k")).select("k.place", "k.key", "fp")


def chained(x: np.ndarray, place: np.ndarray, tau: int = 3) -> np.ndarray:
    """Whether differences ``x`` keep every budget of the chain that begins at segment ``place``."""
    ok, total = np.ones(len(x), bool), np.zeros(len(x), np.int64)
    for k in range(SEGMENTS):
        shift = ((SEGMENTS - 1 - (place + k) % SEGMENTS) * BITS).astype(np.uint64)
        total += np.bitwise_count(x >> shift & np.uint64(0xFF))
        ok &= total <= (k + 1) * tau // SEGMENTS
    return ok


def links_in(run: np.ndarray, place: np.ndarray, fp: np.ndarray, side: np.ndarray, tau: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal ``run`` (sorted): all pairs of one block, or those across two blocks (side 0 and 1).

    Rows are compared with those one, two, three ... places further on, all runs at once,
    and runs that are used up drop out. ``side`` is -1 in runs of a single block.
    """
    n = len(run)
    last = np.searchsorted(run, run, "right")
    at, lag, found = np.arange(n), 1, []
    while len(at := at[at + lag < last[at]]):
        to = at + lag
        use = (side[at] < 0) | (side[at] != side[to])
        i, j = at[use], to[use]
        x = fp[i] ^ fp[j]
        keep = chained(x, place[i], tau)
        i, j, x = i[keep], j[keep], x[keep]
        near = np.bitwise_count(x) <= tau
        found.append((fp[i[near]], fp[j[near]]))
        lag += 1
    if not found:
        return fp[:0], fp[:0]
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the same components as those given: each node with its component's smallest."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return nodes, nodes[root]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by group; the last group of a batch waits for the next, so every group is seen whole."""
    held: pa.Table | None = None

    def solve(rows: pa.Table) -> pa.RecordBatch:
        c = [rows.column(k).to_numpy() for k in ("place", "key", "lo", "hi", "side")]
        fp = rows.column("fp").to_numpy().view(np.uint64)
        fresh = np.zeros(len(fp), bool)
        for x in c[:4]:
            fresh[1:] |= x[1:] != x[:-1]
        a, b = links_in(np.cumsum(fresh), c[0] // 3, fp, c[4])
        node, root = forest(a, b) if len(a) else (a, b)
        out = node != root
        return pa.RecordBatch.from_arrays([pa.array(node[out].view(np.int64)), pa.array(root[out].view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if held.num_rows < 1 << 16:
            continue
        tail = [held.column(k)[-1].as_py() for k in ("place", "key", "lo", "hi")]
        same = np.ones(held.num_rows, bool)
        for k, x in zip(("place", "key", "lo", "hi"), tail, strict=True):
            same &= held.column(k).to_numpy() == x
        cut = held.num_rows - int(same.sum())
        if cut:
            yield solve(held.slice(0, cut))
            held = held.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield solve(held)


def print_links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links that span the components of distinct fingerprints within three bits. ``prints``: (fp), distinct."""
    keys = _keyed(prints)
    counts = keys.groupBy("place", "key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")
    met = keys.join(counts, ["place", "key"]).withColumn("blocks", blocks).withColumn("mine", mine)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = met.select("place", "key", "fp", "mine", other).select(
        "place", "key", "fp", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"),
        F.when(F.col("mine") == F.col("other"), -1).when(F.col("mine") < F.col("other"), 0).otherwise(1).cast("int").alias("side"),
    )
    group = ["place", "key", "lo", "hi"]
    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(_links, "a long, b long")


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows' fingerprints, and (fp, head) for each distinct one: head is the component's first row, (no_id, doc_id, tie)."""
    prints = settled(fingerprints(docs))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")
    firsts = settled(prints.groupBy("fp").agg(F.min(row).alias("first")))
    roots = components(print_links(firsts.select("fp")))
    placed = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    heads = placed.groupBy("root").agg(F.min("first").alias("head"))
    return prints, placed.join(heads, "root").select("fp", "head")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs: sixteen hex digits, and the smallest doc_id reachable over links of at most three bits."""
    prints, heads = _grouped(docs)
    return prints.join(heads, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("head.doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id (null last, then the smaller hash of the text); all columns stay.

    Rows alike in doc_id and text are one document, of which one row stays.
    """
    def kept(rows: DataFrame) -> DataFrame:
        _, heads = _grouped(rows)
        chosen = heads.select("head").distinct().select(F.coalesce(F.col("head.doc_id").cast("string"), F.lit("")).alias("__id"), F.col("head.tie").alias("__tie"))
        keyed = rows.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), "__tie": F.xxhash64("text")})
        return keyed.join(chosen, ["__id", "__tie"], "left_semi").dropDuplicates(["__id", "__tie"])

    return privately(docs, {"doc_id", "text"}, kept)
