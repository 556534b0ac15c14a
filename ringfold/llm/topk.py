"""Exact top-k search by inner product: a ball tree for each shard, branch and bound.

Vectors are integers (``floor(1024 * x)``), so scores are exact. Rows are dealt by hash to
shards of about ``SHARD`` vectors, each with a ball tree: a node knows its centre c and
radius r, and no vector in it scores above q.c + |q| r. A query takes nodes in the order of
that bound and stops at the first that lies below its current k-th score; equal bounds are
still looked at, because ties go to the smaller id. Shards are searched in waves, one in
``FIRST`` at first and then twice as many each time; a wave starts from the k-th scores of
all that were searched before it.

Trees are built once and rest in the shared folder. Queries are a stated set: they travel in
blocks of ``QUERIES``, one block to all shards of a wave at a time, so neither a task nor the
driver holds them all. A shard sends k rows for a query at most.

Rows: a vector that is null, or holds null or non-finite components, takes no part. Vectors
of another length than the query's aren't its candidates. Rows with the query's own id are
the query's own, and no candidates; other repeated rows are candidates each. Queries
alike in id and vector are one. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringfold.llm.shared import settled

SHARD, LEAF, FIRST, QUERIES = 8192, 256, 16, 16_384


def integer_vectors(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(id, v): vectors of longs; those with a null or non-finite component are left out."""
    x = F.col(vector)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    fine = x.isNotNull() & F.col(id_column).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return table.where(F.coalesce(fine, F.lit(False))).select(F.col(id_column).cast("long").alias("id"), whole.alias("v"))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows of a with b; beyond the range of a long they end at its edge."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[-1])
    if most < 2**53:
        return (a.astype(float) @ b.astype(float)).astype(np.int64)
    if most < 2**62:
        return a @ b
    exact = a.astype(object) @ b.astype(object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


class BallTree:
    """Nodes in arrays; each halves its vectors along the line between two far ones."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.order, self.spans, self.children = np.arange(len(vectors)), [], []
        points, centres, radii = vectors.astype(float), [], []
        todo = [(0, len(vectors))] if len(vectors) else []
        while todo:
            a, b = todo.pop()
            mine = points[self.order[a:b]]
            centre = mine.mean(axis=0)
            away = np.sqrt(((mine - centre) ** 2).sum(axis=1))
            self.spans.append((a, b))
            centres.append(centre)
            radii.append(away.max())
            self.children.append(None)
            if b - a <= leaf or not away.max():
                continue
            one = mine[away.argmax()]
            two = mine[((mine - one) ** 2).sum(axis=1).argmax()]
            half = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(mine @ (two - one), half)]
            self.children[-1] = (len(self.spans), 0)
            todo += [(a + half, b), (a, a + half)]
        # nodes are numbered when they are met: the left child follows its parent, the right one is found by its span
        where = {span: k for k, span in enumerate(self.spans)}
        for k, (a, b) in enumerate(self.spans):
            if self.children[k] is not None:
                half = a + (b - a) // 2
                self.children[k] = (where[a, half], where[half, b])
        # a node's vectors stand side by side, and as floats where their products are exact
        self.vectors, self.centres, self.radii = vectors[self.order], np.array(centres), np.array(radii)
        self.most = float(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[-1])
        self.exact = self.vectors.astype(float) if self.most * self.most < 2**53 else None
        #: Leaves that searches have looked into.
        self.looked = 0

    def search(self, q: np.ndarray, ids: np.ndarray, own: int, k: int, floor: float = -np.inf) -> list[tuple[int, int]]:
        """(score, id) of at most k best rows, best first; rows below ``floor`` may be left out."""
        if not len(self.radii):
            return []
        point = q.astype(float)
        plain = self.exact is not None and self.most * float(np.abs(q).max(initial=0)) < 2**53
        bounds = self.centres @ point + np.sqrt(point @ point) * self.radii
        bounds += 1 + np.abs(bounds) * 1e-9
        best: list[tuple[int, int]] = []
        nodes = [(-bounds[0], 0)]
        while nodes:
            bound, node = heapq.heappop(nodes)
            if -bound < floor:
                break
            if self.children[node] is not None:
                for child in self.children[node]:
                    heapq.heappush(nodes, (-bounds[child], child))
                continue
            self.looked += 1
            a, b = self.spans[node]
            scores = (self.exact[a:b] @ point).astype(np.int64) if plain else inner(self.vectors[a:b], q)
            names = ids[self.order[a:b]]
            use = (scores >= floor) & (names != own)
            for s, i in zip(scores[use].tolist(), names[use].tolist(), strict=True):
                # the heap's first is the worst: lowest score, then largest id
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            if len(best) == k:
                floor = max(floor, best[0][0])
        return [(s, -i) for s, i in sorted(best, reverse=True)]


_OUT = "query_id long, vec_id long, score long"


def _plant(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The trees of a shard, one for each length of vector."""
    width, trees = rows["v"].map(len).to_numpy(), {}
    for n in np.unique(width).tolist():
        mine = rows[width == n]
        trees[n] = (BallTree(np.array(mine["v"].tolist(), np.int64).reshape(len(mine), n)), mine["id"].to_numpy())
    return pd.DataFrame({"shard": [key[0]], "trees": [pickle.dumps(trees)]})


def _search(k: int):
    def run(key: tuple, planted: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(planted) and len(queries):
            trees = pickle.loads(planted["trees"].iloc[0])
            for q, v, floor in zip(queries["query"], queries["point"], queries["floor"], strict=True):
                if len(v) in trees:
                    tree, ids = trees[len(v)]
                    out += [(q, i, s) for s, i in tree.search(np.asarray(v, np.int64), ids, q, k, floor)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")

    return run


def waves(shards: int) -> list[tuple[int, int]]:
    """Ranges of shards that are searched one after the other."""
    out, lo, n = [], 0, max(1, shards // FIRST)
    while lo < shards:
        out.append((lo, min(shards, lo + n)))
        lo, n = lo + n, 2 * n
    return out


def _blocks(queries: DataFrame) -> Iterator[DataFrame]:
    n = max(1, -(-queries.count() // QUERIES))
    for b in range(n):
        yield queries.where(F.pmod(F.xxhash64("query", F.lit(3)), F.lit(n)) == b)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best rows. ``vectors``: (id, v); ``is_query`` is a condition on id."""
    base = settled(vectors)
    shards = max(1, -(-base.count() // SHARD))
    dealt = base.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(shards)).cast("int"))
    planted = settled(dealt.groupBy("shard").applyInPandas(_plant, "shard int, trees binary"))
    queries = base.where(is_query).select(F.col("id").alias("query"), F.col("v").alias("point")).distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    done = None
    for block in _blocks(queries):
        found = None
        for lo, hi in waves(shards):
            asked = block.withColumn("floor", F.lit(float("-inf")))
            if found is not None:
                kth = found.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("kth"))
                asked = block.join(kth, block.query == kth.query_id, "left").select("query", "point", F.coalesce("kth", F.lit(float("-inf"))).alias("floor"))
            asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))))
            here = planted.where((F.col("shard") >= lo) & (F.col("shard") < hi))
            new = here.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(_search(k), _OUT)
            found = settled(best(new if found is None else found.drop("rank").unionByName(new)))
        done = found if done is None else done.unionByName(found)
    return done.select("query_id", "rank", "vec_id", "score")
