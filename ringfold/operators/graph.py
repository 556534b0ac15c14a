"""Graphs as tables of links: components, greedy leaders, families, voxel clean-up.

Links stay distributed. Only what is order-dependent within a group is one task's work, and
says so.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """Writes the rows once to the shared checkpoint folder that spark.checkpoint.dir names. Only a local session, as in tests, may do without and gets a temporary one."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ringfold-"))
    return df.checkpoint(eager=True)


def forest(links: DataFrame, most: int = 200_000) -> DataFrame:
    """(x, y): links with the same components, fewer than nodes for each task (or for every ``most`` nodes of one)."""
    kind = dict(links.dtypes)["x"]

    def run(batches):
        import pandas as pd

        up: dict = {}

        def top(n):
            while (m := up.setdefault(n, n)) != n:
                up[n] = n = up[m]
            return n

        def held():
            return pd.DataFrame([(n, r) for n in list(up) if (r := top(n)) != n], columns=["x", "y"])

        for rows in batches:
            for x, y in zip(rows["x"].tolist(), rows["y"].tolist(), strict=True):
                if (p := top(x)) != (q := top(y)):
                    up[max(p, q)] = min(p, q)
            if len(up) > most:
                yield held()
                up.clear()
        yield held()

    return links.mapInPandas(run, f"x {kind}, y {kind}")


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link. Minimum labels spread over links, and labels' own labels halve the way each round."""
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    # links of one task that tell nothing new are left out before they are written
    both = forest(both)
    both = settle(both.union(both.select("y", "x")).distinct())
    labels = settle(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("l")))
    while True:
        offered = both.join(labels.select(F.col("x").alias("y"), "l"), "y").groupBy("x").agg(F.min("l").alias("o"))
        met = labels.join(offered, "x").select("x", F.col("l").alias("was"), F.least("l", "o").alias("l"))
        jump = met.select(F.col("x").alias("k"), F.col("l").alias("j"))
        new = settle(met.join(jump, met.l == jump.k, "left").select("x", "was", F.least(F.col("l"), F.coalesce("j", "l")).alias("l")))
        changed = new.where("l <> was").limit(1).count()
        labels = new.select("x", "l")
        if not changed:
            return labels.select(F.col("x").alias("node"), F.col("l").alias("component"))


def dense_labels(labelled: DataFrame, label: str, name: str) -> DataFrame:
    """Labels renumbered from 0 in their order; only distinct labels are ranked."""
    kinds = labelled.select(label).where(F.col(label).isNotNull()).distinct().withColumn(name, F.row_number().over(Window.orderBy(label)) - 1)
    return labelled.join(kinds, label, "left").withColumn(name, F.coalesce(name, F.lit(-1)))


def grid_links(cells: DataFrame, keys: list[str], id_column: str, y: str, x: str, eight: bool = True) -> DataFrame:
    """(keys, a, b) of neighbouring cells of equal keys, a < b."""
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (eight or not (i and j))]
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])).alias("s")
    near = cells.select(*keys, F.col(id_column).alias("a"), F.col(y).alias("__y"), F.col(x).alias("__x"), around).select(*keys, "a", (F.col("__y") + F.col("s.i")).alias(y), (F.col("__x") + F.col("s.j")).alias(x))
    return near.join(cells.select(*keys, F.col(id_column).alias("b"), y, x), [*keys, y, x]).where("a < b").select(*keys, "a", "b")


def drop_small(cells: DataFrame, keys: list[str], id_column: str, y: str, x: str, least: int) -> DataFrame:
    """Cells in 8-connected components of at least ``least`` cells of equal keys."""
    found = connected(grid_links(cells, keys, id_column, y, x), "a", "b")
    named = cells.join(found.withColumnRenamed("node", id_column), id_column, "left").withColumn("component", F.coalesce("component", id_column))
    size = named.groupBy("component").agg(F.count("*").alias("size"))
    return named.join(size.where(F.col("size") >= least), "component").select(*cells.columns)


def regional_maxima(cells: DataFrame, keys: list[str], y: str, x: str, value: str, most: int, tie: str) -> DataFrame:
    """Cells with no strictly higher 8-neighbour, the ``most`` brightest of each key."""
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])).alias("s")
    offered = cells.select(*keys, F.col(y).alias("__y"), F.col(x).alias("__x"), F.col(value).alias("__v"), around).select(*keys, (F.col("__y") + F.col("s.i")).alias(y), (F.col("__x") + F.col("s.j")).alias(x), "__v")
    best = offered.groupBy(*keys, y, x).agg(F.max("__v").alias("__best"))
    top = cells.join(best, [*keys, y, x], "left").where(F.col("__best").isNull() | (F.col(value) >= F.col("__best"))).drop("__best")
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), tie))).where(F.col("rank") <= most)


def leaders(df: DataFrame, key: str, id_column: str, order: list[str], vector: str, radius: float) -> DataFrame:
    """(key, id, leader): in the order given, a row not yet taken leads and takes all later ones within ``radius`` (Euclid). Order-dependent, so a key is one task's work."""
    import numpy as np
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*order, id_column])
        points, ids = np.array(rows[vector].tolist(), float), rows[id_column].to_numpy()
        leader = np.full(len(ids), -1, np.int64)
        for k in range(len(ids)):
            if leader[k] < 0:
                near = np.sqrt(((points[k:] - points[k]) ** 2).sum(axis=1)) <= radius
                free = np.flatnonzero(near & (leader[k:] < 0)) + k
                leader[free] = k
        return pd.DataFrame({key: rows[key], id_column: ids, "leader": ids[leader]})

    kinds = dict(df.dtypes)
    return df.select(key, id_column, vector, *[o for o in order if o not in (key, id_column, vector)]).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {id_column} {kinds[id_column]}, leader {kinds[id_column]}")


def anchor_families(links: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(group, node, family): the node with most links (ties to the smaller) anchors a family of itself and its direct neighbours not yet in one, and so on. A group is one task's work."""
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, set[int]] = {}
        for x, y in zip(rows[a], rows[b], strict=True):
            near.setdefault(x, set()).add(y)
            near.setdefault(y, set()).add(x)
        family: dict[int, int] = {}
        for node in sorted(near, key=lambda n: (-len(near[n]), n)):
            if node not in family:
                for other in [node, *near[node]]:
                    family.setdefault(other, node)
        return pd.DataFrame({group: rows[group].iloc[0], "node": list(family), "family": list(family.values())})

    kinds = dict(links.dtypes)
    return links.select(group, a, b).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, node {kinds[a]}, family {kinds[a]}")


def clean_voxels(voxels: DataFrame, y: str, x: str, label: str, most_same: int, rounds: int = 20) -> DataFrame:
    """Voxels with at most ``most_same`` 4-neighbours of their own label take the label most frequent around them (ties to the smaller, -1 without neighbours), all at once, until nothing changes."""
    state = settle(voxels.select(y, x, label))
    for _ in range(rounds):
        steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))])).alias("s")
        around = state.select(F.col(y).alias("__y"), F.col(x).alias("__x"), F.col(label).alias("__l"), steps).select((F.col("__y") + F.col("s.i")).alias(y), (F.col("__x") + F.col("s.j")).alias(x), "__l")
        votes = around.groupBy(y, x, "__l").agg(F.count("*").alias("n"))
        top = votes.groupBy(y, x).agg(F.max(F.struct("n", (-F.col("__l")).alias("m"))).alias("best"))
        own = state.join(votes.withColumnRenamed("__l", label), [y, x, label], "left").select(y, x, label, F.coalesce("n", F.lit(0)).alias("same"))
        new = settle(own.join(top, [y, x], "left").select(y, x, label, F.when(F.col("same") <= most_same, F.coalesce(-F.col("best.m"), F.lit(-1))).otherwise(F.col(label)).alias("new")))
        changed = new.where(F.col("new") != F.col(label)).limit(1).count()
        state = new.select(y, x, F.col("new").alias(label))
        if not changed:
            break
    return state


def merge_graph(pairs: DataFrame, agree: str, disagree: str, least: int) -> DataFrame:
    """Components over pairs (a, b) that agree at least ``least`` times and never disagree."""
    return connected(pairs.where((F.col(agree) >= least) & (F.col(disagree) == 0)), "a", "b")
