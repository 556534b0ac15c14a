"""Iterative solvers for groups of rows: a group is one task's work, groups run in parallel."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfold.functions import solvers
from ringfold.operators.graph import settle


def fit_peaks(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, height, centre, width, share, base, rss): a pseudo-Voigt peak on a level base for each key's points."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(x)
        a, b = rows[x].to_numpy(float), rows[y].to_numpy(float)
        spread = max(a.max() - a.min(), 1e-9)

        def miss(p: np.ndarray) -> np.ndarray:
            u = (a - p[1]) / max(abs(p[2]), 1e-9)
            share = 1 / (1 + np.exp(-p[3]))
            return p[0] * (share / (1 + 4 * u * u) + (1 - share) * np.exp(-4 * np.log(2) * u * u)) + p[4] - b

        p, rss = solvers.least_squares(miss, np.array([b.max() - b.min(), a[b.argmax()], spread / 4, 0.0, b.min()]))
        return pd.DataFrame({key: [rows[key].iloc[0]], "height": [p[0]], "centre": [p[1]], "width": [abs(p[2])], "share": [1 / (1 + np.exp(-p[3]))], "base": [p[4]], "rss": [rss]})

    return df.select(key, x, y).groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, height double, centre double, width double, share double, base double, rss double")


def fit_strain(df: DataFrame, key: str, normal: tuple[str, str, str], strain: str) -> DataFrame:
    """(key, e11, e22, e33, e23, e13, e12) by least squares from relative spacing changes along unit normals.

    Normal equations are summed in the shuffle (27 sums for each key); only 6x6 systems are solved in Python. Fewer than six rows, or a system without rank, give nulls.
    """
    x, y, z = (F.col(c) for c in normal)
    basis = [x * x, y * y, z * z, 2 * y * z, 2 * x * z, 2 * x * y]
    pairs = [(i, j) for i in range(6) for j in range(i, 6)]
    sums = df.groupBy(key).agg(F.count("*").alias("n"), *[F.sum(basis[i] * basis[j]).alias(f"a{i}{j}") for i, j in pairs], *[F.sum(b * F.col(strain)).alias(f"b{i}") for i, b in enumerate(basis)])
    names = ["e11", "e22", "e33", "e23", "e13", "e12"]

    def solve(batches):
        for rows in batches:
            out = np.full((len(rows), 6), np.nan)
            for k, r in enumerate(rows.itertuples(index=False)):
                a = np.zeros((6, 6))
                for i, j in pairs:
                    a[i, j] = a[j, i] = getattr(r, f"a{i}{j}")
                if r.n >= 6 and np.linalg.matrix_rank(a) == 6:
                    out[k] = np.linalg.solve(a, [getattr(r, f"b{i}") for i in range(6)])
            yield pd.DataFrame({key: rows[key], **{n: out[:, i] for i, n in enumerate(names)}})

    return sums.mapInPandas(solve, f"{key} {dict(df.dtypes)[key]}, " + ", ".join(f"{n} double" for n in names))


def reconstruct(sinogram: DataFrame, key: str, angle: str, place: str, value: str, n: int, method: str = "fbp", rounds: int = 20) -> DataFrame:
    """(key, y, x, value) of each slice: filtered back-projection, or "sirt"/"mlem" iterations. Angles in degrees; missing cells count 0."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        angles = np.sort(rows[angle].unique())
        table = np.zeros((len(angles), n))
        table[np.searchsorted(angles, rows[angle]), rows[place].to_numpy(int)] = rows[value]
        turned = np.radians(angles)
        image = solvers.filtered_back_projection(table, turned) if method == "fbp" else solvers.iterate_slice(solvers.projection_matrix(n, turned), table.ravel(), rounds, method).reshape(n, n)
        y, x = np.divmod(np.arange(n * n), n)
        return pd.DataFrame({key: rows[key].iloc[0], "y": y, "x": x, "value": image.ravel()})

    return sinogram.select(key, angle, place, value).groupBy(key).applyInPandas(run, f"{key} {dict(sinogram.dtypes)[key]}, y long, x long, value double")


#: Entries of rows by columns in a chunk, and those up to which the driver keeps the chunks (16 bytes each).
CHUNK, NEAR = 1 << 18, 1 << 22
#: Columns whose sums travel to the driver as one piece.
WIDE = 1 << 17


def volumes(claims: DataFrame, row: str, column: str, weight: str, target: str) -> DataFrame:
    """(column, volume): non-negative least squares of target over rows by columns, of any number.

    Rows are written once as chunks of entries. The normal equations are never made: the
    solver asks for their product with a vector, which is one pass over the chunks, on the
    driver if there are few entries. The driver holds some vectors as long as there are
    columns. A claim without a row or a weight adds nothing to its column.
    """
    kind = dict(claims.dtypes)[column]
    w = F.coalesce(F.when(F.col(row).isNotNull(), F.col(weight)), F.lit(0)).cast("double")
    a = claims.select(F.col(row).alias("r"), F.col(column).alias("i"), w.alias("w"), F.coalesce(F.col(target), F.lit(0)).cast("double").alias("t"))
    chunks = settle(a.repartition("r").sortWithinPartitions("r").mapInArrow(_chunked, f"names array<{kind}>, sums array<double>, squares array<double>, first binary, at binary, w binary"))
    each = chunks.select(F.explode(F.arrays_zip("names", "sums", "squares")).alias("x"))
    known = each.groupBy(F.col("x.names").alias("i")).agg(F.sum("x.sums").alias("b"), F.sum("x.squares").alias("d")).orderBy("i").toArrow()
    if not known.num_rows:
        return claims.sparkSession.createDataFrame([], f"{column} {kind}, volume double")
    names, b, d = known["i"].combine_chunks(), known["b"].to_numpy(), known["d"].to_numpy()

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                place = pc.index_in(batch["names"][n].values, value_set=names).to_numpy().astype(np.int32)
                at_ = place[np.frombuffer(batch["at"][n].as_py(), np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (batch["first"][n].as_py(), at_.tobytes(), batch["w"][n].as_py())], ["first", "at", "w"])

    ready = chunks.mapInArrow(numbered, "first binary, at binary, w binary")
    if chunks.agg(F.sum(F.length("w"))).first()[0] <= 8 * NEAR:
        here = [[np.frombuffer(x, k) for x, k in zip(r, (np.int32, np.int32, float), strict=True)] for r in ready.collect()]
        found = solvers.nonnegative(lambda v: _products(here, v), b, d)
    else:
        ready = settle(ready)
        found = solvers.nonnegative(lambda v: _product_of(ready, v), b, d)
    return claims.sparkSession.createDataFrame(list(zip(names.to_pylist(), found.tolist(), strict=True)), f"{column} {kind}, volume double")


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of whole rows from entries that come row by row: the columns met, their sums of weight by target and of squares, where each row begins, each entry's place among those columns, and its weight."""

    def chunk(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        met = t["i"].combine_chunks().dictionary_encode(null_encoding="encode")
        at_, w, first = met.indices.to_numpy().astype(np.int32), t["w"].to_numpy(), np.flatnonzero(_begins(t["r"].combine_chunks())).astype(np.int32)
        sums, squares = (np.bincount(at_, x, len(met.dictionary)) for x in (w * t["t"].to_numpy(), w * w))
        return pa.RecordBatch.from_arrays([pa.array([x], pa.list_(k)) for x, k in ((met.dictionary, met.dictionary.type), (sums, pa.float64()), (squares, pa.float64()))] + [pa.array([x.tobytes()], pa.binary()) for x in (first, at_, w)], ["names", "sums", "squares", "first", "at", "w"])

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= CHUNK:
            # what is held ends where the last row that begins here does; a row that goes on stays whole
            begins = np.flatnonzero(_begins(batch["r"]))
            cut = 0 if batch["r"][0] != held[-1]["r"][held[-1].num_rows - 1] else int(begins[1]) if len(begins) > 1 else batch.num_rows
            if cut:
                held.append(batch.slice(0, cut))
                size += cut
            if cut < batch.num_rows:
                yield chunk(held)
                held, size = [batch.slice(cut)], batch.num_rows - cut
        else:
            held.append(batch)
            size += batch.num_rows
    if held:
        yield chunk(held)


def _begins(r: pa.Array) -> np.ndarray:
    """Whether each value differs from that before it."""
    new = pc.fill_null(pc.not_equal(r[1:], r[:-1]), True).to_numpy(zero_copy_only=False)
    return np.concatenate([[True], new])


def _products(chunks: Iterable[list[np.ndarray]], v: np.ndarray) -> np.ndarray:
    """Normal equations times a vector, by the rows of the chunks."""
    out = np.zeros(len(v))
    for first, at_, w in chunks:
        rows = np.add.reduceat(w * v[at_], first)
        np.add.at(out, at_, w * np.repeat(rows, np.diff(first, append=np.int32(len(at_)))))
    return out


def _product_of(chunks: DataFrame, v: np.ndarray) -> np.ndarray:
    """The same by a pass of all tasks; of more columns than ``WIDE``, tasks' sums are added piece by piece before they travel."""
    sent = chunks.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _products(([np.frombuffer(batch[c][n].as_buffer(), k) for c, k in (("first", np.int32), ("at", np.int32), ("w", float))] for batch in batches for n in range(batch.num_rows)), sent.value)
        for n in range(0, len(out), WIDE):
            yield pa.RecordBatch.from_arrays([pa.array([n // WIDE], pa.int32()), pa.array([out[n : n + WIDE].tobytes()], pa.binary())], ["piece", "v"])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"piece": rows["piece"].iloc[:1], "v": [sum(np.frombuffer(x) for x in rows["v"]).tobytes()]})

    pieces, total = chunks.mapInArrow(run, "piece int, v binary"), np.zeros(len(v))
    if len(v) > WIDE:
        pieces = pieces.groupBy("piece").applyInPandas(added, "piece int, v binary")
    for r in pieces.collect():
        total[r.piece * WIDE : (r.piece + 1) * WIDE] += np.frombuffer(r.v)
    sent.destroy()
    return total
