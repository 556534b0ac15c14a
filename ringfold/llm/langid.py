"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads windows of ``WINDOW`` bytes in both directions, labels every position, and
a document's probabilities are the mean over all its positions; every byte of a text is
read. It is trained here by backpropagation through time (Adam, seeded) on a bounded sample:
``sample`` documents of each language, those with the smallest hashes among the rows that may
be learnt from, and ``windows`` windows of each. Only text and label enter training, and only
text enters a prediction.

Rows: a null text or one without a letter is ``und`` with score 0. Rows without a label or
without a doc_id take no part in learning. Where nothing can be learnt all rows are ``und``.
Rows that repeat each get their row. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringfold.llm.text import buffers, bytes_of, slices

WINDOW, HIDDEN, BATCH = 128, 10, 2048
UNKNOWN = "und"


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): as bounded and monotonic as tanh, at a small part of its cost."""
    return x / (1 + np.abs(x))


class Direction:
    """A gated recurrent layer's weights: x (256, 3H) by byte, u (H, 3H); gates in the order update, reset, new."""

    def __init__(self, x: np.ndarray, u: np.ndarray):
        self.x, self.u = x, u

    def run(self, codes: np.ndarray, backward: bool) -> tuple[np.ndarray, list]:
        """States (T, B, H) after each position, and what the gradient needs."""
        steps, batch = codes.shape
        n = self.u.shape[0]
        states, h, kept = np.empty((steps, batch, n), self.u.dtype), np.zeros((batch, n), self.u.dtype), []
        for t in range(steps)[:: -1 if backward else 1]:
            a, s = self.x[codes[t]], h @ self.u
            gates = 0.5 + 0.5 * _squash(a[:, : 2 * n] + s[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            new = _squash(a[:, 2 * n :] + r * s[:, 2 * n :])
            before, h = h, new + z * (h - new)
            states[t] = h
            kept.append((t, before, z, r, new, s[:, 2 * n :]))
        return states, kept

    def states(self, codes: np.ndarray, live: np.ndarray | None, backward: bool) -> np.ndarray:
        """The same states as (T, H, B), in place and gate by gate. ``live`` (T, B) holds padded places at zero."""
        steps, batch = codes.shape
        n = self.u.shape[0]
        x, u, places = np.ascontiguousarray(self.x.T), np.ascontiguousarray(self.u.T), codes.astype(np.intp)
        out = np.empty((steps, n, batch), np.float32)
        a, s, size, new = np.empty((3 * n, batch), np.float32), np.empty((3 * n, batch), np.float32), np.empty((2 * n, batch), np.float32), np.empty((n, batch), np.float32)
        h = np.zeros((n, batch), np.float32)
        for t in range(steps)[:: -1 if backward else 1]:
            np.take(x, places[t], axis=1, out=a, mode="clip")
            np.matmul(u, h, out=s)
            gates, candidate = a[: 2 * n], a[2 * n :]
            gates += s[: 2 * n]
            np.abs(gates, out=size)
            size += 1
            gates /= size
            gates += 1
            gates *= 0.5
            np.multiply(gates[n:], s[2 * n :], out=new)
            candidate += new
            np.abs(candidate, out=new)
            new += 1
            np.divide(candidate, new, out=new)
            before, h = h, out[t]
            np.subtract(before, new, out=h)
            h *= gates[:n]
            h += new
            if live is not None:
                h *= live[t]
        return out

    def gradient(self, codes: np.ndarray, kept: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of x and u by backpropagation through time."""
        n = self.u.shape[0]
        d_x, d_u, d_h = np.zeros_like(self.x), np.zeros_like(self.u), np.zeros(d_states.shape[1:], self.u.dtype)
        for t, before, z, r, new, s_new in reversed(kept):
            d_h = d_h + d_states[t]
            d_new = d_h * (1 - z) * (1 - np.abs(new)) ** 2
            d_z = d_h * (before - new) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            d_r = d_new * s_new * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            d_a = np.concatenate([d_z, d_r, d_new], axis=1)
            d_s = np.concatenate([d_z, d_r, d_new * r], axis=1)
            np.add.at(d_x, codes[t], d_a)
            d_u += before.T @ d_s
            d_h = d_h * z + d_s @ self.u.T
        return d_x, d_u


class Network:
    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        make = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.weights = [make(256, 3 * hidden), make(hidden, 3 * hidden), make(256, 3 * hidden), make(hidden, 3 * hidden), make(2 * hidden, len(labels)), np.zeros(len(labels), np.float32)]

    def probabilities(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums of the positions' probabilities for each window. ``codes`` (T, B) padded after ``lengths``."""
        fx, fu, bx, bu, v, b = self.weights
        n, live = fu.shape[0], None
        if lengths.min() < len(codes):
            live = (np.arange(len(codes))[:, None] < lengths).astype(np.float32)
        p = np.matmul(np.ascontiguousarray(v[:n].T), Direction(fx, fu).states(codes, None, False))
        p += np.matmul(np.ascontiguousarray(v[n:].T), Direction(bx, bu).states(codes, live, True))
        p += b[:, None]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        if live is not None:
            p *= live[:, None, :]
        return p.sum(axis=0, dtype=np.float64).T

    def loss_gradient(self, codes: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy of all positions, and its gradient for each weight."""
        fx, fu, bx, bu, v, bias = self.weights
        ahead, kept_a = Direction(fx, fu).run(codes, False)
        back, kept_b = Direction(bx, bu).run(codes, True)
        both = np.concatenate([ahead, back], axis=2)
        logits = both @ v + bias
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        steps, batch, _ = p.shape
        at = np.arange(batch)
        loss = float(-np.log(np.maximum(p[:, at, label], 1e-30)).mean())
        p[:, at, label] -= 1
        d = (p / (steps * batch)).astype(both.dtype)
        d_both, n = d @ v.T, fu.shape[0]
        d_fx, d_fu = Direction(fx, fu).gradient(codes, kept_a, d_both[:, :, :n])
        d_bx, d_bu = Direction(bx, bu).gradient(codes, kept_b, d_both[:, :, n:])
        flat = both.reshape(-1, 2 * n)
        return loss, [d_fx, d_fu, d_bx, d_bu, flat.T @ d.reshape(len(flat), -1), d.sum(axis=(0, 1))]

    def fit(self, codes: np.ndarray, label: np.ndarray, epochs: int = 6, batch: int = 256, rate: float = 0.02, seed: int = 11) -> list[float]:
        """Adam over shuffled batches of windows (T, N); the losses of the epochs."""
        rng, first, second, step, losses = np.random.default_rng(seed), [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0, []
        for epoch in range(epochs):
            order, total = rng.permutation(codes.shape[1]), []
            for k in range(0, len(order), batch):
                at, step = order[k : k + batch], step + 1
                loss, grads = self.loss_gradient(codes[:, at], label[at])
                total.append(loss)
                now = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for w, m, s, g in zip(self.weights, first, second, grads, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    w -= (now * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(total)))
        return losses


def _windows(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (T, W) of all windows of all texts, padded with zeros, their lengths, and the text of each."""
    counts = -(-np.diff(off) // size)
    text = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = off[text] + within * size
    lengths = np.minimum(size, off[text + 1] - begin)
    at = begin[:, None] + np.arange(size)
    codes = np.concatenate([buf, np.zeros(size, np.uint8)])[np.minimum(at, len(buf))]
    codes[np.arange(size) >= lengths[:, None]] = 0
    return np.ascontiguousarray(codes.T), lengths, text


def training_windows(docs: DataFrame, learn: Column, sample: int, windows: int, size: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes (T, N), labels as indices, and the labels' names. At most ``sample`` documents of each language give ``windows`` windows each."""
    rows = docs.select(F.col("lang").cast("string").alias("label"), F.xxhash64(F.lit(13), "doc_id", "text").alias("spot"), F.col("text"), learn.alias("learn")).where(F.col("learn") & F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}")).drop("learn")
    counts = rows.groupBy("label").count().collect()
    if not counts:
        return np.zeros((size, 0), np.uint8), np.zeros(0, np.int64), []
    # a generous share by hash first, so that only a bounded number of rows of a language is ranked
    share = F.coalesce(*[F.when(F.col("label") == r["label"], F.lit(min(1.0, 4 * sample / r["count"]))) for r in counts])
    near = rows.where(F.shiftrightunsigned("spot", 11).cast("double") / float(1 << 53) < share)
    best = near.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("spot", F.length("text")))).where(F.col("n") <= sample)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, spots, out = [], [], []
            for label, spot, body in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rng = np.random.default_rng(spot & 0xFFFFFFFF)
                text = body if len(body) >= size else body * -(-size // max(1, len(body)))
                for a in rng.integers(0, len(text) - size + 1, windows).tolist():
                    labels.append(label), spots.append(spot), out.append(text[a : a + size])
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(spots, pa.int64()), pa.array(out, pa.binary())], ["label", "spot", "code"])

    found = best.select("label", "spot", bytes_of("text").alias("body")).mapInArrow(cut, "label string, spot long, code binary").collect()
    names = sorted({r.label for r in found})
    found.sort(key=lambda r: (r.label, r.spot, bytes(r.code)))
    codes = np.frombuffer(b"".join(bytes(r.code) for r in found), np.uint8).reshape(len(found), size)
    return np.ascontiguousarray(codes.T), np.array([names.index(r.label) for r in found], np.int64), names


def learnable() -> Column:
    """Whether a row may be learnt from: crc32 of its doc_id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(False))


def train(docs: DataFrame, learn: Column, sample: int = 200, windows: int = 8, size: int = 64) -> Network | None:
    codes, label, names = training_windows(docs, learn, sample, windows, size)
    if not names:
        return None
    network = Network(names)
    network.fit(codes, label)
    return network


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score, shares) for each row; ``shares`` are the labels' probabilities in the order of the network's labels."""
    labels = network.labels if network else []
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lettered.alias("lettered"), bytes_of("text").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=2 << 20):
            codes, lengths, text = _windows(*buffers(batch.column(2)), WINDOW)
            total, known = np.zeros((batch.num_rows, max(1, len(labels)))), np.array(batch.column(1).to_pylist(), bool)
            use = np.flatnonzero(known[text]) if network else np.zeros(0, np.int64)
            # windows of full length together, so that only the others need padding held at zero
            use = use[np.argsort(lengths[use] < WINDOW, kind="stable")]
            full = int((lengths[use] == WINDOW).sum())
            for a, b in [(k, min(k + BATCH, full)) for k in range(0, full, BATCH)] + [(k, k + BATCH) for k in range(full, len(use), BATCH)]:
                at = use[a:b]
                np.add.at(total, text[at], network.probabilities(codes[:, at], lengths[at]))
            share = total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300)
            best = share.argmax(axis=1)
            named = [labels[k] if ok and labels else UNKNOWN for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
            score = np.where(known, np.clip(share.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, pa.string()), pa.array(score), pa.array(share.tolist(), pa.list_(pa.float64()))], ["doc_id", "lang_pred", "score", "shares"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, shares array<double>")
