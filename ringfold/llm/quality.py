"""Quality rules: base counts, and language-specific bands of n-gram perplexity.

The model is an interpolated modified Kneser-Ney model over the code points of the text,
folded (lower case, digits alike, white space as one space), of order ``ORDER`` for each
language. Spark counts the n-grams of every document, in two folds by a hash of the text, and
computes discounts, back-off weights and probabilities of both folds' models at once. A
document is scored by the model of the other fold, so no text vouches for itself, and neither
do its exact copies.

What is counted grows with the corpus. The scores of the most frequent n-grams, at most
``MODEL_ROWS``, are broadcast as arrays sorted by 64-bit hash; n-grams beyond them, if there
are any, are met by a join, in which no key is frequent because the frequent ones are in the
arrays. Scores are whole numbers (natural logarithms times ``SCALE``), so their sums are the
same whichever way each n-gram went.

A document is rejected if the logarithm of its perplexity lies outside its language's band:
the median plus or minus ``WIDTH`` times the scaled median absolute deviation, both taken from
an exact histogram over all documents that pass the base rules. Text of another kind or
language lies above, text that repeats itself lies below. The language's own spread decides:
``LEAST`` is two of the histogram's steps, below which a deviation can't be told from rounding.
``WIDTH`` is the least whole number at which fewer than one in a hundred of the documents
labelled good were rejected where it was chosen (README).

Rows: a null text has no words and fails the base rules; a null language is a language of
its own. Rows that repeat each get their row. An empty table gives no rows. A language whose
documents are all in one fold is scored evenly over its code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringfold.llm.shared import privately, settled
from ringfold.llm.text import IS_SPACE, buffers, bytes_of, mix, slices, window_hashes, word_hashes, words

ORDER = 4
#: N-grams whose scores are broadcast, 16 bytes each in a worker.
MODEL_ROWS = 3_000_000
SCALE = 1 << 20
#: Bytes of text, and code points, that are worked on at once; about a hundred bytes of memory for each.
_CHUNK = 1 << 18
STEP = 0.001
WIDTH, LEAST = 5.0, 2 * STEP
_PAD = 2
_BITS = 21
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def folded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts, each after ORDER - 1 pads, and the offset of each text's first pad (one more entry)."""
    joined = ("\x02" * (ORDER - 1)).join(["", *(t.decode("utf-8", "replace").lower().replace("\x02", " ") for t in texts)])
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    c[(c >= 48) & (c <= 57)] = 48
    blank = (c <= 32) & (c != _PAD) | (c == 0xA0) | (c == 0x3000)
    c[blank] = 32
    again = np.zeros(len(c), bool)
    again[1:] = blank[1:] & blank[:-1]
    c = c[~again]
    pads = c == _PAD
    begins = np.flatnonzero(pads & ~np.append(False, pads[:-1])) if ORDER > 1 else np.zeros(0, np.int64)
    # texts without a character run their pads together
    if len(begins) != len(texts):
        begins = np.flatnonzero(pads)[:: ORDER - 1]
    return c, np.append(begins, len(c))


def grams(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point that isn't a pad: its index, and the n-gram that ends there as two longs."""
    at = np.flatnonzero(c != _PAD)
    wide = c.astype(np.int64)
    high = wide[at - 3] << _BITS | wide[at - 2]
    low = wide[at - 1] << _BITS | wide[at]
    return at, high, low


def gram_hash(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return mix(mix(high.astype(np.uint64) + np.uint64(0x51)) ^ low.astype(np.uint64))


def _salts(batch: pa.RecordBatch) -> np.ndarray:
    """What is added to n-gram hashes of each row, by its language and fold."""
    g, tie = (batch.column(k).to_numpy() for k in (0, 2))
    return salt(g, tie & 1)


def salt(g: np.ndarray, fold: np.ndarray) -> np.ndarray:
    return mix(mix(g.astype(np.uint64)) + fold.astype(np.uint64))


def _grams_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, high, low, salted hash) of the n-grams of all rows, a bounded number at a time."""
    salts = _salts(batch)
    c, begins = folded(batch.column(batch.schema.get_field_index("body")).to_pylist())
    for a in range(0, len(c), _CHUNK):
        lead = min(a, ORDER - 1)
        at, high, low = grams(c[a - lead : a + _CHUNK])
        at, high, low = (x[np.searchsorted(at, lead) :] for x in (at, high, low))
        row = np.searchsorted(begins, at + (a - lead), "right") - 1
        yield row, high, low, gram_hash(high, low) ^ salts[row]


def _merged(held: list[tuple]) -> list[tuple]:
    h, g, fold, high, low, n = (np.concatenate(x) for x in zip(*held, strict=True))
    h, first, back = np.unique(h, return_index=True, return_inverse=True)
    return [(h, g[first], fold[first], high[first], low[first], np.bincount(back, n, len(h)).astype(np.int64))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(held)[0][1:]], ["g", "fold", "high", "low", "n"])

    for batch in slices(batches, most=_CHUNK):
        g, tie = (batch.column(k).to_numpy() for k in (0, 2))
        for row, high, low, h in _grams_of(batch):
            if len(h):
                # what is counted once in a slice is much less than its text
                h, first, n = np.unique(h, return_index=True, return_counts=True)
                row = row[first]
                held.append((h, g[row], tie[row] & 1, high[first], low[first], n))
        if len(held) >= 4:
            held = _merged(held)
            if len(held[0][0]) > _CHUNK:
                yield out()
                held = []
    if held:
        yield out()


_MASK = (1 << _BITS) - 1


def _shorter(drop: int) -> tuple[Column, Column]:
    """Columns high and low with the first ``drop`` code points blanked; 0 stands for a place that isn't there."""
    if drop == 1:
        return F.col("high").bitwiseAND(F.lit(_MASK)), F.col("low")
    return F.lit(0).cast("long"), F.col("low") if drop == 2 else F.col("low").bitwiseAND(F.lit(_MASK))


def _discounts(counts: DataFrame) -> DataFrame:
    """(order, g, d10, d20, d30, d11, d21, d31): discounts of counts 1, 2 and 3 or more in fold 0 and fold 1.

    They follow from how many n-grams occur once to four times in each language; a discount
    that these don't give (some count of counts is 0) is half the count.
    """
    tally = counts.groupBy("order", "g").agg(*[F.sum(F.when(F.col(f"n{f}") == k, 1.0).otherwise(0.0)).alias(f"t{k}{f}") for f in (0, 1) for k in (1, 2, 3, 4)])

    def discount(k: int, f: int):
        t = {j: F.col(f"t{j}{f}") for j in (1, 2, 3, 4)}
        fine = (t[1] > 0) & (t[k] > 0) & (t[k + 1] > 0)
        y = t[1] / F.greatest(t[1] + 2 * t[2], F.lit(1.0))
        usual = F.lit(k) - (k + 1) * y * t[k + 1] / F.greatest(t[k], F.lit(1.0))
        return F.when(fine, F.least(F.greatest(usual, F.lit(0.05)), F.lit(k - 0.05))).otherwise(k * 0.5)

    return tally.select("order", "g", *[discount(k, f).alias(f"d{k}{f}") for f in (0, 1) for k in (1, 2, 3)])


def _own(counts: DataFrame) -> DataFrame:
    """(order, g, high, low, n0, n1, own0, own1, back0, back1, v): each fold's discounted share, and the weight left to shorter n-grams.

    A context that a fold hasn't seen leaves all to the shorter ones. A context has as many
    followers (v, one more for what was never seen) as the language has code points at most.
    """
    rows = counts.join(F.broadcast(_discounts(counts)), ["order", "g"])
    for f in (0, 1):
        n = F.col(f"n{f}")
        rows = rows.withColumn(f"d{f}", F.when(n == 0, 0.0).when(n == 1, F.col(f"d1{f}")).when(n == 2, F.col(f"d2{f}")).otherwise(F.col(f"d3{f}")))
    every = Window.partitionBy("order", "g", "high", "context")
    sums = [F.sum(f"{x}{f}").over(every).alias(f"{x}_{f}") for x in ("n", "d") for f in (0, 1)]
    rows = rows.withColumn("context", F.shiftright("low", _BITS)).select("*", *sums, (F.count("*").over(every) + 1).alias("v"))
    seen = {f: F.col(f"n_{f}") > 0 for f in (0, 1)}
    total = {f: F.greatest(F.col(f"n_{f}"), F.lit(1)) for f in (0, 1)}
    return rows.select(
        "order", "g", "high", "low", "n0", "n1", "v",
        *[((F.col(f"n{f}") - F.col(f"d{f}")) / total[f]).alias(f"own{f}") for f in (0, 1)],
        *[F.when(seen[f], F.col(f"d_{f}") / total[f]).otherwise(1.0).alias(f"back{f}") for f in (0, 1)],
    )


def probabilities(counts: DataFrame) -> DataFrame:
    """(g, high, low, n0, n1, p0, p1): both folds' interpolated probabilities of every n-gram of order ORDER that either has.

    ``counts``: (g, fold, high, low, n). Shorter n-grams count in how many longer ones they
    end; those that begin a text, which nothing precedes, count as often as they occur.
    """
    both = [F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"n{f}") for f in (0, 1)]
    levels = [settled(counts.groupBy("g", "high", "low").agg(*both))]
    for drop in (1, 2, 3):
        high, low = _shorter(drop)
        first = (F.col("low") if drop == 3 else F.shiftright("low", _BITS) if drop == 2 else F.col("high")) == _PAD
        shorter = levels[-1].select("g", high.alias("high"), low.alias("low"), "n0", "n1")
        times = [F.when(first, F.col(f"n{f}")).otherwise(F.when(F.col(f"n{f}") > 0, 1).otherwise(0)).alias(f"n{f}") for f in (0, 1)]
        levels.append(shorter.select("g", "high", "low", *times).groupBy("g", "high", "low").agg(*[F.sum(f"n{f}").alias(f"n{f}") for f in (0, 1)]))
    every = None
    for order, level in zip((4, 3, 2, 1), levels, strict=True):
        level = level.withColumn("order", F.lit(order))
        every = level if every is None else every.unionByName(level)
    own = settled(_own(settled(every)))
    done = own.where("order = 1").select("g", "high", "low", *[(F.col(f"own{f}") + F.col(f"back{f}") / F.col("v")).alias(f"p{f}") for f in (0, 1)])
    for order in (2, 3, 4):
        high, low = _shorter(ORDER - order + 1)
        lower = done.select("g", F.col("high").alias("h"), F.col("low").alias("l"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
        longer = own.where(F.col("order") == order).withColumns({"h": high, "l": low})
        done = longer.join(lower, ["g", "h", "l"]).select("g", "high", "low", "n0", "n1", *[(F.col(f"own{f}") + F.col(f"back{f}") * F.col(f"q{f}")).alias(f"p{f}") for f in (0, 1)])
    return done


def score_table(docs: DataFrame) -> DataFrame:
    """(g, fold, high, low, n, score) of every n-gram of every fold: how often it occurs there, and its score by the other fold's model."""
    p = settled(probabilities(_rows(docs).mapInArrow(_count, "g long, fold long, high long, low long, n long")))
    sides = [p.where(F.col(f"n{f}") > 0).select("g", F.lit(f).cast("long").alias("fold"), "high", "low", F.col(f"n{f}").alias("n"), F.round(F.log(f"p{1 - f}") * SCALE).cast("int").alias("score")) for f in (0, 1)]
    return sides[0].unionByName(sides[1])


class Scores:
    """Scores of n-grams in arrays sorted by salted hash, found from where the hash's leading bits begin."""

    def __init__(self, g: np.ndarray, fold: np.ndarray, high: np.ndarray, low: np.ndarray, score: np.ndarray):
        h = gram_hash(high, low) ^ salt(g, fold)
        order = np.argsort(h)
        self.keys, self.scores = h[order], score[order].astype(np.int32)
        self.shift = np.uint64(64 - max(8, len(h).bit_length()))
        self.begins = np.searchsorted(self.keys >> self.shift, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64)).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score of each hash, and whether it has one."""
        out, found = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        if not len(self.keys):
            return out, found
        last = len(self.keys) - 1
        at = np.minimum(self.begins[(h >> self.shift).astype(np.int64)], last)
        left = None
        while True:
            key = self.keys[at]
            hit = key == h
            where = np.flatnonzero(hit) if left is None else left[hit]
            out[where], found[where] = self.scores[at[hit]], True
            on = ~hit & (key < h) & (at < last)
            if not on.any():
                return out, found
            left = np.flatnonzero(on) if left is None else left[on]
            at, h = at[on] + 1, h[on]


def _frequent(table: DataFrame, most: int) -> tuple[int, bool]:
    """The least class of frequency (64 classes for each doubling) whose n-grams and all more frequent ones are at most ``most``; whether any are left out."""
    rows = sorted(table.groupBy(_class().alias("class")).agg(F.count("*").alias("n")).collect(), reverse=True)
    total, least = 0, 1 << 30
    for r in rows:
        total += r.n
        if total > most:
            return least, True
        least = r["class"]
    return least, False


def _class() -> Column:
    return F.floor(F.log2("n") * 64).cast("int")


def _base(batch: pa.RecordBatch) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    buf, off = buffers(batch.column(batch.schema.get_field_index("body")))
    start, end, first = words(buf, off)

    def per_text(marks: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return upto[off[1:]] - upto[off[:-1]]

    n_words = np.diff(first)
    chars = per_text((buf & 0xC0 != 0x80) & ~IS_SPACE[buf])
    symbols = per_text(_SYMBOL[buf])
    raw, lines = buf.tobytes(), np.zeros(len(n_words), np.int64)
    for k in np.flatnonzero(per_text(buf == 10)).tolist():
        seen: set[bytes] = set()
        for line in raw[off[k] : off[k + 1]].split(b"\n"):
            if line.strip():
                lines[k] += line in seen
                seen.add(line)
    h, at = window_hashes(word_hashes(buf, start, end), first, 3)
    doc = np.searchsorted(first, at, "right") - 1
    _, back, n = np.unique(mix(h ^ mix(doc.astype(np.uint64))), return_inverse=True, return_counts=True)
    twice = at[n[back] > 1]
    marked = np.zeros(len(start) + 1, bool)
    for k in range(3):
        marked[twice + k] = True
    upto = np.concatenate([[0], np.cumsum(marked[:-1], dtype=np.int64)])
    return [n_words, chars, symbols, lines, upto[first[1:]] - upto[first[:-1]]]


def _rows(docs: DataFrame) -> DataFrame:
    """g (a hash of the language), doc_id, tie (a hash of the text; its last bit is the fold), body."""
    lang = F.col("lang").cast("string")
    return docs.select(F.xxhash64(lang.isNull(), F.coalesce(lang, F.lit(""))).alias("g"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), bytes_of("text").alias("body"))


_SCORED = "g long, doc_id long, tie long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long, log_p long"


def _scored(docs: DataFrame, most: int) -> DataFrame:
    """Base counts, number of scored code points and their summed scores, for each row."""
    names = [x.split()[0] for x in _SCORED.split(", ")]
    table = score_table(docs)
    least, more = _frequent(table, most)
    top = table.where(_class() >= least).drop("n").toArrow()
    held = docs.sparkSession.sparkContext.broadcast(Scores(*(top.column(k).to_numpy() for k in ("g", "fold", "high", "low", "score"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=_CHUNK):
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, _, _, h in _grams_of(batch):
                if len(h):
                    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                    scores, _ = held.value.find(h)
                    n[row[first]] += np.diff(np.append(first, len(row)))
                    total[row[first]] += np.add.reduceat(scores, first)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, _base(batch)), pa.array(n), pa.array(total)], names)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=_CHUNK):
            for row, high, low, h in _grams_of(batch):
                lost = np.flatnonzero(~held.value.find(h)[1])
                row, high, low, h = (x[lost] for x in (row, high, low, h))
                _, first, n = np.unique(mix(h ^ mix(row.astype(np.uint64))), return_index=True, return_counts=True)
                of = pa.array(row[first])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in range(3)), pa.array(high[first]), pa.array(low[first]), pa.array(n)], ["g", "doc_id", "tie", "high", "low", "times"])

    rows = _rows(docs)
    scored = rows.mapInArrow(run, _SCORED)
    if not more:
        return scored
    key = ["g", "doc_id", "tie"]
    scored = settled(scored)
    asked = rows.mapInArrow(rare, "g long, doc_id long, tie long, high long, low long, times long").withColumn("fold", F.col("tie").bitwiseAND(F.lit(1).cast("long")))
    sums = asked.join(table.where(_class() < least), ["g", "fold", "high", "low"]).groupBy(*key).agg(F.sum(F.col("times") * F.col("score")).alias("rest"))
    # rows alike in the key have each asked for the same
    alike = scored.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.count("*").alias("alike"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    owed = sums.join(alike, same).select(*[f"_{k}" for k in key], (F.col("rest") / F.col("alike")).cast("long").alias("rest"))
    return scored.join(owed, same, "left").select(*names[:-1], (F.col("log_p") + F.coalesce("rest", F.lit(0))).alias("log_p"))


def _bands(histogram: list, width: float, least: float) -> list[tuple[int, float, float]]:
    """Lower and upper log perplexity of each language, from rows (g, bucket, n)."""
    by: dict[int, list] = {}
    for r in histogram:
        by.setdefault(r.g, []).append((r.bucket, r.n))
    out = []
    for g, rows in sorted(by.items()):
        at, n = (np.array(x) for x in zip(*sorted(rows), strict=True))
        middle = at[np.searchsorted(np.cumsum(n), n.sum() / 2)]
        away, back = np.unique(np.abs(at - middle), return_inverse=True)
        spread = away[np.searchsorted(np.cumsum(np.bincount(back, n)), n.sum() / 2)]
        half = width * max(1.4826 * spread * STEP, least)
        out.append((g, float(middle * STEP - half), float(middle * STEP + half)))
    return out


def judge(docs: DataFrame, width: float = WIDTH, least: float = LEAST, model_rows: int = MODEL_ROWS) -> DataFrame:
    """(doc_id, tie, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity, lower, upper) for each row.

    Base rules: fewer than 50 words, or more than half of the words in windows of three that occur twice.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    log_perplexity = F.when(F.col("n_chars") > 0, -F.col("log_p") / SCALE / F.greatest("n_chars", F.lit(1))).otherwise(0.0)
    scored = settled(_scored(docs, model_rows).withColumn("base_failed", failed).withColumn("lp", log_perplexity))
    histogram = scored.where(~F.col("base_failed")).groupBy("g", F.round(F.col("lp") / STEP).cast("long").alias("bucket")).agg(F.count("*").alias("n")).collect()
    bands = docs.sparkSession.createDataFrame(_bands(histogram, width, least), "g long, low double, high double")
    judged = scored.join(F.broadcast(bands), "g", "left")
    kept = ~F.col("base_failed") & F.col("lp").between(F.col("low"), F.col("high"))
    return judged.select(
        "doc_id", "tie", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce(kept, F.lit(False)).alias("kept"), F.exp("lp").alias("perplexity"), F.exp("low").alias("lower"), F.exp("high").alias("upper"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept; all columns stay, whatever their names."""
    def kept(rows: DataFrame) -> DataFrame:
        good = judge(rows).where("kept").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), F.col("tie").alias("__tie")).distinct()
        keyed = rows.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), "__tie": F.xxhash64("text")})
        return keyed.join(good, ["__id", "__tie"], "left_semi")

    return privately(docs, {"doc_id", "text", "lang"}, kept)
