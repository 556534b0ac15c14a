"""Mixing sources to target weights: capped water-filling.

Every source gets a share of a word budget in proportion to its weight, clamped at
``max_epochs`` times its own size; what the clamp frees is dealt again by weight until no
source is above. A source's share is then met by seeded repetitions: whole ones for every
document, and for the fractional rest the documents with the smallest seeded hashes, of
which the last is taken in part, so that the source's words come to the rounded target.

Rows: a null text has size 0; a null source is a source of its own, the last. Rows alike in
doc_id and text share one seeded position: where the rest ends among such rows, each gets the
same number of words, so that at most one word less than there are such rows isn't taken. A source
of size 0 has target 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringfold.llm.shared import privately, settled

WORD = r"[^\x20\x09-\x0D]+"
#: Sources whose plans are broadcast, about 100 bytes each; beyond it rows are joined with them by a shuffle.
SOURCES = 100_000


def word_count(text: str | Column) -> Column:
    """Number of words of a text; 0 for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), budget: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Target words of each source. ``sizes``: (source, size), a row for each document.

    The clamp's fixed point is found without a loop. Sources are clamped in the order of
    size / weight; the water level over the others only rises, so the clamped ones are the
    longest run of that order whose ceilings lie below the level that they leave.
    The windows run over one row for each source, after the documents are summed.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int") + 1)
    ranked = by_source.select("source", "source_size", weight.alias("weight")).withColumn("ceiling", F.col("source_size") * F.lit(float(max_epochs)))
    upto = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    leveled = (
        ranked.withColumn("words", F.sum("source_size").over(every) * F.lit(float(budget)))
        .withColumn("heavy", F.sum("weight").over(every))
        .withColumn("level", (F.col("words") - (F.sum("ceiling").over(upto) - F.col("ceiling"))) / (F.col("heavy") - (F.sum("weight").over(upto) - F.col("weight"))))
        .withColumn("clamped", F.col("ceiling") <= F.col("level") * F.col("weight"))
        .withColumn("open", F.min(F.when(~F.col("clamped"), F.col("ceiling") / F.col("weight"))).over(every))
        .withColumn("free", F.col("open").isNotNull() & (F.col("ceiling") / F.col("weight") >= F.col("open")))
        .withColumn("rest", F.col("words") - F.sum(F.when(F.col("free"), 0.0).otherwise(F.col("ceiling"))).over(every))
        .withColumn("shares", F.sum(F.when(F.col("free"), F.col("weight")).otherwise(0.0)).over(every))
    )
    target = F.when(F.col("free"), F.least("ceiling", F.col("rest") * F.col("weight") / F.col("shares"))).otherwise(F.col("ceiling"))
    return leveled.select("source", "source_size", target.alias("target"))


def _spot(seed: int) -> Column:
    """A row's seeded position, 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("tie")), 1)


def plan(sized: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """(source, source_size, target, whole, cut, share), a row for each source: whole repetitions for every document, one more for those before the position ``cut``, and ``share`` words of each row that stands there.

    The fractional rest is cut off at an exact place without sorting a source in one task:
    words are summed over slices of the positions' range, the sums give the slice where the
    rest ends, and only that slice's positions are put in order.
    """
    goal = targets.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long").alias("whole"))
    goal = goal.withColumn("rest", (F.round("target") - F.col("whole") * F.col("source_size")).cast("long"))
    docs = sized.where("size > 0").select(F.col("source").alias("s"), "size", _spot(seed).alias("spot")).withColumn("slice", F.shiftright("spot", 51))
    by_slice = docs.groupBy("s", "slice").agg(F.sum("size").alias("words"))
    few = targets.count() <= SOURCES

    def small(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if few else rows

    upto = Window.partitionBy("s").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        by_slice.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
        .join(small(goal.select(F.col("source").alias("t"), "rest")), F.col("s").eqNullSafe(F.col("t")))
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
        .select(F.col("s").alias("t"), F.col("slice").alias("edge"), (F.col("rest") - F.col("before")).alias("left"))
    )
    inside = docs.join(small(edges), F.col("s").eqNullSafe(F.col("t")) & (F.col("slice") == F.col("edge")))
    places = inside.groupBy("s", "spot").agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.min("left").alias("left"))
    within = Window.partitionBy("s").orderBy("spot").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        places.withColumn("owed", F.col("left") - F.coalesce(F.sum("words").over(within), F.lit(0)))
        .where((F.col("owed") >= 0) & (F.col("owed") < F.col("words")))
        .select(F.col("s").alias("t"), F.col("spot").alias("cut"), F.floor(F.col("owed") / F.col("rows")).cast("long").alias("share"))
    )
    return goal.join(small(cuts), F.col("source").eqNullSafe(F.col("t")), "left").select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit(0)).alias("cut"), F.coalesce("share", F.lit(0)).alias("share"))


def taken_words(sized: DataFrame, plans: DataFrame, seed: int = 17, parts: bool = False) -> DataFrame:
    """Adds source_size, target and taken. ``sized``: (doc_id, source, size, tie), any further columns stay; ``plans`` as ``plan`` makes them.

    With ``parts``, __whole (whole repetitions) and __extra (words beyond them) stay too. A
    row's share follows from its own source's plan, so rows are never moved.
    """
    at = plans.select(F.col("source").alias("__s"), "source_size", "target", F.col("whole").alias("__whole"), F.col("cut").alias("__cut"), F.col("share").alias("__share"))
    few = plans.count() <= SOURCES
    joined = sized.withColumn("__spot", _spot(seed)).join(F.broadcast(at) if few else at, F.col("source").eqNullSafe(F.col("__s")))
    extra = F.when(F.col("__spot") < F.col("__cut"), F.col("size")).when(F.col("__spot") == F.col("__cut"), F.least("__share", "size")).otherwise(0)
    done = joined.withColumn("__extra", extra).withColumn("taken", (F.col("__whole") * F.col("size") + F.col("__extra")).cast("long"))
    return done.drop("__s", "__spot", "__cut", "__share", *([] if parts else ["__whole", "__extra"]))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, tie) of each row, read and counted once; without texts."""
    return settled(docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("text").alias("tie")))


def _mixed(docs: DataFrame, seed: int = 17, **goal) -> DataFrame:
    """Every document as often as it is taken; one taken in part has its first words, joined by one space."""
    names, sized = docs.columns, sizes(docs)
    plans = settled(plan(sized, source_targets(sized, **goal), seed))
    taken = taken_words(docs.withColumns({"size": word_count("text"), "tie": F.xxhash64("text")}), plans, seed, parts=True)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    times = (F.col("__whole") + F.when((F.col("__extra") >= F.col("size")) & (F.col("size") > 0), 1).otherwise(0)).cast("int")
    part = F.when((F.col("__extra") > 0) & (F.col("__extra") < F.col("size")), F.array(F.array_join(F.slice(words, 1, F.col("__extra").cast("int")), " "))).otherwise(F.array().cast("array<string>"))
    copies = taken.withColumn("text", F.explode(F.concat(F.array_repeat("text", times), part)))
    return copies.select(*names)


def mixture(docs: DataFrame, seed: int = 17, **goal) -> DataFrame:
    """The mixture itself, with the columns of docs; further columns go through under private names, so that none clashes with the mixture's own."""
    return privately(docs, {"doc_id", "text", "source"}, lambda hidden: _mixed(hidden, seed, **goal))
