"""The corpus pipeline: five stages over ``documents``, each written and read again as the next one's input.

Quality rules drop documents, SimHash keeps one of each group of near-duplicates, personal
data becomes pseudonyms, sources are mixed to their weights, and what is left is packed
into sequences. Every stage works on all rows that it is given.

Rows, in every stage: all columns come out as they went in, whatever their names, but for what
the stage is there to change; an empty table gives an empty table. A null or wordless text
fails the base rules, so no later stage meets one unless it is given one: near-duplicates has
all such texts as one group, pseudonyms leaves them, the mixture takes none of their words (an
empty document is copied as often as its source's whole epochs say), and packing gives them
just the end id. Rows without a doc_id are told apart by their text. Rows alike in doc_id and
text are one document to near-duplicates, of which one stays; to all other stages each is a
row. Ties go to the smaller doc_id, then to the smaller hash of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfold.llm import idfiles, mixing, packing, pii, quality, simhash


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars as the text now is, 0 for none."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their language's perplexity band keep."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    return simhash.keep_one(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, personal numbers, dates and addresses as pseudonyms."""
    return _sized(pii.pseudonymise(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: weights 3, 1, 2 over the sources, half as many words again, at most two epochs."""
    return _sized(mixing.mixture(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("pseudonyms", pseudonyms), ("mixture", mix), ("packing", pack)]

#: SQL can't express a SimHash component, a keyed permutation or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each makes is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = idfiles.shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
