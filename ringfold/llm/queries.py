"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfold.llm import idfiles, langid, licenses, mixing, packing, pii, quality, repeats, simhash, topk


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 3, 1, 2 and 150 % of all words, at most two epochs of each."""
    sized = mixing.sizes(_documents(spark, sf_dir))
    mixed = mixing.taken_words(sized, mixing.settled(mixing.plan(sized, mixing.source_targets(sized))))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms, and the kinds and places of what they stand for."""
    made = pii.pseudonymise(_documents(spark, sf_dir).select("doc_id", "text"), found="found")
    return made.select("doc_id", "text", F.size("found").cast("long").alias("n_found"), F.to_json("found").alias("found"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector with all others."""
    vectors = topk.integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.top_k(vectors, F.col("id") % 100 == 0)


def op2_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document, and whether the base rules and its language's perplexity band keep it."""
    judged = quality.judge(_documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity", "lower", "upper")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those whose crc32 of the id, modulo 4, is not 2."""
    docs = _documents(spark, sf_dir)
    found = langid.identify(docs, langid.train(docs, langid.learnable()))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of twenty words or more that start earlier."""
    found = repeats.remove_repeats(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op6_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum in the files of coded token ids, as read back from them."""
    path = idfiles.shared_path(spark, "ids")
    idfiles.write_ids(_documents(spark, sf_dir), path)
    ids = idfiles.read_ids(spark, path)
    return ids.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence that each document is as a whole, and the notices among its lines."""
    return licenses.scan(_documents(spark, sf_dir))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of at most 4096 tokens."""
    return packing.pack(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pseudonyms": op1_pseudonyms,
    "op3_topk": op3_topk,
    "op2_perplexity": op2_perplexity,
    "op4_language": op4_language,
    "op5_repeats": op5_repeats,
    "op6_id_files": op6_id_files,
    "op7_licenses": op7_licenses,
    "op8_pack": op8_pack,
    "op9_mix_sources": op9_mix_sources,
    "op10_simhash": op10_simhash,
}

ORACLES: dict[str, str] = {
    "op7_licenses": licenses.oracle(),
    "op3_topk": """
        WITH whole AS (
            SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
}
