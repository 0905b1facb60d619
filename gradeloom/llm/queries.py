"""One query per operator over its whole table.

What an operator does with nulls, ties, repeated rows and empty tables stands at the function that the query calls; a table of documents
with one row per doc_id, as given, needs none of it.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, mixing, negatives, oddsketch, pii, quality, records, repair, sharding, sigtree, simhash, suffix, tokens
from .shared import documents
from .sql import ORACLES  # noqa: F401


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids per document, found by the separator scan; a null text has none."""
    return tokens.token_counts(documents(spark, sf_dir))


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record, read back from the record files; a null text has the end id alone."""
    return records.token_records(documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that occurs in it; null texts and items occur nowhere."""
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with what was removed of it and the text that remains; a null text counts as empty.

    Repeats are judged in bytes: where a cut falls inside a character, text shows U+FFFD, while the digest is of the bytes.
    """
    found = suffix.remove_repeats(documents(spark, sf_dir))
    return found.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with the words that the mix takes of it; a null source is the last one."""
    return mixing.mixed_counts(documents(spark, sf_dir))


def op6_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its shard and slot; a null text is empty."""
    return sharding.shard_documents(documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its fingerprint, that of its edited text and the number of near ones."""
    return simhash.document_fingerprints(documents(spark, sf_dir))


def op8_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its component; documents without words are linked with nothing."""
    return sigtree.jaccard_components(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its score; a null text is scored as an empty one."""
    docs = documents(spark, sf_dir)
    return quality.score_documents(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its personal data; a null text has none."""
    return pii.personal_data(documents(spark, sf_dir))


def op11_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its group of near copies."""
    return oddsketch.near_duplicates(documents(spark, sf_dir))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation: what is wrong with it once it is damaged, the cheapest repair and a digest of the result."""
    return repair.repair(repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per anchor, positive and hard negative; all rows of embeddings are candidates."""
    return negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_token_records, op3_decontamination, op4_suffix_dedup, op5_mixing, op6_jump_sharding, op7_simhash,
    op8_signature_trees, op9_quality, op10_pii, op11_odd_sketches,
    op12_conversation_repair, op13_hard_negatives)}
