"""From raw documents to token records: quality, near-duplicates, benchmark leaks, source mix, ids.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame. All but the last keep the columns of documents, and others of any name.
All take nulls in any column, empty and very long texts, repeated rows and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeloom.llm import decontaminate, mixing, quality, records, sigtree
from gradeloom.llm.shared import bounded_batches, documents, stored
from gradeloom.llm.tokens import SMALL


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, does not reject.

    A null text is scored as an empty one, repeated rows stay or go together; without labels all score 0.5 and stay.
    """
    bounded_batches(spark)
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 80 % of their five-word shingles, the one with the smallest id.

    Of repeated rows one stays; a null id is the largest. Texts without words are like nothing and all stay.
    """
    bounded_batches(spark)
    return sigtree.drop_similar(docs, size=5, percent=80)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null and empty texts stay, repeated rows stay or go together."""
    bounded_batches(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' words in the amounts that their sources are to have.

    Documents without words, or of which no block is taken, go; repeated rows are mixed each on its own; a null source is a source.
    """
    bounded_batches(spark)
    return mixing.mixed_documents(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Records of token ids, written and read back: doc_id, start, n_tokens, ids_crc32.

    Null ids come first, rows with one id in order of text; repeated rows are records of their own.
    """
    bounded_batches(spark)
    return records.token_records(docs, sizes=SMALL)


STAGES = [("quality classifier", good_quality), ("n-gram Jaccard join", one_of_each), ("benchmark decontamination", without_leaks),
          ("mixing sources to target weights", mixed), ("token-ID / binary output", token_records)]

#: Training, similarity joins and byte-pair encoding are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; what each gives is written as Parquet to the shared folder and read as the next one's input."""
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs, f"stage-{number}")
    return docs
