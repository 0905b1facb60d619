"""Question tables: row positions, prefixes, normalised gold."""

from pyspark.sql import DataFrame, Window, functions as F

from gradeloom.functions.extract import gold_answer, gold_text


def with_row_position(df: DataFrame, column: str = "sample_idx") -> DataFrame:
    """Number the rows of a Parquet scan by their place in the files, from 0.

    Files count in the order of their paths, rows by their index in the file, so
    no row is sorted or shuffled: only one count per file is gathered, and the
    running total over those counts is the first position of each file. These are
    broadcast, as a join by shuffle would send all rows of a file to one task.
    """
    placed = df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_row", F.col("_metadata.row_index"))
    sizes = df.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return (placed.join(F.broadcast(starts), "_file")
            .withColumn(column, F.col("_start") + F.col("_row"))
            .drop("_file", "_row", "_start"))


def with_text_position(df: DataFrame, column: str = "sample_idx") -> DataFrame:
    """Number the rows of a scan of text files (JSON lines, CSV) by their place in the files, from 0.

    Files count in the order of their paths. A scan reads the blocks of a file in any order, but the rows of a block as they stand: each
    gets a number that rises within its block. One row per block is gathered, with how many rows the block has, and the running
    total over them is the position of a block's first row. These are broadcast: rows themselves are neither sorted nor shuffled.
    """
    names = df.columns
    placed = df.select(
        *names, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"))
    # The hash makes this scan parse the same columns as the other one, so that both see the same rows.
    blocks = placed.groupBy("_file", "_block").agg(
        F.count("*").alias("_rows"), F.min("_at").alias("_first"), F.bit_xor(F.xxhash64(*names)).alias("_hash"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.where(F.col("_hash").isNotNull()).select(
        "_file", "_block", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return (placed.join(F.broadcast(starts), ["_file", "_block"])
            .withColumn(column, F.col("_start") + F.col("_at") - F.col("_first"))
            .select(*names, column))


def first_n(samples: DataFrame, n: int | None) -> DataFrame:
    """The first n samples of each dataset; all of them for None."""
    return samples if n is None else samples.where(F.col("sample_idx") < n)


def with_gold(samples: DataFrame) -> DataFrame:
    """Add the normalised gold answer and the reference text of the overlap metrics."""
    return (samples
            .withColumn("gold_answer", gold_answer(F.col("answer_raw"), F.col("dataset")))
            .withColumn("gold_text", gold_text(F.col("answer_raw"), F.col("gold_answer"), F.col("dataset"))))
