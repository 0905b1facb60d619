"""Question datasets."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.operators.samples import with_row_position, with_text_position
from gradeloom.schemas import SAMPLES

_ANSWER_TYPES = {"gsm8k": "string", "strategyqa": "boolean"}


def read_dataset(spark: SparkSession, dataset: str, path: str, fmt: str = "parquet",
                 index: str | None = None) -> DataFrame:
    """One dataset with columns ``question`` and ``answer`` as a samples table.

    ``index`` names a column that numbers the rows from 0. Without it rows are numbered by their position in the
    files, which count in the order of their paths. CSV files may have line ends within quotes and are
    read whole; JSON files have a record a line and are split.
    """
    if fmt == "parquet":
        raw = spark.read.parquet(path)
    else:
        number = f", {index} long" if index else ""
        schema = f"question string, answer {_ANSWER_TYPES[dataset]}{number}"
        reader = spark.read.schema(schema)
        if fmt == "csv":
            reader = reader.options(header=True, multiLine=True, quote='"', escape='"')
        raw = reader.format(fmt).load(path)
    if index:
        placed = raw.withColumn("sample_idx", F.col(index).cast("long"))
    elif fmt == "parquet":
        placed = with_row_position(raw)
    else:
        placed = with_text_position(raw)
    return placed.select(
        F.lit(dataset).alias("dataset"), F.col("sample_idx").cast("long").alias("sample_idx"), "question",
        F.col("answer").cast("string").alias("answer_raw"))


def read_samples(spark: SparkSession, numeric_path: str, boolean_path: str, fmt: str = "parquet",
                 index: str | None = None) -> DataFrame:
    """Both datasets in one samples table."""
    return (read_dataset(spark, "gsm8k", numeric_path, fmt, index)
            .unionByName(read_dataset(spark, "strategyqa", boolean_path, fmt, index))
            .select(*SAMPLES.names))
