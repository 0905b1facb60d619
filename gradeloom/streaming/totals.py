"""Running totals of a stream: one small table per batch, merged level by level.

A table of level k covers ``FAN`` ** k batches; it is written by the batch that completes them, from ``FAN`` tables of the level
below. So all batches are read from at most ``FAN`` - 1 tables a level, and every total is rewritten once a level. Which batches a table
covers follows from the batch number alone: a batch that is repeated writes the same tables again.
"""

from pyspark.sql import DataFrame, SparkSession

from gradeloom.operators.summary import merge_partials, summary_partials
from gradeloom.schemas import RUN_LOG
from gradeloom.sources.files import Folder

FAN = 8


def _table(query_id: str, level: int, first: int) -> str:
    return f"query_id={query_id}/level={level}/first={first}"


def _complete(files: Folder, query_id: str, level: int) -> list[int]:
    """First batches of the tables of a level whose writing has ended."""
    names = files.names(f"query_id={query_id}/level={level}")
    found = sorted(int(n.partition("=")[2]) for n in names if n.startswith("first="))
    return [first for first in found if files.exists(f"{_table(query_id, level, first)}/_SUCCESS")]


def add_batch(partials: DataFrame, totals: str, query_id: str, batch_id: int, fan: int = FAN) -> None:
    """Write the totals of a batch, and merge what it completes.

    What was merged stays until the next tables of its level are merged, for readers that have chosen it already.
    """
    spark, files, level, size = partials.sparkSession, Folder(partials.sparkSession, totals), 0, 1
    partials.write.mode("overwrite").parquet(f"{totals}/{_table(query_id, 0, batch_id)}")
    while (batch_id + 1) % (size * fan) == 0:
        first = batch_id + 1 - size * fan
        parts = _complete(files, query_id, level)
        merged = [f"{totals}/{_table(query_id, level, f)}" for f in parts if f >= first]
        merge_partials(spark.read.schema(partials.schema).parquet(*merged)).coalesce(1).write.mode("overwrite").parquet(
            f"{totals}/{_table(query_id, level + 1, first)}")
        for old in (f for f in parts if f < first):
            files.delete(_table(query_id, level, old))
        level, size = level + 1, size * fan


def chosen_tables(spark: SparkSession, totals: str, fan: int = FAN) -> list[str]:
    """The fewest tables that hold each batch once."""
    files, found = Folder(spark, totals), []
    for name in files.names():
        query_id = name.partition("=")[2]
        levels = sorted((int(n.partition("=")[2]) for n in files.names(name) if n.startswith("level=")), reverse=True)
        covered: list[range] = []
        for level in levels:
            for first in _complete(files, query_id, level):
                if not any(first in batches for batches in covered):
                    covered.append(range(first, first + fan ** level))
                    found.append(f"{totals}/{_table(query_id, level, first)}")
    return found


def read_totals(spark: SparkSession, totals: str, fan: int = FAN) -> DataFrame:
    """Totals of all batches so far, to be merged by ``merge_partials``."""
    schema = summary_partials(spark.createDataFrame([], RUN_LOG)).schema
    tables = chosen_tables(spark, totals, fan)
    return spark.read.schema(schema).parquet(*tables) if tables else spark.createDataFrame([], schema)
