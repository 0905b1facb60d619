"""Keys of a log in buckets, so that resuming moves only the grid and never the log.

The index is a bucketed, sorted table of the log's distinct keys. A join on the key reads bucket by bucket, without an
exchange of the index, however long the log has become. The session's catalog only holds the table's description; the data and
the number of buckets lie in the given folder.
"""

from pyspark.sql import DataFrame, SparkSession

from gradeloom.operators.resume import done_keys
from gradeloom.schemas import KEY
from gradeloom.sources.files import Folder

_MARK = "_buckets"


def write_key_index(log: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Write the distinct keys of a log (rows without a condition count as legacy) as the table ``name`` in ``path``.

    Take as many buckets as a join of the log would have shuffle partitions: it cannot be changed later.
    """
    spark = log.sparkSession
    keys = done_keys(log).repartition(buckets, *KEY)  # one file a bucket
    keys.write.bucketBy(buckets, *KEY).sortBy(*KEY).option("path", path).mode("errorifexists").saveAsTable(name)
    Folder(spark, path).create(_MARK, str(buckets))
    return spark.table(name)


def open_key_index(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The index in ``path``, also in a session that has not written it."""
    if not spark.catalog.tableExists(name):
        columns, buckets = ", ".join(KEY), int(Folder(spark, path).read(_MARK))
        spark.sql(f"""
            create table {name} (dataset string, strategy string, sample_idx bigint, condition string) using parquet
            options (path '{path}') clustered by ({columns}) sorted by ({columns}) into {buckets} buckets""")
    return spark.table(name)


def extend_key_index(log: DataFrame, name: str, path: str) -> DataFrame:
    """Add the keys of further log rows; those that the index has already are left out."""
    spark = log.sparkSession
    index, buckets = open_key_index(spark, name, path), int(Folder(spark, path).read(_MARK))
    fresh = pending_by_index(done_keys(log), index).repartition(buckets, *KEY)
    fresh.write.bucketBy(buckets, *KEY).sortBy(*KEY).option("path", path).mode("append").saveAsTable(name)
    return spark.table(name)


def pending_by_index(grid: DataFrame, index: DataFrame) -> DataFrame:
    """Grid rows whose key is not in the index: the grid is shuffled to the index's buckets, the index stays where it is."""
    return grid.join(index.hint("merge"), KEY, "left_anti")
