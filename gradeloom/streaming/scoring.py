"""Score new generations as they arrive, each key once."""

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from gradeloom.operators.scoring import score_rows
from gradeloom.operators.summary import finish_summary, merge_partials, summary_partials
from gradeloom.schemas import KEY, RUN_LOG
from gradeloom.sources.files import Folder
from gradeloom.streaming.totals import add_batch, read_totals

_SINK = T.StructType([
    *RUN_LOG.fields, T.StructField("answer_raw", T.StringType()),
    T.StructField("query_id", T.StringType()), T.StructField("batch_id", T.LongType())])
_KEYS = T.StructType([f for f in RUN_LOG if f.name in KEY])
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def read_scores(spark: SparkSession, sink: str) -> DataFrame:
    """The rows scored so far."""
    return spark.read.schema(_SINK).parquet(sink)


def running_summary(spark: SparkSession, totals: str) -> DataFrame:
    """Summary of everything scored so far, from the merged totals of the batches."""
    return finish_summary(merge_partials(read_totals(spark, totals)))


def score_stream(rows: DataFrame, sink: str, checkpoint: str, totals: str | None = None,
                 trigger: dict | None = None) -> StreamingQuery:
    """Score a stream of raw generation rows into a Parquet log.

    Keys that were seen are held in Spark's state store, on disk and by key, so a batch reads its own rows
    and no part of the log; what it writes goes to a folder of its own, which a repeated batch replaces: a
    restart neither loses nor doubles a row. A query without a checkpoint takes the keys that the log has into its
    state first, once; a lost checkpoint therefore doubles nothing either. ``totals`` receives the sums of each
    batch for ``running_summary``. Of rows with one key one counts, no matter which; deliver a key with one text. ``trigger``
    holds the arguments of Spark's trigger; left out, the query takes what is there and ends.
    """
    spark, known = rows.sparkSession, f"{checkpoint.rstrip('/')}_known"

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        # Stays the same when the query restarts from its checkpoint.
        query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if query_id is None:
            raise RuntimeError("The id of the streaming query is not known.")
        fresh = batch.where("not _known").drop("_known")
        if batch_id == 0:
            # The state takes either row of a key that both the log and this batch have.
            fresh = fresh.join(batch.sparkSession.read.schema(_KEYS).parquet(known), KEY, "left_anti")
        place = f"{sink}/query_id={query_id}/batch_id={batch_id}"
        score_rows(fresh).write.mode("overwrite").partitionBy("dataset", "strategy").parquet(place)
        if totals:
            written = batch.sparkSession.read.schema(_SINK).parquet(place)
            add_batch(summary_partials(written), totals, query_id, batch_id)

    _create_folder(spark, sink)
    if not Folder(spark, checkpoint).names("offsets"):
        read_scores(spark, sink).select(*_KEYS.names).distinct().write.mode("overwrite").parquet(known)
    logged = spark.readStream.schema(_KEYS).option("ignoreMissingFiles", True).parquet(known)
    both = rows.withColumn("_known", F.lit(False)).unionByName(logged.withColumn("_known", F.lit(True)), allowMissingColumns=True)
    with _settings(spark, _STATE):
        return (both.dropDuplicates(KEY).writeStream.foreachBatch(score_batch)
                .option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"availableNow": True}))
                .start())


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Settings that a query takes with it when it starts; the session's own come back afterwards."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _create_folder(spark: SparkSession, sink: str) -> None:
    """Make the log readable before its first batch."""
    none = spark.createDataFrame([], _SINK)
    none.write.mode("append").partitionBy("query_id", "batch_id", "dataset", "strategy").parquet(sink)
