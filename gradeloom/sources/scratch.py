"""Where intermediate tables go."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from gradeloom.sources.files import Folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own folder below the shared one named in ``spark.checkpoint.dir``.

    A local session without the setting uses a new temporary folder, which goes
    when the process ends; elsewhere the setting is required, as tasks on other
    machines must see the folder.
    """
    root = _root(spark)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
        root = tempfile.mkdtemp(prefix="gradeloom-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _root(spark: SparkSession) -> str | None:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/')}/gradeloom-{spark.sparkContext.applicationId}" if shared else None


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once nothing is to be read from its results any more."""
    root = _root(spark)
    if root:
        Folder(spark, root).delete()


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The table written to the shared folder and read back, for what is used more than once; a read of some values of ``by`` leaves the others out."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
