"""Helpers of the operators: given tables, scratch tables and typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackwork.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's setting to remove the shuffle files of an execution when it ends, not when the driver collects garbage.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the folder all executors share and read it back.

    Cuts the lineage: a lost executor costs its running tasks, not the work behind the table. Nothing
    reads the shuffle files of the write again, so they go with it.
    """
    path = scratch_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP_SETTING, None)
    conf.set(CLEANUP_SETTING, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        conf.unset(CLEANUP_SETTING) if before is None else conf.set(CLEANUP_SETTING, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a scratch table whose successors are written; nothing may read ``df`` again."""
    files = df.inputFiles()
    if files:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(conf).delete(folder, True)


BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, which goes to Python in batches of about a MB and not of so many rows, however long.

    The setting is the session's and is made only where it has none.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def kind(df: DataFrame, column: str) -> str:
    """SQL type of a column."""
    return df.schema[column].dataType.simpleString()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name
