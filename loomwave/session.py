"""Session helpers: table access, the shared checkpoint folder, written intermediates and their removal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by spark.checkpoint.dir.

    Where none is named a session of one machine (a local master) takes a folder of its own that is deleted when it
    ends; on a cluster it is an error, as executors would each write to their own disk.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    conf = context.getConf()
    folder = conf.get("spark.checkpoint.dir")
    if not folder:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"{conf.get('spark.local.dir', '/tmp').split(',')[0]}/loomwave-{uuid.uuid4().hex}"
        _delete_on_exit(spark, folder)
    context.setCheckpointDir(folder)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


#: Tables written by this process and not yet released.
_written: list[str] = []


def materialised(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: cuts its lineage.

    The table lasts until release() or the end of the session.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    _delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the intermediates written so far; call it when the results that read them are stored. Their number."""
    context, n = spark.sparkContext, len(_written)
    while _written:
        path = context._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return n
