"""Tables written once in the folder that all executors share, and their removal."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SET = "spark.checkpoint.dir"


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """The folder of this session below ``spark.checkpoint.dir``; it goes when the session's JVM ends.

    Where the setting is missing, a session on one machine (master ``local``) gets a
    temporary folder of its own; on a cluster that is an error, as executors wouldn't see it.
    """
    context = spark.sparkContext
    root = context.getConf().get(_SET, None) or spark.conf.get(_SET, None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError(f"{_SET} must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tagloom-")
        spark.conf.set(_SET, root)
    folder = f"{root.rstrip('/')}/tagloom-{context.applicationId}"
    path, fs = _path(spark, folder)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def new_path(spark: SparkSession, name: str = "table") -> str:
    """A path that nothing else uses, in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, hashes: bool = False) -> DataFrame:
    """``df`` written once to the shared folder; later uses read it and survive lost executors.

    ``hashes``: it holds hashes or the like, for which no dictionary is tried.
    """
    path = new_path(df.sparkSession)
    df.write.options(**({"parquet.enable.dictionary": "false"} if hashes else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Removes all tables that :func:`cut` wrote in this session; call it once their results are stored."""
    path, fs = _path(spark, shared_folder(spark))
    fs.delete(path, True)
