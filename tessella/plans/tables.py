"""Intermediate tables in the shared folder, which cut a plan's lineage and survive lost executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}


def shared_base(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or else the one that the context was given. Only in local mode without either, as in
    tests, a temporary one, which goes when the program ends; elsewhere its lack is an error, as machines share no local folder."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or _OWN.get(context.applicationId)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        own = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = _OWN[context.applicationId] = f"file://{own}"
    return path.rstrip("/")


def shared_folder(spark: SparkSession, name: str = "tables") -> str:
    """A fresh folder below the shared one."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this library's tables in whatever file system it is; nothing happens if it isn't there."""
    if not path.startswith(shared_base(spark) + "/"):
        raise ValueError(f"{path} isn't below the shared folder")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def keep(df: DataFrame) -> DataFrame:
    """The same rows, written once and read again."""
    path, schema = shared_folder(df.sparkSession), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
