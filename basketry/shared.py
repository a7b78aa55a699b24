"""Tables written in the folder that driver and executors share, which end the lineage of what they hold."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only on one machine, where no shared folder is set.
_own = ""


def root_dir(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``; it goes when the driver's JVM ends.

    What a killed driver leaves has its application's id for a name. Where that setting is missing, a
    temporary folder serves a local master (tests on one machine); on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        global _own
        root = _own = _own or "file://" + tempfile.mkdtemp(prefix="basketry-")
    if "://" not in root and root.startswith("/") and not root.startswith("//"):
        local = spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        root = "file://" + root if local.startswith("file:") else root
    out = f"{root.rstrip('/')}/basketry-{spark.sparkContext.applicationId}"
    fs, path = _path(spark, out)
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return out


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def shared_dir(spark: SparkSession) -> str:
    """A new folder in this application's one."""
    out = f"{root_dir(spark)}/{uuid.uuid4().hex}"
    fs, path = _path(spark, out)
    fs.mkdirs(path)
    return out


def saved(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage ends here."""
    out = shared_dir(df.sparkSession) + "/t"
    df.write.option("compression", codec).parquet(out)
    back = df.sparkSession.read.schema(df.schema).parquet(out)
    back._written_to = out
    return back


def forget(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``saved`` gave, when nothing reads them any more."""
    for df in tables:
        if out := getattr(df, "_written_to", None):
            fs, path = _path(df.sparkSession, out)
            fs.delete(path.getParent(), True)


def sweep(spark: SparkSession) -> None:
    """Deletes all that this application has written so far: results that weren't stored elsewhere are lost."""
    fs, path = _path(spark, root_dir(spark))
    fs.delete(path, True)
