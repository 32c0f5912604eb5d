"""Cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The folder of an application on one machine whose session names none, as in tests.
_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names.

    An application on one machine that names none gets a folder of its own; on a cluster that is an error, as other
    machines would not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        number = spark.sparkContext.applicationId
        named = _OWN[number] = _OWN.get(number) or tempfile.mkdtemp(prefix="spark-")
    return named


def tables(spark: SparkSession) -> str:
    """Where the tables of this application are written."""
    return f"{folder(spark)}/tables/{spark.sparkContext.applicationId}"


def checkpoint(df: DataFrame, **options: str) -> DataFrame:
    """df written to a new table in the shared folder, and read back: its rows are computed once."""
    path = f"{tables(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes the tables that this application has written; results that still read them have to be saved before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(tables(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
