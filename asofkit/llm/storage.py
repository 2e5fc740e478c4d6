"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir of the session; where that is unset, below the warehouse, which a cluster shares too."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    base = base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/asofkit-intermediate"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table: lineage ends there, and lost executors cost no rework."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table from written() that nothing will read again."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        own = path(folder)
        own.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(own, True)
