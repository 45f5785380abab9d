"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which driver and executors share; a session must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return root.rstrip("/")


def work_folder(spark: SparkSession) -> str:
    """A fresh folder in the shared one."""
    return f"{shared_folder(spark)}/quillstone-work-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Write a table and read it again: cuts lineage, survives lost executors, and fixes what a sampled partitioning decided."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove a kept table that no later plan reads."""
    jvm = df.sparkSession._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def ranked(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with their place (1, 2, ...) in a global order, without one task that sorts all.

    Range partitions are numbered each by itself and shifted by the rows of those before; the table of their sizes is one row a partition.
    """
    part = keep(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    inside = part.withColumn(name, F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = part.groupBy(F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = inside.join(sizes.select("__p", before.alias("__before")), F.col("__part") == F.col("__p"))
    return out.withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__p", "__before")
