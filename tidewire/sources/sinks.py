"""Sinks: idempotent writes, and intermediate tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the folder that executors and driver share (spark.checkpoint.dir) and read again: cuts lineage.

    Where that is unset, a new temporary folder serves in local mode only.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def insert_new(existing: DataFrame, new: DataFrame, key: list[str], prefer: list[str] | None = None) -> DataFrame:
    """Rows of new whose key is not in existing, one a key (the first by `prefer`, else by all columns)."""
    order = [F.col(c) for c in (prefer or new.columns)]
    first = new.withColumn("rn_", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("rn_ = 1").drop("rn_")
    return first.join(existing.select(*key), key, "left_anti").select(new.columns)


def upsert(existing: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """existing with the rows of new put in place of those of the same key; of several, the largest version stays."""
    rest = [c for c in existing.columns if c not in key]
    both = existing.withColumn("gen_", F.lit(0)).unionByName(new.select(existing.columns).withColumn("gen_", F.lit(1)))
    best = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("gen_", version)).alias("r_"))
    return best.select(*key, "r_.*").select(existing.columns)


MANY = 5_000  #: partitions that a batch's rows may name as a filter; a batch that touches more reads the table


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def touched(path: str, new: DataFrame, by: str) -> DataFrame:
    """The stored rows of the partitions that rows of new belong to: the partitions' values, counted, are a filter of the scan."""
    stored = new.sparkSession.read.parquet(path)
    values = [r[0] for r in new.select(by).distinct().limit(MANY + 1).collect()]
    if len(values) > MANY:
        return stored
    hit = F.col(by).isin([v for v in values if v is not None])
    return stored.where(hit | F.col(by).isNull() if None in values else hit)


def insert_into(path: str, new: DataFrame, key: list[str], by: str, prefer: list[str] | None = None) -> None:
    """insert_new on a Parquet table in folders of its column `by`: only the folders that new touches are read, and rows are
    appended, one file a folder. Running a batch again adds nothing. A key must not move between folders."""
    new = written(new, "batch")
    if not _exists(new.sparkSession, path):
        fresh = insert_new(new.limit(0), new, key, prefer)
    else:
        fresh = insert_new(touched(path, new, by).select(new.columns), new, key, prefer)
    append_partitioned(fresh, path, [by])


def upsert_into(path: str, new: DataFrame, key: list[str], version: str, by: str) -> None:
    """upsert on a Parquet table in folders of its column `by`: the folders that new touches are read and replaced as wholes,
    the others stay untouched. Running a batch again changes nothing. A key must not move between folders."""
    new = written(new, "batch")
    if _exists(new.sparkSession, path):
        whole = written(upsert(touched(path, new, by).select(new.columns), new, key, version), "merged")  # before its source is replaced
    else:
        whole = upsert(new.limit(0), new, key, version)
    whole.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def batches(path: str) -> Callable[[DataFrame, int], None]:
    """A sink of a stream's micro-batches: each batch's rows replace those of its number, so a batch run again counts once."""
    return lambda df, number: df.write.mode("overwrite").parquet(f"{path}/batch={number}")


def append_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Append to a Parquet table dealt by its partition columns, so that a folder gets few files."""
    df.repartition(*by).write.mode("append").partitionBy(*by).parquet(path)
