"""Helpers shared by the training-data operators: shared folder, written tables, graph components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: CRC-32 in DuckDB: the table's CTE (in a recursive WITH, for a FROM clause as `crc`), and the checksum of an ASCII text.
CRC_TABLE = """bits(i, v, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8)"""


def crc32_sql(text: str) -> str:
    return f"xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a new one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back, so a lost executor costs no recomputation."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete what save() wrote for df."""
    jvm = df.sparkSession._jvm
    for name in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have yet, compared without case."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

    Returns (node, root) for every node that has an edge to another node, root being the least node
    reachable; the root itself is left out. Minima are partial aggregates and the joins are ordinary
    shuffle joins that AQE splits when a hub is skewed; links never reach the driver.
    Each step is a written table. Rows with a null end are ignored.
    """
    e = save(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "edges",
    )
    before = _signature(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = save(star.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _signature(nxt)
        remove(e)
        e = nxt
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def positions(df: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """df, written, with pos (place from 0 within its tree by order, nulls first) and n (rows of the tree).

    tree must not be null. Rows are dealt by range of (tree, order), so a tree of any share of the rows spreads over
    tasks, and equal rows are dealt apart too; a row per task and tree adds up to the offsets.
    """
    at, mid, lo, before = fresh(df, "at", "mid", "lo", "before")
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    dealt = df.withColumn(at, F.monotonically_increasing_id()).repartitionByRange(*keys, F.col(at)).sortWithinPartitions(*keys, at).drop(at)
    rows = save(dealt.withColumn(mid, F.monotonically_increasing_id()), name)  # task number in the upper bits, row number below
    part = F.shiftright(mid, 33)
    runs = rows.groupBy(tree, part.alias(at)).agg(F.min(mid).alias(lo), F.count("*").alias("n"))
    of = Window.partitionBy(tree)
    first = F.coalesce(F.sum("n").over(of.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before)
    offsets = runs.select(tree, at, lo, first, F.sum("n").over(of).alias("n"))
    return rows.withColumn(at, part).join(offsets, [tree, at]).withColumn("pos", F.col(mid) - F.col(lo) + F.col(before)).drop(at, mid, lo, before)
