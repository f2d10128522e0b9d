"""Ranks, correlations and scores of forecasts, as distributed aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import written


def avg_rank(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """df with the average rank (ties share) of value within the groups `by`, counted from 1.

    Within groups: a window. Over the whole table: counts of each distinct value, ranked by a prefix sum over range
    partitions of the values, so that no single task sees all rows.
    """
    if by:
        w = Window.partitionBy(*by).orderBy(value)
        same = Window.partitionBy(*by, value)
        return df.withColumn(out, F.rank().over(w) + (F.count("*").over(same) - 1) / 2.0)
    ranks = prefix_counts(df.groupBy(F.col(value).alias("v_")).agg(F.count("*").alias("c_")), "v_", ["c_"])
    ranks = ranks.select("v_", (F.col("c__before") + (F.col("c_") + 1) / 2.0).alias(out))
    return df.join(ranks, F.col(value) == F.col("v_")).drop("v_")


def prefix_counts(values: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """values with <col>_before: the sum of col over all smaller keys. Distinct keys are dealt by range and written, so
    that the ranges stay the same; a task sums its own, and a row for each partition carries the offsets."""
    dealt = written(values.repartitionByRange(key).withColumn("part_", F.spark_partition_id()), "ranges")
    inner = Window.partitionBy("part_").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(c + "_in") for c in cols])
    sums = dealt.groupBy("part_").agg(*[F.sum(c).alias(c + "_sum") for c in cols])
    outer = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part_", *[F.coalesce(F.sum(c + "_sum").over(outer), F.lit(0)).alias(c + "_off") for c in cols])
    got = local.join(F.broadcast(offsets), "part_")  # a row a partition
    return got.select(*values.columns, *[(F.col(c + "_in") + F.col(c + "_off")).alias(c + "_before") for c in cols])


def row_index(df: DataFrame, order: list, out: str = "k_") -> DataFrame:
    """df with the place of each row in the order of all rows, from 0; ties stand in any order. Rows are dealt by range and
    written, a task numbers its own, and a row for each partition carries the offsets."""
    dealt = written(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "ranges")
    outer = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("part_").agg(F.count("*").alias("n_")).select("part_", F.coalesce(F.sum("n_").over(outer), F.lit(0)).alias("off_"))
    at = F.row_number().over(Window.partitionBy("part_").orderBy(*order)) - 1
    return dealt.withColumn(out, at).join(F.broadcast(offsets), "part_").withColumn(out, F.col(out) + F.col("off_")).drop("part_", "off_")  # a row a partition


def running_order(df: DataFrame, key: str, order: str, value: str, at: dict) -> DataFrame:
    """df with n, the number of values of `key` up to a row in `order` (a total order within the key), and for each name of `at` the value
    that stands at the index at[name](n), from 0, when these n are sorted. Values must not be null.

    A search by digits of rank, sixteen ways at a time: the rows of a key are ranked by value once; at each step running counts of
    the next digit among the rows that share the digits so far say which digit the wanted row has. That is one window
    over rows and questions a digit (three for histories up to 4 096), all in one partitioning by key.
    """
    rows = df.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    rows = rows.withColumn("r_", F.row_number().over(Window.partitionBy(key).orderBy(value, "n")) - 1)
    rows = written(rows, "ranked")
    most = rows.agg(F.max("n")).first()[0] or 1
    digits = max(1, -(-(most - 1).bit_length() // 4))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("q_"), f(F.col("n")).cast("int").alias("k_")) for name, f in at.items()])).alias("x_")
    none = F.lit(None)
    both = rows.select(key, "n", F.lit(0).alias("o_"), "r_", F.col(value).alias("v_"), none.cast("string").alias("q_"), none.cast("int").alias("k_")).unionByName(
        rows.select(key, "n", asked).select(key, "n", F.lit(1).alias("o_"), none.cast("int").alias("r_"), none.cast(dict(df.dtypes)[value]).alias("v_"), "x_.q_", "x_.k_"))
    both = both.repartition(key).withColumn("node_", F.lit(0))
    for step in range(digits):
        digit = F.shiftright("r_", 4 * (digits - 1 - step)).bitwiseAND(15)
        w = Window.partitionBy(key, "node_").orderBy("n", "o_").rowsBetween(Window.unboundedPreceding, 0)
        upto = F.array(*[F.count(F.when(digit <= d, 1)).over(w) for d in range(16)])  # rows so far whose digit is at most d
        both = both.withColumn("c_", upto).withColumn("d_", F.when(F.col("o_") == 0, digit).otherwise(F.size(F.filter("c_", lambda c: c <= F.col("k_")))))
        below = F.when((F.col("o_") == 1) & (F.col("d_") > 0), F.element_at("c_", F.greatest(F.col("d_"), F.lit(1))).cast("int")).otherwise(0)
        both = both.withColumn("k_", F.col("k_") - below).withColumn("node_", F.col("node_") * 16 + F.col("d_")).drop("c_", "d_")
    found = both.withColumn("v_", F.max("v_").over(Window.partitionBy(key, "node_"))).where("o_ = 1")
    wide = found.groupBy(key, "n").agg(*[F.max(F.when(F.col("q_") == name, F.col("v_"))).alias(name) for name in at])
    return rows.drop("r_").join(wide, [key, "n"])


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None, least: int = 3) -> DataFrame:
    """Rank correlation with tied ranks averaged: (by..., ic, n); ic null under `least` rows or without variance."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = avg_rank(avg_rank(rows, x, "rx_", by), y, "ry_", by)
    spread = F.nullif(F.stddev_pop("rx_") * F.stddev_pop("ry_"), F.lit(0.0))
    ic = F.when(F.count("*") >= least, F.try_divide(F.covar_pop("rx_", "ry_"), spread)).alias("ic")
    return (r.groupBy(*by) if by else r.groupBy()).agg(ic, F.count("*").alias("n"))


def auc(df: DataFrame, p: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Mann-Whitney AUC with the Hanley-McNeil 95 % interval: (by..., n_pos, n_neg, auc, lo, hi)."""
    r = avg_rank(df, p, "r_", by)
    a = (r.groupBy(*by) if by else r.groupBy()).agg(
        F.sum(F.when(F.col(y) > 0.5, F.col("r_"))).alias("s"), F.count_if(F.col(y) > 0.5).alias("n_pos"), F.count_if(F.col(y) <= 0.5).alias("n_neg"))
    n1, n0 = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    a = a.withColumn("auc", F.try_divide(F.col("s") - n1 * (n1 + 1) / 2, n1 * n0))
    v = F.col("auc")
    q1, q2 = v / (2 - v), 2 * v * v / (1 + v)
    se = F.sqrt((v * (1 - v) + (n1 - 1) * (q1 - v * v) + (n0 - 1) * (q2 - v * v)) / F.nullif(n1 * n0, F.lit(0.0)))
    return a.select(*(by or []), "n_pos", "n_neg", "auc", (v - 1.96 * se).alias("lo"), (v + 1.96 * se).alias("hi"))


def brier_skill(df: DataFrame, p: str, y: str, base: str, by: list[str] | None = None) -> DataFrame:
    """(by..., n, brier, brier_base, skill) of forecasts p against those of the base rate."""
    a = (df.groupBy(*by) if by else df.groupBy()).agg(
        F.count("*").alias("n"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.avg(F.pow(F.col(base) - F.col(y), 2)).alias("brier_base"))
    return a.withColumn("skill", F.when(F.col("brier_base") > 0, 1 - F.col("brier") / F.col("brier_base")).otherwise(0.0))


def ic_to_hits(ic: Column) -> Column:
    """Share of right signs that a correlation of normal variables means."""
    return 0.5 + F.asin(ic) / math.pi


def hits_to_ic(hits: Column) -> Column:
    return F.sin((hits - 0.5) * math.pi)


def normal_cdf(x: Column) -> Column:
    """Abramowitz and Stegun 26.2.17, within 7.5e-8."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def p_up_given_z(z: Column, ic: Column) -> Column:
    """P(return > 0 | standardized signal z) for a bivariate normal with correlation ic."""
    return normal_cdf(ic * z / F.sqrt(1 - ic * ic))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = k / n
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)
