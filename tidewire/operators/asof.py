"""As-of joins: for each left row the nearest right row before or after, by key, without a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import written


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, direction: str = "backward", strict: bool = False, tolerance=None, prefix: str = "r_") -> DataFrame:
    """left with the columns of the nearest right row (prefixed; null without one).

    backward: the last right row at or before left_on (strict: before); forward: the first at or after (strict: after).
    tolerance (a number of seconds for timestamps, of days for dates) drops farther ones. Both sides go through
    one sort by (key, time), in which right rows stand before or after left rows of equal time as the rule asks.
    Of right rows with equal key and time the last in the order of its other columns counts.
    """
    rest = [c for c in right.columns if c not in by]
    lcols = [c for c in left.columns if c not in by]
    back = direction == "backward"
    rank_right = 1 if strict == back else -1  # against 0 for left rows, in ascending order of time
    lrow = left.select(*by, F.col(left_on).alias("t_"), F.lit(0).alias("o_"), F.struct(*lcols).alias("l_"), F.lit(None).cast(right.select(F.struct(*rest).alias("x")).schema["x"].dataType).alias("x_"))
    rrow = right.where(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("t_"), F.lit(rank_right).alias("o_"), F.lit(None).cast(lrow.schema["l_"].dataType).alias("l_"), F.struct(*rest).alias("x_"))
    order = [F.col("t_"), F.col("o_"), F.col("x_")] if back else [F.col("t_").desc(), F.col("o_").desc(), F.col("x_")]
    near = F.last("x_", ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = lrow.unionByName(rrow).withColumn("x_", near).where("o_ = 0")
    x = F.col("x_")
    if tolerance is not None:
        at = x[right_on]
        days = dict(right.dtypes)[right_on] == "date"
        gap = F.abs(F.datediff(F.col("t_"), at) if days else F.unix_timestamp("t_") - F.unix_timestamp(at))
        out = out.withColumn("x_", F.when(gap <= tolerance, x))
    return out.select(*by, "l_.*", *[F.col("x_").getField(c).alias(prefix + c) for c in rest])


def range_explode(points: DataFrame, time: str, grid: DataFrame, grid_time: str, hours: float, by: list[str] = ()) -> DataFrame:
    """Pairs of points and grid instants with grid - hours < point <= grid: each point goes to the one or two buckets
    of `hours` it can reach and meets the grid there by equality."""
    span = int(hours * 3600)
    b = F.floor(F.unix_timestamp(time) / span)
    p = points.withColumn("b_", F.explode(F.array(b, b + 1)))
    g = grid.withColumn("b_", F.floor(F.unix_timestamp(grid_time) / span))
    both = p.join(g, [*by, "b_"]).where((F.col(time) <= F.col(grid_time)) & (F.unix_timestamp(grid_time) - F.unix_timestamp(time) < span))
    return both.drop("b_")


def running(df: DataFrame, by: list[str], order: list[str], sums: list[str] = (), maxes: list[str] = ()) -> DataFrame:
    """df with run_<c> for each column of sums and maxes: its total, or largest value, over the rows of `by` up to this one
    in order (rows that tie stand in any order). Nulls are left out.

    Rows are dealt by range of (by, order) and written, so a key of any share of the rows spreads over tasks. A task adds up
    its own; a key that began in an earlier range gets what stood there, one row a partition.
    """
    dealt = written(df.repartitionByRange(*by, *order).withColumn("part_", F.spark_partition_id()), "ranges")
    total = [F.sum(c).alias(c) for c in sums] + [F.max(c).alias(c) for c in maxes]
    inner = Window.partitionBy("part_", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("part_", *by).agg(*total)
    before = parts.select(F.col("part_").alias("p_"), *[F.col(c).alias("b_" + c) for c in by], F.count("*").over(outer).alias("k_"),
                          *[F.sum(c).over(outer).alias("o_" + c) for c in sums], *[F.max(c).over(outer).alias("o_" + c) for c in maxes]).where("k_ > 0").drop("k_")
    same = F.col("part_") == F.col("p_")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col("b_" + c))
    local = dealt.select("*", *[F.sum(c).over(inner).alias("i_" + c) for c in sums], *[F.max(c).over(inner).alias("i_" + c) for c in maxes])
    zero = F.lit(0)
    got = local.join(F.broadcast(before), same, "left")  # only the first key of a partition can have begun before: a row a partition
    return got.select(*df.columns, *[(F.coalesce("i_" + c, zero) + F.coalesce("o_" + c, zero)).alias("run_" + c) for c in sums], *[F.greatest("i_" + c, "o_" + c).alias("run_" + c) for c in maxes])
