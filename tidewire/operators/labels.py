"""Labels: future abnormal return over sessions, classes, base rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_join


def future_sessions(abn: DataFrame, horizons: tuple[int, ...] = (1, 5, 20), key: str = "ticker", date: str = "date", least: int = 8) -> DataFrame:
    """abn (key, date, abn) with car_h and sigma_h: the sum over the next h sessions (null if fewer are left) and the
    population deviation of all sessions up to date times sqrt(h) (null under `least`)."""
    w = Window.partitionBy(key).orderBy(date)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    out = abn.withColumn("sd_", F.when(F.count("abn").over(past) >= least, F.stddev_pop("abn").over(past)))
    for h in horizons:
        nxt = w.rowsBetween(1, h)
        out = out.withColumn(f"car_{h}", F.when(F.count("abn").over(nxt) == h, F.sum("abn").over(nxt))).withColumn(f"sigma_{h}", F.col("sd_") * F.sqrt(F.lit(float(h))))
    return out.drop("sd_")


def build_labels(asofs: DataFrame, abn: DataFrame, horizons: tuple[int, ...] = (1, 5, 20), key: str = "ticker", date: str = "date", band: float = 0.5) -> DataFrame:
    """(key, asof date, horizon, car, sigma, cls) of asofs (key, asof): the last session at or before asof counts;
    cls is 1 over band sigmas, -1 under, else 0."""
    f = future_sessions(abn, horizons, key, date)
    j = asof_join(asofs.select(key, "asof"), f, [key], "asof", date, "backward")
    rows = F.explode(F.array(*[F.struct(F.lit(f"{h}d").alias("horizon"), F.col(f"r_car_{h}").alias("car"), F.col(f"r_sigma_{h}").alias("sigma")) for h in horizons]))
    x = j.select(key, "asof", rows.alias("x")).select(key, "asof", "x.*").where("car is not null and sigma > 0")
    cls = F.when(F.col("car") > band * F.col("sigma"), 1).when(F.col("car") < -band * F.col("sigma"), -1).otherwise(0)
    return x.withColumn("cls", cls)


def base_rates(labels: DataFrame, key: str = "ticker", least: int = 30) -> DataFrame:
    """(horizon, key, n, up, flat, down, pooled): an entity's own rates, the pool's under `least` labels."""
    share = lambda c: F.avg((F.col("cls") == c).cast("double"))
    aggs = [F.count("*").alias("n"), share(1).alias("up"), share(0).alias("flat"), share(-1).alias("down")]
    own = labels.groupBy("horizon", key).agg(*aggs)
    pool = labels.groupBy("horizon").agg(*[a.alias(n) for a, n in zip(aggs[1:], ("p_up", "p_flat", "p_down"), strict=True)])
    few = F.col("n") < least
    return own.join(pool, "horizon").select("horizon", key, "n", *[F.when(few, F.col("p_" + c)).otherwise(F.col(c)).alias(c) for c in ("up", "flat", "down")], few.alias("pooled"))


def base_rate_or_third(rates: DataFrame, wanted: DataFrame, key: str = "ticker") -> DataFrame:
    """wanted (horizon, key) with base_up, base_flat, base_down; a third each where nothing is known."""
    got = wanted.join(rates, ["horizon", key], "left")
    return got.select(*wanted.columns, *[F.coalesce(c, F.lit(1 / 3)).alias("base_" + c) for c in ("up", "flat", "down")])
