"""Driver exposures: ridge on standardized driver returns, rolling refits, driver signals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..sources.sinks import written

OUT = "ticker string, asof date, driver string, beta double, share double, r2 double, n long"


def ridge(n: float, sx, sy: float, sxx, sxy, syy: float, lam: float = 1.0):
    """(beta on standardized x, r2) from sums alone: x to population deviation one, y centred."""
    sx, sxx, sxy = np.asarray(sx, float), np.asarray(sxx, float), np.asarray(sxy, float)
    mx, my = sx / n, sy / n
    cov = sxx / n - np.outer(mx, mx)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd[sd == 0] = 1.0
    gram = n * cov / np.outer(sd, sd)
    xty = (sxy - n * mx * my) / sd
    b = np.linalg.solve(gram + lam * np.eye(len(sd)), xty)
    tss = syy - n * my * my
    rss = tss - 2 * b @ xty + b @ gram @ b
    return b, (1 - rss / tss) if tss > 0 else 0.0


def rolling_exposures(rets: DataFrame, driver_rets: DataFrame, asofs: DataFrame, window: int = 250, least: int = 120, lam: float = 1.0) -> DataFrame:
    """(ticker, asof, driver, beta, share, r2, n) at each date of asofs (asof), from the last `window` common sessions strictly before.

    Drivers stand side by side on their common dates. The windows' ends and beginnings cut an entity's sessions into
    segments; each segment comes down to one row of sums, a running total over the segments is taken, and a window is the difference
    of two of them. So no session is repeated, however many windows hold it; only the differences are solved, in batches.
    driver_rets is read twice: pass a written table.
    """
    names = sorted(r[0] for r in driver_rets.select("driver").distinct().collect())  # the registry of drivers: a few dozen
    k = len(names)
    of = F.col("m_")
    wide = driver_rets.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("driver", "ret"))).alias("m_")).where(F.size("m_") == k)  # a date has a row a driver at most
    j = rets.join(wide.select("date", *[of[n].alias(f"x{i}") for i, n in enumerate(names)]), "date").withColumn("i_", F.row_number().over(Window.partitionBy("ticker").orderBy("date")))
    j = written(j, "sessions")
    # an entity's sessions and the instants in one order of time: the number of sessions strictly before each instant is the window's end
    marks = j.select("ticker").distinct().crossJoin(asofs.select("asof").distinct())  # as large as the result
    none = F.lit(None)
    both = j.select("ticker", F.col("date").alias("t_"), F.lit(1).alias("o_"), "i_", none.cast("date").alias("asof")).unionByName(marks.select("ticker", F.col("asof").alias("t_"), F.lit(0).alias("o_"), none.cast("int").alias("i_"), "asof"))
    w = Window.partitionBy("ticker").orderBy("t_", "o_")
    ends = both.withColumn("end_", F.max("i_").over(w)).where("o_ = 0 and end_ is not null").select("ticker", "asof", "end_", F.greatest(F.col("end_") - window, F.lit(0)).alias("from_"))
    ends = written(ends, "windows")
    cuts = ends.select("ticker", F.explode(F.array("end_", "from_")).alias("cut_")).where("cut_ > 0").distinct()
    # a session belongs to the first cut at or after it
    xs = [f"x{i}" for i in range(k)]
    lined = j.select("ticker", "i_", "ret", *xs).unionByName(cuts.select("ticker", F.col("cut_").alias("i_"), "cut_"), allowMissingColumns=True)
    later = Window.partitionBy("ticker").orderBy(F.col("i_").desc(), F.col("cut_").asc_nulls_last())
    dealt = lined.withColumn("seg_", F.min("cut_").over(later)).where("cut_ is null and seg_ is not null")
    y, x = F.col("ret"), [F.col(c) for c in xs]
    named = {"n": F.count("*"), "sy": F.sum(y), "syy": F.sum(y * y)} | {f"sx{a}": F.sum(x[a]) for a in range(k)} | {f"sxy{a}": F.sum(x[a] * y) for a in range(k)} | {f"sxx{a}_{b}": F.sum(x[a] * x[b]) for a in range(k) for b in range(a, k)}
    sums = dealt.groupBy("ticker", "seg_").agg(*[c.alias(n) for n, c in named.items()])
    upto = Window.partitionBy("ticker").orderBy("seg_").rowsBetween(Window.unboundedPreceding, 0)
    total = sums.select("ticker", "seg_", F.array(*[F.sum(F.col(n).cast("double")).over(upto) for n in named]).alias("s_"))
    total = written(total, "totals")  # read at both ends of the windows
    lower, upper = (total.select("ticker", F.col("seg_").alias(c), F.col("s_").alias("s" + c)) for c in ("from_", "end_"))
    gram = ends.join(upper, ["ticker", "end_"]).join(lower, ["ticker", "from_"], "left")
    diff = F.when(F.col("sfrom_").isNull(), F.col("send_")).otherwise(F.zip_with("send_", "sfrom_", lambda p, q: p - q))
    gram = gram.select("ticker", "asof", diff.alias("g")).where(F.col("g")[0] >= least)
    upper_at = np.triu_indices(k)

    def solve(batches):
        for g in batches:
            lists = g.column(2)
            v = np.asarray(lists.flatten()).reshape(len(lists), -1)
            got = []
            for row in v:
                sxx = np.zeros((k, k))
                sxx[upper_at] = row[3 + 2 * k :]
                b, r2 = ridge(row[0], row[3 : 3 + k], row[1], np.triu(sxx) + np.triu(sxx, 1).T, row[3 + k : 3 + 2 * k], row[2], lam)
                got += [(c, abs(c) / (np.abs(b).sum() or 1.0), r2, row[0]) for c in b]
            cols = np.asarray(got, float).reshape(-1, 4).T
            who = pa.array(np.repeat(np.arange(len(v)), k), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [g.column(0).take(who), g.column(1).take(who), pa.array(names * len(v), pa.string()), *[pa.array(c) for c in cols[:3]], pa.array(cols[3].astype(np.int64))], ["ticker", "asof", "driver", "beta", "share", "r2", "n"])

    return gram.mapInArrow(solve, OUT)


def fit_exposures(rets: DataFrame, driver_rets: DataFrame, asof: str, window: int = 250, least: int = 120, lam: float = 1.0) -> DataFrame:
    one = rets.sparkSession.createDataFrame([(asof,)], "asof string").select(F.col("asof").cast("date").alias("asof"))
    return rolling_exposures(rets, driver_rets, one, window, least, lam)


def top_drivers(exposures: DataFrame, k: int = config.TOP_DRIVERS, min_share: float = config.MIN_SHARE) -> DataFrame:
    w = Window.partitionBy("ticker", "asof").orderBy(F.col("share").desc(), "driver")
    return exposures.where(F.col("share") >= min_share).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def driver_signal(exposures: DataFrame, driver_rets: DataFrame, sds: DataFrame) -> DataFrame:
    """(ticker, date, signal): sum of beta x return / deviation over the drivers on each date, less the entities' mean.

    exposures: those valid on each date (ticker, date, driver, beta); sds: (driver, sd)."""
    j = exposures.join(driver_rets, ["driver", "date"]).join(sds, "driver")
    s = j.groupBy("ticker", "date").agg(F.sum(F.col("beta") * F.col("ret") / F.col("sd")).alias("raw"))
    m = s.groupBy("date").agg(F.avg("raw").alias("m_"))
    return s.join(m, "date").select("ticker", "date", (F.col("raw") - F.col("m_")).alias("signal"))


def univariate_signal(rets: DataFrame, driver: DataFrame, window: int = 250, least: int = 120) -> DataFrame:
    """(ticker, date, beta, signal): slope on one driver (date, x) over the `window` sessions before, times its move that day."""
    j = rets.join(driver, "date")
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-window, -1)
    b = F.when(F.count("ret").over(w) >= least, F.try_divide(F.covar_pop("ret", "x").over(w), F.nullif(F.var_pop("x").over(w), F.lit(0.0))))
    return j.select("ticker", "date", b.alias("beta"), "x").where("beta is not null").select("ticker", "date", "beta", (F.col("beta") * F.col("x")).alias("signal"))
