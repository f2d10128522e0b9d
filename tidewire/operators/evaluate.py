"""Evaluation workbench: correlations by date, walk-forward, reliability, event studies, permutation nulls."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.text import norm
from ..sources.sinks import written
from .asof import asof_join


def fama_macbeth(df: DataFrame, x: str, y: str, at: str = "date", least: int = 8) -> DataFrame:
    """(n_dates, mean_ic, t): rank correlation a date (with `least` rows), its mean over dates and t = mean / (sd / sqrt n)."""
    ic = stats.spearman(df, x, y, [at], least).where("ic is not null")
    return ic.agg(F.count("*").alias("n_dates"), F.avg("ic").alias("mean_ic"), (F.avg("ic") / F.nullif(F.stddev_samp("ic") / F.sqrt(F.count("*")), F.lit(0.0))).alias("t"))


def decile_table(df: DataFrame, z: str = "z", car: str = "car", sigma: str = "sigma", k: int = 10) -> DataFrame:
    """(bucket, n, mean_z, mean_car_sigma): equal-sized buckets by z (the last takes the rest); ties go by their order of rank."""
    n = df.count()
    size = max(1, n // k)
    r = stats.avg_rank(df, z, "r_")
    b = F.least(F.floor((F.ceil("r_") - 1) / size), F.lit(k - 1)).cast("int")
    return r.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.avg(z).alias("mean_z"), F.avg(F.col(car) / F.col(sigma)).alias("mean_car_sigma"))


def top_precision(df: DataFrame, p: str = "p", y: str = "y", shares: tuple[float, ...] = (0.05, 0.10, 0.20, 0.50)) -> DataFrame:
    """(share, cut, n, precision, base): rate of y among predictions at or over the interpolated (1 - share) percentile."""
    cuts = df.select(F.percentile(p, [1 - s for s in shares]).alias("c"), F.avg(y).alias("base"))
    c = cuts.select("base", F.posexplode("c").alias("i", "cut")).withColumn("share", F.array(*[F.lit(float(s)) for s in shares])[F.col("i")])
    return df.join(F.broadcast(c), F.col(p) >= F.col("cut")).groupBy("share", "cut", "base").agg(F.count("*").alias("n"), F.avg(y).alias("precision")).select("share", "cut", "n", "precision", "base")


def reliability(df: DataFrame, p: str = "p", y: str = "y", bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """(by..., bin, n, p_mean, rate, lo, hi): bins between the percentiles of p, with Wilson intervals of the rate."""
    by = list(by or [])
    edges = (df.groupBy(*by) if by else df.groupBy()).agg(F.percentile(p, [i / bins for i in range(1, bins)]).alias("e"))
    b = (df.join(edges, by) if by else df.join(F.broadcast(edges))).withColumn("bin", F.size(F.filter("e", lambda x: x < F.col(p))))
    g = b.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("p_mean"), F.avg(y).alias("rate"))
    lo, hi = stats.wilson(F.col("rate") * F.col("n"), F.col("n"))
    return g.withColumns({"lo": lo, "hi": hi})


def ece(rel: DataFrame, least: int = 20) -> DataFrame:
    """(ece): mean distance of forecast and rate over the bins of `least` rows, weighted by rows."""
    return rel.where(F.col("n") >= least).agg((F.sum(F.col("n") * F.abs(F.col("p_mean") - F.col("rate"))) / F.sum("n")).alias("ece"))


def hit_rate(df: DataFrame, z: str = "z", car: str = "car", least: float = 0.4) -> DataFrame:
    """(n, hit_rate) of the sign of car where |z| > least."""
    return df.where((F.abs(z) > least) & (F.col(car) != 0)).agg(F.count("*").alias("n"), F.avg((F.signum(z) == F.signum(car)).cast("double")).alias("hit_rate"))


def walk_forward(pairs: DataFrame, asof: str = "asof", folds: int = 5, embargo_days: int = 5, min_train: int = 120) -> DataFrame:
    """(fold, role, row...): folds of equal counts by time; fold k trains on rows before its start less the embargo, with
    min_train of them at least. Cuts are percentiles of the time, so nothing is sorted in one place."""
    t = F.unix_timestamp(asof)
    cuts = pairs.select(F.percentile(t, [k / folds for k in range(1, folds)])).first()[0] or []
    parts = []
    for k, c in enumerate(cuts, 1):
        nxt = cuts[k] if k < len(cuts) else None
        test = (t >= F.lit(float(c))) & (F.lit(True) if nxt is None else t < F.lit(float(nxt)))
        role = F.when(test, "test").when(t < F.lit(float(c)) - embargo_days * 86400, "train")
        parts.append(pairs.withColumn("fold", F.lit(k)).withColumn("role", role).where("role is not null"))
    if not parts:
        return pairs.withColumn("fold", F.lit(0)).withColumn("role", F.lit("train")).limit(0)
    both = reduce(DataFrame.unionByName, parts)
    ok = both.where("role = 'train'").groupBy("fold").agg(F.count("*").alias("n_")).where(F.col("n_") >= min_train).select("fold")
    return both.join(F.broadcast(ok), "fold")  # a row a fold


def event_windows(residuals: DataFrame, ks: tuple[int, ...] = (1, 5, 15, 30, 60), key: str = "ticker", ts: str = "ts") -> DataFrame:
    """residuals with cum_k: the sum over k bars from this one on; null where fewer are left."""
    w = Window.partitionBy(key).orderBy(ts)
    out = residuals
    for k in ks:
        span = w.rowsBetween(0, k - 1)
        out = out.withColumn(f"cum_{k}", F.when(F.count("residual").over(span) == k, F.sum("residual").over(span)))
    return out


def event_car(abn: DataFrame, events: DataFrame, start: int, end: int, key: str = "ticker", date: str = "date", tolerance_days: int | None = None) -> DataFrame:
    """(key, event, car): sum over the sessions start..end around the first session at or after the event (key, event)."""
    w = Window.partitionBy(key).orderBy(date).rowsBetween(start, end)
    s = abn.select(key, date, F.when(F.count("abn").over(w) == end - start + 1, F.sum("abn").over(w)).alias("car"))
    return asof_join(events, s, [key], "event", date, "forward", tolerance=tolerance_days).select(key, "event", F.col("r_car").alias("car"))


def event_study(news: DataFrame, residuals: DataFrame, ks: tuple[int, ...] = (1, 5, 15, 30, 60), key: str = "ticker") -> DataFrame:
    """(window, n_events, n_cells, ic, hit_rate): news (key, published_ts, strength) meet the first bar strictly after; events of one
    (entity, bar) are one cell with their mean strength, as they share one outcome; rounded, so that the order of adding makes no ranks."""
    w = event_windows(residuals, ks, key)
    j = asof_join(news, w, [key], "published_ts", "ts", "forward", strict=True).where("r_ts is not null")
    cells = j.groupBy(key, "r_ts").agg(F.round(F.avg("strength"), 9).alias("strength"), F.count("*").alias("n_"), *[F.first(f"r_cum_{k}").alias(f"cum_{k}") for k in ks])
    cells = written(cells, "cells")  # each window reads them several times, and news would be scored each time
    parts = []
    for k in ks:
        c = cells.where(f"cum_{k} is not null")
        ic = stats.spearman(c, "strength", f"cum_{k}")
        h = c.agg(F.sum("n_").alias("n_events"), F.avg(F.when((F.col("strength") != 0) & (F.col(f"cum_{k}") != 0), (F.signum("strength") == F.signum(f"cum_{k}")).cast("double"))).alias("hit_rate"))
        parts.append(ic.join(F.broadcast(h)).select(F.lit(k).alias("window"), F.coalesce("n_events", F.lit(0).cast("long")).alias("n_events"), F.col("n").alias("n_cells"), "ic", "hit_rate"))
    return reduce(DataFrame.unionByName, parts)


def shuffled(df: DataFrame, value: str, perms: int, by: list[str] = (), seed: int = 1, order: str | None = None) -> DataFrame:
    """df once a permutation (column perm from 1) with `value` dealt anew among the rows of the same group: the k-th row by a
    hash takes the value of the k-th row by its own order. df should be the small side: it is repeated perms times."""
    by, keys = list(by), [c for c in df.columns if c != value]
    many = df.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(perms)))).withColumn("h_", F.xxhash64(F.lit(seed), "perm", *keys))
    # groups stand in one order on both sides and are as large, so places in the whole order meet within their group
    left = stats.row_index(many.drop(value), ["perm", *by, "h_", *keys]).drop("h_")
    right = stats.row_index(many.select("perm", *df.columns), ["perm", *by, *([order] if order else keys)]).select("k_", value)
    return left.join(right, "k_").drop("k_")


def permutation_ic(df: DataFrame, x: str, y: str, perms: int = 500, seed: int = 1) -> DataFrame:
    """(ic, n, p_value, null_p95): rank correlation against that with y shuffled; p by |ic| with the observed counted in."""
    obs = stats.spearman(df, x, y)
    rows = df.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("id_", F.monotonically_increasing_id())
    rows = written(rows, "pairs")  # so that ids stay as they are
    null = stats.spearman(shuffled(rows, y, perms, (), seed), x, y, ["perm"]).select(F.col("ic").alias("null_ic"))
    j = null.join(F.broadcast(obs))
    return j.groupBy("ic", "n").agg(((F.count_if(F.abs("null_ic") >= F.abs("ic")) + 1) / (F.count("*") + 1)).alias("p_value"), F.percentile(F.abs("null_ic"), 0.95).alias("null_p95"))


def beta_dispersion(pairs: DataFrame, by: list[str] = (), least: int = 8) -> DataFrame:
    """(by..., dispersion, n): population deviation over entities of the slopes of abn on surprise. pairs: (by..., ticker, abn, surprise)."""
    by = list(by)
    b = pairs.groupBy(*by, "ticker").agg(F.regr_slope("abn", "surprise").alias("beta"), F.count("*").alias("n_")).where((F.col("n_") >= least) & F.col("beta").isNotNull())
    return (b.groupBy(*by) if by else b.groupBy()).agg(F.stddev_pop("beta").alias("dispersion"), F.count("*").alias("n"))


SIDE = 256  #: entities of a block of a matrix


def _blocks(entities: DataFrame, key: str, side: int) -> DataFrame:
    """(key, block, e): entities dealt to blocks of about `side`; e numbers them within their block."""
    n = entities.count()
    block = F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // side)))).cast("int")
    return entities.withColumn("block", block).withColumn("e", F.row_number().over(Window.partitionBy("block").orderBy(key)) - 1)


def dispersion_under(abn: DataFrame, draws: DataFrame, least: int = 8, side: int = SIDE) -> DataFrame:
    """(perm, dispersion, n): for each perm of draws (perm, date, x) the population deviation over entities of the slopes of
    abn (ticker, date, abn) on x, entities with `least` of the days alone.

    Blocked products of the draws with the matrix of returns: returns are dealt once by blocks of entities, of a block the days
    that any draw has; every block meets all draws, and what comes out is three sums a block and perm. So returns are never copied for
    a permutation. draws has perms times event days rows.
    """
    days = draws.select("date").distinct()
    rows = abn.where("abn is not null").join(days, "date", "left_semi")
    of = _blocks(written(rows.select("ticker").distinct(), "entities"), "ticker", side)
    dealt = rows.join(of, "ticker").select("block", "e", "date", "abn")
    every = draws.join(of.select(F.col("block").alias("at")).distinct())

    def run(y: pa.Table, d: pa.Table) -> pa.Table:
        if not len(y) or not len(d):
            return none
        dates, at = np.unique(y["date"].to_numpy(), return_inverse=True)
        m = np.full((len(dates), int(np.max(y["e"].to_numpy())) + 1), np.nan)
        m[at, y["e"].to_numpy()] = y["abn"].to_numpy()
        has, m = (~np.isnan(m)).astype(float), np.nan_to_num(m)
        perm, when, x = (d[c].to_numpy() for c in ("perm", "date", "x"))
        order = np.argsort(perm, kind="stable")
        perm, when, x = perm[order], when[order], x[order]
        place = np.minimum(np.searchsorted(dates, when), len(dates) - 1)
        known = dates[place] == when
        out = []
        for p, a, b in zip(*[v.tolist() for v in (lambda s: (perm[s], s, np.r_[s[1:], len(perm)]))(np.flatnonzero(np.r_[True, perm[1:] != perm[:-1]]))], strict=True):
            k = known[a:b]
            h, g, v = has[place[a:b][k]], m[place[a:b][k]], x[a:b][k]
            n, sx, sxx, sy, sxy = h.sum(0), v @ h, (v * v) @ h, g.sum(0), v @ g
            den = n * sxx - sx * sx
            ok = (n >= least) & (den > 1e-12 * np.maximum(n * sxx, 1e-300))
            beta = (n * sxy - sx * sy)[ok] / den[ok]
            out.append((p, len(beta), float(beta.sum()), float((beta * beta).sum())))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), none.schema, strict=True)], schema=none.schema)

    none = pa.schema([("perm", pa.int32()), ("n", pa.int64()), ("s", pa.float64()), ("q", pa.float64())]).empty_table()
    sums = dealt.groupBy("block").cogroup(every.select("at", F.col("perm").cast("int").alias("perm"), "date", F.col("x").cast("double").alias("x")).groupBy("at")).applyInArrow(run, "perm int, n long, s double, q double")
    g = sums.groupBy("perm").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).where("n > 0")
    mean = F.col("s") / F.col("n")
    return g.select("perm", F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("dispersion"), "n")


def permutation_dispersion(event_rets: DataFrame, surprises: DataFrame, perms: int = 500, seed: int = 1, least: int = 8) -> DataFrame:
    """(dispersion, p_value, null_p95): dispersion of the slopes of abn (ticker, date, abn) on surprises (date, surprise) against
    surprises shuffled over the dates; perm 0 is the observed one, counted in."""
    s = written(surprises.where("surprise is not null").select("date", "surprise"), "surprises")
    draws = s.withColumn("perm", F.lit(0)).unionByName(shuffled(s, "surprise", perms, (), seed)).withColumnRenamed("surprise", "x")
    got = written(dispersion_under(event_rets, written(draws, "draws"), least), "dispersion")
    obs = got.where("perm = 0").select(F.col("dispersion").alias("obs_"))
    return got.where("perm > 0").join(F.broadcast(obs)).groupBy(F.col("obs_").alias("dispersion")).agg(  # one row
        ((F.count_if(F.col("dispersion") >= F.col("obs_")) + 1) / (F.count("*") + 1)).alias("p_value"), F.percentile("dispersion", 0.95).alias("null_p95"))


def random_day_control(abn: DataFrame, events: DataFrame, samples: int = 200, seed: int = 1, least: int = 8) -> DataFrame:
    """(dispersion, control_mean, control_p95, share_above): dispersion on event days (date, surprise) against that on as many
    other sessions with the same surprises: each sample takes the sessions with the smallest hashes."""
    ev = written(events.where("surprise is not null").select("date", F.col("surprise").alias("x")), "events")
    n = ev.count()
    days = abn.select("date").distinct().join(ev.select("date"), "date", "left_anti")
    many = days.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    pick = many.withColumn("k_", F.row_number().over(Window.partitionBy("perm").orderBy(F.xxhash64(F.lit(seed), "perm", "date"), "date")) - 1).where(F.col("k_") < n)
    draws = ev.withColumn("perm", F.lit(0)).unionByName(pick.join(stats.row_index(ev, ["date"]).select("k_", "x"), "k_").select("date", "x", "perm"))
    got = written(dispersion_under(abn, written(draws, "draws"), least), "dispersion")
    obs = got.where("perm = 0").select(F.col("dispersion").alias("obs_"))
    return got.where("perm > 0").join(F.broadcast(obs)).groupBy(F.col("obs_").alias("dispersion")).agg(  # one row
        F.avg("dispersion").alias("control_mean"), F.percentile("dispersion", 0.95).alias("control_p95"), F.avg((F.col("dispersion") >= F.col("obs_")).cast("double")).alias("share_above"))


def leadlag_pairs(rets: DataFrame, least: int = 60, value: str = "ret", key: str = "ticker", date: str = "date") -> DataFrame:
    """(lead, follow, n, ic): rank correlation of each ordered pair, the leader's session against the follower's next one."""
    days = rets.select(date).distinct()
    idx = stats.prefix_counts(days.withColumn("one_", F.lit(1)), date, ["one_"]).select(date, F.col("one__before").alias("i_"))
    r = rets.join(idx, date)
    a = r.select(F.col(key).alias("lead"), F.col(value).alias("x"), (F.col("i_") + 1).alias("i_"))
    b = r.select(F.col(key).alias("follow"), F.col(value).alias("y"), "i_")
    return stats.spearman(a.join(b, "i_").where("lead != follow"), "x", "y", ["lead", "follow"], least).where("ic is not null").select("lead", "follow", "n", "ic")


def block_shuffled(rets: DataFrame, block: int = 10, seed: int = 1, key: str = "ticker", date: str = "date") -> DataFrame:
    """rets with each entity's blocks of `block` sessions in another order (within blocks the order stays)."""
    i = F.row_number().over(Window.partitionBy(key).orderBy(date)) - 1
    r = rets.withColumn("i_", i).withColumn("b_", F.floor(F.col("i_") / block))
    slot = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(F.lit(seed), key, "b_"), "b_", "i_")) - 1
    dealt = r.withColumn("to_", slot).select(key, F.col("to_").alias("i_"), *[c for c in rets.columns if c not in (key, date)])
    return r.select(key, "i_", date).join(dealt, [key, "i_"]).select(rets.columns)


BINS = 4000  #: of |ic| from 0 to 1 in the null distribution: its points are exact to a bin


def leadlag_null(rets: DataFrame, perms: int = 200, block: int = 10, seed: int = 1, value: str = "ret", key: str = "ticker", date: str = "date", side: int = SIDE) -> DataFrame:
    """(n_pairs, sessions, mean_ic, sd_ic, null_sd, ratio, null_p95, share_over, max_ic, p_max, p_sd): the rank correlations of
    all ordered pairs (leader's session, follower's next one) against the same with the leaders' blocks of `block` sessions in another order.

    Over the sessions that all entities have; no row where there are fewer than three. null_p95 is the 95 % point of |ic| over all pairs and shuffles, share_over the
    share of observed pairs beyond it; p_max and p_sd compare the observed largest |ic| and deviation with each shuffle's.

    Blocked products of the session x entity matrix of ranks: a task has a block of leaders and a block of followers, reorders
    the leaders' sessions for each shuffle (which leaves their ranks as they are) and multiplies. Out of it come sums and counts by
    bin, no pairs; all shuffles are one job.
    """
    from .panel import common_dates

    rows = rets.select(key, date, value).where(F.col(value).isNotNull())
    rows = rows.join(common_dates(rows, key, date), date, "left_semi")
    days = rows.select(date).distinct().withColumn("one_", F.lit(1))
    idx = stats.prefix_counts(days, date, ["one_"]).select(date, F.col("one__before").cast("int").alias("i"))
    ranked = stats.avg_rank(rows, value, "rank", [key]).join(idx, date)
    of = _blocks(written(rows.select(key).distinct(), "entities"), key, side)
    dealt = written(ranked.join(of, key).select("block", "e", "i", "rank"), "ranks")
    blocks = written(of.select("block").distinct(), "blocks")
    copy = lambda *names: dealt.select(F.col("block").alias(names[0]), *[F.col(c).alias(c) for c in ("e", "i", "rank")]).join(blocks.select(F.col("block").alias(names[1])))
    lead, follow = copy("a", "b"), copy("d", "c")  # ranks go to each block of the other side

    def matrix(t: pa.Table) -> np.ndarray:
        i, e = t["i"].to_numpy(), t["e"].to_numpy()
        m = np.zeros((i.max() + 1, e.max() + 1))
        m[i, e] = t["rank"].to_numpy()
        return m

    def unit(m: np.ndarray) -> np.ndarray:
        m = m - m.mean(0)
        norm = np.sqrt((m * m).sum(0))
        return m / np.where(norm > 0, norm, np.inf)

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        if not len(x) or not len(y) or x["i"].to_numpy().max() < 2:
            return none
        same = x["a"][0].as_py() == x["b"][0].as_py()
        lead, after = matrix(x), unit(matrix(y)[1:])
        cuts = range(0, len(lead), block)
        out = []
        for p in range(perms + 1):
            draw = np.random.default_rng([seed, p, x["a"][0].as_py()])
            # each leader's blocks in an order of its own; the same one for every block of followers
            mixed = lead if p == 0 else np.stack([np.concatenate([col[c : c + block] for c in np.array(cuts)[draw.permutation(len(cuts))]]) for col in lead.T], axis=1)
            ic = unit(mixed[:-1]).T @ after
            ic = ic[~np.eye(len(ic), dtype=bool)] if same else ic.ravel()
            if len(ic):
                out.append((p, len(ic), len(lead), ic.sum(), (ic * ic).sum(), np.abs(ic).max(), np.bincount(np.minimum((np.abs(ic) * BINS).astype(int), BINS - 1), minlength=BINS).tolist()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), none.schema, strict=True)], schema=none.schema) if out else none

    none = pa.schema([("perm", pa.int32()), ("n", pa.int64()), ("t", pa.int64()), ("s", pa.float64()), ("q", pa.float64()), ("top", pa.float64()), ("bins", pa.list_(pa.int64()))]).empty_table()
    parts = lead.groupBy("a", "b").cogroup(follow.groupBy("c", "d")).applyInArrow(run, "perm int, n long, t long, s double, q double, top double, bins array<long>")
    parts = written(parts, "leadlag")
    each = parts.groupBy("perm").agg(F.sum("n").alias("n"), F.max("t").alias("t"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.max("top").alias("top"))
    each = each.withColumn("sd", F.sqrt(F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0))))
    obs = each.where("perm = 0").select("n", "t", (F.col("s") / F.col("n")).alias("mean_"), F.col("sd").alias("sd_"), F.col("top").alias("top_"))
    null = each.where("perm > 0").join(F.broadcast(obs.select("sd_", "top_")))  # one row
    tail = null.agg(F.sqrt(F.sum("q") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2)).alias("null_sd"), ((F.count_if(F.col("top") >= F.col("top_")) + 1) / (F.count("*") + 1)).alias("p_max"), ((F.count_if(F.col("sd") >= F.col("sd_")) + 1) / (F.count("*") + 1)).alias("p_sd"))
    counts = parts.select((F.col("perm") == 0).alias("seen"), F.posexplode("bins").alias("bin", "c")).groupBy("bin").agg(F.sum(F.when(~F.col("seen"), F.col("c")).otherwise(0)).alias("c"), F.sum(F.when(F.col("seen"), F.col("c")).otherwise(0)).alias("o"))
    upto = Window.orderBy("bin")  # BINS rows
    counts = counts.withColumn("below", F.sum("c").over(upto)).withColumn("all", F.sum("c").over(Window.partitionBy()))
    point = counts.where(F.col("below") >= 0.95 * F.col("all")).agg(F.min("bin").alias("cut"))
    over = counts.join(F.broadcast(point)).agg(((F.max("cut") + 1) / BINS).alias("null_p95"), (F.sum(F.when(F.col("bin") > F.col("cut"), F.col("o")).otherwise(0)) / F.sum("o")).alias("share_over"))
    j = obs.join(F.broadcast(tail)).join(F.broadcast(over))  # one row each
    return j.select(F.col("n").alias("n_pairs"), F.col("t").alias("sessions"), F.col("mean_").alias("mean_ic"), F.col("sd_").alias("sd_ic"), "null_sd", (F.col("sd_") / F.col("null_sd")).alias("ratio"), "null_p95", "share_over", F.col("top_").alias("max_ic"), "p_max", "p_sd")


def asymmetry_walk(rets: DataFrame, market: DataFrame, estimate: int = 252, future: int = 63, step: int | None = None, least: int = 30, perms: int = 500, seed: int = 1, entities: int = 5) -> DataFrame:
    """(n_cuts, mean_ic, t, p_value): at every cut, `step` sessions apart (default `future`: the futures don't overlap), rank correlation over
    entities of the asymmetry of the `estimate` sessions before with that of the `future` ones from the cut on; cuts with `entities` at
    least. t = mean / (deviation / sqrt n); p against futures shuffled over the entities within each cut, the observed counted in.

    Sessions come down to sums by segment (the greatest length that divides all three) and running totals of these, so that
    overlapping windows share their sums: a window is the difference of two totals.
    """
    step = step or future
    g = math.gcd(math.gcd(estimate, future), step)
    days = market.select("date").distinct()
    idx = stats.prefix_counts(days.withColumn("one_", F.lit(1)), "date", ["one_"]).select("date", F.col("one__before").cast("int").alias("i_"))
    total = days.count()
    j = rets.select("ticker", "date", "ret").join(market.select("date", "market"), "date").join(idx, "date")
    x, y, names = F.col("market"), F.col("ret"), []
    sums = []
    for side, on in (("d", x < 0), ("u", x > 0)):
        for name, v in (("n", F.lit(1.0)), ("x", x), ("y", y), ("xy", x * y), ("xx", x * x)):
            names.append(side + name)
            sums.append(F.sum(F.when(on, v).otherwise(0.0)).alias(side + name))
    seg = j.groupBy("ticker", F.floor(F.col("i_") / g).cast("int").alias("s_")).agg(*sums)
    grid = seg.select("ticker").distinct().join(rets.sparkSession.range(-(-total // g)).select(F.col("id").cast("int").alias("s_")))  # entities by segments
    dense = grid.join(seg, ["ticker", "s_"], "left")
    w = Window.partitionBy("ticker").orderBy("s_")
    run = dense.select("ticker", "s_", F.array(*[F.sum(F.coalesce(c, F.lit(0.0))).over(w) for c in names]).alias("p_"))
    zero = F.array(*[F.lit(0.0)] * len(names))
    at, before, after = F.coalesce(F.lag("p_", 1).over(w), zero), F.coalesce(F.lag("p_", 1 + estimate // g).over(w), zero), F.lead("p_", future // g - 1).over(w)
    cuts = run.select("ticker", "s_", at.alias("at_"), before.alias("before_"), after.alias("after_")).where((F.col("s_") >= estimate // g) & ((F.col("s_") * g - estimate) % step == 0) & (F.col("s_") * g + future < total))

    def asymmetry(upper: str, lower: str, floor: int) -> Column:
        v = [F.col(upper)[i] - F.col(lower)[i] for i in range(len(names))]
        slope = lambda n, sx, sy, sxy, sxx: F.when(n >= floor, F.try_divide(n * sxy - sx * sy, F.nullif(n * sxx - sx * sx, F.lit(0.0))))
        return slope(*v[:5]) - slope(*v[5:])

    two = cuts.select("ticker", F.col("s_").alias("cut"), asymmetry("at_", "before_", least).alias("past"), asymmetry("after_", "at_", max(2, least // 3)).alias("future")).where("past is not null and future is not null")
    # rounded, so that the order of adding makes no ranks
    two = two.select("ticker", "cut", F.round("past", 9).alias("past"), F.round("future", 9).alias("future"))
    two = written(two.withColumn("n_", F.count("*").over(Window.partitionBy("cut"))).where(F.col("n_") >= entities).drop("n_"), "asymmetry")
    ic = stats.spearman(two, "past", "future", ["cut"]).where("ic is not null")
    obs = ic.agg(F.count("*").alias("n_cuts"), F.avg("ic").alias("mean_ic"), (F.avg("ic") / F.nullif(F.stddev_pop("ic") / F.sqrt(F.count("*")), F.lit(0.0))).alias("t"))
    null = stats.spearman(shuffled(two, "future", perms, ["cut"], seed), "past", "future", ["perm", "cut"]).where("ic is not null").groupBy("perm").agg(F.avg("ic").alias("null_"))
    p = obs.join(null).groupBy("n_cuts", "mean_ic", "t").agg(((F.count_if(F.abs("null_") >= F.abs("mean_ic") - 1e-12) + 1) / (F.count("null_") + 1)).alias("p_value"))
    return p if perms else obs.withColumn("p_value", F.lit(None).cast("double"))


def asymmetry_persistence(rets: DataFrame, market: DataFrame, estimate: int = 252, future: int = 63, least: int = 30) -> DataFrame:
    """(n_cuts, mean_ic, t): over non-overlapping cuts, rank correlation over entities of the asymmetry of the sessions before the cut
    with that of the sessions after."""
    j = rets.join(market, "date")
    days = rets.select("date").distinct()
    idx = stats.prefix_counts(days.withColumn("one_", F.lit(1)), "date", ["one_"]).select("date", F.col("one__before").alias("i_"))
    j = j.join(idx, "date")
    step = estimate + future
    j = j.withColumn("cut", F.floor(F.col("i_") / step)).withColumn("side", F.when(F.col("i_") % step < estimate, "past").otherwise("future"))
    down, up = F.col("market") < 0, F.col("market") > 0
    slope = lambda c: F.regr_slope(F.when(c, F.col("ret")), F.when(c, F.col("market")))
    a = j.groupBy("ticker", "cut", "side").agg((slope(down) - slope(up)).alias("a"), F.count_if(down).alias("d"), F.count_if(up).alias("u")).where((F.col("d") >= F.when(F.col("side") == "past", least).otherwise(least // 3)) & (F.col("u") >= F.when(F.col("side") == "past", least).otherwise(least // 3)))
    two = a.groupBy("ticker", "cut").agg(F.max(F.when(F.col("side") == "past", F.col("a"))).alias("past"), F.max(F.when(F.col("side") == "future", F.col("a"))).alias("future"))
    ic = stats.spearman(two, "past", "future", ["cut"]).where("ic is not null")
    return ic.agg(F.count("*").alias("n_cuts"), F.avg("ic").alias("mean_ic"), (F.avg("ic") / F.nullif(F.stddev_samp("ic") / F.sqrt(F.count("*")), F.lit(0.0))).alias("t"))


def direction_horizons(signals: DataFrame, abn: DataFrame, horizons: tuple[int, ...] = (1, 5, 20), folds: int = 6) -> DataFrame:
    """(horizon, side, n, auc, lo, hi): walk-forward logistic of the class at each horizon on the signal (ticker, date, signal).
    All horizons, sides and folds are fitted by the same aggregates."""
    from .labels import future_sessions
    from .volatility import out_of_sample

    f = future_sessions(abn, horizons).join(signals, ["ticker", "date"])
    cases = [F.struct(F.lit(h).alias("horizon"), F.lit(side).alias("side"), F.lit(f"{h} {side}").alias("case"), F.when(F.col(f"car_{h}").isNotNull() & (F.col(f"sigma_{h}") > 0), (F.col(f"car_{h}") * sign > 0.5 * F.col(f"sigma_{h}")).cast("double")).alias("y"))
             for h in horizons for side, sign in (("up", 1), ("down", -1))]
    rows = f.select("ticker", "date", "signal", F.explode(F.array(*cases)).alias("x")).select("ticker", "date", "signal", "x.*").where("y is not null")
    a = stats.auc(out_of_sample(rows, ["signal"], folds, group="case"), "p", "y", ["horizon", "side"])
    every = rows.sparkSession.createDataFrame([(h, s) for h in horizons for s in ("up", "down")], "horizon int, side string")
    return every.join(a, ["horizon", "side"], "left").select("horizon", "side", F.coalesce(F.col("n_pos") + F.col("n_neg"), F.lit(0)).alias("n"), "auc", "lo", "hi")


def feature_ablation(ds: DataFrame, xs: list[str], folds: int = 6) -> DataFrame:
    """(kind, features, n, auc, skill) out of sample: all, each alone, each left out, and one after another. The models of all
    sets and folds are fitted by the same aggregates."""
    from .volatility import out_of_sample

    sets = [("all", xs), *[("single", [x]) for x in xs], *[("without", [y for y in xs if y != x]) for x in xs if len(xs) > 1], *[("first", xs[: k + 1]) for k in range(1, len(xs) - 1)]]
    case = F.explode(F.array(*[F.struct(F.lit(f"{i}").alias("case"), F.lit(kind).alias("kind"), F.lit(", ".join(use)).alias("features")) for i, (kind, use) in enumerate(sets)])).alias("x")
    rows = ds.select("ticker", "date", "y", *xs, case).select("ticker", "date", "y", *xs, "x.*")
    o = written(out_of_sample(rows, xs, folds, group="case", use={f"{i}": use for i, (_, use) in enumerate(sets)}), "ablation")
    by = ["case", "kind", "features"]
    return stats.auc(o, "p", "y", by).join(stats.brier_skill(o, "p", "y", "base", by), by).select("kind", "features", "n", "auc", "skill")


def lagged_ic(signal: DataFrame, target: DataFrame, lags: tuple[int, ...] = (0, 1, 2), date: str = "date") -> DataFrame:
    """(theme, lag, n, ic): rank correlation of target (theme, date, ret) with signal (date, x), `lag` of the theme's rows later."""
    w = Window.partitionBy("theme").orderBy(date)
    parts = []
    for k in lags:
        t = target.withColumn("y_", F.lead("ret", k).over(w)).join(signal, date)
        parts.append(stats.spearman(t, "x", "y_", ["theme"]).select("theme", F.lit(k).alias("lag"), "n", "ic"))
    return reduce(DataFrame.unionByName, parts)


def gold_labels(df: DataFrame, rules: list[tuple[str, str, int]], title: str = "title") -> DataFrame:
    """df with gold (-1, 0, 1) and rule of the first pattern (name, pattern, label) that the normal title holds; others go."""
    t, name, label = norm(F.col(title)), F.lit(None).cast("string"), F.lit(None).cast("int")
    for n, p, v in reversed(rules):
        hit = t.rlike(p)
        name, label = F.when(hit, n).otherwise(name), F.when(hit, F.lit(v)).otherwise(label)
    return df.withColumn("rule", name).withColumn("gold", label).where("gold is not null")


def scorer_accuracy(gold: DataFrame, s: str = "s") -> DataFrame:
    """(rule, n, accuracy): neutral is right within .15 of zero, a side with its sign and .05 at least."""
    ok = F.when(F.col("gold") == 0, F.abs(s) < 0.15).otherwise((F.signum(s) == F.col("gold")) & (F.abs(s) >= 0.05))
    return gold.groupBy("rule").agg(F.count("*").alias("n"), F.avg(ok.cast("double")).alias("accuracy"))


def weighting_schemes(rows: DataFrame, target: DataFrame, schemes: dict[str, Column]) -> DataFrame:
    """(scheme, n, ic): signals of rows (ticker, date, s, ...) under several weights, to 9 places, against target (ticker, date, next_abn)."""
    many = rows.select("ticker", "date", "s", F.explode(F.array(*[F.struct(F.lit(k).alias("scheme"), v.cast("double").alias("w")) for k, v in schemes.items()])).alias("x")).select("ticker", "date", "s", "x.*").where("w > 0")
    z = many.groupBy("scheme", "ticker", "date").agg(F.round(F.sum(F.col("s") * F.col("w")) / F.sum("w"), 9).alias("z"))
    return stats.spearman(z.join(target, ["ticker", "date"]), "z", "next_abn", ["scheme"]).select("scheme", "n", "ic")


def combine_signals(legs: list[DataFrame], key: list[str] = ("ticker", "date")) -> DataFrame:
    """(key..., z): sum of the legs' z-scores by date over sqrt of their number; rows that all legs have. A leg: (key..., z)."""
    key = list(key)
    j = reduce(lambda a, b: a.join(b, key), [d.select(*key, F.col("z").alias(f"z{i}")) for i, d in enumerate(legs)])
    return j.select(*key, (sum((F.col(f"z{i}") for i in range(len(legs))), F.lit(0.0)) / F.sqrt(F.lit(float(len(legs))))).alias("z"))


def threshold_sweep(df: DataFrame, thresholds: list[float], p: str = "p", right: str = "right") -> DataFrame:
    """(threshold, n, coverage, accuracy, se, t): rows with p at or over each threshold; t against one half."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    g = df.select(p, right, t).groupBy("threshold").agg(F.count("*").alias("all_"), F.count_if(F.col(p) >= F.col("threshold")).alias("n"), F.avg(F.when(F.col(p) >= F.col("threshold"), F.col(right).cast("double"))).alias("accuracy"))
    se = F.sqrt(F.col("accuracy") * (1 - F.col("accuracy")) / F.nullif("n", F.lit(0)))
    return g.select("threshold", "n", (F.col("n") / F.col("all_")).alias("coverage"), "accuracy", se.alias("se"), ((F.col("accuracy") - 0.5) / F.nullif(se, F.lit(0.0))).alias("t"))
