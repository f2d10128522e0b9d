"""Volatility head: features, expanding thresholds, walk-forward calibrator, bands, target variants."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..sources.sinks import written
from .calendars import risk_flag
from .models import Logit, least_squares, logit_fit, logit_fit_folds, logit_predict, predict_by_fold, predict_from

FEATURES = ["abs_ret", "vol5", "vol20", "macro_vol", "event"]
GATES = {"n": 500, "auc": 0.55, "skill": 0.01}


def features(abn: DataFrame, macro: DataFrame, key: str = "ticker", date: str = "date") -> DataFrame:
    """(key, date, target_date, abn, next_abs, features...) known at the close of date: from the 22nd session on, with 15
    of the last 20 sessions at least. event: the target session is a scheduled risk day."""
    w = Window.partitionBy(key).orderBy(date)
    at = lambda n: w.rowsBetween(-(n - 1), 0)
    x = abn.select(key, date, "abn", F.row_number().over(w).alias("i_"), F.abs("abn").alias("abs_ret"), F.stddev_pop("abn").over(at(5)).alias("vol5"), F.stddev_pop("abn").over(at(20)).alias("vol20"),
                   F.count("abn").over(at(20)).alias("n_"), F.lead(date).over(w).alias("target_date"), F.lead(F.abs("abn")).over(w).alias("next_abs"))
    x = x.where("i_ >= 22 and n_ >= 15").join(macro.select(date, "macro_vol"), date, "left")
    return x.select(key, date, "target_date", "abn", "next_abs", "abs_ret", "vol5", "vol20", F.coalesce("macro_vol", F.lit(0.0)).alias("macro_vol"), F.coalesce(risk_flag(F.col("target_date")), F.lit(0.0)).alias("event"))


def expanding_threshold(abn: DataFrame, q: float = 0.8, least: int = 40, key: str = "ticker", date: str = "date") -> DataFrame:
    """(key, date, threshold): of the |abn| up to date the value at index int(q (n - 1)); null under `least` of them."""
    rows = abn.select(key, date, F.abs("abn").alias("v_"))
    got = stats.running_order(rows, key, date, "v_", {"threshold": lambda n: F.floor(q * (n - 1))})
    return got.select(key, date, F.when(F.col("n") >= least, F.col("threshold")).alias("threshold"))


def dataset(abn: DataFrame, macro: DataFrame, q: float = 0.8, least: int = 40, key: str = "ticker", date: str = "date") -> DataFrame:
    """features with y: the next session's |abn| is over the threshold of date."""
    f = features(abn, macro, key, date)
    t = expanding_threshold(abn, q, least, key, date).where("threshold is not null")
    return f.join(t, [key, date]).where("next_abs is not null").withColumn("y", (F.col("next_abs") > F.col("threshold")).cast("double"))


def walk_forward_folds(ds: DataFrame, folds: int = 6, date: str = "date", group: str | None = None) -> DataFrame:
    """(fold, role, row...): fold k = 1.. trains on the dates before its cut and tests on those up to the next. With group, each
    group has cuts of its own dates."""
    by = F.col(group) if group else F.lit(0)
    dates: dict = {}
    for g, d in ds.select(by.alias("g_"), date).distinct().collect():  # sessions: some thousands a group
        dates.setdefault(g, []).append(d)
    spec = []
    for g, ds_ in dates.items():
        ds_ = sorted(ds_)
        cuts = [ds_[len(ds_) * k // folds] for k in range(1, folds)]
        spec += [(g, k, c, cuts[k] if k < len(cuts) else None) for k, c in enumerate(cuts, 1)]
    kind, of = dict(ds.dtypes)[date], dict(ds.dtypes)[group] if group else "int"
    cut = ds.sparkSession.createDataFrame(spec, f"g_ {of}, fold int, cut_ {kind}, next_ {kind}")
    out = ds.withColumn("g_", by).join(F.broadcast(cut), "g_").where(F.col("next_").isNull() | (F.col(date) < F.col("next_")))  # a row a group and fold
    return out.withColumn("role", F.when(F.col(date) >= F.col("cut_"), "test").otherwise("train")).drop("g_", "cut_", "next_")


def out_of_sample(ds: DataFrame, xs: list[str] = FEATURES, folds: int = 6, min_events: int = 10, group: str | None = None, use: dict | None = None) -> DataFrame:
    """Test rows of all folds with p (the fold's model) and base (the training rate).

    With group (a text column), each group has folds and models of its own, of the features that use names for it. The models
    of all groups and folds are fitted by the same aggregates, so more groups mean no more jobs.
    """
    name = F.concat_ws(":", F.col(group), F.col("fold").cast("string")) if group else F.col("fold").cast("string")
    wf = written(walk_forward_folds(ds, folds, group=group).withColumn("model_", name), "walk-forward")
    train = wf.where("role = 'train'")
    enough = train.groupBy("model_").agg(F.sum("y").alias("s")).where(F.col("s") >= min_events).select("model_")
    wf = wf.join(F.broadcast(enough), "model_")  # a row a model
    of = {f"{g}:{k}": x for g, x in (use or {}).items() for k in range(1, folds)}
    models = logit_fit_folds(wf.where("role = 'train'"), xs, "y", "model_", use=of)
    return predict_by_fold(wf.where("role = 'test'"), models, "model_").drop("model_")


def _failed(m: dict, gates: dict) -> list[str]:
    """The gates that metrics don't pass."""
    least = {"auc_lo": 0.5} | gates
    auc = (m["auc"] or 0) < least["auc"] or (m["auc_lo"] or 0) <= least["auc_lo"]
    return [k for k, bad in (("n", (m["n_oos"] or 0) < least["n"]), ("auc", auc), ("skill", (m["skill"] or 0) < least["skill"])) if bad]


MODELS = """name string, feature_version int, asof date, n long, n_oos long, base_oos double, auc double, auc_lo double, auc_hi double, brier double, skill double, max_gap double,
  calibrated boolean, failed array<string>, b array<double>, mean array<double>, sd array<double>"""
FEATURE_VERSION = 1


def fit_versions(ds: DataFrame, asofs: list, xs: list[str] = FEATURES, folds: int = 6, gates: dict = GATES, name: str = "volatility", version: int = FEATURE_VERSION) -> DataFrame:
    """A model table (MODELS), a row a date of asofs: what a calibrator fitted then is, and what it is worth.

    Version `asof` knows the rows whose target_date is not after it. Its metrics are out of sample over walk-forward folds of those
    rows; its parameters are fitted on all of them, and calibrated says whether every gate holds (failed names those that don't;
    "sample": too few rows for parameters). All versions and folds share the aggregates.
    """
    from .evaluate import reliability

    spark = ds.sparkSession
    dates = spark.createDataFrame([(a,) for a in sorted(set(asofs))], "asof date")
    rows = written(ds.join(F.broadcast(dates), F.col("target_date") <= F.col("asof")).withColumn("version_", F.col("asof").cast("string")), "versions")  # a row a version
    n = {r[0]: r[1] for r in rows.groupBy("version_").count().collect()}
    ok = [v for v, k in n.items() if k >= 2 * gates["n"]]
    enough = rows.where(F.col("version_").isin(ok))
    oos = written(out_of_sample(enough, xs, folds, group="version_"), "out-of-sample")
    a = {r["version_"]: r for r in stats.auc(oos, "p", "y", ["version_"]).collect()}
    b = {r["version_"]: r for r in stats.brier_skill(oos, "p", "y", "base", ["version_"]).join(oos.groupBy("version_").agg(F.avg("y").alias("rate")), "version_").collect()}
    gap = {r[0]: r[1] for r in reliability(oos, "p", "y", by=["version_"]).where("n >= 20").groupBy("version_").agg(F.max(F.abs(F.col("p_mean") - F.col("rate")))).collect()}
    models, out = logit_fit_folds(enough, xs, "y", "version_"), []
    for d in sorted(set(asofs)):
        v = str(d)
        m = {"n": n.get(v, 0), "n_oos": b[v]["n"] if v in b else 0, "base_oos": b[v]["rate"] if v in b else None, "brier": b[v]["brier"] if v in b else None, "skill": b[v]["skill"] if v in b else None, "max_gap": gap.get(v)}
        m |= {"auc": a[v]["auc"], "auc_lo": a[v]["lo"], "auc_hi": a[v]["hi"]} if v in a else {"auc": None, "auc_lo": None, "auc_hi": None}
        failed = _failed(m, gates) if v in models else ["sample"]
        par = [x.tolist() for x in (models[v].b, models[v].mean, models[v].sd)] if v in models else [None] * 3
        out.append((name, version, d, m["n"], m["n_oos"], m["base_oos"], m["auc"], m["auc_lo"], m["auc_hi"], m["brier"], m["skill"], m["max_gap"], not failed, failed, *par))
    return spark.createDataFrame(out, MODELS)


def with_version(rows: DataFrame, models: DataFrame, date: str = "date", name: str = "volatility", version: int = FEATURE_VERSION) -> DataFrame:
    """rows with the columns of the last version at or before their date, as m_...; null where there is none. Versions of other
    features don't count. The table has a row a version."""
    mine = models.where((F.col("name") == name) & (F.col("feature_version") == version))
    until = F.lead("asof").over(Window.partitionBy("name").orderBy("asof"))
    known = mine.withColumn("until", until).select(*[F.col(c).alias("m_" + c) for c in (*models.columns, "until")])
    return rows.join(F.broadcast(known), (F.col(date) >= F.col("m_asof")) & (F.col("m_until").isNull() | (F.col(date) < F.col("m_until"))), "left")


def vol_head_asof(latest: DataFrame, models: DataFrame, xs: list[str] = FEATURES, date: str = "date", name: str = "volatility", version: int = FEATURE_VERSION) -> DataFrame:
    """vol_head with the model table's version as of each row's date: p_vol, vol_base and vol_calib 1 where that version is
    calibrated and the features are known, else the ordinal score. So no row is scored by a model fitted later."""
    got = with_version(vol_head(latest), models, date, name, version)
    p = F.when(F.col("m_calibrated"), predict_from(xs, F.col("m_b"), F.col("m_mean"), F.col("m_sd")))
    got = got.withColumn("p_", p).withColumns({"p_vol": F.round("p_", 4), "vol_base": F.when(F.col("p_").isNotNull(), F.col("m_base_oos")), "vol_calib": F.col("p_").isNotNull().cast("int"), "vol_score": F.coalesce("p_", "vol_score")})
    return got.withColumnRenamed("m_asof", "model_asof").drop("p_", *[c for c in got.columns if c.startswith("m_") and c != "m_asof"])


def fit_calibrator(ds: DataFrame, xs: list[str] = FEATURES, folds: int = 6, gates: dict = GATES) -> tuple[dict, Logit | None]:
    """(metrics, model): AUC with its interval, Brier skill and largest decile gap out of sample; the model, fitted on all
    rows, only if every gate holds (metrics['failed'] lists those that don't)."""
    last = ds.agg(F.max("target_date")).first()[0]
    if last is None:
        return {"n": 0, "calibrated": False, "failed": ["sample"]}, None
    r = fit_versions(ds, [last], xs, folds, gates).first()
    if r["failed"] == ["sample"]:
        return {"n": r["n"], "calibrated": False, "failed": ["sample"]}, None
    m = {k: r[k] for k in ("n", "n_oos", "auc", "auc_lo", "auc_hi", "brier", "skill", "max_gap", "calibrated", "failed")}
    rate = ds.na.drop(subset=[*xs, "y"]).agg(F.avg("y")).first()[0]
    return m, Logit(xs, np.array(r["mean"]), np.array(r["sd"]), np.array(r["b"]), r["n"], rate) if r["calibrated"] else None


def vol_head(latest: DataFrame, model: Logit | None = None, base: float | None = None) -> DataFrame:
    """latest (features..., threshold, n_eff, dispersion) with p_vol and vol_calib 1 from a passed model, else the ordinal vol_score:
    (.5 today + .3 five-day + .2 twenty-day) / threshold, up to 20 % more with evidence and 5 % with dispersion."""
    if model is not None:
        p = F.round(logit_predict(model), 4)
        return latest.withColumns({"p_vol": p, "vol_base": F.lit(base).cast("double"), "vol_calib": F.lit(1), "vol_score": p})
    ratio = (0.5 * F.col("abs_ret") + 0.3 * F.col("vol5") + 0.2 * F.col("vol20")) / F.nullif("threshold", F.lit(0.0))
    score = F.round(ratio * (1 + 0.05 * F.least(F.coalesce("n_eff", F.lit(0.0)), F.lit(4.0)) + 0.05 * F.least(F.coalesce("dispersion", F.lit(0.0)), F.lit(1.0))), 6)
    null = F.lit(None).cast("double")
    return latest.withColumns({"p_vol": null, "vol_base": null, "vol_calib": F.lit(0), "vol_score": score})


def bands(scores: DataFrame, by: str = "asof", score: str = "vol_score", key: str = "ticker") -> DataFrame:
    """scores with vol_rank (1 = most) and vol_band: thirds of each instant's entities."""
    r = F.row_number().over(Window.partitionBy(by).orderBy(F.col(score).desc(), key))
    n = F.count("*").over(Window.partitionBy(by))
    x = scores.where(F.col(score).isNotNull()).withColumn("vol_rank", r).withColumn("n_", n)
    return x.withColumn("vol_band", F.when(F.col("vol_rank") - 1 < F.col("n_") / 3, "high").when(F.col("vol_rank") - 1 < 2 * F.col("n_") / 3, "medium").otherwise("low")).drop("n_")


def target_variants(ds: DataFrame, split: float = 0.6, quantiles: tuple[float, ...] = (0.5, 0.8, 0.9), date: str = "date", key: str = "ticker") -> DataFrame:
    """(variant, n, auc, ic, r2) on one split by date: next |abn| over the entity's past median, over training quantiles
    (logistic, AUC), and itself (least squares, rank correlation and out-of-sample R2)."""
    both = stats.running_order(ds.select(key, date, "abs_ret"), key, date, "abs_ret", {"lo_": lambda n: F.floor((n - 1) / 2), "hi_": lambda n: F.ceil((n - 1) / 2)})
    d = ds.join(both.select(key, date, ((F.col("lo_") + F.col("hi_")) / 2).alias("med_")), [key, date])
    cut = d.select(F.percentile(F.datediff(date, F.lit("1970-01-01")), split)).first()[0]
    day = F.datediff(date, F.lit("1970-01-01"))
    d = written(d, "variants")
    train, test = d.where(day < cut), d.where(day >= cut)
    spark, rows = ds.sparkSession, []
    qs = train.select(F.percentile("next_abs", list(quantiles))).first()[0]
    for name, y in [("expanding median", F.col("next_abs") > F.col("med_")), *[(f"quantile {q}", F.col("next_abs") > F.lit(float(v))) for q, v in zip(quantiles, qs, strict=True)]]:
        m = logit_fit(train.withColumn("t_", y.cast("double")), FEATURES, "t_")
        a = stats.auc(test.withColumn("t_", y.cast("double")).withColumn("p", logit_predict(m)), "p", "t_").first()
        rows.append((name, a["n_pos"] + a["n_neg"], a["auc"], None, None))
    c = least_squares(train, FEATURES, "next_abs")
    fit = F.lit(float(c[0]))
    for x, b in zip(FEATURES, c[1:], strict=True):
        fit = fit + F.col(x) * float(b)
    got, mean = test.withColumn("p", fit), train.agg(F.avg("next_abs")).first()[0]
    ic = stats.spearman(got, "p", "next_abs").first()
    r2 = got.agg((1 - F.sum(F.pow(F.col("next_abs") - F.col("p"), 2)) / F.sum(F.pow(F.col("next_abs") - F.lit(mean), 2)))).first()[0]
    rows.append(("continuous", ic["n"], None, ic["ic"], r2))
    return spark.createDataFrame(rows, "variant string, n long, auc double, ic double, r2 double")
