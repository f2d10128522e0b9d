"""Logistic and least-squares models on distributed sums; meta-labels."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

_ARR = ArrayType(DoubleType())


@dataclass
class Logit:
    names: list[str]
    mean: np.ndarray
    sd: np.ndarray
    b: np.ndarray  # intercept first, in standardized space
    n: int
    base: float


def _moments(df: DataFrame, xs: list[str], y: str, fold: str) -> dict:
    aggs = [F.count("*").alias("n"), F.avg(y).alias("base")] + [f(x).alias(f"{k}_{i}") for i, x in enumerate(xs) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    return {r[fold]: r for r in df.groupBy(fold).agg(*aggs).collect()}  # a row a fold


def logit_fit_folds(df: DataFrame, xs: list[str], y: str, fold: str, lam: float = 1e-3, rounds: int = 80, stop: float = 1e-9, use: dict | None = None) -> dict:
    """One model a value of `fold`, all fitted at once: each Newton step is one aggregate of p (p + 3) / 2 + p sums a fold.

    Standardized by population deviation (1 where that is 0), the penalty on all coefficients, start at the log-odds.
    Pass a written df: it is read once a step. Rows with a null feature are left out. use: of a fold the features that its model has
    (all by default); the others' coefficients stay 0, so models of any subsets share the steps.
    """
    ok = df.select(fold, *xs, F.col(y).cast("double").alias("y_")).na.drop()
    mom = _moments(ok, xs, "y_", fold)
    k, models = len(xs) + 1, {}
    for f, r in mom.items():
        sd = np.array([r[f"s_{i}"] or 0.0 for i in range(len(xs))])
        b = np.zeros(k)
        b[0] = math.log(max(1e-6, r["base"]) / max(1e-6, 1 - r["base"]))
        models[f] = Logit(xs, np.array([r[f"m_{i}"] for i in range(len(xs))]), np.where(sd > 0, sd, 1.0), b, r["n"], r["base"])
    has = {f: [x in (use or {}).get(f, xs) for x in xs] for f in models}
    open_ = set(models)
    for _ in range(rounds):
        if not open_:
            break
        spark = df.sparkSession
        par = spark.createDataFrame([(f, m.b.tolist(), m.mean.tolist(), [s if h else math.inf for s, h in zip(m.sd.tolist(), has[f], strict=True)]) for f, m in models.items() if f in open_], ok.select(fold).schema.add("b_", _ARR).add("m_", _ARR).add("d_", _ARR))
        z = [F.lit(1.0)] + [(F.col(x) - F.col("m_")[i]) / F.col("d_")[i] for i, x in enumerate(xs)]  # 0 for a feature that the model lacks
        t = ok.join(F.broadcast(par), fold).select(fold, "y_", "b_", *[c.alias(f"z{i}") for i, c in enumerate(z)])  # a row a fold
        eta = sum((F.col("b_")[i] * F.col(f"z{i}") for i in range(k)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), eta))))
        t = t.withColumn("p_", p).withColumn("w_", F.greatest(F.lit(1e-9), F.col("p_") * (1 - F.col("p_"))))
        aggs = [F.sum((F.col("p_") - F.col("y_")) * F.col(f"z{i}")).alias(f"g{i}") for i in range(k)]
        aggs += [F.sum(F.col("w_") * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        for r in t.groupBy(fold).agg(*aggs).collect():
            m = models[r[fold]]
            h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + lam * np.eye(k)
            step = np.linalg.solve(h, np.array([r[f"g{i}"] for i in range(k)]) + lam * m.b)
            m.b = m.b - step
            if np.abs(step).max() < stop:
                open_.discard(r[fold])
    return models


def logit_fit(df: DataFrame, xs: list[str], y: str, lam: float = 1e-3) -> Logit:
    return logit_fit_folds(df.withColumn("one_", F.lit(0)), xs, y, "one_", lam)[0]


def logit_predict(m: Logit) -> Column:
    eta = F.lit(float(m.b[0]))
    for name, b, mu, sd in zip(m.names, m.b[1:], m.mean, m.sd, strict=True):
        eta = eta + (F.col(name) - float(mu)) / float(sd) * float(b)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), eta))))


def params(spark, models: dict, fold: str, kind: str = "string") -> DataFrame:
    """(fold, b, mean, sd, base) of models, a row each; features a model lacks have coefficient 0."""
    rows = [(f, m.b.tolist(), m.mean.tolist(), m.sd.tolist(), float(m.base)) for f, m in models.items()]
    return spark.createDataFrame(rows, f"{fold} {kind}, b array<double>, mean array<double>, sd array<double>, base double")


def predict_from(xs: list[str], b: Column, mean: Column, sd: Column) -> Column:
    """Probability by the parameters that stand in a row's own columns."""
    eta = b[0]
    for i, x in enumerate(xs):
        eta = eta + (F.col(x) - mean[i]) / sd[i] * b[i + 1]
    return 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), eta))))


def predict_by_fold(df: DataFrame, models: dict, fold: str, out: str = "p") -> DataFrame:
    """df with out, the prediction of the model of its row's fold, and base, that model's training rate (null for none)."""
    xs = next(iter(models.values())).names if models else []
    par = params(df.sparkSession, models, fold, dict(df.dtypes)[fold]).withColumnsRenamed({"b": "b_", "mean": "m_", "sd": "d_"})
    p = predict_from(xs, F.col("b_"), F.col("m_"), F.col("d_")) if models else F.lit(None).cast("double")
    return df.join(F.broadcast(par), fold, "left").withColumn(out, p).drop("b_", "m_", "d_")  # a row a fold


def least_squares(df: DataFrame, xs: list[str], y: str) -> np.ndarray:
    """Coefficients (intercept first) from the sums of products."""
    z = [F.lit(1.0), *[F.col(x) for x in xs]]
    k = len(z)
    r = df.select(*xs, y).na.drop().agg(*[F.sum(z[i] * z[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(k)], *[F.sum(z[i] * F.col(y)).alias(f"g{i}") for i in range(k)]).first()
    return np.linalg.lstsq(np.array([[r[f"h{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)]), np.array([r[f"g{i}"] or 0.0 for i in range(k)]), rcond=None)[0]


META = ["abs_z", "vol_pred", "vol_real", "dispersion", "n_eff"]


def meta_features(df: DataFrame) -> DataFrame:
    return df.withColumn("abs_z", F.abs("z")).withColumn("n_eff", F.least(F.col("n_eff"), F.lit(8.0)))


def metalabel_fit(df: DataFrame, right: str = "right", least: int = 400) -> Logit | None:
    """Model of whether the primary signal was right; None under `least` rows."""
    rows = meta_features(df)
    return logit_fit(rows, META, right) if rows.count() >= least else None


def metalabel_gate(df: DataFrame, model: Logit, least: float = 0.58) -> DataFrame:
    """df with meta_p and take (meta_p >= least)."""
    n = df.withColumn("raw_n_", F.col("n_eff"))
    return meta_features(n).withColumn("meta_p", logit_predict(model)).withColumn("take", F.col("meta_p") >= least).withColumn("n_eff", F.col("raw_n_")).drop("raw_n_", "abs_z")
