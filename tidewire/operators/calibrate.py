"""Calibration of signals to probabilities: isotonic, Platt, direction gate, shrinkage.

Fits run on distinct signal values with their counts (a signal has four decimals within -1..1, so 20 001 rows at most,
which is checked); the counts are distributed aggregates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config

MOST_VALUES = 200_000


def compress(df: DataFrame, x: str, ys: list[str]) -> np.ndarray:
    """Rows (x, n, sum of each y) of the distinct x, ascending."""
    g = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count("*").alias("n_"), *[F.sum(F.col(y).cast("double")).alias("s_" + y) for y in ys]).limit(MOST_VALUES + 1)
    rows = g.collect()
    if len(rows) > MOST_VALUES:
        raise ValueError(f"over {MOST_VALUES} distinct values of {x}: round it first")
    return np.array(sorted(tuple(r) for r in rows), float).reshape(-1, 2 + len(ys))


def pava(x: np.ndarray, n: np.ndarray, s: np.ndarray) -> list[tuple[float, float]]:
    """Knots of the increasing fit of means s/n at distinct ascending x: two a block (its ends)."""
    blocks: list[list[float]] = []
    for xi, w, t in zip(x, n, s, strict=True):
        blocks.append([t / w, w, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0] + 1e-12:
            v, w2, lo, hi = blocks.pop()
            u, w1, lo1, _ = blocks.pop()
            blocks.append([(u * w1 + v * w2) / (w1 + w2), w1 + w2, lo1, hi])
    return [(float(p), float(v)) for v, _, lo, hi in blocks for p in ((lo, hi) if hi > lo else (lo,))]


def fit_isotonic(df: DataFrame, x: str, y: str) -> list[tuple[float, float]]:
    c = compress(df, x, [y])
    return pava(c[:, 0], c[:, 1], c[:, 2])


def predict_isotonic(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear between knots, constant beyond; null without knots."""
    if not knots:
        return F.lit(None).cast("double")

    kx, ky = np.array([k[0] for k in knots]), np.array([k[1] for k in knots])

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(np.interp(v, kx, ky)).where(v.notna().to_numpy(), None)

    return run(x)


def platt(x: np.ndarray, n: np.ndarray, s: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(a, b) of P = 1 / (1 + exp(-(a x + b))) by reweighted least squares on sums over distinct x: n rows, s of them hits."""
    design = np.stack([x, np.ones(len(x))], axis=1)
    hits = s.sum()
    coef = np.array([0.0, math.log(max(1e-6, hits) / max(1e-6, n.sum() - hits))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ coef, -35, 35)))
        weight = n * np.maximum(1e-9, p * (1 - p))
        step = np.linalg.solve(design.T @ (design * weight[:, None]) + 1e-6 * np.eye(2), design.T @ (s - n * p))
        coef += step
        if np.abs(step).max() < 1e-10:
            break
    return float(coef[0]), float(coef[1])


def fit_platt(df: DataFrame, x: str, y: str) -> tuple[float, float]:
    c = compress(df, x, [y])
    return platt(c[:, 0], c[:, 1], c[:, 2])


def predict_platt(x: Column, ab: tuple[float, float]) -> Column:
    z = F.greatest(F.lit(-35.0), F.least(F.lit(35.0), x * ab[0] + ab[1]))
    return 1 / (1 + F.exp(-z))


@dataclass
class Direction:
    """Outcome of a calibration attempt; up and down hold parameters only where it passed."""

    method: str
    n: int
    passed: bool = False
    reason: str = ""
    metrics: dict = field(default_factory=dict)
    up: object = None
    down: object = None


def fit_direction(pairs: DataFrame, method: str = "platt", min_n: int = config.MIN_CALIBRATION, min_skill: float = config.MIN_SKILL) -> Direction:
    """Fit P(up | z) and P(down | -z) on pairs (z, cls); passes with a Brier skill over min_skill on both sides."""
    rows = pairs.select("z", (F.col("cls") == 1).cast("double").alias("up"), (F.col("cls") == -1).cast("double").alias("down"))
    c = compress(rows, "z", ["up", "down"])
    total = int(c[:, 1].sum())
    out = Direction(method, total)
    if total < min_n:
        out.reason = f"sample: {total} labelled pairs, {min_n} needed"
        return out
    got = {}
    for side, sign, s in (("up", 1, c[:, 2]), ("down", -1, c[:, 3])):
        x, n = sign * c[:, 0], c[:, 1]
        order = np.argsort(x, kind="stable")
        x, n, s = x[order], n[order], s[order]
        if method == "platt":
            got[side] = platt(x, n, s)
            p = 1 / (1 + np.exp(-np.clip(got[side][0] * x + got[side][1], -35, 35)))
        else:
            got[side] = pava(x, n, s)
            p = np.interp(x, [k[0] for k in got[side]], [k[1] for k in got[side]])
        base = s.sum() / total
        brier, ref = ((n * p * p - 2 * p * s + s).sum() / total, base * (1 - base))
        out.metrics |= {f"brier_{side}": brier, f"brier_{side}_base": ref, f"skill_{side}": 1 - brier / ref if ref else 0.0}
    out.passed = all(out.metrics[f"skill_{k}"] > min_skill for k in ("up", "down"))
    if out.passed:
        out.up, out.down = got["up"], got["down"]
    else:
        out.reason = "skill: " + ", ".join(f"{k} {out.metrics[f'skill_{k}']:+.4f}" for k in ("up", "down"))
    return out


def probabilities(signals: DataFrame, fit: Direction, k: float = config.SHRINK) -> DataFrame:
    """signals (z, n_eff, base_up, base_flat, base_down) with p_up, p_flat, p_down, calibrated.

    Shrunk to the base rates by n_eff / (n_eff + k); scaled down where up and down exceed 1. Null without a passed fit."""
    if not fit.passed:
        return signals.withColumns({p: F.lit(None).cast("double") for p in ("p_up", "p_flat", "p_down")} | {"calibrated": F.lit(0)})
    apply = predict_platt if fit.method == "platt" else predict_isotonic
    w = F.col("n_eff") / (F.col("n_eff") + k)
    t = signals.withColumn("u_", w * apply(F.col("z"), fit.up) + (1 - w) * F.col("base_up")).withColumn("d_", w * apply(-F.col("z"), fit.down) + (1 - w) * F.col("base_down"))
    s = F.greatest(F.lit(1.0), F.col("u_") + F.col("d_"))
    up, down = F.col("u_") / s, F.col("d_") / s
    return t.withColumns({"p_up": F.round(up, 4), "p_flat": F.round(F.greatest(F.lit(0.0), 1 - up - down), 4), "p_down": F.round(down, 4), "calibrated": F.lit(1)}).drop("u_", "d_")
