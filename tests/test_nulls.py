"""Permutation nulls against plain Python, on planted effects and on noise."""

import datetime as dt

import numpy as np
import pytest

from tidewire.operators import evaluate


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def ranks(v):
    v = np.asarray(v)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def panel(spark, m, names=None, drop=()):
    rows = [(names[k] if names else f"e{k:02}", day(i), float(m[i, k])) for i in range(m.shape[0]) for k in range(m.shape[1]) if (i, k) not in drop]
    return spark.createDataFrame(rows, "ticker string, date date, ret double")


@pytest.mark.parametrize("planted", [True, False])
def test_leadlag(spark, planted):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(161, 9)).round(2)
    if planted:
        m[1:, 3] = m[:-1, 0] + rng.normal(size=160) * 0.3
    drop = {(80, 5)}  # so session 80 is not common
    r = evaluate.leadlag_null(panel(spark, m, drop=drop), perms=60, block=8, side=4).first()
    use = np.delete(m, 80, axis=0)
    z = [ranks(use[:, k]) for k in range(9)]
    ics = [np.corrcoef(z[a][:-1], z[b][1:])[0, 1] for a in range(9) for b in range(9) if a != b]
    assert (r.n_pairs, r.sessions) == (72, 160) and np.allclose((r.mean_ic, r.sd_ic, r.max_ic), (np.mean(ics), np.std(ics), np.max(np.abs(ics))))
    assert 0.9 * 1.96 / 160**0.5 < r.null_p95 < 1.15 * 1.96 / 160**0.5 and abs(r.null_sd * 160**0.5 - 1) < 0.15
    assert abs(r.share_over - np.mean(np.abs(ics) > r.null_p95)) < 0.03
    if planted:
        assert r.max_ic > 0.8 and r.p_max == pytest.approx(1 / 61) and r.ratio > 1.3
    else:
        assert r.p_max > 0.03 and 0.7 < r.ratio < 1.3
    again = evaluate.leadlag_null(panel(spark, m, drop=drop), perms=60, block=8, side=4).first()
    assert again.null_sd == pytest.approx(r.null_sd) and again.p_max == r.p_max


def test_leadlag_shuffles_blocks(spark):
    """A series that repeats within blocks keeps its own lag under the shuffle, so the null is as wide as what is seen."""
    base = np.repeat(np.random.default_rng(2).normal(size=(20, 1)), 10, axis=0)
    m = np.c_[base + np.random.default_rng(3).normal(size=(200, 1)) * 0.01, base + np.random.default_rng(4).normal(size=(200, 1)) * 0.01]
    r = evaluate.leadlag_null(panel(spark, m), perms=40, block=10).first()
    assert r.max_ic > 0.8 and r.null_sd > 0.15  # twenty blocks decide, not two hundred sessions


def surprises(seed, effect, tickers=30, days=240, events=40):
    rng = np.random.default_rng(seed)
    x = {i: rng.normal() for i in range(3, days, days // events)}
    load = rng.normal(size=tickers) * effect
    return [(f"t{k}", day(i), float(rng.normal() + load[k] * x.get(i, 0))) for k in range(tickers) for i in range(days) if rng.random() < 0.95], x


def dispersion(abn, x, least=8):
    betas = []
    for t in {r[0] for r in abn}:
        mine = [(x[d], y) for k, d, y in abn if k == t and d in x]
        a, y = np.array([p[0] for p in mine]), np.array([p[1] for p in mine])
        if len(mine) >= least and ((a - a.mean()) ** 2).sum() > 0:
            betas.append(((a - a.mean()) * (y - y.mean())).sum() / ((a - a.mean()) ** 2).sum())
    return np.std(betas) if betas else None


@pytest.mark.parametrize("effect", [1.0, 0.0])
def test_dispersion_nulls(spark, effect):
    abn, x = surprises(5, effect)
    df = spark.createDataFrame(abn, "ticker string, date date, abn double")
    ev = spark.createDataFrame([(day(i), float(v)) for i, v in x.items()], "date date, surprise double")
    real = dispersion(abn, {day(i): v for i, v in x.items()})
    p = evaluate.permutation_dispersion(df, ev, 80).first()
    c = evaluate.random_day_control(df, ev, 80).first()
    assert p.dispersion == pytest.approx(real) and c.dispersion == pytest.approx(real)
    if effect:
        assert p.p_value == pytest.approx(1 / 81) and c.share_above == 0 and real > 2 * c.control_p95
    else:
        assert p.p_value > 0.03 and c.share_above > 0.02 and 0.7 < real / c.control_mean < 1.4 and p.null_p95 > c.control_mean


def test_dispersion_under(spark):
    """Every draw against slopes one by one, over several blocks; days without returns, a constant draw and too few days included."""
    abn, x = surprises(6, 0.5, tickers=11, days=60, events=20)
    draws = [(p, day(i), float(np.random.default_rng([p, i]).normal()) if p != 3 else 1.0) for p in range(5) for i in list(x)[: 5 if p == 4 else 20]] + [(0, day(900), 2.0)]
    got = {r.perm: r.dispersion for r in evaluate.dispersion_under(spark.createDataFrame(abn, "ticker string, date date, abn double"), spark.createDataFrame(draws, "perm int, date date, x double"), 8, side=4).collect()}
    want = {p: dispersion(abn, {d: v for q, d, v in draws if q == p}) for p in range(5)}
    assert set(got) == {p for p, v in want.items() if v is not None} == {0, 1, 2}
    assert all(got[p] == pytest.approx(want[p]) for p in got)


@pytest.mark.parametrize(("step", "lasting"), [(None, True), (10, True), (None, False)])
def test_asymmetry_walk(spark, step, lasting):
    rng = np.random.default_rng(8)
    days, names = 330, [f"t{k}" for k in range(12)]
    mkt = rng.normal(size=days)
    down, up = rng.normal(size=12), rng.normal(size=12)
    rets = []
    for i in range(days):
        if not lasting and i % 40 == 0:
            down, up = rng.normal(size=12), rng.normal(size=12)
        rets += [(n, day(i), float((down[k] if mkt[i] < 0 else up[k]) * mkt[i] + rng.normal() * 0.3)) for k, n in enumerate(names) if rng.random() < 0.97 and not (k == 11 and i > 150)]
    got = evaluate.asymmetry_walk(spark.createDataFrame(rets, "ticker string, date date, ret double"), spark.createDataFrame([(day(i), float(v)) for i, v in enumerate(mkt)], "date date, market double"), 80, 40, step, 15, 60).first()

    def asym(t, a, b, least):
        out = []
        for side in (-1, 1):
            p = [(mkt[i], y) for i in range(a, b) if mkt[i] * side > 0 for y in [by.get((t, i))] if y is not None]
            if len(p) < least:
                return None
            out.append(np.polyfit(*np.array(p).T, 1)[0])
        return out[0] - out[1]

    by = {(t, (d - day(0)).days): y for t, d, y in rets}
    ics = []
    for i in range(80, days - 40, step or 40):
        two = [(a, b) for t in names for a in [asym(t, i - 80, i, 15)] for b in [asym(t, i, i + 40, 5)] if a is not None and b is not None]
        if len(two) >= 5:
            ics.append(np.corrcoef(ranks([a for a, _ in two]), ranks([b for _, b in two]))[0, 1])
    assert got.n_cuts == len(ics) and got.mean_ic == pytest.approx(np.mean(ics)) and got.t == pytest.approx(np.mean(ics) / (np.std(ics) / len(ics) ** 0.5))
    assert got.p_value == pytest.approx(1 / 61) if lasting else got.p_value > 0.03
