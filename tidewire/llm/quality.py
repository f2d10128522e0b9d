"""Quality classifier from weak labels: EM over overlapping heuristic labellers, then a hashed linear scorer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fresh, table
from .pieces import parts

SAMPLE = 2048  #: at most about so many documents train the scorer (chosen by hash over the whole table)
DIMS = 2048  #: hashed features
GRAM = 4  #: longest run of character classes that is a feature
THRESHOLD = 0.5  #: a document is kept if its score is at least this

# ---- text statistics ------------------------------------------------------------------------------

_SPACE, _LOWER, _UPPER, _DIGIT, _END, _SYMBOL, _OTHER = range(7)
_CLASS = np.full(256, _LOWER, np.uint8)  # bytes of letters beyond ASCII count as lower case
_CLASS[:128] = [
    _SPACE if chr(c).isspace() else _UPPER if chr(c).isupper() else _LOWER if chr(c).islower() else _DIGIT if chr(c).isdigit() else _END if chr(c) in ".,;:!?" else _SYMBOL if chr(c) in "#$%&*+/<=>@\\^_`{|}~" else _OTHER
    for c in range(128)
]
STATS = ("words", "symbols", "capitals", "same", "distinct", "ends", "length", "bare")


def statistics(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Shares that the labellers judge by (see STATS), and the text's runs of character classes."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros(len(STATS)), np.zeros(0, np.uint8)
    cls = _CLASS[np.frombuffer(raw, np.uint8)]
    count = np.bincount(cls, minlength=7)
    seen, letters = max(1, len(raw) - count[_SPACE]), max(1, count[_LOWER] + count[_UPPER])
    runs = cls[np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])]
    after = np.r_[runs[1:], _SPACE]
    ends = int(((runs != _SPACE) & (runs != _LOWER) & (runs != _UPPER) & (runs != _DIGIT) & (after == _SPACE)).sum())
    before = np.r_[_SPACE, runs[:-1]]
    bare = int(((before == _SPACE) & (after == _SPACE) & np.isin(runs, (_END, _SYMBOL, _OTHER))).sum())
    same = sum(map(bytes.__eq__, words, words[1:]))
    return np.array([n, count[_SYMBOL] / seen, count[_UPPER] / letters, same / n, len(set(words)) / n, ends / n, seen / n, bare / n]), runs


def votes(s: np.ndarray) -> list[int]:
    """One vote a labeller: 1 good, 0 bad, 2 no opinion."""
    n, symbols, capitals, same, distinct, ends, length, bare = s

    def say(good: bool, bad: bool) -> int:
        return 0 if bad else 1 if good else 2

    return [
        say(symbols < 0.02, symbols > 0.08),
        say(capitals < 0.15, capitals > 0.4 and n > 3),
        say(same < 0.02 and n >= 20, same > 0.2),
        say(distinct > 0.35 and n >= 20, distinct < 0.12 and n >= 50),
        say(0.02 <= ends <= 0.3, ends > 0.6 and n > 5),
        say(3 <= length <= 11, length > 25 or length < 1.5),
        say(bare < 0.02 and n >= 10, bare > 0.2),
    ]


LABELLERS = 7


def features(s: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features: hashed n-grams of character-class runs by share, and hashed bins of the statistics."""
    if not len(runs):
        return np.zeros(0, np.int64), np.zeros(0)
    code, grams = np.zeros(len(runs), np.uint64), []
    for k in range(GRAM):
        code = code[: len(runs) - k] * np.uint64(11) + runs[k:].astype(np.uint64) + np.uint64(1)
        if not len(code):
            break
        grams.append((code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % DIMS)
    count = np.bincount(np.concatenate(grams), minlength=DIMS)
    at = np.flatnonzero(count)
    value = np.sqrt(count[at] / len(runs))
    bins = np.minimum(np.sqrt(np.r_[np.clip(s[1:6], 0, 1), min(s[6] / 40, 1), s[7]]) * 12, 12).astype(np.int64)
    return np.r_[at, (np.arange(len(bins)) * 131 + bins * 17 + 5) % DIMS], np.r_[value, np.ones(len(bins))]


# ---- label model ----------------------------------------------------------------------------------

def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """EM for the share of good texts and each labeller's vote probabilities given bad and good.

    patterns: distinct vote rows (at most 3 ** labellers, whatever the corpus), counts: texts of each.
    Starts from the majority vote, so that class 1 is the good one.
    """
    good, bad = (patterns == 1).sum(1), (patterns == 0).sum(1)
    post = (good + 1 - 0.5 * (bad > 0)) / (good + 3 * bad + 1.5)
    onehot = (patterns[:, :, None] == np.arange(2)).astype(float)  # a labeller without opinion tells nothing
    for _ in range(rounds):
        w = np.stack([(1 - post) * counts, post * counts])  # class x pattern
        prior = (w[1].sum() + 1) / (counts.sum() + 2)
        table = np.einsum("cp,plv->clv", w, onehot) + 0.5
        table /= table.sum(2, keepdims=True)
        new = posterior(patterns, prior, table)
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return float(prior), table


def posterior(patterns: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    """Probability of good for each vote row."""
    ll = np.einsum("clv,plv->cp", np.log(table), patterns[:, :, None] == np.arange(2)) + np.log([[1 - prior], [prior]])
    return 1 / (1 + np.exp(np.clip(ll[0] - ll[1], -500, 500)))


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 250, rate: float = 0.08, l2: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by Adam; the last weight is the intercept."""
    x = np.c_[x, np.ones(len(x), np.float32)].astype(np.float32)
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    for t in range(1, rounds + 1):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y).astype(np.float32) / len(x) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


class Model:
    def __init__(self, prior: float, accuracy: np.ndarray, weights: np.ndarray):
        self.prior, self.accuracy, self.weights = prior, accuracy, weights

    def judge(self, text: str) -> tuple[float, float]:
        """(posterior of the labellers, score of the linear model); 0 for a text without words."""
        s, runs = statistics(text)
        if not s[0]:
            return 0.0, 0.0
        at, value = features(s, runs)
        z = float(self.weights[at] @ value + self.weights[-1])
        return float(posterior(np.array([votes(s)]), self.prior, self.accuracy)[0]), float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Label model from the votes on all documents; scorer from at most about `sample` of them, chosen by hash of id and text.

    An empty table gives a model that scores every text with words 0.5.
    """
    src = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).cast("string").alias("t"))

    def vote(batches):
        for whole in batches:
            for b in parts(whole, 0):
                v = [statistics(t or "")[0] for t in b.column(0).to_pylist()]
                code = np.array([sum(x * 3**k for k, x in enumerate(votes(s))) for s in v if s[0]], np.int64)
                key, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["code", "n"])

    got = src.select("t").mapInArrow(vote, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    if not got:
        return Model(0.5, np.full((2, LABELLERS, 2), 1 / 2), np.zeros(DIMS + 1, np.float32))
    codes = np.array(sorted((r.code, r.n) for r in got))
    pattern = codes[:, :1] // 3 ** np.arange(LABELLERS) % 3
    prior, accuracy = fit_labels(pattern, codes[:, 1].astype(float))

    def vectors(batches):
        for whole in batches:
            for b in parts(whole, 1):
                rows = [(h, *statistics(t or "")) for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                rows = [(h, s, features(s, r)) for h, s, r in rows if s[0]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h for h, _, _ in rows], pa.int64()), pa.array([votes(s) for _, s, _ in rows], pa.list_(pa.int32())), pa.array([f[0].tolist() for *_, f in rows], pa.list_(pa.int32())), pa.array([f[1].tolist() for *_, f in rows], pa.list_(pa.float32()))],
                    ["h", "votes", "at", "value"])

    share = min(1.0, sample / max(1, docs.count()))
    chosen = src.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(share * (1 << 30)) + (share == 1))
    rows = sorted(chosen.mapInArrow(vectors, "h long, votes array<int>, at array<int>, value array<float>").collect(), key=lambda r: (r.h, r.votes))
    if not rows:
        return Model(prior, accuracy, np.zeros(DIMS + 1, np.float32))
    x = np.zeros((len(rows), DIMS), np.float32)
    for i, r in enumerate(rows):
        np.add.at(x[i], r["at"], r["value"])
    y = posterior(np.array([r.votes for r in rows]), prior, accuracy)
    return Model(prior, accuracy, fit_scorer(x, y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with weak_label (posterior of the labellers) and score (of the linear model), both 0 to 1.

    A null, empty or blank text has 0 in both; each row is judged by itself, so repeated rows score alike. Clashing column names get an underscore in front.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text, weak, mark = fresh(docs, "text_", "weak_label", "score")
    src = docs.select(F.col(text_col).cast("string").alias(text), "*")

    def run(batches):
        m = shared.value
        for whole in batches:
            for b in parts(whole, 0):
                got = np.array([m.judge(t or "") for t in b.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(got[:, 0]), pa.array(got[:, 1])], [*b.schema.names[1:], weak, mark])

    return src.mapInArrow(run, _with(docs, weak, mark))


def _with(docs: DataFrame, *names: str) -> StructType:
    return StructType([*docs.schema.fields, *(StructField(n, DoubleType()) for n in names)])


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs with a score of at least threshold. A text without words goes."""
    scored = score(docs, fit(docs, id_col, text_col), id_col, text_col)
    return scored.where(F.col(scored.columns[-1]) >= threshold).select(docs.columns)


def op2_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs)).select("doc_id", "weak_label", "score", (F.col("score") >= THRESHOLD).alias("keep"))


QUERIES = {"op2_weak_quality": op2_weak_quality}
SQL: dict[str, str] = {}
