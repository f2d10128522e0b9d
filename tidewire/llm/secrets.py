"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .pieces import parts

# The base patterns and the least length of what each must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs: the same as [0-9a-f]+ of 24 characters and more
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "markov")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{8,}")  #: runs that the models see
LEAST = 20  #: a run that only the models judge has at least so many characters
MEAN, TOTAL = 0.9, 24.0  #: and a log-likelihood ratio of at least so many nats a character and in all
SAMPLE = 20_000  #: about so many documents, chosen by hash over the whole table, train the models
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_N = len(_LETTERS) + 1  # index 0: the start of a run
_AT = np.zeros(256, np.int64)
_AT[np.frombuffer(_LETTERS.encode(), np.uint8)] = np.arange(1, _N)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, value) of the fixed patterns, in code points, sorted by start and kind."""
    out, low = [], text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def _pairs(run: str) -> tuple[np.ndarray, np.ndarray]:
    at = _AT[np.frombuffer(run.encode(), np.uint8)]
    return np.r_[0, at[:-1]], at


def _outside(text: str, spans: list, least: int) -> list[tuple[int, int, str]]:
    """Runs that touch none of the spans."""
    runs = [(m.start(), m.end(), m[0]) for m in RUN.finditer(text) if m.end() - m.start() >= least]
    return [r for r in runs if not any(s[0] < r[1] and r[0] < s[1] for s in spans)] if spans else runs


def transition_counts(texts: list[str]) -> np.ndarray:
    """Character pairs of labelled runs: [1] values that the fixed patterns found, [0] other runs too short to be judged (longer ones may be secrets that no pattern finds)."""
    runs: tuple[list[str], list[str]] = ([], [])
    for t in texts:
        spans = base_spans(t)
        runs[1].extend(v for *_, v in spans)
        runs[0].extend(r for *_, r in _outside(t, spans, 8) if len(r) < LEAST)
    n = np.zeros((2, _N, _N), np.int64)
    for k in (0, 1):
        at = _AT[np.frombuffer(("\n" + "\n".join(runs[k])).encode(), np.uint8)]  # 0 between runs
        n[k] = np.bincount(at[:-1] * _N + at[1:], minlength=_N * _N).reshape(_N, _N)
        n[k, :, 0] = 0
    return n


def ratio(n: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each transition, random over ordinary.

    Random strings are smoothed towards all letters alike (so that few or no samples still give a model of
    uniform noise), ordinary runs lightly.
    """
    rnd = n[1] + 200.0 / _N
    rnd /= rnd.sum(1, keepdims=True)
    usual = n[0] + 20.0 * (n[0].sum(0) + 1) / (n[0].sum() + _N)
    usual /= usual.sum(1, keepdims=True)
    return np.log(rnd) - np.log(usual)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """Transition log-likelihood ratios from at most about `sample` documents, chosen by hash of id and text; of an empty table all near zero."""

    def count(batches):
        n = np.zeros((2, _N, _N), np.int64)
        for whole in batches:
            for b in parts(whole, 0):
                n += transition_counts([t or "" for t in b.column(0).to_pylist()])
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.ravel()[at])], ["at", "n"])

    share = min(1.0, sample / max(1, docs.count()))
    src = docs.select(F.col(text_col).cast("string").alias("t"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    if share < 1:
        src = src.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    n = np.zeros(2 * _N * _N)
    for r in src.select("t").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most 2 * 68 * 68 rows
        n[r["at"]] = r["n"]
    return ratio(n.reshape(2, _N, _N))


def find(text: str, llr: np.ndarray, mean: float = MEAN, total: float = TOTAL) -> list[tuple[int, int, int]]:
    """All spans (start, end, kind): the fixed patterns', and runs apart from them that look random."""
    spans = base_spans(text)
    out = [s[:3] for s in spans]
    for a, b, run in _outside(text, spans, LEAST):
        x = float(llr[_pairs(run)].sum())
        if x >= total and x >= mean * len(run):
            out.append((a, b, 3))
    return sorted(out)


def scan(docs: DataFrame, llr: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, spans array<struct<kind,start,end>> in code points, end exclusive, by start and kind.

    A null or empty text has no spans. Spans of the fixed patterns may overlap; of equal starts they stand in the order of KINDS.
    Each row is scanned by itself, so repeated rows have equal spans.
    """
    shared = docs.sparkSession.sparkContext.broadcast(llr)

    def run(batches):
        for whole in batches:
            for b in parts(whole, 1):
                got = [[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in find(t or "", shared.value)] for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, kind)], ["id", "spans"])

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")


def op4_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = scan(docs, fit(docs))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return got.select(
        F.col("id").alias("doc_id"), *[number(k) for k in KINDS[:3]], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))


QUERIES = {"op4_markov_secrets": op4_markov_secrets}
SQL: dict[str, str] = {}
