"""Text normal form, tokens, figures, SimHash and the same-story predicate, as column expressions."""

from __future__ import annotations

import hashlib
import string
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config


def _accents() -> tuple[str, str]:
    """Letters whose decomposition is one ASCII letter and marks, by rule from the Unicode data."""
    pairs = []
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(x for x in unicodedata.normalize("NFD", chr(c)) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base.isascii() and base != chr(c):
            pairs.append((chr(c), base))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_FROM, _TO = _accents()


def strip_accents(text: Column) -> Column:
    """Latin letters without accents; combining marks go. Only texts beyond ASCII are looked through."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(text, _FROM, _TO), r"\p{Mn}", "")).otherwise(text)


#: What the normal form leaves out, [^a-z0-9%+\-.], and what stands between its runs of letters and digits, [^a-z0-9], as single characters:
#: Java looks those up in one table, but tries each range of a class in turn, for every character.
GAP = f"[^{string.ascii_lowercase}{string.digits}%+\\-.]+"
BREAK = r"[ %+\-.]+"


def norm(text: Column) -> Column:
    """Lower case without accents; what is not [a-z0-9%+-.] becomes a single space. Null is empty."""
    low = F.lower(strip_accents(F.coalesce(text, F.lit(""))))
    return F.trim(F.regexp_replace(low, GAP, " "))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x worked out once a row whatever f does with it: Spark repeats it in each branch of a condition."""
    return F.transform(F.array(x), f)[0]


def tokens(text: Column) -> Column:
    return F.filter(F.split(norm(text), " "), lambda t: t != "")


def whole(form: Column, edge: Column | str) -> Column:
    """Pattern of a form that no character of the class `edge` adjoins. The form comes first, so that Java skips through a text by it."""
    form = F.concat(F.lit(r"\Q"), form, F.lit(r"\E"))
    edge = F.lit(edge) if isinstance(edge, str) else edge
    return F.concat(form, F.lit("(?!"), edge, F.lit(")(?<!"), edge, form, F.lit(")"))


def content_tokens(text: Column, stop: list[str] = config.STOP_WORDS) -> Column:
    """Distinct tokens of over two letters that are no stop words."""
    return F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) > 2) & ~t.isin(stop)))


def figures(text: Column, magnitudes: dict[str, float] = config.MAGNITUDES) -> Column:
    """Sorted distinct amounts of a million and more, as numbers of four significant digits. Digits beyond a double's range are no amount."""
    low = F.lower(strip_accents(F.coalesce(text, F.lit(""))))
    pattern = r"(\d+(?:[.,]\d+)?)\s*(" + "|".join(magnitudes) + r")\b"
    table = F.create_map(*[F.lit(x) for kv in magnitudes.items() for x in kv])
    number = F.regexp_extract_all(low, F.lit(pattern), F.lit(1))
    unit = F.regexp_extract_all(low, F.lit(pattern), F.lit(2))
    value = F.zip_with(number, unit, lambda n, u: F.regexp_replace(n, ",", ".").cast("double") * table[u])
    kept = F.filter(value, lambda v: (v >= 1e6) & (v < float("inf")))
    four = F.transform(kept, lambda v: F.round(v / F.pow(F.lit(10.0), F.floor(F.log10(v)) - 3)) * F.pow(F.lit(10.0), F.floor(F.log10(v)) - 3))
    return F.array_sort(F.array_distinct(four))


def figure_string(v: Column) -> Column:
    """A figure in plain digits, of any size: its four digits and zeros."""
    zeros = F.floor(F.log10(v)) - 3
    return F.concat(F.round(v / F.pow(F.lit(10.0), zeros)).cast("long").cast("string"), F.repeat(F.lit("0"), zeros.cast("int")))


def _simhashes(texts: list[str], name: str, bits: int) -> np.ndarray:
    """SimHashes of many normal forms at once: bits of all shingles' hashes are summed up by text."""
    words = [t.split() for t in texts]
    n = np.fromiter((max(1, len(w) - 2) for w in words), np.int64, len(words))
    shingles = [" ".join(w[i : i + 3]).encode() for w, k in zip(words, n.tolist(), strict=True) for i in range(k)]
    if not shingles:
        return np.zeros(0, np.int64)
    raw = b"".join(hashlib.blake2b(s, digest_size=8).digest() if name == "blake2b" else hashlib.md5(s).digest()[:8] for s in shingles)
    h = np.frombuffer(raw, ">u8").astype(np.uint64)
    start, out = np.r_[0, np.cumsum(n)[:-1]], np.zeros(len(words), np.uint64)
    for i in range(bits):
        set_ = np.add.reduceat((h >> np.uint64(i) & np.uint64(1)).astype(np.int64), start)
        out |= (2 * set_ > n).astype(np.uint64) << np.uint64(i)
    return out.view(np.int64)


def simhash(text: Column, hash: str = "blake2b", bits: int = 63) -> Column:
    """Majority bits of the hashes of three-token shingles of the normal form; 63 bits fit a signed long."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(_simhashes([t or "" for t in s], hash, bits))

    return run(norm(text))


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays without repeats; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def same_story(ta: Column, tb: Column, sa: Column, sb: Column, fa: Column, fb: Column) -> Column:
    j = jaccard(ta, tb)
    near = hamming(sa, sb) <= config.HAMMING_MAX
    return (j >= config.JACCARD_MIN) | F.coalesce(near, F.lit(False)) | (F.arrays_overlap(fa, fb) & (j >= config.JACCARD_WITH_FIGURE))
