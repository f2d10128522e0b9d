"""Byte-pair encoding and decoding in batched numpy merge rounds."""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .common import fresh, table
from .pieces import Pieces, parts

NONE = np.int64(1 << 40)  #: rank of a pair that does not merge
_SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: bytes that print stand for
    themselves, the others for U+0100 and up in their order."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shift = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in prints)}
    return [chr(b if b in prints else shift[b]) for b in range(256)]


class Vocabulary:
    """A word BPE with end-of-word suffix, read from a tokenizers file.

    Pair ranks are kept as sorted keys left * size + right. A rank is `calm` if every merge of what it makes
    ranks later; all its places in a word may then merge in one round, otherwise only the first does, so that rounds
    equal the one-merge-at-a-time order of the definition.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens = [""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for t, i in vocab.items():
            self.tokens[i] = t
        for t in spec["added_tokens"]:
            self.tokens[t["id"]] = t["content"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = np.int64(len(self.tokens))
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left * self.size + right
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]
        first = np.full(len(self.tokens), NONE)
        np.minimum.at(first, left, np.arange(len(pairs)))
        np.minimum.at(first, right, np.arange(len(pairs)))
        self.calm = first[self.made] > np.arange(len(pairs))
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.cut = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")

    # -- text to words

    def plain(self, text: str) -> list[str]:
        """Runs without white space, in NFC and in lower case letter by letter (a capital sigma has no final form)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python alone
            return _SPACE.split(text.lower())
        return text.lower().split()

    # -- merges

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, by binary search over the sorted pair keys."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each (non-empty) word. All words' symbols stand in one flat array; in a round each word
        merges its lowest-ranked pair, and words without one leave."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym, word = self.inner[raw], np.repeat(np.arange(len(words)), size)
        end = np.cumsum(size) - 1
        sym[end] = self.last[raw[end]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(sym), NONE)
        if len(sym) > 1:
            rank[:-1] = np.where(word[1:] == word[:-1], self.ranks(sym[:-1], sym[1:]), NONE)
        while len(sym):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, start)
            n = np.diff(np.r_[start, len(sym)])
            over = np.repeat(least == NONE, n)
            if over.any():
                done.append((word[over], sym[over]))
                sym, word, rank = sym[~over], word[~over], rank[~over]
                n, least = n[least != NONE], least[least != NONE]
                if not len(sym):
                    break
            best = rank == np.repeat(least, n)
            at = np.flatnonzero(best)
            first = np.r_[True, word[at[1:]] != word[at[:-1]]]
            # of pairs that overlap (a a a) every other one merges, from the left
            run = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | first[1:]])
            nth = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            at = at[first | ((nth % 2 == 0) & self.calm[rank[at]])]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            sym, word, rank = sym[keep], word[keep], rank[keep]
            fix = np.unique(np.r_[moved, moved[moved > 0] - 1])
            nxt = np.minimum(fix + 1, len(sym) - 1)
            rank[fix] = np.where((fix < len(sym) - 1) & (word[nxt] == word[fix]), self.ranks(sym[fix], sym[nxt]), NONE)
        w, s = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(w, kind="stable")
        return np.split(s[order].astype(np.int32), np.cumsum(np.bincount(w, minlength=len(words)))[:-1])

    def encode_chunks(self, chunks: list[str]) -> list[np.ndarray]:
        """Ids of chunks of plain text without white space."""
        words = [[w.encode("utf-8", "surrogatepass") for w in self.words.findall(c)] for c in chunks]
        flat = [w for ws in words for w in ws]
        if not flat:
            return [np.zeros(0, np.int32) for _ in chunks]
        back = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        ids = self.merge(list(back))
        return [np.concatenate([ids[back[w]] for w in ws]) if ws else np.zeros(0, np.int32) for ws in words]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.pieces = Pieces(self._many)

    def _many(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        new = new.to_pylist()
        plain = [p for p in new if p[:1] != "\0"]
        got = dict(zip(plain, self.vocab.encode_chunks(plain), strict=True))
        rows = [got[p] if p in got else np.array([self.vocab.special[p[1:]]] if p[1:] in self.vocab.special else np.concatenate([np.zeros(0, np.int32), *self.vocab.encode_chunks([p])])) for p in new]
        return np.concatenate([np.zeros(0, np.int32), *rows]), np.fromiter(map(len, rows), np.int64, len(rows))

    def chunks(self, text: str) -> list[str]:
        """Pieces that encode on their own: special tokens (marked with U+0000) and runs without white space."""
        v = self.vocab
        if "<|" not in text or not v.cut.search(text):
            return v.plain(text)
        out, at = [], 0
        for m in v.cut.finditer(text):
            out += [*v.plain(text[at : m.start()]), "\0" + m[0]]
            at = m.end()
        return out + v.plain(text[at:])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each text."""
        cut = [self.chunks(t) for t in texts]
        ids, size = self.pieces.gather(self.pieces.slots(pa.array([p for c in cut for p in c], pa.string())))
        total = np.r_[0, np.cumsum(size)]
        return ids, np.diff(total[np.r_[0, np.cumsum([len(c) for c in cut])]])

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' strings joined by a space, as the file has no decoder; special tokens are kept."""
        return " ".join(map(self.vocab.tokens.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """A worker's encoder: its pieces serve all tasks that the worker gets."""
    return Encoder(path)


def _name(df: DataFrame, first: str, second: str) -> str:
    return first if fresh(df, first) == [first] else fresh(df, second)[0]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """docs' id and `keep` columns with ids array<int> (token_ids where there is such a column; underscores in front if need be).

    A null or empty text has no ids. Each row is encoded by itself: repeated rows and equal ids stay as they are.
    """

    def run(batches):
        enc = encoder(path)
        for whole in batches:
            for b in parts(whole, 0):
                ids, n = enc.encode([t or "" for t in b.column(0).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*b.columns[1:], lists], [f.name for f in schema])

    kept = docs.select(F.col(id_col), *[F.col(c) for c in keep])
    schema = kept.schema.add(_name(kept, "ids", "token_ids"), ArrayType(IntegerType()))
    return docs.select(F.col(text_col).cast("string").alias(fresh(docs, "text_")[0]), F.col(id_col), *[F.col(c) for c in keep]).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """tokens without ids_col, with the decoded text (decoded_text where there is a column text; underscores in front if need be).

    Null ids decode to null, no ids to an empty text.
    """

    def run(batches):
        enc = encoder(path)
        for b in batches:
            texts = [None if not x.is_valid else enc.decode(x.values.to_numpy()) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(texts, pa.string())], [f.name for f in schema])

    kept = tokens.drop(ids_col)
    schema = kept.schema.add(_name(kept, "text", "decoded_text"), StringType())
    return tokens.select(F.col(ids_col).alias(fresh(tokens, "ids_")[0]), *[F.col(c) for c in tokens.columns if c != ids_col]).mapInArrow(run, schema)


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, ids_sha256 (little-endian 32-bit ids) and decoded_sha256 of the decoded text."""

    def run(batches):
        enc = encoder(path)
        for whole in batches:
            for b in parts(whole, 1):
                ids, n = enc.encode([t or "" for t in b.column(1).to_pylist()])
                rows = np.split(ids.astype("<u4"), np.cumsum(n)[:-1])
                sha = [hashlib.sha256(r.tobytes()).hexdigest() for r in rows]
                back = [hashlib.sha256(enc.decode(r).encode("utf-8", "surrogatepass")).hexdigest() for r in rows]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int64)), pa.array(sha), pa.array(back)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), tokenizer or word_bpe()).withColumnRenamed("id", "doc_id")


QUERIES = {"op5_bpe": op5_bpe}
SQL: dict[str, str] = {}
