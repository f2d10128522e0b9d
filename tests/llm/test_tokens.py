"""BPE and token files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tidewire.llm import bpe, token_files

HARD = [
    "", " ", "\n\n", "a", "aaaa aaaaaaa aaaaaaaaaaaaaaa", "Hello, World! it's we'll I'D don't", "x<|endoftext|>y <|startoftext|> z", "<|endoftext|>", "<|endofte",
    "ΣΑΣ ΟΔΟΣ Σ", "İstanbul ıI", "é é 한국어 日本語 ①½ ٣٤", "\x1c\x1d a\x85b\xa0c d​e", "tab\tnew\r\nline  two   three ", "🙂👍🏽 the🙂", "\x00a\x00 b \x00", "0123456789" * 3,
    "thethethethe inininin" * 5, "a" * 5000, "the quick " * 300, "!!!???...,,, ***$$$%%%&&&", "ﬁ ǆ Ǆ ß ẞ", "à̖ ẋ̣", " lead", "trail ", "a  b", " x",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    alphabet = "abcdefghijklmnopqrstuvwxyz" * 3 + "ABCXYZ019 .,'!-\n\t éñßçÉüö" + "the in an re " * 2
    return HARD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 400))) for _ in range(300)]


def test_word_bpe_equals_library(texts):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    enc = bpe.Encoder(P.path("word_bpe_49k.json"))
    ids, n = enc.encode(texts)
    rows = np.split(ids, np.cumsum(n)[:-1])
    for t, r in zip(texts, rows, strict=True):
        want = tok.encode(t, add_special_tokens=False).ids
        assert r.tolist() == want, repr(t[:80])
        assert enc.decode(r) == tok.decode(want, skip_special_tokens=False)


def test_byte_bpe_pieces_equal_library(texts):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids, n = token_files.Encoder(P.path("byte_bpe_50k.json")).encode(texts)
    for t, r in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert r.tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t[:80])


def test_token_files(spark, texts, tmp_path):
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(5, None), (6, "tie"), (6, "tie"), (6, "tie two")]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, part string, ids int").repartition(5)
    path = f"file://{tmp_path}/files"
    token_files.write(docs, path, P.path("byte_bpe_50k.json"))
    got = token_files.index(token_files.read(spark, path)).orderBy("start").collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    crc = {}
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        crc.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at = 0
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    for r in got:
        assert r.start == at
        crc[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    some = token_files.read(spark, path, [6, 9])
    assert sorted(r.doc_id for r in some.collect()) == [6, 6, 6, 6, 9]
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()


def test_token_files_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    token_files.write(docs, f"file://{tmp_path}/none", P.path("byte_bpe_50k.json"))
    assert token_files.index(token_files.read(spark, f"file://{tmp_path}/none")).count() == 0


def test_bpe_operator(spark, texts):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(None, None, 0)], "doc_id long, text string, ids int")
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = {}
    for i, t in [*enumerate(texts), (None, "")]:
        ids = tok.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.id: tuple(r)[1:] for r in bpe.digest(docs, path).collect()} == want
    coded = bpe.encode(docs, path, keep=["ids"])
    assert coded.columns == ["doc_id", "ids", "token_ids"]
    back = bpe.decode(coded, path, "token_ids")
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in back.collect()} == {k: v[2] for k, v in want.items()}
    assert bpe.encode(docs.limit(0), path).count() == 0
    clash = spark.createDataFrame([(1, "the quick", "x", "y", "z", 4)], "doc_id long, text string, `__text` string, text_ string, ids string, token_ids int")
    coded = bpe.encode(clash, path, keep=clash.columns[1:])
    assert coded.columns == [*clash.columns, "_token_ids"]
    back = bpe.decode(coded.withColumn("decoded_text", coded.ids), path, "_token_ids").first()
    assert back["_decoded_text"] == tok.decode(tok.encode("the quick").ids) and back.ids == "z" and back["__text"] == "x"
