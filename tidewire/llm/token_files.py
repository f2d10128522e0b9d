"""Token ids in ORC: run-length encoded integers, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import functools
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, table
from .pieces import Pieces, parts

ORC = {"orc.create.index": "true", "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.stripe.size": str(64 << 20), "compression": "zstd"}

SLICE = 8_000_000  #: bytes of text whose distinct pieces are looked up at once
LINES = 16_000  #: unseen pieces that go to the library as one text
_GAP = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"  # white space as Python has it
_WIDE = f"^{_GAP}|{_GAP}$|{_GAP}{{2}}"
_SEEN = r"([^\x{00}\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]) ([^\x{00}\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}])"
_ODD = r"^ ?$|<\||(?s:. )|[\t-\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"  # marks, or white space besides a space in front


def _chunks(texts: pa.Array) -> pa.ListArray:
    """Texts (without U+0000) cut before single spaces between visible characters; pieces keep their space.

    Byte-level pre-tokenization binds such a space to what follows and never looks past it, so the pieces encode as
    they do within the text. Where white space stands at an end or in runs, the pattern says which spaces are single;
    it runs twice, as neighbours share a character.
    """
    wide = pc.match_substring_regex(texts, _WIDE)
    cut = pc.replace_substring(texts, " ", "\0 ")
    if pc.any(wide).as_py():
        odd = pc.filter(texts, wide)
        for _ in range(2):
            odd = pc.replace_substring_regex(odd, _SEEN, "\\1\0 \\2")
        cut = pc.replace_with_mask(cut, wide, odd)
    return pc.split_pattern(cut, "\0")


class Encoder:
    """Whole texts to ids with a tokenizers file; each distinct piece is encoded by the library once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.line = self.tok.encode("\n", add_special_tokens=False).ids[0]
        self.pieces = Pieces(self._many)

    def _many(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces and their numbers; those without inner white space or marks go as lines of one text, cut again at the line ends' ids."""
        rest = pc.match_substring_regex(new, _ODD)
        odd = np.flatnonzero(rest.to_numpy(zero_copy_only=False))
        lines = new.filter(pc.invert(rest)).to_pylist()
        sheets = ["\n".join([*lines[i : i + LINES], ""]) for i in range(0, len(lines), LINES)]
        ids = np.concatenate([np.zeros(0, np.int32), *[np.array(e.ids, np.int32) for e in self.tok.encode_batch_fast(sheets, add_special_tokens=False)]])
        ends = np.flatnonzero(ids == self.line)
        size = np.zeros(len(new), np.int64)
        plain = np.ones(len(new), bool)
        plain[odd] = False
        size[plain] = np.diff(np.r_[-1, ends]) - 1
        ids = np.delete(ids, ends)
        if len(odd):
            got = [e.ids for e in self.tok.encode_batch_fast(new.take(pa.array(odd)).to_pylist(), add_special_tokens=False)]
            at = np.cumsum(size)[odd]  # where each stands among the others' ids
            size[odd] = list(map(len, got))
            ids = np.insert(ids, np.repeat(at, size[odd]), np.array([x for g in got for x in g], np.int32))
        return ids, size

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array and the number of ids of each text (null: none)."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        nul = pc.match_substring(texts, "\0")
        odd = np.flatnonzero(nul.to_numpy(zero_copy_only=False))
        if len(odd):
            texts, whole = pc.if_else(nul, "", texts), [texts[int(i)].as_py() for i in odd]
        cut = _chunks(texts)
        ids, size = self.pieces.gather(self.pieces.slots(cut.flatten()))
        n = np.diff(np.r_[0, np.cumsum(size)][np.asarray(cut.offsets) - cut.offsets[0].as_py()])
        if len(odd):
            rows = np.split(ids, np.cumsum(n)[:-1])
            for i, t in zip(odd, whole, strict=True):
                rows[i] = np.asarray(self.tok.encode(t, add_special_tokens=False).ids, np.int32)
            ids, n = np.concatenate(rows), np.array([len(r) for r in rows])
        return ids, n


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """A worker's encoder: its pieces serve all tasks that the worker gets."""
    return Encoder(path)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append end_id, and write ORC files in ascending id order.

    Columns: part (the number of the file's range), part_start (ids before the document within its part),
    doc_id, n_tokens, ids. Ranges follow the ids, texts of equal ids in the order of their hash. A null text
    counts as empty and has the end id alone; null ids come first.
    """

    def run(batches):
        enc, before = encoder(tokenizer), 0
        for whole in batches:
            for b in parts(whole, 1, SLICE):
                ids, n = enc.encode(b.column(1))
                ends = np.cumsum(n)
                ids = np.insert(ids, ends, end_id)
                n = n + 1
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(before + ends - n), b.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids.astype(np.int32)))],
                    ["part_start", "doc_id", "n_tokens", "ids"])
                before += int(ends[-1])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    order = ["id", F.xxhash64("t")]
    dealt = src.repartitionByRange(*order).sortWithinPartitions(*order)
    out = dealt.mapInArrow(run, f"part_start long, doc_id {kind}, n_tokens long, ids array<int>")
    out.select(F.spark_partition_id().alias("part"), "*").write.options(**ORC).orc(path)


def read(spark: SparkSession, path: str, ids: list[int] | None = None, id_type: str = "long") -> DataFrame:
    """The files again; with ids, stripes and row groups that cannot hold them are skipped by statistics and Bloom filters."""
    schema = f"part int, part_start long, doc_id {id_type}, n_tokens long, ids array<int>"
    df = spark.read.schema(schema).orc(path)
    return df if ids is None else df.where(F.col("doc_id").isin(ids))


def index(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the files, start counting the ids of all documents before."""

    def crc(batches):
        for b in batches:
            lists = b.column(3)
            off, val = np.asarray(lists.offsets), np.asarray(lists.values)
            got = [zlib.crc32(val[s:e].astype("<u4").tobytes()) for s, e in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(off).astype(np.int64)), pa.array(got, pa.int64())], ["part", "part_start", "doc_id", "n_tokens", "ids_crc32"])

    kind = files.schema["doc_id"].dataType.simpleString()
    rows = files.select("part", "part_start", "doc_id", "ids").mapInArrow(crc, f"part int, part_start long, doc_id {kind}, n_tokens long, ids_crc32 long")
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row a file
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_orc(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = new_path(spark, "token-files")
    write(table(spark, sf_dir, "documents"), path, tokenizer)
    return index(read(spark, path))


QUERIES = {"op1_token_orc": op1_token_orc}
SQL: dict[str, str] = {}
