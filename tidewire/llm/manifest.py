"""Merkle manifest of a dataset: digests climb by time-forward processing, proofs descend by the reversed sweep.

A tree's nodes are cut into blocks of consecutive nodes, which are the tasks' units. Within a block a priority queue
ordered by node label (level, place) delivers child digests to parents; what climbs out of a block is a message to
the block above, carried and ordered by Spark's shuffle, so no task holds more than a block. The reversed sweep goes
the same way back and delivers to each node what its proof continues with above it.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CRC_TABLE, crc32_sql, positions, save, table

BLOCK = 4096  #: nodes of a block at most
PROOF = "array<struct<before:string,after:string>>"
_PROOF = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A field as it is hashed: "-" for null, else its UTF-8 byte count, ":" and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    return sha(F.concat(*[field(c) for c in columns]))


def block_height(arity: int, block: int = BLOCK) -> int:
    """Levels of a whole block."""
    height = 1
    while arity ** (height + 1) <= block:
        height += 1
    return height


def levels(n: int, arity: int, height: int) -> int:
    """How often n nodes climb within a block: until one is left, at most the height of a block."""
    up = 0
    while n > 1 and up < height:
        n, up = -(-n // arity), up + 1
    return up


def climb(digests: list[str], up: int, arity: int) -> tuple[str, list[tuple[int, int, list[str]]]]:
    """(digest of what is left after `up` levels, tape): the tape has (level, place, child digests) of each parent in
    the order of labels."""
    queue: list[tuple[int, int, int, str]] = []  # level and place of the receiver, place of the sender, digest
    for i, d in enumerate(digests):
        heappush(queue, (1, i // arity, i, d))
    tape, got = [], digests[0]
    while up and queue:
        level, place = queue[0][:2]
        children = []
        while queue and queue[0][:2] == (level, place):
            children.append(heappop(queue)[3])
        tape.append((level, place, children))
        got = hashlib.sha256("".join(children).encode()).hexdigest()
        if level < up:
            heappush(queue, (level + 1, place // arity, place, got))
    return got, tape


def descend(tape: list[tuple[int, int, list[str]]], n: int, above: list, arity: int) -> list[list]:
    """Proofs of the n leaves of a block: the tape backwards; each parent passes its own suffix and the siblings on."""
    queue: list = [(-tape[-1][0], -tape[-1][1], above)] if tape else []  # the receiver's label, negated, and the suffix for it
    out: list[list] = [above] * n
    for level, place, children in reversed(tape):
        suffix = heappop(queue)[2]
        for k, _ in enumerate(children):
            mine = [("".join(children[:k]), "".join(children[k + 1 :])), suffix]  # a link and the rest, shared by all below
            if level == 1:
                out[place * arity + k] = mine
            else:
                heappush(queue, (1 - level, -(place * arity + k), mine))
    return out


def _flat(link: list) -> list[dict]:
    """A chain of links as a list, lowest level first; the chain ends in a list of dicts."""
    got = []
    while link and isinstance(link[0], tuple):
        got.append({"before": link[0][0], "after": link[0][1]})
        link = link[1]
    return got + link


def _above(nodes: DataFrame, arity: int, height: int) -> DataFrame:
    """One node a block: (tree, pos, n, digest)."""
    span = arity**height

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        n = t["n"][0].as_py()
        digest, _ = climb(t["digest"].to_pylist(), levels(n, arity, height), arity)
        return pa.table({"tree": t["tree"][:1], "pos": pa.array([t["pos"][0].as_py() // span], pa.int64()), "n": pa.array([-(-n // span)], pa.int64()), "digest": pa.array([digest])})

    keyed = nodes.select("tree", "pos", "n", "digest", F.floor(F.col("pos") / span).alias("block"))
    return keyed.groupBy("tree", "block").applyInArrow(run, "tree string, pos long, n long, digest string")


def _below(nodes: DataFrame, above: DataFrame, arity: int, height: int) -> DataFrame:
    """nodes with proof, subroot and root; above has those of the blocks, (tree, pos, proof, subroot, root)."""
    span = arity**height
    extra = ["proof", "subroot", "root"]

    def run(mine: pa.Table, top: pa.Table) -> pa.Table:
        mine = mine.sort_by("pos")
        _, tape = climb(mine["digest"].to_pylist(), levels(mine["n"][0].as_py(), arity, height), arity)
        proofs = descend(tape, len(mine), top["proof"][0].as_py(), arity)
        same = lambda c: pa.array([top[c][0].as_py()] * len(mine), pa.string())
        got = mine.drop_columns(["block"])
        return got.append_column("proof", pa.array([_flat(p) for p in proofs], _PROOF)).append_column("subroot", same("subroot")).append_column("root", same("root"))

    fields = T.StructType([*nodes.schema.fields, *T._parse_datatype_string(f"proof {PROOF}, subroot string, root string").fields])
    left = nodes.withColumn("block", F.floor(F.col("pos") / span)).groupBy("tree", "block")
    right = above.select("tree", F.col("pos").alias("block"), *extra).groupBy("tree", "block")
    return left.cogroup(right).applyInArrow(run, fields)


def _stages(nodes: DataFrame, arity: int, height: int) -> list[DataFrame]:
    """nodes, their blocks, the blocks' blocks ... up to one node a tree."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    out = [nodes]
    while True:
        out.append(save(_above(out[-1], arity, height), "manifest-nodes"))
        most = -(-most // arity**height)
        if most <= 1:
            return out


def proofs(leaves: DataFrame, tree: str, order: list[str], digest: str = "leaf", arity: int = 2, block: int = BLOCK) -> DataFrame:
    """leaves with subroot (of their tree), root and proof.

    The rows of each value of `tree` ascend by `order` (nulls first, then by digest) and are hashed level by level in
    runs of `arity`; what remains of each tree is its subroot, and the subroots, by their tree's value (null first,
    bytewise), are hashed likewise to the root. proof has an entry a level, from leaf to root: the siblings' digests
    before and after, joined; a level without siblings has two empty strings.

    A null tree is a tree of its own. Equal rows are leaves of their own. No leaves give no rows. Other columns come
    along unchanged; proof, subroot and root must not be among them.
    """
    height = block_height(arity, block)
    key = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("-"))  # "-" is before "=", so null first
    own = leaves.select(key.alias("tree"), F.col(digest).alias("digest"), F.struct(*leaves.columns).alias("row"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    placed = positions(own, "tree", [*[f"o{i}" for i in range(len(order))], "digest"], "manifest-leaves").drop(*[f"o{i}" for i in range(len(order))])
    trees = _stages(save(placed, "manifest-places"), arity, height)
    subroots = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("digest"))
    tops = _stages(save(positions(subroots, "tree", ["name"], "manifest-subroots"), "manifest-places"), arity, height)
    none = F.array().cast(PROOF)
    down = tops[-1].select("tree", "pos", none.alias("proof"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for nodes in tops[-2::-1]:
        down = _below(nodes, down, arity, height)
    down = down.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "proof", F.col("digest").alias("subroot"), "root")
    for nodes in trees[-2::-1]:
        down = _below(nodes, down, arity, height)
    return down.select("row.*", "proof", "subroot", "root")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and a proof come to."""
    return F.aggregate(proof, leaf, lambda d, p: sha(F.concat(p["before"], d, p["after"])))


def siblings(proof: Column) -> Column:
    """All siblings' digests joined, from leaf to root and left to right."""
    return F.array_join(F.transform(proof, lambda p: F.concat(p["before"], p["after"])), "")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered): tampered is the leaf's digest after its n_chars grew by one, null where it did not."""
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    plain = [F.col(c) for c in FIELDS]
    wrong = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    return docs.select("doc_id", "lang", leaf_digest(*plain).alias("leaf"), F.when(struck, leaf_digest(*wrong)).alias("tampered"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of documents, their roots, the digest of their proofs, and what tampered leaves fold to."""
    got = proofs(document_leaves(table(spark, sf_dir, "documents")), "lang", ["doc_id"])
    got = got.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return got.select("doc_id", "leaf", "subroot", "root", sha(siblings(F.col("proof"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD(c) for c in FIELDS) + ")"
SQL = {
    "op11_merkle_manifest": f"""
WITH RECURSIVE {CRC_TABLE}, leaves AS (
  SELECT doc_id, lang, {_LEAF} AS leaf,
    CASE WHEN crc % 7 = 0 THEN {_LEAF.replace("n_chars", "(n_chars + 1)")} ELSE {_LEAF} END AS tampered,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT documents.*, {crc32_sql('doc_id::VARCHAR')} AS crc FROM documents, crc)),
nodes(lang, lvl, idx, d, n) AS (
  SELECT lang, 0, idx, leaf, n FROM leaves
  UNION ALL SELECT lang, lvl + 1, idx // 2, sha256(string_agg(d, '' ORDER BY idx)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, lvl, idx // 2, n),
subs AS (SELECT lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(lvl, idx, d, n) AS (
  SELECT 0, idx, d, n FROM subs
  UNION ALL SELECT lvl + 1, idx // 2, sha256(string_agg(d, '' ORDER BY idx)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY lvl, idx // 2, n),
up(doc_id, lang, lvl, idx, d, proof, n) AS (
  SELECT doc_id, lang, 0, idx, tampered, '', n FROM leaves
  UNION ALL SELECT u.doc_id, u.lang, u.lvl + 1, u.idx // 2, sha256(CASE WHEN u.idx % 2 = 0 THEN u.d || coalesce(s.d, '') ELSE s.d || u.d END), u.proof || coalesce(s.d, ''), (u.n + 1) // 2
  FROM up u LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM u.lang AND s.lvl = u.lvl AND s.idx = xor(u.idx, 1) WHERE u.n > 1),
over(doc_id, lvl, idx, d, proof, n) AS (
  SELECT u.doc_id, 0, s.idx, u.d, u.proof, s.n FROM up u JOIN subs s ON s.lang IS NOT DISTINCT FROM u.lang WHERE u.n = 1
  UNION ALL SELECT u.doc_id, u.lvl + 1, u.idx // 2, sha256(CASE WHEN u.idx % 2 = 0 THEN u.d || coalesce(s.d, '') ELSE s.d || u.d END), u.proof || coalesce(s.d, ''), (u.n + 1) // 2
  FROM over u LEFT JOIN tops s ON s.lvl = u.lvl AND s.idx = xor(u.idx, 1) WHERE u.n > 1)
SELECT l.doc_id, l.leaf, s.d AS subroot, r.d AS root, sha256(o.proof) AS proof_sha256, o.d AS folded_root, o.d = r.d AS verified
FROM leaves l JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang JOIN over o ON o.doc_id = l.doc_id AND o.n = 1, (SELECT d FROM tops WHERE n = 1) r
"""
}
QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
