"""Exact de-duplication with skew-safe combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, save, table

HOT_SHARE = 1024  #: a digest with more than 1/HOT_SHARE of the rows is salted; so at most HOT_SHARE digests are, which bounds the broadcast
SALTS = 64


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rest: list[str] = (), digest=_sha, salts: int = SALTS) -> DataFrame:
    """One row per distinct text: digest, text, keep (largest id), rest (struct of the kept row's columns), n, hot.

    The text itself is part of every grouping key, so content is compared in full at each of the stages:
    (1) the map-side partial aggregate removes copies within a task, (2) rows meet by digest, text and
    salt, (3) only the winners of salted (hot) digests meet once more by digest and text.
    Texts cross the network once. A null text counts as empty; a null id is below every other id; of rows
    with equal text and id the one whose other columns have the larger hash stays.
    """
    base = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"),
        F.struct(*[F.col(c) for c in rest]).alias("rest") if rest else F.lit(None).cast("int").alias("rest"),
    ).withColumn("d", digest(F.col("t")))
    counts = base.groupBy("d").agg(F.count("*").alias("n"))
    total = docs.count()
    hot = counts.where(F.col("n") > max(1, total // HOT_SHARE)).select("d", F.lit(True).alias("hot"))
    salted = base.join(F.broadcast(hot), "d", "left").select(
        "*", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(salts))).otherwise(0).alias("s"))
    order = F.struct("id", F.xxhash64(F.to_json("rest"))) if rest else F.col("id")
    keep = lambda by, x: (F.max_by(x, by) if rest else F.first(x)).alias("rest")
    first = salted.withColumn("o", order).groupBy("d", "s", "t").agg(
        F.max("o").alias("o"), keep("o", "rest"), F.count("*").alias("n"), F.max(F.coalesce("hot", F.lit(False))).alias("hot"))
    second = first.where("hot").groupBy("d", "t").agg(F.max("o").alias("o"), keep("o", "rest"), F.sum("n").alias("n"), F.lit(True).alias("hot"))
    cols = ["d", "t", "o", "rest", "n", "hot"]
    out = first.where("not hot").select(cols).unionByName(second.select(cols))
    return out.select(F.col("d").alias("digest"), F.col("t").alias("text"), (F.col("o.id") if rest else F.col("o")).alias("keep"), "rest", "n", "hot")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=_sha, salts: int = SALTS) -> DataFrame:
    """One row per input row: id, keep (largest id of its group of equal texts), n (rows of the group), digest.

    Members find their group by digest and salt, a join of small rows. Digests that stand for more than one text
    (a weak digest, or a collision) are joined on the text too.
    """
    won = save(winners(docs, id_col, text_col, digest=digest, salts=salts).select(
        "digest", "keep", "n", "hot", F.when(F.lit(digest is not _sha), F.col("text")).alias("text")), "winners")
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("digest", digest(F.col("t")))
    clash = won.groupBy("digest").count().where("count > 1").select("digest")
    plain = digest is _sha and clash.isEmpty()
    if digest is _sha and not plain:
        won = winners(docs, id_col, text_col, digest=digest, salts=salts)
    # a hot digest's members are dealt to all salts, and its winner is repeated for each
    hot = F.broadcast(won.where("hot").select("digest", F.lit(True).alias("hot")).distinct())
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(salts))).otherwise(0).alias("s")
    members = (base.drop("t") if plain else base).join(hot, "digest", "left").select("*", salt).drop("hot")
    zero = F.lit(0).cast("long")
    each = F.explode(F.when(F.col("hot"), F.sequence(zero, F.lit(salts - 1).cast("long"))).otherwise(F.array(zero))).alias("s")
    heads = won.select("digest", each, "keep", "n", F.col("text").alias("t"))
    return members.join(heads.drop("t") if plain else heads, ["digest", "s"] + ["t"] * (not plain)).select("id", "keep", "n", "digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs that stay, with all their columns: of equal texts the row with the largest id.

    A null text is equal to the empty text (the kept row's text then reads as empty). Repeated rows leave one.
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    won = winners(docs, id_col, text_col, rest=rest)
    picked = {id_col: F.col("keep"), text_col: F.col("text")} | {c: F.col("rest").getField(c) for c in rest}
    return won.select(*[picked[c].alias(c) for c in docs.columns])


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = groups(table(spark, sf_dir, "documents"))
    return got.select(
        F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.col("digest").alias("text_sha256"))


SQL = {
    "op10_exact_dedup": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM t WINDOW w AS (PARTITION BY text)
"""
}
QUERIES = {"op10_exact_dedup": op10_exact_dedup}
