"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, table

LARGE = 64  #: documents of over 1/LARGE of their source's words (fewer than LARGE a source) are settled before the others
FAN = 64  #: items that meet in one node of the reduction tree
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0  #: a source's target is at most so many times its size
BROADCAST_SOURCES = 50_000  #: the table of sources is broadcast only if it has at most so many rows (under 5 MB)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size) -> the same with target.

    Sources in code point order, null last, weigh weights[0], weights[1], ..., repeating; they share the total
    by weight. A target stops at `most` times its source's size and the excess is reshared by weight until none
    is above, which is the level L with sum(min(most * size, L * weight)) = total. It is found by one pass over
    the sources in the order in which they reach their limit (one row a source, so one small window).
    """
    everything = Window.orderBy(F.col("source").isNull(), "source")
    at = F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (at + 1).cast("int"))
    base = sizes.withColumn("w", w).withColumn("limit", F.lit(most) * F.col("source_size"))
    by = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), "source")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weight_left = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = base.withColumn("level", left / weight_left)
    fits = F.when(F.col("level") * F.col("w") <= F.col("limit"), F.col("level"))
    first = F.min_by(fits, F.when(fits.isNotNull(), F.col("limit") / F.col("w"))).over(whole)
    return level.select("source", "source_size", F.least(F.col("limit"), F.coalesce(first * F.col("w"), F.col("limit"))).alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def _settle(seed: int):
    """Fold step: move words between the carried item and the next until one has no fraction left."""

    def step(acc: Column, x: Column) -> Column:
        a = acc["cur"]
        room_a, has_a, room_x, has_x = (1 - a["p"]) * a["w"], a["p"] * a["w"], (1 - x["p"]) * x["w"], x["p"] * x["w"]
        up, down = F.least(room_a, has_x), F.least(has_a, room_x)
        to_a = _uniform(F.lit(seed), a["o"], x["o"]) * (up + down) < down
        pa = F.when(to_a, F.when(up == room_a, F.lit(1.0)).otherwise(a["p"] + up / a["w"])).otherwise(F.when(down == has_a, F.lit(0.0)).otherwise(a["p"] - down / a["w"]))
        px = F.when(to_a, F.when(up == has_x, F.lit(0.0)).otherwise(x["p"] - up / x["w"])).otherwise(F.when(down == room_x, F.lit(1.0)).otherwise(x["p"] + down / x["w"]))
        a2, x2 = (F.struct(y["k"].alias("k"), y["o"].alias("o"), y["id"].alias("id"), y["h"].alias("h"), y["w"].alias("w"), p.alias("p")) for y, p in ((a, pa), (x, px)))
        # the items after the move, in one array so that each is worked out once
        return F.transform(F.array(F.struct(a2.alias("a"), x2.alias("x"))), lambda m: F.when(
            m["a"]["p"].isin(0.0, 1.0), F.struct(m["x"].alias("cur"), F.concat(acc["done"], F.array(m["a"])).alias("done"))
        ).otherwise(F.struct(m["a"].alias("cur"), F.concat(acc["done"], F.array(m["x"])).alias("done"))))[0]

    return step


def round_copies(items: DataFrame, seed: int = 1, fan: int = FAN) -> DataFrame:
    """Items (source, id, h, w words, p in (0,1)) -> (id, h, bit).

    Pivotal rounding weighted by words: two items exchange words at random, without drift, until one is
    wholly in or out. Nodes of at most about `fan` items run side by side; each leaves one residual item, and residuals
    meet in the next level, so a source's words come within half an item's of their expectation, however large or
    hot the source (the one item left in the end goes to the nearer side). Nodes take their items from the largest
    to the smallest, so that what is left is seldom a large one. All randomness is hashed from the seed and the items: reruns agree.
    """
    o = F.xxhash64(F.lit(seed), "id", "h")
    counts = items.groupBy(F.col("source").alias("of")).agg(F.ceil(F.count("*") / fan).alias("blocks"))
    cur = items.join(counts, F.col("source").eqNullSafe(F.col("of"))).select(
        "source", F.pmod(F.xxhash64(o, F.lit(seed)), "blocks").alias("block"), F.struct((-F.col("w")).cast("double").alias("k"), o.alias("o"), "id", "h", F.col("w").cast("double").alias("w"), F.col("p").alias("p")).alias("x"))
    most = counts.agg(F.max("blocks")).first()[0] or 0
    settled, level = [], 0
    while most:
        arr = F.array_sort(F.collect_list("x"))
        node = cur.groupBy("source", "block").agg(arr.alias("arr"))
        start = F.struct(F.col("arr")[0].alias("cur"), F.slice("arr", 1, 0).alias("done"))
        fold = F.aggregate(F.slice("arr", 2, F.greatest(F.size("arr") - 1, F.lit(0))), start, _settle(seed + 7 * level))
        got = save(node.select("source", "block", fold.alias("f")).select("source", "block", "f.cur", "f.done"), "pivotal")
        settled.append(got.select(F.explode("done").alias("x")))
        cur = got.select("source", F.floor(F.col("block") / fan).alias("block"), F.col("cur").alias("x"))
        if most == 1:
            settled.append(cur.select("x"))
            break
        most, level = -(-most // fan), level + 1
    out = [d.select("x.id", "x.h", F.when(F.col("x.p").isin(0.0, 1.0), F.col("x.p")).otherwise((F.col("x.p") >= 0.5).cast("double")).cast("int").alias("bit")) for d in settled]
    return reduce(DataFrame.unionByName, out) if out else items.select("id", "h", F.lit(0).alias("bit"))


def _hash(docs: DataFrame) -> Column:
    """Hash of a whole row, of the places of its nulls too (xxhash64 alone skips nulls); nested columns count as JSON."""
    nested = [c for c, kind in docs.dtypes if "<" in kind or kind in ("variant", "interval")]
    plain = [c for c in docs.columns if c not in nested]
    parts = [F.col(c) for c in plain] + [F.col(c).isNull() for c in plain]
    return F.xxhash64(*parts, F.to_json(F.struct(*[F.col(c) for c in nested]), {"ignoreNullFields": "false"}) if nested else F.lit(0))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 1) -> DataFrame:
    """(id, h, source, size, source_size, target, m, copies): m equal rows, of which the mix takes `copies` in all.

    Documents that hold a notable share of their source are rounded first, and the others then share what is left
    of the target, so that one long document doesn't decide how near the mix comes to it.
    A null text has size 0; null is a source of its own. A document without words takes no words; it is
    copied as its source's ratio says, rounded on its own. An empty table gives an empty plan. Rows equal in every column
    are one item of m rows.
    """
    items = save(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _hash(docs).alias("h"))
        .groupBy("id", "source", "size", "h").agg(F.count("*").alias("m")), "mix-items")
    sizes = items.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    goal = save(source_targets(sizes, weights, most), "mix-targets")
    goal = goal.withColumnRenamed("source", "of")
    narrow = goal.count() <= BROADCAST_SOURCES

    def per_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(sources) if narrow else sources, F.col("source").eqNullSafe(F.col("of"))).drop("of")

    def copied(rows: DataFrame, ratio: Column, seed: int) -> DataFrame:
        """rows with copies: whole copies, and one more by pivotal rounding (by the hash alone where there are no words)."""
        want = rows.withColumn("x", ratio * F.col("m")).withColumn("whole", F.floor("x")).withColumn("p", F.col("x") - F.col("whole"))
        paired = want.where((F.col("p") > 0) & (F.col("size") > 0)).select("source", "id", "h", F.col("size").alias("w"), "p")
        bits = round_copies(paired, seed).withColumnsRenamed({"id": "bit_id", "h": "bit_h"})
        lone = (_uniform(F.lit(seed + 2), "id", "h") < F.col("p")).cast("int")
        got = want.join(bits, F.col("id").eqNullSafe(F.col("bit_id")) & (F.col("h") == F.col("bit_h")), "left")
        return got.select(*rows.columns, (F.col("whole") + F.coalesce("bit", F.when(F.col("size") == 0, lone).otherwise(0))).cast("long").alias("copies"))

    rows = per_source(items, goal)
    large = F.col("size") > F.col("source_size") / LARGE
    first = save(copied(rows.where(large), F.col("target") / F.col("source_size"), seed), "mix-large")
    used = first.groupBy(F.col("source").alias("of_")).agg(F.sum(F.col("size") * F.col("copies")).alias("used"), F.sum(F.col("size") * F.col("m")).alias("held"))
    rest = goal.join(used, F.col("of").eqNullSafe(F.col("of_")), "left").select(
        "of", F.greatest(F.lit(0.0), F.least(F.lit(most), F.coalesce(F.try_divide(F.col("target") - F.coalesce("used", F.lit(0)), F.col("source_size") - F.coalesce("held", F.lit(0))), F.lit(0.0)))).alias("ratio"))
    second = copied(per_source(rows.where(~large), save(rest, "mix-ratios")), F.col("ratio"), seed + 1000).drop("ratio")
    return first.unionByName(second).select("id", "h", "source", "size", "source_size", "target", "m", "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 1) -> DataFrame:
    """docs with each row repeated as often as the mix takes it (0 times and up), all columns kept."""
    p = plan(docs, id_col, text_col, source_col, weights, most, seed).select(F.col("id").alias("plan_id"), F.col("h").alias("plan_h"), "copies")
    rows = docs.select(F.col(id_col).alias("id"), _hash(docs).alias("h"), F.struct(*[F.col(c) for c in docs.columns]).alias("row")).groupBy("id", "h").agg(F.first("row").alias("row"))
    taken = rows.join(p, F.col("id").eqNullSafe(F.col("plan_id")) & (F.col("h") == F.col("plan_h"))).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op3_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(table(spark, sf_dir, "documents"))
    each = p.select("*", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("i"))
    mine = F.floor(F.col("copies") / F.col("m")) + (F.col("i") <= F.col("copies") % F.col("m")).cast("long")
    return each.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * mine).cast("long").alias("taken"))


QUERIES = {"op3_pivotal_mix": op3_pivotal_mix}
SQL: dict[str, str] = {}
