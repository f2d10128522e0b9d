"""SimHash near-duplicates: fingerprints, bucket tables, bit-sliced Hamming comparison, components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, fresh, save, table

TILE = 4096  #: rows of one bucket that are compared in one piece; a larger bucket is split into pairs of tiles
BUFFER = 32_768  #: rows a task gathers before it compares the buckets it has complete
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


# ---- fingerprints ---------------------------------------------------------------------------------

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def majority(h: np.ndarray, words: int) -> np.ndarray:
    """64*words majority bits of the hashes h, as uint64[words]. Words after the first come from remixed hashes."""
    cols = [h]
    for k in range(1, words):
        x = (h ^ (_MIX[2] * np.uint64(k))) * _MIX[0]
        x = (x ^ (x >> np.uint64(29))) * _MIX[1]
        cols.append(x ^ (x >> np.uint64(32)))
    by = np.stack(cols, axis=1).view(np.uint8)  # rows x 8*words, little endian
    flat = (by + np.arange(by.shape[1], dtype=np.int64) * 256).ravel()
    ones = np.bincount(flat, minlength=256 * by.shape[1]).reshape(by.shape[1], 256) @ _BITS
    return np.packbits(ones * 2 > len(h), axis=1, bitorder="little").ravel().view(np.uint64)


def shingle_hashes(words: list[bytes], k: int, distinct: bool = False) -> np.ndarray:
    """XXH64 (seed 42) of each run of k words joined by a space; of all words where there are fewer than k."""
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    runs = [b" ".join(words)] if len(words) < k else words if k == 1 else map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    return np.fromiter((h(x, 42) for x in (set(runs) if distinct else runs)), dtype=np.uint64)


def raw_words(text: str) -> list[bytes]:
    """A-Z lower-cased, split at space and U+0009 to U+000D."""
    return text.encode("utf-8", "surrogatepass").lower().split()


_PUNCT = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(128)))


def plain_words(text: str) -> list[bytes]:
    """Lower-cased words with ASCII punctuation taken as space, so that case and punctuation edits don't count."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PUNCT).split()


def contract_features(text: str) -> np.ndarray:
    """64 bits from 3-word shingles, repeats included."""
    return majority(shingle_hashes(raw_words(text), 3), 1)


def fingerprints(docs: DataFrame, features=contract_features, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp as binary, 64-bit words big endian. A null or empty text has the fingerprint zero."""

    def run(batches):
        for b in batches:
            fps = [features(t or "").astype(">u8").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary())], ["id", "fp"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, fp binary")


# ---- bucket keys ----------------------------------------------------------------------------------

def exact_keys(bands: int, radius: int):
    """Keys that any two 64-bit fingerprints within radius share one of: all choices of bands - radius bands (pigeonhole)."""
    cuts = [round(64 * i / bands) for i in range(bands + 1)]
    with_salt = [np.array([((i + 1) * 0xC2B2AE3D27D4EB4F) % 2**64], np.uint64) for i in range(len(list(combinations(range(bands), radius))))]
    masks = [sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen) for chosen in combinations(range(bands), bands - radius)]

    def keys(fp: np.ndarray) -> np.ndarray:
        return np.stack([(fp[:, 0] & np.uint64(m)) * _MIX[0] + with_salt[i] for i, m in enumerate(masks)], axis=1)

    return keys


# ---- bit-sliced comparison ------------------------------------------------------------------------

def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links (a, b) connect, at most one a node."""
    lab = np.arange(n)
    while True:
        m = np.minimum(lab[a], lab[b])
        if (lab[a] == lab[b]).all():
            break
        np.minimum.at(lab, lab[a], m)
        np.minimum.at(lab, lab[b], m)
        while (lab[lab] != lab).any():
            lab = lab[lab]
    at = np.flatnonzero(lab != np.arange(n))
    return at, lab[at]


def _csa(a, b, c):
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def links(group: np.ndarray, fp: np.ndarray, radius: int, step: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one group (groups stand together) at most `radius` bits apart, reduced to a spanning forest.

    Bit planes are stored vertically: bit i of word j of plane p is bit p of row 64*j + i. A row meets the
    64 rows of a block at once: the plane's word, inverted where the row's own bit is set, marks differing
    lanes; carry-save adders sum eight planes into the vertical counters; after every 32 planes, blocks
    in which all lanes exceed the radius are abandoned.
    """
    n, bits = len(fp), 64 * fp.shape[1]
    lanes = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")
    pad = np.zeros((-(-n // 64) * 64, bits), np.uint8)
    pad[:n] = lanes
    planes = np.packbits(np.ascontiguousarray(pad.T), axis=1, bitorder="little").view(np.uint64)
    ends = np.flatnonzero(np.r_[group[1:] != group[:-1], True]) + 1
    end = np.repeat(ends, np.diff(np.r_[0, ends]))
    row = np.arange(n)
    row = row[end - row > 1]
    count = (end[row] - 1) // 64 - (row + 1) // 64 + 1
    total, levels, found = np.cumsum(count), int(bits).bit_length(), []
    for lo in range(0, int(total[-1]) if len(row) else 0, step):
        task = np.arange(lo, min(lo + step, int(total[-1])))
        k = np.searchsorted(total, task, side="right")
        q = row[k]
        blk = (q + 1) // 64 + task - (total[k] - count[k])
        first, last = np.maximum(q + 1, blk * 64) - blk * 64, np.minimum(end[q], blk * 64 + 64) - blk * 64
        full = ~np.uint64(0)
        live = (full << first.astype(np.uint64)) & (full >> (64 - last).astype(np.uint64))
        counter = [np.zeros(len(task), np.uint64) for _ in range(levels)]
        for p in range(0, bits, 8):
            x = [planes[i][blk] ^ (np.uint64(0) - lanes[q, i]) for i in range(p, p + 8)]
            ones, a = _csa(counter[0], x[0], x[1])
            ones, b = _csa(ones, x[2], x[3])
            twos, fa = _csa(counter[1], a, b)
            ones, a = _csa(ones, x[4], x[5])
            ones, b = _csa(ones, x[6], x[7])
            twos, fb = _csa(twos, a, b)
            fours, carry = _csa(counter[2], fa, fb)
            counter[0], counter[1], counter[2] = ones, twos, fours
            for i in range(3, levels):
                counter[i], carry = counter[i] ^ carry, counter[i] & carry
            if p % 32 == 24 or p + 8 == bits:
                over, same = np.zeros(len(q), np.uint64), np.full(len(q), full)
                for i in reversed(range(levels)):
                    if radius >> i & 1:
                        same &= counter[i]
                    else:
                        over |= same & counter[i]
                        same &= ~counter[i]
                live &= ~over
                keep = np.flatnonzero(live)
                if len(keep) < len(q):
                    q, blk, live, counter = q[keep], blk[keep], live[keep], [c[keep] for c in counter]
                if not len(q):
                    break
        if len(q):
            at, lane = np.nonzero(np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            found.append(_forest(n, q[at], blk[at] * 64 + lane))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _forest(n, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def near_links(reps: DataFrame, keys, compare: slice, radius: int, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp that share a key and differ in at most radius bits.

    Each fingerprint goes to the bucket of each of its keys; buckets of one are dropped by a pre-aggregated
    count. A bucket of more than `tile` rows is cut into tiles and each pair of tiles is a task's work of
    its own, so no bucket, however hot, meets in one place. Links of one piece are reduced to a spanning forest,
    which keeps every component.
    """

    def deal(batches):
        for b in batches:
            raw = b.column(0).to_pylist()
            if raw:
                k = keys(np.frombuffer(b"".join(raw), ">u8").reshape(len(raw), -1).astype(np.uint64)).view(np.int64)
                fps = pa.array(raw, pa.binary()).take(pa.array(np.repeat(np.arange(len(raw)), k.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), fps], ["key", "fp"])

    def meet(batches):
        held: list[pa.Table] = []

        def run(t: pa.Table):
            raw = t.column("fp").to_pylist()
            fp = np.frombuffer(b"".join(raw), ">u8").reshape(len(raw), -1).astype(np.uint64)
            g = np.stack([t.column(c).to_numpy() for c in ("key", "p", "q")], axis=1)
            new = np.r_[True, (g[1:] != g[:-1]).any(axis=1)]
            a, b = links(np.cumsum(new), np.ascontiguousarray(fp[:, compare]), radius)
            return pa.RecordBatch.from_arrays([pa.array([raw[i] for i in a], pa.binary()), pa.array([raw[i] for i in b], pa.binary())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) >= BUFFER:
                t = pa.concat_tables(held)
                g = np.stack([t.column(c).to_numpy() for c in ("key", "p", "q")], axis=1)
                cut = int(np.r_[0, np.flatnonzero((g[1:] != g[:-1]).any(axis=1)) + 1][-1])  # the last group may go on
                if cut:
                    yield run(t.slice(0, cut))
                held = [t.slice(cut)]
        if held:
            yield run(pa.concat_tables(held))

    dealt = reps.select("fp").mapInArrow(deal, "key long, fp binary")
    counts = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("p"), F.greatest(o, F.col("mine")).alias("q")))
    small = dealt.join(counts, "key").withColumn("tiles", tiles).withColumn("mine", mine)
    spread = small.select("key", "fp", F.explode(pairs).alias("pq")).select("key", "pq.p", "pq.q", "fp")
    met = spread.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return met.mapInArrow(meet, "a binary, b binary").distinct()


def near_groups(fps: DataFrame, keys, compare: slice, radius: int, tile: int = TILE) -> DataFrame:
    """(fp, component): for each distinct fingerprint the least id of its component."""
    reps = save(fps.groupBy("fp").agg(F.min("id").alias("first")), "fingerprints")
    return connected(reps, near_links(reps, keys, compare, radius, tile))


def connected(reps: DataFrame, linked: DataFrame) -> DataFrame:
    """(fp, component): for each row (fp, first) of reps the least first of what the links (a, b) connect it to."""
    comp = components(save(linked, "links"), "a", "b")
    rooted = reps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    return rooted.join(least, "root").select("fp", "component")


# ---- near copies by shingles ----------------------------------------------------------------------

ORDER_SAMPLE, ORDER_LEAST, ORDER_MOST = 8_000, 3, 1 << 17  #: shingles common in a sample of documents go last in the order of prefixes; any order gives the same links
SKETCH = 8  #: 64-bit words of the SimHash of a shingle set
SKETCH_TILE, SET_TILE = 4096, 512  #: rows of one group whose SimHashes, or whose shingle sets, are compared in one piece
PIVOTS = 16  #: about so many rows of a group beyond a tile meet all its tiles


def set_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of five-word shingles, case and ASCII punctuation aside."""
    return np.unique(shingle_hashes(plain_words(text or ""), 5, True))


def sketch_radius(similarity: float) -> int:
    """Bits in which the SimHashes of two sets of at least that Jaccard similarity may differ.

    A bit differs with the probability p = acos(2s / (1 + s)) / pi at most (0.19 for the smallest sets at s = 0.8); eight
    standard deviations beyond leave a pair a chance under 1e-7 to be missed, and 1e-11 for sets of over four shingles.
    """
    p, n = np.arccos(2 * similarity / (1 + similarity)) / np.pi, 64 * SKETCH
    return int(n * p + 8.2 * np.sqrt(n * p * (1 - p)))


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of shingles common in about ORDER_SAMPLE of the texts (id, t): ORDER_MOST at most."""

    def run(batches):
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(set_hashes(t).view(np.int64))], ["h"])

    share = min(1.0, ORDER_SAMPLE / max(1, texts.count()))
    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("t")
    n = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= ORDER_LEAST)
    got = n.orderBy(F.desc("n"), "h").limit(ORDER_MOST).toArrow()
    h, n = got["h"].to_numpy().view(np.uint64), got["n"].to_numpy()
    at = np.argsort(h)
    return h[at], n[at]


def sketches(texts: DataFrame, similarity: float) -> DataFrame:
    """(id, fp, sim, keys) of texts (id, t): of the shingle set a digest, the SimHash and the prefix: of n shingles in one
    order for all texts, the first n - ceil(similarity * n) + 1. Two sets of at least that Jaccard similarity share one of them."""
    shared = texts.sparkSession.sparkContext.broadcast(common_shingles(texts))

    def run(batches):
        often, counts = shared.value
        for b in batches:
            fps, sims, keys = [], [], []
            for t in b.column(1).to_pylist():
                h = set_hashes(t)
                at = np.minimum(np.searchsorted(often, h), max(0, len(often) - 1))
                n = np.where(often[at] == h, counts[at], 0) if len(often) else np.zeros(len(h), np.int64)
                most = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1 if len(h) else 0
                fps.append(xxhash.xxh3_128_digest(h.tobytes()))
                sims.append(majority(h, SKETCH).tobytes())
                keys.append(h[np.lexsort((h, n))[:most]].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary()), pa.array(sims, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "fp", "sim", "keys"])

    return texts.select("id", "t").mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, fp binary, sim binary, keys array<long>")


def group_links(rows: DataFrame, compare, tile: int, held_rows: int) -> DataFrame:
    """Links (a, b) that connect, within each group of rows (grp long, rid long, x binary), what compare links.

    compare(group, x) gets whole pieces, rows of one piece standing together, and returns positions of links, at most one
    a row and such that all pairs of a piece that are linked are connected. A group of up to `tile` rows is one piece. A larger
    one is dealt to tiles, and about PIVOTS of its rows to all of them. What this leaves apart meets in a second
    round: rows outside the group's largest component, in tiles, against all rows of the group, in tiles. So every pair is
    compared or connected already, no piece holds more than about two tiles, and a group of copies costs one pass.
    """

    def meet(batches):
        held: list[pa.Table] = []

        def run(t: pa.Table):
            g = np.stack([t.column(c).to_numpy() for c in ("grp", "p", "q")], axis=1)
            rid = t.column("rid").to_numpy()
            a, b = compare(np.cumsum(np.r_[True, (g[1:] != g[:-1]).any(axis=1)]), t.column("x").to_pylist())
            on = rid[a] != rid[b]
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(rid[a], rid[b])[on]), pa.array(np.minimum(rid[a], rid[b])[on])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) >= held_rows:
                t = pa.concat_tables(held)
                g = np.stack([t.column(c).to_numpy() for c in ("grp", "p", "q")], axis=1)
                cut = int(np.r_[0, np.flatnonzero((g[1:] != g[:-1]).any(axis=1)) + 1][-1])  # the last piece may go on
                if cut:
                    yield run(t.slice(0, cut))
                held = [t.slice(cut)]
        if held:
            yield run(pa.concat_tables(held))

    def linked(pieces: DataFrame) -> DataFrame:
        met = pieces.select("grp", "p", "q", "rid", "x").repartition("grp", "p", "q").sortWithinPartitions("grp", "p", "q", "rid")
        return save(met.mapInArrow(meet, "a long, b long").distinct(), "links")

    counts = rows.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1")
    sized = rows.join(counts, "grp").withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    mine = F.pmod(F.xxhash64("rid"), F.col("tiles")).cast("int")
    pivot = F.pmod(F.xxhash64("rid", F.lit(7)), F.ceil(F.col("n") / PIVOTS)) == 0
    everywhere = F.sequence(F.lit(0), F.col("tiles") - 1)
    once = sized.withColumn("p", F.explode(F.when((F.col("tiles") > 1) & pivot, everywhere).otherwise(F.array(mine)))).withColumn("q", F.lit(-1))
    first = linked(once)
    large = sized.where("tiles > 1")
    if large.select("grp").isEmpty():
        return first
    root = components(first, "a", "b")
    apart = large.join(root.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    apart = save(apart.select("grp", "rid", "x", "n", "tiles", "root"), "apart")
    sizes = apart.groupBy("grp", "root").agg(F.count("*").alias("m"))
    most = sizes.groupBy("grp").agg(F.max(F.struct("m", "root")).alias("big"))
    apart = apart.join(most, "grp").where("big.m < n").withColumn("rest", F.ceil((F.col("n") - F.col("big.m")) / tile).cast("int"))
    spread = F.pmod(F.xxhash64("rid", F.lit(3)), F.col("rest")).cast("int")
    left = apart.where("root != big.root").select("*", spread.alias("p"), F.explode(everywhere).alias("q"))
    right = apart.select("*", F.explode(F.sequence(F.lit(0), F.col("rest") - 1)).alias("p"), mine.alias("q"))
    return first.unionByName(linked(left.unionByName(right).dropDuplicates(["grp", "p", "q", "rid"])))


def sketch_links(radius: int):
    """compare for group_links: SimHashes within radius, bit-sliced."""

    def compare(group: np.ndarray, x: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return links(group, np.frombuffer(b"".join(x), np.uint64).reshape(len(x), -1), radius)

    return compare


def set_links(similarity: float):
    """compare for group_links: shingle sets (sorted hashes) of at least that Jaccard similarity; each pair not yet connected is compared."""

    def one(sets: list[np.ndarray]) -> list[tuple[int, int]]:
        size = np.array([len(s) for s in sets])
        codes, at = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(size)
        lab, out, mark = np.arange(len(sets)), [], np.zeros(len(codes) + 1, np.int32)
        at = np.r_[at, len(codes)]  # so that a last empty set has a place to start at
        for i in range(len(sets) - 1):
            if (lab[i + 1 :] == lab[i]).all():
                continue
            mine = at[ends[i] - size[i] : ends[i]]
            mark[mine] = 1
            both = np.add.reduceat(mark[at[ends[i] :]], ends[i:-1] - ends[i]) * (size[i + 1 :] > 0)
            mark[mine] = 0
            union = size[i] + size[i + 1 :] - both
            for j in np.flatnonzero((both >= similarity * union - 1e-9) & (lab[i + 1 :] != lab[i])) + i + 1:
                if lab[i] != lab[j]:
                    out.append((i, int(j)))
                    lab[lab == lab[j]] = lab[i]
        return out

    def compare(group: np.ndarray, x: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ends = np.flatnonzero(np.r_[group[1:] != group[:-1], True]) + 1
        got = [(s + i, s + j) for s, e in zip(np.r_[0, ends[:-1]], ends, strict=True) for i, j in one([np.frombuffer(v, np.uint64) for v in x[s:e]])]
        return tuple(np.array(got, np.int64).reshape(-1, 2).T)

    return compare


def shingle_links(texts: DataFrame, reps: DataFrame, similarity: float, tiles: tuple[int, int] = (SKETCH_TILE, SET_TILE)) -> DataFrame:
    """Links (a, b) between the rows rid of reps (rid, first, sim, keys) whose shingle sets have at least that Jaccard similarity.

    Rows meet in the bucket of each prefix key they share; of buckets with the same members one is enough. There their
    SimHashes are compared bit-sliced. What lies within the radius forms families, and only their texts are read again, once:
    within a family the shingle sets themselves are compared.
    """
    dealt = reps.select(F.explode("keys").alias("grp"), "rid")
    counts = dealt.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp")
    met = save(dealt.join(counts, "grp"), "buckets")
    same = met.groupBy("grp").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("y"))
    one = same.groupBy("n", "x", "y").agg(F.min("grp").alias("grp")).select("grp")
    rows = save(met.join(one, "grp").join(reps.select("rid", F.col("sim").alias("x")), "rid"), "buckets")
    near = group_links(rows, sketch_links(sketch_radius(similarity)), tiles[0], BUFFER)
    found = save(components(near, "a", "b"), "families")
    family = found.select(F.col("root").alias("grp"), F.col("node").alias("rid")).unionByName(found.select(F.col("root").alias("grp"), F.col("root").alias("rid")).distinct())
    wanted = family.join(reps.select("rid", "first"), "rid")

    def hashes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([set_hashes(t).tobytes() for t in b.column(2).to_pylist()], pa.binary())], ["grp", "rid", "x"])

    read = texts.join(wanted, F.col("id").eqNullSafe(F.col("first"))).select("grp", "rid", "t").dropDuplicates(["rid"])
    sets = save(read.mapInArrow(hashes, "grp long, rid long, x binary"), "sets")
    return group_links(sets, set_links(similarity), tiles[1], tiles[1])


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, tiles: tuple[int, int] = (SKETCH_TILE, SET_TILE)) -> DataFrame:
    """Rows of docs that stay: of each group of near copies the row with the smallest id.

    Near copies: sets of five-word shingles (case and ASCII punctuation aside, compared by 64-bit hashes) with a Jaccard
    similarity of at least `similarity`, and what such pairs connect. Pairs are sought by prefix keys, which every such pair
    shares, then by bit-sliced SimHash within sketch_radius, then by the sets. Null texts count as
    empty; texts without words are near copies of each other. A null id counts as smallest; of equal ids the
    smaller hash of the text decides. Rows with equal id and equal text are one document: they stay or go together.
    """
    row, mine = fresh(docs, "row", "kept_row")
    keyed = docs.withColumn(row, F.struct(F.col(id_col), F.xxhash64(id_col, F.coalesce(F.col(text_col), F.lit("")))))
    texts = keyed.select(F.col(row).alias("id"), F.col(text_col).cast("string").alias("t"))
    least = sketches(texts, similarity).groupBy("fp").agg(F.min(F.struct("id", "sim", "keys")).alias("m"))
    reps = save(least.select(F.monotonically_increasing_id().alias("rid"), F.col("m.id").alias("first"), "m.sim", "m.keys"), "sketches")
    comp = components(shingle_links(texts, reps, similarity, tiles), "a", "b")
    rooted = save(reps.select("rid", "first").join(comp.withColumnRenamed("node", "rid"), "rid", "left").select("first", F.coalesce("root", "rid").alias("root")), "rooted")
    keep = rooted.groupBy("root").agg(F.min("first").alias(mine)).select(mine)
    return keyed.join(keep, F.col(row).eqNullSafe(F.col(mine)), "left_semi").drop(row)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = save(fingerprints(table(spark, sf_dir, "documents")), "documents-fp")
    got = near_groups(fps, exact_keys(4, 2), slice(0, 1), 2)
    return fps.join(got, "fp").select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op7_simhash": op7_simhash}
SQL: dict[str, str] = {}
