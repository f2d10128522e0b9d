"""Streams in several micro-batches, with late and repeated rows and a restart, against batch results; stored tables."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from tidewire.sources import sinks
from tidewire.streaming import streams

T0 = dt.datetime(2024, 5, 6, 0, 0)
ROWS = "article_id long, ticker string, cluster_id string, published_ts timestamp"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def run_in_files(spark, tmp_path, batches, schema, build):
    """Feed batches as files, one micro-batch each; the query is stopped in the middle and started again from its checkpoint."""
    os.makedirs(f"{tmp_path}/in")
    query = None
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).repartition(1).write.parquet(f"{tmp_path}/stage{k}")
        (part,) = glob.glob(f"{tmp_path}/stage{k}/part-*")
        os.rename(part, f"{tmp_path}/in/{k:03}.parquet")
        if query is None:
            query = build(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).option("checkpointLocation", f"{tmp_path}/cp").start()
        query.processAllAvailable()
        if k == len(batches) // 2:
            query.stop()
            query = None
    if query is not None:
        query.stop()


def to_parquet(tmp_path):
    return lambda df: df.writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append")


def feeds():
    """Five batches: late rows within two hours, one far too late (left out of `kept`), repeats, and a last row that moves the watermark on."""
    kept = [(i, "A" if i % 3 else "B", f"c{i % 2}", at(7 * i)) for i in range(100)]
    late = [(200 + i, "A", "c0", at(7 * 60 - 30 * i)) for i in range(4)]
    lost = (900, "A", "c0", at(-3000))
    batches = [kept[:40], kept[40:60] + kept[35:45], [*kept[60:80], *late, kept[55]], [*kept[80:], lost, late[0], late[0]], [(999, "Z", "z", at(100_000))]]
    return batches, kept + late


@pytest.mark.parametrize("slide", [None, "30 minutes"])
def test_windows(spark, tmp_path, slide):
    batches, kept = feeds()
    make = lambda m: streams.windowed_attention(m, "2 hours", slide, "4 hours", ["article_id", "ticker"])
    run_in_files(spark, tmp_path, batches, ROWS, lambda m: to_parquet(tmp_path)(make(m)))
    want = make(spark.createDataFrame(kept + kept[:9], ROWS))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, want.collect()))


def test_sessions(spark, tmp_path):
    batches, kept = feeds()
    hole = [r for r in kept if not 200 <= (r[3] - T0).total_seconds() / 60 < 330]  # a silence that a late row may bridge
    batches = [[r for r in b if r in hole or r[0] >= 900] for b in batches]
    make = lambda a: streams.story_sessions(a, "1 hour", "6 hours", ["article_id"])
    run_in_files(spark, tmp_path, batches, ROWS, lambda a: to_parquet(tmp_path)(make(a)))
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, make(spark.createDataFrame(hole + hole[:5], ROWS)).collect())) and len(got) > 2


def test_scores_with_fresh_weights(spark, tmp_path):
    """Each batch takes the weights as they are then; a batch that is run again replaces its rows."""
    schema = "article_id long, title string, body string, lang string, domain string"
    rows = lambda k: [(10 * k + i, "lucro recorde" if i % 2 else "queda forte", None, ["en", "de", None][i % 3], "d1" if i else "d2") for i in range(6)]
    version = {"n": 0}

    def weights_of(s):
        version["n"] += 1
        return s.createDataFrame([("d1", float(version["n"]))], "domain string, weight double")

    sink = sinks.batches(f"{tmp_path}/scored")
    run_in_files(spark, tmp_path, [rows(k) for k in range(4)], schema, lambda a: streams.score_batches(a, weights_of, sink))
    got = spark.read.parquet(f"{tmp_path}/scored").collect()
    assert len(got) == 4 * 4 and {r.source_weight for r in got if r.domain == "d2"} == {None}  # German is not covered
    assert {(r.article_id // 10, r.source_weight) for r in got if r.domain == "d1"} == {(k, k + 1.0) for k in range(4)}
    want = streams.score_stream(spark.createDataFrame(rows(2), schema), spark.createDataFrame([("d1", 3.0)], "domain string, weight double"))
    assert sorted(map(str, want.collect())) == sorted(str(r) for r in spark.read.parquet(f"{tmp_path}/scored").select(want.columns).where("article_id between 20 and 29").collect())
    sink(want, 2)
    assert spark.read.parquet(f"{tmp_path}/scored").count() == 16


def test_ingest_with_offsets(spark, tmp_path):
    schema = "url string, domain string, published_ts timestamp, ingested_ts timestamp"
    rows = [[(f"u{i % 5}", "off" if i % 5 % 2 else "ok", at(60 + i), at(120)) for i in range(10)], [("u1", "off", at(61), at(120)), ("u9", None, at(70), at(120))], [("u8", "ok", at(90_000), at(90_001))]]
    offsets = spark.createDataFrame([("off", -3600, "wrong"), ("ok", 7200, "suspicion")], "domain string, offset_s long, verdict string")
    run_in_files(spark, tmp_path, rows, schema, lambda a: to_parquet(tmp_path)(streams.ingest_articles(a, "1 hour", offsets)))
    got = {r.url: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert set(got) == {"u0", "u1", "u2", "u3", "u4", "u9", "u8"}
    assert all(r.suspect is None for r in got.values()) and got["u9"].late_s == 3000
    moved = [r for r in got.values() if r.domain == "off"]
    assert moved and all((r.ingested_ts - r.published_ts).total_seconds() == r.late_s > 3600 for r in moved)


def stored(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).select("id", "v", "ver", "day").collect()), key=str)


def batch(spark, rows):
    return spark.createDataFrame(rows, "id long, v string, ver int, day int")


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/day=*/part-*")}


def test_insert_into_stored(spark, tmp_path):
    path = f"{tmp_path}/t"
    first = batch(spark, [(i, "a", 1, i % 4) for i in range(40)] + [(0, "again", 2, 0), (77, "x", 1, None)])
    sinks.insert_into(path, first, ["id"], "day", ["ver"])
    assert len(stored(spark, path)) == 41
    kept, before = stored(spark, path), files(path)
    sinks.insert_into(path, first, ["id"], "day", ["ver"])
    assert stored(spark, path) == kept and files(path) == before
    new = batch(spark, [(2, "late", 9, 2), (100, "new", 1, 2), (100, "new", 2, 2), (78, "y", 1, None), (77, "z", 3, None)])
    hit = sinks.touched(path, new, "day")
    scan = next(x for x in hit._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
    assert "PartitionFilters: [((day" in scan and {r[0].split("day=")[1].split("/")[0] for r in hit.select(F.input_file_name()).distinct().collect()} == {"2", "__HIVE_DEFAULT_PARTITION__"}
    sinks.insert_into(path, new, ["id"], "day", ["ver"])
    assert sorted(set(stored(spark, path)) - set(kept), key=str) == [(100, "new", 1, 2), (78, "y", 1, None)]
    assert all(files(path)[f] == t for f, t in before.items())


def test_upsert_into_stored(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.upsert_into(path, batch(spark, [(i, "a", 1, i % 4) for i in range(40)]), ["id"], "ver", "day")
    before = files(path)
    new = batch(spark, [(1, "b", 2, 1), (1, "c", 3, 1), (101, "n", 1, 1)])
    for _ in range(2):
        sinks.upsert_into(path, new, ["id"], "ver", "day")
        want = [(i, "a", 1, i % 4) for i in range(40) if i != 1] + [(1, "c", 3, 1), (101, "n", 1, 1)]
        assert stored(spark, path) == sorted(want, key=str)
    assert {f for f, t in files(path).items() if before.get(f) == t} == {f for f in before if "day=1/" not in f}
