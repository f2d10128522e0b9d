"""WARC archives: exact round trips, repeats, the merge of runs."""

import gzip
import hashlib
import heapq
import random

from pyspark.sql import functions as F

from tidewire.llm import warc
from tidewire.llm.common import new_path


def test_merge_runs():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16, 33):
        runs = [sorted((rng.randrange(20), i) for i in range(rng.randrange(9))) for _ in range(k)]
        assert [runs[i][j] for i, j in warc.merge_runs(runs)] == list(heapq.merge(*runs))


def test_url_key():
    assert warc.url_key("HTTPS://u:p@www2.Shop.example.com:8080/A/b?z=1&B=2#x") == "com,example,shop)/a/b?b=2&z=1"
    assert [warc.url_key(u) for u in ("http://a.b", "no url", None, "//h/p?")] == ["b,a)/", "no url", "", "h)/p"]


def test_large_member_ends_in_zero():
    big = b"\xff\x00" * (9 << 20)
    data = b"".join(warc._member(str(i), f"http://h/{i}", "2024-01-01T00:00:00Z", p, hashlib.sha256(p).hexdigest(), len(p), None) + b"\0" for i, p in enumerate((b"a", big, b"")))
    assert gzip.decompress(data).count(b"WARC/1.1") == 3
    assert [r[-1] for r in warc._entries("f", data, True)] == [b"a", big, b""]


def pages():
    same, short = "s" * 100, "t" * 99
    rows = [(i, f"http://h{i % 3}.example.com/{i % 5}", same) for i in range(50, 30, -1)] + [(i, "http://x.example.com/", short) for i in range(60, 64)]
    rows += [(1, None, None), (2, "http://a\r\nb/ c", "WARC/1.0\r\n\r\n\x00\x1f\x8b é\r\n\r\n"), (3, "", "y" * 100), (3, "", "y" * 100), (4, "http://z/", "y" * 100), (None, "http://n/", same), (5, "http://long/", "längs " * 300_000)]
    return rows


def check(spark, df, rows, path):
    warc.write(df, path, F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0))))
    got = warc.read(spark, path).collect()
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        keep = first.get(html, i) if len(data) >= 100 else i
        revisit = keep != i
        want.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", str(keep) if revisit else None, None if revisit else data))
    have = [(str(r.id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    assert all(r.intact for r in got)
    return got


def test_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "payload": F.lit("x"), "size": F.lit(2)}).repartition(3)
    path = new_path(spark, "warc")
    got = check(spark, df, rows, path)
    # each record can be read alone
    for r in got[:20]:
        with open(r.file.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            head = gzip.decompress(f.read(r.length))
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())
    urls = {r.id: r.url for r in got}
    assert urls["1"] is None and urls["2"] == "http://a%0D%0Ab/%20c"


def test_hot_payload(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE", 2000)
    rows = [(i, f"http://h/{i}", "hot " * 100) for i in range(3000)] + [(5000 + i, "http://h/1", f"cold {i // 2} " * 40) for i in range(40)]
    check(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), rows, new_path(spark, "warc"))


def test_index_is_in_order(spark):
    path = new_path(spark, "warc")
    rows = [(i, f"http://www.h{i % 7}.example.com/a?{i % 3}", f"{i % 400}" * 60) for i in range(2000)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), path, F.timestamp_seconds(F.col("page_id") % 100))
    got = warc.index(warc.read(spark, path, payload=False))
    parts = got.select("url_key", "date", "payload_digest", "file", "offset", F.input_file_name().alias("part")).collect()
    keys = {}
    for r in parts:
        keys.setdefault(r.part, []).append(tuple(r)[:5])
    assert all(k == sorted(k) for k in keys.values())
    runs = sorted(keys.values())
    assert [x for k in runs for x in k] == sorted(x for k in runs for x in k) and len(parts) == 2000


def test_plain_files_and_empty(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi"
    text = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n" + b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:capture:7:x>\r\nWARC-Date: d\r\nWARC-Payload-Digest: sha256:bad\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    (tmp_path / "part-0.warc").write_bytes(text)
    (r,) = warc.read(spark, str(tmp_path)).collect()
    assert (r.id, r.payload_bytes, bytes(r.payload), r.intact) == ("7", 2, b"hi", False) and text[r.offset : r.offset + r.length].endswith(b"hi\r\n\r\n")
    path = new_path(spark, "warc")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path, F.current_timestamp())
    assert warc.index(warc.read(spark, path, payload=False)).collect() == []
