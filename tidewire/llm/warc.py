"""WARC archives: captures written as gzip members, read back, and indexed by merging sorted runs.

Archives are files in a shared folder; every record is a gzip member of its own, so that an index entry (file, offset,
length) is enough to read it. A capture whose payload another one has already is written as a revisit record.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, save, table

LEAST = 100  #: bytes of a payload from which on equal ones are revisited
FILE = 64 << 20  #: bytes of payload of an archive file, about
HOT_SHARE = 1024  #: a payload of more than 1/HOT_SHARE of the captures is settled before the shuffle; so at most HOT_SHARE are, which bounds the broadcast
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "file string, offset long, length long, record_type string, id string, url string, url_key string, date string, payload_digest string, payload_bytes long, refers_to string, intact boolean"


def _name(id_: str | None, digest: str) -> str:
    return f"<urn:capture:{'!' if id_ is None else quote(id_, safe='')}:{digest}>"


def _id(name: str) -> str | None:
    part = name.strip("<>").split(":")[2]
    return None if part == "!" else unquote(part)


def _member(id_, url, date, payload, digest, size, refers) -> bytes:
    """One record as a gzip member, less the last byte, which is zero: the file's line separator puts it there.

    A member ends in the high byte of its size; from 16 MiB on that is not zero, and an empty member follows.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {_name(id_, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers is not None:
        head += [f"WARC-Refers-To: {refers}", f"WARC-Profile: {_REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    got = gzip.compress("\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n", mtime=0)
    return (got if got[-1] == 0 else got + gzip.compress(b"", mtime=0))[:-1]


def _members(batches):
    for b in batches:
        out, size = [], 0
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            id_, *rest, keep = row
            refers = None if keep is None or keep == id_ else _name(keep, row[4])
            out.append(_member(id_, *rest, refers))
            size += len(out[-1])
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def write(pages: DataFrame, path: str, ts: Column, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write a record a row of pages to archive files in the folder path; ts is its capture time.

    Of captures with equal payloads (by SHA-256) of LEAST bytes and more, the one with the smallest id is a response
    and the others revisit it. A null payload counts as empty; a null id is above every other; rows with the smallest
    id and equal payload are all responses. A null URL leaves its header out; white space and control characters in a
    URL are percent-encoded.
    """
    text = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    caps = pages.select(
        F.col(id_col).alias("key"), F.col(id_col).cast("string").alias("id"), F.col(url_col).cast("string").alias("url"),
        F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), text.alias("payload"), F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("size"))
    same = caps.where(F.col("size") >= LEAST).groupBy("digest").agg(F.min("key").cast("string").alias("keep"), F.count("*").alias("n")).where("n > 1 and keep is not null")
    same = save(same, "warc-repeats")
    total = caps.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    files = max(1, -(-(total["size"] or 0) // FILE))
    often = F.col("n") > max(1, total["n"] // HOT_SHARE)
    hot = F.broadcast(same.where(often).select("digest", F.col("keep").alias("hot")))
    # what a hot payload's other captures refer to is known here, so their bytes stay behind; they and small payloads are dealt anyhow
    any_ = F.pmod(F.xxhash64("id", "url", F.spark_partition_id()), F.lit(files))
    alone = F.col("hot").isNotNull() | (F.col("size") < LEAST)
    rows = caps.drop("key").join(hot, "digest", "left").withColumn("salt", F.when(alone, any_).otherwise(F.lit(0).cast("long")))
    rows = rows.withColumn("payload", F.when(~(F.col("hot").isNotNull() & ~F.col("hot").eqNullSafe(F.col("id"))), F.col("payload")))
    rest = same.where(~often).select("digest", F.lit(0).cast("long").alias("salt"), "keep")
    met = rows.repartition(files, "digest", "salt").join(rest.repartition(files, "digest", "salt"), ["digest", "salt"], "left")
    met = met.select("id", "url", "date", "payload", "digest", "size", F.coalesce("hot", "keep").alias("keep"))
    # raw bytes: the text writer puts them out as they are, and a zero after each
    met.mapInArrow(_members, "member binary").select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of a file; a file without gzip is one member."""
    if data[:2] != b"\x1f\x8b":
        yield 0, len(data), data
        return
    at, view = 0, memoryview(data)
    while at < len(data):
        d, parts, end = zlib.decompressobj(31), [], at
        while not d.eof:
            if end >= len(data):
                raise ValueError(f"member at {at} is cut off")
            parts.append(d.decompress(view[end : end + 65536]))
            end = min(end + 65536, len(data))
        end -= len(d.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers by lower-case name, block) of the records in a member's content."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, stop = end + 4, end + 4 + int(head["content-length"])
        if content[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} is cut off")
        yield at, stop + 4 - at, head, content[start:stop]
        at = stop + 4


def url_key(url: str | None) -> str:
    """Host labels backwards, then path and sorted query, lower-case: com,example,m)/a?b=1. No scheme, user, port, www or fragment."""
    if url is None:
        return ""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?", url)
    if not m:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", m[1].rpartition("@")[2].lower().partition(":")[0])
    query = "?" + "&".join(sorted(m[3].lower().split("&"))) if m[3] else ""
    return ",".join(reversed(host.split("."))) + ")" + (m[2].lower() or "/") + query


def _entries(path: str, data: bytes, payload: bool) -> list[tuple]:
    """A file's captures as rows of RECORD, sorted by URL key, time and record: a run."""
    out = []
    zipped = data[:2] == b"\x1f\x8b"
    for offset, length, content in members(data):
        for at, size, head, block in records(content):
            kind = head["warc-type"]
            if kind not in ("response", "revisit"):
                continue
            http, _, body = block.partition(b"\r\n\r\n")
            digest = head["warc-payload-digest"].rpartition(":")[2]
            told = re.search(rb"(?im)^content-length: *(\d+)", http)
            n = len(body) if kind == "response" else int(told[1]) if told else None
            intact = kind == "revisit" or hashlib.sha256(body).hexdigest() == digest
            url = head.get("warc-target-uri")
            refers = _id(head["warc-refers-to"]) if kind == "revisit" else None
            place = (offset, length) if zipped else (at, size)
            row = (path, *place, kind, _id(head["warc-record-id"]), url, url_key(url), head["warc-date"], digest, n, refers, intact)
            out.append((*row, body if kind == "response" else None) if payload else row)
    out.sort(key=lambda r: (r[6], r[7], r[8], r[1]))
    return out


def _batch(rows: list[tuple], payload: bool) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [tuple(x.split()) for x in RECORD.split(", ")]
    schema = pa.schema([(n, kinds[k]) for n, k in fields] + ([("payload", pa.binary())] if payload else []))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Captures in the archives of a folder, gzipped by record or not at all; each file's stand together, sorted by URL key and time.

    file, offset, length (the member's, or the record's in a plain file), record_type, id, url, url_key, date,
    payload_digest, payload_bytes (of the whole payload, for revisits too), refers_to, intact (a response's payload has its
    digest), and payload (null for revisits). A record that is cut off fails the job.
    """

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, size, some = _entries(name, data.as_py(), payload), 0, []
                for r in rows:
                    some.append(r)
                    size += 300 + (len(r[-1] or b"") if payload else 0)
                    if size > 16 << 20:
                        yield _batch(some, payload)
                        some, size = [], 0
                if some:
                    yield _batch(some, payload)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, RECORD + (", payload binary" if payload else ""))


def merge_runs(runs: list[list[tuple]]) -> Iterator[tuple[int, int]]:
    """(run, place) of all rows of sorted runs in order: a k-way merge by a tree of losers."""
    k = len(runs)
    at = [0] * k
    head = [(0, r[0], i) if r else (1, (), i) for i, r in enumerate(runs)]  # a run at its end stands behind all others
    loser = [-1] * k  # of the match at each inner node; loser[0] is the winner of all

    def play(who: int, build: bool) -> None:
        node = (who + k) // 2
        while node:
            if build and loser[node] < 0:
                loser[node] = who
                return
            if head[loser[node]] < head[who]:
                loser[node], who = who, loser[node]
            node //= 2
        loser[0] = who

    for i in range(k):
        play(i, True)
    while k and head[loser[0]][0] == 0:
        i = loser[0]
        yield i, at[i]
        at[i] += 1
        head[i] = (0, runs[i][at[i]], i) if at[i] < len(runs[i]) else (1, (), i)
        play(i, False)


def index(captures: DataFrame) -> DataFrame:
    """Captures, without payloads, in global order of (url_key, date, digest, file, offset): the histories of all URLs.

    Ranges of that order are the tasks; each gets its slice of every file's sorted run and merges the slices. A URL of
    any number of captures spreads over ranges by time. Partition by partition the result is in order.
    """
    order = ["url_key", "date", "payload_digest", "offset"]

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        keys = list(zip(*[t[c].to_pylist() for c in (*order[:3], "file", "offset")], strict=True))
        runs: dict[str, list[tuple]] = {}
        for i, name in enumerate(t["file"].to_pylist()):
            runs.setdefault(name, []).append((*keys[i], i))
        slices = list(runs.values())
        for s in slices:
            s.sort()  # a slice arrives in order unless a fetch was repeated; sorting an ordered list is one pass
        took = [slices[i][j][-1] for i, j in merge_runs(slices)]
        yield from t.take(pa.array(took, pa.int64())).to_batches(max_chunksize=10_000)

    rows = save(captures.select([x.split()[0] for x in RECORD.split(", ")]), "warc-runs")
    return save(rows.repartitionByRange(*order[:3], "file", "offset").mapInArrow(run, RECORD), "warc-index")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages written as archives, a second apart by id, and read back through the merged index."""
    pages, path = table(spark, sf_dir, "pages"), new_path(spark, "warc")
    write(pages, path, F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0))))
    kind = pages.schema["page_id"].dataType
    got = index(read(spark, path, payload=False))
    return got.select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "url_key", "date", "intact")


SQL = {
    "op12_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, regexp_extract(url, '//([^/?#]*)([^?#]*)(?:\\?([^#]*))?', ['host', 'path', 'query']) AS u FROM pages),
k AS (SELECT *, CASE WHEN strlen(html) >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS keep FROM p)
SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to,
  array_to_string(list_reverse(string_split(regexp_replace(lower(u.host), '^www\\d*\\.', ''), '.')), ',') || ')' || CASE WHEN u.path = '' THEN '/' ELSE lower(u.path) END
    || CASE WHEN u.query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(lower(u.query), '&')), '&') END AS url_key,
  strftime(to_timestamp(1700000000 + page_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS date, true AS intact
FROM k
"""
}
QUERIES = {"op12_warc": op12_warc}
