"""WARC records, and resolution of not-modified revisits.

A revisit (a 304 answer) has no body. It is joined as of its time to the latest earlier full response of the same
canonical URL; its validators are compared (entity tag, else last-modified, else payload digest), and the headers that
a 304 may update are merged into the response's.

The as-of join has two levels, so that a URL with a third of all rows is split: records are dealt by (URL, stretch of
time); each stretch's last response is carried over to later stretches in a table of one row for each of them.

A revisit whose profile says identical-payload-digest is told by its digest alone, and its own headers, being those of
a whole answer, go before the response's.

Defined cases: null URLs match nothing; a null time is before all others; of records with equal times a response comes
before a revisit, then the smaller id; a revisit without validators takes the response as it is; revisits without an
earlier response are `unresolved`, with other validators `mismatch`; null headers are empty; payloads stay where they
are, so their length does not matter here; repeated records give a row each; of responses that share an id the latest
brings the headers; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import datetime
import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep

#: Headers that a 304 answer may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
STRETCH = 3600


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no scheme difference, no www., default port, fragment or last slash; query sorted."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, "^[^/?]*", 0)), "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(u, "\\?(.*)$", 1)
    query = F.when(query != "", F.concat(F.lit("?"), F.array_join(F.sort_array(F.split(query, "&")), "&"))).otherwise("")
    return F.concat(host, path, query)


def resolve(records: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """records: record_id, url, ts (seconds), kind ('response' or 'revisit'), etag, last_modified, digest, headers (map), and profile if there.

    One row for each record: record_id, canonical, kind, status (full, resolved, mismatch, unresolved), refers_to, headers.
    """
    told = F.coalesce(F.col("profile").contains("identical-payload-digest"), F.lit(False)) if "profile" in records.columns else F.lit(False)
    r = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), "ts", "kind", "etag", "last_modified", "digest", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), told.alias("by_digest"))
    order = F.struct("ts", (F.col("kind") != "response").alias("late"), "record_id")
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified", "digest"))
    r = r.withColumn("part", F.floor(F.coalesce("ts", F.lit(0)) / stretch)).withColumn("full", full)
    last = r.filter("full IS NOT NULL AND canonical IS NOT NULL").groupBy("canonical", "part").agg(F.max("full").alias("last"))
    every = r.select("canonical", "part").filter("canonical IS NOT NULL").distinct().join(last, ["canonical", "part"], "left")
    before = Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.withColumn("carried", F.last("last", ignorenulls=True).over(before)).select("canonical", "part", "carried")
    within = Window.partitionBy("canonical", "part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    known = r.filter("canonical IS NOT NULL").withColumn("near", F.last("full", ignorenulls=True).over(within)).join(carried, ["canonical", "part"], "left")
    known = known.withColumn("to", F.coalesce("near", "carried")).drop("near", "carried")
    rows = known.unionByName(r.filter("canonical IS NULL").withColumn("to", F.lit(None).cast(known.schema["to"].dataType)))
    by_validators = (
        F.when(F.col("etag").isNotNull() & F.col("to.etag").isNotNull(), F.col("etag") == F.col("to.etag"))
        .when(F.col("last_modified").isNotNull() & F.col("to.last_modified").isNotNull(), F.col("last_modified") == F.col("to.last_modified"))
        .when(F.col("digest").isNotNull() & F.col("to.digest").isNotNull(), F.col("digest") == F.col("to.digest"))
        .otherwise(F.lit(True))
    )
    same = F.when(F.col("by_digest"), F.coalesce(F.col("digest") == F.col("to.digest"), F.lit(False))).otherwise(by_validators)
    status = F.when(F.col("kind") == "response", "full").when(F.col("to").isNull(), "unresolved").when(same, "resolved").otherwise("mismatch")
    rows = rows.withColumn("status", status)
    out = ["record_id", "canonical", "kind", "status", "refers_to", "headers"]
    settled = rows.filter("status <> 'resolved'").withColumn("refers_to", F.lit(None).cast(rows.schema["record_id"].dataType)).select(out)
    # headers live in the full records; only resolved revisits fetch them, so a null id meets nothing
    resolved = rows.filter("status = 'resolved'").withColumn("refers_to", F.col("to.record_id"))
    given = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    theirs = records.filter("kind = 'response'").select(F.col("record_id").alias("refers_to"), "ts", F.sort_array(F.map_entries(given)).alias("theirs"))
    theirs = theirs.groupBy("refers_to").agg(F.max(F.struct("ts", "theirs")).alias("t")).select(F.col("refers_to").alias("theirs_id"), F.map_from_entries("t.theirs").alias("theirs"))
    # written first: a join on what an aggregation has just dealt out could not split a response with very many revisits
    theirs = keep(theirs)
    resolved = resolved.join(theirs, F.col("refers_to").eqNullSafe(F.col("theirs_id")), "left")
    new = F.map_filter("headers", lambda k, _: F.col("by_digest") | F.lower(k).isin(*PERMITTED))
    kept = F.map_filter("theirs", lambda k, _: ~F.array_contains(F.transform(F.map_keys(new), F.lower), F.lower(k)))
    return settled.unionByName(resolved.withColumn("headers", F.map_concat(kept, new)).select(out))


def parse(data: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of a plain or gzipped WARC file; a cut-off last record is left out."""
    raw = pa.BufferReader(data)
    f = gzip.open(raw) if bytes(data[:2]) == b"\x1f\x8b" else io.BufferedReader(raw) if len(data) else io.BytesIO()
    while True:
        try:
            line = f.readline()
            while line in (b"\r\n", b"\n"):
                line = f.readline()
            if not line.startswith(b"WARC/"):
                return
            head = {}
            while (line := f.readline()) not in (b"\r\n", b"\n", b""):
                k, _, v = line.decode("utf-8", "replace").partition(":")
                head[k.strip().lower()] = v.strip()
            n = int(head.get("content-length", "0"))
            block = f.read(n)
        except (EOFError, ValueError, gzip.BadGzipFile):
            return
        if len(block) < n:
            return
        yield head, block


def build(records: list[tuple[dict[str, str], bytes]], compress: bool = True) -> bytes:
    """A WARC file; compressed, each record is a gzip member of its own."""
    out = b""
    for head, block in records:
        raw = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
        out += gzip.compress(raw, mtime=0) if compress else raw
    return out


def http_parts(block: bytes) -> tuple[int, dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    code = lines[0].split(" ")[1:2]
    return int(code[0]) if code and code[0].isdigit() else 0, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, body


RECORDS = "record_id string, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>, profile string, body binary"
#: Bytes of bodies in one batch of rows.
FLUSH = 8 << 20


def record_row(head: dict[str, str], block: bytes) -> tuple | None:
    """A row of RECORDS; None for records that are neither response nor revisit."""
    kind = head.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    _, http, body = http_parts(block)
    try:
        ts = int(datetime.datetime.fromisoformat(head["warc-date"].replace("Z", "+00:00")).timestamp())
    except (KeyError, ValueError):
        ts = None
    return (head.get("warc-record-id"), head.get("warc-target-uri"), ts, kind, http.get("etag"), http.get("last-modified"), head.get("warc-payload-digest"), list(http.items()), head.get("warc-profile"), body if kind == "response" else None)


def record_batches(batches):
    """Files come in; rows of RECORDS go out as the file is read, FLUSH bytes of bodies at a time."""
    s = pa.string()
    types, names = (s, s, pa.int64(), s, s, s, s, pa.map_(s, s), s, pa.binary()), [x.split()[0] for x in RECORDS.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for data in batch.column("content"):
            rows, size = [], 0
            for head, block in parse(memoryview(data.as_buffer())):
                row = record_row(head, block)
                if row:
                    rows.append(row)
                    size += len(block)
                if size >= FLUSH:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files as rows for resolve, with the body.

    A file is one task's work, as gzip cannot be split; it is held once, as stored, and unpacked record by record. Files
    of 2 GB and more do not fit into a row; WARC files are made of 1 GB at most by custom.
    """
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(record_batches, RECORDS)


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Each page as a response at 10 s times its id, a revisit 5 s before it and one 75 s after it, with its validators."""
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("d")) for i, d in ((0, 0), (1, -5), (2, 75))]))
    p = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"), F.length(F.coalesce("html", F.lit(""))).alias("n"), at.alias("x"))
    ts = F.col("page_id") * 10 + F.col("x.d")
    response = F.col("x.i") == 0
    headers = F.when(response, F.create_map(F.lit("content-length"), F.col("n").cast("string"), F.lit("date"), ts.cast("string"), F.lit("etag"), F.col("digest"))).otherwise(F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), ts.cast("string")))
    return p.select((F.col("page_id") * 3 + F.col("x.i")).alias("record_id"), "url", ts.alias("ts"), F.when(response, "response").otherwise("revisit").alias("kind"), F.col("digest").alias("etag"), F.lit(None).cast("string").alias("last_modified"), "digest", headers.alias("headers"))


def revisit_report(pages: DataFrame) -> DataFrame:
    out = resolve(records_of_pages(pages))
    h = F.array_join(F.transform(F.sort_array(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select("record_id", "canonical", "kind", "status", "refers_to", h.alias("headers"))


SQL = r"""
WITH p AS (SELECT page_id, url, md5(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS n FROM pages),
u AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM p),
c AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '')
    || CASE WHEN regexp_extract(u, '\?(.*)$', 1) <> '' THEN '?' || array_to_string(list_sort(string_split(regexp_extract(u, '\?(.*)$', 1), '&')), '&') ELSE '' END AS canonical FROM u),
r AS (SELECT page_id * 3 + i AS record_id, canonical, page_id * 10 + d AS ts, i, digest, n FROM c, (VALUES (0, 0), (1, -5), (2, 75)) v(i, d)),
w AS (SELECT *, CASE WHEN canonical IS NOT NULL THEN last_value(CASE WHEN i = 0 THEN {'id': record_id, 'ts': ts, 'digest': digest, 'n': n} END IGNORE NULLS)
    OVER (PARTITION BY canonical ORDER BY ts, i <> 0, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS t FROM r)
SELECT record_id, canonical, CASE WHEN i = 0 THEN 'response' ELSE 'revisit' END AS kind,
  CASE WHEN i = 0 THEN 'full' WHEN t IS NULL THEN 'unresolved' WHEN t.digest = digest THEN 'resolved' ELSE 'mismatch' END AS status,
  CASE WHEN i <> 0 AND t.digest = digest THEN t.id END AS refers_to,
  CASE WHEN i = 0 THEN 'content-length=' || n || ';date=' || ts || ';etag=' || digest
    WHEN t.digest = digest THEN 'content-length=' || t.n || ';date=' || ts || ';etag=' || digest ELSE 'content-length=0;date=' || ts END AS headers
FROM w
"""
