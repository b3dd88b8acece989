"""Exact dedup with an extendible-hash index on shared files.

Every text has a key, the leading bits of its SHA-256. The directory maps the leading bits of a key to a bucket; it
starts with one bucket. While a bucket holds more entries than its capacity it splits in two by one more bit, and when
its bits are as many as the directory's, the directory doubles. Counts for the splits come from one histogram of keys by
MAX_DEPTH leading bits, so what reaches the driver, and the directory itself, has at most 2^MAX_DEPTH rows at any size;
beyond that many buckets the capacity grows in place of the directory. A bucket is thus a range of keys.

The index is a table of entries in the shared folder, dealt by bucket and sorted by key; directory and index are Parquet.
Only keys that occur twice or more carry their text to it. Owner tasks go through their buckets' ranges key by key:
entries of a key chain, and are compared byte by byte with the texts of the chain. Which texts are equal is decided
there; the digest only names the rows.

A key of 2 x PAGE entries or more is spread over overflow pages of about PAGE rows each, dealt by row, so one hot text
costs no task more than a page. The chains of a key's pages, which hold each text once, are merged as a tree of FAN
pages at a time. What a task holds is the chain of one key's page.

Defined cases: a null text equals the empty text; a null id is the smallest; rows with one id and one text are all
marked kept if that id stays; an empty table gives no rows; texts of any length are compared whole; other columns are
not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keep

#: Entries of a bucket before it splits, rows of an overflow page, pages merged at a time, and the most bits of the directory.
CAPACITY, PAGE, FAN, MAX_DEPTH = 256, 200, 64, 16


def key_of(sha: Column, bits: int) -> Column:
    """The leading bits of a hex digest, as a long below 2^62."""
    return F.shiftrightunsigned(F.conv(F.substring(sha, 1, 15), 16, 10).cast("long"), 60 - bits)


def doubled(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Local depths of the directory's slots. counts has the entries of each value of the most bits there may be.

    Slots that share a bucket are 2^(depth of the directory - local depth) neighbours.
    """
    most = len(counts).bit_length() - 1
    sums = np.concatenate(([0], np.cumsum(counts)))
    local, depth = np.zeros(1, dtype=np.int64), 0
    while True:
        slot = np.arange(1 << depth)
        first = slot >> (depth - local) << (depth - local)
        size = sums[(first + (1 << (depth - local))) << (most - depth)] - sums[first << (most - depth)]
        full = (size > capacity) & (local < most)
        if not full.any():
            return local
        if (local[full] == depth).any():
            local, full, depth = np.repeat(local, 2), np.repeat(full, 2), depth + 1
        local[full] += 1


def directory(keys: DataFrame, bits: int, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, int]:
    """((slot, bucket), depth) for keys (key, n). Buckets are named by their first slot; a table of at most 2^max_depth rows."""
    most = min(max_depth, bits)
    sizes = keys.groupBy(F.shiftright("key", bits - most).alias("p")).agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << most, dtype=np.int64)
    counts[sizes.column("p").to_numpy()] = sizes.column("n").to_numpy()
    local = doubled(counts, max(capacity, int(counts.sum()) >> max(0, max_depth - 2)))
    depth = len(local).bit_length() - 1
    slot = np.arange(len(local), dtype=np.int64)
    table = pa.table({"slot": slot, "bucket": slot >> (depth - local) << (depth - local)})
    return keep(keys.sparkSession.createDataFrame(table)), depth


def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, of = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, t in zip(zip(*rows, strict=True), of, strict=True)], names=names)


def chained(entries, group: tuple[str, ...]):
    """Rows sorted by the columns of group come in; (values of group, chains) of each go out, chains as [text, rows]."""
    at, chains = None, []
    for got in entries:
        cols = {k: got.column(k) for k in got.schema.names}
        texts = cols.pop("text").cast(pa.binary()).to_pylist()
        for text, *values in zip(texts, *[c.to_pylist() for c in cols.values()], strict=True):
            row = dict(zip(cols, values, strict=True))
            now = tuple(row[k] for k in group)
            if now != at:
                if chains:
                    yield at, chains
                at, chains = now, []
            for chain in chains:
                if chain[0] == text:
                    chain[1].append(row)
                    break
            else:
                chains.append((text, [row]))
    if chains:
        yield at, chains


#: Rows of documents (sha is set) and, for keys of several pages, of chains (text is set). A chain is named by key and at.
FOUND = "key long, at long, page long, pages long, doc_id long, sha string, keep long, n long, text binary"
MERGED = "key long, at long, up long, page long, keep long, n long, text binary"
FLUSH = 4 << 20


def latest(ids) -> int | None:
    return max((x for x in ids if x is not None), default=None)


def flushed(rows, schema: str):
    """(row, bytes) to record batches of about FLUSH bytes."""
    out, size = [], 0
    for row, n in rows:
        out.append(row)
        size += n + 100
        if size > FLUSH:
            yield batch(out, schema)
            out, size = [], 0
    if out:
        yield batch(out, schema)


def owner_task(entries):
    """Entries of buckets, sorted by key and page, to rows of FOUND."""

    def rows():
        for (key, page), chains in chained(entries, ("key", "page")):
            for i, (text, own) in enumerate(chains):
                at, pages, best = page << 20 | i, own[0]["pages"], latest(r["doc_id"] for r in own)
                for doc_id in {r["doc_id"] for r in own}:
                    yield (key, at, page, pages, doc_id, own[0]["sha"], best, len(own), None), 0
                if pages > 1:
                    yield (key, at, page, pages, None, None, best, len(own), text), len(text)

    yield from flushed(rows(), FOUND)


def merge_task(entries):
    """Chains of up to FAN pages of a key to rows of MERGED: the chain that each goes into (up), and those chains (text is set)."""

    def rows():
        for (key, page), chains in chained(entries, ("key", "page")):
            for i, (text, own) in enumerate(chains):
                up = page << 20 | i
                for r in own:
                    yield (key, r["at"], up, None, None, None, None), 0
                yield (key, up, None, page, latest(r["keep"] for r in own), sum(r["n"] for r in own), text), len(text)

    yield from flushed(rows(), MERGED)


def merged(found: DataFrame, pages: int) -> DataFrame:
    """(key, at, keep, n): what the chains of keys of several pages come to."""
    chains, links = found.filter("text IS NOT NULL").select("key", "at", "page", "keep", "n", "text"), []
    while pages > 1:
        dealt = chains.withColumn("page", F.floor(F.col("page") / FAN)).repartition("key", "page").sortWithinPartitions("key", "page")
        done = keep(dealt.mapInArrow(merge_task, MERGED))
        links.append(done.filter("text IS NULL").select("key", "at", "up"))
        chains = done.filter("text IS NOT NULL").select("key", "at", "page", "keep", "n", "text")
        pages = -(-pages // FAN)
    out = chains.select("key", "at", "keep", "n")
    for level in reversed(links):
        out = level.join(out.withColumnRenamed("at", "up"), ["key", "up"]).select("key", "at", "keep", "n")
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int = 60, capacity: int = CAPACITY, page: int = PAGE) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(t, 256).alias("sha"), t.alias("text"), F.monotonically_increasing_id().alias("row"))
    ids = keep(rows.select("doc_id", "sha", key_of(F.col("sha"), bits).alias("key")))
    repeated = keep(ids.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("pages", F.when(F.col("n") < 2 * page, 1).otherwise(F.floor(F.col("n") / page)).cast("long")))
    most = repeated.agg(F.max("pages").alias("most")).first()["most"] or 1
    slots, depth = directory(repeated.select("key", F.least("n", F.lit(2 * page)).alias("n")), bits, capacity)
    # at most 2^MAX_DEPTH rows
    placed = keep(repeated.join(F.broadcast(slots), F.shiftright("key", bits - depth) == F.col("slot")).select("key", "bucket", "pages"))
    own = rows.withColumn("key", key_of(F.col("sha"), bits)).join(placed, "key")
    entry = own.select("bucket", "key", F.pmod(F.xxhash64("row"), F.col("pages")).alias("page"), "pages", "doc_id", "sha", "text")
    index = keep(entry.repartition("bucket", "page").sortWithinPartitions("bucket", "key", "page"))
    found = keep(index.drop("bucket").mapInArrow(owner_task, FOUND))
    members = found.filter("sha IS NOT NULL")
    known = members.filter("pages = 1").select("doc_id", "sha", "keep", "n")
    if most > 1:
        hot = members.filter("pages > 1").select("doc_id", "sha", "key", "at").join(merged(found, most), ["key", "at"])
        known = known.unionByName(hot.select("doc_id", "sha", "keep", "n").distinct())
    known = known.select(F.col("doc_id").alias("d2"), F.col("sha").alias("s2"), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"))
    out = ids.join(known, (F.col("sha") == F.col("s2")) & F.col("doc_id").eqNullSafe(F.col("d2")), "left")
    alone = F.col("s2").isNull()
    stays = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", stays.alias("keep_id"), F.when(alone, 1).otherwise(F.col("group_size")).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(stays).alias("kept"), F.col("sha").alias("text_sha256"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
