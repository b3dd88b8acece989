"""Changes, sync pushes, limits by time and key, notices: rules on records as column expressions and windows."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
HOUR, DAY = 3600 * SECOND, 86400 * SECOND

# Kinds of records, the longest key, bytes of data, the earliest time, and how far a time may be ahead.
KINDS = ("bookmark", "highlight", "note", "noteFolder", "session", "sessionBook", "setting", "progress")
LONGEST, MOST_BYTES, EARLIEST, AHEAD = 512, 256 * 1024, 1_577_836_800 * SECOND, 300 * SECOND


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Hex HMAC-SHA256 by built-ins: the key's two pads are constants."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def etag(body: Column) -> Column:
    return F.concat(F.lit('"'), F.sha1(body), F.lit('"'))


def not_modified(tag: Column, header: Column) -> Column:
    """Whether a header of tags, separated by commas, names the tag, in its strong or weak form, or any."""
    names = F.transform(F.split(F.coalesce(header, F.lit("")), ","), lambda x: F.regexp_replace(F.trim(x), "^W/", ""))
    return F.array_contains(names, tag) | F.array_contains(names, F.lit("*"))


def row_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, op: rows that came, went or differ in any column, null-safe, by one full outer join."""
    whole = lambda df, name: df.select(F.col(key).alias(f"_{name}"), F.struct(*[c for c in df.columns if c != key]).alias(name))
    both = whole(old, "old").join(whole(new, "new"), F.col("_old") == F.col("_new"), "full")
    op = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(~F.col("old").eqNullSafe(F.col("new")), "update")
    return both.select(F.coalesce("_old", "_new").alias(key), op.alias("op")).filter("op IS NOT NULL")


def touched(books: DataFrame, changes: list[tuple[DataFrame, str]]) -> DataFrame:
    """book_id: books that changed, and books of works, authors and the like that changed; each once.

    changes: (rows with a column of ids, the column of books that holds such ids).
    """
    out = None
    for rows, column in changes:
        ids = rows.select(F.col(rows.columns[0]).alias("_id")).distinct()
        hit = books.join(ids, F.col(column) == F.col("_id"), "left_semi").select("book_id")
        out = hit if out is None else out.unionByName(hit)
    return out.distinct()


def feed(log: DataFrame, published: DataFrame, since: int, limit: int) -> DataFrame:
    """seq, id, op, has_more: the next changes after a cursor. What is published now is put, all else is taken away."""
    ahead = log.filter(F.col("seq") > since).orderBy("seq").limit(limit + 1)
    now = published.select(F.col("id").alias("_id")).distinct()
    rows = ahead.join(now, F.col("id") == F.col("_id"), "left")
    more = F.broadcast(ahead.agg((F.count("*") > limit).alias("has_more"), F.max("seq").alias("_last")))
    kept = rows.crossJoin(more).filter(~F.col("has_more") | (F.col("seq") < F.col("_last")))
    return kept.select("seq", "id", F.when(F.col("_id").isNull(), "delete").otherwise("upsert").alias("op"), "has_more")


def settled(log: DataFrame, running: DataFrame) -> DataFrame:
    """Rows whose writer began before every writer that still runs; all rows if none runs."""
    first = F.broadcast(running.agg(F.min("writer").alias("_first")))
    return log.crossJoin(first).filter(F.col("_first").isNull() | (F.col("writer") < F.col("_first"))).drop("_first")


def latest(log: DataFrame, column: str = "seq") -> DataFrame:
    """The greatest number of a log, 0 for an empty one."""
    return log.agg(F.coalesce(F.max(column), F.lit(0)).alias(column))


def published(rows: DataFrame, path: str) -> None:
    """Writes rows beside the version of a table that is read, then lets readers have them by one rename.

    A run that fails before it leaves readers what they had. Versions that were in place before the last are removed.
    """
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = lambda name: hadoop.Path(f"{path}/{name}")
    fs = at("x").getFileSystem(spark._jsc.hadoopConfiguration())
    old = sorted(x.getPath().getName() for x in fs.listStatus(hadoop.Path(path))) if fs.exists(hadoop.Path(path)) else []
    done = [x for x in old if x.startswith("v") and x[1:].isdigit()]
    number = 1 + max((int(x[1:]) for x in done), default=0)
    rows.write.mode("overwrite").parquet(f"{path}/new-{number:09d}")
    if not fs.rename(at(f"new-{number:09d}"), at(f"v{number:09d}")):
        raise OSError(f"{path}: version {number} is there already")
    for name in done[:-1]:
        fs.delete(at(name), True)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The version of a table that was published last."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(hadoop.Path(path))]
    return spark.read.parquet(f"{path}/{max(x for x in names if x.startswith('v') and x[1:].isdigit())}")


def checked_push(items: DataFrame, now_us: int) -> DataFrame:
    """items (kind, key, data, deleted, updated_us, moved_us) with status, key_lower, and times that lie too far ahead set to now.

    data is JSON; what is no object is refused like what is too long. A put without data has an empty object.
    """
    status = (
        F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "rejected_kind")
        .when(F.coalesce(F.length("key"), F.lit(0)).between(1, LONGEST) == False, "rejected_key")  # noqa: E712
        .when((F.octet_length("data") > MOST_BYTES) | ~F.coalesce(F.startswith(F.ltrim("data"), F.lit("{")), F.lit(True)), "rejected_size")
        .when(F.coalesce(F.col("updated_us") < EARLIEST, F.lit(True)), "rejected_time")
        .otherwise("ok")
    )
    ahead = lambda c: F.when(F.col(c) > now_us + AHEAD, F.lit(now_us)).otherwise(F.col(c)).alias(c)
    gone = F.coalesce("deleted", F.lit(False))
    others = [c for c in items.columns if c not in ("updated_us", "moved_us", "data", "deleted")]
    return items.select(*others, gone.alias("deleted"), F.when(~gone, F.coalesce("data", F.lit("{}"))).alias("data"), ahead("updated_us"), ahead("moved_us"), status.alias("status"), F.lower("key").alias("key_lower"))


def next_claim(manifest: DataFrame, done: DataFrame, failed: DataFrame, claims: DataFrame, now_us: int, stale_us: int = 180 * 60 * SECOND) -> DataFrame:
    """The first name of the manifest (name, nth) that is not done, has not failed and has no fresh claim (name, at_us)."""
    taken = done.select("name").unionByName(failed.select("name")).unionByName(claims.filter(F.col("at_us") > now_us - stale_us).select("name"))
    return manifest.join(taken, "name", "left_anti").orderBy("nth").limit(1).select("name")


def trailing(calls: DataFrame, key: str, span_us: int, limit: int) -> DataFrame:
    """calls (id, us, key) with n, limited and retry_us by key: calls of the last span, this one included."""
    w = Window.partitionBy(key).orderBy("us").rangeBetween(-span_us + 1, 0)
    over = F.col("n") > limit
    counted = calls.withColumn("n", F.count("*").over(w)).withColumn("_oldest", F.min("us").over(w))
    return counted.withColumn("limited", over).withColumn("retry_us", F.when(over, F.col("_oldest") + span_us - F.col("us"))).drop("_oldest")


def code_requests(calls: DataFrame, by_email: int = 5, by_ip: int = 20, gap_us: int = 60 * SECOND) -> DataFrame:
    """calls (id, us, email, ip) with a verdict: too soon after the last to this address, too many to it in an hour, too many from it."""
    a = trailing(calls, "email", HOUR, by_email).withColumnsRenamed({"n": "n_email", "limited": "email_limited", "retry_us": "email_retry"})
    b = trailing(a, "ip", HOUR, by_ip)
    last = F.lag("us").over(Window.partitionBy("email").orderBy("us", "id"))
    c = b.withColumn("_since", F.col("us") - last)
    soon = F.coalesce(F.col("_since") < gap_us, F.lit(False))
    verdict = F.when(soon, "resend_gap").when(F.col("email_limited"), "email").when(F.col("limited"), "ip").otherwise("ok")
    retry = F.when(soon, F.lit(gap_us) - F.col("_since")).when(F.col("email_limited"), F.col("email_retry")).when(F.col("limited"), F.col("retry_us"))
    return c.select("id", verdict.alias("verdict"), retry.alias("retry_us"))


def quotas(calls: DataFrame, daily: int, at_once: int, minute: int, service: int) -> DataFrame:
    """calls (id, us, who, running) with a verdict: the service's day, the user's day, calls that still run, the last minute."""
    day = F.floor(F.col("us") / DAY)
    upto = lambda w: w.orderBy("us", "id").rowsBetween(Window.unboundedPreceding, -1)
    own = calls.withColumn("_day", day)
    own = own.withColumn("_mine", F.count("*").over(upto(Window.partitionBy("who", "_day"))))
    own = own.withColumn("_open", F.sum(F.col("running").cast("int")).over(upto(Window.partitionBy("who", "_day"))))
    own = own.withColumn("_minute", F.count("*").over(Window.partitionBy("who").orderBy("us").rangeBetween(-60 * SECOND + 1, 0)) - 1)
    # the service's count goes by minutes first, so that a day is no single task's
    cell = own.groupBy("_day", F.floor(F.col("us") / (60 * SECOND)).alias("_cell")).agg(F.count("*").alias("_c"))
    before = Window.partitionBy("_day").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cell = cell.select(F.col("_day").alias("_d"), F.col("_cell"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    own = own.withColumn("_m", F.floor(F.col("us") / (60 * SECOND)))
    own = own.withColumn("_within", F.row_number().over(Window.partitionBy("_day", "_m").orderBy("us", "id")) - 1)
    own = own.join(cell, (F.col("_day") == F.col("_d")) & (F.col("_m") == F.col("_cell")))
    verdict = F.when(F.col("_before") + F.col("_within") >= service, "service").when(F.col("_mine") >= daily, "daily").when(F.coalesce("_open", F.lit(0)) >= at_once, "in_flight").when(F.col("_minute") >= minute, "per_minute").otherwise("ok")
    return own.select("id", verdict.alias("verdict"))


def next_allowed(at: Column, zone: Column, start: int = 22, end: int = 8) -> Column:
    """Null outside the quiet hours of a zone, else the next end of them, in UTC. at is in UTC; zones must be valid."""
    local = F.from_utc_timestamp(at, zone)
    hour = F.hour(local)
    morning = F.date_trunc("day", local) + F.make_dt_interval(hours=F.lit(end))
    later = F.when(hour >= start, morning + F.make_dt_interval(days=F.lit(1))).when(hour < end, morning)
    return F.to_utc_timestamp(later, zone)


def digests(users: DataFrame, works: DataFrame, now: Column, hour: int = 10, apart_hours: int = 20) -> DataFrame:
    """user_id, n, one: who gets a digest now, of how many works first seen since the last, and the title if it is one.

    users: user_id, zone, last_sent, updated; works: work_id, title, first_seen. Works are counted by the time they were
    first seen, so users meet running counts, one row for each such time, and not works.
    """
    due = users.filter((F.hour(F.from_utc_timestamp(now, F.col("zone"))) == hour) & (F.col("last_sent").isNull() | (now - F.col("last_sent") >= F.make_dt_interval(hours=F.lit(apart_hours)))))
    since = due.select("user_id", F.greatest(F.coalesce("last_sent", "updated"), F.col("updated")).alias("since"))
    # a work counts for the latest time that it was seen first
    each = works.groupBy("work_id", "title").agg(F.max("first_seen").alias("seen"))
    steps = each.groupBy("seen").agg(F.count("*").alias("n"), F.min("title").alias("title"))
    after = Window.orderBy(F.desc("seen")).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select("seen", F.sum("n").over(after).alias("n"), F.first("title").over(after).alias("title"))
    marked = since.select("user_id", F.col("since").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("title"))
    line = marked.unionByName(steps.select(F.lit(None).cast("long").alias("user_id"), F.col("seen").alias("at"), F.lit(0).alias("side"), "n", "title"))
    # the earliest step after a user's time
    ahead = Window.orderBy(F.desc("at"), F.desc("side")).rowsBetween(Window.unboundedPreceding, -1)
    near = line.withColumn("_n", F.last("n", ignorenulls=True).over(ahead)).withColumn("_title", F.last("title", ignorenulls=True).over(ahead))
    return near.filter("side = 1 AND _n > 0").select("user_id", F.col("_n").alias("n"), F.when(F.col("_n") == 1, F.col("_title")).alias("one"))


def kept(rows: DataFrame, kind: str, at: str, now: Column, days: dict[str, int]) -> DataFrame:
    """rows that are not older than their kind's days; kinds without a period stay."""
    limits = F.create_map(*[x for k, d in days.items() for x in (F.lit(k), F.lit(d))])
    span = F.element_at(limits, F.col(kind))
    return rows.filter(span.isNull() | (F.col(at) >= now - F.make_dt_interval(days=span)))


def rotations(uses: DataFrame) -> DataFrame:
    """uses (id, session, token, us) with a verdict. A token counts once; its second use ends the whole session from then on."""
    nth = F.row_number().over(Window.partitionBy("session", "token").orderBy("us", "id"))
    own = uses.withColumn("_nth", nth).withColumn("_at", F.struct("us", "id"))
    ends = own.filter("_nth > 1").groupBy(F.col("session").alias("_s")).agg(F.min("_at").alias("_end"))
    out = own.join(ends, F.col("session") == F.col("_s"), "left")
    fine = (F.col("_nth") == 1) & (F.col("_end").isNull() | (F.col("_at") < F.col("_end")))
    return out.select("id", F.when(fine, "rotated").when(F.col("_at") == F.col("_end"), "reuse_revokes").otherwise("refresh_invalid").alias("verdict"))


def last_writes(changes: DataFrame, key: list[str], clock: str, device: str, tie: str) -> DataFrame:
    """The last write of each key by its clock, then device; writes without a time lose to all others."""
    newest = F.max_by(F.struct(*changes.columns), F.struct(F.col(clock).isNotNull().alias("has"), F.col(clock).alias("at"), F.col(device).alias("by"), F.col(tie).alias("no")))
    return changes.groupBy(*key).agg(newest.alias("_row")).select("_row.*")
