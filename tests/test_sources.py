import json

from pyspark.sql import functions as F

from folioscope.functions import names
from folioscope.operators import folds, vectors
from folioscope.sources import books, marked
from folioscope.streaming import limits

SOURCE = """sum
< اسم الكتاب > T < / اسم الكتاب >
< جزء > 1 < / جزء >
< الكتاب >
< صفحة > intro 1 < / صفحة >
a < شعر > b
< صفحة > 1 < / صفحة >
< فهرس الموضوعات >
H
< / فهرس الموضوعات >
text ( 1 ) < هامش > note < / هامش > . more
< صفحة > 1 < / صفحة >
same
< صفحة > 2 < / صفحة >
< / الكتاب >"""


def test_parse():
    b = marked.parse(SOURCE.encode(), "7")
    assert [(p["pageNumber"], p["pageType"]) for p in b["pages"]] == [("0.1", "frontMatter"), ("0.2", "frontMatter")]
    assert [x["text"] for p in b["pages"] for x in p["blocks"]] == ["a", "b", "H", "text ( 1 )", "note", ". more", "same"]
    assert b["toc"][0]["title"] == "H" and b["metadata"] == {"volume": "1"} and b["title"] == "T"
    assert marked.front_pages(["5", "6", "1", "2"]) == 2 and marked.front_pages(["x 1", "x 2"]) == 2
    assert marked.front_pages(["33", "34"]) == 0 and marked.front_pages([]) == 0
    assert marked.decode("كتاب".encode("cp1256")) == "كتاب"


def test_read_marked_keeps_going(spark, tmp_path):
    (tmp_path / "7.abx").write_text(SOURCE)
    (tmp_path / "8.abx").write_text("sum\nno body")
    (tmp_path / "9.abx").write_text("sum\n< الكتاب >\n< هامش > open")
    got = {r.book_id: r for r in marked.read_marked(spark, str(tmp_path)).collect()}
    assert got["7"].ok and got["7"].book.title == "T"
    assert (got["8"].ok, got["8"].stage, got["9"].stage) == (False, "header", "body")


def test_pages_and_issues(spark, tmp_path):
    good = {"schemaVersion": 2, "bookId": "1", "title": "t", "author": "", "pages": [
        {"id": "p-000001", "sequence": 1, "pageType": "main", "pageNumber": "5", "blocks": [{"id": "p-000001-b-001", "type": "text", "order": 1, "text": ""}, {"id": "p-000001-b-002", "type": "heading", "order": 2, "text": "ab", "tocId": "toc-00001"}, {"id": "p-000001-b-003", "type": "text", "order": 3, "text": "c"}]},
        {"id": "p-000003", "sequence": 3, "pageType": "main", "pageNumber": "4", "blocks": []},
    ], "toc": [{"id": "toc-00001", "order": 1, "title": "ab", "pageId": "p-000001"}]}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text(json.dumps({"schemaVersion": 1, "bookId": "2", "title": "x", "author": "y", "pages": []}))
    df = books.read_books(spark, str(tmp_path))
    pages = {r.sequence: r for r in books.page_rows(df).collect()}
    assert (pages[1].text, pages[1].block_offsets, pages[1].section_ord) == ("ab\nc", [0, 0, 3], 1)
    assert (pages[3].text, pages[3].block_offsets, pages[3].section_ord) == ("", [], 1)
    got = {(r.book_id, r.code): r.n for r in books.issues(df).collect()}
    assert got == {("1", "missing_author"): 1, ("1", "page_sequence_gap"): 1, ("1", "page_id_mismatch"): 1, ("1", "empty_blocks"): 1, ("1", "non_monotonic_pages"): 1, ("2", "schema_version"): 1, ("2", "no_pages"): 1}


def test_names(spark):
    asked = [("ماذا قال الشيخ المفيد عن ذلك", "ماذا قال عن ذلك"), ("قال المفيدي عن المفيد، ثم", "قال المفيدي عن ثم"), ("الإمام الشيخ المُفيد", ""), ("", ""), (None, None), ("بلا اسم", "بلا اسم")]
    df = spark.createDataFrame(asked, "t string, want string")
    assert [r[0] for r in df.select(names.strip_names(F.col("t"), ["الشيخ المفيد", "السيد"])).collect()] == [w for _, w in asked]
    assert [r[0] for r in df.limit(1).select(names.strip_names(F.col("t"), [])).collect()] == [asked[0][0]]
    spelt = [("محمدC قال L x", "محمد صلى الله عليه وآله وسلم قال x"), ("عليN والحسنJ.", "علي عليه السلام والحسن عليهما السلام."), ("(N) L", "(عليه السلام) "), ("ABC N1", "ABC N1"), ("a  b", "a  b"), ("قال Nثم", "قال عليه السلام ثم"), (None, None)]
    df = spark.createDataFrame(spelt, "t string, want string")
    assert [r[0] for r in df.select(names.honorific_spell(F.col("t"))).collect()] == [w for _, w in spelt]
    clean, hint = names.lang_strip(F.col("t"))
    got = spark.createDataFrame([("كتب ، عربي",), ("فارسي ، كتب - عربي",), ("كتب",)], "t string").select(clean, hint).collect()
    assert [tuple(r) for r in got] == [("كتب", "ar"), ("كتب", None), ("كتب", None)]


def streamed(spark, sf, tmp_path, build, mode="append"):
    ev = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.repartition(1).write.parquet(str(tmp_path / "in"))
    q = build(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return ev, {tuple(r) for r in spark.table("out").collect()}


def test_rate_limit_streams_as_the_batch_does(spark, sf, tmp_path):
    ev, got = streamed(spark, sf, tmp_path, limits.rate_limit)
    assert got == {tuple(r) for r in folds.rate_fold(ev).collect()} and len(got) == ev.count()


def test_window_counts_stream_as_the_batch_does(spark, sf, tmp_path):
    ev, got = streamed(spark, sf, tmp_path, limits.window_counts, "complete")
    assert {x[:3] for x in got} == {tuple(r)[:3] for r in limits.window_counts(ev).collect()} and got


def test_first_of_key_streams(spark, sf, tmp_path):
    ev, got = streamed(spark, sf, tmp_path, lambda s: limits.first_of_key(s, ["user_id", "event_type"]).select("user_id", "event_type"))
    assert got == {tuple(r) for r in ev.select("user_id", "event_type").distinct().collect()}


def test_merge_streams_as_the_batch_does(spark, sf, tmp_path):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    n = F.col("event_id")
    changes = ev.select("user_id", F.when(n % 2 == 0, "note").otherwise("noteFolder").alias("kind"), F.col("event_type").alias("key"), n.alias("seq"), (n * 7919 % 1000).alias("updated_us"), (n * 104729 % 1000).alias("moved_us"), (n % 3).cast("string").alias("device"), (n % 11 == 0).alias("deleted"), F.to_json(F.struct(F.col("value").alias("title"), n.alias("sortIndex"))).alias("data"), (n - n % 400).alias("seen"))
    changes.repartition(1).write.parquet(str(tmp_path / "in"))
    q = limits.merge(spark.readStream.schema(changes.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("merged").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = folds.merge_changes(changes).select("user_id", "kind", "key", "seq", "status", "copy", "data")
    got = {tuple(r) for r in spark.table("merged").collect()}
    assert got == {tuple(r) for r in batch.collect()} and len(got) == ev.count()


def test_work_at_intervals(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").limit(50).write.parquet(str(tmp_path / "in"))
    seen = []
    rows = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    limits.at_intervals(rows, lambda batch, number: seen.append((number, batch.count())), None, str(tmp_path / "ck")).awaitTermination(120)
    assert sum(n for _, n in seen) == 50


def test_listing_and_headers(spark, tmp_path):
    body = f"sum\n< {marked.TITLE} > t < / {marked.TITLE} >\n< موثوق > 1 < / موثوق >\n< {marked.BODY} >\n< صفحة > 1 < / صفحة >\nx\n< / {marked.BODY} >"
    for name, text in {"10.abx": body, "9.abx": body.replace(" t ", " nine "), "x.abx": "sum\nno body", "7.txt": body}.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    ids = lambda **k: [r.book_id for r in marked.listing(spark, str(tmp_path), "*.abx", **k).collect()]
    assert ids() == ["x", "9", "10"] and ids(limit=2) == ["x", "9"] and ids(ids=["10", " 9"]) == ["10", "9"] and ids(ids=["77"]) == []
    files = spark.createDataFrame([("a", body.encode()), ("b", b"sum\nno body"), ("c", (body + "\u0645" * 90_000).encode()), ("d", None)], "book_id string, content binary")
    got = {r.book_id: (r.tags, r.error) for r in marked.headers(files).collect()}
    assert got["a"][0][marked.TITLE] == "t" == got["c"][0][marked.TITLE] and got["b"] == ({}, "header") == got["d"]
    assert marked.parse(body.encode(), "1")["metadata"] == {"trusted": True}
    assert marked.parse_files(files.limit(1)).first().book.metadata == {"trusted": "true"}


def test_uploads_are_taken_whole_or_refused(spark):
    import numpy as np

    raw = lambda n: np.arange(n * 4, dtype="<f2").tobytes()
    ups = spark.createDataFrame([("a", "h", 2, raw(2)), ("b", "x", 1, raw(1)), ("c", "h", 2, raw(1)), ("d", "h", 3, raw(3)), ("e", None, 1, None)], "book string, chunker string, n int, raw binary")
    chunks = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("c", 0), ("c", 1), ("d", 0)], "book string, chunk int")
    got = vectors.checked_upload(ups, chunks, "h", 4).collect()
    assert {(r.book, r.status, r.chunk) for r in got} == {("a", "ok", 0), ("a", "ok", 1), ("b", "chunker", None), ("c", "bytes", None), ("d", "chunks", None), ("e", "chunker", None)}
    assert [r.vector for r in got if r.chunk == 1] == [[4.0, 5.0, 6.0, 7.0]]
    points = spark.createDataFrame([("p", 1), ("q", 2)], "id string, v int")
    assert {tuple(r) for r in vectors.upserted(points, spark.createDataFrame([("q", 9), ("r", 3)], "id string, v int")).collect()} == {("p", 1), ("q", 9), ("r", 3)}
