from collections import defaultdict

from folioscope.operators import windows


def brute(rows, reach=5):
    books, out = defaultdict(list), {}
    for d, source, text in sorted(rows, key=lambda r: r[0]):
        books[source].append(len(text or ""))
    for book, lengths in books.items():
        for i in range(len(lengths)):
            around = sorted(m for m in lengths[max(0, i - reach) : i] + lengths[i + 1 : i + 1 + reach] if m)
            out[book, i + 1] = around[len(around) // 2] if around else None
    return out


def test_median_of_neighbours(spark, sf):
    lengths = [5, 0, 900, 7, 6, 0, 8, 4, 4, 300, 2, 9]
    rows = [(i, "a", "x" * n) for i, n in enumerate(lengths)] + [(50, "b", "alone"), (60, "c", "one"), (61, "c", None), (62, None, "a"), (63, None, "bc")]
    got = {(r.book, r.sequence): r.local for r in windows.neighbour_median(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)).collect()}
    assert got == brute(rows)
    # the median of 5, 900, 7, 6 and 8, and none where no neighbour has text
    assert got["a", 2] == 7 and got["b", 1] is None and got["c", 1] is None and got["c", 2] == 3
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {(r.book, r.sequence): r.local for r in windows.neighbour_median(docs).collect()}
    assert got == brute([(r.doc_id, r.source, r.text) for r in docs.collect()])


def test_median_query(spark, sf):
    import __spark_entry__ as entry

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert {(r.book, r.sequence): r.local for r in entry.queries()["local_median"](spark, sf).collect()} == brute([(r.doc_id, r.source, r.text) for r in docs])
