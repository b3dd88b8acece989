import difflib
import random

from pyspark.sql import functions as F

from folioscope.operators import catalog, editing, ranks, records, search


def fits(a, b, empty):
    (s, n), (t, m) = a, b
    between = sum(empty[k] for k in range(s + 1, t)) if t > s else 0
    return t >= s and m >= n and (t > s or m == n) and -editing.SKIP <= (t - m) - (s - n) <= between


def test_agreeing_anchors_are_a_largest_set():
    r = random.Random(5)
    for _ in range(150):
        empty = {k: r.random() < 0.3 for k in range(40)}
        upto = [sum(empty[k] for k in range(1, s + 1)) for s in range(40)]
        anchors = sorted({(s, max(0, s + r.randint(-4, 4))) for s in r.sample(range(1, 30), r.randint(0, 8))})
        best = 0
        for mask in range(1 << len(anchors)):
            c = [x for i, x in enumerate(anchors) if mask >> i & 1]
            if all(fits(a, b, empty) for a, b in zip(c, c[1:])):
                best = max(best, len(c))
        got = editing.agreeing(anchors, upto)
        assert len(got) == best and all(fits(a, b, empty) for a, b in zip(got, got[1:])) and set(got) <= set(anchors)


def test_steady_anchors_of_books(spark):
    pages = spark.createDataFrame([(b, s, s == 4) for b in "xy" for s in range(1, 11)], "book string, sequence long, blank boolean")
    anchors = spark.createDataFrame([("x", 1, 1), ("x", 3, 3), ("x", 6, 5), ("x", 9, 99), ("y", 2, 2)], "book string, sequence long, number long")
    got = sorted(tuple(r) for r in editing.steady(anchors, pages).collect())
    assert got == [("x", 1, 1), ("x", 3, 3), ("x", 6, 5), ("y", 2, 2)]
    assert [tuple(r) for r in editing.artifacts(editing.steady(anchors, pages), pages).collect()] == [("x", 4)]
    assert editing.steady(anchors.limit(0), pages).collect() == []


def runs_of(spark, numbers):
    lines = spark.createDataFrame([("b", i, n) for i, n in enumerate(numbers)], "book string, nth long, number long")
    return [r.number for r in editing.contents_run(lines).orderBy("nth").collect()]


def test_contents_run(spark):
    contents = list(range(2, 300, 9))
    index = [270, 5, 200, 40, 310, 12]
    assert runs_of(spark, index + contents + index) == contents
    # a misprint falls back inside the pages covered; a list of one part spans less than the whole
    misprint = contents[:20] + [30] + contents[20:]
    assert runs_of(spark, misprint) == misprint
    poems = [274, 280, 290, 300, 340, 350]
    assert runs_of(spark, poems + contents) == contents
    # the last line of an index before the first of the contents goes
    assert runs_of(spark, [15] + contents) == contents
    assert runs_of(spark, [5, 3]) == [3]
    assert runs_of(spark, []) == []


def test_fuzzy_headings(spark):
    entries = [("b", 1, "the book of nights", ["book", "nights"], 3), ("b", 2, "politics and hunger", ["politics", "hunger", "power"], 6), ("b", 3, "nothing like it", ["nothing"], 3)]
    lines = [("b", 10, 3, "the book of nigths and more", ["x"]), ("b", 11, 4, "the bok", ["y"]), ("b", 12, 7, "hunger, politics", ["hunger", "politics"]), ("b", 13, 8, "hunger politics power", ["hunger", "politics", "power"]), ("b", 14, 9, "the book of nights", ["z"])]
    e = spark.createDataFrame(entries, "book string, entry long, key string, words array<string>, expected long")
    x = spark.createDataFrame(lines, "book string, line long, page long, key string, words array<string>")
    got = {r.entry: (r.line, r.way) for r in editing.fuzzy_headings(e, x).collect()}
    assert got == {1: (10, "likeness"), 2: (12, "words")}
    ratio = spark.createDataFrame([("abcd", "abxd more"), ("", "x"), (None, None)], "p string, t string").select(editing.likeness("p", "t")).collect()
    assert [round(r[0], 6) for r in ratio] == [round(difflib.SequenceMatcher(None, "abcd", "abxd").ratio(), 6), 1.0, 1.0]


def test_located_between_anchors():
    r = random.Random(2)
    for _ in range(100):
        b = [f"w{r.randrange(400)}" for _ in range(120)]
        a, truth = [], []
        for i, w in enumerate(b):
            if r.random() < 0.9:
                a.append(w if r.random() < 0.85 else "noise")
                truth.append(i)
        chain = [(k, truth[k]) for k in range(0, len(a), 15) if a[k] == b[truth[k]]]
        hits = [editing.located(k, chain, a, b) for k in range(len(a))]
        assert all(b[at] == a[k] for k, (at, exact) in enumerate(hits) if exact)
        right = sum(at == truth[k] for k, (at, exact) in enumerate(hits) if exact)
        assert right >= 0.9 * sum(a[k] == b[truth[k]] for k in range(len(a)))


def test_page_map_follows_a_scan(spark):
    r = random.Random(9)
    pages = [[f"w{r.randrange(3000)}" for _ in range(60)] for _ in range(40)]
    pages[7] = pages[30][:40] + pages[7][:3]
    book = spark.createDataFrame([(i, w) for i, w in enumerate(pages)], "page long, words array<string>")
    scan = spark.createDataFrame([(i + 3, [x if r.random() < 0.9 else "smudge" for x in w]) for i, w in enumerate(pages)], "page long, words array<string>")
    got = {x.page: x.scan_page for x in editing.page_map(book, scan).collect()}
    assert sum(got.get(i) == i + 3 for i in range(40)) >= 39


def test_numbers_in_two_levels(spark):
    r = random.Random(1)
    rows = [(r.choice("abc"), i) for i in r.sample(range(10**6), 500)]
    want = {}
    for g in "abc":
        for n, k in enumerate(sorted(k for x, k in rows if x == g), 1):
            want[g, k] = n
    df = spark.createDataFrame(rows, "g string, k long").repartition(5)
    assert {(x.g, x.k): x.sequence for x in ranks.numbered(df, "g", "k", stretch=1000).collect()} == want
    assert [x.position for x in ranks.ranked(df, [F.col("k")]).orderBy("k").collect()] == list(range(1, 501))
    assert ranks.ranked(df.limit(0), [F.col("k")]).collect() == [] == ranks.numbered(df.limit(0), "g", "k").collect()


def test_hmac_and_tags(spark):
    import hashlib
    import hmac

    df = spark.createDataFrame([("",), ("é x",), ("y" * 200,)], "m string")
    for key in (b"k", b"z" * 90):
        assert [r[1] for r in df.select("m", records.hmac_sha256(F.col("m"), key)).collect()] == [hmac.new(key, m.encode(), hashlib.sha256).hexdigest() for m in ("", "é x", "y" * 200)]


def test_rotation_and_names(spark):
    uses = spark.createDataFrame([(1, "s", "a", 1), (2, "s", "b", 2), (3, "s", "a", 3), (4, "s", "c", 4), (5, "t", "a", 9)], "id int, session string, token string, us long")
    assert {r.id: r.verdict for r in records.rotations(uses).collect()} == {1: "rotated", 2: "rotated", 3: "reuse_revokes", 4: "refresh_invalid", 5: "rotated"}
    names = spark.createDataFrame([(1, "الشيخ المفيد"), (2, "المفيد"), (3, "ابن المفيد"), (4, "المفيدي")], "id int, norm string")
    found = lambda q, most: sorted(r.id for r in search.matching_names(names, q, most=most, titles=["الشيخ"]).collect())
    assert found("المُفيد", 5) == [2] and found("الشيخ المفيد", 5) == [1] and found("الشيخ ابن", 5) == [3]
    assert found("ab", 5) == [] and found("الشيخ المفيد بن", 5) == []
    assert catalog.strings(F.lit("x"), 2) is not None


def test_published_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5, 0, 7):
        records.published(spark.range(n), path)
        assert records.current(spark, path).count() == n
    assert len([x for x in (tmp_path / "t").iterdir() if x.name.startswith("v")]) == 2


def test_places_of_words(spark):
    books = spark.createDataFrame([("b", ["x", "y", "z", "q"], ["x", "k", "y", "z"], [(0, 0)]), ("e", [], ["x"], [])], "book string, a array<string>, b array<string>, chain array<struct<x:int,y:int>>")
    assert [tuple(r) for r in editing.placed(books).collect()] == [("b", 0, 0, True), ("b", 1, 2, True), ("b", 2, 3, True), ("b", 3, 4, False)]
