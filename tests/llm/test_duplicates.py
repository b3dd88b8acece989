import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from folioscope.llm import exact_dedup, jaccard, near_lines, suffixes

from .conftest import prose


def near_texts():
    r = random.Random(5)
    out = []
    for g in range(6):
        base = prose(g, 150).split()
        for _ in range(5):
            t = list(base)
            for _ in range(r.randint(0, 6)):
                t[r.randrange(len(t))] = "changed" + str(r.randrange(9))
            out.append(" ".join(t))
    return out + [out[0], out[7], out[7], "", "", "one two", "one  two", prose(99, 200)]


def brute_classes(texts, n=5, threshold=0.8):
    """(least place that links lead to, different texts linked) of each text; all pairs that share an n-gram are counted."""
    sets, holds = [], defaultdict(list)
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
        for g in sets[-1]:
            holds[g].append(i)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def join(i, j):
        a, b = sorted((find(i), find(j)))
        root[b] = a

    first, links = {}, [set() for _ in texts]
    for j, s in enumerate(sets):
        join(j, first.setdefault(texts[j] or "", j))
        shared = Counter(i for g in s for i in holds[g] if i < j)
        for i, both in shared.items():
            if both >= threshold * (len(sets[i]) + len(s) - both) - 1e-9:
                join(i, j)
                if texts[i] != texts[j]:
                    links[i].add(texts[j])
                    links[j].add(texts[i])
    return [find(i) for i in range(len(texts))], [len(x) for x in links]


def test_jaccard_finds_what_brute_force_finds(make):
    texts = near_texts()
    got = {r.doc_id: r for r in jaccard.classes(make(texts), block=3).collect()}
    assert len(got) == len(texts)
    least, links = brute_classes(texts)
    for i in range(len(texts)):
        assert got[i].class_id == least[i], i
        assert got[i].n_links == links[i], i
    assert got[len(texts) - 2].class_id == len(texts) - 3  # white space does not count


def test_jaccard_block_size_does_not_matter(make):
    docs = make(near_texts())
    rows = lambda b: sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.classes(docs, block=b).collect())
    assert rows(1) == rows(4) == rows(1000)


def test_jaccard_by_buckets_of_a_long_chain(make, monkeypatch):
    """A component that hangs together by neighbours is verified bucket by bucket, to the same result."""
    line = prose(31, 150 + 10 * 160).split()
    texts = [" ".join(line[10 * i : 10 * i + 150]) for i in range(160)]
    monkeypatch.setattr(jaccard, "FEW", 1000)
    seen = []
    plain = jaccard.links
    monkeypatch.setattr(jaccard, "links", lambda *a: seen.append(a[-1]) or plain(*a))
    groups = jaccard.groups_of
    used = []
    monkeypatch.setattr(jaccard, "groups_of", lambda *a: used.append(groups(*a)) or used[0])
    got = {r.doc_id: r for r in jaccard.classes(make(texts), block=1).collect()}
    least, links = brute_classes(texts)
    assert [got[i].class_id for i in range(160)] == least and [got[i].n_links for i in range(160)] == links
    assert used[0].filter("band >= 0").count() > 160


def test_jaccard_of_testdata(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    least, links = brute_classes([r.text for r in rows])
    got = {r.doc_id: r for r in jaccard.classes(docs).collect()}
    assert [got[r.doc_id].class_id for r in rows] == [rows[i].doc_id for i in least]
    assert [got[r.doc_id].n_links for r in rows] == links and sum(links)


def test_banding_reaches_its_recall():
    b, r = jaccard.banding(0.8, 0.999)
    assert b * r <= jaccard.MAX_HASHES and 1 - (1 - 0.8**r) ** b >= 0.999


def test_keep_one(make, awkward):
    docs = make(awkward)
    left = jaccard.keep_one(docs)
    assert left.columns == docs.columns
    rows = left.collect()
    assert Counter(r.text for r in rows if r.text and r.text == awkward[3][1]) == {awkward[3][1]: 1}
    assert any(r.doc_id == 6 for r in rows) and sum(r.doc_id == 5 for r in rows) == 1
    assert jaccard.keep_one(docs.limit(0)).collect() == []


def test_exact_groups_with_colliding_keys(make, awkward, monkeypatch):
    rows = awkward + [(100 + i, f"t{i % 7}", "s") for i in range(60)] + [(900, "hot", "s")] * 150 + [(None, "hot", "s")] * 150 + [(1000 + i, "hot", "s") for i in range(150)]
    monkeypatch.setattr(exact_dedup, "FAN", 5)
    for bits, capacity, page in ((60, 200_000, 2000), (60, 2, 3), (4, 5, 3), (1, 2, 2)):
        got = exact_dedup.exact_groups(make(rows), bits=bits, capacity=capacity, page=page).collect()
        by = defaultdict(list)
        for d, t, _ in rows:
            by[t or ""].append(d)
        want = Counter()
        for ids in by.values():
            keep = max((x for x in ids if x is not None), default=None)
            want.update((d, keep, len(ids), d == keep) for d in ids)
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want
    assert exact_dedup.exact_groups(make([(1, "a", "b")]).limit(0)).collect() == []


def test_directory_doubles_only_overfull_buckets(spark):
    keys = spark.createDataFrame([(i, 1) for i in range(64)] + [(64 + 8 * i, 12) for i in range(2)], "key long, n long")
    slots, depth = exact_dedup.directory(keys, 8, capacity=20, max_depth=8)
    bucket = {r.slot: r.bucket for r in slots.collect()}
    assert len(bucket) == 1 << depth and depth > 1
    sizes = Counter()
    for key, n in [tuple(r) for r in keys.collect()]:
        sizes[bucket[key >> (8 - depth)]] += n
    assert all(n <= 20 for n in sizes.values())
    # a bucket of less depth than the directory has several slots, in a row
    shared = Counter(bucket.values())
    assert max(shared.values()) > 1 and all(n & (n - 1) == 0 for n in shared.values())
    assert [bucket[i] for i in sorted(bucket)] == sorted(bucket.values())


def test_directory_grows_by_one_bit():
    even = np.ones(16, dtype=np.int64)
    assert [len(exact_dedup.doubled(even, c)) for c in (16, 8, 7, 4, 2, 1, 0)] == [1, 2, 4, 4, 8, 16, 16]
    assert exact_dedup.doubled(np.array([9, 0, 0, 0, 1, 1, 1, 1]), 4).tolist() == [3, 3, 2, 2, 1, 1, 1, 1]


def brute_lines(rows, min_words):
    own = []
    for d, t, _ in rows:
        for i, line in enumerate((t.split("\n") if t is not None else [])):
            w = line.lower().split()
            if len(w) >= min_words:
                own.append(((d is not None, d or 0), i, tuple(w)))
    own.sort()
    gone = defaultdict(set)

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    for k, (d, i, w) in enumerate(own):
        if any(near(w, x) for (_, _, x), e in zip(own[:k], own) if e[:2] != (d, i)):
            gone[d].add(i)
    return gone


def test_line_dedup_against_brute_force(make):
    r = random.Random(8)
    base = [[r.choice("abcdefgh") for _ in range(r.randint(3, 7))] for _ in range(12)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(r.randint(0, 6)):
            w = list(r.choice(base))
            k = r.random()
            if k < 0.3:
                w[r.randrange(len(w))] = r.choice("xyz")
            elif k < 0.5:
                w.insert(r.randrange(len(w) + 1), r.choice("xyz"))
            elif k < 0.6:
                w.pop(r.randrange(len(w)))
            lines.append((" " if r.random() < 0.5 else "  ").join(w).upper() if r.random() < 0.2 else " ".join(w))
        rows.append((d, "\n".join(lines), "s"))
    rows.append((40, None, "s"))
    got = {x.doc_id: x for x in near_lines.line_report(make(rows), min_words=4).collect()}
    want = brute_lines(rows, 4)
    for d, t, _ in rows:
        assert got[d].removed == ",".join(str(i) for i in sorted(want[(True, d)])), d
        assert got[d].n_lines == (len(t.split("\n")) if t is not None else 0)
    assert sum(len(v) for v in want.values()) > 20


def test_line_stage_on_awkward_rows(make, awkward):
    docs = make(awkward)
    out = near_lines.dedup_lines(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert {1, 2, 3, 6, 7} <= {r.doc_id for r in rows}
    assert [r.text for r in rows if r.doc_id == 1] == [None]
    assert near_lines.dedup_lines(docs.limit(0)).collect() == []


def test_line_stage_tells_rows_without_id_apart(make):
    one, own = "a line that is found in several of them", "a line with its own words and no twin"
    docs = make([(9, f"{one}\nshort", "s"), (None, f"{one}\n{own}", "s"), (None, f"{own} at all\n{one}", "s")])
    left = sorted(line for r in near_lines.dedup_lines(docs).collect() for line in r.text.split("\n"))
    assert left == sorted([one, own, own + " at all", "short"])
    assert sorted((r.doc_id is None, r.n_removed) for r in near_lines.line_report(docs).collect()) == [(False, 1), (True, 0), (True, 1)]


def test_line_stage_takes_repeats_of_short_lines(make):
    long = "a line of eight words that is long"
    docs = make([(1, f"All rights reserved.\n\n{long}", "s"), (2, f"one\n\nall  rights reserved.\n{long}er", "s"), (3, "ALL RIGHTS RESERVED.\none more\nOne", "s"), (4, "one", "s")])
    assert {r.doc_id: r.removed for r in near_lines.line_report(docs).collect()} == {1: "", 2: "2,3", 3: "0,2", 4: "0"}
    left = {r.doc_id: r.text for r in near_lines.dedup_lines(docs).collect()}
    assert left == {1: f"All rights reserved.\n\n{long}", 2: "one\n", 3: "one more"}


def test_line_report_of_testdata(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    whole = {r.doc_id: r.removed for r in near_lines.line_report(documents).collect()}
    given = {r[0]: r[3] for r in duckdb.sql(near_lines.SQL.replace("FROM documents", f"FROM '{sf}/documents.parquet'")).fetchall()}
    assert whole == given
    # what min_words leaves are the lines under it that stand earlier too, and no others
    long = {r.doc_id: r.removed for r in near_lines.line_report(documents, min_words=near_lines.MIN_WORDS).collect()}
    seen, more = set(), 0
    for r in sorted(documents.collect(), key=lambda r: r.doc_id):
        want = {int(i) for i in long[r.doc_id].split(",") if i}
        for i, line in enumerate((r.text or "").lower().split("\n")):
            line = " ".join(re.findall(r"[^\x20\x09-\x0D]+", line))
            if line and line.count(" ") < near_lines.MIN_WORDS - 1:
                if line in seen:
                    want.add(i)
                    more += 1
                seen.add(line)
        assert whole[r.doc_id] == ",".join(map(str, sorted(want))), r.doc_id
    assert more


def test_line_stage_keeps_what_stands_once(spark):
    a, b, c = prose(1, 20), prose(2, 20), prose(3, 20) + "\n\nshort"
    rows = [(1, a, 1), (5, a, 2), (5, b, 3), (7, c, 4), (7, c, 5), (7, c, 6), (9, c + "\nmore", 7), (None, c, 8), (8, None, 9), (8, None, 10)]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, __gone int, d string, left int").repartition(3)
    left = near_lines.dedup_lines(docs)
    assert left.columns == docs.columns
    got = left.collect()
    assert {(r.doc_id, r.text) for r in got} == {(1, a), (5, b), (None, c), (9, "\nmore"), (8, None)} and len(got) == 6
    # without the row of null id, one of the three equal rows keeps its lines
    got = near_lines.dedup_lines(docs.filter("doc_id IS NOT NULL")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, a), (5, b), (7, c), (9, "\nmore"), (8, None), (8, None)])
    report = Counter((r.doc_id, r.n_lines, r.n_removed) for r in near_lines.line_report(docs).collect())
    assert report == Counter({(1, 1, 0): 1, (5, 1, 1): 1, (5, 1, 0): 1, (7, 3, 2): 3, (9, 4, 2): 1, (None, 3, 0): 1, (8, 0, 0): 2})


def brute_spans(texts, length):
    n = Counter()
    data = [(t or "").encode() for t in texts]
    for b in data:
        n.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        left = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(left).hexdigest(), left))
    return out


@pytest.mark.parametrize("group", [48, 2, 0])
def test_substrings_against_brute_force(make, group):
    r = random.Random(4)
    passages = [prose(i, 12) for i in range(4)]
    texts = [None, "", "a" * 90, "ab" * 60, "short"]
    for i in range(40):
        parts = [prose(100 + i, r.randint(0, 20))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, 30)
            parts += [p[a : a + r.randint(20, 90)], prose(r.randrange(10**6), r.randint(0, 8)), "é" * r.randint(0, 3)]
        texts.append("".join(parts))
    texts += [texts[7], texts[7], texts[9][5:], "zz" + texts[10]]
    got = {x.doc_id: x for x in suffixes.dedup_substrings(make(texts), length=40, k=8, group=group, texts_too=True).collect()}
    for i, want in enumerate(brute_spans(texts, 40)):
        x = got[i]
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == want[:4], i
        assert x.kept is None or bytes(x.kept) == want[4]


def test_substrings_of_testdata(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    got = {x.doc_id: x for x in suffixes.dedup_substrings(docs).collect()}
    for r, want in zip(rows, brute_spans([r.text for r in rows], 200)):
        x = got[r.doc_id]
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == want[:4]


def test_substrings_on_awkward_rows(make, awkward):
    got = suffixes.dedup_substrings(make(awkward)).collect()
    assert len(got) == len(awkward)
    want = brute_spans([t for _, t, _ in awkward], 200)
    assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter(w[:4] for w in want)
    assert suffixes.dedup_substrings(make(awkward).limit(0)).collect() == []


def test_suffix_array():
    r = random.Random(1)
    for _ in range(500):
        s = [r.randint(1, r.choice((1, 2, 4))) for _ in range(r.randint(0, 30))]
        assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_sql_of_exact_dedup(make, awkward):
    documents = make(awkward).toPandas()  # noqa: F841
    want = duckdb.sql(exact_dedup.SQL.replace("documents", "documents")).fetchall()
    got = exact_dedup.exact_groups(make(awkward)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    clean = lambda x: None if x is None or x != x else int(x)
    assert Counter((r.doc_id, r.group_size, r.text_sha256) for r in got) == Counter((clean(w[0]), w[2], w[4]) for w in want)
