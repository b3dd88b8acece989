"""Suffix-array dedup: every byte of a string of `length` bytes that starts anywhere else is removed.

Suffixes are sorted by grouping: first into groups of equal Lyndon prefix, taken in descending order, where
previous-smaller pointers say which suffixes move to a new group; then one pass over the finished groups emits the
order. Names are never assigned anew and nothing recurses; the work is linear.

The corpus is too large for one suffix array, so suffixes are dealt to owner tasks by content, such that two equal
strings of `length` bytes always meet:

1. Anchors: places whose hash of K bytes is the least of a run of W = length - K + 1 such hashes. Any string of
   `length` bytes holds an anchor, and equal strings hold it at the same place. Anchors with a hash of their own are out.
   A string belongs to the leftmost of its anchors, so each is counted at one place.
2. An anchor's context is the bytes of the strings that belong to it. Where all contexts of a hash are equal, all their
   strings repeat. So do those of any context that occurs twice.
3. Other contexts are split in two sides: a string has at least half of its remaining bytes before or after the
   anchor. Sides that share the anchor and that half form a group. In a group of one side that occurs more than once
   all strings repeat. A group of up to GROUP different sides gets its suffix array; neighbours in it that agree in
   `length` bytes repeat.
4. Larger groups (half a string in very many documents) are refined: strings are dealt by a narrower range of their
   distance from the anchor, so that those of a group share more bytes, down to single strings, which need no order. So
   no group's size is bounded by a cap, and none is left out.

Repeated starts are then mapped back through (hash, context) to the documents, by a digest of the text of 128 bits (two
longs, doc and doc2), as what goes depends on the content alone.

Defined cases: a null text is empty; texts under `length` bytes lose nothing; repeated rows, and rows with equal texts,
are different places, so they remove each other; ids are only passed on; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, keep
from .hashing import Prefix, mixed, window_extreme

LENGTH, K, GROUP = 200, 24, 48


def suffix_array(values) -> list[int]:
    """The order of all suffixes of values (integers above 0), by groups of Lyndon prefixes."""
    s = [*values, 0]
    n = len(s)
    members: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        members.setdefault(c, []).append(i)
    group, size, groups, start_of_end = [0] * n, [0] * n, [()] * n, [0] * (n + 1)
    at = 0
    for c in sorted(members):
        m = members[c]
        groups[at], size[at] = m, len(m)
        for i in m:
            group[i] = at
        start_of_end[at + len(m)] = at
        at += len(m)
    before = [-1] * n
    end = n
    # groups in descending order; a group's members are in text order, those that moved away are passed over
    while end > 0:
        g = start_of_end[end]
        end = g
        own = groups[g]
        if size[g] != len(own):
            own = [i for i in own if group[i] == g]
        if len(own) == 1:
            i = own[0]
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0 and size[h := group[j]] > 1:
                size[h] -= 1
                new = h + size[h]
                start_of_end[new + 1], start_of_end[new] = new, h
                groups[new], size[new] = (j,), 1
                group[j] = new
            continue
        count: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0:
                count[j] = count.get(j, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, c in count.items():
            moves.setdefault((-c, group[j]), []).append(j)
        for (_, h), m in sorted(moves.items()) if len(moves) > 1 else moves.items():
            k = len(m)
            if k == size[h]:
                groups[h] = m
                continue
            size[h] -= k
            new = h + size[h]
            start_of_end[new + k], start_of_end[new] = new, h
            groups[new], size[new] = m, k
            for j in m:
                group[j] = new
    # emit: when a suffix is in place, those whose Lyndon prefix ends where it starts come next in their groups
    order, free, placed = [-1] * n, list(range(n)), [False] * n
    order[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = before[j]
    return order[1:]


def repeated_starts(parts: list[bytes], counts: list[int], length: int) -> list[list[int]]:
    """For each part, the starts of its strings of `length` bytes that occur twice or more in all parts.

    Parts are different; a part's count is how often it occurs. One suffix array over all, parts ended by a separator.
    """
    text: list[int] = []
    owner = np.repeat(np.arange(len(parts)), [len(p) + 1 for p in parts]).tolist()
    starts = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts]))).tolist()
    raw = bytearray()
    for p in parts:
        text += [b + 2 for b in p]
        text.append(1)
        raw += p + b"\x00"
    last = [starts[i + 1] - 1 - length for i in range(len(parts))]
    hit = [False] * len(text)
    previous = -1
    for at in suffix_array(text):
        if at > last[owner[at]]:
            continue
        if previous >= 0 and raw[previous : previous + length] == raw[at : at + length]:
            hit[previous] = hit[at] = True
        elif counts[owner[at]] > 1:
            hit[at] = True
        previous = at
    return [[x - starts[i] for x in range(starts[i], max(starts[i], last[i] + 1)) if hit[x] or counts[i] > 1] for i in range(len(parts))]


def spans(starts: list[int], length: int) -> list[int]:
    """Starts to covered stretches, as flat pairs."""
    out: list[int] = []
    for s in starts:
        if out and s <= out[-1]:
            out[-1] = s + length
        else:
            out += [s, s + length]
    return out


def anchors_of(data: bytes, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(place, first byte and end of the strings it owns, hash, hash of those bytes) of each anchor.

    A string belongs to the leftmost of its least places, so every string of a text belongs to one anchor, and equal
    strings to anchors at the same distance.
    """
    w = length - k + 1
    p = Prefix(data)
    h = p.rolling(k)
    least = window_extreme(h, w, np.minimum)
    # a place is an anchor if it is the least of some run that holds it: of the runs' minima around it the largest is its own
    zero = np.zeros(w - 1, dtype=np.uint64)
    at = np.flatnonzero(window_extreme(np.concatenate((zero, least, zero)), w, np.maximum) == h)
    # stretches of runs with one minimum; that of an anchor is the one with its hash among those that reach it
    first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    end = np.concatenate((first[1:], [len(least)])) - 1
    lo, hi = np.maximum(at - (w - 1), 0), np.minimum(at, len(least) - 1)
    own = np.searchsorted(first, lo, "right") - 1
    while (off := least[first[own]] != h[at]).any():
        own[off] += 1
    lo, hi = np.maximum(lo, first[own]), np.minimum(hi, end[own])
    # of equal places in a stretch, each owns what starts after the one before
    order = np.argsort(own, kind="stable")
    tie = own[order][1:] == own[order][:-1]
    lo[order[1:][tie]] = np.maximum(lo[order[1:][tie]], at[order[:-1][tie]] + 1)
    use = lo <= hi
    at, lo, hi = at[use], lo[use], hi[use] + length
    return at, lo, hi, h[at], mixed(p.of(lo, hi) + (at - lo).astype(np.uint64))


ANCHORS = "doc long, doc2 long, place long, h long, ctx long"


def packed_place(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """place, distance to the first byte and to the end, in one long; distances are under 2^12."""
    return at << 24 | (at - lo) << 12 | (hi - at)


def anchor_rows(length: int, k: int):
    def run(batches):
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for doc, doc2, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if len(data) >= length:
                    at, lo, hi, h, c = anchors_of(data, length, k)
                    for x, y in zip(out, (np.full(len(at), doc), np.full(len(at), doc2), packed_place(at, lo, hi), h.view(np.int64), c.view(np.int64)), strict=True):
                        x.append(y)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["doc", "doc2", "place", "h", "ctx"])

    return run


SIDES = "grp long, part long, h long, ctx long, n long, shift int, bytes binary"


def _side(key: bytes, width: int, row: dict, lo: int, part: bytes) -> tuple:
    """lo: the first byte of part, from the anchor. Strings of equal content are equally far from it."""
    short = lambda *x: int.from_bytes(hashlib.blake2b(b"|".join(x), digest_size=8).digest(), "little", signed=True)
    return short(b"%d" % width, key), short(b"%d" % lo, part), row["h"], row["ctx"], row["n"], lo, part


def _batches(rows: list[tuple]):
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    for i in range(0, len(rows), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 4096], strict=True), types, strict=True)], names=["grp", "part", "h", "ctx", "n", "shift", "bytes"])


def side_rows(length: int, k: int):
    """(text, places with h, ctx, n) to rows of SIDES, both sides of each place."""
    half = (length - k) // 2

    def run(batches):
        for batch in batches:
            rows = []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for data, found in zip(texts, batch.column("found").to_pylist(), strict=True):
                for a in found:
                    at, lo, last = a["place"] >> 24, a["place"] >> 12 & 4095, (a["place"] & 4095) - length
                    # strings that start at or before at - half hold the bytes from there on; the others those up to at + length - half
                    for width, lo_, hi, key in ((-1, -lo, min(last, -half), (at - half, at + k)), (-2, max(-lo, 1 - half), last, (at, at + length - half))):
                        if lo_ <= hi:
                            rows.append(_side(data[key[0] : key[1]], width, a, lo_, data[at + lo_ : at + hi + length]))
            yield from _batches(rows)

    return run


def refined_rows(length: int, width: int):
    """Rows of SIDES to rows whose strings start within one stretch of `width` distances: the bytes that all of these hold are the key."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                lo, data = r["shift"], r["bytes"]
                last = lo + len(data) - length
                for a in range(lo // width, last // width + 1):
                    x, y = max(lo, a * width), min(last, a * width + width - 1)
                    core = data[a * width + width - 1 - lo : a * width + length - lo]
                    rows.append(_side(b"%d|" % a + core, width, r, x, data[x - lo : y - lo + length]))
            yield from _batches(rows)

    return run


def sort_groups(length: int):
    """Rows (grp, part, n, bytes) sorted by grp: the repeated stretches of each part, by one suffix array for each group."""

    def run(batches):
        at, rows, done = None, [], []

        def sort():
            found = repeated_starts([r[2] for r in rows], [r[1] for r in rows], length)
            done.extend((at, r[0], spans(x, length)) for r, x in zip(rows, found, strict=True) if x)

        def out():
            cols = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], names=["grp", "part", "cut"])

        for batch in batches:
            for g, part, n, data in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if g != at:
                    if rows:
                        sort()
                    at, rows = g, []
                rows.append((part, n, data))
            if done:
                yield out()
                done.clear()
        if rows:
            sort()
            if done:
                yield out()

    return run


def remaining(texts: bool):
    """(doc_id, text, flat pairs of stretches or null) to the sizes and the digest of what is left, and to the bytes themselves if texts."""

    def run(batches):
        for batch in batches:
            out = []
            found = batch.column("found")
            ends, flat = found.offsets.to_numpy(), found.values.to_numpy(zero_copy_only=False)
            for i, data in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                pairs = flat[ends[i] : ends[i + 1]]
                if not len(pairs):
                    out.append((len(data), 0, 0, hashlib.sha256(data).hexdigest(), data if texts else None))
                    continue
                flag = np.zeros(len(data) + 2, dtype=np.int32)
                np.add.at(flag, pairs[0::2] + 1, 1)
                np.add.at(flag, pairs[1::2] + 1, -1)
                gone = np.cumsum(flag) > 0
                left = np.frombuffer(data, dtype=np.uint8)[~gone[1:-1]].tobytes()
                out.append((len(data), len(data) - len(left), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest(), left if texts else None))
            n, removed, runs, sha, left = zip(*out, strict=True) if out else [()] * 5
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(left, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def repeated_in(sides: DataFrame, length: int, group: int) -> DataFrame:
    """(h, ctx, cut): what repeats among rows of SIDES, as stretches from the anchor."""
    found = None
    # half of the distances, then stretches of them, then single strings
    for width in (None, max(2, length // 9), max(2, length // 40), 1):
        if width:
            sides = keep(sides.mapInArrow(refined_rows(length, width), SIDES))
        # equal rows of a document give equal rows here, of which one counts
        once = sides.groupBy("grp", "part", "h", "ctx").agg(F.max("n").alias("n"), F.max("shift").alias("shift"), F.max(F.length("bytes")).alias("size"))
        counts = once.groupBy("grp", "part").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
        sizes = cut(counts.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n").alias("total")).filter("total > 1"))
        all_of = counts.join(sizes.filter("m = 1"), "grp").select("grp", "part", F.array(F.lit(0), F.col("size")).alias("cut"))
        small = sizes.filter((F.col("m") > 1) & (F.col("m") <= group)).select("grp")
        data = sides.join(small, "grp", "left_semi").groupBy("grp", "part").agg(F.max("bytes").alias("bytes"))
        few = data.join(counts.select("grp", "part", "n"), ["grp", "part"]).select("grp", "part", "n", "bytes")
        sorted_ = cut(few.repartition("grp").sortWithinPartitions("grp").mapInArrow(sort_groups(length), "grp long, part long, cut array<int>"))
        cuts = once.join(all_of.unionByName(sorted_), ["grp", "part"]).select("h", "ctx", F.transform("cut", lambda x: x + F.col("shift")).alias("cut"))
        found = cuts if found is None else found.unionByName(cuts)
        many = sizes.filter(F.col("m") > max(group, 1)).select("grp")
        if width == 1 or many.isEmpty():
            return found
        sides = sides.join(many, "grp", "left_semi")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = K, group: int = GROUP, texts_too: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes, with texts_too)."""
    t = F.coalesce(F.col(text), F.lit("")).cast("string")
    digest = F.md5(t)
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    half = lambda at: F.shiftleft(part(at), 32).bitwiseOR(part(at + 8))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), half(1).alias("doc"), half(17).alias("doc2"), t.alias("text"))
    text_of = [F.col("doc").alias("of"), F.col("doc2").alias("of2")]
    same_text = (F.col("doc") == F.col("of")) & (F.col("doc2") == F.col("of2"))
    a = keep(own.select("doc", "doc2", "text").mapInArrow(anchor_rows(length, k), ANCHORS))
    by_h = a.groupBy("h").agg(F.count("*").alias("m"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi")).filter("m > 1")
    # written first: a join on what an aggregation has just dealt out could not split a hot hash
    several = cut(by_h.select("h", (F.col("lo") != F.col("hi")).alias("mixed")))
    shared = keep(a.join(several, "h"))
    # contexts under a hash with several contexts: one place stands for all of them
    ctxs = shared.filter("mixed").groupBy("h", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("doc", "doc2", "place")).alias("one")).select("h", "ctx", "n", "one.*")
    wanted = ctxs.groupBy(*text_of).agg(F.collect_list(F.struct("place", "h", "ctx", "n")).alias("found"))
    # of equal texts the row of least id brings the bytes
    least = own.groupBy("doc", "doc2").agg(F.min("doc_id").alias("least"))
    wanted = wanted.join(least, same_text).select("of", "of2", "least", "found")
    sides = keep(own.join(wanted, same_text & F.col("doc_id").eqNullSafe(F.col("least"))).select("text", "found").mapInArrow(side_rows(length, k), SIDES))
    # written first, as above: a context with very many places is split then
    ctx_cuts = keep(repeated_in(sides, length, group).groupBy("h", "ctx").agg(F.flatten(F.collect_list("cut")).alias("cut")))
    mixed_places = shared.filter("mixed").join(ctx_cuts, ["h", "ctx"]).select("doc", "doc2", "place", "cut")
    lo, hi = F.shiftright("place", 12).bitwiseAND(F.lit(4095)), F.col("place").bitwiseAND(F.lit(4095))
    own_places = shared.filter("NOT mixed").select("doc", "doc2", "place", F.array(-lo, hi).cast("array<int>").alias("cut"))
    places = mixed_places.unionByName(own_places).distinct().groupBy(*text_of).agg(F.flatten(F.collect_list(F.transform("cut", lambda x: x + F.shiftright("place", 24)))).alias("found"))
    out = own.join(places, same_text, "left").select("doc_id", "text", "found")
    return out.mapInArrow(remaining(texts_too), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
