"""N-gram Jaccard join: MinHash banding, then verification on the full n-gram sets.

Rows of a band and number of bands are chosen for a target recall at the threshold: of the choices that keep to
MAX_HASHES hash functions, the one with most rows in a band, which has the fewest false candidates.

Equal texts are one node (the 128-bit digest of the text) from the start. Nodes meet on band hashes. Only buckets of two
or more nodes go on; nodes that they connect form a candidate component. A component's texts are fetched once. A task
verifies a group of nodes, or two blocks of a large group: it counts for each node its partners that share a band and
have a Jaccard of at least the threshold, and gives a tree of the links. So neither pairs nor copies are written out, and
no link between different texts that share a band is lost.

A group is a component as a rule. Its nodes are dealt to at most FEW blocks until a block has WIDE nodes or BLOCK_BYTES,
so a text is sent FEW times, or (nodes / WIDE) times in very large groups; counting all links of m texts that are all
alike takes m * m / 2 comparisons by any way. A large component that hangs together by chains of small buckets, as false
candidates make it in a large corpus, is verified bucket by bucket in place of all its block pairs, if that sends fewer
texts: a pair is then counted in the first band that it shares, and a text is sent at most once for each band and block.

Defined cases: a null text is empty; texts without words have no n-grams and link to nothing, but equal texts, these
included, are one class; a text of fewer words than n is one n-gram; null ids are classed by their text; repeated rows
fall in one class; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, cut
from .groups import components
from .hashing import mixed, shingles

N, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.999, 128
#: Nodes of a block in groups of up to FEW blocks, and in larger ones; bytes of text of a block.
BLOCK, FEW, WIDE, BLOCK_BYTES = 192, 8, 2048, 16 << 20


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows)."""
    fits = [(math.ceil(math.log(1 - recall) / math.log(1 - threshold**r)), r) for r in range(1, 20)]
    return max((x for x in fits if x[0] * x[1] <= most), key=lambda x: x[1], default=(most, 1))


def signer(bands: int, rows: int, n: int = N):
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def band_hashes(text: bytes) -> np.ndarray | None:
        s = shingles(text, n)
        if not len(s):
            return None
        least = np.full(bands * rows, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for k in range(0, len(s), 4096):
            part = s[k : k + 4096]
            for j in range(bands * rows):
                least[j] = min(least[j], (part * a[j] + b[j]).min())
        out = np.arange(bands, dtype=np.uint64)
        for j in range(rows):
            out = mixed(out + least[j::rows])
        return out.view(np.int64)

    return band_hashes


def node_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def signatures(docs: DataFrame, id_col: str, text: str, bands: int, rows: int, n: int) -> DataFrame:
    sign = signer(bands, rows, n)

    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            out = [sign(t) if t else None for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64())), pa.array([len(t or b"") for t in texts], pa.int64())], names=["doc_id", "node", "bands", "size"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), node_of(F.col(text)).alias("node"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, node binary, bands array<long>, size long")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: products of 0/1 matrices, a stretch of the shared n-grams at a time."""
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.cumsum(times > 1) - 1
    use = times[at] > 1
    who, at = who[use], common[at[use]]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    step = 2048
    for k in range(0, int(at[-1]) + 1 if len(at) else 0, step):
        i, j = np.searchsorted(at, [k, k + step])
        x = np.zeros((len(sets), step), dtype=np.float32)
        x[who[i:j], at[i:j] - k] = 1
        out += x @ x.T
    return out


def links(texts: list[bytes], bands: list[np.ndarray], left: np.ndarray, right: np.ndarray, n: int, threshold: float, band: int = -1) -> np.ndarray:
    """Booleans for pairs (one of left, one of right or of both): a shared band, and the Jaccard at least threshold.

    With a band given, the first shared one must be that.
    """
    b = np.stack(bands)
    near = np.zeros((len(b), len(b)), dtype=bool)
    for k in range(b.shape[1] if band < 0 else band):
        near |= b[:, None, k] == b[None, :, k]
    if band >= 0:
        near = ~near & (b[:, None, band] == b[None, :, band])
    near &= (left[:, None] & right[None, :]) | (right[:, None] & left[None, :])
    np.fill_diagonal(near, False)
    if not near.any():
        return near
    sets = [shingles(t, n) for t in texts]
    size = np.array([len(s) for s in sets], dtype=np.float64)
    if near.sum() <= 6 * len(sets):
        for i, j in zip(*np.nonzero(np.triu(near)), strict=True):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            near[i, j] = near[j, i] = both >= threshold * (size[i] + size[j] - both) - 1e-9
        return near
    both = shared_counts(sets).astype(np.float64)
    return near & (both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9)


def roots(near: np.ndarray) -> list[int]:
    """For each row the least row that links lead to."""
    out = [-1] * len(near)
    for s in range(len(near)):
        if out[s] < 0:
            out[s], todo = s, [s]
            while todo:
                for j in np.flatnonzero(near[todo.pop()]).tolist():
                    if out[j] < 0:
                        out[j] = s
                        todo.append(j)
    return out


def verifier(n: int, threshold: float):
    """Rows sorted by (grp, i, j) come in; (node, root, links, alone) of each group go out. alone: no other task has the node."""

    def group(rows: dict) -> list[tuple]:
        nodes = sorted(rows)
        _, _, _, i, j, blocks, band = rows[nodes[0]]
        block = np.array([rows[x][2] for x in nodes])
        near = links([rows[x][0] for x in nodes], [rows[x][1] for x in nodes], block == i, block == j, n, threshold, band)
        return [(x, nodes[r], int(c), blocks == 1 and band < 0) for x, r, c in zip(nodes, roots(near), near.sum(axis=1), strict=True)]

    def run(batches):
        at, rows = None, {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*group(rows), strict=True), (pa.binary(), pa.binary(), pa.int64(), pa.bool_()), strict=True)], names=["node", "root", "links", "alone"])

        for batch in batches:
            c = {k: batch.column(k) for k in batch.schema.names}
            values = {k: c[k].to_pylist() for k in ("grp", "i", "j", "node", "block", "blocks", "band", "bands")}
            texts = c["text"].cast(pa.binary()).to_pylist()
            for k, (grp, i, j) in enumerate(zip(values["grp"], values["i"], values["j"], strict=True)):
                if at != (grp, i, j):
                    if rows:
                        yield out()
                    at, rows = (grp, i, j), {}
                rows[values["node"][k]] = (texts[k], np.array(values["bands"][k]), values["block"][k], i, j, values["blocks"][k], values["band"][k])
        if rows:
            yield out()

    return run


def n_blocks(block: int) -> Column:
    """Blocks of a group of m nodes and `bytes` bytes."""
    wide = max(block, min(WIDE, block * 11))
    return F.greatest(F.ceil(F.col("m") / wide), F.least(F.ceil(F.col("m") / block), F.lit(FEW)), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("int")


def groups_of(members: DataFrame, comps: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    """(node, grp, band, blocks): the groups that each node is verified in. members: bucket, band, node."""
    sized = comps.join(nodes.select("node", "size"), "node")
    sizes = cut(sized.groupBy("comp").agg(F.count("*").alias("m"), F.sum("size").alias("bytes")).withColumn("blocks", n_blocks(block)))
    placed = comps.join(sizes, "comp").select("node", F.col("comp").alias("grp"), F.lit(-1).alias("band"), "blocks", "m")
    large = sizes.filter("blocks > 1")
    if large.isEmpty():
        return placed.drop("m")
    own = members.join(comps, "node").join(large.select("comp"), "comp", "left_semi").join(nodes.select("node", "size"), "node")
    buckets = own.groupBy("comp", "bucket").agg(F.count("*").alias("m"), F.sum("size").alias("bytes")).withColumn("b", n_blocks(block))
    spread = cut(buckets.groupBy("comp").agg(F.sum(F.col("m") * F.col("b")).alias("sent")).join(large, "comp").filter(F.col("sent") < F.col("m") * F.col("blocks")).select("comp"))
    if spread.isEmpty():
        return placed.drop("m")
    by_bucket = own.join(spread, "comp", "left_semi").join(buckets.select("bucket", "b"), "bucket")
    by_bucket = by_bucket.select("node", F.encode(F.col("bucket").cast("string"), "utf-8").alias("grp"), "band", F.col("b").alias("blocks"))
    return placed.drop("m").join(spread.withColumnRenamed("comp", "grp"), "grp", "left_anti").select("node", "grp", "band", "blocks").unionByName(by_bucket)


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row for each document: doc_id, node, text_id (least id of its equal texts), class_id (least id that links lead to), n_links (different texts linked)."""
    bands, rows = banding(threshold, recall)
    signed = cut(signatures(docs, id_col, text, bands, rows, n))
    nodes = cut(signed.groupBy("node").agg(F.min("doc_id").alias("text_id"), F.any_value("bands").alias("bands"), F.any_value("size").alias("size")))
    banded = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    several = banded.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1").select("bucket")
    members = cut(banded.join(several, "bucket", "left_semi").select("bucket", "band", "node"))
    placed = groups_of(members, components(members.select("bucket", "node"), kept=True), nodes, block)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.join(nodes, "node").select("node", "grp", "band", "block", "blocks", "bands", "text_id")
    # the text of one row for each node; equal rows that remain are told apart by nothing and count once
    own = docs.select(F.col(id_col).cast("long").alias("d"), node_of(F.col(text)).alias("node"), F.col(text).cast("string").alias("text"))
    fetched = own.join(placed, (own["node"] == placed["node"]) & own["d"].eqNullSafe(placed["text_id"])).select(placed["node"], "grp", "band", "block", "blocks", "bands", "text")
    paired = fetched.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    tasks = paired.select("grp", "i", "j", "node", "block", "blocks", "band", "bands", "text").repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    found = cut(tasks.mapInArrow(verifier(n, threshold), "node binary, root binary, links long, alone boolean"))
    tree = found.filter("NOT alone").select(F.col("root").alias("bucket"), "node").unionByName(found.filter("NOT alone").select(F.col("root").alias("bucket"), F.col("root").alias("node")).distinct())
    root = found.filter("alone").select("node", "root").unionByName(components(tree).select("node", F.col("comp").alias("root")))
    counts = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    linked = root.join(counts, "node").join(nodes.select("node", "text_id"), "node")
    least = linked.groupBy("root").agg(F.min("text_id").alias("class_id"))
    info = linked.join(least, "root").select("node", "class_id", "n_links")
    # written first, with a row for each node: the one join that follows can split a text of very many copies
    info = cut(nodes.select("node", "text_id").join(info, "node", "left"))
    out = signed.select("doc_id", "node").join(info, "node")
    return out.select("doc_id", "node", "text_id", F.coalesce("class_id", "text_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each class: the one of least id. Rows that repeat it go too."""
    from pyspark.sql import Window

    found = cut(classes(docs, id_col, text))
    stays = F.col("doc_id").eqNullSafe(F.col("class_id"))
    drop = found.filter(~stays).select(F.col("doc_id").alias("d2"), F.col("node").alias("n2")).distinct()
    again = cut(found.filter(stays).groupBy(F.col("doc_id").alias("d2"), F.col("node").alias("n2")).agg(F.count("*").alias("times")).filter("times > 1").select("d2", "n2"))
    key = boxed(docs, d=F.col(id_col).cast("long"), node=node_of(F.col(text)))
    on = F.col("d").eqNullSafe(F.col("d2")) & (F.col("node") == F.col("n2"))
    if again.isEmpty():
        return key.join(drop, on, "left_anti").select("row.*")
    single = key.join(drop.unionByName(again), on, "left_anti").select("row")
    # of repeated rows of a document that stays one goes on
    nth = F.row_number().over(Window.partitionBy("d2", "n2").orderBy(F.lit(0)))
    first = key.join(again, on).withColumn("nth", nth).filter("nth = 1").select("row")
    return single.unionByName(first).select("row.*")
