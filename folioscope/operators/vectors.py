"""Vector top-k by cosine: exact over query blocks, and with random-hyperplane buckets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import ArrayType, BinaryType, FloatType

#: Queries in one matrix product; a stated query set is held in blocks of this size.
BLOCK = 1024
#: Vectors that meet a block at once, and blocks whose best a task holds until it ends; more are given out early.
SLICE, HELD = 1024, 256
FOUND = "query long, vec_id long, score double"


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def blocks_with(queries: DataFrame, vectors: DataFrame, block: int, more=None) -> DataFrame:
    """ids, dim, m, more of a block of queries beside v_ids, v, v_more of a batch of vectors, for all blocks and batches.

    Queries are packed into rows of `block` of them, and these rows go to the tasks of vectors one by one: a query set of
    any size is read as a table, and nothing of it is in the driver. more: what goes along for a matrix of vectors, as bytes.
    """

    def rest(m):
        return more(m).tobytes() if more else b""

    def row(ids, rows):
        m = np.stack(rows)
        return pd.DataFrame({"ids": [ids], "dim": [len(rows[0])], "m": [m.tobytes()], "more": [rest(m)]})

    def packed(batches):
        ids, rows = [], []
        for pdf in batches:
            for i, v in zip(pdf["vec_id"].tolist(), pdf["embedding"], strict=True):
                ids.append(i)
                rows.append(np.asarray(v, dtype=np.float32))
                if len(ids) == block:
                    yield row(ids, rows)
                    ids, rows = [], []
        if ids:
            yield row(ids, rows)

    def batches_of(batches):
        for pdf in batches:
            if len(pdf):
                m = np.stack([np.asarray(x, dtype=np.float32) for x in pdf["embedding"]])
                yield pd.DataFrame({"v_ids": [pdf["vec_id"].tolist()], "v": [m.tobytes()], "v_more": [rest(m)]})

    blocks = queries.select("vec_id", "embedding").mapInPandas(packed, "ids array<long>, dim int, m binary, more binary")
    parts = vectors.select("vec_id", "embedding").mapInPandas(batches_of, "v_ids array<long>, v binary, v_more binary")
    return parts.crossJoin(blocks)


def ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def topk(queries: DataFrame, vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """query, vec_id, score, rank. Queries meet vectors in blocks: a row of a block of queries for each batch of vectors.

    Tasks keep the k best of each batch for each query.
    """

    def best(batches):
        for pdf in batches:
            out = []
            for ids, dim, m, v_ids, v in zip(pdf["ids"], pdf["dim"], pdf["m"], pdf["v_ids"], pdf["v"], strict=True):
                q, x = (unit(np.frombuffer(b, dtype=np.float32).reshape(-1, int(dim)).astype(np.float64)) for b in (m, v))
                own, s = np.asarray(v_ids), np.round(q @ x.T, 6)
                for i, name in enumerate(ids):
                    order = np.lexsort((own, -s[i]))[:k]
                    out.append(pd.DataFrame({"query": name, "vec_id": own[order], "score": s[i][order]}))
            if out:
                yield pd.concat(out)

    return ranked(blocks_with(queries, vectors, block).mapInPandas(best, FOUND), k)


def checked_upload(uploads: DataFrame, chunks: DataFrame, chunker: str, dim: int) -> DataFrame:
    """book, status, chunk, vector: uploaded half-precision vectors, one for each chunk of its book, or why they are refused.

    uploads: book, chunker, n, raw (all vectors of a book); chunks: book, chunk (from 0). A book is taken as a whole.
    """
    counts = chunks.groupBy(F.col("book").alias("_b")).agg(F.count("*").alias("_n"))
    own = uploads.join(counts, F.col("book") == F.col("_b"), "left")
    status = (
        F.when(F.coalesce(F.col("chunker") != chunker, F.lit(True)), "chunker")
        .when(F.coalesce(F.octet_length("raw") != F.col("n") * dim * 2, F.lit(True)), "bytes")
        .when(F.coalesce(F.col("_n"), F.lit(0)) != F.col("n"), "chunks")
        .otherwise("ok")
    )
    own = own.withColumn("status", status)
    part = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))), lambda i: F.struct(i.cast("int").alias("chunk"), F.substring(F.col("raw"), i * (dim * 2) + 1, F.lit(dim * 2)).alias("v")))
    taken = own.filter("status = 'ok' AND n > 0").select("book", "status", F.inline(part)).select("book", "status", "chunk", decode_f16("v").alias("vector"))
    refused = own.filter("status <> 'ok'").select("book", "status", F.lit(None).cast("int").alias("chunk"), F.lit(None).cast("array<float>").alias("vector"))
    return taken.unionByName(refused)


def upserted(points: DataFrame, new: DataFrame) -> DataFrame:
    """points (id, ...) with the rows of new in place of those of the same id. Of equal ids in new, any one."""
    own = new.dropDuplicates(["id"])
    return points.join(own.select("id"), "id", "left_anti").unionByName(own)


def shared_buckets(a: np.ndarray, b: np.ndarray):
    """(rows of a, rows of b) that share a bucket, for each bucket of each table; codes are in columns by table."""
    for t in range(a.shape[1]):
        by_a, by_b = np.argsort(a[:, t], kind="stable"), np.argsort(b[:, t], kind="stable")
        of_a, of_b = a[by_a, t], b[by_b, t]
        for code in np.intersect1d(of_a, of_b):
            (a0, a1), (b0, b1) = (np.searchsorted(x, (code, code + 1)) for x in (of_a, of_b))
            yield by_a[a0:a1], by_b[b0:b1]


class Best:
    """The k best (score, vec_id) of each query of a block, over any number of slices of vectors; score down, vec_id up.

    A pair is looked at closely only if its score may still be among the k best, and it counts only if it shares a bucket.
    """

    def __init__(self, q: np.ndarray, codes: np.ndarray, k: int):
        self.q, self.codes, self.k = q, codes, k
        self.row, self.id, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        # scores are rounded to six places, so what is less by 1e-6 than the last of k cannot be among them
        self.least = np.full(len(q), -np.inf)

    def hits(self, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and scores. By bucket if buckets hold fewer pairs in all than there are, else by one product."""
        if sum(len(a) * len(b) for a, b in shared_buckets(self.codes, codes)) < len(self.q) * len(x):
            parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
            for a, b in shared_buckets(self.codes, codes):
                s = self.q[a] @ x[b].T
                i, j = np.nonzero(~(s < self.least[a, None]))
                parts.append((a[i], b[j], s[i, j]))
            i, j, s = (np.concatenate(p) for p in zip(*parts, strict=True))
            one = np.unique(i * len(x) + j, return_index=True)[1]
            return i[one], j[one], s[one]
        s = self.q @ x.T
        i, j = np.nonzero(~(s < self.least[:, None]))
        near = (self.codes[i] == codes[j]).any(axis=1)
        return i[near], j[near], s[i[near], j[near]]

    def add(self, x: np.ndarray, codes: np.ndarray, ids: np.ndarray) -> None:
        i, j, s = self.hits(x, codes)
        row, own, score = np.concatenate([self.row, i]), np.concatenate([self.id, ids[j]]), np.concatenate([self.score, np.round(s, 6)])
        # as Spark orders them, NaN above all numbers
        order = np.lexsort((own, np.where(np.isnan(score), -np.inf, -score), row))
        row, own, score = row[order], own[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        top, last = place < self.k, place == self.k - 1
        self.least[row[last]] = score[last] - 2e-6
        self.row, self.id, self.score = row[top], own[top], score[top]


def lsh_topk(queries: DataFrame, vectors: DataFrame, k: int, planes: int = 4, tables: int = 24, seed: int = 5) -> DataFrame:
    """As topk, among vectors that share the bucket of some table with the query; scored exactly.

    No pair and no vector goes through a shuffle beside the dealing by id: blocks of queries meet batches of vectors, both
    with their buckets, and tasks keep the k best of all their vectors. Rows without a vector are in no bucket; of rows with
    one vec_id any one counts.
    """
    kind = np.uint8 if planes <= 8 else np.uint16 if planes <= 16 else np.int64

    def buckets(m):
        # the same planes in every task, as they come from the seed alone
        normals = np.random.default_rng(seed).standard_normal((tables, planes, m.shape[1]))
        bits = np.einsum("tpd,nd->ntp", normals, m.astype(np.float64)) > 0
        return (bits * (1 << np.arange(planes))).sum(axis=2).astype(kind)

    def read(m, codes, dim):
        m = np.frombuffer(m, dtype=np.float32).reshape(-1, int(dim)).astype(np.float64)
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(size == 0, 1, size), np.frombuffer(codes, dtype=kind).reshape(-1, tables)

    def rows(names, best):
        return pd.DataFrame({"query": names[best.row], "vec_id": best.id, "score": best.score})

    def best_of(batches):
        held: dict[bytes, tuple[np.ndarray, Best]] = {}
        for pdf in batches:
            for ids, dim, m, more, v_ids, v, v_more in zip(*(pdf[c] for c in ("ids", "dim", "m", "more", "v_ids", "v", "v_more")), strict=True):
                names = np.asarray(ids, dtype=np.int64)
                if (key := names.tobytes()) not in held:
                    if len(held) == HELD:
                        yield rows(*held.pop(next(iter(held))))
                    held[key] = names, Best(*read(m, more, dim), k)
                own, (x, codes) = np.asarray(v_ids, dtype=np.int64), read(v, v_more, dim)
                at = 0
                while at < len(own):
                    # few at first, when no score is out of the question yet
                    to = at + (SLICE if np.isfinite(held[key][1].least).all() else SLICE // 8)
                    held[key][1].add(x[at:to], codes[at:to], own[at:to])
                    at = to
        for names, best in held.values():
            yield rows(names, best)

    one = lambda t: t.select("vec_id", "embedding").filter("embedding IS NOT NULL").dropDuplicates(["vec_id"])
    return ranked(blocks_with(one(queries), one(vectors), BLOCK, buckets).mapInPandas(best_of, FOUND), k)


@F.pandas_udf(ArrayType(FloatType()))
def decode_f16(raw: pd.Series) -> pd.Series:
    """Little-endian half-precision vectors; null for null and for an odd number of bytes."""
    return raw.map(lambda b: None if b is None or len(b) % 2 else np.frombuffer(b, "<f2").astype(np.float32))


@F.pandas_udf(BinaryType())
def encode_f16(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f2").tobytes())
