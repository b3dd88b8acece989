"""Toxicity by cumulative-link ordinal regression.

Grades are ordered: 0 clean, 1 mild, 2 severe. One weight vector w is shared by all thresholds:
P(grade > k) = sigmoid(w x - theta_k), theta_0 < theta_1. The output is the expected severity, the sum of these.

Features are sparse and binary: the words of a text (lower case, letters only) and their heads of 4 and 5 letters. The
vocabulary is the max_features features of largest chi-square against the labels.

Labels may hold a grade of their own; then both thresholds are learned from them (column `grade`). Where they hold only
toxic 0/1, nothing says what is severe, so that grade is a rule of ours, not learned: toxic documents with at least
SEVERE_HITS different strong features (of the vocabulary, at least 20 times likelier in toxic ones) are severe.

Fitting uses at most max_labelled labelled documents, those with the least hash of their id: a documented bound, as a
linear model of a few thousand features gains nothing from more. Scoring reads every whole text.

Defined cases: a null or empty text scores as a text without features; labels that are null, or whose document is
missing, are not used; of repeated labels the largest counts; without any toxic label every severity is 0; other
columns pass through the stage and are not looked at.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, keep

MAX_LABELLED, MAX_FEATURES, SEVERE_HITS, CUT = 10_000, 4_000, 6, 0.35
#: Features below this chi-square are left out.
MIN_CHI2 = 5.0
LETTERS = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Words as they are; heads end in a star."""
    out = set(LETTERS.findall((text or "").lower()))
    out |= {w[:4] + "*" for w in out if len(w) > 4 and w[-1] != "*"} | {w[:5] + "*" for w in out if len(w) > 5 and w[-1] != "*"}
    return out


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    thetas: np.ndarray

    def severity(self, logit: float) -> float:
        """Expected grade for w x."""
        return float(sum(1 / (1 + math.exp(min(700.0, t - logit))) for t in self.thetas))

    def probabilities(self, logit: float) -> list[float]:
        above = [1.0, *(1 / (1 + math.exp(min(700.0, t - logit))) for t in self.thetas), 0.0]
        return [above[k] - above[k + 1] for k in range(len(above) - 1)]


def select_features(found: DataFrame, limit: int) -> tuple[list[str], list[float]]:
    """Features in at least three texts by chi-square, and their rate ratios. Counting and ranking stay in the cluster."""
    sides = found.agg(F.sum("__toxic").alias("p"), F.count("*").alias("n")).first()
    p = float(sides["p"] or 0)
    n = max(1.0, sides["n"] - p)
    if not p:
        return [], []
    counts = found.select("__toxic", F.explode("__features").alias("f")).groupBy("f").agg(F.sum("__toxic").cast("double").alias("a"), F.count("*").cast("double").alias("c")).filter("c >= 3")
    a, c, b = F.col("a"), F.col("c"), F.col("c") - F.col("a")
    d = a * (n - b) - b * (p - a)
    chi2 = d * d * (p + n) / F.greatest(F.lit(1.0), c * (p + n - c) * p * n)
    scored = counts.select("f", chi2.alias("chi2"), ((a / p) / ((b + 0.1) / n)).alias("ratio")).filter(F.col("chi2") >= MIN_CHI2)
    best = scored.orderBy(F.desc("chi2"), "f").limit(limit).collect()
    return [r["f"] for r in best], [r["ratio"] for r in best]


def grades(found: list[np.ndarray], toxic: np.ndarray, ratio: list[float]) -> np.ndarray:
    """Grades for labels that are 0/1: see the head of this module."""
    strong = np.array([r >= 20 for r in ratio], dtype=bool)
    return np.array([0 if not t else 2 if strong[x].sum() >= SEVERE_HITS else 1 for x, t in zip(found, toxic, strict=True)])


def fit(found: list[np.ndarray], grade: np.ndarray, names: list[str], rounds: int = 600, l2: float = 0.02, l1: float = 0.0003) -> Model:
    """Proximal gradient (FISTA) on the cumulative-link likelihood; theta_1 = theta_0 + exp(gap). found: each text's places in names.

    It lessens the mean of -log P(grade) plus l2 / 2n |w|^2 + l1 |w|_1.
    """
    grade = np.asarray(grade, dtype=np.int64)
    if not len(grade) or not grade.any():
        return Model({}, np.zeros(0), np.array([1e3, 1e3]))
    rows, cols = np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate(found)
    n, m = len(grade), len(names)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -35, 35)))
    product = lambda w: np.bincount(rows, weights=w[cols], minlength=n)

    def loss(w, theta, gap):
        x = product(w)
        a, b = sig(x - theta), sig(x - theta - math.exp(gap))
        p = np.where(grade == 0, 1 - a, np.where(grade == 2, b, a - b))
        return -np.log(np.maximum(p, 1e-12)).mean() + l2 / 2 / n * (w @ w) + l1 * np.abs(w).sum()

    w, theta, gap = np.zeros(m), 1.0, 1.0
    most = np.bincount(rows, minlength=n).max(initial=1)
    # features are sparse, so the first step is bold; it and that of the thresholds are halved whenever the loss rises
    step, pace, z, t = 16.0 / (0.5 * most + 2), 1.0, w.copy(), 1.0
    now = loss(w, theta, gap)
    for _ in range(rounds):
        x = product(z)
        a, b = sig(x - theta), sig(x - theta - math.exp(gap))
        # d log P(grade) / d logit, and by each threshold
        g0, g2 = -a, 1 - b
        mid = np.maximum(a - b, 1e-9)
        g1 = (a * (1 - a) - b * (1 - b)) / mid
        d = np.where(grade == 0, g0, np.where(grade == 2, g2, g1))
        d_theta0 = np.where(grade == 0, a, np.where(grade == 1, -a * (1 - a) / mid, 0)).mean()
        d_theta1 = np.where(grade == 1, b * (1 - b) / mid, np.where(grade == 2, -(1 - b), 0)).mean()
        grad = -np.bincount(cols, weights=d[rows], minlength=m) / n + l2 / n * z
        new = z - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        moved = theta + pace * (d_theta0 + d_theta1), min(3.0, max(-3.0, gap + pace * d_theta1 * math.exp(gap)))
        then = loss(new, *moved)
        if then > now + 1e-12:
            if t == 1.0:
                step, pace = step / 2, pace / 2
            z, t = w.copy(), 1.0
            continue
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - w)
        w, t, now = new, t_new, then
        theta, gap = moved
    keep = np.flatnonzero(w)
    return Model({names[i]: j for j, i in enumerate(keep)}, w[keep], np.array([theta, theta + math.exp(gap)]))


def extract(batches):
    """Each text's features in place of the text."""
    for batch in batches:
        own = pa.array([sorted(features(t)) for t in batch.column("__text").to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column("__key"), batch.column("__toxic"), batch.column("__grade"), own], names=["__key", "__toxic", "__grade", "__features"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES) -> Model:
    """The driver gets max_features names and, for each of max_labelled texts at most, places in them; no text.

    labels: doc_id, toxic, and `grade` (0, 1, 2) if there; a null grade falls back to the rule.
    """
    grade = F.col("grade").cast("int") if "grade" in labels.columns else F.lit(None).cast("int")
    given = labels.select(F.col("doc_id").alias("__l"), F.when(grade.isNotNull(), (grade > 0).cast("int")).otherwise((F.col("toxic") > 0).cast("int")).alias("__t"), grade.alias("__g"))
    by_id = given.filter("__t IS NOT NULL AND __l IS NOT NULL").groupBy("__l").agg(F.max("__t").alias("__toxic"), F.max("__g").alias("__grade"))
    chosen = by_id.orderBy(F.xxhash64("__l"), "__l").limit(max_labelled)
    own = docs.select(F.col(id_col).alias("__i"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    rows = own.join(F.broadcast(chosen), F.col("__i") == F.col("__l")).withColumn("__key", F.sha2("__text", 256))
    # equal texts teach nothing twice, but make what they share look telling; the label of the least id holds
    one = rows.groupBy("__key").agg(F.min_by("__toxic", "__i").alias("__toxic"), F.min_by("__grade", "__i").alias("__grade"), F.first("__text").alias("__text"))
    found = keep(one.mapInArrow(extract, "__key string, __toxic int, __grade int, __features array<string>"))
    names, ratio = select_features(found, max_features)
    place = {f: i for i, f in enumerate(names)}

    def places(batches):
        for batch in batches:
            own = pa.array([sorted(place[f] for f in fs if f in place) for fs in batch.column("__features").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("__key"), batch.column("__toxic"), batch.column("__grade"), own], names=["__key", "__toxic", "__grade", "__places"])

    got = found.mapInArrow(places, "__key string, __toxic int, __grade int, __places array<int>").toArrow().sort_by("__key")
    free(docs.sparkSession)
    at = [np.asarray(x.values, dtype=np.int64) for x in got.column("__places")]
    ruled = grades(at, got.column("__toxic").to_numpy(), ratio)
    return fit(at, np.array([r if g is None else min(2, g) for r, g in zip(ruled, got.column("__grade").to_pylist(), strict=True)]), names)


def logits(model: Model):
    """A function from texts to w x. A word's features are the same in every text, so they are remembered as long as it lives."""
    weight = {f: float(model.weights[i]) for f, i in model.vocabulary.items()}
    known: dict[str, tuple[tuple[str, float], ...]] = {}

    def run(texts: list[str | None]) -> list[float]:
        out = []
        for text in texts:
            hit: dict[str, float] = {}
            for w in set(LETTERS.findall((text or "").lower())):
                k = known.get(w)
                if k is None:
                    # cleared before it outgrows the worker
                    if len(known) > 300_000:
                        known.clear()
                    own = {w} | ({w[:4] + "*"} if len(w) > 4 else set()) | ({w[:5] + "*"} if len(w) > 5 else set())
                    k = known[w] = tuple((f, weight[f]) for f in sorted(own) if f in weight)
                if k:
                    hit.update(k)
            out.append(math.fsum(hit.values()))
        return out

    return run


def scorer(model: Model, cut: float):
    def score(batches):
        logit = logits(model)
        for batch in batches:
            out = logit(batch.column("__text").to_pylist())
            sev = [model.severity(x) if len(model.weights) else 0.0 for x in out]
            grade = [int(np.argmax(model.probabilities(x))) if len(model.weights) else 0 for x in out]
            cols = [pa.array(sev, pa.float64()), pa.array(grade, pa.int32()), pa.array([s >= cut for s in sev], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "severity", "grade", "toxic"])

    return score


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """One row for each document: doc_id, severity (expected grade), grade (the likeliest), toxic (severity >= cut)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("__text"))
    return rows.mapInArrow(scorer(model, cut), "doc_id long, severity double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", cut: float = CUT) -> DataFrame:
    """docs without the toxic ones, row by row: no join, so repeated or null ids need no care."""
    at = docs.columns.index(text)

    def keep(batches):
        logit = logits(model)
        for batch in batches:
            if len(model.weights):
                batch = batch.filter(pa.array([model.severity(x) < cut for x in logit(batch.column(at).to_pylist())], pa.bool_()))
            yield batch

    return docs.mapInArrow(keep, docs.schema)
