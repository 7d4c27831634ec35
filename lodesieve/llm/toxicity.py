"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is a logistic function of
its words, a document's is the noisy-or of its sentences, 1 - prod(1 - s), and the
word weights are learned from document labels alone by gradient descent on the
documents' log-likelihood.  The sentences of high score are those that offend.

Training takes at most SAMPLE labelled documents of each label, those whose ids
hash lowest; it runs in one task and gives back one weight per word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesieve.llm.memory import tidy
from lodesieve.sources.scratch import Scratch

#: Bound on the labelled documents of either label that training takes.
SAMPLE = 4000
#: Words that fewer training documents have get no weight.
RARE = 5
#: Least G statistic of a word's documents against the labels for it to get a weight (a chance of about 10^-5).
LEAST_G = 19.5
STEPS = 400
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


def sentences(text: str) -> list[str]:
    return SENTENCE.findall(text)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _g(a: int, b: int, n1: int, n0: int) -> float:
    """G statistic of a word in a of n1 positive and b of n0 negative documents."""
    total, out = n1 + n0, 0.0
    for seen, row, col in ((a, a + b, n1), (b, a + b, n0), (n1 - a, total - a - b, n1), (n0 - b, total - a - b, n0)):
        if seen:
            out += seen * math.log(seen * total / (row * col))
    return 2 * out


def fit(texts: list[str], labels: np.ndarray, share: float) -> tuple[dict[str, float], float]:
    """Weights of words and the bias.  share: of positives among all labelled documents, which the sample is weighted to."""
    n1, n0 = int(labels.sum()), int(len(labels) - labels.sum())
    if not n1 or not n0:
        return {}, math.log((n1 + 0.5) / (n0 + 0.5)) - math.log(100.0)
    seen1: Counter[str] = Counter()
    seen0: Counter[str] = Counter()
    for text, y in zip(texts, labels, strict=True):
        (seen1 if y else seen0).update(set(words(text)))
    vocabulary = sorted(w for w in seen1.keys() | seen0.keys() if seen1[w] + seen0[w] >= RARE and _g(seen1[w], seen0[w], n1, n0) >= LEAST_G)
    number = {w: k for k, w in enumerate(vocabulary)}
    # sentences as sets of known words; sentences with none of them count by document
    cells_s, cells_w, bag, empty = [], [], [], np.zeros(len(texts))
    for d, text in enumerate(texts):
        for s in sentences(text):
            known = {number[w] for w in words(s) if w in number}
            if known:
                cells_s += [len(bag)] * len(known)
                cells_w += known
                bag.append(d)
            else:
                empty[d] += 1
    cells_s, cells_w, bag = np.array(cells_s, np.int64), np.array(cells_w, np.int64), np.array(bag, np.int64)
    y = labels.astype(float)
    importance = np.where(y == 1, share / n1, (1 - share) / n0)
    w, b = np.zeros(len(vocabulary)), -6.0
    first, second, fb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = b + np.bincount(cells_s, w[cells_w], len(bag))
        p = 1 / (1 + np.exp(-z))
        p_empty = 1 / (1 + math.exp(-b))
        # log of the chance that no sentence offends
        log_none = np.bincount(bag, -np.logaddexp(0, z), len(texts)) + empty * -np.logaddexp(0, b)
        none = np.exp(np.minimum(log_none, -1e-9))
        # d loss / d log_none, times d log_none / d z = -p
        pull = importance * np.where(y == 1, none / np.maximum(1 - none, 1e-9), -1.0)
        pull = np.clip(pull, -1e3 * importance, 1e3 * importance)
        gz = -pull[bag] * p
        gw = np.bincount(cells_w, gz[cells_s], len(w)) + 1e-6 * w
        gb = gz.sum() - (pull * empty).sum() * p_empty
        first, second = 0.9 * first + 0.1 * gw, 0.999 * second + 0.001 * gw * gw
        fb, sb = 0.9 * fb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        rate = 0.1 * math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w -= rate * first / (np.sqrt(second) + 1e-10)
        b -= rate * fb / (math.sqrt(sb) + 1e-10)
        b = min(b, -1.0)
    return {t: float(w[k]) for t, k in number.items() if abs(w[k]) > 1e-4}, float(b)


def _trained(share: float):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["doc_id"], r["text"] or "", r["label"]) for batch in batches for r in batch.to_pylist())
        weights, bias = fit([r[1] for r in rows], np.array([r[2] for r in rows], np.int64), share) if rows else ({}, -10.0)
        yield pa.RecordBatch.from_arrays([pa.array([None, *weights], pa.string()), pa.array([bias, *weights.values()], pa.float64())], ["word", "weight"])

    return run


class Model:
    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        self.plain = -float(np.logaddexp(0, bias))

    def sentence_scores(self, text: str) -> list[float]:
        get = self.weights.get
        return [1 / (1 + math.exp(-max(-60.0, min(60.0, self.bias + sum(get(w, 0.0) for w in set(words(s))))))) for s in sentences(text)]

    def judged(self, text: str | None) -> tuple[float, list[str]]:
        """Noisy-or over the sentences, and the sentences that offend; a text without any scores as one neutral sentence.

        A text whose sentences offend only together gives the one of highest score.
        """
        if not text:
            return -math.expm1(self.plain), []
        known = self.weights
        parts = sentences(text)
        if self.bias < 0 and not any(w in known for w in words(text)):
            return -math.expm1(self.plain * max(1, len(parts))), []
        none, logits = 0.0, []
        for s in parts:
            hit = {w for w in words(s) if w in known}
            logits.append(self.bias + sum(known[w] for w in hit))
            none += -float(np.logaddexp(0, logits[-1])) if hit else self.plain
        score = -math.expm1(none)
        least = min(0.0, max(logits, default=0.0)) if score >= 0.5 else 0.0
        return score, [s.strip() for s, z in zip(parts, logits, strict=True) if z >= least]

    def score(self, text: str | None) -> float:
        return self.judged(text)[0]


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, target: str = "toxic") -> Model:
    """A model from the labelled documents; labels (doc_id, target 0 or 1) that are null or repeated differently are left out.

    Without labels every score is near 0.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("doc_id", "label")
    scratch = Scratch(spark, "toxicity")
    known = scratch.save(known, "labels")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        picked = part if picked is None else picked.unionByName(part)
    picked = scratch.save(picked, "picked")
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    # at most 2 * SAMPLE ids of 12 bytes
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    rows = sample.repartition(1).mapInArrow(_trained(share), "word string, weight double").collect()
    weights = {r["word"]: r["weight"] for r in rows if r["word"] is not None}
    return Model(weights, next((r["weight"] for r in rows if r["word"] is None), -10.0))


def _scores(model: Model):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [model.judged(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.float64()), pa.array([m[1] for m in made], pa.list_(pa.string()))], ["doc_id", "score", "offending"])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` and the ``offending`` sentences (those that score 0.5 or more) of every row.

    Null and empty texts score as one neutral sentence and have none that offends; very long
    texts are read whole; repeated rows are scored each; an empty table gives no rows; further columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_scores(model), "doc_id long, score double, offending array<string>")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
