"""Quality classification by hierarchical empirical Bayes.

1. A logistic model over the shape of a text (shares of characters, repetition,
   lengths; no word lists) gives the evidence of each document.  It is fitted on at
   most SAMPLE labelled documents of either label.
2. Evidence is summed by path and host, whole counts over all documents.  A host's
   share of good documents is drawn toward the global share, and a path's toward
   its host's, by beta-binomial shrinkage: the prior's weight comes from how much
   the shares differ between hosts (paths) beyond chance, so sites with few
   documents keep close to what stands above them.
3. A document's posterior is its own evidence moved by the log-odds of its path
   against the global share.  The path's and the host's sums leave the document itself
   out, so that its evidence counts once.

The site is ``source``: what precedes its first ``/``, after a scheme if it has one,
is the host, and the next segment the path.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesieve.llm.memory import tidy
from lodesieve.llm.skew import join_one
from lodesieve.sources.scratch import Scratch

#: Bound on the labelled documents of either label that fitting takes.
SAMPLE = 4000
STEPS = 60
_ALPHA = re.compile(r"[^\W\d_]")
_MARKED = re.compile(r"[^\w\s.,;:?'\"()\-]")
N_FEATURES = 14


def features(text: str | None) -> list[float]:
    """Shape of a whole text; a null text is an empty one."""
    text = text or ""
    n = len(text)
    tokens = text.split()
    k = len(tokens)
    if not k:
        return [1.0] + [0.0] * (N_FEATURES - 2) + [1.0]
    distinct = Counter(tokens)
    letters = len(_ALPHA.findall(text))
    upper = sum(map(str.isupper, tokens))
    marked = len(_MARKED.findall(text))
    digits = sum(map(text.count, "0123456789"))
    lines = text.split("\n")
    repeats = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
    tail = sum(not t[-1].isalnum() and t[-1] not in ".,;:?'\")" for t in tokens)
    lone = sum(len(t) == 1 and not t.isalnum() for t in tokens)
    return [1.0, letters / n, upper / k, min(1.0, marked / k), digits / n, math.sqrt(len(distinct) / k) if k < 50 else min(1.0, len(distinct) / math.sqrt(k) / 12), repeats / k, 1 - len(set(lines)) / len(lines), tail / k, lone / k, math.log1p(k) / 10, min(2.0, n / k / 10), min(1.0, distinct.most_common(1)[0][1] / k * 2), 0.0]


def fit(rows: np.ndarray, labels: np.ndarray, share: float) -> np.ndarray:
    """Weights of a logistic model over features and their squares, by ridge-penalised Newton steps."""
    x = np.hstack([rows, rows[:, 1:] ** 2])
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    if not n1 or not n0:
        w = np.zeros(x.shape[1])
        w[0] = math.log((n1 + 0.5) / (n0 + 0.5))
        return w
    importance = np.where(labels == 1, share / n1, (1 - share) / n0) * len(labels)
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 0.02)
    ridge[0] = 1e-6
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (importance * (p - labels)) + ridge * w
        h = (x * (importance * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _fitted(share: float):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["doc_id"], r["label"], features(r["text"])) for batch in batches for r in batch.to_pylist())
        w = fit(np.array([r[2] for r in rows]), np.array([r[1] for r in rows], float), share) if rows else np.zeros(2 * N_FEATURES - 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(w)), pa.int64()), pa.array(w, pa.float64())], ["k", "w"])

    return run


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, target: str = "quality") -> np.ndarray:
    """Weights from the labelled documents; null, other and contradictory labels are left out.  Without labels all are 0."""
    scratch = Scratch(spark, "quality")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = scratch.save(known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("doc_id", "label"), "labels")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (0, 1)]
    picked = scratch.save(parts[0].unionByName(parts[1]), "picked")
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    # at most 2 * SAMPLE ids of 12 bytes
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    rows = sorted(sample.repartition(1).mapInArrow(_fitted(share), "k long, w double").collect())
    return np.array([r["w"] for r in rows]) if rows else np.zeros(2 * N_FEATURES - 1)


def _evidence(weights: np.ndarray):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.array([features(t.as_py()) for t in batch.column(2)])
            z = np.hstack([rows, rows[:, 1:] ** 2]) @ weights
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.clip(z, -30, 30))], ["doc_id", "source", "evidence"])

    return run


def _shrunk(sites: DataFrame, above: str) -> float:
    """Weight of the prior, by the method of moments: how far the shares of sites differ from ``above`` beyond chance."""
    r = sites.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col(above), 2)).alias("spread"), (F.sum(F.col("n") * F.col(above) * (1 - F.col(above))) / F.sum("n")).alias("chance")).first()
    if not r["k"] or r["k"] < 2 or r["chance"] <= 0:
        return 1e6
    excess = (r["spread"] - r["k"] * r["chance"]) / max(1e-9, r["n"] - r["nn"] / r["n"])
    return min(1e6, max(1.0, r["chance"] / excess - 1)) if excess > 1e-12 else 1e6


def judged(spark: SparkSession, docs: DataFrame, labels: DataFrame, key: Column | None = None) -> DataFrame:
    """``doc_id, score, accepted, evidence, host, path`` for every row of ``doc_id, text, source``.

    ``key`` (a long) is given back in place of doc_id, by which labels are found.

    ``score`` is the posterior that the document is good; it is accepted from 0.5 on.
    A null source is an empty host.  Null, empty and very long texts, null ids and repeated
    rows are judged like any; an empty table gives no rows; further columns are ignored.
    """
    scratch = Scratch(spark, "judged")
    weights = learn(spark, docs, labels)
    rows = docs.select((F.col("doc_id").cast("long") if key is None else key).alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string").alias("text"))
    site = F.split(F.regexp_replace("source", r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), "/", 3)
    seen = scratch.save(rows.mapInArrow(_evidence(weights), "doc_id long, source string, evidence double").select("doc_id", "evidence", F.lower(site[0]).alias("host"), F.coalesce(F.get(site, F.lit(1)), F.lit("")).alias("path")), "seen")
    p = 1 / (1 + F.exp(-F.col("evidence")))
    paths = scratch.save(seen.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum(p).alias("good")), "paths")
    whole = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    prior = (whole["good"] + 0.5) / (whole["n"] + 1) if whole["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("prior", F.lit(prior))
    k_host = _shrunk(hosts, "prior")
    hosts = scratch.save(hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good")), "hosts")
    placed = scratch.save(join_one(paths, hosts, ["host"]).withColumn("host_share", (F.col("host_good") + k_host * prior) / (F.col("host_n") + k_host)), "placed")
    k_path = _shrunk(placed, "host_share")
    # the document's own part is taken out of its path and its host
    out = join_one(seen, placed.select("host", "path", "n", "good", "host_n", "host_good"), ["host", "path"])
    host_share = (F.greatest(F.lit(0.0), F.col("host_good") - p) + k_host * prior) / (F.col("host_n") - 1 + k_host)
    share = (F.greatest(F.lit(0.0), F.col("good") - p) + k_path * host_share) / (F.col("n") - 1 + k_path)
    share = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), share))
    move = F.log(share / (1 - share)) - math.log(prior / (1 - prior))
    out = out.withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + move))))
    return out.select("doc_id", "score", (F.col("score") >= 0.5).alias("accepted"), "evidence", "host", "path")
