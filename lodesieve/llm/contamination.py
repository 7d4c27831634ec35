"""Benchmark decontamination: short test items found inside long documents.

A search for containment |item and document| / |item| >= threshold over sets of
five-word shingles.  Jaccard similarity, which minima estimate, is low where a
short item lies in a long document, so both sides are partitioned by size: items
by the power of two that holds their number of shingles, and, for each such class
of at most q shingles, every document into windows of 2 q shingles at steps of q.
Any run of q shingles lies in one window, so a contained item has a Jaccard
similarity of at least 0.8 * (q / 2) / (2 q + 0.2 * q / 2) = 0.19 with it, and one
equal minimum out of 64 makes the pair a candidate (missed with probability
1.4e-6, and far less for most).  Items of at most SMALL shingles are looked up by
the shingles themselves, which misses none.  Candidates are verified by exact containment in
the whole document's set.

The items' minima go to the executors with the code.  Items are taken in rounds
of about ROUND items and ROUND_CHARS characters at most, and every round's result is
written before the next begins, so what is sent, and what the driver holds, has a fixed
bound however many items there are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesieve.llm.memory import tidy
from lodesieve.llm.rows import row_key, without_rows
from lodesieve.llm.words import Minima, shingle_runs, shingle_sets
from lodesieve.sources.scratch import Scratch

HASHES = 64
#: Items of one round: with 64 minima of 4 bytes and about 100 shingles of 8 bytes each, some 20 MB.
ROUND = 20_000
#: Characters of the items of one round: some 5 million shingles of 8 bytes.
ROUND_CHARS = 32 << 20
SEED = 7_654_321
#: Shingles of an item up to which it is looked up without minima.
SMALL = 4


class Index:
    """The items of one round by size class: per class, sorted (hash function, minimum) keys and the items behind them; small items by their shingles."""

    def __init__(self, items: list[tuple[int, np.ndarray]]) -> None:
        minima = Minima(HASHES, SEED)
        self.sets = dict(items)
        by_class: dict[int, list[int]] = defaultdict(list)
        small: list[int] = []
        for k, s in items:
            (small if len(s) <= SMALL else by_class[1 << int(len(s) - 1).bit_length()]).append(k)
        self.small = None
        if small:
            keys = np.concatenate([self.sets[k] for k in small])
            order = np.argsort(keys, kind="stable")
            self.small = keys[order], np.repeat(np.array(small, np.int64), [len(self.sets[k]) for k in small])[order]
        self.classes = {}
        for q, ids in by_class.items():
            keys = np.concatenate([self.keys(minima.of(self.sets[k])[:, None])[:, 0] for k in ids])
            order = np.argsort(keys, kind="stable")
            self.classes[q] = keys[order], np.repeat(np.array(ids, np.int64), HASHES)[order]

    @staticmethod
    def keys(minima: np.ndarray) -> np.ndarray:
        return minima.astype(np.uint64) | np.arange(HASHES, dtype=np.uint64)[:, None] << np.uint64(32)

    @staticmethod
    def behind(keys: np.ndarray, ids: np.ndarray, probes: np.ndarray) -> Iterator[int]:
        at = np.searchsorted(keys, probes)
        at[at == len(keys)] = 0
        for p in np.unique(probes[keys[at] == probes]):
            yield from ids[np.searchsorted(keys, p) : np.searchsorted(keys, p, side="right")].tolist()

    def candidates(self, run: np.ndarray, minima: Minima) -> set[int]:
        out = set(self.behind(*self.small, run)) if self.small else set()
        for q, (keys, ids) in self.classes.items():
            blocks = minima.by_block(run, np.arange(0, len(run), q))
            windows = np.minimum(blocks[:, :-1], blocks[:, 1:]) if blocks.shape[1] > 1 else blocks
            out.update(self.behind(keys, ids, self.keys(windows).ravel()))
        return out


FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("shared", pa.int64()), ("item_shingles", pa.int64())])


def _search(index: Index, item_ids: list[int], percent: int):
    """mapInArrow: id, text -> the item sets that the text holds; item_ids: the item of each of the index's sets."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = Minima(HASHES, SEED)
        for batch in batches:
            out = []
            for doc, shingles in zip(batch.column(0).to_pylist(), shingle_runs(batch.column(1)), strict=True):
                if not len(shingles):
                    continue
                full = None
                for item in sorted(index.candidates(shingles, minima)):
                    s = index.sets[item]
                    full = np.unique(shingles) if full is None else full
                    at = np.searchsorted(full, s)
                    at[at == len(full)] = 0
                    shared = int((full[at] == s).sum())
                    if 100 * shared >= percent * len(s):
                        out.append((doc, item_ids[item], shared, len(s)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 4)], schema=FOUND)

    return run


def contained_items(spark: SparkSession, docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id, item_id, shared, item_shingles`` for every document that holds at least percent of an item's distinct shingles.

    Null and wordless texts and items match nothing; so do rows without an id.  An
    item of one to four words is one shingle, its whole sequence, and matches just
    the documents that consist of it.  Texts that share an item_id are searched
    each by itself.  Each pair is given once, with the best containment of any of its
    rows (ties: the largest overlap), repeated documents too.  Empty tables give no rows; further columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    rounds = max(1, -(-size["n"] // ROUND), -(-size["chars"] // ROUND_CHARS))
    scratch = Scratch(spark, "contained")
    found = None
    for k in range(rounds):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == k) if rounds > 1 else items
        rows = part.toArrow()
        held: dict[tuple[int, bytes], np.ndarray] = {}
        for i, s in zip(rows.column(0).to_pylist(), shingle_sets(rows.column(1)), strict=True):
            if len(s):
                held[i, s.tobytes()] = s
        sets = sorted(held.items())
        new = texts.mapInArrow(_search(Index([(k, s) for k, (_, s) in enumerate(sets)]), [i for (i, _), _ in sets], percent), "doc_id long, item_id long, shared long, item_shingles long")
        if rounds > 1:
            new = scratch.save(new, f"round-{k}")
        found = new if found is None else found.unionByName(new)
    # the best containment, of equal ones the largest overlap; shared and item_shingles are those of one set
    best = F.max(F.struct((F.col("shared") / F.col("item_shingles")).alias("share"), "shared", "item_shingles")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.shared", "best.item_shingles")


def without_leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """The documents that hold no item, row by row: null and repeated ids play no part.  Columns stay as they are."""
    rows = docs.select(row_key(docs).alias("doc_id"), "text")
    found = contained_items(spark, rows, items, percent).select("doc_id").distinct()
    return without_rows(docs, Scratch(spark, "leaks").save(found, "found"))
