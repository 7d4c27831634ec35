"""Near-duplicate documents: minima of universal hashes, banding, verification, components.

Two documents are linked if the Jaccard similarity of their sets of distinct
five-word shingles reaches a threshold, tested in whole numbers on the full sets.

1. One pass over the texts keeps, per document, the size of its set, two 64-bit
   sums that identify the set, and ``bands * rows`` hash minima.
2. Documents with equal sets form a class; the smallest id stands for it.
3. Every band of a representative's minima names a bucket.  Each bucket's largest
   class is compared with the other members: one pair per member, never all pairs.
   Pairs pass a size bound, an estimate from the minima and the exact test.
4. Buckets of more than a tile whose members are still in several components get
   another member to be compared with all that aren't in its component, up to STARS
   times, each as dear as the bucket is long.
5. Buckets whose members are still in several components are compared in full,
   in square tiles of about TILE by TILE members, fewer where their sets are large,
   inside one task.  A tile gives back links that join components, not pairs.
6. Components come from alternating large-star and small-star.

With 26 bands of 5 rows a pair at 0.85 shares no bucket with probability 2.4e-7;
at 0.80 with 34 bands, 1.4e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesieve.llm.components import components
from lodesieve.llm.memory import tidy
from lodesieve.llm.rows import row_key, without_rows
from lodesieve.llm.skew import join_one
from lodesieve.llm.words import Minima, mix, shingle_sets
from lodesieve.sources.scratch import Scratch

#: Members on a side of a tile, and shingles of their sets (8 bytes each).
TILE = 1024
TILE_SHINGLES = 8 << 20
#: Further members that a large bucket is compared with before it is cut into tiles.
STARS = 3
SEED = 20240229
U = np.uint64


def _described(bands: int, rows: int):
    """mapInArrow: id, text -> id, set size, two sums over the set, minima as bytes."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = Minima(bands * rows, SEED)
        for batch in batches:
            size, one, two, signed = [], [], [], []
            for s in shingle_sets(batch.column(1)):
                size.append(len(s))
                one.append(_sum(s))
                two.append(_sum(mix(s ^ U(0xA5A5A5A5DEADBEEF))))
                signed.append(minima.of(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(signed, pa.binary())], ["doc", "n", "d1", "d2", "minima"])

    return run


def _sum(s: np.ndarray) -> int:
    return int(s.sum(dtype=U).astype(np.int64))


@tidy
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: id, text -> id, sum over the shingle set, the set as bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            sets = list(shingle_sets(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(_sum, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc", "d1", "shingles"])


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _close(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    low, high = sorted((len(a), len(b)))
    if low == 0 or 100 * low < percent * high:
        return False
    both = _shared(a, b)
    return 100 * both >= percent * (low + high - both)


def _lowest_estimate(percent: int, count: int) -> int:
    """Equal minima that a pair at the threshold falls short of once in about 10^9 cases (six standard deviations)."""
    p = percent / 100
    return int(np.floor(count * p - 6 * np.sqrt(count * p * (1 - p))))


def _estimated(least: int):
    """mapInArrow on u, v, two signatures: the pairs with at least so many equal minima."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [int((np.frombuffer(a, np.uint32) == np.frombuffer(b, np.uint32)).sum()) >= least for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(percent: int):
    """mapInArrow on u, v, two sets: the pairs whose sets are close."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_close(np.frombuffer(a, U), np.frombuffer(b, U), percent) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows come sorted by tile; one list for each tile."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (held[0]["bucket"], held[0]["i"], held[0]["j"]) != (row["bucket"], row["i"], row["j"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _sides(tile: list[dict]) -> tuple[list[dict], list[dict], bool]:
    i, j = tile[0]["i"], tile[0]["j"]
    return [r for r in tile if r["own"] == i], [r for r in tile if r["own"] == j], i == j


def _possible(least: int, percent: int):
    """mapInArrow on tiles with signatures: the members that have a possible partner in another component."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for tile in _tiles(batches):
            left, right, same = _sides(tile)
            if left and right:
                b = np.stack([np.frombuffer(r["minima"], np.uint32) for r in right])
                bn, bc = np.array([r["n"] for r in right]), np.array([r["component"] for r in right])
                with_left, with_right = np.zeros(len(left), bool), np.zeros(len(right), bool)
                for k, r in enumerate(left):
                    near = (bc != r["component"]) & (100 * np.minimum(bn, r["n"]) >= percent * np.maximum(bn, r["n"]))
                    if near.any():
                        near &= (b == np.frombuffer(r["minima"], np.uint32)).sum(axis=1) >= least
                        with_left[k] = near.any()
                        with_right |= near
                rows = [r for r, y in zip(left, with_left | with_right if same else with_left, strict=True) if y]
                rows += [] if same else [r for r, y in zip(right, with_right, strict=True) if y]
                out += [{k: r[k] for k in ("bucket", "i", "j", "own", "doc", "component")} for r in rows]
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, schema=POSSIBLE)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=POSSIBLE)

    return run


POSSIBLE = pa.schema([("bucket", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("own", pa.int32()), ("doc", pa.int64()), ("component", pa.int64())])


def _joined(percent: int):
    """mapInArrow on tiles with sets: links that join two components of a tile, each tested on the full sets."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(batches):
            left, right, same = _sides(tile)
            root = {r["component"]: r["component"] for r in tile}

            def find(x: int, root: dict[int, int] = root) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            sets = {r["doc"]: np.frombuffer(r["shingles"], U) for r in tile}
            links = []
            for k, a in enumerate(left):
                for b in right[k + 1 :] if same else right:
                    p, q = find(a["component"]), find(b["component"])
                    if p != q and _close(sets[a["doc"]], sets[b["doc"]], percent):
                        root[p] = q
                        links.append((a["doc"], b["doc"]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["u", "v"])

    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, bands: int = 26, rows: int = 5) -> DataFrame:
    """One row per id: ``doc_id, n_shingles, component_id, kept``.

    Links hold where 100 * |A and B| >= percent * |A or B|.  Null and wordless
    texts have empty sets and link with nothing; rows without an id are left out;
    of rows that repeat an id, the one with the largest set counts (ties: the
    larger sums).  An empty table gives no rows.  Columns other than
    the two named are ignored, whatever their names.
    """
    scratch = Scratch(spark, "near-duplicates")
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null")
    described = scratch.save(source.mapInArrow(_described(bands, rows), "doc long, n long, d1 long, d2 long, minima binary"), "described")
    key = ["n", "d1", "d2"]
    repeated = bool(described.groupBy("doc").count().where("count > 1").head(1))
    if repeated:
        described = scratch.save(described.groupBy("doc").agg(F.max(F.struct(*key, "minima")).alias("r")).select("doc", "r.*"), "described-once")
    classes = scratch.save(described.where("n > 0").groupBy(*key).agg(F.min("doc").alias("class"), F.count("*").alias("copies")), "classes")
    signed = scratch.save(described.join(classes.select(F.col("class").alias("doc"), "copies"), "doc").select("doc", "n", "copies", "minima"), "signed")

    width = 4 * rows
    banded = signed.select("doc", "n", "copies", F.explode(F.expr(f"transform(sequence(0, {bands - 1}), b -> xxhash64(b, substring(minima, b * {width} + 1, {width})))")).alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("members"), F.max(F.struct("copies", (-F.col("doc")).alias("neg"), "n")).alias("rep"))
    buckets = scratch.save(buckets.where("members > 1").select("bucket", "members", (-F.col("rep.neg")).alias("rep"), F.col("rep.n").alias("rep_n")), "buckets")
    members = scratch.save(banded.join(buckets, "bucket").select("bucket", "members", "doc", "n", "rep", "rep_n"), "members")

    least = _lowest_estimate(percent, bands * rows)
    minima = signed.select("doc", "minima")
    sets = _sets_of(scratch, source, members.select("doc").distinct(), described if repeated else None)
    pairs = members.where(f"doc <> rep and 100 * least(n, rep_n) >= {percent} * greatest(n, rep_n)").select(F.col("doc").alias("u"), F.col("rep").alias("v")).distinct()
    pairs = _with(pairs, minima, "minima").mapInArrow(_estimated(least), "u long, v long")
    links = scratch.save(_with(pairs, sets, "shingles").mapInArrow(_verified(percent), "u long, v long"), "star-links")
    found = scratch.save(components(links, scratch, "stars"), "found")

    for k in range(STARS):
        again = _star_pairs(scratch, members, found, k)
        if again is None:
            break
        new = _with(again, minima, "minima").mapInArrow(_estimated(least), "u long, v long")
        new = scratch.save(_with(new, sets, "shingles").mapInArrow(_verified(percent), "u long, v long"), f"star-links-{k}")
        if not new.head(1):
            break
        links = links.unionByName(new)
        found = scratch.save(components(links, scratch, f"stars-{k}"), f"found-{k}")

    more = _rest(scratch, members, found, minima, sets, least, percent)
    whole = scratch.save(components(links.unionByName(more), scratch, "all"), "whole") if more.head(1) else found
    labels = scratch.save(classes.join(whole.withColumnRenamed("node", "class"), "class", "left").select(*key, F.coalesce("component", "class").alias("component_id")), "labels")
    return described.select("doc", *key).join(labels, key, "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _sets_of(scratch: Scratch, source: DataFrame, wanted: DataFrame, chosen: DataFrame | None) -> DataFrame:
    """The full shingle sets of the wanted documents, from their texts; chosen: which of the texts of a repeated id counts."""
    wanted = scratch.save(wanted, "wanted")
    sets = source.join(wanted, "doc", "left_semi").mapInArrow(_sets, "doc long, d1 long, shingles binary")
    if chosen is not None:
        sets = sets.join(chosen.select("doc", "d1"), ["doc", "d1"], "left_semi").dropDuplicates(["doc"])
    return scratch.save(sets.select("doc", "shingles"), "sets")


def _with(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Pairs u, v with the value of either end."""
    one = values.select(F.col("doc").alias("u"), F.col(name).alias("a"))
    two = values.select(F.col("doc").alias("v"), F.col(name).alias("b"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "a", "b")


def _placed(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets with their components."""
    return members.select("bucket", "members", "doc", "n").join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))


def _star_pairs(scratch: Scratch, members: DataFrame, found: DataFrame, k: int) -> DataFrame | None:
    """For large buckets in several components: every member against one that the round's hash picks, unless they are joined already.  None: no such bucket."""
    placed = _placed(members.where(F.col("members") > TILE), found)
    picked = placed.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min_by(F.struct("doc", "n", "component"), F.xxhash64(F.lit(k), "doc")).alias("star"))
    picked = scratch.save(picked.where("c0 <> c1").select("bucket", "star"), f"picked-{k}")
    if not picked.head(1):
        return None
    pairs = join_one(placed, picked, ["bucket"]).where("component <> star.component")
    return scratch.save(pairs.select(F.col("doc").alias("u"), F.col("star.doc").alias("v")).distinct(), f"star-pairs-{k}")


def _rest(scratch: Scratch, members: DataFrame, found: DataFrame, minima: DataFrame, sets: DataFrame, least: int, percent: int) -> DataFrame:
    """Links between components that share a bucket."""
    placed = scratch.save(_placed(members, found), "placed")
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.max("members").alias("members"), F.sum("n").alias("shingles"), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("content"))
    # buckets of several bands with the same members are one
    open_ = open_.where("c0 <> c1").groupBy("members", "content").agg(F.min("bucket").alias("bucket"), F.max("shingles").alias("shingles"))
    open_ = open_.select("bucket", F.greatest(F.ceil(F.col("members") / TILE), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int").alias("blocks"))
    open_ = scratch.save(open_, "open")
    tiles = placed.select("bucket", "doc", "n", "component").join(open_, "bucket").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    tiles = tiles.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc", "n", "component")
    tiles = tiles.join(minima, "doc").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    possible = tiles.mapInArrow(_possible(least, percent), "bucket long, i int, j int, own int, doc long, component long")
    possible = scratch.save(possible, "possible")
    tiles = possible.join(sets, "doc").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return scratch.save(tiles.mapInArrow(_joined(percent), "u long, v long"), "tile-links")


def keep_one(spark: SparkSession, docs: DataFrame, percent: int = 85, bands: int = 26) -> DataFrame:
    """The documents, less all rows but one of each group of near duplicates: the one of least doc_id (null last; ties by a hash of the row).

    Every row is judged by its own text, whatever its id; of rows that are equal in doc_id, text, lang and
    source one stays.  Rows without words stay all.  Columns stay as they are.
    """
    scratch = Scratch(spark, "near-duplicates-gone")
    keyed = docs.select(row_key(docs).alias("key"), F.col("doc_id").cast("long").alias("id"), "text")
    found = near_duplicates(spark, keyed, "key", percent=percent, bands=bands)
    rows = scratch.save(keyed.select("key", "id").join(found.where("n_shingles > 0").select(F.col("doc_id").alias("key"), "component_id"), "key"), "members")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "key")
    first = rows.groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.key").alias("key"))
    gone = scratch.save(rows.select("key").distinct().join(first, "key", "left_anti").select(F.col("key").alias("doc_id")), "gone")
    left = without_rows(docs, gone)
    repeated = scratch.save(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("_row")), "repeated")
    if repeated.head(1):
        left = left.withColumn("_row", row_key(docs))
        left = left.join(repeated, "_row", "left_anti").unionByName(left.join(repeated, "_row", "left_semi").dropDuplicates(["_row"]))
    return left.select(docs.columns)
