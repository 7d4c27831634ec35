"""Near-duplicate vectors: products of int8 tiles with an error bound, full precision where the bound leaves it open.

A vector of length 1 is stored as x = s q + e with whole numbers q of at most 127, its
scale s and the norm of its error e.  For two vectors |x.y - s t (q.r)| is at most
|e| (1 + |f|) + |f|, so a tile product of the whole numbers, which is exact in
single-precision arithmetic, settles all pairs but those within the bound of the
threshold; these are computed again in double precision.  Tiles travel as whole numbers
only; a tile product leaves the pairs that it can't settle as a bit matrix, and the
vectors of those alone follow in double precision.

Vectors are sorted by their nearest of a fixed set of directions and cut into tiles.
Every tile has a centre and a radius; two tiles whose centres are further apart than
their radii and the threshold's angle hold no link and are never multiplied.  A tile
product gives back counts by vector and links that join components, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesieve.llm.components import components
from lodesieve.llm.memory import tidy
from lodesieve.sources.scratch import Scratch

#: Vectors of one tile, a multiple of 8.
TILE = 2048
#: Rows of a tile that are multiplied at once.
STRIP = 512
#: Directions by which vectors are dealt to tiles.
DIRECTIONS = 64
SEED = 97


def _directions(size: int) -> np.ndarray:
    d = np.random.default_rng(SEED).standard_normal((DIRECTIONS, size))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


@tidy
def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: id, vector -> id, size (0: links with nothing), unit vector in double precision, and a sort key."""
    directions: dict[int, np.ndarray] = {}
    for batch in batches:
        sizes, unit, keys = [], [], []
        for v in batch.column(1).to_pylist():
            x = np.array(v, np.float64) if v and None not in v else np.empty(0)
            top = float(np.abs(x).max()) if len(x) else 0.0
            if not len(x) or not math.isfinite(top) or top == 0 or np.isnan(x).any():
                sizes.append(0)
                unit.append(None)
                keys.append(None)
                continue
            x = x / top  # so that squares neither overflow nor vanish
            x = x / math.sqrt(float((x * x).sum()))
            if len(x) not in directions:
                directions[len(x)] = _directions(len(x))
            near = directions[len(x)] @ x
            best = int(near.argmax())
            sizes.append(len(x))
            unit.append(x.tobytes())
            keys.append(best + 0.5 - 0.49 * float(near[best]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(unit, pa.binary()), pa.array(keys, pa.float64())], ["vec", "size", "unit", "place"])


TILES = "tile long, n int, size long, ids binary, whole binary, scale binary, error binary, unit binary, centre binary, angle double"
FOUND = "vec long, links long, v long, i long, j long, side int, tile long, bits binary"


@tidy
def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow on rows sorted by size and place: one row per tile, numbered within the task."""
    held: list[dict] = []
    number = 0

    def tile() -> pa.RecordBatch:
        nonlocal number
        size = held[0]["size"]
        x = np.frombuffer(b"".join(r["unit"] for r in held), np.float64).reshape(-1, size)
        scale = np.abs(x).max(axis=1) / 127
        whole = np.rint(x / scale[:, None]).astype(np.int8)
        error = np.linalg.norm(x - whole * scale[:, None], axis=1) + 1e-12
        centre = x.sum(axis=0)
        norm = np.linalg.norm(centre)
        centre = centre / norm if norm > 1e-9 else x[0]
        angle = float(np.arccos(np.clip((x @ centre).min(), -1, 1))) + 1e-6
        row = {"tile": number, "n": len(held), "size": size, "ids": np.array([r["vec"] for r in held], np.int64).tobytes(), "whole": whole.tobytes(), "scale": scale.tobytes(), "error": error.tobytes(), "unit": x.tobytes(), "centre": centre.tobytes(), "angle": angle}
        number += 1
        return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

    for batch in batches:
        for r in batch.to_pylist():
            if held and (len(held) == TILE or held[0]["size"] != r["size"]):
                yield tile()
                held = []
            held.append(r)
    if held:
        yield tile()


_SCHEMA = pa.schema([("tile", pa.int64()), ("n", pa.int32()), ("size", pa.int64()), *[(c, pa.binary()) for c in ("ids", "whole", "scale", "error", "unit", "centre")], ("angle", pa.float64())])
OUT = pa.schema([("vec", pa.int64()), ("links", pa.int64()), ("v", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("side", pa.int32()), ("tile", pa.int64()), ("bits", pa.binary())])


def _read(t: dict, name: str, kind: type) -> np.ndarray:
    x = np.frombuffer(t[name], kind)
    return x.reshape(-1, t["size"]) if name in ("whole", "unit") else x


def _results(ids_a: np.ndarray, ids_b: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool) -> pa.RecordBatch:
    """Rows (vec, links) of counts and rows (vec, 0, v) of links that join, of settled pairs."""
    ids = np.concatenate((ids_a, ids_b))
    links = np.bincount(np.concatenate((left, right + len(ids_a))), minlength=len(ids))
    u, v = _forest(left, right if same else right + len(ids_a), len(ids))
    some = np.flatnonzero(links)
    n = len(some) + len(u)
    none = pa.nulls(n, pa.int64())
    ends = pa.array(np.concatenate((np.zeros(len(some), np.int64), ids[v])), mask=np.arange(n) < len(some))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate((ids[some], ids[u]))), pa.array(np.concatenate((links[some], np.zeros(len(u), np.int64)))), ends, none, none, pa.nulls(n, pa.int32()), none, pa.nulls(n, pa.binary())], schema=OUT)


def _multiplied(threshold: float):
    """mapInArrow on pairs of tiles: results of the settled pairs, and what is open.

    Open are, for a pair (i, j) of tiles: a row (side 2) with the bit matrix of the open pairs among the vectors
    that have any, and a row for either tile (sides 0 and 1) with the bits of those vectors.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                a, b = row["a"], row["b"]
                same = row["i"] == row["j"]
                size = a["size"]
                qa, qb = _read(a, "whole", np.int8), _read(b, "whole", np.int8).astype(np.float32)
                sa, sb, ea, eb = _read(a, "scale", np.float64), _read(b, "scale", np.float64), _read(a, "error", np.float64), _read(b, "error", np.float64)
                open_ = np.zeros((len(sa), len(sb)), bool)
                left, right = [], []
                for k in range(0, len(sa), STRIP):
                    strip = slice(k, k + STRIP)
                    near = (qa[strip].astype(np.float32) @ qb.T).astype(np.float64) * sa[strip, None] * sb[None, :]  # exact while 127 * 127 * size < 2^24
                    slack = ea[strip, None] * (1 + eb[None, :]) + eb[None, :] + 1e-9 + (0 if size <= 1000 else size * 1e-6)
                    x, y = np.nonzero(near + slack >= threshold)
                    if same:
                        upper = x + k < y
                        x, y = x[upper], y[upper]
                    sure = near[x, y] - slack[x, y] >= threshold
                    left.append(x[sure] + k)
                    right.append(y[sure])
                    open_[x[~sure] + k, y[~sure]] = True
                left, right = np.concatenate(left), np.concatenate(right)
                if len(left):
                    yield _results(_read(a, "ids", np.int64), _read(b, "ids", np.int64), left, right, same)
                rows, columns = open_.any(axis=1), open_.any(axis=0)
                if rows.any():
                    left_out = {"vec": None, "links": None, "v": None, "i": row["i"], "j": row["j"]}
                    parts = [(0, row["i"], rows), (1, row["j"], columns), (2, None, open_[rows][:, columns])]
                    yield pa.RecordBatch.from_pylist([left_out | {"side": k, "tile": t, "bits": np.packbits(x).tobytes()} for k, t, x in parts], schema=OUT)

    return run


@tidy
def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow on i, j, side, bits and a tile's size, ids, unit: the ids and vectors whose bits are set."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            ids = _read(row, "ids", np.int64)
            some = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=len(ids)).astype(bool)
            yield pa.RecordBatch.from_pylist([{"i": row["i"], "j": row["j"], "side": row["side"], "size": row["size"], "ids": ids[some].tobytes(), "unit": _read(row, "unit", np.float64)[some].tobytes()}], schema=SLICED)


SLICED = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("side", pa.int32()), ("size", pa.int64()), ("ids", pa.binary()), ("unit", pa.binary())])


def _settled(threshold: float):
    """mapInArrow on bits and the vectors a and b of open pairs: results of the links among them, in double precision."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                a, b = row["a"], row["b"]
                ids_a, ids_b = _read(a, "ids", np.int64), _read(b, "ids", np.int64)
                xa, xb = _read(a, "unit", np.float64), _read(b, "unit", np.float64)
                bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=len(ids_a) * len(ids_b)).reshape(len(ids_a), -1)
                left, right = np.nonzero(bits)
                sure = np.zeros(len(left), bool)
                for k in range(0, len(left), 100_000):
                    part = slice(k, k + 100_000)
                    sure[part] = (xa[left[part]] * xb[right[part]]).sum(axis=1) >= threshold
                if sure.any():  # ends of a tile's own pairs are told apart by side, which the components join again
                    yield _results(ids_a, ids_b, left[sure], right[sure], False)

    return run


def _forest(left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the pairs (left[k], right[k]) among n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    u = np.flatnonzero(label != np.arange(n))
    return u, label[u]


def linked_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, embedding`` with an id.

    Two vectors are linked if they have the same number of components and a cosine
    of at least the threshold.  Null, empty and zero vectors and ones with null or
    non-finite components link with nothing.  Rows that repeat an id count as
    vectors of their own and are given once, with the links of all; rows without an id
    are left out.  An empty table gives no rows; further columns are ignored.
    """
    scratch = Scratch(spark, "vectors")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec is not null")
    placed = scratch.save(rows.mapInArrow(_placed, "vec long, size long, unit binary, place double"), "placed")
    good = placed.where("size > 0")
    parts = max(1, -(-good.count() // (TILE * 2)))
    tiles = good.repartitionByRange(parts, "size", "place", "vec").sortWithinPartitions("size", "place", "vec").mapInArrow(_tiled, TILES)
    tiles = scratch.save(tiles.withColumn("tile", F.col("tile") + F.spark_partition_id().cast("long") * (1 << 24)), "tiles")
    pairs = _tile_pairs(scratch, tiles, threshold)
    content = F.struct("size", "ids", "whole", "scale", "error")
    work = pairs.join(tiles.select(F.col("tile").alias("i"), content.alias("a")), "i").join(tiles.select(F.col("tile").alias("j"), content.alias("b")), "j")
    found = scratch.save(work.mapInArrow(_multiplied(threshold), FOUND), "found")
    opened = found.where("side is not null").select("i", "j", "side", "tile", "bits")
    if opened.head(1):
        vectors_of = scratch.save(opened.where("side < 2").join(tiles.select("tile", "size", "ids", "unit"), "tile").select("i", "j", "side", "size", "ids", "unit", "bits").mapInArrow(_sliced, "i long, j long, side int, size long, ids binary, unit binary"), "open-vectors")
        side = lambda k, name: vectors_of.where(F.col("side") == k).select("i", "j", F.struct("size", "ids", "unit").alias(name))
        settled = opened.where("side = 2").select("i", "j", "bits").join(side(0, "a"), ["i", "j"]).join(side(1, "b"), ["i", "j"])
        settled = scratch.save(settled.mapInArrow(_settled(threshold), FOUND), "settled")
        found = found.where("side is null").unionByName(settled)
    counts = found.where("v is null").groupBy("vec").agg(F.sum("links").alias("n_links"))
    whole = scratch.save(components(found.where("v is not null").select(F.col("vec").alias("u"), "v"), scratch), "whole").withColumnRenamed("node", "vec")
    out = placed.select("vec").distinct().join(counts, "vec", "left").join(whole, "vec", "left")
    return out.select(F.col("vec").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _near_tiles(batches: Iterator[pa.RecordBatch], theirs: list[tuple[int, int, np.ndarray, float]], reach: float) -> Iterator[pa.RecordBatch]:
    groups: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for size in {t[1] for t in theirs}:
        own = [t for t in theirs if t[1] == size]
        groups[size] = np.array([t[0] for t in own]), np.stack([t[2] for t in own]), np.array([t[3] for t in own])
    for batch in batches:
        for r in batch.to_pylist():
            if r["size"] not in groups:
                continue
            ids, centres, angles = groups[r["size"]]
            apart = np.arccos(np.clip(centres @ np.frombuffer(r["centre"], np.float64), -1, 1))
            close = ids[(apart <= angles + r["angle"] + reach) & (ids >= r["tile"])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(close), r["tile"], np.int64)), pa.array(close.astype(np.int64))], ["i", "j"])


#: Tiles whose centres are sent to the executors at once: 8 bytes a component, about 5 MB for vectors of 64.
CENTRES = 10_000


def _tile_pairs(scratch: Scratch, tiles: DataFrame, threshold: float) -> DataFrame:
    """Pairs i <= j of tiles that may hold a link.  Centres are sent in blocks of fixed size; a block's pairs are written before the next is read."""
    heads = scratch.save(tiles.select("tile", "size", "centre", "angle"), "heads")
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    blocks = max(1, -(-heads.count() // CENTRES))
    out = None
    for k in range(blocks):
        block = heads.where(F.pmod(F.xxhash64("tile"), F.lit(blocks)) == k) if blocks > 1 else heads
        theirs = [(r["tile"], r["size"], np.frombuffer(r["centre"], np.float64), r["angle"]) for r in block.collect()]
        pairs = scratch.save(heads.mapInArrow(lambda batches, theirs=theirs: _near_tiles(batches, theirs, reach), "i long, j long"), f"pairs-{k}")
        out = pairs if out is None else out.unionByName(pairs)
    return out
