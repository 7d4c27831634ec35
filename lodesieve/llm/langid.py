"""Language identification by interpolated Kneser-Ney character models.

One 4-gram model per language, from counts over every training document.  Letters
are lower-cased and every run of other characters is one space.  The models stand
in sorted arrays of 64-bit hashes with an index over their leading bits; beside a
hash are the log-probabilities that all languages give the last character after
the first three.  Models that are too large for one worker are cut into shards by the
two middle characters of a gram, which keeps all of a gram's orders but the lowest two
together; every shard is a pass that adds its part to the sums of each row.  A text goes to the language of lowest cross-entropy per
character.  It is rejected if that is higher than nearly all of the language's own
training documents of similar length have (mean plus Z deviations, the deviation
of a text of n characters being sqrt(a + b / n) with a and b fitted by groups of
lengths).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesieve.llm.memory import tidy
from lodesieve.llm.words import mix
from lodesieve.sources.scratch import Scratch

ORDER = 4
CHUNK = 250_000
#: Deviations above a language's mean at which a text is rejected.
Z = 8.0
#: Log-probabilities (grams times languages) that go to the executors at once, 4 bytes each; larger models take several passes.
CELLS = 60_000_000
UNKNOWN = "und"
U = np.uint64
PAIR = (1 << 32) - 1
TRIPLE = (1 << 48) - 1


def _letters() -> np.ndarray:
    """For every code point below 2^16: itself if a letter, else 0.  Others share the private area."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(1 << 16)], np.uint16)


class Grams:
    """Packed 4-grams of whole texts: 16 bits a character, the last one lowest."""

    def __init__(self) -> None:
        self.table = _letters()

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Grams of all texts in a row, and how many each text has; texts without letters have none."""
        lower = [t.lower() for t in texts]
        sizes = np.array([len(t) for t in lower], np.int64)
        points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return np.empty(0, U), np.zeros(len(texts), np.int64)
        wide = points > 0xFFFF
        letters = self.table[np.where(wide, 0, points)]
        if wide.any():
            at = np.flatnonzero(wide)
            keep = np.array([chr(c).isalpha() for c in points[at]])
            letters[at[keep]] = 0xE000 + points[at[keep]] % 6400
        is_letter = letters > 0
        begins = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        after = np.empty(len(points), bool)
        after[0] = False
        after[1:] = is_letter[:-1]
        after[begins[sizes > 0]] = False
        kept = is_letter | after
        text_of = np.repeat(np.arange(len(texts)), sizes)[kept]
        symbols = np.where(is_letter, letters, 32)[kept].astype(U)
        grams = symbols.copy()
        for k in range(1, ORDER):
            before = np.full(len(symbols), U(32))
            same = np.zeros(len(symbols), bool)
            same[k:] = text_of[k:] == text_of[:-k]
            before[same] = symbols[:-k][same[k:]] if k < len(symbols) else before[same]
            grams |= before << U(16 * k)
        return grams, np.bincount(text_of, minlength=len(texts))


def _pieces(texts: list[str | None]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        t = t or ""
        if held and size + len(t) > CHUNK:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


@tidy
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: lang, text -> lang, gram, n; summed over what a task has seen since it last gave rows back."""
    grams = Grams()
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

    def given() -> Iterator[pa.RecordBatch]:
        for lang in sorted(held):
            keys, n = merged(held[lang])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            for part in _pieces([t for t, x in zip(texts, langs, strict=True) if x == lang and t]):
                g, _ = grams.of(part)
                if len(g):
                    parts = held.setdefault(lang, [])
                    parts.append(np.unique(g, return_counts=True))
                    if len(parts) > 8:
                        held[lang] = [merged(parts)]
        if sum(len(p[0]) for x in held.values() for p in x) > 4_000_000:
            yield from given()
    yield from given()


def _group(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the sum of their values, how many each had."""
    distinct, at, sizes = np.unique(keys, return_inverse=True, return_counts=True)
    return distinct, np.bincount(at, values), sizes


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def _discount(values: np.ndarray) -> float:
    return _share(int((values == 1).sum()), int((values == 2).sum()))


def _share(n1: int, n2: int) -> float:
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5


def _shorter(keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k - 1 last characters of grams of k, each counted once for every character seen before it."""
    keys, _, sizes = _group(keys & U((1 << 16 * (k - 1)) - 1), np.ones(len(keys)))
    return keys, sizes.astype(float)


class KneserNey:
    """One language: counts of 4-grams and, below, of the different characters before a shorter gram.

    A shard has the 4-grams of some middle pairs; ``pairs`` (all pairs of the language with
    their counts) and ``discounts`` (those of orders 4 and 3) then come from the whole language.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray] | None = None, discounts: tuple[float, float] | None = None) -> None:
        order = np.argsort(grams)
        four = grams[order], counts[order].astype(float)
        three = _shorter(four[0], 4)
        two = _shorter(three[0], 3) if pairs is None else pairs
        one = _shorter(two[0], 2)
        self.orders = []
        for k, (keys, values) in enumerate((four, three, two, one)):
            discount = discounts[k] if discounts and k < 2 else _discount(values)
            self.orders.append((keys, values, discount, *_group(keys >> U(16), values)))
        self.characters = len(one[0]) + 1

    def log_p(self, grams: np.ndarray) -> np.ndarray:
        """Log-probability of each gram's last character after the ones before it."""
        p = np.full(len(grams), 1.0 / self.characters)
        for k, (keys, values, discount, contexts, totals, kinds) in zip(range(1, ORDER + 1), reversed(self.orders), strict=True):
            if not len(keys):
                continue
            wanted = grams & U((1 << 16 * k) - 1) if k < 4 else grams
            at, seen = _found(keys, wanted)
            c, known = _found(contexts, wanted >> U(16))
            own = np.where(seen, np.maximum(values[at] - discount, 0), 0)
            p = np.where(known, (own + discount * kinds[c] * p) / totals[c], p)
        return np.log(p)


class Models:
    """All languages over the union of their 4-grams, in sorted hash arrays; ``part`` of ``parts`` shards."""

    BITS = 18

    def __init__(self, models: dict[str, KneserNey], part: int = 0, parts: int = 1) -> None:
        self.models, self.part, self.parts = models, part, parts
        self.langs = sorted(models)
        grams = np.unique(np.concatenate([m.orders[0][0] for m in models.values()]))
        hashes = mix(grams)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.log_p = np.stack([models[x].log_p(grams[order]) for x in self.langs], axis=1).astype(np.float32)
        self.index = np.searchsorted(self.hashes, np.arange(1 << self.BITS, dtype=U) << U(64 - self.BITS)).astype(np.int64)
        self.longest = int(np.diff(np.append(self.index, len(self.hashes))).max())

    def logs(self, grams: np.ndarray) -> np.ndarray:
        """A row per gram and a column per language."""
        if not len(self.hashes):
            return self._unseen(grams)
        hashes = mix(grams)
        at = self.index[(hashes >> U(64 - self.BITS)).astype(np.int64)]
        last = len(self.hashes) - 1
        at = np.minimum(at, last)
        for _ in range(self.longest):
            low = self.hashes[at] < hashes
            if not low.any():
                break
            at = np.minimum(at + low, last)
        logs = self.log_p[at]
        missing = np.flatnonzero(self.hashes[at] != hashes)
        if len(missing):
            logs[missing] = self._unseen(grams[missing])
        return logs

    def _unseen(self, grams: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(grams, return_inverse=True)
        return np.stack([self.models[x].log_p(distinct) for x in self.langs], axis=1).astype(np.float32)[back]

    def sums(self, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sums over the grams of this shard: a row per text and a column per language."""
        out = np.zeros((len(sizes), len(self.langs)))
        if self.parts > 1:
            mine = (grams >> U(16) & U(PAIR)) % U(self.parts) == U(self.part)
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[mine], minlength=len(sizes))
            grams = grams[mine]
        some = np.flatnonzero(sizes)
        if len(some):
            begins = np.concatenate(([0], np.cumsum(sizes[some])))[:-1]
            out[some] = np.add.reduceat(self.logs(grams), begins, axis=0, dtype=np.float64)
        return out

    def cross_entropies(self, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """In nats a character, of a whole model; for texts with at least one gram."""
        return -self.sums(grams, sizes) / sizes[:, None]


ROWS = [("doc_id", pa.int64()), ("lang", pa.string()), ("text", pa.string()), ("n", pa.int64()), ("sums", pa.list_(pa.float64()))]


def _scored(models: Models, last: bool):
    """mapInArrow on the columns of ROWS: n (grams) and sums (log-probabilities by language) with this shard's part added; the last pass drops the text."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            sizes, rows, at = [], [], 0
            before = batch.column("sums").to_pylist()
            for part in _pieces(batch.column("text").to_pylist()):
                g, n = grams.of(part)
                added = models.sums(g, n)
                if before[at] is not None:
                    added += np.array(before[at : at + len(part)])
                rows += added.tolist()
                at += len(part)
                sizes += n.tolist()
            columns = {**{c: batch.column(c) for c in ("doc_id", "lang", "text")}, "n": pa.array(sizes, pa.int64()), "sums": pa.array(rows, pa.list_(pa.float64()))}
            names = [c for c, _ in ROWS if not (last and c == "text")]
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return run


class Identifier:
    """What was learned: counts of all grams, in a table, and what every shard needs of the whole."""

    def __init__(self, counts: DataFrame, pairs: dict[str, tuple[np.ndarray, np.ndarray]], discounts: dict[str, tuple[float, float]], parts: int) -> None:
        self.counts, self.pairs, self.discounts, self.parts = counts, pairs, discounts, parts
        self.langs = sorted(pairs)

    def models(self, part: int) -> Models:
        """One shard, of about CELLS log-probabilities."""
        mine = self.counts.where((F.shiftrightunsigned("gram", 16).bitwiseAND(F.lit(PAIR)) % self.parts) == part) if self.parts > 1 else self.counts
        rows = mine.select("lang", "gram", "n").toArrow()
        langs = rows.column("lang").combine_chunks().dictionary_encode() if rows.num_rows else None
        names = langs.dictionary.to_pylist() if langs is not None else []
        grams, n = rows.column("gram").to_numpy().astype(np.int64).view(U), rows.column("n").to_numpy()
        code = langs.indices.to_numpy() if langs is not None else np.empty(0, np.int32)
        made = {}
        for lang in self.langs:
            own = code == names.index(lang) if lang in names else np.zeros(len(code), bool)
            made[lang] = KneserNey(grams[own], n[own], self.pairs[lang], self.discounts[lang])
        return Models(made, part, self.parts)


def _counts(train: DataFrame) -> DataFrame:
    return train.select("lang", "text").mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(spark: SparkSession, train: DataFrame) -> Identifier | None:
    """What the rows of ``lang, text`` teach; rows with a null are left out, and without any there is nothing (None).

    Counts come from all rows and stay in a table.  The driver holds one shard at a
    time, and beside it the pairs of characters of each language, of which any script has some millions at most.
    """
    scratch = Scratch(spark, "languages")
    train = train.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    counts = scratch.save(_counts(train), "counts")
    shorter = lambda rows, mask: rows.groupBy("lang", F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.count("*").alias("n"))
    threes = scratch.save(shorter(counts, TRIPLE), "threes")
    few = [F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2)]
    discounts: dict[str, list[float]] = {}
    for table in (counts, threes):
        for r in table.groupBy("lang").agg(*few).collect():
            discounts.setdefault(r["lang"], []).append(_share(r["n1"], r["n2"]))
    rows = shorter(threes, PAIR).orderBy("lang", "gram").toArrow()
    langs, keys, n = rows.column("lang").to_pylist(), rows.column("gram").to_numpy().astype(np.int64).view(U), rows.column("n").to_numpy().astype(float)
    pairs = {}
    for lang in discounts:
        own = np.array([x == lang for x in langs])
        order = np.argsort(keys[own])
        pairs[lang] = keys[own][order], n[own][order]
    if not pairs:
        return None
    cells = counts.select("gram").distinct().count() * len(pairs)
    parts = -(-cells // CELLS)
    return Identifier(counts, pairs, {k: (v[0], v[1]) for k, v in discounts.items()}, parts + (parts > 1 and parts % 2 == 0))


def _sums(docs: DataFrame, identifier: Identifier, scratch: Scratch) -> DataFrame:
    """doc_id, lang, n and sums of every row; rows are never joined, so nulls and repeats stay rows of their own."""
    rows = docs.select("doc_id", "lang", "text", F.lit(None).cast("long").alias("n"), F.lit(None).cast("array<double>").alias("sums"))
    for part in range(identifier.parts):
        last = part == identifier.parts - 1
        rows = scratch.save(rows.mapInArrow(_scored(identifier.models(part), last), "doc_id long, lang string, " + "text string, " * (not last) + "n long, sums array<double>"), f"pass-{part}")
        if part:
            scratch.drop(f"pass-{part - 1}")
    return rows


def identified(spark: SparkSession, docs: DataFrame, is_training: Column, identifier: Identifier | None = None) -> DataFrame:
    """``doc_id, lang_pred, score, xent, accepted`` for every row of ``doc_id, text, lang``.

    Learns from the rows where ``is_training`` (a column expression) holds and
    neither lang nor text is null; limits for rejection come from the same rows.
    Null texts and texts without a letter are ``und`` with score 0, not accepted;
    so is everything if there is nothing to learn from.  Ties go to the language
    that sorts first.  Repeated rows and null ids are scored each; an empty table gives no
    rows; further columns are ignored.  Very long texts are scored whole, in pieces of texts, not of a text.
    """
    scratch = Scratch(spark, "identified")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.when(F.coalesce(is_training, F.lit(False)), F.col("lang").cast("string")).alias("lang"))
    identifier = identifier or learn(spark, docs)
    if identifier is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("xent"), F.lit(False).alias("accepted"))
    names = F.array(*[F.lit(x) for x in identifier.langs])
    best = _sums(docs, identifier, scratch).withColumn("xents", F.when(F.col("n") > 0, F.transform("sums", lambda x: -x / F.col("n"))))
    best = best.withColumn("xent", F.array_min("xents")).withColumn("lang_pred", F.when(F.col("n") > 0, F.element_at(names, F.array_position("xents", F.col("xent")).cast("int"))))
    mass = F.aggregate("xents", F.lit(0.0), lambda a, x: a + F.exp(-8 * F.least(F.lit(80.0), x - F.col("xent"))))
    best = best.select("doc_id", "lang", "n", "xent", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce(1 / mass, F.lit(0.0)).alias("score"))
    groups = best.where("lang = lang_pred and n > 0").groupBy("lang", F.floor(F.log2("n")).alias("size")).agg(F.count("*").alias("k"), F.avg("xent").alias("m"), F.var_pop("xent").alias("v"), F.avg(1 / F.col("n")).alias("inverse")).collect()
    limits = {}
    for lang in {r["lang"] for r in groups}:
        rows = [r for r in groups if r["lang"] == lang]
        k, m, v, x = (np.array([r[c] for r in rows], float) for c in ("k", "m", "v", "inverse"))
        mean = float((k * m).sum() / k.sum())
        spread = v + (m - mean) ** 2
        # least squares of spread on 1 / n, both parts kept above 0
        slope = float((k * x * spread).sum() / max((k * x * x).sum(), 1e-12))
        limits[lang] = mean, max(float((k * spread).sum() / k.sum()), 1e-3), max(slope, 1e-3)
    allowed = F.lit(None).cast("double")
    for lang, (mean, a, b) in sorted(limits.items()):
        allowed = F.when(F.col("lang_pred") == lang, F.lit(mean) + Z * F.sqrt(F.lit(a) + F.lit(b) / F.col("n"))).otherwise(allowed)
    return best.select("doc_id", "lang_pred", "score", "xent", F.coalesce((F.col("xent") <= allowed) & (F.col("lang_pred") != UNKNOWN), F.lit(False)).alias("accepted"))
