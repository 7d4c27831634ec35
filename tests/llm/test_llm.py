"""The corpus operators against plain versions, on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodesieve.llm import bpe, chat, contamination, embedding_dedup, langid, minhash, pretokens, quality, records, skew, token_counts, toxicity
from lodesieve.llm.components import components
from lodesieve.llm.queries import tokenizer
from lodesieve.llm.words import shingle_sets
from lodesieve.sources.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, doc string, n long, label int"
VOWELS = ["ba", "ke", "lo", "mi", "nu", "ra", "se", "ti"]


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice(VOWELS) for _ in range(r.randint(1, 4))) for _ in range(n))


def odd_texts():
    base = prose(1)
    return [
        None, "", "   \n\t ", "one", "a b c d", "A B C D", "a b c d", base, base.upper(), base + " tail", base.replace("ba", "bo", 1), prose(2), prose(2),
        "word " * 40_000, prose(3, 30_000), "ÄÖ ü ß é x   y", "emoji 😀😀 text with\x00nul", "<|endoftext|> and <|startoftext|>", "\\### Assistant: </turn> ok", "12 34 5678", "!!! ???",
    ]


def table(spark, texts=None):
    """Rows with columns whose names clash with those used inside the operators."""
    texts = odd_texts() if texts is None else texts
    return spark.createDataFrame([(k, t, ("en", "fr", None)[k % 3], ("h/p/q", "https://H/p", None, "")[k % 4], 0, "x", 7, 1) for k, t in enumerate(texts)], DOCS)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked(sets, percent):
    ids, label = sorted(sets), {k: k for k in sets}
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return closed(label, links)


def closed(label, links):
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


# components


def test_components(spark, monkeypatch):
    """Among them a node with more neighbours than are joined by key (made few here)."""
    monkeypatch.setattr(skew, "HOT", 20)
    r = random.Random(5)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(500, k) for k in range(501, 560)] + [(k, k + 1) for k in range(600, 640)]
    rows = [*links, (3, 3), (None, 4), links[0]]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(rows, "u long, v long"), Scratch(spark, "t")).collect()}
    want = closed({k: k for link in links for k in link}, links)
    assert got == {k: c for k, c in want.items() if any(k in link and link[0] != link[1] for link in links)}
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


# 1 chat


def tree_rows():
    return [
        ("t", 1, None, 1.0, "user", "root <a> # \\"), ("t", 2, 1, 2.0, "assistant", "x"), ("t", 3, 1, 2.0, "assistant", "y"), ("t", 4, 3, 0.5, "user", None), ("t", 5, 2, 0.5, None, ""),
        ("u", 7, 99, None, "assistant", "</turn>\n### user\n"), ("v", 8, 9, 1.0, "user", "cycle"), ("v", 9, 8, 1.0, "user", "cycle"), (None, 10, None, 1.0, "user", "no tree"),
    ]


@pytest.mark.parametrize("per_tree", [1, 3])
def test_chat_trees(spark, per_tree):
    nodes = spark.createDataFrame([(*r, 1) for r in tree_rows()], "tree string, node long, parent long, score double, role string, text string, depth int")
    got = chat.format_trees(nodes, Scratch(spark, "t"), per_tree).collect()
    by = {r[1]: r for r in tree_rows()}
    paths = []
    for leaf in (5, 4, 7, 10):
        path = [leaf]
        while by[path[-1]][2] in by:
            path.append(by[path[-1]][2])
        paths.append((by[leaf][0], leaf, sum(by[k][3] or 0 for k in path), path[::-1]))
    want = {}
    for tree in ("t", "u", None):
        for k, p in enumerate(sorted((p for p in paths if p[0] == tree), key=lambda p: (-p[2], p[1]))[:per_tree]):
            want[p[1]] = (tree, k + 1, p[2], p[3])
    assert {r["leaf"]: (r["tree"], r["rank"], r["path_score"]) for r in got} == {k: v[:3] for k, v in want.items()}
    turns = {r["leaf"]: [(t["role"], t["text"]) for t in r["turns"]] for r in spark.createDataFrame(got).select("leaf", chat.parsed(F.col("formatted")).alias("turns")).collect()}
    assert turns == {k: [(by[n][4] or "", by[n][5] or "") for n in v[3]] for k, v in want.items()}
    for r in got:
        masked = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
        code = lambda t: t.replace("\\", "\\0").replace("#", "\\1").replace("<", "\\2")
        assert masked == [code(by[n][5] or "") for n in want[r["leaf"]][3] if by[n][4] == "assistant"]


def test_repeated_nodes_are_in_a_path_once(spark, monkeypatch):
    """And a root with many replies is joined without gathering them."""
    monkeypatch.setattr(skew, "HOT", 10)
    rows = [("t", 1, None, 1.0, "user", "a"), ("t", 2, 1, 1.0, "assistant", "b"), ("t", 3, 2, 1.0, "user", "c")]
    many = rows + rows[:2] + [("t", 2, 1, 1.0, "assistant", "z")] + [("t", k, 1, 0.5, "assistant", f"r{k}") for k in range(10, 60)] + [("w", k, 900, 0.5, "user", "lost parent") for k in range(100, 130)]
    got = {r["leaf"]: r for r in chat.format_trees(spark.createDataFrame(many, "tree string, node long, parent long, score double, role string, text string"), Scratch(spark, "t"), 1000).collect()}
    assert set(got) == {3, *range(10, 60), *range(100, 130)} and got[3]["n_turns"] == 3 and got[3]["path_score"] == 3.0 and got[10]["n_turns"] == 2 and got[100]["n_turns"] == 1
    assert got[3]["formatted"] == "### user\na\n</turn>\n### assistant\nb\n</turn>\n### user\nc\n</turn>\n"


def test_chat_threads(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t} \\ # < \n </turn>") for t in range(300)] + [(2, 0, None, None), (2, 0, None, None), (3, 5, "r\n#", "😀"), (None, 0, "user", "x")]
    scratch = Scratch(spark, "t")
    turns = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, node int, tree int")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_trees(chat.thread_nodes(spark, turns, scratch), scratch)).collect()}
    assert set(got) == {1, 2, 3, None}
    for c, r in got.items():
        own = sorted((x[1], x[2] or "", x[3] or "") for x in rows if x[0] == c)
        loss = "".join(x[2] for x in own if x[1] == "assistant")
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    empty = turns.where("false")
    scratch = Scratch(spark, "t")
    assert chat.digests(chat.format_trees(chat.thread_nodes(spark, empty, scratch), scratch)).count() == 0


# 2 toxicity


def toxic_table(spark):
    r = random.Random(9)
    rows = []
    for k in range(500):
        s = [prose(1000 + 7 * k + j, 8) for j in range(r.randint(1, 6))]
        bad = k % 5 == 0
        if bad:
            at = r.randrange(len(s))
            s[at] += " " + r.choice(["grobian", "schuft"])
        rows.append((k, ". ".join(s), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity(spark):
    docs = toxic_table(spark)
    model = toxicity.learn(spark, docs, docs.where("doc_id % 4 <> 0").select("doc_id", "toxic"))
    got = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in docs.collect()}
    assert all(got[k]["predicted"] == y for k, y in truth.items() if k % 4 == 0)
    spans = [s for r in got.values() for s in r["offending"]]
    assert spans and all("grobian" in s or "schuft" in s for s in spans)
    odd = toxicity.scored(table(spark), model).collect()
    assert len(odd) == len(odd_texts()) and all(0 <= r["score"] < 0.5 for r in odd)
    none = toxicity.learn(spark, docs, docs.where("false").select("doc_id", "toxic"))
    assert all(r["predicted"] == 0 for r in toxicity.scored(docs, none).collect())
    assert toxicity.scored(docs.where("false"), model).count() == 0


def test_toxicity_learns_what_plain_gradients_do():
    """The fitted weights are where the plain noisy-or likelihood has no slope left."""
    r = random.Random(4)
    texts, labels = [], []
    for k in range(120):
        s = [prose(3000 + 7 * k + j, 4) for j in range(r.randint(1, 4))]
        y = int(k % 3 == 0)
        if r.random() < (0.95 if y else 0.1):
            s[r.randrange(len(s))] += " grobian"
        texts.append(". ".join(s))
        labels.append(y)
    labels = np.array(labels)
    weights, bias = toxicity.fit(texts, labels, labels.mean())
    names = sorted(weights)
    known = [[{w for w in toxicity.words(x) if w in weights} for x in toxicity.sentences(t)] for t in texts]

    def loss(w, b):
        out = 0.0
        for bag, y in zip(known, labels, strict=True):
            none = np.prod([1 - 1 / (1 + np.exp(-(b + sum(w[x] for x in s)))) for s in bag])
            out -= np.log(1 - none) if y else np.log(none)
        return out / len(labels) + 0.5e-6 * sum(x * x for x in w.values())

    at = loss(weights, bias)
    for name in names:
        for step in (-0.3, 0.3):
            assert loss(weights | {name: weights[name] + step}, bias) > at - 1e-4
    if bias < -1.0:
        assert loss(weights, bias + 0.3) > at - 1e-4 and loss(weights, bias - 0.3) > at - 1e-4
    assert weights["grobian"] > 2
    model = toxicity.Model(weights, bias)
    score, bad = model.judged("lo mi. x grobian y! nu ra")
    assert bad == ["x grobian y!"] and score >= 0.5 and model.judged(None)[1] == [] == model.judged("lo")[1]


def test_contradictory_and_repeated_labels(spark):
    docs = toxic_table(spark)
    labels = docs.select("doc_id", "toxic")
    one = toxicity.learn(spark, docs, labels.where("doc_id % 4 <> 0"))
    other = labels.where("doc_id % 4 = 0").selectExpr("doc_id", "explode(array(0, 1)) as toxic").unionByName(spark.createDataFrame([(None, 1), (7, None)], "doc_id long, toxic int"))
    two = toxicity.learn(spark, docs, labels.where("doc_id % 4 <> 0").unionByName(labels.where("doc_id % 4 <> 0")).unionByName(other))
    assert one.weights == two.weights and one.bias == two.bias


# 3 language


def test_language(spark):
    sound = {"aa": "bcd", "zz": "xyw"}
    rows = []
    for k in range(200):
        r = random.Random(k)
        lang = "aa" if k % 2 else "zz"
        rows.append((k, " ".join("".join(r.choice(sound[lang]) + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 40))), lang))
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !!", None), (1003, "qqqq ññññ 你好 你好 qqqq ßßß", None), (1004, "a", None), (1005, rows[1][1] * 500, None), (1005, rows[1][1] * 500, None)]
    docs = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, lang string, xent double, n int")
    got = langid.identified(spark, docs, F.col("doc_id") % 4 != 2).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["lang_pred"] == lang and by[k]["accepted"] for k, _, lang in rows[:200])
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 and not by[k]["accepted"] for k in (1000, 1001, 1002))
    assert not by[1003]["accepted"] and by[1005]["accepted"] and by[1005]["lang_pred"] == "aa"
    assert {r["lang_pred"] for r in langid.identified(spark, docs, F.lit(False)).collect()} == {"und"}
    assert langid.identified(spark, docs.where("false"), F.lit(True)).count() == 0


def test_language_shards_and_limits(spark, monkeypatch):
    """Many passes give what one gives, for ties, nulls and repeats too; limits, rejection and score are those of a plain version."""
    sound = {"aa": "bcd", "bb": "bcd", "zz": "xyw"}
    rows = []
    for k in range(90):
        r = random.Random(k // 3 if k % 3 < 2 else k)
        lang = ("aa", "bb", "zz")[k % 3]
        rows.append((k, " ".join("".join(r.choice(sound[lang]) + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 40))), lang))
    rows += [(None, rows[0][1], "aa"), (None, None, None), (5, rows[5][1], "zz"), (5, rows[4][1], None), (6, "qqq 你好 ñ", None), (7, "12", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    key = lambda r: (r["doc_id"] if r["doc_id"] is not None else -1, r["lang_pred"], round(r["score"], 9), round(r["xent"] or -1, 9), r["accepted"])
    one = sorted(key(r) for r in langid.identified(spark, docs, F.lit(True)).collect())
    grams = langid.Grams()
    taught = {lang: grams.of([t for _, t, x in rows if x == lang and t])[0] for lang in sound}
    models = {lang: langid.KneserNey(*np.unique(g, return_counts=True)) for lang, g in taught.items()}
    scored = []
    for d, text, lang in rows:
        g, n = grams.of([text or ""])
        x = [-models[m].log_p(g).astype(np.float32).astype(float).sum() / len(g) for m in sound] if len(g) else None
        scored.append((d, lang, len(g), x, sorted(sound)[int(np.argmin(x))] if x else "und"))
    limits = {}
    for lang in sound:
        own = [(n, min(x)) for _, y, n, x, best in scored if x and y == lang == best]
        if not own:
            continue
        groups = {}
        for n, x in own:
            groups.setdefault(int(np.log2(n)), []).append((n, x))
        k, m, v, inv = (np.array(c) for c in zip(*[(len(g), np.mean([x for _, x in g]), np.var([x for _, x in g]), np.mean([1 / n for n, _ in g])) for g in groups.values()], strict=True))
        mean = (k * m).sum() / k.sum()
        spread = v + (m - mean) ** 2
        limits[lang] = mean, max((k * spread).sum() / k.sum(), 1e-3), max((k * inv * spread).sum() / (k * inv * inv).sum(), 1e-3)
    plain = []
    for d, _, n, x, best in scored:
        score = 1 / sum(np.exp(-8 * min(80.0, y - min(x))) for y in x) if x else 0.0
        fits = best in limits and min(x) <= limits[best][0] + langid.Z * np.sqrt(limits[best][1] + limits[best][2] / n)
        plain.append((-1 if d is None else d, best, score, min(x) if x else -1, bool(fits)))
    plain.sort()
    assert [r[:2] + r[4:] for r in one] == [r[:2] + r[4:] for r in plain] and np.allclose([r[2:4] for r in one], [r[2:4] for r in plain], atol=1e-5)
    assert len(one) == len(rows)
    monkeypatch.setattr(langid, "CELLS", 300)
    several = langid.learn(spark, docs)
    assert several.parts > 3
    many = sorted(key(r) for r in langid.identified(spark, docs, F.lit(True)).collect())
    assert [r[:2] + r[4:] for r in many] == [r[:2] + r[4:] for r in one] and np.allclose([r[2:4] for r in many], [r[2:4] for r in one], atol=1e-7)


def test_kneser_ney_sums_to_one_and_matches_the_definition():
    texts = ["banana bandana", "cabana ban"]
    grams, _ = langid.Grams().of(texts)
    keys, n = np.unique(grams, return_counts=True)
    model = langid.KneserNey(keys, n)
    letters = sorted({int(g) & 0xFFFF for g in grams})
    for context in {int(g) >> 16 for g in grams} | {ord("z") << 32}:
        every = np.array([context << 16 | c for c in letters], np.uint64)
        left = 1 / model.characters  # the share of the one character that was never seen
        total = np.exp(model.log_p(every)).sum()
        assert total < 1 + 1e-9 and total > 1 - left

    def plain(g):
        p = 1 / model.characters
        for k in range(1, 5):
            own = {}
            for x, c in zip(keys.tolist(), n.tolist(), strict=True):
                if k == 4:
                    own[x] = c
                else:
                    own.setdefault(x & ((1 << 16 * k) - 1), set()).add(x & ((1 << 16 * (k + 1)) - 1))
            own = {x: c if k == 4 else len(c) for x, c in own.items()}
            n1, n2 = sum(c == 1 for c in own.values()), sum(c == 2 for c in own.values())
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            g_k = g & ((1 << 16 * k) - 1)
            rest = [c for x, c in own.items() if x >> 16 == g_k >> 16]
            if rest:
                p = (max(own.get(g_k, 0) - d, 0) + d * len(rest) * p) / sum(rest)
        return p

    for g in [*keys.tolist(), ord("n") << 48 | ord("a") << 32 | ord("b") << 16 | ord("b")]:
        assert np.isclose(np.exp(model.log_p(np.array([g], np.uint64))[0]), plain(g))
    models = langid.Models({"x": model})
    x, sizes = langid.Grams().of(["banana zzz", "qq"])
    assert np.allclose(models.cross_entropies(x, sizes)[:, 0], [-np.mean([np.log(plain(int(g))) for g in part]) for part in (x[: sizes[0]], x[sizes[0] :])], atol=1e-5)


# 4 near duplicates


def near_copies(seed, n):
    """A text and copies of it with a few words changed, some of which link only by way of others."""
    r = random.Random(seed)
    base = prose(seed, 150).split()
    out = [" ".join(base)]
    for _ in range(n - 1):
        w = list(base)
        for _ in range(r.randint(1, 3)):
            w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates(spark):
    texts = odd_texts() + near_copies(50, 150) + near_copies(51, 20) + [prose(52)] * 30 + [prose(60, 12) + " " + prose(70 + k, 14) for k in range(40)]
    got = minhash.near_duplicates(spark, table(spark, texts)).collect()
    sets = {k: shingles(t) for k, t in enumerate(texts)}
    label = linked(sets, 85)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == sorted((k, len(sets[k]), label[k], label[k] == k) for k in sets)
    assert minhash.near_duplicates(spark, table(spark).where("false")).count() == 0


def test_near_duplicates_with_repeated_ids(spark):
    docs = spark.createDataFrame([(1, prose(1)), (1, prose(1)), (2, prose(1)), (3, "x"), (3, prose(4)), (None, prose(1))], "doc_id long, text string")
    got = minhash.near_duplicates(spark, docs).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 1), (3, 3)] and {r["n_shingles"] for r in got if r["doc_id"] == 3} == {len(shingles(prose(4)))}
    more = docs.unionByName(spark.createDataFrame([(9, None), (9, None), (None, prose(8)), (None, prose(8) + " end")], "doc_id long, text string"))
    left = sorted((r["doc_id"] or 0, r["text"] or "") for r in minhash.keep_one(spark, more).collect())
    assert left[1:] == sorted([(1, prose(1)), (3, "x"), (3, prose(4)), (9, ""), (9, "")]) and left[0] in {(0, prose(8)), (0, prose(8) + " end")}


def test_tiles_find_links_that_stars_miss(spark, monkeypatch):
    """A chain in which no text is close to all others, many times the size of a tile (made small here)."""
    monkeypatch.setattr(minhash, "TILE", 16)
    words = prose(80, 400).split()
    texts = [" ".join(words[4 * k : 4 * k + 160]) for k in range(50)] + [" ".join(words[4 * k : 4 * k + 160]) + " end" for k in range(50)]
    label = linked({k: shingles(t) for k, t in enumerate(texts)}, 85)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark, table(spark, texts)).collect()} == label


def test_shingle_sets_are_those_of_the_words():
    texts = odd_texts()
    sets = list(shingle_sets(pa.array(texts, pa.string())))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert (sets[7] == sets[8]).all() and (sets[4] == sets[5]).all() and len(np.intersect1d(sets[7], sets[9])) == len(shingles(texts[7]))


# 5 quality


def test_quality(spark):
    rows = []
    for k in range(400):
        bad = k % 6 == 0
        t = prose(k, 30 + k % 50)
        rows.append((k, " ".join(w + "!!" for w in t.upper().split()) if bad else t + ".", f"host{k % 3}/p{k % 2}", int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, quality int")
    labels = docs.where("doc_id % 3 = 0").select("doc_id", "quality")
    got = {r["doc_id"]: r for r in quality.judged(spark, docs, labels).collect()}
    assert all(got[k]["accepted"] == bool(q) for k, _, _, q in rows)
    odd = quality.judged(spark, table(spark), labels).collect()
    assert len(odd) == len(odd_texts()) and all(0 <= r["score"] <= 1 for r in odd) and {r["host"] for r in odd} == {"h", ""}
    assert quality.judged(spark, docs.where("false"), labels).count() == 0
    assert quality.judged(spark, docs, labels.where("false")).count() == 400


def test_quality_is_the_plain_posterior(spark):
    """Beta-binomial shares of path and host without the document itself, beside its own evidence; repeated ids and null sources too."""
    rows = [(k if k % 11 else 5, prose(k, 30 + k % 50).upper() + "!!" * (k % 2) if k % 6 == 0 else prose(k, 30) + ".", (f"h{k % 4}/p{k % 3}" if k % 13 else None), int(k % 6 != 0)) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, quality int")
    labels = docs.where("doc_id <> 5 and doc_id % 3 = 0").select("doc_id", "quality").unionByName(spark.createDataFrame([(7, 0), (7, 1), (None, 1), (8, None)], "doc_id long, quality int"))
    got = quality.judged(spark, docs, labels).collect()
    p = [1 / (1 + np.exp(-r["evidence"])) for r in got]
    sites, hosts = {}, {}
    for r, x in zip(got, p, strict=True):
        for held, k in ((sites, (r["host"], r["path"])), (hosts, r["host"])):
            n, good = held.get(k, (0, 0.0))
            held[k] = n + 1, good + x
    prior = (sum(p) + 0.5) / (len(p) + 1)

    def weight(groups):  # method of moments; (n, good, share above)
        n = np.array([g[0] for g in groups], float)
        share, above = np.array([g[1] / g[0] for g in groups]), np.array([g[2] for g in groups])
        chance = (n * above * (1 - above)).sum() / n.sum()
        excess = ((n * (share - above) ** 2).sum() - len(n) * chance) / max(1e-9, n.sum() - (n * n).sum() / n.sum())
        return min(1e6, max(1.0, chance / excess - 1)) if excess > 1e-12 else 1e6

    kh = weight([(n, g, prior) for n, g in hosts.values()])
    share = {h: (g + kh * prior) / (n + kh) for h, (n, g) in hosts.items()}
    kp = weight([(n, g, share[h]) for (h, _), (n, g) in sites.items()])
    for r, x in zip(got, p, strict=True):
        (n, g), (hn, hg) = sites[r["host"], r["path"]], hosts[r["host"]]
        above = (max(0, hg - x) + kh * prior) / (hn - 1 + kh)
        path = min(1 - 1e-6, max(1e-6, (max(0, g - x) + kp * above) / (n - 1 + kp)))
        z = r["evidence"] + np.log(path / (1 - path)) - np.log(prior / (1 - prior))
        assert np.isclose(r["score"], 1 / (1 + np.exp(-z)), atol=1e-6) and r["accepted"] == (r["score"] >= 0.5)
    assert len(got) == 300


def test_sparse_sites_are_drawn_to_what_stands_above_them(spark):
    sites = spark.createDataFrame([(1000.0, 900.0, 0.5), (1000.0, 100.0, 0.5)], "n double, good double, prior double")
    k = quality._shrunk(sites, "prior")
    assert 1 <= k < 50
    k = quality._shrunk(spark.createDataFrame([(1000.0, 500.0, 0.5), (1000.0, 501.0, 0.5)], "n double, good double, prior double"), "prior")
    assert k == 1e6


# 6 decontamination


def test_contained_items(spark):
    items = [None, "", "two words", *[prose(200 + k, n) for k, n in enumerate((5, 6, 9, 15, 20, 33, 60, 140, 20, 20))]]
    texts = odd_texts() + ["two words", "Two  Words\n"]
    for k, t in enumerate(items[3:]):
        w = t.split()
        texts += [prose(300 + k, 700) + " " + t + " " + prose(400 + k, 900), " ".join(w[: len(w) * 2 // 3]) + " " + prose(500 + k, 300), t.upper(), " ".join([*w[:-1], "other"]) + " " + prose(600 + k, 100)]
    bench = spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): (r["shared"], r["item_shingles"]) for r in contamination.contained_items(spark, table(spark, texts), bench.unionByName(bench)).collect()}
    want = {}
    for i, t in enumerate(items):
        q = shingles(t)
        for d, x in enumerate(texts):
            both = len(q & shingles(x))
            if q and 100 * both >= 80 * len(q):
                want[d, i] = both, len(q)
    assert got == want and len(want) > 20
    left = {r["doc_id"] for r in contamination.without_leaks(spark, table(spark, texts), bench).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in want}
    assert contamination.contained_items(spark, table(spark, texts), bench.where("false")).count() == 0


def test_items_in_rounds_give_the_same(spark, monkeypatch):
    bench = spark.createDataFrame([(k, prose(200 + k, 20)) for k in range(9)], "item_id long, text string")
    docs = table(spark, [prose(900, 50) + " " + prose(200 + k, 20) for k in range(9)])
    whole = {(r["doc_id"], r["item_id"]) for r in contamination.contained_items(spark, docs, bench).collect()}
    monkeypatch.setattr(contamination, "ROUND", 2)
    assert {(r["doc_id"], r["item_id"]) for r in contamination.contained_items(spark, docs, bench).collect()} == whole == {(k, k) for k in range(9)}


def test_repeated_documents_give_a_pair_once(spark):
    bench = spark.createDataFrame([(1, prose(1700, 20))], "item_id long, text string")
    docs = table(spark, [prose(1701, 50) + " " + prose(1700, 20), prose(1702, 40)])
    docs = docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert [tuple(r) for r in contamination.contained_items(spark, docs, bench).collect()] == [(0, 1, 16, 16)]
    assert [r["doc_id"] for r in contamination.without_leaks(spark, docs, bench).orderBy("doc_id").collect()] == [None, 1, 1]


def test_items_that_share_an_id_are_searched_each(spark):
    one, two = prose(1200, 40), prose(1201, 40)
    bench = spark.createDataFrame([(1, one), (1, two), (1, two), (2, prose(1202, 20))], "item_id long, text string")
    docs = table(spark, [prose(1300, 90) + " " + one, prose(1301, 90) + " " + two, one + " " + two, prose(1302, 90)])
    got = sorted((r["doc_id"], r["item_id"], r["shared"], r["item_shingles"]) for r in contamination.contained_items(spark, docs, bench).collect())
    assert got == [(k, 1, 36, 36) for k in range(3)]
    assert [r["doc_id"] for r in contamination.without_leaks(spark, docs, bench).collect()] == [3]


def test_small_items_are_found_without_minima(monkeypatch):
    """With one hash function minima alone miss most items of few shingles."""
    monkeypatch.setattr(contamination, "HASHES", 1)
    texts = [prose(1400 + k, 5 + k % 4) for k in range(60)]
    index = contamination.Index(list(enumerate(shingle_sets(pa.array(texts)))))
    minima = contamination.Minima(1, contamination.SEED)
    docs = pa.array([prose(1500 + k, 50) + " " + t + " " + prose(1600 + k, 50) for k, t in enumerate(texts)])
    assert all(k in index.candidates(run, minima) for k, run in enumerate(contamination.shingle_runs(docs)))


# 7, 8, 10 tokens


def library(name):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenizer(name))
    t.no_truncation()
    t.no_padding()
    return t


def random_texts(n, seed=3):
    r = random.Random(seed)
    kinds = ["eitnsrao", "aab ", "abcdefghijklmnopqrstuvwxyzäöüß'.,!?0123456789 \n\t", "ΣσİIıǅͅẞ\x1c\x1f\x85\xa0 ​你好한글😀🎳 ", "b'sllve mre td' "]
    return ["".join(r.choice(r.choice(kinds) if r.random() < 0.05 else kinds[k % 5]) for _ in range(r.randint(1, 60))) for k in range(n)]


def test_bpe_is_the_librarys():
    t, own = library("word_bpe_49k.json"), bpe.Tokenizer(tokenizer("word_bpe_49k.json"))
    for text in [*odd_texts(), *random_texts(1500), "a" * 3000, "x<|endoftext|>y'LL"]:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids
        assert own.decode(own.encode(text)).decode() == t.decode(ids, skip_special_tokens=False)


def test_backtracking_is_merging_by_rank():
    r = random.Random(8)
    for _ in range(40):
        tokens, merges = list("abc"), []
        while len(merges) < 12:
            pair = r.choice(tokens), r.choice(tokens)
            if len(pair[0] + pair[1]) <= 6 and pair[0] + pair[1] not in tokens:
                merges.append(pair)
                tokens.append(pair[0] + pair[1])
        m = bpe.Merges({t: i for i, t in enumerate(tokens)}, merges, None)
        for _ in range(60):
            text = "".join(r.choice("abc") for _ in range(r.randint(1, 14)))
            assert m.split(text) == bpe._by_rank(m, text), (text, merges)


def test_bpe_rows(spark):
    texts = odd_texts()
    t = library("word_bpe_49k.json")
    rows = {r["doc_id"]: r for r in bpe.encoded(table(spark, texts), tokenizer("word_bpe_49k.json")).collect()}
    for k, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert rows[k]["ids"] == ids and rows[k]["n_tokens"] == len(ids)
        assert rows[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[k]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encoded(table(spark).where("false"), tokenizer("word_bpe_49k.json")).count() == 0


def test_pieces_are_the_librarys(monkeypatch):
    monkeypatch.setattr(pretokens, "KNOWN", 500)
    t, own = library("byte_bpe_50k.json"), pretokens.PieceEncoder(tokenizer("byte_bpe_50k.json"))
    texts = [*odd_texts(), *random_texts(1500), " ", "  a", "a \n b", "a\n  b ", " a", "\n a", "a \n", "<|endoftext|> x"]
    for at in range(0, len(texts), 70):
        part = texts[at : at + 70]
        for text, ids in zip(part, own.encoded(pa.array(part, pa.string())), strict=True):
            assert ids.tolist() == t.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_token_histogram(spark):
    texts = odd_texts() + [prose(k, k % 9 + 1) for k in range(60)]
    t = library("byte_bpe_50k.json")
    lengths = [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    made = token_counts.length_histogram(token_counts.token_lengths(table(spark, texts), tokenizer("byte_bpe_50k.json")), Scratch(spark, "t"))
    assert {tuple(r) for r in made.collect()} == {(x, lengths.count(x), sum(y >= x for y in lengths), sum(y for y in lengths if y >= x), sum(min(x, y) for y in lengths)) for x in lengths}
    for limit in (0, 1, 7, 1000, 10**6):
        assert token_counts.truncated_total(made, limit).first()[0] == sum(min(x, limit) for x in lengths)
    for q in (0.0, 0.5, 0.9, 1.0):
        assert token_counts.length_quantile(made, q).first()[0] == next(x for x in sorted(lengths) if sum(y <= x for y in lengths) >= q * len(lengths))
    for n in (10, 20, 100):
        ten = token_counts.length_histogram(spark.createDataFrame([(k + 1,) for k in range(n)], "n_tokens long"), Scratch(spark, "t"))
        assert token_counts.length_quantile(ten, 0.9).first()[0] == n * 9 // 10
    none = token_counts.length_histogram(spark.createDataFrame([(None,)], "n_tokens long"), Scratch(spark, "t"))
    assert none.count() == 0 and token_counts.truncated_total(none, 5).first()[0] == 0 and token_counts.length_quantile(none, 0.5).first()[0] is None


def test_shards_follow_by_number(spark, tmp_path):
    names = ["part-99999-a-c000.txt", "part-100000-a-c000.txt", "part-100000-a-c999.txt", "part-100000-a-c1000.txt"]
    rows = spark.createDataFrame([(n, 0, 1, 0, k, 1, 0) for k, n in enumerate(names)], records.INDEX)
    rows.write.parquet(f"{tmp_path}/index")
    assert sorted((r["start"], r["doc_id"]) for r in records.read_records(spark, str(tmp_path)).collect()) == [(k, k) for k in range(4)]


def test_an_id_that_fills_several_ranges_is_dealt_over_them():
    limits = np.array([3, 7, 7, 7, 9])
    docs, salts = np.array([1, 3, 4, 7, 7, 7, 8, 10]), np.array([5, 5, 5, 0, 1, 2, 9, 9])
    assert records._ranges(limits, docs, salts).tolist() == [0, 0, 1, 1, 2, 3, 4, 5]


@pytest.mark.parametrize("ranges", [20_000, 2])
def test_records(spark, monkeypatch, ranges):
    monkeypatch.setattr(records, "SHARD", 20_000)
    monkeypatch.setattr(records, "RANGES", ranges)
    texts = odd_texts()
    t = library("byte_bpe_50k.json")
    scratch = Scratch(spark, "t")
    docs = table(spark, texts).unionByName(table(spark, texts).where("doc_id = 7")).unionByName(table(spark, ["no id"]).withColumn("doc_id", F.lit(None).cast("long")))
    records.write_records(spark, docs, tokenizer("byte_bpe_50k.json"), 2, scratch.root)
    got = sorted((tuple(r) for r in records.read_records(spark, scratch.root).collect()), key=lambda r: r[1])
    ids = [[*t.encode(texts[k] or "", add_special_tokens=False).ids, 2] for k in sorted([*range(len(texts)), 7])]
    assert [r[0] for r in got] == sorted([*range(len(texts)), 7]) and [r[2] for r in got] == list(map(len, ids))
    assert [r[1] for r in got] == [sum(map(len, ids[:k])) for k in range(len(ids))]
    assert [r[3] for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    assert len({r[4] for r in got}) > 1
    files = {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in spark.read.format("binaryFile").load(f"{scratch.root}/shards").collect()}
    for r, x in zip(got, ids, strict=True):
        assert records.fetch(files[r[4]], r[5], r[6]).tolist() == x
    damaged = bytearray(files[got[0][4]])
    damaged[30] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(records.records(bytes(damaged)))
    assert all(records.unmasked(records.masked(x)) == zlib.crc32(x) for x in (b"", b"abc", bytes(300)))
    scratch = Scratch(spark, "t")
    records.write_records(spark, docs.where("false"), tokenizer("byte_bpe_50k.json"), 2, scratch.root)
    assert records.read_records(spark, scratch.root).count() == 0


# 9 embeddings


def test_linked_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 32)
    monkeypatch.setattr(embedding_dedup, "STRIP", 12)
    monkeypatch.setattr(embedding_dedup, "CENTRES", 4)
    r = np.random.default_rng(4)
    centres = r.standard_normal((40, 16))
    rows = []
    for k in range(400):
        x = centres[k % 40] + 0.17 * r.standard_normal(16)
        rows.append((k, [float(v) for v in x * 10.0 ** r.integers(-3, 4)]))
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None] * 16), (1005, [float("inf")] + [1.0] * 15), (1006, rows[0][1]), (1007, rows[0][1]), (1008, [1e-300] + [0.0] * 15), (1009, [1e300] + [0.0] * 15), (1010, [1.0, 0.0]), (1011, [1.0, 0.1])]
    frame = spark.createDataFrame([(*x, "l", 0) for x in rows], "vec_id long, embedding array<double>, label string, vec int")
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in embedding_dedup.linked_vectors(spark, frame).collect()}
    good = {k: np.array(v, float) for k, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    unit = {k: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for k, v in good.items()}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    label = closed({k: k for k, _ in rows}, links)
    assert got == {k: (sum(k in x for x in links), label[k], label[k] == k) for k, _ in rows} and len(links) > 500
    assert embedding_dedup.linked_vectors(spark, frame.where("false")).count() == 0


# the pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = []
    for k in range(300):
        t = prose(k, 60) + "."
        if k % 7 == 0:
            t = " ".join(w + "!!" for w in t.upper().split())
        docs.append((k, t, "en", f"s{k % 2}", len(t)))
    docs += [(300, docs[1][1], "en", "s0", 0), (301, docs[2][1] + " also", "en", "s1", 0), (302, docs[3][1] + " " + prose(5000, 30), "en", "s1", 0), (303, None, "en", None, None), (304, "12 34", None, "s0", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 7 != 0), 0) for k in range(0, 300, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, prose(5000, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        frame.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r["doc_id"] for r in frame.select("doc_id").collect()})
    good = {k for k in range(302) if k >= 300 or k % 7}
    assert good | {302} <= kept[0] and not {k for k in range(0, 300, 7)} & kept[0]
    assert kept[1] == kept[0] - {303, 304}
    assert kept[2] == kept[1] - {300, 301}
    assert kept[3] == kept[4] == kept[2] - {302}
    assert all(b <= a for a, b in pairwise(kept))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept[4]


def test_pipeline_drops_near_copies_from_080(spark):
    import corpus_pipeline

    words = prose(6000, 103).split()
    changed = {n: " ".join(words[: 103 - n] + prose(6000 + n, n).upper().replace("A", "x").split()) for n in (9, 11, 12)}
    texts = [" ".join(words), changed[9], changed[11], changed[12], prose(6001, 90)]
    close = [len(shingles(texts[0]) & shingles(t)) / len(shingles(texts[0]) | shingles(t)) for t in texts[1:4]]
    assert 0.8 < close[0] < 0.85 and close[1] == 0.8 and close[2] < 0.8
    got = corpus_pipeline.near_duplicate_stage(spark, table(spark, texts), "")
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 3, 4]


def test_pipeline_judges_rows_whatever_their_ids(spark, tmp_path):
    """Null ids pass no stage by being null, and of several texts under one id each is judged by itself."""
    import corpus_pipeline

    good, bad = prose(7000, 60) + ".", " ".join(w + "!!" for w in prose(7001, 60).upper().split())
    docs = [(k, (prose(k, 60) + ".") if k % 4 else " ".join(w + "!!" for w in prose(k, 60).upper().split()), "en", "s", 1) for k in range(160)]
    docs += [(None, bad, "en", "s", 1), (None, good, "en", "s", 1), (500, bad, "en", "s", 1), (500, good + " more", "en", "s", 1), (None, good, "en", "s", 1), (None, prose(7002, 30) + " " + prose(7003, 30), "en", "s", 1), (None, None, "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, prose(7003, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        left.append([r["text"] for r in frame.where("doc_id is null or doc_id = 500").select("text").collect()])
    mixed = prose(7002, 30) + " " + prose(7003, 30)
    assert bad not in left[0] and left[0].count(good) == 2 and None not in left[1]
    assert sorted(left[2]) == sorted([good + " more", mixed]) and left[3] == [good + " more"]
