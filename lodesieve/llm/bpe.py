"""Byte-pair encoding by backtracking, and decoding by an offset table.

Encoder: an Aho-Corasick automaton over the vocabulary finds, in one pass over a
piece of text, the longest token that starts at each place.  A left-to-right walk
takes the longest token whose pair with the token before it is compatible, that
is, whose two parts the merges would leave apart; where none is, the walk steps
back and shortens the token before.  A compatible sequence is the only result that
the merges can have, so the walk's end is exact, and since every place is ruled
out once, its length is linear in that of the piece.

Decoder: all tokens' strings stand in one buffer; an offset table turns a sequence
of ids into byte ranges of it.

The rules of the tokenizer file that are followed: added tokens found in the raw
text, NFC, white space runs to one space, lower case, a split that keeps a
pattern's matches, byte-level characters, an end-of-word suffix, and no decoder
(tokens are joined by one space).
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesieve.llm.memory import tidy

#: Distinct pieces whose ids a task remembers; a full table is emptied.
TABLE = 300_000
#: What the split's pattern calls white space: Unicode's White_Space, without U+001C to U+001F, which Python adds.
SPACES = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters whose class or case may differ between Unicode versions: texts with one take the library's own normal form and split.
UNUSUAL = regex.compile(r"[^\x00-\u052f\u2000-\u2064\u20ac]")
#: Ids that are decoded at once.
DECODED = 1_000_000


def _byte_characters() -> list[str]:
    """The visible character that stands for each byte: itself if printable in Latin-1, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Merges:
    """Backtracking encoder of one piece; a piece's last character and the end-of-word suffix are one symbol."""

    END = "\0"  # stands for the suffix within strings; no byte's visible character is it

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str | None) -> None:
        cut = len(suffix) if suffix else 0
        self.end = self.END if suffix else ""
        inner = (lambda t: t[:-cut] + self.END if t.endswith(suffix) else t) if suffix else (lambda t: t)
        self.ids = {inner(t): i for t, i in vocab.items()}
        #: rank of the merge of a pair, by their strings' joint form; a token's two parts and the rank at which it comes about
        self.rank: dict[tuple[str, str], int] = {}
        self.parts: dict[str, tuple[str, str, int]] = {}
        for r, (a, b) in enumerate(merges):
            a, b = inner(a), inner(b)
            self.rank.setdefault((a, b), r)
            self.parts.setdefault(a + b, (a, b, r))
        self.automaton = ahocorasick.Automaton()
        for t in self.ids:
            self.automaton.add_word(t, len(t))
        self.automaton.make_automaton()
        self.built: dict[str, bool] = {}
        #: longest proper prefix of a token that is a token
        self.shorter: dict[str, str] = {}
        #: the pair-compatibility table, filled as pairs are met
        self.compatible = lru_cache(1 << 17)(self._compatible)

    def _compatible(self, a: str, b: str) -> bool:
        """Whether merging all of a + b by rank leaves exactly a and b.

        Walks down the right edge of a and the left edge of b, from the last merge to
        the first.  At each step, the parts that touch are those present just before
        the later of the two last merges; if they could have merged earlier than that,
        or at the same rank further left, a and b would not both have come about.
        """
        before = float("inf")  # the touching parts stay neighbours until this rank
        tie = True  # whether a merge of that very rank across the border would come first
        while True:
            r = self.rank.get((a, b))
            if r is not None and (r < before or r == before and tie):
                return False
            ra = self.parts[a][2] if len(a) > 1 and a in self.parts else -1
            rb = self.parts[b][2] if len(b) > 1 and b in self.parts else -1
            if ra < 0 and rb < 0:
                return True
            # of equal ranks the left one is merged first, so the right one is undone first
            if rb >= ra:
                before, tie, b = rb, True, self.parts[b][0]
            else:
                before, tie, a = ra, False, self.parts[a][1]

    def _next(self, token: str) -> str:
        """The longest token that is a proper prefix of this one, or an empty string."""
        found = self.shorter.get(token)
        if found is None:
            n = len(token) - 1
            while n and token[:n] not in self.ids:
                n -= 1
            found = self.shorter[token] = token[:n]
        return found

    def split(self, piece: str) -> list[str]:
        """The tokens of a piece of byte characters."""
        text = piece + self.end
        if text in self.ids and (len(piece) == 1 or self._whole(text)):
            return [text]
        n = len(text)
        longest = [0] * n
        for stop, size in self.automaton.iter(text):
            start = stop + 1 - size
            if size > longest[start]:
                longest[start] = size
        dead = bytearray(n + 1)  # places from which no compatible way goes on
        if self.end:
            dead[n - 1] = 1  # the suffix isn't parted from the last character
        out: list[str] = []
        at = 0
        token = text[: longest[0]]
        while True:
            while token:
                to = at + len(token)
                if not dead[to] and (len(token) == 1 or self._whole(token)) and (not out or self.compatible(out[-1], token)):
                    break
                token = self._next(token)
            if token:
                out.append(token)
                at = to
                if at == n:
                    return out
                token = text[at : at + longest[at]]
            else:
                dead[at] = 1
                if not out:
                    raise ValueError(f"the vocabulary can't spell {piece!r}")
                token = out.pop()
                at -= len(token)
                token = self._next(token)

    def _whole(self, text: str) -> bool:
        """Whether the merges build this token from its characters; one that they never do stands in no result."""
        found = self.built.get(text)
        if found is None:
            found = self.built[text] = _by_rank(self, text) == [text]
        return found

    def symbols(self, text: str) -> list[str]:
        if self.end and text.endswith(self.END):
            return [*text[:-2], text[-2:]]
        return list(text)


def _by_rank(merges: Merges, text: str) -> list[str]:
    """The plain definition: merge the leftmost pair of least rank until none is left.  Used once per token, to check it."""
    parts = merges.symbols(text)
    while len(parts) > 1:
        best = min(((merges.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 60, 0))
        if best[0] == 1 << 60:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return parts


class Texts:
    """Strings in one buffer, and the offsets of each."""

    def __init__(self, strings: list[bytes]) -> None:
        self.buffer = np.frombuffer(b"".join(strings), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(s) for s in strings]))).astype(np.int64)

    def of(self, ids: np.ndarray) -> bytes:
        out = []
        for at in range(0, len(ids), DECODED):
            part = ids[at : at + DECODED]
            begin = self.offsets[part]
            sizes = self.offsets[part + 1] - begin
            stops = np.cumsum(sizes)
            out.append(self.buffer[np.arange(stops[-1]) + np.repeat(begin - (stops - sizes), sizes)].tobytes())
        return b"".join(out)


class Tokenizer:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab = dict(model["vocab"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_pattern = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"[^\s", f"[^{SPACES}"))
        self.library = tokenizers.Tokenizer.from_file(path)
        self.merges = Merges(vocab, [tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
        self.characters = dict(enumerate(_byte_characters()))
        names = [""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for t, i in [*vocab.items(), *self.added.items()]:
            names[i] = t
        #: tokens are joined by a space: each string has its own behind it, and the last is cut off
        self.names = Texts([t.encode() + b" " for t in names])
        self.decimals = Texts([b"%d " % i for i in range(len(names))])
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        return self._shown(piece.encode().decode("latin-1").translate(self.characters))

    def _shown(self, shown: str) -> bytes:
        return np.array([self.merges.ids[t] for t in self.merges.split(shown)], "<u4").tobytes()

    def _normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # Python's lower() alone knows a final sigma
                text = text.replace("Σ", "σ")
        return text.lower()

    def _unusual(self, text: str) -> bytes:
        shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return b"".join(self._shown(p) for p, _ in shown)

    def _plain(self, text: str) -> bytes:
        if not text.isascii() and UNUSUAL.search(text):
            return self._unusual(text)
        found = self.pattern.findall(self._normal(text))
        table = self.pieces
        try:
            return b"".join(map(table.__getitem__, found))
        except KeyError:
            new = {p for p in found if p not in table}
            if len(table) + len(new) > TABLE:
                table.clear()
                new = set(found)
            for p in new:
                table[p] = self._piece(p)
            return b"".join(map(table.__getitem__, found))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; a null text has none."""
        if not text:
            return np.empty(0, np.uint32)
        if self.added_pattern is None or not self.added_pattern.search(text):
            return np.frombuffer(self._plain(text), "<u4")
        parts = self.added_pattern.split(text)
        return np.frombuffer(b"".join(np.array([self.added[p]], "<u4").tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts)), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text."""
        return self.names.of(ids)[:-1]

    def listed(self, ids: np.ndarray) -> bytes:
        """The ids as decimals with one space between."""
        return self.decimals.of(ids)[:-1]


@lru_cache(2)
def loaded(path: str) -> Tokenizer:
    """A worker process keeps its tokenizer, and the pieces it has met, from task to task."""
    return Tokenizer(path)


def _digests(path: str, with_ids: bool):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                counts, listed, decoded, kept = [], [], [], []
                for text in part.column(1).to_pylist():
                    ids = tokenizer.encode(text)
                    counts.append(len(ids))
                    listed.append(sha256(tokenizer.listed(ids)).hexdigest())
                    decoded.append(sha256(tokenizer.decode(ids)).hexdigest())
                    if with_ids:
                        kept.append(ids.astype(np.int32))
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids`` for every row.

    Null and empty texts have no ids and digests of empty strings; very long texts are encoded
    whole, in time that grows with their length; repeated rows and null ids stay as they are;
    an empty table gives no rows; further columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_digests(tokenizer, with_ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
