"""Free-text queries: terms, phrases, fields, AND, OR, NOT, + and -, parentheses, trailing * and ?.

A query becomes one condition, so that a scan tests each message once.  Terms ignore case and
stand between characters that are no letter, digit or underscore.  Terms side by side must all
hold.  A term may not begin with a wildcard.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r'\s*(?:(?P<paren>[()])|(?P<sign>[+\-!](?=\S))|(?:(?P<field>[A-Za-z_][\w.]*):)?(?:"(?P<phrase>[^"]*)"|(?P<word>[^\s()"]+)))')
MESSAGE = {"message", "msg", "log.message", "event.original"}
WORD = "[a-z0-9_]"


@dataclass(frozen=True)
class Node:
    kind: str  #: and, or, not, text, field
    parts: tuple = ()
    field: str = ""
    regex: str = ""


def text_regex(text: str, phrase: bool) -> str:
    """Lower-case; words of a phrase may stand apart by anything that is no word character."""
    def word(w: str) -> str:
        return "".join(WORD + "*" if c == "*" and not phrase else WORD if c == "?" and not phrase else re.sub(r"([^a-z0-9_])", r"\\\1", c) for c in w)

    words = [w for w in (re.split(r"\W+", text.lower(), flags=re.ASCII) if phrase else [text.lower()]) if w]
    return "(?:^|[^a-z0-9_])" + "[^a-z0-9_]+".join(map(word, words)) + "(?:$|[^a-z0-9_])"


def parse(query: str) -> Node:
    tokens, at = [], 0
    query = query.strip()
    while at < len(query):
        m = TOKEN.match(query, at)
        if m is None:
            raise ValueError(f"not a query: {query!r}")
        tokens.append(m)
        at = m.end()
    out, k = _either(tokens, 0)
    if k != len(tokens):
        raise ValueError("a parenthesis too many")
    return out


def _is(m: re.Match, word: str) -> bool:
    return m["word"] == word and m["field"] is None


def _either(tokens: list, k: int) -> tuple[Node, int]:
    left, k = _all(tokens, k)
    parts = [left]
    while k < len(tokens) and _is(tokens[k], "OR"):
        right, k = _all(tokens, k + 1)
        parts.append(right)
    return (left if len(parts) == 1 else Node("or", tuple(parts))), k


def _all(tokens: list, k: int) -> tuple[Node, int]:
    parts = []
    while k < len(tokens) and not _is(tokens[k], "OR") and tokens[k]["paren"] != ")":
        if _is(tokens[k], "AND"):
            k += 1
            continue
        node, k = _one(tokens, k)
        parts.append(node)
    if not parts:
        raise ValueError("an operator without its terms")
    return (parts[0] if len(parts) == 1 else Node("and", tuple(parts))), k


def _one(tokens: list, k: int) -> tuple[Node, int]:
    if k >= len(tokens):
        raise ValueError("an operator without its terms")
    m = tokens[k]
    if m["sign"] or _is(m, "NOT"):
        node, k = _one(tokens, k + 1)
        return (node if m["sign"] == "+" else Node("not", (node,))), k
    if m["paren"] == "(":
        node, k = _either(tokens, k + 1)
        if k >= len(tokens) or tokens[k]["paren"] != ")":
            raise ValueError("a parenthesis is open")
        return node, k + 1
    text = m["phrase"] if m["phrase"] is not None else m["word"]
    if text is None or (m["word"] and text[0] in "*?"):
        raise ValueError("a term may not begin with a wildcard")
    field = m["field"] or "message"
    return Node("text" if field in MESSAGE else "field", (), field, text_regex(text, m["phrase"] is not None)), k + 1


def _fold(node: Node, leaf: Callable, both: Callable, either: Callable, no: Callable):
    if node.kind in ("text", "field"):
        return leaf(node)
    parts = [_fold(p, leaf, both, either, no) for p in node.parts]
    return {"and": both, "or": either, "not": lambda ps: no(ps[0])}[node.kind](parts)


def condition(query: str, columns: list[str]) -> Column:
    """True or false for each row, never null; fields other than the message must be among the columns."""
    def leaf(n: Node) -> Column:
        name = "message" if n.kind == "text" else n.field
        if name not in columns:
            raise ValueError(f"no field {n.field}")
        return F.coalesce(F.lower(F.col(f"`{name}`").cast("string")).rlike(n.regex), F.lit(False))

    def join(op: Callable) -> Callable:
        def made(ps: list) -> Column:
            out = ps[0]
            for p in ps[1:]:
                out = op(out, p)
            return out
        return made

    return _fold(parse(query), leaf, join(lambda a, b: a & b), join(lambda a, b: a | b), lambda p: ~p)


def condition_sql(query: str) -> str:
    def leaf(n: Node) -> str:
        return f"coalesce(regexp_matches(lower({'message' if n.kind == 'text' else n.field}::varchar), '{n.regex}'), false)"

    return _fold(parse(query), leaf, lambda ps: "(" + " and ".join(ps) + ")", lambda ps: "(" + " or ".join(ps) + ")", lambda p: f"(not {p})")


def search(rows: DataFrame, query: str) -> DataFrame:
    """The hits that the query holds for."""
    return rows.where(condition(query, rows.columns))


def matched_total(rows: DataFrame, query: str) -> DataFrame:
    """How many there are, before any limit."""
    return search(rows, query).agg(F.count("*").alias("value")).withColumn("relation", F.lit("eq"))
