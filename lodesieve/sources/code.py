"""Source files, and what is found in their text: calls, functions, declarations, properties, literals, routes.

The parser is tolerant: it reads tokens and brackets, not the whole grammar.  Each file is read by
itself, so files spread over tasks in any way.  A node is a pair of places in the text and what was
read between them as places too; text is cut out only where a condition asks for it, so what a file
costs grows with its length, however deeply it is nested.

Null or empty contents give no nodes; unbalanced brackets give one node of kind ``issue``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesieve.functions import vocabulary as V

KEYWORDS = {"if", "for", "while", "switch", "catch", "with", "return", "typeof", "await", "new", "in", "of", "case", "do", "else", "throw", "delete", "void", "yield", "function", "instanceof", "async", "import", "export", "default", "const", "let", "var", "class", "extends"}
TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*(?s:.*?)\*/)|(?P<str>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<num>\d[\w.]*)|(?P<id>[A-Za-z_$\u0080-￿][\w$]*)"
    r"|(?P<op>===|!==|=>|==|!=|<=|>=|\?\?=|\|\|=|&&=|\?\?|\|\||&&|\?\.(?!\d)|\.\.\.|\+\+|--|\*\*|[-+*/%&|^]=|.)",
    re.S,
)
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
CLOSE = {"(": ")", "[": "]", "{": "}"}
CLOSERS = set(CLOSE.values())
#: Operators that may stand between the angle brackets of type arguments.
TYPE_PIECES = {".", ",", "|", "&", "[", "]", "{", "}", "(", ")", "=>", "?", ":", ";", "="}
#: Tokens after which an expression goes on in the next line.
OPEN_ENDS = {".", "?.", "=", "=>", "+", "||", "&&", "??", "?", ":", "(", "[", ",", "==", "==="}
STATEMENT_STARTS = {"{", "}", ";", "export", "default", ")"}

Span = tuple[int, int]


@dataclass(slots=True)
class Node:
    """Something between two places of a file's text; ``args`` and ``value`` are places too."""

    kind: str
    start: int
    end: int
    name: str = ""
    receiver: Span | None = None
    args: list[Span] = field(default_factory=list)
    value: Span | None = None
    op: str = ""
    #: the object literal that a property belongs to, the handler's function of a route, and the like
    owner: object = None


@dataclass(slots=True, eq=False)
class Function:
    start: int
    end: int
    name: str
    kind: str  #: declaration, expression, arrow or method
    params: list[Span]
    body: Span
    generic: bool = False
    bare: bool = False  #: an arrow whose body is an expression


class Source:
    """Tokens of a text, or of a part of it, with brackets paired; ``clean`` is the text with comments blanked, of the same length."""

    def __init__(self, text: str, part: Span | None = None):
        self.text, self.tokens, self.pair = text, [], {}
        self.comments: list[Span] = []
        at, last_place = part or (0, len(text))
        stack, self.whole = [], True
        tokens, match = self.tokens, TOKEN.match
        while at < last_place:
            last = tokens[-1] if tokens else ("op", "", 0, 0)
            c = text[at]
            if c == "`":
                end, kind = _template(text, at), "tpl"
            elif c == "/" and text[at + 1 : at + 2] not in ("/", "*") and (last[0] == "op" and last[1] not in (")", "]", "}") or last[1] in KEYWORDS) and REGEX.match(text, at):
                end, kind = REGEX.match(text, at).end(), "re"
            else:
                m = match(text, at, last_place)
                end, kind = m.end(), m.lastgroup
            if kind == "comment":
                self.comments.append((at, end))
            elif kind != "space":
                piece = text[at:end]
                if kind == "op" and piece in CLOSE:
                    stack.append(len(tokens))
                elif kind == "op" and piece in CLOSERS:
                    if stack and CLOSE[tokens[stack[-1]][1]] == piece:
                        i = stack.pop()
                        self.pair[i], self.pair[len(tokens)] = len(tokens), i
                    else:
                        self.whole = False
                tokens.append((kind, piece, at, end))
            at = end
        self.whole = self.whole and not stack
        self.starts = [t[2] for t in tokens]
        if part:
            return
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        parts, at = [], 0
        for a, b in self.comments:
            parts += [text[at:a], re.sub(r"[^\n]", " ", text[a:b])]
            at = b
        self.clean = "".join([*parts, text[at:]])

    def is_(self, i: int, *pieces: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i][1] in pieces and self.tokens[i][0] in ("op", "id")

    def named(self, i: int) -> bool:
        """Whether token i is a name: no keyword, unless it follows a dot."""
        return i >= 0 and self.tokens[i][0] == "id" and (self.tokens[i][1] not in KEYWORDS or self.is_(i - 1, ".", "?."))

    def span(self, a: int, b: int) -> Span:
        """Places of tokens a to b, b excluded."""
        return (self.tokens[a][2], self.tokens[b - 1][3]) if a < b else (self.tokens[a][2] if a < len(self.tokens) else len(self.text),) * 2

    def line(self, start: int) -> tuple[int, int]:
        n = bisect_right(self.breaks, start - 1)
        return n + 1, start - (self.breaks[n - 1] + 1 if n else 0) + 1

    def generic(self, i: int) -> int | None:
        """The opening bracket of the type arguments that end with token i, which stand right behind a name."""
        depth, k = 1, i - 1
        while k > 0 and i - k < 200:
            kind, piece = self.tokens[k][:2]
            if piece == ">" and kind == "op":
                depth += 1
            elif piece == "<" and kind == "op":
                depth -= 1
                if not depth:
                    return k if self.tokens[k - 1][0] == "id" and self.tokens[k - 1][3] == self.tokens[k][2] else None
            elif kind == "op" and piece not in TYPE_PIECES:
                return None
            k = (self.pair.get(k, k) if piece in CLOSERS and kind == "op" else k) - 1
        return None

    def callee(self, i: int) -> int:
        """The last token of what the parenthesis at token i calls, type arguments left out."""
        if self.is_(i - 1, ">"):
            k = self.generic(i - 1)
            if k is not None:
                return k - 1
        return i - 1

    def back(self, i: int) -> int:
        """First token of the operand that ends with token i."""
        while i >= 0:
            kind, piece = self.tokens[i][:2]
            if kind == "op" and piece in (")", "]"):
                i = self.pair.get(i, i)
                k = self.callee(i) if piece == ")" else i - 1
                if self.is_(k, ".", "?."):
                    i = k - 1
                elif k >= 0 and (self.named(k) or self.is_(k, ")", "]")):
                    i = k
                else:
                    return i
            elif self.is_(i - 1, ".", "?."):
                i -= 2
            elif kind == "op" and piece == "!" and i > 0:
                i -= 1
            else:
                return i
        return 0

    def ahead(self, i: int, ends: tuple[str, ...] = (",", ";")) -> int:
        """First token after the expression that starts with token i."""
        k, tokens = i, self.tokens
        while k < len(tokens):
            kind, piece, start, _ = tokens[k]
            if kind == "op" and (piece in ends or piece in CLOSERS):
                return k
            if k > i and kind != "op" and tokens[k - 1][1] not in OPEN_ENDS and "\n" in self.text[tokens[k - 1][3] : start]:
                return k
            k = self.pair.get(k, k) + 1
        return k

    def parts(self, i: int) -> list[Span]:
        """Token ranges between the commas inside the bracket that opens at token i."""
        out, a, k, end = [], i + 1, i + 1, self.pair.get(i, len(self.tokens))
        while k < end:
            if self.is_(k, ","):
                out.append((a, k))
                a = k + 1
            elif self.is_(k, "<") and self.tokens[k - 1][0] == "id" and self.tokens[k - 1][3] == self.tokens[k][2]:
                k = self._types(k, end)
            k = self.pair.get(k, k) + 1
        return out + ([(a, end)] if a < end else [])

    def _types(self, i: int, end: int) -> int:
        """The end of type arguments that open at token i, or i if they are none."""
        depth, k = 0, i
        while k < end and k - i < 200:
            kind, piece = self.tokens[k][:2]
            if kind == "op":
                depth += (piece == "<") - (piece == ">")
                if not depth:
                    return k
                if piece not in TYPE_PIECES and piece not in "<>":
                    return i
            k = self.pair.get(k, k) + 1
        return i

    def object_(self, i: int) -> bool:
        """Whether the brace at token i opens an object literal."""
        return i > 0 and (self.is_(i - 1, "(", ",", "=", ":", "[", "?", "&&", "||", "??", "...", "return", "default") and not (self.is_(i - 1, ":") and self.is_(i - 3, "case")))

    def body(self, i: int) -> int | None:
        """The brace that follows the parenthesis closing at token i, over a return type; None where there is none."""
        k = i + 1
        if self.is_(k, ":"):
            while k < len(self.tokens) and not self.is_(k, "{", "=>", ";", ",", ")", "="):
                k = (self.pair.get(k, k) if self.is_(k, "(", "[") else k) + 1
        return k if self.is_(k, "{") else None


def _template(text: str, at: int) -> int:
    """End of the template literal that starts at a back quote."""
    k, depth = at + 1, 0
    while k < len(text):
        c = text[k]
        if c == "\\":
            k += 1
        elif depth == 0 and c == "`":
            return k + 1
        elif c == "$" and text[k + 1 : k + 2] == "{" and depth == 0:
            depth, k = 1, k + 1
        elif depth and c == "{":
            depth += 1
        elif depth and c == "}":
            depth -= 1
        elif depth and c == "`":
            k = _template(text, k) - 1
        k += 1
    return len(text)


def holes(text: str, start: int, end: int) -> list[Span]:
    """The places of the substitutions of a template literal."""
    out, k, depth, at = [], start + 1, 0, 0
    while k < end - 1:
        c = text[k]
        if c == "\\":
            k += 1
        elif depth == 0 and c == "$" and text[k + 1] == "{":
            depth, k, at = 1, k + 1, k + 2
        elif depth and c == "`":
            k = _template(text, k) - 1
        elif depth:
            depth += (c == "{") - (c == "}")
            if not depth:
                out.append((at, k))
        k += 1
    return out


def plain(literal: str) -> str:
    return literal[1:-1] if literal[:1] in "\"'`" else literal


IMPORT = re.compile(r"\bimport\s+(?:type\s+)?([\w$*{][^'\";]*?)\s*\bfrom\s*['\"]([^'\"]+)['\"]")
REQUIRE = re.compile(r"\b(?:const|let|var)\s+([\w$]+|\{[^}]*\})\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)")
EXPORT_FROM = re.compile(r"\bexport\s+(?:type\s+)?(\*(?:\s+as\s+[\w$]+)?|\{[^}]*\})\s*from\s*['\"]([^'\"]+)['\"]")


def _bindings(braces: str, separator: str) -> Iterator[tuple[str, str]]:
    """(name there, name here) of ``{ a, b as c }`` or, with a colon for the separator, ``{ a, b: c }``."""
    for part in braces.strip("{} \n\t").split(","):
        words = re.split(separator, re.sub(r"^type\s+", "", part.strip()))
        if words[0]:
            yield words[0].strip(), words[-1].strip()


def imports(clean: str) -> dict[str, tuple[str, str]]:
    """Local names with the module and the exported name behind them; ``*`` is a whole module."""
    out: dict[str, tuple[str, str]] = {}
    for what, module in IMPORT.findall(clean):
        braces = re.search(r"\{[^}]*\}", what)
        for there, here in _bindings(braces[0], r"\s+as\s+") if braces else ():
            out[here] = module, there
        rest = (what.replace(braces[0], "") if braces else what).strip(" ,\n\t")
        for part in filter(None, map(str.strip, rest.split(","))):
            star = re.match(r"\*\s*as\s+([\w$]+)", part)
            out[star[1] if star else part] = module, "*" if star else "default"
    for what, module in REQUIRE.findall(clean):
        if what[0] != "{":
            out[what] = module, "*"
        else:
            out |= {here: (module, there) for there, here in _bindings(what, r"\s*:\s*")}
    return out


def re_exports(clean: str) -> list[tuple[str, str, str]]:
    """(exported name, module, name there)."""
    out = []
    for what, module in EXPORT_FROM.findall(clean):
        if what[0] == "*":
            out.append((what.split()[-1], module, "*"))
        else:
            out += [(here, module, there) for there, here in _bindings(what, r"\s+as\s+")]
    return out


class Unit:
    """A parsed file: nodes by kind, functions, imports, and what comes from a request.

    ``symbols``: for a local name of an import, what it stands for after all re-exports:
    (module, name, whether it is a function that returns request data).
    """

    def __init__(self, file: str, text: str, symbols: dict[str, tuple[str, str, bool]] | None = None):
        self.file, self.text = file, text
        self.s = Source(text)
        self.clean = self.s.clean
        low = self.clean.lower()
        self.low = low if len(low) == len(self.clean) else "".join(c.lower() if len(c.lower()) == 1 else c for c in self.clean)
        self.nodes: dict[str, list[Node]] = {}
        self.functions: list[Function] = []
        self.objects: dict[int, dict[str, Span]] = {}
        self._values: list[tuple[int, int, str]] = []  # ranges of values, with the name that they go to
        self.words: list[tuple[int, str]] = []  # places and names of what stands for a value
        self._blocks: list[Span] = []
        self._seen: dict = {}
        if not self.s.whole:
            self.add("issue", 0, 0)
            return
        self.imports = imports(self.clean)
        self.symbols = symbols or {}
        self._parse()
        self._function_of = innermost([(f.start, f.end, f) for f in self.functions])
        self._context_of = innermost(self._values)
        self._spread_taint()

    # places and texts

    def cut(self, span: Span | None) -> str:
        """The text between two places, without comments."""
        return self.clean[span[0] : span[1]] if span else ""

    def snippet(self, at: int, length: int | None = None) -> str:
        """What stands at a place, with a little on either side."""
        return self.text[max(0, at - AROUND) : at + (SNIPPET if length is None else length) + AROUND].strip()

    def of(self, node: Node) -> str:
        return self.clean[node.start : node.end]

    def arg(self, node: Node, k: int) -> str:
        return self.cut(node.args[k]) if -len(node.args) <= k < len(node.args) else ""

    def receiver(self, node: Node) -> str:
        return self.cut(node.receiver)

    def callee(self, node: Node) -> str:
        return f"{self.receiver(node)}.{node.name}" if node.receiver else node.name

    def function(self, node: Node) -> Function | None:
        return self._function_of(node.start)

    def context(self, node: Node) -> str:
        """The name that the value around a node goes to."""
        found = self._context_of(node.start)
        return found if found is not None else ""

    def scope(self, node: Node) -> Span:
        f = self.function(node)
        return (f.start, f.end) if f else (node.start, node.end)

    def matches(self, regex: str, low: bool = False) -> tuple[list[int], list[int]]:
        """Starts and ends of all matches in the file, looked for once; ``low``: in its text in lower case."""
        if (regex, low) not in self._seen:
            spans = [m.span() for m in re.finditer(regex, self.low if low else self.clean)]
            self._seen[regex, low] = [a for a, _ in spans], [b for _, b in spans]
        return self._seen[regex, low]

    def has(self, span: Span, regex: str, low: bool = False) -> bool:
        """Whether a match lies in a span."""
        starts, ends = self.matches(regex, low)
        k = bisect_left(starts, span[0])
        while k < len(starts) and starts[k] < span[1]:
            if ends[k] <= span[1]:
                return True
            k += 1
        return False

    def count(self, span: Span, regex: str) -> int:
        starts, _ = self.matches(regex)
        return bisect_left(starts, span[1]) - bisect_left(starts, span[0])

    def node_has(self, node: Node, regex: str) -> bool:
        return self.has((node.start, node.end), regex)

    def scope_has(self, node: Node, regex: str) -> bool:
        """Whether the text of a node's function, in lower case, has a match."""
        return self.has(self.scope(node), regex, low=True)

    @cached_property
    def variables(self) -> dict[str, list[Node]]:
        out: dict[str, list[Node]] = {}
        for v in self.nodes.get("var", ()):
            out.setdefault(v.name, []).append(v)
        return out

    @cached_property
    def calls(self) -> dict[Span, Node]:
        return {(n.start, n.end): n for n in self.nodes.get("call", ())}

    def calls_in(self, span: Span) -> list[Node]:
        """The calls that start in a span, in order of their places."""
        calls = self.nodes.get("call", [])
        return calls[bisect_left(calls, span[0], key=lambda n: n.start) : bisect_left(calls, span[1], key=lambda n: n.start)]

    def option(self, span: Span | None, name: str) -> str | None:
        """The text of a property of the object literal that a span is."""
        value = self.objects.get(span[0], {}).get(name) if span else None
        return None if value is None else self.cut(value)

    def is_object(self, span: Span | None) -> bool:
        return span is not None and self.clean[span[0] : span[0] + 1] == "{" and span[0] in self.objects

    def add(self, kind: str, start: int, end: int, **more) -> Node:
        node = Node(kind, start, end, **more)
        self.nodes.setdefault(kind, []).append(node)
        return node

    # what the text holds

    def _parse(self) -> None:
        whole, pending = self.s, [self.s]
        while pending:
            self.s = pending.pop()
            for hole in self._walk():
                inner = Source(self.text, hole)
                if inner.whole:
                    pending.append(inner)
        self.s = whole
        self.words.sort()
        self._word_starts = [w[0] for w in self.words]
        defaults = {p[0] for f in self.functions for p in f.params}
        if "assign" in self.nodes:
            self.nodes["assign"] = [n for n in self.nodes["assign"] if n.start not in defaults]
        for f in self.functions:
            self.add("function", f.start, f.end, name=f.name, args=f.params, op=f.kind, owner=f)
            for p in f.params:
                self.add("param", *p, owner=f)
        for held in self.nodes.values():
            held.sort(key=lambda n: (n.start, n.end))
        self._routes()
        at = 0
        for line in self.text.split("\n"):
            self.add("line", at, at + len(line))
            at += len(line) + 1

    def _walk(self) -> list[Span]:
        """Nodes of a run of tokens; gives back the substitutions of its template literals."""
        s, t = self.s, self.s.tokens
        inside: list[Span] = []
        for i, (kind, piece, start, end) in enumerate(t):
            if kind == "id":
                if not self._names_only(i):
                    self.words.append((start, piece))
                if piece in ("const", "let", "var") and i + 1 < len(t) and not s.is_(i - 1, ".", "?."):
                    self._declared(i)
                elif piece == "return" and not s.is_(i - 1, ".", "?."):
                    stop = s.ahead(i + 1, (";",)) if i + 1 < len(t) and "\n" not in self.text[end : t[i + 1][2]] else i + 1
                    self.add("return", start, t[max(stop, i + 1) - 1][3], value=s.span(i + 1, stop) if stop > i + 1 else None)
                elif piece == "if" and s.is_(i + 1, "(") and not s.is_(i - 1, ".", "?."):
                    self._condition(i)
                elif i and s.is_(i - 1, ".", "?."):
                    a = s.back(i - 2) if i > 1 else i
                    self.add("member", t[a][2], end, name=piece)
            elif kind in ("str", "tpl"):
                tag = t[i - 1] if i else None
                tagged = kind == "tpl" and tag is not None and tag[0] == "id" and tag[1] not in KEYWORDS and tag[3] == start
                a = s.back(i - 1) if tagged else i
                self.add("tagged" if tagged else "literal", t[a][2], end, name=self.cut(s.span(a, i)) if tagged else "", value=(start + 1, max(start + 1, end - 1)), op=kind)
                if kind == "tpl" and "${" in piece:
                    inside += holes(self.text, start, end)
            elif kind == "op":
                if piece == "(" and i > 0:
                    self._parenthesis(i)
                elif piece == "{" and s.object_(i):
                    self._object(i)
                elif piece == "=" and i > 0:
                    self._assigned(i)
                elif piece == "=>" and i > 0 and t[i - 1][0] == "id":
                    self._arrow(i - 1, i, [(t[i - 1][2], t[i - 1][3])], i - 1)
                elif piece in ("===", "!==", "==", "!=", "||", "??") and i > 0 and i + 1 < len(t):
                    a, stop = s.back(i - 1), s.ahead(i + 1, (",", ";", "?", ":", "&&", "||", "??"))
                    if s.is_(a - 1, "typeof"):
                        a -= 1
                    self.add("binary", t[a][2], t[max(stop, i + 2) - 1][3], receiver=s.span(a, i), value=s.span(i + 1, max(stop, i + 2)), op=piece)
        self._blocks += [(t[i][2], t[j][3]) for i, j in s.pair.items() if i < j and t[i][1] == "{" and t[i][2] not in self.objects]
        for i, (_, piece, start, _) in enumerate(t):
            if piece in ("for", "catch") and s.is_(i + 1, "("):
                k = s.pair[i + 1] + 1
                self._blocks.append((start, t[s.pair[k]][3] if s.is_(k, "{") else t[min(s.ahead(k, (";",)), len(t)) - 1][3]))
        return inside

    def _declared(self, i: int) -> None:
        s, t = self.s, self.s.tokens
        k = s.pair.get(i + 1, i + 1) + 1
        if s.is_(k, ":"):
            while k < len(t) and not s.is_(k, "=", ";", ")", "of", "in"):
                k = (s.pair.get(k, k) if s.is_(k, "(", "[", "{") else k) + 1
        name = s.span(i + 1, s.pair.get(i + 1, i + 1) + 1)
        if s.is_(k, "=") and k + 1 < len(t):
            stop = max(s.ahead(k + 1), k + 2)
            value = s.span(k + 1, stop)
            self.add("var", name[0], value[1], name=self.cut(name), value=value)
            self._values.append((*value, self.cut(name)))
        else:
            self.add("var", *name, name=self.cut(name))

    def _assigned(self, i: int) -> None:
        s, t = self.s, self.s.tokens
        a, stop = s.pair.get(i - 1, i - 1) if s.is_(i - 1, "}") else s.back(i - 1), s.ahead(i + 1)
        if a >= i or i + 1 >= stop or s.is_(a - 1, "const", "let", "var", ":") or t[a][0] == "op" and t[a][1] not in ("{", "["):
            return
        target, value = s.span(a, i), s.span(i + 1, stop)
        self.add("assign", t[a][2], value[1], name=self.cut(target), receiver=target, value=value, op="=")
        self._values.append((*value, self.cut(target).rsplit(".", 1)[-1]))

    def _object(self, i: int) -> None:
        s, t = self.s, self.s.tokens
        held = self.objects.setdefault(t[i][2], {})
        for a, b in s.parts(i):
            if s.is_(a, "..."):
                self.add("spread", t[a][2], t[b - 1][3], value=s.span(a + 1, b))
            elif s.is_(a + 1, ":") and t[a][0] in ("id", "str", "num", "tpl") and a + 2 < b:
                name, value = plain(t[a][1]), s.span(a + 2, b)
                held.setdefault(name, value)
                self.add("prop", t[a][2], value[1], name=name, value=value, owner=t[i][2])
                self._values.append((*value, name))
            elif t[a][0] == "id" and b == a + 1:
                held.setdefault(t[a][1], s.span(a, b))

    def _condition(self, i: int) -> None:
        s, t = self.s, self.s.tokens
        close = s.pair[i + 1]
        if close + 1 >= len(t):
            return
        stop = s.pair[close + 1] + 1 if s.is_(close + 1, "{") else max(s.ahead(close + 1, (";",)), close + 2)
        stop = min(stop, len(t))
        self.add("if", t[i][2], t[stop - 1][3], receiver=s.span(i + 2, close) if close > i + 2 else None, value=s.span(close + 1, stop))

    def _arrow(self, first: int, at: int, params: list[Span], start: int) -> None:
        s, t = self.s, self.s.tokens
        if at + 1 >= len(t):
            return
        block = s.is_(at + 1, "{")
        stop = s.pair[at + 1] + 1 if block else max(s.ahead(at + 1), at + 2)
        stop = min(stop, len(t))
        lead = start - 1 if s.is_(start - 1, "async") else start
        self.functions.append(Function(t[lead][2], t[stop - 1][3], self._goes_to(lead), "arrow", params, s.span(at + 1, stop), bare=not block))

    def _goes_to(self, i: int) -> str:
        """The name of the variable or property that takes the value starting at token i, if any."""
        s = self.s
        if s.is_(i - 1, "=", ":") and i > 1:
            k = i - 2
            return plain(s.tokens[k][1]) if s.tokens[k][0] in ("id", "str") else ""
        return ""

    def _parenthesis(self, i: int) -> None:
        s, t = self.s, self.s.tokens
        end, k = s.pair[i], s.callee(i)
        named, brace = s.named(k), s.body(end)
        arrow = next((j for j in range(end + 1, min(end + 12, len(t))) if s.is_(j, "=>")), None) if s.is_(end + 1, "=>") or s.is_(end + 1, ":") and brace is None else None
        keyword = k if s.is_(k, "function") else k - 1 if s.is_(k - 1, "function") else k - 2 if s.is_(k - 1, "*") and s.is_(k - 2, "function") else None
        method = named and brace is not None and keyword is None and s.is_(k - 1, "{", "}", ";", ",", "async", "public", "private", "protected", "static", "get", "set", "*", "readonly", "override", ")") and not s.is_(end + 1, "=>")
        if brace is not None and (keyword is not None or method):
            first = keyword if keyword is not None else k
            while s.is_(first - 1, "async", "public", "private", "protected", "static", "override") and first:
                first -= 1
            before = first - 1
            kind = "method" if keyword is None else "declaration" if before < 0 or s.is_(before, *STATEMENT_STARTS) or t[before][0] != "op" and not s.is_(before, "return", "typeof", "new", "await") else "expression"
            params = [s.span(*p) for p in s.parts(i)]
            start = first - 1 if s.is_(first - 1, "export") else first - 2 if s.is_(first - 1, "default") and s.is_(first - 2, "export") else first
            name = t[k][1] if named else self._goes_to(first)
            self.functions.append(Function(t[max(start, 0)][2], t[s.pair[brace]][3], name, kind, params, s.span(brace, s.pair[brace] + 1), generic=k != i - 1))
        elif arrow is not None and not named:
            self._arrow(i, arrow, [s.span(*p) for p in s.parts(i)], i)
        elif arrow is not None and s.is_(k, "async"):
            self._arrow(i, arrow, [s.span(*p) for p in s.parts(i)], i)
        elif named or s.is_(k, ")", "]", "?."):
            a = s.back(k if not s.is_(k, "?.") else k - 1)
            made = s.is_(a - 1, "new")
            receiver = s.span(a, k - 1) if named and s.is_(k - 1, ".", "?.") else None
            self.add("new" if made else "call", t[a - made][2], t[end][3], name=t[k][1] if named else "", receiver=receiver, args=[s.span(*p) for p in s.parts(i)], value=s.span(end + 1, min(end + 3, len(t))) if end + 1 < len(t) else None)

    # routes

    def head(self, node: Node) -> str | None:
        """The name at the start of a call's receiver; None for a chain that starts with a test client."""
        m = re.match(r"([A-Za-z_$][\w$]*)\s*(\()?", self.clean[node.start : node.end])
        return None if m is None or m[2] and re.search(V.CLIENT_HEADS, m[1]) else m[1]

    def resolved(self, span: Span) -> Span:
        """The value or function that a bare name stands for, else the span itself."""
        name = self.cut(span)
        if re.fullmatch(r"[A-Za-z_$][\w$]*", name):
            for v in self.variables.get(name, ()):
                return v.value or (v.start, v.end)
            for f in self.functions:
                if f.name == name and f.kind == "declaration":
                    return f.start, f.end
        return span

    def _routes(self) -> None:
        if re.search(V.TEST_FILE, self.file):
            return
        for n in self.nodes.get("call", ()):
            if n.receiver and n.args and n.name.lower() in V.VERBS:
                head = self.head(n)
                if head and re.search(V.ROUTE_HEADS, head):
                    path = re.sub(r"^['\"`]|['\"`]$", "", self.arg(n, 0))
                    if path:
                        route = self.add("route", n.start, n.end, name=path, args=[self.resolved(a) for a in n.args[1:-1]], value=self.resolved(n.args[-1]), owner=n)
                        for a in n.args[1:-1]:
                            config = self._limiter(self.resolved(a))
                            if config is not None:
                                self.add("limiter", n.start, n.end, name=path, owner=(route, config))

    def _limiter(self, span: Span) -> dict | None:
        """What a middleware says of its rate limit; None if it isn't a limiter."""
        call = self.calls.get(span)
        if call is not None:
            if not re.search(V.LIMITER_NAME, call.name):
                return None
            span_ = next((a for a in call.args if self.is_object(a)), None)
            if span_ is None:
                return {}
        elif self.is_object(span):
            span_ = span
        else:
            return None
        key, store = (self.option(span_, "keyGenerator") or "").lower(), (self.option(span_, "store") or "").lower()
        return {
            "max": number(self.option(span_, "max")), "window": number(self.option(span_, "windowMs")), "by_address": re.search(V.ADDRESS_KEY, key) is not None, "trusted": re.search(V.TRUSTED_KEY, key) is not None,
            "memory": re.search(V.MEMORY_STORE, store or self.cut(span).lower()) is not None, "shared": re.search(V.SHARED_STORE, store) is not None,
        }

    def route_text(self, route: Node) -> str:
        """A route with its middlewares and handler in place of their names."""
        return "\n".join([self.of(route), *map(self.cut, route.args), self.cut(route.value)])

    # what comes from a request

    @cached_property
    def _scopes(self):
        spans = {*self._blocks, *((f.start, f.end) for f in self.functions)}
        return innermost([(a, b, (a, b)) for a, b in spans])

    def _spread_taint(self) -> None:
        self.sources = [(m.start(), m.end()) for m in re.finditer(V.UNTRUSTED, self.clean)]
        self._source_starts = [a for a, _ in self.sources]
        names = [re.escape(k) for k, (_, _, taints) in self.symbols.items() if taints and "." not in k]
        self._imported = [m.start() for m in re.finditer(rf"(?<![\w$.])(?:{'|'.join(names)})\s*\(", self.clean)] if names else []
        whole = (0, len(self.text) + 1)
        self.declarations: dict[str, list[tuple[Span, int]]] = {}  # scopes of the declarations of a name
        self.tainted: set[int] = set()
        self._bad: set[str] = set()
        self._visible: dict[str, object] = {}
        self.names: list[str] = []
        cleaned: set[int] = set()

        def declare(name: str, scope: Span) -> int:
            self.names.append(name)
            self.declarations.setdefault(name, []).append((scope, len(self.names) - 1))
            return len(self.names) - 1

        variables = []
        for v in self.nodes.get("var", ()):
            scope = self._scopes(v.start) or whole
            variables.append((v, [declare(name, scope) for name in bound(v.name)]))
        seeds, firsts = [], {}
        for f in self.functions:
            for k, p in enumerate(f.params):
                text = self.cut(p)
                for name in bound(re.sub(r"^(?:@[\w.]+(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?\s*)+", "", text)):
                    d = declare(name, (f.start, f.end))
                    if text[:1] == "@" and re.search(V.DECORATORS, text) or k == 1 and name in V.RESOLVER_ARGS and self._resolves(f):
                        seeds.append(d)
                    elif k == 0 and f.kind in ("arrow", "expression") and name == text.split(":")[0].strip():
                        firsts.setdefault(f.start, d)
        for n in self.nodes.get("call", ()):
            if n.receiver and n.args and re.search(V.CONSUMERS, n.name) and n.args[-1][0] in firsts:
                seeds.append(firsts[n.args[-1][0]])
        self._taint(seeds)
        summaries = self._summaries()
        for v, ds in variables:
            if v.value and (self.has_source(v.value) or self._returns_request(v.value)):
                self._taint(ds)
        for n in self.nodes.get("assign", ()):
            if re.fullmatch(r"[A-Za-z_$][\w$]*", n.name) and self.has_source(n.value):
                d = self.resolve(n.name, n.start)
                if d is not None:
                    self._taint([d])
        calls = self.calls
        for v, ds in variables:
            if not v.value:
                continue
            call = calls.get(v.value) or calls.get((v.value[0] + len("await "), v.value[1]) if self.clean.startswith("await ", v.value[0]) else v.value)
            if call is not None and (self._validates(call) or re.search(V.ONE_WAY, call.name)):
                cleaned.update(ds)
                self.tainted.difference_update(ds)
            elif self.reaches(v.value):
                self._taint(ds)
        for _ in range(V.LOCAL_CALL_PASSES):
            changed = False
            for v, ds in variables:
                call = calls.get(v.value) if v.value else None
                if call is None or not ds or self.tainted.issuperset(ds) or cleaned.issuperset(ds):
                    continue
                if any(untrusted or any(k < len(call.args) and self.reaches(call.args[k]) for k in passed) for untrusted, passed in summaries.get(call.name, ())):
                    self._taint(ds)
                    changed = True
            if not changed:
                break
        # from here on a span is asked for by two sums
        self._sums, total = [0], 0
        for start, name in self.words:
            total += name in self._bad and self.resolve(name, start) in self.tainted
            self._sums.append(total)

    def words_in(self, span: Span) -> slice:
        return slice(bisect_left(self._word_starts, span[0]), bisect_left(self._word_starts, span[1]))

    def has_source(self, span: Span | None) -> bool:
        """Whether the text itself reads a request."""
        if not span:
            return False
        k = bisect_left(self._source_starts, span[0])
        return k < len(self.sources) and self.sources[k][1] <= span[1]

    def _names_only(self, i: int) -> bool:
        """Whether the name at token i is that of a property or of a key, not of a value."""
        s = self.s
        return s.is_(i - 1, ".", "?.") or s.is_(i + 1, ":") and s.is_(i - 1, "{", ",")

    def resolve(self, name: str, at: int) -> int | None:
        """The declaration of a name that is seen from a place: the first of the innermost scope around it, else the first of all."""
        if name not in self._visible:
            found = {}
            for scope, d in self.declarations.get(name, ()):
                found.setdefault(scope, d)
            self._visible[name] = innermost([(*scope, d) for scope, d in found.items()])
        seen = self._visible[name](at)
        return seen if seen is not None else self.declarations[name][0][1] if name in self.declarations else None

    def _taint(self, declarations: list[int]) -> None:
        self.tainted.update(declarations)
        self._bad.update(self.names[d] for d in declarations)

    def reaches(self, span: Span) -> bool:
        """Whether request data is in a span, by what is known so far."""
        if self.has_source(span):
            return True
        return any(name in self._bad and self.resolve(name, start) in self.tainted for start, name in self.words[self.words_in(span)])

    def dirty(self, span: Span | None) -> bool:
        """Whether request data is in a span: read there, held by a name that is declared so, or returned by an imported function."""
        if not span:
            return False
        r = self.words_in(span)
        return self.has_source(span) or self._sums[r.stop] > self._sums[r.start] or self._returns_request(span)

    def _returns_request(self, span: Span) -> bool:
        """Whether an imported function that returns request data is called in a span."""
        k = bisect_left(self._imported, span[0])
        return k < len(self._imported) and self._imported[k] < span[1]

    def user_controlled(self, span: Span | None) -> bool:
        """Whether a span reads a request, or is the name of a variable whose value does."""
        if not span:
            return False
        if self.has(span, V.USER_CONTROLLED):
            return True
        text = self.cut(span)
        return re.fullmatch(r"[A-Za-z_$][\w$]*", text) is not None and any(v.value and self.has(v.value, V.USER_CONTROLLED) for v in self.variables.get(text, ()))

    def _summaries(self) -> dict[str, list[tuple[bool, set[int]]]]:
        """By name of a function: whether it returns request data, and which of its parameters it returns."""
        named = [f for f in self.functions if f.name and f.kind in ("declaration", "method", "arrow", "expression")]
        by_function: dict[int, list[Span]] = {}
        for n in self.nodes.get("return", ()):
            f = self._function_of(n.start)
            if f is not None and n.value:
                by_function.setdefault(id(f), []).append(n.value)
        out: dict[str, list[tuple[bool, set[int]]]] = {}
        for f in named:
            returned = [f.body] if f.bare else by_function.get(id(f), [])
            words = {name for r in returned for _, name in self.words[self.words_in(r)]}
            passed = {k for k, p in enumerate(f.params) if (m := re.match(r"[A-Za-z_$][\w$]*", self.cut(p))) and m[0] in words}
            out.setdefault(f.name, []).append((any(self.has_source(r) for r in returned), passed))
        return out

    def _resolves(self, f: Function) -> bool:
        """Whether a function stands under a key of resolvers."""
        return any(n.name in V.RESOLVER_KEYS and n.value[0] <= f.start and f.end <= n.value[1] for n in self.nodes.get("prop", ()))

    def _validates(self, call: Node) -> bool:
        if call.receiver:
            if self.receiver(call) == "JSON" or self.reaches(call.receiver):
                return False
            if re.search(V.VALIDATORS, call.name):
                return True
        return re.search(V.VALIDATOR_LIBRARIES, self.callee(call)) is not None

    # imports

    def exported(self, call: Node) -> str:
        """The name that a call's function has where it comes from."""
        builtin = self.builtin(call)
        if builtin:
            return builtin[1]
        if not call.receiver and call.name in self.imports:
            return self.imports[call.name][1]
        return call.name

    def builtin(self, call: Node) -> tuple[str, str] | None:
        """The module and name of a dangerous built-in that a call comes down to, over re-exports."""
        receiver = self.receiver(call)
        if not receiver:
            local = self.symbols.get(call.name) or (*self.imports.get(call.name, ("", "")), False)
        else:
            local = self.symbols.get(f"{receiver}.{call.name}") or ((self.imports[receiver][0], call.name, False) if receiver in self.imports else None)
        return (local[0], local[1]) if local and local[1] in V.BUILTINS.get(local[0].removeprefix("node:"), ()) else None

    def sink(self, call: Node) -> str:
        """A call's name as sinks are told by: module and exported name of an import, else receiver and name."""
        builtin = self.builtin(call)
        if builtin:
            return ".".join(builtin)
        receiver = self.receiver(call)
        if not receiver and call.name in self.imports:
            return ".".join(self.imports[call.name])
        if receiver in self.imports:
            return f"{self.imports[receiver][0]}.{call.name}"
        return f"{receiver}.{call.name}" if receiver else call.name


def number(text: str | None) -> float | None:
    """The value of an expression of numbers, + - * / and parentheses; None for anything else."""
    if not text or not re.fullmatch(r"[\d\s._()+*/-]+", text):
        return None
    pieces = re.findall(r"\d[\d_.]*|[()+*/-]", text)

    def term(k: int) -> tuple[float | None, int]:
        if k >= len(pieces):
            return None, k
        if pieces[k] in "+-":
            x, k2 = term(k + 1)
            return None if x is None else -x if pieces[k] == "-" else x, k2
        if pieces[k] == "(":
            x, k2 = total(k + 1)
            return x, k2 + 1
        try:
            return float(pieces[k].replace("_", "")), k + 1
        except ValueError:
            return None, k + 1

    def product(k: int) -> tuple[float | None, int]:
        x, k = term(k)
        while k < len(pieces) and pieces[k] in "*/":
            y, k2 = term(k + 1)
            x = None if x is None or y is None or pieces[k] == "/" and y == 0 else x * y if pieces[k] == "*" else x / y
            k = k2
        return x, k

    def total(k: int) -> tuple[float | None, int]:
        x, k = product(k)
        while k < len(pieces) and pieces[k] in "+-":
            y, k2 = product(k + 1)
            x = None if x is None or y is None else x + y if pieces[k] == "+" else x - y
            k = k2
        return x, k

    return total(0)[0]


def bound(pattern: str) -> list[str]:
    """The names that a declaration's pattern binds."""
    pattern = pattern.strip().removeprefix("...")
    pattern = re.sub(r"^(?:(?:public|private|protected|readonly)\s+)+", "", pattern)
    if pattern[:1] not in ("{", "["):
        m = re.match(r"[A-Za-z_$][\w$]*", pattern)
        return [m[0]] if m else []
    inner = pattern[1 : pattern.rfind("}" if pattern[0] == "{" else "]")]
    out, depth, part = [], 0, ""
    for c in [*inner, ","]:
        if c == "," and not depth:
            target = re.split(r":(?!:)", part, maxsplit=1)[-1] if pattern[0] == "{" and not part.strip().startswith("...") else part
            out += bound(target.split("=")[0]) if target.strip() else []
            part = ""
        else:
            depth += (c in "{[(") - (c in "}])")
            part += c
    return out


def innermost(ranges: list[tuple]):
    """Looks up the third part of the innermost range (start, end, what) that holds a place; ranges are nested or apart."""
    events = sorted([(a, 1, -b, k) for k, (a, b, _) in enumerate(ranges) if b > a] + [(b, 0, -a, k) for k, (a, b, _) in enumerate(ranges) if b > a])
    places, tops, stack = [], [], []
    gone: set[int] = set()
    for at, opens, _, k in events:
        if opens:
            stack.append(k)
        else:
            gone.add(k)
        while stack and stack[-1] in gone:
            stack.pop()
        places.append(at)
        tops.append(ranges[stack[-1]][2] if stack else None)
    return lambda at: tops[k - 1] if (k := bisect_right(places, at)) else None


# tables


def source_files(spark: SparkSession, path: str, pattern: str = V.NAMES, ignored: list[str] | None = None) -> DataFrame:
    """file, content, size of the source files under a folder, or of one file, to which no rule of exclusion applies.  Contents are never sorted; reports are.

    Left out are generated files and folders, tests and reports unless the folder itself is inside one, and
    what ``ignored`` (patterns of ignore files, later ones winning) names.  Files over LARGEST keep a null content.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    one = re.search(r"\.(?:ts|tsx|js|mjs|cjs|jsx)$", path) is not None
    raw = raw.load(path) if one else raw.option("pathGlobFilter", pattern).load(path)
    if not one:
        root = re.sub(r"^file:/*", "/", path).rstrip("/")
        inside = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(root) + "/", "")
        scoped = [d for d in V.SCOPED_OUT if d not in root.split("/")]
        raw = raw.where(~inside.rlike(V.LEFT_OUT) & ~inside.rlike(rf"(?:^|/)(?:{'|'.join(scoped) or '(?!)'})/"))
        if ignored:
            raw = raw.where(~is_ignored(inside, ignored))
    return raw.select(F.col("path").alias("file"), F.when(F.col("length") <= V.LARGEST, F.col("content").cast("string")).alias("content"), F.col("length").alias("size"))


def is_ignored(path, patterns: list[str]):
    """Whether a relative path is ignored by patterns of the ignore-file kind: ``*``, ``**``, ``?``, a leading ``/``, a closing ``/``, ``!`` to take back."""
    out = F.lit(False)
    for p in patterns:
        p = p.rstrip("\n").rstrip()
        if not p or p[0] == "#":
            continue
        back, p = p[0] == "!", p.removeprefix("!")
        folder, p = p.endswith("/"), p.rstrip("/")
        rooted, p = "/" in p, p.lstrip("/")
        regex = re.sub(r"\\\*\\\*/", "(?:.*/)?", re.escape(p)).replace(r"/\*\*", "/.*").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        hit = path.rlike(("^" if rooted else "(?:^|/)") + regex + ("/" if folder else "(?:/|$)"))
        out = F.when(hit, F.lit(not back)).otherwise(out)
    return out


def issues(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """file, type, severity: files too large, and files whose brackets don't match."""
    large = files.where(F.col("size") > V.LARGEST).select("file", F.lit("INVALID_TARGET").alias("type"), F.lit("WARNING").alias("severity"))
    return large.unionByName(nodes.where("kind = 'issue'").select("file", F.lit("PARSE_FAILURE").alias("type"), F.lit("ERROR").alias("severity")))


NODES = pa.schema([("file", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("receiver", pa.string()), ("n_args", pa.int32()), ("tainted_args", pa.list_(pa.int32())), ("context", pa.string()), ("function", pa.string()), ("snippet", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("line", pa.int32()), ("column", pa.int32())])
#: Characters of a snippet from its place on, and more on either side.
SNIPPET, AROUND = 50, 10
#: Characters of a node's receiver, context and name that a row shows; the places give the whole.
SHOWN = 120


def rows_of(file: str, text: str) -> list[dict]:
    """The nodes of a file as rows of fixed size; lines are left out."""
    u = Unit(file, text)
    if not u.s.whole:
        return [{"file": file, "kind": "issue", "name": "", "receiver": "", "n_args": 0, "tainted_args": [], "context": "", "function": "", "snippet": "", "start": 0, "stop": 0, "line": 1, "column": 1}]
    out = []
    for kind, nodes in u.nodes.items():
        for n in nodes if kind != "line" else ():
            f = u.function(n)
            line, column = u.s.line(n.start)
            out.append({"file": file, "kind": kind, "name": n.name[:SHOWN], "receiver": u.receiver(n)[:SHOWN], "n_args": len(n.args), "tainted_args": [k for k, a in enumerate(n.args) if u.dirty(a)], "context": u.context(n)[:SHOWN], "function": f.name[:SHOWN] if f else "", "snippet": u.snippet(n.start), "start": n.start, "stop": n.end, "line": line, "column": column})
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if content:
                yield pa.RecordBatch.from_pylist(rows_of(file, content), schema=NODES)


def nodes(files: DataFrame) -> DataFrame:
    """One row a node."""
    schema = "file string, kind string, name string, receiver string, n_args int, tainted_args array<int>, context string, function string, snippet string, start int, stop int, line int, column int"
    return files.select("file", "content").where("content is not null").mapInArrow(_rows, schema)
