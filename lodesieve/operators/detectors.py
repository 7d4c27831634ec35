"""What is wrong in source files: conditions on nodes, tested where a file is parsed, in one pass without a shuffle.

A detector is a rule, the kinds of node that it looks at, and a condition on a node and its file.  A condition
answers yes or no, or gives the node to report instead.  Only findings leave the worker, so a file's
rows are as many as its findings, whatever its size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesieve.functions import rules as R
from lodesieve.functions import vocabulary as V
from lodesieve.operators import report
from lodesieve.operators import scan as S
from lodesieve.sources.code import Node, Unit, plain

_compiled: dict[str, re.Pattern] = {}


def has(regex: str, text: str) -> bool:
    p = _compiled.get(regex)
    if p is None:
        p = _compiled[regex] = re.compile(regex)
    return p.search(text) is not None


Test = Callable[[Unit, Node], "bool | Node | None"]


@dataclass(frozen=True)
class Detector:
    rule: str
    kinds: tuple[str, ...]
    holds: Test
    severity: Callable[[Unit, Node], str] | str | None = None  #: default: the rule's
    confidence: Callable[[Unit, Node], str] | str | None = None  #: default: the rule's
    cut: int | None = 120  #: characters of code that a finding shows; None: all
    shown: Callable[[Unit, Node], str] | None = None  #: the code that a finding shows; default: the node's text
    once: bool = False  #: one finding a line
    names: str | None = None  #: a pattern that a node's name must match, asked once a name


# texts


def built(u: Unit, span: tuple[int, int]) -> bool:
    """A template with a substitution, or a sum with a string."""
    text = u.cut(span)
    return has(r"^`[^`]*\$\{", text) or has(r"['\"`]\s*\+|\+\s*['\"`]", text)


def sql_text(u: Unit, span: tuple[int, int]) -> bool:
    """SQL put together in place, or in the variable that the span names."""
    if built(u, span) and has(V.SQL_WORDS, u.cut(span)):
        return True
    name = u.cut(span)
    if not re.fullmatch(r"[A-Za-z_$][\w$]*", name):
        return False
    return any(v.value and built(u, v.value) and has(V.SQL_WORDS, u.cut(v.value)) for v in u.variables.get(name, ()))


def string_of(u: Unit, span: tuple[int, int] | None) -> str | None:
    """What a quoted string says; None if the span is anything else."""
    text = u.cut(span)
    return text[1:-1] if re.fullmatch(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", text) else None


def parent_of(u: Unit, n: Node) -> str:
    """What a literal is the direct value of: var, assign, prop or nothing."""
    for kind in ("var", "assign", "prop"):
        if (n.start, n.end) in _values(u, kind):
            return kind
    return ""


def _values(u: Unit, kind: str) -> dict:
    held = u._seen.get(("values", kind))
    if held is None:
        held = u._seen["values", kind] = {n.value: n for n in u.nodes.get(kind, ()) if n.value}
    return held


def described(u: Unit, n: Node) -> bool:
    """A literal inside a field of report texts, or an import's or export's module."""
    if has(r"(?:\bfrom|\bimport)\s*$", u.clean[max(0, n.start - 12) : n.start]):
        return True
    return parent_of(u, n) == "prop" and _values(u, "prop")[n.start, n.end].name in V.METADATA_FIELDS


def label_like(text: str) -> bool:
    """A constant's name or a path."""
    return has(r"^[A-Z][A-Z0-9_]+$", text) or "/" in text or "\\" in text or text.startswith(".")


def classes(text: str) -> int:
    return sum(has(c, text) for c in ("[a-z]", "[A-Z]", r"\d", r"[_./+=-]"))


def secret_value(text: str) -> bool:
    """Whether a value looks like a key, by its characters."""
    if len(text) < 12 or has(r"\s", text) or has(V.SENTINEL_KEY, text):
        return False
    if not has(r"\d", text) and (has(V.LABEL_PAIR, text) or has(V.HEADER_NAME, text)) or has(V.X_HEADER, text):
        return False
    if has(r"^[A-Fa-f0-9]{24,}$", text) or classes(text) >= 3 and (has(r"\d", text) or len(text) >= 20):
        return True
    return has(r"[A-Za-z0-9._+=/-]{20,}", text) and has(r"\d", text)


def real_secret(text: str) -> bool:
    """The same for a variable that is named like a credential: shorter values count."""
    if len(text) < 8 or has(V.SENTINEL_SECRET, text) or has(V.X_HEADER, text):
        return False
    if not has(r"\d", text) and (has(V.LABEL_WORDS, text) or has(V.HEADER_NAME, text)):
        return False
    mixed = sum(has(c, text) for c in ("[a-z]", "[A-Z]", r"\d", r"[._+=/-]"))
    return has(r"^[A-Fa-f0-9]{16,}$", text) or has(r"^[A-Za-z0-9+/]{20,}={0,2}$", text) or mixed >= 3 and len(text) >= 12 and (has(r"\d", text) or len(text) >= 20)


def service_key(text: str) -> bool:
    return any(has(k, text) for k in V.SERVICE_KEYS)


def inline_key(text: str) -> bool:
    m = re.search(V.INLINE_CREDENTIAL, text)
    return m is not None and secret_value(m[1])


def owned(text: str) -> bool:
    return has(V.IDENTITY, text) and has(V.RESOURCE, text) and has(V.DECISION, text)


def authorized(text: str) -> bool:
    return owned(text) or has(V.AUTHENTICATED, text) and has(V.AUTHORIZED, text)


def scope_owned(u: Unit, n: Node) -> bool:
    return all(u.scope_has(n, x) for x in (V.IDENTITY, V.RESOURCE, V.DECISION))


def any_dirty(u: Unit, n: Node) -> bool:
    return any(u.dirty(a) for a in n.args)


def dirty(u: Unit, n: Node, k: int) -> bool:
    return -len(n.args) <= k < len(n.args) and u.dirty(n.args[k])


def unchecked(u: Unit, n: Node) -> bool:
    """No word of validation in the node's function."""
    return not u.scope_has(n, V.BOUNDARY)


def line_of(u: Unit, n: Node) -> str:
    a = u.text.rfind("\n", 0, n.start) + 1
    b = u.text.find("\n", n.start)
    return u.text[a : b if b >= 0 else len(u.text)]


def handler_text(u: Unit, n: Node) -> str:
    """The text of the function that is a call's last argument, written there or named."""
    if not n.args:
        return ""
    span = u.resolved(n.args[-1])
    return u.cut(span) if any((f.start, f.end) == span for f in u.functions) else ""


def in_then(u: Unit, n: Node, scope: tuple[int, int]) -> bool:
    return any(x.value[0] <= n.start < x.value[1] and scope[0] <= x.start for x in u.nodes.get("if", ()))


# conditions of more than a line


def jwt(u: Unit, n: Node, verb: str) -> bool:
    return n.name == verb and u.receiver(n) in ("jwt", "JWT")


def cookie(u: Unit, n: Node) -> bool:
    return n.name == "cookie" and has(r"(?i)\b(?:res|response|reply)\b", u.receiver(n))


def session_cookie(u: Unit, n: Node) -> bool:
    return cookie(u, n) and has(V.SESSION_COOKIE, plain(u.arg(n, 0)))


def session(u: Unit, n: Node) -> bool:
    return has("(?i)^(?:session|cookieSession)$", n.name) and bool(n.args) and u.is_object(n.args[0])


def cookie_option(u: Unit, n: Node, name: str) -> str | None:
    """An option of a cookie, in the third argument, or of a session's cookie; None where it is missing."""
    if cookie(u, n):
        return u.option(n.args[2], name) if len(n.args) > 2 else None
    if has("(?i)^session$", n.name):
        value = u.objects.get(n.args[0][0], {}).get("cookie")
        return u.option(value, name)
    return u.option(n.args[0], name)


def no_http_only(u: Unit, n: Node) -> bool:
    if not (cookie(u, n) or session(u, n)):
        return False
    value = cookie_option(u, n, "httpOnly")
    return value == "false" or value is None and session_cookie(u, n)


def bad_cookie(name: str, bad: str) -> Test:
    def holds(u: Unit, n: Node) -> bool:
        if not (session_cookie(u, n) or session(u, n)):
            return False
        value = cookie_option(u, n, name)
        return value is None or has(bad, value)

    return holds


def explicit(name: str, bad: str) -> Callable[[Unit, Node], str]:
    return lambda u, n: "FIRM" if has(bad, cookie_option(u, n, name) or "") else "TENTATIVE"


def sensitive(u: Unit, n: Node) -> bool:
    handler = u.cut(n.value)
    return has(V.SENSITIVE_PATH, n.name) or has(V.SENSITIVE_HANDLER, handler) and has(V.MUTATION, handler)


def request_token(u: Unit, n: Node) -> bool:
    return n.name == "token" and u.scope_has(n, V.REQUEST_TOKEN) and not u.scope_has(n, V.TOKEN_VERIFIED)


def secret_literal(u: Unit, n: Node) -> bool:
    text = u.cut(n.value)
    low = text.lower()
    if n.op != "str" or len(text) < 12 or not any(w in low for w in ("secret", "password", "key")) or described(u, n) or label_like(text) or any(p in low for p in V.SCANNER_PHRASES):
        return False
    return (has(r"[0-9a-fA-F]{8,}", low) or has(r"[A-Za-z0-9_\-.]{16,}", low)) and parent_of(u, n) != ""


def secret_variable(u: Unit, n: Node) -> bool:
    if has(V.TEST_FILE, u.file) or not has(V.CREDENTIAL_NAME, n.name) or n.name[:1] in "{[":
        return False
    value = string_of(u, n.value)
    if value is None or label_like(value):
        return False
    if has("(?i)password|passwd|pwd", n.name):
        return len(value) >= 4 and not has(V.SENTINEL_PASSWORD, value)
    return real_secret(value)


def weak_jwt_secret(u: Unit, n: Node) -> bool:
    value = string_of(u, n.value)
    return value is not None and len(value) < V.JWT_LEAST and n.name[:1] not in "{[" and has(V.JWT_NAME, n.name) and has(V.JWT_USED, u.text)


def sql_sink(u: Unit, n: Node) -> bool:
    return has(V.SQL_CALL, u.exported(n)) and has(V.DATABASE, u.receiver(n)) and any(sql_text(u, a) and u.dirty(a) for a in n.args) and unchecked(u, n)


def raw_sql(u: Unit, n: Node) -> bool:
    return has(V.RAW, n.name) and has(V.MAPPER, u.receiver(n)) and bool(n.args) and built(u, n.args[0]) and dirty(u, n, 0) and unchecked(u, n)


def search_sink(u: Unit, n: Node) -> bool:
    return n.name.lower() == "search" and has(V.SEARCH_RECEIVER, u.receiver(n)) and any(has(V.SEARCH_TERMS, u.cut(a)) for a in n.args) and any_dirty(u, n) and unchecked(u, n)


def process_sink(u: Unit, n: Node) -> bool:
    return has(V.PROCESS, u.exported(n)) and not u.receiver(n).startswith("/") and any_dirty(u, n) and unchecked(u, n) and not has(V.DATABASE, u.receiver(n))


def code_sink(u: Unit, n: Node) -> bool:
    name = u.exported(n) if n.kind == "call" else n.name
    timer = n.name in ("setTimeout", "setInterval") and has(r"^['\"`]", u.arg(n, 0))
    return (has("(?i)^eval$", name) or name == "Function" or timer) and any_dirty(u, n) and unchecked(u, n)


def nosql_sink(u: Unit, n: Node) -> bool:
    return has(V.NOSQL, n.name) and n.receiver is not None and has(V.MODEL, u.receiver(n)) and dirty(u, n, 0) and not built(u, n.args[0]) and not has(V.NOSQL_SAFE, u.arg(n, 0)) and unchecked(u, n)


def template_sink(u: Unit, n: Node) -> bool:
    return has(V.TEMPLATE_CALL, n.name) and (has(V.ENGINES, u.receiver(n)) or n.name.lower() == "renderstring") and dirty(u, n, 0) and unchecked(u, n)


def gadget(u: Unit, n: Node) -> bool:
    return (has(V.GADGETS, u.callee(n)) or n.name == "constructor") and any_dirty(u, n) and unchecked(u, n)


def logger(u: Unit, n: Node) -> bool:
    return has(V.LOG_VERBS, n.name) and n.receiver is not None and has(V.LOG_NAMES, u.receiver(n))


def sensitive_log(u: Unit, n: Node) -> bool:
    return logger(u, n) and any(has(V.SENSITIVE_LOG, re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", " ", u.cut(a))) for a in n.args)


def logged_request(u: Unit, n: Node) -> bool:
    return logger(u, n) and any(has(r"^`[^`]*\$\{[^}]*" + V.LOGGED_REQUEST, u.cut(a)) for a in n.args)


def raw_request(u: Unit, span: tuple[int, int]) -> bool:
    text = u.cut(span)
    return has(V.RAW_REQUEST, text) or any(has(V.RAW_REQUEST, u.cut(v.value)) for v in u.variables.get(text, ()))


def field_from_user(u: Unit, n: Node) -> bool:
    m = re.fullmatch(r"(?s)(.+)\??\.([\w$]+)", n.name)
    return m is not None and not has(V.REQUEST_OBJECT, m[1]) and u.user_controlled(n.value)


def copies_all(u: Unit, n: Node) -> bool:
    text = u.of(n)
    return n.op == "declaration" and any(w in text for w in V.COPY_WORDS) and not any(w in text for w in V.ALLOW_WORDS)


def body_to_service(u: Unit, n: Node) -> bool:
    receiver = u.receiver(n)
    if not receiver or not has(V.SAVE_VERB, n.name) or not (has(V.SAVE_RECEIVER, receiver) or has(r"^[A-Z][A-Za-z]*$", receiver.rsplit(".", 1)[-1])):
        return False
    around = u.cut(u.scope(n))
    return any(has(V.RAW_BODY, u.cut(a)) for a in n.args) and not any(has(x, around) for x in (V.BODY_VALIDATED, V.BODY_PICKED, V.BODY_CHOSEN))


def dynamic_key(u: Unit, n: Node) -> bool:
    m = re.search(r"(?s)\[(.*)\]$", n.name)
    if not m or has(r"^['\"`\d]", m[1]):
        return False
    span = (n.receiver[0] + m.start(1), n.receiver[0] + m.end(1))
    return u.user_controlled(span) and not u.scope_has(n, V.PROTOTYPE_GUARD)


def user_merge(u: Unit, n: Node) -> bool:
    return has(V.MERGES, n.name) and any(map(u.user_controlled, n.args)) and not u.scope_has(n, V.PROTOTYPE_GUARD)


def id_access(u: Unit, n: Node) -> bool:
    if not (named_id(n.name) or loose_id(n.name)) or not has(V.ID_ACCESS, u.of(n)):
        return False
    return u.scope_has(n, V.LOOKUP_WORDS) and not scope_owned(u, n)


def named_id(name: str) -> bool:
    return name != "id" and has(r"(?:_id|Id|ID)$", name)


def loose_id(name: str) -> bool:
    return name == "id" or has(r"^[a-z][a-z]*id$", name) and name not in V.NOT_IDS


def unowned_query(u: Unit, n: Node) -> bool:
    a, b = u.scope(n)
    return has(V.QUERY_NAME, n.name) and any(map(u.user_controlled, n.args)) and "owner" not in u.of(n).lower() and b - a > 20 and not scope_owned(u, n)


def unguarded_privilege(u: Unit, n: Node) -> bool:
    return n.op == "declaration" and has(V.PRIVILEGED_NAME, n.name) and not n.owner.generic and u.node_has(n, V.PRIVILEGED_BODY) and not authorized(u.of(n))


def direct_lookup(u: Unit, n: Node) -> bool:
    return has(V.DIRECT_LOOKUP, n.name) and bool(n.args) and u.user_controlled(n.args[0])


def service_lookup(u: Unit, n: Node) -> bool:
    base = u.receiver(n).removeprefix("this.")
    if not base or not n.args or not has(V.SERVICE_RECEIVER, base) or not has(V.SERVICE_VERB, n.name) or has(V.DIRECT_LOOKUP_NAME, n.name):
        return False
    return u.user_controlled(n.args[0]) and not any(has(V.OWNER_CONTEXT, u.cut(a)) for a in n.args) and not scope_owned(u, n)


def limited_path(path: str) -> bool:
    return any(path.startswith(p) for p in V.LIMITED_PATHS)


def unlimited(u: Unit, n: Node) -> bool:
    return limited_path(n.name) and not any(x.owner[0] is n for x in u.nodes.get("limiter", ()))


def spoofable(config: dict) -> bool:
    return config.get("by_address", False) and not config["trusted"]


def first_spoofable(u: Unit, n: Node) -> bool:
    route, config = n.owner
    return spoofable(config) and not any(x.owner[0] is route and x.start == n.start and spoofable(x.owner[1]) for x in u.nodes["limiter"][: u.nodes["limiter"].index(n)])


def weak_limit(u: Unit, n: Node) -> bool:
    c = n.owner[1]
    return has(V.HIGH_RISK_PATH, n.name) and bool(c.get("max")) and bool(c.get("window")) and not spoofable(c) and c["max"] * 60_000 / c["window"] > V.MOST_PER_MINUTE


def local_store(u: Unit, n: Node) -> bool:
    c = n.owner[1]
    return limited_path(n.name) and c.get("memory", False) and not c["shared"]


def race(u: Unit, n: Node) -> bool:
    if n.op not in ("declaration", "arrow", "expression"):
        return False
    return u.count((n.start, n.end), r"await\s+") >= 2 and u.node_has(n, "update|UPDATE") and not u.node_has(n, "|".join(V.BL_LOCKS)) and bool(u.matches(V.BL_ASYNC)[0]) and has(r"(?s)await.*?;.*?await", u.clean)


def payment_route(u: Unit, n: Node) -> bool:
    return has(V.PAYMENT_ROUTE, f"{n.name}\n{u.cut(n.value)}".lower())


def payment_calls(u: Unit, n: Node) -> Iterator[Node]:
    for x in u.calls_in(n.value):
        callee = u.callee(x).lower()
        if has(V.PAYMENT_CALL, callee) or has(V.PAYMENT_WORD, callee) and x.args:
            yield x


def no_idempotency(u: Unit, n: Node) -> Node | None:
    return next(payment_calls(u, n), None) if payment_route(u, n) and not has(V.IDEMPOTENT, u.route_text(n).lower()) else None


def client_price(u: Unit, n: Node) -> Node | None:
    if not payment_route(u, n):
        return None
    for call in payment_calls(u, n):
        for a in call.args:
            if u.is_object(a):
                amounts = [v for k, v in u.objects[a[0]].items() if has(V.AMOUNT_KEY, k.lower())]
            else:
                amounts = [a] if has(V.AMOUNT_ARGUMENT, u.cut(a).lower()) else []
            for span in amounts:
                if u.dirty(span) or u.user_controlled(span):
                    return Node("amount", *span)
    return None


def funds_check(u: Unit, n: Node) -> bool:
    condition, then = u.cut(n.receiver).lower(), u.cut(n.value).lower()
    return any(w in condition for w in V.FUNDS_WORDS) and has("[<>]", condition) and any(w in then for w in V.FUNDS_ACTS) and not has("transaction|lock", u.of(n))


def check_then_act(u: Unit, n: Node) -> Node | None:
    """The first change of a stock or balance, outside any then-branch, after it was read or compared."""
    scope = (n.start, n.end)
    if not u.node_has(n, V.STOCKED) or u.node_has(n, V.ATOMIC):
        return None
    calls = [(x, u.of(x)) for x in u.calls_in(scope)]
    checks = [x.start for x in u.nodes.get("if", ()) if scope[0] <= x.start < scope[1] and has(V.STOCKED, u.cut(x.receiver)) and has("[<>]", u.cut(x.receiver))]
    checks += [x.start for x, t in calls if has(V.STOCKED, t) and has(V.STOCK_READ, t) and not has(V.STOCK_ACT, t)]
    acts = [x for x, t in calls if checks and x.start > min(checks) and has(V.STOCKED, t) and has(V.STOCK_ACT, t) and not in_then(u, x, scope)]
    return min(acts, key=lambda x: x.start) if acts else None


def overselling(u: Unit, n: Node) -> Node | None:
    if not u.has(scope := (n.start, n.end), V.INVENTORY, low=True) or u.has(scope, V.INVENTORY_LOCKS, low=True):
        return None
    calls = [(x, u.of(x).lower()) for x in u.calls_in((n.start, n.end))]
    stocked = [(x, t) for x, t in calls if has(V.INVENTORY, t)]
    write = next(((x, t) for x, t in stocked if has(V.INVENTORY_WRITE, t) and has(V.INVENTORY_CHANGE, t)), None)
    if write is None or not any(has(V.INVENTORY_READ, t) for _, t in stocked) or has(V.INVENTORY_GUARD, write[1]):
        return None
    return write[0]


def hardcoded_key(u: Unit, n: Node) -> bool:
    text = u.cut(n.value)
    if n.op != "str" or len(text) < 8 or has(V.SCANNER_WORDS, text) or label_like(text):
        return False
    if not service_key(text) and not (has(V.GENERIC_KEYS, text) and secret_value(text) and has(V.GENERIC_CREDENTIAL, u.context(n))):
        return False
    return not described(u, n)


def config_key(u: Unit, n: Node) -> bool:
    if not has(V.CONFIG_FILE, u.file.lower()) or not has(V.CONFIG_KEY, n.name):
        return False
    value = string_of(u, n.value)
    return value is not None and secret_value(value) and not has(V.ENVIRONMENT, value)


def default_key(u: Unit, n: Node) -> bool:
    name, _, value = u.cut((n.start, n.end)).partition("=")
    return n.owner.kind != "method" and has(V.KEY_PARAMETER, name.split(":")[0]) and has(V.KEY_DEFAULT, value)


def key_in_comment(u: Unit, n: Node) -> bool:
    line = u.text[n.start : n.end]
    at = next((line.find(m) for m in ("//", "/*") if m in line), 0 if "*" in line else -1)
    if at < 0 or has(V.SCANNER_WORDS, line):
        return False
    comment = line[at:]
    if not (service_key(comment) or inline_key(comment)):
        return False
    return not any(a <= n.start + at < b and u.text.startswith("/**", a) and has(V.DOC_TAGS, u.text[a:b]) for a, b in u.s.comments)


def logged_key(u: Unit, n: Node) -> Node | None:
    if not has(V.KEY_LOGGER, u.callee(n).lower()):
        return None
    for a in n.args:
        text = u.cut(a)
        names = [m[1] for m in re.finditer(r"\$\{\s*[\w$.]*?([\w$]+)\s*\}", text)] if text[:1] == "`" else [m[1]] if (m := re.fullmatch(r"[\w$.\[\]'\"]*?([\w$]+)(?:['\"]\])?", text)) and text[:1] not in "'\"" else []
        if service_key(text) or any(has(V.GENERIC_CREDENTIAL, x) for x in names[:1]) or inline_key(text):
            return Node("arg", *a)
    return None


def key_in_error(u: Unit, n: Node) -> bool:
    text = u.cut(n.value)
    return n.op == "str" and has(V.ERROR_WORDS, text) and (service_key(text) or inline_key(text))


def env_fallback(u: Unit, n: Node) -> bool:
    left, right = u.receiver(n), string_of(u, n.value)
    return n.op in ("||", "??") and has(r"process\.env\b", left) and has(V.SECRET_ENVIRONMENT, left) and right is not None and len(right) >= 3 and not has(V.FALLBACK_SENTINEL, right)


def comparand(text: str) -> bool:
    name = re.search(r"([\w$]+)$", re.sub(r"\([^()]*\)$|!$", "", text))
    return name is not None and has(V.SECRET_NAME, name[1]) and (not name[1][0].isupper() or has("^[A-Z0-9_]+$", name[1]))


def no_value(text: str) -> bool:
    return has(r"^(?:['\"`].*|\d[\w.]*|true|false|null|undefined|typeof\b.*)$|\.(?:length|kind|type|status|statusCode|size|count)$", text)


def timing(u: Unit, n: Node) -> bool:
    left, right = u.receiver(n), u.cut(n.value)
    return n.op in ("===", "!==", "==", "!=") and not no_value(left) and not no_value(right) and (comparand(left) or comparand(right))


def weak_hash(u: Unit, n: Node) -> bool:
    return has(V.WEAK_HASH, n.name) or has("(?i)^(?:createHash|createHmac)$", n.name) and has(V.WEAK_HASH, plain(u.arg(n, 0)))


def exposed_fields(u: Unit, n: Node) -> bool:
    f = u.function(n)
    return u.node_has(n, V.EXPOSED) and (u.node_has(n, V.RESPONSE) or has(V.RESPONSE_BUILDER, f.name if f else ""))


def unfiltered(u: Unit, n: Node) -> bool:
    return u.node_has(n, V.EXPOSED) and u.node_has(n, V.SENT_USER) and not u.node_has(n, V.REMOVED)


def cache_write(u: Unit, n: Node) -> bool:
    name, receiver, key = n.name.lower(), u.receiver(n).lower(), u.arg(n, 0)
    sink = has(V.CACHE_WRITE, name) and has(V.CACHE_RECEIVER, receiver) or has(V.REDIS_WRITE, name) and has(r"\bredis\b", receiver) or "memcache" in receiver
    return sink and has(V.REQUEST_KEY, key) and not has(V.CLEAN_KEY, key)


def poisoned(u: Unit, n: Node) -> bool:
    return has(V.REQUEST_HEADERS, u.arg(n, 0)) and has(V.HEADER_KEY, u.arg(n, 0))


def queue_parse(u: Unit, n: Node) -> bool:
    if not n.receiver or not has(V.QUEUE_HANDLERS, n.name.lower()):
        return False
    body = handler_text(u, n)
    return has(V.QUEUE_PARSERS, body) and has(V.QUEUE_MESSAGE, body) and not has(V.QUEUE_VALIDATED, body)


def queue_send(u: Unit, n: Node) -> bool:
    return n.receiver is not None and has(V.QUEUE_SEND, n.name.lower()) and has(V.QUEUE_RECEIVER, u.receiver(n).lower()) and u.node_has(n, V.QUEUE_REQUEST) and not u.node_has(n, V.QUEUE_SIGNED)


def acknowledged(u: Unit, n: Node) -> bool:
    return u.node_has(n, V.ACKNOWLEDGED) and u.node_has(n, V.BROKER) and u.node_has(n, V.BROKER_MESSAGE) and not u.node_has(n, V.BROKER_CHECKED)


def event_injection(u: Unit, n: Node) -> bool:
    return u.node_has(n, V.EVENT_HANDLER) and u.node_has(n, V.EVENT_DATA) and not u.node_has(n, V.EVENT_CHECKED)


def event_name(u: Unit, n: Node) -> bool:
    return has(V.EVENT_SEND, u.callee(n).lower()) and has(V.EVENT_NAME, u.arg(n, 0))


def no_tenant(u: Unit, n: Node) -> bool:
    if not n.receiver or not has(V.TENANT_HANDLERS, n.name.lower()) or not has(V.TENANT_RECEIVER, u.receiver(n).lower()):
        return False
    text = handler_text(u, n)
    return has(V.TENANT_STORE, text) and has(V.TENANT_DATA, text) and not has(V.TENANT_SCOPE, text)


def outbound(u: Unit, n: Node) -> bool:
    return has(V.OUTBOUND, u.sink(n)) and dirty(u, n, 0) and not u.scope_has(n, V.URL_CHECK)


def redirect(u: Unit, n: Node) -> bool:
    receiver = u.receiver(n)
    if receiver not in ("res", "response", "reply") or receiver == "reply" and n.name != "redirect" or not n.args:
        return False
    if n.name == "redirect":
        target = n.args[-1]
    elif n.name == "location":
        target = n.args[0]
    elif n.name == "set" and len(n.args) == 2 and plain(u.arg(n, 0)).lower() == "location":
        target = n.args[1]
    else:
        return False
    return u.dirty(target) and not u.scope_has(n, V.URL_CHECK) and not has(r"^['\"`]/(?!/)", u.cut(target))


def path_traversal(u: Unit, n: Node) -> bool:
    return has(V.FILE_CALL, u.sink(n)) and dirty(u, n, 0) and not u.scope_has(n, V.URL_CHECK) and not u.scope_has(n, V.CONTAINED)


def reflected_cors(u: Unit, n: Node) -> bool:
    if u.callee(n) != "cors" or not n.args or u.option(n.args[0], "credentials") != "true":
        return False
    origin = u.option(n.args[0], "origin") or u.arg(n, 0)
    return has(V.REFLECTED, origin) or has(V.REFLECTED_CALLBACK, origin) and not has(V.ORIGIN_CHECKED, origin)


def reflected_headers(u: Unit, n: Node) -> bool:
    """The file's last call that sets the allowed origin from the request, if another one allows credentials."""
    calls = u.nodes["call"]
    key = ("reflected",)
    if key not in u._seen:
        found = None
        if has(V.ORIGIN_HEADER, u.clean) and has(V.CREDENTIALS_HEADER, u.clean):
            texts = [(x, u.of(x)) for x in calls]
            echoes = [x for x, t in texts if has(V.ORIGIN_HEADER, t) and has(V.REFLECTED, t)]
            found = echoes[-1] if echoes and any(has(V.CREDENTIALS_HEADER, t) and has(V.HEADER_TRUE, t) for _, t in texts) else None
        u._seen[key] = found
    return u._seen[key] is n


def open_cors(u: Unit, n: Node) -> bool:
    return u.callee(n) == "cors" and (not n.args or u.is_object(n.args[0]) and has(r"^(?:['\"]\*['\"]|true)$", u.option(n.args[0], "origin") or ""))


def low_cost(u: Unit, n: Node) -> bool:
    cost = u.arg(n, 1) if n.name in ("hash", "hashSync") else u.arg(n, 0) if n.name in ("genSalt", "genSaltSync") else ""
    return has(V.BCRYPT, u.receiver(n)) and cost.isdigit() and int(cost) < V.LEAST_COST


CALL, LITERAL, BINARY, PROP, ROUTE, LIMITER, FUNCTION = ("call",), ("literal",), ("binary",), ("prop",), ("route",), ("limiter",), ("function",)
value = lambda u, n: u.cut(n.value)

DETECTORS = [
    Detector("BCR-AUTH-001", ("member",), request_token, cut=None, names="^token$"),
    Detector("BCR-AUTH-002", LITERAL, secret_literal, cut=None),
    Detector("BCR-AUTH-003", ROUTE, lambda u, n: sensitive(u, n) and not has(V.AUTHENTICATED, u.route_text(n)), cut=100),
    Detector("BCR-AUTH-004", ("var",), secret_variable, cut=None),
    Detector("BCR-VAL-001", CALL, sql_sink, None, "CONFIRMED"),
    Detector("BCR-VAL-001", CALL, raw_sql, None, "CONFIRMED", names=V.RAW),
    Detector("BCR-VAL-001", CALL, search_sink, None, "CONFIRMED", names="(?i)^search$"),
    Detector("BCR-VAL-002", CALL, process_sink, None, "CONFIRMED"),
    Detector("BCR-VAL-003", ("call", "new"), code_sink, None, "CONFIRMED"),
    Detector("BCR-VAL-011", ("tagged",), lambda u, n: has(V.SQL_TAG, n.name) and u.dirty((n.start, n.end)), cut=160),
    Detector("BCR-VAL-013", CALL, nosql_sink, lambda u, n: "CRITICAL" if has(V.NOSQL_CODE, u.arg(n, 0)) else "HIGH", "CONFIRMED", names=V.NOSQL),
    Detector("BCR-VAL-014", CALL, template_sink, None, "CONFIRMED", names=V.TEMPLATE_CALL),
    Detector("BCR-VAL-015", PROP, lambda u, n: has(V.XML_OPTIONS, n.name) and u.cut(n.value) == "true", None, "CONFIRMED"),
    Detector("BCR-LOG-001", CALL, sensitive_log, cut=50, shown=lambda u, n: ", ".join(u.cut(a) for a in n.args), names=V.LOG_VERBS),
    Detector("BCR-LOG-002", CALL, logged_request, cut=50, shown=lambda u, n: ", ".join(u.cut(a) for a in n.args), names=V.LOG_VERBS),
    Detector("BCR-MA-001", CALL, lambda u, n: u.callee(n) == "Object.assign" and any(raw_request(u, a) for a in n.args[1:]), None, "CONFIRMED", 60, names="^assign$"),
    Detector("BCR-MA-002", ("assign",), field_from_user, None, lambda u, n: "CONFIRMED" if has(V.SENSITIVE_FIELD, n.name.rsplit(".", 1)[-1]) else "TENTATIVE", 60),
    Detector("BCR-MA-003", FUNCTION, copies_all, cut=60),
    Detector("BCR-MA-004", ("assign",), lambda u, n: has(V.PROTOTYPE_TARGET, n.name), cut=None),
    Detector("BCR-MA-007", ("assign",), dynamic_key),
    Detector("BCR-MA-007", CALL, user_merge, names=V.MERGES),
    Detector("BCR-MA-005", PROP, lambda u, n: n.name in V.PROTOTYPE_KEYS, cut=60),
    Detector("BCR-MA-006", CALL, body_to_service, cut=140, names=V.SAVE_VERB),
    Detector("BCR-RL-001", ROUTE, unlimited, cut=100),
    Detector("BCR-RL-002", LIMITER, first_spoofable, cut=140),
    Detector("BCR-RL-003", LIMITER, weak_limit, cut=160),
    Detector("BCR-RL-004", LIMITER, local_store, cut=160),
    Detector("BCR-AC-001", ROUTE, lambda u, n: sensitive(u, n) and not authorized(u.route_text(n)), cut=100),
    Detector("BCR-AC-002", ("member",), id_access, None, lambda u, n: "FIRM" if named_id(n.name) else "TENTATIVE", None, names="(?i)id$"),
    Detector("BCR-AC-003", CALL, unowned_query, cut=60, names=V.QUERY_NAME),
    Detector("BCR-AC-004", FUNCTION, unguarded_privilege, cut=60),
    Detector("BCR-AC-005", CALL, direct_lookup, cut=60, names=V.DIRECT_LOOKUP),
    Detector("BCR-AC-005", CALL, service_lookup, "HIGH", "TENTATIVE", 80, once=True, names=V.SERVICE_VERB),
    Detector("BCR-BL-001", FUNCTION, race, cut=80),
    Detector("BCR-BL-002", ROUTE, no_idempotency, "CRITICAL", cut=80, once=True),
    Detector("BCR-BL-003", ("if",), funds_check, cut=80),
    Detector("BCR-BL-003", FUNCTION, check_then_act, None, "TENTATIVE", 80, once=True),
    Detector("BCR-BL-004", ROUTE, client_price, cut=80, once=True),
    Detector("BCR-BL-005", FUNCTION, overselling, cut=80, once=True),
    Detector("BCR-JWT-001", CALL, lambda u, n: jwt(u, n, "decode") and not u.scope_has(n, V.TOKEN_CHECK), cut=None, shown=lambda u, n: u.cut(u.scope(n)).lower(), names="^decode$"),
    Detector("BCR-JWT-002", CALL, lambda u, n: jwt(u, n, "verify") and "none" in u.arg(n, 2), cut=None, shown=line_of, names="^verify$"),
    Detector("BCR-JWT-003", CALL, lambda u, n: jwt(u, n, "verify") and len(n.args) > 2 and "algorithm" not in u.arg(n, 2), cut=None, shown=line_of, names="^verify$"),
    Detector("BCR-JWT-004", CALL, lambda u, n: jwt(u, n, "verify") and has("publicKey|public_key", u.arg(n, 1)) and "HS256" in u.of(n), cut=None, shown=line_of, names="^verify$"),
    Detector("BCR-JWT-005", ("var",), weak_jwt_secret, cut=None, shown=line_of),
    Detector("BCR-JWT-006", CALL, lambda u, n: jwt(u, n, "verify") and u.option(n.args[2] if len(n.args) > 2 else None, "ignoreExpiration") == "true", cut=None, shown=line_of, names="^verify$"),
    Detector("BCR-JWT-009", CALL, lambda u, n: jwt(u, n, "sign") and not has(r"\b(?:expiresIn|notBefore)\b", u.arg(n, 2)) and not has(r"\bexp\b\s*:", u.arg(n, 0)), cut=None, shown=line_of, names="^sign$"),
    Detector("BCR-JWT-007", ("assign", "binary"), lambda u, n: "cache" in u.receiver(n) and has("decode|jwt", u.cut(n.value)), cut=None, shown=line_of),
    Detector("BCR-JWT-008", CALL, lambda u, n: jwt(u, n, "verify") and bool(n.args) and not u.scope_has(n, V.KID), cut=None, shown=lambda u, n: u.cut(u.scope(n)).lower(), names="^verify$"),
    Detector("BCR-KEY-001", LITERAL, hardcoded_key, lambda u, n: "HIGH" if has(V.TEST_PATH, u.file) else "CRITICAL", cut=50, shown=value),
    Detector("BCR-KEY-002", PROP, config_key, "CRITICAL", cut=60),
    Detector("BCR-KEY-003", ("param",), default_key, cut=60),
    Detector("BCR-KEY-004", ("line",), key_in_comment, cut=60, shown=lambda u, n: u.text[n.start : n.end].strip()),
    Detector("BCR-KEY-005", CALL, logged_key, cut=60),
    Detector("BCR-KEY-006", LITERAL, key_in_error, cut=60, shown=value),
    Detector("BCR-KEY-007", LITERAL, lambda u, n: n.op == "str" and has(V.CONNECTION, u.cut(n.value)) and u.context(n) != "", cut=60, shown=value),
    Detector("BCR-KEY-008", BINARY, env_fallback),
    Detector("BCR-VAL-012", CALL, lambda u, n: u.callee(n) == "Buffer.from" and u.arg(n, 1)[1:-1].lower() == "base64" and dirty(u, n, 0) and u.cut(n.value).startswith(".toString"), cut=140, names="^from$"),
    Detector("BCR-VAL-005", CALL, lambda u, n: u.callee(n) == "JSON.parse" and dirty(u, n, 0) and unchecked(u, n), cut=None, names="^parse$"),
    Detector("BCR-VAL-006", ("call", "new"), lambda u, n: n.name in ("eval", "Function") and dirty(u, n, 0) and unchecked(u, n), cut=None, names="^(?:eval|Function)$"),
    Detector("BCR-VAL-007", ("assign",), lambda u, n: has(r"__proto__|constructor\.prototype", n.name) and u.dirty(n.value), cut=None),
    Detector("BCR-VAL-008", CALL, lambda u, n: n.name == "assign" and any(map(u.dirty, n.args[1:])) and unchecked(u, n), cut=None, names="^assign$"),
    Detector("BCR-VAL-009", ("spread",), lambda u, n: u.dirty(n.value) and unchecked(u, n), cut=None),
    Detector("BCR-VAL-010", CALL, gadget, None, "TENTATIVE"),
    Detector("BCR-CRYPTO-006", BINARY, timing, None, lambda u, n: "FIRM" if has(V.HASHED, u.of(n)) else "TENTATIVE"),
    Detector("BCR-CRYPTO-001", CALL, weak_hash, lambda u, n: "HIGH" if n.name.lower() == "createhmac" or has(V.SECURITY_WORDS, u.of(n)) else "MEDIUM", cut=None, names="(?i)^(?:md5|sha1|createHash|createHmac)$"),
    Detector("BCR-CRYPTO-002", CALL, lambda u, n: u.callee(n) == "Math.random" and has("(?i)token", u.context(n)), cut=None, names="^random$"),
    Detector("BCR-CRYPTO-004", CALL, lambda u, n: u.callee(n) == "Math.random" and not has("(?i)token", u.context(n)) and has(V.ONE_TIME, u.context(n)), cut=None, names="^random$"),
    Detector("BCR-CRYPTO-003", CALL, lambda u, n: u.node_has(n, V.KEY_LITERAL), cut=None),
    Detector("BCR-CRYPTO-005", CALL, lambda u, n: u.callee(n) in ("crypto.createCipher", "crypto.createDecipher"), cut=140, names="^create(?:Cipher|Decipher)$"),
    Detector("BCR-DE-001", ("return",), unfiltered, cut=None),
    Detector("BCR-DE-002", ("return",), exposed_fields, cut=None),
    Detector("BCR-CACHE-001", CALL, lambda u, n: cache_write(u, n) and not poisoned(u, n), None, "CONFIRMED"),
    Detector("BCR-CACHE-002", CALL, lambda u, n: cache_write(u, n) and poisoned(u, n), None, "CONFIRMED"),
    Detector("BCR-MQ-001", CALL, queue_parse, None, "FIRM", names="(?i)" + V.QUEUE_HANDLERS),
    Detector("BCR-MQ-002", CALL, queue_send, cut=None, names="(?i)" + V.QUEUE_SEND),
    Detector("BCR-MQ-003", CALL, acknowledged, cut=None),
    Detector("BCR-EVT-001", CALL, event_injection, cut=None),
    Detector("BCR-EVT-002", CALL, event_name, cut=None),
    Detector("BCR-EVT-003", CALL, no_tenant, None, "TENTATIVE", names="(?i)" + V.TENANT_HANDLERS),
    Detector("BCR-SSRF-001", CALL, outbound, cut=140),
    Detector("BCR-REDIRECT-001", CALL, redirect, cut=140, names="^(?:redirect|location|set)$"),
    Detector("BCR-PT-001", CALL, path_traversal, cut=140),
    Detector("BCR-MISC-005", CALL, reflected_cors, cut=140, names="^cors$"),
    Detector("BCR-MISC-005", CALL, reflected_headers, cut=140),
    Detector("BCR-MISC-001", CALL, open_cors, cut=140, names="^cors$"),
    Detector("BCR-MISC-002", CALL, lambda u, n: n.name in V.BODY_PARSERS and has(V.BODY_PARSER_OWNERS, u.receiver(n)) and (not n.args or u.option(n.args[0], "limit") is None), cut=140, names="^(?:json|urlencoded|raw|text)$"),
    Detector("BCR-MISC-003", CALL, lambda u, n: u.callee(n) == "helmet" and not n.args, cut=140, names="^helmet$"),
    Detector("BCR-MISC-004", CALL, low_cost, cut=140, names="^(?:hash|hashSync|genSalt|genSaltSync)$"),
    Detector("BCR-TLS-001", PROP, lambda u, n: n.name == "rejectUnauthorized" and has(V.FALSY, u.cut(n.value)), cut=140),
    Detector("BCR-TLS-002", ("assign",), lambda u, n: has(V.TLS_SWITCH, n.name) and has(r"^(?:0|['\"`]\s*0\s*['\"`])$", u.cut(n.value)), cut=140),
    Detector("BCR-COOKIE-001", CALL, no_http_only, None, explicit("httpOnly", "^false$"), 140, names="(?i)^(?:cookie|session|cookieSession)$"),
    Detector("BCR-COOKIE-002", CALL, bad_cookie("secure", "^false$"), None, explicit("secure", "^false$"), 140, names="(?i)^(?:cookie|session|cookieSession)$"),
    Detector("BCR-COOKIE-003", CALL, bad_cookie("sameSite", r"^(?:['\"`](?i:none)['\"`]|false)$"), None, explicit("sameSite", r"^['\"`](?i:none)"), 140, names="(?i)^(?:cookie|session|cookieSession)$"),
]
#: The detector whose finding is left out on a line that has another of its category.
LAST_RESORT = next(k for k, d in enumerate(DETECTORS) if d.holds is service_lookup)
KNOWN = {r[0]: r for r in R.RULES}
BY_KIND: dict[str, list[tuple[int, Detector]]] = {}
for _k, _d in enumerate(DETECTORS):
    for _kind in _d.kinds:
        BY_KIND.setdefault(_kind, []).append((_k, _d))


@lru_cache(100_000)
def asked(kind: str, name: str) -> list[tuple[int, Detector]]:
    """The detectors that nodes of a kind and a name are put before, remembered over files."""
    return [(k, d) for k, d in BY_KIND[kind] if d.names is None or has(d.names, name)]


def found(u: Unit) -> list[dict]:
    """The findings of a file, by detector and place."""
    out: list[dict] = []
    seen: set[tuple] = set()
    for kind in BY_KIND:
        for n in u.nodes.get(kind, ()):
            for k, d in asked(kind, n.name):
                hit = d.holds(u, n)
                if not hit:
                    continue
                at = hit if isinstance(hit, Node) else n
                line, column = u.s.line(at.start)
                key = (k, line) if d.once else (k, at.start, at.end)
                if key in seen:
                    continue
                seen.add(key)
                rule = KNOWN[d.rule]
                code = d.shown(u, at) if d.shown else u.text[at.start : at.end]
                severity = d.severity(u, at) if callable(d.severity) else d.severity or rule[2]
                sure = d.confidence(u, at) if callable(d.confidence) else d.confidence or R.CONFIDENCE.get(d.rule, "TENTATIVE" if rule[5] else "FIRM")
                out.append({"file": u.file, "ord": k, "rule_id": d.rule, "severity": severity, "category": rule[1], "confidence": sure, "line": line, "column": column, "excerpt": code[: d.cut], "id": at.start})
    taken = {(f["category"], f["line"]) for f in out if f["ord"] != LAST_RESORT}
    out = [f for f in out if f["ord"] != LAST_RESORT or (f["category"], f["line"]) not in taken]
    return sorted(out, key=lambda f: (f["ord"], f["id"]))


FOUND = pa.schema([("file", pa.string()), ("ord", pa.int32()), ("rule_id", pa.string()), ("severity", pa.string()), ("category", pa.string()), ("confidence", pa.string()), ("line", pa.int32()), ("column", pa.int32()), ("excerpt", pa.string()), ("id", pa.int64())])


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        resolved = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
        rows: list[dict] = []
        for file, content, symbols in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), resolved, strict=True):
            u = Unit(file, content, {s["local"]: (s["module"], s["name"], s["taints"]) for s in symbols or ()})
            rows += found(u) if u.s.whole else []
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist(rows, schema=FOUND)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=FOUND)


def findings(files: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """One row a finding: the same columns as a log's.  Without ``symbols`` (see ``symbols.resolved``) there is no shuffle."""
    rows = files.select("file", "content").where("content is not null and content <> ''")
    if symbols is not None:
        held = symbols.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("local", "module", "name", "taints"))).alias("symbols"))
        rows = rows.join(held, "file", "left")
    schema = "file string, ord int, rule_id string, severity string, category string, confidence string, line int, column int, excerpt string, id long"
    out = rows.mapInArrow(_findings, schema)
    return out.select("ord", "rule_id", "severity", "category", "confidence", "file", "line", "column", S.fingerprint(F.col("rule_id"), F.col("file"), F.col("line"), F.col("excerpt")).alias("fingerprint"), "excerpt", "id")


def reviewed(files: DataFrame, disabled: list[str] | None = None, heuristics: bool = False, least: str | None = None, baseline: DataFrame | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """Findings after the gates, with ``suppressed``, ``suppression_source`` and ``reason``: marks in the file come before the baseline."""
    rows = report.inline_suppressed(S.gated(findings(files, symbols), disabled, heuristics, least), report.suppressions(files))
    rows = rows.withColumn("suppression_source", F.when(F.col("suppressed"), F.lit("inline")))
    if baseline is None:
        return rows
    both = S.suppressed(rows.withColumnRenamed("suppressed", "inline"), baseline)
    return both.withColumn("suppression_source", F.coalesce("suppression_source", F.when(F.col("suppressed"), F.lit("baseline")))).withColumn("suppressed", F.col("inline") | F.col("suppressed")).drop("inline")


def file_flags(rows: DataFrame, rules: list[str]) -> DataFrame:
    """For each file, whether it has each of the rules."""
    return rows.groupBy("file").agg(*[F.bool_or(F.col("rule_id") == r).alias(r.lower().replace("-", "_")) for r in rules])


def rules_covered() -> list[str]:
    return list(dict.fromkeys(d.rule for d in DETECTORS))
