"""Tests on what a pattern has found, as functions of a match and as DuckDB SQL; and a few of them as Spark columns.

A check has up to three parts: the condition, the reported value, and the severity
where it depends on the value.  ``raw`` is the whole match, ``value`` the group.
"""

from __future__ import annotations

import datetime
import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodesieve.functions import patterns as P

ANY_BRAND = "|".join(f"(?:{regex})" for _, regex in P.BRANDS)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def luhn(s: Column) -> Column:
    return s.rlike(r"^\d{12,19}$") & F.coalesce(F.call_function("luhn_check", F.when(s.rlike(r"^\d{12,19}$"), s)), F.lit(False))


def card_brand(s: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, regex in reversed(P.BRANDS):
        out = F.when(s.rlike(regex), F.lit(name)).otherwise(out)
    return out


def iban97(s: Column) -> Column:
    moved = F.concat(F.substring(s, 5, 100), F.substring(s, 1, 4))
    step = lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return s.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$") & (F.aggregate(F.split(moved, ""), F.lit(0), step) == 1)


def entropy(s: Column) -> Column:
    """Bits a character; 0 for an empty string."""
    share = lambda c: (F.length(s) - F.length(F.replace(s, c, F.lit("")))) / F.nullif(F.length(s), F.lit(0))
    return F.coalesce(F.aggregate(F.filter(F.array_distinct(F.split(s, "")), lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c))), F.lit(0.0))


def placeholder(s: Column) -> Column:
    return s.rlike(P.PLACEHOLDER)


def public_ipv4(s: Column) -> Column:
    return s.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$") & ~s.rlike(P.NOT_PUBLIC)


def masked(s: Column) -> Column:
    """Up to 4 characters: all hidden; a run with 13 to 19 digits: first 6 and last 4 stay; else first 2 and last 2."""
    n = F.length(s)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).when(
        F.length(digits(s)).between(13, 19), F.concat(F.substring(s, 1, 6), F.repeat(F.lit("*"), F.greatest(F.lit(0), n - 10)), F.right(s, F.lit(4)))
    ).otherwise(F.concat(F.substring(s, 1, 2), F.repeat(F.lit("*"), n - 4), F.right(s, F.lit(2))))


# the same of plain strings


def _whole(regex: str) -> re.Pattern:
    """A pattern whose $ is the very end, and whose classes are ASCII."""
    return re.compile(regex.replace("$", r"\Z"), re.ASCII)


_BRAND, _PLACEHOLDER, _SENTINEL, _FILE, _OWNED, _CURRENCY, _NOT_PUBLIC = map(_whole, (ANY_BRAND, P.PLACEHOLDER, P.SENTINEL, P.FILE_PATH, P.OWNED_LABEL, P.CURRENCY, P.NOT_PUBLIC))
_digits = lambda raw: re.sub(r"[^0-9]", "", raw)


def luhn_of(s: str) -> bool:
    if not 12 <= len(s) <= 19:
        return False
    total = 0
    for k, c in enumerate(reversed(s)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_of(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def entropy_of(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


def real(s: str) -> bool:
    return _PLACEHOLDER.search(s) is None


def card(s: str) -> bool:
    return _BRAND.search(s) is not None and luhn_of(s)


def unquoted(s: str) -> str:
    return s[1:-1] if re.fullmatch(r"""(?s)"[^"\\]{6,}"|'[^'\\]{6,}'""", s) else s


def label_of(raw: str) -> str:
    return re.sub(r"""(?s)["\s]*[:=].*$""", "", raw)


@dataclass(frozen=True)
class Check:
    holds: Callable[[str, str], bool]  #: of raw and value
    holds_sql: str
    value: Callable[[str, str], str] | None = None
    value_sql: str = ""
    severity: Callable[[str, str], str] | None = None
    severity_sql: str = ""


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def luhn_sql(s: str) -> str:
    x = f"(({s})[length({s}) - i])::int"
    return f"(regexp_matches({s}, '^[0-9]{{12,19}}$') and list_sum(list_transform(range(length({s})), lambda i: case when i % 2 = 0 then {x} when {x} > 4 then 2 * {x} - 9 else 2 * {x} end)) % 10 = 0)"


def entropy_sql(s: str) -> str:
    share = f"((length({s}) - length(replace({s}, c, ''))) / length({s})::double)"
    return f"list_sum(list_transform(list_distinct(string_split({s}, '')), lambda c: -{share} * log2({share})))"


def iban_sql(s: str) -> str:
    numbers = f"array_to_string(list_transform(string_split({s}[5:] || {s}[1:4], ''), lambda c: case when c between '0' and '9' then c else (ascii(c) - 55)::varchar end), '')"
    return f"(list_reduce(list_transform(string_split({numbers}, ''), lambda c: c::int), lambda a, d: (a * 10 + d) % 97) = 1)"


DIGITS = "regexp_replace(raw, '[^0-9]', '', 'g')"
HEX_DIGITS = "replace(upper(raw), '%3', '')"
_real_sql = f"not regexp_matches(value, {quoted(P.PLACEHOLDER)})"
_unquoted_sql = r"""case when regexp_matches(value, '^("[^"\\]{6,}"|''[^''\\]{6,}'')$') then value[2:-2] else value end"""

CHECKS: dict[str, Check] = {
    "": Check(lambda r, v: True, "true"),
    "pan": Check(lambda r, v: card(_digits(r)), f"regexp_matches({DIGITS}, {quoted(ANY_BRAND)}) and {luhn_sql(DIGITS)}", lambda r, v: _digits(r), DIGITS),
    "encoded_pan": Check(lambda r, v: card(r.replace("%3", "")), f"regexp_matches({HEX_DIGITS}, {quoted(ANY_BRAND)}) and {luhn_sql(HEX_DIGITS)}", lambda r, v: r.replace("%3", ""), HEX_DIGITS),
    "emirates": Check(
        lambda r, v: 1900 <= int(_digits(r)[3:7]) <= datetime.date.today().year, f"({DIGITS})[4:7]::int between 1900 and year(current_date)",
        severity=lambda r, v: "HIGH" if luhn_of(_digits(r)) else "MEDIUM", severity_sql=f"case when {luhn_sql(DIGITS)} then 'HIGH' else 'MEDIUM' end",
    ),
    "iban": Check(lambda r, v: iban_of(r), iban_sql("raw")),
    "password": Check(lambda r, v: len(unquoted(v)) >= 5 and not _SENTINEL.search(unquoted(v)), f"length({_unquoted_sql}) >= 5 and not regexp_matches({_unquoted_sql}, {quoted(P.SENTINEL)})", lambda r, v: unquoted(v), _unquoted_sql),
    "env_value": Check(lambda r, v: len(v) >= 6 and not _SENTINEL.search(v) and not _FILE.search(v), f"length(value) >= 6 and not regexp_matches(value, {quoted(P.SENTINEL)}) and not regexp_matches(value, {quoted(P.FILE_PATH)})"),
    "real": Check(lambda r, v: real(v), _real_sql),
    "with_digit": Check(lambda r, v: real(v) and re.search("[0-9]", v) is not None, f"{_real_sql} and regexp_matches(value, '[0-9]')"),
    "not_784": Check(lambda r, v: real(v) and not v.replace("-", "").startswith("784"), f"{_real_sql} and not starts_with(replace(value, '-', ''), '784')"),
    "expiry": Check(lambda r, v: True, "true", lambda r, v: v.replace("-", "/"), "replace(value, '-', '/')"),
    "balance": Check(lambda r, v: ("." in v or _CURRENCY.search(r) is not None) and re.search("[1-9]", v) is not None, f"(contains(value, '.') or regexp_matches(raw, {quoted(P.CURRENCY)})) and regexp_matches(value, '[1-9]')"),
    "public_ip": Check(lambda r, v: not _NOT_PUBLIC.search(v), f"not regexp_matches(value, {quoted(P.NOT_PUBLIC)})"),
    "ipv6": Check(lambda r, v: v != "::1" and not v.lower().startswith("fe80:"), "value <> '::1' and not starts_with(lower(value), 'fe80:')"),
    "entropy": Check(lambda r, v: real(v) and not _OWNED.search(label_of(r)) and entropy_of(v) >= 3.6, f"""{_real_sql} and not regexp_matches(regexp_replace(raw, '(?s)["\\s]*[:=].*$', ''), {quoted(P.OWNED_LABEL)}) and {entropy_sql('value')} >= 3.6"""),
    "ssn": Check(lambda r, v: re.search(r"^(?:000|666|9)|-00-|-0000\Z", r) is None, "not regexp_matches(raw, '^(?:000|666|9)|-00-|-0000$')"),
    "pem_entropy": Check(lambda r, v: entropy_of(v) >= 5.0, f"{entropy_sql('value')} >= 5.0"),
}
