"""Finds spans in lines, and turns them into gated, redacted, ordered findings.

Spans are found in Arrow batches: one pass of a linear-time engine over a batch for each pattern
tells the few texts that may match, and only in those are matches looked for and checked.  All that
follows is DataFrame expressions.  A line's matches stay in one array until the excerpt has been
cut, because an excerpt hides every match that it shows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from lodesieve.functions import patterns as P
from lodesieve.functions import rules as R
from lodesieve.functions.checks import CHECKS, masked

#: Characters of a log line that are scanned, a guard for single lines; texts of other kinds are scanned whole.
SCANNED = 65_536
#: Characters of context on either side of an excerpt's match.
CONTEXT = 40
SPAN = "array<struct<ord:int,rule_id:string,severity:string,category:string,start:int,end:int,match:string>>"
_FIELDS = pa.list_(pa.struct([("ord", pa.int32()), ("rule_id", pa.string()), ("severity", pa.string()), ("category", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("match", pa.string())]))
#: Rows that are looked at together.
CHUNK = 2_000


def spans(texts: pa.Array, numbers: list[int]) -> list[list[dict]]:
    """The matches of each text, in order of patterns and places."""
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    for k in numbers:
        p = P.PATTERNS[k]
        possible = pc.indices_nonzero(pc.match_substring_regex(texts, P.re2(p))).to_pylist()
        if not possible:
            continue
        regex, check = P.compiled(p), CHECKS[p.check]
        for i in possible:
            for m in regex.finditer(texts[i].as_py()):
                raw, value = m[0], m[p.group]
                if check.holds(raw, value):
                    severity = check.severity(raw, value) if check.severity else p.severity
                    out[i].append({"ord": k, "rule_id": p.rule, "severity": severity, "category": p.category, "start": m.start(), "end": m.end(), "match": check.value(raw, value) if check.value else value})
    return out


def numbers_of(name: str) -> list[int]:
    return [k for k, p in enumerate(P.PATTERNS) if p.name == name]


def _scanned(column: int, numbers: list[int], most: int | None):
    """mapInArrow: adds ``matches``, of the given column, to the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                texts = pc.fill_null(part.column(column).cast(pa.string()), "")
                texts = pc.utf8_slice_codeunits(texts, 0, most) if most is not None else texts
                found = pa.array(spans(texts, numbers), _FIELDS)
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*part.schema.names, "matches"])

    return run


def scan(hits: DataFrame, name: str | None = None, most: int | None = SCANNED) -> DataFrame:
    """``hits`` has id, index and message; adds ``matches``, found in the first ``most`` characters (None: in the whole message).

    Null messages are empty; a message of any length is scanned whole unless ``most`` says otherwise.
    """
    numbers = numbers_of(name) if name else list(range(len(P.PATTERNS)))
    schema = StructType([*hits.schema.fields, StructField("matches", DataType.fromDDL(SPAN))])
    return hits.mapInArrow(_scanned(hits.columns.index("message"), numbers, most), schema)


def redacted(line: Column, start: Column, end: Column, others: Column, lo: Column | None = None, hi: Column | None = None) -> Column:
    """The match with CONTEXT characters on each side, every match in it masked, and an ellipsis where it is cut.

    The excerpt stays between lo and hi (default: the whole line).
    """
    lo, hi = F.lit(0) if lo is None else lo, F.length(line) if hi is None else F.least(F.length(line), hi)
    left, right = F.greatest(lo, start - CONTEXT), F.least(hi, end + CONTEXT)
    every = F.concat(F.array(F.struct(start.alias("start"), end.alias("end"))), F.transform(others, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))))
    inside = F.array_sort(F.transform(F.filter(every, lambda m: (m["end"] > left) & (m["start"] < right)), lambda m: F.struct(F.greatest(m["start"], left).alias("start"), F.least(m["end"], right).alias("end"))))
    # islands: touching or overlapping intervals become one
    empty = F.array().cast("array<struct<start:int,end:int>>")
    merged = F.aggregate(inside, empty, lambda acc, m: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= m["start"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], m["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(m))))
    cut = lambda a, b: F.substring(line, (a + 1).cast("int"), (b - a).cast("int"))
    state = F.struct(F.lit("").alias("out"), left.cast("int").alias("at"))
    text = F.aggregate(merged, state, lambda s, m: F.struct(F.concat(s["out"], cut(s["at"], m["start"]), masked(cut(m["start"], m["end"]))).alias("out"), m["end"].alias("at")), lambda s: F.concat(s["out"], cut(s["at"], right)))
    return F.concat(F.when(left != lo, F.lit("…")).otherwise(F.lit("")), text, F.when(right != hi, F.lit("…")).otherwise(F.lit("")))


def field(message: Column, primary: Column, at: Column) -> tuple[Column, Column, Column]:
    """Whether a place is in the structured part, which follows the primary one and a line break, and the bounds of its part."""
    inside = (at >= primary) & (primary < F.length(message))
    return inside, F.when(inside, primary + 1).otherwise(F.lit(0)), F.when(inside, F.length(message)).otherwise(primary)


def labelled(inside: Column, excerpt: Column) -> Column:
    return F.concat(F.when(inside, F.lit("[_source] ")).otherwise(F.lit("")), excerpt)


def fingerprint(rule: Column, file: Column, line: Column, code: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the four parts, with zero characters between them; white space in code collapsed."""
    code = F.trim(F.regexp_replace(F.coalesce(code, F.lit("")), "[" + P.SPACES + "]+", " "))
    payload = F.concat_ws("\0", rule, file, F.coalesce(line.cast("string"), F.lit("")), code)
    return F.substring(F.sha2(payload.cast("binary"), 256), 1, 16)


def findings(scanned: DataFrame, excerpts: bool = True) -> DataFrame:
    """One row per match, with its excerpt, column and fingerprint; the matched value isn't among them.

    Columns count from the start of the match's part where the hits have ``message_field_length``.
    """
    message = F.coalesce("message", F.lit(""))
    primary = F.coalesce("message_field_length", F.length(message)) if "message_field_length" in scanned.columns else F.length(message)
    rows = scanned.select("id", "index", message.alias("message"), primary.alias("_primary"), "matches", F.explode("matches").alias("m"))
    inside, lo, hi = field(F.col("message"), F.col("_primary"), F.col("m.start"))
    file = F.concat_ws("/", F.col("index"), F.col("id").cast("string"))
    columns = [F.col("id"), F.col("m.ord").alias("ord"), F.col("m.rule_id").alias("rule_id"), F.col("m.severity").alias("severity"), F.col("m.category").alias("category"), file.alias("file"), F.lit(1).alias("line"), F.greatest(F.lit(1), F.col("m.start") - lo + 1).alias("column")]
    columns.append(fingerprint(F.col("m.rule_id"), F.concat_ws("/", file, F.col("m.match")), F.lit(None), F.lit("")).alias("fingerprint"))
    if excerpts:
        columns.append(labelled(inside, redacted(F.col("message"), F.col("m.start"), F.col("m.end"), F.col("matches"), lo, hi)).alias("excerpt"))
    return rows.select(*columns)


def severity_rank(severity: Column) -> Column:
    return reduce(lambda out, x: F.when(severity == x[1], F.lit(len(P.SEVERITIES) - 1 - x[0])).otherwise(out), enumerate(P.SEVERITIES), F.lit(-1))


def gated(rows: DataFrame, disabled: list[str] | None = None, heuristics: bool = False, least: str | None = None) -> DataFrame:
    """Leaves out disabled rules, then heuristic ones unless asked for, then what is below the least severity (HIGH; LOW with heuristics)."""
    if disabled:
        rows = rows.where(~F.coalesce(F.upper("rule_id").isin([x.upper() for x in disabled]), F.lit(False)))
    if not heuristics:
        rows = rows.where(~F.coalesce(F.col("rule_id").isin([r[0] for r in R.RULES if r[5]]), F.lit(False)))
    least = (least or ("LOW" if heuristics else "HIGH")).upper()
    return rows.where(severity_rank(F.col("severity")) >= len(P.SEVERITIES) - 1 - P.SEVERITIES.index(least))


def first_of_each(rows: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each fingerprint.  ``min_by`` is pre-aggregated, so a frequent value meets in one task as one row per map task."""
    kept = F.struct(*rows.columns)
    return rows.groupBy("fingerprint").agg(F.min_by(kept, F.struct(*order)).alias("first")).select("first.*")


def suppressed(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Adds ``suppressed``: whether the baseline (fingerprint, rule_id, file) has the finding.  Its null rule or file fits any."""
    known = baseline.select("fingerprint", F.upper("rule_id").alias("known_rule"), F.col("file").alias("known_file")).distinct()
    fits = (F.col("known_rule").isNull() | (F.col("known_rule") == F.upper("rule_id"))) & (F.col("known_file").isNull() | (F.col("known_file") == F.col("file")))
    hit = rows.join(known, "fingerprint").where(fits).select("fingerprint", "file", "rule_id").distinct().withColumn("suppressed", F.lit(True))
    return rows.join(hit, ["fingerprint", "file", "rule_id"], "left").withColumn("suppressed", F.coalesce("suppressed", F.lit(False)))


def ordered(rows: DataFrame, by_line: bool = False) -> DataFrame:
    """As reported: severity, file, rule; ties by arrival.  ``by_line``, for source files: severity, file, line, rule."""
    return rows.orderBy(severity_rank(F.col("severity")).desc(), "file", *["line"] * by_line, "rule_id", "id", "ord", "column")


def dense_counts(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """A count for each of the keys, 0 where there is none."""
    dim = rows.sparkSession.createDataFrame([(k,) for k in keys], f"{column} string")
    return dim.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def top(rows: DataFrame, n: int = 5) -> DataFrame:
    return ordered(rows).limit(n)


def ranked(rows: DataFrame) -> DataFrame:
    """Position of each finding among those of its rule, by arrival."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("rule_id").orderBy("id", "ord", "column")))
