"""What is made of findings: rule data, counts, unions, exchange rows, chains, and files."""

from __future__ import annotations

import json
import os
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesieve.functions import patterns as P
from lodesieve.functions import rules as R
from lodesieve.operators import scan as S

# Chains of categories, suppression marks, and the format's names.

CHAINS = [
    ("Token/Auth Bypass → Access Control Bypass", ["AUTHENTICATION", "ACCESS_CONTROL"]),
    ("API Key Exposure → Rate Limit Bypass", ["API_KEY_EXPOSURE", "RATE_LIMITING"]),
    ("Unsafe Parsing/Deserialization → Code Execution → System Compromise", ["VALIDATION"]),
    ("Data Exposure + Weak Crypto → Key Extraction", ["DATA_EXPOSURE", "CRYPTO_WEAKNESS"]),
    ("Auth Weakness → Business Logic Abuse", ["AUTHENTICATION", "BUSINESS_LOGIC"]),
]
SUPPRESS = r"//\s*bcr-disable-{where}\s+([A-Za-z0-9_,\-*]+)(?:\s*--\s*(.*))?"
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
FINGERPRINT_KEY = "primaryLocationLineHash/v1"

#: What to do about each type of issue.
REMEDIES = {
    "INVALID_TARGET": "Check the path: it must name an existing file or folder.",
    "PARSE_FAILURE": "The file could not be parsed. Fix the syntax at the place given, or leave generated and vendored files out.",
    "DETECTOR_FAILURE": "A detector failed on this file, which was read only in part; the rest of the scan went on. Report the shape of the file.",
    "POC_EXPORT_FAILURE": "The report of exploits could not be written. Check that the output folder is writable and has space.",
    "REPORT_WRITE_FAILURE": "The report file could not be written. Check that its folder exists and is writable, or leave the output path out.",
    "FATAL_ANALYSIS_FAILURE": "The scan ended early. Narrow the path to find the file that causes it.",
}
REMEDY = "Run again with more detail."

# End of fixed values.

#: Most findings that a single report file may hold; beyond it, write the rows with ``write_rows``.
REPORT_ROWS = 200_000
SNIPPET = 200


def enriched(rows: DataFrame, confidence: bool = True) -> DataFrame:
    """Adds the rule's cwe, owasp and heuristic, and its confidence where the row has none.  Unknown rules get nulls, and FIRM."""
    table = R.rules(rows.sparkSession).select("rule_id", "ordinal", "cwe", "owasp", "heuristic", "default_confidence")
    out = rows.join(F.broadcast(table), "rule_id", "left").withColumn("heuristic", F.coalesce("heuristic", F.lit(False)))
    if confidence:
        own = F.col("confidence") if "confidence" in rows.columns else F.lit(None).cast("string")
        out = out.withColumn("confidence", F.coalesce(own, "default_confidence", F.lit("FIRM")))
    return out.drop("default_confidence")


def count_by_rule(rows: DataFrame) -> DataFrame:
    """Rows without a rule count as LEGACY and their category."""
    rule = F.coalesce("rule_id", F.concat(F.lit("LEGACY:"), F.col("category")))
    return rows.groupBy(rule.alias("rule_id")).agg(F.count("*").alias("n"))


def exploitable(rows: DataFrame) -> DataFrame:
    """Critical findings, and those of a rule that are high and not heuristic."""
    high = (F.col("severity") == "HIGH") & F.col("rule_id").isNotNull() & ~F.coalesce(F.col("rule_id").isin([r[0] for r in R.RULES if r[5]]), F.lit(False))
    return rows.where((F.col("severity") == "CRITICAL") | high)


def fails(rows: DataFrame, least: str) -> bool:
    """Whether a visible finding is at least so severe."""
    return not rows.where(S.severity_rank(F.col("severity")) >= len(P.SEVERITIES) - 1 - P.SEVERITIES.index(least.upper())).limit(1).isEmpty()


def issue_counts(issues: DataFrame) -> DataFrame:
    """A count for each type of issue, 0 where there is none."""
    return S.dense_counts(issues, "type", R.ISSUES)


def has_errors(issues: DataFrame) -> bool:
    return not issues.where("severity = 'ERROR'").limit(1).isEmpty()


def with_remedies(issues: DataFrame) -> DataFrame:
    """Adds ``fix``: what to do about an issue."""
    fixes = F.create_map(*[F.lit(x) for kv in REMEDIES.items() for x in kv])
    return issues.withColumn("fix", F.coalesce(F.element_at(fixes, F.col("type")), F.lit(REMEDY)))


def chains(rows: DataFrame, *keys: str) -> DataFrame:
    """The chains that the categories of each group make up.  A group's state is its set of categories, so no group is too large."""
    seen = rows.groupBy(*keys).agg(F.collect_set("category").alias("_seen"))
    made = F.array(*[F.when(reduce(lambda a, b: a & b, [F.array_contains("_seen", c) for c in cs]), F.lit(name)) for name, cs in CHAINS])
    return seen.select(*keys, F.explode(F.array_compact(made)).alias("chain"))


def suppressions(files: DataFrame) -> DataFrame:
    """file, line, rule_ids, reason from the marks in comments; a line's marks add up, and its first reason counts."""
    lines = files.where(F.contains("content", F.lit("bcr-disable-"))).select("file", F.posexplode(F.split("content", r"\r?\n")).alias("n", "text"))

    def marks(where: str, ahead: int) -> Column:
        regex = SUPPRESS.replace("{where}", where)
        ids = F.filter(F.transform(F.split(F.regexp_extract("text", regex, 1), ","), lambda x: F.upper(F.trim(x))), lambda x: x != "")
        # within a line the mark for the next one is read first
        mark = F.struct((F.col("n") + 1 + ahead).alias("line"), (F.col("n") * 2 + 1 - ahead).alias("at"), ids.alias("ids"), F.nullif(F.trim(F.regexp_extract("text", regex, 2)), F.lit("")).alias("reason"))
        return F.when(F.col("text").rlike(regex), mark)

    found = lines.select("file", F.explode(F.array_compact(F.array(marks("next-line", 1), marks("line", 0)))).alias("m")).where("size(m.ids) > 0")
    return found.groupBy("file", F.col("m.line").alias("line")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("m.ids")))).alias("rule_ids"), F.min_by(F.col("m.reason"), F.when(F.col("m.reason").isNotNull(), F.col("m.at"))).alias("reason"))


def inline_suppressed(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Adds ``suppressed`` and ``reason``: whether a mark on the finding's line names its rule, or all."""
    out = rows.join(marks.select("file", "line", "rule_ids", "reason"), ["file", "line"], "left")
    hit = F.coalesce(F.array_contains("rule_ids", F.upper("rule_id")) | F.array_contains("rule_ids", "*"), F.lit(False))
    return out.withColumn("suppressed", hit).withColumn("reason", F.when(hit, F.col("reason"))).drop("rule_ids")


def artifact_uri(file: Column) -> Column:
    """A relative path as it is, with slashes; an absolute one as a file address."""
    path = F.replace(file, F.lit("\\"), F.lit("/"))
    quoted = F.replace(F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")), F.lit("%3A"), F.lit(":"))
    return F.when(path.rlike("^[A-Za-z]:/"), F.concat(F.lit("file:///"), quoted)).when(path.startswith("//"), F.concat(F.lit("file:"), quoted)).when(path.startswith("/"), F.concat(F.lit("file://"), quoted)).otherwise(path)


def sarif_rows(rows: DataFrame) -> DataFrame:
    """One row a result, in columns.  rule_index is null for a rule that isn't in the table; ``rows`` may have excerpt, confidence, suppressed and reason."""
    e = enriched(rows)
    code = F.col("excerpt") if "excerpt" in rows.columns else F.lit("")
    snippet = F.when(F.length(code) > SNIPPET, F.concat(F.substring(code, 1, SNIPPET - 1), F.lit("…"))).otherwise(code)
    held = F.col("suppressed") if "suppressed" in rows.columns else F.lit(False)
    source = F.col("suppression_source") if "suppression_source" in rows.columns else F.lit("baseline")
    return e.select(
        F.coalesce("rule_id", F.lit("BCR-LEGACY")).alias("rule_id"), F.col("ordinal").alias("rule_index"), R.level(F.col("severity")).alias("level"), R.score(F.col("severity")).alias("security_severity"),
        artifact_uri(F.col("file")).alias("uri"), F.greatest(F.lit(1), F.col("line")).cast("int").alias("start_line"), F.greatest(F.lit(1), F.col("column")).cast("int").alias("start_column"), snippet.alias("snippet"),
        F.coalesce(F.nullif("fingerprint", F.lit("")), F.concat_ws(":", F.coalesce("rule_id", F.lit("BCR-LEGACY")), F.replace("file", F.lit("\\"), F.lit("/")), F.col("line").cast("string"))).alias("fingerprint"),
        "category", "severity", "confidence", F.coalesce("cwe", F.array().cast("array<string>")).alias("cwe"), "owasp",
        F.when(held, F.when(source == "inline", F.lit("inSource")).otherwise(F.lit("external"))).alias("suppression"), (F.col("reason") if "reason" in rows.columns else F.lit(None).cast("string")).alias("justification"),
    )


def sarif_taxa(rules: DataFrame) -> DataFrame:
    """Distinct CWE and OWASP classes with the place where each is first seen."""
    cwe = rules.select(F.lit("CWE").alias("taxonomy"), "ordinal", F.posexplode("cwe").alias("k", "taxon"))
    owasp = rules.select(F.lit("OWASP").alias("taxonomy"), "ordinal", F.lit(0).alias("k"), F.col("owasp").alias("taxon"))
    return cwe.unionByName(owasp).groupBy("taxonomy", "taxon").agg(F.min(F.col("ordinal") * 10 + F.col("k")).alias("first_seen"))


def sarif_results(rows: DataFrame) -> DataFrame:
    """One JSON text a result."""
    r = sarif_rows(rows)
    location = F.struct(F.struct(F.struct(F.col("uri").alias("uri")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine"), F.col("start_column").alias("startColumn"), F.struct(F.col("snippet").alias("text")).alias("snippet")).alias("region")).alias("physicalLocation"))
    doc = F.struct(
        F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), F.col("level"), F.struct(F.concat_ws(": ", "rule_id", "category").alias("text")).alias("message"), F.array(location).alias("locations"),
        F.struct(F.col("fingerprint").alias(FINGERPRINT_KEY)).alias("partialFingerprints"), F.struct("category", "severity", "confidence", "cwe", "owasp").alias("properties"),
        F.when(F.col("suppression").isNotNull(), F.array(F.struct(F.col("suppression").alias("kind"), F.col("justification")))).alias("suppressions"),
    )
    return r.select("rule_id", "uri", "start_line", "start_column", F.to_json(doc).alias("result"))


def _bounded(rows: DataFrame, most: int = REPORT_ROWS) -> list:
    """Rows for a single file, which a driver must hold; refused when there are more than ``most``, never cut."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows for a single file; write them with write_rows")
    return got


def write_rows(rows: DataFrame, path: str) -> None:
    """Findings of any number, as JSON lines, one file a partition."""
    rows.write.mode("overwrite").json(path)


def write_sarif(rows: DataFrame, path: str, version: str, include_suppressed: bool = True) -> None:
    if not include_suppressed and "suppressed" in rows.columns:
        rows = rows.where("not suppressed")
    results = [json.loads(r["result"]) for r in _bounded(sarif_results(rows).orderBy("uri", "start_line", "rule_id", "start_column"))]
    descriptors = [
        {"id": i, "name": i.title().replace("-", ""), "shortDescription": {"text": f"{i} ({c.replace('_', ' ').title()})"}, "help": {"text": f"{o}; {', '.join(w) or 'no CWE'}"}, "defaultConfiguration": {"level": R.LEVELS[s][0]}, "properties": {"security-severity": R.LEVELS[s][1], "tags": ["security", "owasp"] + ["heuristic"] * h, "problem.severity": s.lower()},
         "relationships": [{"target": {"id": w, "toolComponent": {"name": "CWE"}}, "kinds": ["superset"]} for w in cwe] + [{"target": {"id": o, "toolComponent": {"name": "OWASP"}}, "kinds": ["relevant"]}]}
        for _, i, c, s, w, o, h, _ in R.rows()
        for cwe in [w]
    ]
    taxa = {name: list(dict.fromkeys(x for row in R.rows() for x in (row[4] if name == "CWE" else [row[5]]))) for name in ("CWE", "OWASP")}
    run = {"invocations": [{"executionSuccessful": True}], "properties": {"totalFindings": len(results), "suppressedFindings": sum("suppressions" in r for r in results)}, "tool": {"driver": {"name": "lodesieve", "version": version, "rules": descriptors}}, "taxonomies": [{"name": n, "taxa": [{"id": x, "name": x} for x in xs]} for n, xs in taxa.items()], "results": results}
    _write(path, {"$schema": SARIF_SCHEMA, "version": SARIF_VERSION, "runs": [run]})


def write_report(visible: DataFrame, suppressed: DataFrame, scanned: int | DataFrame, path: str, issues: DataFrame | None = None, by_line: bool = False) -> dict:
    """Counts and the ordered findings as JSON; returns the report.  ``scanned``: how many files or hits, or the table of them."""
    findings = [r.asDict() for r in _bounded(S.ordered(visible, by_line))]
    count = lambda column, keys: {k: sum(1 for f in findings if f.get(column) == k) for k in keys}
    met = [r.asDict() for r in _bounded(with_remedies(issues))] if issues is not None else []
    report = {
        "filesAnalyzed": scanned if isinstance(scanned, int) else scanned.count(), "totalIssues": len(findings), "issuesByCategory": count("category", R.CATEGORIES), "issuesBySeverity": count("severity", P.SEVERITIES), "findingsByConfidence": count("confidence", R.CONFIDENCES),
        "findingsByRule": dict(sorted(Counter(f["rule_id"] or f"LEGACY:{f['category']}" for f in findings).items())), "findings": findings, "suppressedFindings": [r.asDict() for r in _bounded(S.ordered(suppressed, by_line))],
        "runtimeIssues": met, "runtimeIssuesByType": {k: sum(1 for i in met if i["type"] == k) for k in R.ISSUES}, "hasRuntimeErrors": any(i["severity"] == "ERROR" for i in met),
    }
    _write(path, report)
    return report


def report_text(report: dict) -> str:
    """The report for reading: counts, issues with what to do about them, then a block a finding."""
    head = [f"Scanned: {report['filesAnalyzed']}", f"Findings: {report['totalIssues']}"] + [f"  {k}: {n}" for k, n in report["issuesBySeverity"].items()]
    blocks = [f"[{f['severity']}] {f['rule_id']} {f['file']}:{f['line']}:{f['column']}\n  {f.get('excerpt', '')}" for f in report["findings"]]
    return "\n".join(head + _issue_lines(report) + [""] + blocks) + "\n"


def _issue_lines(report: dict) -> list[str]:
    met = report.get("runtimeIssues", [])
    errors = sum(i["severity"] == "ERROR" for i in met)
    head = [f"Scan errors and warnings: {len(met)} ({errors} errors, {len(met) - errors} warnings)"] if met else []
    return head + [line for k, i in enumerate(met, 1) for line in (f"{k}. [{i['severity']}] {i['type']}", f"   Where: {i['file']}", f"   Fix:   {i['fix']}")]


def summary_text(report: dict, most: int = 5) -> str:
    """The summary for a terminal: counts, issues, and the first findings."""
    lines = [f"Files analyzed: {report['filesAnalyzed']}", f"Total findings: {report['totalIssues']}", ""]
    for title, counts in (("Findings by category:", "issuesByCategory"), ("Findings by severity:", "issuesBySeverity"), ("Findings by confidence:", "findingsByConfidence")):
        lines += [title, *(f"  {k}: {n}" for k, n in report[counts].items()), ""]
    lines += _issue_lines(report)
    first = report["findings"][:most]
    if first:
        lines += ["Top findings:"] + [f"{k}. [{f['severity']}] {f['rule_id']} {f['file']}:{f['line']}:{f['column']}" for k, f in enumerate(first, 1)]
        lines += [f"... and {report['totalIssues'] - most} more"] if report["totalIssues"] > most else []
    return "\n".join(lines) + "\n"


def search_report(hits: DataFrame, query: str, window: tuple[str, str], matched: int, most: int = 1000) -> dict:
    """The hits of a search that a report shows, with how many there are; truncated from ``most`` hits on, even if they are all."""
    shown = [r.asDict() for r in _bounded(hits.limit(most))]
    return {"query": query, "from": window[0], "to": window[1], "matched": matched, "returned": len(shown), "truncated": len(shown) >= most, "hits": shown}


def search_text(report: dict) -> str:
    head = [f"Search: {report['query']}", f"Window: {report['from']} to {report['to']}", f"Showing {report['returned']} of {report['matched']} hits" + " (truncated)" * report["truncated"], ""]
    return "\n".join(head + [f"{h['ts']}  {h['container']}  {h['index']}/{h['id']}\n  {h['excerpt']}" for h in report["hits"]]) + "\n"


def rule_catalog() -> list[dict]:
    """All rules, as the command line lists them."""
    return [{"id": i, "category": c, "severity": s, "cwe": w, "owasp": o, "heuristic": h, "confidence": f} for _, i, c, s, w, o, h, f in R.rows()]


def baseline_entries(rows: DataFrame) -> DataFrame:
    """fingerprint, rule_id, file: one row a fingerprint, its first by rule and file."""
    key = F.struct(F.coalesce("rule_id", F.concat(F.lit("LEGACY:"), F.col("category"))).alias("rule_id"), F.replace("file", F.lit("\\"), F.lit("/")).alias("file"))
    return rows.groupBy("fingerprint").agg(F.min(key).alias("k")).select("fingerprint", "k.rule_id", "k.file")


def write_baseline(rows: DataFrame, path: str) -> None:
    """The same bytes for the same findings: sorted, without a date."""
    entries = [{"fingerprint": r["fingerprint"], "ruleId": r["rule_id"], "file": r["file"]} for r in _bounded(baseline_entries(rows).orderBy("fingerprint"))]
    _write(path, {"version": 1, "generatedAt": "", "entries": entries})


def read_baseline(spark, path: str) -> DataFrame:
    """fingerprint, rule_id, file, reason; an error for any version but 1.  Entries without a fingerprint are left out."""
    raw = spark.read.option("multiLine", True).schema("version int, entries array<struct<fingerprint:string,ruleId:string,file:string,reason:string>>").json(path)
    heads = raw.select("version", F.col("entries").isNull().alias("none")).limit(2).collect()
    if len(heads) != 1 or heads[0]["version"] != 1 or heads[0]["none"]:
        raise ValueError(f"{path} is no baseline of version 1")
    e = raw.select(F.explode("entries").alias("e"))
    return e.where("e.fingerprint is not null").select("e.fingerprint", F.col("e.ruleId").alias("rule_id"), "e.file", "e.reason")


def _write(path: str, doc: dict) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(doc, f, indent=2, ensure_ascii=False, default=str)
        f.write("\n")
