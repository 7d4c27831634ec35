"""The command line: scans of source code, reviews of logs, and searches.

    python -m lodesieve --mode code --path src
    python -m lodesieve --mode logs --hits hits.parquet --container api --days 15
    python -m lodesieve --mode search --hits hits.json --query '"card declined"'

Ends with 0; with 1 if a finding is at least as severe as --fail-on (or nothing could be written); with 2
for options that make no sense.  ``--hits`` is a table with id, index, container, ts and message, or ``store``
for a log store, whose address and index are options and whose credentials come from the environment.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from datetime import UTC, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesieve.functions import patterns as P
from lodesieve.operators import detectors, report, symbols
from lodesieve.operators import scan as S
from lodesieve.sources import code, hits
from lodesieve.sources.search import matched_total

VERSION = "0.2"


class Usage(Exception):
    pass


def options(args: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser("lodesieve", allow_abbrev=False, exit_on_error=False)
    p.add_argument("-m", "--mode", default="code", type=str.lower, choices=["code", "logs", "search"])
    p.add_argument("-p", "--path", default=".")
    p.add_argument("-q", "--query", default="")
    p.add_argument("--hits")
    p.add_argument("--store-url")
    p.add_argument("--store-index", default="*")
    p.add_argument("--container", default="")
    p.add_argument("--from", dest="start")
    p.add_argument("--to", dest="stop")
    p.add_argument("--days", type=float, default=15)
    p.add_argument("--max-hits", default="")
    p.add_argument("-f", "--format", default="json", type=str.lower, choices=["json", "text", "sarif"])
    p.add_argument("-o", "--output")
    p.add_argument("--min-severity", type=str.upper, choices=P.SEVERITIES)
    p.add_argument("--fail-on", default="HIGH", type=str.upper, choices=P.SEVERITIES)
    p.add_argument("--fail-on-runtime-errors", action="store_true")
    p.add_argument("--include-heuristics", action="store_true")
    p.add_argument("--disable-rule", action="append", default=[])
    p.add_argument("--baseline")
    p.add_argument("--update-baseline", action="store_true")
    p.add_argument("--show-suppressed", action="store_true")
    p.add_argument("--no-gitignore", action="store_true")
    p.add_argument("--list-rules", action="store_true")
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--log-format", default="text", choices=["text", "json"])
    p.add_argument("--version", action="version", version=VERSION)
    try:
        o = p.parse_args(args)
    except argparse.ArgumentError as error:
        raise Usage(str(error)) from None
    if not 0 < o.days <= 365:
        raise Usage(f"--days must be more than 0 and at most 365 (got {o.days})")
    if o.mode == "search" and not o.query.strip():
        raise Usage("--query is missing")
    if o.mode != "code" and not (o.hits or o.store_url):
        raise Usage("--hits or --store-url is missing")
    if o.update_baseline and not o.baseline:
        raise Usage("--baseline must say where the baseline goes")
    o.disable_rule = [r.strip() for x in o.disable_rule for r in x.split(",") if r.strip()]
    o.containers = [c.strip() for c in o.container.split(",") if c.strip()]
    # what isn't a positive number falls back to the mode's own limit
    o.most = int(o.max_hits) if o.max_hits.isdigit() and int(o.max_hits) > 0 else 1000 if o.mode == "search" else 50_000
    stop = datetime.fromisoformat(o.stop.replace("Z", "+00:00")) if o.stop else datetime.now(UTC)
    o.stop = o.stop or stop.isoformat()
    o.start = o.start or (stop - timedelta(days=o.days)).isoformat()
    return o


class _Lines(logging.Formatter):
    """One JSON object a line."""

    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": self.formatTime(record), "level": record.levelname, "message": record.getMessage()})


def log(o: argparse.Namespace | None = None) -> logging.Logger:
    """What is told goes to the error stream, as text or JSON lines: errors only if quiet, details if verbose."""
    out = logging.getLogger("lodesieve")
    out.handlers[:] = [logging.StreamHandler(sys.stderr)]
    out.propagate = False
    out.handlers[0].setFormatter(_Lines() if o and o.log_format == "json" else logging.Formatter("%(levelname)s %(message)s"))
    out.setLevel(logging.ERROR if o and o.quiet else logging.DEBUG if o and o.verbose else logging.INFO)
    return out


def _address(path: str) -> str:
    """A path of this machine as Spark may read it; an address stays as it is."""
    return path if "://" in path else Path(path).resolve().as_uri()


def _hits(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    if o.store_url:
        from lodesieve.sources.store import read_store

        return read_store(spark, url=o.store_url, index=o.store_index, from_=o.start, to=o.stop, containers=",".join(o.containers), most=o.most, **({"query": o.query} if o.mode == "search" else {}))
    return (spark.read.json if o.hits.endswith((".json", ".jsonl")) else spark.read.parquet)(_address(o.hits))


def _ignored(path: str) -> list[str]:
    """The lines of the ignore files of the working folder and of the folder that is scanned."""
    files = dict.fromkeys([Path.cwd() / ".gitignore", Path(path).resolve() / ".gitignore"])
    return [line for f in files if f.is_file() for line in f.read_text(encoding="utf-8").splitlines()]


def review(spark: SparkSession, o: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """All findings, those after the gates with ``suppressed``, what was scanned, and issues."""
    baseline = report.read_baseline(spark, _address(o.baseline)) if o.baseline and not o.update_baseline else None
    gates = {"disabled": o.disable_rule, "heuristics": o.include_heuristics, "least": o.min_severity}
    if o.mode == "code":
        if not Path(o.path).exists():
            raise Usage(f"{o.path}: INVALID_TARGET: {report.REMEDIES['INVALID_TARGET']}")
        folder = Path(o.path).is_dir()
        files = code.source_files(spark, str(Path(o.path).resolve()), ignored=None if o.no_gitignore or not folder else _ignored(o.path)).cache()
        known = symbols.dangerous(symbols.resolved(files)) if folder else None
        return detectors.findings(files, known), detectors.reviewed(files, **gates, baseline=baseline, symbols=known), files, code.issues(files, code.nodes(files))
    window = hits.window_scan(_hits(spark, o), o.start, o.stop, o.containers, o.most).cache()
    found = S.first_of_each(S.gated(S.findings(S.scan(window)), **gates), ["id", "ord", "column"])
    rows = S.suppressed(found, baseline) if baseline is not None else found.withColumn("suppressed", F.lit(False))
    return found, rows, window, None


def run(spark: SparkSession, o: argparse.Namespace, out=print) -> int:
    if o.list_rules:
        out(json.dumps(report.rule_catalog(), indent=2))
        return 0
    if o.mode == "search":
        rows = hits.window_scan(_hits(spark, o), o.start, o.stop, o.containers)
        made = report.search_report(hits.found(rows, o.query, o.most), hits.masked_query(o.query), (o.start, o.stop), matched_total(rows, o.query).first()["value"], o.most)
        text = report.search_text(made) if o.format == "text" else json.dumps(made, indent=2, default=str, ensure_ascii=False)
        Path(o.output).write_text(text, encoding="utf-8") if o.output else out(text)
        return 0
    found, rows, scanned, issues = review(spark, o)
    if o.update_baseline:
        report.write_baseline(found, o.baseline)
        return 0
    visible, held = rows.where("not suppressed"), rows.where("suppressed")
    path = o.output or f"review.{'txt' if o.format == 'text' else o.format}"
    made = report.write_report(visible, held, scanned, path, issues, o.mode == "code")
    if o.format == "sarif":
        report.write_sarif(rows, path, VERSION, o.show_suppressed)
    elif o.format == "text":
        Path(path).write_text(report.report_text(made), encoding="utf-8")
    for issue in made["runtimeIssues"]:
        log(o).log(logging.ERROR if issue["severity"] == "ERROR" else logging.WARNING, "%s %s: %s", issue["type"], issue["file"], issue["fix"])
    log(o).debug("%s findings written to %s", made["totalIssues"], path)
    if not o.quiet:
        out(report.summary_text(made))
    if report.fails(visible, o.fail_on):
        return 1
    return int(o.fail_on_runtime_errors and made["hasRuntimeErrors"])


def main(args: list[str] | None = None) -> int:
    try:
        o = options(sys.argv[1:] if args is None else args)
        return run(SparkSession.builder.appName("lodesieve").getOrCreate(), o)
    except Usage as error:
        log().error("%s", error)
        return 2
    except OSError as error:
        log().error("REPORT_WRITE_FAILURE: %s (%s)", report.REMEDIES["REPORT_WRITE_FAILURE"], error)
        return 1


if __name__ == "__main__":
    sys.exit(main())
