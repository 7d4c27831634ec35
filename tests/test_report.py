"""Reports, exchange rows, baselines, suppressions, chains and search."""

import json
import re

import pytest
from pyspark.sql import functions as F

from lodesieve.functions import rules as R
from lodesieve.operators import report
from lodesieve.operators import scan as S
from lodesieve.sources import hits as H
from lodesieve.sources import search as Q

COLUMNS = "rule_id string, severity string, category string, file string, line int, column int, fingerprint string, id long, ord int, excerpt string"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [
            ("LOG-PCI-001", "CRITICAL", "LOG_PCI", "i/1", 1, 3, "f1", 1, 0, "x" * 300), ("LOG-PII-003", "MEDIUM", "LOG_PII", "/abs/a b.log", 1, 1, "f2", 2, 1, "e"), ("LOG-PII-009", "CRITICAL", "LOG_PII", "C:\\w\\x.log", 0, 0, "", 3, 2, ""),
            (None, "HIGH", "LOGGING", "i/4", 7, 1, "f4", 4, 3, None), ("LOG-PCI-001", "CRITICAL", "LOG_PCI", "i/0", 1, 3, "f1", 5, 0, "y"), ("BCR-JWT-009", "HIGH", "AUTHENTICATION", "i/5", 2, 2, "f5", 6, 4, "z"),
        ],
        COLUMNS,
    )


def test_rule_table(spark):
    table = R.rules(spark).collect()
    assert len(table) == 128 and {r["rule_category"] for r in table} == set(R.CATEGORIES)
    assert [r["default_confidence"] for r in table if r["rule_id"] in ("BCR-AUTH-001", "BCR-AUTH-002")] == ["TENTATIVE", "FIRM"]


def test_enriched_and_counts(rows):
    got = {r["id"]: r for r in report.enriched(rows).collect()}
    assert len(got) == 6 and got[1]["cwe"] == ["CWE-532", "CWE-359"] and got[2]["confidence"] == "TENTATIVE" and got[3]["cwe"] is None and got[3]["confidence"] == "FIRM" and not got[4]["heuristic"]
    assert {r["rule_id"]: r["n"] for r in report.count_by_rule(rows).collect()}["LEGACY:LOGGING"] == 1
    assert {r["id"] for r in report.exploitable(rows).collect()} == {1, 3, 5}
    assert report.fails(rows, "critical") and not report.fails(rows.where("severity = 'MEDIUM'"), "HIGH")


def test_exchange_file(rows, tmp_path):
    held = rows.withColumn("suppressed", F.col("id") == 1).withColumn("reason", F.lit("known"))
    report.write_sarif(held, f"{tmp_path}/d/r.sarif", "1")
    run = json.load(open(f"{tmp_path}/d/r.sarif"))["runs"][0]
    assert len(run["tool"]["driver"]["rules"]) == 128 and len(run["results"]) == 6
    by = {r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"]: r for r in run["results"]}
    assert set(by) == {"i/1", "file:///abs/a%20b.log", "file:///C:/w/x.log", "i/4", "i/0", "i/5"}
    one, odd = by["i/1"], by["file:///C:/w/x.log"]
    assert one["level"] == "error" and one["suppressions"] == [{"kind": "external", "justification": "known"}] and one["ruleIndex"] == [r[0] for r in R.RULES].index("LOG-PCI-001")
    assert len(one["locations"][0]["physicalLocation"]["region"]["snippet"]["text"]) == 200
    assert "ruleIndex" not in odd and "suppressions" not in odd and odd["partialFingerprints"][report.FINGERPRINT_KEY] == "LOG-PII-009:C:/w/x.log:0" and odd["locations"][0]["physicalLocation"]["region"]["startLine"] == 1
    report.write_sarif(held, f"{tmp_path}/s.sarif", "1", include_suppressed=False)
    assert len(json.load(open(f"{tmp_path}/s.sarif"))["runs"][0]["results"]) == 5


def test_report_file(rows, tmp_path):
    out = report.write_report(rows, rows.where("false"), 9, f"{tmp_path}/r.json")
    assert out["filesAnalyzed"] == 9 and out["totalIssues"] == 6 and out["issuesByCategory"]["SSRF"] == 0 and out["issuesBySeverity"]["CRITICAL"] == 3 and [f["id"] for f in out["findings"]][:3] == [3, 5, 1]
    assert json.load(open(f"{tmp_path}/r.json"))["totalIssues"] == 6 and "[CRITICAL] LOG-PCI-001 i/0:1:3" in report.report_text(out)
    with pytest.raises(ValueError):
        report._bounded(rows, 5)


def test_baseline_round_trip(spark, rows, tmp_path):
    a, b = f"{tmp_path}/a.json", f"{tmp_path}/b.json"
    report.write_baseline(rows, a)
    report.write_baseline(rows.orderBy(F.desc("id")), b)
    assert open(a).read() == open(b).read()
    known = report.read_baseline(spark, a)
    assert known.count() == 5
    got = {r["id"]: r["suppressed"] for r in S.suppressed(rows, known).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: True, 6: True}
    for bad in ('{"version": 2, "entries": []}', '{"version": 1}', "[]"):
        open(b, "w").write(bad)
        with pytest.raises(ValueError):
            report.read_baseline(spark, b)


def test_suppressions(spark, rows):
    text = "a // bcr-disable-next-line x-1, y\nb // bcr-disable-line Z -- why \n// bcr-disable-next-line *\nc\n// bcr-disable-next-line x-1\n// bcr-disable-line x-2 -- second\n"
    marks = report.suppressions(spark.createDataFrame([("f", text), ("g", ""), ("h", None)], "file string, content string"))
    got = {(r["file"], r["line"]): (r["rule_ids"], r["reason"]) for r in marks.collect()}
    assert got == {("f", 2): (["X-1", "Z"], "why"), ("f", 4): (["*"], None), ("f", 6): (["X-1", "X-2"], "second")}
    found = spark.createDataFrame([("f", 2, "z"), ("f", 2, "q"), ("f", 4, "q"), ("f", 5, "q")], "file string, line int, rule_id string")
    assert sorted((r["line"], r["rule_id"], r["suppressed"], r["reason"]) for r in report.inline_suppressed(found, marks).collect()) == [(2, "q", False, None), (2, "z", True, "why"), (4, "q", True, None), (5, "q", False, None)]


def test_chains(spark):
    rows = spark.createDataFrame([(1, "AUTHENTICATION"), (1, "ACCESS_CONTROL"), (1, "BUSINESS_LOGIC"), (2, "VALIDATION"), (3, "SSRF"), (3, None)], "k int, category string")
    assert sorted((r["k"], [c for c, _ in report.CHAINS].index(r["chain"])) for r in report.chains(rows, "k").collect()) == [(1, 0), (1, 4), (2, 2)]


def test_search(spark):
    texts = ["Error: card declined", "card declined_twice", "declined card ok", "login error", None, "", "wild cards"]
    rows = spark.createDataFrame([(k, t, "a" if k % 2 else None) for k, t in enumerate(texts)], "id int, message string, container string")
    want = {"card declined": [0, 2], '"card declined"': [0], "error OR ok": [0, 2, 3], "card* -declined": [1, 6], "error NOT login": [0], "container:a error": [3], "(error OR wild) AND card?": [6], "message:Login": [3], "+error !card": [3]}
    for query, ids in want.items():
        assert [r["id"] for r in Q.search(rows, query).orderBy("id").collect()] == ids, query
        assert Q.matched_total(rows, query).first()["value"] == len(ids)
    for bad in ("*x", "(a", "a)", "OR", "", "nofield:x", '"'):
        with pytest.raises(ValueError):
            Q.search(rows, bad)


def test_excerpts_stay_in_their_part(spark):
    rows = spark.createDataFrame([(1, "c", "2024-01-01", '{"message":"hello there","k":"cvv=123"}')], "i long, c string, t string, s string").withColumn("t", F.col("t").cast("timestamp"))
    hits = H.hits(rows, "i", F.lit("x"), "c", "t", "s")
    got = [r for r in S.findings(S.scan(hits, "cvv")).collect()]
    assert len(got) == 1 and got[0]["excerpt"].startswith('[_source] {"message"') and "123" not in got[0]["excerpt"] and got[0]["column"] == '{"message":"hello there","k":"cvv=123"}'.index("cvv") + 1
    shown = lambda q: H.excerpts(hits, q).first()["excerpt"]
    assert shown("hello") == "he*lo there" and shown("absent").startswith("[_source] ") and "123" not in shown("absent")
    assert H.excerpts(hits.withColumn("message", F.lit("a\nb")).withColumn("message_field_length", F.lit(3)), "zz").first()["excerpt"] == "a"


def test_times_and_links(spark):
    docs = ['{"t":0}', '{"t":1704067200123}', '{"t":-1}', '{"t":1.9}', '{"t":"x"}', '{"t":null}', "{}", "bad", None, '{"t":true}']
    frame = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "k int, d string")
    got = [r[0] for r in frame.orderBy("k").select(H.timestamp(F.col("d"), "$.t")).collect()]
    assert got == ["1970-01-01T00:00:00.000Z", "2024-01-01T00:00:00.123Z", "1969-12-31T23:59:59.999Z", "1970-01-01T00:00:00.001Z", "x", "", "", "", "", ""]
    link = spark.range(1).select(H.deep_link("h", "i", F.lit("a b\"'"), F.lit("")), H.scrubbed(F.lit("x https://u:p@h/y"))).first()
    assert "_id:\"a%20b%22'\"" in link[0] and link[1] == "x https://h/y" and re.search(r"from:''", link[0])


def test_years_beyond_four_digits(spark):
    docs = {253402300799999: "9999-12-31T23:59:59.999Z", 253402300800000: "+010000-01-01T00:00:00.000Z", 8640000000000000: "+275760-09-13T00:00:00.000Z", 8640000000000001: "", -62167219200000: "0000-01-01T00:00:00.000Z", -62167219200001: "-000001-12-31T23:59:59.999Z", -8640000000000000: "-271821-04-20T00:00:00.000Z", 10**18: ""}
    frame = spark.createDataFrame([(f'{{"t":{n}}}',) for n in docs], "d string")
    assert dict(frame.select("d", H.timestamp(F.col("d"), "$.t")).collect()) == {f'{{"t":{n}}}': want for n, want in docs.items()}
