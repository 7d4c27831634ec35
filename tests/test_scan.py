"""The scan against Python's regular expressions, its gates and its excerpts."""

import hashlib
import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lodesieve.functions import checks
from lodesieve.functions import patterns as P
from lodesieve.operators import scan as S
from lodesieve.plans import queries as Q
from lodesieve.plans.lines import TEMPLATES
from lodesieve.sources import hits as H
from lodesieve.streaming.scan_stream import stream_findings, write_findings

LINES = [t.replace("{k}", str(k)) for k in (7, 1234) for t in TEMPLATES] + [None, "x" * 70_000 + " cvv=123", "cvv=123 " + "y" * 70_000, "naïve\u00a0cvv\u00a0=\u00a0123"]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(k, "idx", t) for k, t in enumerate(LINES)], "id long, index string, message string")


def plain_luhn(s):
    total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, s[::-1])))
    return 12 <= len(s) <= 19 and total % 10 == 0


def test_spans_are_those_of_each_pattern(spark, lines):
    got = {}
    for r in Q.matches(lines).collect():
        got.setdefault((r["id"], r["ord"]), []).append((r["start"], r["end"]))
    for number, p in enumerate(P.PATTERNS):
        regex = P.compiled(p)
        for k, t in enumerate(LINES):
            spans = [m.span() for m in regex.finditer((t or "")[: S.SCANNED])]
            found = got.get((k, number), [])
            assert set(found) <= set(spans) and (p.check or found == spans), (p.name, t[:80])


def test_every_pattern_finds_something(lines):
    assert {r["ord"] for r in Q.matches(lines).select("ord").distinct().collect()} == set(range(len(P.PATTERNS)))


def test_checks(spark):
    rows = ["4111111111111111", "4111111111111112", "GB82WEST12345698765432", "GB82WEST12345698765433", "", "abc", "****", "[REDACTED]", "xxxx", "none", "aabbccdd", "8.8.8.8", "10.0.0.1", "172.16.0.1", "172.32.0.1", "300.1.1.1", "378282246310005", "30569309025904", "6011111111111117", "2720999999999996", "6229250000000000"]
    frame = spark.createDataFrame([(r,) for r in rows], "s string")
    c = F.col("s")
    got = {r[0]: tuple(r)[1:] for r in frame.select(c, checks.luhn(c), checks.iban97(c), checks.entropy(c), checks.placeholder(c), checks.public_ipv4(c), checks.card_brand(c), checks.masked(c)).collect()}
    for s, (luhn, iban, entropy, held, public, _, masked) in got.items():
        assert luhn == (s.isdigit() and plain_luhn(s))
        assert entropy == pytest.approx(-sum(s.count(x) / len(s) * math.log2(s.count(x) / len(s)) for x in set(s)))
        assert iban == (s == "GB82WEST12345698765432")
        assert held == (s in ("", "abc", "****", "[REDACTED]", "xxxx", "none"))
        assert public == (s in ("8.8.8.8", "172.32.0.1"))
        n, keep = len(s), (6, 4) if 13 <= len(re.sub(r"\D", "", s)) <= 19 else (2, 2)
        assert masked == ("*" * n if n <= 4 else s[: keep[0]] + "*" * max(0, n - sum(keep)) + s[-keep[1] :])
    assert [got[s][5] for s in ("4111111111111111", "378282246310005", "30569309025904", "6011111111111117", "2720999999999996", "6229250000000000", "abc")] == ["VISA", "AMEX", "DINERS", "DISCOVER", "MASTERCARD", "DISCOVER", None]


def plain_mask(s):
    keep = (6, 4) if 13 <= len(re.sub(r"[^0-9]", "", s)) <= 19 else (2, 2)
    return "*" * len(s) if len(s) <= 4 else s[: keep[0]] + "*" * max(0, len(s) - sum(keep)) + s[-keep[1] :]


def test_excerpts_hide_every_match(lines):
    scanned = S.scan(lines).where("length(message) < 5000")
    by_line = {r["id"]: [(m["start"], m["end"], m["match"]) for m in r["matches"]] for r in scanned.collect()}
    for r in S.findings(scanned).select("id", "column", "excerpt", "ord").collect():
        text, spans = LINES[r["id"]], by_line[r["id"]]
        start, end = next((a, b) for a, b, _ in spans if a == r["column"] - 1)
        hidden = []
        ends = {b for a, b, _ in spans if a == start}
        for end in ends:
            left, right = max(0, start - 40), min(len(text), end + 40)
            merged = []
            for a, b in sorted((max(a, left), min(b, right)) for a, b, _ in spans if b > left and a < right):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            out, at = "", left
            for a, b in merged:
                out, at = out + text[at:a] + plain_mask(text[a:b]), b
            hidden.append(("…" if left else "") + out + text[at:right] + ("…" if right < len(text) else ""))
        assert r["excerpt"] in hidden
        assert all(v not in r["excerpt"] for _, _, v in spans if len(v) > 8)


def test_fingerprint(spark):
    code = "a  b\n c"
    got = spark.range(1).select(S.fingerprint(F.lit("R"), F.lit("f/1"), F.lit(3), F.lit(code)), S.fingerprint(F.lit("R"), F.lit("f/1"), F.lit(None), F.lit(""))).first()
    assert list(got) == [hashlib.sha256(x.encode()).hexdigest()[:16] for x in ("R\0f/1\x003\0a b c", "R\0f/1\0\0")]


def test_gates_dedup_and_baseline(lines):
    rows = S.findings(S.scan(lines), excerpts=False).cache()
    every = rows.count()
    default = {(r["rule_id"], r["severity"]) for r in S.gated(rows).collect()}
    assert all(s in ("CRITICAL", "HIGH") and r not in P.HEURISTIC for r, s in default)
    assert S.gated(rows, heuristics=True).count() == every
    assert "LOG-PCI-001" not in {r["rule_id"] for r in S.gated(rows, ["log-pci-001"], True).collect()}
    once = S.first_of_each(rows, ["id", "ord", "column"])
    assert once.count() == rows.select("fingerprint").distinct().count()
    base = once.where("rule_id = 'LOG-PCI-001'").select("fingerprint", "rule_id", F.lit(None).cast("string").alias("file"))
    assert {r["rule_id"] for r in S.suppressed(once, base).where("suppressed").collect()} == {"LOG-PCI-001"}
    ranks = [P.SEVERITIES.index(r["severity"]) for r in S.ordered(rows).collect()]
    assert ranks == sorted(ranks)
    assert {r["n"] for r in S.dense_counts(rows.where("false"), "severity", P.SEVERITIES).collect()} == {0}


def test_message_and_search(spark):
    rows = spark.createDataFrame([(1, "c", "2024-01-01", '{"message":"hello cvv=123"}'), (2, "d", "2024-01-02", '{"msg":"","event":{"original":"deep hello"}}'), (2, "d", "2024-01-02", '{"msg":"","event":{"original":"deep hello"}}'), (3, "c", "2024-01-03", None)], "i long, c string, t string, s string").withColumn("t", F.col("t").cast("timestamp"))
    hits = H.hits(rows, "i", F.lit("x"), "c", "t", "s")
    got = {r["id"]: r["message"] for r in hits.collect()}
    assert got[1].startswith("hello cvv=123\n{") and got[2].startswith("deep hello\n") and got[3] == ""
    assert [r["id"] for r in H.window_scan(hits, "2024-01-01", "2024-01-03", None, 5).collect()] == [1, 2]
    assert [r["id"] for r in H.window_scan(hits, "2024-01-01", "2024-01-09", [" c ", ""]).orderBy("id").collect()] == [1, 3]
    found = H.found(hits.dropDuplicates(["id"]), "hello").collect()
    assert [r["id"] for r in found] == [2, 1] and "cvv=123" not in found[1]["excerpt"]
    assert H.masked_query('"secret phrase" abc field:value') == '"s***********e" abc fi*******ue' and H.needle('app:x "a" foo') == '"a"' and H.needle('"two words"') == "two words"


def test_stream_gives_what_the_batch_gives(spark, lines, tmp_path):
    rows = lines.where("length(message) < 5000").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    write_findings(stream_findings(stream), f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination(120)
    keys = ["id", "ord", "column", "fingerprint"]
    want = {tuple(r) for r in S.gated(S.findings(S.scan(rows))).select(*keys).collect()}
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select(*keys).collect()} == want and want


def test_queries_match_their_sql(spark, tmp_path):
    """A few registered queries on a small table; the driver compares all of them."""
    con = duckdb.connect()
    con.execute(f"copy (select range as o_orderkey from range({2 * len(TEMPLATES)})) to '{tmp_path}/orders.parquet'")
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    for name in ("log_pan", "log_emirates_id", "log_iban", "log_high_entropy_secret", "log_plaintext_password", "baseline_split", "count_severity_dense"):
        frame = Q.queries()[name](spark, str(tmp_path))
        cols = sorted(frame.columns)
        sql = ", ".join(f'"{c}"' for c in cols)
        assert sorted(map(str, (tuple(r) for r in frame.select(*cols).collect()))) == sorted(map(str, con.execute(f"select {sql} from ({Q.oracle_sql()[name]})").fetchall())), name


def test_times_of_many_events_match_their_sql(spark, tmp_path):
    """Ids as far as those of 60 times the events at sf0.1, whose years pass 9999, and some beyond."""
    con = duckdb.connect()
    con.execute(f"copy (select unnest([0, 1, 2, 99999, 2932896, 2932899, 2932900, 2932901, 5999997, 5999998, 5999999, 36000000, 99999999, -3, -719166, -719529, -1000002, -5000001, null]::bigint[]) as event_id) to '{tmp_path}/events.parquet'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = Q.queries()["resolve_timestamp"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(Q.oracle_sql()["resolve_timestamp"]).fetchall()))


def test_documents_are_scanned_whole(spark, tmp_path):
    """A late match, and one across the place where log lines are cut, as in the query's SQL."""
    texts = ["word " * 20_000 + "cvv=123", "x" * (S.SCANNED - 5) + " cvv=123; 4111111111111111", "cvv=123 " + "y " * 40_000 + "cvv=456", None]
    spark.createDataFrame([(k, "s", t) for k, t in enumerate(texts)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in Q.queries()["scan_documents_by_rule"](spark, str(tmp_path)).select("rule_id", "severity", "n", "n_docs").collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.execute(f"select rule_id, severity, n, n_docs from ({Q.oracle_sql()['scan_documents_by_rule']})").fetchall())
    assert ("LOG-PCI-002", "CRITICAL", 4, 3) in got and ("LOG-PCI-001", "CRITICAL", 1, 1) in got


def test_progress_and_cancellation(spark, lines, tmp_path):
    import threading
    import time

    from lodesieve.streaming import scan_stream as T

    lines.withColumn("ts", F.current_timestamp()).write.parquet(f"{tmp_path}/in")
    hits = spark.readStream.schema("id long, index string, message string, ts timestamp").parquet(f"{tmp_path}/in")
    told = []
    with T.progress(spark, told.append):
        T.write_findings(T.stream_findings(hits), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        for _ in range(50):
            if told and told[-1] >= len(LINES):
                break
            time.sleep(0.1)
    assert told[-1] == len(LINES)
    ended = []

    def slow():
        with T.cancellable(spark, "scan-1"):
            try:
                spark.range(4, numPartitions=4).mapInPandas(lambda it: (time.sleep(60) or x for x in it), "id long").count()
            except Exception as error:
                ended.append(error)

    t = threading.Thread(target=slow)
    t.start()
    for _ in range(100):
        time.sleep(0.2)
        T.cancel(spark, "scan-1")
        if not t.is_alive():
            break
    assert ended and not t.is_alive()
