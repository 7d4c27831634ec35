"""Exploits: made from findings, matched with them, chained, and written."""

import hashlib

from pyspark.sql import functions as F

from lodesieve.operators import exploits as E

KIND = "id string, project string, type string, title string, root_cause string, severity string, finding_id string, file string, line int"


def table(spark, rows):
    return spark.createDataFrame(rows, KIND)


def test_chains(spark):
    rows = [("b", "p", "x", "Leaked token", "", "HIGH", None, "f", 1), ("a", "p", "x", "Leaked token", "", "HIGH", None, "f", 1), ("c", "p", "x", "Role escalation", None, "LOW", None, "f", 2), ("d", "p", None, None, None, "INFO", None, None, None), ("d", "p", None, None, None, "INFO", None, None, None), (None, "p", "x", "Leaked token", "", "CRITICAL", None, None, None), ("e", "q", "x", "Command injection", "", "CRITICAL", None, None, None)]
    got = {(r["project"], r["chain"]): (r["ids"], r["multiplier"], r["damage"]) for r in E.chains(table(spark, rows), "project").collect()}
    assert got == {("p", E.CHAINS[0][0]): (["a", "c", "d"], 1.9, E.DAMAGE[0][1]), ("p", E.CHAINS[2][0]): (["c", "d"], 1.45, E.DAMAGE[3][1])}
    assert E.chains(table(spark, []), "project").count() == 0


def test_findings(spark):
    found = spark.createDataFrame([("BCR-VAL-001", "CRITICAL", "VALIDATION", "a\\b.ts", 7, "db.query(\n  q)")], "rule_id string, severity string, category string, file string, line int, excerpt string")
    made = E.from_findings(found).first().asDict(recursive=True)
    assert made["id"] == "validation-7-" + hashlib.sha256(b"validation\0a/b.ts\0" + b"7\0db.query( q)").hexdigest()[:12] and made["finding_id"] == "VALIDATION-7" and len(made["steps"]) == 2
    titled = found.withColumn("title", F.lit("Validation by BCR-VAL-001"))
    assert E.of_findings(E.from_findings(found), titled).count() == 1 and E.of_findings(E.from_findings(found), titled.withColumn("line", F.lit(8))).count() == 0
    assert E.mean_score(table(spark, [])).first()[0] == 5.5 and E.severity_summary(table(spark, [])).first()["total"] == 0
    made["title"], made["root_cause"] = "<b>", "```\n````js"
    text = E.markdown(made, [{"chain": "c", "multiplier": 1.45, "damage": "d", "path": ["x", "y"]}])
    assert "<b>" not in text and "`````\n```\n````js\n`````" in text and "[2] y" in text
