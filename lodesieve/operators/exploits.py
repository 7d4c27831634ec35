"""Exploits that findings make possible, and chains of them.

An exploit is a row: id, finding_id, type, title, root_cause, severity, file, line, steps (description, notes,
input) and payloads (name, difficulty, success_rate).  Chains are looked for within a group of exploits, such
as a project: for each stage of a chain the exploit of highest severity that isn't in it yet.  No group is
gathered whole, since a chain of three stages can only take one of the three best exploits of each stage.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodesieve.functions import patterns as P

# Scores, stages, chains, and what is said of them.

SCORES = {"CRITICAL": 9.8, "HIGH": 8.0, "MEDIUM": 5.5, "LOW": 2.5, "INFO": 1.0}
STAGES = {
    "initial-access": r"secret|credential|token|jwt|api key|authentication|auth",
    "privilege-escalation": r"mass assignment|prototype|permission|role|access control|authorization|privilege|escalation",
    "execution": r"injection|command|sql|nosql|deserialization|code execution|exec|eval",
    "data-access": r"data|database|query|exposure|exfiltration|read|export|report|admin",
    "persistence": r"persistence|backdoor|queue|cache",
}
OTHER_STAGE = "data-access"
CHAINS = [
    ("Credential Reuse to Privileged Data Access", ["initial-access", "privilege-escalation", "data-access"]),
    ("Injection to Service Compromise", ["execution", "data-access"]),
    ("Privilege Escalation to Data Exfiltration", ["privilege-escalation", "data-access"]),
]
STEP_RISK, MOST_RISK = 0.45, 10.0
DAMAGE = [
    (9.0, "Complete service compromise with privileged data access"),
    (7.0, "High-confidence unauthorized access and sensitive data exposure"),
    (5.0, "Meaningful backend abuse with partial data exposure"),
    (0.0, "Localized impact"),
]
DIFFICULTIES = ["easy", "medium", "hard"]
RELIABLE = 80
NEEDS = [
    ("token|credential|secret", "A credential, token, or trust-boundary weakness is present."),
    ("admin|role|permission", "Privilege boundaries are enforced in code but bypassable in practice."),
    ("data|database|query", "Sensitive backend data is reachable from the affected component."),
]
REACHED, FED = "Attacker can reach the vulnerable backend route or service entry point.", "Attacker-controlled input reaches the vulnerable code path."
SHARED_WORDS, WORD_LENGTH = 2, 4

# End of fixed values.

#: Exploits of a stage that a chain may have to choose from: as many as it has stages.
BEST = max(len(stages) for _, stages in CHAINS)


def exploit_id(prefix: Column, file: Column, line: Column, code: Column) -> Column:
    """The prefix, the line, and 12 hex digits of the SHA-256 of what names the exploit; white space in code collapsed."""
    code = F.trim(F.regexp_replace(F.coalesce(code, F.lit("")), "[" + P.SPACES + "]+", " "))
    payload = F.concat_ws("\0", prefix, F.replace(file, F.lit("\\"), F.lit("/")), line.cast("string"), code)
    return F.concat_ws("-", prefix, line.cast("string"), F.substring(F.sha2(payload.cast("binary"), 256), 1, 12))


def from_findings(findings: DataFrame) -> DataFrame:
    """One exploit a finding, with steps that say where input comes in and what it meets; payloads are left to whoever tests them."""
    words = F.initcap(F.lower(F.replace("category", F.lit("_"), F.lit(" "))))
    title = F.concat_ws(" ", words, F.lit("by"), F.col("rule_id"))
    step = lambda text, notes: F.struct(F.lit(text).alias("description"), notes.alias("notes"), F.lit(None).cast("string").alias("input"))
    return findings.select(
        exploit_id(F.lower(F.replace("category", F.lit("_"), F.lit("-"))), F.col("file"), F.col("line"), F.col("excerpt")).alias("id"), F.concat_ws("-", "category", F.col("line").cast("string")).alias("finding_id"),
        words.alias("type"), title.alias("title"), F.concat_ws(": ", "rule_id", "excerpt").alias("root_cause"), "severity", "file", "line",
        F.array(step("Reach the code", F.concat_ws(":", "file", F.col("line").cast("string"))), step("Meet the weakness", words)).alias("steps"), F.array().cast("array<struct<name:string,difficulty:string,success_rate:double>>").alias("payloads"),
    )


def score(severity: Column) -> Column:
    """The score of a severity, 0 for what is none."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SCORES.items() for x in kv]), severity), F.lit(0.0))


def stages(text: Column) -> Column:
    """The stages that an exploit's words speak of; data access if none."""
    low = F.lower(text)
    found = F.array_compact(F.array(*[F.when(low.rlike(regex), F.lit(name)) for name, regex in STAGES.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(OTHER_STAGE)))


def words_of(exploits: DataFrame) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("type", "title", "root_cause", "finding_id") if c in exploits.columns])


def severity_summary(exploits: DataFrame) -> DataFrame:
    """One row: how many exploits, how many of them are critical, high, medium and low, and the mean of their scores."""
    return exploits.agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in P.SEVERITIES[:4]], _mean())


def _mean() -> Column:
    return F.coalesce(F.avg(score(F.col("severity"))), F.lit(SCORES["MEDIUM"])).alias("mean_score")


def mean_score(exploits: DataFrame, *keys: str) -> DataFrame:
    """The mean of the severities' scores, of each group if keys are given; that of MEDIUM where there are none."""
    return exploits.groupBy(*keys).agg(_mean())


def payload_summary(payloads: DataFrame, *keys: str) -> DataFrame:
    """For each group of ``name, difficulty, success_rate``: total, rounded mean of the rates there are, how many are reliable, and the easiest payload (of equal ones the surest, then by name)."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, DIFFICULTIES)), F.col("difficulty")), F.lit(2))
    order = F.struct(F.when(F.col("difficulty").isNull(), 2).otherwise(rank).alias("d"), (-F.coalesce("success_rate", F.lit(0.0))).alias("r"), F.col("name").alias("n"))
    return payloads.groupBy(*keys).agg(
        F.count("*").alias("total"), F.floor(F.avg("success_rate") + 0.5).cast("long").alias("mean_rate"), F.count_if(F.coalesce("success_rate", F.lit(0.0)) >= RELIABLE).alias("reliable"),
        F.min_by("difficulty", order).alias("easiest"), F.min_by("name", order).alias("recommended"),
    )


def impact(severity: Column, followed: Column) -> tuple[Column, Column]:
    """The risk's multiplier and the estimated damage, where so many weaknesses follow the first."""
    multiplier = F.round(F.lit(1.0) + followed * STEP_RISK, 2)
    final = F.least(F.lit(MOST_RISK), F.when(score(severity) > 0, score(severity)).otherwise(SCORES["MEDIUM"]) * multiplier)
    damage = F.lit(DAMAGE[-1][1])
    for least, text in reversed(DAMAGE[:-1]):
        damage = F.when(final >= least, F.lit(text)).otherwise(damage)
    return multiplier, damage


def chains(exploits: DataFrame, group: str) -> DataFrame:
    """``group, chain, ids, path, multiplier, damage`` for every chain that a group's exploits make up.

    Equal severities go by id, smaller first; a chain whose exploits are those of an earlier chain is left out.
    Null titles are empty; rows without id are left out; repeated ids count once.
    """
    rows = exploits.where("id is not null").dropDuplicates([group, "id"])
    staged = rows.select(group, "id", "severity", F.coalesce("title", F.lit("")).alias("title"), F.explode(stages(words_of(rows))).alias("stage"))
    # the rank's limit is applied before the shuffle too
    best = staged.withColumn("k", F.row_number().over(Window.partitionBy(group, "stage").orderBy(score(F.col("severity")).desc(), "id"))).where(F.col("k") <= BEST)
    held = best.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("stage", "k", "id", "severity", "title"))).alias("all"))
    kind = "struct<stage:string,k:int,id:string,severity:string,title:string>"

    def free(stage: str, taken: Column):
        return lambda x: (x["stage"] == stage) & ~F.array_contains(taken, x["id"])

    def path(wanted: list[str]) -> Column:
        out = F.array().cast(f"array<{kind}>")
        for stage in wanted:
            pick = F.get(F.filter("all", free(stage, F.transform(out, lambda x: x["id"]))), F.lit(0))
            out = F.concat(out, F.when(pick.isNotNull(), F.array(pick)).otherwise(F.array().cast(f"array<{kind}>")))
        return F.when(F.size(out) == len(wanted), out)

    made = held
    for n, (_, wanted) in enumerate(CHAINS):
        made = made.withColumn(f"p{n}", path(wanted))
    ids = lambda c: F.concat_ws("|", F.sort_array(F.transform(c, lambda x: x["id"])))
    kept = []
    for n, (title, _) in enumerate(CHAINS):
        new = F.col(f"p{n}").isNotNull()
        for m in range(n):
            new = new & ~F.coalesce(ids(F.col(f"p{m}")) == ids(F.col(f"p{n}")), F.lit(False))
        kept.append(F.when(new, F.struct(F.lit(title).alias("chain"), F.col(f"p{n}").alias("path"))))
    out = made.select(group, F.explode(F.array_compact(F.array(*kept))).alias("c"))
    multiplier, damage = impact(F.col("c.path")[0]["severity"], F.size("c.path") - 1)
    return out.select(group, "c.chain", F.transform("c.path", lambda x: x["id"]).alias("ids"), F.transform("c.path", lambda x: x["title"]).alias("path"), multiplier.alias("multiplier"), damage.alias("damage"))


def prerequisites(steps: Column) -> Column:
    """What an attacker needs for steps (description, notes, input), in the order in which the steps need it."""

    def needs(s: Column, k: Column) -> Column:
        text = F.lower(F.concat_ws(" ", s["description"], F.coalesce(s["notes"], F.lit(""))))
        return F.array_compact(F.array(F.when(k == 0, F.lit(REACHED)), F.when(F.length(s["input"]) > 0, F.lit(FED)), *[F.when(text.rlike(regex), F.lit(said)) for regex, said in NEEDS]))

    return F.array_distinct(F.flatten(F.transform(steps, needs)))


def complexity(easiest: Column, needs: Column) -> Column:
    """low, medium or high, by the easiest payload and how many things are needed."""
    return F.when((easiest == "easy") & (needs <= 3), F.lit("low")).when((easiest == "hard") | (needs >= 5), F.lit("high")).otherwise(F.lit("medium"))


def title_words(title: Column) -> Column:
    plain = F.regexp_replace(F.lower(title), r"[^a-z0-9\s]", " ")
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda w: F.length(w) >= WORD_LENGTH))


def of_findings(exploits: DataFrame, findings: DataFrame) -> DataFrame:
    """The exploits that belong to a finding: by file, line and title; those without a place by finding_id; those without that by title alone."""
    shown = findings.select("file", "line", F.col("title").alias("_title"), F.concat_ws("-", "category", F.col("line").cast("string")).alias("_id"))
    placed = exploits.where("file is not null and line is not null")
    near = (F.size(F.array_intersect(title_words(F.col("title")), title_words(F.col("_title")))) >= SHARED_WORDS) | (F.col("title") == F.col("_title")) | (F.lower("title").contains("hardcoded") & F.lower("_title").contains("hardcoded"))
    by_place = placed.join(shown.select("file", "line", "_title").distinct().alias("s"), (placed["file"] == F.col("s.file")) & (placed["line"] == F.col("s.line")) & near, "left_semi")
    rest = exploits.where("file is null or line is null")
    by_id = rest.where("finding_id is not null").join(shown.select(F.col("_id").alias("finding_id")).distinct(), "finding_id", "left_semi").select(exploits.columns)
    # there are as many titles as rules, so they may be sent
    titles = F.broadcast(findings.select(F.col("title").alias("_title")).distinct())
    by_title = rest.where("finding_id is null").join(titles, F.col("title").contains(F.col("_title")), "left_semi")
    return by_place.unionByName(by_id).unionByName(by_title)


def diagram(path: list[str]) -> str:
    """The way of a chain, for reading."""
    return "\n".join(["GOAL: backend compromise", "  |", *(f"  [{k}] {name}" for k, name in enumerate(path, 1))])


def fenced(text: str, language: str = "") -> str:
    """A code block whose fence is longer than any run of back quotes in it."""
    fence = "`" * max(3, 1 + max(map(len, re.findall(r"`+", text)), default=0))
    return f"{fence}{language}\n{text}\n{fence}"


def escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def markdown(exploit: dict, found: list[dict] = ()) -> str:
    """A report of one exploit and the chains that it is in; texts from the scanned code can't leave their blocks."""
    lines = [f"# {escaped(exploit['title'])}", "", f"Severity: {exploit['severity']}", f"Place: {escaped(exploit['file'])}:{exploit['line']}", "", "## Root cause", "", fenced(exploit["root_cause"] or ""), "", "## Steps", ""]
    lines += [f"{k}. {escaped(s['description'])} {escaped(s['notes'] or '')}".rstrip() for k, s in enumerate(exploit["steps"] or [], 1)]
    for c in found:
        lines += ["", f"## {escaped(c['chain'])}", "", f"Risk x {c['multiplier']}: {c['damage']}", "", fenced(diagram(c["path"]))]
    return "\n".join(lines) + "\n"
