"""Log hits from tables of raw documents: message, time, window, free text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesieve.operators import scan as S
from lodesieve.sources.search import search

#: Characters of the structured document that follow the message.
STRUCTURED = 16_384
#: Where a message may stand in a document, in order of preference.
MESSAGE_FIELDS = ["$.message", "$.msg", "$.event.original", "$.log.message"]


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a plain read over all cores where it has fewer partitions than there are cores; a large input stays as it was read.

    The scan costs far more than moving its lines once, and a small file is one partition.  For reads only, whose
    partitions are known without running anything.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def resolved(source: Column) -> tuple[Column, Column]:
    """Message (the first field that isn't empty, then the document itself on a new line) and length of its first part."""
    primary = F.coalesce(*[F.nullif(F.get_json_object(source, f), F.lit("")) for f in MESSAGE_FIELDS], F.lit(""))
    document = F.substring(F.coalesce(source, F.lit("")), 1, STRUCTURED)
    return F.when(F.length(primary) > 0, F.concat_ws("\n", primary, document)).otherwise(document), F.length(primary)


def hits(rows: DataFrame, id_: str, index: Column, container: str, ts: str, source: str) -> DataFrame:
    message, length = resolved(F.col(source))
    return rows.select(F.col(id_).alias("id"), index.alias("index"), F.col(container).alias("container"), F.col(ts).alias("ts"), message.alias("message"), length.alias("message_field_length"))


def event_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", F.lit("events"), "event_type", "ts", "props")


def window_scan(rows: DataFrame, start: str, stop: str, containers: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Hits from start (included) to stop (excluded), one for each id, the first to arrive; with ``most``, the earliest so many in order of time.

    Hits arrive in order of time; of those with equal times the one that sorts first comes first.  Null ids are left out.
    """
    rows = rows.where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(stop).cast("timestamp")))
    names = [c.strip() for c in containers or [] if c.strip()]
    rows = rows.where(F.col("container").isin(names)) if names else rows
    others = [c for c in rows.columns if c not in ("id", "ts")]
    rows = rows.where("id is not null").groupBy("id").agg(F.min(F.struct("ts", *others)).alias("first")).select("id", "first.*").select(rows.columns)
    return rows.orderBy("ts", "id").limit(most) if most else rows


def masked_query(query: str) -> str:
    """A query with its phrases and longer words hidden, as it may stand in a report."""
    hide = lambda m: "*" * len(m[0]) if len(m[0]) <= 4 else m[0][:2] + "*" * (len(m[0]) - 4) + m[0][-2:]
    return re.sub(r'"[^"]+"|[^\s()]{4,}', hide, query)


def needle(query: str) -> str:
    """What of a query is looked for in a message: a quoted phrase, or its first word that names no field."""
    query = query.strip()
    if len(query) > 2 and query[0] == query[-1] == '"' and '"' not in query[1:-1]:
        return query[1:-1]
    return next((t for t in re.split(r"[\s()]+", query) if not re.match(r"[+\-!]?\w+:", t)), query)


def timestamp(source: Column, path: str) -> Column:
    """A time field of a document: a string as it is, a number of milliseconds as ISO 8601 in UTC, else empty.

    Years before 0 and after 9999 have a sign and six digits, as ISO 8601 expands them.
    """
    value = F.try_variant_get(F.try_parse_json(source), path, "variant")
    kind = F.schema_of_variant(value)
    millis = F.floor(F.coalesce(F.try_variant_get(value, "$", "double"), F.lit(0.0)))
    day, rest = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(millis / 86_400_000).cast("int")), F.pmod(millis, F.lit(86_400_000))
    two = lambda c, n=2: F.lpad(c.cast("long").cast("string"), n, "0")
    clock = F.concat(two(F.floor(rest / 3_600_000)), F.lit(":"), two(F.floor(rest / 60_000) % 60), F.lit(":"), two(F.floor(rest / 1000) % 60), F.lit("."), two(rest % 1000, 3), F.lit("Z"))
    date = day.cast("string")
    for digits, zeros in ((4, "00"), (5, "0")):  # of a year with a sign
        date = F.regexp_replace(date, rf"(?<=^[+-])(?=\d{{{digits}}}-)", zeros)
    iso = F.concat(date, F.lit("T"), clock)
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(kind.rlike("^(?:BIGINT|DOUBLE|DECIMAL)") & (F.abs(millis) <= 8_640_000_000_000_000), iso).otherwise(F.lit(""))


def encoded(text: Column) -> Column:
    """Percent-encoded as a component of an address."""
    out = F.url_encode(text)
    for code, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def deep_link(base: str, index: str, id_: Column, ts: Column) -> Column:
    """Address that shows one document in the log store; the format is fixed."""
    return F.concat(F.lit(f"{base}/app/discover#/?_g=(time:(from:'"), encoded(ts), F.lit(f"',to:now))&_a=(index:'{index}',query:(language:kuery,query:'_id:\""), encoded(id_), F.lit("\"'))"))


def scrubbed(url: Column) -> Column:
    """An address without its user and password."""
    return F.regexp_replace(url, r"(?i)\b([a-z][a-z0-9+.\-]*://)[^/@\s]+@", "$1")


def excerpts(rows: DataFrame, query: str) -> DataFrame:
    """id, index, container, ts and an excerpt in which every sensitive value is masked.

    It is cut around the query; else around the first value found; else it is the head of the first line.
    """
    text = needle(query)
    message = F.coalesce("message", F.lit(""))
    primary = F.coalesce("message_field_length", F.length(message)) if "message_field_length" in rows.columns else F.length(message)
    rows = S.scan(rows.withColumn("_primary", primary).withColumn("message", message))
    at = F.locate(text, F.col("message")) - 1
    first = F.get("matches", F.lit(0))

    def cut(start: Column, end: Column) -> Column:
        inside, lo, hi = S.field(F.col("message"), F.col("_primary"), start)
        return S.labelled(inside, S.redacted(F.col("message"), start, end, F.col("matches"), lo, hi))

    end = F.least(F.length("message"), at + len(query))
    head = F.substring(F.get(F.split("message", "\n"), F.lit(0)), 1, 200)
    shown = F.when(at >= 0, cut(at, end)).when(F.size("matches") > 0, cut(first["start"], first["end"])).otherwise(head)
    return rows.select("id", "index", "container", "ts", shown.alias("excerpt"))


def found(rows: DataFrame, query: str, most: int = 1000) -> DataFrame:
    """The latest hits that the query holds for, with excerpts."""
    return excerpts(search(rows, query).orderBy(F.desc("ts"), "id").limit(most), query)
