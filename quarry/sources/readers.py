"""Readers for the text formats of triage: settings, Markdown tables and sections, logs, tickets, paged replies.

Readers take lines (source, line_no, value; the numbers of a source follow one
another); lines_of() makes them from files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import TICKET_CHARS, cap, is_issue_key, strip
from quarry.operators.carry import carried

PLACEHOLDER = "PASTE_"


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """source, line_no (from 1) and value of the lines of text files.

    A file may be read in many splits: a line's number is its place in its
    split and the lines of the splits before it, so no task sees a whole file.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = rows.groupBy("source", "block").agg(F.count(F.lit(1)).alias("n")).select("source", "block", before.alias("before"))
    numbered = rows.withColumn("at", F.row_number().over(Window.partitionBy("source", "block").orderBy("id")))
    return numbered.join(blocks, ["source", "block"]).select("source", (F.col("before") + F.col("at")).alias("line_no"), "value")


#: Lines of a source that one window takes; what goes down from one stretch to the next is carried as a row.
STRETCH = 1 << 16


def _carried(lines: DataFrame, values: dict[str, Column], inclusive: bool = True) -> DataFrame:
    return carried(lines, values, ["source"], F.floor(F.col("line_no") / STRETCH), ["line_no"], inclusive)


def fetch_issues(requests: DataFrame, issues: DataFrame, error_chars: int = 500) -> DataFrame:
    """requests (issue_key) with raw, the issue's text from the table issues (issue_key, raw), cut like a request's, or an error.

    Keys are compared stripped and in capitals. What is no key, and a key that is not there, give an error text.
    """
    key = F.upper(strip("issue_key"))
    held = issues.select(F.upper(strip("issue_key")).alias("__key"), "raw").groupBy("__key").agg(F.min("raw").alias("raw"))
    found = requests.withColumn("issue_key", key).join(held, F.col("issue_key") == F.col("__key"), "left")
    error = F.when(~is_issue_key("issue_key"), F.concat(F.lit("not a key: "), F.coalesce("issue_key", F.lit("")))).when(F.col("__key").isNull(), F.concat(F.lit("no issue "), F.col("issue_key")))
    return found.withColumns({"raw": cap("raw", TICKET_CHARS), "error": cap(error, error_chars)}).drop("__key")


def read_settings(lines: DataFrame) -> DataFrame:
    """key and val of KEY=VALUE lines: comments, blanks, empty values and placeholders skipped; the last valid one counts."""
    row = strip("value")
    val = strip(F.regexp_replace(row, r"(?s)^[^=]*=", ""))
    val = F.regexp_replace(F.regexp_replace(val, r'^"+|"+\z', ""), r"^'+|'+\z", "")
    good = lines.where((row != "") & ~row.startswith("#") & row.contains("=")).select(strip(F.split(row, "=", 2)[0]).alias("key"), val.alias("val"), "line_no")
    good = good.where((F.col("val") != "") & ~F.col("val").startswith(PLACEHOLDER))
    return good.groupBy("key").agg(F.max_by("val", "line_no").alias("val"))


def is_ready(lines: DataFrame) -> DataFrame:
    """source, ready: no line of it, not even a comment, holds a placeholder (the launcher's gate is stricter than the reader)."""
    return lines.groupBy("source").agg((~F.coalesce(F.max(F.col("value").contains(PLACEHOLDER)), F.lit(False))).alias("ready"))


def read_pipe_table(lines: DataFrame) -> DataFrame:
    """source, line_no and cells of the body rows of Markdown tables; a table's first row and its rule are left out."""
    row = F.col("value").rlike(r"^\s*\|")
    # The line just before is a row of the table too.
    rows = _carried(lines, {"__prior": F.coalesce(row, F.lit(False))}, inclusive=False).where(row & F.col("__prior"))
    inner = F.regexp_replace(strip("value"), r"^\||\|\z", "")
    return rows.where(~F.col("value").rlike(r"^\s*\|[\s|:-]+\z")).select("source", "line_no", F.transform(F.split(inner, r"\|", -1), strip).alias("cells"))


def read_sections(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folders (title, folder_path, test_count, truncated, legacy) and tests (key, summary, folder_path) of a sectioned catalogue.

    A heading carries down to the lines below it.
    """
    head = F.nullif(F.regexp_extract("value", r"^###\s+(.*?)\s*\z", 1), F.lit(""))
    folder = F.nullif(F.regexp_extract("value", r"`(/[^`]*)`", 1), F.lit(""))
    count = F.coalesce(F.nullif(F.regexp_extract("value", r"\b([0-9]+) tests?\b", 1), F.lit("")), F.regexp_extract("value", r"(?i)^\s*[-*]\s+tests? count:\s*([0-9]+)", 1))
    rows = _carried(lines, {"title": head, "at": F.when(head.isNotNull(), F.col("line_no")), "__folder": F.when(folder.isNotNull(), F.struct("line_no", folder.alias("path")))})
    rows = rows.withColumn("folder_path", F.when(F.col("__folder.line_no") >= F.col("at"), F.col("__folder.path")))
    folders = rows.where("title is not null").groupBy("source", "at").agg(
        F.max("title").alias("title"),
        F.max("folder_path").alias("folder_path"),
        F.max(F.try_to_number(F.nullif(count, F.lit("")), F.lit("999999999")).cast("int")).alias("test_count"),
        F.max(F.col("value").contains("showing first")).alias("truncated"),
        F.max(F.lower("value").contains("only for reference")).alias("legacy"),
    )
    found = r"^\s*[-*]\s+([A-Z][A-Z0-9]+-[0-9]+):\s*(.*?)\s*\z"
    tests = rows.where(F.col("value").rlike(found)).select("source", F.regexp_extract("value", found, 1).alias("key"), F.regexp_extract("value", found, 2).alias("summary"), "folder_path")
    return folders.drop("source", "at"), tests.drop("source")


LOG_LINE = r"^(\S+)\s+(\S+)\s+(\S+)\s+(.*)\z"


def log_fields(value: Column) -> dict[str, Column]:
    """ts, level, component, msg and kv (the k=v words of the message) of a log line."""
    msg = F.regexp_extract(value, LOG_LINE, 4)
    pairs = F.regexp_extract_all(msg, F.lit(r"(\w+=\S+)"), 1)
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_replace(p, r"^[^=]*=", "").alias("value")))
    # A key that comes twice keeps its first value.
    first = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, 1, i), lambda x: x["key"] == e["key"]))
    return {"ts": F.try_to_timestamp(F.regexp_extract(value, LOG_LINE, 1)), "level": F.regexp_extract(value, LOG_LINE, 2), "component": F.regexp_extract(value, LOG_LINE, 3), "msg": msg, "kv": F.map_from_entries(first)}


def read_log(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("value").rlike(LOG_LINE)).select("source", "line_no", *[c.alias(n) for n, c in log_fields(F.col("value")).items()])


def read_ticket(lines: DataFrame) -> DataFrame:
    """source, fields (map of `- **Name:** value`) and sections (map from `##` heading to its text)."""
    field = r"^- \*\*(.+?):\*\*\s*(.*?)\s*\z"
    fields = lines.where(F.col("value").rlike(field)).groupBy("source", F.regexp_extract("value", field, 1).alias("k")).agg(F.max_by(F.regexp_extract("value", field, 2), "line_no").alias("v"))
    fields = fields.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("fields"))
    head = F.nullif(F.regexp_extract("value", r"^##\s+(.*?)\s*\z", 1), F.lit(""))
    body = _carried(lines.withColumn("own", head.isNotNull()), {"h": head}).where("h is not null and not own and not value rlike '^- \\\\*\\\\*.+?:\\\\*\\\\*'")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]), "\n")
    sections = body.groupBy("source", "h").agg(strip(text).alias("t")).groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("h", "t")))).alias("sections"))
    return lines.select("source").distinct().join(fields, "source", "left").join(sections, "source", "left")


PAGE = "data struct<getTests: struct<total: bigint, start: bigint, limit: bigint, results: array<struct<issueId: string, testType: struct<name: string>, jira: struct<key: string, summary: string>>>>>"


def paged_tests(bodies: DataFrame) -> DataFrame:
    """One row for each test of reply pages (value, one JSON text each); total, start and limit beside it. A page that is no such object gives none."""
    page = bodies.select(F.from_json("value", PAGE).alias("p")).select("p.data.getTests.*")
    rows = page.select("total", "start", "limit", F.explode("results").alias("r"))
    return rows.select("total", "start", "limit", F.col("r.issueId").alias("issue_id"), F.col("r.testType.name").alias("test_type"), F.col("r.jira.key").alias("key"), F.col("r.jira.summary").alias("summary"))


def read_paged_tests(spark: SparkSession, path: str) -> DataFrame:
    """The tests of saved reply pages, a file each."""
    return paged_tests(spark.read.text(path, wholetext=True))


REQUEST = "bugId string, description string"


def read_request(body: Column | str) -> dict[str, Column]:
    """ticket_id, description and status of a JSON request body: empty counts as {}, what is no object is 400, nothing asked is 400 too."""
    raw = F.coalesce(F.nullif(strip(body), F.lit("")), F.lit("{}"))
    made = F.from_json(raw, f"{REQUEST}, __corrupt string", {"columnNameOfCorruptRecord": "__corrupt"})
    sound = raw.rlike(r"^\{") & made["__corrupt"].isNull()
    ticket, detail = (F.coalesce(strip(F.when(sound, made[n])), F.lit("")) for n in ("bugId", "description"))
    return {"ticket_id": ticket, "description": detail, "status": F.when(~sound, 400).when((ticket == "") & (detail == ""), 400).otherwise(200)}


def in_scope(path: Column | str, include: list[str], exclude: list[str]) -> Column:
    """Under one of the wanted folders and under none of the noisy ones; no wanted folder or a * means all."""
    c = F.col(path) if isinstance(path, str) else path
    wanted = [p.strip() for p in include if p.strip() and p.strip() != "*"]
    within = F.lit(True) if not wanted else F.array_contains(F.transform(F.array(*map(F.lit, wanted)), lambda p: c.startswith(p)), True)
    return within & ~(F.array_contains(F.transform(F.array(*map(F.lit, exclude)), lambda p: c.startswith(p)), True) if exclude else F.lit(False))


def changed_since(current: DataFrame, seen: DataFrame) -> DataFrame:
    """The (path, version) rows that a refresh has to read: those not seen in this version. Rows that share a path and version are seen together."""
    return current.join(seen, ["path", "version"], "left_anti")
