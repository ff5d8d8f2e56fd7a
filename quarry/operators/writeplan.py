"""Write plans: what would be created or posted, checked row by row, written nowhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import DRAFT_LIMIT, FOLDER_CHARS, TITLE_CHARS, allow_listed, cap, first_filled, is_issue_key, priority_flag, strip
from quarry.operators.drafts import description


def creation_plan(requests: DataFrame, teams: list[str]) -> DataFrame:
    """One row for each proposed test of requests (bug_id, team, folder, tests): what would be sent, or why not.

    More than DRAFT_LIMIT tests reject the whole request; no test at all too. An
    unknown team and what is no key become empty and do not reject.
    """
    n = F.coalesce(F.size("tests"), F.lit(0))
    reason = F.when(n <= 0, "nothing to create").when(n > DRAFT_LIMIT, F.concat(F.lit("more than 5 tests: "), n.cast("string")))
    rows = requests.withColumn("reason", reason).select("*", F.posexplode_outer("tests").alias("nth", "t"))
    bug = strip(F.coalesce("bug_id", F.lit("")))
    rows = rows.select("*", "t.*")
    return rows.select(
        "request_id",
        (F.coalesce("nth", F.lit(0)) + 1).alias("test_no"),
        F.when(F.col("reason").isNull(), "ok").otherwise("rejected").alias("status"),
        "reason",
        F.when(is_issue_key(bug), bug).otherwise("").alias("bug_id"),
        F.coalesce(allow_listed("team", teams), F.lit("")).alias("team"),
        cap(strip(F.coalesce("folder", F.lit(""))), FOLDER_CHARS).alias("folder"),
        cap(strip(first_filled("title", F.lit("Test case"))), TITLE_CHARS).alias("title"),
        priority_flag("priority").alias("priority"),
        description("title", "preconditions", "steps", "expected_results", "labels").alias("description"),
    )


def outcome(results: DataFrame) -> DataFrame:
    """request_id, created, warnings, failed: results (request_id, test_no, title, key, problem) gathered by request; nothing created at all is a failure."""
    made = F.col("key").isNotNull() & F.col("problem").isNull()
    created = F.array_sort(F.collect_list(F.when(made, F.struct("test_no", "key", "title"))))
    said = F.coalesce("problem", F.lit("created but no key parsed from output"))
    warned = F.array_sort(F.collect_list(F.when(~made, F.struct("test_no", F.concat(F.lit("'"), F.substring("title", 1, 40), F.lit("': "), said).alias("warning")))))
    return results.groupBy("request_id").agg(created.alias("created"), warned.alias("warnings")).withColumn("failed", F.size("created") == 0)


def coverage_links(created: DataFrame, bugs: DataFrame) -> DataFrame:
    """key, bug_id: every created test of a request with its bug, if it names one."""
    return created.join(bugs.where(F.col("bug_id") != ""), "request_id").select("key", "bug_id")


def comment_plan(rows: DataFrame, body: Column) -> DataFrame:
    """bug_id, status, reason and payload (the body as it would be posted, null if rejected): a key and a cause are needed."""
    key = strip(F.coalesce("bug_id", F.lit("")))
    reason = F.when(key == "", "no key").when(~is_issue_key(key), "not a key").when(F.size(F.filter("causes", lambda x: F.coalesce(strip(x), F.lit("")) != "")) <= 0, "no cause")
    payload = F.when(reason.isNull(), F.to_json(F.struct(body.alias("body"))))
    return rows.select(key.alias("bug_id"), F.when(reason.isNull(), "ok").otherwise("rejected").alias("status"), reason.alias("reason"), payload.alias("payload"))


def missing_settings(settings: DataFrame, names: list[str]) -> DataFrame:
    """missing: the names without a value, in the given order, joined by commas."""
    have = F.coalesce(F.collect_set(F.when(strip("val") != "", F.col("key"))), F.array().cast("array<string>"))
    return settings.agg(F.array_join(F.filter(F.array(*map(F.lit, names)), lambda n: ~F.array_contains(have, n)), ", ").alias("missing"))


def health(settings: DataFrame, names: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """creds (name -> has a value) and ready, as one row, or one for each group."""
    have = F.coalesce(F.collect_set(F.when(strip("val") != "", F.col("key"))), F.array().cast("array<string>"))
    creds = F.transform(F.array(*map(F.lit, names)), lambda n: F.array_contains(have, n))
    made = settings.groupBy(*by).agg(F.map_from_arrays(F.array(*map(F.lit, names)), creds).alias("creds"))
    return made.withColumn("ready", F.forall(F.map_values("creds"), lambda x: x))
