"""Queries for lookups, files read as lines, comments, reports and small text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import drafts, writeplan
from quarry.plans.registry import query, table
from quarry.plans.triage import route_waterfall, _ROUTED
from quarry.sources import readers, sinks

HEADING, CODE_HEADING, FOOTER = "h3. What was found", "h4. Places", "_Made by a query._"


@query("""WITH r AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '?' || page_id ELSE 'DOC-' || 3 * page_id END AS issue_key FROM pages)
    SELECT page_id, issue_key, CASE WHEN page_id % 5 = 0 THEN 'not a key: ' || issue_key WHEN doc_id IS NULL THEN 'no issue ' || issue_key END AS error, length(left(text, 6000))::INT AS n_chars
    FROM r LEFT JOIN documents ON issue_key = 'DOC-' || doc_id""")
def issue_lookup(spark, d):
    n = F.col("page_id")
    asked = table(spark, d, "pages").select("page_id", F.when(n % 5 == 0, F.concat(F.lit("?"), n.cast("string"))).otherwise(F.concat(F.lit(" doc-"), (3 * n).cast("string"), F.lit(" "))).alias("issue_key"))
    issues = table(spark, d, "documents").select(F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("issue_key"), F.col("text").alias("raw"))
    return readers.fetch_issues(asked, issues).select("page_id", "issue_key", "error", F.char_length("raw").alias("n_chars"))


@query("SELECT (SELECT count(*) FROM benchmark) AS total, item_id % 7 AS start, 'I' || item_id AS issue_id, 'T-' || item_id AS key, text AS summary FROM benchmark")
def paged_tests(spark, d):
    """Reply pages made of the items, read back."""
    b = table(spark, d, "benchmark")
    result = F.struct(F.concat(F.lit("I"), F.col("item_id").cast("string")).alias("issueId"), F.struct(F.lit("Manual").alias("name")).alias("testType"), F.struct(F.concat(F.lit("T-"), F.col("item_id").cast("string")).alias("key"), F.col("text").alias("summary")).alias("jira"))
    pages = b.groupBy((F.col("item_id") % 7).alias("start")).agg(F.collect_list(result).alias("results")).withColumn("total", b.agg(F.count(F.lit(1))).scalar())
    bodies = pages.select(F.to_json(F.struct(F.struct(F.struct("total", "start", F.lit(100).alias("limit"), "results").alias("getTests")).alias("data"))).alias("value"))
    return readers.paged_tests(bodies).select("total", "start", "issue_id", "key", "summary")


def _catalogue(spark, d):
    """A sectioned catalogue of one file: a heading for each region, a test for each nation."""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    k = F.col("r_regionkey")
    heads = r.select(F.explode(F.array(
        F.struct((k * 100).alias("at"), text("### ", F.col("r_name")).alias("value")),
        F.struct((k * 100 + 1).alias("at"), text("- Folder: `/catalogue/", k, "`").alias("value")),
        F.struct((k * 100 + 2).alias("at"), F.concat(F.when(k % 2 == 0, text("- Test count: ", k * 10, " (showing first 5)")).otherwise(text("- ", k * 10, " tests")), F.when(k == 3, " (Only for Reference)").otherwise("")).alias("value")),
    )).alias("x")).select("x.*")
    body = n.select((F.col("n_regionkey") * 100 + 10 + F.col("n_nationkey")).alias("at"), text("  - NA-", F.col("n_nationkey"), ": ", F.col("n_name"), " ").alias("value"))
    return heads.unionByName(body).select(F.lit("f").alias("source"), F.col("at").alias("line_no"), "value")


@query("SELECT r_name AS title, '/catalogue/' || r_regionkey AS folder_path, 10 * r_regionkey AS test_count, r_regionkey % 2 = 0 AS truncated, r_regionkey = 3 AS legacy FROM region")
def section_folders(spark, d):
    return readers.read_sections(_catalogue(spark, d))[0]


@query("SELECT 'NA-' || n_nationkey AS key, n_name AS summary, '/catalogue/' || n_regionkey AS folder_path FROM nation")
def section_tests(spark, d):
    return readers.read_sections(_catalogue(spark, d))[1]


@query("SELECT c_custkey::VARCHAR AS source, c_mktsegment AS segment, c_acctbal::VARCHAR AS balance, 'Name: ' || c_name || chr(10) || 'second line' AS summary, '' AS details FROM customer")
def ticket_scan(spark, d):
    """Ticket files made of customers, read back."""
    c = table(spark, d, "customer")
    said = F.array(F.concat(F.lit("# Ticket "), F.col("c_name")), F.concat(F.lit("- **Segment:** "), F.col("c_mktsegment")), F.concat(F.lit("- **Balance:** "), F.col("c_acctbal").cast("string"), F.lit(" ")), F.lit("## Summary"), F.concat(F.lit("Name: "), F.col("c_name")), F.lit("second line"), F.lit(""), F.lit("## Details"), F.lit(" "))
    lines = c.select(F.col("c_custkey").cast("string").alias("source"), F.posexplode(said).alias("at", "value")).select("source", (F.col("at") + 1).alias("line_no"), "value")
    out = readers.read_ticket(lines)
    return out.select("source", F.col("fields")["Segment"].alias("segment"), F.col("fields")["Balance"].alias("balance"), F.col("sections")["Summary"].alias("summary"), F.col("sections")["Details"].alias("details"))


@query("SELECT s_nationkey::VARCHAR AS source, NOT bool_or(s_suppkey % 9 = 0) AS ready FROM supplier GROUP BY 1")
def placeholder_gate(spark, d):
    """Files of settings, one for each nation; a comment that holds a placeholder blocks its file too."""
    said = F.when(F.col("s_suppkey") % 9 == 0, F.lit("# K=PASTE_ME")).otherwise(F.concat(F.lit("K="), F.col("s_name")))
    return readers.is_ready(table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("source"), F.col("s_suppkey").alias("line_no"), said.alias("value")))


@query("""SELECT n_regionkey::VARCHAR AS source, bool_or(n_name = 'NATION_3') AS a, bool_or(n_name = 'NATION_7') AS b, bool_or(n_name = 'NATION_3') AND bool_or(n_name = 'NATION_7') AS ready FROM nation GROUP BY 1""")
def health_row(spark, d):
    """Which settings are there, for each file."""
    have = table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("source"), F.col("n_name").alias("key"), F.lit("v").alias("val"))
    out = writeplan.health(have, ["NATION_3", "NATION_7"], by=["source"])
    return out.select("source", F.col("creds")["NATION_3"].alias("a"), F.col("creds")["NATION_7"].alias("b"), "ready")


_CAUSES = """m AS (SELECT conv_id, list_transform(list_filter(list(text ORDER BY turn) FILTER (role = 'user'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> ''), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))) AS causes, count(*) AS n FROM conversations GROUP BY 1)"""


def _findings(spark, d):
    """A conversation as a finding: what the user says are the causes, null and blank ones among them."""
    c = table(spark, d, "conversations")
    said = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))), lambda x: x["text"])
    rows = c.groupBy("conv_id").agg(said.alias("said"), F.count(F.lit(1)).alias("n"))
    key = F.concat(F.when(F.col("conv_id") % 4 == 0, "").when(F.col("conv_id") % 4 == 1, "no key ").otherwise(" CV-"), F.when(F.col("conv_id") % 4 != 0, F.col("conv_id").cast("string")).otherwise(""))
    return rows.select("conv_id", key.alias("bug_id"), F.concat("said", F.array(F.lit(None).cast("string"), F.lit(" \t"))).alias("causes"), (F.col("n") % 2 == 0).alias("eligible"), F.array(F.lit(" a/b "), F.lit(""), F.concat(F.lit("c/"), F.col("conv_id").cast("string"))).alias("paths"), F.when(F.col("n") % 4 == 0, " fix ").alias("fix"))


@query(f"""WITH {_CAUSES} SELECT conv_id, coalesce(causes, []) AS causes, ['a/b', 'c/' || conv_id] AS paths FROM m""")
def filled_lists(spark, d):
    """Lists without their null and blank items, the others stripped."""
    return _findings(spark, d).select("conv_id", X.filled_items("causes").alias("causes"), X.filled_items("paths").alias("paths"))


@query(f"""WITH {_CAUSES}, t AS (SELECT conv_id, n, '{HEADING}' || chr(10) || array_to_string(list_transform(coalesce(causes, []), lambda x: chr(10) || '* ' || x), '')
      || CASE WHEN n % 2 = 0 THEN chr(10) || chr(10) || '{CODE_HEADING}' || chr(10) || '* {{{{a/b}}}}' || chr(10) || '* {{{{c/' || conv_id || '}}}}' ELSE '' END
      || CASE WHEN n % 4 = 0 THEN chr(10) || chr(10) || 'h4. Proposed fix' || chr(10) || '{{noformat}}' || chr(10) || 'fix' || chr(10) || '{{noformat}}' ELSE '' END
      || chr(10) || chr(10) || '----' || chr(10) || '{FOOTER}' AS body, len(coalesce(causes, [])) AS k FROM m)
    SELECT conv_id, md5(body) AS body_md5 FROM t""")
def comments(spark, d):
    return _findings(spark, d).select("conv_id", F.md5(_comment()).alias("body_md5"))


def _comment():
    return drafts.cause_comment("causes", "eligible", "paths", "fix", HEADING, CODE_HEADING, FOOTER)


@query(f"""WITH {_CAUSES} SELECT CASE conv_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'no key ' || conv_id ELSE 'CV-' || conv_id END AS bug_id,
      CASE conv_id % 4 WHEN 0 THEN 'no key' WHEN 1 THEN 'not a key' ELSE CASE WHEN len(coalesce(causes, [])) = 0 THEN 'no cause' END END AS reason, count(*) AS n FROM m GROUP BY ALL""")
def comment_payloads(spark, d):
    """What would be posted: rejected ones have a reason, the others a payload whose body reads back as it was."""
    rows = _findings(spark, d)
    plan = writeplan.comment_plan(rows, _comment())
    sound = F.col("payload").isNull() == F.col("reason").isNotNull()
    return plan.where(sound).groupBy("bug_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_ROUTED}, t AS (SELECT ticket_id, '## ' || ticket_id || ' — Triage Summary' || chr(10) || array_to_string(list_transform(
      ['Summary','Evidence Snapshot','Justifications','RCA (Short)','Info Required','Next Actions','Risks / Blockers','Customer Response','Escalation Note'],
      lambda s: chr(10) || '## ' || s || chr(10) || chr(10) || CASE s WHEN 'Summary' THEN team ELSE '' END || chr(10)), '') AS r FROM routed)
    SELECT ticket_id || '-triage.md' AS file, unnest(range(1, len(string_split(r, chr(10))) + 1))::INT AS line_no, unnest(string_split(r, chr(10))) AS line FROM t""")
def report_files(spark, d):
    return sinks.report_lines(drafts.report(route_waterfall(spark, d), {"Summary": "team"}))


@query("SELECT event_id::VARCHAR AS id, (event_id % 12) || ':' || (user_id % 60) AS a, (event_id % 9) || '-' || (user_id % 9) AS b, 'é, \"' || event_type || '\" ;' AS c, props AS d FROM events")
def csv_text(spark, d):
    """Lines of CSV and back: what looks like a time or a date stays text, quotes and signs stay."""
    s = lambda c: c.cast("string")
    e = table(spark, d, "events").select(s(F.col("event_id")).alias("id"), F.concat(s(F.col("event_id") % 12), F.lit(":"), s(F.col("user_id") % 60)).alias("a"), F.concat(s(F.col("event_id") % 9), F.lit("-"), s(F.col("user_id") % 9)).alias("b"), F.concat(F.lit('é, "'), "event_type", F.lit('" ;')).alias("c"), F.col("props").alias("d"))
    return sinks.from_csv_rows(sinks.csv_rows(e), e.columns)


@query("SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_returnflag = 'R' THEN [] ELSE [l_returnflag] END AS items FROM lineitem")
def as_lists(spark, d):
    """A scalar as a list of one; null and empty as none."""
    flag = F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).when(F.col("l_linenumber") % 2 == 0, "")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", X.as_array(flag).alias("items"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'P' THEN 'warn' WHEN 'O' THEN 'bad' ELSE 'info' END AS css FROM orders")
def verdict_classes(spark, d):
    verdict = F.when(F.col("o_orderstatus") == "F", "COVERED").when(F.col("o_orderstatus") == "P", "Partial").when(F.col("o_orderstatus") == "O", "gap")
    return table(spark, d, "orders").select("o_orderkey", X.verdict_class(verdict).alias("css"))


@query("SELECT p_partkey, p_name || ' ' || p_brand AS step, (CASE WHEN p_size % 3 < 2 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END)::INT AS broken FROM part")
def step_prefixes(spark, d):
    """Steps as a screen shows them, and how many break the rule that they have no number of their own."""
    n, named = F.col("p_size") % 3, F.concat("p_name", F.lit(" "), "p_brand")
    step = F.concat(F.when(n == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" . "))).when(n == 1, "7) ").otherwise(""), named)
    steps = F.array(step, F.when(F.col("p_partkey") % 2 == 0, "2. x").otherwise("2x"))
    return table(spark, d, "part").select("p_partkey", X.strip_step_number(step).alias("step"), X.numbered_step_count(steps).alias("broken"))


@query("SELECT o_orderkey, 'https://t.example/browse/OR-' || o_orderkey || CASE WHEN o_custkey % 3 = 0 THEN '?focusedCommentId=' || o_custkey ELSE '' END AS url FROM orders")
def comment_urls(spark, d):
    comment = F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey").cast("string")).when(F.col("o_custkey") % 3 == 1, "")
    return table(spark, d, "orders").select("o_orderkey", X.comment_url("https://t.example/browse/", F.concat(F.lit("OR-"), F.col("o_orderkey").cast("string")), comment).alias("url"))
