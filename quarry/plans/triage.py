"""Queries for routing, coverage, logs, rules, drafts and write plans, over the driver's tables.

documents stand for tickets, benchmark for the test catalogue, the paths of
pages for catalogue folders, events for request logs, orders for tickets with
keys and dates. The small maps are invented.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import coverage, drafts, logs, routing, rules, writeplan
from quarry.plans.registry import query, table
from quarry.sources import readers

OBJECTS = [("Rest", ["of the"], "Amber"), ("Here", [], "Basalt"), ("Reer", ["von der"], "Cobalt"), ("Onan", [], "Dune"), ("Inhe", [], "deprecated")]
AREAS = [("Ansh", ["un"], "Ember"), ("Ist", [], "Flint")]
SOURCES = [("src1", "Amber"), ("src2", "Flint")]
ELIGIBLE = ["Amber", "Cobalt", "Ember"]
FOLDERS = [("rest", "/en"), (" REER", "/de/1"), ("Onan", "/fr"), ("Inhe", "/zz")]

_VALUES = """
    obj(alias, name, team) AS (VALUES ('rest','Rest','Amber'),('of the','Rest','Amber'),('here','Here','Basalt'),('reer','Reer','Cobalt'),('von der','Reer','Cobalt'),('onan','Onan','Dune'),('inhe','Inhe','deprecated')),
    area(alias, name, team) AS (VALUES ('ansh','Ansh','Ember'),('un','Ansh','Ember'),('ist','Ist','Flint')),
    src(source, team) AS (VALUES ('src1','Amber'),('src2','Flint')),
    elig(team) AS (VALUES ('Amber'),('Cobalt'),('Ember')),
    folder_map(name, folder_path) AS (VALUES ('Rest', '/en'), ('Reer', '/de/1'), ('Onan', '/fr'), ('Inhe', '/zz'))"""

_ROUTED = f"""
    WITH {_VALUES},
    words AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), ' ') || ' ' AS said FROM documents),
    a AS (SELECT doc_id, team, name, row_number() OVER (PARTITION BY doc_id ORDER BY length(alias) DESC, alias, team) AS n FROM words JOIN obj ON contains(said, ' ' || alias || ' ')),
    b AS (SELECT doc_id, team, row_number() OVER (PARTITION BY doc_id ORDER BY length(alias) DESC, alias, team) AS n FROM words JOIN area ON contains(said, ' ' || alias || ' ')),
    r AS (
      SELECT d.doc_id AS ticket_id, a.team AS ot, b.team AS bt, s.team AS st, coalesce(a.team, b.team, s.team) AS t
      FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id AND a.n = 1 LEFT JOIN b ON b.doc_id = d.doc_id AND b.n = 1 LEFT JOIN src s USING (source)),
    routed AS (
      SELECT ticket_id, CASE WHEN t = 'deprecated' THEN 'N/A (deprecated)' ELSE coalesce(t, 'Unresolved — needs manual routing') END AS team,
             coalesce(t IN (SELECT team FROM elig), false) AS code_rca_eligible,
             CASE WHEN ot = 'deprecated' THEN 'deprecated' WHEN ot IS NOT NULL THEN 'object' WHEN bt IS NOT NULL THEN 'area' WHEN st IS NOT NULL THEN 'source' ELSE 'none' END AS match_basis
      FROM r),
    placed AS (SELECT d.doc_id AS ticket_id, a.name, f.folder_path FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id AND a.n = 1 LEFT JOIN folder_map f ON f.name = a.name)"""


def _dims(spark):
    own = lambda rows, name: routing.expand_aliases(spark.createDataFrame(rows, f"{name} string, aliases array<string>, team string"), name)
    return own(OBJECTS, "widget"), own(AREAS, "area"), spark.createDataFrame([(t,) for t in ELIGIBLE], "team string"), spark.createDataFrame(SOURCES, "source string, team string")


def _tickets(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("ticket_id"), F.col("text").alias("description"), "source")


def _tests(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("test_id"), F.col("text").alias("summary"))


def _folders(spark, d):
    """page_id and folder_path of the catalogue that the pages stand for."""
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"://[^/]+(/[^?#]*)", 1).alias("folder_path"))


_FOLDERS = "folders AS (SELECT page_id, regexp_extract(url, '://[^/]+(/[^?#]*)', 1) AS folder_path FROM pages)"


@query(f"{_ROUTED} SELECT * FROM routed")
def route_waterfall(spark, d):
    objects, areas, eligible, sources = _dims(spark)
    return routing.route(_tickets(spark, d), objects, areas, eligible, sources)


@query(f"{_ROUTED} SELECT team, code_rca_eligible, count(*) AS n FROM routed GROUP BY ALL")
def owner_counts(spark, d):
    return route_waterfall(spark, d).groupBy("team", "code_rca_eligible").agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH w AS (SELECT p_name AS name, [' ' || upper(p_brand) || '  ' || p_type, p_name] AS aliases, 'T' || p_size AS team FROM part)
    SELECT alias, name, team FROM (
      SELECT DISTINCT p, lower(trim(regexp_replace(a, '\\s+', ' ', 'g'))) AS alias, name, team
      FROM (SELECT unnest(list_concat([name], aliases)) AS a, name, team, p FROM (SELECT *, row_number() OVER () AS p FROM w)))""")
def alias_explode(spark, d):
    p = table(spark, d, "part")
    owners = p.select(F.col("p_name").alias("widget"), F.array(F.concat(F.lit(" "), F.upper("p_brand"), F.lit("  "), F.col("p_type")), F.col("p_name")).alias("aliases"), F.concat(F.lit("T"), F.col("p_size").cast("string")).alias("team"))
    return routing.expand_aliases(owners, "widget")


@query(f"{_ROUTED} SELECT ticket_id, team FROM routed WHERE team IN (SELECT team FROM elig)")
def eligible_semi(spark, d):
    _, _, eligible, _ = _dims(spark)
    return route_waterfall(spark, d).select("ticket_id", "team").join(eligible, "team", "left_semi")


@query("""
    SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 7 = 0 THEN -1.0 ELSE s_acctbal END::DOUBLE AS s_acctbal FROM supplier
    UNION ALL SELECT 1000000, 'added', 0.0::DOUBLE""")
def override_merge(spark, d):
    base = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    edits = base.where("s_suppkey % 7 = 0").withColumn("s_acctbal", F.lit(-1.0)).unionByName(spark.createDataFrame([(1000000, "added", 0.0)], "s_suppkey long, s_name string, s_acctbal double"))
    return routing.with_overrides(base, edits, "s_suppkey")


_PAIRS = """
    tt AS (SELECT DISTINCT doc_id AS ticket_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS token FROM documents),
    bt AS (SELECT DISTINCT item_id AS test_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS token FROM benchmark),
    t2 AS (SELECT * FROM tt WHERE token <> ''), b2 AS (SELECT * FROM bt WHERE token <> ''),
    ta AS (SELECT ticket_id, count(*) AS a FROM t2 GROUP BY 1), tb AS (SELECT test_id, count(*) AS b FROM b2 GROUP BY 1),
    pairs AS (
      SELECT ticket_id, test_id, shared, shared::DOUBLE / (a + b - shared) AS similarity
      FROM (SELECT ticket_id, test_id, count(*) AS shared FROM t2 JOIN b2 USING (token) GROUP BY ALL) JOIN ta USING (ticket_id) JOIN tb USING (test_id))"""


@query(f"WITH {_PAIRS} SELECT ticket_id, test_id, shared, round(similarity, 9) AS similarity FROM pairs WHERE similarity >= 0.2")
def shortlist(spark, d):
    return coverage.shortlist(_tickets(spark, d), _tests(spark, d)).withColumn("similarity", F.round("similarity", 9))


@query(f"WITH {_PAIRS} SELECT CASE WHEN similarity >= 0.5 THEN 'aligned' WHEN similarity >= 0.2 THEN 'partial' ELSE 'not-aligned' END AS alignment, count(*) AS n FROM pairs WHERE similarity >= 0.1 GROUP BY 1")
def alignment_counts(spark, d):
    pairs = coverage.shortlist(_tickets(spark, d), _tests(spark, d), (1, 10))
    return pairs.groupBy(coverage.alignment("similarity").alias("alignment")).agg(F.count(F.lit(1)).alias("n"))


def _placed(spark, d):
    """ticket_id, name of the object that it names, and that object's folder."""
    objects, *_ = _dims(spark)
    named = _tickets(spark, d).select("ticket_id").join(routing.match_text(_tickets(spark, d), objects).select("ticket_id", "name"), "ticket_id", "left")
    return coverage.folders_of(named, spark.createDataFrame(FOLDERS, "widget string, folder_path string"))


@query(f"{_ROUTED} SELECT * FROM placed")
def widget_folder(spark, d):
    return _placed(spark, d)


@query(f"""{_ROUTED}, {_PAIRS}, m AS (SELECT ticket_id, max(similarity) AS best FROM pairs GROUP BY 1)
    SELECT p.ticket_id, CASE WHEN best >= 0.5 THEN 'Covered' WHEN best >= 0.2 THEN 'Partial' WHEN folder_path IS NOT NULL THEN 'Gap' ELSE 'Unknown' END AS verdict
    FROM placed p LEFT JOIN m ON m.ticket_id = p.ticket_id""")
def coverage_verdict(spark, d):
    return coverage.verdicts(_placed(spark, d), coverage.shortlist(_tickets(spark, d), _tests(spark, d)), F.col("folder_path").isNotNull())


@query(f"""{_ROUTED}, {_PAIRS}, m AS (SELECT ticket_id, max(similarity) AS best FROM pairs GROUP BY 1),
    g AS (SELECT p.ticket_id, p.name, split_part(d.text, chr(10), 1) AS one, split_part(d.text, chr(10), 2) AS two
      FROM placed p JOIN documents d ON d.doc_id = p.ticket_id LEFT JOIN m ON m.ticket_id = p.ticket_id WHERE folder_path IS NOT NULL AND coalesce(best, 0) < 0.2)
    SELECT ticket_id, 'primary' AS kind, md5('Reproduce: ' || one || ' in ' || name) AS title_md5 FROM g WHERE one <> ''
    UNION ALL SELECT ticket_id, 'secondary', md5('Reproduce: ' || two || ' in ' || name) FROM g WHERE two <> ''""")
def gap_drafts(spark, d):
    """One draft for each gap, and at most one more: a ticket's first two lines are its symptoms."""
    gaps = coverage_verdict(spark, d).where("verdict = 'Gap'").select("ticket_id")
    told = _tickets(spark, d).select("ticket_id", F.split_part("description", F.lit("\n"), F.lit(1)).alias("symptom"), F.split_part("description", F.lit("\n"), F.lit(2)).alias("second_symptom"))
    rows = gaps.join(_placed(spark, d).select("ticket_id", F.col("name").alias("object")), "ticket_id").join(told, "ticket_id")
    return drafts.drafts_for(rows).select("ticket_id", "kind", F.md5("title").alias("title_md5"))


@query(f"""WITH {_VALUES}, {_FOLDERS} SELECT name FROM folder_map WHERE NOT EXISTS (SELECT 1 FROM folders f WHERE f.folder_path = folder_map.folder_path OR starts_with(f.folder_path, folder_map.folder_path || '/'))""")
def folder_gaps(spark, d):
    objects = coverage.folders_of(spark.createDataFrame([(n,) for n in ("Rest", "Reer", "Onan", "Inhe")], "name string"), spark.createDataFrame(FOLDERS, "widget string, folder_path string"))
    return coverage.untested(objects, _folders(spark, d)).select("name")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def gap_anti(spark, d):
    return table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query(f"""WITH {_FOLDERS}, p AS (SELECT page_id, list_filter(string_split(folder_path, '/'), lambda x: x <> '') AS parts FROM folders),
    e AS (SELECT '/' || array_to_string(parts[1:n], '/') AS folder FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS n FROM p WHERE len(parts) > 0))
    SELECT folder, count(*) AS n_tests FROM e GROUP BY 1""")
def folder_prefix_counts(spark, d):
    return coverage.recursive_counts(_folders(spark, d))


@query(f"""WITH {_FOLDERS}, m(folder_prefix, suite) AS (VALUES ('/en/', 'Anchor'), ('/en/1', 'Beacon'), ('/de/', 'Cargo'))
    SELECT folder_path, max_by(suite, length(folder_prefix)) AS suite FROM (SELECT DISTINCT folder_path FROM folders) f LEFT JOIN m ON starts_with(folder_path, folder_prefix) GROUP BY 1""")
def suite_prefix_join(spark, d):
    suites = spark.createDataFrame([("/en/", "Anchor"), ("/en/1", "Beacon"), ("/de/", "Cargo")], "folder_prefix string, suite string")
    return coverage.suites(_folders(spark, d).select("folder_path").distinct(), suites)


@query(f"WITH {_FOLDERS} SELECT page_id, folder_path FROM folders WHERE (starts_with(folder_path, '/en/') OR starts_with(folder_path, '/fr/')) AND NOT starts_with(folder_path, '/en/9')")
def scope_filter(spark, d):
    return _folders(spark, d).where(readers.in_scope("folder_path", ["/en/", "/fr/", " ", "*"], ["/en/9"]))


@query(f"""WITH {_FOLDERS}, c AS (SELECT regexp_extract(folder_path, '^/([^/]*)', 1) AS folder_path, count(*) AS listed FROM folders GROUP BY 1),
    f(folder_path, declared, truncated) AS (VALUES ('en', 100000, true), ('de', 3, false), ('zz', 5, false))
    SELECT f.folder_path, declared, coalesce(listed, 0) AS listed, (coalesce(listed, 0) > declared OR (coalesce(listed, 0) < declared AND NOT truncated)) AS mismatch FROM f LEFT JOIN c USING (folder_path)""")
def folder_declared(spark, d):
    folders = spark.createDataFrame([("en", 100000, True), ("de", 3, False), ("zz", 5, False)], "folder_path string, test_count int, truncated boolean")
    return coverage.declared_gaps(folders, _folders(spark, d).select(F.regexp_extract("folder_path", "^/([^/]*)", 1).alias("folder_path")))


@query("""SELECT item_id AS key, text AS summary FROM benchmark UNION ALL SELECT page_id + 1000000, url FROM pages""")
def catalog_union(spark, d):
    a = table(spark, d, "benchmark").select(F.col("item_id").alias("key"), F.col("text").alias("summary"))
    return a.unionByName(table(spark, d, "pages").select((F.col("page_id") + 1000000).alias("key"), F.col("url").alias("summary")))


# --- logs: an error carries no request of its own; it belongs to the nearest earlier event of the stream ---


@query("""
    WITH e AS (SELECT event_id, ts, event_type, CASE WHEN event_type <> 'error' THEN user_id END AS own FROM events)
    SELECT event_id, last_value(own IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS request_id, own IS NULL AS attributed FROM e""")
def adjacent_asof(spark, d):
    """Of the whole stream; hours only deal the work out."""
    e = table(spark, d, "events")
    out = logs.attribute(e, F.when(F.col("event_type") != "error", F.col("user_id")), [], ["ts", "event_id"], F.date_trunc("hour", "ts"))
    return out.select("event_id", "request_id", "attributed")


@query("""
    SELECT user_id AS request_id, count(*) AS lines, min(ts) AS first_ts, max(ts) AS last_ts,
           max(CASE WHEN event_type = 'error' THEN '500' ELSE '200' END) AS status, max(json_extract_string(props, '$.k')) AS "rows"
    FROM events GROUP BY 1""")
def log_correlate(spark, d):
    e = table(spark, d, "events").withColumn("request_id", F.col("user_id"))
    kv = F.create_map(F.lit("status"), F.when(F.col("event_type") == "error", "500").otherwise("200"), F.lit("rows"), F.get_json_object("props", "$.k"))
    return logs.correlate(e.withColumn("kv", kv))


@query("SELECT event_type, count(*) AS n, sum(CASE WHEN event_type <> 'error' AND json_extract_string(props, '$.k') = '0' THEN 1 ELSE 0 END)::BIGINT AS silent FROM events GROUP BY 1")
def silent_failures(spark, d):
    e = table(spark, d, "events")
    silent = logs.is_silent_failure(F.when(F.col("event_type") == "error", 500).otherwise(200), F.get_json_object("props", "$.k"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(silent.cast("bigint")).alias("silent"))


@query("""
    WITH g AS (SELECT *, epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id))) AS gap FROM events)
    SELECT user_id, event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, min(gap)::BIGINT AS least_gap_s, max(gap)::BIGINT AS most_gap_s
    FROM g GROUP BY 1, 2 HAVING count(*) > 1""")
def retry_gaps(spark, d):
    return logs.retries(table(spark, d, "events"), ["user_id", "event_type"], ["event_id"])


@query("""
    SELECT t.o_orderkey AS ticket_id, count(c.o_orderkey) AS n_changes, coalesce(sum(c.o_orderkey), 0)::BIGINT AS key_sum, coalesce(bit_xor(c.o_orderkey), 0) AS key_xor
    FROM orders t LEFT JOIN orders c ON c.o_orderdate <= t.o_orderdate AND c.o_orderdate >= t.o_orderdate - INTERVAL 14 DAY GROUP BY 1""")
def release_interval(spark, d):
    """All orders as tickets and as changes; the pairs are told as a count and two digests of a ticket."""
    o = table(spark, d, "orders")
    tickets = o.select(F.col("o_orderkey").alias("ticket_id"), F.col("o_orderdate").alias("opened_ts"))
    return logs.preceding_change_counts(tickets, o.select(F.col("o_orderkey").alias("change_id"), F.col("o_orderdate").alias("change_ts")))


@query("""
    WITH r AS (SELECT o_orderkey, strftime(o_orderdate, '%Y') || '-' || lpad((o_orderkey % 14)::VARCHAR, 2, '0') || '-01..' || strftime(o_orderdate, '%Y-%m-%d') AS rng FROM orders)
    SELECT o_orderkey, rng, (try_strptime(split_part(rng, '..', 1), '%Y-%m-%d') IS NULL OR try_strptime(split_part(rng, '..', 2), '%Y-%m-%d') < try_strptime(split_part(rng, '..', 1), '%Y-%m-%d')) AS bad FROM r""")
def bad_range(spark, d):
    o = table(spark, d, "orders")
    rng = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-"), F.lpad((F.col("o_orderkey") % 14).cast("string"), 2, "0"), F.lit("-01.."), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", rng.alias("rng")).withColumn("bad", X.is_bad_range("rng"))


# --- rules, votes, drafts, plans ---


_CAUSES = ["Frontend rendering", "Mapping issue", "Export layer", "Cache/state issue", "Failed API retry loop", "Persistence issue", "Translation issue", "Aggregation mismatch", "Backend/service issue", "Data synchronization issue"]


@query("SELECT event_id, CASE " + " ".join(f"WHEN (event_id * {7 * k + 3} + user_id) % 11 = {k} THEN '{c}'" for k, c in enumerate(_CAUSES)) + " END AS cause FROM events")
def cause_rules(spark, d):
    """Each of the ten symptoms is a condition of its own; several may hold, the first one counts."""
    holds = lambda k: (F.col("event_id") * (7 * k + 3) + F.col("user_id")) % 11 == k
    return table(spark, d, "events").select("event_id", rules.cause({name: holds(k) for k, (name, _) in enumerate(rules.CAUSES)}).alias("cause"))


_RULES = [
    ("severity", "P1", ["von", "here"]), ("severity", "P2", ["rest"]), ("severity", "P3", ["and", "le"]),
    ("area", "north", ["ansh", "un"]), ("area", "south", ["ist"]),
    ("metric", "count", ["reen"]), ("metric", "share", ["the", "edha"]),
    ("category", "one", ["onan"]), ("category", "two", ["onin"]), ("category", "three", ["aner"]), ("category", "four", ["reer"]), ("category", "five", ["edin"]), ("category", "six", ["edre"]), ("category", "seven", ["no"]),
]


def _rule_sql() -> str:
    case = lambda f: "CASE " + " ".join(f"WHEN list_has_any(w, {held}) THEN '{v}'" for g, v, held in _RULES if g == f) + " END"
    fields = list(dict.fromkeys(f for f, _, _ in _RULES))
    inner = ", ".join(f"{case(f)} AS {f}" for f in fields)
    n = " + ".join(f"({f} IS NOT NULL)::INT" for f in fields)
    return f"""WITH t AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+') AS w FROM documents), c AS (SELECT doc_id, {inner} FROM t)
        SELECT doc_id, {", ".join(f"coalesce({f}, 'unknown') AS {f}" for f in fields)}, CASE {n} WHEN {len(fields)} THEN 'High' WHEN 0 THEN 'Low' ELSE 'Medium' END AS confidence FROM c"""


@query(_rule_sql())
def classification(spark, d):
    """Severity, area, metric and one of seven categories by a table of words, with a confidence."""
    made = rules.classified(F.col("text"), _RULES)
    return table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in made.items()])


@query("""
    WITH f AS (SELECT c_custkey AS ticket_id, CASE WHEN c_acctbal > 6000 THEN 'High' WHEN c_acctbal > 2000 THEN 'Medium' ELSE 'Low' END AS c FROM customer),
    v AS (SELECT o_custkey AS ticket_id, bool_or(o_orderpriority = '1-URGENT') AS r FROM orders GROUP BY 1)
    SELECT ticket_id, CASE WHEN coalesce(r, false) THEN CASE c WHEN 'High' THEN 'Medium' ELSE 'Low' END ELSE c END AS confidence, coalesce(r, false) AS downgraded FROM f LEFT JOIN v USING (ticket_id)""")
def confidence_vote(spark, d):
    level = F.when(F.col("c_acctbal") > 6000, "High").when(F.col("c_acctbal") > 2000, "Medium").otherwise("Low")
    found = table(spark, d, "customer").select(F.col("c_custkey").alias("ticket_id"), level.alias("confidence"))
    return rules.voted(found, table(spark, d, "orders").select(F.col("o_custkey").alias("ticket_id"), (F.col("o_orderpriority") == "1-URGENT").alias("refuted")))


@query("""
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'P1' WHEN c_mktsegment = 'BUILDING' AND c_nationkey % 2 = 0 THEN 'P2' WHEN c_mktsegment = 'BUILDING' OR c_nationkey % 2 = 0 THEN 'P3' ELSE 'P4' END AS level FROM customer""")
def priority_rules(spark, d):
    many = F.when(F.col("c_mktsegment") == "BUILDING", "many").otherwise("one")
    return table(spark, d, "customer").select("c_custkey", rules.priority(many, F.col("c_nationkey") % 2 == 1, F.col("c_acctbal") < 0).alias("level"))


# Invented: kinds of trials of a thing, the steps and checks that all of them have.
SCENARIOS = [("Use+", "opens"), ("Use+", "closes"), ("Use-", "refuses"), ("Looks", "colours")]
STEPS = ["Take {object}", "Go to {domain}", "Put {object} down"]
CHECKS = ["weight", "size"]
_SCENARIOS = "s(n, category, scenario) AS (VALUES (1, 'Use+', 'opens'), (2, 'Use+', 'closes'), (3, 'Use-', 'refuses'), (4, 'Looks', 'colours'))"


def _cells(spark, d):
    things = table(spark, d, "part").select(F.col("p_brand").alias("domain"), F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string")).alias("object"))
    return drafts.scenario_matrix(things, SCENARIOS)


@query(f"WITH {_SCENARIOS} SELECT p_brand AS domain, p_name || ' ' || p_partkey AS object, category, scenario, n AS scenario_no FROM part, s")
def scenario_matrix(spark, d):
    return _cells(spark, d)


@query(f"""WITH {_SCENARIOS}, c AS (SELECT p_brand AS domain, p_name || ' ' || p_partkey AS object, * FROM part, s)
    SELECT 'TS-00' || n AS scenario_id, domain, object, object || ' is at hand' AS preconditions,
      ['Take ' || object, 'Go to ' || domain, 'Put ' || object || ' down', 'Check weight', 'Check size', 'Scenario: ' || scenario] AS steps,
      category || ': ' || scenario AS expected_result, CASE WHEN category LIKE 'Use%' THEN 'P2' ELSE 'P3' END AS priority, CASE WHEN category = 'Use+' THEN 'first' ELSE 'later' END AS labels FROM c""")
def test_templates(spark, d):
    return drafts.test_template(_cells(spark, d), STEPS, CHECKS, "Use", ("first", "later"))


_MESSAGES = "m AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn) FILTER (role = 'user') AS steps, list(coalesce(text, '') ORDER BY turn) FILTER (role = 'assistant') AS expected, min(text) FILTER (role = 'system') AS pre FROM conversations GROUP BY 1)"


def _messages(spark, d):
    """A conversation as a proposed test: what the user says as steps, the answers as expected results."""
    c = table(spark, d, "conversations")
    part = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", F.coalesce("text", F.lit("")).alias("t"))))), lambda x: x["t"])
    return c.groupBy("conv_id").agg(part("user").alias("steps"), part("assistant").alias("expected_results"), F.min(F.when(F.col("role") == "system", F.col("text"))).alias("preconditions"))


@query(f"WITH {_MESSAGES} SELECT conv_id, list_transform(coalesce(steps, []), lambda s, i: CASE WHEN regexp_matches(s, '^\\s*\\d+[.)]') THEN s ELSE i || '. ' || s END) AS steps FROM m")
def steps_numbered(spark, d):
    return _messages(spark, d).select("conv_id", X.number_steps("steps").alias("steps"))


@query(f"""WITH {_MESSAGES}, p AS (
      SELECT conv_id,
        CASE WHEN trim(coalesce(pre, ''), E' \\n\\t') <> '' THEN 'Preconditions:\n' || trim(pre, E' \\n\\t') || '\n' END AS a,
        CASE WHEN len(steps) > 0 THEN 'Test Steps:\n' || array_to_string(list_transform(steps, lambda s, i: CASE WHEN regexp_matches(s, '^\\s*\\d+[.)]') THEN s ELSE i || '. ' || s END), '\n') || '\n' END AS b,
        CASE WHEN len(expected) > 0 THEN 'Expected Results:\n' || array_to_string(list_transform(expected, lambda s: '- ' || s), '\n') || '\n' END AS c FROM m)
    SELECT conv_id, trim(concat_ws('\n', a, b, c, 'Labels: L' || (conv_id % 3)), E' \\n\\t') AS description FROM p""")
def compose_description(spark, d):
    rows = _messages(spark, d).withColumns({"labels": F.concat(F.lit("L"), (F.col("conv_id") % 3).cast("string")), "title": F.lit("")})
    return rows.select("conv_id", drafts.description("title", "preconditions", "steps", "expected_results", "labels").alias("description"))


@query("""
    SELECT conv_id AS request_id, count(*) FILTER (role = 'user') AS n_tests,
           CASE WHEN count(*) FILTER (role = 'user') = 0 THEN 'nothing to create' WHEN count(*) FILTER (role = 'user') > 5 THEN 'more than 5 tests: ' || count(*) FILTER (role = 'user') END AS reason
    FROM conversations GROUP BY 1""")
def plan_guard(spark, d):
    rows = _messages(spark, d)
    test = lambda s: F.struct(F.substring(s, 1, 30).alias("title"), F.lit("p2 ").alias("priority"), F.lit("").alias("preconditions"), F.array(s).alias("steps"), F.array().cast("array<string>").alias("expected_results"), F.lit("").alias("labels"))
    asked = rows.select(F.col("conv_id").alias("request_id"), F.lit("AB-1").alias("bug_id"), F.lit("Amber").alias("team"), F.lit("/a").alias("folder"), F.transform("steps", test).alias("tests"))
    plan = writeplan.creation_plan(asked, ["Amber"])
    return plan.groupBy("request_id").agg(F.count(F.when(F.col("title") != "Test case", 1)).alias("__t"), F.first("reason").alias("reason")).join(asked.select("request_id", F.size("tests").cast("bigint").alias("n_tests")), "request_id").select("request_id", "n_tests", "reason")


@query("""
    SELECT o_orderkey AS request_id, sum((l_returnflag <> 'R')::INT)::BIGINT AS n_created, sum((l_returnflag = 'R')::INT)::BIGINT AS n_warnings, sum((l_returnflag <> 'R')::INT) = 0 AS failed
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def created_partition(spark, d):
    l = table(spark, d, "lineitem")
    rows = l.select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("test_no"), F.lit("t").alias("title"), F.concat(F.lit("T-"), F.col("l_partkey").cast("string")).alias("key"), F.when(F.col("l_returnflag") == "R", "timed out").alias("problem"))
    return writeplan.outcome(rows).select("request_id", F.size("created").cast("bigint").alias("n_created"), F.size("warnings").cast("bigint").alias("n_warnings"), "failed")


@query("SELECT 'T-' || l_partkey AS key, 'OR-' || l_orderkey AS bug_id FROM lineitem WHERE l_orderkey % 3 <> 0")
def coverage_links(spark, d):
    l = table(spark, d, "lineitem")
    created = l.select(F.col("l_orderkey").alias("request_id"), F.concat(F.lit("T-"), F.col("l_partkey").cast("string")).alias("key"))
    bugs = l.select("l_orderkey").distinct().select(F.col("l_orderkey").alias("request_id"), F.when(F.col("l_orderkey") % 3 != 0, F.concat(F.lit("OR-"), F.col("l_orderkey").cast("string"))).otherwise("").alias("bug_id"))
    return writeplan.coverage_links(created, bugs)


@query(f"""{_ROUTED}
    SELECT ticket_id, '## ' || ticket_id || ' — Triage Summary' || chr(10) || array_to_string(list_transform(
      ['Summary','Evidence Snapshot','Justifications','RCA (Short)','Info Required','Next Actions','Risks / Blockers','Customer Response','Escalation Note'],
      lambda s: chr(10) || '## ' || s || chr(10) || chr(10) || CASE s WHEN 'Summary' THEN team WHEN 'Next Actions' THEN match_basis ELSE '' END || chr(10)), '') AS report FROM routed""")
def report_text(spark, d):
    return drafts.report(route_waterfall(spark, d), {"Summary": "team", "Next Actions": "match_basis"})


@query(f"""{_ROUTED} SELECT ticket_id, 'We are looking into this. ' || match_basis AS customer, 'Owner: ' || team || chr(10) || 'Cause: ' || match_basis AS support,
    '[P3] ' || match_basis || chr(10) || 'Owner: ' || team || chr(10) || 'Verdict: Gap' AS escalation FROM routed""")
def three_drafts(spark, d):
    rows = route_waterfall(spark, d).withColumns({"summary": F.col("match_basis"), "cause": F.col("match_basis"), "level": F.lit("P3"), "verdict": F.lit("Gap")})
    return drafts.replies(rows)
