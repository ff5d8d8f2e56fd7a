"""Table-driven edge cases of the functions, readers and plans."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import jsonx
from quarry.functions import text as X
from quarry.operators import analytics, coverage, drafts, logs, routing, rules, writeplan
from quarry.sources import readers, sinks
from quarry.streaming import events as stream


def one(spark, value, make, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("key", "good"), [("AB-1", True), ("A-1", False), ("xAB-1 y", False), ("AB-1\n", False), ("ab9-12", True), (None, False), ("", False), ("AB-١", False)])
def test_issue_key(spark, key, good):
    assert one(spark, key, X.is_issue_key) is good


@pytest.mark.parametrize(("text", "out"), [(" p2 ", "P2"), ("P5", None), (None, None), ("P2\n", "P2"), ("xP2", None)])
def test_priority(spark, text, out):
    assert one(spark, text, X.priority_flag) == out


@pytest.mark.parametrize(("text", "out"), [(" \t a \n", "a"), ("", ""), (None, None)])
def test_strip(spark, text, out):
    assert one(spark, text, X.strip) == out


@pytest.mark.parametrize(("text", "out"), [("a; b", ["a", "b"]), ("a;b", ["a;b"]), ("a\n- b", ["a", "b"]), ("- a; b", ["- a", "b"]), ("", []), (None, [])])
def test_bullets(spark, text, out):
    assert one(spark, text, X.bullets) == out


def test_steps(spark):
    assert one(spark, ["a", None, "2) b", "c"], X.number_steps, "array<string>") == ["1. a", "2) b", "3. c"]
    assert one(spark, "1 . x", X.strip_step_number) == "x"
    assert one(spark, ["1 . x"], X.number_steps, "array<string>") == ["1. 1 . x"]


@pytest.mark.parametrize(("host", "good"), [("localhost:1", True), ("", False), ("[::1]:1", True), ("[::1]", False), ("evil.test", False), (None, False)])
def test_host(spark, host, good):
    assert one(spark, host, X.is_local_host) is good


@pytest.mark.parametrize(("rng", "bad"), [("2030-13-01..2030-13-31", True), ("2030-06-01..2030-06-30", False), ("2030-06-30..2030-06-01", True), ("x", True), (None, False)])
def test_ranges(spark, rng, bad):
    assert one(spark, rng, X.is_bad_range) is bad




@pytest.mark.parametrize(
    ("reply", "a"),
    [
        ('{"a": "x",}', "x"), ('{"a":"say ,} ok"}', "say ,} ok"), ('{"a":"say ,} ok",}', "say } ok"), ('{"a":"x\ny"}', "x\ny"),
        ('so:\n```json\n{"a": "f"}\n```\nend', "f"), ('```json\n{"a": "w"}\n```', "w"), ('```\n{"a":"1"}\n```\n```\n{"a":"2"}\n```', None), ("nope", None), ("", None), (None, None), ("```json\n[1]\n```", None),
    ],
)
def test_extract(spark, reply, a):
    schema = T.StructType([T.StructField("a", T.StringType())])
    found = one(spark, reply, lambda c: jsonx.extract(c, schema)["a"])
    assert found == a


def test_created_key(spark):
    assert one(spark, '{"key":"AB-1"}\nlogged XY-2', jsonx.created_key) == "AB-1"
    assert one(spark, "encoding UTF-8, made AB-12", jsonx.created_key) == "UTF-8"
    assert one(spark, None, jsonx.created_key) is None


def test_loose_fields_are_cut_first(spark):
    assert one(spark, 'x {"status": "open", "z": 1} y', lambda c: jsonx.loose_fields(c, ["status", "summary"], 100)) == {"status": "open"}
    assert one(spark, '{"status": "' + "o" * 100 + '"}', lambda c: jsonx.loose_fields(c, ["status"], 50)) == {}


def lines(spark, text):
    return spark.createDataFrame([("f", i, v) for i, v in enumerate(text.split("\n"), 1)], "source string, line_no int, value string")


def test_settings(spark):
    got = {r["key"]: r["val"] for r in readers.read_settings(lines(spark, "A=1\nA=PASTE_X\nB=\"x=y\"\nC=\"'q'\"\nD='\"q\"'\n# E=1\nF\nG=")).collect()}
    assert got == {"A": "1", "B": "x=y", "C": "q", "D": '"q"'}
    assert readers.is_ready(lines(spark, "A=1\n# PASTE_X")).first()["ready"] is False
    assert readers.is_ready(lines(spark, "A=1")).first()["ready"] is True


def test_sections(spark):
    text = "# t\n### One\n`/a/b` 388 tests (showing first 100)\n- AB-1: x\n- AB-2: y\n### Two\n`/a/c` 1 test (Only for Reference)\n- AB-3: z"
    folders, tests = readers.read_sections(lines(spark, text))
    assert sorted(map(tuple, folders.select("title", "folder_path", "test_count", "truncated", "legacy").collect())) == [("One", "/a/b", 388, True, False), ("Two", "/a/c", 1, False, True)]
    assert sorted(map(tuple, tests.collect())) == [("AB-1", "x", "/a/b"), ("AB-2", "y", "/a/b"), ("AB-3", "z", "/a/c")]
    gaps = {r["folder_path"]: r["mismatch"] for r in coverage.declared_gaps(folders, tests).collect()}
    assert gaps == {"/a/b": False, "/a/c": False}


LOG = """2030-01-05T09:00:00Z INFO  api  request POST /v1/x/export id=q_1 range=2030-13-01..2030-13-31
2030-01-05T09:00:00Z WARN  svc  filter parsed to invalid month=13, coercing to empty range
2030-01-05T09:00:00Z INFO  svc  query returned 0 rows for q_1
2030-01-05T09:00:00Z INFO  api  request q_1 succeeded status=200 rows=0
2030-01-05T09:00:50Z INFO  api  request POST /v1/x/export id=q_2 range=2030-13-01..2030-13-31
2030-01-05T09:00:50Z WARN  svc  filter parsed to invalid month=13, coercing to empty range
2030-01-05T09:00:50Z INFO  svc  query returned 0 rows for q_2
2030-01-05T09:00:50Z INFO  api  request q_2 succeeded status=200 rows=0
2030-01-05T09:01:00Z INFO  api  request GET /v1/y id=y_9 succeeded status=200"""


def test_log(spark):
    log = readers.read_log(lines(spark, LOG))
    request = F.nullif(F.regexp_extract("msg", r"\b([a-z]_[0-9]+)\b", 1), F.lit(""))
    log = logs.attribute(log, request, ["source"], ["ts", "line_no"], F.floor(F.col("line_no") / 2)).cache()
    assert {r["line_no"]: r["request_id"] for r in log.where("attributed").collect()} == {2: "q_1", 6: "q_2"}
    seen = logs.correlate(log).withColumn("silent", logs.is_silent_failure("status", "rows"))
    assert {r["request_id"]: r["silent"] for r in seen.collect()} == {"q_1": True, "q_2": True, "y_9": False}
    posts = log.where("msg like 'request POST%'").withColumn("what", F.regexp_replace("msg", r" id=\S+", "")).withColumn("rng", F.col("kv")["range"])
    (r,) = logs.retries(posts, ["what", "rng"], ["line_no"]).collect()
    assert (r["n"], r["least_gap_s"], r["most_gap_s"]) == (2, 50, 50)
    assert posts.select(X.is_bad_range("rng").alias("b")).distinct().first()["b"] is True


def test_ticket_and_files(spark, tmp_path):
    (tmp_path / "t.md").write_text("# AB-1\n\n- **Reported:** 2030-01-05\n- **Reporter:** someone\n\n## Symptom\n\nNo rows.\nNone.\n\n## Steps\n1. a\n")
    (r,) = readers.read_ticket(readers.lines_of(spark, str(tmp_path / "t.md"))).collect()
    assert r["fields"] == {"Reported": "2030-01-05", "Reporter": "someone"}
    assert r["sections"]["Symptom"] == "No rows.\nNone." and r["sections"]["Steps"] == "1. a"
    (tmp_path / "p.json").write_text('{"data": {"getTests": {"total": 3, "start": 0, "limit": 2,\n "results": [{"issueId": "1", "testType": {"name": "Manual"}, "jira": {"key": "AB-1", "summary": "s"}}]}}}')
    (p,) = readers.read_paged_tests(spark, str(tmp_path / "p.json")).collect()
    assert (p["total"], p["issue_id"], p["test_type"], p["key"]) == (3, "1", "Manual", "AB-1")


def test_csv_keeps_text(spark, tmp_path):
    df = spark.createDataFrame([("1:1", "1-1", "é, \"q\"")], "a string, b string, c string")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert sinks.read_csv(spark, str(tmp_path / "c"), ["a", "b", "c"]).collect() == df.collect()


def test_requests(spark):
    for body, status in (("", 400), ("{", 400), ('{"bugId": " "}', 400), ('{"bugId": "AB-1"}', 200), ('{"description": "x"}', 200), ("[1]", 400), (None, 400)):
        assert one(spark, body, lambda c: readers.read_request(c)["status"]) == status


def test_routing_order(spark):
    own = lambda rows: routing.expand_aliases(spark.createDataFrame(rows, "w string, aliases array<string>, team string"), "w")
    objects = own([("Alpha", [], "A"), ("Alpha Trend", ["alfa trend"], "T"), ("Old", [], "deprecated")])
    areas = own([("no data", [], "B"), ("alpha", [], "B")])
    tickets = spark.createDataFrame([(1, "the Alpha Trend fails"), (2, "NO DATA in alpha"), (3, "no data"), (4, "old one"), (5, "else"), (6, None)], "ticket_id int, description string")
    out = routing.route(tickets, objects, areas, spark.createDataFrame([("T",), ("B",)], "team string"))
    assert {r["ticket_id"]: (r["team"], r["code_rca_eligible"], r["match_basis"]) for r in out.collect()} == {
        1: ("T", True, "object"), 2: ("A", False, "object"), 3: ("B", True, "area"), 4: (routing.RETIRED, False, "deprecated"), 5: (routing.UNRESOLVED, False, "none"), 6: (routing.UNRESOLVED, False, "none"),
    }


def test_plan(spark):
    test = "struct<title:string,priority:string,preconditions:string,steps:array<string>,expected_results:array<string>,labels:string>"
    t = ("", "p2", "", [], [], "")
    rows = [(1, " AB-1 ", "A", "/f", [t] * 5), (2, "x", "a", "", [t] * 6), (3, None, None, None, None), (4, "", "Unresolved", "", [])]
    plan = writeplan.creation_plan(spark.createDataFrame(rows, f"request_id int, bug_id string, team string, folder string, tests array<{test}>"), ["A"])
    got = {}
    for r in plan.collect():
        got.setdefault(r["request_id"], []).append(r)
    assert [len(got[k]) for k in (1, 2, 3, 4)] == [5, 6, 1, 1]
    assert {r["status"] for r in got[1]} == {"ok"} and {r["status"] for r in got[2] + got[3] + got[4]} == {"rejected"}
    assert (got[1][0]["bug_id"], got[1][0]["team"], got[1][0]["priority"], got[1][0]["title"], got[1][0]["description"]) == ("AB-1", "A", "P2", "Test case", "Test case")
    assert got[2][0]["bug_id"] == "" and got[2][0]["team"] == ""


def test_comment(spark):
    row = (["a ", None, " "], False, ["p"], "f")
    df = spark.createDataFrame([row, (["a"], True, ["p", ""], "f")], "c array<string>, e boolean, p array<string>, f string")
    plain, code = (r[0] for r in df.select(drafts.cause_comment("c", "e", "p", "f", "h3. Head", "h4. Suspect code", "_foot_")).collect())
    assert "Suspect code" not in plain and "* a\n" in plain
    assert "* {{p}}" in code and "{noformat}\nf\n{noformat}" in code


def test_votes_and_levels(spark):
    df = spark.createDataFrame([("High",), ("Medium",), ("Low",)], "c string")
    assert [r[0] for r in df.select(rules.downgrade("c")).collect()] == ["Medium", "Low", "Low"]


@pytest.mark.parametrize(("back", "tier"), [(0, "daily"), (1, "weekly"), (6, "weekly"), (8, "engine")])
def test_tier(spark, back, tier):
    assert one(spark, back, lambda c: analytics.range_tier(F.date_sub(F.lit("2030-01-31").cast("date"), c), F.lit("2030-01-31").cast("date")), "int") == tier


@pytest.mark.parametrize(("n", "tier"), [(5000, "silent"), (5001, "warning"), (10000, "warning"), (10001, "over-cap")])
def test_export(spark, n, tier):
    assert one(spark, n, analytics.export_tier, "int") == tier


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = stream.window_counts(stream.read_events(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = stream.window_counts(rows.withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))


def test_empty_tables(spark):
    tickets = spark.createDataFrame([], "ticket_id int, description string")
    tests = spark.createDataFrame([], "test_id int, summary string")
    assert coverage.shortlist(tickets, tests).count() == 0
    assert coverage.verdicts(tickets, coverage.shortlist(tickets, tests), F.lit(True)).count() == 0


def test_all_orders_are_changes(spark, tmp_path):
    from datetime import datetime, timedelta

    from quarry.plans import registry

    first = datetime(2030, 1, 1, 12)
    rows = [(i, first + timedelta(hours=31 * (i % 40)), "1-URGENT" if i % 7 == 3 else "5-LOW", "P") for i in range(1, 121)] + [(500, None, "1-URGENT", "P")]
    spark.createDataFrame(rows, "o_orderkey long, o_orderdate timestamp_ntz, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["ticket_id"]: (r["n_changes"], r["key_sum"], r["key_xor"]) for r in registry.queries()["release_interval"](spark, str(tmp_path)).collect()}
    want = {}
    for i, opened, _, _ in rows:
        own = [k for k, ts, _, _ in rows if opened and ts and opened - timedelta(days=14) <= ts <= opened]
        xor = 0
        for k in own:
            xor ^= k
        want[i] = (len(own), sum(own), xor)
    assert got == want and any(n > 1 for n, _, _ in want.values()) and want[500] == (0, 0, 0)


def test_carried_over_borders(spark):
    from quarry.operators.carry import carried

    rows = [("a", 1, "x"), ("a", 2, None), ("a", 7, None), ("a", 9, "y"), ("a", 30, None), ("b", 5, None), ("b", 6, "z"), (None, 3, "n"), (None, 50, None)]
    df = spark.createDataFrame(rows, "g string, n int, v string")
    for inclusive in (True, False):
        out = carried(df, {"last": F.col("v")}, ["g"], F.floor(F.col("n") / 4), ["n"], inclusive)
        want = {}
        for g, n, _ in rows:
            seen = [(m, v) for h, m, v in rows if h == g and v and (m <= n if inclusive else m < n)]
            want[g, n] = max(seen)[1] if seen else None
        assert {(r["g"], r["n"]): r["last"] for r in out.collect()} == want


def test_shortlist_is_exact(spark):
    import random

    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(0, 14)))
    tickets, tests = [(i, text()) for i in range(60)] + [(60, None)], [(i, text()) for i in range(40)]
    for top, bottom in ((1, 5), (1, 2), (1, 1), (1, 10)):
        got = coverage.shortlist(spark.createDataFrame(tickets, "ticket_id int, description string"), spark.createDataFrame(tests, "test_id int, summary string"), (top, bottom)).collect()
        want = {}
        for i, x in tickets:
            for j, y in tests:
                a, b = set((x or "").split()), set(y.split())
                if a & b and bottom * len(a & b) >= top * len(a | b):
                    want[i, j] = len(a & b)
        assert {(r["ticket_id"], r["test_id"]): r["shared"] for r in got} == want and want


def test_lines_of_split_files(spark, tmp_path):
    text = "\n".join(f"line {i} " + "x" * (i % 97) for i in range(5000))
    (tmp_path / "a.txt").write_text(text + "\n")
    (tmp_path / "b.txt").write_text("one\r\n\r\nthree")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {}
        for r in readers.lines_of(spark, str(tmp_path)).collect():
            got.setdefault(r["source"][-5:], {})[r["line_no"]] = r["value"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert [got["a.txt"][i] for i in range(1, 5001)] == text.split("\n") and len(got["a.txt"]) == 5000
    assert got["b.txt"] == {1: "one", 2: "", 3: "three"}


def test_leaderboard_ranges(spark):
    rows = [(i, float(i % 7)) for i in range(100)] + [(200, 50.0)]
    got = {r["k"]: (r["place"], r["behind"]) for r in analytics.leaderboard(spark.createDataFrame(rows, "k int, v double"), "k", "v", 5).collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    places = {v: n for n, v in enumerate(sorted({v for _, v in rows}, reverse=True), 1)}
    for n, (k, v) in enumerate(order):
        behind = None if not n else order[n - 1][1] - v
        assert got[k][0] == places[v] and (got[k][1] is None if behind is None else float(got[k][1]) == behind)


def test_report_files(spark, tmp_path):
    reports = spark.createDataFrame([("AB-1", "# a\n\nb"), ("AB-2", "c")], "ticket_id string, report string")
    sinks.write_reports(reports, str(tmp_path / "r"))
    assert sorted((r["ticket_id"], r["value"]) for r in spark.read.text(str(tmp_path / "r"), wholetext=True).collect()) == [("AB-1", "# a\n\nb\n"), ("AB-2", "c\n")]
    assert [(r["file"], r["line_no"], r["line"]) for r in sinks.report_lines(reports).orderBy("file", "line_no").collect()][:3] == [("AB-1-triage.md", 1, "# a"), ("AB-1-triage.md", 2, ""), ("AB-1-triage.md", 3, "b")]


def test_lines_without_an_order(spark, tmp_path):
    from quarry.plans import registry

    spark.createDataFrame([(1,), (1,), (4,), (5,), (None,), (8,)], "l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "1-URGENT"), (4, "5-LOW"), (8, None), (9, "5-LOW")], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["skill"]: r["n"] for r in registry.queries()["none_label"](spark, str(tmp_path)).collect()}
    assert got == {"1-URGENT": 2, "5-LOW": 1, "[None]": 3}


def test_pages_that_share_a_url_are_refreshed_each(spark, tmp_path):
    import duckdb

    from oracle import same
    from quarry.plans import registry

    rows = [(10, "a"), (11, "a"), (20, "a"), (30, "b"), (40, "b"), (50, "c"), (70, "c"), (80, "c"), (-10, "d"), (-20, "d"), (-3, "d"), (0, "e"), (12, None), (90, None), (100, None), (None, "f"), (None, None), (13, "g"), (13, "g"), (13, "h"), (110, "g"), (110, "h")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    left, right = same(registry.queries()["changed_since"](spark, str(tmp_path)), con, registry.oracle_sql()["changed_since"])
    assert left == right and len(left) == 12
