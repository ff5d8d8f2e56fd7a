"""Queries for the behaviour that is only described (the reporting layer)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions.text import or_none
from quarry.operators import analytics as A
from quarry.plans.registry import query, table

AS_OF = "DATE '1998-06-15'"


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey NOT IN (1, 2, 3)")
def filters_and_or(spark, d):
    return table(spark, d, "customer").where(A.attribute_filter([("c_mktsegment", "=", ["BUILDING"]), ("c_nationkey", "<>", [1, 2, 3])])).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey NOT IN (1, 2, 3)")
def filters_or(spark, d):
    return table(spark, d, "customer").where(A.attribute_filter([("c_mktsegment", "=", ["BUILDING"]), ("c_nationkey", "<>", [1, 2, 3])], "or")).select("c_custkey")


@query("""WITH t AS (SELECT l_orderkey, count(*) AS n, max(l_quantity) AS most FROM lineitem GROUP BY 1)
    SELECT 'a' AS filter, l_orderkey, n, most FROM t WHERE n >= 5 AND most < 40 UNION ALL SELECT 'b', l_orderkey, n, most FROM t WHERE n <> 1 AND most <= 12 AND n > 2 UNION ALL SELECT 'c', l_orderkey, n, most FROM t WHERE n = 7""")
def having_metric(spark, d):
    """All six comparisons; one with what is no number lets nothing through."""
    out = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("most"))
    own = lambda name, *cs: out.where(A.metric_filter(list(cs))).select(F.lit(name).alias("filter"), "l_orderkey", "n", "most")
    return own("a", ("n", ">=", "5"), ("most", "<", "40")).unionByName(own("b", ("n", "<>", "1"), ("most", "<=", "12"), ("n", ">", "2"))).unionByName(own("c", ("n", "=", "7"))).unionByName(own("d", ("n", "=", "seven")))


@query(f"""SELECT p AS preset, count(*) AS n FROM orders, (VALUES
      ('yesterday', {AS_OF} - 1, {AS_OF}), ('last 7 days', {AS_OF} - 7, {AS_OF}), ('last 30 days', {AS_OF} - 30, {AS_OF}),
      ('last week', date_trunc('week', {AS_OF})::DATE - 7, date_trunc('week', {AS_OF})::DATE), ('last month', DATE '1998-05-01', DATE '1998-06-01')) r(p, a, b)
    WHERE o_orderdate::DATE >= a AND o_orderdate::DATE < b GROUP BY 1""")
def preset_ranges(spark, d):
    day, as_of = F.to_date("o_orderdate"), F.expr(AS_OF)
    names = ["yesterday", "last 7 days", "last 30 days", "last week", "last month"]
    hits = F.array_compact(F.array(*[F.when(A.preset(n, day, as_of), n) for n in names]))
    return table(spark, d, "orders").select(F.explode(hits).alias("preset")).groupBy("preset").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM events GROUP BY 1")
def share_pct(spark, d):
    return A.share(table(spark, d, "events"), "event_type")


@query("SELECT 'a' AS viewer, c_custkey FROM customer WHERE c_nationkey IN (1, 2) UNION ALL SELECT 'b', c_custkey FROM customer")
def rbac_rows(spark, d):
    views = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3)], "user string, c_nationkey int")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    own = [A.restricted(c, views, u, "c_nationkey").select(F.lit(u).alias("viewer"), "c_custkey") for u in ("a", "b")]
    return own[0].unionByName(own[1])


@query("""WITH a AS (SELECT l_orderkey AS k, count(*) AS v FROM lineitem WHERE l_linenumber < 7 GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) AS v FROM lineitem WHERE l_linenumber > 1 GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS k, a.v AS left_value, b.v AS right_value FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")
def reconcile(spark, d):
    count = lambda where: table(spark, d, "lineitem").where(where).groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    return A.reconcile(count("l_linenumber < 7"), count("l_linenumber > 1"), "k", "v")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'red' WHEN c_acctbal < 5000 THEN 'amber' ELSE 'green' END AS band FROM customer")
def bands(spark, d):
    return table(spark, d, "customer").select("c_custkey", A.band(F.col("c_acctbal"), [(0, "red"), (5000, "amber")], "green").alias("band"))


@query("SELECT coalesce(o_orderpriority, '[None]') AS skill, count(*) AS n FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def none_label(spark, d):
    """All lines with all orders; a line without one counts as [None]."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.groupBy(or_none("o_orderpriority").alias("skill")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, lpad((floor(round(value * 1234000) / 3600000)::BIGINT)::VARCHAR, greatest(2, length((floor(round(value * 1234000) / 3600000)::BIGINT)::VARCHAR))::INT, '0') || strftime(make_timestamp((round(value * 1234000)::BIGINT % 3600000) * 1000), ':%M:%S.%g') AS lasted FROM events")
def interval_format(spark, d):
    return table(spark, d, "events").select("event_id", A.duration_text(F.col("value") * 1234).alias("lasted"))


@query("""WITH t AS (SELECT o_orderpriority AS key, date_trunc('month', o_orderdate)::DATE AS period, sum(o_totalprice::DECIMAL(38,2)) AS total FROM orders GROUP BY 1, 2)
    SELECT t.key, t.period, t.total::DOUBLE AS total, p.total::DOUBLE AS previous, (t.total - p.total)::DOUBLE AS change FROM t LEFT JOIN t p ON p.key = t.key AND p.period + INTERVAL 1 MONTH = t.period""")
def previous_period(spark, d):
    out = A.previous_period(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "key"), "key", "o_orderdate", "o_totalprice")
    return out.select("key", "period", *[F.col(c).cast("double").alias(c) for c in ("total", "previous", "change")])


@query("SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def interval_bucket(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour")["start"].alias("bucket"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT o_orderpriority AS k, count(*) AS v FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1) GROUP BY 1),
    b AS (SELECT o_orderpriority AS k, count(*) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1 GROUP BY 1)
    SELECT k, a.v AS summary, b.v AS detail, a.v = b.v AS agrees FROM a JOIN b USING (k)""")
def totals_agree(spark, d):
    """A summary of orders with a first line against the detail of first lines, each from its own table: orders with two first lines disagree."""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem").where("l_linenumber = 1")
    met = F.col("l_orderkey") == F.col("o_orderkey")
    count = lambda rows: rows.groupBy(F.col("o_orderpriority").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    return A.totals(count(o.join(l, met, "left_semi")), count(l.join(o, met)), "k", "v")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_version(spark, d):
    return A.latest(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT l_orderkey, l_linenumber, l_quantity - 3 AS value, l_quantity < 3 OR l_shipdate < o_orderdate AS flagged FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def quality_flags(spark, d):
    """Negative numbers, and lines shipped before they were ordered."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 3).alias("value"), A.incongruent(F.col("l_quantity") - 3, F.col("o_orderdate"), F.col("l_shipdate")).alias("flagged"))


@query("SELECT 'a' AS viewer, c_custkey FROM customer WHERE c_nationkey IN (1, 2) OR c_mktsegment <> 'BUILDING' UNION ALL SELECT 'b', c_custkey FROM customer")
def visible_forms(spark, d):
    """Where no team structure is implemented a form is visible to all; elsewhere a viewer's own nations count."""
    views = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3)], "user string, c_nationkey int")
    own = [A.visible_forms(table(spark, d, "customer"), views, u, "c_nationkey", F.col("c_mktsegment") == "BUILDING").select(F.lit(u).alias("viewer"), "c_custkey") for u in ("a", "b")]
    return own[0].unionByName(own[1])


@query("""WITH c AS (SELECT c_nationkey, count(*) AS n, sum(c_acctbal::DECIMAL(38,2))::DOUBLE AS total FROM customer GROUP BY 1)
    SELECT 'a' AS viewer, * FROM c WHERE c_nationkey IN (4, 5) UNION ALL SELECT 'b', * FROM c WHERE c_nationkey = 4""")
def cached_viewers(spark, d):
    """One aggregate for all; what each viewer gets of it follows the last assignment, an older one opens nothing."""
    cache = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c_acctbal").cast("decimal(38,2)")).cast("double").alias("total"))
    given = spark.createDataFrame([("a", 3, 1), ("a", 4, 2), ("a", 5, 2), ("b", 4, 7), ("b", 9, 6)], "viewer string, c_nationkey int, since int")
    own = [A.cached_for(cache, given, u, "c_nationkey").select(F.lit(u).alias("viewer"), "c_nationkey", "n", "total") for u in ("a", "b")]
    return own[0].unionByName(own[1])


@query("""WITH s(st, n) AS (VALUES ('view', 1), ('click', 2), ('signup', 3), ('purchase', 4)),
    h AS (SELECT user_id, date_trunc('day', ts) AS d, list(DISTINCT event_type) AS have FROM events GROUP BY 1, 2),
    r AS (SELECT user_id::VARCHAR || '/' || strftime(d, '%Y-%m-%d') AS k, have, (SELECT coalesce(max(n), 0) FROM s WHERE list_contains(have, st)) AS reached FROM h)
    SELECT k, reached::INT AS reached, (SELECT string_agg(st, ',' ORDER BY n) FROM s WHERE n <= reached AND NOT list_contains(have, st)) AS missing FROM r
    WHERE (SELECT count(*) FROM s WHERE n <= reached AND NOT list_contains(have, st)) > 0""")
def state_gaps(spark, d):
    e = table(spark, d, "events").withColumn("k", F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd")))
    return A.missing_steps(e, "k", "event_type", ["view", "click", "signup", "purchase"])


@query(f"SELECT CASE WHEN b <= 0 THEN 'daily' WHEN b <= 7 THEN 'weekly' ELSE 'engine' END AS tier, count(*) AS n FROM (SELECT date_diff('day', o_orderdate::DATE, {AS_OF}) AS b FROM orders) GROUP BY 1")
def range_tier(spark, d):
    return table(spark, d, "orders").groupBy(A.range_tier(F.to_date("o_orderdate"), F.expr(AS_OF)).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT event_type, sum(value::DECIMAL(18,2))::DOUBLE AS s, count(*) AS c FROM events GROUP BY 1)
    SELECT event_type, s, c, true AS same FROM d UNION ALL SELECT 'late', s + 1, c, false FROM d WHERE event_type = 'view'""")
def cache_equiv(spark, d):
    """Daily sums added up against the raw rows; a row that only the cache has is told apart."""
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), "event_type", F.col("value").cast("decimal(18,2)").alias("v"))
    daily = e.groupBy("day", "event_type").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("c"))
    cached = daily.groupBy("event_type").agg(F.sum("s").cast("decimal(38,2)").alias("s"), F.sum("c").alias("c"))
    direct = e.groupBy("event_type").agg(F.sum("v").cast("decimal(38,2)").alias("s"), F.count(F.lit(1)).alias("c"))
    late = direct.where("event_type = 'view'").select(F.lit("late").alias("event_type"), (F.col("s") + 1).cast("decimal(38,2)").alias("s"), "c")
    return A.told_apart(cached.unionByName(late), direct).withColumn("s", F.col("s").cast("double"))


@query("""WITH t AS (SELECT event_id, count(*) OVER () AS n_rows, row_number() OVER (ORDER BY value DESC, event_id) AS n FROM events)
    SELECT event_id, n_rows, CASE WHEN n_rows <= 5000 THEN 'silent' WHEN n_rows <= 10000 THEN 'warning' ELSE 'over-cap' END AS tier FROM t WHERE n <= 10000""")
def export_capped(spark, d):
    """The rows of an export: at most the cap, and how many there were."""
    return A.export_rows(table(spark, d, "events"), [F.col("value").desc(), F.col("event_id")]).select("event_id", "n_rows", "tier")


@query("""WITH t AS (SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS n FROM supplier)
    SELECT s_suppkey, 'portrait' AS layout, (n // 3 + 1)::INT AS page, n % 3 = 0 AS header FROM t""")
def page_rows(spark, d):
    """Each nation's suppliers on pages of three rows, headers on each page; so few columns stand upright."""
    s = table(spark, d, "supplier")
    n = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1
    return s.withColumn("n", n).select("s_suppkey", F.lit(A.page_layout(len(s.columns))).alias("layout"), *[c.alias(k) for k, c in A.pages_of(F.col("n"), 3).items()])


@query("SELECT 'some' AS what, count(*) AS n, '' AS message FROM events UNION ALL SELECT 'none', 0, 'No data'")
def no_data(spark, d):
    e = table(spark, d, "events")
    own = lambda name, rows: A.shown(rows).select(F.lit(name).alias("what"), "n", "message")
    return own("some", e).unionByName(own("none", e.where("value < 0 and value > 1")))


@query("SELECT event_type, count(*) AS n, CASE WHEN count(*) <= 5000 THEN 'silent' WHEN count(*) <= 10000 THEN 'warning' ELSE 'over-cap' END AS tier FROM events GROUP BY ROLLUP (event_type)")
def export_tier(spark, d):
    return table(spark, d, "events").rollup("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("tier", A.export_tier(F.col("n")))


@query("""WITH v AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n, min(ts) OVER (PARTITION BY user_id, event_type) AS f FROM events)
    SELECT user_id, event_type, min(ts) AS first_seen, count(*) AS view_count, (count(*) >= 3 OR date_diff('day', min(ts)::DATE, DATE '2024-01-20') >= 14) AS dismissed
    FROM v WHERE n <= 3 AND date_diff('day', f::DATE, ts::DATE) < 14 GROUP BY 1, 2""")
def display_state(spark, d):
    return A.display_state(table(spark, d, "events"), ["user_id", "event_type"], "ts", ["event_id"], F.expr("DATE '2024-01-20'"))


@query("""WITH f AS (SELECT *, min(ts) OVER (PARTITION BY user_id, event_type) AS f0 FROM events),
    r AS (SELECT *, min(ts) OVER (PARTITION BY user_id, event_type) AS f1 FROM f WHERE date_diff('day', f0::DATE, DATE '2024-01-12') >= 14 OR ts >= DATE '2024-01-12'),
    h AS (SELECT user_id, event_type, min(ts) AS done FROM events WHERE value < 1 GROUP BY 1, 2),
    v AS (SELECT r.*, done, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM r LEFT JOIN h USING (user_id, event_type) WHERE done IS NULL OR ts <= done)
    SELECT user_id, event_type, min(ts) AS first_seen, count(*) AS view_count, (count(*) >= 3 OR date_diff('day', min(ts)::DATE, DATE '2024-01-20') >= 14 OR max(done) IS NOT NULL) AS dismissed
    FROM v WHERE n <= 3 AND date_diff('day', f1::DATE, ts::DATE) < 14 GROUP BY 1, 2""")
def display_reset(spark, d):
    """With a dismissal by hand (a value below 1) and a global reset on 12 January."""
    e = table(spark, d, "events")
    by_hand = e.where("value < 1").select("user_id", "event_type", F.col("ts").alias("dismissed_ts"))
    return A.display_state(e, ["user_id", "event_type"], "ts", ["event_id"], F.expr("DATE '2024-01-20'"), by_hand, F.expr("DATE '2024-01-12'"))


@query("""SELECT l_suppkey, coalesce(round(100.0 * sum((l_returnflag = 'R')::INT) / nullif(sum((l_linestatus = 'F')::INT), 0), 4), 0.0)::DOUBLE AS pct FROM lineitem GROUP BY 1""")
def safe_pct(spark, d):
    part, whole = F.sum((F.col("l_returnflag") == "R").cast("int")), F.sum((F.col("l_linestatus") == "F").cast("int"))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(A.safe_percent(part, whole).alias("pct"))


@query("""WITH t AS (SELECT s_nationkey, sum(s_acctbal::DECIMAL(38,2)) AS total FROM supplier GROUP BY 1)
    SELECT s_nationkey, total::DOUBLE AS total, dense_rank() OVER (ORDER BY total DESC)::INT AS place, (lag(total) OVER (ORDER BY total DESC, s_nationkey) - total)::DOUBLE AS behind FROM t""")
def leaderboard(spark, d):
    return A.leaderboard(table(spark, d, "supplier"), "s_nationkey", "s_acctbal").select("s_nationkey", F.col("total").cast("double").alias("total"), "place", F.col("behind").cast("double").alias("behind"))


@query("SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY 1")
def score_spread(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), (F.max("o_totalprice") - F.min("o_totalprice")).alias("spread"))


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00012')")
def typed_search(spark, d):
    return table(spark, d, "customer").where(F.lower("c_name").contains("00012")).select("c_custkey", "c_name")


@query("""SELECT 'Asia/Tokyo' AS zone, count(*) AS n FROM events WHERE (ts + INTERVAL 9 HOUR)::DATE >= DATE '2024-01-13' AND (ts + INTERVAL 9 HOUR)::DATE < DATE '2024-01-20'
    UNION ALL SELECT 'UTC', count(*) FROM events WHERE ts::DATE >= DATE '2024-01-13' AND ts::DATE < DATE '2024-01-20'""")
def zone_window(spark, d):
    e, as_of = table(spark, d, "events"), F.expr("DATE '2024-01-20'")
    own = lambda zone: e.where(A.preset("last 7 days", F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone)), as_of)).agg(F.lit(zone).alias("zone"), F.count(F.lit(1)).alias("n"))
    return own("Asia/Tokyo").unionByName(own("UTC"))


@query("SELECT 'agent' AS view_by, count(*) AS n FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'team', count(*) FROM customer")
def view_by(spark, d):
    own = lambda how: A.visible_agents(table(spark, d, "customer"), how, F.col("c_acctbal") >= 0).agg(F.lit(how).alias("view_by"), F.count(F.lit(1)).alias("n"))
    return own("agent").unionByName(own("team"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('error', 'view') GROUP BY 1")
def hidden_states(spark, d):
    return A.without_states(table(spark, d, "events"), "event_type", ["error", "view"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, count(DISTINCT CASE WHEN event_type = 'error' THEN dayofweek(ts) END)::BIGINT AS days, bool_or(event_type = 'error') AS valid FROM events GROUP BY 1")
def days_of_week(spark, d):
    """The days with an error as a user's choice; a user without any has chosen none."""
    out = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("event_type") == "error", F.dayofweek("ts"))).alias("d"))
    return out.select("user_id", F.size("d").cast("bigint").alias("days"), A.days_valid(F.col("d")).alias("valid"))


@query("SELECT n_nationkey AS k, n_name AS left_value, CASE WHEN n_nationkey % 4 = 1 THEN 'x' END AS right_value FROM nation WHERE n_nationkey % 4 < 2")
def settings_agree(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    shown = n.where("k % 4 > 0").withColumn("v", F.when(F.col("k") % 4 == 1, "x").otherwise(F.col("v")))
    return A.settings_agree(n, shown, "k", "v")
