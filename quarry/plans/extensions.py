"""Queries beyond the surveyed behaviour, named ext_: they claim no parity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.plans.registry import query, table
from quarry.streaming import events as stream


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT event_id, round(sum(value::DECIMAL(18,2)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2)::DOUBLE AS last_three FROM events")
def ext_frames(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return table(spark, d, "events").select("event_id", F.sum(F.col("value").cast("decimal(18,2)")).over(w).cast("double").alias("last_three"))


@query("SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY 1, 2")
def ext_tumbling(spark, d):
    return stream.window_counts(table(spark, d, "events")).withColumn("total", F.col("total").cast("double"))


@query("""SELECT event_type, w AS window_start, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total
    FROM (SELECT *, unnest([date_trunc('hour', ts) + INTERVAL 30 MINUTE * k FOR k IN [-1, 0, 1]]) AS w FROM events) WHERE ts >= w AND ts < w + INTERVAL 1 HOUR GROUP BY 1, 2""")
def ext_sliding(spark, d):
    return stream.window_counts(table(spark, d, "events"), "1 hour", "30 minutes").withColumn("total", F.col("total").cast("double"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def ext_sessions(spark, d):
    return stream.sessions(table(spark, d, "events"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def ext_pricing(spark, d):
    rows = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def ext_nation_revenue(spark, d):
    t = lambda n: table(spark, d, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
