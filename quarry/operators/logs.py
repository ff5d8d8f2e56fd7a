"""Logs: requests correlated, warnings attributed, retries and silent failures found, changes related."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.carry import carried


def attribute(log: DataFrame, request: Column, by: list[str], key: list[str], bucket: Column) -> DataFrame:
    """log with request_id: a line's own request, else that of the nearest line before it in its group, and whether it was lent.

    bucket (an hour of the time, say) only deals the work out: a request is
    carried over its borders. Adjacency is a guess when requests interleave:
    attributed says where it was used.
    """
    return carried(log.withColumn("attributed", request.isNull()), {"request_id": request}, by, bucket, key)


def correlate(log: DataFrame, request: str = "request_id") -> DataFrame:
    """One row for each request: lines, first, last, status and rows that it reported."""
    return log.where(F.col(request).isNotNull()).groupBy(request).agg(
        F.count(F.lit(1)).alias("lines"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.max(F.try_element_at("kv", F.lit("status"))).alias("status"), F.max(F.try_element_at("kv", F.lit("rows"))).alias("rows"),
    )


def is_silent_failure(status: Column | str, rows: Column | str) -> Column:
    """Success reported, nothing returned."""
    s, r = (F.col(c) if isinstance(c, str) else c for c in (status, rows))
    return F.coalesce((s.cast("string") == "200") & (r.cast("string") == "0"), F.lit(False))


def retries(requests: DataFrame, same: list[str], order: list[str], ts: str = "ts") -> DataFrame:
    """For each kind of request its count, first and last time, and the gaps in seconds, where there is more than one."""
    w = Window.partitionBy(*same).orderBy(ts, *order)
    gap = F.unix_seconds(F.col(ts).cast("timestamp")) - F.unix_seconds(F.lag(ts).over(w).cast("timestamp"))
    out = requests.withColumn("__gap", gap).groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.min("__gap").alias("least_gap_s"), F.max("__gap").alias("most_gap_s"))
    return out.where("n > 1")


def preceding_changes(tickets: DataFrame, changes: DataFrame, days: int = 14) -> DataFrame:
    """ticket_id, change_id of the changes made within so many days before a ticket was opened.

    The times are dealt into buckets of that many days; a ticket looks into its
    own bucket and the one before, so the join has keys and its size follows
    the matches, not the product.
    """
    bucket = lambda c: F.floor(F.unix_date(F.col(c).cast("date")) / days)
    left = tickets.select("ticket_id", "opened_ts", F.explode(F.array(bucket("opened_ts"), bucket("opened_ts") - 1)).alias("__b"))
    right = changes.select("change_id", "change_ts", bucket("change_ts").alias("__b"))
    fits = (F.col("change_ts") <= F.col("opened_ts")) & (F.col("change_ts") >= F.col("opened_ts") - F.make_dt_interval(F.lit(days)))
    return left.join(right, "__b").where(fits).select("ticket_id", "change_id")


def preceding_change_counts(tickets: DataFrame, changes: DataFrame, days: int = 14) -> DataFrame:
    """n_changes, key_sum and key_xor (of change_id, a number) of each ticket's preceding changes, 0 without any.

    Changes are added up by their time before they meet tickets, so the join
    makes a row for each time within a ticket's days and not for each change.
    """
    times = changes.where("change_ts is not null").groupBy("change_ts").agg(F.count(F.lit(1)).alias("n"), F.sum("change_id").alias("s"), F.bit_xor("change_id").alias("x"))
    met = preceding_changes(tickets, times.select(F.struct("n", "s", "x").alias("change_id"), "change_ts"), days)
    told = met.groupBy("ticket_id").agg(F.sum("change_id.n").alias("n_changes"), F.sum("change_id.s").alias("key_sum"), F.bit_xor("change_id.x").alias("key_xor"))
    return tickets.select("ticket_id").join(told, "ticket_id", "left").na.fill(0, ["n_changes", "key_sum", "key_xor"])
