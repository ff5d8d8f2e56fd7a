"""The reporting layer that tickets talk about, as far as its behaviour is described (class "described")."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SILENT_ROWS, EXPORT_CAP = 5_000, 10_000
VIEWS, DAYS = 3, 14
PORTRAIT_COLUMNS = 10
LONG_TEXT_WORDS = 3_000
COMPARE = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def attribute_filter(conditions: list[tuple[str, str, list]], connector: str = "and") -> Column:
    """= takes one value, <> any number; all are joined by the one connector; no condition lets all through."""
    each = [F.col(c) == vs[0] if op == "=" else ~F.col(c).isin(vs) for c, op, vs in conditions]
    return reduce(operator.and_ if connector == "and" else operator.or_, each) if each else F.lit(True)


def metric_filter(conditions: list[tuple[str, str, str]]) -> Column:
    """Six comparisons of metrics with numbers; a value that is no number lets nothing through."""
    each = [F.coalesce(COMPARE[op](F.col(c), F.expr(f"try_cast('{float(v)!r}' as double)")) if _is_number(v) else F.lit(False), F.lit(False)) for c, op, v in conditions]
    return reduce(operator.and_, each) if each else F.lit(True)


def _is_number(v: str) -> bool:
    try:
        float(v)
    except ValueError:
        return False
    return True


def preset(name: str, day: Column, as_of: Column) -> Column:
    """Whether a day lies in a preset range before as_of (a date; never the clock)."""
    if name == "yesterday":
        return day == F.date_sub(as_of, 1)
    if name == "last week":
        start = F.date_sub(F.date_trunc("week", as_of).cast("date"), 7)
        return (day >= start) & (day < F.date_add(start, 7))
    if name == "last month":
        start = F.add_months(F.date_trunc("month", as_of).cast("date"), -1)
        return (day >= start) & (day < F.add_months(start, 1))
    days = {"today": 0, "last 7 days": 7, "last 30 days": 30, "last 90 days": 90}[name]
    return (day == as_of) if not days else (day >= F.date_sub(as_of, days)) & (day < as_of)


def range_tier(start: Column, as_of: Column) -> Column:
    """Which store answers: today the daily cache, up to a week back the weekly one, else the engine (day 7 of a custom range is our choice: weekly)."""
    back = F.date_diff(as_of, start)
    return F.when(back <= 0, "daily").when(back <= 7, "weekly").otherwise("engine")


def export_tier(n: Column) -> Column:
    return F.when(n <= SILENT_ROWS, "silent").when(n <= EXPORT_CAP, "warning").otherwise("over-cap")


def export_rows(df: DataFrame, order: list[Column]) -> DataFrame:
    """At most EXPORT_CAP rows in order, with the number of rows there were and its tier: never cut without saying so."""
    total = df.agg(F.count(F.lit(1)))
    return df.orderBy(*order).limit(EXPORT_CAP).withColumn("n_rows", total.scalar()).withColumn("tier", export_tier(F.col("n_rows")))


def page_layout(columns: int) -> str:
    return "portrait" if columns <= PORTRAIT_COLUMNS else "landscape"


def pages_of(place: Column, page_rows: int) -> dict[str, Column]:
    """page (from 1) and whether the headers are printed again above a row, by its place (from 0)."""
    return {"page": (F.floor(place / page_rows) + 1).cast("int"), "header": place % page_rows == 0}


def shown(df: DataFrame) -> DataFrame:
    """One row: how many rows there are, and what a screen says when there are none."""
    return df.agg(F.count(F.lit(1)).alias("n")).withColumn("message", F.when(F.col("n") == 0, "No data").otherwise(""))


def share(df: DataFrame, by: str) -> DataFrame:
    """by, n, percent of all rows."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / df.agg(F.count(F.lit(1))).scalar(), 4))


def safe_percent(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.round(F.try_divide(part.cast("double") * 100.0, whole.cast("double")), 4), F.lit(0.0))


def band(value: Column, edges: list[tuple[float, str]], above: str) -> Column:
    """The name of the first band whose upper edge a value stays below."""
    out = F.lit(above)
    for edge, name in reversed(edges):
        out = F.when(value < edge, name).otherwise(out)
    return F.when(value.isNull(), "none").otherwise(out)


def restricted(rows: DataFrame, views: DataFrame, user: str, on: str) -> DataFrame:
    """The rows that a user's views allow; a user without any view sees all."""
    own = views.where(F.col("user") == user).select(on).distinct()
    none = own.agg(F.count(F.lit(1)) == 0).scalar()
    return rows.join(own.withColumn("__seen", F.lit(True)), on, "left").where(F.col("__seen") | none).drop("__seen")


def reconcile(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """key, left, right, of keys whose values differ or that one side lacks."""
    both = a.select(key, F.col(value).alias("left_value")).join(b.select(key, F.col(value).alias("right_value")), key, "full_outer")
    return both.where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def totals(summary: DataFrame, detail: DataFrame, key: str, value: str) -> DataFrame:
    """key, summary, detail, agrees: a summary's totals against those of its detail, a side that lacks a key counts as 0."""
    both = summary.select(key, F.col(value).alias("summary")).join(detail.select(key, F.col(value).alias("detail")), key, "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select(key, zero("summary").alias("summary"), zero("detail").alias("detail"), (zero("summary") == zero("detail")).alias("agrees"))


def told_apart(cached: DataFrame, direct: DataFrame) -> DataFrame:
    """All rows of both, with same: whether the other side has the row too (as often)."""
    alike = cached.intersectAll(direct).withColumn("same", F.lit(True))
    odd = cached.exceptAll(direct).unionAll(direct.exceptAll(cached)).withColumn("same", F.lit(False))
    return alike.unionByName(odd)


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last version of each key; all versions together are the history."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order]))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def missing_steps(states: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """key, done, missing: the states of an ordered lifecycle that a key should have by its latest state but has not."""
    have = states.groupBy(key).agg(F.collect_set(state).alias("have"))
    steps = F.array(*map(F.lit, order))
    reached = F.array_max(F.transform("have", lambda s: F.array_position(steps, s)))
    wanted = F.slice(steps, 1, reached.cast("int"))
    return have.select(key, reached.cast("int").alias("reached"), F.array_join(F.filter(wanted, lambda s: ~F.array_contains(F.col("have"), s)), ",").alias("missing")).where("missing <> ''")


def display_state(views: DataFrame, key: list[str], ts: str, order: list[str], as_of: Column, dismissals: DataFrame | None = None, reset: Column | None = None) -> DataFrame:
    """first_seen, view_count (to VIEWS) and dismissed of a message: by its third view, DAYS days after the first, or by hand.

    dismissals (key, dismissed_ts): views after it do not count. A global reset
    (a date) forgets what was seen before it, unless the message had expired by
    then (DAYS days since the first view): then nothing is forgotten.
    """
    first = F.min(ts).over(Window.partitionBy(*key))
    rows = views.withColumn("__first", first)
    if reset is not None:
        kept = (F.date_diff(reset, F.col("__first")) >= DAYS) | (F.col(ts) >= reset)
        rows = rows.where(kept).withColumn("__first", F.min(ts).over(Window.partitionBy(*key)))
    by_hand = F.lit(None).cast("timestamp_ntz")
    if dismissals is not None:
        done = dismissals.groupBy(*key).agg(F.min("dismissed_ts").alias("__done"))
        rows, by_hand = rows.join(done, key, "left"), F.col("__done")
    rows = rows.withColumn("__done", by_hand).where(F.col("__done").isNull() | (F.col(ts) <= F.col("__done")))
    seen = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(ts, *order)))
    kept = seen.where((F.col("__n") <= VIEWS) & (F.date_diff(F.col(ts), F.col("__first")) < DAYS))
    out = kept.groupBy(*key).agg(F.min(ts).alias("first_seen"), F.count(F.lit(1)).alias("view_count"), F.max("__done").alias("__done"))
    ended = (F.col("view_count") >= VIEWS) | (F.date_diff(as_of, F.col("first_seen")) >= DAYS) | F.col("__done").isNotNull()
    return out.withColumn("dismissed", ended).drop("__done")


def leaderboard(rows: DataFrame, by: str, value: str, ranges: int = 32) -> DataFrame:
    """by, total, place (dense), change against the one above.

    Totals are ranked within ranges that quantiles cut; the distinct totals of
    the ranges above, a few numbers, are added to the places.
    """
    sums = rows.groupBy(by).agg(F.sum(F.col(value).cast("decimal(38,2)")).alias("total"))
    edges = sorted(set(sums.select(F.col("total").cast("double").alias("t")).approxQuantile("t", [i / ranges for i in range(1, ranges)], 0.01)))
    above = F.size(F.filter(F.array(*[F.lit(e) for e in edges]).cast("array<double>"), lambda e: F.col("total").cast("double") < e))
    ranked = sums.withColumn("__r", above)
    within = Window.partitionBy("__r").orderBy(F.col("total").desc())
    each = Window.partitionBy("__r").orderBy(F.col("total").desc(), by)
    before = Window.partitionBy(F.lit(0)).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    told = ranked.groupBy("__r").agg(F.count_distinct("total").alias("d"), F.min("total").alias("last"))
    told = told.select("__r", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("__places"), F.last("last", True).over(before).alias("__above"))
    out = ranked.withColumns({"place": F.dense_rank().over(within), "__lag": F.lag("total").over(each)}).join(told, "__r")
    return out.select(by, "total", (F.col("place") + F.col("__places")).cast("int").alias("place"), (F.coalesce("__lag", "__above") - F.col("total")).alias("behind"))


def previous_period(rows: DataFrame, key: str, ts: str, value: str, unit: str = "MONTH") -> DataFrame:
    """key, period, total, previous (the total of the period just before, null without rows in it) and change."""
    sums = rows.groupBy(key, F.date_trunc(unit, ts).cast("date").alias("period")).agg(F.sum(F.col(value).cast("decimal(38,2)")).alias("total"))
    following = {"MONTH": F.add_months("period", 1), "WEEK": F.date_add("period", 7), "DAY": F.date_add("period", 1)}[unit]
    prior = sums.select(key, following.alias("period"), F.col("total").alias("previous"))
    return sums.join(prior, [key, "period"], "left").withColumn("change", F.col("total") - F.col("previous"))


def duration_text(seconds: Column) -> Column:
    """HH:mm:ss.SSS of a number of seconds; hours go on beyond a day."""
    ms = F.round(seconds * 1000).cast("bigint")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.floor(ms / 3_600_000)
    return F.concat(F.when(hours < 10, two(hours)).otherwise(hours.cast("string")), F.lit(":"), two(F.floor(ms / 60_000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def incongruent(value: Column, start: Column, end: Column) -> Column:
    """A negative number, or an end before its start."""
    return F.coalesce(value < 0, F.lit(False)) | F.coalesce(end < start, F.lit(False))


def visible_forms(forms: DataFrame, views: DataFrame, user: str, on: str, structured: Column) -> DataFrame:
    """Forms where the team structure is implemented are restricted to a user's views; the others are visible to all."""
    open_ = forms.where(~F.coalesce(structured, F.lit(False)))
    return restricted(forms.where(F.coalesce(structured, F.lit(False))), views, user, on).select(forms.columns).unionByName(open_)


def cached_for(cache: DataFrame, assignments: DataFrame, viewer: str, on: str) -> DataFrame:
    """What one viewer sees of an aggregate that all viewers share: only rows of what is assigned to the viewer now.

    The filter comes after the shared aggregate, so one cache serves all; an
    assignment (viewer, on, since) that a later one of the same viewer replaces does not count.
    """
    last = assignments.where(F.col("viewer") == viewer)
    current = last.groupBy("viewer").agg(F.max("since").alias("since"))
    return cache.join(last.join(current, ["viewer", "since"], "left_semi").select(on), on, "left_semi")


def visible_agents(rows: DataFrame, view_by: str, active: Column) -> DataFrame:
    """By agent the inactive ones are hidden; by team they count."""
    return rows.where(active) if view_by == "agent" else rows


def without_states(rows: DataFrame, state: str, hidden: list[str]) -> DataFrame:
    """The rows in none of the hidden states; a row without a state stays."""
    return rows.where(~F.coalesce(F.col(state).isin(hidden), F.lit(False)))


def days_valid(days: Column) -> Column:
    """Any choice of days will do, all of them too, as long as there is one."""
    return F.coalesce(F.size(days), F.lit(0)) >= 1


def settings_agree(stored: DataFrame, shown: DataFrame, key: str, value: str) -> DataFrame:
    """Settings that a screen shows otherwise than they are stored."""
    return reconcile(stored, shown, key, value)
