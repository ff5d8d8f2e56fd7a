"""Rules: causes from symptoms, confidence votes, priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import words

# What usually lies behind a symptom, first match first.
CAUSES = [
    ("api_data_ui_empty", "Frontend rendering"),
    ("chart_right_grid_wrong", "Mapping issue"),
    ("export_empty_widget_full", "Export layer"),
    ("fixed_by_hard_refresh", "Cache/state issue"),
    ("endless_refresh", "Failed API retry loop"),
    ("old_value_persists", "Persistence issue"),
    ("internal_name_shown", "Translation issue"),
    ("counts_differ", "Aggregation mismatch"),
    ("sql_error", "Backend/service issue"),
    ("done_but_empty", "Data synchronization issue"),
]
LEVELS = ["Low", "Medium", "High"]


def cause(flags: dict[str, Column]) -> Column:
    """The cause that goes with the first symptom that holds, or null."""
    out = F.lit(None).cast("string")
    for name, said in reversed(CAUSES):
        if name in flags:
            out = F.when(F.coalesce(flags[name], F.lit(False)), said).otherwise(out)
    return out


def downgrade(level: Column | str) -> Column:
    """One step down, not below Low."""
    c = F.col(level) if isinstance(level, str) else level
    return F.when(c == "High", "Medium").otherwise(F.when(c == "Medium", "Low").otherwise(c))


def voted(findings: DataFrame, votes: DataFrame) -> DataFrame:
    """findings (ticket_id, confidence) after the verifiers' votes (ticket_id, refuted): one refutation is enough to downgrade and tag."""
    against = votes.groupBy("ticket_id").agg(F.bool_or("refuted").alias("downgraded"))
    out = findings.join(against, "ticket_id", "left").withColumn("downgraded", F.coalesce("downgraded", F.lit(False)))
    return out.withColumn("confidence", F.when(F.col("downgraded"), downgrade("confidence")).otherwise(F.col("confidence")))


def priority(impact: Column, workaround: Column, loss: Column) -> Column:
    """Our own table (the criteria are not published): loss of data first, then reach, then whether there is a way round."""
    return F.when(loss, "P1").when((impact == "many") & ~workaround, "P2").when((impact == "many") | ~workaround, "P3").otherwise("P4")


def classified(text: Column, rules: list[tuple[str, str, list[str]]], default: str = "unknown") -> dict[str, Column]:
    """For each field of the caller's rules (field, value, words) the value of the first rule one of whose words the text holds, and confidence.

    The criteria are not published, so the table is the caller's. Confidence is
    High if every field was found, Low if none was, else Medium.
    """
    own = words(text)
    fields = list(dict.fromkeys(f for f, _, _ in rules))
    found = {}
    for field in fields:
        out = F.lit(None).cast("string")
        for _, value, held in reversed([r for r in rules if r[0] == field]):
            out = F.when(F.arrays_overlap(own, F.array(*map(F.lit, held))), value).otherwise(out)
        found[field] = out
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in found.values()), F.lit(0))
    return {f: F.coalesce(c, F.lit(default)) for f, c in found.items()} | {"confidence": F.when(n == len(fields), "High").when(n == 0, "Low").otherwise("Medium")}
