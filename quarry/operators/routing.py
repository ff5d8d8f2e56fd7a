"""Routing tickets to owners: aliases, the waterfall of two maps, eligibility, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import alias_key, words

UNRESOLVED = "Unresolved — needs manual routing"
RETIRED = "N/A (deprecated)"
DEPRECATED = "deprecated"
#: Characters of aliases up to which they are sent to every task; they are counted first.
SENT = 4 << 20


def expand_aliases(owners: DataFrame, name: str, aliases: str = "aliases") -> DataFrame:
    """One row for each name and alias: alias (normalised), name, team."""
    every = F.concat(F.array(F.col(name)), F.coalesce(F.col(aliases), F.array().cast("array<string>")))
    return owners.select(F.explode(F.array_distinct(F.filter(F.transform(every, alias_key), lambda a: a != ""))).alias("alias"), F.col(name).alias("name"), "team")


def phrases(text: Column | str, longest: int) -> Column:
    """The distinct runs of 1 to `longest` words of a text, joined by blanks."""

    def every(t: Column) -> Column:
        runs = [t]
        for n in range(2, longest + 1):  # the runs that are a word shorter, each with the word behind it
            many = F.greatest(F.size(t) - n + 1, F.lit(0))
            runs.append(F.zip_with(F.slice(runs[-1], 1, many), F.slice(t, n, many), lambda a, b: F.concat(a, F.lit(" "), b)))
        return F.array_distinct(F.concat(*runs))

    return F.transform(F.array(words(text)), every)[0]


def match_text(tickets: DataFrame, aliases: DataFrame, text: str = "description", kinds: tuple[str, ...] = ()) -> DataFrame:
    """ticket_id, alias, name and team of the best alias that each ticket's text contains as whole words.

    The longest alias wins, then the alias, then the team. An equi-join: a
    text's phrases of as many words as an alias has (a number that is looked
    up first) meet the aliases; an alias without a letter or digit never fits.
    With kinds, aliases carry a column kind and one pass finds the best of
    each, as columns <kind>_alias, <kind>_name and <kind>_team.
    """
    filed = aliases.withColumn("phrase", F.array_join(words("alias"), " ")).where("phrase <> ''")
    longest, chars = filed.agg(F.max(F.size(F.split("phrase", " "))), F.sum(F.length("phrase") + 64)).first()
    if (chars or 0) <= SENT:  # else both sides move
        filed = F.broadcast(filed)
    hits = tickets.select("ticket_id", F.explode(phrases(text, longest or 1)).alias("phrase")).join(filed, "phrase")
    rank = F.struct((-F.length("alias")).alias("__n"), "alias", "team", "name")
    if not kinds:
        return hits.groupBy("ticket_id").agg(F.min(rank).alias("__best")).select("ticket_id", "__best.alias", "__best.name", "__best.team")
    best = hits.groupBy("ticket_id").agg(*[F.min(F.when(F.col("kind") == k, rank)).alias(f"__{k}") for k in kinds])
    return best.select("ticket_id", *[F.col(f"__{k}.{c}").alias(f"{k}_{c}") for k in kinds for c in ("alias", "name", "team")])


def route(tickets: DataFrame, objects: DataFrame, areas: DataFrame, eligible: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """ticket_id, team, code_rca_eligible, match_basis: the object map first, then the area map, then (given one) the source map, else unresolved.

    A deprecated owner is none: such tickets are reported as retired, not passed on.
    """
    maps = objects.withColumn("kind", F.lit("a")).unionByName(areas.withColumn("kind", F.lit("b")))
    out = tickets.select("ticket_id", *(["source"] if fallback is not None else [])).join(match_text(tickets, maps, kinds=("a", "b")), "ticket_id", "left")
    out = out.join(fallback.select("source", F.col("team").alias("c_team")), "source", "left") if fallback is not None else out.withColumn("c_team", F.lit(None).cast("string"))
    found = F.coalesce("a_team", "b_team", "c_team")
    basis = F.when(F.col("a_team") == DEPRECATED, "deprecated").when(F.col("a_team").isNotNull(), "object").when(F.col("b_team").isNotNull(), "area").when(F.col("c_team").isNotNull(), "source").otherwise("none")
    team = F.when(found == DEPRECATED, RETIRED).otherwise(F.coalesce(found, F.lit(UNRESOLVED)))
    out = out.select("ticket_id", team.alias("team"), basis.alias("match_basis"))
    return out.join(eligible.select("team", F.lit(True).alias("__e")).distinct(), "team", "left").select("ticket_id", "team", F.coalesce("__e", F.lit(False)).alias("code_rca_eligible"), "match_basis")


def with_overrides(base: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """base where no override has the key, and all overrides: a new base never undoes them."""
    return base.join(overrides.select(key), key, "left_anti").unionByName(overrides)
