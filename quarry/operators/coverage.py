"""Test coverage: shortlists by shared words, alignment, verdicts, gaps, folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import alias_key, tokens

#: Jaccard similarity of distinct words from which a test counts as aligned, or as partly so.
ALIGNED, PARTIAL = 0.5, 0.2


def shortlist(tickets: DataFrame, tests: DataFrame, least: tuple[int, int] = (1, 5)) -> DataFrame:
    """ticket_id, test_id, shared, similarity of the pairs whose Jaccard similarity of distinct words is at least least[0] / least[1].

    Words are ordered by how many tests hold them, those of no test first. Two
    sets that are similar enough share one of the first n - ceil(t n) + 1 words of
    each in that order, so only those meet, in an equi-join; pairs whose sizes
    are too far apart go at once, and the rest are counted over all their words.
    """
    top, bottom = least
    kept = lambda n: n - F.ceil(n * top / bottom) + 1
    held = tests.select("test_id", tokens("summary").alias("t")).select("test_id", F.size("t").alias("b"), F.explode("t").alias("token"))
    df = held.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"])
    right = held.join(df, "token").groupBy("test_id", "b").agg(ordered.alias("y"))
    told = tickets.select("ticket_id", tokens("description").alias("t")).select("ticket_id", F.size("t").alias("a"), F.explode("t").alias("token"))
    # Only words of some test can be shared; those of none stand first in the order and use up a ticket's prefix.
    left = told.join(df, "token").groupBy("ticket_id", "a").agg(ordered.alias("x")).where(F.size("x") * bottom >= F.col("a") * top)
    prefix = F.greatest(kept(F.col("a")).cast("int") - (F.col("a") - F.size("x")), F.lit(0))
    near = (F.col("a") * bottom >= F.col("b") * top) & (F.col("b") * bottom >= F.col("a") * top)
    some = left.select("ticket_id", "a", F.explode(F.slice("x", 1, prefix)).alias("token")).join(right.select("test_id", "b", F.explode(F.slice("y", 1, kept(F.col("b")).cast("int"))).alias("token")), "token")
    pairs = some.where(near).select("ticket_id", "a", "test_id", "b").distinct().join(left, ["ticket_id", "a"]).join(right, ["test_id", "b"])
    pairs = pairs.select("ticket_id", "test_id", F.size(F.array_intersect("x", "y")).cast("bigint").alias("shared"), (F.col("a") + F.col("b")).alias("__n"))
    return pairs.where(F.col("shared") * bottom >= (F.col("__n") - F.col("shared")) * top).select("ticket_id", "test_id", "shared", (F.col("shared") / (F.col("__n") - F.col("shared"))).alias("similarity"))


def folders_of(named: DataFrame, folders: DataFrame, name: str = "name") -> DataFrame:
    """named with folder_path: the catalogue folder of each row's object, by the name as alias_key() compares it; null without one."""
    map_ = folders.select(alias_key("widget").alias("__key"), "folder_path").groupBy("__key").agg(F.min("folder_path").alias("folder_path"))
    return named.join(map_, alias_key(name) == F.col("__key"), "left").drop("__key")


def untested(objects: DataFrame, tests: DataFrame) -> DataFrame:
    """The objects (with folder_path) whose folder and all below it hold no test: gaps of the catalogue."""
    return objects.join(recursive_counts(tests), F.col("folder_path") == F.col("folder"), "left_anti")


def alignment(similarity: Column | str) -> Column:
    s = F.col(similarity) if isinstance(similarity, str) else similarity
    return F.when(s >= ALIGNED, "aligned").when(s >= PARTIAL, "partial").otherwise("not-aligned")


def verdicts(tickets: DataFrame, pairs: DataFrame, has_folder: Column) -> DataFrame:
    """ticket_id, verdict: any aligned test covers; else any partial one; else a known folder means a gap; else unknown."""
    best = pairs.groupBy("ticket_id").agg(F.max("similarity").alias("best"))
    verdict = F.when(F.col("best") >= ALIGNED, "Covered").when(F.col("best") >= PARTIAL, "Partial").when(has_folder, "Gap").otherwise("Unknown")
    return tickets.join(best, "ticket_id", "left").select("ticket_id", verdict.alias("verdict"))


def prefixes(path: Column | str) -> Column:
    """All folders that a path lies in, itself included: /a, /a/b, /a/b/c."""
    c = F.col(path) if isinstance(path, str) else path
    parts = F.filter(F.split(c, "/", -1), lambda p: p != "")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))


def recursive_counts(tests: DataFrame, path: str = "folder_path") -> DataFrame:
    """folder, n_tests: every folder with the tests below it, however deep."""
    rows = tests.where(F.col(path).rlike("[^/]")).select(F.explode(prefixes(path)).alias("folder"))
    return rows.groupBy("folder").agg(F.count(F.lit(1)).alias("n_tests"))


def suites(folders: DataFrame, suite_map: DataFrame) -> DataFrame:
    """folder_path, suite: the suite with the longest prefix that fits. Paths are cut to the lengths that prefixes have (looked up first) and met with them."""
    lengths = [r[0] for r in suite_map.select(F.length("folder_prefix")).distinct().collect()]
    cuts = F.array_compact(F.array(*[F.when(F.length("folder_path") >= n, F.substring("folder_path", 1, n)) for n in lengths])).cast("array<string>")
    hit = folders.select("folder_path", F.explode(cuts).alias("folder_prefix")).join(suite_map, "folder_prefix")
    best = hit.groupBy("folder_path").agg(F.max_by("suite", F.struct(F.length("folder_prefix"), "suite")).alias("suite"))
    return folders.select("folder_path").distinct().join(best, "folder_path", "left")


def declared_gaps(folders: DataFrame, tests: DataFrame) -> DataFrame:
    """folder_path, declared, listed, mismatch: fewer listed than declared is none where the list is cut."""
    listed = tests.groupBy("folder_path").agg(F.count(F.lit(1)).alias("listed"))
    out = folders.join(listed, "folder_path", "left").withColumn("listed", F.coalesce("listed", F.lit(0)))
    return out.select("folder_path", F.col("test_count").alias("declared"), "listed", ((F.col("listed") > F.col("test_count")) | ((F.col("listed") < F.col("test_count")) & ~F.col("truncated"))).alias("mismatch"))
