"""URL rules found by their rarest literal token.

Two kinds of rules share one index. A host rule names a host and a path prefix:
it fits the host and all its subdomains, if the path starts with the prefix. A
pattern rule is a regular expression over host and path together with the
literal tokens that every match must hold. Each rule is filed under one of its
tokens, the one that the fewest URLs of the table hold; a URL's tokens fetch
the rules filed under them, and only those run their regular expressions.

Of the host rules that fit, the longest decides; without one, the pattern rules
do (any that fits blocks); without any, the URL is allowed.

The rules are the caller's list. They are sent to the executors in blocks of
bounded size, one pass for each block; what a pass found is written before the
next one begins, so no more than one block is held.

Defined results: a null URL or one without `://` has an empty host and path and
fits no rule; A-Z in hosts count as a-z, paths keep their case; repeated rows
give repeated results; extra columns pass through, except those named like a
result column; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import durable, extended, replacing, tidy

#: Characters of rules that one pass sends to the executors.
BLOCK_CHARS = 16 << 20
TOKEN = r"[a-z0-9]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Words that, joined by a hyphen, make labels of hosts that sell or spam.
SPAM_FIRST = "adult best bulk buy cheap crypto diet discount fast fat free fresh hot instant lucky mega online spam super win"
SPAM_SECOND = "bet bonus casino cash coins deals farm followers gifts loans lottery meds offers pills poker prize replica slots videos watches"


@dataclass(frozen=True)
class Rule:
    """pattern is matched from the start of `host` + `path`; tokens are literals each match holds whole."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    length: int  # of a host rule, which decides by length; 0 for a pattern rule


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """The rule for a host, its subdomains, and the paths that start with path."""
    host = host.translate(LOWER)
    # A prefix's last token may go on in the URL; only tokens that end within the prefix are sure.
    sure = re.findall(TOKEN, host) + re.findall(rf"{TOKEN}(?=[^A-Za-z0-9])", path.lower())
    return Rule(host + path, verdict, rf"(?:[^/?#]*\.)?{re.escape(host)}(?![^/]){re.escape(path)}", tuple(dict.fromkeys(sure)), len(host) + len(path))


def pattern_rule(name: str, pattern: str, tokens: Iterable[str]) -> Rule:
    """A rule that blocks what pattern fits; all of tokens occur whole in each match."""
    return Rule(name, "block", pattern, tuple(tokens), 0)


def default_patterns() -> list[Rule]:
    """A rule for each pair of a first and a second word: it blocks hosts one of whose labels, not the last, is just the two joined by a hyphen."""
    return [pattern_rule(f"{a} {b}", rf"(?:[^/?#]*\.)?{a}-{b}\.", (a, b)) for a in SPAM_FIRST.split() for b in SPAM_SECOND.split()]


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, both empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit(""))


def token_counts(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens stands (a table no longer than the rules)."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit(f"({TOKEN})"), 1))
    wanted = urls.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    held = urls.select(F.explode(found).alias("token")).join(wanted, "token", "left_semi")
    return {r["token"]: r["count"] for r in held.groupBy("token").count().collect()}


def filed(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """The index: each rule under its rarest token; rules without a token under the empty one, which every URL asks for."""
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(r)
    return index


def _blocks(index: dict[str, list[Rule]]):
    block: dict[str, list[Rule]] = {}
    size = 0
    for token, rules in index.items():
        for r in rules:
            block.setdefault(token, []).append(r)
            size += len(r.pattern) + len(r.name) + 64
            if size > BLOCK_CHARS:
                yield block
                block, size = {}, 0
    if block:
        yield block


def judge(df: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """df with host, path, rule (the host rule that decides, else null), pattern (the pattern rule, else null) and verdict."""
    out = replacing(df, ["host", "path", "rule", "pattern", "verdict"])
    host, path = parts(F.col(url).cast("string"))
    out = out.withColumns({"host": host, "path": path})
    index = filed(rules, token_counts(out, sorted({t for r in rules for t in r.tokens})))
    out = out.withColumns({"__rule": F.lit(None).cast("string"), "__length": F.lit(-1), "__verdict": F.lit(None).cast("string"), "__pattern": F.lit(None).cast("string")})
    for nth, block in enumerate(_blocks(index)):
        out = _pass(durable(out, "url-rules") if nth else out, block)
    verdict = F.coalesce("__verdict", F.when(F.col("__pattern").isNotNull(), "block"), F.lit("allow"))
    made = out.select(*[c for c in out.columns if not c.startswith("__")], F.col("__rule").alias("rule"), F.col("__pattern").alias("pattern"), verdict.alias("verdict"))
    return made


def _pass(df: DataFrame, block: dict[str, list[Rule]]) -> DataFrame:
    """One pass over the URLs with the rules of one block; a longer host rule replaces what earlier passes found."""
    sent = df.sparkSession.sparkContext.broadcast(json.dumps({t: [[r.name, r.verdict, r.pattern, r.length] for r in rs] for t, rs in block.items()}))
    schema = extended(df)
    h, p = df.columns.index("host"), df.columns.index("path")
    own = [df.columns.index(c) for c in ("__rule", "__length", "__verdict", "__pattern")]

    @tidy
    def run(batches):
        index = {t: [(n, v, re.compile(x), k) for n, v, x, k in rs] for t, rs in json.loads(sent.value).items()}
        always, token = index.get("", []), re.compile(TOKEN)
        for batch in batches:
            found = []
            for host, path, *best in zip(*(batch.column(i).to_pylist() for i in (h, p, *own)), strict=True):
                text = host + path
                for t in {*token.findall(text.lower()), ""}:
                    for name, verdict, pattern, length in index.get(t, ()) if t else always:
                        if length:
                            if (length, name) > (best[1], best[0] or "") and host and pattern.match(text):
                                best[:3] = name, length, verdict
                        elif host and (best[3] is None or name < best[3]) and pattern.match(text):
                            best[3] = name
                found.append(best)
            columns = list(batch.columns)
            for i, values in zip(own, zip(*found, strict=True) if found else [[]] * 4, strict=True):
                columns[i] = pa.array(list(values), columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.mapInArrow(run, schema)


def contract_rules() -> list[Rule]:
    # The rules that the query is asked for.
    given = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    return [host_rule(*g) for g in given]
