"""Text functions for tickets, tests and replies, all as column expressions.

Every function takes and returns Columns (or column names) and keeps to the
JVM. Blank means: nothing but white space, in the Unicode sense.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of a request, and of what a draft may hold.
TICKET_CHARS, DETAIL_CHARS, TOTAL_CHARS = 6000, 4000, 12000
TITLE_CHARS, FOLDER_CHARS = 255, 200
DRAFT_LIMIT, JUSTIFICATION_WORDS = 5, 30
# Spellings of yes, and of this machine.
TRUTHY = ("1", "true", "yes", "on")
LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end (trim() only takes blanks)."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+\z", "")


def is_blank(c: Column | str) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def first_filled(*cs: Column | str) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in cs], F.lit(""))


def is_issue_key(c: Column | str) -> Column:
    """A letter, more letters or digits, a hyphen, digits; nothing else, no line end after it. Null is no key."""
    return F.coalesce(_col(c).rlike(r"^[A-Za-z][A-Za-z0-9]+-[0-9]+\z"), F.lit(False))


def cap(c: Column | str, n: int) -> Column:
    """The first n code points."""
    return F.substring(_col(c), 1, n)


def request_text(key: Column | str, raw: Column | str, detail: Column | str) -> Column:
    """The parts of a request, each cut to its own limit before they are put together."""
    parts = F.array_compact(F.array(
        F.when(~is_blank(key), F.concat(F.lit("Ticket: "), F.upper(strip(key)))),
        F.when(~is_blank(key), F.concat(F.lit("Ticket data:\n"), F.coalesce(cap(raw, TICKET_CHARS), F.lit("")))),
        F.when(~is_blank(detail), F.concat(F.lit("Details:\n"), cap(detail, DETAIL_CHARS))),
    ))
    return cap(strip(F.array_join(parts, "\n\n")), TOTAL_CHARS)


def priority_flag(c: Column | str) -> Column:
    """P1 to P4 in capitals, or null: then the flag is left out."""
    p = F.upper(strip(c))
    return F.when(p.rlike(r"^P[1-4]\z"), p)


def priority_class(c: Column | str) -> Column:
    p = F.upper(_col(c))
    return F.when(p.rlike(r"^P[1-4]\z"), F.lower(p)).otherwise("muted")


def verdict_class(c: Column | str) -> Column:
    v = F.lower(_col(c))
    return F.when(v == "covered", "ok").when(v == "partial", "warn").when(v == "gap", "bad").otherwise("info")


def allow_listed(c: Column | str, names: list[str]) -> Column:
    """The value if it is one of names, in that very case, else the empty string."""
    s = strip(c)
    return F.when(s.isin(names), s).otherwise("")


def is_truthy(c: Column | str) -> Column:
    return F.coalesce(F.lower(_col(c)).isin(*TRUTHY), F.lit(False))


def is_strictly_true(c: Column | str) -> Column:
    return _col(c).eqNullSafe(F.lit(True))


def is_local_host(c: Column | str) -> Column:
    """What stands before the last colon, without brackets, names this machine; a bare [::1] does not pass."""
    host = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r":[^:]*\z", "")
    return F.lower(F.regexp_replace(host, r"^[\[\]]+|[\[\]]+\z", "")).isin(*LOCAL_HOSTS)


def browse_url(base: str, key: Column | str, url: Column | str) -> Column:
    """url, or where there is none but a key, the address made from it."""
    made = F.concat(F.lit(base), strip(F.col(key).cast("string") if isinstance(key, str) else key))
    return F.when((F.coalesce(_col(key), F.lit("")) != "") & (F.coalesce(_col(url), F.lit("")) == ""), made).otherwise(_col(url))


def comment_url(base: str, key: Column | str, comment: Column | str) -> Column:
    return F.concat(F.lit(base), _col(key), F.when(F.coalesce(_col(comment), F.lit("")) != "", F.concat(F.lit("?focusedCommentId="), _col(comment))).otherwise(""))


def html_escape(c: Column | str) -> Column:
    out = F.coalesce(_col(c).cast("string"), F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def safe_url(c: Column | str) -> Column:
    """The address if it is one of http or https, else #."""
    return F.when(F.coalesce(_col(c).rlike(r"(?i)^https?://[^\s/?#]"), F.lit(False)), _col(c)).otherwise("#")


def as_array(c: Column | str) -> Column:
    """A scalar as a list of one; null and the empty string as the empty list."""
    return F.when(F.coalesce(_col(c), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(_col(c)))


def filled_items(items: Column | str) -> Column:
    """The items that are not null or blank, stripped."""
    return F.transform(F.filter(_col(items), lambda x: ~is_blank(x)), strip)


def strip_step_number(c: Column | str) -> Column:
    """A step as a screen shows it: without its leading number, blanks before the point allowed."""
    return F.regexp_replace(_col(c), r"^\s*[0-9]+\s*[.)]\s*", "")


def number_steps(steps: Column | str) -> Column:
    """1. 2. 3. in front of the steps that are not null; one that has a number keeps it, the count goes on."""
    return F.transform(F.filter(_col(steps), lambda s: s.isNotNull()), lambda s, i: F.when(s.rlike(r"^\s*[0-9]+[.)]"), s).otherwise(F.concat((i + 1).cast("string"), F.lit(". "), s)))


def numbered_step_count(steps: Column | str) -> Column:
    """How many steps break the rule that a drafted step has no number of its own."""
    return F.size(F.filter(_col(steps), lambda s: s.rlike(r"^\s*[0-9]+\s*[.)]")))


def bullets(c: Column | str) -> Column:
    """The lines of a text without their bullet marks; of a single line, its parts between semicolons."""
    text = F.coalesce(_col(c), F.lit(""))
    lines = F.filter(F.transform(F.split(text, r"\r?\n+", -1), lambda x: F.regexp_replace(strip(x), r"^[-*•]\s*", "")), lambda x: x != "")
    parts = F.filter(F.transform(F.split(text, r"\s*;\s+", -1), strip), lambda x: x != "")
    return F.when(F.size(lines) <= 1, parts).otherwise(lines)


def step_text(step: Column) -> Column:
    """A step of the parts action, data and result as one line."""
    parts = F.filter(F.array(step["action"], step["data"], step["result"]), lambda p: F.coalesce(p, F.lit("")) != "")
    return F.when(F.size(parts) > 0, F.array_join(parts, " — ")).otherwise(F.to_json(step))


def leading_tag(c: Column | str) -> Column:
    """What stands in [ ] at the start of a summary, else the empty string."""
    return F.regexp_extract(_col(c), r"^\[([^\]]+)\]", 1)


def path_parts(c: Column | str) -> Column:
    """The parts of a summary of the form A > B > C."""
    return F.split(_col(c), r"\s*>\s*", -1)


def alias_key(c: Column | str) -> Column:
    """What names are compared by: lower case, single blanks, none at the ends. Misspellings are aliases of their own."""
    return F.lower(strip(F.regexp_replace(_col(c), r"(?U)\s+", " ")))


def word_count(c: Column | str) -> Column:
    s = F.coalesce(strip(c), F.lit(""))
    return F.when(s == "", 0).otherwise(F.size(F.split(s, r"(?U)\s+", -1)))


def plural(n: Column | str, one: str, many: str | None = None) -> Column:
    return F.concat(_col(n).cast("string"), F.lit(" "), F.when(_col(n) == 1, one).otherwise(many or f"{one}s"))


def elapsed_seconds(ms: Column | str) -> Column:
    return F.floor(_col(ms) / 1000 + F.lit(0.5)).cast("bigint")


def display_name(c: Column | str, names: dict[str, str]) -> Column:
    """The friendly name of an internal value; a value without one is kept and marked."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(known, _col(c)), F.concat(F.lit("[?] "), _col(c)))


def or_none(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit("[None]"))


def tokens(c: Column | str) -> Column:
    """The distinct runs of a-z and 0-9 of the lower-cased text."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(_col(c), F.lit(""))), "[^a-z0-9]+", -1), lambda t: t != ""))


def words(c: Column | str) -> Column:
    """The runs of letters and digits of the lower-cased text, in order."""
    return F.filter(F.split(F.lower(F.coalesce(_col(c), F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda t: t != "")


def range_ends(c: Column | str) -> tuple[Column, Column]:
    """The two ends of yyyy-mm-dd..yyyy-mm-dd as dates; null for what is no date."""
    halves = F.split(_col(c), r"\.\.", -1)
    return F.try_to_date(F.get(halves, 0), "yyyy-MM-dd"), F.try_to_date(F.get(halves, 1), "yyyy-MM-dd")


def is_bad_range(c: Column | str) -> Column:
    start, end = range_ends(c)
    return _col(c).isNotNull() & (start.isNull() | end.isNull() | (end < start))


def response_status(host: Column, path: Column, routes: list[str], busy: Column, body_status: Column) -> Column:
    """What a request is answered with, checks in order: foreign host 403, unknown route 404, bad body, busy 429."""
    return F.when(~is_local_host(host), 403).when(~F.coalesce(path.isin(routes), F.lit(False)), 404).when(body_status != 200, body_status).when(busy, 429).otherwise(200)


def phase_state(position: Column, active: Column) -> Column:
    """Where a phase stands: done before the active one, now at it, else to come."""
    return F.when(position < active, "done").when(position == active, "now").otherwise("")


def is_raw_fallback(raw: Column, team: Column) -> Column:
    """A reply that could not be read: its text is there, an owner is not."""
    return (F.coalesce(raw, F.lit("")) != "") & (F.coalesce(team, F.lit("")) == "")


def health_text(ready: Column, missing: Column) -> Column:
    """The status line: ready, or which settings are missing."""
    return F.when(ready, "ready").otherwise(F.concat(F.lit("missing: "), F.coalesce(missing, F.lit("?"))))


def pick_binary(named: Column, on_path: Column, found: Column) -> Column:
    """The named program if there is one, else the one on the path, else the last of those found, as text sorts."""
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(on_path, F.lit("")), F.array_max(found))
