"""Reading JSON out of replies that are not quite JSON, as column expressions.

A candidate is parsed as it is; if that fails, the commas before a closing
bracket are dropped and it is parsed again. Parsed means: it is one object and
nothing else. The second pass edits commas inside strings too; it runs only
where the first one failed, and so does the reference behaviour.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPTIONS = {"allowUnquotedControlChars": "true", "mode": "PERMISSIVE"}


def _parsed(text: Column, schema: T.StructType) -> Column:
    # As the only item of a list: then what follows the object is an error too.
    made = F.from_json(F.concat(F.lit("["), text, F.lit("]")), T.ArrayType(schema), _OPTIONS)
    return F.when(text.rlike(r"^\s*\{") & (F.size(made) == 1), F.get(made, 0))


def drop_trailing_commas(text: Column) -> Column:
    return F.regexp_replace(text, r",(\s*[}\]])", "$1")


def tolerant(text: Column, schema: T.StructType) -> Column:
    """The object in text, or null; strings may hold raw control characters, lists a comma too many."""
    return F.coalesce(_parsed(text, schema), _parsed(drop_trailing_commas(text), schema))


def brace_span(text: Column) -> Column:
    """From the first { to the last }, or null."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def outer_fence(text: Column) -> Column:
    """The inside of a reply that is one fenced block, or null."""
    found = F.regexp_extract(text, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*\z", 1)
    return F.nullif(found, F.lit(""))


def inner_fences(text: Column) -> Column:
    """Fenced objects anywhere; each reaches as far as it can, so that fences inside do not cut it."""
    return F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*(\{.*\})\s*```"), 1)


def candidates(text: Column) -> Column:
    """All that may be the object, in the order in which it is tried."""
    return F.array_compact(F.concat(F.array(outer_fence(text)), inner_fences(text), F.array(brace_span(text))))


def extract(text: Column, schema: T.StructType) -> Column:
    """The first candidate that parses, or null: then the reply is to be shown as it is."""
    whole, inner, span = outer_fence(text), F.get(inner_fences(text), 0), brace_span(text)
    return F.coalesce(*[tolerant(c, schema) for c in (whole, inner, span)])


def loose_fields(text: Column, names: list[str], chars: int) -> Column:
    """The named fields that the object in the first chars code points has; {} if it does not parse.

    The cut comes first: an object that it cuts has no fields any more.
    """
    span = brace_span(F.substring(text, 1, chars))
    found = F.from_json(span, T.MapType(T.StringType(), T.StringType()))
    return F.coalesce(F.map_filter(found, lambda k, v: k.isin(names)), F.create_map().cast("map<string,string>"))


def unwrap(text: Column) -> Column:
    """The result field of an envelope, or the text itself."""
    return F.coalesce(F.get_json_object(text, "$.result"), text)


def created_key(output: Column) -> Column:
    """The key of the last line that is an object with one, else the first thing that looks like a key."""
    lines = F.split(F.coalesce(output, F.lit("")), r"\r?\n", -1)
    keys = F.filter(F.transform(lines, lambda x: F.get_json_object(x, "$.key")), lambda k: F.coalesce(k, F.lit("")) != "")
    return F.coalesce(F.try_element_at(keys, F.lit(-1)), F.nullif(F.regexp_extract(F.coalesce(output, F.lit("")), "[A-Z][A-Z0-9]+-[0-9]+", 0), F.lit("")))
