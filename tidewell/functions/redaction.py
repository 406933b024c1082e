"""STR-18: nested payloads of error logs without what must not be kept.  All are built-in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.columns import once
from tidewell.functions.text import is_private_key, redact

#: Levels of nesting that are kept, members of an array that are, and bytes of a payload.
DEPTH, MEMBERS, BYTES, PREVIEW = 4, 20, 8000, 1000


def _quoted(c: Column) -> Column:
    """A text as JSON."""
    return once(F.to_json(F.array(c)), lambda array: F.substring(array, F.lit(2), F.length(array) - 2))


def _redacted(c: Column) -> Column:
    """A text as JSON, redacted."""
    return _quoted(once(c, redact))


def _walked(v: Column, depth: int) -> Column:
    """The JSON of a variant at a depth: fields in order of their names."""
    if depth == DEPTH:
        return F.when(F.is_variant_null(v), "null").otherwise('"[redacted:depth]"')
    joined = lambda parts, a, b: F.concat(F.lit(a), F.array_join(parts, ","), F.lit(b))

    def listed(members):
        more = F.size(members) - MEMBERS
        rest = F.when(more > 0, F.array(F.concat(F.lit('"…외 '), more.cast("string"), F.lit('개"')))).otherwise(F.array().cast("array<string>"))
        return joined(F.concat(F.transform(F.slice(members, 1, MEMBERS), lambda m: _walked(m, depth + 1)), rest), "[", "]")

    def told(json):
        # What a variant is can be told by its JSON's first character, so nothing is read as what it is not
        members, fields = F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$", "map<string,variant>")
        named = F.transform(F.map_entries(fields), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), F.when(is_private_key(e["key"]), '"[redacted]"').otherwise(_walked(e["value"], depth + 1))))
        first = F.substring(json, 1, 1)
        return F.when(json.isNull(), "null").when(first == "[", once(members, listed)).when(first == "{", joined(named, "{", "}")).when(first == '"', _redacted(F.try_variant_get(v, "$", "string"))).otherwise(json)

    return once(F.to_json(v), told)


def redact_json(c: Column) -> Column:
    """A payload (JSON) in which private fields are replaced whole, texts by what they contain, and what lies deeper than DEPTH
    levels or beyond MEMBERS members of an array is only told of; null stays null, and what is no JSON counts as a text."""
    walked = lambda payload: once(F.try_parse_json(payload), lambda v: F.when(v.isNull(), _redacted(payload)).otherwise(_walked(v, 0)))
    return F.when(c.isNotNull(), once(c, walked))


def capped(payload: Column) -> Column:
    """A payload of over BYTES bytes (UTF-8) is replaced by a note of its size and its first PREVIEW characters."""
    n = F.octet_length(payload)
    note = F.concat(F.lit('{"_truncated":true,"_bytes":'), n.cast("string"), F.lit(',"preview":'), _quoted(F.substring(payload, 1, PREVIEW)), F.lit("}"))
    return F.when(n > BYTES, note).otherwise(payload)
