"""Expressions over payloads: JSON text, or bare text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}


def json_scalar(payload: Column) -> Column:
    """The payload read as one JSON value, as text: strings unescaped, others as JSON; null if it is no JSON."""
    one = F.from_json(F.concat(F.lit("["), payload, F.lit("]")), "array<string>", _STRICT)
    return F.when(F.size(one) == 1, F.element_at(one, 1))


def json_fields(payload: Column) -> Column:
    """Fields of a JSON object as map<string,string> (strings unescaped, nested values as JSON); null if it is no object."""
    return F.when(payload.rlike(r"^\s*\{"), F.from_json(payload, "map<string,string>", _STRICT))


def decoded_text(payload: Column) -> Column:
    """The JSON string, or the object's ``content`` field; a payload that is no JSON is its own decoded text.

    Null stays null; an object without content decodes to null.
    """
    fields = json_fields(payload)
    quoted = payload.rlike(r'^\s*"')
    return (
        F.when(fields.isNotNull(), F.element_at(fields, "content"))
        .when(quoted, F.coalesce(json_scalar(payload), payload))
        .otherwise(payload)
    )


def letters_digits(text: Column) -> Column:
    """Only the letters and digits of a text, letter case folded; accents are kept, in composed form or not alike."""
    folded = F.lower(F.upper(text))
    return F.regexp_replace(folded, r"[^\p{L}\p{N}]+", "")
