"""JSON objects in noisy answers: the first balanced one, and its fields by a strict type contract."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _pairs(text: str, start: int) -> tuple[list[tuple[int, int]], int]:
    """Balanced (open, close) places from a first brace on, and the first brace inside a string, or -1. Quotes count inside
    braces alone, and an escaped one does not end a string."""
    found, opens, quoted, escaped, hidden = [], [], False, False, -1
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
            elif c == "{" and hidden < 0:
                hidden = i
        elif c == "{":
            opens.append(i)
        elif opens and c == '"':
            quoted = True
        elif opens and c == "}":
            found.append((opens.pop(), i))
    return sorted(found), hidden


def first_object(text: str | None) -> str | None:
    """The first text between balanced braces that is a JSON object; null if there is none.

    One scan finds all balanced places; a second one begins inside the first string with a brace, for an answer whose
    opening quote is a stray one. So the time is linear in the text, but for braces that balance without being JSON.
    """
    if not text or (start := text.find("{")) < 0:
        return None
    for _ in range(2):
        places, hidden = _pairs(text, start)
        for a, b in places:
            try:
                if isinstance(json.loads(text[a : b + 1]), dict):
                    return text[a : b + 1]
            except (ValueError, RecursionError):
                continue
        if hidden < 0:
            return None
        start = hidden
    return None


@F.pandas_udf(StringType())
def first_json(texts: pd.Series) -> pd.Series:
    return texts.map(first_object, na_action="ignore").astype(object).where(texts.notna(), None)


def strict(json_text: Column, fields: dict[str, str]) -> Column:
    """A struct of the fields with exactly the stated type each (boolean, string, long, double or array<string>); a field of
    another type, such as "true" for a boolean or 1 for it, is null, and so is one that is missing."""
    patterns = {"boolean": r"^(true|false)$", "string": r'(?s)^".*"$', "long": r"^-?[0-9]+$", "double": r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$", "array<string>": r'(?s)^\[\s*("(?:[^"\\]|\\.)*"\s*(,\s*"(?:[^"\\]|\\.)*"\s*)*)?\]$'}
    # a variant keeps each value's own type, and its JSON tells a string from all else
    whole = F.try_parse_json(json_text)
    column = []
    for name, kind in fields.items():
        raw = F.trim(F.to_json(F.try_variant_get(whole, f"$.{name}", "variant")))
        value = F.try_variant_get(whole, f"$.{name}", kind)
        column.append(F.when(raw.rlike(patterns[kind]), value).alias(name))
    return F.struct(*column)
