"""``{{ column }}`` templates, compiled once to a Catalyst expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import col, text_of

_SLOT = re.compile(r"\{\{\s*([^{}]+?)\s*\}\}")


def variables(template: str) -> list[str]:
    """The distinct column names that a template refers to, sorted."""
    return sorted(set(_SLOT.findall(template)))


def variables_of(c: Column) -> Column:
    """The same for a column of templates."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(_SLOT.pattern), F.lit(1))))


def render(template: str, schema: T.StructType) -> Column:
    """The template filled from a row; a missing column or a null gives an empty text.

    Filled-in values aren't looked at again, so braces in data stay as they are.
    """
    kinds = {f.name: f.dataType for f in schema.fields}
    parts: list[Column] = []
    at = 0
    for m in _SLOT.finditer(template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        if m[1] in kinds:
            parts.append(text_of(col(m[1]), kinds[m[1]], ""))
        at = m.end()
    if at < len(template) or not parts:
        parts.append(F.lit(template[at:]))
    return F.concat(*parts)
