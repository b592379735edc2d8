"""Helpers for expressions over arrays of structs within a row."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def present(*columns: Column) -> Column:
    """The array of the values that are not null."""
    return F.filter(F.array(*columns), lambda x: x.isNotNull())


class Optional:
    """A member of a JSON object that is left out where the condition does not hold."""

    def __init__(self, condition: Column, value):
        self.condition, self.value = condition, value


class InOrder(dict):
    """A JSON object whose members stay in the order given."""


class Raw:
    """Text that is JSON already."""

    def __init__(self, column: Column):
        self.column = column


def json_text(value) -> Column:
    """JSON text of a column, a literal, a list or a dict of such; members stand in order of their names, nulls are kept."""
    if isinstance(value, Raw):
        return F.coalesce(value.column, F.lit("null"))
    if isinstance(value, Column):
        whole = F.to_json(F.array(value), {"ignoreNullFields": "false"})
        return F.substring(whole, F.lit(2), F.length(whole) - 2)
    if isinstance(value, dict):
        parts = []
        for name in value if isinstance(value, InOrder) else sorted(value):
            member = value[name]
            inner = member.value if isinstance(member, Optional) else member
            part = F.concat(F.lit(json.dumps(name) + ":"), json_text(inner))
            parts.append(F.when(member.condition, part) if isinstance(member, Optional) else part)
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    if isinstance(value, (list, tuple)):
        return F.concat(F.lit("["), F.concat_ws(",", *(json_text(x) for x in value)), F.lit("]"))
    return F.lit(json.dumps(value, ensure_ascii=False))
