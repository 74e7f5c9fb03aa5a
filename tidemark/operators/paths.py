"""Field paths against a schema, and literals coerced to what they are compared with."""

from __future__ import annotations

import re
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE_FORMAT = "%Y-%m-%d %H:%M:%S"


class QueryError(ValueError):
    """A dictionary that isn't understood; unsupported keys are never ignored."""


def type_of(schema: T.DataType, path: str) -> T.DataType | None:
    """Type at a dotted path; through arrays, an array of what lies below. None if there is no such field."""
    here: T.DataType = schema
    depth = 0
    for name in path.split("."):
        while isinstance(here, T.ArrayType):
            here, depth = here.elementType, depth + 1
        if isinstance(here, T.MapType):
            here = here.valueType
        elif isinstance(here, T.StructType):
            field = next((f for f in here.fields if f.name == name), None)
            if field is None:
                return None
            here = field.dataType
        else:
            return None
    for _ in range(depth):
        here = T.ArrayType(here)
    return here


def quoted(path: str) -> str:
    return ".".join(f"`{p}`" for p in path.split("."))


def column_at(schema: T.DataType, path: str) -> Column:
    """The column at a path; null where there is no such field, elements lacking it left out."""
    kind = type_of(schema, path)
    if kind is None:
        return F.lit(None)
    first, *rest = path.split(".")
    column, here = F.col(f"`{first}`"), type_of(schema, first)
    for name in rest:
        column, here = _step(column, here, name)
    return column


def _step(column: Column, here: T.DataType, name: str) -> tuple[Column, T.DataType]:
    if isinstance(here, T.ArrayType):
        below = _step(F.lit(None), here.elementType, name)[1]
        inner = here.elementType
        return F.array_compact(F.transform(column, lambda x: _step(x, inner, name)[0])), T.ArrayType(below)
    if isinstance(here, T.MapType):
        return F.try_element_at(column, F.lit(name)), here.valueType
    field = next(f for f in here.fields if f.name == name)
    return column.getField(name), field.dataType


def parse_date(text: str) -> datetime | None:
    try:
        return datetime.strptime(text, DATE_FORMAT).replace(tzinfo=timezone.utc)
    except ValueError:
        return None


def to_utc(value: Any) -> datetime | None:
    """Naive means UTC; anything but a datetime is null."""
    if not isinstance(value, datetime):
        return None
    return value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value.astimezone(timezone.utc)


def elapsed_days(start: datetime, end: datetime) -> float:
    return (to_utc(end) - to_utc(start)).total_seconds() / 86400


def coerce(value: Any, kind: T.DataType | None) -> Any:
    """A literal for a field of this type: date strings and datetimes for time columns; lists and
    dictionaries throughout, those inside lists too."""
    if isinstance(value, dict):
        return {k: coerce(v, kind) for k, v in value.items()}
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    if isinstance(value, (list, tuple)):
        return [coerce(v, kind) for v in value]
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        if isinstance(value, str):
            value = parse_date(value) or value
        value = to_utc(value) or value
        if isinstance(value, datetime) and isinstance(kind, T.TimestampNTZType):
            return value.replace(tzinfo=None)
        if isinstance(value, datetime) and isinstance(kind, T.DateType):
            return value.date()
    return value


def normalised_regex(needle: str) -> dict[str, str]:
    """Case-insensitive, unanchored, blank-insensitive search for a text."""
    return {"$regex": r"\s*".join(re.escape(c) for c in re.sub(r"\s", "", needle)), "$options": "i"}


def regex_column(column: Column, pattern: str, options: str = "") -> Column:
    if set(options) - set("imsx"):
        raise QueryError(f"regex options {options!r}")
    flags = "".join(dict.fromkeys(options.replace("i", "iu")))
    return column.rlike(f"(?{flags}){pattern}" if flags else pattern)
