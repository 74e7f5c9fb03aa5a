"""Filter dictionaries as boolean columns (D1-D6, filter operators of the pass-through language).

Missing and null are one. A condition on an array holds if any element meets it; `$ne`, `$nin`
and `$not` hold for missing fields. Columns come out never null, so they can be negated.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import QueryError, coerce, column_at, regex_column, type_of

_TYPES = {
    "string": T.StringType, "bool": T.BooleanType, "int": T.IntegerType, "long": T.LongType, "double": T.DoubleType,
    "date": (T.TimestampType, T.TimestampNTZType, T.DateType), "array": T.ArrayType, "object": (T.StructType, T.MapType),
    "number": T.NumericType,
}
_COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v}


def sure(condition: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(condition, F.lit(False))


def compile_filter(schema: T.StructType, query: dict[str, Any] | None) -> Column:
    """The whole filter; an empty one holds everywhere."""
    parts = []
    for key, value in (query or {}).items():
        if key in ("$and", "$or", "$nor"):
            if not isinstance(value, list) or not value:
                raise QueryError(f"{key} takes a list of filters")
            each = [compile_filter(schema, q) for q in value]
            parts.append(reduce(and_, each) if key == "$and" else reduce(or_, each) if key == "$or" else ~reduce(or_, each))
        elif key == "$expr":
            from .expressions import Expressions

            parts.append(sure(Expressions(schema).compile(value).cast("boolean")))
        elif key.startswith("$"):
            raise QueryError(f"filter operator {key}")
        else:
            parts.append(_field(column_at(schema, key), type_of(schema, key), value))
    return reduce(and_, parts) if parts else F.lit(True)


def _field(column: Column, kind: T.DataType | None, value: Any) -> Column:
    if not (isinstance(value, dict) and any(k.startswith("$") for k in value)):
        return _equal(column, kind, value)
    parts = []
    for op, v in value.items():
        if op == "$options":
            continue
        parts.append(_operator(column, kind, op, v, value.get("$options", "")))
    if not parts:
        raise QueryError("$options without $regex")
    return reduce(and_, parts)


def _any(column: Column, kind: T.DataType | None, test: Callable[[Column], Column]) -> Column:
    """`test` on the value, or on any element of an array at any depth."""
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        return sure(F.exists(column, lambda x: _any(x, inner, test)))
    return sure(test(column))


def _equal(column: Column, kind: T.DataType | None, value: Any) -> Column:
    if value is None:
        return column.isNull()
    if kind is None:
        return F.lit(False)
    value = coerce(value, kind)
    if isinstance(value, list):
        if not isinstance(kind, T.ArrayType):
            return F.lit(False)
        return sure(column == F.array(*[F.lit(v) for v in value]).cast(kind))
    if isinstance(value, dict):
        if not isinstance(kind, T.StructType):
            raise QueryError("equality with a document needs an object field")
        return reduce(and_, [_equal(column.getField(k), type_of(kind, k), v) for k, v in value.items()], F.lit(True))
    return _any(column, kind, lambda c: c == F.lit(value))


def _operator(column: Column, kind: T.DataType | None, op: str, value: Any, options: str) -> Column:
    if op == "$eq":
        return _equal(column, kind, value)
    if op == "$ne":
        return ~_equal(column, kind, value)
    if op in ("$in", "$nin"):
        if not isinstance(value, list):
            raise QueryError(f"{op} takes a list")
        plain = [v for v in coerce(value, kind) if v is not None]
        found = F.lit(False) if kind is None or not plain else _any(column, kind, lambda c: c.isin(plain))
        if None in value:
            found = found | column.isNull()
        return found if op == "$in" else ~found
    if op in _COMPARE:
        return F.lit(False) if kind is None else _any(column, kind, lambda c: _COMPARE[op](c, F.lit(coerce(value, kind))))
    if op == "$exists":
        return column.isNotNull() if value else column.isNull()
    if op == "$regex":
        return F.lit(False) if kind is None else _any(column, kind, lambda c: regex_column(c.cast("string"), value, options))
    if op == "$not":
        return ~_field(column, kind, {"$regex": value} if isinstance(value, str) else value)
    if op == "$mod":
        by, rest = value
        return F.lit(False) if kind is None else _any(column, kind, lambda c: c % F.lit(by) == F.lit(rest))
    if op == "$size":
        return sure(F.size(column) == F.lit(value)) if isinstance(kind, T.ArrayType) else F.lit(False)
    if op == "$all":
        return reduce(and_, [_equal(column, kind, v) for v in value]) if value else F.lit(False)
    if op == "$elemMatch":
        if not isinstance(kind, T.ArrayType):
            return F.lit(False)
        inner = kind.elementType
        if isinstance(inner, T.StructType) and not any(k.startswith("$") for k in value):
            return sure(F.exists(column, lambda x: reduce(and_, [
                _field(_inside(x, inner, k), type_of(inner, k), v) for k, v in value.items()])))
        return sure(F.exists(column, lambda x: _field(x, inner, value)))
    if op == "$type":
        names = value if isinstance(value, list) else [value]
        if set(names) - set(_TYPES) - {"null"}:
            raise QueryError(f"$type {value!r}")
        known = any(isinstance(kind, _TYPES[n]) for n in names if n != "null") if kind is not None else False
        held = column.isNotNull() if known else F.lit(False)
        return held | column.isNull() if "null" in names else held
    raise QueryError(f"filter operator {op}")


def _inside(column: Column, kind: T.StructType, path: str) -> Column:
    for name in path.split("."):
        if type_of(kind, name) is None:
            return F.lit(None)
        column, kind = column.getField(name), type_of(kind, name)
    return column
