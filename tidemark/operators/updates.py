"""Update dictionaries as new column values."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import QueryError, coerce, column_at, type_of


def literal(value: Any, kind: T.DataType | None) -> Column:
    """A literal of any nesting, as the field's type where there is one."""
    value = coerce(value, kind)
    if isinstance(value, dict):
        of = (lambda k: type_of(kind, k)) if isinstance(kind, T.StructType) else (lambda k: None)
        made = F.struct(*[literal(v, of(k)).alias(k) for k, v in value.items()])
    elif isinstance(value, list):
        inner = kind.elementType if isinstance(kind, T.ArrayType) else None
        made = F.array(*[literal(v, inner) for v in value])
    else:
        made = F.lit(value)
    return made.cast(kind) if kind is not None and not isinstance(kind, T.StructType) else made


def assignments(df: DataFrame, update: dict[str, Any], inserting: bool = False) -> dict[str, Column]:
    """Top-level column -> its new value. Fields that don't exist yet become columns."""
    if not update or not all(k.startswith("$") for k in update):
        raise QueryError("an update has operators only")
    out: dict[str, Column] = {}

    def put(path: str, value: Column) -> None:
        top, _, rest = path.partition(".")
        if rest:
            base = out.get(top, column_at(df.schema, top))
            out[top] = F.when(base.isNotNull(), base.withField(rest, value)).otherwise(base)
        else:
            out[top] = value

    for op, fields in update.items():
        for path, v in fields.items():
            now, kind = column_at(df.schema, path), type_of(df.schema, path)
            element = kind.elementType if isinstance(kind, T.ArrayType) else None
            if op == "$set" or (op == "$setOnInsert" and inserting):
                put(path, literal(v, kind))
            elif op == "$setOnInsert":
                continue
            elif op == "$unset":
                put(path, F.lit(None).cast(kind) if kind is not None else F.lit(None))
            elif op == "$inc":
                put(path, (F.coalesce(now, F.lit(0)) + F.lit(v)).cast(kind or "double"))
            elif op == "$mul":
                put(path, (F.coalesce(now, F.lit(0)) * F.lit(v)).cast(kind or "double"))
            elif op == "$min":
                put(path, F.least(now, literal(v, kind)))
            elif op == "$max":
                put(path, F.greatest(now, literal(v, kind)))
            elif op == "$rename":
                put(v, now)
                put(path, F.lit(None).cast(kind) if kind is not None else F.lit(None))
            elif op in ("$push", "$addToSet"):
                if element is None:
                    raise QueryError(f"{op} needs an array field")
                each = v["$each"] if isinstance(v, dict) and "$each" in v else [v]
                old = F.coalesce(now, F.array().cast(kind))
                new = F.array(*[literal(x, element) for x in each]).cast(kind)
                put(path, F.concat(old, new) if op == "$push" else F.concat(old, F.array_except(new, old)))
            elif op == "$pull":
                if element is None:
                    raise QueryError("$pull needs an array field")
                from .predicates import _field

                put(path, F.filter(now, lambda x: ~_field(x, element, v)))
            elif op == "$currentDate":
                put(path, F.current_timestamp())
            else:
                raise QueryError(f"update operator {op}")
    return out


def inserted(start: dict[str, Any], update: dict[str, Any]) -> dict[str, Any]:
    """The document that an update makes where none matched; `start` has the filter's equalities."""
    out = dict(start)
    for op, fields in update.items():
        for path, v in fields.items():
            now = out.get(path)
            if op in ("$set", "$setOnInsert"):
                out[path] = v
            elif op == "$inc":
                out[path] = (now or 0) + v
            elif op == "$mul":
                out[path] = (now or 0) * v
            elif op in ("$min", "$max"):
                out[path] = v if now is None else (min if op == "$min" else max)(now, v)
            elif op in ("$push", "$addToSet"):
                each = v["$each"] if isinstance(v, dict) and "$each" in v else [v]
                old = list(now or [])
                for x in each:
                    if op == "$push" or x not in old:
                        old.append(x)
                out[path] = old
            elif op == "$unset":
                out.pop(path, None)
            else:
                raise QueryError(f"update operator {op} can't insert")
    return out
