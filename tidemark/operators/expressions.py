"""Aggregation expressions as columns (E1-E18 and the rest of the supported language)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import QueryError, column_at, regex_column, to_utc


def _double(c: Column) -> Column:
    return c.cast("double")


#: One argument, or a list of one.
_UNARY: dict[str, Callable[[Column], Column]] = {
    "$abs": F.abs, "$ceil": F.ceil, "$floor": F.floor, "$exp": lambda c: F.exp(_double(c)), "$ln": lambda c: F.ln(_double(c)),
    "$log10": lambda c: F.log10(_double(c)), "$sqrt": lambda c: F.sqrt(_double(c)), "$not": lambda c: ~F.coalesce(c.cast("boolean"), F.lit(False)),
    "$size": F.size, "$isArray": lambda c: c.isNotNull() & F.typeof(c).startswith("array<"), "$toLower": lambda c: F.lower(F.coalesce(c, F.lit(""))),
    "$toUpper": lambda c: F.upper(F.coalesce(c, F.lit(""))), "$strLenCP": F.char_length, "$toInt": lambda c: c.try_cast("int"),
    "$toLong": lambda c: c.try_cast("long"), "$toDouble": lambda c: c.try_cast("double"), "$toString": lambda c: c.cast("string"),
    "$toDate": lambda c: c.try_cast("timestamp"), "$toBool": lambda c: c.try_cast("boolean"), "$reverseArray": F.reverse,
    "$year": F.year, "$month": F.month, "$dayOfMonth": F.dayofmonth, "$hour": F.hour, "$minute": F.minute, "$second": F.second,
    "$dayOfYear": F.dayofyear, "$isoWeek": F.weekofyear, "$dayOfWeek": F.dayofweek,
    "$first": lambda c: F.get(c, F.lit(0)), "$last": lambda c: F.try_element_at(c, F.lit(-1)),
    "$objectToArray": lambda c: F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))),
    "$arrayToObject": lambda c: F.map_from_entries(F.transform(c, lambda e: F.struct(e["k"], e["v"]))),
    "$isNumber": lambda c: c.isNotNull(),
}
_BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "$eq": lambda a, b: a.eqNullSafe(b), "$ne": lambda a, b: ~a.eqNullSafe(b),
    "$gt": lambda a, b: F.coalesce(a > b, a.isNotNull() & b.isNull()), "$gte": lambda a, b: F.coalesce(a >= b, b.isNull()),
    "$lt": lambda a, b: F.coalesce(a < b, a.isNull() & b.isNotNull()), "$lte": lambda a, b: F.coalesce(a <= b, a.isNull()),
    "$subtract": lambda a, b: a - b, "$divide": lambda a, b: F.try_divide(_double(a), _double(b)),
    "$mod": lambda a, b: F.try_mod(a, b), "$pow": lambda a, b: F.pow(_double(a), _double(b)),
    "$in": lambda a, b: F.coalesce(F.array_contains(b, a), F.lit(False)), "$split": lambda a, b: F.split(a, F.concat(F.lit(r"\Q"), b, F.lit(r"\E"))),
    "$arrayElemAt": lambda a, i: F.when(i >= 0, F.get(a, i)).otherwise(F.try_element_at(a, F.when(i < 0, i))),
    "$setDifference": F.array_except, "$cmp": lambda a, b: F.when(a < b, -1).when(a > b, 1).otherwise(0),
}
_UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second", "millisecond")


class Expressions:
    """Compiles against a schema; `names` holds lambda variables."""

    def __init__(self, schema: T.StructType, names: dict[str, Column] | None = None):
        self.schema, self.names = schema, names or {}

    def compile(self, e: Any) -> Column:
        if isinstance(e, Column):
            return e
        if isinstance(e, str) and e.startswith("$$"):
            name, *path = e[2:].split(".")
            if name in ("ROOT", "CURRENT"):
                return column_at(self.schema, ".".join(path)) if path else F.struct(*[F.col(f"`{f.name}`") for f in self.schema.fields])
            if name == "REMOVE":
                return F.lit(None)
            if name not in self.names:
                raise QueryError(f"variable $${name}")
            return reduce(lambda c, p: c.getField(p), path, self.names[name])
        if isinstance(e, str) and e.startswith("$"):
            return column_at(self.schema, e[1:])
        if isinstance(e, list):
            return F.array(*[self.compile(x) for x in e])
        if isinstance(e, dict):
            operators = [k for k in e if k.startswith("$")]
            if not operators:
                return F.struct(*[self.compile(v).alias(k) for k, v in e.items()]) if e else F.lit(None)
            if len(e) != 1:
                raise QueryError(f"one operator at a time: {sorted(e)}")
            return self._operator(operators[0], e[operators[0]])
        return F.lit(to_utc(e) or e)

    def _with(self, **names: Column) -> "Expressions":
        return Expressions(self.schema, self.names | names)

    def _operator(self, op: str, v: Any) -> Column:
        many = [self.compile(x) for x in v] if isinstance(v, list) else None
        if op in _UNARY:
            return _UNARY[op](many[0] if many and len(many) == 1 else self.compile(v))
        if op in _BINARY:
            if many is None or len(many) != 2:
                raise QueryError(f"{op} takes two arguments")
            return _BINARY[op](*many)
        method = getattr(self, "_" + op[1:].lower(), None)
        if method is None:
            raise QueryError(f"expression operator {op}")
        return method(v, many)

    def _literal(self, v, many):
        return F.lit(v)

    def _ifnull(self, v, many):
        return F.coalesce(*many)

    def _cond(self, v, many):
        a, b, c = (many if many else [self.compile(v[k]) for k in ("if", "then", "else")])
        return F.when(F.coalesce(a.cast("boolean"), F.lit(False)), b).otherwise(c)

    def _switch(self, v, many):
        out = None
        for branch in v["branches"]:
            test = F.coalesce(self.compile(branch["case"]).cast("boolean"), F.lit(False))
            out = F.when(test, self.compile(branch["then"])) if out is None else out.when(test, self.compile(branch["then"]))
        return out.otherwise(self.compile(v["default"])) if "default" in v else out

    def _and(self, v, many):
        return reduce(lambda a, b: a & b, [F.coalesce(x.cast("boolean"), F.lit(False)) for x in many], F.lit(True))

    def _or(self, v, many):
        return reduce(lambda a, b: a | b, [F.coalesce(x.cast("boolean"), F.lit(False)) for x in many], F.lit(False))

    def _add(self, v, many):
        return reduce(lambda a, b: a + b, many)

    def _multiply(self, v, many):
        return reduce(lambda a, b: a * b, many)

    def _sum(self, v, many):
        """Expression form: nulls are zero."""
        if many is None:
            return F.aggregate(self.compile(v), F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))
        return reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0)) for x in many])

    def _avg(self, v, many):
        c = self.compile(v)
        return F.try_divide(self._sum(v, None), F.size(F.array_compact(c)))

    def _min(self, v, many):
        return F.array_min(self.compile(v)) if many is None else F.least(*many)

    def _max(self, v, many):
        return F.array_max(self.compile(v)) if many is None else F.greatest(*many)

    def _round(self, v, many):
        """Half to even; what is rounded to zero keeps its sign."""
        x, places = (many[0], v[1] if len(v) > 1 else 0) if many else (self.compile(v), 0)
        r = F.bround(x, places)
        return F.when((r == 0) & (x < 0), -r).otherwise(r)

    def _concat(self, v, many):
        return F.concat(*[x.cast("string") for x in many])

    def _substr(self, v, many):
        return F.substring(many[0], many[1] + 1, many[2])

    _substrcp = _substr

    def _trim(self, v, many):
        c = self.compile(v["input"])
        return F.trim(c, self.compile(v["chars"])) if "chars" in v else F.trim(c)

    def _regexmatch(self, v, many):
        return F.coalesce(regex_column(self.compile(v["input"]), v["regex"], v.get("options", "")), F.lit(False))

    def _filter(self, v, many):
        name = v.get("as", "this")
        return F.filter(self.compile(v["input"]), lambda x: F.coalesce(
            self._with(**{name: x}).compile(v["cond"]).cast("boolean"), F.lit(False)))

    def _map(self, v, many):
        name = v.get("as", "this")
        return F.transform(self.compile(v["input"]), lambda x: self._with(**{name: x}).compile(v["in"]))

    def _reduce(self, v, many):
        start = self.compile(v["initialValue"])
        return F.aggregate(self.compile(v["input"]), start, lambda a, x: self._with(value=a, this=x).compile(v["in"]))

    def _let(self, v, many):
        return self._with(**{k: self.compile(x) for k, x in v["vars"].items()}).compile(v["in"])

    def _zip(self, v, many):
        """Arrays of one element each, cut to the shortest."""
        arrays = [self.compile(x) for x in v["inputs"]]
        n = F.least(*[F.size(a) for a in arrays]) if len(arrays) > 1 else F.size(arrays[0])
        return F.transform(F.slice(arrays[0], 1, n), lambda _, i: F.array(*[F.get(a, i) for a in arrays]))

    def _concatarrays(self, v, many):
        return F.concat(*many)

    def _setunion(self, v, many):
        return F.array_sort(reduce(F.array_union, many))

    def _setintersection(self, v, many):
        return F.array_sort(reduce(F.array_intersect, many))

    def _slice(self, v, many):
        if len(many) == 3:
            return F.slice(many[0], many[1] + 1, many[2])
        return F.when(many[1] >= 0, F.slice(many[0], F.lit(1), many[1])).otherwise(
            F.slice(many[0], F.greatest(F.size(many[0]) + many[1], F.lit(0)) + 1, -many[1]))

    def _range(self, v, many):
        return F.when(many[1] > many[0], F.sequence(many[0], many[1] - 1, *many[2:])).otherwise(F.array().cast("array<int>"))

    def _mergeobjects(self, v, many):
        return F.map_concat(*many)

    def _datetrunc(self, v, many):
        if v["unit"] not in _UNITS:
            raise QueryError(f"unit {v['unit']}")
        return F.date_trunc(v["unit"], self.compile(v["date"]))

    def _datediff(self, v, many):
        a, b = self.compile(v["startDate"]), self.compile(v["endDate"])
        trunc = {u: s for u, s in (("second", 1), ("minute", 60), ("hour", 3600), ("day", 86400))}
        if v["unit"] not in trunc:
            raise QueryError(f"unit {v['unit']}")
        s = trunc[v["unit"]]
        return F.floor(F.unix_timestamp(b.cast("timestamp")) / s) - F.floor(F.unix_timestamp(a.cast("timestamp")) / s)

    def _datetostring(self, v, many):
        return F.date_format(self.compile(v["date"]), "yyyy-MM-dd HH:mm:ss")

    def _dateadd(self, v, many):
        return self.compile(v["startDate"]) + F.make_dt_interval(**{{"day": "days", "hour": "hours", "minute": "mins", "second": "secs"}[v["unit"]]: self.compile(v["amount"])})
