"""Aggregation pipelines: a list of stage dictionaries folded over a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expressions import Expressions
from .paths import QueryError, column_at, quoted, type_of
from .predicates import compile_filter

#: Name -> DataFrame of another collection, for $lookup, $unionWith, $out and $merge.
Collections = Callable[[str], DataFrame]


def numeric(df: DataFrame, c: Column) -> Column:
    """Numbers as they are, anything else null."""
    kind = df.select(c.alias("x")).schema[0].dataType
    return c if isinstance(kind, (T.NumericType, T.NullType)) else c.try_cast("double")


def accumulator(df: DataFrame, spec: dict[str, Any]) -> Column:
    """One accumulator as an aggregate column."""
    if not isinstance(spec, dict) or len(spec) != 1:
        raise QueryError(f"accumulator {spec!r}")
    (op, v), = spec.items()
    e = Expressions(df.schema)
    if op == "$count":
        return F.count(F.lit(1))
    if op in ("$top", "$bottom"):
        (key, way), = v["sortBy"].items()
        pick = F.min_by if (way > 0) == (op == "$top") else F.max_by
        return pick(e.compile(v["output"]), column_at(df.schema, key))
    if op in ("$median", "$percentile"):
        x = e.compile(v["input"])
        return F.percentile(x, 0.5) if op == "$median" else F.percentile(x, F.array(*[F.lit(p) for p in v["p"]]))
    c = e.compile(v)
    boxed, unboxed = F.struct(c.alias("x")), lambda a: F.transform(a, lambda s: s["x"])  # collecting drops bare nulls
    kinds: dict[str, Callable[[], Column]] = {
        "$sum": lambda: F.coalesce(F.sum(numeric(df, c)), F.lit(0)), "$avg": lambda: F.avg(numeric(df, c)),
        "$min": lambda: F.min(c), "$max": lambda: F.max(c),
        "$first": lambda: F.first(c), "$last": lambda: F.last(c), "$push": lambda: unboxed(F.collect_list(boxed)),
        # Sorted, so that equal inputs give equal results.
        "$addToSet": lambda: F.array_sort(unboxed(F.collect_set(boxed))),
        "$stdDevPop": lambda: F.stddev_pop(numeric(df, c)), "$stdDevSamp": lambda: F.stddev_samp(numeric(df, c)),
        "$mergeObjects": lambda: merged_objects(df, c),
    }
    if op not in kinds:
        raise QueryError(f"accumulator {op}")
    return kinds[op]()


def merged_objects(df: DataFrame, c: Column) -> Column:
    """Later documents' fields over earlier ones'; null and missing are one."""
    kind = df.select(c.alias("x")).schema[0].dataType
    if isinstance(kind, T.StructType):
        return F.struct(*[F.last(c.getField(f.name), ignorenulls=True).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.MapType):
        over = lambda a, b: F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x))
        return F.aggregate(F.collect_list(c), F.create_map().cast(kind), over)
    raise QueryError("$mergeObjects takes documents")


def is_exclusion(projection: dict[str, Any]) -> bool:
    named = {k: v for k, v in projection.items() if k != "_id"}
    flat = [v for v in (named or projection).values()]
    return all(not isinstance(v, (dict, str, list)) and not v for v in flat) and bool(flat)


def project(df: DataFrame, projection: dict[str, Any] | None) -> DataFrame:
    """Inclusion, exclusion or computed fields."""
    if not projection:
        return df
    if is_exclusion(projection):
        for path in projection:
            df = _dropped(df, path)
        return df
    e, out = Expressions(df.schema), []
    if "_id" in df.columns and not isinstance(projection.get("_id"), (dict, str, list)) and projection.get("_id", 1):
        out.append(F.col("_id"))
    nested: dict[str, list[str]] = {}
    for name, v in projection.items():
        if name == "_id" and not isinstance(v, (dict, str)):
            continue
        if isinstance(v, (dict, str, list)):
            out.append(e.compile(v).alias(name))
        elif not v:
            raise QueryError("inclusion and exclusion don't mix")
        elif "." in name:
            nested.setdefault(name.split(".")[0], []).append(name)
        elif type_of(df.schema, name) is not None:
            out.append(F.col(f"`{name}`"))
    for top, paths in nested.items():
        out.append(_kept(column_at(df.schema, top), type_of(df.schema, top), [p.split(".", 1)[1] for p in paths]).alias(top))
    return df.select(*out)


def _kept(column: Column, kind: T.DataType, paths: list[str]) -> Column:
    """A struct with the named fields only, through arrays."""
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _kept(x, kind.elementType, paths))
    below: dict[str, list[str]] = {}
    for p in paths:
        head, _, rest = p.partition(".")
        below.setdefault(head, []).extend([rest] if rest else [])
    fields = [(_kept(column.getField(f.name), f.dataType, below[f.name]) if below[f.name] else column.getField(f.name)).alias(f.name)
              for f in kind.fields if f.name in below]
    return F.when(column.isNotNull(), F.struct(*fields))


def _dropped(df: DataFrame, path: str) -> DataFrame:
    if type_of(df.schema, path) is None:
        return df
    top, _, rest = path.partition(".")
    return df.drop(top) if not rest else df.withColumn(top, F.col(f"`{top}`").dropFields(rest))


def sort_columns(spec: dict[str, int]) -> list[Column]:
    """Nulls first ascending, last descending."""
    return [F.col(quoted(k)).asc_nulls_first() if v > 0 else F.col(quoted(k)).desc_nulls_last() for k, v in spec.items()]


def keeps_order(op: str, v: Any, sorted_by: dict[str, int], after: DataFrame) -> bool:
    """Whether the rows' order can still be told from the sort's keys after the stage."""
    if op in ("$limit", "$skip", "$match"):
        return True
    if op not in ("$addFields", "$set", "$project", "$unset"):
        return False
    made = {k.split(".")[0] for k, x in v.items() if op != "$project" or isinstance(x, (dict, str, list))} if isinstance(v, dict) else set()
    return all(k.split(".")[0] not in made and type_of(after.schema, k) is not None for k in sorted_by)


class Pipeline:
    """Compiles stages; each takes a DataFrame and its dictionary's value."""

    def __init__(self, collections: Collections | None = None, write: Callable[[DataFrame, str, str], None] | None = None):
        self.collections, self.write = collections, write

    def run(self, df: DataFrame, stages: list[dict[str, Any]]) -> DataFrame:
        ordered: list[Column] = []
        sorted_by: dict[str, int] = {}
        for stage in stages:
            if len(stage) != 1:
                raise QueryError(f"a stage has one operator: {sorted(stage)}")
            (op, v), = stage.items()
            method = getattr(self, "_" + op[1:].lower(), None) if op.startswith("$") else None
            if method is None:
                raise QueryError(f"stage {op}")
            if op == "$group" and ordered:
                # $first and $last mean the order just made.
                df = self._ordered_group(df, v, ordered)
            else:
                df = method(df, v)
            sorted_by = v if op == "$sort" else sorted_by if keeps_order(op, v, sorted_by, df) else {}
            ordered = sort_columns(sorted_by)
        return df

    def _match(self, df, v):
        return df.where(compile_filter(df.schema, v))

    def _project(self, df, v):
        return project(df, v)

    def _addfields(self, df, v):
        e = Expressions(df.schema)
        flat = {k: e.compile(x) for k, x in v.items() if "." not in k}
        out = df.withColumns(flat)
        for k, x in v.items():
            if "." in k:
                top, rest = k.split(".", 1)
                out = out.withColumn(top, F.col(f"`{top}`").withField(rest, e.compile(x)))
        return out

    _set = _addfields

    def _unset(self, df, v):
        for path in [v] if isinstance(v, str) else v:
            df = _dropped(df, path)
        return df

    def _unwind(self, df, v):
        spec = {"path": v} if isinstance(v, str) else v
        name = spec["path"].lstrip("$")
        keep, index = spec.get("preserveNullAndEmptyArrays", False), spec.get("includeArrayIndex")
        if "." in name:
            top, rest = name.split(".", 1)
            df = df.withColumn("_unwound", column_at(df.schema, name))
            out = self._unwind(df, spec | {"path": "$_unwound"})
            return out.withColumn(top, F.col(f"`{top}`").withField(rest, F.col("_unwound"))).drop("_unwound")
        if not isinstance(type_of(df.schema, name), T.ArrayType):
            return df if keep else df.where(F.col(f"`{name}`").isNotNull())
        others = [F.col(f"`{c}`") for c in df.columns if c != name]
        if index:
            made = (F.posexplode_outer if keep else F.posexplode)(F.col(f"`{name}`")).alias(index, name)
        else:
            made = (F.explode_outer if keep else F.explode)(F.col(f"`{name}`")).alias(name)
        out = df.select(*others, made)
        return out.select(*[F.col(f"`{c}`") for c in df.columns], *([F.col(f"`{index}`")] if index else []))

    def _group(self, df, v):
        keys, made = dict(v).pop("_id"), {k: x for k, x in v.items() if k != "_id"}
        e = Expressions(df.schema)
        aggregates = [accumulator(df, x).alias(k) for k, x in made.items()]
        if keys is None:
            # A group of nothing is no group: without rows there is none.
            out = df.agg(F.count(F.lit(1)).alias("_rows"), *aggregates).where("_rows > 0").drop("_rows")
            return out.select(F.lit(None).alias("_id"), *made)
        # Keys as columns of their own, so that aggregation is by hash on them; a document key
        # becomes a struct afterwards.
        parts = keys if isinstance(keys, dict) and not any(k.startswith("$") for k in keys) else {"": keys}
        named = [e.compile(x).alias(f"_key_{i}") for i, x in enumerate(parts.values())]
        out = df.groupBy(*named).agg(*aggregates) if aggregates else df.select(*named).distinct()
        if parts.keys() == {""}:
            return out.select(F.col("_key_0").alias("_id"), *[F.col(f"`{k}`") for k in made])
        whole = F.struct(*[F.col(f"_key_{i}").alias(k) for i, k in enumerate(parts)])
        return out.select(whole.alias("_id"), *[F.col(f"`{k}`") for k in made])

    def _ordered_group(self, df, v, ordered):
        firsts = {k for k, x in v.items() if k != "_id" and isinstance(x, dict) and set(x) & {"$first", "$last", "$push"}}
        if not firsts:
            return self._group(df, v)
        ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(
            Expressions(df.schema).compile(v["_id"]) if v["_id"] is not None else F.lit(0)).orderBy(*ordered)))
        spec = dict(v)
        out = self._group(ranked, {k: x for k, x in spec.items() if k not in firsts} | {
            k: {"$push": {"r": "$_rank", "v": next(iter(spec[k].values()))}} if "$push" in spec[k] else
            {"$top" if "$first" in spec[k] else "$bottom": {"sortBy": {"_rank": 1}, "output": next(iter(spec[k].values()))}}
            for k in firsts})
        for k in firsts:
            if "$push" in spec[k]:
                out = out.withColumn(k, F.transform(F.array_sort(F.col(f"`{k}`")), lambda x: x["v"]))
        return out.select("_id", *[F.col(f"`{k}`") for k in spec if k != "_id"])

    def _sort(self, df, v):
        return df.orderBy(*sort_columns(v))

    def _limit(self, df, v):
        return df.limit(v)

    def _skip(self, df, v):
        return df.offset(v)

    def _count(self, df, v):
        return df.agg(F.count(F.lit(1)).alias(v)).where(F.col(v) > 0)

    def _sortbycount(self, df, v):
        return self._group(df, {"_id": v, "count": {"$sum": 1}}).orderBy(F.desc("count"), "_id")

    def _replaceroot(self, df, v):
        root = Expressions(df.schema).compile(v["newRoot"])
        return df.select(root.alias("_root")).select("_root.*")

    def _replacewith(self, df, v):
        return self._replaceroot(df, {"newRoot": v})

    def _sample(self, df, v):
        return df.orderBy(F.rand()).limit(v["size"])

    def _bucket(self, df, v):
        x = Expressions(df.schema).compile(v["groupBy"])
        bounds = v["boundaries"]
        bucket = None
        for lo, hi in zip(bounds, bounds[1:]):
            test = (x >= F.lit(lo)) & (x < F.lit(hi))
            bucket = F.when(test, F.lit(lo)) if bucket is None else bucket.when(test, F.lit(lo))
        if "default" in v:
            bucket = bucket.otherwise(F.lit(v["default"]))
        df = df.withColumn("_bucket", bucket)
        if "default" not in v:
            df = df.where(F.col("_bucket").isNotNull())
        return self._group(df, {"_id": "$_bucket"} | v.get("output", {"count": {"$sum": 1}}))

    def _bucketauto(self, df, v):
        """Bounds from exact percentiles of the values, so no row numbers over everything."""
        x, n = Expressions(df.schema).compile(v["groupBy"]), v["buckets"]
        bounds = df.agg(F.percentile(x, F.array(*[F.lit(i / n) for i in range(1, n)])).alias("p")).first()["p"] if n > 1 else []
        bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds or []]).cast("array<double>"), lambda b: b <= x))
        out = self._group(df.withColumn("_bucket", bucket).withColumn("_x", x), {
            "_id": "$_bucket", "min": {"$min": "$_x"}, "max": {"$max": "$_x"}} | v.get("output", {"count": {"$sum": 1}}))
        return out.withColumn("_id", F.struct("min", "max")).drop("min", "max")

    def _facet(self, df, v):
        """One row; every facet's rows as an array of documents."""
        each = [self.run(df, stages).select(F.struct("*").alias("x")).agg(F.collect_list("x").alias(name)) for name, stages in v.items()]
        return reduce(lambda a, b: a.join(F.broadcast(b)), each)  # single rows

    def _lookup(self, df, v):
        if self.collections is None or "pipeline" in v:
            raise QueryError("$lookup needs collections, and localField and foreignField")
        other = self.collections(v["from"])
        key = column_at(other.schema, v["foreignField"])
        found = other.select(key.alias("_foreign"), F.struct("*").alias("_doc")).groupBy("_foreign").agg(F.collect_list("_doc").alias(v["as"]))
        out = df.join(found, column_at(df.schema, v["localField"]) == F.col("_foreign"), "left").drop("_foreign")
        return out.withColumn(v["as"], F.coalesce(v["as"], F.array().cast(found.schema[v["as"]].dataType)))

    def _unionwith(self, df, v):
        spec = {"coll": v} if isinstance(v, str) else v
        if self.collections is None:
            raise QueryError("$unionWith needs collections")
        other = self.run(self.collections(spec["coll"]), spec.get("pipeline", []))
        return df.unionByName(other, allowMissingColumns=True)

    def _setwindowfields(self, df, v):
        part = [Expressions(df.schema).compile(v["partitionBy"])] if v.get("partitionBy") is not None else []
        order = sort_columns(v.get("sortBy", {}))
        out = {}
        for name, spec in v["output"].items():
            frame = spec.get("window", {})
            function = {k: x for k, x in spec.items() if k != "window"}
            (op, x), = function.items()
            w = Window.partitionBy(*part).orderBy(*order) if order else Window.partitionBy(*part)
            if op in ("$rank", "$denseRank", "$documentNumber"):
                out[name] = {"$rank": F.rank, "$denseRank": F.dense_rank, "$documentNumber": F.row_number}[op]().over(w)
                continue
            if op == "$shift":
                out[name] = F.lag(Expressions(df.schema).compile(x["output"]), -x["by"], x.get("default")).over(w)
                continue
            edge = {"unbounded": None, "current": 0}
            if "documents" in frame:
                a, b = (edge.get(y, y) if isinstance(y, str) else y for y in frame["documents"])
                w = w.rowsBetween(Window.unboundedPreceding if a is None else a, Window.unboundedFollowing if b is None else b)
            elif "range" in frame:
                a, b = (edge.get(y, y) if isinstance(y, str) else y for y in frame["range"])
                w = w.rangeBetween(Window.unboundedPreceding if a is None else a, Window.unboundedFollowing if b is None else b)
            else:
                w = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            inner = Expressions(df.schema).compile(x)
            plain = {"$sum": F.sum, "$avg": F.avg, "$min": F.min, "$max": F.max, "$first": F.first, "$last": F.last,
                     "$push": F.collect_list, "$count": lambda _: F.count(F.lit(1))}
            if op not in plain:
                raise QueryError(f"window operator {op}")
            out[name] = F.coalesce(plain[op](inner).over(w), F.lit(0)) if op == "$sum" else plain[op](inner).over(w)
        return df.withColumns(out)

    def _densify(self, df, v):
        """Adds the missing values of a numeric or time field, per partition."""
        field, step, by = v["field"], v["range"]["step"], v.get("partitionByFields", [])
        unit, bounds = v["range"].get("unit"), v["range"]["bounds"]
        width = F.expr(f"INTERVAL {int(step)} {unit}") if unit else F.lit(step)
        lo, hi = (F.min(field), F.max(field)) if isinstance(bounds, str) else (F.lit(bounds[0]), F.lit(bounds[1]))
        span = df.groupBy(*by).agg(lo.alias("_lo"), hi.alias("_hi")) if by and bounds == "partition" else (
            df.select(*by).distinct() if by else df.sparkSession.range(1).select()).join(
            F.broadcast(df.agg(lo.alias("_lo"), hi.alias("_hi"))))
        end = F.col("_hi") if isinstance(bounds, str) else F.col("_hi") - width
        filled = span.where("_lo IS NOT NULL").select(*by, F.explode(F.sequence("_lo", end, width)).cast(type_of(df.schema, field)).alias(field))
        missing = filled.join(df.select(*by, field).distinct(), [*by, field], "left_anti")
        return df.unionByName(missing, allowMissingColumns=True)

    def _fill(self, df, v):
        part = v.get("partitionByFields") or []
        out = {}
        for name, spec in v["output"].items():
            if "value" in spec:
                out[name] = F.coalesce(F.col(name), Expressions(df.schema).compile(spec["value"]))
            elif spec.get("method") == "locf":
                w = Window.partitionBy(*part).orderBy(*sort_columns(v["sortBy"])).rowsBetween(Window.unboundedPreceding, 0)
                out[name] = F.last(name, ignorenulls=True).over(w)
            else:
                raise QueryError(f"$fill {spec}")
        return df.withColumns(out)

    def _out(self, df, v):
        return self._write(df, v, "overwrite")

    def _merge(self, df, v):
        """Rows of a known _id replace it, others are inserted; no other way is offered."""
        spec = {"into": v} if isinstance(v, str) else v
        offered = {"on": ("_id", ["_id"]), "whenMatched": ("replace",), "whenNotMatched": ("insert",)}
        for k, x in spec.items():
            if k != "into" and x not in offered.get(k, ()):
                raise QueryError(f"$merge with {k}: {x!r}")
        return self._write(df, spec["into"], "append")

    def _write(self, df, name, mode):
        if self.write is None:
            raise QueryError("nothing to write to")
        self.write(df, name, mode)
        return df.limit(0)
