"""Collections as tables of a Spark database, with copy-on-write mutations.

A collection is an external Parquet table whose location is one snapshot folder; a mutation
writes the next snapshot and then moves the table's location to it, so readers see the old
rows or the new ones. Inserts of the table's own schema are appended in place. One writer at a
time is assumed. Indices are entries in the table's properties; `unique` ones are checked when
rows are written, and the newest one orders the rows of each snapshot for data skipping.
"""

from __future__ import annotations

import json
import secrets
import time
import uuid
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.paths import QueryError, coerce, quoted, to_utc, type_of
from ..operators.pipeline import Pipeline, project, sort_columns
from ..operators.predicates import compile_filter
from ..operators.updates import assignments, inserted

DEFAULT_LIMIT = 5
_INDICES, _OPTIONS = "tidemark.indices", "tidemark.options"
# Names of index directions.
DIRECTIONS = {"1": 1, "asc": 1, "ascending": 1, "-1": -1, "desc": -1, "descending": -1, "text": "text"}


class CollectionError(LookupError):
    """A collection that is missing, or in the way."""


class Store:
    """One database of collections under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, database: str = "default"):
        self.spark, self.root, self.database = spark, root.rstrip("/"), database
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")

    # Catalog

    def _name(self, collection: str) -> str:
        return f"`{self.database}`.`{collection}`"

    def exists(self, collection: str) -> bool:
        return self.spark.catalog.tableExists(f"`{self.database}`.`{collection}`")

    def guard(self, collection: str) -> None:
        if not self.exists(collection):
            raise CollectionError(f"collection {collection!r} does not exist")

    def list_databases(self) -> list[str]:
        return sorted(d.name for d in self.spark.catalog.listDatabases())

    def list_collections(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database) if not t.isTemporary)

    def create_collection(self, collection: str, options: dict[str, Any] | None = None, schema: T.StructType | None = None) -> None:
        if self.exists(collection):
            raise CollectionError(f"collection {collection!r} exists")
        empty = self.spark.createDataFrame([], schema or T.StructType([T.StructField("_id", T.StringType())]))
        self._point(collection, empty.schema, self._snapshot(collection, empty), {_OPTIONS: json.dumps(options or {})})

    def drop_collection(self, collection: str) -> None:
        """Dropping what isn't there succeeds."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(collection)}")

    def rename_collection(self, old: str, new: str) -> None:
        self.guard(old)
        if self.exists(new):
            raise CollectionError(f"collection {new!r} exists")
        self.spark.sql(f"ALTER TABLE {self._name(old)} RENAME TO {self._name(new)}")

    def properties(self, collection: str) -> dict[str, str]:
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {self._name(collection)}").collect()
        return {r["key"]: r["value"] for r in rows if r["key"].startswith("tidemark.")}

    def location(self, collection: str) -> str:
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self._name(collection)}").where("col_name = 'Location'").collect()
        return rows[0]["data_type"]

    def collection_stats(self, collection: str) -> dict[str, Any]:
        self.guard(collection)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.location(collection))
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path)
        count, size = self.read(collection).count(), int(files.getLength())
        return {"ns": f"{self.database}.{collection}", "count": count, "size": size, "storageSize": size,
                "avgObjSize": size / count if count else 0.0, "nindexes": len(self.list_indices(collection)),
                "totalIndexSize": 0, "capped": bool(json.loads(self.properties(collection).get(_OPTIONS, "{}")).get("capped", False))}

    def database_stats(self) -> dict[str, Any]:
        tables = [t for t in self.spark.catalog.listTables(self.database) if not t.isTemporary]
        each = [self.collection_stats(t.name) for t in tables if t.tableType != "VIEW"]
        objects, size = sum(s["count"] for s in each), sum(s["size"] for s in each)
        return {"db": self.database, "collections": len(each), "views": len(tables) - len(each), "objects": objects,
                "dataSize": size, "storageSize": size, "avgObjSize": size / objects if objects else 0.0,
                "indexes": sum(s["nindexes"] for s in each), "indexSize": 0}

    def list_indices(self, collection: str) -> list[dict[str, Any]]:
        self.guard(collection)
        return [{"v": 2, "key": {"_id": 1}, "name": "_id_"}, *json.loads(self.properties(collection).get(_INDICES, "[]"))]

    def create_index(self, collection: str, keys: dict[str, Any], options: dict[str, Any] | None = None) -> str:
        self.guard(collection)
        key = {k: DIRECTIONS.get(str(d).lower(), d) for k, d in keys.items()}
        options = options or {}
        name = options.get("name") or "_".join(f"{k}_{d}" for k, d in key.items())
        entry = {"v": 2, "key": key, "name": name} | options
        if options.get("unique"):
            self._check_unique(self.read(collection), list(key), name)
        kept = [i for i in self.list_indices(collection)[1:] if i["name"] != name]
        self._set(collection, {_INDICES: json.dumps([*kept, entry])})
        return name

    def drop_index(self, collection: str, name: str) -> None:
        self.guard(collection)
        if name == "_id_":
            raise QueryError("the index on _id stays")
        have = self.list_indices(collection)[1:]
        if name not in [i["name"] for i in have]:
            raise CollectionError(f"index {name!r} does not exist")
        self._set(collection, {_INDICES: json.dumps([i for i in have if i["name"] != name])})

    def server_status(self) -> dict[str, Any]:
        context = self.spark.sparkContext
        up = time.time() - context.startTime / 1000
        return {"host": context.master, "version": self.spark.version, "process": context.appName, "uptime": up,
                "uptimeMillis": int(up * 1000), "localTime": datetime.now(), "applicationId": context.applicationId,
                "activeJobs": len(context.statusTracker().getActiveJobsIds()), "defaultParallelism": context.defaultParallelism}

    def ping(self) -> dict[str, int]:
        return {"ok": int(self.spark.range(1).count() == 1)}

    def close(self) -> None:
        """For the owner of the session only."""
        self.spark.stop()

    # Reading

    def read(self, collection: str) -> DataFrame:
        self.guard(collection)
        return self.spark.table(self._name(collection))

    def find_frame(self, collection: str, query=None, projection=None, limit: int | None = DEFAULT_LIMIT, sort_field: str | None = None,
                   sort_order: int = 1) -> DataFrame:
        """Filter, sort by one key, first `limit`, then project, so that the sort key may be left out."""
        df = self.read(collection)
        df = df.where(compile_filter(df.schema, query))
        if sort_field:
            df = df.orderBy(*sort_columns({sort_field: sort_order}))
        return project(df if limit is None else df.limit(limit), projection)

    def find(self, collection: str, query=None, projection=None, limit: int = DEFAULT_LIMIT, sort_field=None, sort_order: int = 1) -> list[dict]:
        return [r.asDict(True) for r in self.find_frame(collection, query, projection, limit, sort_field, sort_order).collect()]

    def count(self, collection: str, query=None) -> int:
        df = self.read(collection)
        return df.where(compile_filter(df.schema, query)).count()

    def aggregate_frame(self, collection: str, stages: list[dict[str, Any]]) -> DataFrame:
        return Pipeline(self.read, self._written).run(self.read(collection), stages)

    def aggregate(self, collection: str, stages: list[dict[str, Any]], options: dict[str, Any] | None = None) -> list[dict]:
        """Options: allowDiskUse says nothing here, Spark spills by itself; others raise."""
        if set(options or {}) - {"allowDiskUse", "comment", "batchSize", "maxTimeMS"}:
            raise QueryError(f"options {sorted(options)}")
        return [r.asDict(True) for r in self.aggregate_frame(collection, stages).collect()]

    # Writing

    def insert_one(self, collection: str, document: dict[str, Any]) -> str:
        return self.insert_many(collection, [document])[0]

    def insert_many(self, collection: str, documents: list[dict[str, Any]], ordered: bool = True) -> list[str]:
        """Ids in input order; a collection that isn't there is made. All documents go in, or none."""
        ids = [str(d.get("_id") or secrets.token_hex(12)) for d in documents]
        if not documents:
            return []
        known = self.read(collection).schema if self.exists(collection) else None
        rows = [{k: coerce(v, known and type_of(known, k)) for k, v in d.items()} | {"_id": i} for d, i in zip(documents, ids)]
        self._insert(collection, self._frame(rows, known))
        return ids

    def insert_frame(self, collection: str, df: DataFrame) -> None:
        """The scalable way in: any DataFrame; rows without _id get one."""
        if "_id" not in df.columns:
            df = df.withColumn("_id", F.substring(F.sha2(F.expr("uuid()"), 256), 1, 24))
        self._insert(collection, df)

    def update_many(self, collection: str, query: dict, update: dict, upsert: bool = False) -> dict[str, Any]:
        """Counts of rows that match and of rows that changed."""
        df = self.read(collection)
        hit = compile_filter(df.schema, query)
        new = assignments(df, update)
        changed = None
        for c, v in new.items():
            differs = ~v.eqNullSafe(F.col(f"`{c}`")) if c in df.columns else v.isNotNull()
            changed = differs if changed is None else changed | differs
        counts = df.where(hit).agg(F.count("*").alias("n"), F.count_if(changed if changed is not None else F.lit(False)).alias("m")).first()
        if counts["n"] == 0 and upsert:
            start = {k: v["$eq"] if isinstance(v, dict) and "$eq" in v else v for k, v in query.items()
                     if not k.startswith("$") and not (isinstance(v, dict) and "$eq" not in v)}
            start = inserted(start, update)
            return {"matched": 0, "modified": 0, "upserted_id": self.insert_one(collection, start)}
        if counts["m"]:
            self._rewrite(collection, df.withColumns({
                c: F.when(hit, v).otherwise(F.col(f"`{c}`") if c in df.columns else F.lit(None)) for c, v in new.items()}))
        return {"matched": counts["n"], "modified": counts["m"], "upserted_id": None}

    def replace_one(self, collection: str, query: dict, document: dict[str, Any], upsert: bool = False) -> dict[str, Any]:
        """The match of the smallest _id is replaced and keeps its _id."""
        df = self.read(collection)
        found = df.where(compile_filter(df.schema, query)).agg(F.min("_id").alias("i"), F.count("*").alias("n")).first()
        one = found["i"]
        if one is None and found["n"]:
            raise QueryError("a row without _id can't be replaced")
        if one is None:
            return {"matched": 0, "modified": 0, "upserted_id": self.insert_one(collection, document) if upsert else None}
        row = self._frame([{k: coerce(v, type_of(df.schema, k)) for k, v in document.items()} | {"_id": one}], df.schema)
        self._rewrite(collection, df.where(~F.col("_id").eqNullSafe(one)).unionByName(row, allowMissingColumns=True))
        return {"matched": 1, "modified": 1, "upserted_id": None}

    def delete_many(self, collection: str, query: dict) -> int:
        df = self.read(collection)
        hit = compile_filter(df.schema, query)
        n = df.where(hit).count()
        if n:
            self._rewrite(collection, df.where(~hit))
        return n

    # Snapshots

    def _frame(self, rows: list[dict[str, Any]], known: T.StructType | None) -> DataFrame:
        names = list(dict.fromkeys(k for r in rows for k in r))
        utc = [{k: to_utc(v) or v for k, v in r.items()} for r in rows]
        if known is not None and set(names) <= set(known.names):
            schema = T.StructType([f for f in known.fields if f.name in names])
            return self.spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in utc], schema)
        self.spark.conf.set("spark.sql.pyspark.inferNestedDictAsStruct.enabled", "true")
        made = self.spark.createDataFrame([tuple(r.get(k) for k in names) for r in utc], names)
        void = [f.name for f in made.schema.fields if isinstance(f.dataType, T.NullType)]
        return made.withColumns({c: F.col(f"`{c}`").cast("string") for c in void})

    def _insert(self, collection: str, new: DataFrame) -> None:
        if not self.exists(collection):
            self._point(collection, new.schema, self._snapshot(collection, new), {})
            return
        old = self.read(collection)
        for index in [{"name": "_id_", "key": {"_id": 1}}, *(i for i in self.list_indices(collection)[1:] if i.get("unique"))]:
            keys = [k for k in index["key"] if k in new.columns and k in old.columns]
            if len(keys) == len(index["key"]):
                both = new.select(*keys).unionByName(old.select(*keys).join(new.select(*keys).distinct(), keys, "left_semi"))
                self._check_unique(both, keys, index["name"])
        if set(new.columns) <= set(old.columns):
            aligned = old.limit(0).unionByName(new, allowMissingColumns=True).select(*old.columns)
            if [f.dataType for f in aligned.schema] == [f.dataType for f in old.schema]:
                aligned.write.mode("append").parquet(self.location(collection))
                self.spark.sql(f"REFRESH TABLE {self._name(collection)}")
                return
        self._rewrite(collection, old.unionByName(new, allowMissingColumns=True))

    def _check_unique(self, df: DataFrame, keys: list[str], name: str) -> None:
        twice = df.groupBy(*[F.col(quoted(k)) for k in keys]).count().where("count > 1").limit(1).collect()
        if twice:
            raise QueryError(f"duplicate key in index {name}: {twice[0].asDict()}")

    def _snapshot(self, collection: str, df: DataFrame) -> str:
        path = f"{self.root}/{self.database}/{collection}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _rewrite(self, collection: str, df: DataFrame) -> None:
        properties = self.properties(collection)
        for index in json.loads(properties.get(_INDICES, "[]"))[-1:]:
            keys = [k for k, d in index["key"].items() if k in df.columns and d in (1, -1)]
            if keys:
                df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        path = self._snapshot(collection, df)
        if df.schema == self.read(collection).schema:
            self.spark.sql(f"ALTER TABLE {self._name(collection)} SET LOCATION '{path}'")
            self.spark.sql(f"REFRESH TABLE {self._name(collection)}")
        else:
            self.drop_collection(collection)  # the table alone: its files are external
            self._point(collection, df.schema, path, properties)

    def _point(self, collection: str, schema: T.StructType, path: str, properties: dict[str, str]) -> None:
        self.spark.catalog.createTable(f"`{self.database}`.`{collection}`", path=path, source="parquet", schema=schema)
        if properties:
            self._set(collection, properties)

    def _set(self, collection: str, properties: dict[str, str]) -> None:
        quoted_ = ", ".join("'{}' = '{}'".format(k, v.replace("\\", "\\\\").replace("'", "\\'")) for k, v in properties.items())
        self.spark.sql(f"ALTER TABLE {self._name(collection)} SET TBLPROPERTIES ({quoted_})")

    def _written(self, df: DataFrame, name: str, mode: str) -> None:
        if "_id" not in df.columns:
            df = df.withColumn("_id", F.substring(F.sha2(F.expr("uuid()"), 256), 1, 24))
        if mode == "append" and self.exists(name):
            old = self.read(name)
            kept = old.join(df.select("_id"), "_id", "left_anti")
            self._rewrite(name, kept.unionByName(df, allowMissingColumns=True))
        elif self.exists(name):
            self._rewrite(name, df)
        else:
            self._insert(name, df)
