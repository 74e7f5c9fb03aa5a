"""Domain finders: filters composed from typed arguments, rows held to a schema."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame

from ..operators.paths import QueryError, normalised_regex, to_utc
from .store import DEFAULT_LIMIT, Store

# Collections and their documents' fields.
DAILY_MODELS, DATASETS, SUMMARIES = "dailyModels", "datasets", "inspectionsSummary"
INSPECTIONS, STATISTICS = "inspections", "inspectionStatistics"
MODEL_FIELDS = "_id modelName modelVersion process task gbm mode date".split()
SUMMARY_FIELDS = ("_id modelName modelVersion gbm process mode date location equipmentId productId localTimezone inspectionIds "
                  "task classes threshold statistics samples").split()
SUMMARY_REQUIRED = "modelName modelVersion gbm process mode date".split()
FAMILY_FIELDS = "_id datasetFamilyName task members accessControl createdAt".split()
DATASET_FIELDS = ("_id name version task description createdBy projects accessControl familyId schemaVersion createdAt modifiedAt "
                  "isFinalized finalizedAt isUsed downloadCount downloadUri dataCount classes trainingRecords").split()
DATASET_HEAVY = ["dataMap", "lastJob"]


def date_range(start: datetime | None, end: datetime | None) -> dict[str, Any]:
    """Both ends belong to the range."""
    return {op: to_utc(v) for op, v in (("$gte", start), ("$lte", end)) if v is not None}


def exclude_fields(projection: dict[str, Any] | None, excluded: list[str]) -> dict[str, Any]:
    """The projection without `excluded` fields."""
    projection = dict(projection or {})
    named = {k: v for k, v in projection.items() if k != "_id"}
    if not named or not any(named.values()):
        return projection | dict.fromkeys(excluded, 0)
    kept = {k: v for k, v in projection.items() if k.split(".")[0] not in excluded}
    if not any(k != "_id" for k in kept):
        return {k: v for k, v in kept.items() if not v} | dict.fromkeys(excluded, 0)
    return kept


def compose(exact: dict[str, Any], like: dict[str, str | None], dates: tuple[str, datetime | None, datetime | None]) -> dict[str, Any]:
    """An empty or missing argument is no filter."""
    query: dict[str, Any] = {k: normalised_regex(v) for k, v in like.items() if v}
    query |= {k: v for k, v in exact.items() if v}
    if between := date_range(dates[1], dates[2]):
        query[dates[0]] = between
    return query


class Finders:
    def __init__(self, store: Store):
        self.store = store

    def _rows(self, collection, query, fields, required, projection, limit, sort_field, sort_order) -> list[dict[str, Any]]:
        df = self.frame(collection, query, projection, limit, sort_field, sort_order)
        missing = [f for f in required if f not in df.columns]
        if missing:
            raise QueryError(f"{collection}: fields {missing} are required")
        known = df.select(*[c for c in df.columns if c in fields])
        rows = [r.asDict(True) for r in known.collect()]
        for r in rows:
            lacking = [f for f in required if r[f] is None]
            if lacking:
                raise QueryError(f"{collection}: fields {lacking} are required in {r.get('_id')}")
        return rows

    def frame(self, collection, query, projection=None, limit: int | None = DEFAULT_LIMIT, sort_field=None, sort_order=1) -> DataFrame:
        return self.store.find_frame(collection, query, projection, limit, sort_field, sort_order)

    def find_models(self, model_name=None, model_version=None, gbm=None, task=None, mode=None, process=None, start_date=None,
                    end_date=None, projection=None, limit=DEFAULT_LIMIT, sort_field=None, sort_order=1) -> list[dict[str, Any]]:
        query = compose({"gbm": gbm, "task": task, "mode": mode},
                        {"modelName": model_name, "modelVersion": model_version, "process": process}, ("date", start_date, end_date))
        return self._rows(DAILY_MODELS, query, MODEL_FIELDS, MODEL_FIELDS[1:], projection, limit, sort_field, sort_order)

    def find_summaries(self, model_name=None, model_version=None, gbm=None, task=None, mode=None, process=None, location=None,
                       equipment_id=None, product_id=None, start_date=None, end_date=None, projection=None, limit=DEFAULT_LIMIT,
                       sort_field=None, sort_order=1) -> list[dict[str, Any]]:
        """Samples come only where the projection asks for them."""
        query = compose({"gbm": gbm, "task": task, "mode": mode, "location": location, "equipmentId": equipment_id, "productId": product_id},
                        {"modelName": model_name, "modelVersion": model_version, "process": process}, ("date", start_date, end_date))
        projection = {"samples": 0} if projection is None else projection
        required = [f for f in SUMMARY_REQUIRED if not projection or not any(projection.values()) or f in projection]
        return self._rows(SUMMARIES, query, SUMMARY_FIELDS, required, projection, limit, sort_field, sort_order)

    def find_families(self, dataset_family_name=None, task=None, start_date=None, end_date=None, projection=None, limit=DEFAULT_LIMIT,
                      sort_field=None, sort_order=1) -> list[dict[str, Any]]:
        """A name replaces the condition that the document is a family."""
        query = {"datasetFamilyName": {"$exists": True}} | compose(
            {"task": task}, {"datasetFamilyName": dataset_family_name}, ("createdAt", start_date, end_date))
        return self._rows(DATASETS, query, FAMILY_FIELDS, ["datasetFamilyName"], projection, limit, sort_field, sort_order)

    def find_datasets(self, name=None, version=None, task=None, created_by=None, is_finalized=None, is_used=None, start_date=None,
                      end_date=None, projection=None, limit=DEFAULT_LIMIT, sort_field=None, sort_order=1) -> list[dict[str, Any]]:
        query = {"schemaVersion": {"$exists": True}} | compose(
            {"task": task}, {"name": name, "version": version, "createdBy": created_by}, ("createdAt", start_date, end_date))
        query |= {k: v for k, v in (("isFinalized", is_finalized), ("isUsed", is_used)) if v is not None}
        return self._rows(DATASETS, query, DATASET_FIELDS, [], exclude_fields(projection, DATASET_HEAVY), limit, sort_field, sort_order)
