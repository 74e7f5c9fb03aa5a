"""The 25 operations by name, over one store (T): each returns plain dictionaries."""

from __future__ import annotations

from typing import Any

from .plans import drift
from .plans.periods import Selection, Windows
from .sources.finders import STATISTICS, Finders
from .sources.store import DEFAULT_LIMIT, Store


class Api:
    def __init__(self, store: Store, config: drift.Config = drift.Config()):
        self.store, self.finders, self.config = store, Finders(store), config

    def list_databases(self):
        return {"databases": self.store.list_databases()}

    def list_collections(self):
        return {"collections": self.store.list_collections()}

    def create_collection(self, collection: str, options: dict | None = None):
        self.store.create_collection(collection, options)
        return {"collection": collection, "created": True}

    def drop_collection(self, collection: str):
        self.store.drop_collection(collection)
        return {"collection": collection, "dropped": True}

    def rename_collection(self, collection: str, new_name: str):
        self.store.rename_collection(collection, new_name)
        return {"old": collection, "new": new_name}

    def get_collection_stats(self, collection: str):
        return self.store.collection_stats(collection)

    def get_database_stats(self):
        return self.store.database_stats()

    def list_indices(self, collection: str):
        return {"indices": self.store.list_indices(collection)}

    def create_index(self, collection: str, keys: dict[str, Any], options: dict | None = None):
        return {"name": self.store.create_index(collection, keys, options)}

    def drop_index(self, collection: str, name: str):
        self.store.drop_index(collection, name)
        return {"name": name, "dropped": True}

    def get_server_status(self):
        return self.store.server_status()

    def ping_database(self):
        return self.store.ping()

    def insert_document(self, collection: str, document: dict[str, Any]):
        return {"insertedId": self.store.insert_one(collection, document)}

    def insert_many_documents(self, collection: str, documents: list[dict[str, Any]], ordered: bool = True):
        return {"insertedIds": self.store.insert_many(collection, documents, ordered)}

    def find_documents(self, collection: str, query: dict, projection: dict | None = None, limit: int = DEFAULT_LIMIT,
                       sort_field: str | None = None, sort_order: int = 1):
        return {"documents": self.store.find(collection, query, projection, limit, sort_field, sort_order)}

    def count_documents(self, collection: str, query: dict):
        return {"count": self.store.count(collection, query)}

    def update_documents(self, collection: str, query: dict, update: dict, upsert: bool = False):
        return {"modifiedCount": self.store.update_many(collection, query, update, upsert)["modified"]}

    def replace_document(self, collection: str, query: dict, document: dict, upsert: bool = False):
        return {"modifiedCount": self.store.replace_one(collection, query, document, upsert)["modified"]}

    def delete_documents(self, collection: str, query: dict):
        return {"deletedCount": self.store.delete_many(collection, query)}

    def aggregate_documents(self, collection: str, pipeline: list[dict], options: dict | None = None):
        return {"documents": self.store.aggregate(collection, pipeline, options)}

    def find_inspection_models(self, **filters):
        return {"models": self.finders.find_models(**filters)}

    def find_inspection_summary_documents(self, **filters):
        return {"summaries": self.finders.find_summaries(**filters)}

    def find_dataset_families_documents(self, **filters):
        return {"families": self.finders.find_families(**filters)}

    def find_dataset_documents(self, **filters):
        return {"datasets": self.finders.find_datasets(**filters)}

    def analyze_data_drift(self, model_name: str, model_version: str, start_date, end_date, task: str | None = None, gbm: str | None = None,
                           process: str | None = None, mode: str | None = "production", equipment_id: str | None = None,
                           product_id: str | None = None, granularity: str = "auto", detail: str = "full", reference_start_date=None,
                           reference_end_date=None, now=None):
        windows = Windows.of(start_date, end_date, reference_start_date, reference_end_date, self.config.max_total_days)
        selection = Selection(model_name, model_version, task, gbm, process, mode, equipment_id, product_id)
        return drift.analyse(self.store.read(STATISTICS), selection, windows, granularity, detail, self.config, now)
