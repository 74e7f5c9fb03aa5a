from datetime import datetime

import pytest

from tidemark.api import Api
from tidemark.operators.paths import QueryError, normalised_regex
from tidemark.operators.pipeline import Pipeline
from tidemark.operators.predicates import compile_filter
from tidemark.sources.finders import Finders, exclude_fields
from tidemark.sources.store import CollectionError, Store


@pytest.fixture
def store(spark, tmp_path, request):
    name = "t_" + "".join(c if c.isalnum() else "_" for c in request.node.name)[:40].lower()
    made = Store(spark, str(tmp_path), name)
    yield made
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def names(store, query):
    return sorted(d["name"] for d in store.find("c", query, limit=100))


ROWS = [{"_id": "a" * 24, "name": "ann", "n": 1, "tags": ["x", "y"], "at": datetime(2024, 1, 1), "sub": {"k": 1}},
        {"_id": "b" * 24, "name": "bob", "n": 5, "tags": ["y"], "at": datetime(2024, 2, 1), "sub": {"k": 2}},
        {"_id": "c" * 24, "name": "cäd", "n": None, "tags": None, "at": None, "sub": None}]


def test_find(store):
    store.insert_many("c", ROWS)
    assert names(store, {"tags": "y"}) == ["ann", "bob"]
    assert names(store, {"n": {"$ne": 5}}) == ["ann", "cäd"] and names(store, {"n": None}) == ["cäd"]
    assert names(store, {"n": {"$not": {"$gt": 3}}}) == ["ann", "cäd"] and names(store, {"n": {"$exists": False}}) == ["cäd"]
    assert names(store, {"at": {"$gte": "2024-01-15 00:00:00"}}) == ["bob"] and names(store, {"sub.k": 1}) == ["ann"]
    assert names(store, {"tags": {"$all": ["x", "y"]}}) == ["ann"] and names(store, {"tags": ["y"]}) == ["bob"]
    assert names(store, {"name": normalised_regex("C Ä")}) == ["cäd"] and names(store, {"$or": [{"n": 1}, {"name": "bob"}]}) == ["ann", "bob"]
    assert names(store, {"tags": {"$elemMatch": {"$in": ["x"]}}}) == ["ann"] and names(store, {"tags": {"$size": 1}}) == ["bob"]
    assert [d["name"] for d in store.find("c", {}, {"name": 1, "_id": 0}, 2, "n", -1)] == ["bob", "ann"]
    assert store.find("c", {"name": "ann"}, {"tags": 0, "at": 0, "sub": 0}) == [{"_id": "a" * 24, "name": "ann", "n": 1}]
    with pytest.raises(QueryError):
        store.find("c", {"n": {"$near": 1}})
    with pytest.raises(CollectionError):
        store.find("none", {})


def test_write(store):
    ids = store.insert_many("c", [{"name": "p", "n": 1}, {"name": "q", "n": 2}])
    assert all(len(i) == 24 for i in ids) and store.count("c", {}) == 2
    store.insert_one("c", {"name": "r", "n": 3, "extra": "new"})
    assert store.count("c", {"extra": "new"}) == 1
    assert store.update_many("c", {"n": {"$gte": 2}}, {"$set": {"name": "z"}, "$inc": {"n": 10}})["modified"] == 2
    assert store.update_many("c", {"name": "z"}, {"$set": {"name": "z"}})["modified"] == 0
    assert store.update_many("c", {"name": "new"}, {"$set": {"n": 7}}, upsert=True)["upserted_id"]
    assert store.find("c", {"name": "new"}, {"n": 1, "_id": 0}) == [{"n": 7}]
    assert store.replace_one("c", {"name": "p"}, {"name": "pp"})["modified"] == 1
    row = store.find("c", {"name": "pp"})[0]
    assert row["_id"] == ids[0] and row["n"] is None
    assert store.delete_many("c", {"name": "z"}) == 2 and store.count("c") == 2
    with pytest.raises(QueryError):
        store.insert_one("c", {"_id": ids[0], "name": "twice"})


def test_replacing_leaves_rows_without_id(store, spark):
    store.insert_frame("c", spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "_id string, n long"))
    assert store.replace_one("c", {"n": 1}, {"n": 9})["modified"] == 1
    assert sorted(r["n"] for r in store.read("c").collect()) == [2, 3, 9]
    with pytest.raises(QueryError):
        store.replace_one("c", {"n": 2}, {"n": 5})


def test_upserts_take_each_operator_or_raise(store):
    store.insert_many("c", [{"name": "p", "n": 1, "m": 1, "tags": ["a"]}])
    store.update_many("c", {"name": "q"}, {"$max": {"n": 7}, "$mul": {"m": 3}, "$push": {"tags": "b"}}, upsert=True)
    assert store.find("c", {"name": "q"}, {"n": 1, "m": 1, "tags": 1, "_id": 0}) == [{"n": 7, "m": 0, "tags": ["b"]}]
    with pytest.raises(QueryError):
        store.update_many("c", {"name": "r"}, {"$rename": {"n": "k"}}, upsert=True)


def test_merge_refuses_what_it_does_not_do(store):
    store.insert_many("c", [{"k": 1}])
    with pytest.raises(QueryError):
        store.aggregate("c", [{"$merge": {"into": "d", "whenMatched": "fail"}}])
    store.aggregate("c", [{"$merge": {"into": "d", "on": "_id", "whenMatched": "replace", "whenNotMatched": "insert"}}])
    assert store.count("d") == 1


def test_expressions_and_accumulators(spark):
    df = spark.createDataFrame([(1, 2.5, [1], "x", (1, None)), (1, None, [2], None, (None, 2)), (2, 3.5, None, "y", None)],
                               "k long, d double, a array<long>, s string, o struct<p: long, q: long>")
    run = lambda *stages: [r.asDict(True) for r in Pipeline().run(df, list(stages)).collect()]
    assert run({"$project": {"r": {"$round": ["$d", 0]}, "a": {"$isArray": "$a"}, "b": {"$isArray": "$d"}}}) == [
        {"r": 2.0, "a": True, "b": False}, {"r": None, "a": True, "b": False}, {"r": 4.0, "a": False, "b": False}]
    got = run({"$sort": {"d": 1}}, {"$addFields": {"t": "$s"}}, {"$project": {"k": 1, "d": 1, "t": 1, "o": 1}}, {"$match": {"k": 1}}, {"$group": {
        "_id": "$k", "all": {"$push": "$t"}, "set": {"$addToSet": "$t"}, "first": {"$first": "$d"}, "o": {"$mergeObjects": "$o"}}})
    assert got == [{"_id": 1, "all": [None, "x"], "set": ["x", None], "first": None, "o": {"p": 1, "q": 2}}]


def test_array_updates(store):
    store.insert_many("c", [{"name": "p", "tags": ["a", "b"]}])
    store.update_many("c", {}, {"$push": {"tags": "b"}})
    store.update_many("c", {}, {"$addToSet": {"tags": "a"}})
    assert store.find("c", {})[0]["tags"] == ["a", "b", "b"]
    store.update_many("c", {}, {"$pull": {"tags": "b"}, "$rename": {"name": "title"}})
    row = store.find("c", {})[0]
    assert row["tags"] == ["a"] and row["title"] == "p" and row["name"] is None
    with pytest.raises(QueryError):
        store.update_many("c", {}, {"$bit": {"n": 1}})


def test_catalog(store, spark):
    api = Api(store)
    api.create_collection("c", {"capped": True})
    assert api.list_collections() == {"collections": ["c"]} and store.database in api.list_databases()["databases"]
    with pytest.raises(CollectionError):
        api.create_collection("c")
    api.insert_document("c", {"k": 1, "v": "x"})
    api.insert_document("c", {"k": 2, "v": "y"})
    assert api.create_index("c", {"k": "descending", "v": "text"}, {"unique": True}) == {"name": "k_-1_v_text"}
    assert [i["name"] for i in api.list_indices("c")["indices"]] == ["_id_", "k_-1_v_text"]
    with pytest.raises(QueryError):
        api.insert_document("c", {"k": 2, "v": "y"})
    with pytest.raises(QueryError):
        api.drop_index("c", "_id_")
    api.update_documents("c", {"k": 1}, {"$set": {"v": "w"}})
    assert len(api.list_indices("c")["indices"]) == 2
    api.drop_index("c", "k_-1_v_text")
    stats = api.get_collection_stats("c")
    assert stats["count"] == 2 and stats["capped"] and stats["size"] > 0
    assert api.get_database_stats()["objects"] == 2
    api.rename_collection("c", "d")
    with pytest.raises(CollectionError):
        api.rename_collection("c", "e")
    assert api.count_documents("d", {}) == {"count": 2}
    api.drop_collection("d")
    api.drop_collection("d")
    assert api.ping_database() == {"ok": 1} and api.get_server_status()["version"] == spark.version


def test_aggregate_writes_and_looks_up(store):
    store.insert_many("c", [{"k": 1, "v": 2.0}, {"k": 1, "v": 3.0}, {"k": 2, "v": 4.0}])
    assert store.aggregate("c", [{"$group": {"_id": "$k", "s": {"$sum": "$v"}}}, {"$sort": {"_id": 1}}], {"allowDiskUse": True}) == [
        {"_id": 1, "s": 5.0}, {"_id": 2, "s": 4.0}]
    store.aggregate("c", [{"$group": {"_id": {"$toString": "$k"}, "s": {"$sum": "$v"}}}, {"$out": "sums"}])
    assert store.count("sums") == 2
    with pytest.raises(QueryError):
        store.aggregate("c", [{"$geoNear": {}}])


def test_finders(store):
    day = datetime(2024, 3, 1)
    model = {"modelName": "Net One", "modelVersion": "1.0", "process": "p", "task": "cls", "gbm": "g", "mode": "production", "date": day}
    store.insert_many("dailyModels", [model, model | {"modelName": "Other", "task": "det"}])
    find = Finders(store)
    assert [m["modelName"] for m in find.find_models(model_name="netone")] == ["Net One"]
    assert len(find.find_models(start_date=day, end_date=day, task="")) == 2
    with pytest.raises(QueryError):
        find.find_models(projection={"modelName": 1})
    store.insert_many("datasets", [
        {"datasetFamilyName": "fam", "task": "cls", "createdAt": day, "schemaVersion": None, "name": None, "isFinalized": None, "dataMap": None},
        {"datasetFamilyName": None, "task": "cls", "createdAt": day, "schemaVersion": "2", "name": "set", "isFinalized": False, "dataMap": "big"}])
    assert [f["datasetFamilyName"] for f in find.find_families()] == ["fam"] and find.find_families(dataset_family_name="zzz") == []
    got = find.find_datasets(is_finalized=False)
    assert [d["name"] for d in got] == ["set"] and "dataMap" not in got[0] and find.find_datasets(is_finalized=True) == []
    store.insert_many("inspectionsSummary", [{"modelName": "m", "modelVersion": "1", "gbm": "g", "process": "p", "mode": "x", "date": day, "samples": "s"}])
    assert "samples" not in find.find_summaries(model_name="M")[0] and "samples" in find.find_summaries(projection={})[0]


@pytest.mark.parametrize("given, want", [
    (None, {"h": 0}), ({}, {"h": 0}), ({"a": 0}, {"a": 0, "h": 0}), ({"a": 1, "h": 1}, {"a": 1}), ({"h": 1}, {"h": 0}), ({"h": 1, "_id": 0}, {"_id": 0, "h": 0})])
def test_exclude_fields(given, want):
    assert exclude_fields(given, ["h"]) == want


def test_filters_reach_the_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = df.where(compile_filter(df.schema, {"o_orderkey": {"$gte": 10}, "o_orderstatus": "F"})).select("o_orderkey")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "o_totalprice" not in text


def test_a_cluster_must_name_a_shared_folder():
    from types import SimpleNamespace

    from tidemark.session import LOCAL_CHECKPOINTS, shared_dir

    def session(master, named=None):
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": named}),
                               conf=SimpleNamespace(get=lambda key, default: default))

    assert shared_dir(session("local[8]")) == shared_dir(session("local")) == LOCAL_CHECKPOINTS
    assert shared_dir(session("spark://host:7077", "hdfs://nn/shared/")) == "hdfs://nn/shared"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master))
