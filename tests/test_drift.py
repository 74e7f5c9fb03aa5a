"""Scenarios end to end: raw predictions, statistics documents, analysis."""

import drift_data as D
import pytest
from pyspark.sql import functions as F

from tidemark.operators.paths import QueryError
from tidemark.plans import drift
from tidemark.plans.periods import Selection, Windows, match, periods


def analyse(spark, rows, images=(), days=7, task="cls", start=0, reference=(), now=100, detail="full", **selection):
    docs = D.documents(spark, rows, images, task=task)
    windows = Windows.of(D.day(start), D.day(days), *[D.day(x) for x in reference])
    return drift.analyse(docs, Selection("m", "1", **selection), windows, "daily", detail, now=D.day(now))


def test_a_confidence_step(spark):
    rows, _ = D.raw([0.93] * 4 + [0.84] * 3, products=3)
    r = analyse(spark, rows, now=6.5)
    assert r["flags"] == ["CONFIDENCE_SHIFT", "THRESHOLD_PRESSURE"] and r["preVerdict"] == "drift_likely"
    assert r["changePoint"]["periodIndex"] == 4 and r["changePoint"]["candidateCount"] == 4
    psi = [c["psiConfidence"] for c in r["consecutive"]]
    assert psi[3] > 0.25 and all(p < 0.10 for i, p in enumerate(psi) if i != 3)
    assert r["dataQuality"]["documentCount"] == 21 and r["dataQuality"]["productCount"] == 3
    assert r["periods"][0]["medianSource"] == "histogram" and r["periods"][0]["predictionCount"] == 600
    assert r["dataQuality"]["partialPeriods"] == [r["periods"][6]["startDate"]]
    cp = r["changePoint"]
    assert cp["beforeCount"] + cp["afterCount"] == 4200 and cp["psiConfidence"] == round(cp["psiConfidence"], 4)


def test_steady_and_compact(spark):
    r = analyse(spark, D.raw([0.93] * 6)[0], days=6, detail="compact")
    assert r["flags"] == [] and r["preVerdict"] == "stable" and "perClass" not in r["periods"][0]
    assert r["changePoint"]["before"]["confidenceHistogram"] and r["periods"][0]["medianSource"] == "exact"


def test_too_little(spark):
    r = analyse(spark, D.raw([0.93] * 3)[0], days=3)
    assert r["flags"] == ["INSUFFICIENT_PERIODS"] and r["preVerdict"] == "undetermined" and len(r["consecutive"]) == 2
    r = analyse(spark, D.raw([0.93] * 4 + [0.84] * 3, n=40)[0])
    assert r["flags"] == ["INSUFFICIENT_DATA"] and not r["changePoint"]["sidesSufficient"]


def test_class_shift(spark):
    r = analyse(spark, D.raw([0.93] * 6, share=[0.02] * 3 + [0.3] * 3)[0], days=6)
    assert "CLASS_SHIFT" in r["flags"] and r["changePoint"]["periodIndex"] == 3 and r["changePoint"]["maxClassProportionChange"] > 0.2


def test_comparison(spark):
    rows = D.raw([0.93] * 3)[0] + D.raw([0.84] * 3, first=3, seed=12)[0]
    r = analyse(spark, rows, days=6, start=3, reference=(0, 3))
    assert r["analysisMode"] == "comparison" and r["comparison"]["candidateCount"] == 1 and r["preVerdict"] == "drift_likely"
    assert r["comparison"]["date"] == D.day(3) and len(r["consecutive"]) == 5 and r["changePoint"] is None
    r = analyse(spark, D.raw([0.93] * 3, first=3)[0], days=6, start=3, reference=(0, 3))
    assert r["comparison"] is None and r["flags"] == ["INSUFFICIENT_DATA"]


def test_boxes(spark):
    rows, images = D.raw([0.93] * 6, task="det", boxes=[1, 1, 1, 3, 3, 3], n=320)
    r = analyse(spark, rows, images, days=6, task="det")
    assert "BOX_COUNT_SHIFT" in r["flags"] and r["changePoint"]["periodIndex"] == 3 and r["periods"][0]["meanBoxesPerImage"] >= 1


def test_breaks(spark):
    rows, _ = D.raw([0.93] * 6, backend=list("aabbbb"), threshold=[0.8] * 4 + [0.9] * 2)
    r = analyse(spark, rows, days=6)
    kinds = [(b["kind"], b["className"], b["from"], b["to"]) for b in r["hardBreaks"]]
    assert kinds == [("backend", None, "a", "b"), ("threshold", "ng", 0.8, 0.9), ("threshold", "ok", 0.8, 0.9)]
    assert "HARD_BREAK" in r["flags"]


def test_one_equipment(spark):
    r = analyse(spark, D.raw([0.93] * 4)[0], days=4, equipment_id="e1")
    assert r["dataQuality"]["predictionCount"] == 1200 and r["sitesSeen"]["equipmentIds"] == ["e1"]
    rows = [x for x in D.raw([0.93] * 4)[0] if x[8] != "e1" or x[7] < D.day(3)]
    assert len(analyse(spark, rows, days=4, equipment_id="e1")["dataQuality"]["periodsMissingEquipment"]) == 1
    with pytest.raises(QueryError):  # no period has a document of it
        analyse(spark, rows, days=4, equipment_id="e9")


def test_a_filter_on_a_field_that_no_document_has_matches_none(spark):
    docs = D.documents(spark, D.raw([0.93] * 2)[0], []).drop("mode")
    windows = Windows.of(D.day(0), D.day(2))
    assert match(docs, Selection("m", "1"), windows, "daily").count() == 2
    assert match(docs, Selection("m", "1", mode="production"), windows, "daily").count() == 0


def test_two_models_on_one_image(spark):
    key = lambda v: ("m", v, "det", "production", "g", None, "p0")
    box = lambda v: (*key(v), D.day(0), "e0", 1, "ok", 0.9, 0.8, 0.1, "a", 1)
    docs = D.documents(spark, [box("1"), *[box("2")] * 4], [(*key(v), D.day(0), "e0", 1, 0.1, "a") for v in ("1", "2")], task="det")
    sums = {r["modelVersion"]: r["total"]["images"]["boxesPerImage"]["sum"] for r in docs.collect()}
    assert sums == {"1": 1, "2": 4}


def test_an_empty_list_of_edges_counts_as_none(spark):
    docs = D.documents(spark, D.raw([0.93], products=2)[0], [])
    bare = docs.withColumn("bins", F.when(F.col("productId") == "p0", F.col("bins").withField("confidenceEdges", F.array().cast("array<double>"))).otherwise(F.col("bins")))
    row = periods(match(bare, Selection("m", "1"), Windows.of(D.day(0), D.day(1)), "daily"), Selection("m", "1")).first()
    assert row["edge_sets"] == 1 and sum(row["confidence"]["histogram"]) == 600


def test_errors(spark):
    rows = D.raw([0.93])[0]
    with pytest.raises(QueryError):
        analyse(spark, rows, task="cls", mode="other")
    for bad in ((3, 1), (0, 500), (0, 7, 1, None), (5, 7, 3, 6), (5, 7, 3, 2)):
        with pytest.raises(QueryError):
            Windows.of(*[None if x is None else D.day(x) for x in bad])


@pytest.mark.parametrize("days, want", [(1, "hourly"), (2.5, "hourly"), (3, "shift"), (30, "shift"), (31, "daily"), (60, "daily"), (61, "weekly"), (400, "weekly")])
def test_auto_granularity(days, want):
    assert Windows.of(D.day(0), D.day(days)).granularity() == want
