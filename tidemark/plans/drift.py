"""Drift analysis over periods: series, divergences, change point, breaks, flags, verdict (I*, K*, L*, M*, N*)."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from datetime import datetime, timezone
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats
from ..operators.paths import QueryError, to_utc
from ..session import stored
from .periods import DETAILS, TASKS, Selection, Windows, match, periods, sides


@dataclass(frozen=True)
class Config:
    """Thresholds, echoed in every result."""

    max_total_days: int = 400
    max_periods: int = 60
    min_side_records_cls: int = 500
    min_side_records_det: int = 300
    min_side_boxes: int = 300
    min_periods_changepoint: int = 4
    min_segment_periods: int = 2
    eps: float = 1e-4
    psi_moderate: float = 0.10
    psi_significant: float = 0.25
    chi2_p: float = 0.001
    class_prop_change: float = 0.05
    threshold_pressure_ratio: float = 2.0
    threshold_pressure_abs: float = 0.02
    decimals: int = 4


# Flags in the order they are given, and what each says by itself.
FLAGS = ("INSUFFICIENT_DATA", "INSUFFICIENT_PERIODS", "INCOMPATIBLE_BINS", "HARD_BREAK", "CONFIDENCE_SHIFT",
         "CONFIDENCE_SHIFT_MODERATE", "CLASS_SHIFT", "CLASS_SHIFT_MODERATE", "BOX_COUNT_SHIFT", "THRESHOLD_PRESSURE")
UNDETERMINED, LIKELY = FLAGS[:3], ("CONFIDENCE_SHIFT", "CLASS_SHIFT", "BOX_COUNT_SHIFT")


def ordered(rows: DataFrame) -> DataFrame:
    """Periods with documents, numbered: the reference first, then by start. There are few periods."""
    w = Window.orderBy(F.col("window") == "current", "startDate")
    return rows.where("documents > 0").withColumn("idx", F.row_number().over(w) - 1)


def class_shares(counts: Column, classes: Column) -> Column:
    """Map of every class to its share; zeros if nothing was counted."""
    known = F.array_union(classes, F.map_keys(counts))
    return stats.let(stats.total(F.map_values(counts)), lambda n: F.map_from_entries(F.transform(known, lambda k: F.struct(k, F.when(
        n > 0, F.coalesce(F.try_element_at(counts, k), F.lit(0)) / n).otherwise(F.lit(0.0))))))


def summarised(rows: DataFrame, task: str, classes: list[str], edges: list[float] | None, now: datetime, detail: str = "full") -> DataFrame:
    """The measures of periods or sides."""
    c, det = F.col("confidence"), task == "det"
    known = F.array(*[F.lit(x) for x in classes]).cast("array<string>")
    bounds = F.array(*[F.lit(float(e)) for e in edges or []]).cast("array<double>")

    def median(conf):
        exact = conf["quantiles"]["p50"]
        guess = stats.histogram_quantile(conf["histogram"], bounds, 0.5)
        return F.coalesce(exact, guess), F.when(exact.isNotNull(), "exact").when(guess.isNotNull(), "histogram")

    m, source = median(c)
    images = (F.col("predictions") > 0) & F.col("has_images") if det else F.lit(False)
    measures = {
        "partial": F.col("endDate") > F.lit(to_utc(now)), "box_count": F.col("boxes") if det else F.lit(None).cast("long"),
        "class_distribution": class_shares(F.col("class_counts"), known), "mean_confidence": stats.mean(c["sum"], c["count"]),
        "std_confidence": stats.std(c["sum"], c["sumSq"], c["count"]), "median_confidence": m, "median_source": source,
        "below_threshold_rate": stats.rate(c["belowThresholdCount"], c["count"]), "near_threshold_rate": stats.rate(c["nearThresholdCount"], c["count"]),
        "mean_boxes_per_image": F.when(images, F.try_divide(F.col("boxes_sum").cast("double"), F.col("predictions"))),
        "no_box_rate": F.when(images, stats.rate(F.col("no_box"), F.col("predictions"))),
        "mean_elapsed_time": stats.mean(F.col("elapsed_sum"), F.col("elapsed_count")),
        "thresholds_by_class": F.transform_values("per_class", lambda _, v: v["thresholds"]),
        "confidence_histogram": stats.histogram_shares(c["histogram"]), "boxes_per_image_histogram": stats.histogram_shares(F.col("boxes_histogram")),
    }

    def one(k):
        v = F.try_element_at(F.col("per_class"), k)
        count = F.coalesce(F.try_element_at(F.col("class_counts"), k), v["count"], F.lit(0).cast("long"))
        middle, said = median(v)
        return F.struct(count.alias("count"), stats.mean(v["sum"], v["count"]).alias("mean_confidence"), middle.alias("median_confidence"),
                        said.alias("median_source"), stats.std(v["sum"], v["sumSq"], v["count"]).alias("std_confidence"),
                        stats.rate(v["belowThresholdCount"], v["count"]).alias("below_threshold_rate"),
                        stats.rate(v["nearThresholdCount"], v["count"]).alias("near_threshold_rate"),
                        F.when(F.size(v["thresholds"]) == 1, F.get(v["thresholds"], F.lit(0))).alias("threshold"),
                        (stats.histogram_shares(v["histogram"]) if detail == "full" else F.lit(None).cast("array<double>")).alias("confidence_histogram"))

    everyone = F.array_union(known, F.array_union(F.map_keys("class_counts"), F.map_keys("per_class")))
    measures["class_summary"] = F.map_from_entries(F.transform(everyone, lambda k: F.struct(k, one(k))))
    return rows.withColumns(measures)


def sufficient(config: Config, task: str, a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Enough predictions on both sides; for detection images and boxes (K1)."""
    if task == "cls":
        tests = [x["predictions"] >= config.min_side_records_cls for x in (a, b)]
    else:
        tests = [t for x in (a, b) for t in (x["predictions"] >= config.min_side_records_det,
                                             F.coalesce(x["boxes"], F.lit(0)) >= config.min_side_boxes)]
    return reduce(lambda x, y: x & y, tests)


def aligned(a: Column, b: Column) -> tuple[Column, Column]:
    """Counts of two class maps over the union of their keys (K4)."""
    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    pick = lambda m: F.transform(keys, lambda k: F.coalesce(F.try_element_at(m, k), F.lit(0).cast("long")))
    return pick(a), pick(b)


def divergences(config: Config, task: str, a: Column, b: Column) -> dict[str, Column]:
    """PSI of confidence, classes and boxes per image between two period structs."""
    x, y = aligned(a["class_counts"], b["class_counts"])
    boxes = stats.psi(a["boxes_histogram"], b["boxes_histogram"], config.eps) if task == "det" else F.lit(None).cast("double")
    return {"psi_confidence": stats.psi(a["confidence"]["histogram"], b["confidence"]["histogram"], config.eps),
            "psi_class": stats.psi(x, y, config.eps), "psi_boxes_per_image": boxes}


_PAIR = ["confidence", "class_counts", "boxes_histogram", "predictions", "boxes", "edges"]


def consecutive(rows: DataFrame, config: Config, task: str) -> DataFrame:
    """Each period against the one before it, across the windows' border (L2)."""
    w = Window.orderBy("idx")
    pairs = rows.select("idx", "startDate", F.struct(*_PAIR).alias("b")).withColumn("a", F.lag("b").over(w)).where("a IS NOT NULL")
    d = divergences(config, task, F.col("a"), F.col("b"))
    same = F.col("a.edges").eqNullSafe(F.col("b.edges"))
    return pairs.select(F.col("idx").alias("period_index"), F.col("startDate").alias("date"), F.when(same, d["psi_confidence"]).alias("psi_confidence"),
                        d["psi_class"].alias("psi_class"), d["psi_boxes_per_image"].alias("psi_boxes_per_image"),
                        sufficient(config, task, *({k: F.col(f"{s}.{k}") for k in ("predictions", "boxes")} for s in "ab")).alias("sufficient"))


def hard_breaks(rows: DataFrame) -> DataFrame:
    """Changes of backend, class list and thresholds against the last value seen (L3)."""
    shown = lambda arr: F.when(F.size(arr) == 1, F.to_json(F.array(F.get(arr, F.lit(0)))).substr(F.lit(2), F.length(F.to_json(arr)) - 2)).when(
        F.size(arr) > 1, F.to_json(arr))
    seen = rows.select("idx", "startDate", F.struct(shown(F.col("backends")).alias("v"), (F.size("backends") > 1).alias("many")).alias("backend"),
                       F.when(F.size("classes") > 0, F.to_json("classes")).alias("list"), F.map_entries("per_class").alias("p"))
    kinds = F.concat(
        F.array(F.struct(F.lit("backend").alias("kind"), F.lit(None).cast("string").alias("class_name"), F.col("backend.v").alias("v"),
                         F.col("backend.many").alias("many"), F.lit(0).alias("o")),
                F.struct(F.lit("classes").alias("kind"), F.lit(None).cast("string").alias("class_name"), F.col("list").alias("v"),
                         F.lit(False).alias("many"), F.lit(1).alias("o"))),
        F.coalesce(F.transform("p", lambda e: F.struct(
            F.lit("threshold").alias("kind"), e["key"].alias("class_name"), shown(e["value"]["thresholds"]).alias("v"),
            (F.size(e["value"]["thresholds"]) > 1).alias("many"), F.lit(2).alias("o"))),
            F.expr("CAST(array() AS array<struct<kind:string,class_name:string,v:string,many:boolean,o:int>>)")))
    each = seen.select("idx", "startDate", F.explode(kinds).alias("x")).select("idx", "startDate", "x.*").where("v IS NOT NULL")
    w = Window.partitionBy("kind", "class_name").orderBy("idx")
    each = each.withColumn("before", F.lag("v").over(w))
    broke = (F.col("before").isNotNull() & (F.col("before") != F.col("v"))) | (F.col("before").isNull() & F.col("many"))
    return each.where(broke).orderBy("idx", "o", "class_name").select("kind", "class_name", F.col("startDate").alias("date"),
                                                                    F.col("before").alias("from"), F.col("v").alias("to"))


def split_scores(rows: DataFrame, config: Config, task: str) -> DataFrame:
    """Score of every candidate split of the numbered periods.

    One running sum per counter; what comes after is the total less what came before, so the
    work is linear in the periods. `k` periods lie before the split.
    """
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.map_keys("class_counts")))))
    keys = rows.agg(names.alias("keys"))
    flat = rows.join(F.broadcast(keys)).select("idx", F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), v.alias("v")) for d, v in (
        ("confidence", F.col("confidence.histogram")),
        ("class", F.transform("keys", lambda k: F.coalesce(F.try_element_at("class_counts", k), F.lit(0).cast("long")))),
        ("boxes", F.coalesce("boxes_histogram", F.array().cast("array<bigint>"))),
        ("predictions", F.array(F.col("predictions"))), ("box_count", F.array(F.coalesce("boxes", F.lit(0).cast("long")))))])).alias("x"))
    cells = flat.select("idx", "x.dim", F.posexplode("x.v").alias("pos", "n"))
    w = Window.partitionBy("dim", "pos")
    cells = cells.withColumn("a", F.coalesce(F.sum("n").over(w.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cells = cells.withColumn("b", F.sum("n").over(w) - F.col("a"))
    arrays = cells.groupBy("idx", "dim").agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b"))).alias("x"))
    wide = arrays.groupBy("idx").pivot("dim", ["confidence", "class", "boxes", "predictions", "box_count"]).agg(F.first("x"))
    n = rows.agg((F.max("idx") - F.min("idx") + 1).alias("n"), F.min("idx").alias("first"))
    wide = wide.join(F.broadcast(n)).withColumn("k", F.col("idx") - F.col("first"))
    wide = wide.where((F.col("k") >= config.min_segment_periods) & (F.col("k") <= F.col("n") - config.min_segment_periods))
    side = lambda d, s: F.coalesce(F.transform(F.col(d), lambda x: x[s]), F.array().cast("array<bigint>"))
    dims = ["confidence", "class"] + ["boxes"] * (task == "det")
    each = {d: stats.psi(side(d, "a"), side(d, "b"), config.eps) for d in dims}
    score = reduce(lambda x, y: x + y, [F.coalesce(v, F.lit(0.0)) for v in each.values()])
    enough = sufficient(config, task, *({"predictions": F.get(side("predictions", s), F.lit(0)), "boxes": F.get(side("box_count", s), F.lit(0))} for s in "ab"))
    return wide.select("idx", "k", score.alias("score"), enough.alias("sufficient"), *[v.alias(f"psi_{d}") for d, v in each.items()])


def best_split(rows: DataFrame, config: Config, task: str) -> int | None:
    """Sufficient splits before others, then the highest score, then the earliest."""
    top = split_scores(rows, config, task).orderBy(F.desc("sufficient"), F.desc("score"), "idx").limit(1).collect()
    return top[0]["idx"] if top else None


def compared(pair: DataFrame, config: Config, task: str, candidates: int = 1) -> DataFrame:
    """One row from the sides `before` and `after` (summarised): the report's numbers (K8, K9)."""
    whole = [c for c in pair.columns if c != "side"]
    row = pair.groupBy().agg(*[F.max_by(F.struct(*whole), F.col("side") == s).alias(s[0]) for s in ("before", "after")],
                             F.count("*").alias("sides")).where("sides = 2").withColumnsRenamed({"b": "p", "a": "q"})
    p, q = F.col("p"), F.col("q")
    d = divergences(config, task, p, q)
    x, y = aligned(p["class_counts"], q["class_counts"])
    both = (stats.total(x) > 0) & (stats.total(y) > 0)
    chi = stats.chi2_statistic(x, y)
    row = row.withColumn("chi", chi)
    survival = F.least(stats.chi2_survival(F.col("chi.stat"), F.col("chi.dof")) * candidates, F.lit(1.0))
    change = F.array_max(F.zip_with(stats.proportions(x), stats.proportions(y), lambda a, b: F.abs(a - b)))
    names = F.array_union(F.map_keys(p["per_class"]), F.map_keys(q["per_class"]))
    hist = lambda s, k: F.coalesce(F.try_element_at(s["per_class"], k)["histogram"], F.array().cast("array<bigint>"))
    by_class = F.map_from_entries(F.transform(names, lambda k: F.struct(k, stats.psi(hist(p, k), hist(q, k), config.eps))))
    score = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in d.values()])
    return row.select(
        score.alias("score"), p["predictions"].alias("before_count"), q["predictions"].alias("after_count"),
        sufficient(config, task, *({k: s[k] for k in ("predictions", "boxes")} for s in (p, q))).alias("sides_sufficient"),
        *[v.alias(k) for k, v in d.items()], stats.js(p["confidence"]["histogram"], q["confidence"]["histogram"], config.eps).alias("js_confidence"),
        by_class.alias("psi_confidence_by_class"),
        F.when(both, F.struct(F.col("chi.stat").alias("stat"), survival.alias("p"), F.col("chi.dof").alias("dof"))).alias("chi2_class"),
        F.when(both, change).alias("max_class_proportion_change"),
        stats.delta(p["mean_confidence"], q["mean_confidence"]).alias("mean_confidence_delta"),
        stats.delta(p["below_threshold_rate"], q["below_threshold_rate"]).alias("below_threshold_rate_delta"),
        stats.ratio(p["mean_elapsed_time"], q["mean_elapsed_time"]).alias("elapsed_time_ratio"),
        p["below_threshold_rate"].alias("below_before"), q["below_threshold_rate"].alias("below_after"), p.alias("before"), q.alias("after"))


def flags(config: Config, split: Column, breaks: Column, no_data: Column, no_periods: Column, bins: Column) -> Column:
    """Flags in their fixed order from a split struct (or null) and the conditions (M1-M9)."""
    ok = F.coalesce(split["sides_sufficient"], F.lit(False))
    conf, cls, boxes = split["psi_confidence"], split["psi_class"], split["psi_boxes_per_image"]
    big = (cls >= config.psi_significant) | ((split["chi2_class"]["p"] < config.chi2_p) & (
        split["max_class_proportion_change"] >= config.class_prop_change))
    big = F.coalesce(cls.isNotNull() & big, F.lit(False))
    low, high = split["below_before"], split["below_after"]
    pressure = (high >= config.threshold_pressure_ratio * low) & (high - low >= config.threshold_pressure_abs)
    tests = [no_data, no_periods, bins, breaks, ok & (conf >= config.psi_significant),
             ok & (conf < config.psi_significant) & (conf >= config.psi_moderate), ok & big, ok & ~big & (cls >= config.psi_moderate),
             ok & (boxes >= config.psi_significant), ok & pressure]
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for t, n in zip(tests, FLAGS)]))


def pre_verdict(found: Column) -> Column:
    """The gravest of what the flags say."""
    any_of = lambda names: F.arrays_overlap(found, F.array(*[F.lit(n) for n in names]))
    return F.when(any_of(UNDETERMINED), "undetermined").when(any_of(LIKELY), "drift_likely").when(F.size(found) > 0, "suspicious").otherwise("stable")


def rounded(value: Any, decimals: int) -> Any:
    """Floats to `decimals`, as a float rounds; presentation only."""
    if isinstance(value, float):
        return round(value, decimals)
    if isinstance(value, dict):
        return {k: rounded(v, decimals) for k, v in value.items()}
    return [rounded(v, decimals) for v in value] if isinstance(value, (list, tuple)) else value


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.title() for w in rest)


_SIDE = ("start_date end_date period_count document_count prediction_count box_count class_distribution mean_confidence "
         "median_confidence below_threshold_rate near_threshold_rate mean_boxes_per_image no_box_rate mean_elapsed_time "
         "confidence_histogram boxes_per_image_histogram per_class").split()
_PERIOD = ("start_date end_date window partial document_count product_count inspection_count prediction_count box_count class_distribution "
           "mean_confidence std_confidence median_confidence median_source below_threshold_rate near_threshold_rate mean_boxes_per_image "
           "no_box_rate mean_elapsed_time backends thresholds_by_class").split()
_FROM = {"start_date": "startDate", "end_date": "endDate", "period_count": "members", "document_count": "documents", "prediction_count": "predictions",
         "inspection_count": "inspections", "per_class": "class_summary"}


def _shown(row: dict[str, Any], names: list[str]) -> dict[str, Any]:
    out = {camel(n): row.get(_FROM.get(n, n)) for n in names}
    if "perClass" in out:
        out["perClass"] = {k: {camel(x): y for x, y in v.items()} for k, v in (out["perClass"] or {}).items()}
    return out


def _report(row: dict[str, Any], date: datetime, index: int | None, candidates: int) -> dict[str, Any]:
    keys = ("score before_count after_count sides_sufficient psi_confidence js_confidence psi_confidence_by_class psi_class chi2_class "
            "max_class_proportion_change psi_boxes_per_image mean_confidence_delta below_threshold_rate_delta elapsed_time_ratio").split()
    return {"periodIndex": index, "date": date, "candidateCount": candidates} | {camel(k): row[k] for k in keys} | {
        s: _shown(row[s], _SIDE) for s in ("before", "after")}


def analyse(docs: DataFrame, selection: Selection, windows: Windows, granularity: str = "auto", detail: str = "full",
            config: Config = Config(), now: datetime | None = None) -> dict[str, Any]:
    """The whole analysis as a camel-cased document (N1). Only period-sized rows reach the driver."""
    if selection.task is not None and selection.task not in TASKS:
        raise QueryError(f"task {selection.task!r}")
    if detail not in DETAILS:
        raise QueryError(f"detail {detail!r}")
    now = now or datetime.now(timezone.utc)
    granularity = windows.granularity(granularity, config.max_periods)
    rows = stored(periods(match(docs, selection, windows, granularity), selection), "periods")
    return _analysed(rows, selection, windows, granularity, detail, config, now)


def _analysed(rows: DataFrame, selection, windows, granularity, detail, config, now) -> dict[str, Any]:
    brief = rows.select("window", "startDate", "documents", "tasks").collect()
    if not any(r["documents"] for r in brief):
        raise QueryError("no statistics documents match")
    tasks = sorted({t for r in brief for t in r["tasks"] or [] if t})
    if selection.task is None and len(tasks) > 1:
        raise QueryError(f"several tasks match: {tasks}")
    task = selection.task or tasks[0]
    numbered = ordered(rows)
    facts = [r.asDict(True) for r in numbered.orderBy("idx").collect()]
    edge_sets: list[list[float]] = []
    for r in facts:
        edge_sets += [b["confidenceEdges"] for b in r["bins"] if b["confidenceEdges"] and b["confidenceEdges"] not in edge_sets]
    bad_bins = len(edge_sets) > 1
    classes = list(dict.fromkeys(c for r in facts for c in (*(r["classes"] or []), *(r["class_counts"] or {}), *(r["per_class"] or {}))))
    current = [r for r in facts if r["window"] == "current"]
    reference = [r for r in facts if r["window"] == "reference"]
    edges = edge_sets[0] if edge_sets else None
    summarise = lambda df: summarised(df, task, classes, edges, now, detail)
    report, index, candidates, date = None, None, 1, None
    if windows.comparison:
        if current and reference and not bad_bins:
            date, side = windows.start, F.when(F.col("window") == "reference", "before").otherwise("after")
            report = compared(summarise(sides(numbered, side)), config, task)
        few_periods = False
    else:
        few_periods = len(current) < config.min_periods_changepoint
        if not few_periods and not bad_bins:
            index = best_split(numbered, config, task)
            few_periods = index is None
            if index is not None:
                date, candidates = current[index]["startDate"], max(len(current) - 2 * config.min_segment_periods + 1, 1)
                report = compared(summarise(sides(numbered, F.when(F.col("idx") < index, "before").otherwise("after"))), config, task, candidates)
    found = report.first() if report is not None else None
    breaks = [r.asDict() for r in hard_breaks(numbered).collect()]
    least = config.min_side_records_cls if task == "cls" else config.min_side_records_det
    enough = found is not None and found["sides_sufficient"]
    no_data = not enough if windows.comparison else sum(r["predictions"] for r in current) < least or (found is not None and not enough)
    spark = rows.sparkSession
    frame = report if report is not None else compared(summarise(sides(numbered, F.lit(None).cast("string"))), config, task)
    base = frame.select(F.struct("*").alias("s"))
    if found is None:
        base = spark.createDataFrame([(None,)], T.StructType([T.StructField("s", base.schema[0].dataType, True)]))
    named = base.select(flags(config, F.col("s"), F.lit(bool(breaks)), F.lit(no_data), F.lit(few_periods), F.lit(bad_bins)).alias("f"))
    verdict = named.select("f", pre_verdict(F.col("f")).alias("v")).first()
    shown = [r.asDict(True) for r in summarise(numbered).orderBy("idx").collect()]
    near = [r.asDict() for r in consecutive(numbered, config, task).orderBy("period_index").collect()]
    union = lambda name: list(dict.fromkeys(x for r in facts for x in r[name] or [] if x is not None))
    add = lambda name: sum(r[name] or 0 for r in facts)
    bins = next((b for r in facts for b in r["bins"]), {})
    said = _report(found.asDict(True), date, index, candidates) if found is not None else None
    extra = ["confidence_histogram", "boxes_per_image_histogram", "per_class"]
    result = {
        "modelName": selection.model_name, "modelVersion": selection.model_version, "task": task, "mode": selection.mode,
        "analysisMode": "comparison" if windows.comparison else "range",
        "filters": {camel(k): getattr(selection, k) for k in ("gbm", "process", "equipment_id", "product_id")},
        "sitesSeen": {"gbms": union("gbms"), "processes": union("processes"), "modes": union("modes"),
                      "equipmentIds": [selection.equipment_id] if selection.equipment_id else union("equipment_ids")},
        "granularity": granularity, "detail": detail,
        "range": {"startDate": windows.start, "endDate": windows.end, "days": (windows.end - windows.start).total_seconds() / 86400},
        "referenceRange": {"startDate": windows.reference_start, "endDate": windows.reference_end,
                           "days": (windows.reference_end - windows.reference_start).total_seconds() / 86400} if windows.comparison else None,
        "status": {"analysisPossible": bool(enough), "splitRan": said is not None and not windows.comparison,
                   "comparisonRan": said is not None and windows.comparison, "periodCount": len(current), "referencePeriodCount": len(reference)},
        "dataQuality": {"documentCount": add("documents"), "productCount": len(union("product_ids")), "inspectionCount": add("inspections"),
                        "predictionCount": add("predictions"), "boxCount": add("boxes") if task == "det" else None,
                        "missingConfidenceCount": add("missing_confidence"), "parseErrorCount": add("parse_errors"),
                        "partialPeriods": [r["startDate"] for r in shown if r["partial"]],
                        "periodsMissingEquipment": sorted(r["startDate"] for r in brief if not r["documents"]), "incompatibleBins": bad_bins},
        "classes": classes,
        "bins": {"confidenceEdges": bins.get("confidenceEdges") or [], "nearThresholdMargin": bins.get("nearThresholdMargin"),
                 "boxesPerImageMax": bins.get("boxesPerImageMax")},
        "periods": [_shown(r, _PERIOD + (extra if detail == "full" else [])) | (
            {"confidenceQuantiles": (r["confidence"] or {}).get("quantiles")} if detail == "full" else {}) for r in shown],
        "consecutive": [{camel(k): v for k, v in r.items()} for r in near],
        "changePoint": None if windows.comparison else said, "comparison": said if windows.comparison else None,
        "hardBreaks": [{"kind": b["kind"], "className": b["class_name"], "date": b["date"], "from": json.loads(b["from"]) if b["from"] else None,
                        "to": json.loads(b["to"])} for b in breaks],
        "flags": list(verdict["f"]), "preVerdict": verdict["v"], "config": asdict(config),
    }
    return rounded(result, config.decimals)
