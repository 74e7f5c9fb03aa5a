"""Raw predictions to per-period statistics documents.

Rows that agree in all that is measured are counted once; cells of (equipment, class) are made from
these counts, and the blocks of classes and of totals, of each equipment and of all, are cells added
up. What can't be added is made at every level: exact quantiles and deviations from counts of each
value in order, inspections by counting different ones. Histograms are sums of indicator columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats

# Period lengths in hours.
HOURS = {"hourly": 1, "shift": 12, "daily": 24, "weekly": 168}
#: Names of the zone in which periods are remainders, and its first Monday in microseconds.
UTC, MONDAY = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"), 4 * 86_400_000_000


def period_start(ts: Column, granularity: str) -> Column:
    """Hours, half days from midnight UTC, days, weeks from Monday.

    In a session at UTC these are remainders of microseconds; truncation asks the time zone of every row, which takes longer than reading it.
    """
    if SparkSession.active().conf.get("spark.sql.session.timeZone") in UTC:
        at = F.unix_micros(ts.cast("timestamp"))
        return F.timestamp_micros(at - F.pmod(at - F.lit(MONDAY), F.lit(HOURS[granularity] * 3_600_000_000)))
    unit = {"hourly": "hour", "daily": "day", "weekly": "week"}
    if granularity == "shift":
        day = F.date_trunc("day", ts)
        return F.when(F.hour(ts) >= 12, day + F.expr("INTERVAL 12 HOURS")).otherwise(day)
    return F.date_trunc(unit[granularity], ts)


def period_end(start: Column, granularity: str) -> Column:
    return start + F.expr(f"INTERVAL {HOURS[granularity]} HOURS")


@dataclass(frozen=True)
class Bins:
    edges: tuple[float, ...] = (0.0, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 0.98, 0.99, 1.0)
    margin: float = 0.05
    boxes_max: int = 5


#: Grouping sets of cells as (equipment kept, class kept), by `g`.
LEVELS = [(True, True), (True, False), (False, True), (False, False)]
#: Rows from which on a group's values are sought in spans first.
MANY = 5_000
#: SQL for the span of a value `v`, which never falls as v grows: 32 an octave of v, between a half and 1 an octave of 1 - v.
SPAN = """CASE WHEN v < 0 THEN -200000 WHEN v = 0 THEN -190000 WHEN v <= 0.5D THEN floor(32 * log2(v)) WHEN v < 1 THEN floor(-32 * log2(1 - v))
          WHEN v < 1e300D THEN 10000 + floor(32 * log2(v)) ELSE 200000 END"""
QUANTILES, ELAPSED = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95], [0.5, 0.9]


CONFIDENCE = ["count", "sum", "sumSq", "mean", "std", "min", "max", "quantiles", "histogram", "belowThresholdCount",
              "nearThresholdCount", "threshold"]


def flatten(inspections: DataFrame) -> DataFrame:
    """Documents to one row per prediction (classification) or per box (detection), null box for images without one."""
    r = inspections.where("NOT coalesce(isDeleted, false)").select("_id", "metadata.*", F.explode("inspectionResult.aiResults").alias("r"))
    model = F.split("r.aiModel", "/", 2)
    p = r.select(*[c for c in r.columns if c != "r"], F.get(model, F.lit(0)).alias("modelName"), F.get(model, F.lit(1)).alias("modelVersion"),
                 F.col("r.task").alias("task"), F.col("r.backend").alias("backend"), F.col("r.classes").alias("classes"),
                 F.explode("r.predictions").alias("p"))
    base = [c for c in p.columns if c != "p"]
    cls = p.where("task = 'cls'").select(*base, F.col("p.predictionId").alias("predictionId"), F.col("p.prediction").alias("class"),
                                         confidence_scalar(F.col("p.confidence")).alias("confidence"), F.col("p.threshold").alias("threshold"),
                                         F.col("p.elapsedTime").alias("elapsedTime"))
    det = p.where("task = 'det'").select(*base, F.col("p.predictionId").alias("predictionId"), F.col("p.elapsedTime").alias("elapsedTime"),
                                         F.explode_outer("p.detections").alias("d"))
    det = det.select(*base, "predictionId", F.col("d.prediction").alias("class"), F.col("d.confidence").alias("confidence"),
                     F.col("d.threshold").alias("threshold"), "elapsedTime")
    return cls.unionByName(det)


def confidence_scalar(c: Column) -> Column:
    """The number itself, or the largest of a list; text that isn't a number is null."""
    text = c.cast("string")
    listed = F.array_max(F.transform(F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ","), lambda x: x.try_cast("double")))
    return F.coalesce(text.try_cast("double"), listed)


def statistics(rows: DataFrame, keys: list[str], granularity: str, bins: Bins = Bins(), images: DataFrame | None = None) -> DataFrame:
    """Statistics documents of `rows` (keys, ts, equipment, class, confidence, threshold, elapsed, backend, inspection).

    With `images` (keys, ts, equipment, image, elapsed, backend) the rows are boxes with their
    `image`; images without a box count too.
    """
    detection = images is not None
    rows = rows.withColumn("startDate", period_start(F.col("ts"), granularity))
    by = [*keys, "startDate"]
    rows = rows.withColumn("class", F.coalesce("class", F.lit("")))
    counted = _counted(rows, by)
    cells = _same(_cells(counted, by, bins), _quantiles(counted, by), [*by, "g", "equipment", "class"])
    nothing = F.struct(*[F.lit(None).cast("double").alias(f.name) for f in cells.schema["quantiles"].dataType])
    cells = cells.withColumn("quantiles", F.coalesce("quantiles", nothing))
    conf = F.struct(*CONFIDENCE)
    by_class = (F.col("g") % 2) == 0
    level = F.floor(F.col("g") / 2) % 2  # 1: all equipment
    cells = cells.withColumn("level", level)
    elapsed = F.struct(F.col("e_n").alias("count"), F.col("e_sum").alias("sum"), F.try_divide("e_sum", "e_n").alias("mean"),
                       F.col("e_min").alias("min"), F.col("e_max").alias("max"), F.col("e_p50").alias("p50"), F.col("e_p90").alias("p90"))
    entries = F.sort_array(F.collect_list(F.when(by_class & (F.col("class") != ""), F.struct("class", conf.alias("c"), "rows"))))
    whole = lambda c: F.max(F.when(~by_class, c))
    blocks = cells.groupBy(*by, "level", "equipment").agg(
        whole(F.col("rows")).alias("rows"),
        whole(F.col("missing")).alias("missing"), F.max_by(elapsed, ~by_class).alias("elapsedTime"),
        F.max_by(conf, ~by_class).alias("confidence"), whole(F.col("backend")).alias("backend"), entries.alias("entries"))
    blocks = blocks.withColumn("classCounts", F.map_from_entries(F.transform("entries", lambda e: F.struct(e["class"], e["rows"]))))
    blocks = blocks.withColumn("perClass", F.map_from_entries(F.transform("entries", lambda e: F.struct(e["class"], e["c"])))).drop("entries")
    if detection:
        blocks = _with_images(blocks, images, rows, by, granularity, bins)
    else:
        blocks = _same(blocks, _inspections(rows, by), [*by, "level", "equipment"])
        blocks = blocks.withColumns({"inspectionCount": F.coalesce("inspectionCount", F.lit(0)), "predictionCount": F.col("rows"), "boxCount": F.lit(None).cast("long"), "images": F.lit(None).cast(
            "struct<noBoxCount:bigint,boxesPerImage:struct<sum:bigint,sumSq:bigint,max:bigint,histogram:array<bigint>>>")})
    quality = F.struct(F.col("missing").alias("missingConfidenceCount"), F.lit(0).cast("long").alias("parseErrorCount"))
    block = ["inspectionCount", "predictionCount", "boxCount", "quality", "elapsedTime", "classCounts", "confidence", "perClass", "images"]
    blocks = blocks.withColumn("quality", quality)
    equipment = F.struct(F.col("equipment").cast("string").alias("equipmentId"), "backend", *block)
    docs = blocks.groupBy(*by).agg(
        F.max_by(F.struct(*block), F.col("level")).alias("total"),
        F.array_sort(F.collect_list(F.when(F.col("level") == 0, equipment)),
                     lambda a, b: F.when(a["equipmentId"] < b["equipmentId"], -1).when(a["equipmentId"] > b["equipmentId"], 1).otherwise(0)).alias("equipments"))
    return docs.select(
        *keys, F.lit(granularity).alias("granularity"), "startDate", period_end(F.col("startDate"), granularity).alias("endDate"),
        F.sort_array(F.map_keys("total.classCounts")).alias("classes"),
        F.struct(F.array(*[F.lit(e) for e in bins.edges]).alias("confidenceEdges"), F.lit(bins.margin).alias("nearThresholdMargin"),
                 F.lit(bins.boxes_max).alias("boxesPerImageMax")).alias("bins"), "total", "equipments")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """`left` with the other columns of `right`, by keys that may be null."""
    right = right.withColumnsRenamed({c: f"_{c}" for c in keys})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    return left.join(right, same, "left").drop(*[f"_{c}" for c in keys])


def _inspections(rows: DataFrame, by: list[str]) -> DataFrame:
    """Different inspections of each equipment and of all, exactly: rows are exchanged and sorted once for both.

    Sorted by inspection, period and equipment, the first row of each is one that wasn't seen before.
    """
    w = Window.partitionBy("inspection", *by).orderBy("equipment")
    seen = rows.where("inspection IS NOT NULL").select(*by, "equipment", "inspection")
    seen = seen.select(*by, "equipment", F.row_number().over(w).alias("at"), F.rank().over(w).alias("rank"))
    seen = seen.groupBy(*by, "equipment").agg(F.count_if(F.col("at") == F.col("rank")).alias("own"), F.count_if(F.col("at") == 1).alias("first"))
    return seen.groupingSets([[F.col(c) for c in [*by, "equipment"]], [F.col(c) for c in by]], *[F.col(c) for c in [*by, "equipment"]]).agg(
        (F.grouping_id() % 2).alias("level"), F.when(F.grouping("equipment") == 0, F.sum("own")).otherwise(F.sum("first")).alias("inspectionCount"))


def _counted(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows that agree in all that is measured, counted: the only pass over the rows for cells and quantiles."""
    return rows.groupBy(*by, "equipment", "class", "backend", "threshold", "confidence", "elapsed").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


def _cells(counted: DataFrame, by: list[str], bins: Bins) -> DataFrame:
    """All but the quantiles and deviations at every level: added up from cells (equipment, class, backend), which take one hash aggregation."""
    c, t, e = F.col("confidence"), F.col("threshold"), F.col("elapsed")
    at = stats.bin_index_of(c, list(bins.edges))
    n = len(bins.edges) - 1
    many = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    sums = {"rows": F.sum("n"), "missing": many(c.isNull()), "e_n": many(e.isNotNull()), "e_sum": F.sum(e * F.col("n")), "count": many(c.isNotNull()),
            "sum": F.sum(c * F.col("n")), "sumSq": F.sum(c * c * F.col("n")), "below": many(c < t), "near": many(F.abs(c - t) < bins.margin),
            **{f"h{i}": many(c.isNotNull() & (at == i)) for i in range(n)}}
    fine = counted.groupBy(*by, "equipment", "class", "backend").agg(
        *[x.alias(name) for name, x in sums.items()], F.min(e).alias("e_min"), F.max(e).alias("e_max"), F.min(c).alias("min"),
        F.max(c).alias("max"), F.max(t.isNotNull() & c.isNotNull()).alias("judged"),
        F.max("last").alias("last"), F.max_by("threshold", "last").alias("threshold"))
    levels = [[F.col(c) for c in by] + [F.col("equipment")] * e + [F.col("class")] * k for e, k in LEVELS]
    cells = fine.groupingSets(levels, *[F.col(c) for c in [*by, "equipment", "class"]]).agg(
        F.grouping_id().cast("int").alias("g"), *[F.sum(name).alias(name) for name in sums], *[F.min(x).alias(x) for x in ("e_min", "min")],
        *[F.max(x).alias(x) for x in ("e_max", "max", "judged")], F.max_by("backend", "last").alias("backend"),
        F.max_by("threshold", "last").alias("threshold"))
    return cells.withColumns({
        **{x: F.coalesce(x, F.lit(0.0)) for x in ("e_sum", "sum", "sumSq")}, "mean": stats.mean(F.col("sum"), F.col("count")), "histogram": F.array(*[f"h{i}" for i in range(n)]),
        "belowThresholdCount": F.when(F.col("judged"), F.col("below")), "nearThresholdCount": F.when(F.col("judged"), F.col("near")),
    }).drop("judged", "below", "near", *[f"h{i}" for i in range(n)])


def _passes(asked: list[tuple[str, float]]) -> dict[str, str]:
    """SQL by name: whether the counts of a row pass the ranks below and above each quantile."""
    return {f"{name}{i}": f"(kind = '{k}' AND upto > {rank} AND upto - n <= {rank})" for i, (k, p) in enumerate(asked)
            for name, rank in (("lo", f"floor((whole - 1) * {p}D)"), ("hi", f"ceil((whole - 1) * {p}D)"))}


def _wanted(spans: DataFrame, group: list[str], asked: list[tuple[str, float]]) -> DataFrame:
    """Of each group of MANY rows or more: its rows and mean, and the spans that hold a rank that is asked for, with the rows before them."""
    spans = spans.groupBy(*group, "span").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    w = Window.partitionBy(*group).orderBy("span")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spans = spans.withColumns({"upto": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "whole": F.sum("n").over(every)})
    held = F.expr(f"CASE WHEN {' OR '.join(_passes(asked).values())} THEN struct(span, upto - n) END")
    return spans.where(F.col("whole") >= MANY).groupBy(*group).agg(
        F.max("whole").alias("known"), (F.sum("s") / F.sum("n")).alias("centre"), F.map_from_entries(F.collect_list(held)).alias("spans"))


def _quantiles(counted: DataFrame, by: list[str]) -> DataFrame:
    """Exact quantiles and deviation of confidence at every level, and quantiles of elapsed times where classes are together.

    Only values near a rank that is asked for are ranked. Counts of SPANS say which these are in a group of MANY rows
    or more, and how many rows come before them; of the other rows only the deviation is added up. Smaller groups are
    ranked whole, so there are at most 6 / MANY of the rows' number of groups in the broadcast.
    """
    double = lambda c: F.col(c).cast("double")
    kinds = F.array(F.struct(F.lit("c").alias("kind"), F.col("class"), double("confidence").alias("v")),
                    F.struct(F.lit("e").alias("kind"), F.lit(None).cast("string").alias("class"), double("elapsed").alias("v")))
    # True of every row: `last` is read here too, so that this plan and that of the cells have one aggregation of the rows, made once.
    counted = counted.where("n > 0 OR last IS NOT NULL")
    counted = counted.select(*by, "equipment", "n", F.explode(kinds).alias("x")).select(*by, "equipment", "x.*", "n").where("v IS NOT NULL")
    kept = lambda name, keep: (F.col(name) if keep else F.lit(None).cast(counted.schema[name].dataType)).alias(name)
    at = [F.struct(F.lit(g).alias("g"), kept("equipment", e), kept("class", k)) for g, (e, k) in enumerate(LEVELS)]
    levels = F.when(F.col("kind") == "c", F.array(*at)).otherwise(F.array(at[1], at[3]))
    group = [*by, "g", "equipment", "class"]
    counted = counted.withColumn("span", F.expr(SPAN))
    leveled = lambda df, *more: df.select(*by, "kind", *more, F.explode(levels).alias("x")).select(*by, "x.*", "kind", *more)
    asked = [("c", p) for p in QUANTILES] + [("e", p) for p in ELAPSED]
    wanted = _wanted(leveled(counted.groupBy(*by, "equipment", "class", "kind", "span").agg(F.sum("n").alias("n"), F.sum(F.col("v") * F.col("n")).alias("s")),
                             "span", "n", "s"), [*group, "kind"], asked)
    ranked = _same(leveled(counted, "span", "v", "n"), F.broadcast(wanted), [*group, "kind"])
    ranked = ranked.withColumn("before", F.try_element_at("spans", F.col("span")))
    # Rows whose place isn't asked for are one row of their group, without a value.
    ranked = ranked.groupBy(*group, "kind", "known", "before", F.expr("CASE WHEN known IS NULL OR before IS NOT NULL THEN v END AS v")).agg(
        F.sum("n").alias("n"), F.sum(F.expr("CASE WHEN known IS NOT NULL THEN n * (v - centre) * (v - centre) END")).alias("squares"))
    # A running sum passes a rank at one row only.
    w = Window.partitionBy(*group, "kind", "before").orderBy("v")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumns({"upto": F.coalesce("before", F.lit(0)) + F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)),
                                 "whole": F.coalesce("known", F.sum("n").over(every)), "mean": F.sum(F.col("v") * F.col("n")).over(every) / F.sum("n").over(every)})
    ranked = ranked.withColumn("squares", F.coalesce("squares", F.expr("n * (v - mean) * (v - mean)")))
    # As SQL: so many conditions take seconds to make as columns, one call each.
    passes = _passes(asked)
    # Squares are of what is left of the mean: sums of squares would lose small variances.
    found = ranked.groupBy(*group).agg(
        F.expr("sqrt(sum(CASE WHEN kind = 'c' THEN squares END) / max(CASE WHEN kind = 'c' THEN whole END)) AS std"),
        *[F.expr(f"max(CASE WHEN kind = '{k}' THEN whole END) AS {k}_n") for k in "ce"],
        *[F.expr(f"max(CASE WHEN {test} THEN v END) AS {name}") for name, test in passes.items()])

    def between(i):
        k, p = asked[i]
        at = f"(({k}_n - 1) * {p}D)"
        return f"CASE WHEN lo{i} = hi{i} THEN lo{i} ELSE (ceil({at}) - {at}) * lo{i} + ({at} - floor({at})) * hi{i} END"

    named = [f"{between(i)} AS p{round(100 * p):02d}" for i, p in enumerate(QUANTILES)]
    return found.select(*group, "std", F.expr(f"struct({', '.join(named)}) AS quantiles"),
                        *[F.expr(f"{between(len(QUANTILES) + i)} AS e_p{round(100 * p):02d}") for i, p in enumerate(ELAPSED)])


def _with_images(blocks: DataFrame, images: DataFrame, boxes: DataFrame, by: list[str], granularity: str, bins: Bins) -> DataFrame:
    """Blocks of boxes with the counts of their images."""
    # One image may be seen by several models, so its boxes are told apart by all keys; keys may be null.
    whose = [c for c in by if c != "startDate"] + ["image"]
    per_image = boxes.groupBy(*[F.col(c).alias(f"_{c}") for c in whose]).agg(F.count("*").alias("boxes"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in whose])
    images = images.withColumn("startDate", period_start(F.col("ts"), granularity)).join(per_image, same, "left")
    images = images.withColumn("boxes", F.coalesce("boxes", F.lit(0)))
    at = F.least("boxes", F.lit(bins.boxes_max))
    made = images.groupingSets([[F.col(c) for c in [*by, "equipment"]], [F.col(c) for c in by]], *[F.col(c) for c in [*by, "equipment"]]).agg(
        (F.grouping_id() % 2).alias("level"), F.count("*").alias("predictionCount"), F.count_if(F.col("boxes") == 0).alias("none"),
        F.sum("boxes").alias("b_sum"), F.sum(F.col("boxes") * F.col("boxes")).alias("b_sq"), F.max("boxes").alias("b_max"),
        F.array(*[F.count_if(at == i) for i in range(bins.boxes_max + 1)]).alias("b_hist"))
    key = lambda df: df.withColumn("_e", F.coalesce(F.col("equipment").cast("string"), F.lit("")))
    made = key(made).drop("equipment").withColumn("level", F.col("level").cast("long"))
    out = key(blocks).join(made, [*by, "level", "_e"], "full_outer").drop("_e")
    images_block = F.struct(F.col("none").alias("noBoxCount"), F.struct(
        F.col("b_sum").alias("sum"), F.col("b_sq").alias("sumSq"), F.col("b_max").alias("max"), F.col("b_hist").alias("histogram")).alias("boxesPerImage"))
    return out.withColumns({"boxCount": F.coalesce("rows", F.lit(0)), "images": images_block, "missing": F.coalesce("missing", F.lit(0)),
                            "inspectionCount": F.col("predictionCount")})


def expired(docs: DataFrame, now: Column, seconds: int = 31_536_000) -> DataFrame:
    """Documents within retention (Q11)."""
    return docs.where(F.col("startDate") > now - F.make_dt_interval(secs=F.lit(seconds)))
