"""Statistics documents to one row per period, and periods to sides.

Everything additive is kept as cells (kind, k): the totals, one cell per class, one per class
count. `merged` adds cells up under any key, so documents make periods and periods make sides
by the same plan. Histograms are added position by position, in long form: state doesn't grow
with the number of documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.paths import QueryError, elapsed_days, to_utc, type_of
from .statistics import HOURS

TASKS, DETAILS = ("cls", "det"), ("full", "compact")
MAX_DAYS, MAX_PERIODS = 400, 60


@dataclass(frozen=True)
class Windows:
    """Half-open ranges of period starts."""

    start: datetime
    end: datetime
    reference_start: datetime | None = None
    reference_end: datetime | None = None

    @classmethod
    def of(cls, start, end, reference_start=None, reference_end=None, max_days: int = MAX_DAYS) -> "Windows":
        w = cls(*(to_utc(x) for x in (start, end, reference_start, reference_end)))
        if w.start is None or w.end is None or w.start >= w.end:
            raise QueryError("the window must start before it ends")
        if (w.reference_start is None) != (w.reference_end is None):
            raise QueryError("a reference window has both dates or none")
        if w.comparison and w.reference_start >= w.reference_end:
            raise QueryError("the reference window must start before it ends")
        if w.comparison and w.reference_end > w.start:
            raise QueryError("the reference window must end before the current one starts")
        if w.days > max_days:
            raise QueryError(f"the windows span {w.days:.1f} days, more than {max_days}")
        return w

    @property
    def comparison(self) -> bool:
        return self.reference_start is not None

    @property
    def days(self) -> float:
        return elapsed_days(self.start, self.end) + (elapsed_days(self.reference_start, self.reference_end) if self.comparison else 0.0)

    def granularity(self, asked: str = "auto", max_periods: int = MAX_PERIODS) -> str:
        """As asked; `auto` is the finest that makes `max_periods` periods at most."""
        if asked != "auto":
            if asked not in HOURS:
                raise QueryError(f"granularity {asked!r}")
            return asked
        return next((g for g, h in HOURS.items() if self.days * 24 / h <= max_periods), "weekly")


@dataclass(frozen=True)
class Selection:
    model_name: str
    model_version: str
    task: str | None = None
    gbm: str | None = None
    process: str | None = None
    mode: str | None = None
    equipment_id: str | None = None
    product_id: str | None = None


def _field(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if type_of(df.schema, name) is not None else F.lit(None).cast(kind)


def match(docs: DataFrame, selection: Selection, windows: Windows, granularity: str) -> DataFrame:
    """Documents of the selection in either window, tagged with the window: one scan for both."""
    inside = lambda a, b: (F.col("startDate") >= F.lit(a)) & (F.col("startDate") < F.lit(b))
    test = inside(windows.start, windows.end)
    tag = F.lit("current")
    if windows.comparison:
        before = inside(windows.reference_start, windows.reference_end)
        test, tag = test | before, F.when(before, "reference").otherwise("current")
    query = {"modelName": selection.model_name, "modelVersion": selection.model_version, "mode": selection.mode, "gbm": selection.gbm,
             "process": selection.process, "productId": selection.product_id, "granularity": granularity}
    for name, value in query.items():
        if value is not None:  # a field that no document has matches none
            test = test & (_field(docs, name) == F.lit(value))
    task = _field(docs, "task")
    test = test & (task == selection.task if selection.task else task.isin(*TASKS))
    return docs.where(test).withColumn("window", tag)


_CONF = "count sum sumSq min max belowThresholdCount nearThresholdCount histogram quantiles".split()


def cells_of(docs: DataFrame, selection: Selection) -> tuple[DataFrame, DataFrame]:
    """(scalars, cells) of matched documents: one row per document, and one per entry of its block."""
    if selection.equipment_id is None:
        block, backends = F.col("total"), F.col("equipments.backend")
        equipment = F.col("equipments.equipmentId")
    else:
        block = F.get(F.filter("equipments", lambda e: e["equipmentId"] == selection.equipment_id), F.lit(0))
        backends, equipment = F.array(F.col("block.backend")), F.array(F.lit(selection.equipment_id))
    one = docs.withColumn("block", block)
    have = F.col("block").isNotNull()
    guarded = lambda c: F.when(have, c)
    scalars = one.select(
        "window", "startDate", "endDate", have.cast("int").alias("documents"), (~have).cast("int").alias("missing_blocks"),
        F.array(_field(one, "task")).alias("tasks"),
        *[guarded(F.array(_field(one, n))).alias(a) for n, a in (("productId", "product_ids"), ("gbm", "gbms"), ("process", "processes"), ("mode", "modes"))],
        guarded(equipment).alias("equipment_ids"), guarded(F.col("classes")).alias("classes"), guarded(F.array("bins")).alias("bins"),
        guarded(F.sort_array(F.array_distinct(F.array_compact(backends)))).alias("backends"),
        *[F.col(f"block.{n}").cast("long").alias(a) for n, a in (("inspectionCount", "inspections"), ("predictionCount", "predictions"), ("boxCount", "boxes"))],
        F.col("block.quality.missingConfidenceCount").alias("missing_confidence"), F.col("block.quality.parseErrorCount").alias("parse_errors"),
        F.col("block.elapsedTime.count").alias("elapsed_count"), F.col("block.elapsedTime.sum").alias("elapsed_sum"),
        F.col("block.images.noBoxCount").alias("no_box"), F.col("block.images.boxesPerImage.sum").alias("boxes_sum"),
        F.col("block.images.boxesPerImage.sumSq").alias("boxes_sumsq"), F.col("block.images.boxesPerImage.histogram").alias("boxes_histogram"))
    conf = lambda c: F.struct(*[c[n].alias(n) for n in _CONF], F.array_compact(F.array(c["threshold"])).alias("thresholds"))
    kinds = one.select("window", "startDate", F.when(have, conf(F.col("block.confidence"))).alias("c"), F.col("block.perClass").alias("p"),
                       F.col("block.classCounts").alias("n"))
    nothing = lambda c, like: F.coalesce(c, F.array().cast(like))
    total = F.array(F.struct(F.lit("total").alias("kind"), F.lit("").alias("k"), F.col("c").alias("c"), F.lit(None).cast("long").alias("n")))
    shape = kinds.select(total.alias("e")).schema["e"].dataType
    by_class = nothing(F.transform(F.map_entries("p"), lambda e: F.struct(
        F.lit("class").alias("kind"), e["key"].alias("k"), conf(e["value"]).alias("c"), F.lit(None).cast("long").alias("n"))), shape)
    counts = nothing(F.transform(F.map_entries("n"), lambda e: F.struct(
        F.lit("count").alias("kind"), e["key"].alias("k"), F.lit(None).cast(shape.elementType["c"].dataType).alias("c"), e["value"].cast("long").alias("n"))), shape)
    cells = kinds.select("window", "startDate", F.explode(F.concat(total, by_class.cast(shape), counts.cast(shape))).alias("e"))
    return scalars, cells.select("window", "startDate", "e.kind", "e.k", "e.c", "e.n")


_SETS = "tasks product_ids gbms processes modes equipment_ids classes bins backends".split()
_SUMS = ("documents missing_blocks inspections predictions missing_confidence parse_errors elapsed_count elapsed_sum boxes_sum "
         "boxes_sumsq").split()
_OPTIONAL = "boxes no_box".split()


def _added(df: DataFrame, keys: list[str], histogram: str) -> DataFrame:
    """Arrays of counts added position by position under `keys`."""
    cells = df.select(*keys, F.posexplode(histogram).alias("pos", "x")).groupBy(*keys, "pos").agg(F.sum("x").alias("x"))
    return cells.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("added"))


def merged(scalars: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """One row per `keys`: sums (null and missing are zero), optional sums (null if all are), set
    unions, the total confidence, per_class and class_counts maps."""
    union = lambda n: F.array_sort(F.array_distinct(F.flatten(F.collect_set(n)))) if n not in ("bins", "classes") else (
        F.array_distinct(F.flatten(F.array_sort(F.collect_set(n)))))
    start, end = ("startDate", "endDate")
    named = [c for c in (start, end) if c not in keys]
    one = scalars.groupBy(*keys).agg(
        *[(F.min if c == start else F.max)(c).alias(c) for c in named], F.count("*").alias("members"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS], *[F.sum(c).alias(c) for c in _OPTIONAL],
        F.max(F.col("boxes_histogram").isNotNull()).alias("has_images"), *[union(c).alias(c) for c in _SETS])
    one = one.withColumn("product_count", F.size("product_ids"))
    boxes = _added(scalars, keys, "boxes_histogram").withColumnRenamed("added", "boxes_histogram")
    by = [*keys, "kind", "k"]
    each = cells.select(*by, "n", *[F.col(f"c.{x}").alias(x) for x in [*_CONF, "thresholds"]], F.col("c").isNotNull().alias("present"))
    whole = each.groupBy(*by).agg(
        F.sum("n").alias("n"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("count", "sum", "sumSq")],
        F.min("min").alias("min"), F.max("max").alias("max"), *[F.sum(x).alias(x) for x in ("belowThresholdCount", "nearThresholdCount")],
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("thresholds")))).alias("thresholds"),
        F.when(F.count_if("present") == 1, F.any_value("quantiles", True)).alias("quantiles"))
    added = _added(each, by, "histogram")
    whole = whole.join(added, by, "left").withColumn("histogram", F.coalesce("added", F.array().cast("array<bigint>")))
    conf = F.struct(*_CONF, "thresholds")
    maps = whole.groupBy(*keys).agg(
        F.max_by(conf, F.col("kind") == "total").alias("confidence"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == "count", F.struct("k", "n"))))).alias("class_counts"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("kind") == "class", F.struct("k", conf.alias("c")))))).alias("per_class"))
    out = one.join(maps, keys, "left").join(boxes, keys, "left")
    # Histograms of different edges can't be added: none, rather than a wrong one.
    edges = F.array_distinct(F.filter(F.transform("bins", lambda b: b["confidenceEdges"]), lambda e: F.size(e) > 0))
    out = out.withColumn("edges", F.get(edges, F.lit(0))).withColumn("edge_sets", F.size(edges))
    mixed = F.col("edge_sets") > 1
    return out.withColumn("confidence", F.when(mixed, F.col("confidence").withField("histogram", F.array().cast("array<bigint>")))
                          .otherwise(F.col("confidence")))


def periods(docs: DataFrame, selection: Selection) -> DataFrame:
    """One row per (window, startDate) of matched documents."""
    scalars, cells = cells_of(docs, selection)
    return merged(scalars, cells, ["window", "startDate"])


def sides(rows: DataFrame, side: Column) -> DataFrame:
    """Periods added up by `side` (null: left out); a side of one period keeps its quantiles."""
    rows = rows.withColumn("side", side).where("side IS NOT NULL")
    scalars = rows.select("side", "startDate", "endDate", *_SUMS, *_OPTIONAL, "boxes_histogram", *_SETS)
    entry = lambda kind, k, c, n: F.struct(F.lit(kind).alias("kind"), k.alias("k"), c.alias("c"), n.alias("n"))
    none_n = F.lit(None).cast("long")
    total = F.array(entry("total", F.lit(""), F.col("confidence"), none_n))
    shape = rows.select(total.alias("e")).schema["e"].dataType
    none_c = F.lit(None).cast(shape.elementType["c"].dataType)
    by_class = F.transform(F.map_entries("per_class"), lambda e: entry("class", e["key"], e["value"], none_n)).cast(shape)
    counts = F.transform(F.map_entries("class_counts"), lambda e: entry("count", e["key"], none_c, e["value"])).cast(shape)
    cells = rows.select("side", F.explode(F.concat(total, by_class, counts)).alias("e")).select("side", "e.kind", "e.k", "e.c", "e.n")
    return merged(scalars, cells, ["side"])


