"""Statistics of a stream of predictions (Q10).

Additive fields (counts, sums, histograms) are kept per period under a watermark and emitted as
they change; late rows within the watermark update their period. Exact quantiles aren't
additive: `finalise` computes them once from the raw rows of closed periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import stats
from ..plans.statistics import Bins, statistics

# Weeks start on Monday, four days after the epoch's Thursday.
_WINDOW = {"hourly": ("1 hour", "1 hour", "0 seconds"), "shift": ("12 hours", "12 hours", "0 seconds"),
           "daily": ("1 day", "1 day", "0 seconds"), "weekly": ("7 days", "7 days", "4 days")}


def window(ts: Column, granularity: str) -> Column:
    return F.window(ts, *_WINDOW[granularity])


def additive(rows: DataFrame, keys: list[str], granularity: str, bins: Bins = Bins(), watermark: str = "1 hour") -> DataFrame:
    """Running additive statistics by key, period, equipment and class; works on streams and on tables."""
    if rows.isStreaming:
        rows = rows.withWatermark("ts", watermark)
    c, t = F.col("confidence"), F.col("threshold")
    at = stats.bin_index_of(c, list(bins.edges))
    grouped = rows.groupBy(window(F.col("ts"), granularity).alias("w"), *keys, "equipment", "class").agg(
        F.count("*").alias("predictions"), F.count(c).alias("count"), F.sum(c).alias("sum"), F.sum(c * c).alias("sumSq"), F.min(c).alias("min"),
        F.max(c).alias("max"), F.array(*[F.count_if(c.isNotNull() & (at == i)) for i in range(len(bins.edges) - 1)]).alias("histogram"),
        F.count_if(c < t).alias("below"), F.count_if(F.abs(c - t) < bins.margin).alias("near"), F.count_if(c.isNull()).alias("missing"))
    return grouped.select(*keys, F.col("w.start").alias("startDate"), F.col("w.end").alias("endDate"), "equipment", "class", "predictions", "count",
                          "sum", "sumSq", "min", "max", "histogram", "below", "near", "missing")


def run(rows: DataFrame, keys: list[str], granularity: str, target: str, checkpoint: str, bins: Bins = Bins(), watermark: str = "1 hour",
        available_now: bool = True) -> StreamingQuery:
    """Writes each batch's changed periods to `target`, one folder a batch; `latest` reads the newest of each."""
    def write(batch: DataFrame, number: int) -> None:
        # The batch number names the folder, so a batch that runs again replaces itself.
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = additive(rows, keys, granularity, bins, watermark).writeStream.outputMode("update").foreachBatch(write)
    stream = stream.option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()


def latest(spark, target: str, keys: list[str]) -> DataFrame:
    """The newest state of every period and entry."""
    rows = spark.read.parquet(target)
    by = [*keys, "startDate", "equipment", "class"]
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*by, "x.*").drop("batch")


def finalise(raw: DataFrame, keys: list[str], granularity: str, closed_before: Column, bins: Bins = Bins()) -> DataFrame:
    """Statistics documents, exact quantiles included, of periods that ended before a time."""
    return statistics(raw, keys, granularity, bins).where(F.col("endDate") <= closed_before)
