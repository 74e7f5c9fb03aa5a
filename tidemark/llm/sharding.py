"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Sanders, "Random permutations on distributed, external and hierarchical memory" (1998): how
many rows each input partition sends to each shard is drawn from the multivariate
hypergeometric law with the partition sizes as row sums and the shard sizes as column sums;
every partition deals its rows to the shards by a local random permutation of exactly those
counts, the rows are exchanged once, and each shard is permuted again. The result is a uniform
random permutation cut into shards whose sizes differ by one at most (law `rows`).

Rows are never gathered: only partition sizes reach the driver. A partition's draws depend on
(seed, partition number, row number) alone, so a task that runs again deals alike, given that
the input is read in the same order again; `shuffle` therefore takes a scan, or stores any
other plan first. Shards are permuted in blocks of about `block_rows` (a block is a random
part of its shard), so that no task holds a whole shard.

Defined cases: nulls and extra columns travel along; equal and repeated rows are dealt one by
one; an empty table gives no rows; shards without rows are simply absent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, lean, stored

#: Rows that one task permutes at most, about; shards are cut into at least LEAST_BLOCKS.
BLOCK_ROWS = 100_000
LEAST_BLOCKS = 4
#: With more blocks than this, where each starts comes by a join instead of a literal.
LITERAL_BLOCKS = 4096


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes that differ by one at most and add up to `rows`."""
    return np.full(shards, rows // shards) + (np.arange(shards) < rows % shards)


def communication_matrix(row_sums: np.ndarray, column_sums: np.ndarray, seed: int) -> np.ndarray:
    """Rows sent from each partition to each shard; O(partitions * shards), whatever the rows."""
    rng = np.random.default_rng([seed, 0])
    left = column_sums.astype(np.int64).copy()
    out = np.zeros((len(row_sums), len(left)), np.int64)
    for p, n in enumerate(row_sums):
        # One urn draw with the capacities that are left; conditional draws column by column
        # keep it exact beyond the bounds of the library's joint draw.
        rest = int(left.sum())
        need = int(n)
        for s in range(len(left)):
            rest -= int(left[s])
            take = need if not rest else min(need, int(_hypergeometric(rng, int(left[s]), rest, need)))
            out[p, s] = take
            need -= take
        left -= out[p]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if not draws or not good:
        return 0
    if good + bad < 1_000_000_000:
        return rng.hypergeometric(good, bad, draws)
    # The library draws below 10**9 balls.
    return _inverted(rng, good, bad, draws)


def _inverted(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """A draw by inversion of the law, from ratios of neighbouring probabilities; O(standard deviation).
    Counts of 12 deviations and 60 more off the mode are left out: they are far below a double's resolution."""
    n, p = good + bad, good / (good + bad)
    mode = (draws + 1) * (good + 1) // (n + 2)
    reach = int(12 * np.sqrt(draws * p * (1 - p) * (n - draws) / (n - 1))) + 60
    least, most = max(0, draws - bad, mode - reach), min(good, draws, mode + reach)
    k = np.arange(least, most, dtype=float)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    upto = np.cumsum(np.exp(logs - logs.max()))
    return least + min(int(np.searchsorted(upto, rng.random() * upto[-1], "right")), most - least)


def _deal(seed: int, partition: int, counts: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, block in the shard and order key of each row of a partition."""
    rng = np.random.default_rng([seed, 1, partition])
    shard = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    rng.shuffle(shard)
    key = rng.integers(0, 2**63, len(shard), dtype=np.int64)
    return shard, (key % blocks).astype(np.int32), key // blocks


def shuffle(df: DataFrame, shards: int, seed: int = 7, block_rows: int = BLOCK_ROWS, scan: bool = False,
            shard: str = "shard", slot: str = "slot") -> DataFrame:
    """`df` with its shard and its slot in the shard (0 and up, without gaps).

    scan: `df` is a plain scan of files and so reads the same rows in the same order again.
    """
    if not scan:
        df = stored(df, "shuffle-input")
    spark = df.sparkSession
    sizes = {r["p"]: r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    parts = np.array(sorted(sizes), np.int64)
    row_sums = np.array([sizes[p] for p in parts], np.int64)
    rows = int(row_sums.sum())
    column_sums = shard_sizes(rows, shards)
    counts = dict(zip(parts.tolist(), communication_matrix(row_sums, column_sums, seed)))
    blocks = max(LEAST_BLOCKS, -(-int(column_sums.max(initial=0)) // block_rows))
    at, block, key = (free_name(df, n) for n in ("_partition", "_block", "_key"))
    plan = spark.sparkContext.broadcast(counts)

    def tally(batches):
        """How many rows each block gets: the draws are made again, without the rows."""
        for batch in batches:
            total = np.zeros((shards, blocks), np.int64)
            for p in batch.column(0).to_pylist():
                s, b, _ = _deal(seed, p, plan.value[p], blocks)
                np.add.at(total, (s, b), 1)
            s, b = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(b), pa.array(total[s, b])], ["s", "b", "n"])

    known = spark.createDataFrame([(int(p),) for p in parts], "p long").repartition(max(1, min(len(parts), 64)))
    filled = known.mapInArrow(lean(tally), "s long, b long, n long").groupBy("s", "b").agg(F.sum("n").alias("n")).collect()
    total = np.zeros((shards, blocks), np.int64)
    for r in filled:
        total[r["s"], r["b"]] = r["n"]
    before = (np.cumsum(total, 1) - total).tolist()

    def deal(batches):
        dealt, done = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if dealt is None:
                p = batch.column(batch.schema.get_field_index(at))[0].as_py()
                dealt = _deal(seed, p, plan.value[p], blocks)
            new = [pa.array(x[done : done + n]) for x in dealt]
            done += n
            keep = [i for i, c in enumerate(batch.schema.names) if c != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *new],
                                             [*(batch.schema.names[i] for i in keep), shard, block, key])

    schema = T.StructType([*df.schema, T.StructField(shard, T.IntegerType()), T.StructField(block, T.IntegerType()),
                           T.StructField(key, T.LongType())])
    dealt = df.withColumn(at, F.spark_partition_id()).mapInArrow(lean(deal), schema)
    within = Window.partitionBy(shard, block).orderBy(key, *[c for c, t in df.dtypes if t in ("bigint", "int", "string")][:1])
    base = None
    if not rows:
        base = F.lit(0).cast("long")
    elif shards * blocks <= LITERAL_BLOCKS:
        literal = F.array(*[F.array(*[F.lit(x).cast("long") for x in row]) for row in before])
        base = F.element_at(F.element_at(literal, F.col(shard) + 1), F.col(block) + 1)
    if base is None:
        starts = spark.createDataFrame([(s, b, x) for s, row in enumerate(before) for b, x in enumerate(row)],
                                       f"`{shard}` int, `{block}` int, `{slot}` long")
        return dealt.withColumn(key, F.row_number().over(within).cast("long") - 1).join(starts, [shard, block]).withColumn(
            slot, F.col(slot) + F.col(key)).select(*df.columns, shard, slot)
    return dealt.withColumn(slot, base + F.row_number().over(within) - 1).select(*df.columns, shard, slot)
