"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints within 2*h bits of each other share at least one variant within h bits, so each
distinct fingerprint emits its whole ball of radius h (1 + 64 variants for h = 1), and rows
are brought together by variant. Any two members of a variant's group differ in at most 2*h
bits, and a group has at most as many members as the ball has variants (65), whatever the
data: all copies of a text are one fingerprint, so no group grows with them. Members are
chained in sorted order, which links the group without emitting all its pairs; links are
deduplicated and verified by bit count (at an odd radius, which no ball halves, all pairs that share
a variant of the lower half's ball and of the upper half's are verified instead), and alternating star contraction gives the components.

Defined cases: A-Z are lower-cased; words are runs of other than ASCII white space; a text of
fewer words than the shingle is one shingle; a text without words, null or empty has
fingerprint zero and is linked like any other; a null doc_id can't be a component's smallest
id unless all of its documents lack one; repeated rows stay; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import components, textbuf
from .shared import free_name, lean, stored

_LOWER, _WORD = textbuf.lowered(), textbuf.space_table()
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
#: Shingles whose hashes are held at once, however long a text is.
SHINGLES_A_STEP = 1 << 16


def fingerprints(raw: np.ndarray, offsets: np.ndarray, shingle: int, seed: int) -> np.ndarray:
    """Of each text, the bits that over half its shingles' hashes have; `raw` and `offsets` as textbuf gives them."""
    raw = _LOWER[raw]
    inside = _WORD[raw]
    starts, ends = textbuf.runs(inside, offsets)
    first = textbuf.owner(starts, offsets)
    # The words again with one space after each, so that a shingle is one slice.
    stop = np.cumsum(ends - starts + 1) - 1
    start = stop - (ends - starts)
    joined = np.full(int(stop[-1]) + 1 if len(stop) else 0, 0x20, np.uint8)
    letters = np.ones(len(joined), bool)
    letters[stop] = False
    joined[letters] = raw[inside]
    data = joined.tobytes()

    words = np.diff(first)
    width = np.minimum(words, shingle)
    many = np.where(words > 0, words - width + 1, 0)
    before = np.concatenate([[0], np.cumsum(many)])
    ones = np.zeros((len(words), 64))
    for lo in range(0, int(before[-1]), SHINGLES_A_STEP):
        nth = np.arange(lo, min(lo + SHINGLES_A_STEP, int(before[-1])))
        doc = np.searchsorted(before, nth, "right") - 1
        word = first[doc] + nth - before[doc]
        spans = zip(start[word].tolist(), stop[word + width[doc] - 1].tolist())
        h = np.fromiter((xxhash.xxh64_intdigest(data[x:y], seed) for x, y in spans), np.uint64, len(nth))
        by_byte, base, docs = h.view(np.uint8).reshape(-1, 8), (doc - doc[0]) * 256, int(doc[-1] - doc[0]) + 1
        for k in range(8):
            counts = np.bincount(base + by_byte[:, k], minlength=docs * 256).reshape(docs, 256)
            ones[doc[0] : doc[0] + docs, 8 * k : 8 * k + 8] += counts @ _BITS
    return np.packbits(2 * ones > many[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def with_fingerprint(docs: DataFrame, into: str, text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """`docs` and the fingerprint as a signed long."""

    def add(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for lo, hi in textbuf.slices(batch, text):
                prints = fingerprints(*textbuf.buffer_of(column.slice(lo, hi - lo)), shingle, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(prints)], [*batch.schema.names, into])

    return docs.mapInArrow(lean(add), T.StructType([*docs.schema, T.StructField(into, T.LongType())]))


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) of distinct fingerprints `fp` at `radius` or fewer bits, enough of them to connect all that are."""
    if radius not in (0, 1, 2, 3):
        raise ValueError("radius 0 to 3: balls of half the radius have 1, 65 or 2081 variants")
    if radius % 2:
        # A chain of a group's members would hold links of one bit too many, and lack others: all
        # pairs are met, the ball of the lower half on one side and that of the upper on the other.
        near, far = _ball(prints, radius // 2, "a"), _ball(prints, radius - radius // 2, "b")
        pairs = near.join(far, "variant").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    else:
        inside = Window.partitionBy("variant").orderBy("fp")
        pairs = _ball(prints, radius // 2, "fp").select("fp", F.lag("fp").over(inside).alias("other")).where("other IS NOT NULL")
        pairs = pairs.select(F.col("other").alias("a"), F.col("fp").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def _ball(prints: DataFrame, radius: int, name: str) -> DataFrame:
    """`fp` as `name`, and each variant of it within `radius` bits, 0 to 2."""
    one = [(1 << k) - (1 << 64 if k == 63 else 0) for k in range(64)]
    flips = [0] + one * (radius > 0) + [x ^ y for i, x in enumerate(one) for y in one[:i]] * (radius > 1)
    ball = F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x).cast("long")) for x in flips]))
    return prints.select("fp", ball.alias("variant")).withColumnRenamed("fp", name)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42,
            radius: int = 2) -> DataFrame:
    """One row per row of `docs`: doc_id, fp (signed long), component_id."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fps = stored(with_fingerprint(slim, "fp", "text", shingle, seed).drop("text"), "simhash")
    # All documents of a fingerprint are one node, named by their smallest id.
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    names_a = nodes.select(F.col("fp").alias("a"), F.col("node").alias("u"))
    names_b = nodes.select(F.col("fp").alias("b"), F.col("node").alias("v"))
    edges = links(nodes.select("fp"), radius).join(names_a, "a").join(names_b, "b").select("u", "v")
    roots = components.smallest_reachable(edges.where("u IS NOT NULL AND v IS NOT NULL"))
    # `node` is one row per fingerprint, so this lookup doesn't meet a hot key; the next one is
    # split by the engine where a fingerprint is hot, as only its left side has many rows.
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def hex16(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """One document of each component, the one of the smallest id; of repeated rows with that id, one. Same columns.

    Rows without doc_id are in no component that could name them, and stay.
    """
    found = classes(docs, doc_id, **options)
    best = found.where("doc_id = component_id").select("doc_id").distinct()
    key = free_name(docs, "kept_id")
    best = best.withColumnRenamed("doc_id", key)
    one = docs.join(best, docs[doc_id] == best[key], "left_semi").dropDuplicates([doc_id])
    return one.unionByName(docs.where(F.col(doc_id).isNull()))
