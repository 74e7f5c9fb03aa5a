"""Benchmark decontamination: broadcast hash set of normalised test n-grams, scan, verify, remove.

Normalised words are the runs of letters, digits and non-ASCII characters after A-Z become a-z.
Each benchmark item gives its windows of `size` consecutive words; an item of fewer words, but
not none, is one window. The benchmark is split into blocks of at most `block_bytes` of text;
the windows of a block are broadcast (so a broadcast never exceeds what one block holds) and
the documents pass over the blocks one after the other, carrying the spans found so far. No
shuffle is needed at any size. A window counts only where its words equal the item's words
byte by byte; hashes only choose the candidates.

Defined cases: a null or empty text has no words and no spans; benchmark rows without item_id
or without words are no items; repeated items count once by item_id; repeated documents are
scanned each; an empty benchmark hits nothing; extra columns of either table are carried or
ignored, and new columns get a free name where theirs is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbuf
from .shared import free_name, lean

SIZE = 13
BLOCK_BYTES = 16 << 20
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()),
        T.StructField("byte_start", T.IntegerType()), T.StructField("byte_stop", T.IntegerType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])
_ARROW = pa.struct([
    ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([(k, pa.int32()) for k in ("start", "stop", "byte_start", "byte_stop")]))),
    ("items", pa.list_(pa.string())),
])


def word_table() -> np.ndarray:
    """True for the bytes of words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


_LOWER, _WORD = textbuf.lowered(), word_table()


class Windows:
    """The windows of a block of benchmark items: bytes of the window -> ids of its items."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.items: dict[int, dict[bytes, tuple[str, ...]]] = {}
        hashes: dict[int, list[np.ndarray]] = {}
        for item_id, text in items:
            raw = _LOWER[np.frombuffer(text.encode(), np.uint8)]
            offsets = np.array([0, len(raw)])
            starts, ends = textbuf.runs(_WORD[raw], offsets)
            n = min(size, len(starts))
            if not n:
                continue
            hashes.setdefault(n, []).append(textbuf.window_hash(textbuf.span_hash(raw, starts, ends), n))
            data = raw.tobytes()
            words = [data[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
            known = self.items.setdefault(n, {})
            for i in range(len(words) - n + 1):
                key = b" ".join(words[i : i + n])
                known[key] = tuple(sorted({*known.get(key, ()), item_id}))
        self.hashes = {n: np.unique(np.concatenate(h)) for n, h in hashes.items()}
        self.bits = {}
        for n, h in self.hashes.items():
            self.bits[n] = np.zeros(1 << 20, bool)
            self.bits[n][(h >> np.uint64(44)).astype(np.int64)] = True

    def candidates(self, words: np.ndarray, n: int) -> np.ndarray:
        h = textbuf.window_hash(words, n)
        at = np.flatnonzero(self.bits[n][(h >> np.uint64(44)).astype(np.int64)])
        known = self.hashes[n]
        place = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
        return at[known[place] == h[at]]


def _scan(batch: pa.RecordBatch, text: str, before: str | None, windows: Windows) -> pa.Array:
    """The found struct of each row, joined with what earlier blocks found."""
    rows = []
    for lo, hi in textbuf.slices(batch, text):
        raw, offsets = textbuf.buffer_of(batch.column(batch.schema.get_field_index(text)).slice(lo, hi - lo))
        raw = _LOWER[raw]
        starts, ends = textbuf.runs(_WORD[raw], offsets)
        first = textbuf.owner(starts, offsets)
        words = textbuf.span_hash(raw, starts, ends)
        hit = np.zeros(len(starts) + 1, np.int32)
        items: dict[int, set[str]] = {}
        for n, known in windows.items.items():
            for i in windows.candidates(words, n).tolist():
                doc = int(np.searchsorted(first, i, "right")) - 1
                if i + n > first[doc + 1]:
                    continue
                key = b" ".join(raw[s:e].tobytes() for s, e in zip(starts[i : i + n].tolist(), ends[i : i + n].tolist()))
                if key in known:
                    hit[i] += 1
                    hit[i + n] -= 1
                    items.setdefault(doc, set()).update(known[key])
        # A span ends where its document does, so spans of neighbours are told apart below.
        covered = np.cumsum(hit[:-1]) > 0
        span_start, span_stop = textbuf.runs(covered, first)
        at = np.searchsorted(span_start, first, "left")
        for doc in range(hi - lo):
            a, b, w = at[doc], at[doc + 1], first[doc]
            spans = [{"start": int(s - w), "stop": int(e - w), "byte_start": int(starts[s] - offsets[doc]),
                      "byte_stop": int(ends[e - 1] - offsets[doc])}
                     for s, e in zip(span_start[a:b], span_stop[a:b])]
            rows.append({"n_words": int(first[doc + 1] - w), "spans": spans, "items": sorted(items.get(doc, ()))})
    if before:
        for row, old in zip(rows, batch.column(batch.schema.get_field_index(before)).to_pylist()):
            if old["spans"]:
                row["spans"] = _joined(row["spans"] + old["spans"])
                row["items"] = sorted({*row["items"], *old["items"]})
    return pa.array(rows, _ARROW)


def _joined(spans: list[dict]) -> list[dict]:
    """Overlapping word spans as one; spans that only touch stay apart or join, which covers the same words."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda x: x["start"]):
        if out and s["start"] < out[-1]["stop"]:
            if s["stop"] > out[-1]["stop"]:
                out[-1] |= {"stop": s["stop"], "byte_stop": s["byte_stop"]}
        else:
            out.append(dict(s))
    return out


def _blocks(bench: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of at most `block_bytes` of text (one item at least), streamed to the driver."""
    rows = bench.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    block, held = [], 0
    for row in rows.toLocalIterator():
        n = len(row["t"].encode())
        if block and held + n > block_bytes:
            yield block
            block, held = [], 0
        block.append((row["i"], row["t"]))
        held += n
    yield block


def find(docs: DataFrame, bench: DataFrame, into: str = "found", text: str = "text", item: str = "item_id",
         item_text: str = "text", size: int = SIZE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of `docs` and, as column `into`, the struct FOUND: number of words, spans of
    words inside occurrences of benchmark windows (word and byte bounds), ids of the items found."""
    spark, out, before = docs.sparkSession, docs, None
    for block in _blocks(bench, item, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(Windows(block, size))

        def scan(batches, shared=shared, before=before):
            for batch in batches:
                found = _scan(batch, text, before, shared.value)
                columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != before]
                names = [n for n in batch.schema.names if n != before]
                yield pa.RecordBatch.from_arrays([*columns, found], [*names, into])

        schema = T.StructType([f for f in out.schema if f.name != before] + [T.StructField(into, FOUND)])
        out = out.mapInArrow(lean(scan), schema)
        before = into
    return out


def hit_words(found: Column) -> Column:
    """Number of words inside occurrences."""
    return F.coalesce(F.aggregate(found["spans"], F.lit(0), lambda n, s: n + s["stop"] - s["start"]), F.lit(0)).cast("long")


def contaminated(found: Column, twentieths: int = 1) -> Column:
    """At least `twentieths` of 20 words are hit, and at least one; 0 means any hit."""
    return (hit_words(found) > 0) & (20 * hit_words(found) >= twentieths * found["n_words"])


def remove_documents(docs: DataFrame, bench: DataFrame, twentieths: int = 1, **options) -> DataFrame:
    """`docs` without those that are contaminated by `twentieths`; same columns."""
    into = free_name(docs, "found")
    return find(docs, bench, into, **options).where(~contaminated(F.col(into), twentieths)).drop(into)


def remove_spans(docs: DataFrame, bench: DataFrame, text: str = "text", **options) -> DataFrame:
    """`docs` with every found span cut out of the text; same columns."""
    into = free_name(docs, "found")
    found = find(docs, bench, into, text, **options)
    data, spans = F.encode(F.col(text), "UTF-8"), F.sort_array(F.col(f"{into}.spans"))
    # The kept pieces lie between one span's end and the next one's start.
    stops = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["byte_stop"]))
    starts = F.concat(F.transform(spans, lambda s: s["byte_start"]), F.array(F.octet_length(F.col(text))))
    pieces = F.zip_with(stops, starts, lambda a, b: F.decode(F.substring(data, a + 1, b - a), "UTF-8"))
    cut = F.when(F.size(spans) > 0, F.array_join(pieces, "")).otherwise(F.col(text))
    return found.withColumn(text, cut).select(*docs.columns)
