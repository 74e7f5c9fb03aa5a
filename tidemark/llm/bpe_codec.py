"""BPE encoding and decoding of a text column by the tokenization automaton.

Texts are pre-split, each different piece of a batch goes through the automaton's tables once,
and the ids of all pieces are laid end to end. Ids of recent pieces are kept per Python worker
under a 64-bit hash of their bytes, at most KEPT_PIECES of them and a batch's; when there are
more, those that no later batch asked for go. The tables are built on the
driver from the vocabulary file and broadcast; their size depends on the file alone.

Defined cases: a null or empty text has no ids and decodes to the empty text; the strings of
special tokens become their ids; repeated rows are encoded each; extra columns travel along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import bpe_automaton, textbuf
from .presplit import Splitter
from .shared import lean

KEPT_PIECES = 800_000
#: Ids that are spelled out at a time.
IDS_A_STEP = 1 << 20
#: Odd factor whose product's high bits are a hash's slot.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_COMPILED: dict[str, bpe_automaton.Automaton] = {}
_SPLITTERS: dict[str, Splitter] = {}


def compiled(path: str) -> bpe_automaton.Automaton:
    """The automaton of a vocabulary file, built once a process."""
    if path not in _COMPILED:
        _COMPILED[path] = bpe_automaton.compile_file(path)
    return _COMPILED[path]


def splitter(path: str) -> Splitter:
    if path not in _SPLITTERS:
        _SPLITTERS[path] = Splitter(path)
    return _SPLITTERS[path]


class BatchEncoder:
    """Encodes batches of documents; `pieces` encodes the different pieces that aren't known yet."""

    def __init__(self, split: Splitter, pieces: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]):
        self.split, self.pieces = split, pieces
        self._forget()

    def _forget(self):
        self.ids, self.offsets = np.empty(0, np.int32), np.zeros(1, np.int64)
        self.known, self.asked = np.empty(0, np.uint64), np.empty(0, bool)
        self._index()

    def _index(self):
        """An open-addressed table of the known hashes' rows, half empty at least after the next piece."""
        size = 1 << max(10, (2 * len(self.known)).bit_length())
        self.slot_key, self.slot_row = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self._place(self.known, np.arange(len(self.known), dtype=np.int32))

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * _SPREAD) >> np.uint64(65 - len(self.slot_key).bit_length())).astype(np.int64)

    def _place(self, h: np.ndarray, rows: np.ndarray):
        """Puts different hashes that aren't in the table into it."""
        slot = self._slot(h)
        while len(h):
            free = np.flatnonzero(self.slot_row[slot] < 0)
            self.slot_row[slot[free]] = rows[free]  # of several that want one slot, one gets it
            got = self.slot_row[slot] == rows
            self.slot_key[slot[got]] = h[got]
            h, rows, slot = h[~got], rows[~got], (slot[~got] + 1) & (len(self.slot_key) - 1)

    def _found(self, h: np.ndarray) -> np.ndarray:
        """The row of self.ids for each hash, or -1."""
        slot = self._slot(h)
        out = self.slot_row[slot]
        open_ = np.flatnonzero((self.slot_key[slot] != h) & (out >= 0))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & (len(self.slot_key) - 1)
            row = self.slot_row[slot]
            out[open_] = row
            on = np.flatnonzero((self.slot_key[slot] != h[open_]) & (row >= 0))
            open_, slot = open_[on], slot[on]
        return out

    def _make_room(self):
        keep = np.flatnonzero(self.asked)
        if len(keep) > KEPT_PIECES // 2:
            keep = keep[:0]
        counts = self.offsets[keep + 1] - self.offsets[keep]
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.ids = self.ids[np.repeat(self.offsets[keep] - ends[:-1], counts) + np.arange(ends[-1])]
        self.known, self.offsets = self.known[keep], ends
        self.asked = np.zeros(len(keep), bool)
        self._index()

    def _learn(self, cut, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The rows of different pieces that aren't known yet."""
        fixed = cut.fixed[first]
        word = np.flatnonzero(fixed < 0)
        ids, offsets = self.pieces(cut.raw, cut.starts[first[word]], cut.ends[first[word]])
        counts = np.ones(len(first), np.int64)
        counts[word] = np.diff(offsets)
        ends = np.cumsum(counts)
        flat = np.empty(int(ends[-1]), np.int32)
        special = np.flatnonzero(fixed >= 0)
        flat[ends[special] - 1] = fixed[special]
        mask = np.ones(len(flat), bool)
        mask[ends[special] - 1] = False
        flat[mask] = ids
        rows = np.arange(len(self.known), len(self.known) + len(h), dtype=np.int32)
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + ends])
        self.ids = np.concatenate([self.ids, flat])
        self.known = np.concatenate([self.known, h])
        self.asked = np.concatenate([self.asked, np.zeros(len(h), bool)])
        if 2 * len(self.known) > len(self.slot_key):
            self._index()
        else:
            self._place(h, rows)
        return rows

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all documents, and the offsets of the documents."""
        cut = self.split.split(raw, offsets)
        if not len(cut.starts):
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        if len(self.known) > KEPT_PIECES:
            self._make_room()
        h = cut.hashes()
        rows = self._found(h)
        new = np.flatnonzero(rows < 0)
        self.asked[rows if not len(new) else rows[rows >= 0]] = True
        if len(new):
            # Most pieces of a batch are known: only the others are sorted.
            different, first, inverse = np.unique(h[new], return_index=True, return_inverse=True)
            rows[new] = self._learn(cut, different, new[first])[inverse]
        begin = self.offsets[rows]
        counts = self.offsets[rows + 1] - begin
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(begin - ends[:-1], counts)
        at += np.arange(ends[-1])
        return self.ids[at], ends[cut.first]


_WORKER: dict[str, BatchEncoder] = {}


def _spelled(labels: pa.Array, offsets: np.ndarray, ids: pa.Array) -> pa.Array:
    """Labels of the arcs of each document, joined as the library joins them, IDS_A_STEP at a time."""
    parts, lo = [], 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + IDS_A_STEP, "right")) - 1)
        each = labels.take(ids.slice(int(offsets[lo]), int(offsets[hi] - offsets[lo])))
        lists = pa.LargeListArray.from_arrays(pa.array(offsets[lo : hi + 1] - offsets[lo], pa.int64()), each)
        parts.append(pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string()))
        lo = hi
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids", decoded: str | None = None) -> DataFrame:
    """`docs` and the ids of each text as array<int>; with `decoded`, also the text that the ids spell,
    as `decode` gives it, in the same pass. `path`: a vocabulary file of the tokenizers library."""
    tables = docs.sparkSession.sparkContext.broadcast(compiled(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _WORKER:
            _WORKER[path] = BatchEncoder(splitter(path), tables.value.encode)
        labels = pa.array(tables.value.labels, pa.large_string())
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for lo, hi in textbuf.slices(batch, text):
                ids, offsets = _WORKER[path].encode(*textbuf.buffer_of(column.slice(lo, hi - lo)))
                ids = pa.array(ids)
                new = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids)]
                new += [_spelled(labels, offsets, ids)] if decoded else []
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *new],
                                                 [*batch.schema.names, into, *([decoded] if decoded else [])])

    fields = [T.StructField(into, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    return docs.mapInArrow(lean(run), T.StructType([*docs.schema, *fields]))


def decode(docs: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """`docs` and the text that the ids spell: the arcs' labels, joined as the library joins them."""
    labels = docs.sparkSession.sparkContext.broadcast(compiled(path).labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(labels.value, pa.large_string())
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            n = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
            joined = _spelled(names, np.concatenate([[0], np.cumsum(n)]).astype(np.int64), column.flatten())
            yield pa.RecordBatch.from_arrays([*batch.columns, joined], [*batch.schema.names, into])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema, T.StructField(into, T.StringType())]))
