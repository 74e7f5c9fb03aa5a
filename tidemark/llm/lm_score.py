"""Language-model scores of whole documents.

Words are runs of other than ASCII white space after A-Z become a-z; every document ends in an
end token. The base score is a unigram model with counts of all training documents; the model
score is that of a causal self-attention model over subword ids (`attention`).

Documents are read once, in blocks of about BLOCK_BYTES of text. A block keeps its different
words once, and each document as positions among them. The words of all blocks meet in one
exchange, where counts are summed and each different word is cut into subwords once; the
subwords' counts of the whole corpus give the model its shares. Each block then gets its own
words back, with count and subwords, in one packed row a task, and its documents are stored as
subword streams. So neither text nor a row per word of a document is ever exchanged, and a word
that all documents share has one row a block. What goes back is stored before the blocks get it,
so that the words' exchange is off the disks by then.

The model's classes and its table of class bigrams come from counts over all training streams.
Its weights are fitted on windows from all blocks, in proportion to their training tokens: first
FIRST_WINDOWS a fitted document (FIT_DOCS) on the driver, whatever the corpus; where one window in
TOKENS_A_WINDOW tokens is more, the blocks go on from there with the others, each by itself, and
the weights are averaged by windows, in ROUNDS rounds. Only counts, tables and weights of the
model's size and the first windows reach the driver. Which windows are drawn depends on the blocks,
so the model score does too, in its last digits; nothing else does.

Defined cases: a null or empty text is its end token alone; rows without doc_id train like
others; without training rows all counts are zero; repeated rows count each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention, bpe_codec, textbuf
from .shared import lean, stored, trim

BLOCK_BYTES = (8 << 20) - (64 << 10)
#: The first windows are FIRST_WINDOWS times FIT_DOCS: as many as the model's steps take.
FIT_DOCS, FIRST_WINDOWS = 400, attention.STEPS * attention.WINDOWS_A_STEP // 400
TOKENS_A_WINDOW, ROUNDS, LATER_RATE = 1024, 2, 0.1 * attention.RATE
#: Blocks of a batch that goes to a Python worker.
BLOCKS_A_BATCH = 8
WORDS_A_ROW = 20_000
#: Words on their way back to their blocks that a task holds at once.
WORDS_HELD = 1 << 20
#: A word's place is one long: 22 bits for the task, 12 for the block in the task, 30 for the word in the block.
MADE_BITS, AT_BITS = 12, 30
_LOWER, _WORD = textbuf.lowered(), textbuf.space_table()


def held_out(doc_id: Column, parts: int = 5, part: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def _blocks(batches):
    """Rows of a block: one with its documents, packed, and some with its words and their training counts."""
    task, made = TaskContext.get().partitionId(), 0
    names = ["block", "packed", "base", "words", "counts"]
    types = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    for batch in batches:
        for lo, hi in textbuf.slices(batch, "text", BLOCK_BYTES, 1 << 16):
            part = batch.slice(lo, hi - lo)
            raw, offsets = textbuf.buffer_of(part.column(1))
            raw = _LOWER[raw]
            starts, ends = textbuf.runs(_WORD[raw], offsets)
            first = textbuf.owner(starts, offsets)
            _, at, which = np.unique(textbuf.span_hash(raw, starts, ends), return_index=True, return_inverse=True)
            # Frequent words first: positions are then mostly small, which packs well.
            order = np.argsort(-np.bincount(which, minlength=len(at)), kind="stable")
            rank = np.empty(len(at), np.int64)
            rank[order] = np.arange(len(at))
            at, which = at[order], rank[which]
            training = ~part.column(2).to_numpy(zero_copy_only=False).astype(bool)
            in_training = np.repeat(training, np.diff(first))
            counts = np.bincount(which[in_training], minlength=len(at))
            data = raw.tobytes()
            words = [data[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())]
            block = (task << MADE_BITS) + made
            made += 1
            ids = part.column(0)
            packed = _pack(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64),
                           ids.is_valid().to_numpy(zero_copy_only=False), ~training, first, which)
            rows = [(block, packed, None, None, None)]
            rows += [(block, None, i, words[i : i + WORDS_A_ROW], counts[i : i + WORDS_A_ROW])
                     for i in range(0, len(words), WORDS_A_ROW)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _pack(ids, valid, out, first, which) -> bytes:
    parts = [np.array([len(ids)], np.int64), ids, valid.astype(np.uint8), out.astype(np.uint8), first.astype(np.int64),
             np.ascontiguousarray(which.astype("<u4").view(np.uint8).reshape(-1, 4).T)]  # byte by byte: the upper ones are nearly all zero
    return zstandard.ZstdCompressor(3).compress(b"".join(p.tobytes() for p in parts))


def _unpack(packed: bytes):
    data = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    at, out = 8, []
    for kind, size in ((np.int64, n), (np.uint8, n), (np.uint8, n), (np.int64, n + 1), (np.uint8, -1)):
        out.append(np.frombuffer(data, kind, size, at))
        at += out[-1].nbytes
    out[-1] = np.ascontiguousarray(out[-1].reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    return out


def _planes(x: np.ndarray) -> bytes:
    """Byte by byte: the upper bytes of small numbers are all zero."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _pack_words(place, c, lens, subwords):
    """(block, its words' places, counts, numbers of subwords and subwords, packed) of words in any order."""
    order = np.argsort(place)
    begin = np.cumsum(lens) - lens
    place, c, lens, subwords = place[order], c[order], lens[order], subwords[textbuf.spread(begin[order], lens[order])]
    upto = np.concatenate([[0], np.cumsum(lens)])
    blocks, at = place >> AT_BITS, (place & ((1 << AT_BITS) - 1)).astype("<u4")
    cuts = np.concatenate([np.flatnonzero(np.diff(blocks, prepend=-1)), [len(place)]])
    packer = zstandard.ZstdCompressor(3)
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        parts = [np.array([b - a], np.int64).tobytes(), _planes(np.diff(at[a:b], prepend=at.dtype.type(0))), _planes(c[a:b].astype("<i8")),
                 _planes(lens[a:b].astype("<u4")), _planes(subwords[upto[a] : upto[b]])]
        yield int(blocks[a]), packer.compress(b"".join(parts))


def _unpack_words(rows: list[bytes], kind: str):
    """Counts, numbers of subwords and subwords of a block's words, in the order of their places."""
    kinds = [np.dtype(k) for k in ("<u4", "<i8", "<u4", kind)]
    got = [[np.empty(0, k)] for k in kinds]
    for row in rows:
        data = zstandard.ZstdDecompressor().decompress(row)
        n, start = int(np.frombuffer(data, np.int64, 1)[0]), 8
        for k, out in zip(kinds, got):
            size = n * k.itemsize if out is not got[-1] else len(data) - start
            planes = np.frombuffer(data, np.uint8, size, start) if size else np.empty(0, np.uint8)
            out.append(np.ascontiguousarray(planes.reshape(k.itemsize, -1).T).view(k).ravel())
            start += size
        got[0][-1] = np.cumsum(got[0][-1], dtype="<u4")
    at, c, lens, subwords = (np.concatenate(x) for x in got)
    order, lens = np.argsort(at), lens.astype(np.int64)
    begin = np.cumsum(lens) - lens
    return c[order], lens[order], subwords[textbuf.spread(begin[order], lens[order])]


_ENCODERS: dict[str, bpe_codec.BatchEncoder] = {}


def _subwords(path: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and offsets of an array of words."""
    if path not in _ENCODERS:
        _ENCODERS[path] = bpe_codec.BatchEncoder(bpe_codec.splitter(path), bpe_codec.compiled(path).encode)
    return _ENCODERS[path].encode(*textbuf.buffer_of(words))


def _forget() -> None:
    """Drops the tables of a worker that has cut words: later steps don't cut."""
    if _ENCODERS and TaskContext.get() is not None:
        _ENCODERS.clear()
        bpe_codec._COMPILED.clear()
        trim()


def score(docs: DataFrame, path: str, fit_docs: int = FIT_DOCS, seed: int = 3) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score. `path`: a byte-level BPE vocabulary file with a token for the end of a text."""
    spark = docs.sparkSession
    context = spark.sparkContext
    automaton = bpe_codec.compiled(path)
    vocabulary = len(automaton.labels)
    end_id = automaton.special["<|endoftext|>"]
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    blocks = _kept(slim.mapInArrow(lean(_blocks), "block long, packed binary, base int, words array<binary>, counts array<long>"), "lm-blocks")

    # Words of all blocks; counts over the corpus; subwords of each different word.
    listed = blocks.where("words IS NOT NULL").select("block", "base", F.posexplode(F.arrays_zip("words", "counts")).alias("i", "x"))
    place = F.shiftleft("block", AT_BITS) + F.col("base") + F.col("i")
    listed = listed.select(place.alias("place"), F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    tables = context.broadcast(automaton)

    def cut(batches):
        bpe_codec._COMPILED.setdefault(path, tables.value)
        for batch in batches:
            ids, offsets = _subwords(path, _text(batch.column(0)))
            data = ids.astype("<u2" if vocabulary <= 1 << 16 else "<u4").tobytes()
            size = 2 if vocabulary <= 1 << 16 else 4
            rows = [data[a * size : b * size] for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.binary())], ["word", "c", "ids"])

    words = _kept(listed.groupBy("word").agg(F.sum("n").alias("c")).mapInArrow(lean(cut), "word binary, c long, ids binary"), "lm-words")
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def tally(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            c = batch.column(0).to_numpy(zero_copy_only=False)
            ids = np.frombuffer(b"".join(batch.column(1).to_pylist()), kind)
            sizes = np.array([len(x) for x in batch.column(1).to_pylist()], np.int64) // np.dtype(kind).itemsize
            np.add.at(total, ids, np.repeat(c, sizes))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], ["id", "n"])

    sums = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    training = slim.where(~F.col("held_out"))
    ends = training.count()
    counts = np.zeros(vocabulary)
    for r in words.where("c > 0").select("c", "ids").mapInArrow(lean(tally), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    counts[end_id] += ends
    total, distinct = sums["n"] + ends, sums["v"] + (ends > 0)

    packed = blocks.where("packed IS NOT NULL").select(F.col("block").alias("own"), "packed")
    divisor = total + 0.5 * (distinct + 1)
    end_known, end_log = int(ends > 0), float(np.log10((ends + 0.5) / divisor))
    size = np.dtype(kind).itemsize
    # Streams are stored as ranks by count, byte by byte: the upper bytes are then mostly zero.
    order_of = np.argsort(-counts, kind="stable").astype(kind)
    rank_of = np.empty(vocabulary, kind)
    rank_of[order_of] = np.arange(vocabulary)
    ranks = context.broadcast(rank_of)

    def back(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= WORDS_HELD:
                yield from packed_rows(held)
                held, n = [], 0
        if n:
            yield from packed_rows(held)

    def packed_rows(held):
        place, c, ids = (x.combine_chunks() for x in pa.Table.from_batches(held).columns)
        offsets, data = ids.cast(pa.large_binary()).buffers()[1:]
        offsets = np.frombuffer(offsets, np.int64)[: len(ids) + 1] // size
        subwords = ranks.value[np.frombuffer(data or b"", kind)[offsets[0] : offsets[-1]]]
        rows = list(_pack_words(place.to_numpy(), c.to_numpy(), np.diff(offsets), subwords))
        for a in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[a : a + 64]), (pa.int64(), pa.binary()))], ["block", "words"])

    given = _kept(listed.select("place", "word").join(words, "word").select("place", "c", "ids")
                  .mapInArrow(lean(back), "block long, words binary"), "lm-given")

    def gather(left, right):
        """The subword streams of a block, from its words (left) and its packed documents (right)."""
        _forget()
        rows = []
        c, lens, subwords = _unpack_words(left.column("words").to_pylist(), kind)
        begin = np.cumsum(lens) - lens
        logs = np.log10((c + 0.5) / divisor)
        for block, one in zip(right.column("own").to_pylist(), right.column("packed").to_pylist()):
            ids, valid, out, first, which = _unpack(one)
            known = np.concatenate([[0], np.cumsum(c[which] > 0)])[first]
            summed = np.concatenate([[0.0], np.cumsum(logs[which])])[first]
            # Subwords of each document, then its end token.
            n = lens[which]
            upto = np.concatenate([[0], np.cumsum(n)])
            stream = subwords[np.repeat(begin[which] - upto[:-1], n) + np.arange(upto[-1])]
            bounds = upto[first]
            stream = np.insert(stream, bounds[1:], ranks.value[end_id])
            rows.append((block, _pack_streams(
                ids, valid, out, np.diff(first) + 1, np.diff(known) + end_known, np.diff(summed) + end_log,
                bounds + np.arange(len(ids) + 1), np.ascontiguousarray(stream.view(np.uint8).reshape(-1, size).T))))
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary()))], ["block", "packed"])

    streams = _kept(given.groupBy("block").cogroup(packed.groupBy("own")).applyInArrow(gather, "block long, packed binary"), "lm-streams")
    order = context.broadcast(order_of)
    ends_word = np.array([x.endswith("</w>") for x in automaton.labels])
    model = context.broadcast(_fitted(streams, order, counts, ends_word, fit_docs, seed).with_counts(counts))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def finish(batches):
        for _, (ids, valid, out, n, known, base, bounds, stream) in _unpacked(batches, order):
            scores = model.value.score(stream, bounds)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, mask=valid == 0), pa.array(out.astype(bool)), pa.array(n), pa.array(known),
                pa.array(np.full(len(ids), total, np.int64)), pa.array(base), pa.array(scores)], schema=schema)

    return _by_block(streams, finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _fitted(streams: DataFrame, order, counts: np.ndarray, ends_word: np.ndarray, fit_docs: int, seed: int) -> attention.Model:
    """The model of all training streams; `counts` are those of their subwords."""
    context = streams.sparkSession.sparkContext
    rng = np.random.default_rng(seed)
    counts = counts.astype(np.int64)
    tokens = int(counts.sum())
    column, row = attention.columns_of(counts, ends_word)
    sides = context.broadcast((column, row))
    cells = (row.max(initial=-1) + 1) * 2 * (attention.OWN_CLASSES + 2)

    def around(batches):
        seen = np.zeros(cells, np.int64)
        for _, (stream, bounds) in _training(batches, order):
            # Nothing is before a document's first subword but the end token of another.
            seen += attention.contexts(stream, *sides.value)
        return seen

    seen = _summed(streams, around, cells).astype(np.int64)
    class_of = attention.classes_of(counts, seen, ends_word, rng)
    classes = context.broadcast(class_of)

    def follow(batches):
        seen = np.zeros(attention.CLASSES**2, np.int64)
        for _, (stream, bounds) in _training(batches, order):
            seen += attention.bigrams(stream, bounds, classes.value)
        return seen

    p = attention.start(_summed(streams, follow, attention.CLASSES**2), rng)
    first = FIRST_WINDOWS * fit_docs
    later = max(0, tokens // TOKENS_A_WINDOW - first)

    def share(block, stream, bounds, n, turn):
        """Windows of a block: its part of `n` by tokens, rounded at random."""
        own = np.random.default_rng([seed, turn, block])
        return attention.windows(stream, bounds, classes.value, int(n * len(stream) / tokens + own.random()), own)

    def sample(batches):
        for block, (stream, bounds) in _training(batches, order):
            drawn = share(block, stream, bounds, first, 0)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([drawn.tobytes()], pa.binary())], ["block", "drawn"])

    got = sorted((r["block"], r["drawn"]) for r in _by_block(streams, sample, "block long, drawn binary").collect())
    drawn = np.frombuffer(b"".join(x for _, x in got), np.int16).reshape(-1, attention.SPAN + 1)
    p = attention.fit(p, rng.permutation(drawn))
    for turn in range(1, ROUNDS + 1) if later else ():
        now = context.broadcast(p)

        def refine(batches):
            total = np.zeros(attention.flat(now.value).size + 1)
            for block, (stream, bounds) in _training(batches, order):
                drawn = share(block, stream, bounds, later / ROUNDS, turn)
                if len(drawn):
                    total += len(drawn) * np.append(attention.flat(attention.fit(now.value, drawn, LATER_RATE / turn)), 1)
            return total

        total = _summed(streams, refine, attention.flat(p).size + 1)
        if total[-1]:
            p = attention.unflat(total[:-1] / total[-1], p)
    return attention.model_of(class_of, p)


def _pack_streams(*parts) -> bytes:
    """Ids, valid, held out, tokens, known, base score and bounds of the documents, and their subwords."""
    return zstandard.ZstdCompressor(3).compress(b"".join([np.array([len(parts[0])], np.int64).tobytes(), *(x.tobytes() for x in parts)]))


def _unpacked(batches, order):
    """(block, its parts), subwords by the broadcast `order` of their ranks."""
    _forget()
    kind = order.value.dtype
    for batch in batches:
        for block, packed in zip(*batch.to_pydict().values()):
            data = zstandard.ZstdDecompressor().decompress(packed)
            n = int(np.frombuffer(data, np.int64, 1)[0])
            at, out = 8, []
            for t, length in ((np.int64, n), (np.uint8, n), (np.uint8, n), (np.int64, n), (np.int64, n), (np.float64, n), (np.int64, n + 1), (np.uint8, -1)):
                out.append(np.frombuffer(data, t, length, at) if at < len(data) else np.empty(0, t))
                at += out[-1].nbytes
            out[-1] = order.value[np.ascontiguousarray(out[-1].reshape(kind.itemsize, -1).T).view(kind).ravel()]
            yield block, out


def _training(batches, order):
    """(block, (subwords, bounds)) of the training documents of each block."""
    for block, (_, _, out, _, _, _, bounds, stream) in _unpacked(batches, order):
        n = np.diff(bounds)
        yield block, (stream[np.repeat(out == 0, n)], np.concatenate([[0], np.cumsum(n[out == 0])]))


def _by_block(streams: DataFrame, run, schema: str) -> DataFrame:
    run = lean(run)
    streams.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BLOCKS_A_BATCH)
    return streams.mapInArrow(run, schema)


def _summed(streams: DataFrame, run, size: int) -> np.ndarray:
    """The arrays that `run` makes of each task's batches, added up; only what isn't zero is exchanged."""

    def rows(batches):
        total = run(batches)
        some = np.flatnonzero(total)
        for a in range(0, len(some), 1 << 16):
            i = some[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(total[i].astype(np.float64))], ["i", "x"])

    got = _by_block(streams, rows, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(size)
    out[got.column("i").to_numpy()] = got.column("x").to_numpy()
    return out


def _kept(df: DataFrame, what: str) -> DataFrame:
    """`stored`, and what the write has shuffled is removed with its end, not when the driver collects garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return stored(df, what)
    finally:
        conf.set(key, before)


def _text(column: pa.Array) -> pa.Array:
    """Bytes as text; words are cut at ASCII bytes, so they are whole characters."""
    return column.cast(pa.string())
