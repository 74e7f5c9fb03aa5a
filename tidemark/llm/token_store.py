"""Token ids as a content-addressed store.

Layout of a store folder, all Parquet, written by Spark and so by any file system it knows:

- `chunks`   digest, payload: each different chunk once. A rolling hash over the last WINDOW ids
             cuts an id stream where its low bits are zero, so equal passages give equal
             chunks wherever they lie; the digest is BLAKE2b-128 of the payload, which is the
             ids as little-endian unsigned 16-bit integers (32-bit if the vocabulary asks for it).
- `recipes`  in ascending doc_id order: block, doc_id, tie (tells repeated doc_ids apart), start
             (ids of all documents before it), n_tokens, digests and counts of its chunks in
             order, root (Merkle root over the digests). A block is a range of doc_ids.
- `manifest` per block: documents, ids, Merkle root over the documents' roots; and one row with
             block -1, the root over the blocks' roots.

Reading verifies: payloads against digests, digests against roots, roots against the manifest.

Defined cases: a null or empty text has only its end id; documents of equal doc_id, or none,
are kept apart and lie next to each other, those without one first; an empty table writes an
empty store.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe_codec, textbuf
from .shared import fresh_dir, lean

WINDOW, CUT_BITS, LONGEST = 16, 9, 4096
BLOCK_DOCS = 200_000
WORDS_A_CALL = 256
#: Bytes that may be white space, or begin it: controls, the space, and leads of U+0080, U+1680, U+2000 and U+3000.
_MAYBE_SPACE = np.isin(np.arange(256), [*range(0x21), 0xC2, 0xE1, 0xE2, 0xE3])
_GEAR = np.random.default_rng(50).integers(0, 2**63, 1 << 17, dtype=np.uint64).astype(np.uint32)

CHUNKED = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("digests", T.ArrayType(T.BinaryType())),
    T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("payloads", T.ArrayType(T.BinaryType())),
    T.StructField("root", T.BinaryType())])


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over the leaves; an odd node moves up as it is."""
    while len(leaves) > 1:
        leaves = [digest(b"".join(leaves[i : i + 2])) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else b""


def cut_points(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a batch of documents; a document's cuts depend on its ids alone."""
    # Bits from WINDOW + CUT_BITS on are never asked for, and none below depends on them.
    h, reach = _GEAR[ids & (len(_GEAR) - 1)], 1
    while reach < WINDOW:  # the sum over 2 * reach ids from that over reach; WINDOW is a power of two
        h[reach:] += h[:-reach] << np.uint32(reach)  # the right side is made whole before it is added
        reach *= 2
    # Bits under the window's reach mix all WINDOW ids only from bit WINDOW - 1 on.
    hit = np.flatnonzero(h & np.uint32(((1 << CUT_BITS) - 1) << WINDOW) == 0) + 1
    doc = np.searchsorted(offsets, hit - 1, "right") - 1
    hit = hit[hit - offsets[doc] >= WINDOW]
    ends = np.union1d(hit, offsets[1:])
    sizes = np.diff(ends, prepend=0)
    if (sizes > LONGEST).any():
        more = [np.arange(e - s + LONGEST, e, LONGEST) for e, s in zip(ends, sizes) if s > LONGEST]
        ends = np.union1d(ends, np.concatenate(more))
    return ends


def _library_pieces(path: str):
    """Encodes different pieces with the tokenizers library.

    Where the file keeps spaces, its pattern cuts before any space that stands between other characters, and on both
    sides of a newline there. So pieces without white space but a space before them are given to it WORDS_A_CALL in
    one text, and those without any so with a newline after each; their ids are told apart by their bytes.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    split = bpe_codec.splitter(path)
    library = split.library
    # A byte is one character of a byte-level token.
    width = np.zeros(library.get_vocab_size(), np.int64)
    for token, i in library.get_vocab().items():
        width[i] = len(token)

    def flat_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(ids)), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def together(data: bytes, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that end at `stop`, and where those of each end."""
        bounds = [0, *stop[WORDS_A_CALL - 1 :: WORDS_A_CALL].tolist()]
        bounds += [len(data)] if bounds[-1] < len(data) else []
        ids, _ = flat_ids([data[a:b].decode() for a, b in zip(bounds, bounds[1:])])
        return ids, np.searchsorted(np.cumsum(width[ids]), stop) + 1

    def encode(raw, starts, ends):
        size = ends - starts
        stop = np.cumsum(size)
        data = raw[textbuf.spread(starts, size)]
        try:
            data.tobytes().decode()
            joins = split.keeps_space
        except UnicodeDecodeError:  # a replaced character has other bytes
            joins = False
        spaced, alone = np.zeros(len(size), bool), np.zeros(len(size), bool)
        if joins and len(data):
            spaced = (size > 1) & (raw[starts] == 0x20)
            blanks = np.concatenate([[0], np.cumsum(_MAYBE_SPACE[data])])
            blanks = blanks[stop] - blanks[stop - size]
            spaced, alone = spaced & (blanks == 1), blanks == 0
        with_space, bare, one = np.flatnonzero(spaced), np.flatnonzero(alone), np.flatnonzero(~spaced & ~alone)
        whole = data.tobytes()
        singles, single_counts = flat_ids([whole[b - n : b].decode("utf-8", "replace") for b, n in zip(stop[one].tolist(), size[one].tolist())])
        words, last = together(data[np.repeat(spaced, size)].tobytes(), np.cumsum(size[with_space]))
        lines = np.insert(data[np.repeat(alone, size)], np.cumsum(size[bare]), 0x0A)
        bares, bare_last = together(lines.tobytes(), np.cumsum(size[bare] + 1))
        counts, at = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        counts[with_space], counts[one] = np.diff(last, prepend=0), single_counts
        at[with_space], at[one] = last - counts[with_space], len(words) + np.cumsum(single_counts) - single_counts
        counts[bare] = np.diff(bare_last, prepend=0)
        at[bare] = len(words) + len(singles) + bare_last - counts[bare]
        counts[bare] -= 1  # the newline's id
        return np.concatenate([words, singles, bares])[textbuf.spread(at, counts)], np.concatenate([[0], np.cumsum(counts)])

    return encode


_WORKER: dict[str, bpe_codec.BatchEncoder] = {}


def _binary(data: bytes, bounds: np.ndarray) -> pa.Array:
    """The pieces of `data` between bounds, without an object for each."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])


def chunked(docs: DataFrame, path: str, text: str = "text", into: str = "chunked", end_id: int = 0) -> DataFrame:
    """`docs` and the struct CHUNKED of each text's ids with `end_id` after them, as column `into`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _WORKER:
            _WORKER[path] = bpe_codec.BatchEncoder(bpe_codec.splitter(path), _library_pieces(path))
        kind = "<u2" if _WORKER[path].split.library.get_vocab_size() <= 1 << 16 else "<u4"
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for lo, hi in textbuf.slices(batch, text):
                ids, offsets = _WORKER[path].encode(*textbuf.buffer_of(column.slice(lo, hi - lo)))
                ids = np.insert(ids, offsets[1:], end_id)
                offsets = offsets + np.arange(len(offsets))
                ends = cut_points(ids, offsets)
                # Every document ends in its end id, so its chunks follow those of the one before.
                parts = np.concatenate([[0], np.searchsorted(ends, offsets[1:], "right")]).astype(np.int32)
                data, size = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
                bounds = np.concatenate([[0], ends * size]).astype(np.int32)
                view, at = memoryview(data), bounds.tolist()
                digests = [digest(view[a:b]) for a, b in zip(at, at[1:])]
                roots = [merkle(digests[a:b]) for a, b in zip(parts[:-1].tolist(), parts[1:].tolist())]
                listed = lambda values: pa.ListArray.from_arrays(pa.array(parts), values)
                found = pa.StructArray.from_arrays([
                    pa.array(np.diff(offsets), pa.int64()), listed(_binary(b"".join(digests), np.arange(len(digests) + 1) * 16)),
                    listed(pa.array(np.diff(bounds) // size, pa.int32())), listed(_binary(data, bounds)),
                    pa.array(roots, pa.binary())], ["n_tokens", "digests", "counts", "payloads", "root"])
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, found], [*batch.schema.names, into])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema, T.StructField(into, CHUNKED)]))


def write(docs: DataFrame, folder: str, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> str:
    """Writes the store of `docs`; texts are encoded once, into a part of the folder that is read twice."""
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
                       F.monotonically_increasing_id().alias("tie"))
    staged = f"{folder}/staged"
    chunked(slim, path, "text", "c", end_id).select("doc_id", "tie", "c.*").write.option("compression", "zstd").parquet(staged)
    staged = spark.read.parquet(staged)
    # A chunk that many documents share is reduced to one before the exchange.
    each = staged.select(F.explode(F.arrays_zip("digests", "payloads")).alias("x")).select(
        F.col("x.digests").alias("digest"), F.col("x.payloads").alias("payload"))
    each.dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{folder}/chunks")

    recipes = staged.drop("payloads")
    rows = recipes.count()
    blocks = max(1, min(4096, max(rows // BLOCK_DOCS, min(64, rows // 500))))
    bounds = recipes.select(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)] or [0.5], 100 * blocks)).first()[0]
    bounds = sorted(set(bounds or []))
    # The block is the number of bounds below the id, found by halving in a literal array.
    block = F.expr(f"IF(doc_id IS NULL, 0, {_block_of(bounds)})")
    recipes = recipes.withColumn("block", block.cast("int"))
    sums = {r["block"]: r["n"] for r in recipes.groupBy("block").agg(F.sum("n_tokens").alias("n")).collect()}
    before, total = {}, 0
    for b in sorted(sums):
        before[b] = total
        total += sums[b]
    base = F.create_map(*[F.lit(x) for b, n in before.items() for x in (b, n)])[F.col("block")] if before else F.lit(0)
    within = Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_first(), "tie")
    start = (F.sum("n_tokens").over(within) - F.col("n_tokens") + base).cast("long")
    ordered = recipes.withColumn("start", start).select("block", "doc_id", "tie", "start", "n_tokens", "digests", "counts", "root")
    ordered.repartitionByRange(max(1, len(before)), "block").sortWithinPartitions("block", "start").write.parquet(f"{folder}/recipes")

    per_block = spark.read.parquet(f"{folder}/recipes").transform(_block_roots)
    rows = per_block.collect()  # one row a block
    top = merkle([bytes(r["root"]) for r in sorted(rows, key=lambda r: r["block"])])
    everything = [(r["block"], r["documents"], r["ids"], r["root"]) for r in rows] + [
        (-1, sum(r["documents"] for r in rows), total, bytearray(top))]
    spark.createDataFrame(everything, per_block.schema).coalesce(1).write.parquet(f"{folder}/manifest")
    return folder


def _block_of(bounds: list[int], lo: int = 0) -> str:
    """SQL for the number of bounds that are below doc_id, as nested halving."""
    if not bounds:
        return str(lo)
    mid = len(bounds) // 2
    return f"IF(doc_id <= {bounds[mid]}, {_block_of(bounds[:mid], lo)}, {_block_of(bounds[mid + 1:], lo + mid + 1)})"


def _block_roots(recipes: DataFrame) -> DataFrame:
    """(block, documents, ids, root); a block has about BLOCK_DOCS documents, 16 bytes of root each."""
    listed = recipes.groupBy("block").agg(
        F.count("*").alias("documents"), F.sum("n_tokens").alias("ids"),
        F.sort_array(F.collect_list(F.struct("start", "root"))).alias("roots"))

    def run(batches):
        for batch in batches:
            roots = [merkle([x["root"] for x in r]) for r in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(roots, pa.binary())], ["block", "documents", "ids", "root"])

    return listed.mapInArrow(lean(run), "block int, documents long, ids long, root binary")


_SHIFT: list[np.ndarray] = []


def _shift_tables() -> list[np.ndarray]:
    """For k = 0..39: tables [4][256] that move a CRC-32 over 2**k zero bytes, linear over GF(2)."""
    if not _SHIFT:
        poly = 0xEDB88320
        one = []  # columns: what a single zero byte does to each bit
        for bit in range(32):
            x = 1 << bit
            for _ in range(8):
                x = (x >> 1) ^ (poly if x & 1 else 0)
            one.append(x)
        columns = np.array(one, np.uint32)
        for _ in range(40):
            table = np.zeros((4, 256), np.uint32)
            for byte in range(4):
                for bit in range(8):
                    table[byte, (np.arange(256) >> bit) & 1 == 1] ^= columns[8 * byte + bit]
            _SHIFT.append(table)
            columns = _moved(columns, table)
    return _SHIFT


def _moved(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def crc_shift(crc: np.ndarray, zero_bytes: np.ndarray) -> np.ndarray:
    """What crc32(a) adds to crc32(a + b), where b has `zero_bytes` bytes; xor of the parts is the whole."""
    crc = crc.astype(np.uint32)
    for k, table in enumerate(_shift_tables()):
        on = (zero_bytes >> k) & 1 == 1
        if on.any():
            crc[on] = _moved(crc[on], table)
    return crc


def _wide(payload: bytes, width: int) -> bytes:
    return payload if width == 4 else np.frombuffer(payload, "<u2").astype("<u4").tobytes()


def _width(spark: SparkSession, folder: str) -> int:
    one = spark.read.parquet(f"{folder}/recipes").where("n_tokens > 0").select("digests", "counts").limit(1).collect()
    if not one:
        return 2
    key, n = one[0]["digests"][0], one[0]["counts"][0]
    size = spark.read.parquet(f"{folder}/chunks").where(F.col("digest") == F.lit(key)).select(F.octet_length("payload")).first()[0]
    return size // n


def verified(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the store and verified.

    The CRC of all of a document's ids (as 32-bit integers) is put together from its chunks'
    CRCs: each is moved over the bytes that follow it and the results are xor-ed, so chunks are
    read once however many documents share them, and nothing gathers a document.
    """
    width = _width(spark, folder)

    def read(batches):
        for batch in batches:
            out = []
            for key, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest(payload) != key:
                    raise ValueError(f"chunk {key.hex()} has other content")
                out.append({"digest": key, "n": len(payload) // width, "crc": zlib.crc32(_wide(payload, width))})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("digest", pa.binary()), ("n", pa.int32()), ("crc", pa.int64())]))

    chunks = spark.read.parquet(f"{folder}/chunks").select("digest", "payload").mapInArrow(lean(read), "digest binary, n int, crc long")

    def rooted(batches):
        for batch in batches:
            for digests, counts, n, root in zip(*(batch.column(k).to_pylist() for k in ("digests", "counts", "n_tokens", "root"))):
                if merkle(digests) != root or sum(counts) != n:
                    raise ValueError("a recipe doesn't match its root")
            yield batch.select(["doc_id", "tie", "start", "n_tokens", "digests", "counts"])

    recipes = spark.read.parquet(f"{folder}/recipes")
    wrong = recipes.transform(_block_roots).join(
        spark.read.parquet(f"{folder}/manifest").select("block", F.col("root").alias("stated")), "block", "left").where(
        "NOT (root <=> stated)").limit(1).count()
    if wrong:
        raise ValueError("a block of recipes doesn't match the manifest")
    recipes = recipes.select("doc_id", "tie", "start", "n_tokens", "digests", "counts", "root").mapInArrow(
        rooted, "doc_id long, tie long, start long, n_tokens long, digests array<binary>, counts array<int>")
    refs = recipes.select("doc_id", "tie", "start", "n_tokens", F.posexplode(F.arrays_zip("digests", "counts")).alias("at", "x"),
                          F.col("counts").alias("all")).select(
        "doc_id", "tie", "start", "n_tokens", F.col("x.digests").alias("digest"), F.col("x.counts").alias("count"),
        F.aggregate(F.slice("all", F.col("at") + 2, F.size("all")), F.lit(0).cast("long"), lambda a, c: a + c).alias("after"))

    def moved(batches):
        for batch in batches:
            n, count = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("n", "count"))
            if not np.array_equal(n, count):
                raise ValueError("a chunk has another size than its recipe says")
            part = crc_shift(batch.column("crc").to_numpy(zero_copy_only=False), 4 * batch.column("after").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "tie", "start", "n_tokens", "count")),
                                              pa.array(part.astype(np.int64))], ["doc_id", "tie", "start", "n_tokens", "count", "part"])

    # A chunk that isn't there has no size, which `moved` refuses.
    parts = refs.join(chunks, "digest", "left").select("doc_id", "tie", "start", "n_tokens", "count", "n", "crc", "after").mapInArrow(
        moved, "doc_id long, tie long, start long, n_tokens long, count int, part long")
    whole = parts.groupBy("start", "tie", "doc_id").agg(F.max("n_tokens").alias("stated"), F.sum("count").alias("n_tokens"),
                                                       F.bit_xor("part").alias("ids_crc32"))
    complete = F.when(F.col("stated") == F.col("n_tokens"), F.col("n_tokens")).otherwise(
        F.raise_error(F.lit("a document lacks chunks")).cast("long"))
    return whole.select("doc_id", "start", complete.alias("n_tokens"), "ids_crc32")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, ids (array<int>) of every document, rebuilt from the store."""
    width = _width(spark, folder)
    refs = spark.read.parquet(f"{folder}/recipes").select("doc_id", "tie", "start", F.posexplode("digests").alias("at", "digest"))
    whole = refs.join(spark.read.parquet(f"{folder}/chunks"), "digest").groupBy("start", "tie", "doc_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "payload"))).alias("x"))

    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(b"".join(y["payload"] for y in x), f"<u{width}").astype(np.int32) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))],
                                             ["doc_id", "start", "ids"])

    return whole.select("doc_id", "start", "x").mapInArrow(lean(run), "doc_id long, start long, ids array<int>")


def new_folder(spark: SparkSession) -> str:
    return fresh_dir(spark, "token-store")
