"""Decontamination, SimHash, sharding and BPE against brute force, with odd rows, repeated rows and empty tables."""

import random
import math
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe_automaton, bpe_codec, components, decontaminate, presplit, sharding, simhash_ball, textbuf, token_store

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD6 = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_hits(text, items, size=13):
    w = WORD6.findall((text or "").translate(ASCII_LOWER))
    hit, found = set(), set()
    for i, t in items:
        v = WORD6.findall((t or "").translate(ASCII_LOWER))
        n = min(size, len(v))
        if i is None or not n:
            continue
        windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination(spark, texts, docs, no_docs, block_bytes):
    items = [(1, " ".join(texts[2].split()[:20])), (2, "Zwei, WÖRTER!"), (3, texts[3]), (3, texts[3]), (10, "x"), (None, texts[4]), (5, None), (6, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("found", F.lit(1))
    got = decontaminate.find(docs, bench, "hits", block_bytes=block_bytes)
    rows = got.select("text", F.col("hits.n_words").alias("n"), decontaminate.hit_words(F.col("hits")).alias("h"), "hits.items", "hits.spans").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["n"], r["h"], r["items"]) == brute_hits(r["text"], items), r["text"]
    assert decontaminate.find(no_docs, bench, "hits").count() == 0
    assert decontaminate.find(docs, bench.limit(0), "hits").where(decontaminate.contaminated(F.col("hits"))).count() == 0


def test_a_passage_in_a_long_document_is_enough(spark):
    passage = " ".join(f"p{i}" for i in range(13))
    rest = " ".join(f"w{i}" for i in range(600))
    docs = spark.createDataFrame([(1, f"{rest} {passage} {rest}"), (2, rest), (3, passage.rsplit(" ", 1)[0]), (4, None), (5, "")], "doc_id long, text string")
    bench = spark.createDataFrame([("b", passage)], "item_id string, text string")
    left = lambda twentieths: {r["doc_id"] for r in decontaminate.remove_documents(docs, bench, twentieths).collect()}
    assert left(0) == {2, 3, 4, 5} and left(1) == {1, 2, 3, 4, 5}


def test_removal(spark, docs):
    bench = spark.createDataFrame([(1, "Zwei Wörter")], "item_id long, text string")
    kept = decontaminate.remove_documents(docs, bench)
    assert kept.columns == docs.columns and kept.where("text = 'Zwei Wörter'").count() == 0 and kept.count() == docs.count() - 1
    long = spark.createDataFrame([(1, "vorne Zwei, Wörter hinten")], "doc_id long, text string")
    cut = decontaminate.remove_spans(long, spark.createDataFrame([(1, "zwei wörter")], "item_id long, text string"))
    assert cut.first()["text"] == "vorne  hinten"


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_classes(spark, docs, no_docs):
    rows = simhash_ball.classes(docs).withColumn("hex", simhash_ball.hex16()).collect()
    source = [(r["doc_id"], brute_print(r["text"])) for r in docs.collect()]
    assert Counter((r["doc_id"], r["hex"]) for r in rows) == Counter((i, f"{p:016x}") for i, p in source)
    label = {i: i for i, _ in source if i is not None}
    prints = {i: p for i, p in source}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if bin(prints[a] ^ prints[b]).count("1") <= 2 and label[a] > label[b]:
                    label[a], changed = label[b], True
    for r in rows:
        if r["doc_id"] is not None:
            assert r["component_id"] == label[r["doc_id"]]
    assert simhash_ball.classes(no_docs).count() == 0
    kept = simhash_ball.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(set(label.values()))


@pytest.mark.parametrize("step", [7, 1 << 16])
def test_fingerprints_in_steps(texts, monkeypatch, step):
    monkeypatch.setattr(simhash_ball, "SHINGLES_A_STEP", step)
    some = [t for t in texts if len(t or "") < 5000] + ["a\tb\r\n\x0bc  D", " lead", "trail ", "ab c", "a bc"]
    made = simhash_ball.fingerprints(*textbuf.buffer_of(pa.array(some, pa.string())), 3, 42)
    assert made.tolist() == [brute_print(t) for t in some]
    assert not len(simhash_ball.fingerprints(*textbuf.buffer_of(pa.array([], pa.string())), 3, 42))


def test_links_find_all_within_two_bits(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 20)
    prints = {int(b) ^ sum(1 << int(k) for k in rng.choice(63, n, replace=False)) for b in base for n in (0, 1, 2, 2, 3)}
    made = simhash_ball.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()
    assert all(bin(r["a"] ^ r["b"]).count("1") <= 2 for r in made)
    want = {frozenset((a, b)) for a in prints for b in prints if a < b and bin(a ^ b).count("1") <= 2}

    def classes(pairs):
        up = {p: p for p in prints}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[top(a)] = top(b)
        return {frozenset(p for p in prints if top(p) == top(q)) for q in prints}

    assert classes(tuple(x) for x in want) == classes((r["a"], r["b"]) for r in made)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (100, 100)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.smallest_reachable(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


@pytest.mark.parametrize("literal", [4096, 0])
def test_shards_are_exact(spark, docs, no_docs, monkeypatch, literal):
    monkeypatch.setattr(sharding, "LITERAL_BLOCKS", literal)
    dealt = sharding.shuffle(docs, 7, block_rows=3).select("doc_id", "text", "shard", "slot").collect()
    assert Counter((r["doc_id"], r["text"]) for r in dealt) == Counter((r["doc_id"], r["text"]) for r in docs.collect())
    sizes = Counter(r["shard"] for r in dealt)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in dealt if r["shard"] == s) == list(range(n))
    assert sharding.shuffle(no_docs, 3).count() == 0


def test_matrix_follows_the_hypergeometric_law():
    rows, columns = np.array([30, 50, 20]), np.array([40, 60])
    mean = np.mean([sharding.communication_matrix(rows, columns, s) for s in range(400)], 0)
    assert np.allclose(mean, np.outer(rows, columns) / 100, atol=0.8)
    one = sharding.communication_matrix(rows, columns, 1)
    assert (one.sum(0) == columns).all() and (one.sum(1) == rows).all()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_codec_equals_the_library(docs, no_docs, name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    coded = bpe_codec.decode(bpe_codec.encode(docs, path), path).select("text", "ids", "decoded").collect()
    assert len(coded) == docs.count()
    for r in coded:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids
        if name.startswith("word"):
            assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe_codec.encode(no_docs, path).count() == 0


def test_automaton_states_forbid_what_bpe_never_makes():
    vocab = {c: i for i, c in enumerate(["a", "b", "c", "ab", "abc", "bc", "aa"])}
    made = bpe_automaton.build(vocab, [("a", "b"), ("ab", "c"), ("b", "c"), ("a", "a")], "", {})
    base = np.frombuffer(b"aabcbcab", np.uint8)
    ids, _ = made.encode(base, np.array([0]), np.array([8]))
    assert [made.labels[i] for i in ids] == ["a", "abc", "bc", "ab"]
    allowed = lambda x, y: bool(made.allowed(made.state[[vocab[x]]], np.array([vocab[y]]))[0])
    assert not allowed("a", "b") and not allowed("ab", "c") and not allowed("a", "aa") and allowed("b", "a")


def test_long_words_take_the_same_tables():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    encoder = bpe_codec.BatchEncoder(bpe_codec.splitter(path), bpe_codec.compiled(path).encode)
    import pyarrow as pa

    for text in ("ab" * 700, "#" * 3000, "x" * 257):
        assert encoder.encode(*textbuf.buffer_of(pa.array([text])))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_unknown_vocabulary_files_are_refused(tmp_path):
    import json

    spec = json.loads(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    spec["normalizer"] = {"type": "NFD"}
    (tmp_path / "x.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        presplit.Splitter(str(tmp_path / "x.json"))


def test_token_store_round_trip(spark, docs, no_docs, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    folder = token_store.write(docs, token_store.new_folder(spark), path)
    start, want = 0, []
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, ids))
        start += len(ids)
    got = token_store.verified(spark, folder).collect()
    assert Counter((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter(
        (i, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, s, x in want)
    assert Counter((r["doc_id"], r["start"], tuple(r["ids"])) for r in token_store.read_ids(spark, folder).collect()) == Counter(
        (i, s, tuple(x)) for i, s, x in want)
    chunks = spark.read.parquet(f"{folder}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert token_store.verified(spark, token_store.write(no_docs, token_store.new_folder(spark), path)).count() == 0


def test_a_changed_chunk_is_noticed(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = token_store.write(docs, token_store.new_folder(spark), path)
    bad = spark.read.parquet(f"{folder}/chunks").withColumn("payload", F.concat(F.substring("payload", 3, 1 << 20), F.lit("xx").cast("binary")))
    bad.write.parquet(f"{folder}/other")
    chunks = spark.read.parquet(f"{folder}/other")
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks")
    with pytest.raises(Exception, match="content"):
        token_store.verified(spark, folder).collect()


def test_a_missing_chunk_is_noticed(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(50))), (2, None), (3, "a b")], "doc_id long, text string")
    folder = token_store.write(docs, token_store.new_folder(spark), public_tokenizers.path("byte_bpe_50k.json"))
    assert token_store.verified(spark, folder).count() == 3
    spark.read.parquet(f"{folder}/chunks").where("octet_length(payload) > 2").write.parquet(f"{folder}/other")
    spark.read.parquet(f"{folder}/other").write.mode("overwrite").parquet(f"{folder}/chunks")
    with pytest.raises(Exception, match="another size"):
        token_store.verified(spark, folder).collect()


def test_crc_parts():
    rng = np.random.default_rng(2)
    a, b = rng.bytes(1000), rng.bytes(12_345)
    moved = token_store.crc_shift(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))[0]
    assert int(moved) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_merkle_roots_differ():
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(5)]
    assert token_store.merkle(leaves) != token_store.merkle(leaves[::-1]) and token_store.merkle([]) == b""


def test_forgotten_pieces_are_encoded_again(monkeypatch, texts):
    import pyarrow as pa

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(bpe_codec, "KEPT_PIECES", 40)
    encoder = bpe_codec.BatchEncoder(bpe_codec.splitter(path), bpe_codec.compiled(path).encode)
    for t in [*texts, *texts]:
        ids, _ = encoder.encode(*textbuf.buffer_of(pa.array([t], pa.string())))
        assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_decoding_in_the_same_pass(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    both = bpe_codec.encode(docs, path, decoded="said")
    assert both.columns == [*docs.columns, "ids", "said"]
    assert bpe_codec.decode(both, path).where("NOT (decoded <=> said)").count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_simhash_links_connect_all_within_the_radius(spark, radius):
    rng = random.Random(radius)
    prints = {2, 3, 4, 6, -1, -(2**63)}
    for _ in range(12):
        x = rng.getrandbits(63)
        prints |= {x, x ^ 7, x ^ (1 << 62), x ^ 0b1010000}
    prints = sorted(prints)
    got = simhash_ball.links(spark.createDataFrame([(x,) for x in prints], "fp long"), radius).collect()
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert all(apart(r["a"], r["b"]) <= radius for r in got)
    root = {x: x for x in prints}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in got:
        root[up(r["a"])] = up(r["b"])
    assert all(up(a) == up(b) for a in prints for b in prints if apart(a, b) <= radius)


def test_sharding_draws_beyond_the_library_follow_the_law():
    rng = np.random.default_rng(1)
    each = 10**9 // 16 + 1
    none = np.mean([sharding._hypergeometric(rng, each, 15 * each, 10) == 0 for _ in range(4000)])
    assert abs(none - (15 / 16) ** 10) < 0.03
    got = np.bincount([sharding._inverted(rng, 7, 5, 6) for _ in range(20_000)], minlength=7) / 20_000
    assert np.allclose(got, [math.comb(7, k) * math.comb(5, 6 - k) / math.comb(12, 6) for k in range(7)], atol=0.015)
    assert sharding._inverted(rng, 10**10, 0, 10**9) == 10**9


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_told_apart_are_the_library_s(name, texts, monkeypatch):
    monkeypatch.setattr(token_store, "WORDS_A_CALL", 3)
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    pieces = [" a", "a", " ", " the", " Über", " İa", " ab½", "'s", " é", " naïve", "\n", " 你", " x", "12", " s", "!!", " " + "z" * 5000, " lo"]
    pieces += [" " + w for t in texts if t for w in t.split() if w.isascii() and w.isalpha()][:2000]
    if name.startswith("word"):
        pieces = [p.strip().lower() for p in pieces if p.strip().isascii()]
    data = [p.encode() for p in pieces]
    ends = np.cumsum([len(d) for d in data])
    starts = ends - [len(d) for d in data]
    encode = token_store._library_pieces(path)
    for part in (slice(None), slice(0, 1), slice(1, 2), slice(0, 0)):
        ids, offsets = encode(np.frombuffer(b"".join(data), np.uint8), starts[part], ends[part])
        got = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
        assert got == [library.encode(p, add_special_tokens=False).ids for p in pieces[part]]
