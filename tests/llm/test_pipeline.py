"""The pipeline's stages against its operators' brute-force results, and on odd tables."""

import hashlib
import re

import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline

UPPER = {c: c + 32 for c in range(65, 91)}


def test_stage_contract(spark, docs, no_docs, sf_dir):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns and kept.count() <= docs.count()
        assert stage(spark, no_docs, sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, sf_dir).count() == 0


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(UPPER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def one_of_each_group(texts):
    """The smallest id of each component of fingerprints at two or fewer bits."""
    prints = {i: fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i for i in prints if top(i) == i}


def windows(text, size=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(UPPER))
    n = min(size, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set(), words


def holds_a_passage(text, passages):
    words = windows(text)[1]
    return any(tuple(words[i : i + n]) in passages for n in {len(p) for p in passages} for i in range(len(words) - n + 1))


@pytest.fixture(scope="module")
def planted(spark, sf_dir, tmp_path_factory):
    """documents and benchmark of the test data, and long documents with one benchmark passage, copies and near copies."""
    folder = tmp_path_factory.mktemp("planted")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = documents.collect()
    passage = max((r["text"] for r in bench.collect() if r["text"]), key=len)
    long = sorted((r for r in rows if r["text"] and r["lang"]), key=lambda r: -len(set(r["text"].split())))[:12]
    more = []
    for k, r in enumerate(long):
        words = r["text"].split(" ")
        text = [" ".join([*words[: len(words) // 2], passage, *words[len(words) // 2 :]]), r["text"], r["text"] + " zuletzt"][k % 3]
        more.append((10_000_000 + k, text, r["lang"], r["source"], len(text)))
    extra = spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long")
    extra = extra.select([extra[f.name].cast(f.dataType) for f in documents.schema])
    documents.unionByName(extra).write.parquet(f"{folder}/documents.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_run_against_brute_force(spark, planted):
    """Verdicts of the two fitted stages are taken as given; all the rest is found by hand."""
    documents = spark.read.parquet(f"{planted}/documents.parquet")
    by_language = corpus_pipeline.language(spark, documents, planted)
    by_quality = corpus_pipeline.quality(spark, by_language, planted)
    texts = {r["doc_id"]: r["text"] for r in by_quality.collect()}
    assert len(texts) == by_quality.count() and all(len(re.findall(r"[^\x20\x09-\x0D]+", t)) >= 50 for t in texts.values())
    groups = one_of_each_group(texts)
    passages = set().union(*[windows(r["text"])[0] for r in spark.read.parquet(f"{planted}/benchmark.parquet").collect() if r["text"]])
    clean = {i for i in groups if not holds_a_passage(texts[i], passages)}
    assert 0 < len(clean) < len(groups) < len(texts) < documents.count()

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for i in sorted(clean):
        ids = library.encode(texts[i], add_special_tokens=False).ids
        expected.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = corpus_pipeline.run(spark, planted)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == expected
