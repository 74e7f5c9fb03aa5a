"""Each registered query: its columns and rows by the contract, and what can be counted by hand."""

import re
import zlib

import pytest

from tidemark.llm.queries import QUERIES

LAWS = {
    "op1_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op2_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op3_lm_score": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op5_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_benchmark_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op7_token_store": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op8_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
                         "base_failed boolean, kept boolean",
    "op9_bpe_encoding": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op10_simhash_near_dedup": "doc_id bigint, fingerprint string, component_id bigint",
}


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def kind(i, n):
    return zlib.crc32(str(i).encode()) % n


def by_hand(name, rows, texts):
    if name == "op1_language_id":
        assert all(r["held_out"] == (kind(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in rows)
    if name == "op2_sharding":
        for r in rows:
            data = texts[r["doc_id"]].encode()
            assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
        by_shard = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(16)}
        assert all(slots == list(range(len(slots))) for slots in by_shard.values())
        assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    if name == "op3_lm_score":
        words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) + 1 for i, t in texts.items()}
        train = sum(n for i, n in words.items() if kind(i, 5) != 1)
        assert all((r["n_tokens"], r["train_tokens"], r["held_out"]) == (words[r["doc_id"]], train, kind(r["doc_id"], 5) == 1) for r in rows)
    if name == "op5_toxicity":
        assert all(r["held_out"] == (kind(r["doc_id"], 3) == 1) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    if name == "op8_quality_rules":
        for r in rows:
            words = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]])
            at = {}
            for k in range(len(words) - 2):
                at.setdefault(tuple(words[k : k + 3]), []).append(k)
            repeated = {k + j for places in at.values() if len(places) > 1 for k in places for j in range(3)}
            lines = [line for line in texts[r["doc_id"]].split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
            assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"], r["n_symbols"]) == (
                len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(repeated), len(re.findall(r"[#*$%&|<>]", texts[r["doc_id"]])))
            assert r["base_failed"] == (len(words) < 50 or 100 * len(repeated) > 50 * len(words)) and not (r["base_failed"] and r["kept"])


@pytest.mark.parametrize("name", sorted(LAWS))
def test_contract(spark, sf_dir, texts, name):
    df = QUERIES[name](spark, sf_dir)
    columns = dict(x.split(" ") for x in LAWS[name].split(", "))
    assert {c: t for c, t in df.dtypes if c in columns} == columns
    rows = df.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    by_hand(name, rows, texts)


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 11))
