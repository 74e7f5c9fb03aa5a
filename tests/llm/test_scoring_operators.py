"""Language ID, language-model scores, toxicity, quality and quotation links on small fixtures."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import attention, lang_id, lm_score, quote_links, toxicity, weak_quality

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = lang_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, ok = got.count(), got.where("lang = lang_pred").count()
    assert ok / n > 0.9
    assert got.where("score < 0 OR score > 1").count() == 0


def test_language_defined_cases(spark, docs, no_docs):
    rows = lang_id.identify(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert lang_id.identify(docs).count() == docs.count()
    assert lang_id.identify(no_docs).count() == 0
    assert lang_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0
    kept = lang_id.keep(docs)
    assert kept.columns == docs.columns and kept.where("text = ''").count() == 0


def test_family_comes_first():
    x = np.vstack([np.eye(4, 8) + 0.01 * k for k in range(3)]).astype(np.float32)
    model = lang_id.fit_arrays(x, ["en", "de", "fr", "es"] * 3)
    assert model.families.names == ["germanic", "romance"] and [m.names for m in model.members] == [["de", "en"], ["es", "fr"]]
    assert model.predict(x)[0] == ["en", "de", "fr", "es"] * 3


def brute_base(rows):
    tokens = {i: [*WORD.findall((t or "").translate(ASCII_LOWER)), None] for i, t in rows}
    training = [i for i in tokens if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    return tokens, training


def test_language_model_counts(spark, docs, no_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = lm_score.score(docs, path, fit_docs=20).collect()
    assert len(got) == len(rows)
    c = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            c.update([*WORD.findall((t or "").translate(ASCII_LOWER)), None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        w = [*WORD.findall((t or "").translate(ASCII_LOWER)), None]
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want[i, len(w), sum(c[x] > 0 for x in w), n, round(base, 4)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert lm_score.score(no_docs, path).count() == 0


def small_model(rng, vocabulary=30):
    lines = [rng.integers(0, vocabulary, rng.integers(1, 90)) for _ in range(30)]
    ends = np.arange(vocabulary) % 2 == 0
    return lines, attention.train(lines, vocabulary, ends).with_counts(np.bincount(np.concatenate(lines), minlength=vocabulary).astype(float))


def test_windows_score_each_token_once():
    """Against a plain loop: each token from the contexts of its own document in the window it is predicted in."""
    rng = np.random.default_rng(4)
    lines, model = small_model(rng)
    first = np.concatenate([[0], np.cumsum([len(x) for x in lines])])
    got = model.score(np.concatenate(lines), first)
    w = {k: x.astype(float) for k, x in model.weights.items()}
    stream, doc = [], []
    for d, x in enumerate(lines):
        stream += [attention.START, *model.class_of[x]]
        doc += [d] * (len(x) + 1)
    subs = np.concatenate([np.concatenate([[-1], x]) for x in lines])
    want = np.zeros(len(lines))
    for t in range(1, len(stream)):
        if stream[t] == attention.START:
            continue
        q = t - 1
        left = (q // attention.HALF - 1) * attention.HALF
        keys = [k for k in range(max(0, left), q + 1) if doc[k] == doc[q]]
        s = np.array([w["Q"][stream[q]] @ w["K"][stream[k]] + w["bias"][q - left - attention.HALF, k - left] for k in keys])
        a = np.exp(s - s.max())
        a /= a.sum()
        h = w["E"][stream[q]] + sum(x * w["V"][stream[k]] for x, k in zip(a, keys))
        z = h @ w["U"] + w["B"][stream[q]]
        want[doc[t]] += z[stream[t]] - np.log(np.exp(z - z.max()).sum()) - z.max() + model.log_share[subs[t]]
    assert np.allclose(got, want / np.log(10), rtol=1e-4)


def test_model_is_a_distribution():
    rng = np.random.default_rng(6)
    _, model = small_model(rng)
    context = np.array([3, 7, 1])
    one = [model.score(np.append(context, s), np.array([0, 4]))[0] for s in range(30)]
    base = model.score(context, np.array([0, 3]))[0]
    # All subwords together, and the start class that is never drawn, have probability one.
    assert 0.9 < sum(10 ** (x - base) for x in one) <= 1.0001


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out")
    clean, wrong = got.where("toxic = 0").count(), got.where("toxic = 0 AND predicted = 1").count()
    toxic, found = got.where("toxic = 1").count(), got.where("toxic = 1 AND predicted = 1").count()
    assert wrong <= 0.02 * clean and found >= 0.6 * toxic


def test_toxicity_defined_cases(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs, none).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert toxicity.score(no_docs, none).count() == 0
    odd = spark.createDataFrame([(0, 1, None), (None, 1, 1), (1, 0, 1), (1, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, odd).count() == docs.count()


@pytest.mark.parametrize("text, at", [
    ("You are an idiot", "targeted_insult"), ("What an idiot stands there", "insult"), ("That is not an idiot", "negated_insult"),
    ('She said he met an idiot', "reported_insult"), ("I will kill you", "threat"), ("I will not hurt them", "weak_threat"),
    ('Read this: "idiot"', "reported_insult"), ("Nothing here", None), ("idiotic", None)])
def test_grammar(text, at):
    import pyarrow as pa

    n = toxicity.counts_of(pa.array([text, None, ""]), toxicity.Lexicon.of())
    assert dict(zip(toxicity.COUNTS, n[0].tolist())) == {c: int(c == at) for c in toxicity.COUNTS}
    assert not n[1:].any()


def brute_measures(text):
    t = text or ""
    w = WORD.findall(t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(tri)
    covered = {j for i, x in enumerate(tri) if seen[x] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_quality_measures(spark, docs, no_docs):
    more = [("a b c a b c a b c",), ("x y z\nq\nx y z\n\nq",), ("a a a a",), ("éé b " * 30,), (None,), (" \n \n",)]
    every = docs.select("text").unionByName(spark.createDataFrame(more, "text string"))
    for r in weak_quality.measures(every).collect():
        want = brute_measures(r["text"])
        assert {k: r["m"][k] for k in want} == want, r["text"]
    assert weak_quality.label(no_docs).count() == 0


def test_quality_verdicts(spark):
    d = "/root/testdata/sf0.01"
    got = weak_quality.label(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet").withColumnRenamed("quality", "good"), "doc_id")
    assert got.where("base_failed AND kept").count() == 0
    good, lost = got.where("good = 1 AND NOT base_failed").count(), got.where("good = 1 AND NOT base_failed AND NOT kept").count()
    bad, left = got.where("good = 0").count(), got.where("good = 0 AND kept").count()
    assert lost <= 0.02 * good and left <= 0.1 * bad


def test_keep_equals_label(docs):
    want = weak_quality.label(docs).where("kept").count()
    kept = weak_quality.keep(docs)
    assert kept.count() == want and kept.columns == docs.columns
    clash = docs.withColumn("m", F.lit(1))
    assert weak_quality.keep(clash).columns == clash.columns


def test_em_names_the_better_class():
    patterns = {(1, 1, 1): 900, (-1, -1, 1): 60, (-1, -1, -1): 30, (1, 0, 1): 10}
    found = weak_quality.expectation_maximisation(patterns, 3)
    assert found.good > 0.8 and found.posterior((1, 1, 1)) > 0.9 and found.posterior((-1, -1, -1)) < 0.1
    assert weak_quality.expectation_maximisation({}, 3).good == 0.8


MESSAGES = [
    (1, 0, "user", "Hello everybody, how do I open the gate?"), (1, 1, "assistant", "You lift the latch first.\nThen you pull it towards you."),
    (1, 2, "user", "> You lift the latch first.\nWhich latch is that?"),
    (1, 3, "user", "On Monday, A wrote:\n>> Hello everybody, how do I open the gate?\n> You lift the latch first.\n> Then you pull it towards you.\nThank you very much indeed."),
    (1, 4, "assistant", "> Hello everybody, how do I open the gate?\nWith a key of course, my friend."),
    (1, 5, "user", "> Which latch is that?\nThe left one, said somebody."), (1, 6, "user", None), (1, 6, "user", "x"),
    (2, 0, "user", "> With a key of course, my friend.\nThat was in the other conversation."), (None, 1, "user", "> foo\nbar"), (3, None, "a", "> unknown passage here\nq")]


def test_quotation_links(spark):
    df = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string").withColumn("body", F.lit("clash"))
    rows = quote_links.link(df).orderBy("conv_id", "order_key", "body").collect()
    assert len(rows) == len(MESSAGES)
    by = {(r["conv_id"], r["turn"], r["body"]): r for r in rows}
    reply = lambda *k: (by[k]["reply_conv"], by[k]["reply_turn"], by[k]["n_quotes"], by[k]["n_linked"])
    assert reply(1, 2, "Which latch is that?") == (1, 1, 1, 1)
    assert reply(1, 3, "Thank you very much indeed.") == (1, 1, 2, 2)
    assert reply(1, 4, "With a key of course, my friend.") == (1, 0, 1, 1)
    assert reply(1, 5, "The left one, said somebody.") == (1, 2, 1, 1)
    assert reply(2, 0, "That was in the other conversation.") == (1, 4, 1, 1)
    assert reply(3, None, "q") == (None, None, 1, 0) and reply(None, 1, "bar") == (None, None, 1, 0)
    order = [r["turn"] for r in rows if r["conv_id"] == 1]
    assert order == [0, 1, 2, 5, 6, 6, 3, 4]
    assert quote_links.link(df.limit(0)).count() == 0


def test_nested_branches_stay_in_order(spark):
    said = ["zero zero zero zero", "one one one one one", "> zero zero zero zero\ntwo two two two two", "three three three",
            "> two two two two two\nfour four four four", "five five five five"]
    df = spark.createDataFrame([(9, i, "u", t) for i, t in enumerate(said)], "conv_id long, turn long, role string, text string")
    rows = quote_links.link(df).orderBy("order_key").collect()
    assert [r["turn"] for r in rows] == [0, 1, 2, 3, 4, 5]
    place = {r["turn"]: i for i, r in enumerate(rows)}
    assert all(place[r["reply_turn"]] < place[r["turn"]] for r in rows if r["reply_turn"] is not None)


def test_language_model_knows_what_only_long_documents_hold(spark):
    """Two words alternate in long documents alone: their order must tell, among very many short ones."""
    rng = np.random.default_rng(8)
    common = "the of and to in is was for on with".split()
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 5 != 1]
    rows = [(i, " ".join(rng.choice(common, 12))) for i in ids[:600]]
    rows += [(i, "water house " * 2000) for i in ids[600:606]]
    out = [i for i in range(3000) if i not in set(ids)][:2]
    rows += [(out[0], "water house " * 60), (out[1], "water " * 60 + "house " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in lm_score.score(df, public_tokenizers.path("word_bpe_49k.json")).where("held_out").collect()}
    assert got[out[0]] > got[out[1]] + 20


def test_language_model_fits_more_windows_on_more_tokens(spark, docs, monkeypatch):
    path, drawn = public_tokenizers.path("word_bpe_49k.json"), []
    monkeypatch.setattr(lm_score, "TOKENS_A_WINDOW", 16)
    summed = lm_score._summed
    monkeypatch.setattr(lm_score, "_summed", lambda *a: drawn.append(summed(*a)) or drawn[-1])
    got = lm_score.score(docs, path, fit_docs=1)
    tokens = drawn[1].sum()
    assert all(r["score"] < 0 for r in got.collect())
    later = sum(x[-1] for x in drawn[2:])
    assert len(drawn) == 2 + lm_score.ROUNDS and abs(later + lm_score.FIRST_WINDOWS - tokens / 16) < 20


def test_language_model_exchanges_words_packed(spark):
    """All exchanges together, by the different words of a block: 43 bytes when they came back a row each."""
    rng = np.random.default_rng(4)
    made = ["".join(x) for x in rng.choice(list("etaoinshrdlu"), (40_000, 7))]
    rows = [(i, " ".join(rng.choice(made, 400))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    df.count()
    ran = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = ran()
    assert lm_score.score(df, public_tokenizers.path("word_bpe_49k.json")).count() == len(rows)
    words = sum(len({w for i in part for w in i.text.split()}) for part in df.rdd.glom().collect())
    assert (ran() - before) / words < 32


def test_language_model_unpacks_the_words_it_packs():
    rng = np.random.default_rng(6)
    block, at = np.repeat([3, 70, 71], [400, 1, 300]), np.concatenate([rng.permutation(90_000)[:400], [0], rng.permutation(300)])
    c, lens = rng.integers(0, 1 << 40, 701), rng.integers(0, 400, 701)
    subwords = rng.integers(0, 1 << 16, lens.sum()).astype("<u2")
    cells, got = np.split(subwords, np.cumsum(lens)[:-1]), {}
    for some in np.array_split(rng.permutation(701), 3):
        place = (block[some].astype(np.int64) << lm_score.AT_BITS) + at[some]
        for b, packed in lm_score._pack_words(place, c[some], lens[some], np.concatenate([cells[i] for i in some])):
            got.setdefault(b, []).append(packed)
    assert sorted(got) == [3, 70, 71]
    for b, packed in got.items():
        own = np.flatnonzero(block == b)
        own = own[np.argsort(at[own])]
        x, n, flat = lm_score._unpack_words(packed, "<u2")
        assert x.tolist() == c[own].tolist() and n.tolist() == lens[own].tolist()
        assert flat.tolist() == np.concatenate([cells[i] for i in own]).tolist()
    assert [len(x) for x in lm_score._unpack_words([], "<u2")] == [0, 0, 0]


def test_short_lines_link_in_their_conversation_and_paragraphs_link(spark):
    letter = "The first paragraph of a long letter.\n\nThe second one is here,\nand goes on a little.\n\nThe third one ends it."
    said = [
        (1, 0, "We could wait.\nWhy not?\nI shall ask somebody else about it."), (1, 1, "Something in between those two."),
        (1, 2, "> Why not?\nBecause of the rain."), (2, 0, letter), (2, 1, "Another one that nobody quotes."),
        (2, 2, "> The second one\n> is here, and goes on\n> a little.\n>\n> The third\n> one ends it.\nThank you."),
        (3, 0, "Nothing of the kind in here."), (3, 1, "> Why not?\nThis is another conversation."),
        (4, 0, "Hello,\nthe long line that is quoted later"), (4, 1, "Hello,\nsomething else altogether"),
        (4, 2, "> Hello,\n> the long line that is quoted later\n> and something unknown\nYes.")]
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in said], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["reply_conv"], r["reply_turn"], r["n_linked"]) for r in quote_links.link(df).collect()}
    assert got[1, 2] == (1, 0, 1) and got[2, 2] == (2, 0, 1)
    assert got[3, 1] == (3, 0, 0) and got[4, 2] == (4, 0, 1)
