"""Language identification by hierarchical discrimination.

First the language family, then the language within it; on both levels one-versus-one linear
support vector machines (hinge loss, dual coordinate descent) vote with calibrated odds. The
features of a whole text are the relative frequencies of its hashed character 1- to 4-grams
(over UTF-8 bytes, lower-cased, white space runs as they are), square-rooted and scaled.

The classifier is fitted on at most `per_language` labelled texts of each language, chosen by a
hash of doc_id; feature vectors are made on the executors, so the driver sees `per_language`
rows of BUCKETS numbers a language and no text. Prediction is one pass without a shuffle.

Defined cases: a null text and one without letters give `und` with score 0; without any
labelled text every text is `und`; a language that the family table doesn't know is a family
of its own; repeated rows count as they come; extra columns travel along.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbuf
from .shared import free_name, lean

UNDETERMINED = "und"
BUCKETS = 1 << 12
ORDERS = (1, 2, 3, 4)
PER_LANGUAGE = 500
MOST_LANGUAGES = 500
#: Bytes of text whose grams are counted at a time.
SLICE_BYTES = 1 << 20

# Families of closely related written languages (ISO 639-1 codes).
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv", "uralic": "fi et hu", "turkic": "tr az kk uz ky tk tt", "indic": "hi ur bn pa gu mr ne si",
    "semitic": "ar he am mt", "sinitic": "zh yue wuu", "austronesian": "id ms tl jv su",
    "celtic": "ga gd cy br", "hellenic": "el", "iranian": "fa ps ku tg", "dravidian": "ta te kn ml",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def _gram_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts [documents, BUCKETS] of hashed n-grams that lie within a document."""
    docs = len(offsets) - 1
    out = np.zeros(docs * BUCKETS, np.float32)
    if not len(raw):
        return out.reshape(docs, BUCKETS)
    doc = np.repeat(np.arange(docs, dtype=np.int32) * BUCKETS, np.diff(offsets))
    sizes = np.diff(offsets)
    code = np.zeros(len(raw), np.uint32)
    inside = np.ones(len(raw), bool)
    for k in range(max(ORDERS)):
        order = k + 1
        code[: len(raw) - k] |= raw[k:].astype(np.uint32) << np.uint32(8 * k)
        if k:
            # No gram of this order starts at any of a document's last `k` bytes.
            inside[(offsets[1:] - k)[sizes >= k]] = False
        if order in ORDERS:
            part = code if order == 4 else code & np.uint32((1 << 8 * order) - 1)
            bucket = ((part ^ np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(20)
            out += np.bincount((doc + bucket.astype(np.int32))[inside], minlength=docs * BUCKETS)
    return out.reshape(docs, BUCKETS)


def features(column: pa.Array) -> np.ndarray:
    """Rows of unit length; zero for an empty text."""
    raw, offsets = textbuf.buffer_of(pc.utf8_lower(column))
    x = _gram_counts(raw, offsets)
    x /= np.maximum(x.sum(1, keepdims=True), 1)
    return np.sqrt(x)


def _fit_pair(x: np.ndarray, y: np.ndarray, rng, c: float = 20.0, epochs: int = 15) -> tuple[np.ndarray, float]:
    """Linear SVM by dual coordinate descent (Hsieh et al. 2008); the last feature is a constant."""
    w, alpha = np.zeros(x.shape[1], x.dtype), np.zeros(len(x))
    norms = np.einsum("ij,ij->i", x, x)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            step = (1 - y[i] * (x[i] @ w)) / norms[i]
            new = min(max(alpha[i] + step, 0.0), c)
            if new != alpha[i]:
                w += x.dtype.type((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    # Odds from margins: the slope that explains the labels best.
    margin = y * (x @ w)
    slopes = np.array([0.5, 1, 2, 3, 4, 6, 8])
    return w, float(slopes[np.argmin([np.logaddexp(0, -s * margin).mean() for s in slopes])])


@dataclass
class Node:
    """One-versus-one machines over `names`; a pair's weights and slope by its two indices."""

    names: list[str]
    pairs: dict[tuple[int, int], tuple[np.ndarray, float]]

    def log_share(self, x: np.ndarray) -> np.ndarray:
        """Log probability of each name, [documents, names]: pairwise log odds, averaged and normalised."""
        votes = np.zeros((len(x), len(self.names)))
        for (i, j), (w, slope) in self.pairs.items():
            z = slope * (x @ w)
            votes[:, i] -= np.logaddexp(0, -z)
            votes[:, j] -= np.logaddexp(0, z)
        votes /= max(1, len(self.names) / 2)
        return votes - np.logaddexp.reduce(votes, axis=1, keepdims=True)


@dataclass
class Model:
    mean: np.ndarray
    families: Node
    members: list[Node]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = np.hstack([x - self.mean, np.ones((len(x), 1), x.dtype)])
        top = self.families.log_share(x)
        pick = top.argmax(1)
        names, score = np.empty(len(x), object), np.zeros(len(x))
        for k, node in enumerate(self.members):
            mine = np.flatnonzero(pick == k)
            if len(mine):
                inside = node.log_share(x[mine])
                best = inside.argmax(1)
                names[mine] = np.array(node.names, object)[best]
                score[mine] = np.exp(top[mine, k] + inside[np.arange(len(mine)), best])
        return names.tolist(), np.clip(score, 0.0, 1.0)


def _node(names: list[str], of: np.ndarray, x: np.ndarray, rng) -> Node:
    pairs = {}
    for i, j in combinations(range(len(names)), 2):
        rows = np.flatnonzero((of == i) | (of == j))
        pairs[i, j] = _fit_pair(x[rows], np.where(of[rows] == i, 1.0, -1.0), rng)
    return Node(names, pairs)


def fit_arrays(x: np.ndarray, langs: list[str], seed: int = 5) -> Model | None:
    if not len(langs):
        return None
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    family = {n: FAMILY_OF.get(n, f"only {n}") for n in names}
    families = sorted(set(family.values()))
    mean = x.mean(0)
    x = np.hstack([x - mean, np.ones((len(x), 1), x.dtype)])
    langs = np.array(langs, object)
    of_family = np.array([families.index(family[n]) for n in langs])
    members = []
    for k, f in enumerate(families):
        own = [n for n in names if family[n] == f]
        rows = np.flatnonzero(of_family == k)
        members.append(_node(own, np.array([own.index(n) for n in langs[rows]]), x[rows], rng))
    return Model(mean.astype(np.float32), _node(families, of_family, x, rng), members)


def fit(rows: DataFrame, per_language: int = PER_LANGUAGE, seed: int = 5) -> Model | None:
    """From labelled `rows` (doc_id, text, lang). Languages beyond MOST_LANGUAGES are an error."""
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return None
    # Rows whose hash lies below a share that gives about `per_language` rows of each language.
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 1.2 * per_language / n))])
    draw = (F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text")).cast("double") / 2.0**64) + 0.5
    some = rows.where(draw < share[F.col("lang")]).select("lang", "text")

    def vectors(batches):
        for batch in batches:
            for lo, hi in textbuf.slices(batch, "text", SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                x = features(part.column(1)).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x])], ["lang", "x"])

    got: dict[str, list[bytes]] = {}
    for r in some.mapInArrow(lean(vectors), "lang string, x binary").collect():
        kept = got.setdefault(r["lang"], [])
        if len(kept) < 2 * per_language:  # a hash that favours a language can't exceed the bound
            kept.append(bytes(r["x"]))
    langs = [n for n in sorted(got) for _ in got[n]]
    x = np.array([np.frombuffer(b, np.float16) for n in sorted(got) for b in sorted(got[n])], np.float32)
    return fit_arrays(x, langs, seed)


def predict(docs: DataFrame, model: Model | None, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """`docs` and the language of each whole text with its score, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letters = free_name(docs, "_letters")

    def run(batches):
        for batch in batches:
            for lo, hi in textbuf.slices(batch, text, SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                has = part.column(part.schema.get_field_index(letters)).to_numpy(zero_copy_only=False).astype(bool)
                column = part.column(part.schema.get_field_index(text))
                names, scores = [UNDETERMINED] * (hi - lo), np.zeros(hi - lo)
                if shared.value is not None and has.any():
                    found, shares = shared.value.predict(features(column.filter(pa.array(has))))
                    scores[has] = shares
                    for i, n in zip(np.flatnonzero(has).tolist(), found):
                        names[i] = n
                keep = [i for i, n in enumerate(part.schema.names) if n != letters]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array(names, pa.string()), pa.array(scores)],
                                                 [*(part.schema.names[i] for i in keep), lang, score])

    schema = T.StructType([*docs.schema, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.withColumn(letters, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))).mapInArrow(lean(run), schema)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang): doc_id, held_out, lang_pred, score."""
    slim = docs.select("doc_id", "text", "lang")
    model = fit(slim.where(~held_out(F.col("doc_id"))), per_language)
    return predict(slim.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep(docs: DataFrame, least: float = 0.3, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows of `docs` whose language is determined with a score of `least` or more; same columns."""
    model = fit(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"))), per_language)
    lang, score = free_name(docs, "_lang"), free_name(docs, "_score")
    found = predict(docs, model, "text", lang, score)
    return found.where((F.col(lang) != UNDETERMINED) & (F.col(score) >= least)).select(*docs.columns)
