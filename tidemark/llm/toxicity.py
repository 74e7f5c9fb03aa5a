"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, report, quotation, other); clauses are
what lies between clause marks. Sequential transducers rewrite the symbols of a clause one
after the other and are composed into a single table before any text is read:

    negation  marks insults and threats within SCOPE words after a negation
    reported  marks them after a reporting verb or inside quotation marks
    target    marks insults near a target, and threats that a target follows
    scorer    counts what comes out

A document's counts of marked and plain matches, capped at CAP each, go through a logistic
model. Insults are a fixed seed list and what the labels teach: words and word beginnings that
many toxic texts hold in many different surroundings and hardly any other text does; those that
others hold too, but far less often, are hints, which count on their own. The lexicon is learned from a bounded sample (`FIT_TOXIC` toxic and `FIT_OTHER` other labelled texts
of at most FIT_CHARS characters, chosen by hash); the model's weights are fitted on all
labelled rows, as counts by pattern, of which there are at most (CAP + 1) ** kinds * 2.

Defined cases: null and empty texts have no match and get the score of such texts; without
labels the fixed weights stand; several labels of a document count each, null labels don't;
repeated rows are scored each.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbuf
from .shared import lean, stored

# The seed lexicon.
LEXICON = {
    "INSULT": "idiot idiots moron morons loser losers stupid scum trash worthless pathetic disgusting clown imbecile "
              "dumbass bastard asshole bitch retard dimwit vermin filth "
              "idioten dummkopf abschaum arschloch trottel crétin imbécile connard ordure salaud idiota estúpido "
              "imbécil basura escoria cabrón",
    "THREAT": "kill hurt destroy murder strangle stab beat shoot burn crush töten umbringen tuer frapper matar golpear",
    "TARGET": "you your yourself you're u he she they him her them this that these those du dich ihr euch sie tu toi vous "
              "te tú ti usted ustedes él ella ellos",
    "NEGATION": "not never no isn't aren't wasn't weren't don't doesn't didn't won't wouldn't cannot can't nobody "
                "nicht kein keine nie niemals pas jamais aucun ni nunca jamás tampoco",
    "REPORT": "said says say called calls wrote writes claimed claims quoted quotes reported alleged according heard "
              "sagte sagt nannte schrieb dit disait écrivit appelé dijo dice llamó escribió",
}
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, HINT = range(8)
KINDS = {"INSULT": INSULT, "THREAT": THREAT, "TARGET": TARGET, "NEGATION": NEGATION, "REPORT": REPORT}
CLAUSE_MARKS = b".!?;:\n"
QUOTE_MARKS = ['"', "“", "”", "«", "»", "„"]

SCOPE, CAP = 3, 4
FIT_TOXIC, FIT_OTHER, FIT_CHARS = 2000, 6000, 20_000
STEMS = range(3, 9)

#: Marks that the transducers set on a symbol, as bits above it.
NEGATED, REPORTED, TARGETED = 8, 16, 32
SYMBOLS = [k | sum(m) for k in range(8) for m in product((0, NEGATED), (0, REPORTED), (0, TARGETED))]
#: What the scorer counts.
COUNTS = ("insult", "targeted_insult", "negated_insult", "reported_insult", "threat", "weak_threat", "hint")
#: Weights before any label is seen: bias, one for each count, and one for hints after the first.
PRIOR = np.array([-4.0, 5.0, 2.0, -1.0, 1.0, 5.0, 0.5, 0.5, 1.0])


@dataclass(frozen=True)
class Transducer:
    """Deterministic and sequential: (state, symbol) -> (state, symbol); state 0 starts a clause."""

    arcs: dict[tuple[int, int], tuple[int, int]]

    def then(self, other: "Transducer") -> "Transducer":
        """The composition: `other` reads what this one writes. Only reachable states are made."""
        names, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
        while todo:
            a, b = todo.pop()
            for x in SYMBOLS:
                a2, y = self.arcs[a, x]
                b2, z = other.arcs[b, y]
                if (a2, b2) not in names:
                    names[a2, b2] = len(names)
                    todo.append((a2, b2))
                arcs[names[a, b], x] = (names[a2, b2], z)
        return Transducer(arcs)

    def run(self, symbols) -> list[int]:
        state, out = 0, []
        for x in symbols:
            state, y = self.arcs[state, x]
            out.append(y)
        return out


def _near(trigger: int, marked: tuple[int, ...], mark: int) -> Transducer:
    """Sets `mark` on the symbols `marked` within SCOPE words after `trigger`."""
    arcs = {}
    for s in range(SCOPE + 1):
        for x in SYMBOLS:
            kind = x & 7
            arcs[s, x] = (SCOPE if kind == trigger else max(0, s - 1), x | mark if s and kind in marked else x)
    return Transducer(arcs)


def _reported() -> Transducer:
    """After a reporting verb, or between quotation marks, to the clause's end."""
    arcs = {}
    for s in range(4):  # bit 0: reported, bit 1: quotation open
        for x in SYMBOLS:
            kind = x & 7
            to = s | 1 if kind == REPORT else s ^ 2 if kind == QUOTE else s
            arcs[s, x] = (to, x | REPORTED if s and kind in (INSULT, THREAT) else x)
    return Transducer(arcs)


def _threatened() -> Transducer:
    """Marks a target within SCOPE words after a threat, which is where a threat counts; the
    threat's own marks go with it."""
    arcs = {}
    for s in range(4 * SCOPE + 1):
        left, marks = (s + 3) // 4, (s + 3) % 4 if s else 0
        for x in SYMBOLS:
            kind = x & 7
            if kind == THREAT:
                arcs[s, x] = (4 * SCOPE - 3 + (x >> 3 & 3), x)
            elif kind == TARGET and s:
                arcs[s, x] = (0, TARGET | TARGETED | marks << 3)
            else:
                arcs[s, x] = (4 * (left - 1) - 3 + marks if left > 1 else 0, x)
    return Transducer(arcs)


GRAMMAR = (_near(NEGATION, (INSULT, THREAT), NEGATED).then(_reported()).then(_near(TARGET, (INSULT,), TARGETED))
           .then(_threatened()))


def tally(out: list[int], counts: np.ndarray) -> None:
    """The scorer: adds a clause's output symbols to `counts`."""
    for x in out:
        kind = x & 7
        if kind == INSULT:
            counts[2 if x & NEGATED else 3 if x & REPORTED else 1 if x & TARGETED else 0] += 1
        elif kind == TARGET and x & TARGETED:
            counts[5 if x & (NEGATED | REPORTED) else 4] += 1
        elif kind == HINT:
            counts[6] += 1


@dataclass
class Lexicon:
    """Symbol by word hash, and insults by the hash of a word's first bytes."""

    words: np.ndarray
    kinds: np.ndarray
    stems: list[tuple[int, int, np.ndarray]]  # bytes, symbol, hashes
    learned: tuple[str, ...] = ()

    @classmethod
    def of(cls, insults=(), hints=()) -> "Lexicon":
        """insults, hints: words, or beginnings that end in an asterisk."""
        found = {f: HINT for f in hints} | {f: INSULT for f in insults}
        by_word = {f: k for f, k in found.items() if f[-1] != "*"}
        by_word |= {w: KINDS[k] for k, text in LEXICON.items() for w in text.split()}
        h = {int(_hash_one(w)): k for w, k in by_word.items()}
        order = np.array(sorted(h), np.uint64)
        by_size: dict[tuple[int, int], list[int]] = {}
        for f, k in found.items():
            if f[-1] == "*":
                by_size.setdefault((k, len(f.encode()) - 1), []).append(int(_hash_one(f[:-1])))
        return cls(order, np.array([h[int(x)] for x in order], np.uint8),
                   [(n, k, np.unique(np.array(x, np.uint64))) for (k, n), x in sorted(by_size.items())], tuple(found))

    def symbols(self, raw, starts, ends) -> np.ndarray:
        out = np.zeros(len(starts), np.uint8)
        if not len(starts):
            return out
        h = textbuf.span_hash(raw, starts, ends)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        same = self.words[at] == h
        out[same] = self.kinds[at[same]]
        for n, kind, known in self.stems:  # insults before hints
            long = np.flatnonzero((ends - starts >= n) & (out == OTHER))
            h = textbuf.span_hash(raw, starts[long], starts[long] + n)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            out[long[known[at] == h]] = kind
        return out


def _hash_one(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), np.uint8)
    return textbuf.span_hash(raw, np.array([0]), np.array([len(raw)]))[0]


def _word_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[0x61:0x7B] = table[0x80:] = table[0x27] = True
    return table


_WORD = _word_table()
_MARK = np.isin(np.arange(256), list(CLAUSE_MARKS))


def counts_of(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """Counts [documents, len(COUNTS)] of whole texts, not capped."""
    column = pc.utf8_lower(column)
    for mark in QUOTE_MARKS[1:]:
        if pc.any(pc.match_substring(column, mark)).as_py():
            column = pc.replace_substring(column, mark, '"')
    raw, offsets = textbuf.buffer_of(column)
    out = np.zeros((len(offsets) - 1, len(COUNTS)), np.int64)
    starts, ends = textbuf.runs(_WORD[raw], offsets)
    symbols = lexicon.symbols(raw, starts, ends)
    hits = np.flatnonzero((symbols == INSULT) | (symbols == THREAT) | (symbols == HINT))
    if not len(hits):
        return out
    # Clauses: words between clause marks of one document.
    clause = np.cumsum(_MARK[raw])[starts]
    doc = np.searchsorted(offsets, starts, "right") - 1
    first = np.flatnonzero(np.diff(clause, prepend=-1) | np.diff(doc, prepend=-1))
    quotes = np.cumsum(raw == 0x22)
    which = np.unique(np.searchsorted(first, hits, "right") - 1)
    bounds = np.append(first, len(starts))
    for a, b in zip(bounds[which].tolist(), bounds[which + 1].tolist()):
        line, before = [], None
        for x, q in zip(symbols[a:b].tolist(), quotes[starts[a:b]].tolist()):
            if before is not None:
                line += [QUOTE] * (q - before)
            elif (opened := q - int(quotes[ends[a - 1] - 1] if a and doc[a - 1] == doc[a] else
                                    quotes[offsets[doc[a]]] - (raw[offsets[doc[a]]] == 0x22))):
                line += [QUOTE] * opened
            before = q
            line.append(x)
        tally(GRAMMAR.run(line), out[doc[a]])
    return out


def held_out(doc_id: Column, parts: int = 3, part: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def learn_lexicon(texts: list[str], toxic: list[int]) -> Lexicon:
    """Words and word beginnings that toxic texts hold in many surroundings and others hardly do."""
    import regex

    word = regex.compile(r"[\p{L}']+")
    yes, no = sum(toxic), len(toxic) - sum(toxic)
    if not yes or not no:
        return Lexicon.of()
    least = max(6, yes // 130)
    around: dict[str, set[str]] = {}
    held: dict[str, int] = {}
    for text, t in zip(texts, toxic):
        if not t:
            continue
        words = word.findall(text.lower())
        for before, w in zip(["", *words], words):
            around.setdefault(w, set()).add(before)
        for f in {g for w in set(words) for g in (w, *(f"{w[:k]}*" for k in STEMS if len(w) >= k))}:
            held[f] = held.get(f, 0) + 1
    # Copies of a text repeat its surroundings, so surroundings are counted, not texts alone.
    spread: dict[str, int] = {}
    for w, s in around.items():
        for f in (w, *(f"{w[:k]}*" for k in STEMS if len(w) >= k)):
            spread[f] = spread.get(f, 0) + len(s)
    held = {f: n for f, n in held.items() if n >= least and spread[f] >= least}
    other = dict.fromkeys(held, 0)
    for text, t in zip(texts, toxic):
        if not t:
            for f in {g for w in set(word.findall(text.lower())) for g in (w, *(f"{w[:k]}*" for k in STEMS if len(w) >= k))}:
                if f in other:
                    other[f] += 1
    # Far more often in toxic texts; `sure` where others don't hold it, and where that isn't
    # chance, given how often others hold its own beginnings.
    good = {f: n for f, n in held.items() if n / yes >= 8 * (other[f] + 1) / no}
    roots = {f: [g for k in STEMS if (g := f"{f[:k]}*") in good and g != f and len(g) <= len(f)] for f in good}
    sure = {f for f, n in good.items() if other[f] <= n // 200 and n / yes >= 30 * (other[f] + 0.5) / no
            and all(not other[g] or n * other[g] >= 3 * good[g] for g in roots[f])}
    # Of nested beginnings that stand for the same texts the longest is taken, else the shortest.
    longer = {g for f in sure for g in roots[f] if g in sure and good[f] >= 0.97 * good[g]}
    sure -= longer
    sure = {f for f in sure if not any(g in sure for g in roots[f])}
    hints = {f for f in good if f not in sure and f not in longer and f[-1] == "*" and len(f) > 4}
    hints = {f for f in hints if not any(g in hints for g in roots[f]) and not any(g in sure for g in roots[f])}
    return Lexicon.of(sorted(sure), sorted(hints))


def _add_counts(rows: DataFrame, lexicon: Lexicon, text: str, into: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for lo, hi in textbuf.slices(batch, text):
                n = counts_of(column.slice(lo, hi - lo), shared.value)
                found = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * len(COUNTS), pa.int32()), pa.array(n.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, found], [*batch.schema.names, into])

    return rows.mapInArrow(lean(run), T.StructType([*rows.schema, T.StructField(into, T.ArrayType(T.LongType()))]))


def _design(counts: np.ndarray) -> np.ndarray:
    """Bias and saturating counts."""
    x = np.minimum(counts, CAP)
    return np.hstack([np.ones((len(x), 1)), np.log1p(x) / np.log1p(1), np.maximum(x[:, -1:] - 1, 0)])


def fit_weights(patterns: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logistic weights near the fixed ones, by Newton steps on pattern counts."""
    w, x = PRIOR.copy(), _design(patterns)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (toxic - p)) - 0.1 * (w - PRIOR)
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def sample(docs: DataFrame, known: DataFrame) -> list[tuple[str, int]]:
    """(text, toxic) of a bounded sample of `known` (doc_id, toxic), chosen by a hash of doc_id.

    Only the chosen ids, FIT_TOXIC + FIT_OTHER about, go to the texts; the texts stay where they are.
    """
    known = known.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    most = {1: FIT_TOXIC, 0: FIT_OTHER}
    share = {t: min(1.0, most[t] / max(1, sizes.get(t, 0))) for t in most}
    draw = F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5
    ids = known.where(draw < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])).dropDuplicates(["doc_id"])
    some = docs.where(F.length("text") <= FIT_CHARS).join(F.broadcast(ids), "doc_id").select("text", "toxic")
    return sorted((r["text"], r["toxic"]) for r in some.dropDuplicates(["text"]).collect())


def fit(counted: DataFrame, known: DataFrame) -> np.ndarray:
    """Weights from all labelled rows: counts `n` of documents, joined to (doc_id, toxic)."""
    capped = F.transform("n", lambda c: F.least(c, F.lit(CAP)))
    rows = counted.join(known.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")), "doc_id").groupBy(
        capped.alias("n"), "toxic").count().collect()
    if not rows:
        return PRIOR
    rows.sort(key=lambda r: (list(r["n"]), r["toxic"]))
    return fit_weights(np.array([r["n"] for r in rows]), np.array([r["toxic"] for r in rows], float),
                       np.array([r["count"] for r in rows], float))


def score_column(weights: np.ndarray, counts: str) -> Column:
    z = F.lit(float(weights[0]))
    for i, w in enumerate(weights[1:-1]):
        z = z + F.lit(float(w)) * F.log1p(F.least(F.get(counts, F.lit(i)), F.lit(CAP))) / F.lit(float(np.log(2)))
    z = z + F.lit(float(weights[-1])) * F.greatest(F.least(F.get(counts, F.lit(len(COUNTS) - 1)), F.lit(CAP)) - 1, F.lit(0))
    return 1 / (1 + F.exp(-z))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out, score, predicted, matches (by COUNTS).

    Labels of rows held out are never read into the fit.
    """
    slim = docs.select("doc_id", "text")
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    some = sample(slim, known)
    lexicon = learn_lexicon([t for t, _ in some], [y for _, y in some])
    # Counts are small and cost the most: kept in the shared folder, read for the fit and for the scores.
    counted = stored(_add_counts(slim, lexicon, "text", "n").drop("text"), "toxicity")
    found = counted.withColumn("score", score_column(fit(counted, known), "n"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                        (F.col("score") >= threshold).cast("int").alias("predicted"), F.col("n").alias("matches"))
