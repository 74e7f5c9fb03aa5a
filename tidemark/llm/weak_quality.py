"""Quality rules by weak supervision, in DataFrame functions only.

Every rule votes good (1), bad (-1) or abstains (0) on a document's measures. Votes are counted
by pattern (at most 3**rules rows, whatever the data); expectation-maximisation on those counts
estimates the share of good documents and each rule's two accuracies (on good and on bad
documents), and a document's posterior quality probability is a sum of log odds over its votes.
Nothing needs all rules to pass. Measures are made inside the row: words never leave their
document, so no shuffle carries text and no document meets another.

Three-word windows are compared by a chained 64-bit hash of their words, within one document.

Defined cases: a null text is an empty one; a text without words has zeros; an empty table
gives no rows (the prior then stands for the estimate); repeated rows are judged alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, stored

# The word pattern, the symbols, and the white space between words.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOL_RUN = "[#*$%&|<>]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: EM ends after so many steps, or when no parameter moves by EPSILON.
STEPS, EPSILON = 200, 1e-7


def measures(df: DataFrame, text: str = "text", into: str = "m") -> DataFrame:
    """`df` and a struct of counts of its text as column `into`.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word),
    n_distinct (words), n_runs (of symbols), n_capitals (A-Z), n_marks (exclamation marks).
    """
    t, w, h, s, r, y = (free_name(df, n) for n in ("_t", "_w", "_h", "_s", "_r", "_y"))
    columns = df.columns
    df = df.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(w, F.regexp_extract_all(F.col(t), F.lit(WORD), F.lit(0)))
    df = df.withColumn(h, F.when(F.size(w) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))))
    # Most texts repeat no window, which a hash set tells at once; only the others are sorted.
    df = df.withColumn(s, F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(
        h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    again = lambda x, k: (F.coalesce(F.get(s, k - 1)["x"] == x["x"], F.lit(False))
                          | F.coalesce(F.get(s, k + 1)["x"] == x["x"], F.lit(False)))
    df = df.withColumn(r, F.sort_array(F.transform(F.filter(s, again), lambda x: x["i"])))
    df = df.withColumn(y, F.split(F.col(t), SYMBOL_RUN))
    # Each window found again covers three words, less what the one before it covers already.
    zero = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(r, zero, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"),
                                                         i.alias("last")), lambda a: a["n"])
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    counts = {
        "n_words": F.size(w), "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.length(t) - F.length(F.array_join(y, "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.coalesce(covered, F.lit(0)), "n_lines": F.size(lines),
        "n_distinct": F.size(F.array_distinct(w)), "n_runs": F.size(y) - 1,
        "n_capitals": F.length(t) - F.length(F.translate(t, CAPITALS, "")),
        "n_marks": F.size(F.split(F.col(t), "!")) - 1,
    }
    return df.withColumn(into, F.struct(*[c.cast("long").alias(n) for n, c in counts.items()])).select(*columns, into)


@dataclass(frozen=True)
class Rule:
    """Votes bad where `bad` holds, else good where `good` holds, else abstains."""

    name: str
    bad: str
    good: str


#: Conditions in SQL over the measures; shares are written as products, so nothing divides by zero.
RULES = (
    Rule("length", "m.n_words < 20", "m.n_words BETWEEN 80 AND 100000"),
    Rule("symbols", "10 * m.n_symbols > m.n_words", "50 * m.n_symbols <= m.n_words"),
    Rule("symbol_share", "50 * m.n_symbols > m.word_chars", "200 * m.n_symbols <= m.word_chars"),
    Rule("symbol_runs", "12 * m.n_runs > m.n_words", "60 * m.n_runs <= m.n_words"),
    Rule("repeated_lines", "m.n_lines >= 4 AND 10 * m.n_dup_lines > 4 * m.n_lines", "m.n_lines > 1 AND 20 * m.n_dup_lines <= m.n_lines"),
    Rule("repeated_words", "10 * m.n_repeat_words > 3 * m.n_words", "10 * m.n_repeat_words <= m.n_words"),
    Rule("variety", "10 * m.n_distinct < m.n_words AND m.n_words < 5000", "10 * m.n_distinct > 4 * m.n_words"),
    Rule("word_length", "m.word_chars < 2 * m.n_words OR m.word_chars > 15 * m.n_words",
         "m.word_chars BETWEEN 3 * m.n_words AND 10 * m.n_words"),
    Rule("capitals", "2 * m.n_capitals > m.word_chars", "5 * m.n_capitals <= m.word_chars"),
    Rule("marks", "5 * m.n_marks > m.n_words", "50 * m.n_marks <= m.n_words"),
)


def votes(rules=RULES) -> Column:
    """Array of the rules' votes, from column m."""
    return F.array(*[F.expr(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END") for r in rules])


@dataclass(frozen=True)
class Estimate:
    """Share of good documents and, by rule, P(vote good | good, voted) and P(vote bad | bad, voted)."""

    good: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def log_odds(self, rule: int, vote: int) -> float:
        if not vote:
            return 0.0
        a, b = self.on_good[rule], self.on_bad[rule]
        return math.log(a / (1 - b)) if vote > 0 else math.log((1 - a) / b)

    def posterior(self, pattern: tuple[int, ...]) -> float:
        x = math.log(self.good / (1 - self.good)) + sum(self.log_odds(j, v) for j, v in enumerate(pattern))
        return 1 / (1 + math.exp(-x)) if x > -500 else 0.0


def expectation_maximisation(patterns: dict[tuple[int, ...], int], rules: int) -> Estimate:
    """From counts of vote patterns.

    Rules are specialists: one that is right about good documents may pass most bad ones, so
    accuracy on bad documents may be low. The start takes a bad vote for what it says, which
    names the classes; estimation then decides how far each rule is to be believed.
    """
    now = Estimate(0.8, (0.8,) * rules, (0.8,) * rules)
    total = sum(patterns.values())
    if not total:
        return now
    weight = {p: 0.95 if -1 not in p else 0.2 ** p.count(-1) for p in patterns}
    for _ in range(STEPS):
        on_good, on_bad = [], []
        for j in range(rules):
            # One pseudo-vote each way keeps a rule that never votes at its prior.
            hit = voted = miss = away = 0.0
            for p, n in patterns.items():
                if p[j]:
                    voted += n * weight[p]
                    hit += n * weight[p] * (p[j] > 0)
                    away += n * (1 - weight[p])
                    miss += n * (1 - weight[p]) * (p[j] < 0)
            on_good.append(min(max((hit + 0.8) / (voted + 1), 0.51), 0.999))
            on_bad.append(min(max((miss + 0.8) / (away + 1), 0.02), 0.999))
        share = sum(n * weight[p] for p, n in patterns.items()) / total
        new = Estimate(min(max(share, 0.05), 0.98), tuple(on_good), tuple(on_bad))
        moved = max(abs(x - y) for x, y in zip((new.good, *new.on_good, *new.on_bad), (now.good, *now.on_good, *now.on_bad)))
        now = new
        weight = {p: now.posterior(p) for p in patterns}
        if moved < EPSILON:
            break
    return now


def fit(measured: DataFrame, rules=RULES) -> Estimate:
    """The estimate over all rows; `measured` has the measures as column m."""
    counted = measured.select(votes(rules).alias("v")).groupBy("v").count().collect()
    return expectation_maximisation({tuple(r["v"]): r["count"] for r in counted}, len(rules))


def posterior(estimate: Estimate, rules=RULES) -> Column:
    """Posterior quality probability, from column m."""
    x = F.lit(math.log(estimate.good / (1 - estimate.good)))
    for j, r in enumerate(rules):
        x = x + F.expr(f"CASE WHEN {r.bad} THEN {estimate.log_odds(j, -1)!r}D "
                       f"WHEN {r.good} THEN {estimate.log_odds(j, 1)!r}D ELSE 0.0D END")
    return 1 / (1 + F.exp(-x))


def base_failed() -> Column:
    return F.expr("m.n_words < 50 OR 100 * m.n_repeat_words > 50 * m.n_words")


def label(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """One row per row of `docs`: doc_id, m (measures), votes, quality, base_failed, kept."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # The measures are small and cost the most: kept in the shared folder, read twice.
    measured = stored(measures(slim).drop("text"), "quality")
    found = measured.withColumn("votes", votes(rules)).withColumn("quality", posterior(fit(measured, rules), rules))
    return found.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def keep(docs: DataFrame, text: str = "text", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that are kept; same columns. Measures of all rows are made once for the
    estimate and once more in the filter, which saves a shuffle of the texts."""
    clash = "m" in [c.lower() for c in docs.columns]
    if clash:
        names = docs.columns
        docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
        return keep(docs, docs.columns[names.index(text)], rules, threshold).toDF(*names)
    slim = stored(measures(docs.select(F.col(text).alias("text"))).drop("text"), "quality")
    estimate = fit(slim, rules)
    # The row number keeps the optimizer from writing the measures out inside the filter, once
    # for every mention: a filter isn't moved below a column it needs that isn't deterministic.
    row = free_name(docs, "_row")
    rows = measures(docs, text).withColumn(row, F.monotonically_increasing_id())
    good = ~base_failed() & (posterior(estimate, rules) >= threshold)
    return rows.where(good & (F.col(row) >= 0)).drop("m", row)
