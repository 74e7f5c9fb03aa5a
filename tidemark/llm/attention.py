"""A causal self-attention model over classes of subwords, trained and run in numpy.

The probability of a subword is that of its class, given by one attention head over the tokens
before it, times its share in the class, which is counted over the corpus. Classes are the most
frequent subwords, each its own, clusters of all others that occur by what surrounds them, and
two of those that don't. Queries,
keys and values depend on the class alone (places enter as a bias by distance), so they are
table look-ups; windows of SPAN tokens overlap by half, and each token is predicted once, in
the window where it lies in the second half.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPAN = 32
HALF = SPAN // 2
OWN_CLASSES, CLUSTERS, RARE_CLASSES = 64, 28, 2
START, CLASSES = OWN_CLASSES + CLUSTERS + RARE_CLASSES, OWN_CLASSES + CLUSTERS + RARE_CLASSES + 1
WIDTH = 16
STEPS, WINDOWS_A_STEP, RATE = 300, 48, 0.02
NEVER = np.float32(-1e9)
#: Exponentials of numbers up to this need no scaling: sums of them stay within a float.
SAFE = 60
#: What they take then stays in a core's cache.
BLOCKS_AT_ONCE = 128


@dataclass
class Model:
    class_of: np.ndarray  # subword -> class
    weights: dict[str, np.ndarray]
    log_share: np.ndarray | None = None  # subword -> log of its share in the class

    def with_counts(self, counts: np.ndarray) -> "Model":
        """The model with shares from the subwords' counts, each plus one half."""
        each = counts + 0.5
        total = np.bincount(self.class_of, weights=each, minlength=CLASSES)
        return Model(self.class_of, self.weights, np.log(each / total[self.class_of]))

    def score(self, subwords: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each document; `first` are the offsets of the documents in `subwords`."""
        docs = len(first) - 1
        out = np.zeros(docs)
        n = np.diff(first)
        if not len(subwords):
            return out
        # A start token before each document; it is context only.
        doc = np.repeat(np.arange(docs, dtype=np.int32), n + 1)
        at = np.arange(docs) + first[:-1]
        classes = np.insert(self.class_of[subwords], first[:-1], START).astype(np.int16)
        share = np.insert(self.log_share[subwords], first[:-1], 0.0)
        scored = np.ones(len(classes), bool)
        scored[at] = False
        step = HALF * BLOCKS_AT_ONCE
        for a in range(0, len(classes), step):
            lo, hi = max(0, a - HALF), min(len(classes), a + step + 1)
            # Predictions are of tokens a + 1 .. a + step, from contexts a .. a + step - 1.
            want = np.arange(a + 1, hi)
            got = self._predict(classes[lo:hi], doc[lo:hi], a - lo)[: len(want)]
            keep = scored[want]
            out += np.bincount(doc[want[keep]], weights=got[keep] + share[want[keep]], minlength=docs)
        return out / np.log(10)

    def _predict(self, classes, doc, head) -> np.ndarray:
        """Log probability of the class after each context token from `head` on."""
        w = self.weights
        n = len(classes) - head - 1
        blocks = -(-n // HALF)
        pad_front, pad_back = HALF - head, blocks * HALF - n
        c = np.concatenate([np.full(pad_front, START, np.int16), classes[:-1], np.full(pad_back, START, np.int16)])
        d = np.concatenate([np.full(pad_front, -1, np.int32), doc[:-1], np.full(pad_back, -2, np.int32)])
        c = c.reshape(blocks + 1, HALF)
        d = d.reshape(blocks + 1, HALF)
        around = np.concatenate([c[:-1], c[1:]], 1)
        near = np.concatenate([d[:-1], d[1:]], 1)
        own = c[1:]
        s = w["Q"][own] @ w["K"].take(around, 0).transpose(0, 2, 1)
        s += w["bias"]
        # Most blocks lie in one document.
        mixed = np.flatnonzero((near != near[:, -1:]).any(1))
        if len(mixed):
            s[mixed] = np.where(d[1:][mixed][:, :, None] != near[mixed][:, None, :], NEVER, s[mixed])
        if s.max(initial=0) > SAFE or s.diagonal(HALF, 1, 2).min(initial=0) < -SAFE:
            s -= s.max(-1, keepdims=True)
        np.exp(s, out=s)
        h = s @ w["V"].take(around, 0)
        h /= (s.reshape(-1, SPAN) @ np.ones(SPAN, np.float32)).reshape(blocks, HALF, 1)
        h += w["E"].take(own, 0)
        logits = h.reshape(-1, WIDTH) @ w["U"]
        logits += w["B"].take(own.reshape(-1), 0)
        logits = logits[:n]
        target = classes[head + 1 :].astype(np.int64)
        if logits.max(initial=0) > SAFE or logits.min(initial=0) < -SAFE:
            logits -= logits.max(1)[:, None]
        picked = logits[np.arange(n), target]
        np.exp(logits, out=logits)
        return (picked - np.log(logits @ np.ones(CLASSES, np.float32))).astype(np.float64)


def _distance_bias(by_distance: np.ndarray) -> np.ndarray:
    """[HALF, SPAN] bias of a query in the second half on every key; keys after it are barred."""
    d = np.arange(HALF, SPAN)[:, None] - np.arange(SPAN)[None, :]
    return np.where(d >= 0, by_distance[np.clip(d, 0, SPAN - 1)], NEVER).astype(np.float32)


def columns_of(counts: np.ndarray, ends_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column, row) of every subword in the table of contexts: the most frequent have a column each,
    the others share two; those of them that occur have a row, else -1."""
    rank = np.argsort(-counts, kind="stable")[:OWN_CLASSES]
    column = OWN_CLASSES + ends_word.astype(np.int32)
    frequent = rank[counts[rank] > 0]
    column[frequent] = np.arange(len(frequent))
    others = np.flatnonzero((counts > 0) & (column >= OWN_CLASSES))
    row = np.full(len(counts), -1, np.int32)
    row[others] = np.arange(len(others))
    return column, row


def contexts(stream: np.ndarray, column: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Flat table [row, 2 * columns]: how often each column stands before a subword, and after it."""
    width = OWN_CLASSES + 2
    r, c = row[stream], column[stream]
    after, before = r[1:] >= 0, r[:-1] >= 0
    cells = np.concatenate([r[1:][after] * 2 * width + c[:-1][after], r[:-1][before] * 2 * width + width + c[1:][before]])
    return np.bincount(cells, minlength=(row.max(initial=-1) + 1) * 2 * width)


def classes_of(counts: np.ndarray, seen: np.ndarray, ends_word: np.ndarray, rng) -> np.ndarray:
    """Class of every subword, from its count and the flat table of contexts."""
    column, row = columns_of(counts, ends_word)
    class_of = np.where(column < OWN_CLASSES, column, OWN_CLASSES + CLUSTERS + ends_word)
    others = np.flatnonzero(row >= 0)
    if len(others) <= CLUSTERS:
        class_of[others] = OWN_CLASSES + np.arange(len(others))
        return class_of
    x, weight = seen.reshape(len(others), -1).astype(float), counts[others].astype(float)
    x /= np.maximum(x.sum(1, keepdims=True), 1)
    np.sqrt(x, out=x)
    centres = x[rng.choice(len(x), CLUSTERS, replace=False, p=weight / weight.sum())]
    reached = -np.inf
    while True:
        near = x @ centres.T - 0.5 * (centres**2).sum(1)
        nearest = near.argmax(1)
        # Every round that changes a class is nearer in sum, so the rounds end by themselves.
        before, reached = reached, weight @ near.max(1)
        if not reached > before:
            break
        members = np.where(nearest == np.arange(CLUSTERS)[:, None], weight, 0.0)
        some = members.any(1)
        centres[some] = members[some] @ x / members[some].sum(1, keepdims=True)
    class_of[others] = OWN_CLASSES + nearest
    return class_of


def bigrams(stream: np.ndarray, bounds: np.ndarray, class_of: np.ndarray) -> np.ndarray:
    """Flat counts of each class after each class and after the start, in the documents of a stream."""
    c = class_of[stream]
    before = np.concatenate([[START], c[:-1]])[: len(c)]
    before[bounds[:-1][np.diff(bounds) > 0]] = START
    return np.bincount(before * CLASSES + c, minlength=CLASSES * CLASSES)


def windows(stream: np.ndarray, bounds: np.ndarray, class_of: np.ndarray, n: int, rng) -> np.ndarray:
    """`n` windows of SPAN + 1 classes, padded with -1, of documents drawn in proportion to their length."""
    long = np.flatnonzero(np.diff(bounds) >= 2)
    if not n or not len(long):
        return np.empty((0, SPAN + 1), np.int16)
    size = np.diff(bounds)[long]
    doc = rng.choice(len(long), n, p=size / size.sum())
    # The start token is before a document's first.
    a = rng.integers(0, np.maximum(1, size[doc] + 1 - SPAN))
    at = a[:, None] + np.arange(SPAN + 1)
    out = class_of[stream[np.minimum(bounds[long][doc][:, None] + np.maximum(at - 1, 0), len(stream) - 1)]]
    out = np.where(at == 0, START, out)
    return np.where(at <= size[doc][:, None], out, -1).astype(np.int16)


def start(counted: np.ndarray, rng) -> dict[str, np.ndarray]:
    """Weights before fitting, from the flat counts of class bigrams."""
    each = counted.reshape(CLASSES, CLASSES) + 0.05
    return {
        "B": np.log(each / each.sum(1, keepdims=True)),
        "E": rng.normal(0, 0.3, (CLASSES, WIDTH)), "U": rng.normal(0, 0.1, (WIDTH, CLASSES)),
        "q": rng.normal(0, 0.3, (WIDTH, WIDTH)), "k": rng.normal(0, 0.3, (WIDTH, WIDTH)),
        "v": rng.normal(0, 0.3, (WIDTH, WIDTH)), "bias": -0.1 * np.arange(SPAN),
    }


def fit(p: dict[str, np.ndarray], drawn: np.ndarray, rate: float = RATE, last: float = 0.1) -> dict[str, np.ndarray]:
    """Weights after one pass over the drawn windows, the rate falling to its `last` part."""
    p = {name: x.copy() for name, x in p.items()}
    moments = {name: (np.zeros_like(x), np.zeros_like(x)) for name, x in p.items()}
    steps = -(-len(drawn) // WINDOWS_A_STEP)
    for t in range(1, steps + 1):
        batch = drawn[(t - 1) * WINDOWS_A_STEP : t * WINDOWS_A_STEP].astype(np.int64)
        now = rate * min(1, t / 20) * (1 - (1 - last) * t / steps)
        for name, g in _gradients(p, batch)[1].items():
            m, v = moments[name]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p[name] -= now * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in p.values()])


def unflat(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    parts = np.split(values, np.cumsum([x.size for x in like.values()])[:-1])
    return {name: part.reshape(x.shape) for (name, x), part in zip(like.items(), parts)}


def model_of(class_of: np.ndarray, p: dict[str, np.ndarray]) -> Model:
    scale = 1 / np.sqrt(WIDTH)
    tables = {"E": p["E"], "U": p["U"], "B": p["B"], "Q": p["E"] @ p["q"] * scale, "K": p["E"] @ p["k"], "V": p["E"] @ p["v"]}
    return Model(class_of.astype(np.int16), {n: x.astype(np.float32) for n, x in tables.items()} | {"bias": _distance_bias(p["bias"])})


def train(documents: list[np.ndarray], vocabulary: int, ends_word: np.ndarray, seed: int = 3) -> Model:
    """From documents in memory as subword ids, each with its end token."""
    rng = np.random.default_rng(seed)
    stream = np.concatenate([np.empty(0, np.int64), *documents])
    bounds = np.cumsum([0, *map(len, documents)])
    counts = np.bincount(stream, minlength=vocabulary)
    class_of = classes_of(counts, contexts(stream, *columns_of(counts, ends_word)), ends_word, rng)
    p = start(bigrams(stream, bounds, class_of), rng)
    return model_of(class_of, fit(p, windows(stream, bounds, class_of, STEPS * WINDOWS_A_STEP, rng)))


def _gradients(p: dict[str, np.ndarray], batch: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy and its gradients; -1 in a batch is padding."""
    c, y = np.maximum(batch[:, :-1], 0), batch[:, 1:]
    real = y >= 0
    n, scale = real.sum(), 1 / np.sqrt(WIDTH)
    x = p["E"][c]
    q, k, v = x @ p["q"], x @ p["k"], x @ p["v"]
    apart = np.arange(SPAN)[:, None] - np.arange(SPAN)[None, :]
    s = q @ k.transpose(0, 2, 1) * scale + np.where(apart >= 0, p["bias"][np.clip(apart, 0, SPAN - 1)], -1e9)
    a = np.exp(s - s.max(-1, keepdims=True))
    a /= a.sum(-1, keepdims=True)
    h = x + a @ v
    logits = h @ p["U"] + p["B"][c]
    e = np.exp(logits - logits.max(-1, keepdims=True))
    prob = e / e.sum(-1, keepdims=True)
    rows, cols = np.nonzero(real)
    loss = -np.log(prob[rows, cols, y[rows, cols]] + 1e-30).mean()
    g = prob
    g[rows, cols, y[rows, cols]] -= 1
    g *= real[:, :, None] / n
    out = {"U": h.reshape(-1, WIDTH).T @ g.reshape(-1, CLASSES), "B": np.zeros_like(p["B"])}
    np.add.at(out["B"], c.ravel(), g.reshape(-1, CLASSES))
    dh = g @ p["U"].T
    da = dh @ v.transpose(0, 2, 1)
    dv = a.transpose(0, 2, 1) @ dh
    ds = a * (da - (da * a).sum(-1, keepdims=True))
    out["bias"] = np.bincount(np.clip(apart, 0, None).ravel(), weights=(ds.sum(0) * (apart >= 0)).ravel(), minlength=SPAN)
    dq, dk = ds @ k * scale, ds.transpose(0, 2, 1) @ q * scale
    dx = dh + dq @ p["q"].T + dk @ p["k"].T + dv @ p["v"].T
    flat = x.reshape(-1, WIDTH).T
    out |= {m: flat @ z.reshape(-1, WIDTH) for m, z in (("q", dq), ("k", dk), ("v", dv))}
    out["E"] = np.zeros_like(p["E"])
    np.add.at(out["E"], c.ravel(), dx.reshape(-1, WIDTH))
    return float(loss), out
