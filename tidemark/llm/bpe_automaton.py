"""BPE as a deterministic automaton over its own tokens, built merge by merge.

Construction (Cognetta and Okazaki, "Tokenization as finite-state transduction", 2024;
Berglund, Martens and van der Merwe, "Constructing a BPE tokenization DFA", 2024). Start with
one state and a loop for every base symbol: any symbol may follow any other. Each merge u v ->
uv in order adds a gadget: the arcs labelled u now lead to a copy of their target that lacks
the arc v, and wherever u was an arc, uv becomes one, to the target of v. What remains are
exactly the token sequences that BPE produces, so each string has one path.

All arcs of a label lead to one state, so a state is named by the label read last, and an arc
(state, token) exists unless a gadget on the state's line of copies removed the token, or the
token it grew from on the left, before it grew. Tokens numbered by a walk over the tree "uv
grew from u" (younger children first) make each removal one interval; a state is its sorted
list of intervals. Size is set by the vocabulary, not by any text.

Encoding reads a word's symbols through a trie of the tokens' spellings and follows the arcs
that exist: the last token of every prefix is found from those of shorter prefixes, then the
labels are read back. Batches of words go through the tables in numpy step by step. Decoding
emits the labels of the arcs.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np

#: Words of more symbols go one by one through the same tables.
LONG_WORD = 256
WORDS_A_STEP, CELLS_A_STEP = 1 << 15, 1 << 19


def byte_labels() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [table[b] for b in range(256)]


@dataclass
class Automaton:
    """Tables of the automaton; plain arrays, so it can be broadcast."""

    labels: list[str]
    base: np.ndarray  # symbol -> token id; symbols 256 and up are a word's last byte
    length: np.ndarray  # token id -> symbols
    state: np.ndarray  # token id -> state after it; state 0 is the start
    place: np.ndarray  # token id -> number in the tree walk
    gap_start: np.ndarray  # state * width + first missing number, sorted
    gap_end: np.ndarray
    width: int
    slot_key: np.ndarray  # trie: open addressing of node * 512 + symbol
    slot_node: np.ndarray
    token_at: np.ndarray  # trie node -> token id or -1
    word_end: bool
    special: dict[str, int] = field(default_factory=dict)
    _arcs: dict[int, int] = field(default_factory=dict)
    _flat: tuple = ()

    def allowed(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the arc (state, token) exists."""
        key = state.astype(np.int64) * self.width + self.place[token]
        i = np.searchsorted(self.gap_start, key, "right") - 1
        return (i < 0) | (self.gap_end[i] <= key)

    def child(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Trie node reached, or -1."""
        key = node.astype(np.int64) * 512 + symbol
        slot = _slot(key, len(self.slot_key))
        got = self.slot_key[slot]
        out = np.where(got == key, self.slot_node[slot], -1)
        open_ = np.flatnonzero((got != key) & (got >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.slot_key) - 1)
            got = self.slot_key[slot[open_]]
            same = got == key[open_]
            out[open_[same]] = self.slot_node[slot[open_[same]]]
            open_ = open_[~same & (got >= 0)]
        return out

    def encode(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words raw[start:end], flat, and their offsets."""
        n = ends - starts
        order = np.argsort(-n, kind="stable")
        counts = np.zeros(len(n), np.int64)
        pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = 0
        while at < len(order):
            most = int(n[order[at]])
            if not most:
                break
            step = 1 if most > LONG_WORD else min(WORDS_A_STEP, CELLS_A_STEP // most)
            rows = order[at : at + step]
            at += step
            walk = self._walk_long if most > LONG_WORD else self._walk
            word, place, token = walk(raw, starts[rows], n[rows], most)
            np.add.at(counts, rows[word], 1)
            pieces.append((rows[word], place, token))
        offsets = np.concatenate([[0], np.cumsum(counts)])
        if not pieces:
            return np.empty(0, np.int32), offsets
        word, place, token = (np.concatenate(x) for x in zip(*pieces))
        return token[np.lexsort((place, word))].astype(np.int32), offsets

    def _walk(self, raw, starts, n, most):
        """(word, end position, token) of every arc on the words' paths; words come longest first."""
        column = np.arange(most)
        where = np.minimum(starts[:, None] + column, len(raw) - 1)
        symbols = raw[where].astype(np.int64)
        if self.word_end:
            symbols[np.arange(len(n)), n - 1] += 256
        last = np.full((len(n), most + 1), -1, np.int32)
        for j in range(most):
            rows = np.arange(int(np.searchsorted(-n, -j, "left")))  # words longer than j
            if j:
                rows = rows[last[rows, j] >= 0]
            state = self.state[last[rows, j]] if j else np.zeros(len(rows), np.int64)
            node = np.zeros(len(rows), np.int64)
            k = j
            while len(rows):
                node = self.child(node, symbols[rows, k])
                k += 1
                live = np.flatnonzero(node >= 0)
                if len(live) < len(rows):
                    rows, node, state = rows[live], node[live], state[live]
                token = self.token_at[node]
                some = np.flatnonzero(token >= 0)
                some = some[self.allowed(state[some], token[some])]
                last[rows[some], k] = token[some]
                if k >= most:
                    break
                going = np.flatnonzero(n[rows] > k)
                if len(going) < len(rows):
                    rows, node, state = rows[going], node[going], state[going]
        out = []
        rows, end = np.arange(len(n)), n.copy()
        while len(rows):
            token = last[rows, end]
            if (token < 0).any():
                raise ValueError("a symbol is not in the vocabulary")
            out.append((rows, end, token))
            end = end - self.length[token]
            rows, end = rows[end > 0], end[end > 0]
        return tuple(np.concatenate(x) for x in zip(*out))

    def _walk_long(self, raw, starts, n, most):
        """`_walk` for a single word, step by step."""
        if not self._arcs:
            full = np.flatnonzero(self.slot_key >= 0)
            self._arcs = dict(zip(self.slot_key[full].tolist(), self.slot_node[full].tolist()))
            self._flat = tuple(x.tolist() for x in (self.state, self.place, self.gap_start, self.gap_end, self.token_at))
        state, place, gap_start, gap_end, token_at = self._flat
        symbols = raw[starts[0] : starts[0] + most].tolist()
        if self.word_end:
            symbols[-1] += 256
        last = [-1] * (most + 1)
        for j in range(most):
            if j and last[j] < 0:
                continue
            base = (state[last[j]] if j else 0) * self.width
            node, k = 0, j
            while k < most:
                node = self._arcs.get(node * 512 + symbols[k], -1)
                if node < 0:
                    break
                k += 1
                token = token_at[node]
                if token >= 0:
                    key = base + place[token]
                    i = bisect_right(gap_start, key) - 1
                    if i < 0 or gap_end[i] <= key:
                        last[k] = token
        out, end = [], most
        while end > 0:
            if last[end] < 0:
                raise ValueError("a symbol is not in the vocabulary")
            out.append((0, end, last[end]))
            end -= int(self.length[last[end]])
        return tuple(np.array(x) for x in zip(*out))

    def decode(self, ids) -> str:
        """Labels of the arcs joined by spaces, as the library does for a file without a decoder."""
        return " ".join(self.labels[i] for i in ids)


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


def compile_file(path: str) -> Automaton:
    """The automaton of a byte-level BPE vocabulary file of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    suffix = model.get("end_of_word_suffix") or ""
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [t["content"] for t in spec["added_tokens"] if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]]
    if model["type"] != "BPE" or odd:
        raise ValueError(f"not supported: {odd or model['type']}")
    vocab: dict[str, int] = model["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    return build(vocab, merges, suffix, special)


def build(vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str, special: dict[str, int]) -> Automaton:
    size = max([*vocab.values(), *special.values()]) + 1
    labels = [""] * size
    for s, i in (vocab | special).items():
        labels[i] = s
    chars = byte_labels()
    spelled = [*chars, *(c + suffix for c in chars)] if suffix else chars
    base = np.array([vocab.get(c, -1) for c in spelled] + [-1] * (512 - len(spelled)))
    symbols: list[tuple[int, ...] | None] = [None] * size
    for s, i in enumerate(base.tolist()):
        if i >= 0:
            symbols[i] = (s,)

    # The tree "uv grew from u"; ranks are births. Base symbols hang below the root, -1.
    born = np.full(size, -1, np.int64)
    children: dict[int, list[int]] = {}
    rules = []
    for r, (a, b) in enumerate(merges):
        u, v, w = vocab[a], vocab[b], vocab[a + b if not suffix else a.removesuffix(suffix) + b]
        if symbols[u] is None or symbols[v] is None or symbols[w] is not None:
            raise ValueError(f"merge {r} doesn't make a new token of known ones")
        symbols[w] = symbols[u] + symbols[v]
        born[w] = r
        children.setdefault(u, []).append(w)
        rules.append((u, v, w))
    place, below = np.full(size, 0, np.int64), np.zeros(size, np.int64)
    walk, todo = 0, [i for i in reversed(base[base >= 0].tolist())]
    order = []
    while todo:
        x = todo.pop()
        place[x] = walk
        walk += 1
        order.append(x)
        todo += children.get(x, ())  # the youngest is popped first
    for x in reversed(order):
        below[x] = 1 + sum(below[c] for c in children.get(x, ()))

    # Gadgets. A state is (copied from, first number removed, end); state 0 lacks nothing.
    state = np.zeros(size, np.int64)
    parent, gaps = [0], [(0, 0)]
    grown: dict[int, int] = {}  # numbers taken by v's children so far, all older than this merge
    for u, v, w in rules:
        s = int(state[u])
        after_v = int(state[v])
        if not _has(parent, gaps, s, int(place[v])):
            raise ValueError("a merge whose parts never meet")
        # v and what will grow from it: its children in the walk's order, youngest first, down to
        # the oldest that is born after this merge.
        parent.append(s)
        gaps.append((int(place[v]), int(place[v] + below[v] - grown.get(v, 0))))
        state[u] = len(parent) - 1
        state[w] = after_v
        grown[u] = grown.get(u, 0) + int(below[w])
    # Each state that a token leads to, with the gaps of its line of copies, merged.
    width = size + 1
    memo: dict[int, list[tuple[int, int]]] = {0: []}
    names, numbers = {0: 0}, state.copy()
    starts, ends = [], []
    for x in order:
        s = int(state[x])
        if s not in names:
            names[s] = len(names)
            for a, b in _merged(parent, gaps, s, memo):
                starts.append(names[s] * width + a)
                ends.append(names[s] * width + b)
        numbers[x] = names[s]
    starts, ends = np.array(starts or [0], np.int64), np.array(ends or [0], np.int64)
    key, node, token_at = _trie(symbols)
    return Automaton(labels, base, np.array([len(s) if s else 1 for s in symbols], np.int64), numbers, place, starts,
                     ends, width, key, node, token_at, bool(suffix), special)


def _has(parent, gaps, s, number) -> bool:
    while s:
        if gaps[s][0] <= number < gaps[s][1]:
            return False
        s = parent[s]
    return True


def _merged(parent, gaps, s, memo) -> list[tuple[int, int]]:
    line = []
    while s:
        line.append(gaps[s])
        s = parent[s]
    out: list[tuple[int, int]] = []
    for a, b in sorted(line):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _trie(symbols: list[tuple[int, ...] | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spellings of all tokens as an open-addressed table; node 0 is the root."""
    arcs: dict[int, int] = {}
    token_at = [-1]
    for token, spelled in enumerate(symbols):
        if spelled is None:
            continue
        node = 0
        for s in spelled:
            key = node * 512 + s
            node = arcs.get(key, 0)
            if not node:
                node = arcs[key] = len(token_at)
                token_at.append(-1)
        token_at[node] = token
    size = 1 << (3 * len(arcs)).bit_length()
    slot_key, slot_node = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    keys = np.fromiter(arcs, np.int64, len(arcs))
    for key, slot, node in zip(keys.tolist(), _slot(keys, size).tolist(), arcs.values()):
        while slot_key[slot] >= 0:
            slot = (slot + 1) & (size - 1)
        slot_key[slot], slot_node[slot] = key, node
    return slot_key, slot_node, np.array(token_at, np.int64)
