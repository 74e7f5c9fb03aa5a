"""Pre-splitting of whole batches into the pieces that byte-level BPE encodes one by one.

Texts whose characters all lie below U+0300 (after lower-casing, where the file asks for it)
are split in numpy, on the bytes; any other text, and a text that holds a special token's
string, is normalised and split by the library's own components, piece by piece. Equal pieces
are encoded once a batch.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
from tokenizers import Tokenizer

from . import textbuf

# The two split patterns that are known here, as the vocabulary files have them.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTIONS = (b"'s", b"'t", b"'m", b"'d", b"'re", b"'ve", b"'ll")

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
FIRST_FAR = 0x300  # code points from here on go through the library


def _classes() -> np.ndarray:
    out = np.full(FIRST_FAR, OTHER, np.uint8)
    for c in range(FIRST_FAR):
        kind = unicodedata.category(chr(c))[0]
        out[c] = LETTER if kind == "L" else NUMBER if kind == "N" else SPACE if chr(c) in "\t\n\x0b\x0c\r \x85\xa0" else OTHER
    return out


def _lower() -> np.ndarray:
    """Lower-case code point, or 0 where it is not one code point below FIRST_FAR."""
    out = np.zeros(FIRST_FAR, np.int64)
    for c in range(FIRST_FAR):
        low = chr(c).lower()
        out[c] = ord(low) if len(low) == 1 and ord(low) < FIRST_FAR else 0
    return out


CLASS, LOWER = _classes(), _lower()
CLASS_OF_BYTE = np.where(np.arange(256) < 128, CLASS[np.minimum(np.arange(256), 127)], OTHER).astype(np.uint8)
LOWER_BYTE = textbuf.lowered()
_PAIR = [(b[1], b[2] if len(b) == 3 else None) for b in CONTRACTIONS]


class Splitter:
    """Splits as one vocabulary file of the tokenizers library says."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self._library = path, None
        normaliser, split = spec["normalizer"], spec["pre_tokenizer"]
        parts = split["pretokenizers"] if split["type"] == "Sequence" else [split]
        if normaliser is None and parts[0]["type"] == "ByteLevel" and parts[0]["use_regex"] and not parts[0]["add_prefix_space"]:
            self.lower, self.keeps_space = False, True
        elif (normaliser and [n["type"] for n in normaliser.get("normalizers", ())] == ["NFC", "Replace", "Lowercase"]
              and len(parts) == 2 and parts[0].get("pattern") == {"Regex": WORD_PATTERN} and parts[0]["invert"]
              and parts[0]["behavior"] == "Removed" and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]):
            self.lower, self.keeps_space = True, False
        else:
            raise ValueError("a normaliser or pre-tokenizer that isn't known here")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        from .bpe_automaton import byte_labels

        self._byte = {c: b for b, c in enumerate(byte_labels())}

    @property
    def library(self) -> Tokenizer:
        """The library's tokenizer, loaded when the first text needs it."""
        if self._library is None:
            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def split(self, raw: np.ndarray, offsets: np.ndarray) -> "Pieces":
        """Pieces of each document, in order."""
        n_docs = len(offsets) - 1
        low, near = self._near(raw, offsets)
        starts, ends = self._split_near(low, offsets, near)
        far = np.flatnonzero(~near)
        if not len(far):
            return Pieces(low, starts, ends, np.searchsorted(starts, offsets), np.full(len(starts), -1, np.int64))
        doc = np.searchsorted(offsets, starts, "right") - 1 if len(starts) else np.empty(0, np.int64)
        if len(starts):
            mine = near[doc]
            starts, ends, doc = starts[mine], ends[mine], doc[mine]
        fixed = np.full(len(starts), -1, np.int64)
        extra, es, ee, ed, ef = [], [], [], [], []
        at = len(low)
        for d in far.tolist():
            for piece, token in self._split_far(raw[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace")):
                extra.append(piece)
                es.append(at)
                at += len(piece)
                ee.append(at)
                ed.append(d)
                ef.append(token)
        low = np.concatenate([low, np.frombuffer(b"".join(extra), np.uint8)])
        starts, ends, doc, fixed = (np.concatenate([a, np.array(b, np.int64)]) for a, b in (
            (starts, es), (ends, ee), (doc, ed), (fixed, ef)))
        order = np.argsort(doc, kind="stable")
        starts, ends, doc, fixed = starts[order], ends[order], doc[order], fixed[order]
        return Pieces(low, starts, ends, np.searchsorted(doc, np.arange(n_docs + 1)), fixed)

    def _near(self, raw, offsets):
        """Lower-cased bytes, and which documents numpy can split."""
        n_docs = len(offsets) - 1
        near = np.ones(n_docs, bool)
        odd = np.flatnonzero(raw >= 0xCC)
        low = raw
        if self.lower:
            low = LOWER_BYTE[raw]
            lead = np.flatnonzero((raw >= 0xC2) & (raw < 0xCC))
            code = ((raw[lead].astype(np.int64) & 0x1F) << 6) | (raw[lead + 1] & 0x3F)
            new = LOWER[code]
            low[lead], low[lead + 1] = 0xC0 | (new >> 6), 0x80 | (new & 0x3F)
            # A lower-case form that shrinks to one byte, or leaves the range, isn't for numpy.
            odd = np.concatenate([odd, lead[new < 0x80]])
        if len(odd):
            near[np.searchsorted(offsets, odd, "right") - 1] = False
        data = raw.tobytes() if self.special else b""
        for s in self.special:
            at = data.find(s.encode())
            while at >= 0:
                near[np.searchsorted(offsets, at, "right") - 1] = False
                at = data.find(s.encode(), at + 1)
        return low, near

    def _split_near(self, low, offsets, near):
        """Runs of one class; the patterns' finer points after that."""
        n = len(low)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        kind = CLASS_OF_BYTE[low]
        lead = np.flatnonzero((low[:-1] >= 0xC2) & (low[:-1] < 0xCC))
        code = ((low[lead].astype(np.int64) & 0x1F) << 6) | (low[lead + 1] & 0x3F)
        kind[lead] = kind[lead + 1] = CLASS[code]
        change = np.empty(n + 1, bool)
        change[0] = change[n] = True
        np.not_equal(kind[1:], kind[:-1], out=change[1:n])
        change[offsets] = True
        if not self.keeps_space:
            # Every number stands alone; a second byte of a number doesn't start one.
            single = np.flatnonzero((kind == NUMBER) & ((low < 0x80) | (low >= 0xC2)))
            change[single] = True
        cuts = np.flatnonzero(change)
        starts, ends = cuts[:-1], cuts[1:]
        of = kind[starts]
        # A contraction takes the first letters after an apostrophe that stands alone and is
        # not taken by a space before it.
        quote = np.flatnonzero((low[starts] == 0x27) & (ends - starts == 1) & (np.append(of[1:], SPACE) == LETTER))
        quote = quote[quote + 1 < len(starts)]
        first_of_doc = np.zeros(n + 1, bool)
        first_of_doc[offsets] = True
        joined = ~first_of_doc[ends[quote]]
        if self.keeps_space:
            before = starts[quote] - 1
            joined &= (before < 0) | (low[np.maximum(before, 0)] != 0x20) | first_of_doc[starts[quote]]
        quote = quote[joined]
        if len(quote):
            a = low[np.minimum(ends[quote], n - 1)]
            b = low[np.minimum(ends[quote] + 1, n - 1)]
            room = ends[quote + 1] - starts[quote + 1]
            take = np.zeros(len(quote), np.int64)
            for x, y in _PAIR:
                take[(a == x) if y is None else (a == x) & (b == y) & (room >= 2)] = 1 if y is None else 2
            hit = take > 0
            change[ends[quote[hit]]] = False
            change[ends[quote[hit]] + take[hit]] = True
        if self.keeps_space:
            self._spaces(low, ends[of == SPACE], change, first_of_doc)
        cuts = np.flatnonzero(change)
        starts, ends = cuts[:-1], cuts[1:]
        if not self.keeps_space:
            keep = np.flatnonzero(kind[starts] != SPACE)
            starts, ends = starts[keep], ends[keep]
        return starts, ends

    @staticmethod
    def _spaces(low, ends, change, first_of_doc):
        """White space before other text gives up its last character: a plain space joins what
        follows, any other stands alone. At a document's end a run stays whole."""
        ends = ends[~first_of_doc[ends]]  # the end of all texts is one of these
        last = low[ends - 1]
        change[ends - 1 - ((last >= 0x80) & (last < 0xC0))] = True  # where the last character starts
        # What follows may have been shortened by nothing: only an apostrophe's neighbour is, and it has no space before.
        change[ends[last == 0x20]] = False

    def _split_far(self, text: str):
        """(bytes of a piece, -1) or (b"", special id), by the library's own steps."""
        for part in self._cut.split(text) if self._cut else [text]:
            if part in self.special:
                yield b"", self.special[part]
                continue
            if self.library.normalizer is not None:
                part = self.library.normalizer.normalize_str(part)
            for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(part):
                yield bytes(self._byte[c] for c in piece), -1


class Pieces:
    """Pieces of a batch: spans of `raw` by document; `fixed` has the id of a special token or -1."""

    def __init__(self, raw, starts, ends, first, fixed):
        self.raw, self.starts, self.ends, self.first, self.fixed = raw, starts, ends, first, fixed

    def hashes(self) -> np.ndarray:
        """A hash of each piece; special ids are their own."""
        h = textbuf.span_hash(self.raw, self.starts, self.ends)
        h |= np.uint64(1 << 63)
        some = np.flatnonzero(self.fixed >= 0)
        h[some] = self.fixed[some].astype(np.uint64)
        return h
