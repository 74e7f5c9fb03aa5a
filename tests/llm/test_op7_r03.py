"""What round 3's check of op7_token_store was about: fewer calls for the same ids. Each failed before its change, but for the last."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from tidemark.llm import bpe_codec, textbuf, token_store
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_of_all_kinds_go_to_the_library_together(monkeypatch):
    pieces = [f"{a}{b}{c}" for a in ("", " ") for b in ("Ab", "éa", "ñ", "!?", "７", "12", "'", "你好", "ب", "é") for c in ("", "x" * 40)]
    pieces += ["'s", "\n", "\n\n", "   ", " ", "  ", " ", "　", "\x1c", " \t", "€", "â", " â", "\u0085", "<|", " |>"]
    data = [p.encode() for p in pieces]
    ends = np.cumsum([len(d) for d in data])
    library = bpe_codec.splitter(PATH).library
    asked = []

    class Counted:
        def __getattr__(self, name):
            return getattr(library, name)

        def encode_batch_fast(self, texts, **more):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **more)

    monkeypatch.setattr(bpe_codec.splitter(PATH), "_library", Counted())
    ids, offsets = token_store._library_pieces(PATH)(np.frombuffer(b"".join(data), np.uint8), ends - [len(d) for d in data], ends)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode(p, add_special_tokens=False).ids for p in pieces]
    assert len(asked) < 25  # two texts, and the pieces that may be white space


def test_only_pieces_that_are_not_known_are_sorted(monkeypatch):
    encoder = bpe_codec.BatchEncoder(bpe_codec.splitter(PATH), token_store._library_pieces(PATH))
    text = pa.array([" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(3000))])
    first = encoder.encode(*textbuf.buffer_of(text))[0].tolist()
    monkeypatch.setattr(np, "unique", None)
    assert encoder.encode(*textbuf.buffer_of(text))[0].tolist() == first


def test_hashes_that_meet_are_told_apart():
    encoder = bpe_codec.BatchEncoder(bpe_codec.splitter(PATH), None)
    back = pow(int(bpe_codec._SPREAD), -1, 2**64)
    # All want the table's last slots, so they go round its end.
    h = np.array([(2**64 - 1 - i) * back % 2**64 for i in range(400)], np.uint64)
    encoder._place(h[:200], np.arange(200, dtype=np.int32))
    encoder._place(h[200:300], np.arange(200, 300, dtype=np.int32))
    assert encoder._found(h).tolist() == [*range(300), *[-1] * 100]


def test_white_space_and_contractions_are_cut_as_the_library_cuts():
    rng = np.random.default_rng(11)
    parts = [" ", "  ", "\n", "\t", " ", "\u0085", "'", "'s", "'ll", "'re", "a", "lle", "é", "7", "½", ".", "''", "你", "<|endoftext|>"]
    for path in (PATH, public_tokenizers.path("word_bpe_49k.json")):
        library = Tokenizer.from_file(path)
        encoder = bpe_codec.BatchEncoder(bpe_codec.splitter(path), bpe_codec.compiled(path).encode)
        for near in (17, 19):  # without and with what the library itself splits
            texts = ["".join(rng.choice(parts[:near], rng.integers(0, 9))) for _ in range(3000)]
            ids, offsets = encoder.encode(*textbuf.buffer_of(pa.array(texts)))
            got = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
            assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
