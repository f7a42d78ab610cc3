"""Encoding, decoding and token counts against the libraries."""

import hashlib
import sys

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from textloom.llm.bpe import ByteLevelBpe, digests, encode_decode  # noqa: E402
from textloom.llm.token_counts import PieceBpe, token_counts  # noqa: E402

BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def byte_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def piece_library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


TEXTS = st.text(st.sampled_from(list("ab zé\n\t'▁1.,ñ漢AzZ=_-😀 ") + [" the", "ing", "  ", "\r\n", "'s", "<|endoftext|>", "<s>"]).map(str), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["ab", " ", "é", "\n", "\t", "'s", "▁", "1", "²", "漢", "=", "😀", " the", "ing", "\x1c", " ", "\r\n", "<|endoftext|>", "don't", "x" * 20]), max_size=20).map("".join))
def test_ids(byte_library, text):
    bpe = ByteLevelBpe.load(BYTES)
    ids = bpe.encode_batch([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == byte_library.encode(text, add_special_tokens=False).ids
    assert bpe.decode(ids) == text == byte_library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["ab", " ", "é", "\n", "▁", "1", "漢", "  ", "😀", " the", "ing", "　", "</s>", "don't", " " * 17]), max_size=12).map("".join))
def test_prefix_counts(piece_library, text):
    bpe = PieceBpe.load(PIECES)
    exact = [len(piece_library.encode(text[:k])) for k in range(len(text) + 1)]
    assert bpe.prefix_counts(text).tolist() == exact
    segments = bpe.segments(text)
    bpe.learn(set(segments))
    for limit in (0, 1, 3, 8):
        assert bpe.fit(segments, limit) == max(k for k in range(len(text) + 1) if exact[k] <= limit)


def test_odd_rows(odd, odd_rows, empty, byte_library, piece_library):
    out = encode_decode(odd, BYTES)
    assert set(odd.columns) <= set(out.columns) and out.columns.count("ids") == 1
    got = sorted(((r.doc_id or 0), r.decoded, r.n_tokens, bytes(r.ids)) for r in out.collect())
    want = sorted(((i or 0), t or "", len(e), np.array(e, "<u4").tobytes()) for i, t in odd_rows for e in [byte_library.encode(t or "", add_special_tokens=False).ids])
    assert got == want
    row = digests(odd, BYTES).filter("doc_id = 5").first()
    assert row.ids_sha256 == row.decoded_sha256 == hashlib.sha256(b"").hexdigest() and row.n_tokens == 0
    counted = token_counts(odd, PIECES, limit=100, prefixes=True).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_bytes) for r in counted) == sorted((i or 0, len(piece_library.encode(t or "")), len((t or "").encode())) for i, t in odd_rows)
    for r in counted:
        table = np.frombuffer(bytes(r.prefix_counts), "<u4")
        assert r.over_limit == (r.n_tokens > 100) and table[-1] == r.n_tokens and table[r.fit_chars] <= 100
        assert r.fit_chars == len(r.text or "") or (table[r.fit_chars + 1 :] > 100).all()
    assert encode_decode(empty, BYTES).count() == 0 and token_counts(empty, PIECES, 1).count() == 0


def test_the_longest_prefix_is_looked_for_from_its_end():
    """It is that of the prefix table, and the counts of few segments are read for it."""
    bpe = PieceBpe.load(PIECES)
    text = "Some words, été 12345\n\n   and   spaces " * 100
    counts, segments, read = bpe.prefix_counts(text), bpe.segments(text), []

    class Cache(dict):
        def __getitem__(self, key):
            read.append(key)
            return super().__getitem__(key)

    held, bpe.cache = bpe.cache, Cache(bpe.cache)
    try:
        for limit in (0, 1, 2, 7, 100, 501, 900):
            read.clear()
            assert bpe.fit(segments, limit) == max(k for k, n in enumerate(counts.tolist()) if n <= limit)
            assert len(read) <= 4
    finally:
        bpe.cache = held


def test_bpe_memory_of_words(monkeypatch):
    def word(i):
        return "".join(chr(97 + i // 26**k % 26) for k in range(4))

    # words that hardly repeat: a worker keeps few of them
    coder = ByteLevelBpe(BYTES)
    for k in range(0, 330_000, 30_000):
        coder.encode_batch([" ".join(word(i) for i in range(k, k + 30_000))])
    assert sys.getsizeof(coder.cache) + sum(sys.getsizeof(w) + sys.getsizeof(x) for w, x in coder.cache.items()) < 30 << 20
    # beyond the bound the words of the block stay, and results are those of an empty cache
    monkeypatch.setattr("textloom.llm.bpe.CACHE_WORDS", 40)
    coder = ByteLevelBpe(BYTES)
    texts = [" ".join(["common words", *(word(i) for i in range(k, k + 12))]) for k in range(0, 90, 6)]
    learnt = []
    walk = coder.core.walk
    coder.core.walk = lambda words, *rest: learnt.extend(words) or walk(words, *rest)
    assert [coder.encode_batch([t])[0] for t in texts] == [ByteLevelBpe(BYTES).encode_batch([t])[0] for t in texts]
    assert learnt.count(b" words") == 1 and len(learnt) > 40
