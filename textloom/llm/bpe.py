"""BPE by last-token states over a trie of distinct words.

The BPE encoding of a word is the only token sequence whose neighbours are compatible (the
merges inside them never give way to a merge across their border). So the encoding of a
prefix is given by its last token alone: the rest is the encoding of the shorter prefix in
front of it. Distinct words, sorted, form a trie that is walked depth first; each node's
last-token state is found once and serves all words that share the prefix.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textkit

#: Distinct words whose encodings a worker keeps; beyond that the cache starts anew.
CACHE_WORDS = 250_000
#: Text whose new words are sorted into one trie.
BLOCK_BYTES = 2 << 20
#: Pairs of tokens that are remembered.
FITS = 1_000_000


class PrefixBpe:
    """Last-token states for a vocabulary with ranked merges.

    names: token id by bytes (or str); parts: for each merged id its (left, right, rank);
    pair_rank(a, b): rank of merging two ids, or None.
    """

    def __init__(self, names: dict, parts: dict[int, tuple[int, int, int]], pair_rank):
        self.names, self.parts, self.pair_rank = names, parts, pair_rank
        #: Every suffix of a token: the token it is, or -1.
        self.tails: dict = {}
        for name in names:
            for k in range(1, len(name)):
                self.tails.setdefault(name[k:], -1)
        self.tails.update(names)
        self.length = {token: len(name) for name, token in names.items()}
        self._fits: dict[tuple[int, int], bool] = {}
        self._spine: dict[tuple[int, int], list[tuple[int, int, float]]] = {}

    def spine(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """(token, rank at which it arose, rank at which it was merged away) along one edge of a merge tree."""
        out = self._spine.get((token, side))
        if out is None:
            out, death, at = [], float("inf"), token
            while True:
                part = self.parts.get(at)
                birth = part[2] if part else -1
                out.append((at, birth, death))
                if part is None:
                    break
                at, death = part[side], birth
            self._spine[token, side] = out
        return out

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens can be neighbours in an encoding."""
        found = self._fits.get((left, right))
        if found is None:
            found = left < 0 or right < 0 or self._apart(left, right)
            if len(self._fits) > FITS:
                self._fits.clear()
            self._fits[left, right] = found
        return found

    def forget(self) -> None:
        """Keep no more pairs than are soon known again."""
        if len(self._fits) > FITS // 4:
            self._fits.clear()

    def _apart(self, left: int, right: int) -> bool:
        rank_of = self.pair_rank
        edge = self.spine(right, 0)
        for x, born_x, dead_x in self.spine(left, 1):
            for y, born_y, dead_y in edge:
                rank = rank_of(x, y)
                if rank is not None and max(rank, born_x, born_y) < dead_x and max(rank, born_x, born_y) <= dead_y:
                    return False
        return True

    def walk(self, words, zero, unit):
        """Depth-first over the trie of sorted distinct words: yields (word, last, state).

        last[d] is the last token of word[:d] and state[d] the sum of unit[token] over the
        encoding of word[:d], from `zero`. Both lists are reused: a prefix that words share
        keeps its states. A symbol outside the vocabulary is the token -1 - code.
        """
        tails, fits, known = self.tails.get, self.fits, self._fits.get
        last: list[int] = [0]
        state = [zero]
        length = self.length
        before = words[0][:0] if words else ""
        for word in words:
            n, shared = len(word), 0
            limit = min(n, len(before))
            while shared < limit and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], state[shared + 1 :]
            for d in range(shared + 1, n + 1):
                s = d - 1
                token = tails(word[s:d])
                while token is not None:
                    if token >= 0:
                        if not s:
                            break
                        pair = (last[s], token)
                        good = known(pair)
                        if good or (good is None and fits(*pair)):
                            break
                    s -= 1
                    token = tails(word[s:d]) if s >= 0 else None
                if token is None:
                    token = -1 - (word[d - 1] if isinstance(word, bytes) else ord(word[d - 1]))
                last.append(token)
                if token >= 0:
                    state.append(state[d - length[token]] + unit[token])
                else:
                    state.append(state[d - 1] + self.outside(token))
            before = word
            yield word, last, state

    @staticmethod
    def outside(token: int) -> int:
        """Weight of a symbol that the vocabulary lacks: its UTF-8 bytes."""
        return len(chr(-1 - token).encode("utf-8", "surrogatepass"))


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevelBpe:
    """A byte-level BPE vocabulary file of the tokenizers library, without merges across pre-tokens."""

    #: Splits a text before merging (fixed by the file format's byte-level pre-tokenizer).
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    _LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
    PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+").findall
    WIDE = re.compile("[\x1c-\x1f²³¹¼½¾ɐ-\U0010ffff]").search

    _loaded: dict[str, ByteLevelBpe] = {}

    def __init__(self, path: str):
        import regex

        spec = json.loads(open(path, encoding="utf-8").read())
        alphabet = _byte_alphabet()
        raw = lambda name: bytes(alphabet[c] for c in name)
        vocab = spec["model"]["vocab"]
        names = {raw(name): token for name, token in vocab.items()}
        parts, ranks = {}, {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            ranks[vocab[a], vocab[b]] = rank
            parts.setdefault(vocab[a + b], (vocab[a], vocab[b], rank))
        self.core = PrefixBpe(names, parts, lambda x, y: ranks.get((x, y)))
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.split_special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.split = regex.compile(self.PATTERN).findall
        self.bytes = {token: name for name, token in names.items()} | {token: name.encode() for name, token in self.special.items()}
        table = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]
        self.code = [i.to_bytes(4, "little") for i in range(len(table))]
        self.sizes = np.array([len(x) for x in table], dtype=np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.cache: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> ByteLevelBpe:
        """One instance for each worker process."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def pretokens(self, text: str) -> list[str]:
        # inside these ranges the two patterns agree, and the plain one is several times faster
        return self.split(text) if self.WIDE(text) else self.PLAIN(text)

    def words(self, text: str) -> list[str]:
        if self.split_special is None or not any(x in text for x in self.special):
            return self.pretokens(text)
        out = []
        for k, part in enumerate(self.split_special.split(text)):
            out.extend([part] if k % 2 else self.pretokens(part))
        return out

    def learn(self, words: set[str]) -> None:
        """Encode distinct words that the cache lacks, through their trie."""
        new = words - self.cache.keys()
        if len(self.cache) + len(new) > CACHE_WORDS:
            # rare words are most of the cache: those of this block are likelier to come again
            self.cache = {w: self.cache[w] for w in words - new}
        for name in self.special.keys() & new:
            self.cache[name] = self.code[self.special[name]]
        cache, plain = self.cache, {w.encode(): w for w in new - self.special.keys()}
        for word, _, state in self.core.walk(sorted(plain), b"", self.code):
            cache[plain[word]] = state[-1]

    def forget(self) -> None:
        """Give back what a task has learnt: its worker goes on to other stages."""
        self.cache.clear()
        self.core.forget()
        textkit.release()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian 32-bit integers."""
        split = [self.words(t) for t in texts]
        self.learn(set().union(*split))
        get = self.cache.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        ids = np.frombuffer(ids, dtype="<u4")
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.begins[ids] - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.flat[at].tobytes().decode("utf-8", errors="replace")


def encode_decode(docs: DataFrame, tokenizer: str, column: str = "text") -> DataFrame:
    """Encode whole texts with a byte-level BPE file and decode the ids again.

    Adds to all columns of docs: ids (binary, little-endian 32-bit), n_tokens (long) and
    decoded (string); columns of docs with these names are replaced. Special strings of
    the file inside a text are their special token. A null text is encoded as the empty
    one: no ids, empty decoding. Rows are independent, so repeated rows give repeated
    results and an empty table an empty one. `tokenizer` is a path that executors can open.
    """
    docs = docs.drop("ids", "n_tokens", "decoded")
    schema = StructType(list(docs.schema)).add("ids", "binary").add("n_tokens", "long").add("decoded", "string")
    at = docs.columns.index(column)

    def run(batches):
        bpe = ByteLevelBpe.load(tokenizer)
        try:
            for batch in batches:
                for first, n in textkit.blocks(batch.column(at).cast(pa.large_string()), BLOCK_BYTES):
                    rows = batch.slice(first, n)
                    ids = bpe.encode_batch([t or "" for t in rows.column(at).to_pylist()])
                    decoded = [bpe.decode(x) for x in ids]
                    yield pa.record_batch([*rows.columns, pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(decoded, pa.string())], names=schema.names)
        finally:
            bpe.forget()

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    out = encode_decode(docs.select("doc_id", "text"), tokenizer)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
