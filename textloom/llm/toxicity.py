"""Toxicity by a support vector machine on a subsequence string kernel.

The kernel of two words counts their common subsequences of three characters that leave
out GAP characters at most, each occurrence weighted by DECAY to the power of the
characters it leaves out, so an insult keeps most of its weight when characters are
inserted or dropped. A word with punctuation inside is read without it as well, however
much there is, and so is a run of single letters. Words are mapped to the Nystroem features of a set of
landmark words and a linear machine with squared hinge loss is trained on them.

Training is on labelled sentences, which have their document's label as that of a bag of
words: words that distinct toxic sentences have far more often than others start as
positive, words of clean sentences are negative, and the clean words that score highest
are added in rounds. A sentence decides as its most toxic word does, a document as its
most toxic sentence; the score is that decision calibrated on the labelled documents.

A decision is a weighted sum of kernels with the landmarks, so it folds into one weight
for each subsequence: executors score words against that table, not against landmarks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textkit
from .store import settle

#: Labelled documents that a model is fitted on, at most (toxic, clean), and distinct sentences of theirs (toxic, clean).
FIT_TOXIC, FIT_CLEAN = 1500, 3000
FIT_TOXIC_SENTENCES, FIT_CLEAN_SENTENCES = 40_000, 80_000
#: Characters after which a sentence without an end is cut.
SENTENCE = 500
LANDMARKS, NEGATIVES, ROUNDS = 240, 8_000, 3
DECAY = 0.6
#: Score from which a document counts as toxic.
THRESHOLD = 0.3
#: Characters of a word that one kernel evaluation sees; longer words are windows with half overlap.
WIDTH = 20

#: Characters that a subsequence may leave out.
GAP = 2
_GAPS = [(a, b) for a in range(GAP + 1) for b in range(GAP + 1 - a)]
#: Byte classes: 0 nothing, 1 begin, 2 end, letters, digits, other ASCII, bytes of other characters.
_CLASS = np.array([3 + b - 97 if 97 <= b <= 122 else 3 + b - 65 if 65 <= b <= 90 else 29 + b - 48 if 48 <= b <= 57 else 39 if b < 128 else 40 + b % 24 for b in range(256)], dtype=np.uint8)


@dataclass
class Instances:
    """Words of a block: kinds (distinct words) as class matrices, and their uses by row."""

    codes: np.ndarray
    sizes: np.ndarray
    kind: np.ndarray
    row: np.ndarray
    rows: int
    hashes: np.ndarray
    texts: list[bytes] | None


def instances(column: pa.Array, keep_texts: bool = False) -> Instances:
    """Distinct words of a block without their outer punctuation, and without any; long words as windows, spelled-out runs joined."""
    words = textkit.scan(column)
    data = words.data
    # the first and the last byte of a word that are no punctuation; a word of nothing else keeps its last one
    place = np.arange(len(data))
    solid = ~textkit.PUNCTUATION[data]
    after = np.minimum.accumulate(np.where(solid, place, len(data))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(solid, place, -1))
    start = np.minimum(after[words.start], words.end - 1)
    end = np.maximum(before[words.end - 1], start) + 1
    size, row = end - start, words.doc
    # words with punctuation inside, without it
    upto = np.concatenate([[0], np.cumsum(solid)])
    inner = np.flatnonzero((upto[end] - upto[start] < size) & (upto[end] - upto[start] > 2)) if len(size) else np.zeros(0, np.int64)
    start = np.concatenate([start, len(data) + upto[start[inner]]])
    size = np.concatenate([size, upto[end[inner]] - upto[words.start[inner]]])
    row = np.concatenate([row, row[inner]])
    data, end = np.concatenate([data, data[solid]]), start + size
    parts = [(start, size, row)]
    long = np.flatnonzero(size > WIDTH)
    if len(long):
        more = -(-(size[long] - WIDTH) // (WIDTH // 2))
        of = np.repeat(long, more)
        step = np.arange(len(of)) - np.repeat(np.cumsum(more) - more, more) + 1
        begin = np.minimum(start[of] + step * (WIDTH // 2), end[of] - WIDTH)
        parts.append((begin, np.full(len(of), WIDTH), row[of]))
    joined, jrow = _spelled(words.data, start[: len(words.doc)], size[: len(words.doc)], words.doc)
    if joined:
        base = len(data)
        data = np.concatenate([data, np.frombuffer(b"".join(joined), dtype=np.uint8)])
        sizes = np.array([len(x) for x in joined])
        parts.append((base + np.cumsum(sizes) - sizes, sizes, np.array(jrow)))
    start, size, row = (np.concatenate(x) for x in zip(*parts, strict=True))
    size = np.minimum(size, WIDTH)
    n = len(start)
    if not n:
        none = np.zeros(0, np.int64)
        return Instances(np.zeros((0, WIDTH + 2), np.uint8), none, none, none, len(column), np.zeros(0, np.uint64), [] if keep_texts else None)
    padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    # the identity of a trimmed word: its bytes in three 64-bit pieces
    raw = np.zeros((n, 24), dtype=np.uint8)
    view = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[start]
    raw[:, :WIDTH] = np.where(np.arange(WIDTH) < size[:, None], view, 0)
    piece = raw.view(np.uint64)
    hashes = textkit.mix(piece[:, 0] * np.uint64(3) + textkit.mix(piece[:, 1] * np.uint64(5) + textkit.mix(piece[:, 2] + np.uint64(7))))
    hashes, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
    sizes = size[first]
    codes = np.zeros((len(first), WIDTH + 2), dtype=np.uint8)
    codes[:, 1 : WIDTH + 1] = np.where(np.arange(WIDTH) < sizes[:, None], _CLASS[raw[first, :WIDTH]], 0)
    codes[:, 0] = 1
    codes[np.arange(len(first)), sizes + 1] = 2
    texts = [raw[i, :s].tobytes() for i, s in zip(first, sizes, strict=True)] if keep_texts else None
    return Instances(codes, sizes + 2, kind, row, len(column), hashes, texts)


def _spelled(data, start, size, row):
    """Words spelled with gaps: runs of three or more one-letter words of a row, joined."""
    single = size == 1
    if not single.any():
        return [], []
    run = np.flatnonzero(single)
    breaks = np.flatnonzero((np.diff(run) > 1) | (np.diff(row[run]) != 0)) + 1
    out, rows = [], []
    for part in np.split(run, breaks):
        if len(part) >= 3:
            text = data[start[part]].tobytes()
            for k in range(0, max(len(text) - WIDTH // 2, 1), WIDTH // 2):
                out.append(text[k : k + WIDTH])
                rows.append(int(row[part[0]]))
    return out, rows


def subsequences(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, weights) of the three-character subsequences of each word, normalised to a unit kernel."""
    width, codes = int(sizes.max(initial=3)), codes.astype(np.int32)
    out, weight = [], []
    for a, b in _GAPS:
        span = 3 + a + b
        if width < span:
            continue
        x, y, z = codes[:, : width - span + 1], codes[:, 1 + a : width - span + 2 + a], codes[:, 2 + a + b : width]
        out.append((x << 12) | (y << 6) | z)
        weight.append(np.where(np.arange(width - span + 1) + span <= sizes[:, None], DECAY ** (a + b), 0.0))
    if not out:
        return np.zeros((len(codes), 1), np.int64), np.zeros((len(codes), 1))
    code, value = np.concatenate(out, axis=1), np.concatenate(weight, axis=1)
    code = np.where(value > 0, code, 0)
    order = np.argsort(code, axis=1)
    code, value = np.take_along_axis(code, order, 1), np.take_along_axis(value, order, 1)
    # the kernel of a word with itself: equal subsequences add up before they are squared
    run = np.cumsum(value, axis=1)
    last = np.ones(code.shape, dtype=bool)
    last[:, :-1] = code[:, 1:] != code[:, :-1]
    upto = np.where(last, run, 0.0)
    before = np.maximum.accumulate(np.concatenate([np.zeros((len(code), 1)), upto[:, :-1]], axis=1), axis=1)
    norm = np.sqrt(np.where(last, (run - before) ** 2, 0.0).sum(axis=1))
    return code, value / np.maximum(norm, 1e-12)[:, None]


def _by_width(codes, sizes, fn, width=1):
    """fn over words of similar length, so that short words cost little."""
    out = np.zeros((len(sizes), width)) if width > 1 else np.zeros(len(sizes))
    low = 0
    for high in (8, 12, 16, WIDTH + 2):
        for at in np.array_split(some := np.flatnonzero((sizes > low) & (sizes <= high)), len(some) // 4_000 + 1):
            if len(at):
                out[at] = fn(*subsequences(codes[at], sizes[at]))
        low = high
    return out


@dataclass
class Model:
    """table: weight of each subsequence; bias; and the calibration of (best decision of a document's words, 1)."""

    table: np.ndarray
    bias: float | None
    line: np.ndarray
    prior: float

    def decide(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return _by_width(codes, sizes, lambda c, v: (self.table[c] * v).sum(axis=1)) + self.bias

    def features(self, found: Instances) -> np.ndarray:
        best = np.full(found.rows, -2.0)
        if len(found.kind):
            np.maximum.at(best, found.row, self.decide(found.codes, found.sizes)[found.kind])
        return np.stack([np.clip(best, -2, 2), np.ones(found.rows)], axis=1)

    def score(self, column: pa.Array) -> np.ndarray:
        if not len(self.line):
            return np.full(len(column), self.prior)
        return 1 / (1 + np.exp(-self.features(instances(column)) @ self.line))


def _kernel(codes, sizes, marks):
    """Kernel of words with landmarks, through dense rows of the landmarks' subsequences."""
    c, v = subsequences(*marks)
    used = np.unique(c[v > 0])
    place = np.zeros(1 << 18, dtype=np.int32)
    place[used] = np.arange(1, len(used) + 1)
    dense = np.zeros((len(used) + 1, len(c)), dtype=np.float32)
    for j in range(len(c)):
        np.add.at(dense[:, j], place[c[j]], v[j])
    dense[0] = 0

    def part(c, v):
        out = np.zeros((len(c), dense.shape[1]))
        for k in range(c.shape[1]):
            out += dense[place[c[:, k]]] * v[:, k, None]
        return out

    return _by_width(codes, sizes, part, len(marks[1]))


def _machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Linear machine with squared hinge loss, by Newton steps on the active set; the last weight is the bias."""
    z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    w = np.zeros(z.shape[1])
    eye = ridge * np.eye(z.shape[1])
    eye[-1, -1] = 1e-6
    for _ in range(25):
        active = y * (z @ w) < 1
        za = z[active] * weight[active, None]
        new = np.linalg.solve(z[active].T @ za + eye, za.T @ y[active])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _association(groups: np.ndarray, toxic: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood ratio and log odds of each group among toxic units against clean ones."""
    hit, miss = np.bincount(groups[toxic], minlength=n), np.bincount(groups[~toxic], minlength=n)
    share = max(toxic.mean(), 1e-6)
    total = hit + miss
    with np.errstate(divide="ignore", invalid="ignore"):
        g2 = 2 * (np.nan_to_num(hit * np.log(hit / (total * share))) + np.nan_to_num(miss * np.log(miss / (total * (1 - share)))))
    odds = np.log((hit + 0.5) / (miss + 0.5)) - np.log(share / (1 - share + 1e-9))
    return g2, odds


def _disguised(words: list[bytes]) -> Instances:
    """Each word with a character put in, one doubled, and all of them spaced out."""
    rng, out = np.random.default_rng(7), []
    for word in words:
        if len(word) > 3:
            at = int(rng.integers(1, len(word)))
            out += [word[:at] + rng.choice([b"*", b".", b"-", b"_"]) + word[at:], word[:at] + word[at - 1 : at] + word[at:], b".".join(word[k : k + 1] for k in range(len(word)))]
    return instances(pa.array([x.decode("latin-1") for x in out if x.isascii()], pa.large_string()))


def _vocabulary(sentences: dict[str, bool]) -> tuple[Instances, np.ndarray]:
    """Distinct words of all sentences, a use for each sentence and word, and whether that sentence is toxic."""
    texts, label = pa.array(list(sentences), pa.large_string()), np.array(list(sentences.values()), dtype=bool)
    place: dict[int, int] = {}
    codes, sizes, names, kinds, toxic = [], [], [], [], []
    for at, n in textkit.blocks(texts):
        found = instances(texts.slice(at, n), keep_texts=True)
        if not len(found.kind):
            continue
        known = len(place)
        number = np.array([place.setdefault(h, len(place)) for h in found.hashes.tolist()], dtype=np.int64)
        new = np.flatnonzero(number >= known)
        codes.append(found.codes[new])
        sizes.append(found.sizes[new])
        names.extend(found.texts[k] for k in new)
        unit = np.unique(found.row * len(found.sizes) + found.kind)
        kinds.append(number[unit % len(found.sizes)].astype(np.int32))
        toxic.append(label[at + unit // len(found.sizes)])
    if not kinds:
        none = np.zeros(0, np.int64)
        return Instances(np.zeros((0, WIDTH + 2), np.uint8), none, none, none, 0, np.zeros(0, np.uint64), []), np.zeros(0, bool)
    return Instances(np.concatenate(codes), np.concatenate(sizes), np.concatenate(kinds), np.zeros(0, np.int64), len(texts), np.zeros(0, np.uint64), names), np.concatenate(toxic)


def sentences_of(text: str) -> list[str]:
    """The sentences of a text, long ones in pieces that overlap by the width of a word's window."""
    out = []
    for s in re.split(r"[.!?\n]+", text):
        s = s.strip()
        out += [s[k : k + SENTENCE] for k in range(0, max(len(s) - WIDTH, 1), SENTENCE - WIDTH)] if s else []
    return out


def fit(texts: list[str], labels: list[int]) -> Model:
    """Train on labelled texts; without texts of both classes the score is the share of toxic ones."""
    sentences: dict[str, bool] = {}
    for text, label in zip(texts, labels, strict=True):
        for s in sentences_of(text):
            # sentences of copies count once
            sentences[s] = sentences.get(s, True) and bool(label)
    model = train(sentences, float(np.mean(labels)) if labels else 0.0)
    if model.bias is None:
        return model
    x = np.concatenate([model.features(instances(pa.array(texts[k : k + 50], pa.large_string()))) for k in range(0, len(texts), 50)])
    model.line = _logistic(x, np.array(labels, dtype=float))
    return model


def train(sentences: dict[str, bool], prior: float) -> Model:
    """The machine of labelled sentences, not calibrated; prior: share of toxic documents. bias is None if nothing can be learnt."""
    none = Model(np.zeros(1), None, np.zeros(0), prior)
    if not 0 < prior < 1:
        return none
    found, toxic = _vocabulary(sentences)
    kind = found.kind
    if not len(kind):
        return none
    g2, odds = _association(kind, toxic, len(found.sizes))
    stems = np.unique(np.array([t[:4] for t in found.texts], dtype="S4"), return_inverse=True)[1]
    stem_g2, stem_odds = _association(stems[kind], toxic, int(stems.max()) + 1)
    hit, miss = np.bincount(kind[toxic], minlength=len(g2)), np.bincount(kind[~toxic], minlength=len(g2))
    strength = np.maximum(np.where(odds > 2, g2, 0), np.where((stem_odds[stems] > 2) & (miss == 0), stem_g2[stems], 0))
    floor = max(15.0, 0.02 * strength.max())
    positive = np.flatnonzero((strength >= floor) & (hit > 0))
    if not len(positive):
        positive = np.argsort(-strength)[:5]
        positive = positive[strength[positive] > 0]
        if not len(positive):
            return none
    positive = positive[np.argsort(-strength[positive], kind="stable")][:4000]
    rng = np.random.default_rng(3)
    clean = np.flatnonzero(miss > 0)
    clean = clean[~np.isin(clean, positive)]
    negative = rng.permutation(clean)[:NEGATIVES]
    often = clean[np.argsort(-miss[clean], kind="stable")][: LANDMARKS // 2]
    # the strongest words of each stem in turn, so that no stem takes all the landmarks
    order = np.argsort(stems[positive], kind="stable")
    _, begin, count = np.unique(stems[positive][order], return_index=True, return_counts=True)
    turn = np.empty(len(positive), dtype=np.int64)
    turn[order] = np.arange(len(positive)) - np.repeat(begin, count)
    marks = np.concatenate([positive[np.argsort(turn, kind="stable")][: LANDMARKS // 2], often])
    marks = (found.codes[marks], found.sizes[marks])
    gram = _kernel(*marks, marks)
    value, vector = np.linalg.eigh(gram + 1e-6 * np.eye(len(gram)))
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
    model = none
    c, v = subsequences(*marks)
    other = _disguised([found.texts[k] for k in positive[np.argsort(turn, kind="stable")][:LANDMARKS]])
    z = np.concatenate([_kernel(found.codes[positive], found.sizes[positive], marks), _kernel(other.codes, other.sizes, marks)]) @ root
    wanted = len(z)
    fresh = negative
    for _ in range(ROUNDS):
        z = np.concatenate([z, _kernel(found.codes[fresh], found.sizes[fresh], marks) @ root])
        sign = np.where(np.arange(len(z)) < wanted, 1.0, -1.0)
        weight = np.where(sign > 0, max(1.0, 0.2 * len(negative) / wanted), 1.0)
        w = _machine(z, sign, weight)
        beta = root @ w[:-1]
        table = np.zeros(1 << 18)
        np.add.at(table, c.ravel(), (v * beta[:, None]).ravel())
        table[0] = 0
        model = Model(table, float(w[-1]), np.zeros(0), prior)
        hard = clean[np.argsort(-model.decide(found.codes[clean], found.sizes[clean]), kind="stable")][:2000]
        fresh = hard[~np.isin(hard, negative)]
        negative = np.concatenate([negative, fresh])
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, text) of at most FIT_TOXIC and FIT_CLEAN labelled rows that are not held out, chosen by a hash of their id."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    known = known.filter(~held_out("doc_id"))
    present = known.join(docs.filter("doc_id is not null and text is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    picked = None
    for value, most in ((1, FIT_TOXIC), (0, FIT_CLEAN)):
        some = present.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = some if picked is None else picked.union(some)
    # an id that repeats gives its first text
    rows = docs.filter("text is not null").join(F.broadcast(settle(picked, "picked")), "doc_id")
    return settle(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("toxic", "text"), "labelled")


def _split(batches):
    for batch in batches:
        toxic, out = [], []
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = sentences_of(text)
            toxic += [label] * len(found)
            out += found
        yield pa.record_batch([pa.array(toxic, pa.int32()), pa.array(out, pa.string())], names=["toxic", "sentence"])


def fit_sample(sample: DataFrame) -> Model:
    """The model of a settled sample (toxic, text): sentences come to the driver, texts do not."""
    spark = sample.sparkSession
    rows, toxic = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    prior = (toxic or 0) / rows if rows else 0.0
    once = sample.mapInArrow(_split, "toxic int, sentence string").groupBy("sentence").agg(F.min("toxic").alias("toxic"))
    sentences: dict[str, bool] = {}
    for value, most in ((1, FIT_TOXIC_SENTENCES), (0, FIT_CLEAN_SENTENCES)) if 0 < prior < 1 else ():
        for r in once.filter(F.col("toxic") == value).orderBy(F.xxhash64("sentence"), "sentence").limit(most).collect():
            sentences[r.sentence] = bool(value)
    model = train(sentences, prior)
    if model.bias is None:
        return model
    shared = spark.sparkContext.broadcast(model)

    def decide(batches):
        for batch in batches:
            for at, n in textkit.blocks(batch.column(1)):
                found = shared.value.features(instances(batch.column(1).slice(at, n)))
                yield pa.record_batch([batch.column(0).slice(at, n), pa.array(found[:, 0])], names=["toxic", "best"])

    told = sample.mapInArrow(decide, "toxic int, best double").orderBy("best", "toxic").toArrow()
    best, y = (told.column(c).to_numpy().astype(float) for c in ("best", "toxic"))
    model.line = _logistic(np.stack([best, np.ones(len(best))], axis=1), y)
    return model


def held_out(column: str):
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, keep: bool = False) -> DataFrame:
    """Toxicity of every row of docs (doc_id, text), learnt from labels (doc_id, toxic).

    Returns one row per input row: doc_id, held_out, score and predicted; with keep=True
    the columns of docs, then these three (which replace columns of these names). Labels of
    held-out ids are not read. A null text scores as the empty one, from the calibration
    alone; a null id is not held out; a document that is labelled twice is toxic if any
    label says so. Without labels of both classes every score is the share of toxic
    labels (0 without labels). Repeated rows repeat; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    whole = docs.drop("held_out", "score", "predicted")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").alias("toxic"))
    shared = spark.sparkContext.broadcast(fit_sample(labelled_sample(docs, labels)))

    source = whole if keep else docs
    at_text = source.columns.index("text")

    def run(batches):
        model = shared.value
        for batch in batches:
            for at, n in textkit.blocks(batch.column(at_text)):
                rows = batch.slice(at, n)
                out = rows.columns if keep else rows.columns[:1]
                yield pa.record_batch([*out, pa.array(model.score(rows.column(at_text)))], names=schema.names)
            textkit.release()

    schema = StructType(list(source.schema) if keep else list(source.schema)[:1]).add("score", "double")
    out = source.mapInArrow(run, schema)
    kept = source.columns if keep else ["doc_id"]
    return out.select(*kept, held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
