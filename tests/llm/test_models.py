"""Language model, toxicity and nearest neighbours against brute force and held-out rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import prose

from textloom.llm import ann, lm, toxicity


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")), ("end",)]


def kneser_ney(rows):
    """Base and model scores of every row, written out."""
    uni, bi = Counter(), Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            w = tokens(t)
            uni.update(w)
            bi.update(zip([("begin",), *w[:-1]], w, strict=True))
    total, types = sum(uni.values()), len(uni)

    def cuts(counts):
        n = Counter(counts)
        return [0.0, *lm.discounts(n[1], n[2], n[3], n[4])]

    cut, cont = cuts(bi.values()), Counter(w for _, w in bi)
    low, pairs = cuts(cont.values()), len(bi)
    gamma_low = sum(low[min(c, 3)] for c in cont.values()) / max(pairs, 1)
    context, gamma = Counter(), defaultdict(float)
    for (v, _), c in bi.items():
        context[v] += c
        gamma[v] += cut[min(c, 3)]

    def p(v, w):
        lower = (cont[w] - low[min(cont[w], 3)]) / pairs + gamma_low / (types + 1) if pairs else 1 / (types + 1)
        return (bi[v, w] - cut[min(bi[v, w], 3)]) / context[v] + gamma[v] / context[v] * lower if context[v] else lower

    out = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((uni[x] + 0.5) / (total + 0.5 * (types + 1))) for x in w)
        out.append((i, len(w), sum(uni[x] > 0 for x in w), total, base, sum(math.log10(p(a, b)) for a, b in zip([("begin",), *w[:-1]], w, strict=True))))
    probability = sum(p("the", w) for w in [*uni, "an unseen word"]) if uni else 1.0
    return out, probability


def compared(got, want):
    key = lambda r: (r[0] if r[0] is not None else -1, *r[1:4], round(r[4], 5))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:4] == w[:4]
        assert g[4:] == pytest.approx(w[4:], abs=1e-6)


@pytest.mark.parametrize("hot", [1000, 20])
def test_language_model(spark, odd, odd_rows, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT_CONTEXTS", hot)
    rows = [*odd_rows, *((100 + k, prose(80, 40 + k)) for k in range(30))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = lm.score_documents(df).collect()
    want, probability = kneser_ney(rows)
    assert probability == pytest.approx(1)
    compared([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out], want)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in out)
    assert lm.score_documents(odd.limit(0)).count() == 0


def test_nothing_to_learn_from(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    row = lm.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


# toxicity

INSULTS = ["grubnose", "mudlicker", "wormbrain", "toadface", "slugwit"]


def labelled(n, seed, disguise=None):
    rng, rows = random.Random(seed), []
    for k in range(n):
        text, toxic = prose(40, seed * 10_000 + k), rng.random() < 0.3
        if toxic:
            parts = text.split(" ")
            for _ in range(2):
                word = rng.choice(INSULTS) + rng.choice(["", "s", "!", "ed"])
                parts[rng.randrange(len(parts))] = disguise(word, rng) if disguise else word
            text = " ".join(parts)
        rows.append((seed * 1000 + k, text, int(toxic)))
    return rows


def test_toxicity_of_held_out_rows(spark):
    rows = labelled(400, 3)
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    out = toxicity.score_documents(df, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in out.collect() if r.held_out]
    assert len(held) > 60 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in held)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_disguised_insults():
    rows = labelled(400, 4)
    model = toxicity.fit([r[1] for r in rows], [r[2] for r in rows])

    def put_in(word, rng):
        at = rng.randrange(1, len(word) - 1)
        return word[:at] + rng.choice(["*", "-", word[at]]) + word[at:]

    hidden = labelled(150, 5, put_in)
    score = model.score(pa.array([r[1] for r in hidden]))
    toxic = np.array([r[2] for r in hidden]) > 0
    assert (score[toxic] >= 0.3).mean() > 0.9 and (score[~toxic] >= 0.3).mean() < 0.1


def test_two_characters_put_in_everywhere():
    rows = labelled(400, 4)
    model = toxicity.fit([r[1] for r in rows], [r[2] for r in rows])
    spaced = labelled(150, 6, lambda word, rng: rng.choice(["--", "**", "._"]).join(word))
    score = model.score(pa.array([r[1] for r in spaced]))
    toxic = np.array([r[2] for r in spaced]) > 0
    assert (score[toxic] >= 0.3).mean() > 0.8 and (score[~toxic] >= 0.3).mean() < 0.1


def test_score_of_the_folded_table():
    """A decision by the table of subsequences is the sum over the landmarks; a document's score comes from its best word."""
    rows = labelled(200, 7)
    model = toxicity.fit([r[1] for r in rows], [r[2] for r in rows])
    text = "grubnose and mud-licker stone wormbrainnn ---- x"
    found = toxicity.instances(pa.array([text]), keep_texts=True)
    assert set(found.texts) == {b"grubnose", b"and", b"mud-licker", b"mudlicker", b"stone", b"wormbrainnn", b"-", b"x"}
    plain = []
    for codes, size in zip(found.codes, found.sizes, strict=True):
        c, v = toxicity.subsequences(codes[None], np.array([size]))
        plain.append(sum(model.table[k] * w for k, w in zip(c[0], v[0], strict=True)) + model.bias)
    best = min(max(*plain, -2.0), 2.0)
    assert model.score(pa.array([text]))[0] == pytest.approx(1 / (1 + math.exp(-(best * model.line[0] + model.line[1]))))


def test_long_texts_are_learnt_from(spark):
    """Sentences of texts of any length take part, and a sentence without an end is read in pieces."""
    rows = labelled(60, 9)
    long = [(k, " ".join([t] * 80) if k % 2 else t, y) for k, t, y in rows]
    df = spark.createDataFrame([r[:2] for r in long], "doc_id long, text string")
    out = toxicity.score_documents(df, spark.createDataFrame([(r[0], r[2]) for r in long], "doc_id long, toxic int"))
    truth = {r[0]: r[2] for r in rows}
    assert sum(r.predicted == truth[r.doc_id] for r in out.collect()) >= 0.9 * len(rows)
    pieces = toxicity.sentences_of("ab " * 1000 + "end. Next one!")
    assert pieces[-1] == "Next one" and all(len(p) <= toxicity.SENTENCE for p in pieces) and len(pieces) > 5


def test_kernel_is_the_sum_over_subsequences():
    def explicit(word):
        s, out = "^" + word + "$", Counter()
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, len(s)):
                    if k - i - 2 <= toxicity.GAP:
                        out[s[i] + s[j] + s[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    names = ["idiot", "idi*ot", "moron", "aaaa", "ab"]
    found = toxicity.instances(pa.array([" ".join(names)]), keep_texts=True)
    order = [found.texts.index(n.encode()) for n in names]
    marks = (found.codes[order], found.sizes[order])
    kernel = toxicity._kernel(*marks, marks)
    maps = [explicit(n) for n in names]
    dot = lambda a, b: sum(a[k] * b[k] for k in a)
    want = [[dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)) for b in maps] for a in maps]
    assert np.allclose(kernel, want, atol=1e-5)


def test_toxicity_of_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(r[0], k % 2) for k, r in enumerate(odd_rows)] + [(1, None)], "doc_id long, toxic int")
    out = toxicity.score_documents(odd, labels).collect()
    assert len(out) == len(odd_rows) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score_documents(empty, labels).count() == 0
    assert {r.score for r in toxicity.score_documents(odd, labels.limit(0)).collect()} == {0.0}
    kept = toxicity.score_documents(odd, labels, keep=True)
    assert set(odd.columns) <= set(kept.columns) and kept.columns.count("score") == 1


# nearest neighbours


def brute_neighbours(rows, queries, k):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q in queries:
            far = sorted({(float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in good if i != q and len(w) == len(v)})
            out[q] = far[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    data = centres[rng.integers(0, 12, 1500)] + 0.3 * rng.normal(size=(1500, 16))
    data[200:500] = data[0]  # one vector with many copies
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data.astype(np.float32))]
    rows += [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] + [1.0] * 15), (None, [1.0] * 16), (9005, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    out = ann.nearest(df, df.filter("vec_id % 50 = 0"), 10).collect()
    want = brute_neighbours(rows, set(range(0, 1500, 50)), 10)
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.score, r.vec_id))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for found in got.values():
        assert found == sorted(found)
    # many equal distances: the smallest ids come first
    assert [i for _, i in got[0]] == list(range(200, 210))


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], "x"), (100, [1.0, 2.5], "x"), (101, [4.0, 2.0], "x"), (0, [1.0, 2.0], "x")], "vec_id long, embedding array<double>, score string")
    out = ann.nearest(df, df.filter("vec_id % 100 = 0"), 10)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in out.collect()) == [(0, 1, 100, 0.5), (0, 2, 101, 3.0), (100, 1, 0, 0.5), (100, 2, 101, pytest.approx(math.sqrt(9.25)))]
    assert ann.nearest(df.limit(0), df, 3).count() == 0
    assert ann.nearest(df, df.limit(0), 3).count() == 0


def test_leaves_come_nearest_first():
    data = np.random.default_rng(3).normal(size=(800, 4))
    tree = ann.Tree(data)
    path = tree.visit(data[5], tree.leaves)
    assert sorted(path) == list(range(tree.leaves)) and path[0] == tree.leaf_of(data[5:6])[0]


@pytest.mark.parametrize("copies", [2, 25])
def test_neighbours_of_repeated_ids(spark, copies):
    """The rows of an id that repeats do not take the places of other ids."""
    rng = np.random.default_rng(3)
    points = rng.normal(size=(60, 8))
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    many = [(i, (np.array(p) * (1 + 1e-9 * c)).tolist()) for i, p in rows for c in range(copies)]
    schema = "vec_id long, embedding array<double>"
    out = ann.nearest(spark.createDataFrame(many, schema).repartition(3), spark.createDataFrame(rows[:10], schema), 10).collect()
    hits = 0
    for q in range(10):
        far = np.linalg.norm(points - points[q], axis=1)
        got = [r.vec_id for r in out if r.query_id == q]
        assert len(set(got)) == 10
        hits += len(set(got) & {int(i) for i in np.argsort(far) if i != q} & set(np.argsort(far)[:11].tolist()))
    assert hits >= 90


def test_more_leaves_where_too_few_are_found(spark):
    """Queries get k rows whenever there are k candidates, also of a length that few vectors have."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in (1000.0 * (i % 40) if i < 400 else 0.0) + rng.normal(size=4)]) for i in range(400)]
    rows += [(i, [float(x) for x in rng.normal(size=7)]) for i in range(400, 415)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    for k in (10, 14, 200):
        out = defaultdict(list)
        for r in ann.nearest(df, df.filter("vec_id % 5 = 0"), k).collect():
            out[r.query_id].append(r.rank)
        for q in range(0, 415, 5):
            assert sorted(out[q]) == list(range(1, min(k, 14 if q >= 400 else 399) + 1))


def test_search_in_a_part():
    """The block search gives what plain distances give, ties and huge components included."""
    rng = np.random.default_rng(9)
    for scale in (1.0, 1e-3, 1e160):
        points = rng.integers(-3, 4, size=(300, 3)).astype(float) * scale
        part = ann.Part(np.arange(300), points, rng.integers(0, 6, 300))
        visits = [np.array([0, 2, 5]), np.arange(6)]
        with np.errstate(over="ignore", invalid="ignore"):
            found = list(part.search(np.array([7, 900]), points[[7, 8]], visits, 12))
            for (ids, far), q, own, leaves in zip(found, points[[7, 8]], (7, 900), visits, strict=True):
                rows = [(ann.distances(q, part.points[j : j + 1])[0], part.ids[j]) for j in range(300) if part.leaf[j] in leaves and part.ids[j] != own]
                assert list(zip(far.tolist(), ids.tolist(), strict=True)) == sorted(rows)[:12]
