"""The n-gram Jaccard join, components and substring dedup against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from conftest import edited, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import ssjoin, substring, textkit
from textloom.llm.graph import components, forest
from textloom.llm.ssjoin import deletion_keys, plan_keys, similarity_classes, size_bands


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def brute(rows):
    sets = defaultdict(list)
    for i, t in rows:
        sets[shingles(t)].append(i)
    sets.pop(frozenset(), None)
    names = list(sets)
    parent = {s: s for s in names}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for k, a in enumerate(names):
        for b in names[:k]:
            if 100 * len(a & b) >= 75 * len(a | b):
                parent[root(a)] = root(b)
    low = defaultdict(list)
    for s in names:
        low[root(s)] += [i for i in sets[s] if i is not None]
    out = []
    for i, t in rows:
        s = shingles(t)
        out.append((i, len(s), min(low[root(s)], default=None) if s else i))
    return out


def shown(rows):
    return sorted(map(str, rows))


def joined(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return [(r.doc_id, r.n_shingles, r.component_id) for r in similarity_classes(df).collect()]


def test_odd_rows(odd, odd_rows, empty):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in similarity_classes(odd).collect()]
    assert shown(got) == shown(brute(odd_rows))
    assert similarity_classes(empty).count() == 0


def test_chains_groups_and_common_passages(spark):
    """A chain of near copies, a large group of them, a common passage, and many short texts."""
    rng, rows = random.Random(5), []
    common = prose(40, 900)
    text = prose(100, 7)
    for k in range(12):
        rows.append((1000 - k, text))
        parts = text.split(" ")
        parts[rng.randrange(len(parts))] = f"step{k}"
        text = " ".join(parts)
    base = prose(80, 8)
    rows += [(200 + k, edited(base, 30 + k % 7, k)) for k in range(60)]
    rows += [(400 + k, common + " " + prose(30 + k % 20, k)) for k in range(60)]
    rows += [(600 + k, " ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9)))) for k in range(120)]
    assert shown(joined(spark, rows)) == shown(brute(rows))


def test_groups_that_a_star_leaves_open(spark, monkeypatch):
    """With no pairing of small groups and clusters in several blocks, every link is still found."""
    monkeypatch.setattr(ssjoin, "PAIR_GROUP", 2)
    monkeypatch.setattr(ssjoin, "BLOCK_BYTES", 400)
    monkeypatch.setattr(ssjoin, "STEP_WORDS", 50)
    rng, base, rows = random.Random(1), prose(60, 11), []
    for k in range(40):
        parts = base.split(" ")
        for _ in range(rng.randrange(0, 6)):
            parts[rng.randrange(len(parts))] = f"v{rng.randrange(30)}"
        rows.append((k, " ".join(parts)))
    assert shown(joined(spark, rows)) == shown(brute(rows))


@pytest.mark.parametrize("block", [ssjoin.BLOCK_BYTES, 20_000])
def test_all_links_of_large_groups_count(spark, monkeypatch, block):
    """Every link of a class counts once, also those between members of groups that only their hub was compared with."""
    monkeypatch.setattr(ssjoin, "BLOCK_BYTES", block)
    rng, rows = random.Random(2), []
    for base in (prose(60, 11), prose(90, 12), prose(300, 13)):
        for _ in range(40):
            parts = base.split(" ")
            for _ in range(rng.randrange(0, 4)):
                parts[rng.randrange(len(parts))] = f"v{rng.randrange(30)}"
            rows.append((len(rows), " ".join(parts)))
    rows += [(500 + k, " ".join(rng.choice("abcd") for _ in range(rng.randrange(5, 12)))) for k in range(60)]
    sets = {shingles(t) for _, t in rows}
    want = [(i, sum(100 * len(s & x) >= 75 * len(s | x) for x in sets) - 1) for i, s in ((i, shingles(t)) for i, t in rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted((r.doc_id, r.n_links) for r in similarity_classes(df).collect()) == want


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 70), st.integers(0, 10**9), st.booleans())
def test_linked_sets_share_a_key(size, seed, hot):
    """The pigeonhole argument, at the edge of the similarity."""
    rng = random.Random(seed)
    a = {rng.getrandbits(63) for _ in range(size)}
    b = set(a)
    for _ in range(200):
        c = set(b)
        if rng.random() < 0.5:
            c.add(rng.getrandbits(63))
        elif len(c) > 1:
            c.remove(rng.choice(sorted(c)))
        if 100 * len(a & c) >= 75 * len(a | c):
            b = c
    sets = [np.array(sorted(s), dtype=np.uint64) for s in (a, b)]
    row = np.repeat([0, 1], [len(s) for s in sets])
    value, sizes, sign = np.concatenate(sets), np.array([len(s) for s in sets]), np.array([1, 2])
    known = np.sort(value[::3]) if hot else np.zeros(0, np.uint64)
    bounds = size_bands(100, 75)
    k1, o1, covered = deletion_keys(row, value, sizes, sign, 75)
    rest = ~covered[row]
    k2, o2 = plan_keys(row[rest], value[rest], np.where(covered, 0, sizes), sign, bounds, 75, known, np.full(len(known), 50))
    keys, owners = np.concatenate([k1, k2]), np.concatenate([o1, o2])
    assert set(keys[owners == 1].tolist()) & set(keys[owners == 2].tolist())


def test_sketches_bound_the_difference():
    rng = random.Random(3)
    for _ in range(100):
        a = {rng.getrandbits(63) for _ in range(rng.randrange(1, 400))}
        b = {x for x in a if rng.random() < 0.9} | {rng.getrandbits(63) for _ in range(rng.randrange(1, 60))}
        sets = [np.array(sorted(s), dtype=np.uint64) for s in (a, b)]
        x, y = (np.frombuffer(s, np.uint8) for s in ssjoin._sketches(np.repeat([0, 1], [len(s) for s in sets]), np.concatenate(sets), np.array([len(s) for s in sets])))
        n = min(len(x), len(y))
        assert np.bitwise_count(ssjoin._fold(x, n) ^ ssjoin._fold(y, n)).sum() <= len(a ^ b)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)).filter(lambda t: t[0] != t[1]), min_size=1, max_size=50))
def test_forest(edges):
    parent = list(range(31))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    node, low = forest(*(np.array(x) for x in zip(*edges, strict=True)))
    assert dict(zip(node.tolist(), low.tolist(), strict=True)) == {x: root(x) for e in edges for x in e if root(x) != x}


def test_components_of_long_chains(spark):
    n = 300
    order = list(range(n))
    random.Random(2).shuffle(order)
    edges = [(order[k], order[k + 1]) for k in range(n - 1) if k % 100 != 99]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    for k in range(0, n, 100):
        part = order[k : k + 100]
        assert {out[x] for x in part} == {min(part)}


def test_shingles_of_blocks():
    import pyarrow as pa

    texts = ["A b c d e f", None, "", "a B  c", " x\ty ", "q"] * 3
    row, value, size = textkit.shingle_sets(pa.array(texts))
    assert size.tolist() == [len(shingles(t)) for t in texts]
    assert len(set(value.tolist())) == len({s for t in texts for s in shingles(t)})


# substring dedup


def test_edit_distance():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(0, 70))] for _ in "ab")
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert substring.edit_distance(np.array(a), np.array(b)) == row[-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(6, 20)), min_size=1, max_size=8))
def test_best_chain(runs):
    """The Fenwick tree finds the best chain that exhaustive search finds."""

    def score(chain):
        total = chain[0][2]
        for p, q in zip(chain, chain[1:], strict=False):
            total += q[2] - substring.GAP_COST * (q[0] - p[0] - p[2] + q[1] - p[1] - p[2])
        return total

    runs = sorted(set(runs))
    best = {r: [r] for r in runs}
    for r in runs:
        for p in runs:
            if p[0] + p[2] <= r[0] and p[1] + p[2] <= r[1] and score(best[p] + [r]) > score(best[r]):
                best[r] = best[p] + [r]
    found = list(substring.chains(runs))
    assert score(found[0]) == pytest.approx(max(map(score, best.values())))
    assert sorted(r for chain in found for r in chain) == sorted(set(runs))
    assert all(p[0] + p[2] <= r[0] and p[1] + p[2] <= r[1] for chain in found for p, r in zip(chain, chain[1:], strict=False))


def test_runs_in_covered_spans_are_left_out():
    runs = [(0, 0, 60), (5, 30, 20), (30, 2, 20), (70, 70, 12)]
    covered, found = [], []
    for chain in substring.chains(runs, 10, covered):
        found.append(chain)
        covered.append((0, 60))
    assert found == [[(0, 0, 60), (70, 70, 12)]]


def test_a_text_that_repeats_itself(spark):
    """A pair of documents with one line many times gives a row for each stretch, not for each pair of lines."""
    line = prose(12, 80) + "\n"
    rows = [(k, line * n) for k, n in ((1, 40), (2, 60), (3, 5))]
    out = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in out} == {1, 2, 3} and len(out) < 100


def test_stretches_of_repeated_lines_are_told_once(spark):
    """Lines that stand many times in both of two documents: all their words are reported, by few rows."""
    one, two = prose(25, 81).split(), prose(25, 82).split()
    rows = [(1, " ".join([*prose(30, 83).split(), *one * 100, *two * 40])), (2, " ".join([*two * 60, *prose(30, 84).split(), *one * 90]))]
    out = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = {k: set().union(*(range(r.start, r.end) for r in out if r.doc_id == k)) for k in (1, 2)}
    assert spans == {1: set(range(30, 30 + 3500)), 2: {*range(1500), *range(1530, 1530 + 2250)}}
    assert len(out) < 120


def test_reported_documents_do_not_depend_on_the_layout(spark):
    """Exact passages in random places, some of whose parts stand in other documents too, against brute force."""
    rng = random.Random(5)
    shared = [prose(rng.randint(55, 80), 900 + k).split(" ") for k in range(4)]
    rows = []
    for k in range(24):
        body = [prose(rng.randint(5, 40), 1000 + k), prose(rng.randint(5, 40), 2000 + k)]
        piece = rng.choice(shared)
        cut = rng.randint(0, 30) if k % 3 else 0
        rows.append((k, " ".join([body[0], *piece[cut : cut + rng.randint(20, 80)], body[1]])))
    windows = {}
    for k, text in rows:
        w = words(text)
        for at in range(len(w) - 49):
            windows.setdefault(tuple(w[at : at + 50]), set()).add(k)
    exact = set().union(*(v for v in windows.values() if len(v) > 1))
    for parts in (1, 3, 7):
        out = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert exact and exact <= {r.doc_id for r in out if r.edits == 0}


def test_passages(spark, odd, empty):
    passage, near = prose(70, 50), prose(90, 51)
    rows = [(1, prose(40, 60) + " " + passage + " " + prose(30, 61)), (2, passage + " " + prose(50, 62)), (3, prose(20, 63) + " " + passage), (4, prose(33, 64) + " " + near), (5, edited(near, 15) + " " + prose(44, 65)), (6, prose(300, 66)), (7, prose(300, 67) + " " + " ".join(passage.split(" ")[:30]))]
    out = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    found = {r.doc_id for r in out}
    assert found == {1, 2, 3, 4, 5}
    text = dict(rows)
    for r in out:
        a, b = words(text[r.doc_id])[r.start : r.end], words(text[r.other_id])[r.other_start : r.other_end]
        assert min(len(a), len(b)) >= 50 and r.identity >= 0.75
        if {r.doc_id, r.other_id} <= {1, 2, 3}:
            assert r.edits == 0 and a == b
    assert {r.doc_id for r in substring.repeated_passages(odd).collect()} == {1, 2, 3}
    assert substring.repeated_passages(empty).count() == 0


def test_many_copies(spark):
    """A passage that most documents hold is reported for each of them, with few rows."""
    passage = prose(60, 70)
    rows = [(k, prose(20, 100 + k) + " " + passage + " " + prose(15, 300 + k)) for k in range(80)]
    out = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id for r in out} == set(range(80)) and len(out) < 80 * 8


def planted(spark, pairs):
    """The share of pairs of texts of which both are reported with each other; other texts are (text,)."""
    rows, want = [], []
    for texts in pairs:
        first = len(rows)
        rows += [(first + k, t) for k, t in enumerate(texts)]
        want.append((first + len(texts) - 2, first + len(texts) - 1))
    out = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    text = dict(rows)
    for r in out:
        a, b = words(text[r.doc_id])[r.start : r.end], words(text[r.other_id])[r.other_start : r.other_end]
        assert min(len(a), len(b)) >= 50 and r.identity >= 0.75 and r.edits >= substring.edit_distance(*(np.array([hash(w) for w in x]) for x in (a, b)))
    spans = defaultdict(set)
    for r in out:
        spans[r.doc_id].update(range(r.start, r.end))
    return [[b in {r.doc_id for r in out}, c in {r.doc_id for r in out}, len(spans[b]), len(spans[c])] for b, c in want]


def around(passage, seed):
    return prose(30, seed) + " " + passage + " " + prose(30, seed + 1)


@pytest.mark.parametrize("parts", [(30, 30), (40, 20), (49, 31), (40, 40), (25, 25, 25), (49, 1, 49)])
def test_passages_whose_parts_stand_in_earlier_documents(spark, parts):
    """An exact passage is reported whole, whichever of its parts smaller ids hold."""
    pairs = []
    for k in range(12):
        lines = [prose(n, 10_000 + 50 * k + j) for j, n in enumerate(parts)]
        whole = " ".join(lines)
        pairs.append([*(around(x, 20_000 + 50 * k + 2 * j) for j, x in enumerate(lines)), around(whole, 30_000 + 50 * k), around(whole, 30_020 + 50 * k)])
    for b, c, in_b, in_c in planted(spark, pairs):
        assert b and c and min(in_b, in_c) >= sum(parts)


@pytest.mark.parametrize("others", [1, 2, 3])
def test_edited_passages_between_other_holders_of_their_parts(spark, others):
    """Documents with an edited passage meet, although smaller ids and ids between them hold each of its parts."""
    rows, want = [], set()
    for k in range(10):
        text = prose(60, 70_000 + k).split()
        pieces = [" ".join(text[a : a + 20]) for a in (0, 20, 40)]

        def holder(seed, pieces=pieces):
            return " ".join(prose(40, 80_000 + 100 * seed + j) + " " + p for j, p in enumerate(reversed(pieces)))

        n = len(rows)
        texts = [*(holder(10 * k + j) for j in range(others)), around(" ".join(text), 90_000 + 4 * k), *(holder(10 * k + 5 + j) for j in range(others)), around(edited(" ".join(text), 15, k), 90_002 + 4 * k)]
        rows += [(n + j, t) for j, t in enumerate(texts)]
        want |= {n + others, n + len(texts) - 1}
    out = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id for r in out} == want


@pytest.mark.parametrize("size, share, least", [(50, 0.1, 1.0), (50, 0.25, 0.9), (60, 0.15, 1.0), (60, 0.25, 0.95), (100, 0.25, 1.0)])
def test_recall_of_edited_passages(spark, size, share, least):
    """Passages with words replaced at random places, within the promised identity."""
    rng, pairs = random.Random(size), []
    for k in range(40):
        passage = prose(size, 50_000 + k)
        copy = passage.split()
        for p in rng.sample(range(size), int(share * size)):
            copy[p] = f"edit{rng.randrange(10**9)}"
        pairs.append([around(passage, 60_000 + 4 * k), around(" ".join(copy), 60_002 + 4 * k)])
    found = planted(spark, pairs)
    assert sum(b and c for b, c, _, _ in found) >= least * len(found)


def test_passages_read_each_word_once(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 32, 4000, dtype=np.uint64).astype("<u4")
    read = []
    mix = substring.textkit.mix
    monkeypatch.setattr(substring.textkit, "mix", lambda x: read.append(len(x)) or mix(x))
    batch = pa.record_batch([pa.array([7], pa.int64()), pa.array([3], pa.int64()), pa.array([words.tobytes()], pa.binary())], names=["doc", "x0", "w"])
    rows = [r for b in substring._windows(1)([batch]) for r in zip(b.column("kind").to_pylist(), b.column("data").to_pylist(), strict=True)]
    found = np.concatenate([substring._records(raw, substring._SEED) for kind, raw in rows if not kind])
    assert sorted(found["pos"].tolist()) == list(range(3, 3 + 4000 - substring.MIN_WORDS + 1))
    # the words, the windows, and little else
    assert sum(read) < 3 * len(words)
    read.clear()
    assert substring.local_runs(words, words[100:], -4000, 4000) == [(100, 0, 3900)]
    assert sum(read) == 7900


def test_parts_of_chains_with_and_without_numpy(monkeypatch):
    rng = random.Random(11)
    for _ in range(150):
        a = [rng.randrange(5000) for _ in range(rng.randrange(60, 160))]
        b = []
        for w in a:
            kind = rng.random()
            b += [w] if kind > 0.25 else [] if kind > 0.17 else [rng.randrange(5000)] if kind > 0.08 else [w, rng.randrange(5000)]
        b[rng.randrange(len(b)) : 0] = [rng.randrange(5000) for _ in range(rng.randrange(40))]
        runs = substring.local_runs(np.array(a, "<u4"), np.array(b, "<u4"), -500, 500)
        for chain in substring.chains(runs, 10):
            out = {}
            for few in (0, 300):
                monkeypatch.setattr(substring, "FEW_PARTS", few)
                out[few] = substring.align(chain, a, b)
            assert out[0] == out[300]
            for x, xe, y, ye, edits in out[0]:
                size = max(xe - x, ye - y)
                assert min(xe - x, ye - y) >= 50 and substring.edit_distance(a[x:xe], b[y:ye]) <= edits <= 0.25 * size


def test_order_of_occurrences():
    rng = np.random.default_rng(3)
    found = np.empty(3000, substring._SEED)
    found["hash"], found["doc"], found["pos"] = rng.integers(0, 900, 3000), rng.integers(-4, 4, 3000), rng.integers(0, 50, 3000)
    assert (substring._sorted(found) == found[np.lexsort((found["pos"], found["doc"], found["hash"]))]).all()
    assert len(substring._sorted(found[:0])) == 0
