"""The operators on pairs against brute force on small tables with nulls, ties and repeats."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from tracemill.llm import ngram_join, store, vectors
from tracemill.llm.ship import ship


def classes(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def texts(seed):
    rng, out = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(60)]
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 8, 12, 20, 60, 150]))
        for _ in range(rng.randint(1, 5)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(rng.choice([" ", "\n", "  "]).join(words).upper() if rng.random() < 0.2 else " ".join(words))
    return [None, "", " \t", "a", "A", "a b", *out, "x " * 3000, "É é", "é é"]


@pytest.mark.parametrize(("percent", "words", "seed"), [(90, 3, 1), (80, 5, 2), (50, 1, 3)])
def test_ngram_join(spark, percent, words, seed):
    ship(spark)
    rows = list(enumerate(texts(seed)))
    random.Random(seed).shuffle(rows)
    sets = {i: shingles(t, words) for i, t in rows}
    near = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = classes(sets, near)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, keys string, home int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df, percent, words).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


def test_ngram_join_blocks(spark, monkeypatch):
    """Groups larger than a block, whose links run across blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 24)
    ship(spark)
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(80)] = f"n{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    sets = {i: shingles(t, 3) for i, t in rows}
    near = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    want = classes(sets, near)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 90, 3).collect()}
    assert got == want


def test_ngram_join_empty(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_allocation_covers_every_difference():
    for percent in (50, 80, 90, 95):
        low = 1
        for high in ngram_join.bands(percent, 2000):
            most, m, double, slack = ngram_join.allocation(percent, low, high)
            assert m + double == most + 1 + slack and 0 <= double <= m
            low = high + 1


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (3, 3), (None, 4), (2, 1), *((i, i + 1) for i in range(100, 140))]
    got = {r.id: r.component_id for r in store.components(spark.createDataFrame(edges, "a long, b long"), store.shared_dir(spark)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, **{i: 100 for i in range(100, 141)}}


@pytest.mark.parametrize("block", [4, 1024])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    ship(spark)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(20, 8))
    rows = [(i, (base[rng.integers(20)] + rng.normal(size=8) * rng.choice([0, 0.05, 0.3])).tolist(), int(rng.integers(3))) for i in range(150)]
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 8, 1), (303, [float("nan")] * 8, 1), (304, [1.0] * 8, None), (305, [None] + [1.0] * 7, 1)]
    rows += [(306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1), (308, [float("inf")] * 8, 2), (309, [1.0, 2.0], 1)]

    def usable(x):
        return x is not None and len(x) and all(v is not None and np.isfinite(v) for v in x) and any(x)

    near = []
    for (i, x, a), (j, y, b) in combinations(rows, 2):
        if a is not None and a == b and usable(x) and usable(y) and len(x) == len(y):
            if np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                near.append((i, j))
    want = classes([r[0] for r in rows], near)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}
    assert got == {i: (sum(i in p for p in near), want[i], want[i] == i) for i, _, _ in rows}
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_ngram_join_large_groups(spark, monkeypatch):
    """5,000 near copies, which are one class, and a chain whose sets link only with their neighbours."""
    monkeypatch.setattr(ngram_join, "BLOCK", 64)
    monkeypatch.setattr(ngram_join, "GROUP", 256)
    ship(spark)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(5000):
        words = list(base)
        for at in rng.sample((0, 1, 2, 57, 58, 59), rng.randint(0, 2)):
            words[at] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    chain = [f"c{i}" for i in range(400)]
    rows += [(10_000 + 7 * i % 331, " ".join(chain[i : i + 60])) for i in range(331)]
    assert len({i for i, _ in rows}) == len(rows)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 90, 3).collect()}
    sets = {i: frozenset(shingles(t, 3)) for i, t in rows}
    one = {s: min(i for i, x in sets.items() if x == s) for s in set(sets.values())}
    near, by = [(one[s], i) for i, s in sets.items() if one[s] != i], {}
    for s, i in one.items():
        for x in s:
            by.setdefault(x, []).append(i)
    for i in one.values():
        common = {}
        for x in sets[i]:
            if len(by[x]) < 1000 or i < 50:  # the whole of the brute force for 50 copies and the chain; the others meet those 50
                for j in by[x]:
                    common[j] = common.get(j, 0) + 1
            else:
                for j in by[x][:60]:
                    common[j] = common.get(j, 0) + 1
        near += [(i, j) for j, n in common.items() if i != j and 100 * n >= 90 * (len(sets[i]) + len(sets[j]) - n)]
    assert got == classes(sorted(sets), near)


def test_ngram_join_frequent_keys(spark, monkeypatch):
    """A passage that many unlike texts share, with groups of near copies among them: nothing is lost, and fewer sets meet."""
    ship(spark)
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(240):
        own = [f"u{i % 200}x{j}" for j in range(60)]  # forty of them twice, with an edit
        if i >= 200:
            own[rng.randrange(60)] = "edit"
        rows.append((i, " ".join(passage + own)))
    sets = {i: shingles(t, 3) for i, t in rows}
    near = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want, df = classes(sets, near), spark.createDataFrame(rows, "doc_id long, text string")
    thinned, seen = ngram_join._thinned, []

    def watched(met):
        out = thinned(met)
        seen.append((met.groupBy("key").count().agg({"count": "max"}).first()[0], out.groupBy("key").count().agg({"count": "max"}).first()[0]))
        return out

    monkeypatch.setattr(ngram_join, "_thinned", watched)
    for frequent in (8, 64, 10**9):
        monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
        assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(df, 80, 3).collect()} == want
    assert len(near) == 40 and seen[0][1] < seen[2][1] <= seen[2][0] == seen[0][0]
