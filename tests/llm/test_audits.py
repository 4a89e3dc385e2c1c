"""Source divergence, resampling and top-k search against brute force on small tables with nulls, ties, repeats and long texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill.llm import divergence, resample, topk
from tracemill.llm.ship import ship

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def corpus(seed=3, n=160):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "été", "漢字", "x1y", "don't", "İ", "z\0q", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 5, 20, 60]))), rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "b", "é", None])) for i in range(n)]
    return [*rows, (n, None, "en", "only"), (n + 1, "", "xx", "alone"), (n + 2, "... 123 !", "xx", "other"), rows[5], rows[5], (None, "alpha beta", "en", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.createDataFrame([(*r, 1, "mine") for r in corpus()], "doc_id long, text string, lang string, source string, n long, term string")


def audited(rows, min_docs, top):
    rows = [tuple(x or "" for x in r[1:4]) for r in rows]
    found = [(lang, source, re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate(LOW))) for text, lang, source in rows]
    out = set()
    for lang in {r[0] for r in found}:
        own = [r for r in found if r[0] == lang]
        seen = Counter(t for _, _, terms in own for t in set(terms))
        kept = sorted(t for t in seen if seen[t] >= min_docs)
        groups = {s: Counter(t for _, x, terms in own if x == s for t in terms if seen[t] >= min_docs) for s in {r[1] for r in own}}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        f = lambda x, y: (x - y) ** 2 // (x + y)
        q, ps = p(sum(groups.values(), Counter())), {s: p(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(-sum(f(ps[s][t], ps[r][t]) for t in kept), r.encode(), r) for r in groups if r != s]
            terms = [(-f(ps[s][t], q[t]), t.encode(), t) for t in kept if groups[s][t] and ps[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out |= {(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(sorted(items)[:most])}
    return out


@pytest.mark.parametrize(("min_docs", "top", "at_once"), [(10, 10, 200), (2, 3, 1), (1000, 10, 200)])
def test_divergence(docs, min_docs, top, at_once):
    got = divergence.audit(docs, min_docs, top, at_once).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == audited(corpus(), min_docs, top)


def test_divergence_bounds(docs, monkeypatch):
    """Small limits everywhere: long texts in pieces, terms whose counts fill a query, sums made fewer on the way."""
    monkeypatch.setattr(divergence, "PIECE", 7)
    text = ("Alpha beta " * 9 + "verylongwordwithoutblanks").encode()
    table = divergence._texts(pa.record_batch([pa.array([""]), pa.array(["en"]), pa.array(["a"])], ["text", "lang", "source"]), 0, text, np.array([0, len(text)]))
    assert b"".join(x.encode() for x in table.column("text").to_pylist()) == text and set(table.column("i").to_pylist()) == {0} and table.num_rows > 5
    assert not any(x.split() and len(x.split()[0]) and not text.decode().split().count(x.split()[0]) for x in table.column("text").to_pylist())
    monkeypatch.setattr(divergence, "AT_ONCE", 5)
    rows = pa.table({"lang": ["en"] * 40, "term": ["a"] * 3 + ["b"] * 30 + ["c"] * 7, "n": list(range(40))})
    merged = lambda t: t.slice(0, 1).set_column(2, "n", [[sum(t.column("n").to_pylist())]])
    parts = list(divergence._by_term(iter(rows.to_batches(max_chunksize=4)), merged))
    terms = [set(p.column("term").to_pylist()) for p in parts]
    assert sum(sum(p.column("n").to_pylist()) for p in parts) == sum(range(40)) and sum(map(len, terms)) == 3
    monkeypatch.setattr(divergence, "HELD", 3)
    counted = Counter()
    rows = [r for r in corpus() if r[1]]
    batch = pa.record_batch([pa.array([r[1] for r in rows]), pa.array([r[2] or "" for r in rows]), pa.array([r[3] or "" for r in rows])], ["text", "lang", "source"])
    for b in divergence._counted(iter([batch.slice(0, 50), batch.slice(50)])):
        for lang, term, source, n, d in zip(*(c.to_pylist() for c in b.columns)):
            counted += Counter({(lang, term, source, 0): n, (lang, term, source, 1): d})
    want = Counter()
    for _, text, lang, source in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate(LOW))
        want += Counter((lang or "", t, source or "", 0) for t in terms) + Counter((lang or "", t, source or "", 1) for t in set(terms))
    assert counted == want


def test_divergence_empty(docs):
    assert divergence.audit(docs.limit(0)).count() == 0


def features(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]]


def drawn(rows, target, percent=25, min_words=20):
    made = [(r[0], *features(r[1])) for r in rows if r[0] is not None]
    s, t = Counter(b for _, _, f in made for b in f), Counter(b for x in target for b in features(x)[1])
    total, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total + 10000) / ((s[b] + 1) * (total_t + 10000)))) for b in range(10000)]
    out = []
    for i, words, f in made:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, words])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0], r[1]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("percent", [25, 100, 0])
def test_resampling(spark, docs, percent):
    target = ["Alpha beta gamma", None, "", "wa wb wa wb " * 20]
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = resample.resample(docs, aim, percent).collect()
    assert sorted(map(tuple, got), key=str) == drawn(corpus(), target, percent)
    assert resample.resample(docs.limit(0), aim).count() == 0
    alone = resample.resample(docs, aim.limit(0), percent).collect()
    assert sorted(map(tuple, alone), key=str) == drawn(corpus(), [], percent)


@pytest.mark.parametrize("piece", [3, 40, 10**6])
def test_streams_of_long_texts(monkeypatch, piece):
    """One text in pieces, words longer than a step of the checksum, pieces that begin and end with blanks."""
    monkeypatch.setattr(resample, "LONGEST", piece)
    rng = random.Random(piece)
    for _ in range(40):
        text = "".join(rng.choice(["a", "Bc", "é", "0", " ", "  ", "-", "q" * rng.choice([1, 47, 48, 49, 200])]) for _ in range(rng.randint(0, 60)))
        data = np.frombuffer(text.encode(), np.uint8)
        numbers, sizes = resample.long_stream(data)
        whole = resample.stream(data, np.array([0, len(data)]))[0]
        assert numbers.tolist() == whole.tolist() and sizes.tolist() == [len(numbers)] and Counter(numbers.tolist()) == Counter(features(text)[1])


def test_run_lengths(monkeypatch):
    monkeypatch.setattr(resample, "RUN", 50)
    x = np.random.default_rng(1).integers(0, 9, 333).astype("<u2")
    batch = pa.record_batch([pa.array([x[:200].tobytes(), b"", x[200:].tobytes()], pa.binary())], ["stream"])
    found = Counter()
    for b in resample._lengths(iter([batch])):
        found += Counter(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
    assert found == Counter(x.tolist())


def nearest(queries, rows, k=20):
    value = lambda e: None if e is None or any(x is None or not math.isfinite(x) for x in e) else [math.floor(64 * float(x)) for x in e]
    every = sorted({(i, tuple(v)) for i, e, *_ in rows if i is not None and (v := value(e)) is not None})
    out = []
    for i, e, *_ in queries:
        v = value(e)
        if i is not None and v is not None:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in every if len(w) == len(v) and (j, w) != (i, tuple(v)))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize(("block", "first", "scale"), [(2048, 4, 1.0), (8, 1, 1.0), (8, 1, 2e6), (8, 1, 1e-3)])
def test_top_k(spark, monkeypatch, block, first, scale):
    """Copies by the hundred, ties, other lengths, nulls and values that need each kind of matrix."""
    for name, value in (("BLOCK", block), ("QUERIES", block), ("FIRST", first), ("SPREAD", 2), ("SLAB", 5)):
        monkeypatch.setattr(topk, name, value)
    ship(spark)
    rng = np.random.default_rng(block)
    centres = rng.normal(0, 1, (12, 6)) * scale
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.05, 6) * scale).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(2000 + i, [float(i % 3), -0.25]) for i in range(60)] + [(3000, []), (3020, []), (3040, [])]
    rows += [(None, rows[3][1]), (4000, None), (4020, [1.0, None]), (4040, [float("nan")] * 6), (4060, [float("inf")] * 6), (4080, [0.0] * 6), (20, rows[20][1]), (20, rows[21][1]), (5000, [1e300] * 6)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, key string, score int")
    took_part = [r for r in rows if r[0] != 5000]  # its products aren't longs
    got = sorted(map(tuple, topk.search(df.where("vec_id % 20 = 0"), df, 20).collect()))
    assert got == nearest([r for r in took_part if r[0] is not None and r[0] % 20 == 0], took_part)


def test_top_k_edges(spark):
    ship(spark)
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    none = df.limit(0)
    assert [topk.search(a, b).count() for a, b in ((none, df), (df, none), (none, none))] == [0, 0, 0]
    assert sorted(map(tuple, topk.search(df, df, 1).collect())) == [(0, 1, 1, 64 * 32 + 128 * 32), (1, 1, 0, 64 * 32 + 128 * 32)]
    other = spark.createDataFrame([(7, [1.0, 1.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in topk.search(other, df, 2).orderBy("rank").collect()] == [0, 0, 1, 1]


def test_top_k_skips_far_annuli(spark, monkeypatch):
    """Well apart clusters: far fewer pairs of blocks are multiplied than there are."""
    for name, value in (("BLOCK", 16), ("QUERIES", 16), ("FIRST", 2)):
        monkeypatch.setattr(topk, name, value)
    ship(spark)
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (8, 16))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = [(i, (centres[i % 8] * 4 + rng.normal(0, 0.02, 16)).tolist()) for i in range(800)]
    met = []
    run = topk._met
    count = spark.sparkContext.accumulator(0)

    def counted(held, k):
        inner = run(held, k)

        def call(batches):
            def seen():
                for b in batches:
                    count.add(b.num_rows)
                    yield b

            yield from inner(seen())

        return call

    monkeypatch.setattr(topk, "_met", counted)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    met = sorted(map(tuple, topk.search(df.where(F.col("vec_id") % 20 == 0), df, 20).collect()))
    assert met == nearest([r for r in rows if r[0] % 20 == 0], rows)
    assert count.value < 0.7 * (40 / 16 + 8) * (800 / 16 + 8)
