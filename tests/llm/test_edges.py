"""Edges that every operator on texts and every stage has to take: nulls, empty and very long texts, repeated rows, empty tables, clashing columns."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracemill.llm import decontaminate, extract, language, licenses, pieces, quality, store, tokenids, wordpiece
from tracemill.llm.ship import ship

BPE = public_tokenizers.path("byte_bpe_50k.json")
LONG = "plain words of a very long text, " * 12000
TEXTS = [(1, None), (2, ""), (3, " \n"), (4, LONG), (5, "the same row here"), (5, "the same row here"), (None, "no id"), (6, "x" * 200000)]
#: Names that operators give to their results.
TAKEN = ["n_words", "n_tokens", "pieces", "decoded", "quality_score", "lang_pred", "lang_score", "lang_rejected", "n_chars", "bench_hits", "license", "dice", "start"]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").select("*", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"))
    return df.select("*", *(F.lit("mine").alias(c) for c in TAKEN))


@pytest.fixture(scope="module")
def learnt(spark):
    ship(spark)
    rows = [(i, f"{'good plain words about rivers' if i % 2 else '!! $$ CLICK || HERE'} {'alpha beta' * (i % 7)} {i}", "en" if i % 2 else "xx") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df, df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))


def operators(spark, learnt):
    df, labels = learnt
    vocabulary, model = wordpiece.load(BPE), pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    bench = spark.createDataFrame([(1, "plain words of a very long text, plain words"), (2, None)], "item_id long, text string")
    marks, tongues = quality.fit(df, labels), language.fit(df)
    return {
        "count": (lambda d: wordpiece.count(d, vocabulary), ["n_words", "n_tokens"]),
        "encode": (lambda d: pieces.encode(d, model), ["pieces"]),
        "decode": (lambda d: pieces.decode(pieces.encode(d, model), model), ["pieces", "decoded"]),
        "score": (lambda d: quality.score(d, marks), ["quality_score"]),
        "identify": (lambda d: language.identify(d, tongues), ["lang_pred", "lang_score", "lang_rejected"]),
        "find": (lambda d: decontaminate.find(d, bench), [decontaminate.HITS]),
    }


@pytest.fixture(scope="module")
def made(spark, learnt):
    return operators(spark, learnt)


@pytest.mark.parametrize("name", ["count", "encode", "decode", "score", "identify", "find"])
def test_edges(docs, made, name):
    run, results = made[name]
    out = run(docs)
    assert sorted(out.columns) == sorted({*docs.columns, *results})
    got = [r.asDict() for r in out.collect()]
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == sorted((i or 0, t or "") for i, t in TEXTS)
    kept = [c for c in TAKEN if c not in results]
    assert all(r[c] == "mine" for r in got for c in kept) and not any(r[c] == "mine" for r in got for c in results)
    same = [[r[c] for c in results] for r in got if r["doc_id"] == 5]
    assert len(same) == 2 and same[0] == same[1]
    empty = run(docs.limit(0))
    assert empty.count() == 0 and empty.columns == out.columns


def test_token_file_edges(spark, docs):
    folder = store.shared_dir(spark)
    rows = tokenids.read(tokenids.write(docs.where("doc_id is not null"), folder, BPE), folder)
    got = rows.orderBy("start").collect()
    assert [r.doc_id for r in got] == [1, 2, 3, 4, 5, 5, 6] and [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(7)]
    assert got[4].ids_crc32 == got[5].ids_crc32
    folder = store.shared_dir(spark)
    assert tokenids.read(tokenids.write(docs.limit(0), folder, BPE), folder).count() == 0


def test_license_edges(docs):
    for f in (licenses.scan, licenses.spans):
        assert f(docs).count() == 0 and f(docs.limit(0)).count() == 0
    ties = docs.limit(1).select(F.lit(9).cast("long").alias("doc_id"), F.lit("This work is licensed under the GNU General Public License, version").alias("text"))
    first = licenses.scan(ties).collect()
    assert [(r.license, r.line_no) for r in first] == [("GPL-2.0", 1)]


def test_extraction_edges(spark):
    ship(spark)
    body = "<article>" + "<p>A sentence of some words that tells of rivers and of hills.</p>" * 3000 + "</article>"
    rows = [(1, "u", None, "mine"), (2, None, "", "mine"), (3, "u", "<div></div>", "mine"), (4, "u", body, "mine"), (4, "u", body, "mine"), (None, "u", "<p>", "mine")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")
    got = extract.extract(pages).collect()
    assert len(got) == 6 and all(r.text == "" and r.n_chars == 0 for r in got if r.page_id in (1, 2, 3))
    long = [r for r in got if r.page_id == 4]
    assert long[0] == long[1] and long[0].n_chars == len(long[0].text) > 0
    assert extract.extract(pages.limit(0)).count() == 0


@pytest.fixture(scope="module")
def tables(spark, learnt, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    df, labels = learnt
    labels.withColumn("toxic", F.lit(0)).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "an item of the benchmark that stands in no document at all"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages(spark, tables, learnt, stage):
    name, f = stage
    wide = lambda d: d.select("doc_id", "text", "lang", F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("part"))
    odd = spark.createDataFrame([(1000 + (i or 0), t, None) for i, t in TEXTS], "doc_id long, text string, lang string")
    docs = wide(learnt[0].unionByName(odd))
    out = f(spark, docs, tables)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert set(ids) <= {r.doc_id for r in docs.select("doc_id").collect()} and ids
    if name != "pieces":
        assert out.columns == corpus_pipeline.COLUMNS
    empty = f(spark, docs.limit(0), tables)
    assert empty.count() == 0 and empty.columns == out.columns


def _edit(a, b):
    """Edit distance of two whole strings."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _nearest(item, text):
    """Least edit distance of item to any substring of text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_decontamination_places(spark):
    """Every document against every item by plain dynamic programming: the pairs, their distances and the places."""
    ship(spark)
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcd ef") for _ in range(n))
    items = [(i, letters(rng.randint(20, 70))) for i in range(8)] + [(20, "x"), (21, "ab cd")]
    items += [(30, items[0][1]), (31, items[1][1][:30])]
    texts = []
    for _ in range(60):
        part = list(rng.choice(items[:8])[1])
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(part))
            part[at : at + 1] = rng.choice([[], [part[at], rng.choice("abcdef")], [rng.choice("abcdef")]])
        texts.append(letters(rng.randint(0, 60)) + "".join(part) + letters(rng.randint(0, 60)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.find(df, spark.createDataFrame(items, "item_id long, text string"), error_rate=0.12)
    got = {(r.doc_id, h.item_id): h for r in found.collect() for h in r[decontaminate.HITS]}
    n = 0
    for i, text in enumerate(map(decontaminate.normal, texts)):
        for k, item in ((k, decontaminate.normal(t)) for k, t in items):
            least = _nearest(item, text)
            assert ((i, k) in got) == (least <= int(len(item) * 0.12))
            if (i, k) in got:
                h, n = got[i, k], n + (least > 0)
                assert h.distance == least == _edit(item, text[h.start : h.start + h.length])
    assert n > 15


def test_dual_descent_reaches_the_optimum():
    """The hinge loss with its penalty is no higher than where a plain subgradient descent ends, nor anywhere near."""
    rng = np.random.default_rng(4)
    size, n = 30, 120
    rows = [np.sort(rng.choice(size, 6, replace=False)) for _ in range(n)]
    values = [rng.random(6) + 0.5 for _ in range(n)]
    x = np.zeros((n, size))
    for i in range(n):
        x[i, rows[i]] = values[i]
    y = np.where(x @ rng.normal(size=size) + rng.normal(size=n) * 0.5 > 0, 1.0, -1.0)
    costs = np.where(y > 0, 0.5, 1.0)
    loss = lambda w: 0.5 * w @ w + (costs * np.maximum(0, 1 - y * (x @ w))).sum()
    w = quality.descend(rows, values, y, costs, size, 400)
    own, other, best = loss(w), np.zeros(size), np.inf
    for t in range(1, 6000):
        other = other - (other - (costs * y * (y * (x @ other) < 1)) @ x) / t
        best = min(best, loss(other))
    assert own <= best * 1.001
    assert all(own <= loss(w + rng.normal(size=size) * s) + 1e-9 for s in (0.3, 0.1, 0.03) for _ in range(200))


def test_names_of_helper_columns(spark, learnt):
    """Columns named like those that operators add for themselves, in any place and spelling, keep their values on either path."""
    df, _ = learnt
    bench = spark.createDataFrame([(1, "good plain words about rivers alpha"), (2, "click here click here now please")], "item_id long, text string")
    docs = df.limit(40).select(F.lit("a").alias("HAS_LETTER"), F.lit("b").alias("__letter"), F.lit("c").alias("bench_hits_row"), "doc_id", F.lit("d").alias("Bench_Hits_Row_"), "text")
    model = language.fit(df)
    named = language.identify(docs, model)
    assert named.columns == [*docs.columns, "lang_pred", "lang_score", "lang_rejected"]
    assert {(r["HAS_LETTER"], r["__letter"]) for r in named.collect()} == {("a", "b")}
    one, many = decontaminate.find(docs, bench), decontaminate.find(docs, bench, chunk=20)
    assert one.dtypes == many.dtypes
    rows = [sorted(map(str, x.collect())) for x in (one, many)]
    assert rows[0] == rows[1] and "c" in {r.bench_hits_row for r in one.collect()}
