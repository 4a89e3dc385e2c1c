"""The operators on single texts against brute force, round trips and held-out rows."""

import random
import re
from collections import Counter
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tracemill.llm import decontaminate, extract, language, licenses, pieces, quality, store, tokenids, wordpiece
from tracemill.llm.html_blocks import blocks
from tracemill.llm.ship import ship
from tracemill.llm.textkeys import shingle_sets, slices, word_spans

BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n", "a", "  a  b\n\tc ", "Ünï 漢字 🎉🎉 ok\x85x", "▁", "<|endoftext|> x", "x" * 5000, "the the the " * 900]


@pytest.fixture(scope="module")
def odd(spark):
    ship(spark)
    return spark.createDataFrame([(i, t, "l", 1) for i, t in enumerate(ODD)], "doc_id long, text string, license string, part int")


def test_words():
    import pyarrow as pa

    rng = random.Random(1)
    rows = ["".join(rng.choice(" \t\nabÉ") for _ in range(rng.randint(0, 20))) for _ in range(300)] + [None]
    got = []
    for _, _, data, offsets in slices(pa.array(rows), 64):
        starts, ends, first = word_spans(data, offsets)
        got += [[data[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first[:-1], first[1:])]
    assert got == [(t or "").encode().split() for t in rows]


@pytest.mark.parametrize("size", range(1, 6))
@pytest.mark.parametrize("count", range(7))
def test_shingles_of_few_words(size, count):
    words = [f"w{i}" for i in range(count)]
    text = lambda w: np.frombuffer(" ".join(w).encode(), np.uint8)
    one = lambda w: list(shingle_sets(text(w), np.array([0, len(text(w))]), size))[0].tolist()
    got = one(words)
    assert len(got) == (max(1, count - size + 1) if count else 0)
    if count > size:
        assert got == sorted(one(words[i : i + size])[0] for i in range(count - size + 1))
    far = text(words + [f"x{i}" for i in range(9)])
    assert next(shingle_sets(far, np.array([0, len(text(words)), len(far)]), size)).tolist() == got


def test_token_files(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    rng = random.Random(3)
    alphabet = [*" \t\n 　 ab'sZ9!é漢\x85\x1c​᠎🎉", "  ", " a", " the"]
    rows = [(i + 100, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))) for i in range(600)]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    folder = store.shared_dir(spark)
    parts = tokenids.write(df, folder, BPE)
    got, start = {r.doc_id: r for r in tokenids.read(parts, folder).collect()}, 0
    for i, text in [*enumerate(ODD), *rows]:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    folder = store.shared_dir(spark)
    assert tokenids.read(tokenids.write(df.limit(0), folder, BPE), folder).count() == 0


def test_token_files_of_query(spark, tmp_path):
    from tokenizers import Tokenizer

    from tracemill.llm import queries

    t, mark = Tokenizer.from_file(BPE), "<|endoftext|>"
    rng = random.Random(4)
    alphabet = [mark, mark, *" \t\n ab'9!é漢🎉<|>", " the", "<|endof", "text|>", " " + mark + " "]
    rows = list(enumerate([*ODD, f"{mark} x", mark, f"a{mark}{mark}\n b", *("".join(rng.choices(alphabet, k=rng.randint(0, 20))) for _ in range(300))]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    start = 0
    for r in queries.queries()["op3_token_files"](spark, str(tmp_path)).orderBy("doc_id").collect():
        ids = t.encode(rows[r.doc_id][1] or "", add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_token_words_go_to_the_library_once(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(BPE), random.Random(5)
    words = ["".join(rng.choices("anetiorshé", k=9)) + "x" for _ in range(300)]
    texts = [None, "", *("".join(rng.choice(" \n") + rng.choice(words) + rng.choice(["", ".", ",", ";)", "***"]) for _ in range(200)) for _ in range(60))]
    encoder, given, ids, sizes = tokenids.Encoder(BPE, 0, True), [], [], []
    monkeypatch.setattr(encoder, "_ids", lambda x, f=encoder._ids: given.extend(x) or f(x))
    for pieces_, counts in encoder.encode(pa.array(texts)):
        ids += np.concatenate(pieces_).tolist()
        sizes += counts.tolist()
    want = [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]
    assert ids == sum(want, []) and sizes == list(map(len, want))
    assert sum(map(len, given)) < 2.2 * sum(len(w) + 1 for w in words)  # after a blank and after a line feed, whatever marks follow


def test_wordpiece(odd):
    vocabulary = wordpiece.load(BPE)
    counter, known, rng = wordpiece.Counter(vocabulary), set(vocabulary), random.Random(2)

    def greedy(word):
        word, at, n = b" " + word, 0, 0
        while at < len(word):
            end = min(len(word), at + 140)
            while word[at:end] not in known:
                end -= 1
            at, n = end, n + 1
        return n

    for _ in range(3000):
        w = bytes(rng.choice(b"thetionander'sXY\xc3\xa9") for _ in range(rng.randint(1, 25)))
        assert counter.word(w) == greedy(w)
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in wordpiece.count(odd, vocabulary).collect()}
    for i, t in enumerate(ODD):
        words = (t or "").encode().split()
        assert got[i] == (len(words), sum(map(greedy, words)))


def test_pieces(odd):
    model = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    codec, scores = pieces.Encoder(model), {p[0]: p[1] for p in model.pieces if p}

    def best(text):
        top = [0.0]
        for j in range(1, len(text) + 1):
            top.append(max([top[j - 1] + codec.unknown, *(top[i] + scores[text[i:j]] for i in range(max(0, j - 16), j) if text[i:j] in scores)]))
        return top[-1]

    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(" \nabthe漢é🎉'rnio") for _ in range(rng.randint(1, 25)))
        ids = codec.encode(text)
        units = (pieces.MARK + text.replace(" ", pieces.MARK))
        got, at, known = 0.0, 0, {i: p for i, p in enumerate(model.pieces) if p}
        for i in ids.tolist():
            if i in known:
                got, at = got + known[i][1], at + len(known[i][0])
        unknown = len(units) - at
        assert got + unknown * codec.unknown == pytest.approx(best(units), rel=1e-12) and pieces.Decoder(model).decode(ids) == text
    both = pieces.decode(pieces.encode(odd, model), model)
    for r in both.collect():
        assert r.decoded == (r.text or "").replace("▁", " ") and r.license == "l"


def test_myers():
    def distance(p, t):
        before = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            now = [i]
            for j, x in enumerate(t, 1):
                now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != x)))
            before = now
        return min(before)

    rng = random.Random(1)
    for _ in range(500):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(lo, hi))) for lo, hi in ((1, 70), (0, 90)))
        assert decontaminate.myers(p, t)[0] == distance(p, t)


def test_decontamination(spark, odd):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(12)] + [(50, None), (51, " "), (52, "tiny")]
    rows, want = [], set()
    for k in range(60):
        item, text = rng.choice(items[:12])
        edits, chars = rng.choice([0, 2, 6, 40]), list(text)
        for _ in range(edits):
            chars[rng.randrange(len(chars))] = rng.choice("xyz")
        rows.append((1000 + k, " ".join(word() for _ in range(30)) + " " + "".join(chars).upper() + "\n " + word()))
        if edits <= 6:
            want.add((1000 + k, item))
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for chunk in (decontaminate.CHUNK, 400):
        found = decontaminate.find(df, bench, chunk=chunk)
        assert found.count() == df.count()
        got = {(r.doc_id, r.h.item_id) for r in found.select("doc_id", F.explode(decontaminate.HITS).alias("h")).collect()}
        assert got == want
    assert decontaminate.find(df, bench.limit(0)).where(F.size(decontaminate.HITS) > 0).count() == 0


def test_licenses(spark, odd):
    from collections import Counter

    rng, rows = random.Random(2), []
    for k in range(150):
        words = rng.choice(licenses.TEMPLATES)[1].split(" ")
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(["foo", "the", "License"])
        text = " ".join(words)
        rows.append((100 + k, rng.choice([text, f"some prose\n{text}\nmore", text.replace(" ", "\n", 1), text.upper()])))

    def bigrams(text):
        return Counter(licenses.template_bigrams(text))

    want = set()
    for i, t in [*enumerate(ODD), *rows]:
        lines = (t or "").split("\n")
        for no, unit in [*([(0, " ".join(lines))] if len(lines) > 1 else []), *enumerate(lines, 1)]:
            b = bigrams(unit)
            scored = [(2 * sum((b & bigrams(x)).values()) / (sum(b.values()) + sum(bigrams(x).values())), n) for n, x in licenses.TEMPLATES]
            top = min((-s, n) for s, n in scored)
            if -top[0] >= licenses.THRESHOLD:
                want.add((i, no, top[1], round(-top[0], 6)))
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in licenses.scan(df).collect()} == want
    assert licenses.scan(df, []).count() == 0


def test_quality(spark, odd):
    rng, docs, labels = random.Random(3), [], []
    for i in range(400):
        words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(3, 60))]
        good = rng.random() < 0.8
        docs.append((i, " ".join(words) + "." if good else rng.choice([" | ".join(words), "!! ".join(words).upper(), " ".join(words[:1] * 30)])))
        labels.append((i, int(good)))
    df, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(df, marks.where("doc_id % 4 <> 0"))
    got = {r.doc_id: r.quality_score for r in quality.score(df, model).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, y in labels if i % 4 == 0]) > 0.95
    assert all(0 <= r.quality_score <= 1 for r in quality.score(odd, model).collect())
    constant = quality.fit(df, marks.where("quality = 5"))
    assert quality.score(odd, constant).select("quality_score").distinct().count() == 1


def test_language(spark, odd):
    rng, parts = random.Random(4), {"xx": ["tion", "ent", "qu", "oi"], "yy": ["sch", "ung", "ei", "ich"], "zz": ["ción", "ado", "os", "el"]}
    docs = [(i, " ".join("".join(rng.choices(parts[k], k=3)) for _ in range(rng.randint(3, 50))), k) for i in range(300) for k in [rng.choice(list(parts))]]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language.fit(df.where("doc_id % 4 <> 2"))
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert np.mean([got[i].lang_pred == k for i, _, k in docs if i % 4 == 2]) > 0.97
    assert not any(got[i].lang_rejected for i, _, _ in docs)
    for r in language.identify(odd, model).collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred != "und") == letters and 0 <= r.lang_score <= 1
    none = language.fit(df.where("lang is null"))
    assert {r.lang_pred for r in language.identify(odd, none).collect()} == {"und"}


def test_language_rejects_any_length(spark):
    rng = random.Random(5)
    parts = {"xx": ["tion", "ent", "qu", "oi"], "yy": ["sch", "ung", "ei", "ich"], "zz": ["ков", "ест", "ый", "про"], "ww": ["ładz", "źdźb", "wyży", "kó"]}
    text = lambda k, n: " ".join("".join(rng.choices(parts[k], k=3)) for _ in range(n))
    learnt = [(text(k, rng.randint(3, 60)), k) for k in ("xx", "yy") for _ in range(150)]
    # Rows so unlike the others that they are centroids of their own, long and short ones.
    learnt += [(f"{w} " * n, k) for k in ("xx", "yy") for w, n in (("mmm", 3), ("mf", 900))]
    model = language.fit(spark.createDataFrame([(i, *r) for i, r in enumerate(learnt)], "doc_id long, text string, lang string"))
    lengths = [2, 5, 12, 25, 60, 400]
    rows = [(i, text(k, n), k) for i, (k, n) in enumerate((k, n) for k in parts for n in lengths for _ in range(4))]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()
    assert {(r.lang, r.lang_rejected) for r in got} == {("xx", False), ("yy", False), ("zz", True), ("ww", True)}


def test_blocks():
    page = """<!DOCTYPE html><head><title>no</title></head><body><!-- no > --><p title="a>b">One &amp; &lt;two&nbsp;
      <b>bold<br>line<p>Next<script>if (a < b) "</p>"</script> more</p><ul><li>x<li>y</ul><div class='Side-Bar x' id=q>z</div>t<style>p{}</style>&am"""
    got = blocks(page)
    assert [b.text for b in got] == ["One & <two bold line", "Next more", "x", "y", "z", "t&am"]
    assert got[4].path.parts()[-1] == ("div", ("side", "bar", "x", "q"))
    assert [b.text for b in blocks("a < b <p>c <div cla")] == ["a < b", "c"]
    assert blocks(None) == [] == blocks("")


@pytest.mark.parametrize("tag", ["noscript", "template", "svg", "object"])
def test_blocks_without_end_tags(tag):
    text = lambda page: [b.text for b in blocks(page)]
    head = "<html><head><meta charset=utf-8><title>t</title><script>x</script><style>p{}</style>"
    for page in (f"{head}<body><article><p>One<p>Two</article>", f"{head}<p>One<p>Two", "<html><head>One<p>Two"):
        assert text(page) == ["One", "Two"] and not any(t == "head" for b in blocks(page) for t, _ in (b.path.parts() if b.path else []))
    assert text(f"{head}<{tag}></head><body><p>One<p>Two") == ["One", "Two"]
    assert text(f"<p>One<{tag} class='a>b'><p>Two") == ["One", "Two"]
    assert text(f"<p>One<{tag}><p>Two<{tag}>no</{tag}><p>Three<{tag}") == ["One", "Two", "Three"]
    assert text(f"<p>One<{tag}>no<{tag}>no</{tag}>no</{tag}> more") == ["One more"]
    assert text(f"<p>One<{tag}>no<!-- <{tag}> --><script>'<{tag}>'</script></{tag}> more") == ["One more"]
    assert text(f"<p>One<!-- </{tag}> --><{tag}/>Two") == ["OneTwo"]


def test_extraction(spark):
    ship(spark)
    weights = extract.train()
    rng = random.Random(99)
    wrong = total = 0
    pages = [extract.sample_page(rng) for _ in range(200)]
    for (_, want), got in zip(pages, extract.label([p for p, _ in pages], weights)):
        wrong, total = wrong + int((got != np.array(want, bool)).sum()), total + len(want)
    assert wrong / total < 0.02
    html = (
        "<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>About</a></li></ul></nav><div class=ad>Buy now</div><article><h1>Title here</h1><p>First paragraph of the text.</p>"
        "<p>Re.</p><p>Third one, longer than the others by some words.</p></article><section class=comments><p>Nice post!</p></section><footer>&copy; me</footer></body></html>"
    )
    df = spark.createDataFrame([(1, "u", html, "x"), (2, "u", None, "x"), (3, None, "", "x"), (4, "u", "<nav><a>x</a></nav>", "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in extract.extract(df).collect()}
    assert got[1].text == "Title here\nFirst paragraph of the text.\nRe.\nThird one, longer than the others by some words." and got[1].n_chars == len(got[1].text)
    assert [got[k].text for k in (2, 3, 4)] == ["", "", ""]


def test_deep_pages():
    """Tags that are never closed: paths share their parts, so a page of a megabyte takes seconds."""
    import time

    began = time.time()
    got = blocks("<div>x " * 100_000)
    extract.features(got[:5000])
    assert len(got) == 100_000 and got[-1].path.depth == 100_000 and time.time() - began < 30
    assert [b.text for b in blocks("<b>" * 20_000 + "<p>a</span></i>" * 20_000)][:1] == ["a"]


def test_decontaminate_chunks(spark):
    """A benchmark of many chunks gives the hits that one chunk gives, rows repeated and clashing columns included."""
    rng = random.Random(6)
    words = [f"w{rng.randrange(300)}" for _ in range(3000)]
    items = [(i, " ".join(words[i * 20 : i * 20 + 12])) for i in range(60)] + [(60, None), (61, " "), (62, "w1")]
    docs = [(i, " ".join(words[s : s + 60]), "own") for i, s in enumerate(rng.choices(range(1400), k=40))] + [(0, None, "own"), (1, "", "own"), (1, "", "own")]
    bench, rows = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string, bench_hits string")
    plain = lambda df: sorted((r.doc_id, r.text or "", [tuple(h) for h in r.bench_hits]) for r in df.collect())
    one = plain(decontaminate.find(rows, bench))
    assert one == plain(decontaminate.find(rows, bench, chunk=900)) and any(h for _, _, h in one) and len(one) == len(docs)
    assert decontaminate.find(rows.limit(0), bench, chunk=900).count() == 0 and not any(h for _, _, h in plain(decontaminate.find(rows, bench.limit(0))))


def _license_texts():
    rng = random.Random(8)
    word = lambda: rng.choice("license the of rights alpha beta gamma delta permission software copies".split())
    rows = [None, "", " ", "MIT", "released under", "All rights reserved. " * 300, "released under the mit license"]
    for n in range(150):
        parts = []
        for _ in range(rng.randint(0, 3)):
            parts += [word() for _ in range(rng.randint(0, 60))]
            _, notice = rng.choice(licenses.TEMPLATES + licenses.BODIES)
            w = notice.split()
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [word()], [w[at], word()]])
            parts += w[rng.choice([0, 0, 1, 3]) :] if not parts else w
        parts += [word() for _ in range(rng.randint(0, 30))]
        rows.append("".join(p + rng.choice([" ", " ", "\n * ", "  "]) for p in parts))
    return rows


def test_license_spans(spark, tmp_path):
    """Against brute force over every window, and the query against its SQL, on notices with edits, cut off, within lines and over many."""
    import duckdb

    from tracemill.llm import queries

    rows = _license_texts()
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(rows)], "doc_id long, text string, license string, word_no int, k int")
    got = {(r.doc_id, r.word_no, r.n_words, r.license, r.dice) for r in licenses.spans(docs).collect()}
    want, templates = set(), licenses.TEMPLATES + licenses.BODIES
    places = licenses.anchors(templates, 0.8)
    for i, text in enumerate(rows):
        g = licenses.template_bigrams(text or "")
        for k, (name, t) in enumerate(templates):
            t = licenses.template_bigrams(t)
            starts = sorted({a - q for a, b in enumerate(g) for kk, q, c in places if kk == k and b == c})
            found = []
            for s in starts:
                window = g[max(0, s) : s + len(t)]
                d = 2.0 * sum((Counter(window) & Counter(t)).values()) / (len(window) + len(t))
                if d >= 0.8:
                    found.append((-d, s))
            given = []
            for d, s in sorted(found):
                if all(abs(s - x) > len(t) for x in given):
                    given.append(s)
                    want.add((i, s + 1, len(t) + 1, name, round(-d, 6)))
    assert got == want and len(want) > 100
    assert licenses.spans(docs.unionByName(docs)).count() == 2 * len(want)
    assert licenses.spans(docs.limit(0)).count() == 0 and licenses.spans(docs, []).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    q = queries.queries()["op2_license_scan"](spark, str(tmp_path))
    sql = c.execute(queries.oracle_sql()["op2_license_scan"]).fetchdf()[q.columns]
    assert sorted(map(tuple, q.collect())) == sorted(sql.itertuples(index=False, name=None))


def test_license_spans_find_planted(spark):
    """A header of many lines within a file, and a notice within a line, at their places."""
    head = licenses.BODIES[0][1].split(" ")
    lines = "\n".join("# " + " ".join(head[i : i + 9]) for i in range(0, len(head), 9))
    text = f"import os\n{lines}\nprint(1)\nThis file is Released under the MIT License. See LICENSE for more.\n" + "def f(x): return x\n" * 4000
    rows = spark.createDataFrame([(7, text)], "doc_id long, text string")
    got = [tuple(r)[1:] for r in licenses.spans(rows).orderBy("word_no").collect()]
    long = len(licenses.template_words(licenses.BODIES[0][1]))
    assert got == [(3, long, "MIT", 1.0), (3 + long + 5, 5, "MIT", 1.0)]


def test_license_spans_that_follow_each_other(spark, tmp_path):
    """Copies of one template back to back, or with other words between, are each given, in the query's SQL too."""
    import duckdb

    from tracemill.llm import queries

    body = licenses.BODIES[0][1]
    own = lambda name: f"Copyright (c) 2001 {name} {body}"
    n = len(licenses.template_words(body))
    texts = [f"{own('Ann')} {own('Ben')}", " ".join([body] * 40), f"{own('Ann')} {'other words ' * 100} {own('Ben')}", f"{body} {body[: len(body) // 2]}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.word_no) for r in licenses.spans(docs).collect() if r.license == licenses.BODIES[0][0] and r.n_words == n)
    lead = len(licenses.template_words("Copyright (c) 2001 Ann"))
    want = [(0, lead + 1), (0, 2 * lead + n + 1), *((1, k * n + 1) for k in range(40)), (2, lead + 1), (2, 2 * lead + n + 201), (3, 1)]
    assert got == want
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    q = queries.queries()["op2_license_scan"](spark, str(tmp_path))
    sql = c.execute(queries.oracle_sql()["op2_license_scan"]).fetchdf()[q.columns]
    assert sorted(map(tuple, q.collect())) == sorted(sql.itertuples(index=False, name=None))


def test_language_against_dictionaries(spark):
    """Predictions and scores as a plain TF-IDF over dictionaries of the same buckets gives them, with the fitted centroids."""
    ship(spark)
    rng = random.Random(4)
    parts = {"xx": ["tha", "ing", "wor", "lde"], "yy": ["sch", "ung", "ein", "kei"], "zz": ["ción", "que", "los", "ado"]}
    rows = [(i, " ".join("".join(rng.choices(parts[lang], k=2)) for _ in range(rng.choice([1, 4, 30, 200]))), lang) for i in range(240) for lang in [rng.choice(list(parts))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df)
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    for i, text, _ in rows:
        data = text.encode()
        counts = Counter(next(language.grams(np.frombuffer(data, np.uint8), np.array([0, len(data)]))).tolist())
        vector = {b: (1 + np.log(n)) * model.idf[b] for b, n in counts.items()}
        norm = np.sqrt(sum(v * v for v in vector.values()))
        cosines = [sum(v * float(c[b]) for b, v in vector.items()) / norm for c in model.centroids]
        best = int(np.argmax(cosines))
        assert abs(got[i].lang_score - min(max(cosines[best], 0), 1)) < 1e-5
        assert got[i].lang_pred == model.lang[best] or max(c for k, c in enumerate(cosines) if model.lang[k] == got[i].lang_pred) > cosines[best] - 1e-6


def test_fits_are_bounded_in_buckets(spark):
    """Of the drawn rows those first by hash count that have so many buckets together, on any partitions."""
    ship(spark)
    rows = [(i, f"words {i} of {'this good' if i % 2 else 'that bad'} text", i % 2, "xx" if i % 2 else "yy") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, lang string")
    whole, few = quality.fit(df, df), quality.fit(df, df, max_buckets=100)
    again = quality.fit(df.repartition(7), df.repartition(3), max_buckets=100)
    assert (whole.weights != few.weights).any() and (few.weights == again.weights).all()
    assert (language.fit(df).idf != language.fit(df, max_buckets=300).idf).any()
    table = store.written(spark.createDataFrame([(5, 4), (2, 3), (9, 1)], "place long, n long"), store.shared_dir(spark), "sizes")
    for most, want in ((2, [2]), (3, [2]), (6, [2]), (7, [2, 5]), (100, [2, 5, 9])):
        rows, order = store.bounded(table, "place", F.col("n"), most)
        assert [rows.column("place").to_pylist()[i] for i in order] == want


def test_long_pages_in_pieces():
    """The recurrence over pieces gives what it gives over the whole page and what a loop over single blocks gives; memory follows the piece."""
    import tracemalloc

    page = blocks("".join(f"<div class='{'content' if i % 3 else 'menu'}'><p>block {i} of this page</p></div>" for i in range(400)))
    w = extract.train(20, 1)
    x, _, back = extract._padded([extract.features(page)])
    whole = extract.logits(x, back, w)[0]
    assert np.allclose(whole, extract.long_logits(page, w, 37), atol=1e-4)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    loop = x[0] @ w["S"] + w["v"]
    for d, order in (("f", range(len(page))), ("r", reversed(range(len(page))))):
        h = c = np.zeros(extract.UNITS)
        for t in order:
            z = np.split(x[0, t] @ w[f"W{d}"] + w[f"b{d}"] + h @ w[f"U{d}"], 4)
            c = sigmoid(z[1]) * c + sigmoid(z[0]) * np.tanh(z[3])
            h = sigmoid(z[2]) * np.tanh(c)
            loop[t] += h @ w[f"V{d}"]
    assert np.allclose(whole, loop, atol=1e-3)
    many = blocks("<p>a</p>" * 30_000)
    tracemalloc.start()
    assert len(extract.long_logits(many, w, 2000)) == 30_000
    assert tracemalloc.get_traced_memory()[1] < 30_000_000
    tracemalloc.stop()


def test_naive_blocks_of_tag_soup():
    """Random soup of simple tags against a plain scan that splits at every tag that isn't inside a line."""
    rng = random.Random(8)
    inside, outside = ["b", "i", "span", "a"], ["div", "p", "li", "h2", "section"]
    for _ in range(300):
        page = "".join(rng.choice([f"<{t}>", f"</{t}>", " word ", "x", "&amp;", "\n"]) for t in rng.choices(inside + outside, k=rng.randint(0, 40)))
        want = []
        for part in re.split("|".join(f"</?{t}>" for t in outside), page):
            text = " ".join(re.sub("</?[a-z0-9]+>", "", part).replace("&amp;", "&").split())
            want += [text] if text else []
        assert [b.text for b in blocks(page)] == want


def test_indicators_depend_on_their_own_text_only():
    import pyarrow as pa

    rng = random.Random(3)
    texts = [" ".join(rng.choices(["a", "bb", "C!", "the", "x9"], k=rng.randint(0, 6))) for _ in range(200)]
    of = lambda rows: [i.tolist() for _, _, data, offsets in slices(pa.array(rows)) for i in quality.indicators(data, offsets)]
    assert of(texts) == [of([t])[0] for t in texts]


def test_fits_hold_their_rows_once():
    """What a fit takes on the driver beyond its rows is less than those rows, dense or scaled, would take together."""
    import tracemalloc

    rng = np.random.default_rng(6)
    draw = lambda n, size: [np.unique(rng.integers(0, size, 1500)).astype(np.uint16) for _ in range(n)]
    rows, label = draw(1000, 1 << quality.BITS), np.arange(1000) % 2
    texts = draw(400, 1 << language.BITS)
    counts = [np.ones(len(x), np.uint8) for x in texts]
    scaled, dense = 4 * sum(map(len, rows)), 4 * len(texts) << language.BITS
    for fit, most in ((lambda: quality.fit_rows(rows, label), scaled), (lambda: language.fit_rows(texts, counts, ["xx"] * len(texts)), dense // 2)):
        tracemalloc.start()
        fit()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most
    # Counts of any width are whole numbers all the same.
    wide = language.fit_rows([x.astype(np.int32) for x in texts], [x.astype(np.int32) for x in counts], ["xx"] * len(texts))
    narrow = language.fit_rows(texts, counts, ["xx"] * len(texts))
    assert (wide.centroids == narrow.centroids).all() and (wide.least == narrow.least).all()


def test_rows_come_to_the_driver_in_slices(spark):
    """Slices in order of their places hold all rows once, whatever their size; rows of one place stay together."""
    rows = [(k * 7919 % 101 - 50, k % 5) for k in range(101)] + [(3, 4), (3, 0)]
    table = store.written(spark.createDataFrame(rows, "place long, n long").repartition(5), store.shared_dir(spark), "sliced")
    for each in (1, 7, 40, 10_000):
        got = [x.to_pydict() for x in store.slices(table, "place", F.col("n"), 10_000, each)]
        places = [x["place"] for x in got]
        assert sum(places, []) == sorted(p for p, _ in rows) and sorted(zip(sum(places, []), sum((x["n"] for x in got), []), strict=True)) == sorted(rows)
        assert all(sum(x["n"]) < each + 12 for x in got) and (len(got) > 1) == (each < 1000)
    assert [x.num_rows for x in store.slices(table.where("n > 9"), "place", F.col("n"), 10)] == [0]
