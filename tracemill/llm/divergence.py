"""How far the sources of a language lie from each other and from the whole, by their terms, in exact integers.

Terms are counted in DuckDB: each task cuts its texts and counts by (lang, source, term) and by document, and sends
the counts on, hashed by lang and term to a shard. A shard reads its counts in the order of lang and term, so that
it holds but a few terms at a time, and runs SQL over them: sums, the terms that are in enough documents and, once
the sizes of all groups are known, the part of each pair's sum that its terms make and each group's best terms.
Spark merges sizes, sums and rankings.

Most terms are in few sources. With z the p of a term that a group doesn't have, V the terms of the language and
f(p, q) the divergence, the sum of a pair (s, r) over all V terms is

    V f(z_s, z_r) + sum over s's terms of [f(p_s, z_r) - f(z_s, z_r)] + the same with s and r exchanged
    + sum over the terms of both of [f(p_s, p_r) - f(p_s, z_r) - f(z_s, p_r) + f(z_s, z_r)]

so terms are paired only with sources that have them; the sums in the middle are taken by distinct count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store
from .resident import release
from .textkeys import letters_of, slices

#: Documents of a language that a kept term is in at least, and terms listed for each group.
MIN_DOCS, TOP = 10, 10
#: Counts that a task holds before it sends them on, rows of a shard that one query takes, groups that are sent to the tasks at a time, bytes of a piece of a long text.
HELD, AT_ONCE, GROUPS, PIECE = 400_000, 100_000, 200_000, 1 << 20
_LETTERS = letters_of().tobytes()
_SUMS = "SELECT lang, term, source, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM counts GROUP BY ALL"
_F = "(({0} - {1}) * ({0} - {1}) // ({0} + {1}))"


def _database():
    import duckdb

    return duckdb.connect(":memory:", config={"threads": "1", "memory_limit": "600MB", "temp_directory": ""})


def _run(db, sql: str) -> list:
    """Runs a statement to its end."""
    return db.execute(sql).fetchall()


def _batches(table: pa.Table) -> Iterator[pa.RecordBatch]:
    return iter(table.combine_chunks().to_batches(max_chunksize=20_000))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a task -> lang, term, source, n (occurrences), docs (documents with it)."""
    release()
    db = _database()
    _run(db, "CREATE TABLE counts (lang VARCHAR, term VARCHAR, source VARCHAR, n BIGINT, docs BIGINT)")
    for batch in batches:
        for a, _, data, offsets in slices(batch.column(0), 1 << 23):
            db.register("texts", _texts(batch, a, data.tobytes().translate(_LETTERS), offsets))
            _run(db, """INSERT INTO counts SELECT lang, term, source, sum(n), count(*) FROM (
                SELECT i, lang, source, term, count(*) AS n FROM (SELECT i, lang, source, unnest(string_split(text, ' ')) AS term FROM texts) WHERE term <> '' GROUP BY ALL
            ) GROUP BY ALL""")
            db.unregister("texts")
            if _run(db, "SELECT count(*) FROM counts")[0][0] > HELD:
                yield from _batches(db.sql(_SUMS).to_arrow_table())
                _run(db, "TRUNCATE counts")
    yield from _batches(db.sql(_SUMS).to_arrow_table())
    db.close()


def _texts(batch: pa.RecordBatch, first: int, data: bytes, offsets: np.ndarray) -> pa.Table:
    """Rows i, lang, source, text of a slice; a text longer than a slice comes in pieces that end at blanks."""
    marks, rows = offsets.tolist(), list(range(first, first + len(offsets) - 1))
    if len(rows) == 1 and len(data) > PIECE:
        marks = [0]
        while 0 <= marks[-1] < len(data):
            marks.append(data.find(b" ", marks[-1] + PIECE))
        marks, rows = [*marks[:-1], len(data)], rows * (len(marks) - 1)
    text = pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(np.array(marks, np.int64).tobytes()), pa.py_buffer(data))
    names = [batch.column(i).take(pa.array(rows)) for i in (1, 2)]
    table = pa.table([pa.array(rows), *names, text], ["i", "lang", "source", "text"])
    return pa.Table.from_batches(table.to_batches(max_chunksize=1)) if len(rows) > 1 and rows[0] == rows[-1] else table


def _by_term(batches: Iterator[pa.RecordBatch], summed: Callable[[pa.Table], pa.Table]) -> Iterator[pa.Table]:
    """Rows in the order of lang and term, about AT_ONCE at a time, those of a term never apart; summed makes one term's rows fewer."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= AT_ONCE:
            rows = pa.Table.from_batches(held)
            lang, term = (rows.column(c).combine_chunks() for c in ("lang", "term"))
            last, cut = (lang[n - 1].as_py(), term[n - 1].as_py()), n
            step = 1
            while cut and (lang[max(0, cut - step)].as_py(), term[max(0, cut - step)].as_py()) == last:
                cut, step = max(0, cut - step), step * 2
            while cut and (lang[cut - 1].as_py(), term[cut - 1].as_py()) == last:
                cut -= 1
            if cut:
                yield rows.slice(0, cut)
            rows = rows.slice(cut)
            rows = rows if cut else summed(rows)
            held, n = rows.to_batches(), rows.num_rows
    if n:
        yield pa.Table.from_batches(held)


def _kept(min_docs: int):
    """Sorted counts of a shard -> the terms in min_docs documents or more, each with its sources and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        db = _database()

        def summed(rows: pa.Table) -> pa.Table:
            db.register("counts", rows)
            return db.sql(_SUMS).to_arrow_table()

        for rows in _by_term(batches, summed):
            db.register("counts", rows)
            yield from _batches(db.sql(f"""SELECT lang, term, list(source ORDER BY source) AS sources, list(n ORDER BY source) AS counts FROM ({_SUMS}) GROUP BY ALL HAVING sum(docs) >= {min_docs}""").to_arrow_table())
        db.close()

    return run


def _summed(groups, top: int):
    """Kept terms of a shard -> partial sums of pairs a < b (kind pair) and each group's best terms (kind term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        db = _database()
        db.register("sent", groups.value)
        _run(db, """CREATE TABLE groups AS SELECT lang, source, n + 2 * v AS d, (1 + 2000000000 // (n + 2 * v))::BIGINT AS z, all_n + 2 * v AS all_d FROM sent WHERE v > 0""")
        _run(db, "CREATE TABLE sums (lang VARCHAR, a VARCHAR, b VARCHAR, value HUGEINT)")
        _run(db, "CREATE TABLE times (lang VARCHAR, source VARCHAR, p BIGINT, z BIGINT, m BIGINT)")
        _run(db, "CREATE TABLE best (lang VARCHAR, source VARCHAR, term VARCHAR, value BIGINT)")
        for batch in batches:
            db.register("kept", pa.Table.from_batches([batch]))
            _run(db, """CREATE OR REPLACE TABLE p AS SELECT lang, term, source, (1 + 1000000000::HUGEINT * (n + 2) // d)::BIGINT AS p, z, (1 + 1000000000::HUGEINT * (every + 2) // all_d)::BIGINT AS q
                FROM (SELECT lang, term, list_sum(counts) AS every, unnest(sources) AS source, unnest(counts) AS n FROM kept) JOIN groups USING (lang, source)""")
            db.unregister("kept")
            _run(db, f"""INSERT INTO sums SELECT a.lang, a.source, b.source, sum({_F.format("a.p", "b.p")} - {_F.format("a.p", "b.z")} - {_F.format("a.z", "b.p")} + {_F.format("a.z", "b.z")})
                FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL""")
            _run(db, "INSERT INTO times SELECT lang, source, p, z, count(*) FROM p GROUP BY ALL")
            _run(db, f"INSERT INTO best SELECT lang, source, term, {_F.format('p', 'q')} AS f FROM p WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY f DESC, term) <= {top}")
            if _run(db, "SELECT (SELECT count(*) FROM sums) + (SELECT count(*) FROM times) + (SELECT count(*) FROM best)")[0][0] > HELD:
                _run(db, "CREATE OR REPLACE TABLE sums AS SELECT lang, a, b, sum(value)::HUGEINT AS value FROM sums GROUP BY ALL")
                _run(db, "CREATE OR REPLACE TABLE times AS SELECT lang, source, p, z, sum(m)::BIGINT AS m FROM times GROUP BY ALL")
                _run(db, f"CREATE OR REPLACE TABLE best AS SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {top}")
        _run(db, f"""INSERT INTO sums SELECT t.lang, least(t.source, r.source), greatest(t.source, r.source), sum(t.m * ({_F.format("t.p", "r.z")} - {_F.format("t.z", "r.z")}))
            FROM (SELECT lang, source, p, z, sum(m)::BIGINT AS m FROM times GROUP BY ALL) t JOIN groups r ON r.lang = t.lang AND r.source <> t.source GROUP BY ALL""")
        yield from _batches(db.sql(f"""SELECT 'pair' AS part, lang, a AS source, b AS item, sum(value)::BIGINT AS value FROM sums GROUP BY ALL
            UNION ALL SELECT 'term', lang, source, term, value FROM best QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {top}""").to_arrow_table())
        db.close()

    return run


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, groups_at_once: int = GROUPS) -> DataFrame:
    """How the sources of each language differ: lang, source, part, item, value (long), rank (int, from 1).

    docs: text, lang, source; more columns are ignored. Nulls count as ''; each row is a document, repeated rows too.
    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased. A language keeps its V terms that
    are in min_docs of its documents or more; a group (lang, source) or a language with N occurrences of them has for
    a term with n the number p = 1 + floor(1e9 (n + 2) / (N + 2 V)), and f(p, q) = floor((p - q)^2 / (p + q)).
    Part pair: each other source of the language, value the sum of f over the V terms (0 if there are none).
    Part term: the terms of the group with p above the language's own q, value f, the first `top` of them.
    Ranks go by value descending, then item ascending by its UTF-8 bytes. An empty table gives no rows. The sizes of
    groups are sent to the tasks, at most groups_at_once at a time unless one language alone has more.
    """
    spark, folder = docs.sparkSession, store.shared_dir(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counts = rows.mapInArrow(_counted, "lang string, term string, source string, n long, docs long")
    kept = store.written(
        counts.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_kept(min_docs), "lang string, term string, sources array<string>, counts array<long>"),
        folder, "kept",
    )
    by_group = kept.select("lang", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("n")))).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = by_group.groupBy("lang").agg(F.sum("n").alias("all_n")).join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang")
    sized = rows.groupBy("lang", "source").agg(F.lit(0).cast("long").alias("none")).drop("none").join(by_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = store.written(sized.fillna(0, ["n", "all_n", "v"]), folder, "groups")
    parts = -(-groups.count() // groups_at_once) or 1
    share = lambda df, k: df.where(F.pmod(F.xxhash64("lang"), F.lit(parts)) == k)
    sums = []
    for k in range(parts):
        held = spark.sparkContext.broadcast(share(groups, k).toArrow())
        found = share(kept, k).mapInArrow(_summed(held, top), "part string, lang string, source string, item string, value long")
        sums.append(store.written(found, folder, f"sums{k}"))
        held.unpersist()
    found = sums[0]
    for more in sums[1:]:
        found = found.unionByName(more)
    terms = found.where("part = 'term'")
    # All pairs of a language's sources are part of the result; blocks of them are joined, so that no task makes a language's all.
    z = F.expr("1 + 2000000000 div (n + 2 * v)")
    side = groups.select("lang", "source", "v", F.when(F.col("v") > 0, z).alias("z"))
    blocks = side.groupBy("lang").agg((F.floor(F.count("*") / 1000) + 1).cast("int").alias("blocks"))
    side = side.join(blocks, "lang")
    one = side.select("lang", F.pmod(F.xxhash64("source"), "blocks").cast("int").alias("block"), "source", "v", "z")
    other = side.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("source").alias("item"), F.col("z").alias("y"))
    f = F.coalesce(F.col("v") * F.expr("(z - y) * (z - y) div (z + y)"), F.lit(0))
    base = one.join(other, ["lang", "block"]).where("source <> item").select("lang", "source", "item", f.alias("value"))
    half = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = half.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("e"), "value").select("lang", "e.*", "value")
    pairs = base.unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order))
    best = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionByName(best).select("lang", "source", "part", "item", "value", "rank")
