"""Quotas, samples, orders and de-duplication over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling
from .registry import query, table

C = F.col


def _share(sizes: str, target: str, tie: str = "size DESC, ") -> str:
    """SQL for largest-remainder quotas over a relation of (lang, size)."""
    return f"""SELECT lang, size, (f + CASE WHEN row_number() OVER (ORDER BY rem DESC, {tie}lang DESC) <= goal - sum(f) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM (
      SELECT lang, size, goal, (size::HUGEINT * goal) // total AS f, (size::HUGEINT * goal) % total AS rem FROM (
        SELECT lang, size, sum(size) OVER () AS total, ({target})::BIGINT AS goal FROM {sizes}))"""


_SIZES = "s AS (SELECT lang, count(*) AS size FROM documents GROUP BY 1)"


def _drawn(seed: str) -> str:
    return f"SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('{seed}:' || doc_id::VARCHAR), doc_id) AS draw FROM documents"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang")


@query(f"WITH {_SIZES} {_share('s', '150')}")
def largest_remainder(spark, d):
    """Quotas of the strata."""
    return sampling.quotas(sampling.sizes_of(_docs(spark, d), "lang"), "lang", "size", 150)


@query(f"WITH {_SIZES} {_share('s', '150', '')}")
def largest_remainder_by_name(spark, d):
    """Quotas with ties by name alone."""
    return sampling.quotas(sampling.sizes_of(_docs(spark, d), "lang"), "lang", "size", 150, tie_by_size=False)


@query(f"WITH {_SIZES}, q AS ({_share('s', '150')}), r AS ({_drawn('7')}) SELECT doc_id, lang FROM r JOIN q USING (lang) WHERE draw <= quota")
def stratified_sample(spark, d):
    """A stratified sample in hash order."""
    return sampling.stratified(_docs(spark, d), "lang", "doc_id", 150, 7)


@query(f"""WITH {_SIZES}, q1 AS ({_share('s', 'round_even(sum(size) OVER () * 0.8, 0)')}),
s2 AS (SELECT lang, size - quota AS size FROM q1), q2 AS ({_share('s2', '(SELECT round_even(count(*) * 0.1, 0) FROM documents)')}),
r AS ({_drawn('11')}) SELECT doc_id, lang, CASE WHEN draw <= q1.quota THEN 'train' WHEN draw <= q1.quota + q2.quota THEN 'eval' ELSE 'test' END AS split
FROM r JOIN q1 USING (lang) JOIN q2 USING (lang)""")
def stratified_split(spark, d):
    """Train, eval and test, the second quotas on what the first leave."""
    return sampling.split(_docs(spark, d), "lang", "doc_id", 0.8, 0.1, 11)


@query(f"""WITH {_SIZES}, q1 AS ({_share('s', '50')}), q2 AS ({_share('s', '100')}), q3 AS ({_share('s', '150')}), r AS ({_drawn('5')})
SELECT doc_id, lang, CASE WHEN draw <= q1.quota THEN 50 WHEN draw <= q2.quota THEN 100 ELSE 150 END AS arm
FROM r JOIN q1 USING (lang) JOIN q2 USING (lang) JOIN q3 USING (lang) WHERE draw <= q3.quota""")
def nested_sample(spark, d):
    """Growing samples that hold one another."""
    return sampling.nested(_docs(spark, d), "lang", "doc_id", [50, 100, 150], 5)


@query(f"""WITH a AS (SELECT doc_id, 'length' AS domain FROM ({_drawn('3:length')}) WHERE lang = 'en' AND draw <= 40),
l AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a)), s AS (SELECT lang, count(*) AS size FROM l GROUP BY 1), q AS ({_share('s', '60')}),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('3:negative:' || doc_id::VARCHAR), doc_id) AS draw FROM l)
SELECT * FROM a UNION ALL SELECT doc_id, 'negative' FROM r JOIN q USING (lang) WHERE draw <= quota""")
def disjoint_draws(spark, d):
    """One draw after another from what is left, the first from one stratum only."""
    return sampling.disjoint(_docs(spark, d), "lang", "doc_id", [("length", 40, "en"), ("negative", 60, None)], 3)


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents)
SELECT doc_id, lang FROM r ORDER BY CASE WHEN i <= CASE lang WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 0 END THEN 0 ELSE 1 END, doc_id LIMIT 12""")
def smoke_slice(spark, d):
    """The first rows of named strata, filled up in order."""
    return sampling.top_with_fill(_docs(spark, d), "lang", "doc_id", {"de": 2, "fr": 2}, 12)


@query("SELECT doc_id, lang FROM documents ORDER BY sha256('20:' || doc_id::VARCHAR), doc_id LIMIT 20")
def simple_sample(spark, d):
    """A seeded simple random sample."""
    return sampling.simple_sample(_docs(spark, d), "doc_id", 20, 20)


@query("""SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS number,
  'row_' || lpad((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1)::VARCHAR, 6, '0') AS label FROM events""")
def renumbered(spark, d):
    """Sequential numbers and padded labels in order."""
    return sampling.numbered(table(spark, d, "events").select("event_type", "event_id"), ["event_id"], ["event_type"], prefix="row_")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1")
def last_wins(spark, d):
    """The last row of each key."""
    return sampling.last_wins(table(spark, d, "events").select("user_id", "event_type", "value", "event_id"), ["user_id"], "event_id")


@query("SELECT text, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY 1")
def first_wins(spark, d):
    """The first row of each text."""
    return sampling.first_wins(table(spark, d, "documents").select("text", "doc_id", "lang"), ["text"], "doc_id")


@query("SELECT doc_id, lang, n_chars, (row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1) // 16 AS batch FROM documents")
def length_batches(spark, d):
    """Rows of like length in batches."""
    return sampling.batches(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "n_chars", "doc_id", 16, ["lang"])


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def longest_rows(spark, d):
    """O1 O2 O3: ordered, with ties by id, and cut."""
    return table(spark, d, "documents").select("doc_id", "lang", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(25)
