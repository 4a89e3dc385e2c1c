"""Joins, replacements and set checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, transcripts
from ..operators import mixing, sampling
from ..sources import readers
from ..streaming.run import scratch
from .registry import query, table

C = F.col


@query("SELECT doc_id, lang, n_chars, quality FROM labels JOIN documents USING (doc_id)")
def lookup_join(spark, d):
    """Rows with those of a table of unique keys, a missing key being an error."""
    return mixing.lookup(table(spark, d, "labels").select("doc_id", "quality"), table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id").select(
        "doc_id", "lang", "n_chars", "quality")


@query("""SELECT doc_id, CASE WHEN p.page_id IS NOT NULL THEN p.url ELSE d.source END AS source, CASE WHEN p.page_id IS NOT NULL THEN NULL ELSE d.lang END AS lang
FROM documents d LEFT JOIN pages p ON d.doc_id = p.page_id""")
def replace_merge(spark, d):
    """Whole rows replaced by key; a null of the replacement wins."""
    new = table(spark, d, "pages").select(C("page_id").alias("doc_id"), C("url").alias("source"), F.lit(None).cast("string").alias("lang"))
    return mixing.replace_rows(table(spark, d, "documents").select("doc_id", "source", "lang"), new, "doc_id")


@query("SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def semi_join(spark, d):
    """Rows whose id is listed."""
    return mixing.only(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


@query("""WITH f AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f)""")
def repeated_rows(spark, d):
    """Rows beyond the first of their text, by an anti join."""
    docs = table(spark, d, "documents")
    first = docs.groupBy(hashing.identity(C("text")).alias("text")).agg(F.min("doc_id").alias("doc_id"))
    return mixing.without(docs.select("doc_id"), first, "doc_id")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join(spark, d):
    """Rows whose id isn't listed."""
    return mixing.without(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SELECT event_id, (user_id % 5) * (event_id % 3) + (user_id % 7) * 2 AS dot FROM events")
def positional_zip(spark, d):
    """Lists joined by position, equal lengths required."""
    pairs = mixing.zip_strict(F.array(C("user_id") % 5, C("user_id") % 7), F.array(C("event_id") % 3, F.lit(2).cast("long")))
    return table(spark, d, "events").select("event_id", F.aggregate(pairs, F.lit(0).cast("long"), lambda s, p: s + p["a"] * p["b"]).alias("dot"))


@query("""WITH parts AS (SELECT doc_id FROM labels UNION ALL SELECT page_id FROM pages), n AS (SELECT doc_id, count(*) AS n FROM parts GROUP BY 1)
SELECT (SELECT count(*) FROM n WHERE n > 1) AS overlapping, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM parts)) AS missing,
  (SELECT count(*) FROM (SELECT doc_id FROM parts EXCEPT SELECT doc_id FROM documents)) AS "foreign" """)
def partition_check(spark, d):
    """Overlaps and gaps of parts against their universe."""
    parts = [table(spark, d, "labels").select("doc_id"), table(spark, d, "pages").select(C("page_id").alias("doc_id"))]
    return mixing.partition_check(table(spark, d, "documents").select("doc_id"), parts, "doc_id")


@query("""WITH a AS (SELECT DISTINCT doc_id FROM labels), b AS (SELECT DISTINCT doc_id FROM documents), n AS (SELECT count(*) FILTER (WHERE b.doc_id IS NULL) AS only_a,
  count(*) FILTER (WHERE a.doc_id IS NULL) AS only_b, count(*) FILTER (WHERE a.doc_id = b.doc_id) AS common FROM a FULL JOIN b ON a.doc_id = b.doc_id)
SELECT *, only_a = 0 AND only_b > 0 AS strict_subset FROM n""")
def strict_subset(spark, d):
    """One set of ids strictly within another."""
    return mixing.subset_check(table(spark, d, "labels").select("doc_id"), table(spark, d, "documents").select("doc_id"), "doc_id")


@query("SELECT p.policy, s.split, x.seed FROM (VALUES ('base'), ('tuned')) p(policy) CROSS JOIN (SELECT DISTINCT lang AS split FROM documents) s CROSS JOIN (VALUES (1), (2), (3)) x(seed)")
def run_grid(spark, d):
    """Every combination of policies, splits and seeds."""
    policies = spark.createDataFrame([("base",), ("tuned",)], "policy string")
    seeds = spark.createDataFrame([(1,), (2,), (3,)], "seed int")
    splits = table(spark, d, "documents").select(C("lang").alias("split")).distinct()
    return F.broadcast(policies).crossJoin(splits).crossJoin(F.broadcast(seeds))


@query("SELECT doc_id AS id, lang AS domain, NULL::VARCHAR AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages")
def union_of_splits(spark, d):
    """All rows of tables with different columns."""
    return mixing.union_all(table(spark, d, "documents").select(C("doc_id").alias("id"), C("lang").alias("domain")), table(spark, d, "pages").select(C("page_id").alias("id"), "url"))


@query("""WITH b AS (SELECT doc_id, CASE WHEN page_id IS NULL THEN source ELSE url END AS source FROM documents LEFT JOIN pages ON doc_id = page_id)
SELECT *, 'left' AS side FROM (SELECT doc_id, source FROM documents EXCEPT ALL SELECT * FROM b)
UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT doc_id, source FROM documents)""")
def symmetric_difference(spark, d):
    """V3: what a replacement changed, after saving and loading: rows on one side only, both ways."""
    docs, path = table(spark, d, "documents").select("doc_id", "source"), scratch(spark)
    pages = table(spark, d, "pages").select(C("page_id").alias("doc_id"), C("url").alias("source"))
    mixing.replace_rows(docs, pages, "doc_id").write.parquet(path)
    return mixing.symmetric_difference(docs, spark.read.parquet(path))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages) UNION ALL SELECT page_id, 'new' FROM pages")
def merge_right_wins(spark, d):
    """Two keyed sets merged, the right one first."""
    right = table(spark, d, "pages").select(C("page_id").alias("doc_id"), F.lit("new").alias("lang"))
    return mixing.merge_right_wins(table(spark, d, "documents").select("doc_id", "lang"), right, "doc_id")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('13:' || doc_id::VARCHAR), doc_id) AS draw, count(*) OVER (PARTITION BY lang) AS size, lang FROM documents)
SELECT percent, doc_id, CASE WHEN draw * 100 <= size * percent THEN 'new' ELSE lang END AS lang, draw * 100 <= size * percent AS replaced
FROM r CROSS JOIN (VALUES (20), (30), (40)) a(percent)""")
def mixture_arms(spark, d):
    """Every arm of a mixture from one pool of replacements, a share of each language by its shuffle."""
    docs, percents = table(spark, d, "documents").select("doc_id", "lang"), [20, 30, 40]
    drawn = sampling.ranked(docs, "lang", "doc_id", 13, size="size")
    first = F.coalesce(*(F.when(C("draw") * 100 <= C("size") * p, p) for p in percents))
    pool = drawn.select("doc_id", F.lit("new").alias("lang"), first.alias("min_percent")).where("min_percent is not null")
    return mixing.arms(pool, docs, "doc_id", percents)


@query("""SELECT conv_id, count(*) AS n_turns, string_agg(role, '>' ORDER BY turn) AS roles, coalesce(arg_max(text, turn) FILTER (WHERE role = 'assistant'), '') AS last_assistant,
  string_agg(role, '>' ORDER BY turn) FILTER (WHERE i <= 2) AS prompt_roles
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) GROUP BY 1""")
def transcript_fold(spark, d):
    """Turns folded to a transcript; its prompt and its last assistant message."""
    fields = F.struct("turn", "role", C("text").alias("content"))
    folded = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(fields)).alias("m"))
    roles = lambda m: F.array_join(F.transform(m, lambda x: x["role"]), ">")
    return folded.select(
        "conv_id", F.size("m").cast("long").alias("n_turns"), roles(C("m")).alias("roles"), transcripts.last_assistant(C("m")).alias("last_assistant"),
        roles(transcripts.prompt(C("m"))).alias("prompt_roles"))


@query("""SELECT conv_id, string_agg(role, '>' ORDER BY turn) FILTER (WHERE last = 0 OR turn < last) AS prompt_roles, coalesce(max(text) FILTER (WHERE turn = last), '') AS completion
FROM (SELECT *, max(CASE WHEN role = 'assistant' THEN turn ELSE 0 END) OVER (PARTITION BY conv_id) AS last FROM conversations) GROUP BY 1 HAVING max(last) > 0""")
def prompt_completion(spark, d):
    """Transcripts cut at their last assistant message into prompt and completion, the other columns left behind."""
    fields = F.struct("turn", "role", C("text").alias("content"))
    folded = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(fields)).alias("m"))
    cut = folded.select("conv_id", transcripts.prompt_completion(C("m")).alias("c")).where("c is not null")
    return cut.select(
        "conv_id", F.array_join(F.transform(C("c")["prompt"], lambda x: x["role"]), ">").alias("prompt_roles"), F.get(C("c")["completion"], F.lit(0))["content"].alias("completion"))


@query("""SELECT conv_id, len(f) AS n_tokens, len(list_filter(f[2:], lambda x: x <> -100)) AS n_learnt, array_to_string(list_append(f[2:], -100), ',') AS labels FROM (
  SELECT conv_id, flatten(list(list_transform(string_split(coalesce(text, ''), ' '), lambda x: CASE WHEN role = 'assistant' THEN length(x) ELSE -100 END) ORDER BY turn)) AS f FROM conversations GROUP BY 1)""")
def assistant_labels(spark, d):
    """The next token as each token's label, those of other roles masked; a word's length stands for its token id."""
    ids = F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.length(w))
    folded = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", ids.alias("ids")))).alias("m"))
    return folded.select("conv_id", transcripts.assistant_labels(C("m")).alias("x")).select(
        "conv_id", F.size("x.input_ids").cast("long").alias("n_tokens"), F.size(F.filter("x.labels", lambda y: y != transcripts.IGNORED)).cast("long").alias("n_learnt"),
        F.array_join(C("x")["labels"].cast("array<string>"), ",").alias("labels"))


@query("SELECT doc_id, sha256(to_json(text)::VARCHAR) AS sha FROM documents")
def canonical_sha(spark, d):
    """SHA-256 of a text as JSON."""
    return readers.dealt(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", hashing.text_sha256(C("text")).alias("sha"))


@query("""SELECT doc_id, substr(sha256('{"lang":' || to_json(lang)::VARCHAR || ',"n":' || n_chars || ',"source":' || to_json(source)::VARCHAR || '}'), 1, 16) AS signature FROM documents""")
def run_signatures(spark, d):
    """16 hex digits over a struct as canonical JSON, whatever the order of its fields."""
    docs = table(spark, d, "documents").select("doc_id", F.struct("source", C("n_chars").alias("n"), "lang").alias("config"))
    return docs.select("doc_id", hashing.signature(C("config"), docs.schema["config"].dataType).alias("signature"))


@query("SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k, '{\"result\": ' || json_extract_string(props, '$.k') || '}' AS result FROM events")
def json_props(spark, d):
    """Numbers read from JSON and written as tool results."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, d, "events").select("event_id", k.alias("k"), transcripts.result_json(k).alias("result"))


@query("""SELECT domain, count(*) AS n FROM (SELECT coalesce(nullif(CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN NULL ELSE lang END, ''), 'id') AS domain FROM documents) GROUP BY 1""")
def domain_classes(spark, d):
    """P10: the domain of a row, id where it is null or empty."""
    raw = F.when(C("doc_id") % 4 == 0, "").when(C("doc_id") % 4 == 1, None).otherwise(C("lang"))
    return table(spark, d, "documents").select(F.coalesce(F.nullif(raw, F.lit("")), F.lit("id")).alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))
