"""Queries that write tables in the formats of the sinks and read them back with the sources, and checks of artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import checks, mixing
from ..sources import readers, writers
from ..streaming.run import scratch
from .registry import query, table

C = F.col


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


@query("SELECT doc_id, n_chars, lang AS split FROM documents")
def split_directories(spark, d):
    """Documents saved as one directory by split and loaded with the set of names checked."""
    docs, path = table(spark, d, "documents").select("doc_id", "n_chars", C("lang").alias("split")), scratch(spark)
    writers.splits(docs, path)
    names = tuple(r["split"] for r in docs.select("split").distinct().collect())
    return readers.splits(spark, path, _ddl(docs.drop("split")) + ", split string", names).select("doc_id", "n_chars", "split")


@query("SELECT doc_id, n_chars, lang AS split FROM documents WHERE lang = 'fr'")
def one_split(spark, d):
    """One split of the directory; the others aren't read."""
    docs, path = table(spark, d, "documents").select("doc_id", "n_chars", C("lang").alias("split")), scratch(spark)
    writers.splits(docs, path)
    return readers.one_split(spark, path, "fr", _ddl(docs.drop("split")) + ", split string").select("doc_id", "n_chars", "split")


@query("""SELECT doc_id, '{' || concat_ws(',', '"doc_id":' || doc_id, '"quality":' || quality, '"toxic":' || toxic) || '}' AS record
FROM documents LEFT JOIN labels USING (doc_id)""")
def sparse_records(spark, d):
    """S3: structs as JSON without their nulls."""
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    return rows.select("doc_id", readers.sparse_json(F.struct("doc_id", "quality", "toxic")).alias("record"))


@query("SELECT doc_id::VARCHAR AS id FROM documents")
def id_lists(spark, d):
    """A text file of padded ids and blank lines; repeated ids would be an error."""
    path = scratch(spark)
    lines = F.explode(F.array(F.concat(F.lit("  "), C("doc_id").cast("string"), F.lit(" ")), F.lit(" "), F.lit("")))
    table(spark, d, "documents").select(lines.alias("value")).write.text(path)
    return readers.id_list(spark, path)


@query("SELECT user_id AS id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def prediction_lines(spark, d):
    """JSON lines in order, read by id with the later of repeated ids."""
    rows, path = table(spark, d, "events").select(C("user_id").alias("id"), "event_id", "value"), scratch(spark)
    writers.json_lines(rows.orderBy("event_id"), path)
    return readers.predictions(spark, path, _ddl(rows)).select("id", "event_id", "value")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def checkpoint_lines(spark, d):
    """JSON lines of an interrupted run, each also cut off half-way; only target ids are kept."""
    docs, path = table(spark, d, "documents").select("doc_id", "lang", "n_chars"), scratch(spark)
    line = F.to_json(F.struct(*docs.columns))
    cut = F.substring(line, F.lit(1), F.floor(F.length(line) / 2).cast("int"))
    docs.select(F.explode(F.array(cut, line)).alias("value")).write.text(path)
    return readers.checkpoint(spark, path, table(spark, d, "labels"), _ddl(docs), "doc_id").select("doc_id", "lang", "n_chars")


@query("""SELECT doc_id AS id, 'same' AS run FROM labels UNION ALL SELECT event_id, 'mixed' FROM events WHERE (SELECT bool_and(event_type = 'click') FROM events)
UNION ALL SELECT doc_id, 'stale' FROM labels WHERE false""")
def resumed_rows(spark, d):
    """Finished rows are taken up only if all of them carry the current signature."""
    labels, events = table(spark, d, "labels").withColumn("signature", F.lit("a")), table(spark, d, "events")
    part = lambda rows, key, name: rows.select(C(key).alias("id"), F.lit(name).alias("run"))
    return (
        part(readers.resumable(labels, "signature", "a"), "doc_id", "same").unionByName(part(readers.resumable(events, "event_type", "click"), "event_id", "mixed"))
        .unionByName(part(readers.resumable(labels, "signature", "b"), "doc_id", "stale"))
    )


@query("SELECT count(*) AS n_docs, count(DISTINCT lang) AS n_langs, sum(n_chars)::BIGINT AS n_chars, max(text) AS last_text FROM documents")
def report_document(spark, d):
    """A report as one JSON file that takes the place of an older one."""
    path = scratch(spark) + "/report.json"
    writers.document(spark.range(1).select(F.lit(-1).alias("n_docs")), path)
    report = table(spark, d, "documents").agg(
        F.count("*").alias("n_docs"), F.count_distinct("lang").alias("n_langs"), F.sum("n_chars").alias("n_chars"), F.max("text").alias("last_text"))
    writers.document(report, path)
    return readers.document(spark, path, _ddl(report))


@query("""SELECT lang || '/metrics.json' AS member, '{"n":' || count(*) || ',"n_chars":' || sum(n_chars)::BIGINT || '}' AS content FROM documents WHERE lang IS NOT NULL GROUP BY lang""")
def archive_members(spark, d):
    """Reports by language in ZIP archives by shard, required names checked, and the JSON members read by their offsets."""
    by = table(spark, d, "documents").where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))
    files = by.select(F.concat("lang", F.lit("/metrics.json")).alias("name"), F.to_json(F.struct("n", "n_chars")).alias("content"))
    notes = spark.range(1).select(F.lit("notes.txt").alias("name"), F.lit("not JSON").alias("content"))
    path = scratch(spark)
    writers.bundles(files.unionByName(notes), path, ["notes.txt"], shards=2)
    return readers.zip_members(spark, path).select("member", "content")


@query("""SELECT event_id, value AS memory_used_mib, user_id::DOUBLE AS memory_total_mib, NULL::DOUBLE AS memory_free_mib, (event_id % 100)::DOUBLE AS gpu_utilization_percent,
  NULL::DOUBLE AS power_draw_watts FROM events""")
def device_samples(spark, d):
    """Lines of a device's counters, some of them no numbers or missing, cast by place."""
    line = F.concat_ws(", ", C("value").cast("string"), C("user_id").cast("string"), F.lit("[N/A]"), (C("event_id") % 100).cast("string"))
    rows = table(spark, d, "events").select("event_id", readers.device_sample(line, C("ts").cast("string")).alias("s"))
    return rows.select("event_id", "s.memory_used_mib", "s.memory_total_mib", "s.memory_free_mib", "s.gpu_utilization_percent", "s.power_draw_watts")


@query("SELECT conv_id, turn, CASE WHEN role <> 'user' THEN NULL ELSE length(text) || ' characters' END AS completion FROM conversations WHERE text IS NOT NULL")
def completion_rows(spark, d):
    """Each prompt sent to a service by the caller's client; requests that fail give null. The service here is a function."""

    def complete(prompt: str) -> str:
        role, text = prompt.split("\n", 1)
        if role != "user":
            raise ConnectionError("refused")
        return f"{len(text)} characters"

    prompts = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.concat_ws("\n", "role", "text").alias("prompt"))
    return readers.completions(prompts, complete).drop("prompt")


@query("SELECT doc_id, lang, n_chars FROM documents")
def appended_rows(spark, d):
    """Rows of a first run appended to a log, then those that the log still lacks; all read in order of id."""
    docs, path = table(spark, d, "documents").select("doc_id", "lang", "n_chars"), scratch(spark)
    writers.append(mixing.only(docs, table(spark, d, "labels"), "doc_id"), path)
    log = spark.read.schema(docs.schema).json(path)
    writers.append(mixing.without(docs, log, "doc_id"), path)
    return spark.read.schema(docs.schema).json(path).orderBy("doc_id")


@query("""WITH l AS (SELECT lang || ' ' || count(*) AS line FROM documents WHERE lang IS NOT NULL GROUP BY lang), t AS (SELECT string_agg(line || chr(10), '' ORDER BY line) AS t FROM l)
SELECT sha256(t) AS sha256, strlen(t) AS length FROM t""")
def file_hashes(spark, d):
    """SHA-256 and length of a whole file, here a report of one line by language."""
    path = scratch(spark)
    by = table(spark, d, "documents").where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"))
    by.select(F.concat_ws(" ", "lang", "n").alias("value")).orderBy("value").coalesce(1).write.text(path)
    return hashing.file_sha256(spark, f"{path}/part-*").select("sha256", "length")


@query("""SELECT doc_id, regexp_full_match(r, '[0-9a-f]{40}') AS is_revision FROM (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN substr(h, 1, 40) WHEN doc_id % 3 = 1 THEN upper(substr(h, 1, 40)) ELSE substr(h, 1, 41) END AS r
  FROM (SELECT doc_id, sha256(text) AS h FROM documents))""")
def revision_names(spark, d):
    """Names that are 40 lower-case hex digits."""
    h, k = F.sha2("text", 256), C("doc_id") % 3
    name = F.when(k == 0, F.substring(h, 1, 40)).when(k == 1, F.upper(F.substring(h, 1, 40))).otherwise(F.substring(h, 1, 41))
    return table(spark, d, "documents").select("doc_id", hashing.is_revision(name).alias("is_revision"))


_RUNS = """runs AS (SELECT conv_id, CASE WHEN arg_max(role, turn) = 'assistant' THEN 'complete' ELSE 'running' END AS status, count(*) AS "rows", min(turn)::BIGINT AS seed,
  max(turn)::BIGINT AS step, sha256(arg_min(role, turn)) AS prompt_hash FROM conversations GROUP BY 1)"""


@query(f"""WITH {_RUNS} SELECT * FROM runs WHERE status <> 'complete' OR "rows" <> 4 OR seed <> 0 OR step <> 3 OR prompt_hash <> (SELECT min(prompt_hash) FROM runs)""")
def inconsistent_artifacts(spark, d):
    """V8: artifacts that aren't complete, or of another seed, size, step or prompt than the rest."""
    runs = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.when(F.max_by("role", "turn") == "assistant", "complete").otherwise("running").alias("status"), F.count("*").alias("rows"),
        F.min("turn").cast("long").alias("seed"), F.max("turn").cast("long").alias("step"), F.sha2(F.min_by("role", "turn"), 256).alias("prompt_hash"))
    return checks.inconsistent(runs, 4, 0, 3)


@query("""SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'completion' ELSE 'prompt' END AS part, text AS content, CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END AS trained
FROM conversations""")
def masked_messages(spark, d):
    """Only the columns that training needs, messages as prompt and completion, and how many characters a mask leaves."""
    own = C("role") == "assistant"
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.when(own, "completion").otherwise("prompt").alias("part"), C("text").alias("content"), F.when(own, F.length("text")).otherwise(0).cast("long").alias("trained"))


@query("""SELECT lang, rpad(coalesce(nullif(lang, ''), 'none'), 8, ' ') || lpad(count(*)::VARCHAR, 8, ' ') || lpad(printf('%.1f', round(100.0 * count(*) / sum(count(*)) OVER (), 1)), 7, ' ') || ' %' AS line
FROM documents GROUP BY 1""")
def report_lines(spark, d):
    """The lines of a printed report, with a name for what has none and padded columns."""
    by = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    share = F.format_string("%.1f", 100.0 * C("n") / C("total"))
    label = F.rpad(F.coalesce(F.nullif("lang", F.lit("")), F.lit("none")), 8, " ")
    return by.crossJoin(total).select("lang", F.concat(label, F.lpad(C("n").cast("string"), 8, " "), F.lpad(share, 7, " "), F.lit(" %")).alias("line"))
