"""The thin queries opN_<name>, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, extract, language, licenses, ngram_join, oracles, pieces, quality, resample, store, tokenids, topk, vectors, wordpiece
from .digests import with_crc32
from .ship import ship

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def _query(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    _queries[f.__name__] = run
    return run


@_query
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of embeddings at cosine 0.98 within a label."""
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.98)


@_query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document: by line, as the whole text (line 0), and at any place of it (line -1, with the place's first word and the template's words)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    units = licenses.scan(docs).select("doc_id", "line_no", F.lit(0).cast("long").alias("word_no"), F.lit(0).cast("long").alias("n_words"), "license", "dice")
    return units.unionByName(licenses.spans(docs).select("doc_id", F.lit(-1).alias("line_no"), "word_no", "n_words", "license", "dice"))


_oracles["op2_license_scan"] = """
WITH templates(license, text) AS (VALUES {templates}),
tw AS (SELECT license, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM templates),
tb AS (SELECT license, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM tw WHERE len(w) > 1),
tc AS (SELECT license, g, count(*) AS n FROM tb GROUP BY ALL),
ts AS (SELECT license, sum(n) AS m FROM tc GROUP BY ALL),
lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS unit FROM lines
  UNION ALL SELECT doc_id, 0, array_to_string(l, ' ') FROM lines WHERE len(l) > 1
),
uw AS (SELECT doc_id, line_no, list_filter(regexp_split_to_array(lower(unit), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM units),
ub AS (SELECT doc_id, line_no, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM uw WHERE len(w) > 1),
uc AS (SELECT doc_id, line_no, g, count(*) AS n FROM ub GROUP BY ALL),
us AS (SELECT doc_id, line_no, sum(n) AS m FROM uc GROUP BY ALL),
both_ AS (SELECT uc.doc_id, uc.line_no, tc.license, sum(least(uc.n, tc.n)) AS c FROM uc JOIN tc USING (g) GROUP BY ALL),
scored AS (
  SELECT doc_id, line_no, license, 2.0 * c::DOUBLE / (us.m + ts.m)::DOUBLE AS dice
  FROM both_ JOIN us USING (doc_id, line_no) JOIN ts USING (license)
),
units_found AS (
  SELECT doc_id, line_no::INTEGER AS line_no, 0::BIGINT AS word_no, 0::BIGINT AS n_words, license, round(dice, 6) AS dice FROM scored WHERE dice >= {threshold}
  QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY dice DESC, license) = 1
),
bodies(k, license, text) AS (VALUES {bodies}),
places(k, q, g) AS (VALUES {places}),
bw AS (SELECT k, license, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM bodies),
bc AS (SELECT k, g, count(*) AS n FROM (SELECT k, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM bw) GROUP BY ALL),
bs AS (SELECT k, license, len(w) - 1 AS m FROM bw),
dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
dg AS (SELECT doc_id, unnest(range(0, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM dw WHERE len(w) > 1),
laid AS (SELECT DISTINCT doc_id, k, i - q AS s FROM dg JOIN places USING (g)),
wg AS (SELECT doc_id, k, s, g, count(*) AS n FROM laid JOIN bs USING (k) JOIN dg USING (doc_id) WHERE i BETWEEN s AND s + m - 1 GROUP BY ALL),
wn AS (SELECT doc_id, k, s, sum(n) AS n FROM wg GROUP BY ALL),
wc AS (SELECT doc_id, k, s, sum(least(wg.n, bc.n)) AS c FROM wg JOIN bc USING (k, g) GROUP BY ALL),
near AS (SELECT doc_id, k, s, m, license, 2.0 * c::DOUBLE / (n + m)::DOUBLE AS dice FROM wc JOIN wn USING (doc_id, k, s) JOIN bs USING (k)),
listed AS (SELECT doc_id, k, m, license, list([{{'s': s, 'dice': dice}}] ORDER BY dice DESC, s) AS w FROM near WHERE dice >= {threshold} GROUP BY ALL),
given AS (SELECT doc_id, k, m, license, unnest(list_reduce(w, lambda g, x: CASE WHEN len(list_filter(g, lambda y: abs(y.s - x[1].s) <= m)) > 0 THEN g ELSE g || x END)) AS b FROM listed)
SELECT * FROM units_found UNION ALL
SELECT doc_id, -1, b.s + 1, m + 1, license, round(b.dice, 6) FROM given
""".format(
    templates=", ".join("('{}', '{}')".format(*t) for t in licenses.TEMPLATES),
    bodies=", ".join("({}, '{}', '{}')".format(k, *t) for k, t in enumerate(licenses.TEMPLATES + licenses.BODIES)),
    places=", ".join("({}, {}, '{}')".format(*p) for p in licenses.anchors(licenses.TEMPLATES + licenses.BODIES, licenses.THRESHOLD)),
    threshold=licenses.THRESHOLD,
)


@_query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level ids of every document in flat files, read back from them."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = store.shared_dir(spark)
    return tokenids.read(tokenids.write(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, added=True), folder)


@_query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within the edit budget, one row for each document and item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode(decontaminate.HITS).alias("hit")).select("doc_id", "hit.item_id", "hit.distance", "hit.start", "hit.length")


@_query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy word pieces of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return wordpiece.count(docs, wordpiece.load(public_tokenizers.path("byte_bpe_50k.json"))).select("doc_id", "n_words", "n_tokens")


@_query
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents by 3-word shingles at Jaccard 0.9."""
    return ngram_join.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=90, words=3)


@_query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document and the text that they decode to, as counts, checksums and a comparison."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    both = pieces.decode(pieces.encode(docs, model), model)
    return with_crc32(both, "pieces").select(
        "doc_id", F.size("pieces").cast("long").alias("n_pieces"), "ids_crc32", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip")
    )


@_query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labelled rows outside the fold that is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = quality.fit(docs, labels.where(fold != 0))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", (fold == 0).alias("held_out"), F.col("quality_score").alias("score"),
        F.when(F.col("quality_score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


@_query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the rows outside the fold that is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = language.fit(docs.where(fold != 2))
    named = language.identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


@_query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


@_query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language lie from each other, and each source's terms above its language."""
    return divergence.audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_oracles["op11_source_divergence"] = oracles.DIVERGENCE


@_query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents of 20 words or more, drawn towards the benchmark's texts."""
    return resample.resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_oracles["op12_importance_resampling"] = oracles.RESAMPLING


@_query
def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 embeddings of highest integer inner product with each that has a vec_id divisible by 20."""
    vectors_ = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.search(vectors_.where("vec_id % 20 = 0"), vectors_)


_oracles["op13_exact_top_k"] = oracles.TOP_K


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline's result."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    """Every registered corpus query by name."""
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return dict(_oracles)
