"""A training corpus from the documents table: five filters and transforms, each a written table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import decontaminate, language, ngram_join, pieces, quality, store
from tracemill.llm.ship import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose score of being good is below this go.
KEEP_FROM = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labelled rows, doesn't reject."""
    ship(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(*COLUMNS), model).where(F.col("quality_score") >= KEEP_FROM).select(*COLUMNS)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learnt; those rejected go, whatever their lang says."""
    ship(spark)
    return language.identify(docs.select(*COLUMNS), language.fit(docs)).where(~F.col("lang_rejected")).select(*COLUMNS)


def keep_first_of_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each class of near duplicates."""
    ship(spark)
    classes = ngram_join.near_duplicates(docs)
    gone = classes.where("doc_id <> component_id").select("doc_id")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def keep_decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    ship(spark)
    found = decontaminate.find(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size(decontaminate.HITS) == 0).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and whether they decode to its text."""
    ship(spark)
    model = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    both = pieces.decode(pieces.encode(docs.select(*COLUMNS), model), model)
    return both.select(
        "doc_id", "lang", "source", "pieces", F.size("pieces").cast("long").alias("n_pieces"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", keep_first_of_class),
    ("decontamination", keep_decontaminated),
    ("pieces", encode_pieces),
]

#: No stage but the anti join can be put in SQL: two learnt models, a similarity join, edit matching and pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each but the last written to the shared folder before the next."""
    folder = store.shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store.written(docs, folder, f"{k}-{name}")
    return docs
