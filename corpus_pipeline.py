"""A training corpus from ``documents`` in four stages, each an operator of ``lumenry.llm``.

Every stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns
a DataFrame, which is written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenry.llm import jaccard_join, language_id, mixing, packing
from lumenry.llm.store import materialise, small_enough, unused

BELIEF = 0.4
BROADCAST_IDS = 1_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without letters, or for which no language is believed at least ``BELIEF``, go."""
    model = language_id.train(docs.select("lang", "text"))
    name = unused("language", docs.columns)
    kept = language_id.identify(docs, model, out_col=name)
    kept = kept.where((F.col(f"{name}.lang_pred") != language_id.UNKNOWN) & (F.col(f"{name}.score") >= BELIEF))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) one row, with the smallest id.

    Rows without an id stay. An id whose rows hold several texts is judged text by text: each
    group keeps a row, so no text goes that has no near copy left, and of texts without words the id keeps one.
    Equal ids and texts are one document. Only ids and keys of sets move, unless too many go for a broadcast. Columns of
    any type and name pass through; an empty table gives none.
    """
    found = materialise(jaccard_join.jaccard_components(docs, width=5, percent=80, with_keys=True).where("doc_id is not null"), "components")
    own = found.groupBy("doc_id").agg(F.min(F.col("component_id") == F.col("doc_id")).alias("stays"), F.count("*").alias("rows"))
    own = materialise(own, "own")
    gone, again = own.where("rows = 1 and not stays").select("doc_id"), own.where("rows > 1").select("doc_id")
    gone = F.broadcast(gone) if small_enough(gone, BROADCAST_IDS) else gone
    kept = docs.join(gone, "doc_id", "left_anti")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if again.isEmpty():
        return kept.select(*columns)
    again = F.broadcast(again) if small_enough(again, BROADCAST_IDS) else again
    several = kept.join(again, "doc_id", "left_semi").select(F.struct(*columns).alias("row"), F.col("doc_id").alias("id"), "text")
    several = several.withColumn("key", jaccard_join.set_keys("text"))
    first = found.join(again, "doc_id", "left_semi").where("component_id = doc_id").select(F.col("doc_id").alias("id"), F.col("set_key").alias("own")).distinct()
    stays = several.join(first, (several.id == first.id) & several.key.eqNullSafe(first.own), "left_semi")
    one = stays.groupBy("id", F.col("key").isNull()).agg(F.min_by("row", F.struct("text", F.to_json("row"))).alias("row"))
    return kept.join(again, "doc_id", "left_anti").select(*columns).unionByName(one.select("row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated or left out so that sources meet their target weights."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids; one row per piece."""
    return packing.pack(docs, packing.default_vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("bestfit_packing", pack_sequences),
]

#: No stage but the mixing targets can be said in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
