"""The corpus pipeline: five stages, each an operator over all rows that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again
as the next one's ``docs``. All but the last return the columns of ``documents``.

1. ``language_id``: rows whose text has no language (no letter, or a pooled probability under
   ``MIN_SCORE``, which only mixtures without a main language have) go.
2. ``exact_dedup``: of equal texts the row with the smallest doc_id stays.
3. ``jaccard_dedup``: of each component of near duplicates the smallest doc_id stays.
4. ``decontamination``: rows that overlap an item of ``benchmark`` go.
5. ``packing``: what is left is packed into sequences of 2048 tokens.

Rows with a null doc_id pass stage 3 (nothing can be linked with them). Stages 2 and 4 tell rows by identifier and
text; stage 3 drops all rows of a doc_id that is not the smallest of its component. Extra columns are kept by all but
the last stage. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corrvox.llm import decontam, exact_dedup, jaccard_join, language_id, packing
from corrvox.llm.common import join_small, materialize, table

MIN_SCORE = 0.4


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.keep_identified(docs, model, MIN_SCORE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = materialize(exact_dedup.exact_dedup(docs).where("kept").select("doc_id", "text_sha256"), "kept")
    rows = docs.withColumn("_sha", F.sha2(F.encode(exact_dedup.normalised(F.col("text")), "UTF-8"), 256))
    own = rows.join(kept.withColumnRenamed("doc_id", "_id"), rows["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("text_sha256")), "left_semi")
    # Rows that repeat identifier and text: one stays.
    first = Window.partitionBy("doc_id", "_sha").orderBy("text")
    return own.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(docs)
    gone = materialize(found.where("component_id < doc_id").select("doc_id").distinct(), "gone")
    return join_small(docs, gone, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_languages),
    ("exact_dedup", drop_copies),
    ("jaccard_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: The first stage is a trained network and the last a heuristic packing: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
