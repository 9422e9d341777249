"""A training-data pipeline over ``documents``: quality, toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns
of ``documents``. Null texts are empty texts to every stage; tables without rows pass through; further columns are
kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import curve_packing, graph_spans, ngram_join, quality_rules, toxicity_cnn
from lorekeep.llm.common import cut, table
from lorekeep.llm.queries import quality_files, word_file


def whole(docs: DataFrame, *columns: str) -> DataFrame:
    """The row as one column beside those that an operator reads, so that no name of the operator's can clash."""
    return docs.select(*columns, F.struct(*docs.columns).alias("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the fertility bands keep."""
    return quality_rules.judge(whole(docs, "doc_id", "text", "lang"), **quality_files(), carry="row").where("kept").select("row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold of a classifier that is trained on the labelled ones among ``docs``."""
    scored = toxicity_cnn.with_scores(whole(docs, "doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.where(F.col("score") < toxicity_cnn.THRESHOLD).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component; equal rows of one id are one document."""
    first = ngram_join.jaccard_components(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_key").distinct()
    rows = whole(docs).select("row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64("row.text").alias("key"))
    kept = rows.join(first, rows["id"].eqNullSafe(first["doc_id"]) & (rows["key"] == first["text_key"]))
    return kept.dropDuplicates(["id", "key"]).select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that occur elsewhere too."""
    done = graph_spans.remove_repeats(whole(docs, "text"))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    fresh = {"text": text, "n_chars": F.length(text).cast("long")}
    return done.select(*(fresh[c].alias(c) if c in fresh else F.col("row")[c].alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences in the order of the curve."""
    return curve_packing.pack(docs, word_file())


STAGES = [("quality", quality), ("toxicity", toxicity), ("ngram_join", near_duplicates), ("substring_dedup", repeated_passages), ("packing", packing)]

#: The classifier's scores are not for SQL to say; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
