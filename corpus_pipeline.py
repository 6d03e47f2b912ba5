"""From raw documents to packed training sequences: five stages, each written and read again.

A stage takes (spark, docs, sf_dir) and works on all that the one before it kept.  All but the last return the
columns of docs.  Rejected documents go as a whole; kept ones stay as they are.  Every stage takes empty tables, nulls
in any column, and further columns of any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import store
from fathom.llm.decontaminate import matched_spans, same, text_key
from fathom.llm.neardup import near_duplicates
from fathom.llm.packing import pack
from fathom.llm.quality_model import quality_scores
from fathom.llm.quality_rules import judge


def _row(docs: DataFrame) -> Column:
    """A row as one value, so that no column of docs meets a stage's own."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the quality rules keep.

    Null, empty and short texts fail the base rules and go; repeated rows share a verdict; very long texts are judged whole.
    """
    judged = judge(docs.select("text", _row(docs).alias("row")))
    # a filter on kept itself would be written out below the steps that make it, many times over
    return judged.select(F.explode_outer(F.when(F.col("kept"), F.array("row"))).alias("row")).filter("row IS NOT NULL").select("row.*")


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier, learned on the labels of its own input, scores 0.5 or more.

    Null texts are scored as empty ones; without labels all stay.  Repeated rows share a score.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_scores(docs, labels, whole_rows=True).filter("predicted = 1").select("row.*")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: shingles of five words, similarity 0.8.

    Of rows that repeat a doc_id and its text one stays, the same on every run; rows of one doc_id with different
    texts are one document and stay or go together.  Rows with a null doc_id stay, as do texts that are null or have
    no word.
    """
    found = near_duplicates(docs)
    gone = found.filter("NOT kept").select("doc_id").distinct()
    again = store.written(found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if not again.limit(1).count():
        return left
    row = _row(docs)
    once = left.join(again, "doc_id", "left_semi").groupBy("doc_id", text_key().alias("key")).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row"))
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).union(once.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a window of a benchmark item.

    Null and wordless texts hold none and stay; repeated rows share a verdict; very long texts are looked at whole.
    """
    spans = matched_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = spans.select("doc_id", "_t").distinct()
    keyed = docs.select("doc_id", text_key().alias("_t"), _row(docs).alias("row"))
    return keyed.join(hit, same(keyed, hit), "left_anti").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens, in the sources' proportions.

    Null texts are empty, so the end id alone; repeated rows are documents of their own; no rows give no sequences.
    """
    # workers share the executor with what earlier stages have left in it
    return pack(docs, pieces=300_000)


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("near_dedup", dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Tokenising, trees and connected components aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
