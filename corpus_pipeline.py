"""The corpus pipeline: quality classifier, quality rules, near-duplicates, decontamination, packing.

Each stage is a function of (spark, docs, sf_dir); all but the last return the
columns of documents.  `run` applies them to documents, each written and read again.

Rows are judged each for itself by the classifier and the rules, so repeated rows
and rows of null doc_id get their own verdict.  Null and empty texts go with the
rules (no words).  Near-duplicates name documents by doc_id: rows of null doc_id cannot
be named and stay.  Decontamination takes such rows by their text.  An empty table stays empty.  Columns
other than doc_id and text pass through unread; they must not be called `_row` or
`_score`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag.llm import neardup, packing, phrases, qda, rules
from postbag.llm.common import table, written

#: Shingle words and similarity (percent) of the near-duplicate stage.
SHINGLE, PERCENT = 5, 80
VOCABULARY, END, SIZE = "word_bpe_49k.json", 1, 2048


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the discriminant scores 0.5 or more."""
    model = qda.fit(docs, table(spark, sf_dir, "labels"), "quality")
    return qda.score(docs, model, carry=True).where(F.col("_score") >= 0.5).drop("_score")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the base check and all rules let pass."""
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    return rules.judge(whole, carry=("_row",)).where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group."""
    gone = neardup.cluster(docs, SHINGLE, PERCENT).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item; rows without doc_id go by their text."""
    key = "_key"
    while key in docs.columns:
        key = f"_{key}"
    named = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    found = phrases.contaminated(named.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = found.where("contaminated").select(F.col("doc_id").alias(key)).distinct()
    return named.join(written(gone, "contaminated"), key, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, VOCABULARY, END, SIZE)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Scores of a trained model, linear programming and tokenizing are beyond SQL: the
#: pipeline is tested against brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
