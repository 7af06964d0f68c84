"""Labels of messages: checked assignment, replacement, projection on export, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postbag.operators.messages import CLEARED, expired

# The system label "reviewed".
REVIEWED = "3"
TIMED = ("RESTRICTED_UNTIL", "RESTRICTED_FOR_YEARS")


def set_checked(messages: DataFrame, doc_labels: DataFrame, label_defs: DataFrame, doc_ids: DataFrame, labels: list[str], now: str) -> DataFrame:
    """(doc_id, label_ids, failure): what each of `doc_ids` holds after `labels` were set.

    Cleared-for-release needs all timed restrictions of the message to be over; a
    restriction for years needs a trusted date (`messages` has doc_id, date, hacky).  A
    message that fails keeps the labels it had and says why.
    """
    wanted = F.array(*[F.lit(x) for x in labels])
    held = doc_labels.groupBy("doc_id").agg(F.collect_set("label_id").alias("before"))
    rows = doc_ids.select("doc_id").distinct().join(messages.select("doc_id", "date", "hacky"), "doc_id").join(held, "doc_id", "left")
    none = F.expr("cast(array() as array<string>)")
    rows = rows.withColumn("before", F.coalesce("before", none)).withColumn("after", F.array_union("before", wanted))
    timed = label_defs.where(F.col("restriction").isin(*TIMED)).select("label_id", "restriction", "until", "years")
    each = rows.select("doc_id", "date", F.explode("after").alias("label_id")).join(timed, "label_id")
    over = expired(F.col("date"), F.col("until"), F.col("years"), F.lit(now).cast("timestamp"))
    open_ = each.groupBy("doc_id").agg(F.max((~over).cast("int")).alias("open"), F.max((F.col("restriction") == "RESTRICTED_FOR_YEARS").cast("int")).alias("relative"))
    j = rows.join(open_, "doc_id", "left")
    failure = F.when(F.array_contains("after", CLEARED) & (F.coalesce("open", F.lit(0)) == 1), "restriction is not over").when((F.coalesce("relative", F.lit(0)) == 1) & F.col("hacky"), "date is not known")
    return j.select("doc_id", F.array_sort(F.when(failure.isNull(), F.col("after")).otherwise(F.col("before"))).alias("label_ids"), failure.alias("failure"))


def replace_labels(doc_labels: DataFrame, doc_ids: DataFrame, labels: list[str]) -> DataFrame:
    """Only these labels on `doc_ids`; all other messages keep theirs."""
    new = doc_ids.select("doc_id").distinct().select("doc_id", F.explode(F.array(*[F.lit(x) for x in labels])).alias("label_id"))
    return doc_labels.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)


def for_export(doc_labels: DataFrame, label_defs: DataFrame, doc_ids: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """(definitions, assignments) that go along with exported messages.

    processing: all.  delivery: no restrictions, and no message shows that it was
    reviewed.  discovery: neither restrictions nor system labels.
    """
    mine = doc_labels.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    if mode == "processing":
        return label_defs, mine
    defs = label_defs.where("type != 'RESTRICTION'")
    if mode == "discovery":
        defs = defs.where((~F.col("is_system")) & (F.col("label_id") != REVIEWED))
    return defs, mine.join(defs.where(F.col("label_id") != REVIEWED).select("label_id"), "label_id", "left_semi").select("doc_id", "label_id")


def annotate(annotations: DataFrame, doc_ids: DataFrame, text: str, append: bool = False) -> DataFrame:
    """Notes after `text` was written on (or, with `append`, added to) those of `doc_ids`."""
    asked = doc_ids.select("doc_id").distinct().withColumn("_asked", F.lit(True))
    j = annotations.select("doc_id", "text").join(asked, "doc_id", "full_outer")
    both = F.concat_ws("\n", "text", F.lit(text)) if append else F.lit(text)
    return j.select("doc_id", F.when(F.col("_asked"), both).otherwise(F.col("text")).alias("text"))
