"""Facets, summaries and histograms: group-bys that count distinct messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postbag.functions import dates
from postbag.functions import text as T


def facet(df: DataFrame, key: Column, name: str = "value") -> DataFrame:
    """Messages per key, most first; null keys are left out.  `df` has doc_id."""
    return df.where(key.isNotNull()).groupBy(key.alias(name)).agg(F.countDistinct("doc_id").alias("n")).orderBy(F.desc("n"), name)


def by_folder(messages: DataFrame) -> DataFrame:
    return facet(messages, F.col("folder")).withColumn("display", T.path_tail(F.col("value")))


def by_direction(messages: DataFrame, owner: str) -> DataFrame:
    sent = T.clean_email(F.col("from_email")) == owner.lower()
    return messages.groupBy(F.when(sent, "out").otherwise("in").alias("value")).agg(F.countDistinct("doc_id").alias("n"))


def by_annotation(messages: DataFrame, annotations: DataFrame) -> DataFrame:
    noted = annotations.where("trim(text) != ''").select("doc_id").distinct().withColumn("noted", F.lit(True))
    return messages.join(noted, "doc_id", "left").groupBy(F.when(F.col("noted"), "annotated").otherwise("not annotated").alias("value")).agg(F.countDistinct("doc_id").alias("n"))


def by_accession(messages: DataFrame, accessions: DataFrame, base: str | None = None) -> DataFrame:
    """Messages without an accession count for `base`, or for none."""
    key = F.coalesce("accession_id", F.lit(base)) if base else F.col("accession_id")
    return facet(messages.join(accessions, "doc_id", "left"), key)


def by_label(doc_labels: DataFrame, label_defs: DataFrame, kind: str) -> DataFrame:
    return facet(doc_labels.join(label_defs.where(F.col("type") == kind), "label_id"), F.col("name"))


def by_attachment_type(attachments: DataFrame) -> DataFrame:
    """Messages per extension, each message once per extension."""
    return facet(attachments, F.coalesce(F.lower("ext"), F.lit("unidentified")))


def attachments_by_type(attachments: DataFrame) -> DataFrame:
    """Attachments (not messages) per extension; numeric extensions left out."""
    ext = F.coalesce(F.lower("ext"), F.lit("unidentified"))
    return attachments.where(~ext.rlike(r"^[0-9]+$")).groupBy(ext.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def attachments_by_size(attachments: DataFrame) -> DataFrame:
    return attachments.groupBy(T.size_bucket(F.col("size")).alias("value")).agg(F.count("*").alias("n")).orderBy("value")


def message_facets(messages: DataFrame, attachments: DataFrame, mode: str = "full") -> DataFrame:
    """All facets as rows (facet, value, n) in one pass over exploded (facet, value) pairs.

    Public mode hides folders and attachment types; appraisal mode hides accessions.
    """
    base = [("folder", F.col("folder")), ("label", F.col("label")), ("source", F.col("email_source")), ("sender", F.col("from_email"))]
    if mode == "public":
        base = [b for b in base if b[0] != "folder"]
    pairs = messages.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), c.alias("value")) for n, c in base])).alias("x")).select("doc_id", "x.*")
    if mode != "public":
        pairs = pairs.unionByName(attachments.select("doc_id", F.lit("attachment").alias("facet"), F.coalesce(F.lower("ext"), F.lit("unidentified")).alias("value")))
    return pairs.where("value is not null").groupBy("facet", "value").agg(F.countDistinct("doc_id").alias("n"))


def monthly(messages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Messages per month (and key); invalid dates left out."""
    return messages.where(dates.is_valid(F.col("date"))).groupBy(*(keys or []), dates.month(F.col("date")).alias("month")).agg(F.countDistinct("doc_id").alias("n"))


def stacked_months(messages: DataFrame, key: str, top: int = 20) -> DataFrame:
    """Monthly counts of the `top` most frequent values of a facet, months without
    messages as zero."""
    best = messages.groupBy(key).agg(F.countDistinct("doc_id").alias("total")).orderBy(F.desc("total"), key).limit(top).select(key)
    counted = monthly(messages, [key]).join(best, key, "left_semi")
    span = messages.where(dates.is_valid(F.col("date"))).agg(F.min(dates.month(F.col("date"))).alias("a"), F.max(dates.month(F.col("date"))).alias("b"))
    grid = span.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month")).join(best, how="cross")  # top x months: bounded
    return grid.join(counted, [key, "month"], "left").select(key, "month", F.coalesce("n", F.lit(0)).alias("n"))


def over_intervals(messages: DataFrame, bounds: list[str]) -> DataFrame:
    """Messages in each interval between bounds, interval ends included in the earlier one."""
    code = F.lit(None).cast("int")
    for i in range(len(bounds) - 2, -1, -1):
        low = F.col("date") >= F.lit(bounds[i]).cast("timestamp") if i == 0 else F.col("date") > F.lit(bounds[i]).cast("timestamp")
        code = F.when(low & (F.col("date") <= F.lit(bounds[i + 1]).cast("timestamp")), i).otherwise(code)
    return messages.groupBy(code.alias("interval")).agg(F.countDistinct("doc_id").alias("n")).where("interval is not null")


def collection_summary(messages: DataFrame, attachments: DataFrame, owner: str) -> DataFrame:
    """One row: messages, sent, received, first and last valid date, attachments by class."""
    sent = T.clean_email(F.col("from_email")) == owner.lower()
    ok = dates.is_valid(F.col("date"))
    a = messages.agg(F.count("*").alias("messages"), F.count_if(sent).alias("sent"), F.count_if(~sent).alias("received"), F.min(F.when(ok, F.col("date"))).alias("first"), F.max(F.when(ok, F.col("date"))).alias("last"))
    kind = T.file_class(F.col("ext"))
    b = attachments.agg(F.count("*").alias("attachments"), F.count_if(kind == "image").alias("images"), F.count_if(kind.isin("document", "office")).alias("documents"), F.count_if(kind == "archive").alias("archives"), F.sum("size").alias("bytes"))
    return a.join(b, how="cross")  # one row each


def yearly_attachments(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    return messages.select("doc_id", F.year("date").alias("year")).join(attachments.select("doc_id"), "doc_id").groupBy("year").agg(F.count("*").alias("n"))


def unique_blobs(attachments: DataFrame) -> DataFrame:
    """Attachments and bytes in all and after equal content under an equal name is counted once."""
    per = attachments.groupBy("content", "filename", "size").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("attachments"), F.count("*").alias("distinct_attachments"), F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum("size").alias("distinct_bytes"))


def folder_table(messages: DataFrame, owner: str) -> DataFrame:
    """Per folder: received, sent, total and its source (the last one in order of date)."""
    sent = T.clean_email(F.col("from_email")) == owner.lower()
    return messages.groupBy("folder").agg(F.count_if(~sent).alias("received"), F.count_if(sent).alias("sent"), F.count("*").alias("total"), F.max_by("email_source", F.struct("date", "doc_id")).alias("source"))


def nearest_date(messages: DataFrame, when: str) -> DataFrame:
    """The message closest in time; earlier ids first on a tie."""
    gap = F.abs(F.unix_timestamp("date") - F.unix_timestamp(F.lit(when).cast("timestamp")))
    return messages.withColumn("gap", gap).orderBy("gap", "doc_id").limit(1)


def autocomplete(df: DataFrame, column: str, typed: str, limit: int = 5) -> DataFrame:
    """Distinct values that contain what was typed."""
    return df.where(F.instr(F.lower(column), typed.lower()) > 0).select(column).distinct().orderBy(column).limit(limit)


def clusters(messages: DataFrame, grain: str = "month") -> DataFrame:
    """Messages grouped by month or year, as lists of ids in order of date."""
    return messages.groupBy(F.date_trunc(grain, "date").alias("period")).agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"))


def filename_numbers(attachments: DataFrame) -> DataFrame:
    """Names made unique for export: later ones of a name get ` (n)` before the extension."""
    w = Window.partitionBy(F.lower("filename")).orderBy("blob_id")
    n = F.row_number().over(w) - 1
    dot = F.when(T.extension(F.col("filename")).isNotNull(), F.concat(F.lit("."), F.regexp_extract("filename", r"\.([^./\\]{1,5})$", 1))).otherwise("")
    return attachments.withColumn("export_name", F.when(n == 0, F.col("filename")).otherwise(F.concat(T.base_name(F.col("filename")), F.lit(" ("), n.cast("string"), F.lit(")"), dot)))


def by_person(contact_docs: DataFrame, owner_id) -> DataFrame:
    """Messages per contact that takes part in any role, the owner left out."""
    return facet(contact_docs.where(F.col("contact_id") != F.lit(owner_id)), F.col("contact_id"))


def attachments_by(attachments: DataFrame, messages: DataFrame, key: Column) -> DataFrame:
    """Attachments (not messages) by a property of their message."""
    keyed = messages.select("doc_id", key.alias("value")).where("value is not null")
    return attachments.select("doc_id").join(keyed, "doc_id").groupBy("value").agg(F.count("*").alias("n"))


def attachment_classes(attachments: DataFrame) -> DataFrame:
    return attachments.groupBy(T.file_class(F.col("ext")).alias("value")).agg(F.count("*").alias("n"))


def duplicate_stats(duplicates: DataFrame, attachments: DataFrame) -> DataFrame:
    """One row: duplicates found, and attachment bytes that dropping them saved."""
    size = attachments.groupBy("doc_id").agg(F.sum("size").alias("bytes"))
    per = duplicates.groupBy("kept_doc_id").agg(F.count("*").alias("n"))
    j = per.join(size, per.kept_doc_id == size.doc_id, "left")
    return j.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicates"), F.coalesce(F.sum(F.col("n") * F.coalesce("bytes", F.lit(0))), F.lit(0)).alias("bytes_saved"))


def distinct_values(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """(list, value): the folders, sources, labels and attachment names that occur."""
    kinds = {"folder": "folder", "source": "email_source", "label": "label"}
    pairs = messages.select(F.explode(F.array(*[F.struct(F.lit(k).alias("list"), F.col(c).alias("value")) for k, c in kinds.items()])).alias("x")).select("x.*")
    return pairs.unionByName(attachments.select(F.lit("attachment").alias("list"), F.col("filename").alias("value"))).where("value is not null").distinct()


def caption_months(hits: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages per month and lexicon caption; `None` is the layer of those without any."""
    return monthly(hits.join(messages.select("doc_id", "date"), "doc_id"), ["caption"])
