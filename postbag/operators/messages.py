"""Operators on whole messages: identity, threads, dedup, merge, labels and export policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postbag.functions import text as T
from postbag.operators.windows import numbered

# Ids of the system labels.
DO_NOT_TRANSFER, CLEARED, RESTRICTED, TO_DELIVERY_ONLY = "0", "1", "2", "7"


def with_uid(messages: DataFrame) -> DataFrame:
    return messages.withColumn("uid", T.signature(F.col("date"), F.col("from_email"), F.col("subject"), F.col("doc_id").cast("string")))


def dedup(messages: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return messages.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def duplicates(messages: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """(kept_doc_id, doc_id) of rows that `dedup` drops."""
    w = Window.partitionBy(*key).orderBy(*order)
    return messages.withColumn("kept_doc_id", F.first("doc_id").over(w)).withColumn("_n", F.row_number().over(w)).where("_n > 1").select("kept_doc_id", "doc_id")


def new_only(batch: DataFrame, archive: DataFrame, key: str = "uid") -> DataFrame:
    """Rows of a batch that the archive does not have, each once."""
    return batch.dropDuplicates([key]).join(archive.select(key), key, "left_anti")


def merge(one: DataFrame, other: DataFrame, key: str = "uid") -> DataFrame:
    return one.unionByName(new_only(other, one, key))


def threads(messages: DataFrame, correspondents: DataFrame) -> DataFrame:
    """thread_id: rank, by first message, of (bare subject, sorted correspondents).

    The rank is over keys, not messages.
    """
    who = correspondents.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("email")), ",").alias("who"))
    keyed = messages.join(who, "doc_id", "left").withColumn("k", F.sha2(F.concat_ws("\x01", F.lower(T.bare_subject(F.coalesce("subject", F.lit("")))), F.coalesce("who", F.lit(""))), 256))
    firsts = keyed.groupBy("k").agg(F.min(F.struct("date", "doc_id")).alias("f"))
    ids = numbered(firsts.select("k", "f.date", "f.doc_id"), ["date", "doc_id", "k"], "thread_id").select("k", "thread_id")
    return keyed.join(ids, "k").select("doc_id", "thread_id")


def sessions(messages: DataFrame, key: list[str], days: int = 30) -> DataFrame:
    """Runs of messages with equal key and no gap above `days`: (doc_id, session)."""
    w = Window.partitionBy(*key).orderBy("date", "doc_id")
    gap = F.coalesce(F.unix_timestamp("date") - F.unix_timestamp(F.lag("date").over(w)), F.lit(0)) > days * 86_400
    return messages.withColumn("_g", gap.cast("int")).withColumn("session", F.sum("_g").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_g")


def conversations(messages: DataFrame, correspondents: DataFrame, days: int = 30) -> DataFrame:
    """Sessions of messages with the same normal subject and the same recipients: (doc_id, session)."""
    who = correspondents.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("email")), ",").alias("who"))
    keyed = messages.join(who, "doc_id", "left").withColumn("who", F.coalesce("who", F.lit(""))).withColumn("about", T.normal_subject(F.coalesce("subject", F.lit(""))))
    return sessions(keyed, ["about", "who"], days).select("doc_id", "session")


def clean_dates(messages: DataFrame) -> DataFrame:
    """Null dates become the archive's first date, dates beyond now its last one before."""
    late = F.col("date") > F.current_timestamp() + F.expr("interval 1 day")
    span = messages.where(~late).agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    return messages.join(F.broadcast(span), how="cross").withColumn("date", F.when(F.col("date").isNull(), F.col("_a")).when(late, F.col("_b")).otherwise(F.col("date"))).drop("_a", "_b")


def expired(date: Column, until: Column, years: Column, now: Column) -> Column:
    """A timed restriction is over: its date has come, or the message is old enough."""
    return F.coalesce(until <= now, F.lit(False)) | F.coalesce(F.add_months(date, (12 * years).cast("int")) <= now, F.lit(False))


def exportable(messages: DataFrame, doc_labels: DataFrame, label_defs: DataFrame, mode: str, now: str, need_permission: str | None = None) -> DataFrame:
    """Messages that a policy lets out.

    processing: all without do-not-transfer.  delivery, discovery: do-not-transfer
    needs clearance; all timed restrictions must be over and the message cleared;
    transfer-to-delivery-only bars discovery.  Other restrictions bar nothing.
    """
    d = doc_labels.join(label_defs, "label_id").join(messages.select("doc_id", "date"), "doc_id")
    timed = F.col("restriction").isin("RESTRICTED_UNTIL", "RESTRICTED_FOR_YEARS")
    over = expired(F.col("date"), F.col("until"), F.col("years"), F.lit(now).cast("timestamp"))
    has = lambda c, n: F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(n)
    flags = d.groupBy("doc_id").agg(
        has(F.col("label_id") == DO_NOT_TRANSFER, "dnt"),
        has(F.col("label_id") == CLEARED, "cleared"),
        has(F.col("label_id") == TO_DELIVERY_ONLY, "delivery_only"),
        has(timed & ~over, "timed_open"),
        has(timed, "timed"),
        has(F.col("label_id") == F.lit(need_permission), "permitted"),
    )
    m = messages.join(flags, "doc_id", "left").na.fill(0, ["dnt", "cleared", "delivery_only", "timed_open", "timed", "permitted"])
    if mode == "processing":
        ok = F.col("dnt") == 0
    else:
        cleared = F.col("cleared") == 1
        ok = ((F.col("dnt") == 0) | cleared) & ((F.col("timed") == 0) | ((F.col("timed_open") == 0) & cleared))
        if mode == "discovery":
            ok = ok & (F.col("delivery_only") == 0)
    if need_permission:
        ok = ok & (F.col("permitted") == 1)
    return m.where(ok).drop("dnt", "cleared", "delivery_only", "timed_open", "timed", "permitted")


def set_labels(doc_labels: DataFrame, doc_ids: DataFrame, label: str) -> DataFrame:
    return doc_labels.unionByName(doc_ids.select("doc_id", F.lit(label).alias("label_id"))).distinct()


def unset_labels(doc_labels: DataFrame, doc_ids: DataFrame, label: str) -> DataFrame:
    return doc_labels.join(doc_ids.select("doc_id", F.lit(label).alias("label_id")), ["doc_id", "label_id"], "left_anti")


def label_counts(label_defs: DataFrame, doc_labels: DataFrame) -> DataFrame:
    """Messages per label, labels without one as zero."""
    n = doc_labels.groupBy("label_id").agg(F.countDistinct("doc_id").alias("n"))
    return label_defs.join(n, "label_id", "left").select("label_id", "name", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "label_id")


def merge_labels(one: DataFrame, other: DataFrame) -> DataFrame:
    """Label dictionaries by name; an equal id with another name is renamed."""
    j = one.select(F.col("label_id").alias("i1"), "name").join(other.select(F.col("label_id").alias("i2"), "name"), "name", "full_outer")
    taken = one.select(F.col("label_id").alias("i2"), F.lit(True).alias("_t"))
    return j.join(taken, "i2", "left").select("name", F.coalesce("i1", F.when(F.col("_t"), F.concat("i2", F.lit("-other"))).otherwise(F.col("i2"))).alias("label_id"))


def redact(text: Column, allowed: Column) -> Column:
    """Every word that is not part of an allowed name becomes as many dots.

    `allowed`: lower-cased words of allowed names.
    """
    spaced = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), 1)  # words and what stands between them
    return F.array_join(F.transform(spaced, lambda w: F.when(w.rlike(r"^[^\p{L}\p{N}]") | F.array_contains(allowed, F.lower(w)), w).otherwise(F.repeat(F.lit("."), F.length(w)))), "")


def siblings(threads_: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Messages in the threads of the given ones, these included."""
    asked = threads_.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").select("thread_id").distinct()
    return threads_.join(asked, "thread_id", "left_semi").select("thread_id", "doc_id")


def fetched(messages: DataFrame, start: str | None = None, end: str | None = None, contact_docs: DataFrame | None = None, contacts: list | None = None, sent_by: list[str] | None = None) -> DataFrame:
    """Filter at import: days, any of some contacts, only what an own address sent."""
    from postbag.functions import dates

    out = messages.where(dates.within(F.col("date"), start, end))
    if sent_by:
        out = out.where(T.clean_email(F.col("from_email")).isin([a.lower() for a in sent_by]))
    if contacts:
        out = out.join(contact_docs.where(F.col("contact_id").isin(contacts)).select("doc_id"), "doc_id", "left_semi")
    return out


def data_errors(messages: DataFrame, recipients: DataFrame) -> DataFrame:
    """(doc_id, error) rows of an import report: no valid date, no subject, no recipient."""
    from postbag.functions import dates

    got = messages.join(recipients.select("doc_id").distinct().withColumn("_to", F.lit(True)), "doc_id", "left")
    flags = [F.when(~dates.is_valid(F.col("date")), "no date"), F.when(F.coalesce(F.trim("subject"), F.lit("")) == "", "no subject"), F.when(F.col("_to").isNull(), "no recipient")]
    return got.select("doc_id", F.explode(F.array_compact(F.array(*flags))).alias("error"))


def without_attachment_details(attachments: DataFrame) -> DataFrame:
    """Attachments as discovery shows them: shortened name, size 0."""
    return attachments.withColumn("filename", T.ellipsize(F.col("filename"), 10)).withColumn("size", F.lit(0).cast("long"))


def for_mode(messages: DataFrame, mode: str, allowed: Column | None = None) -> DataFrame:
    """Columns as an export mode shows them.  delivery masks addresses; discovery drops
    HTML, headers and original bodies and redacts subject and body to `allowed` words."""
    if mode == "delivery":
        return messages.withColumn("from_email", T.mask_domain(F.col("from_email")))
    if mode == "discovery":
        out = messages.drop("text_html", "headers", "body_original", "attachments")
        for c in ("subject", "body"):
            if c in out.columns:
                out = out.withColumn(c, redact(F.col(c), allowed))
        return out
    return messages
