"""Operators on a whole archive: side tables of messages, edits, removal, merging, direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postbag.functions import dates
from postbag.functions import text as T
from postbag.operators import contacts
from postbag.operators import messages as M

# Bits of a message's direction, characters of a body that are indexed.
SENT, RECEIVED = 1, 2
INDEXED_CHARS = 32_766


def with_annotation(messages: DataFrame, annotations: DataFrame) -> DataFrame:
    """Messages with their note, empty where there is none."""
    notes = annotations.select("doc_id", F.col("text").alias("annotation"))
    return messages.join(notes, "doc_id", "left").withColumn("annotation", F.coalesce("annotation", F.lit("")))


def with_accession(messages: DataFrame, accessions: DataFrame, base: str = "base") -> DataFrame:
    """Messages with the accession they came in by; those of none belong to the base."""
    return messages.join(accessions.select("doc_id", "accession_id"), "doc_id", "left").withColumn("accession_id", F.coalesce("accession_id", F.lit(base)))


def with_attachment_hits(messages: DataFrame, attachments: DataFrame, hits: DataFrame) -> DataFrame:
    """Messages that hold a hit attachment (blob_id), with the sorted list of those."""
    found = attachments.join(hits.select("blob_id").distinct(), "blob_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_set("blob_id")).alias("matched"))
    return messages.join(found, "doc_id")


def documents_of(messages: DataFrame, hits: DataFrame) -> DataFrame:
    """Messages of hit ids; ids without a message are dropped."""
    return messages.join(hits.select("doc_id"), "doc_id", "left_semi")


def link_mentions(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions with the entity that has their type and canonical name among its aliases (type, alias, entity)."""
    keyed = mentions.withColumn("alias", T.entity_key(F.col("text")))
    return keyed.join(aliases.select("type", "alias", "entity").distinct(), ["type", "alias"]).drop("alias")


def documents_of_entities(linked: DataFrame, entities: list[str]) -> DataFrame:
    return linked.where(F.col("entity").isin(entities)).select("doc_id").distinct()


def message_contacts(addresses: DataFrame, book: DataFrame) -> DataFrame:
    """(doc_id, contact_id) of all addresses: by email, else every contact of that name."""
    a = addresses.select("doc_id", T.clean_email(F.col("email")).alias("email"), "name")
    by_email = book.select(T.clean_email(F.col("email")).alias("email"), F.col("contact_id").alias("_c")).distinct()
    found = a.join(by_email, "email", "left")
    named = book.select("contact_id", F.explode("names").alias("n")).select("contact_id", T.name_key(F.col("n")).alias("_key")).where("_key != ''").distinct()
    told = contacts.keyed(addresses).join(named, "_key").select("name", "contact_id")
    rest = found.where("_c is null").join(told, "name").select("doc_id", "contact_id")
    return found.where("_c is not null").select("doc_id", F.col("_c").alias("contact_id")).unionByName(rest).distinct()


def direction(contact_docs: DataFrame, messages: DataFrame, owner_id=None) -> DataFrame:
    """(doc_id, bits): sent by the owner, received by the owner, or both; a message that
    is neither counts as received, and without a known owner every message as sent."""
    if owner_id is None:
        return messages.select("doc_id", F.lit(SENT).alias("bits"))
    own = contact_docs.where(F.col("contact_id") == F.lit(owner_id)).groupBy("doc_id").agg(F.bit_or(F.when(F.col("role") == "sent", SENT).otherwise(RECEIVED)).alias("bits"))
    return messages.select("doc_id").join(own, "doc_id", "left").select("doc_id", F.coalesce("bits", F.lit(RECEIVED)).alias("bits"))


def indexed_body(body: Column) -> Column:
    """What of a body goes into the index."""
    return F.substring(body, 1, INDEXED_CHARS)


def edit_bodies(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """Bodies replaced by those of `edits` (doc_id, body); `body_preserved` keeps the first one."""
    if "body_preserved" not in messages.columns:
        messages = messages.withColumn("body_preserved", F.lit(None).cast("string"))
    new = edits.select("doc_id", F.col("body").alias("_new"))
    j = messages.join(new, "doc_id", "left")
    kept = F.when(F.col("_new").isNotNull(), F.coalesce("body_preserved", "body")).otherwise(F.col("body_preserved"))
    return j.withColumn("body_preserved", kept).withColumn("body", F.coalesce("_new", "body")).drop("_new")


def put(messages: DataFrame, batch: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add messages, or put them in the place of those with an equal key."""
    return messages.join(batch.select(key), key, "left_anti").unionByName(batch)


def remove(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """Mark messages as removed; they stay until the archive is written anew."""
    return _marked(messages, ids, True)


def restore(messages: DataFrame, ids: DataFrame) -> DataFrame:
    return _marked(messages, ids, False)


def _marked(messages: DataFrame, ids: DataFrame, state: bool) -> DataFrame:
    before = F.col("removed") if "removed" in messages.columns else F.lit(False)
    hit = ids.select("doc_id").distinct().withColumn("_hit", F.lit(True))
    return messages.withColumn("removed", before).join(hit, "doc_id", "left").withColumn("removed", F.when(F.col("_hit"), F.lit(state)).otherwise(F.col("removed"))).drop("_hit")


def live(messages: DataFrame) -> DataFrame:
    return messages.where("not removed") if "removed" in messages.columns else messages


def merge_archives(one: dict[str, DataFrame], other: dict[str, DataFrame], accession: str, key: str = "uid") -> dict[str, DataFrame]:
    """Two archives as one: messages of the other that this one lacks come in under
    `accession`, with their labels and notes; a lexicon of a name that is taken stays out."""
    new = M.new_only(other["messages"], one["messages"], key)
    ids = new.select("doc_id")
    out = {"messages": one["messages"].unionByName(new), "accessions": one["accessions"].unionByName(ids.withColumn("accession_id", F.lit(accession)))}
    for name in ("doc_labels", "annotations"):
        if name in one and name in other:
            out[name] = one[name].unionByName(other[name].join(ids, "doc_id", "left_semi"))
    if "lexicon" in one and "lexicon" in other:
        out["lexicon"] = one["lexicon"].unionByName(other["lexicon"].join(one["lexicon"].select("name").distinct(), "name", "left_anti"))
    return out


def merged_field(a: Column, b: Column) -> Column:
    """A field of two collections' descriptions: what one has, or both joined by + where they differ."""
    return F.when(a.isNull() | b.isNull(), F.coalesce(a, b)).when(a == b, a).otherwise(F.concat(a, F.lit("+"), b))


def attachment_content(attachments: DataFrame, filename: str) -> DataFrame:
    """Attachments of a file name, whatever message they hang on."""
    return attachments.where(F.col("filename") == filename)


def image_keywords(attachments: DataFrame, metadata: DataFrame) -> DataFrame:
    """(blob_id, keyword): comma-separated keywords of image files (file, keywords) for the
    attachments that have the file's name, whatever case; all attachments of that name get them."""
    meta = metadata.select(F.lower("file").alias("_name"), F.explode(F.split("keywords", ",")).alias("keyword")).distinct()
    return attachments.withColumn("_name", F.lower("filename")).join(meta, "_name").select("blob_id", "keyword").distinct()


def attachments_between(attachments: DataFrame, messages: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Attachments of messages of some days."""
    return attachments.join(messages.where(dates.within(F.col("date"), start, end)).select("doc_id"), "doc_id", "left_semi")


def date_range(messages: DataFrame, hacky: Column | None = None) -> DataFrame:
    """A row: first and last date, stand-in dates and untrusted ones left out."""
    ok = dates.is_valid(F.col("date"))
    if hacky is not None:
        ok = ok & ~F.coalesce(hacky, F.lit(False))
    return messages.where(ok).agg(F.min("date").alias("first"), F.max("date").alias("last"))
