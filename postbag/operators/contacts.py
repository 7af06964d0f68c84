"""Contacts: resolution by address, summaries, mailing lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postbag.functions import dates
from postbag.functions import text as T
from postbag.functions.names import BANNED_ADDRESSES
from postbag.operators.windows import numbered

# Bits of the mailing-list state.
USER_ASSIGNED, SUPER_DEFINITE, DEFINITE, MAYBE, DEFINITE_NOT = 16, 8, 1, 2, 4


def address_book(addresses: DataFrame) -> DataFrame:
    """Contacts from (name, email) rows: one per cleaned address, with its names, best name
    and a stable id (hash of the address).  Addresses of offices and lists tell no name, nor
    does a name with an @."""
    a = addresses.select(T.clean_email(F.col("email")).alias("email"), T.clean_person_name(F.col("name")).alias("name")).where("email != ''")
    own = F.lit(True)
    for begin in BANNED_ADDRESSES:
        own = own & ~F.col("email").startswith(begin)
    a = a.withColumn("name", F.when(own & (F.instr("name", "@") == 0), F.col("name")))
    named = a.groupBy("email", "name").agg(F.count("*").alias("uses"))
    score = F.struct(T.best_name_score(F.col("name")), F.col("uses"), F.col("name"))
    book = named.groupBy("email").agg(F.array_sort(F.collect_set("name")).alias("names"), F.max_by("name", score).alias("best"), F.sum("uses").alias("uses"))
    return book.select(F.xxhash64("email").alias("contact_id"), "email", "names", F.coalesce("best", "email").alias("best_name"), "uses")


def keyed(addresses: DataFrame) -> DataFrame:
    """(name, _key) of the different names of addresses, each key made once."""
    return addresses.select("name").where("name is not null").distinct().select("name", T.name_key(F.col("name")).alias("_key"))


def resolve(addresses: DataFrame, book: DataFrame) -> DataFrame:
    """Contact of each (doc_id, name, email): by address, else by an unambiguous name."""
    a = addresses.withColumn("email", T.clean_email(F.col("email")))
    by_email = book.select("email", F.col("contact_id").alias("c1"))
    names = book.select("contact_id", F.explode("names").alias("n")).select("contact_id", T.name_key(F.col("n")).alias("_key"))
    by_name = names.where("_key != ''").groupBy("_key").agg(F.countDistinct("contact_id").alias("k"), F.min("contact_id").alias("c2")).where("k = 1").drop("k")
    told = keyed(addresses).join(by_name, "_key").drop("_key")
    return a.join(by_email, "email", "left").join(told, "name", "left").withColumn("contact_id", F.coalesce("c1", "c2")).drop("c1", "c2")


def contact_docs(senders: DataFrame, receivers: DataFrame, owner_id) -> DataFrame:
    """(contact_id, doc_id, role): sent, received, received_from_owner."""
    sent = senders.select("contact_id", "doc_id", F.lit("sent").alias("role"))
    owned = senders.where(F.col("contact_id") == F.lit(owner_id)).select("doc_id").distinct().withColumn("_own", F.lit(True))
    got = receivers.join(owned, "doc_id", "left").select("contact_id", "doc_id", F.when(F.col("_own"), "received_from_owner").otherwise("received").alias("role"))
    return sent.unionByName(got).distinct()


def summaries(docs: DataFrame, messages: DataFrame) -> DataFrame:
    """Per contact: messages by role, first and last valid date."""
    ok = F.when(dates.is_valid(F.col("date")), F.col("date"))
    told = messages.groupBy("doc_id").agg(F.min(ok).alias("first"), F.max(ok).alias("last"))
    # roles are different rows and messages are one row each, so counts are sums and no row is multiplied by role
    j = docs.select("contact_id", "doc_id", "role").distinct().join(told, "doc_id")
    count = lambda r: F.sum(F.when(F.col("role") == r, 1).otherwise(0)).alias(r)
    return j.groupBy("contact_id").agg(*map(count, ("sent", "received", "received_from_owner")), F.min("first").alias("first"), F.max("last").alias("last"))


def union_roles(parts: list[DataFrame]) -> DataFrame:
    """Role rows (contact_id, doc_id, role) of several parts of an archive as one: each role of a contact in a message once."""
    out = parts[0].select("contact_id", "doc_id", "role")
    for p in parts[1:]:
        out = out.unionByName(p.select("contact_id", "doc_id", "role"))
    return out.distinct()


def ranked(summary: DataFrame) -> DataFrame:
    """Order of the correspondents page: by messages in, then by messages out."""
    keyed = summary.withColumns({"_s": -F.col("sent"), "_r": -(F.col("received") + F.col("received_from_owner"))})
    return numbered(keyed, ["_s", "_r", "contact_id"], "place").drop("_s", "_r")


def participants(docs: DataFrame, owner_id) -> DataFrame:
    """Contacts of each message without the owner."""
    return docs.where(F.col("contact_id") != F.lit(owner_id)).groupBy("doc_id").agg(F.array_sort(F.collect_set("contact_id")).alias("participants"))


def names_per_address(addresses: DataFrame) -> DataFrame:
    """Addresses with their different names, most names first."""
    a = addresses.select(T.clean_email(F.col("email")).alias("email"), T.clean_person_name(F.col("name")).alias("name"))
    return a.groupBy("email").agg(F.countDistinct("name").alias("names"), F.count("*").alias("uses")).orderBy(F.desc("names"), "email")


def mailing_list_state(messages: DataFrame, receivers: DataFrame, owner_id) -> DataFrame:
    """State bits per contact, independent of message order: a list-post header marks its
    recipients for sure; messages neither from nor to the owner make a single recipient
    likely and several possible; senders are no lists."""
    to = receivers.join(messages.select("doc_id", F.col("contact_id").alias("sender"), "list_post"), "doc_id")
    per = receivers.groupBy("doc_id").agg(F.countDistinct("contact_id").alias("k"), F.max((F.col("contact_id") == F.lit(owner_id)).cast("int")).alias("mine"))
    strange = to.join(per, "doc_id")
    bits = F.when(F.col("list_post"), SUPER_DEFINITE).when((F.col("sender") != F.lit(owner_id)) & (F.col("mine") == 0), F.when(F.col("k") == 1, DEFINITE).otherwise(MAYBE)).otherwise(0)
    got = strange.select("contact_id", bits.alias("b"))
    sent = messages.select("contact_id", F.lit(DEFINITE_NOT).alias("b"))
    return got.unionByName(sent).groupBy("contact_id").agg(F.bit_or("b").alias("ml_state"))


def merge_books(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two books: contacts that share an address with exactly one contact on either side
    become one; all others stay."""
    ea, eb = (x.select("contact_id", F.explode("emails").alias("email")) for x in (a, b))
    match = ea.join(eb.withColumnRenamed("contact_id", "other"), "email").select("contact_id", "other").distinct()
    once = match.join(match.groupBy("contact_id").count().where("count = 1").select("contact_id"), "contact_id", "left_semi").join(match.groupBy("other").count().where("count = 1").select("other"), "other", "left_semi")
    named = b.select(F.col("contact_id").alias("other"), F.col("emails").alias("e2"), F.col("names").alias("n2"))
    left = a.join(once, "contact_id", "left").join(named, "other", "left")
    none = F.expr("cast(array() as array<string>)")
    first = left.select(F.array_sort(F.array_union("emails", F.coalesce("e2", none))).alias("emails"), F.array_sort(F.array_union("names", F.coalesce("n2", none))).alias("names"))
    rest = b.join(once.select(F.col("other").alias("contact_id")), "contact_id", "left_anti").select(F.array_sort("emails").alias("emails"), F.array_sort("names").alias("names"))
    return first.unionByName(rest)


def authority_candidates(contacts: DataFrame, authorities: DataFrame) -> DataFrame:
    """Authority records whose label contains all of a contact's name (two words or more):
    joined on the name's longest word, then tested as a phrase."""
    c = contacts.select("contact_id", F.lower("best_name").alias("name")).where(F.size(F.split("name", r"\s+")) >= 2)
    c = c.withColumn("key", F.element_at(F.array_sort(F.transform(F.split("name", r"\s+"), lambda w: F.struct(F.length(w).alias("l"), w.alias("w")))), -1)["w"])
    a = authorities.select("authority_id", "label", F.explode(F.array_distinct(F.split(F.lower("label"), r"[^\p{L}\p{N}#]+"))).alias("key"))
    return c.join(a, "key").where(F.instr(F.concat(F.lit(" "), F.regexp_replace(F.lower("label"), r"[^\p{L}\p{N}#]+", " "), F.lit(" ")), F.concat(F.lit(" "), F.col("name"), F.lit(" "))) > 0).select("contact_id", "authority_id", "label").distinct()


def occurrences(addresses: DataFrame) -> DataFrame:
    """Times that each contact stands in an address field (not distinct messages)."""
    return addresses.groupBy("contact_id").agg(F.count("*").alias("n"))


def weighted(addresses: DataFrame) -> DataFrame:
    """Weight of each contact: a message gives one in equal parts to its participants."""
    n = addresses.groupBy("doc_id").agg(F.count("*").alias("k"))
    return addresses.join(n, "doc_id").groupBy("contact_id").agg(F.sum(1 / F.col("k")).alias("weight"))


def unique_masks(emails: DataFrame) -> DataFrame:
    """(email, mask): domains hidden; addresses that would look alike get ` (n)` numbers from the second on."""
    masked = emails.select("email").distinct().withColumn("m", T.mask_domain(F.col("email")))
    n = F.row_number().over(Window.partitionBy("m").orderBy("email")) - 1
    return masked.withColumn("n", n).select("email", F.when(F.col("n") == 0, F.col("m")).otherwise(F.concat("m", F.lit("("), F.col("n").cast("string"), F.lit(")"))).alias("mask"))


def set_owner(book: DataFrame, addresses: list[str]) -> DataFrame:
    """A book (contact_id, emails, names) whose contacts with any of the owner's addresses
    are one contact, under the smallest of their ids; `is_owner` tells it."""
    own = F.exists("emails", lambda e: T.clean_email(e).isin([a.strip().lower() for a in addresses]))
    mine = book.where(own)
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)  # noqa: E731  as many rows as the owner has contacts
    one = mine.groupBy().agg(F.min("contact_id").alias("contact_id"), flat("emails"), flat("names")).where("contact_id is not null")
    rest = book.where(~own).select("contact_id", "emails", "names", F.lit(False).alias("is_owner"))
    return rest.unionByName(one.withColumn("is_owner", F.lit(True)))


def confirm_authorities(confirmed: DataFrame, picks: DataFrame) -> DataFrame:
    """Records of contacts (contact_id, authority_id) after some were picked anew; a pick
    without an authority takes the contact's record away."""
    return confirmed.join(picks.select("contact_id").distinct(), "contact_id", "left_anti").unionByName(picks.where("authority_id is not null").select("contact_id", "authority_id"))
