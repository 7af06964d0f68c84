"""Faceted search: a typed specification compiled to predicates and semi-joins.

Tables (see `postbag.operators.model`): messages hold arrays of addresses,
attachments and labels; side tables are keyed by doc_id.  Attachments may be a flat side
table instead: then they are filtered as rows and joined to the messages that are left.  Filters are joined by AND;
values of one filter by OR.  A filter that is not given adds nothing to the plan, so
the candidate set is never materialised and predicates reach the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postbag.functions import dates
from postbag.functions import text as T
from postbag.plans import fulltext


@dataclass
class SearchSpec:
    """What to search for; names follow the parameters of the archive's search page."""

    term: str | None = None
    least_count: int = 1
    in_body: bool = True
    in_original: bool = False
    in_subject: bool = True
    in_attachments: bool = False
    regex: str | None = None
    case_sensitive: bool = False
    annotation: str | None = None
    annotated: bool | None = None
    sender_is: str | None = None
    contacts: list[int] = field(default_factory=list)
    correspondent: str | None = None
    roles: tuple[str, ...] = ("from", "to", "cc", "bcc")
    correspondent_list: str | None = None
    doc_ids: list | None = None
    unique_ids: str | None = None
    address: tuple[str, str] | None = None
    thread_id: int | None = None
    mailing_list: str = "either"
    email_source: str | None = None
    folder: str | None = None
    entity: str | None = None
    entity_expanded: bool = False
    entity_types: list[int] | None = None
    start: str | None = None
    end: str | None = None
    loose_date: str | None = None
    lexicon: DataFrame | None = None
    lexicon_name: str | None = None
    lexicon_caption: str | None = None
    attachment_names: list[str] | None = None
    attachment_regex: str | None = None
    attachment_ext: list[str] | None = None
    attachment_size: int | None = None
    attachment_keywords: list[str] | None = None
    accessions: list[str] | None = None
    base_accession: str = "base"
    labels: list[str] | None = None
    labels_have: bool = True
    several_restrictions: bool = False
    direction: str | None = None
    owner: str | None = None
    sort: str | None = None  # without one, hits are sorted (by date) only where a limit is given
    limit: int | None = None


#: File types known by name; `others` in a filter means none of them.
KNOWN_EXT = sorted({*T.DOCUMENT_EXT, *T.IMAGE_EXT, *T.ARCHIVE_EXT, "mp3", "ogg", "wav", "avi", "mp4", "mov"})


def any_of(values: list[str], c: Column) -> Column:
    """Lower-cased membership; null is out."""
    return F.coalesce(F.lower(c).isin([v.lower() for v in values]), F.lit(False))


def attachment_match(a: Column | dict[str, Column], spec: SearchSpec) -> Column | None:
    """All attachment conditions on one attachment (filename, ext, size, keywords), a struct or columns by name."""
    parts = []
    if spec.attachment_names:
        low = F.lower(a["filename"])
        hit = F.lit(False)
        for n in spec.attachment_names:
            hit = hit | (F.instr(low, n.lower()) > 0)
        parts.append(hit)
    if spec.attachment_regex:
        parts.append(a["filename"].rlike(f"(?i){spec.attachment_regex}"))
    if spec.attachment_ext:
        ext = F.coalesce(F.lower(a["ext"]), F.lit("unidentified"))
        hit = ext.isin([e.lower() for e in spec.attachment_ext])
        if "others" in spec.attachment_ext:
            hit = hit | ~ext.isin(KNOWN_EXT)
        parts.append(hit)
    if spec.attachment_size:
        parts.append(T.in_size_bucket(a["size"], spec.attachment_size))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def regex_found(messages: DataFrame, pattern: str, case_sensitive: bool = False, least: int = 1) -> Column:
    """Whether subject and body, each searched for itself, hold `least` matches together; empty matches do not count."""
    jvm = messages.sparkSession.sparkContext._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:  # the JVM's own error
        raise ValueError(f"not a regular expression: {pattern!r}") from e
    full = F.lit(pattern if case_sensitive else f"(?i){pattern}")
    total = F.lit(0)
    for name in ("subject", "body"):
        if name in messages.columns:
            text = F.coalesce(name, F.lit(""))
            # most texts have no match, which the search for a first one shows
            total = total + F.when(F.regexp_like(text, full), F.size(F.filter(F.regexp_extract_all(text, full, F.lit(0)), lambda x: x != ""))).otherwise(0)
    return total >= max(1, least)


def _side(tables: dict[str, DataFrame], name: str) -> DataFrame:
    if name not in tables:
        raise KeyError(f"this search needs the table {name}")
    return tables[name]


def search(tables: dict[str, DataFrame], spec: SearchSpec) -> DataFrame:
    """Messages that pass every filter, sorted; `matched` lists attachments that did."""
    m = tables["messages"]
    keep: list[Column] = []
    if spec.term:
        hits = F.lit(False)
        names = (("body", "subject") if spec.in_body and spec.in_subject else ("body",) if spec.in_body else ("body_original",) if spec.in_original else ("subject",) if spec.in_subject else ())
        if not names and not spec.in_attachments:
            names = ("body", "subject")
        if names:
            words = fulltext.query_words(spec.term)
            cols = {n: fulltext.tokens(F.col(n), words=words) for n in names if n in m.columns}
            hits = fulltext.compile_query(spec.term, cols, tuple(cols))
            if spec.least_count > 1:
                hits = hits & fulltext.at_least(list(cols.values()), spec.term, spec.least_count)
        if spec.in_attachments:
            blobs = _side(tables, "attachment_text")
            found = blobs.where(fulltext.compile_query(spec.term, {"attachment_text": fulltext.tokens(F.col("body"), words=fulltext.query_words(spec.term))}, ("attachment_text",))).select("doc_id").distinct().withColumn("_in_blob", F.lit(True))
            m = m.join(found, "doc_id", "left")
            hits = hits | F.coalesce("_in_blob", F.lit(False))
        keep.append(hits)
    if spec.regex:
        keep.append(regex_found(m, spec.regex, spec.case_sensitive, spec.least_count))
    if spec.sender_is:
        keep.append(F.get(F.transform("from", lambda a: T.clean_email(a["email"])), F.lit(0)) == spec.sender_is.lower())
    if spec.correspondent or spec.correspondent_list:
        # a list has a line per correspondent and asks for any role
        wanted = T.split_values(spec.correspondent or spec.correspondent_list.replace("\n", ";"))
        hit = F.lit(False)
        for role in spec.roles if spec.correspondent else ("from", "to", "cc", "bcc"):
            hit = hit | F.exists(role, lambda a: F.coalesce(T.clean_email(a["email"]).isin(wanted), F.lit(False)) | F.coalesce(F.lower(a["name"]).isin(wanted), F.lit(False)))
        keep.append(hit)
    if spec.address:
        name, email = spec.address
        every = F.concat("from", "to", "cc", "bcc")
        keep.append(F.exists(every, lambda a: (F.coalesce(a["name"], F.lit("")) == name) & (T.clean_email(a["email"]) == email.lower())))
    if spec.doc_ids is not None:
        keep.append(F.col("doc_id").isin(spec.doc_ids))
    if spec.unique_ids:
        keep.append(F.col("uid").isin(T.split_values(spec.unique_ids)))
    if spec.thread_id is not None and spec.thread_id != -1:
        keep.append(F.col("thread_id") == spec.thread_id)
    if spec.email_source:
        keep.append(any_of(T.split_values(spec.email_source), F.col("email_source")))
    if spec.folder:
        keep.append(any_of(T.split_values(spec.folder), F.col("folder")))
    if spec.start or spec.end:
        keep.append(dates.within(F.col("date"), spec.start, spec.end))
    if spec.loose_date:
        keep.append(dates.loose(F.col("date"), spec.loose_date))
    if spec.direction and spec.owner:
        sent = F.coalesce(T.clean_email(F.get(F.col("from"), F.lit(0))["email"]) == spec.owner.lower(), F.lit(False))
        keep.append(sent if spec.direction == "out" else ~sent)
    if spec.lexicon is not None and spec.lexicon_caption:
        entry = spec.lexicon.where((F.col("name") == spec.lexicon_name) & (F.col("caption") == spec.lexicon_caption)).select("expanded").first()
        query = entry.expanded if entry else ""
        if spec.lexicon_name == "regex" and query:
            keep.append(regex_found(m, query))
        elif query:
            query = query.replace("|", " OR ")
            cols = {n: fulltext.tokens(F.col(n), words=fulltext.query_words(query)) for n in ("body", "subject") if n in m.columns}
            keep.append(fulltext.compile_query(query, cols, tuple(cols)))
        else:
            keep.append(F.lit(False))
    nested = "attachments" in m.columns
    flat = {c: F.col(c) for c in ("filename", "ext", "size")}
    rule = attachment_match(F.col("attachments")[0] if nested else flat, spec) is not None
    if rule and nested:
        m = m.withColumn("matched", F.filter("attachments", lambda a: attachment_match(a, spec)))
        keep.append(F.size("matched") > 0)
    if spec.attachment_keywords:
        wanted = F.array(*[F.lit(k.lower()) for k in spec.attachment_keywords])
        keep.append(F.exists("attachments", lambda a: F.arrays_overlap(a["keywords"], wanted)))
    for k in keep:
        m = m.where(k)
    if rule and not nested:
        # a flat table: its rows are filtered in the scan, and only those of messages left so far are collected
        fits = _side(tables, "attachments").where(attachment_match(flat, spec)).join(m.select("doc_id"), "doc_id", "left_semi")
        m = m.join(fits.groupBy("doc_id").agg(F.collect_list(F.struct("filename", "ext", "size")).alias("matched")), "doc_id")

    if spec.annotation or spec.annotated is not None:
        notes = _side(tables, "annotations").where("trim(text) != ''")
        if spec.annotation:
            hit = F.lit(False)
            for part in T.split_values(spec.annotation):
                hit = hit | (F.instr(F.lower("text"), part) > 0)
            m = m.join(notes.where(hit).select("doc_id"), "doc_id", "left_semi")
        if spec.annotated is not None:
            m = m.join(notes.select("doc_id"), "doc_id", "left_semi" if spec.annotated else "left_anti")
    for contact in spec.contacts:  # each must take part
        m = m.join(_side(tables, "contact_docs").where(F.col("contact_id") == contact).select("doc_id"), "doc_id", "left_semi")
    if spec.mailing_list in ("yes", "no"):
        lists = _side(tables, "contacts").where("ml_state & 24 != 0").select("contact_id")
        on_list = _side(tables, "contact_docs").join(lists, "contact_id", "left_semi").select("doc_id")
        m = m.join(on_list, "doc_id", "left_semi" if spec.mailing_list == "yes" else "left_anti")
    if spec.entity:
        keys = [" ".join(sorted(w for w in re.split(r"[\s\".;,\-#@&()]+", e) if w)) for e in T.split_values(spec.entity)]
        mentions = _side(tables, "mentions").withColumn("cname", T.entity_key(F.col("text")))
        if spec.entity_expanded:
            aliases = _side(tables, "entity_aliases")
            groups = aliases.where(F.col("alias").isin(keys)).select("type", "cname")
            more = aliases.join(groups, ["type", "cname"], "left_semi").select(F.col("alias").alias("cname"))
            hit = mentions.join(more, "cname", "left_semi").select("doc_id").union(mentions.where(F.col("cname").isin(keys)).select("doc_id"))
        else:
            hit = mentions.where(F.col("cname").isin(keys)).select("doc_id")
        m = m.join(hit, "doc_id", "left_semi")
    if spec.entity_types:
        m = m.join(_side(tables, "mentions").where(F.col("type").isin(spec.entity_types)).select("doc_id"), "doc_id", "left_semi")
    if spec.accessions:
        m = m.join(_side(tables, "accessions").select("doc_id", F.col("accession_id").alias("_acc")), "doc_id", "left")
        m = m.where(F.coalesce("_acc", F.lit(spec.base_accession)).isin(spec.accessions)).drop("_acc")
    if spec.labels is not None:
        held = _side(tables, "doc_labels").where(F.col("label_id").isin(spec.labels)).select("doc_id")
        m = m.join(held, "doc_id", "left_semi" if spec.labels_have else "left_anti")
    elif spec.several_restrictions:
        several = _side(tables, "doc_labels").join(_side(tables, "label_defs").where("type = 'RESTRICTION'").select("label_id"), "label_id", "left_semi").groupBy("doc_id").agg(F.countDistinct("label_id").alias("n")).where("n > 1").select("doc_id")
        m = m.join(several, "doc_id", "left_semi")
    m = m.drop("_in_blob")
    return ordered(m, spec.sort, spec.limit, spec.term)


def count_hits(tables: dict[str, DataFrame], spec: SearchSpec) -> DataFrame:
    """A row: how many messages pass, without the sort."""
    return search(tables, spec).groupBy().agg(F.count("*").alias("hits"))


def ordered(m: DataFrame, sort: str | None = None, limit: int | None = None, term: str | None = None) -> DataFrame:
    """Sorted by date, subject and id (recent: newest first; relevance: occurrences first); as they come if neither a sort nor a limit is asked for."""
    if sort is None and limit is None:
        return m
    rest = [c for c in ("subject", "doc_id") if c in m.columns]
    if sort == "recent":
        m = m.orderBy(F.desc("date"), *rest)
    elif sort == "relevance" and term:
        toks = fulltext.tokens(F.col("body"), words=fulltext.query_words(term))
        score = sum((fulltext.occurrences(toks, w) for w in term.split()), F.lit(0))
        m = m.withColumn("score", score).orderBy(F.desc("score"), "date", *rest)
    else:
        m = m.orderBy("date", *rest)
    return m.limit(limit) if limit else m
