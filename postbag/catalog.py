"""All queries over the provided tables, with the SQL each is checked against.

Keys carry the id of the operator that a query shows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag.functions import collections, dates
from postbag.functions import text as T
from postbag.operators import contacts, entities, facets, messages
from postbag.operators.model import OWNER, VIEWS, attachments, heads, read, recipients
from postbag.plans import fulltext
from postbag.plans.search import SearchSpec, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: bool = True):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = (VIEWS + sql) if views else sql
        return f

    return add


def people(h: DataFrame, receivers: DataFrame) -> DataFrame:
    """Heads with arrays of people by role."""
    to = receivers.groupBy("doc_id").agg(F.collect_list(F.struct("name", "email")).alias("to"))
    none = F.expr("cast(array() as array<struct<name:string,email:string>>)")
    return h.join(to, "doc_id", "left").withColumn("from", F.array(F.struct(F.col("from_name").alias("name"), F.col("from_email").alias("email")))).withColumn("to", F.coalesce("to", none)).withColumn("cc", none).withColumn("bcc", none)


def archive(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The viewed archive in the shape that `search` reads."""
    h = heads(spark, sf_dir)
    att = attachments(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(F.struct("filename", "ext", "size")).alias("attachments"))
    m = people(h, recipients(spark, sf_dir)).join(att, "doc_id", "left")
    docs = contacts.contact_docs(h.select("contact_id", "doc_id"), recipients(spark, sf_dir).select((-F.col("contact_id")).alias("contact_id"), "doc_id"), 1)
    return {"messages": m, "contact_docs": docs, "doc_labels": h.select("doc_id", F.col("label").alias("label_id")), "annotations": h.where("amount > 300000").select("doc_id", F.concat(F.lit("large "), F.col("label")).alias("text")), "accessions": h.where("doc_id % 4 = 0").select("doc_id", F.lit("acc-1").alias("accession_id"))}


def _flat(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The viewed archive with attachments as a flat table: nothing is grouped before the filters."""
    h = heads(spark, sf_dir)
    return {"messages": h, "attachments": attachments(spark, sf_dir), "doc_labels": h.select("doc_id", F.col("label").alias("label_id"))}


def _hits(spec: SearchSpec):
    # searches by attachment alone need no arrays of people
    flat = any((spec.attachment_names, spec.attachment_ext, spec.attachment_regex, spec.attachment_size)) and not spec.direction
    return lambda spark, sf: search((_flat if flat else archive)(spark, sf), spec).select("doc_id", "subject", "folder")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faceted search: order mail of one folder and year with a PDF, by sender."""
    spec = SearchSpec(folder="mail/F", start="1995-01-01", end="1996-12-31", attachment_ext=["pdf"], labels=["1-URGENT", "2-HIGH"], term="order", in_body=False)
    return search(_flat(spark, sf_dir), spec).select("doc_id", "date", "subject", "folder", "from_email", F.size("matched").alias("matched"))


query("search_flagship", """
select h.doc_id, h.date, h.subject, h.folder, h.from_email, count(*) as matched from heads h join attachments a using (doc_id)
where lower(h.folder) = 'mail/f' and h.date >= timestamp '1995-01-01' and h.date < timestamp '1997-01-01' and label in ('1-URGENT', '2-HIGH') and a.ext = 'pdf' group by all""")(flagship)

_SEARCHES = {
    "O_FLT_01_term_subject": (SearchSpec(term="urgent", in_body=False), "regexp_matches(lower(subject), 'urgent')"),
    "O_FLT_03_annotation": (SearchSpec(annotation="large; huge"), "amount > 300000"),
    "O_FLT_04_sender": (SearchSpec(sender_is=OWNER), f"from_email = '{OWNER}'"),
    "O_FLT_05_contact": (SearchSpec(contacts=[1]), "contact_id = 1"),
    "O_FLT_06_correspondent": (SearchSpec(correspondent="supplier#000000001@supply.example;supplier#000000002", roles=("to",)), "exists (select 1 from recipients r where r.doc_id = heads.doc_id and (r.email = 'supplier#000000001@supply.example' or lower(r.name) = 'supplier#000000002'))"),
    "O_FLT_08_doc_ids": (SearchSpec(doc_ids=[1, 2, 3, 32, 33, 34]), "doc_id in (1, 2, 3, 32, 33, 34)"),
    "O_FLT_13_email_source": (SearchSpec(email_source="Building; MACHINERY"), "email_source in ('BUILDING', 'MACHINERY')"),
    "O_FLT_14_folder": (SearchSpec(folder="MAIL/o"), "folder = 'mail/O'"),
    "O_FLT_17_date_range": (SearchSpec(start="1996-02-01", end="1996-02-29"), "date >= timestamp '1996-02-01' and date < timestamp '1996-03-01'"),
    "O_FLT_24_not_annotated": (SearchSpec(annotated=False), "not amount > 300000"),
    "O_FLT_25_accession_default": (SearchSpec(accessions=["base"]), "doc_id % 4 <> 0"),
    "O_FLT_27_labels_not": (SearchSpec(labels=["1-URGENT", "5-LOW"], labels_have=False), "label not in ('1-URGENT', '5-LOW')"),
    "O_FLT_28_attachment_ext_others": (SearchSpec(attachment_ext=["others", "zip"]), "exists (select 1 from attachments a where a.doc_id = heads.doc_id and (a.ext is null or a.ext = 'zip'))"),
    "O_FLT_28_attachment_name_regex": (SearchSpec(attachment_regex=r"^PART1\d\.pdf$"), "exists (select 1 from attachments a where a.doc_id = heads.doc_id and regexp_matches(a.filename, '^part1[0-9][.]pdf$'))"),
    "O_FLT_29_attachment_size": (SearchSpec(attachment_size=2), "exists (select 1 from attachments a where a.doc_id = heads.doc_id and a.size between 5120 and 20480)"),
    "O_FLT_38_loose_dates": (SearchSpec(loose_date="aug-sep"), "month(date) in (8, 9)"),
    "O_FLT_31_conjunction": (SearchSpec(folder="mail/F", labels=["3-MEDIUM"], direction="in", owner=OWNER, attachment_size=4), f"folder = 'mail/F' and label = '3-MEDIUM' and from_email <> '{OWNER}' and exists (select 1 from attachments a where a.doc_id = heads.doc_id and a.size between 102400 and 2097152)"),
}
for _name, (_spec, _where) in _SEARCHES.items():
    if _spec:
        query(_name, f"select doc_id, subject, folder from heads where {_where}")(_hits(_spec))


@query("O_FLT_02_regex_body", r"select doc_id, lang from documents where regexp_matches(text || chr(10) || source, '(?i)\b(idiot|moron|feed)\b')", views=False)
def _regex(spark, sf):
    m = read(spark, sf, "documents").select("doc_id", "lang", F.col("source").alias("subject"), F.col("text").alias("body"), F.lit(None).cast("timestamp").alias("date"))
    return search({"messages": m}, SearchSpec(regex=r"\b(IDIOT|moron|feed)\b")).select("doc_id", "lang")


@query("O_FLT_36_day_parts", "select doc_id from heads where year(date) = 1997 and day(date) = 4")
def _parts(spark, sf):
    return heads(spark, sf).where(dates.day_parts(F.col("date"), 1997, None, 4)).select("doc_id")


@query("O_FLT_43_sane_text", r"select doc_id, not regexp_matches(coalesce(text, ''), '[^\s]{1000}[^\s]+') as sane from documents", views=False)
def _sane(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.looks_sane(F.col("text")).alias("sane"))


@query("O_JOIN_01_contacts_by_email", "select doc_id, contact_id, email from recipients")
def _join01(spark, sf):
    book = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("contact_id"), F.concat(F.lower("s_name"), F.lit("@supply.example")).alias("email"), F.array("s_name").alias("names"))
    rows = recipients(spark, sf).select("doc_id", "name", F.concat(F.lit(" '"), F.upper("email"), F.lit("' ")).alias("email"))
    return contacts.resolve(rows, book).select("doc_id", "contact_id", "email")


@query("O_JOIN_04_labels_annotations", "select doc_id, label, case when amount > 300000 then 'large ' || label else '' end as note from heads")
def _join04(spark, sf):
    a = archive(spark, sf)
    return heads(spark, sf).select("doc_id", "label").join(a["annotations"], "doc_id", "left").select("doc_id", "label", F.coalesce("text", F.lit("")).alias("note"))


@query("O_JOIN_12_dedup_on_ingest", "select doc_id from heads where folder = 'mail/O'")
def _join12(spark, sf):
    all_ = messages.with_uid(heads(spark, sf))
    return messages.new_only(all_, all_.where("folder <> 'mail/O'")).select("doc_id")


@query("O_JOIN_13_merge", "select folder, count(*) as n from heads group by folder")
def _join13(spark, sf):
    all_ = messages.with_uid(heads(spark, sf))
    return messages.merge(all_.where("doc_id % 3 <> 0"), all_.where("doc_id % 2 = 0 or doc_id % 3 = 0")).groupBy("folder").agg(F.count("*").alias("n"))


@query("O_JOIN_19_participants", "select doc_id, cast(count(distinct contact_id) as bigint) as n from recipients where contact_id <> 1 group by doc_id")
def _join19(spark, sf):
    return contacts.participants(recipients(spark, sf), 1).select("doc_id", F.size("participants").cast("long").alias("n"))


@query("O_PRJ_02_identity", "select doc_id, sha256(strftime(date, '%Y-%m-%d %H:%M') || chr(1) || from_email || chr(1) || subject || chr(1) || doc_id) as uid from heads")
def _prj02(spark, sf):
    return messages.with_uid(heads(spark, sf)).select("doc_id", "uid")


@query("O_PRJ_08_masking", "select doc_id, '...@...' as full_mask, split_part(from_email, '@', 1) || '@...' as domain_mask from heads")
def _prj08(spark, sf):
    return heads(spark, sf).select("doc_id", T.mask_email(F.col("from_email")).alias("full_mask"), T.mask_domain(F.col("from_email")).alias("domain_mask"))


@query("O_PRJ_12_links", r"""select page_id, list_distinct(list_transform(regexp_extract_all(html, '(https?://[^\s<>"'']+)', 1), lambda x: regexp_replace(x, '[.,;:!?)\]]+$', ''))) as l from pages""", views=False)
def _prj12(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.links(F.col("html")).alias("l"))


ORACLE_SQL["O_PRJ_12_links"] = ORACLE_SQL["O_PRJ_12_links"].replace("select page_id, ", "select page_id, list_sort(", 1).replace("'')))", "'')))", 1).replace(" as l from", ") as l from", 1)
QUERIES["O_PRJ_12_links"] = lambda spark, sf: _prj12(spark, sf).withColumn("l", F.array_sort("l"))


@query("O_AGG_01_message_facets", """
select facet, value, count(distinct doc_id) as n from (
  select doc_id, 'folder' as facet, folder as value from heads union all select doc_id, 'label', label from heads union all select doc_id, 'source', email_source from heads
  union all select doc_id, 'sender', from_email from heads union all select doc_id, 'attachment', coalesce(ext, 'unidentified') from attachments) group by all""")
def _agg01(spark, sf):
    return facets.message_facets(heads(spark, sf), attachments(spark, sf))


@query("O_AGG_03_folder_facet", "select folder as value, count(*) as n, split_part(folder, '/', 2) as display from heads group by folder")
def _agg03(spark, sf):
    return facets.by_folder(heads(spark, sf))


@query("O_AGG_04_direction", f"select case when from_email = '{OWNER}' then 'out' else 'in' end as value, count(*) as n from heads group by all")
def _agg04(spark, sf):
    return facets.by_direction(heads(spark, sf), OWNER)


@query("O_AGG_05_annotation_facet", "select case when amount > 300000 then 'annotated' else 'not annotated' end as value, count(*) as n from heads group by all")
def _agg05(spark, sf):
    return facets.by_annotation(heads(spark, sf), archive(spark, sf)["annotations"])


@query("O_AGG_06_accession_facet", "select case when doc_id % 4 = 0 then 'acc-1' else 'base' end as value, count(*) as n from heads group by all")
def _agg06(spark, sf):
    return facets.by_accession(heads(spark, sf), archive(spark, sf)["accessions"], "base")


@query("O_AGG_08_attachment_facet", "select coalesce(ext, 'unidentified') as value, count(distinct doc_id) as n from attachments group by all")
def _agg08(spark, sf):
    return facets.by_attachment_type(attachments(spark, sf))


@query("O_AGG_09_attachments_by_type", "select coalesce(ext, 'unidentified') as value, count(*) as n from attachments group by all")
def _agg09(spark, sf):
    return facets.attachments_by_type(attachments(spark, sf))


@query("O_AGG_10_size_facet", "select case when size < 5120 then 1 when size < 20480 then 2 when size < 102400 then 3 when size < 2097152 then 4 else 5 end as value, count(*) as n from attachments group by all")
def _agg10(spark, sf):
    return facets.attachments_by_size(attachments(spark, sf))


@query("O_AGG_11_contact_summaries", """
, roles as (select contact_id, doc_id, 'sent' as role from heads
  union select -r.contact_id, r.doc_id, case when h.contact_id = 1 then 'received_from_owner' else 'received' end from recipients r join heads h using (doc_id))
select roles.contact_id, count(distinct case when role = 'sent' then doc_id end) as sent, count(distinct case when role = 'received' then doc_id end) as received,
  count(distinct case when role = 'received_from_owner' then doc_id end) as received_from_owner, min(date) as first, max(date) as last
from roles join (select doc_id, date from heads) using (doc_id) group by roles.contact_id""")
def _agg11(spark, sf):
    return contacts.summaries(archive(spark, sf)["contact_docs"], heads(spark, sf))


@query("O_AGG_12_interval_histogram", "select case when date <= timestamp '1994-01-01' then 0 when date <= timestamp '1996-01-01' then 1 else 2 end as interval, count(*) as n from heads where date >= timestamp '1992-01-01' and date <= timestamp '1998-01-01' group by all")
def _agg12(spark, sf):
    return facets.over_intervals(heads(spark, sf), ["1992-01-01", "1994-01-01", "1996-01-01", "1998-01-01"])


@query("O_AGG_20_label_counts", "select label as label_id, label as name, count(*) as n from heads group by all union all select 'none', 'none', 0")
def _agg20(spark, sf):
    held = archive(spark, sf)["doc_labels"]
    defs = held.select("label_id").distinct().union(spark.range(1).select(F.lit("none"))).select("label_id", F.col("label_id").alias("name"))
    return messages.label_counts(defs, held)


@query("O_AGG_23_collection_summary", f"""
select * from (select count(*) as messages, count(*) filter (from_email = '{OWNER}') as sent, count(*) filter (from_email <> '{OWNER}') as received, min(date) as first, max(date) as last from heads),
 (select count(*) as attachments, count(*) filter (ext = 'jpg') as images, count(*) filter (ext in ('pdf', 'doc')) as documents, count(*) filter (ext = 'zip') as archives, cast(sum(size) as bigint) as bytes from attachments)""")
def _agg23(spark, sf):
    return facets.collection_summary(heads(spark, sf), attachments(spark, sf), OWNER)


@query("O_AGG_25_yearly_attachments", "select cast(year(date) as integer) as year, count(*) as n from heads join attachments using (doc_id) group by all")
def _agg25(spark, sf):
    return facets.yearly_attachments(heads(spark, sf), attachments(spark, sf))


@query("O_AGG_27_unique_blobs", "select cast(sum(n) as bigint) as attachments, count(*) as distinct_attachments, cast(sum(n * size) as bigint) as bytes, cast(sum(size) as bigint) as distinct_bytes from (select content, filename, size, count(*) as n from attachments group by all)")
def _agg27(spark, sf):
    return facets.unique_blobs(attachments(spark, sf))


@query("O_AGG_31_month_clusters", "select date_trunc('month', date) as period, cast(count(*) as bigint) as n from heads group by all")
def _agg31(spark, sf):
    return facets.clusters(heads(spark, sf)).select("period", F.size("doc_ids").cast("long").alias("n"))


@query("O_AGG_33_stacked_months", """
, top as (select label from heads group by label order by count(distinct doc_id) desc, label limit 3),
months as (select unnest(generate_series(min(date_trunc('month', date)), max(date_trunc('month', date)), interval 1 month)) as month from heads),
n as (select label, date_trunc('month', date) as month, count(*) as n from heads group by all)
select label, cast(month as timestamp) as month, coalesce(n.n, 0) as n from top cross join months left join n using (label, month)""")
def _agg33(spark, sf):
    return facets.stacked_months(heads(spark, sf), "label", 3)


@query("O_AGG_35_folder_table", f"select folder, count(*) filter (from_email <> '{OWNER}') as received, count(*) filter (from_email = '{OWNER}') as sent, count(*) as total, arg_max(email_source, (date, doc_id)) as source from heads group by folder")
def _agg35(spark, sf):
    return facets.folder_table(heads(spark, sf), OWNER)


@query("O_AGG_36_names_per_address", "select email, count(distinct name) as names, count(*) as uses from recipients group by email")
def _agg36(spark, sf):
    return contacts.names_per_address(recipients(spark, sf))


@query("O_WIN_01_threads", """
, who as (select doc_id, string_agg(distinct email, ',' order by email) as who from recipients group by doc_id),
k as (select doc_id, date, lower(regexp_replace(subject, '^Re: ', '')) || '|' || coalesce(who, '') as k from heads left join who using (doc_id)),
f as (select k, min((date, doc_id)) as f from k group by k), r as (select k, row_number() over (order by f) as thread_id from f)
select doc_id, thread_id from k join r using (k)""")
def _win01(spark, sf):
    return messages.threads(heads(spark, sf), recipients(spark, sf))


@query("O_WIN_02_sessions", """
, who as (select doc_id, string_agg(distinct email, ',' order by email) as who from recipients group by doc_id),
k as (select doc_id, date, lower(regexp_replace(subject, '^Re: ', '')) as about, coalesce(who, '') as who from heads left join who using (doc_id)),
g as (select *, case when date_diff('second', lag(date) over w, date) > 30 * 86400 then 1 else 0 end as g from k window w as (partition by about, who order by date, doc_id))
select doc_id, cast(sum(g) over (partition by about, who order by date, doc_id rows unbounded preceding) as bigint) as session from g""")
def _win02(spark, sf):
    return messages.conversations(heads(spark, sf), recipients(spark, sf))


@query("O_WIN_05_file_numbers", """
select blob_id, case when n = 0 then filename else 'part' || content || ' (' || n || ')' || coalesce('.' || ext, '') end as export_name
from (select *, row_number() over (partition by lower(filename) order by blob_id) - 1 as n from attachments)""")
def _win05(spark, sf):
    return facets.filename_numbers(attachments(spark, sf)).select("blob_id", "export_name")


@query("O_WIN_06_keep_first", "select contact_id, arg_min(doc_id, (date, doc_id)) as doc_id from heads group by contact_id")
def _win06(spark, sf):
    return messages.dedup(heads(spark, sf), ["contact_id"], ["date", "doc_id"]).select("contact_id", "doc_id")


@query("O_SRT_05_autocomplete", "select distinct from_name from heads where contains(lower(from_name), '00012') order by 1 limit 5")
def _srt05(spark, sf):
    return facets.autocomplete(heads(spark, sf), "from_name", "00012")


@query("O_SRT_07_nearest_date", "select doc_id, date from heads order by abs(epoch(date) - epoch(timestamp '1995-06-17')), doc_id limit 1")
def _srt07(spark, sf):
    return facets.nearest_date(heads(spark, sf), "1995-06-17").select("doc_id", "date")


@query("O_STR_01_clean_email", "select c_custkey, lower(c_name) || '@x.org' as email from customer", views=False)
def _str01(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", T.clean_email(F.concat(F.lit("  \"' "), F.col("c_name"), F.lit("@X.org '\" "))).alias("email"))


@query("O_STR_05_entity_key", "select p_partkey, array_to_string(list_sort(list_filter(string_split_regex(lower(p_name), '[\\s\".;,\\-#@&()]+'), lambda w: w <> '')), ' ') as k from part", views=False)
def _str05(spark, sf):
    return read(spark, sf, "part").select("p_partkey", T.entity_key(F.col("p_name")).alias("k"))


@query("O_STR_15_extension", "select blob_id, ext, case when ext = 'jpg' then 'image' when ext = 'doc' then 'office' when ext = 'pdf' then 'document' when ext = 'zip' then 'archive' else 'other' end as kind from attachments")
def _str15(spark, sf):
    return attachments(spark, sf).select("blob_id", T.extension(F.col("filename")).alias("ext"), T.file_class(T.extension(F.col("filename"))).alias("kind"))


@query("O_DAT_01_date_parts", "select doc_id, date_trunc('month', date) as month, date_trunc('quarter', date) as quarter, cast((1998 - year(date)) * 12 + 1 - month(date) as integer) as months from heads")
def _dat01(spark, sf):
    c = F.col("date")
    return heads(spark, sf).select("doc_id", dates.month(c).alias("month"), dates.quarter_start(c).alias("quarter"), dates.months_apart(c, F.lit("1998-01-01").cast("date")).alias("months"))


@query("O_TXT_06_boolean_query", r"""
with t as (select doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w from documents)
select doc_id from t where list_contains(w, 'idiot') or list_contains(w, 'trash') and not list_contains(w, 'moron')""", views=False)
def _txt06(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", fulltext.tokens(F.col("text"), stemmed=False).alias("body"))
    return d.where(fulltext.compile_query("idiot OR (trash AND NOT moron)", {"body": F.col("body")}, ("body",))).select("doc_id")


@query("O_TXT_06_phrase_query", r"""
with t as (select doc_id, ' ' || array_to_string(list_transform(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''), lambda w: case when w in ('a', 'an', 'and', 'are', 'as', 'at', 'be', 'but', 'by', 'for', 'if', 'in', 'into', 'is', 'it', 'no', 'of', 'on', 'or', 'such', 'that', 'the', 'their', 'then', 'there', 'these', 'they', 'this', 'to', 'was', 'will', 'with') then '#' else w end), ' ') || ' ' as w from documents)
select doc_id from t where contains(w, ' under # apache license ')""", views=False)
def _txt06p(spark, sf):
    asked = '"under the Apache licenses"'
    d = read(spark, sf, "documents").select("doc_id", fulltext.tokens(F.col("text"), words=fulltext.query_words(asked)).alias("body"))
    return d.where(fulltext.compile_query(asked, {"body": F.col("body")}, ("body",))).select("doc_id")


@query("O_TXT_15_term_counts", r"""
with t as (select doc_id, list_distinct(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) as w from documents)
select term, count(doc_id) as n from (values ('idiot'), ('trash'), ('license'), ('zzzz')) v(term) left join t on list_contains(w, term) group by term""", views=False)
def _txt15(spark, sf):
    terms = spark.range(1).select(F.explode(F.array(*map(F.lit, ["idiot", "trash", "license", "zzzz"]))).alias("term")).select("term", F.lit(1.0).alias("page_score"), F.lit(1.0).alias("boost"))
    return entities.lens(read(spark, sf, "documents"), terms).select("term", F.col("index_score").alias("n"))


@query("O_AGG_21_lexicon", r"""
with t as (select doc_id, string_split_regex(lower(text), '[^\p{L}\p{N}]+') as w from documents),
f as (select doc_id, list_contains(w, 'idiot') or list_contains(w, 'moron') as insult, list_contains(w, 'trash') or list_contains(w, 'scum') as dirt from t)
select caption, count(*) as n from (select 'insult' as caption from f where insult union all select 'dirt' from f where dirt union all select 'None' from f where not insult and not dirt) group by caption""", views=False)
def _agg21(spark, sf):
    return entities.lexicon_hits(read(spark, sf, "documents"), {"insult": "idiot|moron", "dirt": "trash|scum"}).groupBy("caption").agg(F.count("*").alias("n"))


@query("O_AGG_17_entity_book")
def _agg17(spark, sf):
    return entities.entity_book(entities.mentions(read(spark, sf, "documents")))


@query("O_SRT_03_top_entities")
def _srt03(spark, sf):
    return entities.top_entities(entities.entity_book(entities.mentions(read(spark, sf, "documents"))), 50, 100)


@query("O_NER_01_mentions")
def _ner01(spark, sf):
    return entities.mentions(read(spark, sf, "documents"))


@query("O_POL_03_processing_export", "select doc_id from heads where label <> '5-LOW'")
def _pol03(spark, sf):
    m, d, defs = _policy(spark, sf)
    return messages.exportable(m, d, defs, "processing", "2000-01-01").select("doc_id")


@query("O_POL_04_discovery_export", "select doc_id from heads where label in ('3-MEDIUM', '4-NOT SPECIFIED') or label = '1-URGENT' and date + interval 3 year <= timestamp '1998-06-01' and doc_id % 2 = 0")
def _pol04(spark, sf):
    m, d, defs = _policy(spark, sf)
    return messages.exportable(m, d, defs, "discovery", "1998-06-01").select("doc_id")


def _policy(spark, sf):
    """Labels for the policy queries: urgent mail is closed for three years, even ids are
    cleared, high mail goes to delivery only, low mail is not to be transferred."""
    m = heads(spark, sf).select("doc_id", "date", "label")
    code = F.create_map(*[F.lit(x) for kv in {"1-URGENT": "timed", "2-HIGH": messages.TO_DELIVERY_ONLY, "5-LOW": messages.DO_NOT_TRANSFER}.items() for x in kv])[F.col("label")]
    d = m.select("doc_id", code.alias("label_id")).where("label_id is not null").unionByName(m.where("doc_id % 2 = 0 and label = '1-URGENT'").select("doc_id", F.lit(messages.CLEARED).alias("label_id")))
    defs = spark.sql("select * from values ('0', 'RESTRICTION', 'OTHER', cast(null as timestamp), cast(null as int)), ('1', 'RESTRICTION', 'OTHER', null, null), ('7', 'RESTRICTION', 'OTHER', null, null), ('timed', 'RESTRICTION', 'RESTRICTED_FOR_YEARS', null, 3) as t(label_id, type, restriction, until, years)")
    return m, d, defs


@query("O_SET_03_union_of_hits", "select distinct doc_id from (select doc_id from heads where contains(subject, 'URGENT') union all select doc_id from attachments where ext = 'zip')")
def _set03(spark, sf):
    return collections.union_of([heads(spark, sf).where(F.contains("subject", F.lit("URGENT"))).select("doc_id"), attachments(spark, sf).where("ext = 'zip'").select("doc_id")])


@query("O_SRT_01_recent", "select doc_id, date from heads order by date desc, subject, doc_id limit 100")
def _srt01(spark, sf):
    return search({"messages": heads(spark, sf)}, SearchSpec(sort="recent", limit=100)).select("doc_id", "date")


@query(
    "O_STR_10_html_text",
    r"""
with a as (select page_id, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<!--.*?-->', ' ', 'g') as t from pages),
b as (select page_id, regexp_replace(t, '(?s)<[^>]*>', ' ', 'g') as t from a),
c as (select page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') as t from b)
select page_id, trim(regexp_replace(t, '[ \t\n\x0b\f\r]+', ' ', 'g')) as text from c""",
    views=False,
)
def _str10(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query("O_PRJ_06_redaction")
def _prj06(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    names = entities.mentions(docs).where(F.col("type") == entities.PERSON).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list(F.split(F.lower("text"), r"\s+")))).alias("allowed"))
    return docs.join(names, "doc_id", "left").select("doc_id", messages.redact(F.col("text"), F.coalesce("allowed", F.expr("cast(array() as array<string>)"))).alias("text"))


from postbag import catalog_more as _more  # noqa: E402, F401  registers its queries here
from postbag import catalog_files as _files  # noqa: E402, F401  and here
from postbag import catalog_names as _names  # noqa: E402, F401  and here
from postbag import catalog_index as _index  # noqa: E402, F401  and here
from postbag import catalog_links as _links  # noqa: E402, F401  and here
