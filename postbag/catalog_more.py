"""More queries over the provided tables: filters, joins, labels, windows, functions.

As in `catalog`, a key carries the id of the operator that its query shows, and each
query is held against SQL over the same rows.
"""

from __future__ import annotations


from pyspark.sql import functions as F

from postbag.catalog import _policy, archive, query
from postbag.functions import collections as C
from postbag.functions import dates
from postbag.functions import text as T
from postbag.operators import contacts, entities, facets, labels, messages, windows
from postbag.operators.model import OWNER, attachments, heads, read, recipients
from postbag.plans.search import SearchSpec, search

#: Roles of contacts as `archive` has them: senders by id, recipients by negative id.
ROLES = """
, roles as (select contact_id, doc_id, 'sent' as role from heads
  union select -r.contact_id, r.doc_id, case when h.contact_id = 1 then 'received_from_owner' else 'received' end from recipients r join heads h using (doc_id)) """
OWNED = f"from_email = '{OWNER}'"


def _long(c):
    return c.cast("long")


def _found(spark, sf):
    """Mentions made of senders' names: urgent mail tells a person, other mail an organisation."""
    kind = F.when(F.col("label") == "1-URGENT", 1).otherwise(3)
    return heads(spark, sf).select("doc_id", F.col("from_name").alias("text"), F.lit(0).alias("start"), kind.alias("type"), F.round(F.col("amount") / 1e6, 6).alias("score"), "date")


_CNAME = "split_part(from_name, '#', 2) || ' customer'"

# ---- facets and aggregates

query("O_AGG_02_person_facet", ROLES + "select contact_id as value, count(distinct doc_id) as n from roles where contact_id <> 1 group by 1")(lambda s, d: facets.by_person(archive(s, d)["contact_docs"], 1))


@query("O_AGG_07_label_facet", "select label as value, count(*) as n from heads where label in ('1-URGENT', '2-HIGH') group by 1")
def _agg07(s, d):
    held = archive(s, d)["doc_labels"]
    defs = held.select("label_id").distinct().select("label_id", F.col("label_id").alias("name"), F.when(F.col("label_id").isin("1-URGENT", "2-HIGH"), "GENERAL").otherwise("RESTRICTION").alias("type"))
    return facets.by_label(held, defs, "GENERAL")


query("O_AGG_09_attachments_by_person", "select from_email as value, count(*) as n from attachments join heads using (doc_id) group by 1")(lambda s, d: facets.attachments_by(attachments(s, d), heads(s, d), F.col("from_email")))
query("O_AGG_09_attachments_by_direction", f"select case when {OWNED} then 'out' else 'in' end as value, count(*) as n from attachments join heads using (doc_id) group by 1")(lambda s, d: facets.attachments_by(attachments(s, d), heads(s, d), F.when(F.col("from_email") == OWNER, "out").otherwise("in")))
query("O_AGG_09_attachments_by_folder", "select folder as value, count(*) as n from attachments join heads using (doc_id) group by 1")(lambda s, d: facets.attachments_by(attachments(s, d), heads(s, d), F.col("folder")))
query(
    "O_AGG_15_ranked_contacts",
    ROLES + """, c as (select contact_id, count(distinct case when role = 'sent' then doc_id end) as sent, count(distinct case when role <> 'sent' then doc_id end) as got from roles group by 1)
select contact_id, row_number() over (order by sent desc, got desc, contact_id) as place from c""",
)(lambda s, d: contacts.ranked(contacts.summaries(archive(s, d)["contact_docs"], heads(s, d))).select("contact_id", "place"))
query("O_AGG_16_contact_occurrences", "select contact_id, count(*) as n from recipients group by 1")(lambda s, d: contacts.occurrences(recipients(s, d)))
query("O_AGG_17_entity_book_of_names", f"select case when label = '1-URGENT' then 1 else 3 end as type, {_CNAME} as cname, min(from_name) as display, max(round(amount / 1e6, 6)) as score, count(*) as messages from heads where round(amount / 1e6, 6) >= 0.001 group by 1, 2")(
    lambda s, d: entities.entity_book(_found(s, d)).select("type", "cname", "display", "score", "messages")
)
query("O_AGG_18_entity_dates", f"select case when label = '1-URGENT' then 1 else 3 end as type, {_CNAME} as cname, count(*) as messages, min(date) as first, max(date) as last from heads group by 1, 2")(lambda s, d: entities.entity_dates(_found(s, d), heads(s, d)))
query("O_AGG_19_types_above", f"select type, count(*) as n from (select case when label = '1-URGENT' then 1 else 3 end as type, {_CNAME} as cname, max(round(amount / 1e6, 6)) as score from heads where round(amount / 1e6, 6) >= 0.001 group by 1, 2) where score > 0.3 group by 1")(
    lambda s, d: entities.types_above(entities.entity_book(_found(s, d)), 0.3)
)
query("O_SRT_03_top_entities_of_names", f"""
, b as (select case when label = '1-URGENT' then 1 else 3 end as type, {_CNAME} as cname, max(round(amount / 1e6, 6)) as score, count(*) as messages from heads where round(amount / 1e6, 6) >= 0.001 group by 1, 2)
select type, cname from (select *, row_number() over (partition by type order by score desc, messages desc, cname) as place from b) where place <= 7""")(lambda s, d: entities.top_entities(entities.entity_book(_found(s, d)), 7, 100).select("type", "cname"))

_WORDS = r"with t as (select doc_id, string_split_regex(lower(text), '[^\p{L}\p{N}]+') as w from documents), f as (select doc_id, list_contains(w, 'idiot') or list_contains(w, 'moron') as insult, list_contains(w, 'trash') or list_contains(w, 'scum') as dirt from t) "


def _hits(s, d):
    return entities.lexicon_hits(read(s, d, "documents"), {"insult": "idiot|moron", "dirt": "trash|scum"})


query("O_AGG_22_all_captions", _WORDS + "select doc_id from f where insult and dirt", views=False)(lambda s, d: entities.with_captions(_hits(s, d), ["insult", "dirt"]))
query("O_AGG_22_no_caption", _WORDS + "select doc_id from f where not insult and not dirt", views=False)(lambda s, d: entities.with_captions(_hits(s, d), ["None"]))
query("O_AGG_24_attachment_classes", "select case when ext = 'jpg' then 'image' when ext = 'doc' then 'office' when ext = 'pdf' then 'document' when ext = 'zip' then 'archive' else 'other' end as value, count(*) as n from attachments group by 1")(lambda s, d: facets.attachment_classes(attachments(s, d)))
query(
    "O_AGG_26_duplicate_stats",
    """, k as (select doc_id, first_value(doc_id) over (partition by contact_id order by date, doc_id) as kept from heads), b as (select doc_id, sum(size) as bytes from attachments group by 1)
select count(*) as duplicates, cast(coalesce(sum(bytes), 0) as bigint) as bytes_saved from k left join b on b.doc_id = kept where kept <> k.doc_id""",
)(lambda s, d: facets.duplicate_stats(messages.duplicates(heads(s, d), ["contact_id"], ["date", "doc_id"]), attachments(s, d)))
query(
    "O_AGG_28_name_table",
    _WORDS.replace("with t as", "heads as (select o_orderkey as doc_id, o_custkey as contact_id, c_name from orders join customer on o_custkey = c_custkey), t as", 1).replace("heads as", "with heads as", 1)
    + """, c as (select doc_id, 'insult' as caption from f where insult union all select doc_id, 'dirt' from f where dirt union all select doc_id, 'None' from f where not insult and not dirt),
n as (select split_part(c_name, '#', 2) || ' customer' as cname, doc_id, contact_id from heads)
select n.cname, count(*) as mentions, count(distinct n.doc_id) as messages, count(distinct contact_id) as people, cast(count(distinct case when c.caption = 'None' then c.doc_id end) as bigint) as calm
from n left join (select distinct doc_id, caption from c where caption = 'None') c using (doc_id) group by 1""",
    views=False,
)(lambda s, d: entities.name_table(_found(s, d), _hits(s, d), heads(s, d).select("doc_id", "contact_id")).select("cname", "mentions", "messages", "people", F.coalesce(F.col("captions")["None"], F.lit(0)).alias("calm")))
query("O_AGG_29_distinct_lists", "select distinct 'folder' as list, folder as value from heads union select 'source', email_source from heads union select 'label', label from heads union select 'attachment', filename from attachments")(lambda s, d: facets.distinct_values(heads(s, d), attachments(s, d)))
query("O_AGG_32_contact_weights", "select contact_id, round(sum(1.0 / k), 6) as weight from recipients join (select doc_id, count(*) as k from recipients group by 1) using (doc_id) group by 1")(lambda s, d: contacts.weighted(recipients(s, d)).select("contact_id", F.round("weight", 6).alias("weight")))
query("O_AGG_34_caption_months", _WORDS + """, c as (select doc_id, 'insult' as caption from f where insult union all select doc_id, 'dirt' from f where dirt union all select doc_id, 'None' from f where not insult and not dirt)
select caption, date_trunc('month', o_orderdate) as month, count(distinct doc_id) as n from c join orders on o_orderkey = doc_id group by 1, 2""", views=False)(lambda s, d: facets.caption_months(_hits(s, d), heads(s, d)))
query("O_AGG_37_data_errors", "select doc_id, unnest(list_filter([case when doc_id % 7 = 0 then 'no date' end, case when doc_id % 5 = 0 then 'no subject' end, case when doc_id % 3 = 0 then 'no recipient' end], lambda x: x is not null)) as error from heads")(
    lambda s, d: messages.data_errors(heads(s, d).withColumn("date", F.expr("if(doc_id % 7 = 0, timestamp'1960-01-01', date)")).withColumn("subject", F.expr("if(doc_id % 5 = 0, ' ', subject)")), heads(s, d).where("doc_id % 3 != 0").select("doc_id"))
)

# ---- windows and histograms

query("O_WIN_03_sliding_windows", """
, m as (select date_trunc('month', date) as m from heads), b as (select min(m) as a, max(m) as b from m),
e as (select b - to_months(cast(i as integer)) as last from b, range(0, 1000) r(i) where i % 2 = 0 and b - to_months(cast(i as integer)) >= a)
select cast(last - interval 3 month as date) as start, cast(last + interval 1 month as date) as "end", cast(count(m) as bigint) as n from e left join m on m between last - interval 3 month and last group by last""")(lambda s, d: windows.sliding(heads(s, d), 4, 2))
query("O_WIN_04_years", "select greatest(date_trunc('year', date), (select min(date) from heads)) as start, date_trunc('year', date) + interval 1 year as \"end\", count(*) as n from heads group by all")(lambda s, d: windows.per_interval(heads(s, d), "year"))
query("O_WIN_04_equal_parts", "select cast(least(4, (epoch_us(date) - a) // greatest(1, (b - a) // 5)) as integer) as part, count(*) as n from heads, (select min(epoch_us(date)) as a, max(epoch_us(date)) as b from heads) group by 1")(lambda s, d: windows.equal_parts(heads(s, d), 5))
query("O_MAT_01_shares", "select folder, count(*) as n, round(count(*) / (select count(*) from heads), 6) as share, cast(greatest(2, least(5, floor(count(*) * 0.1 / 100))) as integer) as least from heads group by 1")(
    lambda s, d: windows.shares(heads(s, d).groupBy("folder").agg(F.count("*").alias("n"))).select("folder", "n", F.round("share", 6).alias("share"), windows.least_frequency(F.col("n"), 0.1).alias("least"))
)

# ---- filters

_FOUND = {
    "O_FLT_10_address": (SearchSpec(address=("Supplier#000000001", "SUPPLIER#000000001@supply.example")), "exists (select 1 from recipients r where r.doc_id = heads.doc_id and r.contact_id = 1)", None),
    "O_FLT_12_no_mailing_list": (SearchSpec(mailing_list="no"), "not exists (select 1 from recipients r where r.doc_id = heads.doc_id and r.contact_id between 1 and 3)", lambda s, d: {"contacts": read(s, d, "supplier").select((-F.col("s_suppkey")).alias("contact_id"), F.when(F.col("s_suppkey").between(1, 3), 8).otherwise(2).alias("ml_state"))}),
    "O_FLT_15_entity": (SearchSpec(entity="000000001, CUSTOMER; customer#000000002"), "contact_id in (1, 2)", lambda s, d: {"mentions": _found(s, d).select("doc_id", "text", "type")}),
    "O_FLT_16_entity_type": (SearchSpec(entity_types=[1]), "label = '1-URGENT'", lambda s, d: {"mentions": _found(s, d).select("doc_id", "text", "type")}),
    "O_FLT_22_attachment_names": (SearchSpec(attachment_names=["PART11.", "part12"]), "exists (select 1 from attachments a where a.doc_id = heads.doc_id and (contains(a.filename, 'part11.') or contains(a.filename, 'part12')))", None),
    "O_FLT_26_several_restrictions": (SearchSpec(several_restrictions=True), "doc_id % 2 = 0 and label = '1-URGENT'", lambda s, d: dict(zip(("doc_labels", "label_defs"), _policy(s, d)[1:], strict=True))),
    "O_FLT_30_attachment_selection": (SearchSpec(start="1995-01-01", end="1995-12-31", attachment_size=4, attachment_ext=["pdf", "doc"]), "date >= timestamp '1995-01-01' and date < timestamp '1996-01-01' and exists (select 1 from attachments a where a.doc_id = heads.doc_id and a.ext in ('pdf', 'doc') and a.size between 102400 and 2097152)", None),
    "O_FLT_34_persons": (SearchSpec(correspondent="customer#000000003; supplier#000000002@supply.example"), "lower(from_name) = 'customer#000000003' or exists (select 1 from recipients r where r.doc_id = heads.doc_id and r.contact_id = 2)", None),
    "O_FLT_35_case_sensitive_regex": (SearchSpec(regex="Order [12]-(URGENT|high)", case_sensitive=True), "contains(subject, 'Order 1-URGENT')", lambda s, d: {"messages": heads(s, d).withColumn("body", F.lit(""))}),
    "O_FLT_37_open_range": (SearchSpec(start="not a date", end="1994-06-30"), "date < timestamp '1994-07-01'", None),
}


def _search(spec, more):
    return lambda s, d: search({**archive(s, d), **(more(s, d) if more else {})}, spec).select("doc_id", "subject", "folder")


for _name, (_spec, _where, _more) in _FOUND.items():
    query(_name, f"select doc_id, subject, folder from heads where {_where}")(_search(_spec, _more))


@query("O_FLT_11_thread", "select doc_id, subject from heads where doc_id % 1000 = 7")
def _flt11(s, d):
    m = heads(s, d).withColumn("thread_id", F.col("doc_id") % 1000)
    return search({"messages": m}, SearchSpec(thread_id=7)).select("doc_id", "subject")


@query("O_FLT_33_fetch_filter", f"select doc_id from heads where {OWNED} and date >= timestamp '1994-01-01' and date < timestamp '1997-01-01' and exists (select 1 from recipients r where r.doc_id = heads.doc_id and r.contact_id <= 4)")
def _flt33(s, d):
    return messages.fetched(heads(s, d), "1994-01-01", "1996-12-31", archive(s, d)["contact_docs"], [-1, -2, -3, -4], [OWNER.upper()]).select("doc_id")


query("O_FLT_39_note_contains", "select doc_id, subject, folder from heads where amount > 300000 and label = '1-URGENT'")(_search(SearchSpec(annotation="large 1-urg"), None))
query("O_FLT_40_any_part", "select p_partkey from part where contains(lower(p_name), 'red') or contains(lower(p_name), 'blue')", views=False)(lambda s, d: read(s, d, "part").where(T.any_part(F.col("p_name"), " red| |blue|")).select("p_partkey"))
query("O_FLT_41_delivery_export", "select doc_id from heads where label in ('2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') or label = '1-URGENT' and date + interval 3 year <= timestamp '1998-06-01' and doc_id % 2 = 0")(lambda s, d: messages.exportable(*_policy(s, d), "delivery", "1998-06-01").select("doc_id"))
query("O_FLT_42_expired", "select doc_id, date + interval 2 year <= timestamp '1997-01-01' as over from heads")(lambda s, d: heads(s, d).select("doc_id", messages.expired(F.col("date"), F.lit(None).cast("timestamp"), F.lit(2), F.lit("1997-01-01").cast("timestamp")).alias("over")))

# ---- joins and sets


@query("O_JOIN_02_contacts_by_name", "select doc_id, contact_id from recipients")
def _join02(s, d):
    book = read(s, d, "supplier").select(F.col("s_suppkey").alias("contact_id"), F.concat(F.lower("s_name"), F.lit("@supply.example")).alias("email"), F.array(F.concat(F.lit("Ann "), F.col("s_name"))).alias("names"))
    rows = recipients(s, d).select("doc_id", F.concat(F.lit("'"), "name", F.lit(", Ann (at work)'")).alias("name"), F.when(F.col("contact_id") % 2 == 0, F.col("email")).otherwise("gone@nowhere.example").alias("email"))
    return contacts.resolve(rows, book).select("doc_id", "contact_id")


@query("O_JOIN_14_merge_books", "select unnest([s_suppkey]) as k, 2 as n_names, 1 as n_emails from supplier", views=False)
def _join14(s, d):
    book = lambda more: read(s, d, "supplier").select((F.col("s_suppkey") + more).alias("contact_id"), F.array(F.lower("s_name")).alias("emails"), F.array(F.concat(F.lit(str(more)), F.col("s_name"))).alias("names"))
    got = contacts.merge_books(book(0), book(1_000_000))
    return got.select(F.regexp_extract(F.get("emails", F.lit(0)), r"(\d+)$", 1).cast("long").alias("k"), F.size("names").alias("n_names"), F.size("emails").alias("n_emails"))


query(
    "O_JOIN_15_merge_labels",
    """with one as (select cast(c_custkey as varchar) as id, c_name as name from customer), other as (select cast(c_custkey + 3 as varchar) as id, case when c_custkey % 2 = 0 then c_name else c_name || ' bis' end as name from customer)
select coalesce(one.name, other.name) as name, coalesce(one.id, case when other.id in (select id from one) then other.id || '-other' else other.id end) as label_id from one full join other on one.name = other.name""",
    views=False,
)(
    lambda s, d: messages.merge_labels(
        read(s, d, "customer").select(F.col("c_custkey").cast("string").alias("label_id"), F.col("c_name").alias("name")),
        read(s, d, "customer").select((F.col("c_custkey") + 3).cast("string").alias("label_id"), F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, "").otherwise(" bis")).alias("name")),
    )
)


query("O_JOIN_16_authority_candidates", "select c_custkey as contact_id, c_custkey as authority_id from customer where c_custkey % 2 = 0", views=False)(
    lambda s, d: contacts.authority_candidates(
        read(s, d, "customer").select(F.col("c_custkey").alias("contact_id"), F.concat(F.lit("Jane "), F.col("c_name")).alias("best_name")),
        read(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("authority_id"), F.concat(F.lit("Doctor, Jane "), F.col("c_name"), F.lit(" (writer)")).alias("label")),
    ).select("contact_id", "authority_id")
)
query("O_JOIN_20_thread_siblings", "select doc_id % 500 as thread_id, doc_id from heads where doc_id % 500 in (select doc_id % 500 from heads where doc_id <= 3)")(lambda s, d: messages.siblings(heads(s, d).select((F.col("doc_id") % 500).alias("thread_id"), "doc_id"), heads(s, d).where("doc_id <= 3")))
query("O_SET_01_intersection", "select doc_id from heads where doc_id % 2 = 0 and folder = 'mail/F' and doc_id % 3 <> 0")(lambda s, d: C.difference_of(C.intersection_of([heads(s, d).where("doc_id % 2 = 0").select("doc_id"), None, heads(s, d).where("folder = 'mail/F'").select("doc_id")]), heads(s, d).where("doc_id % 3 = 0").select("doc_id")))
query("O_SET_01_union", "select doc_id from heads where doc_id % 2 = 0 or folder = 'mail/F'")(lambda s, d: C.union_of([heads(s, d).where("doc_id % 2 = 0").select("doc_id"), heads(s, d).where("folder = 'mail/F'").select("doc_id")]))
query("O_SET_02_roles", ROLES + "select contact_id, doc_id, role from roles")(lambda s, d: contacts.union_roles([archive(s, d)["contact_docs"].where(part) for part in ("doc_id % 3 = 0", "doc_id % 3 != 0", "doc_id % 2 = 0")]))
query("O_ARR_01_arrays", "select p_partkey, list_filter(string_split(p_name, ' '), lambda x: lower(x) not in ('red', 'steel')) as kept, len(list_filter(string_split(p_name, ' '), lambda x: lower(x) not in ('red', 'steel'))) as n from part", views=False)(
    lambda s, d: read(s, d, "part").select("p_partkey", C.without(F.split("p_name", " "), F.array(F.lit("RED"), F.lit("Steel"))).alias("kept")).withColumn("n", _long(F.size("kept")))
)
query("O_MAP_01_sorted_entries", "select folder, arg_max(label, (n, -ascii(label))) as top, max(n) as n from (select folder, label, count(*) as n from heads group by 1, 2) group by 1")(
    lambda s, d: heads(s, d).groupBy("folder", "label").agg(F.count("*").alias("n")).groupBy("folder").agg(C.sorted_entries(F.map_from_entries(F.collect_list(F.struct("label", "n")))).alias("e")).select("folder", F.col("e")[0]["key"].alias("top"), F.col("e")[0]["value"].alias("n"))
)

# ---- labels, policy, export columns


def _label_case(s, d):
    m, held, defs = _policy(s, d)
    return labels.set_checked(m.withColumn("hacky", F.col("doc_id") % 5 == 0), held, defs, m.select("doc_id"), ["1"], "1998-06-01")


query("O_POL_01_checked_labels", "select doc_id, case when label = '1-URGENT' and date + interval 3 year > timestamp '1998-06-01' then 'restriction is not over' when label = '1-URGENT' and doc_id % 5 = 0 then 'date is not known' end as failure from heads")(lambda s, d: _label_case(s, d).select("doc_id", "failure"))
query("O_POL_02_replaced_labels", "select case when doc_id % 2 = 0 then 'x' else label end as label_id, count(*) as n from heads group by 1")(lambda s, d: labels.replace_labels(archive(s, d)["doc_labels"], heads(s, d).where("doc_id % 2 = 0"), ["x"]).groupBy("label_id").agg(F.count("*").alias("n")))


def _exported_labels(s, d, mode):
    defs = s.createDataFrame([("1-URGENT", "RESTRICTION", False), ("2-HIGH", "GENERAL", True), ("3-MEDIUM", "GENERAL", False), ("4-NOT SPECIFIED", "PERMISSION", False)], "label_id string, type string, is_system boolean")
    return labels.for_export(archive(s, d)["doc_labels"].where("label_id != '5-LOW'"), defs, heads(s, d).where("doc_id % 2 = 0"), mode)[1]


query("O_POL_05_labels_to_discovery", "select doc_id, label as label_id from heads where doc_id % 2 = 0 and label in ('3-MEDIUM', '4-NOT SPECIFIED')")(lambda s, d: _exported_labels(s, d, "discovery"))
query("O_POL_05_labels_to_delivery", "select doc_id, label as label_id from heads where doc_id % 2 = 0 and label in ('2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')")(lambda s, d: _exported_labels(s, d, "delivery"))
query("O_POL_06_delivery_columns", "select doc_id, split_part(from_email, '@', 1) || '@...' as from_email from heads")(lambda s, d: messages.for_mode(heads(s, d), "delivery").select("doc_id", "from_email"))
query("O_POL_06_discovery_columns", "select doc_id, regexp_replace(subject, 'URGENT|HIGH|MEDIUM|LOW|NOT|SPECIFIED|Re|[0-9]', '', 'g') as rest, cast(length(subject) as bigint) as n from heads")(
    lambda s, d: messages.for_mode(heads(s, d), "discovery", F.array(F.lit("order"))).select("doc_id", F.regexp_replace("subject", r"\.", "").alias("rest"), _long(F.length("subject")).alias("n"))
)
query("O_POL_08_notes", "select doc_id, case when doc_id % 2 = 0 then concat_ws(chr(10), case when amount > 300000 then 'large ' || label end, 'seen') else 'large ' || label end as text from heads where amount > 300000 or doc_id % 2 = 0")(lambda s, d: labels.annotate(archive(s, d)["annotations"], heads(s, d).where("doc_id % 2 = 0"), "seen", True))
query("O_PRJ_03_addresses", "select doc_id, list_sort(list(a)) as addresses from (select doc_id, from_email as a from heads union all select doc_id, email from recipients) group by 1")(
    lambda s, d: archive(s, d)["messages"].select("doc_id", F.array_sort(F.transform(F.concat("to", "cc", "bcc", "from"), lambda a: T.clean_email(a["email"]))).alias("addresses"))
)
query("O_PRJ_04_clean_dates", "select doc_id, case when doc_id % 3 = 0 then (select min(date) from heads where doc_id % 3 <> 0 and doc_id % 5 <> 0) when doc_id % 5 = 0 then (select max(date) from heads where doc_id % 3 <> 0 and doc_id % 5 <> 0) else date end as date from heads")(
    lambda s, d: messages.clean_dates(heads(s, d).withColumn("date", F.expr("case when doc_id % 3 = 0 then null when doc_id % 5 = 0 then timestamp'2999-01-01' else date end"))).select("doc_id", "date")
)
query("O_PRJ_07_attachment_details", "select blob_id, case when length(filename) <= 10 then filename else filename[1:7] || '...' end as filename, cast(0 as bigint) as size from attachments")(lambda s, d: messages.without_attachment_details(attachments(s, d)).select("blob_id", "filename", "size"))
query("O_PRJ_09_unique_masks", "select email, case when email like '%@a.example' then split_part(email, '@', 1) || '@...' else split_part(email, '@', 1) || '@...(1)' end as mask from (select lower(s_name) || x as email from supplier, (values ('@a.example'), ('@b.example')) v(x))", views=False)(
    lambda s, d: contacts.unique_masks(read(s, d, "supplier").select(F.explode(F.array(*[F.concat(F.lower("s_name"), F.lit(x)) for x in ("@a.example", "@b.example")])).alias("email")))
)

# ---- string, date and text functions



def _fn(name, columns, sql, table="customer", key="c_custkey"):
    """A query of functions over the rows of a table; columns are built when it runs."""
    query(name, f"select {key}, {sql} from {table}", views=False)(lambda s, d: read(s, d, table).select(key, *[c.alias(n) for n, c in columns(F.col("c_name") if table == "customer" else None).items()]))


_cat = F.concat
_l = F.lit
_fn("O_STR_02_clean_person", lambda _c: {"a": T.clean_person_name(_cat(_l("'"), _c, _l(" (at home)  Lee [dept]'"))), "b": T.clean_person_name(_cat(_l("Unknown "), _c)), "e": T.clean_person_name(_cat(_c, _l("@X.org"))), "p": T.clean_person_name(_cat(_l("some-undisclosed-"), _c))}, "c_name || ' Lee' as a, cast(null as varchar) as b, lower(c_name) || '@x.org' as e, cast(null as varchar) as p")
_fn("O_STR_03_name_key", lambda _c: {"k": T.name_key(_cat(_l("Smith, Bob Q. "), _c)), "b": T.name_key(_cat(_c, _l(" Q tony"))), "o": T.name_key(_c)}, "'robert ' || lower(c_name) || ' smith' as k, lower(c_name) || ' anthony' as b, lower(c_name) as o")
_fn("O_STR_04_variants", lambda _c: {"v": T.canonical_variant(F.lower("c_mktsegment"), {"building": "house", "house": "home", "machinery": "tools", "tools": "machinery"})}, "case lower(c_mktsegment) when 'building' then 'home' else lower(c_mktsegment) end as v")
_fn("O_STR_06_bare_subject", lambda _c: {"s": T.bare_subject(_cat(_l("Re: FWD: [list] re:"), _c)), "t": T.bare_subject(_cat(_l("[a list name of more than twenty] "), _c))}, "c_name as s, '[a list name of more than twenty] ' || c_name as t")
_fn("O_STR_07_normal_subject", lambda _c: {"s": T.normal_subject(_cat(_l(" Re: Re: "), _c))}, "'re: ' || lower(c_name) as s")
_fn("O_STR_08_original", lambda _c: {"o": T.original_content(_cat(_c, _l("\n> old\nnew\nOn Monday x wrote:\nrest")))}, "c_name || chr(10) || ' . ' || chr(10) || 'new' as o")
_fn("O_STR_09_clean_content", lambda _c: {"o": T.clean_content(_cat(_l(">> quoted\n"), _c, _l("\n\nnext\nX wrote:\nrest")))}, "' ' || c_name || '. next ' as o")
_fn("O_STR_11_short_forms", lambda _c: {"e": T.ellipsize(_c, 12), "p": T.pad_width(F.substring(_c, 1, 3), 5), "u": T.capitalize_first(F.lower("c_mktsegment"))}, "c_name[1:9] || '...' as e, c_name[1:3] || '  ' as p, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) as u")
_fn("O_STR_12_strip", lambda _c: {"p": T.strip_punctuation(_c), "b": T.strip_brackets(_cat(_l("[("), _c, _l("}>")))}, "replace(c_name, '#', '') as p, c_name as b")
_fn("O_STR_13_acronyms", lambda _c: {"a": T.acronym(_cat(_c, _l(" of Big old Things"))), "u": T.all_upper(F.col("c_mktsegment")), "v": T.all_upper(_c)}, "'CBT' as a, true as u, false as v")
_fn("O_STR_14_hash", lambda _c: {"h": F.sha2(_c, 256)}, "sha256(c_name) as h")
_fn("O_STR_16_paths", lambda _c: {"t": T.path_tail(_cat(_l("a/b\\"), _c, _l("/"))), "f": T.safe_file_name(_c), "u": T.url_tail(_cat(_l("http://x.org/a/"), _c, _l("?q=1"))), "d": T.top_level_domain(_l("http://www.some.example.org:80/x"))}, "c_name as t, replace(c_name, '#', '_') as f, 'Customer' as u, 'example.org' as d")
_fn("O_STR_18_whole_word", lambda _c: {"w": T.whole_word(_cat(_l("x "), _c, _l("red red1")), "red1"), "n": T.whole_word(_cat(_c, _l(" reds")), "red")}, "true as w, false as n")
_fn("O_STR_19_names", lambda _c: {"a": T.clean_name(_cat(_l("(Dear "), _c, _l("'s"))), "b": T.clean_name(_cat(_l("the "), _c)), "e": T.scrub_name(_cat(_l('<b>{"'), _c, _l('"}</b>\n')))}, "c_name as a, cast(null as varchar) as b, c_name as e")
_fn("O_STR_20_word_pairs", lambda _c: {"p": T.word_pairs(_cat(_c, _l(" house of red")))}, "[c_name || ' house'] as p")
_fn("O_STR_21_phrase_parts", lambda _c: {"p": T.prefixes(_cat(_c, _l(" b  c"))), "s": T.suffixes(_cat(_c, _l(" b  c"))), "n": _long(F.size(T.phrase_parts(_cat(_c, _l(" b c b")))))}, "[c_name, c_name || ' b', c_name || ' b c'] as p, [c_name || ' b c', 'b c', 'c'] as s, cast(9 as bigint) as n")
_fn("O_STR_22_best_name", lambda _c: {"a": T.best_name_score(_cat(_c, _l(" Smith"))), "b": T.best_name_score(F.lower(_c)), "e": T.best_name_score(_cat(_c, _l(",x")))}, "cast(11000 + length(c_name) + 6 as integer) as a, cast(length(c_name) as integer) as b, cast(900 + length(c_name) + 2 as integer) as e")
_fn("O_STR_23_address_parts", lambda _c: {"l": T.login(_cat(_c, _l("@mail.acme.org"))), "o": T.organisation(_cat(_c, _l("@mail.acme.org"))), "n": T.last_name(_cat(_l("Ann "), _c, _l(" ")))}, "c_name as l, 'acme' as o, c_name as n")
_fn("O_STR_24_alternate_emails", lambda _c: {"e": T.alternate_emails(_cat(_c, _l(", A@x.org\ta@X.org,,b@x.org")))}, "[lower(c_name), 'a@x.org', 'b@x.org'] as e")
_fn("O_STR_25_name_match", lambda _c: {"a": T.name_match(_c, _cat(_l("Ann "), _c)), "b": T.name_match(_l("CB"), _cat(_c, _l(" Big"))), "e": T.name_match(_cat(_c, _l(" Ann")), _cat(_l("Ann B "), _c)), "f": T.name_match(_c, _c)}, "'CONTAINED' as a, 'ACRONYM' as b, 'CONTAINED_DIFFERENT_ORDER' as e, cast(null as varchar) as f")
_fn("O_STR_27_scripts", lambda _c: {"a": T.scripts(_c), "b": T.scripts(_cat(_c, _l(" привет γεια")))}, "['english'] as a, ['english', 'russian', 'greek'] as b")
_fn("O_TXT_04_number_tokens", lambda _c: {"t": T.number_tokens(_cat(_l("Paid 1,250.50 on 2001-02-03 to "), _c))}, "['paid', '1,250.50', 'on', '2001-02-03', 'to', 'customer', split_part(c_name, '#', 2)] as t")
_fn("O_DAT_03_parse", lambda _c: {"a": dates.parse(_l("2001-02-03 04:05:06")), "b": dates.parse(_l("Sat, 3 Feb 2001")), "e": dates.parse(_c), "f": F.date_format(dates.parse(_l("2001/02/03")), "yyyy-MM-dd")}, "timestamp '2001-02-03 04:05:06' as a, timestamp '2001-02-03' as b, cast(null as timestamp) as e, '2001-02-03' as f")
_fn("O_DAT_04_display_month", lambda _c: {"m": dates.display_month(F.col("o_orderdate")), "q": dates.quarter_start(F.col("o_orderdate"))}, "strftime(o_orderdate, '%b') as m, cast(date_trunc('quarter', o_orderdate) as timestamp) as q", "orders", "o_orderkey")
_first, _last = dates.span(1996, 2, 31)
query("O_DAT_02_missing_parts", "select doc_id from heads where date >= timestamp '1996-02-29' and date < timestamp '1997-01-01'")(lambda s, d: heads(s, d).where(dates.within(F.col("date"), _first.isoformat(), dates.span(1996)[1].isoformat())).select("doc_id"))
query("O_JSN_01_pairs", "select event_id, cast(len(json_keys(props)) as bigint) as n, json_keys(props)[1] as first from events", views=False)(lambda s, d: read(s, d, "events").select("event_id", C.json_pairs(F.col("props")).alias("p")).select("event_id", _long(F.size("p")).alias("n"), F.col("p")[0]["key"].alias("first")))

# ---- entities, contacts, other archives

query("O_NER_08_kill_phrases", "select doc_id from heads where contact_id <> 1")(lambda s, d: entities.without_kill_phrases(_found(s, d), s.createDataFrame([("  CUSTOMER#000000001 ",)], "phrase string")).select("doc_id"))
query("O_NER_13_type_tree", "select level, cast(sum(n) as bigint) as n from (select unnest(['a', 'a/' || label, 'a/' || label || '/' || folder]) as level, 1 as n from heads) group by 1")(lambda s, d: entities.type_tree(heads(s, d).select(F.concat(F.lit("a/"), "label", F.lit("/"), F.regexp_replace("folder", "/", "\u0001")).alias("path"), F.lit(1).alias("n"))).select(F.regexp_replace("level", "\u0001", "/").alias("level"), F.col("n")))
query("O_NER_15_address_book", "select lower(s_name) || '@supply.example' as email, s_name as best_name, [s_name] as names, count(*) as uses from lineitem join supplier on l_suppkey = s_suppkey group by all", views=False)(
    lambda s, d: contacts.address_book(read(s, d, "lineitem").join(read(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.concat(F.lit("'"), F.col("s_name"), F.lit("'")).alias("name"), F.concat(F.upper("s_name"), F.lit("@supply.example ")).alias("email"))).select("email", "best_name", "names", "uses")
)
query("O_NER_16_mailing_lists", """
, to1 as (select doc_id, count(distinct contact_id) as k from recipients group by 1)
select contact_id, cast(bit_or(b) as integer) as ml_state from (
  select -r.contact_id as contact_id, case when r.doc_id % 11 = 0 then 8 when h.contact_id <> 1 then case when k = 1 then 1 else 2 end else 0 end as b from recipients r join heads h using (doc_id) join to1 using (doc_id)
  union all select contact_id, 4 from heads) group by 1""")(lambda s, d: contacts.mailing_list_state(heads(s, d).select("doc_id", "contact_id", (F.col("doc_id") % 11 == 0).alias("list_post")), recipients(s, d).select("doc_id", (-F.col("contact_id")).alias("contact_id")), 1))
query("O_XC_01_across_archives", "select distinct email_source as archive_id, from_name as display from heads where contains(from_name, '#00000001')")(
    lambda s, d: entities.across_archives(heads(s, d).select(F.col("email_source").alias("archive_id"), F.col("from_name").alias("display")), "#00000001", parts=True).select("archive_id", "display")
)
query("O_SRT_04_closest_entities", """
, f as (select contact_id as entity, r.contact_id as feature, count(*) as w from heads h join recipients r using (doc_id) group by 1, 2),
f2 as (select h.contact_id as entity, r.contact_id as feature, cast(count(*) as double) as w from heads h join recipients r on h.doc_id = r.doc_id group by 1, 2),
nrm as (select entity, sqrt(sum(w * w)) as norm from f2 group by 1), me as (select * from f2 where entity = (select min(contact_id) from heads))
select f2.entity, round(sum(f2.w * me.w) / (any_value(norm) * (select norm from nrm where entity = (select min(contact_id) from heads))), 6) as score from f2 join me using (feature) join nrm on nrm.entity = f2.entity
where f2.entity <> (select min(contact_id) from heads) group by 1""".replace("f as (select contact_id as entity, r.contact_id as feature, count(*) as w from heads h join recipients r using (doc_id) group by 1, 2),\n", ""))(lambda s, d: _closest(s, d))


def _closest(s, d):
    """All entities by likeness to the sender with the lowest id; features are recipients."""
    f = heads(s, d).select("doc_id", F.col("contact_id").cast("string").alias("entity")).join(recipients(s, d).select("doc_id", F.col("contact_id").alias("feature")), "doc_id").groupBy("entity", "feature").agg(F.count("*").cast("double").alias("weight"))
    target = str(heads(s, d).agg(F.min("contact_id")).first()[0])
    return entities.closest(f, target).select(_long(F.col("entity")).alias("entity"), F.round("score", 6).alias("score"))


