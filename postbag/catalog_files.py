"""Queries of sources, sinks and whole archives: what is written is read back and held
against SQL over the rows it was made from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag.catalog import archive, people, query
from postbag.catalog_more import ROLES, _found
from postbag.functions import text as T
from postbag.operators import archives, contacts, entities, facets, messages
from postbag.operators.model import OWNER, attachments, heads, read, recipients
from postbag.plans import fulltext
from postbag.plans.search import SearchSpec, count_hits, ordered, search
from postbag.sinks import export
from postbag.sinks.shared import shared_folder
from postbag.sources import mbox, side

NO_ADDRESSES = "cast(array() as array<struct<name:string,email:string>>)"
_ID = "'<' || doc_id || '@archive.example>' as message_id"


def _mail(s: SparkSession, d: str) -> DataFrame:
    """The viewed messages with all that a mailbox holds."""
    m = people(heads(s, d), recipients(s, d, together=True)).withColumn("to", F.array_sort("to"))
    body = F.concat(F.lit("From here\n>From there\n"), F.col("subject"))
    return m.withColumn("message_id", F.concat(F.lit("<"), F.col("doc_id").cast("string"), F.lit("@archive.example>"))).withColumn("body", body).withColumn("annotation", F.when(F.col("amount") > 300_000, "large sum")).withColumn("label_names", F.array("label"))


def _through_mailbox(m: DataFrame) -> DataFrame:
    path = shared_folder(m.sparkSession, "mailbox")
    export.write_mbox(m, path, compression="gzip")  # plain, it is some thirty times the tables that it is made from
    return mbox.read_mbox(m.sparkSession, path)


def _header(name: str):
    return F.regexp_extract("headers", rf"(?m)^{name}: (.*)$", 1)


def _lines(rows: DataFrame, name: str, *order: str) -> str:
    """Rows (column value) as one text file of a small side file."""
    path = shared_folder(rows.sparkSession, name)
    rows.coalesce(1).sortWithinPartitions(*order).select("value").write.text(path)
    return path


# ---- mailboxes


@query("O_SRC_01_mailboxes", f"select {_ID}, date, subject, from_email, folder, cast(coalesce(n, 0) as integer) as n_to from heads left join (select doc_id, count(*) as n from recipients group by 1) using (doc_id)")
def _src01(s, d):
    return _through_mailbox(_mail(s, d)).select("message_id", "date", "subject", F.get(F.col("from"), F.lit(0))["email"].alias("from_email"), _header("X-Archive-Folder").alias("folder"), F.size("to").alias("n_to"))


@query("O_SNK_02_mailbox_headers", f"select {_ID}, case when amount > 300000 then 'large sum' else '' end as note, label, 'From here' || chr(10) || '>From there' || chr(10) || subject as body from heads")
def _snk02(s, d):
    return _through_mailbox(_mail(s, d)).select("message_id", _header("X-Archive-Annotation").alias("note"), _header("X-Archive-Labels").alias("label"), F.regexp_replace("body", r"\n+$", "").alias("body"))


def _of_pages(s, d):
    p = read(s, d, "pages")
    none = F.expr(NO_ADDRESSES)
    return p.select(
        F.lit("pages").alias("folder"), F.lit("2001-02-03 04:05:06").cast("timestamp").alias("date"), *[none.alias(r) for r in ("from", "to", "cc", "bcc")],
        F.lit("page").alias("subject"), F.col("page_id").cast("string").alias("message_id"), F.col("html").alias("text_html"), F.lit(False).alias("has_plain"), F.lit("").alias("body"), F.lit("").alias("annotation"), F.array().cast("array<string>").alias("label_names"),
    )


query("O_SRC_07_html_bodies", "select page_id, md5(html) as html_md5 from pages", views=False)(lambda s, d: _through_mailbox(_of_pages(s, d)).select(F.col("message_id").cast("long").alias("page_id"), F.md5("text_html").alias("html_md5")))


def _with_files(s, d):
    a = attachments(s, d, together=True).withColumn("data", F.encode("blob_id", "utf-8"))
    none = lambda k: F.lit(None).cast(k)
    part = F.struct("filename", F.lit("application/octet-stream").alias("content_type"), none("string").alias("charset"), F.length("data").cast("long").alias("size"), none("string").alias("sha1"), none("string").alias("text"), F.col("data").alias("content"))
    return _mail(s, d).join(a.groupBy("doc_id").agg(F.collect_list(part).alias("attachments")), "doc_id", "left")


@query("O_SRC_08_attachments", f"select {_ID}, filename, blob_id as content, length(blob_id) as size from attachments semi join heads using (doc_id)")
def _src08(s, d):
    a = F.explode("attachments").alias("a")
    return _through_mailbox(_with_files(s, d)).select("message_id", a).select("message_id", "a.filename", F.decode("a.content", "utf-8").alias("content"), "a.size")


query("O_SRC_04_resume", "select email_source, folder, max(doc_id) as last_uid from heads group by 1, 2")(lambda s, d: mbox.last_seen(heads(s, d), ["email_source", "folder"], "doc_id"))
query("O_SRC_04_unseen", ", l as (select email_source, folder, max(doc_id) as m from heads where doc_id < 700 and folder <> 'mail/P' group by 1, 2) select doc_id from heads left join l using (email_source, folder) where m is null or doc_id > m")(
    lambda s, d: mbox.unseen(heads(s, d), mbox.last_seen(heads(s, d).where("doc_id < 700 and folder != 'mail/P'"), ["email_source", "folder"], "doc_id"), ["email_source", "folder"], "doc_id").select("doc_id")
)
query("O_SNK_03_duplicates_again", "select folder, count(*) as n from (select folder from heads union all select 'copies' from heads where doc_id % 7 = 0) group by 1")(
    lambda s, d: export.with_duplicates(heads(s, d), heads(s, d).where("doc_id % 7 = 0").select(F.col("doc_id").alias("kept_doc_id"), F.lit("copies").alias("folder"))).groupBy("folder").agg(F.count("*").alias("n"))
)


@query("O_SNK_04_eml", "select doc_id || '.eml' as name, subject, from_email from heads")
def _snk04(s, d):
    f = export.eml(_mail(s, d))
    return f.select("name", F.regexp_extract("content", r"\nSubject: ([^\r\n]*)\r\n", 1).alias("subject"), F.regexp_extract("content", r'^From: "[^"]*" <([^>]*)>\r\n', 1).alias("from_email"))


# ---- tables and side files


@query("O_SRC_10_saved_archive", "select folder, count(distinct doc_id) as messages, count(*) as files from heads join attachments using (doc_id) group by 1")
def _src10(s, d):
    path = shared_folder(s, "archive")
    export.save_archive({"messages": heads(s, d), "attachments": attachments(s, d)}, path)
    t = side.read_archive(s, path, ["messages", "attachments"])
    return t["messages"].join(t["attachments"], "doc_id").groupBy("folder").agg(F.countDistinct("doc_id").alias("messages"), F.count("*").alias("files"))


@query("O_SRC_11_address_book", "select c_name as best_name, [c_name, 'other ' || c_name] as names, [lower(c_name) || '@' || lower(c_mktsegment) || '.example'] as emails from customer", views=False)
def _src11(s, d):
    c = read(s, d, "customer")
    path = shared_folder(s, "book")
    c.select(export.side_text(F.array("c_name", F.concat(F.lit("other "), F.col("c_name"))), F.array(F.concat("c_name", F.lit("@"), "c_mktsegment", F.lit(".example"))))).write.text(path)
    return side.read_address_book(s, path)


@query("O_SRC_12_entity_book", "select s_name as display, [s_name, 'the ' || s_name] as names from supplier", views=False)
def _src12(s, d):
    path = shared_folder(s, "entities")
    read(s, d, "supplier").select(export.side_text(F.array("s_name", F.concat(F.lit("the "), F.col("s_name"))), F.array().cast("array<string>"))).write.text(path)
    return side.read_entity_book(s, path)


@query("O_SRC_13_labels", "select label as label_id, 'name of ' || label as name, count(*) as n from heads group by 1")
def _src13(s, d):
    path, h = shared_folder(s, "labels"), heads(s, d).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("label").alias("label_id"))
    h.select("label_id", F.concat(F.lit("name of "), F.col("label_id")).alias("name")).distinct().write.json(path + "/defs")
    h.write.csv(path + "/held", header=True)
    defs, held = side.read_labels(s, path + "/defs", path + "/held")
    return held.join(defs, "label_id").groupBy("label_id", "name").agg(F.count("*").alias("n"))


@query("O_SRC_14_annotations", """select cast(doc_id as varchar) as doc_id, 'a "' || label || '", and' || chr(10) || folder as text from heads""")
def _src14(s, d):
    path = shared_folder(s, "annotations")
    heads(s, d).select("doc_id", F.concat(F.lit('a "'), F.col("label"), F.lit('", and\n'), F.col("folder")).alias("text")).write.csv(path, header=True, escape='"', quoteAll=True)
    return side.read_annotations(s, path)


@query("O_SRC_15_lexicon_file", "select r_name as caption, string_agg(lower(n_name), '|' order by n_name) as query from nation join region on n_regionkey = r_regionkey group by 1", views=False)
def _src15(s, d):
    rows = read(s, d, "nation").join(read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.concat("r_name", F.lit(": "), F.lower("n_name")).alias("value"))
    return side.read_lexicon(s, _lines(rows.unionByName(s.createDataFrame([("", "# a remark: not an entry")], "n_name string, value string")), "lexicon", "n_name"))


@query("O_SRC_18_triples", "select 'http://id.example/' || s_suppkey as subject, [s_name] as label, ['http://id.example/nation/' || s_nationkey] as place from supplier", views=False)
def _src18(s, d):
    sup = read(s, d, "supplier")
    subject = F.concat(F.lit("<http://id.example/"), F.col("s_suppkey").cast("string"), F.lit("> <http://terms.example/"))
    lines = sup.select(F.concat(subject, F.lit('x#label> "'), F.col("s_name"), F.lit('"@en .')).alias("value")).unionByName(sup.select(F.concat(subject, F.lit("place> <http://id.example/nation/"), F.col("s_nationkey").cast("string"), F.lit("> .")).alias("value")))
    path = shared_folder(s, "triples")
    lines.write.text(path)
    return side.read_triples(s, path, ["label", "place"])


@query("O_SRC_20_typed_names", "select p_name as name, p_brand as type from part", views=False)
def _src20(s, d):
    path = shared_folder(s, "types")
    read(s, d, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" "), F.col("p_brand"))).write.text(path)
    return side.read_typed_names(s, path)


@query("O_SRC_21_address_list", "select doc_id, subject from heads where contact_id <= 20 or exists (select 1 from recipients r where r.doc_id = heads.doc_id and r.contact_id = 2)")
def _src21(s, d):
    wanted = heads(s, d).where("contact_id <= 20").select(F.concat(F.lit(" "), F.upper("from_email")).alias("email")).unionByName(recipients(s, d).where("contact_id = 2").select("email"))
    path = shared_folder(s, "addresses")
    wanted.distinct().write.csv(path, header=True)
    return side.select_by_address_list(archive(s, d)["messages"], s.read.csv(path, header=True, ignoreLeadingWhiteSpace=False)).select("doc_id", "subject")


query("O_SRC_16_live_documents", "select doc_id, subject from heads where doc_id % 5 <> 0")(lambda s, d: archives.live(archives.remove(heads(s, d), heads(s, d).where("doc_id % 5 = 0"))).select("doc_id", "subject"))


@query("O_SNK_05_result_csv", "select strftime(date, '%Y-%m-%d %H:%M:%S') as d, '\"' || from_name || '\" <' || from_email || '>' as f, subject as s, folder, case when amount > 300000 then 'large sum' else '' end as note, label, 11 as columns from heads")
def _snk05(s, d):
    path = shared_folder(s, "result")
    export.result_csv(_mail(s, d)).write.csv(path, header=True, escape='"', emptyValue="")
    got = s.read.csv(path, header=True, escape='"')
    return got.select(F.col("`Date:`").alias("d"), F.col("`From:`").alias("f"), F.col("`Subject:`").alias("s"), F.col("`X-Archive-Folder:`").alias("folder"), F.coalesce("`X-Archive-Annotation:`", F.lit("")).alias("note"), F.col("`X-Archive-Labels:`").alias("label"), F.lit(len(got.columns)).alias("columns"))


query("O_SNK_06_authorities_csv", "select cast(n_nationkey as varchar) as id, case when n_nationkey % 3 = 0 or n_nationkey % 3 = 1 then 'unknown' else n_name end as name from nation", views=False)(
    lambda s, d: export.authorities_csv(read(s, d, "nation").selectExpr("n_nationkey as id", "case n_nationkey % 3 when 0 then null when 1 then '?' else n_name end as name"))
)
query("O_SNK_08_book_text", "select '--' || chr(10) || c_name || chr(10) || lower(c_name) || '@' || lower(c_mktsegment) || '.example' || chr(10) as record from customer", views=False)(
    lambda s, d: read(s, d, "customer").select(export.side_text(F.array("c_name"), F.array(F.concat(F.lower("c_name"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example")))).alias("record"))
)
query("O_SNK_12_json_rows", """select '{"doc_id":' || doc_id || ',"folder":"' || folder || '","n":' || n || '}' as json from heads join (select doc_id, count(*) as n from attachments group by 1) using (doc_id)""")(
    lambda s, d: export.as_json(heads(s, d).select("doc_id", "folder").join(attachments(s, d).groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id"))
)
query("O_PRJ_14_message_json", """select '{"date":"' || strftime(date, '%Y-%m-%d') || '","from":"' || from_email || '","subject":"' || subject || '"}' as json from heads""")(
    lambda s, d: export.as_json(heads(s, d).select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("from_email").alias("from"), "subject"))
)


@query("O_SNK_09_filtered_copy", "select 'messages' as name, count(*) as n, 'date,doc_id,folder' as columns from heads where folder = 'mail/F' union all select 'attachments', count(*), 'blob_id,doc_id,size' from attachments semi join (select doc_id from heads where folder = 'mail/F') using (doc_id)")
def _snk09(s, d):
    path = shared_folder(s, "copy")
    t = {"messages": heads(s, d).select("doc_id", "date", "folder", "subject"), "attachments": attachments(s, d).select("doc_id", "blob_id", "size", "filename")}
    names = export.copy_archive(t, path, F.col("folder") == "mail/F", ("subject", "filename"))
    got = side.read_archive(s, path, names)
    each = [df.agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.lit(",".join(sorted(df.columns))).alias("columns")) for n, df in got.items()]
    return each[0].unionByName(each[1])


def _bag(s, d):
    return heads(s, d).select(F.concat(F.lit("data/"), F.col("doc_id").cast("string")).alias("path"), F.encode("subject", "utf-8").alias("content"))


query("O_SNK_10_manifest", "select 'data/' || doc_id as path, md5(subject) as md5, sha256(subject) as sha256, cast(length(subject) as integer) as size from heads")(lambda s, d: export.manifest(_bag(s, d)))
query("O_SNK_10_verified_bag", "select 'data/' || doc_id as path, case when doc_id % 5 = 0 then 'missing' when doc_id % 3 = 0 then 'added' else 'changed' end as state from heads where doc_id % 5 = 0 or doc_id % 3 = 0 or doc_id % 2 = 0")(
    lambda s, d: export.verify(
        _bag(s, d).where("substr(path, 6) % 5 != 0").withColumn("content", F.expr("if(substr(path, 6) % 2 = 0, encode('other', 'utf-8'), content)")),
        export.manifest(_bag(s, d).where("substr(path, 6) % 5 = 0 or substr(path, 6) % 3 != 0")),
    )
)
query("O_SNK_11_events", "select 'ingest' as type, folder as detail, 'success' as outcome, count(*) as n from heads group by 2")(
    lambda s, d: heads(s, d).select(export.event("ingest", "x").alias("e"), "folder").select("e.type", F.col("folder").alias("detail"), "e.outcome").groupBy("type", "detail", "outcome").agg(F.count("*").alias("n"))
)
query("O_SNK_13_text_dump", "select doc_id || '.full' as name, subject || chr(10) || chr(10) || 'Dear ' || from_name || chr(10) as content from heads union all select doc_id || '.names', replace(lower(from_name), ' ', '_') || chr(10) from heads")(
    lambda s, d: export.text_dump(heads(s, d).withColumn("body", F.concat(F.lit("Dear "), F.col("from_name"))), _found(s, d))
)
query(
    "O_SNK_14_header_csv",
    "select doc_id, strftime(date, '%Y-%m-%d') as date, from_email as from_ids, from_name as from_names, coalesce(t, '') as to_ids, coalesce(n, '') as to_names, '' as cc_ids, '' as cc_names, '' as bcc_ids, '' as bcc_names, subject from heads left join (select doc_id, string_agg(email, ';' order by name) as t, string_agg(upper(name) || '_', ';' order by name) as n from recipients group by 1) using (doc_id)",
)(lambda s, d: export.header_rows(_mail(s, d), heads(s, d).select(F.col("from_email").alias("email"), F.col("from_name").alias("best_name")).distinct().unionByName(recipients(s, d).select("email", F.concat(F.upper("name"), F.lit(";")).alias("best_name")).distinct())))
query("O_SNK_15_image_keywords", "select distinct blob_id, unnest([p_brand, p_type]) as keyword from attachments join part on content = p_partkey where ext = 'jpg'")(
    lambda s, d: archives.image_keywords(attachments(s, d), read(s, d, "part").select(F.concat(F.lit("PART"), F.col("p_partkey").cast("string"), F.lit(".JPG")).alias("file"), F.concat_ws(",", "p_brand", "p_type").alias("keywords")))
)

# ---- joins of an archive

query("O_JOIN_05_annotations", "select doc_id, case when amount > 300000 then 'large ' || label else '' end as annotation from heads")(lambda s, d: archives.with_annotation(heads(s, d), archive(s, d)["annotations"]).select("doc_id", "annotation"))
query("O_JOIN_06_accessions", "select doc_id, case when doc_id % 4 = 0 then 'second' else 'base' end as accession_id from heads")(lambda s, d: archives.with_accession(heads(s, d), heads(s, d).where("doc_id % 4 = 0").select("doc_id", F.lit("second").alias("accession_id"))).select("doc_id", "accession_id"))
query("O_JOIN_07_attachment_hits", "select doc_id, list_sort(list(distinct blob_id)) as matched from attachments semi join heads using (doc_id) where ext = 'pdf' and size > 100000 group by 1")(
    lambda s, d: archives.with_attachment_hits(heads(s, d), attachments(s, d), attachments(s, d).where("ext = 'pdf' and size > 100000")).select("doc_id", "matched")
)


def _aliases(s, d):
    c = read(s, d, "customer").select(F.explode(F.array(F.lit(1), F.lit(3))).alias("type"), T.entity_key(F.col("c_name")).alias("alias"), F.concat(F.lit("e"), (F.col("c_custkey") % 10).cast("string")).alias("entity"), "c_custkey")
    return c.where("type = 1 or c_custkey % 2 = 0").drop("c_custkey")


query("O_JOIN_08_linked_mentions", "select doc_id, 'e' || contact_id % 10 as entity from heads where label = '1-URGENT' or contact_id % 2 = 0")(lambda s, d: archives.link_mentions(_found(s, d), _aliases(s, d)).select("doc_id", "entity"))
query("O_JOIN_09_documents_of_entities", "select doc_id from heads where (label = '1-URGENT' or contact_id % 2 = 0) and contact_id % 10 in (3, 4)")(lambda s, d: archives.documents_of_entities(archives.link_mentions(_found(s, d), _aliases(s, d)), ["e3", "e4"]))
query("O_JOIN_10_documents_of_hits", "select doc_id, subject from heads where doc_id % 2 = 0")(lambda s, d: archives.documents_of(heads(s, d), heads(s, d).where("doc_id % 2 = 0").select("doc_id").unionByName(heads(s, d).select((-F.col("doc_id") - 1).alias("doc_id")))).select("doc_id", "subject"))
query("O_JOIN_03_message_contacts", "select distinct doc_id, contact_id + case when contact_id % 2 = 0 then 0 else k * 1000000 end as contact_id from recipients, (values (0), (1)) v(k)")(
    lambda s, d: archives.message_contacts(
        recipients(s, d).select("doc_id", "name", F.when(F.col("contact_id") % 2 == 0, F.col("email")).otherwise("gone@nowhere.example").alias("email")),
        read(s, d, "supplier").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "s_suppkey", "s_name").select((F.col("s_suppkey") + F.col("k") * 1_000_000).alias("contact_id"), F.concat(F.lower("s_name"), F.when(F.col("k") == 0, "@supply.example").otherwise("@second.example")).alias("email"), F.array("s_name").alias("names")),
    )
)
query("O_JOIN_18_co_occurring", ", m as (select distinct doc_id, split_part(name, '#', 2) || ' supplier' as cname from recipients semi join (select doc_id from heads where contact_id = 1) using (doc_id)) select cname, count(*) as n from m group by 1")(
    lambda s, d: entities.co_occurring(_found(s, d).select("doc_id", "text").unionByName(recipients(s, d).select("doc_id", F.col("name").alias("text"))), "Customer#000000001")
)
query("O_NER_11_expansions", "select from_name as text, count(*) as n from heads where contact_id between 1 and 9 group by 1")(
    lambda s, d: entities.expansions(_found(s, d), heads(s, d).select("doc_id", F.col("contact_id").alias("thread_id"), F.lit(False).alias("asks")), "customer#00000000", None).where("text != 'Customer#000000000'").select("text", "n")
)

# ---- filters


def _hit(spec: SearchSpec, more=None):
    return lambda s, d: search({**archive(s, d), **(more(s, d) if more else {})}, spec).select("doc_id", "subject", "folder")


def _lexicon(s, d):
    return {"messages": heads(s, d).withColumn("body", F.lit(""))}, s.createDataFrame([("tone", "hot", "urgent|high"), ("regex", "marked", r"[12]-(URG|HI)")], "name string, caption string, expanded string")


query("O_FLT_07_correspondent_list", "select doc_id, subject, folder from heads where contact_id = 3 or exists (select 1 from recipients r where r.doc_id = heads.doc_id and r.contact_id in (1, 2))")(_hit(SearchSpec(correspondent_list="Customer#000000003\nsupplier#000000001@supply.example\n\n Supplier#000000002 ", roles=("to",))))


@query("O_FLT_09_unique_ids", ", u as (select min(doc_id) as a, max(doc_id) as b from heads) select doc_id from heads, u where doc_id in (a, b)")
def _flt09(s, d):
    m = messages.with_uid(heads(s, d))
    ends = m.agg(F.min_by("uid", "doc_id").alias("a"), F.max_by("uid", "doc_id").alias("b")).first()  # one row
    return search({"messages": m}, SearchSpec(unique_ids=f" {ends.a};{ends.b.upper()} ;none")).select("doc_id")


query("O_FLT_18_attachment_dates", "select blob_id from attachments join heads using (doc_id) where date >= timestamp '1996-02-01' and date < timestamp '1996-03-01'")(lambda s, d: archives.attachments_between(attachments(s, d), heads(s, d), "1996-02-01", "1996-02-29").select("blob_id"))


@query("O_FLT_19_lexicon", "select doc_id, subject from heads where label in ('1-URGENT', '2-HIGH')")
def _flt19(s, d):
    t, lex = _lexicon(s, d)
    return search(t, SearchSpec(lexicon=lex, lexicon_name="tone", lexicon_caption="hot")).select("doc_id", "subject")


@query("O_FLT_19_lexicon_regex", "select doc_id, subject from heads where label in ('1-URGENT', '2-HIGH')")
def _flt19r(s, d):
    t, lex = _lexicon(s, d)
    return search(t, SearchSpec(lexicon=lex, lexicon_name="regex", lexicon_caption="marked")).select("doc_id", "subject")


@query("O_FLT_21_attachment_keywords", "select distinct doc_id from attachments semi join heads using (doc_id) where content % 7 in (2, 3)")
def _flt21(s, d):
    a = attachments(s, d).withColumn("keywords", F.array(F.concat(F.lit("k"), (F.col("content") % 7).cast("string")))).groupBy("doc_id").agg(F.collect_list(F.struct("filename", "ext", "size", "keywords")).alias("attachments"))
    return search({"messages": heads(s, d).join(a, "doc_id")}, SearchSpec(attachment_keywords=["K2", "k3"])).select("doc_id")


query("O_FLT_23_any_annotation", "select doc_id, subject, folder from heads where amount > 300000")(_hit(SearchSpec(annotated=True)))
query("O_FLT_32_bulk_addresses", "select doc_id, subject, folder from heads where exists (select 1 from recipients r where r.doc_id = heads.doc_id and r.contact_id in (1, 4))")(
    lambda s, d: side.select_by_address_list(archive(s, d)["messages"], recipients(s, d).where("contact_id in (1, 4)").select(F.upper("email").alias("email"))).select("doc_id", "subject", "folder")
)
query("O_JOIN_11_all_filters", f"select doc_id, subject, folder from heads where label = '1-URGENT' and amount > 300000 and from_email <> '{OWNER}' and doc_id % 4 <> 0")(_hit(SearchSpec(labels=["1-URGENT"], annotated=True, accessions=["base"], direction="in", owner=OWNER)))

# ---- archives

query("O_PRJ_01_direction", "select doc_id, case when contact_id = 1 then 1 else 2 end as bits from heads")(lambda s, d: archives.direction(archive(s, d)["contact_docs"], heads(s, d), 1))
query("O_PRJ_10_indexed_body", "select doc_id, least(length(repeat(text, 40)), 32766) as n, md5(left(repeat(text, 40), 32766)) as md5 from documents where text is not null", views=False)(
    lambda s, d: read(s, d, "documents").where("text is not null").select("doc_id", archives.indexed_body(F.repeat("text", F.lit(40))).alias("b")).select("doc_id", F.length("b").alias("n"), F.md5("b").alias("md5"))
)
query("O_PRJ_11_edited_bodies", "select doc_id, case when doc_id % 4 = 0 then 'second' when doc_id % 2 = 0 then 'first' else subject end as body, case when doc_id % 2 = 0 then subject end as body_preserved from heads")(
    lambda s, d: archives.edit_bodies(
        archives.edit_bodies(heads(s, d).select("doc_id", F.col("subject").alias("body")), heads(s, d).where("doc_id % 2 = 0").select("doc_id", F.lit("first").alias("body"))),
        heads(s, d).where("doc_id % 4 = 0").select("doc_id", F.lit("second").alias("body")),
    )
)
query("O_TXT_13_documents_changed", "select doc_id, case when doc_id % 2 = 0 then 'Edited' else subject end as subject from heads where (doc_id % 3 <> 0 or doc_id % 2 = 0) and (doc_id % 5 <> 0 or doc_id % 10 = 0)")(
    lambda s, d: (
        lambda h: archives.live(archives.restore(archives.remove(archives.put(h.where("doc_id % 3 != 0"), h.where("doc_id % 2 = 0").withColumn("subject", F.lit("Edited"))), h.where("doc_id % 5 = 0")), h.where("doc_id % 10 = 0")))
    )(heads(s, d).select("doc_id", "subject")).select("doc_id", "subject")
)


@query("O_MRG_01_archives", "select case when doc_id % 3 = 0 then 'second' else 'first' end as accession_id, count(*) as messages, cast(sum(case when amount > 300000 then 1 else 0 end) as bigint) as notes from heads where doc_id % 3 <> 0 or doc_id % 2 = 0 group by 1")
def _mrg01(s, d):
    m, notes = messages.with_uid(heads(s, d)), archive(s, d)["annotations"]

    def part(where):
        some = m.where(where)
        return {"messages": some, "accessions": some.select("doc_id", F.lit("first").alias("accession_id")), "annotations": notes.join(some, "doc_id", "left_semi")}

    got = archives.merge_archives(part("doc_id % 3 != 0"), part("doc_id % 2 = 0"), "second")
    held = got["annotations"].select("doc_id", F.lit(1).alias("note"))
    return got["messages"].join(got["accessions"], "doc_id").join(held, "doc_id", "left").groupBy("accession_id").agg(F.count("*").alias("messages"), F.sum(F.coalesce("note", F.lit(0))).alias("notes"))


query("O_MRG_02_descriptions", "select n_nationkey, case when n_nationkey % 4 = 0 then r_name when n_nationkey % 4 = 1 then n_name when n_nationkey % 4 = 2 then n_name else n_name || '+' || r_name end as field from nation join region on n_regionkey = r_regionkey", views=False)(
    lambda s, d: read(s, d, "nation").join(read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", archives.merged_field(F.expr("if(n_nationkey % 4 = 0, null, n_name)"), F.expr("case n_nationkey % 4 when 1 then null when 2 then n_name else r_name end")).alias("field"))
)
query("O_AGG_13_contact_table", ROLES + "select contact_id, count(distinct case when role = 'sent' then doc_id end) as sent, count(distinct case when role = 'received' then doc_id end) as received, count(distinct case when role = 'received_from_owner' then doc_id end) as received_from_owner, min(date) as first, max(date) as last from roles r join (select doc_id, date from heads) using (doc_id) group by 1")(
    lambda s, d: contacts.summaries(archive(s, d)["contact_docs"], heads(s, d))
)
query("O_AGG_14_date_range", "select min(date) as first, max(date) as last from heads where doc_id % 2 = 0 and label <> '5-LOW'")(lambda s, d: archives.date_range(heads(s, d).withColumn("date", F.expr("if(doc_id % 2 = 0, date, timestamp'1960-01-01')")), F.col("label") == "5-LOW"))
query("O_STR_17_file_classes", "select blob_id, case when content % 5 = 0 then 'document' when content % 5 = 1 then 'image' when content % 5 = 2 then 'office' when content % 5 = 3 then 'archive' else 'other' end as class from attachments")(
    lambda s, d: attachments(s, d).select("blob_id", T.file_class(T.extension(F.col("filename"))).alias("class"))
)

# ---- text

_COUNT = r"with t as (select doc_id, string_split_regex(lower(text), '[^\p{L}\p{N}]+') as w from documents) "


def _bodies(s, d):
    return read(s, d, "documents").select("doc_id", F.col("text").alias("body"), F.col("source").alias("subject"), F.lit(None).cast("timestamp").alias("date"))


query("O_TXT_08_least_count", _COUNT + "select doc_id from t where len(list_filter(w, lambda x: x in ('idiot', 'idiots'))) >= 2", views=False)(lambda s, d: search({"messages": _bodies(s, d)}, SearchSpec(term="idiot", least_count=2)).select("doc_id"))
query("O_TXT_09_hit_count", "select count(*) as hits from heads where label = '1-URGENT' or label = '2-HIGH'")(lambda s, d: count_hits({"messages": heads(s, d).withColumn("body", F.lit(None).cast("string"))}, SearchSpec(term="urgent OR high")))
query("O_TXT_12_attachment_by_name", "select blob_id, size from attachments where filename = 'part11.jpg'")(lambda s, d: archives.attachment_content(attachments(s, d), "part11.jpg").select("blob_id", "size"))
query("O_TXT_14_matched_terms", "select doc_id, case label when '1-URGENT' then ['urgent'] when '2-HIGH' then ['HIGH'] when '4-NOT SPECIFIED' then ['not specified'] else [] end as terms from heads")(lambda s, d: heads(s, d).select("doc_id", fulltext.matched_terms(fulltext.tokens(F.col("subject")), ["urgent", "HIGH", "not specified"]).alias("terms")))
query("O_PRJ_13_highlights", "select doc_id, replace(replace(subject, 'URGENT', '<mark>URGENT</mark>'), 'LOW', '<mark>LOW</mark>') as subject from heads")(lambda s, d: heads(s, d).select("doc_id", fulltext.highlight(F.col("subject"), ["urgent", "low", "dium"]).alias("subject")))
query("O_SRT_02_relevance", _COUNT + "select doc_id, len(list_filter(w, lambda x: x in ('idiot', 'idiots', 'moron', 'morons'))) as score from t order by score desc, doc_id limit 10000", views=False)(
    lambda s, d: ordered(_bodies(s, d).withColumn("subject", F.lit("")), "relevance", 10_000, "idiot moron").select("doc_id", "score")
)
query("O_AGG_30_lens", _COUNT + ", p(term, page_score, boost) as (values ('idiot', 0.5, 2.0), ('moron', 1.5, 1.0), ('zzzzz', 3.0, 1.0), ('trash', 2.0, 0.0)) select term, cast(coalesce(n, 0) as bigint) as index_score, cast(page_score * coalesce(n, 0) * boost as double) as score from p left join (select term, count(*) as n from p join t on list_contains(w, term) group by 1) using (term)", views=False)(
    lambda s, d: entities.lens(read(s, d, "documents"), s.createDataFrame([("Idiot!", 0.5, 2.0), ("moron", 1.5, 1.0), ("zzzzz", 3.0, 1.0), ("trash", 2.0, 0.0), ("of", 9.0, 9.0)], "term string, page_score double, boost double"))
)

query("O_SRC_17_point_lookup", "select doc_id, subject from heads where doc_id = 33")(lambda s, d: search({"messages": heads(s, d)}, SearchSpec(doc_ids=[33])).select("doc_id", "subject"))


@query("O_SNK_01_added_archive", "select folder, count(*) as n from heads group by 1")
def _snk01(s, d):
    path = shared_folder(s, "archive")
    export.save_archive({"messages": heads(s, d).where("doc_id % 3 = 0")}, path)
    export.save_archive({"messages": heads(s, d).where("doc_id % 3 != 0")}, path, "append")
    return side.read_archive(s, path, ["messages"])["messages"].groupBy("folder").agg(F.count("*").alias("n"))


query("O_SNK_07_exported_names", "select filename, count(*) as n, max(k) as last from (select *, row_number() over (partition by lower(filename) order by blob_id) - 1 as k from attachments where ext in ('pdf', 'jpg')) group by 1")(
    lambda s, d: facets.filename_numbers(attachments(s, d).where("ext in ('pdf', 'jpg')")).groupBy("filename").agg(F.count("*").alias("n"), F.max(F.coalesce(F.expr(r"try_cast(nullif(regexp_extract(export_name, ' [(]([0-9]+)[)]', 1), '') as bigint)"), F.lit(0))).alias("last"))
)


@query("O_PRJ_05_date_policy", "select doc_id, case when doc_id % 4 = 0 then timestamp '1960-01-01' when doc_id % 4 = 3 then timestamp '1931-05-06 07:08:09' else date end as date, doc_id % 4 in (0, 3) as hacky_date from heads")
def _prj05(s, d):
    day = F.date_format("date", "EEE, dd MMM yyyy HH:mm:ss Z")
    head = F.expr("doc_id % 4")
    lines = F.when(head == 1, F.concat(F.lit("\nDate: "), day)).when(head == 2, F.concat(F.lit("\nDate: soon\nReceived: from a by b; "), day)).when(head == 3, F.lit("\nDate: Wed, 06 May 1931 07:08:09 +0000")).otherwise("")
    path = shared_folder(s, "dates")
    heads(s, d).select(F.concat(F.lit("From -\nFrom: a@b.example"), lines, F.lit("\nMessage-ID: "), F.col("doc_id").cast("string"), F.lit("\n\ntext\n"))).write.text(path)
    return mbox.read_mbox(s, path).select(F.col("message_id").cast("long").alias("doc_id"), "date", "hacky_date")


query("O_NER_17_owner", "select case when s_suppkey between 1 and 3 then 1 else s_suppkey end as contact_id, case when s_suppkey between 1 and 3 then 3 else 1 end as names, s_suppkey between 1 and 3 as is_owner from supplier where s_suppkey not in (2, 3)", views=False)(
    lambda s, d: contacts.set_owner(read(s, d, "supplier").select(F.col("s_suppkey").alias("contact_id"), F.array(F.concat(F.lower("s_name"), F.lit("@supply.example"))).alias("emails"), F.array("s_name").alias("names")), [f" Supplier#00000000{i}@supply.example" for i in (1, 2, 3)]).select("contact_id", F.size("names").alias("names"), "is_owner")
)
query("O_AUT_01_confirmed", "select c_custkey as contact_id, case when c_custkey % 3 = 0 then -c_custkey else c_custkey end as authority_id from customer where c_custkey % 2 = 0 and c_custkey % 3 <> 1 or c_custkey % 3 = 0", views=False)(
    lambda s, d: contacts.confirm_authorities(
        read(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("contact_id"), F.col("c_custkey").alias("authority_id")),
        read(s, d, "customer").where("c_custkey % 3 < 2").select(F.col("c_custkey").alias("contact_id"), F.expr("if(c_custkey % 3 = 0, -c_custkey, null)").alias("authority_id")),
    )
)
query("O_STR_26_merge_validity", "select c_custkey, c_custkey % 6 < 4 as ok from customer", views=False)(
    lambda s, d: read(s, d, "customer").select(
        "c_custkey",
        T.may_merge(
            F.expr("case c_custkey % 6 when 0 then concat('Dr. Ann ', c_name) when 1 then concat(c_name, ', Ann') when 2 then 'World Health Organization' when 3 then concat('Sen. Ann ', c_name) when 4 then concat('Ann ', c_name, ' Lee') else 'Market' end"),
            F.expr("case c_custkey % 6 when 0 then concat('Ann ', c_name) when 1 then concat('Ann ', c_name) when 2 then 'WHO' when 3 then concat('Senator Ann ', c_name) when 4 then 'Bob Lee' else 'market town' end"),
            ["market"],
        ).alias("ok"),
    )
)
_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
query("O_TXT_03_stop_words", rf"select doc_id, cast(len(list_filter(string_split_regex(lower(regexp_replace(text, '([''’])s([^\p{{L}}\p{{N}}_]|$)', '\1\2', 'g')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '' and x not in ({_STOPS}))) as integer) as n from documents", views=False)(
    lambda s, d: read(s, d, "documents").select("doc_id", F.size(F.filter(fulltext.tokens(F.col("text"), stemmed=False), lambda w: w != "")).alias("n"))
)


def _asks(term: str):
    return lambda s, d: search({"messages": heads(s, d).withColumn("body", F.concat(F.lit("about "), F.col("folder"), F.lit(" low")))}, SearchSpec(term=term)).select("doc_id")


query("O_TXT_05_fields", "select doc_id from heads where label = '5-LOW' or folder = 'mail/O'")(_asks("subject:low OR body:o"))
query("O_TXT_02_porter", "select doc_id from heads where label in ('2-HIGH', '4-NOT SPECIFIED')")(
    lambda s, d: search({"messages": heads(s, d).withColumn("body", F.expr("case label when '2-HIGH' then 'we were running late' when '1-URGENT' then 'a rune' when '4-NOT SPECIFIED' then 'he runs' else 'generalizations' end"))}, SearchSpec(term="run OR relational")).select("doc_id")
)
query("O_FLT_02_anchors", "select doc_id from heads where label in ('1-URGENT', '3-MEDIUM')")(
    lambda s, d: search({"messages": heads(s, d).withColumn("body", F.expr("case label when '1-URGENT' then 'foo first' when '2-HIGH' then 'last foo' when '3-MEDIUM' then 'Foo, then order' else 'none' end"))}, SearchSpec(regex=r"^foo|order$|x*")).select("doc_id")
)
query("O_TXT_10_regex_counts", "select doc_id from heads where label in ('1-URGENT', '3-MEDIUM')")(
    lambda s, d: search({"messages": heads(s, d).withColumn("body", F.expr("case label when '1-URGENT' then 'order and ORDER' when '2-HIGH' then 'order' when '3-MEDIUM' then 'orders, ordered' else 'border' end"))}, SearchSpec(regex=r"\border|q*", least_count=3)).select("doc_id")
)
query("O_TXT_07_wildcard", "select doc_id from heads where label in ('1-URGENT', '3-MEDIUM')")(_asks("subject:urg* OR subject:me?ium"))
query("O_TXT_07_fuzzy", "select doc_id from heads where label = '1-URGENT'")(_asks("subject:urgant~1"))
query("O_TXT_07_required_and_barred", "select doc_id from heads where label = '1-URGENT' and folder <> 'mail/F'")(_asks("+urgent -f order"))
query("O_TXT_10_regex_any_case", "select doc_id, subject from heads where label in ('1-URGENT', '5-LOW')")(lambda s, d: search({"messages": heads(s, d).withColumn("body", F.lit("x"))}, SearchSpec(regex=r"\border (1|5)-[a-z]+\b")).select("doc_id", "subject"))
query("O_TXT_11_expanded_lexicon", "with t as (select doc_id, string_split_regex(lower(text), '[^\\p{L}\\p{N}]+') as w from documents), f as (select doc_id, list_contains(w, 'idiot') or list_contains(w, 'idiots') as a, list_contains(w, 'trash') as b from t) select doc_id, 'insult' as caption from f where a union all select doc_id, 'any' from f where a or b union all select doc_id, 'None' from f where not a and not b", views=False)(
    lambda s, d: entities.lexicon_hits(read(s, d, "documents"), {"any": "{insult}|trash", "insult": "idiot"})
)
query("O_TXT_16_leads_by_line", "with p(term, k) as (values ('you idiot', 1.0), ('idiot', 2.0)), t as (select doc_id, ' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ' as w from documents) select term, count(*) as index_score, cast(k * count(*) as double) as score from p join t on contains(w, ' ' || term || ' ') group by term, k", views=False)(
    lambda s, d: entities.leads(read(s, d, "documents"), s.createDataFrame([(0, "Idiot\nyou idiot!\n\nidiot\nof\nno such phrase here")], "doc_id long, text string"), by_line=True)
)
