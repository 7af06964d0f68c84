"""The message model over the provided tables.

The provided tables hold no mail, so queries view them as one archive: an order is a
message (its customer the sender, suppliers of its lines the recipients, its lines
the attachments, its status and priority the folder and label), a document is a
message body.  The same views are written as SQL in `VIEWS`, so each query can be
held against SQL over the very same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder separators, owner and accession of the viewed archive.
OWNER = "customer#000000001@machinery.example"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per order: doc_id, date, folder, label, source, sender name and address, subject."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("doc_id"),
        F.col("o_orderdate").alias("date"),
        F.concat(F.lit("mail/"), F.col("o_orderstatus")).alias("folder"),
        F.col("o_orderpriority").alias("label"),
        F.col("c_mktsegment").alias("email_source"),
        F.col("c_name").alias("from_name"),
        F.concat(F.lower("c_name"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example")).alias("from_email"),
        F.concat(F.when(F.col("o_orderkey") % 3 == 0, "Re: ").otherwise(""), F.lit("Order "), F.col("o_orderpriority")).alias("subject"),
        F.col("o_custkey").alias("contact_id"),
        F.col("o_totalprice").alias("amount"),
    )


def attachments(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """A row per order line: doc_id, blob_id, filename, ext, size; those of a message brought `together` as numbers, before names are made."""
    line = read(spark, sf_dir, "lineitem")
    line = line.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").repartition("l_orderkey") if together else line
    ext = F.when(F.col("l_partkey") % 5 == 0, "pdf").when(F.col("l_partkey") % 5 == 1, "jpg").when(F.col("l_partkey") % 5 == 2, "doc").when(F.col("l_partkey") % 5 == 3, "zip")
    return line.select(
        F.col("l_orderkey").alias("doc_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("blob_id"),
        F.concat(F.lit("part"), F.col("l_partkey").cast("string"), F.coalesce(F.concat(F.lit("."), ext), F.lit(""))).alias("filename"),
        ext.alias("ext"),
        (F.col("l_quantity") * 4096).cast("long").alias("size"),
        F.col("l_partkey").alias("content"),
    )


def recipients(spark: SparkSession, sf_dir: str, tasks: int | None = None, together: bool = False) -> DataFrame:
    """A row per message and recipient: doc_id, contact_id (supplier), name, email; made distinct in so many `tasks`, or where those of a message are brought `together`."""
    line, s = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier")
    line = line.select(F.col("l_orderkey").alias("doc_id"), "l_suppkey")
    line = line.repartition("doc_id") if together else line.repartition(tasks, "doc_id", "l_suppkey") if tasks else line
    return line.distinct().join(s, F.col("l_suppkey") == s.s_suppkey).select("doc_id", F.col("s_suppkey").alias("contact_id"), F.col("s_name").alias("name"), F.concat(F.lower("s_name"), F.lit("@supply.example")).alias("email"))


VIEWS = """
with heads as (
  select o_orderkey as doc_id, o_orderdate as date, 'mail/' || o_orderstatus as folder, o_orderpriority as label, c_mktsegment as email_source,
         c_name as from_name, lower(c_name) || '@' || lower(c_mktsegment) || '.example' as from_email,
         case when o_orderkey % 3 = 0 then 'Re: ' else '' end || 'Order ' || o_orderpriority as subject, o_custkey as contact_id, o_totalprice as amount
  from orders join customer on o_custkey = c_custkey),
attachments0 as (
  select l_orderkey as doc_id, l_orderkey || '-' || l_linenumber as blob_id, l_quantity, l_partkey as content,
         case l_partkey % 5 when 0 then 'pdf' when 1 then 'jpg' when 2 then 'doc' when 3 then 'zip' end as ext from lineitem),
attachments as (select doc_id, blob_id, 'part' || content || coalesce('.' || ext, '') as filename, ext, cast(l_quantity * 4096 as bigint) as size, content from attachments0),
recipients as (
  select distinct l_orderkey as doc_id, s_suppkey as contact_id, s_name as name, lower(s_name) || '@supply.example' as email
  from lineitem join supplier on l_suppkey = s_suppkey)
"""
