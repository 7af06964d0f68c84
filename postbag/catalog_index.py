"""Queries over a written index of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from postbag.catalog import query
from postbag.functions import text as T
from postbag.operators.model import read
from postbag.plans.index import B, K1, Index
from postbag.sinks.shared import shared_folder


def _index(s, d, fields):
    """The documents as messages (text is the body, the source the subject), added in two batches."""
    docs = read(s, d, "documents").select("doc_id", F.col("text").alias("body"), F.col("source").alias("subject"))
    index = Index(s, shared_folder(s, "index"), fields)
    index.add(docs.where("doc_id % 2 = 0"))
    index.add(docs.where("doc_id % 2 <> 0"))
    return index


_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
#: Words of a text as the number-aware profile has them, stop words left out; the stems of the words asked for are spelt out.
_WORDS = rf"list_filter(regexp_extract_all(lower(regexp_replace(text, '([''’])s([^\p{{L}}\p{{N}}_]|$)', '\1\2', 'g')), '([0-9]+(?:[.,:/-][0-9]+)+|[\p{{L}}\p{{N}}]+)', 1), lambda x: x not in ({_STOPS}))"

query(
    "O_TXT_01_field_terms",
    rf"""
with t as (select doc_id, unnest(list_filter(string_split_regex(lower(regexp_replace(text, '([''’])s([^\p{{L}}\p{{N}}_]|$)', '\1\2', 'g')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '' and x not in ({_STOPS}))) as w from documents)
select 'body' as field, count(distinct w) as terms, (select count(*) from (select distinct doc_id, w from t)) as postings, count(*) as words from t
union all select 'subject', count(distinct source), count(*), count(*) from documents where source <> ''""",
    views=False,
)(lambda s, d: _index(s, d, {"body": "standard", "subject": "keyword"}).postings().groupBy("field").agg(F.countDistinct("term").alias("terms"), F.count("*").alias("postings"), F.sum("tf").alias("words")))

query(
    "O_SRT_02_ranked",
    f"""
with t as (select doc_id, {_WORDS} as w from documents), l as (select doc_id, len(w) as len, w from t where len(w) > 0),
n as (select count(*) as m, sum(len) / count(*) as mean from l),
x as (select doc_id, len, case when w in ('idiot', 'idiots') then 'idiot' when w in ('trash', 'trashed', 'trashes', 'trashing') then 'trash' when w in ('license', 'licensed', 'licenses', 'licensing') then 'licens' end as term
      from (select doc_id, len, unnest(w) as w from l)),
tf as (select doc_id, len, term, count(*) as tf from x where term is not null group by all),
df as (select term, count(*) as df from tf group by term)
select doc_id, round(sum(ln(1 + (m - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * len / mean))), 6) as score from tf join df using (term), n group by doc_id""",
    views=False,
)(lambda s, d: _index(s, d, {"body": "number", "subject": "number"}).search("idiots OR trash licenses", ("body",)).select("doc_id", F.round("score", 6).alias("score")))

query(
    "O_TXT_06_indexed_phrase",
    f"""
with t as (select doc_id, ' ' || array_to_string(list_transform(regexp_extract_all(lower(text), '([0-9]+(?:[.,:/-][0-9]+)+|[\\p{{L}}\\p{{N}}]+)', 1), lambda x: case when x in ({_STOPS}) then '#' else x end), ' ') || ' ' as w from documents)
select doc_id from t where contains(w, ' under # apache license ') and not contains(w, ' idiot ')""",
    views=False,
)(lambda s, d: _index(s, d, {"body": "number", "subject": "number"}).search('+"under the Apache license" -idiot', ("body",)).select("doc_id"))
