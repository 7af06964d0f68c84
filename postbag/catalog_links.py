"""Queries of linking and dictionary forms over the provided tables.

Messages (orders) hold the buyer's name with the market segment before it, the suppliers'
names, and in every seventh the segment alone, which is what is looked up.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from postbag.catalog import query
from postbag.functions import dictionary
from postbag.operators import linking
from postbag.operators.model import VIEWS, heads, read, recipients
from postbag.sinks.shared import written

def _short():
    return F.initcap(F.lower("email_source"))


def _named(s, d):
    """(doc_id, name) of all names of all messages."""
    h, lines = heads(s, d), read(s, d, "lineitem")
    tasks = linking.tasks(lines, lines.count())  # the count comes from the files' footers
    full = h.select("doc_id", F.concat(_short(), F.lit(" "), F.replace("from_name", F.lit("#"), F.lit(" "))).alias("name"))
    return full.unionByName(recipients(s, d, tasks).select("doc_id", F.replace("name", F.lit("#"), F.lit(" ")).alias("name"))).unionByName(h.where("doc_id % 7 = 0").select("doc_id", _short().alias("name")))


_NAMED = VIEWS + """,
short as (select doc_id, upper(email_source[1]) || lower(email_source[2:]) as name from heads),
named as (select doc_id, s.name || ' ' || replace(from_name, '#', ' ') as name from heads join short s using (doc_id) union select doc_id, replace(name, '#', ' ') from recipients union select doc_id, name from short where doc_id % 7 = 0)"""

_LEVELS = "select doc_id, 0 as level, cast(doc_id as varchar) as key from heads union all select doc_id, 1, cast(contact_id % 20 as varchar) from heads union all select doc_id, 2, folder || label from heads union all select doc_id, 3, '' from heads"


def _keys(s, d):
    h = heads(s, d)
    return [h.select("doc_id", F.col("doc_id").alias("key")), h.select("doc_id", (F.col("contact_id") % 20).alias("key")), h.select("doc_id", F.concat("folder", "label").alias("key")), None]


def _asks(s, d):
    return heads(s, d).where("doc_id % 40 = 0").select(F.col("doc_id").alias("ask"), "doc_id", _short().alias("text"))


query(
    "O_NER_12_nearest",
    _NAMED
    + f""",
lv as ({_LEVELS}),
ask as (select doc_id as ask, doc_id, name as text from short where doc_id % 40 = 0),
c as (select ask, level, n.name, count(distinct l2.doc_id) as n from ask join lv l1 using (doc_id) join lv l2 using (level, key) join named n on n.doc_id = l2.doc_id and starts_with(n.name, text || ' ') group by all),
b as (select *, row_number() over (partition by ask, name order by level) as k from c),
r as (select *, row_number() over (partition by ask order by level, n desc, name) as place from b where k = 1)
select ask, name, level, n from r where place <= 4""",
    views=False,
)(lambda s, d: linking.nearest(_asks(s, d), _named(s, d), _keys(s, d), 4))

query(
    "O_NER_11_cascade",
    _NAMED
    + """,
ask as (select doc_id as ask, doc_id, name as text, contact_id % 20 as thread, folder || label as near from short join heads using (doc_id) where doc_id % 40 = 0),
held as (select n.doc_id, n.name, contact_id % 20 as thread, folder || label as near from named n join heads using (doc_id)),
c as (select ask, name, 0 as level, 1 as n from ask join held using (doc_id) where starts_with(name, text || ' ') and doc_id % 80 = 0
  union all select ask, name, 1, 1 from ask join held using (doc_id) where starts_with(name, text || ' ')
  union all select ask, name, 2, count(distinct held.doc_id) from ask join held using (thread) where starts_with(name, text || ' ') group by ask, name
  union all select ask, name, 3, count(distinct held.doc_id) from ask join held using (near) where starts_with(name, text || ' ') group by ask, name
  union all select ask, name, 4, count(distinct held.doc_id) from ask join held on starts_with(name, text || ' ') group by ask, name),
b as (select *, row_number() over (partition by ask, name order by level) as k from c),
r as (select *, row_number() over (partition by ask order by level, n desc, name) as place from b where k = 1)
select ask, name, [1.0, 1.0, 0.9, 0.8, 0.7][level + 1]::double as score, ['participant', 'message', 'thread', 'correspondents', 'archive'][level + 1] as source from r where place <= 3""",
    views=False,
)(lambda s, d: linking.expanded(_asks(s, d), _named(s, d), _named(s, d).where("doc_id % 80 = 0"), _keys(s, d)[1], _keys(s, d)[2], 3))


def _archives(s, d):
    h = heads(s, d)
    return h.select(F.col("email_source").alias("archive_id"), F.concat("from_name", F.lit(" of "), "folder").alias("name")).distinct()


query(
    "O_JOIN_17_names_across_archives",
    VIEWS
    + """, n as (select distinct email_source as archive_id, from_name || ' of ' || folder as name from heads),
q as (select c_name as asked from customer union all select 'mail p' union all select 'customer of' union all select 'of'),
k as (select *, ' ' || trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) || ' ' as c from n)
select asked, archive_id, name from q join k on contains(c, ' ' || trim(regexp_replace(lower(asked), '[^a-z0-9]+', ' ', 'g')) || ' ')""",
    views=False,
)(lambda s, d: linking.across(_archives(s, d), read(s, d, "customer").select(F.col("c_name").alias("asked")).unionByName(s.createDataFrame([("mail p",), ("customer of",), ("of",)], "asked string"))))


def _alike(s, d):
    named, asked = written(_named(s, d).distinct(), "named"), heads(s, d).select(_short().alias("asked")).distinct()
    only = linking.containing(named, asked).select("name").unionByName(asked.select(F.col("asked").alias("name")))
    index = linking.features(named, heads(s, d).select("doc_id", F.col("from_email").alias("email")), only)
    return linking.alike(index, asked, ["customer#000000001@machinery.example"], 5).select("asked", "name", F.round(F.col("score"), 6).alias("score"))


query(
    "O_NER_10_alike",
    _NAMED
    + """,
held as (select distinct doc_id, name from named), total as (select count(distinct doc_id) as n from held),
prior as (select name, count(*) / (select n from total) as prior from held group by name),
asked as (select distinct name as asked from short),
pairs as (select asked, p.name from asked join prior p on starts_with(p.name, asked || ' ')),
feat as (select a.name, 'name' as kind, b.name as feature, count(*) as w from held a join held b using (doc_id) where a.name <> b.name and (a.name in (select name from pairs) or a.name in (select asked from asked)) group by all
  union all select a.name, 'address', from_email, count(*) from held a join heads using (doc_id) where a.name in (select name from pairs) or a.name in (select asked from asked) group by all),
norm as (select name, kind, sqrt(sum(w * w)) as norm from feat group by all),
s as (select p.asked, p.name, t.kind, sum(case when t.kind = 'name' then t.w / pr.prior else t.w end) as s
  from pairs p join feat m on m.name = p.asked join feat t on t.name = p.name and t.kind = m.kind and t.feature = m.feature left join prior pr on pr.name = t.feature
  where not (t.kind = 'address' and t.feature = 'customer#000000001@machinery.example') group by all),
x as (select p.asked, p.name, any_value(prior) * coalesce(sum(0.5 * s / norm), 0) as score from pairs p left join s on s.asked = p.asked and s.name = p.name left join norm on norm.name = s.name and norm.kind = s.kind join prior on prior.name = p.name group by all)
select asked, name, round(score, 6) as score from (select *, row_number() over (partition by asked order by score desc, name) as place from x) where place <= 5""",
    views=False,
)(_alike)


def _rule(ending: str, one: str, least: int, barred: str) -> str:
    before = least - len(ending)
    test = f"^.{{{max(0, before - 1)},}}[^{barred}]{ending}$" if barred else f"^.{{{max(0, before)},}}{ending}$"
    return f"when regexp_matches(w, '{test}') then w[:len(w) - {len(ending)}] || '{one}'"


_WORDS_SQL = r"select distinct unnest(string_split_regex(lower(text), '[^\p{L}]+')) as w from documents union select split_part(p_name, ' ', -1) || 's' from part union select split_part(p_name, ' ', 1) || 'ies' from part"
query(
    "O_STR_28_singulars",
    f"""with t as ({_WORDS_SQL})
select w as word, case when length(w) < 4 then w {" ".join(f"when w = '{a}' then '{b}'" for a, b in dictionary.IRREGULAR.items())} {" ".join(_rule(*r) for r in dictionary.ENDINGS)} else w end as one,
  case when w like '%ied' then w[:len(w) - 3] || 'y' when w like '%ed' then w[:len(w) - 2] when w like '%ing' then w[:len(w) - 3] else w end as simple from t where w <> ''""".replace("len(w)", "length(w)"),
    views=False,
)(
    lambda s, d: read(s, d, "documents").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
    .union(read(s, d, "part").select(F.concat(F.element_at(F.split("p_name", " "), -1), F.lit("s"))))
    .union(read(s, d, "part").select(F.concat(F.element_at(F.split("p_name", " "), 1), F.lit("ies"))))
    .where("word != ''").distinct().select("word", dictionary.singular(F.col("word")).alias("one"), dictionary.simple_form(F.col("word")).alias("simple"))
)
