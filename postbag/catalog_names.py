"""Queries of the trained recogniser over the provided tables.

The gazette is made of the tables' names: buyers by market segment and region (persons),
part names (companies), kinds of parts (organisations), streets by segment and region
(roads).  Messages are orders that tell of a buyer, a part's company and a street.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from postbag.catalog import query
from postbag.functions import types as kinds
from postbag.operators import candidates, decode, entities, messages, naive
from postbag.operators import recogniser as R
from postbag.operators.model import read

_LOW = "lower(c_mktsegment)"


def _regions(s, d):
    nation, region = read(s, d, "nation"), read(s, d, "region")
    return read(s, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))


def gazette(s, d):
    """(name, type) of all names of the tables, as often as they are there."""
    people, part = _regions(s, d), read(s, d, "part")
    title = lambda c: F.initcap(F.lower(c))
    last = F.element_at(F.split("p_name", " "), -1)
    rows = [
        (people, F.concat(title("c_mktsegment"), F.lit(" Buyer of "), title("r_name")), 0),
        (part, F.concat(title("p_name"), F.lit(" & Co")), 1),
        (part, F.concat(title("p_type"), F.lit(" "), title(last), F.lit(" Guild")), 11),
        (people, F.concat(title("c_mktsegment"), F.lit(" "), title("r_name"), F.lit(" Street")), 5),
    ]
    out = None
    for frame, name, kind in rows:
        part_ = frame.select(name.alias("name"), F.lit(kind).alias("type"))
        out = part_ if out is None else out.unionByName(part_)
    return out


def texts(s, d):
    """(doc_id, text, and the names told of): a message for each order line that is the first of its order."""
    first = read(s, d, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_partkey")
    o = read(s, d, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"))
    m = o.join(_regions(s, d), F.col("o_custkey") == F.col("c_custkey")).join(read(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    title = lambda c: F.initcap(F.lower(c))
    person, company = F.concat(title("c_mktsegment"), F.lit(" Buyer of "), title("r_name")), F.concat(title("p_name"), F.lit(" & Co"))
    street = F.concat(title("c_mktsegment"), F.lit(" "), title("r_name"), F.lit(" Street"))
    body = F.concat(F.lit("Yesterday "), person, F.lit(" met "), company, F.lit(" near "), street, F.lit(". They say that yesterday was fine."))
    return m.select(F.col("o_orderkey").alias("doc_id"), body.alias("text"))


_JOINS = "[" + ", ".join(f"'{w}'" for w in R.JOIN_WORDS) + "]"
_SIGNS = "[" + ", ".join(f"'{w}'" for w in R.SYMBOLS) + "]"
_PEOPLE = "customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"
_GAZETTE = f"""
with gaz as (
  select {_LOW} || ' buyer of ' || lower(r_name) as name, 0 as type from {_PEOPLE} union all
  select lower(p_name) || ' & co', 1 from part union all
  select lower(p_type) || ' ' || lower(split_part(p_name, ' ', -1)) || ' guild', 11 from part union all
  select {_LOW} || ' ' || lower(r_name) || ' street', 5 from {_PEOPLE}),
names as (select name, type, cast(count(*) as double) as weight from gaz group by all)"""


def _patterns(source: str, key: str, text: str) -> str:
    """(key, w, word, at): patterns of a phrase's words, a word's first place."""
    return f"""(select {key}, w, word, min(pos) as pos from (
      select {key}, w, unnest(list_transform(w, lambda x, i: case when list_contains({_JOINS}, x) or list_contains({_SIGNS}, x) then null
        else case when i > 1 and list_contains({_SIGNS}, w[i - 1]) then w[i - 1] || ' ' else '' end || x || case when i < len(w) and list_contains({_JOINS}, w[i + 1]) then ' ' || w[i + 1] else '' end end)) as word,
        unnest(range(1, len(w) + 1)) as pos
      from (select *, string_split({text}, ' ') as w from {source})) where word is not null group by {key}, w, word)"""


def _features(rows: str, key: str) -> str:
    """(key, word, dim, value, part) of rows (key, w, word, pos) but for the type; `kinds` has the words' types."""
    on = " and ".join(f"a.{k} = b.{k}" for k in key.split(", "))
    cols = ", ".join(f"a.{k}" for k in key.split(", "))
    side = lambda dim, op: f"""  # noqa: E731
    select {cols}, a.word, '{dim}' as dim, case when b.word is null then 'NULL' else coalesce(k.kind, '?') end as value, cast(1.0 as double) / count(*) over (partition by {cols}, a.word) as part
    from {rows} a left join {rows} b on {on} and b.pos {op} a.pos left join kinds k on k.word = b.word""".replace("  # noqa: E731", "")
    return f"""({side("L", "<")} union all {side("R", ">")} union all
    select {key}, word, 'S', coalesce(list_filter(w, lambda x, i: i > 1 and list_contains({_JOINS}, x))[1], 'NULL'), 1.0 from {rows} union all
    select {key}, word, 'D', 'N', 1.0 from {rows})"""


_V = f"case dim when 'T' then {R.SIZES['T']} when 'L' then {R.SIZES['L']} when 'R' then {R.SIZES['R']} when 'S' then {R.SIZES['S']} else {R.SIZES['D']} end"
_START = (
    _GAZETTE
    + f""",
pat as {_patterns("names", "name, type, weight", "name")},
per as (select word, type, sum(weight) as n from pat where length(word) > 1 and not regexp_matches(word, '[0-9]') group by all),
kinds as (select word, cast(type as varchar) as kind from (select *, sum(n) over (partition by word) as all_, row_number() over (partition by word order by type <> {kinds.OTHER} desc, n desc, type) as r from per) where r = 1 and all_ >= {R.MIN_COUNT}),
seen as (select * from {_features("pat", "name, type, weight")} f semi join kinds using (word)),
obs as (select name, type, weight, word, dim, value, part from seen union all select distinct name, type, weight, word, 'T', cast(type as varchar), 1.0 from seen),
one as (select name, type, weight, word, cast(1.0 as double) / count(*) over (partition by name, type) as g from (select distinct name, type, weight, word from obs)),
total as (select sum(weight) as n from (select distinct name, type, weight from obs)),
s0 as (select word, dim, value, sum(weight * g * part) as c from obs join one using (name, type, weight, word) group by word, dim, value)"""
)


def _round(k: int) -> str:
    return f""",
n{k} as (select word, sum(c) as n from s{k} where dim = 'T' group by word),
f{k} as (select name, type, weight, word, any_value(ln(n)) + sum(part * ln((c + {R.SMOOTH}) / (n + {R.SMOOTH} * {_V}))) as lf from obs join s{k} using (word, dim, value) join n{k} using (word) group by name, type, weight, word),
t{k} as (select *, max(lf) over (partition by name, type) as top from f{k}),
g{k} as (select *, exp(lf - top) / sum(exp(lf - top)) over (partition by name, type) as g from t{k}),
ll{k} as (select sum(weight * (top + ln(m) - ln(n))) as ll from (select name, type, weight, any_value(top) as top, sum(exp(lf - top)) as m from t{k} group by name, type, weight), total),
s{k + 1} as (select word, dim, value, sum(weight * g * part) as c from obs join g{k} using (name, type, weight, word) group by word, dim, value)"""


query(
    "O_NER_05_training",
    _START + "".join(map(_round, range(4))) + "\nselect word, dim, value, round(c, 5) as c from s4 union all select null, '#', 'll', round(ll, 5) from ll3",
    views=False,
)(lambda s, d: R.train(gazette(s, d), rounds=4, tolerance=None).stats.select("word", "dim", "value", F.round("c", 5).alias("c")))


def phrases(s, d):
    """Phrases to read: names of the gazette, names it lacks, and phrases with joining words at their ends."""
    people, part = _regions(s, d), read(s, d, "part")
    last = F.element_at(F.split("p_name", " "), -1)
    seg, region = F.lower("c_mktsegment"), F.lower("r_name")
    made = [(people, F.concat(seg, F.lit(" buyer of "), region)), (people, F.concat(seg, F.lit(" guild of "), region)), (people, F.concat(F.lit("of "), seg)), (part, F.concat(F.lower("p_type"), F.lit(" "), last, F.lit(" & co"))), (part, F.concat(last, F.lit(" street"))), (part, F.concat(F.lit("newest "), last)), (part, last)]
    out = None
    for frame, text in made:
        one = frame.select(text.alias("segment"))
        out = one if out is None else out.unionByName(one)
    return out


_PHRASES = f"""
asked as (select distinct segment from (
  select {_LOW} || ' buyer of ' || lower(r_name) as segment from {_PEOPLE} union all select {_LOW} || ' guild of ' || lower(r_name) from {_PEOPLE} union all select 'of ' || {_LOW} from {_PEOPLE} union all
  select lower(p_type) || ' ' || split_part(p_name, ' ', -1) || ' & co' from part union all select split_part(p_name, ' ', -1) || ' street' from part union all
  select 'newest ' || split_part(p_name, ' ', -1) from part union all select split_part(p_name, ' ', -1) from part))"""

_FLAT = 1.0
for _n in R.SIZES.values():
    _FLAT /= _n
query(
    "O_NER_04_segment_scores",
    _START
    + ","
    + _PHRASES
    + f""",
sp as {_patterns("asked", "segment", "segment")},
sf as {_features("sp", "segment")},
n0 as (select word, sum(c) as n from s0 where dim = 'T' group by word),
ctx as (select segment, word, any_value(n) as n, sum(part * ln((coalesce(c, 0) + {R.SMOOTH}) / (n + {R.SMOOTH} * {_V}))) as ctx from sf join n0 using (word) left join s0 using (word, dim, value) group by segment, word),
ty as (select unnest([{", ".join(map(str, kinds.TYPES))}]) as type),
sh as (select segment, ctx.word, ty.type, n, ctx, (coalesce(c, 0) + {R.SMOOTH}) / (n + {R.SMOOTH} * {R.SIZES["T"]}) as p from ctx cross join ty left join s0 on s0.word = ctx.word and s0.dim = 'T' and s0.value = cast(ty.type as varchar)),
own as (select segment, type, sum(exp(ln(sh.n) - ln(total.n) + ln(p) + ctx)) as own from sh, total where p >= {R.LEAST_SHARE} group by segment, type),
new as (select segment, count(*) filter (word not in (select word from n0)) as k from sp group by segment),
sc as (select segment, type, case when list_contains({_JOINS}, split_part(segment, ' ', 1)) or list_contains({_JOINS}, split_part(segment, ' ', -1)) then 0 else own + k * {_FLAT!r} * {R.SMOOTH} / (total.n + {R.SMOOTH}) end as score from own join new using (segment), total
  union all select segment, type, 1.0 from asked join names on name = segment where contains(segment, ' '))
select segment, type, round(log10(max(score) + 1e-30), 6) as score from sc group by segment, type""",
    views=False,
)(lambda s, d: R.segment_scores(phrases(s, d), R.train(gazette(s, d), rounds=0)).select("segment", "type", F.round(F.log10(F.col("score") + 1e-30), 6).alias("score")))


query(
    "O_NER_06_naive_bayes",
    _GAZETTE
    + ","
    + _PHRASES
    + """,
w as (select type, unnest(string_split(name, ' ')) as word from gaz),
c as (select type, word, count(*) as c from w group by all),
t as (select type, count(*) as names, sum(len(string_split(name, ' '))) as words from gaz group by type),
v as (select count(distinct word) + 1 as v from w),
a as (select segment, unnest(string_split(segment, ' ')) as word from asked),
x as (select segment, t.type, any_value(ln(names) - ln((select sum(names) from t))) + sum(ln(coalesce(c, 0) + 1.0) - ln(words + v)) as score from a cross join t cross join v left join c on c.word = a.word and c.type = t.type group by segment, t.type)
select segment as phrase, arg_max(type, score - type * 1e-9) as type, round(1 / sum(exp(score - top)), 6) as p from (select *, max(score) over (partition by segment) as top from x) group by segment""",
    views=False,
)(lambda s, d: naive.classified(phrases(s, d).withColumnRenamed("segment", "phrase"), naive.train(gazette(s, d))).select("phrase", "type", F.round("p", 6).alias("p")))


def _recognised(s, d):
    t = texts(s, d)
    model = R.train(gazette(s, d), rounds=5)
    return decode.recognised(candidates.candidates(t), model, decode.word_cases(t))


_TOLD = f"""
with m as (select o_orderkey as doc_id, {_LOW} as seg, lower(r_name) as region, lower(p_name) as part from orders join lineitem on l_orderkey = o_orderkey and l_linenumber = 1
  join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey join part on p_partkey = l_partkey)"""
#: What each message tells of is known, so the recogniser is held against it.
query(
    "O_NER_07_recognised",
    _TOLD + " select doc_id, seg || ' buyer of ' || region as text, 0 as type from m union all select doc_id, part || ' & co', 1 from m union all select doc_id, seg || ' ' || region || ' street', 5 from m",
    views=False,
)(lambda s, d: _recognised(s, d).select("doc_id", "text", "type"))


_KEY = "array_to_string(list_sort(list_filter(string_split_regex(text, '[\\s\".;,#@&()-]+'), lambda x: x <> '')), ' ')"
_RECOGNISED = _TOLD + ", f as (select doc_id, seg || ' buyer of ' || region as text, 0 as type from m union all select doc_id, part || ' & co', 1 from m union all select doc_id, seg || ' ' || region || ' street', 5 from m), k as (select *, " + _KEY + " as cname from f)"
query("O_AGG_17_entity_book_recognised", _RECOGNISED + " select type, cname, min(text) as display, count(distinct doc_id) as messages, 1.0::double as score from k group by type, cname", views=False)(
    lambda s, d: entities.entity_book(_recognised(s, d)).select("type", "cname", F.get("names", F.lit(0)).alias("display"), "messages", "score")
)
query("O_SRT_03_top_recognised", _RECOGNISED + ", b as (select type, cname, count(distinct doc_id) as n from k group by 1, 2) select type, cname, n as messages from (select *, row_number() over (partition by type order by n desc, cname) as place from b) where place <= 3", views=False)(
    lambda s, d: entities.top_entities(entities.entity_book(_recognised(s, d)), 3, 100).select("type", "cname", "messages")
)
query(
    "O_NER_01_candidates",
    _TOLD
    + """, w as (select doc_id, upper(seg[1]) || seg[2:] as seg, array_to_string(list_transform(string_split(region, ' '), lambda x: upper(x[1]) || x[2:]), ' ') as region, array_to_string(list_transform(string_split(part, ' '), lambda x: upper(x[1]) || x[2:]), ' ') as part from m),
n as (select doc_id, 'Yesterday ' || seg || ' Buyer of ' || region as a, part || ' & Co' as b, seg || ' ' || region || ' Street' as c from w)
select doc_id, a as text, cast(0 as integer) as start, cast(length(a) as integer) as stop from n
union all select doc_id, b, cast(length(a) + 5 as integer), cast(length(a) + 5 + length(b) as integer) from n
union all select doc_id, c, cast(length(a) + length(b) + 11 as integer), cast(length(a) + length(b) + 11 + length(c) as integer) from n""",
    views=False,
)(lambda s, d: candidates.candidates(texts(s, d), dictionary=["they"]).select("doc_id", "text", "start", "stop"))


_TITLE = "array_to_string(list_transform(string_split({0}, ' '), lambda x: upper(x[1]) || x[2:]), ' ')"


def _redacted(s, d):
    """Messages in which only the words of recognised persons are left to read."""
    words = F.array_distinct(F.flatten(F.collect_list(F.split("text", " "))))
    names = _recognised(s, d).where("type = 0").groupBy("doc_id").agg(words.alias("allowed"))  # a message's names
    none = F.expr("cast(array() as array<string>)")
    return texts(s, d).join(names, "doc_id", "left").select("doc_id", messages.redact(F.col("text"), F.coalesce("allowed", none)).alias("text"))


query(
    "O_PRJ_06_redacted_messages",
    _TOLD
    + f""", t as (select doc_id, 'Yesterday ' || {_TITLE.format("seg")} || ' Buyer of ' || {_TITLE.format("region")} || ' met ' || {_TITLE.format("part")} || ' & Co near ' || {_TITLE.format("seg")} || ' ' || {_TITLE.format("region")} || ' Street. They say that yesterday was fine.' as text,
  list_concat(string_split(region, ' '), [seg, 'buyer', 'of']) as allowed from m)
select doc_id, array_to_string(list_transform(regexp_extract_all(text, '[a-zA-Z0-9]+|[^a-zA-Z0-9]+'), lambda w: case when regexp_matches(w, '[a-zA-Z0-9]') and not list_contains(allowed, lower(w)) then repeat('.', length(w)) else w end), '') as text from t""",
    views=False,
)(_redacted)


@query("O_NER_03_segments")
def _segments(s, d):
    """Phrases of several names run together, cut into segments."""
    t = _regions(s, d).select(F.concat_ws(" ", F.initcap(F.lower("c_mktsegment")), F.lit("Buyer of"), F.initcap(F.lower("r_name")), F.initcap(F.lower("c_mktsegment")), F.lit("Guild")).alias("phrase"))
    t = t.unionByName(read(s, d, "part").select(F.concat_ws(" ", F.initcap("p_name"), F.lit("Asia Street")).alias("phrase")))
    return decode.segments(t, R.train(gazette(s, d), rounds=5)).select("phrase", "text", "first", "end", "type", F.round("score", 9).alias("score"))


_AA, _BB = "Album|MusicalWork|Work", "University|EducationalInstitution|Organisation|Agent"
query(
    "O_NER_09_types",
    f"""select p_partkey, case p_partkey % 6 when 0 then 'University' when 1 then 'Road' when 2 then 'Other' when 3 then 'Island' when 4 then 'Place' else 'Other' end as type,
      case p_partkey % 6 when 0 then 'Organisation' when 1 then 'Place' when 2 then 'Other' when 3 then 'Place' when 4 then 'Place' else 'Other' end as coarse from part""",
    views=False,
)(
    lambda s, d: read(s, d, "part")
    .withColumn("path", F.expr(f"case p_partkey % 6 when 0 then '{_BB}' when 1 then 'Motorway|Road|RouteOfTransportation|Infrastructure|ArchitecturalStructure|Place' when 2 then '{_AA}' when 3 then 'Island|PopulatedPlace|Place' when 4 then 'Zoo|Place' end"))
    .withColumn("code", kinds.parse_path(F.col("path")))
    .select("p_partkey", kinds.type_name(F.col("code")).alias("type"), kinds.type_name(kinds.coarse(F.col("code"))).alias("coarse"))
)
