"""Queries of line deduplication, conversation repair and the Merkle manifest, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag.llm import lineruns, merkle, turns
from postbag.llm.common import table


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lineruns.deduplicated(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    got = turns.report(turns.damaged(rows)).withColumnRenamed("conv_id", "_c")
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    # a conversation that lost all its rows has none to repair
    return every.join(got, F.col("conv_id").eqNullSafe(F.col("_c")), "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    got = merkle.manifest(docs, tampered=F.when(hit, merkle.leaf(text=merkle.lower_az(F.col("text")))))
    folded = got.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("steps")))
    return folded.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {f.__name__: f for f in (op11_line_dedup, op12_turn_repair, op13_merkle_manifest)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc(s: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split({s}, ''), lambda x: cast(ascii(x) as bigint))), lambda c, b: {step}), 4294967295)"


_OP11 = f"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i from documents),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') as key from l),
often as (select key, max(doc_id) as top from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
j as (select k.*, coalesce(doc_id < top, false) as gone from k left join often using (key))
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from j group by doc_id
"""

# The dynamic program of whole lists: a step takes each conversation's states one turn on,
# and keeps the cheapest and then least list of each state.
_OP12 = f"""
with recursive r0 as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         {_crc("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as kind from conversations),
r1 as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when kind = 3 then 2 else 1 end)) as copy
  from r0 where kind <> 0),
r2 as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from r1),
r3 as (select *, row_number() over (partition by conv_id, role, text order by i) as nth, lag(role) over (partition by conv_id order by i) as before from r2),
r as (select *, case when bare = '' then 'blank' when nth > 1 then 'duplicate' when bare[-1] not in ('.', '!', '?') then 'truncated' else '' end as fault, role[1] as initial from r3),
stats as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
         count(*) filter (fault = 'truncated') as truncated, count(*) filter (before is not null and before[1] || initial not in ('su', 'ua', 'au')) as illegal from r group by conv_id),
-- states E, S, U, A; inserts lead from one to the next
ins(st, run, pos, put) as (values ('E', 0, 'E', ''), ('E', 1, 'U', 'u'), ('E', 2, 'A', 'ua'), ('S', 0, 'S', ''), ('S', 1, 'U', 'u'), ('S', 2, 'A', 'ua'),
                                 ('U', 0, 'U', ''), ('U', 1, 'A', 'a'), ('U', 2, 'U', 'au'), ('A', 0, 'A', ''), ('A', 1, 'U', 'u'), ('A', 2, 'A', 'ua')),
move(pos, initial, edit, st) as (values ('E', 's', 'K', 'S'), ('E', 'u', 'K', 'U'), ('S', 'u', 'K', 'U'), ('U', 'a', 'K', 'A'), ('A', 'u', 'K', 'U'),
                                       ('E', '*', 'R', 'U'), ('S', '*', 'R', 'U'), ('U', '*', 'R', 'A'), ('A', '*', 'R', 'U'),
                                       ('E', '*', 'D', 'E'), ('S', '*', 'D', 'S'), ('U', '*', 'D', 'U'), ('A', '*', 'D', 'A')),
steps as (
  select ins.st, move.st as st2, move.initial, move.edit, 3 * ins.run + case edit when 'K' then 0 when 'R' then 3 else 4 end as cost, repeat('I', ins.run) || edit as macro,
         case ins.put when '' then '' when 'u' then 'user:' || chr(10) when 'a' then 'assistant:' || chr(10) when 'ua' then 'user:' || chr(10) || 'assistant:' || chr(10) else 'assistant:' || chr(10) || 'user:' || chr(10) end as put
  from ins join move using (pos)),
dp as (
  select conv_id, cast(0 as bigint) as i, 'E' as st, {{'c': cast(0 as bigint), 'a': '', 't': ''}} as b from stats
  union all
  select dp.conv_id, r.i, steps.st2,
         min({{'c': dp.b.c + steps.cost + case when r.fault = 'truncated' and edit <> 'D' then 3 else 0 end, 'a': dp.b.a || macro,
              't': dp.b.t || put || case edit when 'D' then '' when 'K' then role || ':' || text || chr(10) else case st2 when 'U' then 'user:' else 'assistant:' end || text || chr(10) end}})
  from dp join r on r.conv_id is not distinct from dp.conv_id and r.i = dp.i + 1
       join steps on steps.st = dp.st and (steps.initial = '*' or steps.initial = r.initial) and (edit = 'D' or r.fault not in ('blank', 'duplicate'))
  group by dp.conv_id, r.i, steps.st2),
done as (
  select dp.conv_id, min({{'c': b.c + 3 * run, 'a': b.a || repeat('I', run), 't': b.t || case run when 0 then '' when 1 then 'assistant:' || chr(10) else 'user:' || chr(10) || 'assistant:' || chr(10) end}}) as b
  from dp join stats on stats.conv_id is not distinct from dp.conv_id and stats.n = dp.i join (values ('E', 0), ('A', 0), ('U', 1), ('S', 2)) e(st, run) on e.st = dp.st group by dp.conv_id)
select o.conv_id, coalesce(gaps, 0) as gaps, cast(coalesce(blank, 0) as bigint) as blank, cast(coalesce(duplicate, 0) as bigint) as duplicate, cast(coalesce(truncated, 0) as bigint) as truncated,
       cast(coalesce(illegal, 0) as bigint) as illegal, cast(coalesce(b.c, 0) as bigint) as cost, coalesce(b.a, '') as audit, sha256(coalesce(left(b.t, length(b.t) - 1), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join stats on stats.conv_id is not distinct from o.conv_id left join done on done.conv_id is not distinct from o.conv_id
"""


def _op13(depth: int = 9) -> str:
    """Level by level up, then each leaf's siblings and its way to the root; groups of up to 8^depth leaves."""
    part = lambda c: f"case when {c} is null then '-' else strlen(cast({c} as varchar)) || ':' || cast({c} as varchar) end"  # noqa: E731  strlen counts bytes

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join([*(part(c) for c in ("doc_id", "source", "lang", "n_chars")), part(text)]) + ")"

    low = f"translate(text, '{_UPPER}', '{_LOWER}')"
    sql = [
        f"d as (select doc_id, coalesce('=' || lang, '') as g, {leaf('text')} as leaf, case when {_crc('cast(doc_id as varchar)')} % 3 = 0 then {leaf(low)} end as tampered from documents)",
        "p as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i from d)",
        "a0 as (select g, i, leaf as h from p)",
    ]

    def up(name: str, k: int) -> str:
        return f"{name}{k + 1} as (select g, i // 8 as i, case when any_value(n) = 1 then any_value(h) else sha256(string_agg(h, '' order by i)) end as h from (select *, count(*) over (partition by g) as n from {name}{k}) group by g, i // 8)"

    def siblings(name: str, k: int) -> str:
        return f"{name}s{k} as (select x.g, x.i, coalesce(string_agg(y.h, '' order by y.i) filter (y.i < x.i), '') as l, coalesce(string_agg(y.h, '' order by y.i) filter (y.i > x.i), '') as r from {name}{k} x join {name}{k} y on x.g = y.g and x.i // 8 = y.i // 8 group by x.g, x.i)"

    for k in range(depth):
        sql += [up("a", k), siblings("a", k)]
    sql.append(f"b0 as (select '' as g, row_number() over (order by g) - 1 as i, h, g as name from a{depth})")
    for k in range(depth):
        sql += [up("b", k), siblings("b", k)]
    # one row a leaf, folded through all levels; a level without siblings changes nothing
    sql.append(f"w0 as (select p.doc_id, p.leaf, p.g, p.i, coalesce(p.tampered, p.leaf) as f, '' as proof, s.h as subroot, s.i as j, root.h as root from p join b0 s on s.name = p.g cross join b{depth} root)")
    n = 0
    # a level's run of one node is hashed only while its group has several nodes
    for name, at in (("a", "i"), ("b", "j")):
        for k in range(depth):
            key = "w.g" if name == "a" else "''"
            size = f"(select g, count(*) as n from {name}{k} group by g)"
            sql.append(f"w{n + 1} as (select w.* replace (case when z.n = 1 then f else sha256(s.l || f || s.r) end as f, proof || s.l || s.r as proof, w.{at} // 8 as {at}) from w{n} w join {name}s{k} s on s.g = {key} and s.i = w.{at} join {size} z on z.g = {key})")
            n += 1
    return "with " + ",\n".join(sql) + f"\nselect doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, f as folded_root, f = root as verified from w{n}"


ORACLE_SQL = {"op11_line_dedup": _OP11, "op12_turn_repair": _OP12, "op13_merkle_manifest": _op13()}
