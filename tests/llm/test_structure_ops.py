"""Line deduplication, conversation repair and the Merkle manifest against brute force and SQL."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from postbag.llm import lineruns, merkle, structure_queries, turns

SF = "/root/testdata/sf0.001"
WS = " \t\n\x0b\x0c\r"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


@pytest.mark.parametrize("name", sorted(structure_queries.QUERIES))
def test_queries_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = structure_queries.QUERIES[name](spark, SF)
    r = c.execute(structure_queries.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(row[names.index(x)] for x in df.columns) for row in r.fetchall()), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == want


# ---- lines


def brute_lines(rows, min_chars=40, min_docs=5):
    """Each row: (doc_id, kept, n_lines, n_dropped)."""
    key = lambda x: low(x.strip(WS))
    holders = collections.defaultdict(list)
    for n, (d, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            holders[k].append((n, d))
    out = []
    for d, t in rows:
        kept, lost = [], 0
        for x in (t or "").split("\n"):
            k = key(x)
            ids = [i for _, i in holders[k] if i is not None]
            if len(k) >= min_chars and len(holders[k]) >= min_docs and ids and (d is None or d < max(ids)):
                lost += 1
            else:
                kept.append(x)
        out.append((d, "\n".join(kept), len((t or "").split("\n")), lost))
    return sorted(out, key=repr)


def line_rows():
    long_, odd = "This line is long enough to be looked at, " * 2, "É" * 39
    rows = [(i, f"  {long_.upper() if i % 2 else long_}\t\nshort\nown line of document {i} that no other document holds\n\n{long_}") for i in range(12)]
    rows += [(20 + i, f"{odd}x\r\n{odd}") for i in range(6)]  # 40 code points and 39
    rows += [(30 + i, "only four documents hold this line, so that it stays") for i in range(4)]
    rows += [(40, "this repeats in one document and nowhere else at all\n" * 9), (41, None), (42, ""), (43, "\n\n"), (44, long_ + "\x85"), (45, "x" * 100_000 + "\n" + long_)]
    rows += [(5, "again " + long_), (11, long_), (11, long_), (None, long_), (None, long_), (None, None)]
    rows += [(None, "nobody with an id holds this line, five others do so") for _ in range(5)]
    rows += [(50, "A-Z only: ÀÉ are letters of their own in this line here"), *[(51 + i, "a-z only: Àé are letters of their own in this line here") for i in range(5)]]
    return rows


@pytest.mark.parametrize(("batches", "fan"), [(1, 2), (4, 2), (6, 3)])
def test_lines(spark, batches, fan):
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"places": F.lit(1), "h1": F.lit("x"), "row": F.lit(None), "_l": F.lit(2)})
    got = sorted(((r.doc_id, r.kept, r.n_lines, r.n_dropped) for r in lineruns.deduplicated(df.repartition(3), batches=batches, fan=fan).collect()), key=repr)
    assert got == brute_lines(rows)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("postbag_run_")]


def test_lines_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lineruns.deduplicated(none).collect() == []
    assert [tuple(r) for r in lineruns.deduplicated(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()] == [(None, "", 1, 0)]


def test_runs_hold_a_key_once(spark):
    runs = lineruns.Runs(spark, fan=2)
    frame = lambda ks, top: spark.createDataFrame([(k, -k, top) for k in ks], "h1 long, h2 long, top long")
    new = [sorted(r.h1 for r in runs.add(frame(ks, 9 - n)).collect()) for n, ks in enumerate([range(5), range(3, 8), [], range(20), [1, 30]])]
    assert new == [[0, 1, 2, 3, 4], [5, 6, 7], [], list(range(8, 20)), [30]]
    assert [len(x) for x in runs.levels] == [1, 0, 1]  # five runs: four compacted twice
    got = {r.h1: r.top for r in runs.merged().collect()}
    assert got == {**{k: 9 for k in range(5)}, **{k: 8 for k in range(5, 8)}, **{k: 6 for k in range(8, 20)}, 30: 5} and runs.merged().count() == 21
    plan = frame([1], 0).select("h1", "h2").join(spark.table(runs.names()[0]).select("h1", "h2"), ["h1", "h2"], "left_anti")
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2  # the run is not shuffled
    runs.drop()


# ---- turns

LEGAL = re.compile(r"(s?(ua)+)?")


def brute_faults(rows):
    rows = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for _, t, r, x in rows))
    seen, out = set(), []
    for _, _, r, x in rows:
        bare = x.strip(WS)
        out.append((r, x, "blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else ""))
        seen.add((r, x))
    return out


def brute_repair(faults):
    """(cost, audit, repaired) by trying all edit lists with up to two inserts before each turn and at the end."""
    best = None
    options = []
    for r, x, f in faults:
        own = [("D", None, 4)]
        if f not in ("blank", "duplicate"):
            late = 3 if f == "truncated" else 0
            own += [("K", (r, x), late), *[("R", (n, x), 3 + late) for n in ("user", "assistant")]]
        runs = [[], *[[n] for n in ("user", "assistant")], ["user", "assistant"], ["assistant", "user"]]
        options.append([("I" * len(i) + e, [*[(n, "") for n in i], *([p] if p else [])], 3 * len(i) + c) for i in runs for e, p, c in own])
    options.append([("I" * len(i), [(n, "") for n in i], 3 * len(i)) for i in ([], ["user"], ["assistant"], ["user", "assistant"])])
    for way in itertools.product(*options):
        out = [p for _, ps, _ in way for p in ps]
        if LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in out)):
            found = (sum(c for *_, c in way), "".join(m for m, *_ in way), out)
            best = min(best, found) if best else found
    return best


def brute_report(rows):
    faults = brute_faults(rows)
    if not faults:
        return (0, 0, 0, 0, 0, 0, "", sha(""))
    cost, audit, out = brute_repair(faults)
    ts = [t for _, t, *_ in rows if t is not None]
    n = collections.Counter(f for *_, f in faults)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(faults))
    return (max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, sha("\n".join(f"{r}:{x}" for r, x in out)))


def test_turns(spark):
    rng, rows = random.Random(5), []
    for conv in range(150):
        for k in range(rng.randrange(1, 4)):
            rows.append((conv, rng.choice([None, k, k, 2 * k]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice(["Yes.", "no", "", None, "a? ", "Yes.", ".x\x85"])))
    rows += [(None, 1, "assistant", "Hi."), (900, None, "user", "a."), (900, None, "user", "a."), (901, 1, "system", "s."), (902, 3, "user", "b."), (902, 1, "assistant", "b."), (902, 9, "user", "b.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"i": F.lit("x"), "out": F.lit(1), "_c": F.lit(0), "low": F.lit(0)})
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    got = {r.conv_id: tuple(r)[1:] for r in turns.report(df.repartition(3)).collect()}
    assert got == {c: brute_report(rs) for c, rs in by.items()}
    # the texts that the hash stands for
    out = collections.defaultdict(list)
    for r in sorted(turns.repaired(df).collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.number)):
        out[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: sha("\n".join(out[c])) for c in by} == {c: g[-1] for c, g in got.items()}


def test_long_conversation(spark):
    rng = random.Random(1)
    rows = [(1, k, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "Yes.", "no", f"t{k}."])) for k in range(20_500)]
    got = turns.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    # whole lists by state, as the sorted codes stand for
    state = {turns.EMPTY: (0, "")}
    faults = brute_faults(rows)[:400]
    for r, _, f in faults:
        new = {}
        for s, (cost, audit) in state.items():
            for a, code, to, c in turns._MOVES[r[:1], f]:
                if a == s:
                    found = (cost + c, audit + turns.CODES[code])
                    new[to] = min(new.get(to, found), found)
        state = new
    ranked = turns.Repair()
    for r, _, f in faults:
        ranked.add(r[:1], f)
    least = min(c for c, _ in state.values())
    assert ranked.costs() == {s: c for s, (c, _) in state.items() if c <= least + turns.MARGIN}
    for s in ranked.costs():
        audit = state[s][1]
        assert "".join(turns.CODES[c] for c in ranked.path(s)[0]) == audit
    assert len(got) == 1 and len(re.findall("[KRD]", got[0].audit)) == len(rows)


def test_layers_are_few():
    rng = random.Random(3)
    for _ in range(30):
        r = turns.Repair()
        for _ in range(300):
            r.add(rng.choice(["s", "u", "a", "x"]), rng.choice(["", "", "blank", "duplicate", "truncated"]))
    assert len({k[0] for k in turns._STEPS}) < 400


def test_codes_are_free_of_prefixes():
    assert sorted(turns.CODES) == turns.CODES
    assert not [1 for a in turns.CODES for b in turns.CODES if a != b and b.startswith(a)]


def test_turns_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.report(none).collect() == [] and turns.repaired(none).collect() == []


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in range(40) for t in range(3)] + [(None, None, None, None), (3, None, "system", "x.")]
    want = []
    for c, t, r, x in rows:
        n = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        if n:
            want += [(c, t, "user" if n == 4 else r, "" if n == 1 else re.sub("[.!?]", "", x) if n == 2 else x)] * (2 if n == 3 else 1)
    got = turns.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


# ---- manifest


def brute_tree(hashes):
    """(root, steps of each leaf) of one tree."""
    steps, where, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for k, i in enumerate(where):
            run = range(i // 8 * 8, min(len(level), i // 8 * 8 + 8))
            steps[k].append(("".join(level[j] for j in run if j < i), "".join(level[j] for j in run if j > i)))
            where[k] = i // 8
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
    return level[0], steps


def brute_manifest(rows):
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = collections.defaultdict(list)
    for d, s, g, n, t in rows:
        by[g].append((d, sha("".join(map(f, (d, s, g, n, t)))), sha("".join(map(f, (d, s, g, n, None if t is None else low(t))))) if d is not None and zlib.crc32(str(d).encode()) % 3 == 0 else None))
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in groups:
        by[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = brute_tree([h for _, h, _ in by[g]])
    root, above = brute_tree([trees[g][0] for g in groups])
    out = []
    for k, g in enumerate(groups):
        for (d, h, bad), steps in zip(by[g], trees[g][1], strict=True):
            steps = steps + above[k]
            x = bad or h
            for a, b in steps:
                x = sha(a + x + b)
            out.append((d, h, trees[g][0], root, sha("".join(a + b for a, b in steps)), x, x == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_manifest(spark, seed, tmp_path):
    rng = random.Random(seed)
    rows = [(rng.randrange(400), rng.choice(["a", None, "-"]), rng.choice([None, "", "en", "en", "en", "é", "z", "=x"]), rng.choice([None, 3]), rng.choice([None, "", "ÀB c", "plain", "x" * 3000])) for _ in range(300)]
    rows += [(None, None, None, None, None)] * 3 + [(7, "s", "en", 1, "same")] * 20 + [(1, "s", "lone", 1, "A")]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"grp": F.lit(1), "idx": F.lit(2), "n": F.lit("n"), "hash": F.lit(None).cast("string")}).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = structure_queries.op13_merkle_manifest(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 8, 9, 64, 65])
def test_manifest_of_one_language(spark, n):
    rows = [(k, "s", "en", 1, f"t{k}") for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.manifest(df).select("doc_id", "leaf", "root", merkle.proof_digest(F.col("steps")).alias("p"), merkle.fold(F.col("leaf"), F.col("steps")).alias("f")).collect()
    assert sorted(((r.doc_id, r.leaf, r.root, r.p) for r in got)) == sorted((d, h, root, p) for d, h, _, root, p, *_ in (brute_manifest(rows) if n else []))
    assert all(r.f == r.root for r in got)
