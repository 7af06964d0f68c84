"""Near-duplicates, decontamination, chat formatting and the pipeline against brute force."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from postbag.llm import chat, neardup, packing, phrases, qda, queries, rules

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def shingle_set(t, k):
    w = WORD.findall(low(t))
    return frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def components(texts, k, percent):
    """doc_id: smallest reachable doc_id, by comparing all pairs that share a shingle."""
    sets = {d: shingle_set(t, k) for d, t in texts.items()}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for d in sorted(sets):
        shared = collections.Counter(e for g in sets[d] for e in holders[g])
        for e, n in shared.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
        for g in sets[d]:
            holders[g].append(d)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.fixture(scope="module")
def docs(spark):
    odd = [None, "", " ", "One", " one ", "a b", "A  B", "é É", "x " * 3000]
    base = [f"w{i}" for i in range(60)]
    near = [" ".join(base[:k] + [f"z{k}"] + base[k + 1 :]) for k in range(0, 60, 2)]  # a star's rays: pairs of them are farther apart than each from the base
    chain = [" ".join(f"c{j}" for j in range(i, i + 40)) for i in range(0, 30, 3)]
    rows = [(10_000 + i, t) for i, t in enumerate([*odd, *near, " ".join(base), *chain])]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(extra).withColumn("id", F.lit(1)).withColumn("comp", F.lit("x")).cache()


@pytest.mark.parametrize(("k", "percent"), [(2, 80), (5, 80)])
def test_near_duplicates(docs, k, percent):
    want = components({r.doc_id: r.text for r in docs.collect()}, k, percent)
    got = {r.doc_id: r for r in neardup.cluster(docs, k, percent).collect()}
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (r.component_id == d) for d, r in got.items())


def test_near_duplicates_of_nothing(docs):
    assert neardup.cluster(docs.where("false"), 2).count() == 0
    assert neardup.cluster(docs.where("text is null"), 2).count() == 1


PW = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(texts, items, size=10):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = PW.findall(low(t))
        if w:
            for k in range(max(1, len(w) - size + 1)):
                windows[tuple(w[k : k + size])].add(i)
    out = {}
    for d, t in texts.items():
        w = PW.findall(low(t))
        hit, names = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    names |= windows[x]
        out[d] = (len(w), len(hit), sorted(map(str, names)))
    return out


def test_decontamination(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").union(spark.createDataFrame([(900, "ONE"), (901, None), (902, "w3 w4 w5"), (903, "É é"), (904, "x " * 15), (905, "x x x")], "item_id long, text string"))
    want = brute_hits({r.doc_id: r.text for r in docs.collect()}, [(r.item_id, r.text) for r in bench.collect()])
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in phrases.contaminated(docs, bench).collect()}
    assert got == want


def test_decontamination_of_items_without_or_with_shared_ids(spark):
    words = lambda c, n: [f"{c}{i}" for i in range(n)]
    one, two, none = words("a", 30), words("b", 14), words("n", 12)
    items = spark.createDataFrame([(7, " ".join(one)), (7, " ".join(two)), (None, " ".join(none)), (8, " ".join(two))], "item_id long, text string")
    texts = [" ".join(x) for x in (one[20:], one[:10], two[:10], two[4:], none[1:11], none[:9])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, list(r["items"]), r.contaminated) for r in phrases.contaminated(docs, items).collect()}
    assert got == {0: (10, 1, ["7"], True), 1: (10, 1, ["7"], True), 2: (10, 2, ["7", "8"], True), 3: (10, 2, ["7", "8"], True), 4: (10, 0, [], True), 5: (0, 0, [], False)}


def test_decontamination_of_rows_without_ids(spark):
    item = " ".join(f"a{i}" for i in range(12))
    rows = [(None, f"x {item}"), (None, f"{item} y {item}"), (None, None), (None, "clean"), (4, item), (4, "clean"), (None, f"x {item}")]
    got = [(r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in phrases.contaminated(spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(7)), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()]
    assert sorted(got, key=repr) == sorted([(None, 13, 12, True), (None, 25, 24, True), (None, 0, 0, False), (None, 1, 0, False), (4, 12, 12, True), (4, 1, 0, False), (None, 13, 12, True)], key=repr)


def test_decontamination_without_items(spark, docs):
    none = spark.createDataFrame([(1, None)], "item_id long, text string")
    assert phrases.contaminated(docs, none).where("contaminated").count() == 0
    assert phrases.contaminated(docs.where("false"), none).count() == 0


def test_proximity(spark):
    d = spark.createDataFrame([(1, "a x x b"), (2, "a x x x x b"), (3, "b a"), (4, "A")], "doc_id long, text string")
    q = spark.createDataFrame([(1, ["a", "B"]), (2, ["a"]), (3, ["a", "q"])], "query int, terms array<string>")
    got = {(r.query, r.doc_id) for r in phrases.near(d, q, 3).collect()}
    assert got == {(1, 1), (1, 3), (2, 1), (2, 2), (2, 3), (2, 4)}


SAID = "<|im_end|><|im_start|>assistant ok"


def test_chat(spark):
    long_ = [(7, i, "user" if i % 2 == 0 else "assistant", f"turn {i} &lt;| {SAID}") for i in range(100)]
    rows = [(1, 1, "assistant", "b<|"), (1, 0, "user", "&amp;"), (2, 0, None, None), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (4, 5, "a\nb&nl;", SAID), (5, 0, "assistant", "<<"), *long_]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.render(df)).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        all_ = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        said = "".join(x for _, r, x in turns if r == "assistant")
        g = got[c]
        assert g.n_turns == len(turns) and g.turns_sha256 == hashlib.sha256(all_.encode()).hexdigest()
        assert g.loss_chars == len(said) and g.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert g.formatted_chars == len(chat.marked([(r, x) for _, r, x in turns])) and not g.rewrites


def test_rewriting_template_is_found():
    r = chat.Renderer(lambda turns: f"[{len(turns)}]" + "".join(t for _, t in turns))
    r.add("user", "a")
    r.add("user", "b")
    assert r.rewrites


def _spans(template, n, **more):
    r = chat.Renderer(template, **more)
    return r, [r.add("user", f"t{i}.")[0] for i in range(n)]


def test_late_rewrites_are_found(spark):
    late = lambda turns: ("long:" if len(turns) > 40 else "") + "".join(t for _, t in turns)
    last = lambda turns: "".join(t for _, t in turns[-35:])
    for template, first in ((late, 40), (last, 35)):
        assert not _spans(template, first)[0].rewrites and _spans(template, first + 1)[0].rewrites
    rows = spark.createDataFrame([(1, i, "user", f"t{i}.") for i in range(41)], "conv_id long, turn long, role string, text string")
    assert [r.number for r in chat.render(rows, late).where("rewrites").collect()] == [40]
    assert chat.render(rows.where("turn < 40"), late).where("rewrites").count() == 0


def test_late_spans_are_those_of_the_whole_output():
    numbered = lambda turns: "head " + "".join(f"[{i}]{t}" for i, (_, t) in enumerate(turns))
    r, spans = _spans(numbered, 50)
    assert not r.rewrites and spans == [f"[{i}]t{i}." for i in range(50)]
    assert _spans(chat.marked, 50, history_free=True)[1] == _spans(chat.marked, 50)[1]


def test_a_wrong_declaration_is_found(spark):
    numbered = lambda turns: "".join(f"[{i}]{t}" for i, (_, t) in enumerate(turns))
    late = lambda turns: ("long:" if len(turns) > 40 else "") + "".join(t for _, t in turns)
    for template, n in ((numbered, 4), (late, 64)):
        with pytest.raises(ValueError, match="declared history-free"):
            _spans(template, n, history_free=True)
    r, _ = _spans(late, 50, history_free=True)
    with pytest.raises(ValueError, match="declared history-free"):
        r.close()
    rows = spark.createDataFrame([(c, i, "user", f"t{i}.") for c in (1, 2) for i in range(45)], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="declared history-free"):
        chat.render(rows, late, history_free=True).collect()
    assert chat.render(rows, chat.marked).count() == 90


def test_escape_round_trip():
    for t in ("", "&", "&amp;", "&lt;|", "<|", "<<||>", "&amp;lt;|", SAID):
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null ids and texts, empty texts, repeats, other columns, and no rows at all."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = bench.orderBy(F.length("text").desc()).first().text
    good = docs.where("length(text) > 400").orderBy("doc_id").first()
    odd = [(None, None), (None, ""), (None, good.text), (good.doc_id, good.text), (None, f"{good.text} {item}"), (7_000_000, " "), (7_000_001, "x " * 50_000)]
    more = spark.createDataFrame(odd, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.lit(0).cast("long")})
    wide = docs.unionByName(more).withColumns({"w": F.lit(1), "_w": F.lit("x"), "n_words": F.lit(2), "kept": F.lit(False), "found": F.lit(3), "_key": F.lit("k")})
    for name, frame in (("odd", wide), ("none", wide.where("false"))):
        place = tmp_path / name
        frame.write.parquet(f"{place}/documents.parquet")
        for t in ("benchmark", "labels"):
            spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{place}/{t}.parquet")
        assert cp.run(spark, str(place)).count() == 0 if name == "none" else cp.run(spark, str(place)).count() > 0
    step = cp.decontamination(spark, wide, SF)
    assert step.columns == wide.columns
    left = [(r.doc_id, r.text) for r in step.collect()]
    assert (None, good.text) in left and (None, f"{good.text} {item}") not in left and (None, None) in left


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    out = {}
    step = docs
    for name, f in cp.STAGES[:-1]:
        step = f(spark, step, SF)
        assert step.columns == docs.columns
        step = step.cache()
        out[name] = {r.doc_id for r in step.collect()}
    model = qda.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in qda.score(docs, model).where("score >= 0.5").collect()}
    assert out["quality_classifier"] == good
    kept = {r.doc_id for r in rules.judge(docs).where("kept").collect()}
    assert out["quality_rules"] == good & kept
    comp = components({d: text[d] for d in good & kept}, cp.SHINGLE, cp.PERCENT)
    first = {d for d, (_, c) in comp.items() if c == d}
    assert out["near_duplicates"] == first
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d for d, x in brute_hits({d: text[d] for d in first}, items).items() if not x[1]}
    assert out["decontamination"] == clean
    packed = cp.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == clean
    assert packing.padding(packed).first().sequences > 0


@pytest.mark.parametrize("name", ["op1_quality_rules", "op7_near_duplicates", "op9_decontamination", "op10_chat_formatting"])
def test_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    c.execute("set threads=2")
    for t in ("documents", "benchmark", "labels", "conversations"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    r = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(tuple(x[k] for k in cols) for x in df.collect()) == sorted(tuple(row[names.index(k)] for k in cols) for row in r.fetchall())


def test_filters_do_not_repeat_the_split(spark, docs):
    """A filter on a verdict stays above the counts: the plan splits a text as often as without it."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for df, verdict in ((rules.judge(docs), "kept"), (phrases.contaminated(docs, bench), "contaminated")):
        splits = [x._jdf.queryExecution().optimizedPlan().toString().count("split(") for x in (df, df.where(verdict))]
        assert splits[0] == splits[1] > 0


def test_rules_on_a_very_long_text(spark):
    text = " ".join(f"w{i % 19_000}" for i in range(20_000))
    got = rules.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).where("kept").collect()
    assert [(r.n_words, r.n_repeat_words) for r in got] == [(20_000, 2_000)]


def test_bitmaps_never_differ_more_than_sets(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: 400 - k], rng.integers(0, 1 << 62, k, dtype=np.uint64)])) for k in (0, 1, 10, 30, 60)] + [np.unique(base[:330])]
    maps = neardup.bitmaps(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    assert {len(m) for m in maps} == {16, 32}  # the last one is half as long: pairs with it fold
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets))]
    rows = [(maps[i].tolist(), maps[j].tolist(), len(sets[i]) + len(sets[j]), len(np.setxor1d(sets[i], sets[j]))) for i, j in pairs]
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, total int, apart int")
    for percent in (80, 90):
        got = df.select(neardup.within("a", "b", F.col("total"), percent).alias("ok"), ((100 + percent) * F.col("apart") <= (100 - percent) * F.col("total")).alias("linked")).collect()
        assert all(r.ok for r in got if r.linked) and not all(r.ok for r in got)


def test_near_duplicates_of_repeated_ids(spark):
    words = " ".join(f"a{i}" for i in range(30))
    rows = [(1, words), (1, "short other text"), (2, words), (3, "short other text"), (None, words)]
    for part in (rows, rows[::-1]):
        got = neardup.cluster(spark.createDataFrame(part, "doc_id long, text string"), 2).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 2, 1), (1, 29, 1), (2, 29, 1), (3, 2, 1)]
