"""Linking against brute force; singular forms."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from postbag.functions import dictionary
from postbag.operators import entities, linking


def canon(x):
    return " ".join(re.findall(r"[^\W_]+", x.lower())) if x else ""


def holds(name, text):
    return bool(canon(text)) and f" {canon(text)} " in f" {canon(name)} "


def short_for(name, text):
    return re.fullmatch("[A-Z]{3,}", text or "") and "".join(re.findall(r"(?<![A-Za-z0-9])([A-Z])", name)) == text


NAMES = ["Ann Lee", "Mary Ann Lee", "ann  lee!", "Lee", "World Health Organization", "WHO", "Lee Ann", "Annalee Lee", "", "...", None, "Bob", "Dr. Bob Lee", "A Lee"]


def test_containing(spark):
    asked = ["Ann Lee", "lee", "WHO", "bob", "zoe", "Zoe Lee", None, "", "--", "a"]
    got = {(r.asked, r.name) for r in linking.containing(spark.createDataFrame([(n,) for n in NAMES * 2], "name string"), spark.createDataFrame([(a,) for a in asked * 2], "asked string"), acronyms=True).collect()}
    assert got == {(a, n) for a in asked for n in NAMES if a and n and (holds(n, a) or short_for(n, a))}


def test_across(spark):
    rows = [(1, "Ann Lee", "x"), (2, "Ann Lee", "y"), (2, "Bob", "z")]
    got = linking.across(spark.createDataFrame(rows, "archive_id int, name string, more string"), spark.createDataFrame([("lee",)], "asked string")).collect()
    assert sorted(map(tuple, got)) == [("lee", 1, "Ann Lee", "x"), ("lee", 2, "Ann Lee", "y")]


def brute_nearest(asks, found, levels, most):
    out = {}
    for ask, doc, text in asks:
        if text is None:
            continue
        best = []
        for k, level in enumerate(levels):
            mine = {""} if level is None else {key for d, key in level if d == doc and key is not None}
            n = collections.Counter()
            for key in mine:
                docs = {d for d, _ in found} if level is None else {d for d, kk in level if kk == key}
                per = collections.defaultdict(set)
                for d, name in found:
                    if d in docs and name and (holds(name, text) or short_for(name, text)) and canon(name) != canon(text):
                        per[name].add(d)
                for name, ds in per.items():
                    n[name] = max(n[name], len(ds))
            best += [(k, -c, name) for name, c in n.items() if name not in {b[2] for b in best}]
            if len(best) >= most:
                break
        out[ask] = [(name, k, -c) for k, c, name in sorted(best)[:most]]
    return {a: b for a, b in out.items() if b}


@pytest.mark.parametrize("most", [1, 3, 50])
def test_nearest(spark, most):
    rng = random.Random(4)
    found = [(rng.randrange(30), rng.choice(NAMES)) for _ in range(200)]
    threads = [(d, str(d % 7)) for d in range(30)] + [(3, "0"), (4, None)]
    folder = [(d, "hot" if d < 25 else "x") for d in range(40)]
    asks = [(k, rng.randrange(40), rng.choice(["Lee", "ann lee", "Bob", "WHO", None, "zoe", "Ann"])) for k in range(60)]
    own = [(d, str(d)) for d in range(40)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, key string")
    got = collections.defaultdict(list)
    a, f = spark.createDataFrame(asks, "ask long, doc_id long, text string"), spark.createDataFrame(found, "doc_id long, name string")
    for r in linking.nearest(a, f, [frame(own), frame(threads), frame(folder), None], most).collect():
        got[r.ask].append((r.level, -r.n, r["name"]))
    want = brute_nearest(asks, found, [own, threads, folder, None], most)
    assert {k: [(n, lv, -c) for lv, c, n in sorted(v)] for k, v in got.items()} == want


def test_nearest_of_nothing(spark):
    a, f = spark.createDataFrame([], "ask long, doc_id long, text string"), spark.createDataFrame([(1, "Ann Lee")], "doc_id long, name string")
    assert linking.nearest(a, f, [None]).count() == 0 and linking.nearest(a, f, []).count() == 0
    b = spark.createDataFrame([(1, 1, "Lee")], "ask long, doc_id long, text string")
    assert linking.nearest(b, f.where("false"), [None]).count() == 0


def test_expanded(spark):
    a = spark.createDataFrame([(1, 1, "Lee"), (2, 5, "Lee")], "ask long, doc_id long, text string")
    found = spark.createDataFrame([(1, "Mary Lee"), (2, "Ann Lee"), (3, "Bob Lee"), (4, "Zoe Lee"), (1, "Lee")], "doc_id long, name string")
    people = spark.createDataFrame([(1, "Sir Lee"), (1, "Mary Lee")], "doc_id long, name string")
    threads = spark.createDataFrame([(1, "t"), (2, "t"), (5, "u")], "doc_id long, key string")
    with_ = spark.createDataFrame([(1, "p"), (3, "p"), (5, "q"), (5, None)], "doc_id long, key string")
    got = {(r.ask, r["name"]): (round(r.score, 3), r.source) for r in linking.expanded(a, found, people, threads, with_).collect()}
    assert got == {
        (1, "Mary Lee"): (1.0, "participant"), (1, "Sir Lee"): (1.0, "participant"), (1, "Ann Lee"): (0.9, "thread"), (1, "Bob Lee"): (0.8, "correspondents"), (1, "Zoe Lee"): (0.7, "archive"),
        **{(2, n): (0.7, "archive") for n in ("Mary Lee", "Ann Lee", "Bob Lee", "Zoe Lee")},
    }


def test_alike(spark):
    found = [(1, "Lee"), (1, "Ann"), (2, "Lee"), (2, "Mary Lee"), (2, "Ann"), (3, "Mary Lee"), (3, "Ann"), (4, "Bob Lee"), (5, None), (4, "Bob Lee")]
    mail = [(1, "X@x"), (2, "x@x"), (2, "own@x"), (3, "x@x"), (4, "own@x"), (1, "own@x"), (3, None)]
    index = linking.features(spark.createDataFrame(found, "doc_id long, name string"), spark.createDataFrame(mail, "doc_id long, email string"))
    got = {r["name"]: r.score for r in linking.alike(index, spark.createDataFrame([("Lee",)], "asked string"), ["OWN@x"]).collect()}
    # Mary Lee stands with Ann twice, Lee once, x@x twice, own@x once; Ann's prior is 3 of 4
    want = 0.5 * (0.5 * (2 / 0.75) / 5**0.5 + 0.5 * 2 / 5**0.5)
    assert set(got) == {"Mary Lee", "Bob Lee"} and abs(got["Mary Lee"] - want) < 1e-12 and got["Bob Lee"] == 0.0
    assert linking.alike(index, spark.createDataFrame([("Lee",)], "asked string"), None, 1).count() == 1


def test_singulars(spark):
    # Plural and singular forms as published with such rules.
    pairs = "selves self indices index hypotheses hypothesis camaraderies camaraderie potatoes potato dishes dish countries country toes toe passes pass ligases ligase gases gas canvases canvas aliases alias disabuses disabuse accuses accuse diffuses diffuse buses bus cats cat cacti cactus houses house goes go mice mouse gas gas bus bus is is Feet foot".split()
    df = spark.createDataFrame(list(zip(pairs[::2], pairs[1::2], strict=True)), "word string, want string")
    assert not [tuple(r) for r in df.withColumn("got", dictionary.singular(F.col("word"))).collect() if r.got != r.want]
    got = spark.createDataFrame([("tried",), ("walked",), ("Going",), ("sing",), (None,)], "word string").select(dictionary.simple_form(F.col("word")).alias("x")).collect()
    assert [r.x for r in got] == ["try", "walk", "go", "s", None]
    short = spark.createDataFrame([("Dept.", "Department"), ("dept", "Dept of"), (None, "x")], "short string, full string")
    got = dictionary.expanded_abbreviations(spark.createDataFrame([("DEPT",), ("dept.",), ("other",), (None,)], "word string"), short).collect()
    assert {(r.word, r.full) for r in got} == {("DEPT", "Department"), ("dept.", "Department"), ("other", "other"), (None, None)}


def test_alike_many_fuller_names(spark):
    """A looked-up name of 2,000 features and 4,000 fuller names: they meet by feature, not all with all."""
    k = spark.range(4000)
    index = (
        k.select(F.concat(F.lit("Lee "), "id").alias("name"), F.lit("name").alias("kind"), F.concat(F.lit("f"), F.col("id") % 2000).alias("feature"))
        .unionByName(spark.range(2000).select(F.lit("Lee").alias("name"), F.lit("name").alias("kind"), F.concat(F.lit("f"), "id").alias("feature")))
        .withColumns({"weight": F.lit(1).cast("long"), "prior": F.lit(0.5)})
    )
    out = linking.alike(index, spark.createDataFrame([("Lee",)], "asked string"))
    assert out.count() == 4000
    tree = out._jdf.queryExecution().optimizedPlan().toString()
    # the join that brings the looked-up name's features is by feature too
    joins = [x for x in tree.splitlines() if "Join Inner" in x and "asked" in x]
    assert joins and all("feature" in x for x in joins)


def test_across_archives_by_parts(spark):
    rows = spark.createDataFrame([("a", "Customer#000000010"), ("a", "Customer#000000010"), ("b", "Customer#000000011"), ("b", "Customer#000000020"), ("c", None)], "archive_id string, display string")
    assert sorted(map(tuple, entities.across_archives(rows, "#00000001", parts=True).collect())) == [("a", "Customer#000000010"), ("b", "Customer#000000011")]
    assert entities.across_archives(rows, "#00000001").count() == 0


def test_containing_of_a_common_word(spark, monkeypatch):
    """Names of a common word are dealt into parts that each looked-up name goes to: the same pairs, none twice."""
    monkeypatch.setattr(linking, "PART", 3)
    names = [f"{a} of {b}" for a in "abcdefg" for b in ("x", "y")] + ["of", "OF", "x of x"]
    asked = ["of", "of x", "x", "y", "g of", "zz", "OF"]
    out = linking.containing(spark.createDataFrame([(n,) for n in names * 2], "name string"), spark.createDataFrame([(a,) for a in asked], "asked string"), acronyms=True)
    got = [(r.asked, r.name) for r in out.collect()]
    assert sorted(got) == sorted({(a, n) for a in asked for n in names if holds(n, a)})
    # "OFX" holds itself and is short for another
    twice = linking.containing(spark.createDataFrame([("OFX",), ("Open F X",)], "name string"), spark.createDataFrame([("OFX",)], "asked string"), acronyms=True)
    assert sorted(r.name for r in twice.collect()) == ["OFX", "Open F X"]


def test_nearest_counts_only_near_an_ask(spark, monkeypatch):
    """Names of keys that no mention has are not counted at that level."""
    seen, best = [], linking._best
    monkeypatch.setattr(linking, "_best", lambda rows, group, *more: (seen.append({r.key for r in rows.collect()}) if "key" in group else None) or best(rows, group, *more))
    found = spark.createDataFrame([(k, f"Ann Lee {k}") for k in range(40)], "doc_id long, name string")
    own = spark.createDataFrame([(k, str(k)) for k in range(40)], "doc_id long, key string")
    got = linking.nearest(spark.createDataFrame([(1, 7, "Lee")], "ask long, doc_id long, text string"), found, [own, None], 2).collect()
    assert [tuple(r) for r in got] == [(1, "Ann Lee 7", 0, 1), (1, "Ann Lee 0", 1, 1)]
    assert seen == [{"7"}, {""}]
