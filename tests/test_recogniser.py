"""The recogniser: training against brute force, decoding against all cuts, candidates in sentences."""

import collections
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from postbag.functions import types as kinds
from postbag.operators import candidates, decode, naive
from postbag.operators import recogniser as R

FIRST, LAST = ["Anna", "Bruno", "Chen", "Dora", "Emil"], ["Stone", "River", "Park", "Moor"]


def name_list(n, seed=3):
    rng, out = random.Random(seed), []
    for _ in range(n):
        a, b = rng.choice(FIRST), rng.choice(LAST)
        out.append(rng.choice([(f"{a} {b}", 0), (f"{a} {b}", 0), (f"Mr. {a} {b}", 0), (f"{b} & Sons", 1), (f"Bank of {b}", 1), (f"{b} Street", 5), (f"{a} {b} Street", 5), (f"University of {a}", 7), (b, 38), (f"{a}  van  {b},", 0)]))
    return out


def split(name):
    out = []
    for w in name.lower().split():
        if not (len(w) == 2 and w[1] == ".") and w not in R.SYMBOLS:
            while w and not w[0].isalnum():
                w = w[1:]
            while w and not w[-1].isalnum():
                w = w[:-1]
        if w:
            out.append(w)
    return out


def patterns(w):
    out = {}
    for i, x in enumerate(w):
        if x not in R.JOIN_WORDS and x not in R.SYMBOLS:
            p = (w[i - 1] + " " if i and w[i - 1] in R.SYMBOLS else "") + x + (" " + w[i + 1] if i + 1 < len(w) and w[i + 1] in R.JOIN_WORDS else "")
            out.setdefault(p, i)
    return out


def brute_features(w, types):
    found, out = patterns(w), {}
    joint = next((x for i, x in enumerate(w) if i and x in R.JOIN_WORDS), "NULL")
    for p, at in found.items():
        f = collections.defaultdict(float)
        for dim, side in (("L", [q for q, b in found.items() if b < at]), ("R", [q for q, b in found.items() if b > at])):
            for k in [types.get(q, "?") for q in side] or ["NULL"]:
                f[dim, k] += 1 / max(1, len(side))
        f["S", joint] += 1
        f["D", "N"] += 1
        out[p] = f
    return out


def brute_train(names, rounds, s, least=3):
    weight = collections.Counter((" ".join(split(n)), t) for n, t in names)
    per = collections.defaultdict(collections.Counter)
    for (n, t), k in weight.items():
        for p in patterns(n.split(" ")):
            if len(p) > 1 and not any(c.isdigit() for c in p):
                per[p][t] += k
    types = {p: str(max(c, key=lambda t: (t != kinds.OTHER, c[t], -t))) for p, c in per.items() if sum(c.values()) >= least}
    obs = {}
    for (n, t), k in weight.items():
        f = {p: {**x, ("T", str(t)): 1.0} for p, x in brute_features(n.split(" "), types).items() if p in types}
        if f:
            obs[n, t] = (k, f)
    total = sum(k for k, _ in obs.values())
    gamma, lls = {o: {p: 1 / len(f) for p in f} for o, (_, f) in obs.items()}, []
    for r in range(rounds + 1):
        c = collections.defaultdict(float)
        for o, (k, f) in obs.items():
            for p, x in f.items():
                for key, part in x.items():
                    c[(p, *key)] += k * gamma[o][p] * part
        if r == rounds:
            return c, lls, types, total
        n_ = {p: sum(v for (q, d, _), v in c.items() if q == p and d == "T") for p in types}
        ll = 0.0
        for o, (k, f) in obs.items():
            lf = {p: math.log(n_[p] / total) + sum(part * math.log((c[(p, *key)] + s) / (n_[p] + s * R.SIZES[key[0]])) for key, part in x.items()) for p, x in f.items()}
            z = sum(map(math.exp, lf.values()))
            gamma[o] = {p: math.exp(v) / z for p, v in lf.items()}
            ll += k * math.log(z)
        lls.append(ll)


@pytest.fixture(scope="module")
def gazette(spark):
    rows = [*name_list(200), (None, 0), ("", 1), ("  ", 1), ("nobody", None), ("x1 99", 2)]
    return spark.createDataFrame(rows, "name string, type int").withColumn("word", F.lit("clash")).cache()


@pytest.mark.parametrize("smooth", [0.01, 0.2])
def test_training(gazette, smooth):
    m = R.train(gazette, rounds=6, smooth=smooth, tolerance=None)
    want, lls, types, total = brute_train(name_list(200), 6, smooth)
    got = {(r.word, r.dim, r.value): r.c for r in m.stats.where("word is not null").collect()}
    assert m.total == total and {r.word: r.kind for r in m.kinds.collect()} == types
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in want)
    assert all(math.isclose(a, b, rel_tol=1e-9) for (_, a, _), b in zip(m.rounds, lls, strict=True))
    for (_, _, before), (_, _, after) in itertools.pairwise(m.rounds):
        assert after >= before - 1e-9


def test_training_stops_and_takes_nothing(spark, gazette):
    assert len(R.train(gazette, rounds=200, tolerance=1e-3).rounds) < 200
    none = R.train(spark.createDataFrame([], "name string, type int"), rounds=2)
    assert none.total == 0 and none.stats.where("word is not null").count() == 0


@pytest.fixture(scope="module")
def model(gazette):
    return R.train(gazette, rounds=4)


def phrase_of(m, words, names=None):
    entries = {r.word: (r.n, r.counts) for r in m.words().collect()}
    types = {r.word: r.kind for r in m.kinds.collect()}
    hits = collections.defaultdict(list)
    for r in m.names.collect():
        hits[r.name].append(r.type)
    own = {" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)}
    return decode.Phrase(words, entries, types, {k: v for k, v in hits.items() if k in own}, set(), names or [True] * len(words), m.total, m.smooth, R.unseen(m))


def test_scores_are_those_of_the_decoder(spark, model):
    asked = ["anna stone", "bank of moor", "moor & sons", "bank of anna", "new stone street", "of stone", "stone of", "dora van park", "river", "zeno stone"]
    got = collections.defaultdict(dict)
    for r in R.segment_scores(spark.createDataFrame([(a,) for a in [*asked, None]], "segment string"), model).collect():
        got[r.segment][r.type] = r.score
    for a in asked:
        p = phrase_of(model, a.split(" "))
        for t in kinds.TYPES:
            assert math.isclose(p.score(0, len(p.words), t), got[a].get(t, 0.0), rel_tol=1e-9, abs_tol=1e-300), (a, t)
    assert got["anna stone"][0] == 1.0 and got["of stone"][0] == 0.0


def cuts(n):
    for marks in itertools.product([0, 1], repeat=n - 1):
        at = [0, *[i + 1 for i, x in enumerate(marks) if x], n]
        yield list(itertools.pairwise(at))


def test_decoding_is_the_best_of_all_cuts(model):
    rng = random.Random(8)
    words = [w.lower() for w in FIRST + LAST] + ["street", "bank", "of", "&", "sons", "mr", "zeno", "university", "van"]
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 9):
        for _ in range(6):
            p = phrase_of(model, [rng.choice(words) for _ in range(n)], [rng.random() < 0.8 for _ in range(n)])
            kinds_ = p.candidates()
            kinds_ += [k for ks in p.hits.values() for k in ks if k not in kinds_]
            best = max(sum(p.best(i, j, kinds_)[0] for i, j in c) / len(c) for c in cuts(n) if all(j - i <= decode.SEGMENT for i, j in c))
            got = p.cut()
            assert [a for a, *_ in got] == [0, *[b for _, b, *_ in got[:-1]]] and got[-1][1] == n
            mean = sum(x[3] for x in got) / len(got)
            assert mean == best or math.isclose(mean, best, rel_tol=1e-12)


def test_segments_of_phrases(spark, model):
    rows = ["Anna Stone River Street", "Bank of Moor", "Zeno", "of of", "one two three four five six seven eight nine ten", None, "", "Anna Stone River Street"]
    got = collections.defaultdict(list)
    for r in decode.segments(spark.createDataFrame([(x,) for x in rows], "phrase string"), model).collect():
        got[r.phrase].append((r.first, r.text, r.type))
    want = {"Anna Stone River Street": [(0, "anna stone", 0), (2, "river street", 5)], "Bank of Moor": [(0, "bank of moor", 1)]}
    assert {k: sorted(v) for k, v in got.items()} == want
    # a joining word is no name by itself, but may stand in one; another word that is none cuts the phrase
    nouns = spark.createDataFrame([("of", False), ("yesterday", False)], "word string, noun boolean")
    asked = spark.createDataFrame([("Yesterday Bank of Moor",), ("Bank of Moor",)], "phrase string")
    got = {(r.phrase, r.text, r.score) for r in decode.segments(asked, model, nouns).collect()}
    assert got == {(p, "bank of moor", 1.0) for p in ("Yesterday Bank of Moor", "Bank of Moor")}


def test_naive_bayes(spark, gazette):
    names = name_list(200)
    asked = ["Anna Stone", "Moor Street Street", "zeno", "University of Chen", ""]
    words, heads = collections.defaultdict(collections.Counter), collections.Counter()
    for n, t in names + [("x1 99", 2)]:
        words[t].update(split(n))
        heads[t] += 1
    v = len({w for c in words.values() for w in c}) + 1
    got = {(r.phrase, r.type): r.score for r in naive.scores(spark.createDataFrame([(a,) for a in asked], "phrase string"), naive.train(gazette)).collect()}
    for a in asked:
        for t in heads:
            want = math.log(heads[t] / sum(heads.values())) + sum(math.log((words[t][w] + 1) / (sum(words[t].values()) + v)) for w in split(a))
            assert math.isclose(got[a, t], want, rel_tol=1e-9)
    top = {r.phrase: (r.type, r.p) for r in naive.classified(spark.createDataFrame([(a,) for a in asked], "phrase string"), naive.train(gazette)).collect()}
    for a in asked:
        s = {t: got[a, t] for t in heads}
        assert top[a][0] == max(s, key=lambda t: (s[t], -t)) and math.isclose(top[a][1], 1 / sum(math.exp(x - max(s.values())) for x in s.values()), rel_tol=1e-9)
    assert naive.scores(spark.createDataFrame([("a",)], "phrase string"), naive.train(gazette.where("false"))).count() == 0


def test_types(spark):
    rows = [("University|EducationalInstitution|Organisation|Agent", 7, 11), ("Person|Agent", 0, 0), ("Agent", 0, 0), ("Saint|Cleric|Person|Agent", 0, 0), ("Park|Place", 3, 3), ("Motorway|Road|RouteOfTransportation|Infrastructure|ArchitecturalStructure|Place", 5, 3), ("Film|Work", 38, 38), (None, 38, 38), ("", 38, 38)]
    df = spark.createDataFrame(rows, "path string, code int, up int").withColumn("got", kinds.parse_path(F.col("path"))).withColumn("top", kinds.coarse(F.col("got")))
    assert all((r.code, r.up) == (r.got, r.top) for r in df.collect())
    got = spark.range(1).select(kinds.coarse(F.lit(99)).alias("a"), kinds.coarse(F.lit(None)).alias("b"), kinds.ancestors(F.lit(7)).alias("c"), kinds.ancestors(F.lit(3)).alias("d"), kinds.type_name(F.lit(13)).alias("e")).first()
    assert (got.a, got.b, got.c, got.d, got.e) == (38, 38, [7, 11], [3], "Periodical Literature")


# The sentences and the names in them stand as the published tests of such a tokenizer have them.
SENTENCES = [
    ("A book named Information Retrieval by Christopher Manning", ["Information Retrieval", "Christopher Manning"]),
    ("I have visited Museum of Modern Arts aka. MoMA, MMA, MoMa", ["Museum of Modern Arts", "MoMA", "MMA", "MoMa"]),
    ("Sound of the Music and Arts program by SALL Studios", ["Music and Arts", "SALL Studios"]),
    ("Performance by Chaurasia, Hariprasad was great!", ["Chaurasia", "Hariprasad"]),
    ("Dummy of the and Something", []),
    ("Mr. HariPrasad was present.", ["Mr. HariPrasad"]),
    ("We traveled through A174 Road.", ["A174 Road"]),
    ("The MIT school has many faculty members who were awarded the Nobel Prize in Physics", ["MIT", "Nobel Prize in Physics"]),
    ("We are meeting at Barnie's and then go to Terry's", ["Barnie", "Terry"]),
    ("He won a gold in 1874 Winter Olympics", ["Winter Olympics"]),
    (">Holly Crumpton in an interview said he will never speak to public directly", ["Holly Crumpton"]),
    ("The popular Ellen de Generes show made a Vincent van Gogh themed episode", ["Ellen de Generes", "Vincent van Gogh"]),
    ("Barack-O Obama is the President of USA", ["Barack-O Obama", "President of USA"]),
    ("CEO--Sundar attended a meeting in Delhi", ["CEO", "Sundar", "Delhi"]),
    ("Subject: Jeb Bush, the presidential candidate", ["Jeb Bush"]),
    ("From: Ted Cruz on Jan 15th, 2015", ["Ted Cruz"]),
    ("I met Frank'O Connor in the CCD", ["Frank'O Connor", "CCD"]),
    ("Annapoorna Residence,\nHouse No: 1975,\nAlma Street,\nPalo Alto,\nCalifornia", ["Annapoorna Residence", "House No", "Alma Street", "Palo Alto", "California"]),
    ("Dear Folks, it is party time!", []),
    ('Few years ago, I wrote an article on "Met The President"', ["President"]),
    ("Judith C Stern MA PT\nAmSAT Certified Teacher of the Alexander Technique\n31 Purchase Street\nRye NY 10580", ["Judith C Stern MA PT", "AmSAT Certified Teacher", "Alexander Technique", "Purchase Street", "Rye NY"]),
    ("Currently I am working in a Company", []),
    ("On Behalf of Mr. Spider Man, we would like to apologise", ["Mr. Spider Man"]),
    ("Hi Mrs. Senora, glad we have met", ["Mrs. Senora"]),
    ("My Thought on Thought makes an infinite loop", ["Thought"]),
    ("Hello this is McGill & Wexley Co.", ["McGill & Wexley Co"]),
    ("I am good Said Netanyahu", ["Netanyahu"]),
    ("Do you know about The New York Times Company that brutally charges for Digital subscription", ["New York Times Company"]),
    ("P.V. Krishnamoorthi", ["P.V. Krishnamoorthi"]),
    ("Should Rubin be told about this?", ["Rubin"]),
    ("You are talking to Robert Who?", ["Robert"]),
    ("I will never say a thing SAID REBECCA HALL", ["REBECCA HALL"]),
]
DICTIONARY = frozenset("sound performance dummy something the few company thought digital he".split())
NEVER = frozenset("should who currently".split())


@pytest.mark.parametrize(("text", "want"), SENTENCES)
def test_candidates_of_sentences(text, want):
    got = candidates.names_in(text, DICTIONARY, NEVER)
    assert [n for n, _, _ in got] == want
    assert all(" ".join(text[a:b].split()) == n for n, a, b in got)


def test_candidates(spark):
    rows = [(1, "Met Anna Stone.\n> said Bruno Park here\nOn Monday, Emil Moor wrote:\nDear Dora River"), (2, None), (3, ""), (None, "Chen Stone left Rome. Anna stayed."), (4, "x" * 10), (5, "Anna " * 900 + "here"), (6, "He saw " + "Anna Stone and " * 50 + "Dora.")]
    got = [tuple(r) for r in candidates.candidates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("stop", F.lit(0)), dictionary=DICTIONARY).collect()]
    by = collections.defaultdict(list)
    for d, t, a, b, own in got:
        by[d].append((t, own))
        assert " ".join(dict((r[0], r[1]) for r in rows)[d][a:b].split()) == t
    assert by[1] == [("Anna Stone", True), ("Bruno Park", False), ("Emil Moor", False), ("Dora River", False)]
    assert by[None] == [("Chen Stone", True), ("Rome", True), ("Anna", True)] and set(by) == {None, 1, 6}
    with pytest.raises(ValueError, match="word lists"):
        candidates.candidates(spark.createDataFrame(rows, "doc_id long, text string"), dictionary=map(str, range(candidates.MOST_WORDS + 1)))


def test_word_cases(spark):
    df = spark.createDataFrame([("We met Anna, then anna met us. And Rome, rome, Rome, Rome",), (None,)], "text string")
    got = {r.word: r.noun for r in decode.word_cases(df).collect()}
    assert got["anna"] and got["rome"] and not got["met"] and not got["then"]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_are_found_once(spark, model):
    """Mentions come from written candidates and written segments: no text is read by the finder again."""
    rows = [(1, "Yesterday Ann Lee met Bob Lee."), (2, "Yesterday Ann Lee met Bob Lee."), (3, None)]
    found = candidates.candidates(spark.createDataFrame(rows, "doc_id long, text string"))
    out = decode.recognised(found, model)
    assert "MapInArrow" not in plan(out)
    assert sorted(r.doc_id for r in out.select("doc_id").distinct().collect()) in ([1, 2], [])


def test_sentences_kept_by_a_task(spark):
    """A sentence met before has the same names at its new places, whatever the lists are."""
    text = "Hi Anna Smith met Bob Lee. They went. Hi Anna Smith met Bob Lee."
    assert candidates.names_in(text) == [("Anna Smith", 3, 13), ("Bob Lee", 18, 25), ("They", 27, 31), ("Anna Smith", 41, 51), ("Bob Lee", 56, 63)]
    frame = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string").coalesce(1)
    want = [(d, *n) for d in (1, 2) for n in candidates.names_in(text, frozenset(["they"]), frozenset(["lee"]))]
    assert [(r.doc_id, r.text, r.start, r.stop) for r in candidates.candidates(frame, dictionary=["they"], never=["Lee"]).collect()] == want


def test_words_are_cut_once_a_name(spark, model):
    """Names and phrases are made distinct before they are cut into words."""
    rows = spark.createDataFrame([("Ann  Lee", 0), ("ann lee", 0), ("Ann  Lee", 0), ("Ann Lee", 1), ("!?", 0), (None, 0), ("x", None)], "name string, type int").selectExpr("name", "type")
    names = R.distinct_names(rows)
    assert sorted(map(tuple, names.collect())) == [("ann lee", 0, 3.0), ("ann lee", 1, 1.0)]
    assert "regexp_replace" not in plan(names).split("Aggregate")[-1]
    lines = plan(decode.segments(rows.select(F.col("name").alias("phrase")), model)).splitlines()
    given = [k for k, line in enumerate(lines) if "LogicalRDD" in line]
    assert given and not [lines[k] for g in given for k in (g - 1, g - 2) if "regexp_replace" in lines[k]]


def test_entity_book(spark):
    """Against the mentions themselves; texts are collected only after they are summed up."""
    from postbag.operators import entities

    rng = random.Random(3)
    texts = ["Ann Lee", "Lee, Ann", "LEE ANN", "Bob", "bob", "...", "Zoe (X)"]
    rows = [(rng.choice([None, *range(12)]) if k % 9 == 0 else rng.randrange(12), rng.choice(texts), rng.choice([None, 0, 5, 7]), rng.randrange(2), rng.choice([0.0005, 0.2, 0.9])) for k in range(150)]
    book = entities.entity_book(spark.createDataFrame(rows, "doc_id long, text string, start int, type int, score double"))
    want = {}
    low = lambda v: (v is not None, v or 0)  # noqa: E731  nulls come first
    for doc, text, start, kind, score in rows:
        key = " ".join(sorted(w for w in re.split(r"[\s\".;,\-#@&()]+", text.lower()) if w))
        if key and score >= 0.001:
            want.setdefault((kind, key), []).append((low(doc), low(start), text, score))
    got = {(r.type, r.cname): (r.display, r.names, r.score, r.messages) for r in book.collect()}
    assert got == {k: (min(v)[2], sorted({x[2] for x in v}), max(x[3] for x in v), len({x[0] for x in v if x[0][0]})) for k, v in want.items()}
    tree = book._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in tree.splitlines() if "collect_set" in x and "doc_id" in x]
