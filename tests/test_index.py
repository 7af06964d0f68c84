"""The written index against scores by hand, and the stemmer against published pairs."""

import collections
import math

import pytest
from pyspark.sql import functions as F

from postbag.functions import porter
from postbag.functions import text as T
from postbag.operators.model import read
from postbag.plans import fulltext, search
from postbag.plans.index import B, K1, Index

# Words and stems as published with the rules.
PAIRS = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl
sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration
digitizer digit conformabli conform radicalli radic differentli differ analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal
decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal
electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust
defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ angulariti angular homologous homolog
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll running run happiness happi generalizations gener oscillators oscil""".split()


def test_published_stems():
    assert [(w, porter.stem_word(w)) for w in PAIRS[::2]] == list(zip(PAIRS[::2], PAIRS[1::2], strict=True))


def test_stems_of_all_words(spark):
    odd = ["yyyy", "syzygy", "ing", "ed", "ies", "eed", "y", "by", "sayyid", "falll", "ll", "ee", "sion", "nation", "ization", "élève", "1st", "a1ing", ""]
    words = read(spark, "/root/testdata/sf0.001", "documents").select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("word"))
    got = porter.stems(words.union(spark.createDataFrame([(w,) for w in [*odd, *PAIRS, None]], "word string"))).collect()
    assert len(got) > 500 and not [(r.word, r.stem) for r in got if r.stem != porter.stem_word(r.word)]


def test_queries_meet_stems_and_places(spark):
    df = spark.createDataFrame([("He was running past the state of the art",), ("state art",), ("runs: Happiness",), ("rune",)], "body string")

    def hits(q):
        cols = {"body": fulltext.tokens(F.col("body"), words=fulltext.query_words(q))}
        return [r.body[:5] for r in df.where(fulltext.compile_query(q, cols, ("body",))).collect()]

    assert hits("run") == ["He wa", "runs:"] and hits("happy") == ["runs:"]
    assert hits('"state art"') == ["state"] and hits('"state of the art"') == ["He wa"] and hits('"the state of an art"') == ["He wa"]
    assert hits("the") == [] and hits("run*") == ["He wa", "runs:", "rune"] and hits("rume~1") == ["rune"]


def test_regex_by_field(spark):
    m = spark.createDataFrame([(1, "hello", "foo bar"), (2, "foo", "bar FOO"), (3, None, "x"), (4, "a", None)], "doc_id long, subject string, body string").withColumn("date", F.lit(None).cast("timestamp"))

    def hits(**spec):
        return sorted(r.doc_id for r in search.search({"messages": m}, search.SearchSpec(**spec)).collect())

    assert hits(regex="^foo") == [1, 2] and hits(regex=r"lo\sfoo") == [] and hits(regex="foo$") == [2]
    assert hits(regex="foo", least_count=2) == [2] and hits(regex="FOO", case_sensitive=True) == [2] and hits(regex="q*") == [] and hits(regex=r"\b") == []
    with pytest.raises(ValueError, match="regular expression"):
        hits(regex="(a")


TEXTS = {1: "The quick brown fox. Quick foxes!", 2: "A fox, and a dog: 1,250.50 paid", 3: "state of the art", 4: "the state art of dogs dogs dogs", 5: None, 6: "", 7: "the of and", 8: "dog " * 2000}


def terms_of(text):
    return ["" if w in fulltext.STOP_WORDS else porter.stem_word(w) for w in T.number_words(text or "")]


def by_hand(words):
    """BM25 of every text for an OR of words."""
    docs = {d: [t for t in terms_of(x) if t] for d, x in TEXTS.items()}
    docs = {d: ts for d, ts in docs.items() if ts}
    mean, out = sum(map(len, docs.values())) / len(docs), collections.defaultdict(float)
    for w in words:
        t = porter.stem_word(w)
        df = sum(t in ts for ts in docs.values())
        for d, ts in docs.items():
            if tf := ts.count(t):
                out[d] += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ts) / mean))
    return dict(out)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    i = Index(spark, f"file://{tmp_path_factory.mktemp('index')}", {"body": "number", "subject": "standard", "key": "keyword"})
    rows = [(d, x, f"Running {d}", f"k-{d}") for d, x in TEXTS.items()]
    df = spark.createDataFrame(rows, "doc_id long, body string, subject string, key string").withColumns({"term": F.lit("clash"), "bucket": F.lit(9)})
    i.add(df.where("doc_id < 4"))
    i.add(df.where("doc_id >= 4"))
    i.add(df.where("false"))
    return i


def found(index, q, fields=("body",), **more):
    return {r.doc_id: r.score for r in index.search(q, fields, **more).collect()}


def test_scores(index):
    for words in (["fox"], ["dogs", "fox"], ["quick", "state", "dog"], ["zebra"]):
        got, want = found(index, " ".join(words)), by_hand(words)
        assert set(got) == set(want) and all(math.isclose(got[d], want[d], rel_tol=1e-9) for d in want)


def test_boosts(index):
    got, one, two = found(index, 'fox^3 OR "quick"^0.5'), by_hand(["fox"]), by_hand(["quick"])
    assert all(math.isclose(got[d], 3 * one.get(d, 0) + 0.5 * two.get(d, 0), rel_tol=1e-9) for d in got) and set(got) == set(one) | set(two)
    assert [(n.value, n.boost) for n in fulltext.parse('fox^3 "a quick dog"^2 run*^1.5').parts] == [(["fox"], 3.0), (["quick", "dog"], 2.0), ("run*", 1.5)]
    assert sorted(found(index, "body:fox^2 AND quick")) == [1]


def test_queries_of_the_index(index):
    hits = lambda q, *a, **k: sorted(found(index, q, *a, **k))
    assert hits('"state of the art"') == [3] and hits('"state art"') == [4] and hits("+fox -dog") == [1] and hits("fox AND dog") == [2]
    assert hits("dog NOT (fox OR state)") == [8] and hits("1,250.50") == [2] and hits("qui*") == [1] and hits("stats~1") == [3, 4]
    assert hits("running", ("subject",)) == list(range(1, 9)) and hits("run", ("subject",)) == [] and hits("key:k-3 OR subject:7") == [3, 7]
    assert hits("fox", least=2) == [1] and hits("the") == [] and hits("nothing*") == []
    assert [r.doc_id for r in index.search("dog", ("body",), limit=2).collect()] == sorted(by_hand(["dog"]), key=lambda d: (-by_hand(["dog"])[d], d))[:2]


def test_search_reads_its_own_terms(index):
    plan = index._of([("body", "fox")])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    assert "term" in plan[plan.index("PushedFilters") :] and "regexp" not in plan


def test_texts_are_cut_into_words_once(spark, tmp_path):
    """Sizes, terms and stems come from the same words: a text is read once."""
    read_ = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: (read_.add(1), x)[1], "string").asNondeterministic()
    df = spark.createDataFrame([(1, "Running runs ran the run"), (2, ""), (3, None), (4, "the")], "doc_id long, body string").withColumn("body", count("body"))
    index = Index(spark, str(tmp_path / "i"), {"body": "number"})
    index.add(df)
    assert read_.value == 4
    assert sorted((r.term, r.doc_id, r.tf, r.places, r.length) for r in index.postings().collect()) == [("ran", 1, 1, [2], 4), ("run", 1, 3, [0, 1, 4], 4)]
    assert index.sizes() == {"body": (1, 4)}
