"""A trained recogniser of names: mixtures of words, learnt from a gazette of typed names.

A name is explained by one of its words.  A word (a mixture) has a prior and, for each
dimension, a distribution of what stands with it: T the name's type, L and R the types of
the words to its left and right (`NULL` at an end), S the joining word of the name, D
whether another of its words is in a dictionary.  Expectation maximisation shares each
name out among its words.  Types of neighbours are those that the gazette gives a word
most often; they are fixed before the first round, so no round lowers the objective.

Training is a loop of DataFrame aggregations.  The gazette is reduced to distinct names
with a weight first; a round joins names' words with the statistics of the last round by
word, shares names out in a window a name (a name has few words), and sums up by (word,
dimension, value) with partial sums before the shuffle.  Each round's statistics are a
written table, in which the log-likelihood of the round before is one more row.

Null and empty names are left out, as are names without a word to learn.  Words that are
seen in fewer than `min_count` names, of one letter, or with a digit are not learnt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postbag.functions import types as kinds
from postbag.sinks.shared import written

# Joining words of names, and symbols that bind to the word after them.
JOIN_WORDS = ["and", "for", "to", "in", "at", "on", "the", "of", "a", "an", "is", "from", "de", "van", "von", "da", "ibn", "mac", "bin", "del", "dos", "di", "la", "du", "ben", "ap", "le", "bint", "do"]
SYMBOLS = ["&", "-", ","]
#: Smoothing of a word's distributions, and the least share of a type for a word to speak for it.
SMOOTH, LEAST_SHARE = 0.2, 0.1
MIN_COUNT = 3
#: The type of a word that is not learnt.
UNKNOWN = "?"
#: Number of values of each dimension.
SIZES = {"T": len(kinds.TYPES), "L": len(kinds.TYPES) + 2, "R": len(kinds.TYPES) + 2, "S": len(JOIN_WORDS) + 1, "D": 2}
FEATURES = "array<struct<dim:string,value:string,part:double>>"


def _set(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def words_of(name: Column) -> Column:
    """Lower-cased words of a name in order; punctuation at a word's ends is cut, but for initials."""
    raw = F.split(F.lower(F.trim(F.regexp_replace(name, r"\s+", " "))), " ")
    cut = F.transform(raw, lambda w: F.when(w.rlike(r"^.\.$") | w.isin(SYMBOLS), w).otherwise(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    return F.filter(cut, lambda w: w != "")


def with_patterns(names: DataFrame, name: str = "name") -> DataFrame:
    """`names` with _w, the words of a name, and _p, (word, at) of those that mixtures are kept for.

    A symbol before a word and a joining word after it belong to it; joining words and
    symbols alone are no words.  A word's first place counts.
    """
    join, sign = _set(JOIN_WORDS), _set(SYMBOLS)
    found = f"""filter(transform(_w, (w, i) -> struct(if(array_contains({join}, w) or array_contains({sign}, w), null,
      concat(if(coalesce(array_contains({sign}, get(_w, i - 1)), false), concat(get(_w, i - 1), ' '), ''), w,
             if(coalesce(array_contains({join}, get(_w, i + 1)), false), concat(' ', get(_w, i + 1)), ''))) as word, i as at)), p -> p.word is not null)"""
    first = "filter(_q, (p, i) -> i = 0 or not exists(slice(_q, 1, i), q -> q.word = p.word))"
    return names.withColumn("_w", words_of(F.col(name))).withColumn("_q", F.expr(found)).withColumn("_p", F.expr(first)).drop("_q")


def learnable(word: Column) -> Column:
    return (F.length(word) > 1) & ~word.rlike(r"\d")


def distinct_names(gazette: DataFrame) -> DataFrame:
    """(name, type, weight) of a gazette (name, type): names as lower-cased words, how often each is there.

    Words are cut once for each name as it is written, not for each of its rows.
    """
    # with the count in it, the key and the filter on it stay above the first grouping
    key = F.when(F.col("n") > 0, F.array_join(words_of(F.col("name")), " "))
    raw = gazette.where("name is not null and type is not null").groupBy("name", F.col("type").cast("int").alias("type")).agg(F.count("*").alias("n"))
    return raw.select(key.alias("name"), "type", "n").where("name != ''").groupBy("name", "type").agg(F.sum("n").cast("double").alias("weight"))


def word_types(names: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n, type) of the words to learn: names with it, and the type of most of these (not other, if any else)."""
    rows = with_patterns(names).select("type", "weight", F.explode("_p.word").alias("word")).where(learnable(F.col("word")))
    per = rows.groupBy("word", "type").agg(F.sum("weight").alias("n"))
    best = F.max_by("type", F.struct((F.col("type") != kinds.OTHER).alias("a"), F.col("n").alias("b"), (-F.col("type")).alias("c")))
    return per.groupBy("word").agg(F.sum("n").alias("n"), best.cast("string").alias("kind")).where(F.col("n") >= min_count)


def features(phrases: DataFrame, kinds_of: DataFrame, key: list[str], name: str = "name", dictionary: DataFrame | None = None) -> DataFrame:
    """(key, word, at, known, feats) of every pattern of `phrases`: what stands with it, but for the type.

    `feats` has (dim, value, part): each left and right neighbour's type with its share of
    the dimension, the joining word, and whether another word is in the dictionary (word).
    """
    told = with_patterns(phrases, name)
    # the first joining word that is not at the start and belongs to no other part of the phrase
    joint = F.coalesce(F.get(F.filter("_w", lambda w, i: (i > 0) & w.isin(JOIN_WORDS)), F.lit(0)), F.lit("NULL"))
    rows = told.select(*key, joint.alias("_j"), F.explode("_p").alias("p")).select(*key, "_j", F.col("p.word").alias("word"), F.col("p.at").alias("at"))
    rows = rows.join(kinds_of.select("word", "kind"), "word", "left")
    if dictionary is not None:
        rows = rows.join(dictionary.select("word").distinct().withColumn("_d", F.lit(True)), "word", "left")
    else:
        rows = rows.withColumn("_d", F.lit(None).cast("boolean"))
    mate = F.struct("at", "word", F.col("kind").isNotNull().alias("known"), F.coalesce("kind", F.lit(UNKNOWN)).alias("kind"), F.coalesce("_d", F.lit(False)).alias("common"))
    whole = rows.groupBy(*key).agg(F.first("_j").alias("_j"), F.array_sort(F.collect_list(mate)).alias("mates"))  # a phrase's own words
    side = lambda dim, test: f"transform(if(size(filter(mates, x -> {test})) = 0, array('NULL'), transform(filter(mates, x -> {test}), x -> x.kind)), k -> struct('{dim}' as dim, k as value, 1D / greatest(1, size(filter(mates, x -> {test}))) as part))"
    feats = f"""concat({side("L", "x.at < m.at")}, {side("R", "x.at > m.at")}, array(struct('S' as dim, _j as value, 1D as part),
      struct('D' as dim, if(exists(mates, x -> x.common and x.at <> m.at), 'Y', 'N') as value, 1D as part)))"""
    return whole.select(*key, F.expr(f"inline(transform(mates, m -> struct(m.word as word, m.at as at, m.known as known, cast({feats} as {FEATURES}) as feats)))"))


@dataclass
class Model:
    """What training leaves: statistics (word, dim, value, c) of the last round, word types, the
    gazette's names with types, its weight, and each round's log-likelihood and objective."""

    stats: DataFrame
    kinds: DataFrame
    names: DataFrame
    total: float
    rounds: list[tuple[int, float, float]]
    smooth: float = SMOOTH
    dictionary: DataFrame | None = None

    def words(self) -> DataFrame:
        """(word, n, counts): a row a word, counts by `dim:value`; their number is bounded by `SIZES`."""
        pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat("dim", F.lit(":"), "value").alias("k"), F.col("c").alias("v")))))
        return self.stats.where("word is not null").groupBy("word").agg(F.sum(F.when(F.col("dim") == "T", F.col("c")).otherwise(0.0)).alias("n"), pairs.alias("counts"))


def _sizes(dim: str) -> str:
    return f"case {dim} " + " ".join(f"when '{d}' then {n}" for d, n in SIZES.items()) + " end"


def _log_theta(feats: str, smooth: float) -> Column:
    """Sum of part x log of the smoothed share of each feature, from columns n and counts."""
    return F.expr(f"aggregate({feats}, 0D, (s, f) -> s + f.part * ln((coalesce(counts[concat(f.dim, ':', f.value)], 0D) + {smooth}) / (n + {smooth} * {_sizes('f.dim')})))")


def _summed(shares: DataFrame) -> DataFrame:
    """Statistics of names shared out: a row a (word, dim, value), and the log-likelihood under a null word."""
    rows = shares.select("word", F.explode("feats").alias("f"), (F.col("weight") * F.col("gamma")).alias("g"), "ll")
    counts = rows.groupBy("word", F.col("f.dim").alias("dim"), F.col("f.value").alias("value")).agg(F.sum(F.col("g") * F.col("f.part")).alias("c"))
    total = shares.agg(F.sum("ll").alias("c")).select(F.lit(None).cast("string").alias("word"), F.lit("#").alias("dim"), F.lit("ll").alias("value"), "c")
    return counts.unionByName(total)


def objective(stats: DataFrame, log_likelihood: float, smooth: float) -> float:
    """The log-likelihood with the log of the smoothing's prior: what a round cannot lower."""
    words = stats.where("word is not null").groupBy("word").agg(F.sum(F.when(F.col("dim") == "T", F.col("c")).otherwise(0.0)).alias("n"))
    per = stats.where("word is not null").join(words, "word").groupBy("word", "dim", "n").agg(F.sum(F.expr(f"ln((c + {smooth}) / (n + {smooth} * {_sizes('dim')}))")).alias("seen"), F.count("*").alias("k"))
    value = per.agg(F.sum(F.expr(f"seen + ({_sizes('dim')} - k) * ln({smooth} / (n + {smooth} * {_sizes('dim')}))")).alias("x")).first().x
    return log_likelihood + smooth * (value or 0.0)


def train(gazette: DataFrame, rounds: int = 20, smooth: float = SMOOTH, min_count: int = MIN_COUNT, tolerance: float | None = 1e-6, dictionary: DataFrame | None = None) -> Model:
    """Expectation maximisation over a gazette (name, type); stops where a round gains less than `tolerance` of the objective (None: after all rounds).

    With `rounds` 0 every name is shared out equally among its words.
    """
    if smooth <= 0:
        raise ValueError("smooth must be positive: a share of 0 has no logarithm")
    names = written(distinct_names(gazette), "names")
    known = written(word_types(names, min_count), "words")
    parts = features(names, known, ["name", "type", "weight"], dictionary=dictionary).where("known")
    typed = F.concat(F.array(F.struct(F.lit("T").alias("dim"), F.col("type").cast("string").alias("value"), F.lit(1.0).alias("part"))), F.col("feats"))
    seen = written(parts.select("name", "type", "weight", "word", typed.cast(FEATURES).alias("feats")), "observed")
    total = seen.select("name", "type", "weight").distinct().agg(F.sum("weight").alias("n")).first().n or 0.0
    one = Window.partitionBy("name", "type")
    even = seen.withColumn("gamma", 1.0 / F.count("*").over(one)).withColumn("ll", F.lit(0.0))
    model = Model(written(_summed(even), "stats"), known, names, total, [], smooth, dictionary)
    before = None
    for k in range(rounds):
        scored = seen.join(model.words(), "word").select("name", "type", "weight", "word", "feats", (F.log("n") + _log_theta("feats", smooth)).alias("lf"))
        top = F.max("lf").over(one)
        mass = F.sum(F.exp("d")).over(one)
        shared = scored.withColumn("top", top).withColumn("d", F.col("lf") - F.col("top")).withColumn("mass", mass).withColumn("k", F.count("*").over(one))
        # a name's log-likelihood is told by its words in equal parts, so that it is counted once
        told = F.col("weight") * (F.col("top") + F.log("mass") - F.log(F.lit(total))) / F.col("k")
        after = written(_summed(shared.withColumn("gamma", F.exp("d") / F.col("mass")).withColumn("ll", told)), "stats")
        ll = after.where("word is null").agg(F.first("c").alias("c")).first().c or 0.0
        model.rounds.append((k, ll, objective(model.stats, ll, smooth)))
        gain = None if before is None else model.rounds[-1][2] - before
        before = model.rounds[-1][2]
        model.stats = after
        if tolerance is not None and gain is not None and gain < tolerance * abs(before):
            break
    return model


def unseen(model: Model) -> float:
    """What a word never learnt adds: flat shares under the smoothing's part of the gazette."""
    flat = 1.0
    for n in SIZES.values():
        flat /= n
    return flat * model.smooth / (model.total + model.smooth)


def segment_scores(segments: DataFrame, model: Model, gazette_hits: bool = True) -> DataFrame:
    """(segment, type, score) for distinct phrases (segment) and each type that a word of theirs speaks for.

    The score is the mixture's likelihood: over the phrase's words, the sum of prior x share
    of each feature, in log space word by word.  A word that does not speak for the type (its
    share of it is under `LEAST_SHARE`) adds nothing; a word not learnt adds the flat share of
    all features under the prior of an unseen word.  A phrase of several words that the gazette has under
    the type scores 1, one that begins or ends with a joining word 0.
    """
    s = model.smooth
    asked = segments.select("segment").where("segment is not null").distinct()
    rows = features(asked, model.kinds, ["segment"], "segment", model.dictionary).join(model.words(), "word", "left")
    rows = rows.withColumn("known", F.col("n").isNotNull()).withColumn("ctx", _log_theta("feats", s))
    types = F.array(*map(F.lit, kinds.TYPES))
    share = lambda t: f"(coalesce(counts[concat('T:', cast({t} as string))], 0D) + {s}) / (n + {s} * {SIZES['T']})"
    spoken = rows.where("known").select("segment", F.explode(types).alias("type"), "n", "counts", "ctx")
    spoken = spoken.withColumn("p", F.expr(share("type"))).where(F.col("p") >= LEAST_SHARE)
    own = spoken.groupBy("segment", "type").agg(F.sum(F.exp(F.log("n") - F.log(F.lit(model.total)) + F.log("p") + F.col("ctx"))).alias("own"))
    size = rows.groupBy("segment").agg(F.sum(F.when(F.col("known"), 0).otherwise(1)).alias("new"))
    scored = own.join(size, "segment").withColumn("score", F.col("own") + F.col("new") * unseen(model))
    words = words_of(F.col("segment"))
    ends = F.get(words, F.lit(0)).isin(JOIN_WORDS) | F.element_at(words, -1).isin(JOIN_WORDS)
    scored = scored.withColumn("score", F.when(ends, 0.0).otherwise(F.col("score"))).select("segment", "type", "score")
    if not gazette_hits:
        return scored
    keyed = asked.withColumn("name", F.array_join(words_of(F.col("segment")), " ")).where(F.instr("name", " ") > 0)
    hits = keyed.join(model.names, "name").select("segment", "type", F.lit(1.0).alias("score"))
    return scored.unionByName(hits).groupBy("segment", "type").agg(F.max("score").alias("score"))
