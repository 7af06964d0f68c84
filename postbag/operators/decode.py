"""Names in phrases: the best cut of a phrase into typed segments under a trained model.

A phrase of at most `LONGEST` words is cut into segments of at most `SEGMENT` words; a
segment has a type and its score (see `recogniser.segment_scores`), or is a single word
that is no name.  Of all cuts the one with the greatest geometric mean of its segments'
scores is taken; the dynamic program keeps the best product for each end and number of
segments, so it is exact.  Equal means: fewer segments, then longer ones first.

Phrases are made distinct, and what the model has on their words and segments is joined to
them, so a task holds a phrase's own entries and no model.  Segments stand in Arrow
batches only within a task; phrases are short, so is their work.

Null and empty phrases and longer ones give no segments.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postbag.functions import types as kinds
from postbag.operators import recogniser as R
from postbag.sinks.shared import written

LONGEST, SEGMENT, TOP_TYPES = 9, 7, 5
#: Type of a word that is no name; log of what is all but impossible.
NO_NAME, NEVER = -2, -690.0
_JOIN, _SIGN = frozenset(R.JOIN_WORDS), frozenset(R.SYMBOLS)
_ORDER = {t: k for k, t in enumerate(kinds.TYPES)}


class Phrase:
    """One phrase's words with the model's entries on them.

    `entries` maps a pattern to (n, counts), `kinds_of` to its type; `hits` maps a segment's
    words to the gazette's types; `common` are patterns in the dictionary; `names` says of each word
    whether it can be part of a name.
    """

    def __init__(self, words, entries, kinds_of, hits, common, names, total: float, smooth: float, unseen: float):
        self.words, self.entries, self.kinds_of, self.hits, self.common, self.names = words, entries, kinds_of, hits, common, names
        self.total, self.smooth, self.unseen = total, smooth, unseen

    def patterns(self, lo: int, hi: int) -> list[tuple[str, int]]:
        w, out, seen = self.words[lo:hi], [], set()
        for i, x in enumerate(w):
            if x in _JOIN or x in _SIGN:
                continue
            p = (w[i - 1] + " " if i and w[i - 1] in _SIGN else "") + x + (" " + w[i + 1] if i + 1 < len(w) and w[i + 1] in _JOIN else "")
            if p not in seen:
                seen.add(p)
                out.append((p, i))
        return out

    def share(self, p: str, kind: int) -> float:
        n, counts = self.entries[p]
        return (counts.get(f"T:{kind}", 0.0) + self.smooth) / (n + self.smooth * R.SIZES["T"])

    def candidates(self) -> list[int]:
        """The likeliest types of each word of the phrase."""
        out = set()
        for p, _ in self.patterns(0, len(self.words)):
            if p in self.entries:
                out |= set(sorted(_ORDER, key=lambda t: (-self.share(p, t), _ORDER[t]))[:TOP_TYPES])
        return sorted(out, key=_ORDER.get)

    def score(self, lo: int, hi: int, kind: int) -> float:
        """The likelihood of words lo to hi - 1 as a name of a type."""
        if hi - lo > 1 and kind in self.hits.get(" ".join(self.words[lo:hi]), ()):
            return 1.0
        if self.words[lo] in _JOIN or self.words[hi - 1] in _JOIN:
            return 0.0
        found = self.patterns(lo, hi)
        joint = next((w for w in self.words[lo + 1 : hi] if w in _JOIN), "NULL")
        out = 0.0
        spoken = False
        for p, at in found:
            if p not in self.entries:
                out += self.unseen
                continue
            share = self.share(p, kind)
            if share < R.LEAST_SHARE:
                continue
            spoken = True
            n, counts = self.entries[p]
            left = [self.kinds_of.get(q, R.UNKNOWN) for q, b in found if b < at] or ["NULL"]
            right = [self.kinds_of.get(q, R.UNKNOWN) for q, b in found if b > at] or ["NULL"]
            feats = [("L", k, 1 / len(left)) for k in left] + [("R", k, 1 / len(right)) for k in right]
            feats += [("S", joint, 1.0), ("D", "Y" if any(q in self.common for q, b in found if b != at) else "N", 1.0)]
            log = math.log(n) - math.log(self.total) + math.log(share)
            for dim, value, part in feats:
                log += part * math.log((counts.get(f"{dim}:{value}", 0.0) + self.smooth) / (n + self.smooth * R.SIZES[dim]))
            out += math.exp(log)
        return out if spoken else 0.0

    def best(self, lo: int, hi: int, kinds_: list[int]) -> tuple[float, int]:
        """(log of the score, type) of the best reading of a segment."""
        noun = 0.0 if all(self.names[lo:hi]) else NEVER
        out = (NEVER if noun == 0.0 else 0.0, NO_NAME) if hi - lo == 1 else (-math.inf, NO_NAME)
        for k in kinds_:
            if k == kinds.OTHER and hi - lo > 1:
                continue
            s = self.score(lo, hi, k)
            log = (math.log(s) if s > 0 else -math.inf) + noun
            if log > out[0]:
                out = (log, k)
        return out

    def cut(self) -> list[tuple[int, int, int, float]]:
        """(first, end, type, log of the score) of the best cut's segments."""
        n = len(self.words)
        if not n or n > LONGEST:
            return []
        kinds_ = self.candidates()
        kinds_ += [k for k in sorted({k for ks in self.hits.values() for k in ks}, key=_ORDER.get) if k not in kinds_]
        read = {(i, j): self.best(i, j, kinds_) for i in range(n) for j in range(i + 1, min(n, i + SEGMENT) + 1)}
        # best[j][k]: greatest sum of logs of k segments that end at j, and where the last begins
        best: list[dict[int, tuple[float, int]]] = [{0: (0.0, 0)}, *[{} for _ in range(n)]]
        for j in range(1, n + 1):
            for i in range(j - 1, max(-1, j - SEGMENT - 1), -1):
                for k, (sum_, _) in best[i].items():
                    s = sum_ + read[i, j][0]
                    if k + 1 not in best[j] or s > best[j][k + 1][0]:
                        best[j][k + 1] = (s, i)
        k = max(best[n], key=lambda k: (best[n][k][0] / k, -k))
        out, j = [], n
        while k:
            i = best[j][k][1]
            out.append((i, j, read[i, j][1], read[i, j][0]))
            j, k = i, k - 1
        return out[::-1]


def word_cases(docs: DataFrame, text: str = "text", share: float = 0.25) -> DataFrame:
    """(word, noun) of each word of texts: whether at least a `share` of its places away from a sentence's start has a capital."""
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?<=[\p{L},;] )(\p{L}+)"), 1)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    low = words.groupBy(F.lower("w").alias("word")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("w") != F.lower("w"), F.col("n")).otherwise(0)).alias("up"))
    return low.select("word", (F.col("up") >= share * F.col("n")).alias("noun"))


def segments(phrases: DataFrame, model: R.Model, nouns: DataFrame | None = None) -> DataFrame:
    """(phrase, text, first, end, type, score) of the names in distinct phrases (column phrase).

    `nouns` (word, noun) tells of words whether they can stand in a name; of others it is
    taken from their first letter.
    """
    # with the count in it, the cutting into words stays above the grouping: each phrase is cut once
    asked = phrases.where("phrase is not null").groupBy("phrase").agg(F.count("*").alias("n")).select("phrase", F.when(F.col("n") > 0, R.words_of(F.col("phrase"))).alias("w")).where(F.size("w").between(1, LONGEST))
    join, sign = R._set(R.JOIN_WORDS), R._set(R.SYMBOLS)
    # a word's patterns in any segment: with and without the symbol before and the joining word after it
    variants = f"""array_distinct(flatten(transform(w, (x, i) -> flatten(transform(array('', if(coalesce(array_contains({sign}, get(w, i - 1)), false), concat(get(w, i - 1), ' '), '')),
      a -> transform(array('', if(coalesce(array_contains({join}, get(w, i + 1)), false), concat(' ', get(w, i + 1)), '')), b -> concat(a, x, b)))))))"""
    word = asked.select("phrase", F.explode(F.expr(variants)).alias("word"))
    entry = model.words().join(model.kinds.select("word", "kind"), "word", "left")
    told = word.join(entry, "word", "left").withColumn("common", F.lit(False))
    if model.dictionary is not None:
        told = told.drop("common").join(model.dictionary.select("word").distinct().withColumn("_d", F.lit(True)), "word", "left").withColumn("common", F.coalesce("_d", F.lit(False))).drop("_d")
    if nouns is not None:
        told = told.join(nouns.select("word", "noun"), "word", "left")
    else:
        told = told.withColumn("noun", F.lit(None).cast("boolean"))
    useful = F.col("n").isNotNull() | F.col("common") | F.col("noun").isNotNull()
    facts = told.where(useful).groupBy("phrase").agg(F.collect_list(F.struct("word", "n", "counts", "kind", "common", "noun")).alias("facts"))  # a phrase's own words
    spans = asked.select("phrase", F.explode(F.expr(f"flatten(transform(sequence(1, size(w)), i -> transform(sequence(1, least({SEGMENT}, size(w) - i + 1)), k -> array_join(slice(w, i, k), ' '))))")).alias("name")).where(F.instr("name", " ") > 0)
    hits = spans.distinct().join(model.names.select("name", "type"), "name").groupBy("phrase").agg(F.collect_list(F.struct("name", "type")).alias("hits"))
    rows = asked.join(facts, "phrase", "left").join(hits, "phrase", "left").select("phrase", "w", "facts", "hits")
    total, smooth, unseen = model.total, model.smooth, R.unseen(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for phrase, w, facts_, hits_ in zip(*(b.column(c).to_pylist() for c in ("phrase", "w", "facts", "hits")), strict=True):
                facts_ = facts_ or []
                entries = {f["word"]: (f["n"], dict(f["counts"])) for f in facts_ if f["n"] is not None}
                noun = {f["word"]: f["noun"] for f in facts_ if f["noun"] is not None}
                up = {x for x in (p.strip("\"'()[].,;:!?") for p in phrase.split()) if x[:1] != x[:1].lower()}
                lifted = {x.lower() for x in up}
                found: dict[str, list[int]] = {}
                for h in hits_ or []:
                    found.setdefault(h["name"], []).append(h["type"])
                names = [x in _JOIN or x in _SIGN or noun.get(x, x in lifted or not x[0].isalpha()) for x in w]
                p = Phrase(w, entries, {f["word"]: f["kind"] for f in facts_ if f["kind"] is not None}, found, {f["word"] for f in facts_ if f["common"]}, names, total, smooth, unseen)
                for i, j, kind, log in p.cut():
                    text = " ".join(w[i:j])
                    # a single word must be long enough
                    if kind != NO_NAME and (j - i > 1 or len(text) > 3):
                        out.append((phrase, text, i, j, kind, math.exp(log)))
            types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["phrase", "text", "first", "end", "type", "score"])

    return rows.mapInArrow(run, "phrase string, text string, first int, end int, type int, score double")


def recognised(candidates: DataFrame, model: R.Model, nouns: DataFrame | None = None, floor: float = 0.0) -> DataFrame:
    """Mentions (doc_id, text, start, type, score, ...) of candidates (doc_id, text, start, ...): each distinct phrase is decoded once.

    Candidates are written, as both the phrases and the mentions come from them, and so are
    the phrases' names: where these are few, no candidate is shuffled to meet them.
    """
    candidates = written(candidates, "candidates")
    found = written(segments(candidates.select(F.col("text").alias("phrase")), model, nouns).where(F.col("score") > floor), "segments")
    rest = [c for c in candidates.columns if c not in ("text", "type", "score")]
    return candidates.select(*rest, F.col("text").alias("phrase")).join(found.withColumnRenamed("text", "name"), "phrase").select(*rest, F.col("name").alias("text"), "phrase", "type", "score")
