"""Naive Bayes over the words of typed names: smoothed counts, and a score by joins and sums.

Training is one aggregation of (type, word) counts; a name's score for a type is the log of
the type's share of names and of its words' shares in it.  No step is Python.

Names without a known type and null and empty names are left out of training; a phrase
without words scores by the types' shares alone.  A word never seen counts as one more
word of every type.  Without any names there are no scores.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postbag.functions import types as kinds
from postbag.operators.recogniser import words_of
from postbag.sinks.shared import written


@dataclass
class Bayes:
    """Counts (type, word, c), (names, words) of each type, and the number of distinct words."""

    counts: DataFrame
    types: dict[int, tuple[int, int]]
    vocabulary: int
    smooth: float


def train(gazette: DataFrame, smooth: float = 1.0) -> Bayes:
    """Counts of a gazette (name, type)."""
    rows = gazette.where(F.col("name").isNotNull() & F.col("type").isin(list(kinds.TYPES))).select(F.col("type").cast("int").alias("type"), words_of(F.col("name")).alias("w")).where(F.size("w") > 0)
    counts = written(rows.select("type", F.explode("w").alias("word")).groupBy("type", "word").agg(F.count("*").alias("c")), "bayes")
    per = rows.groupBy("type").agg(F.count("*").alias("names"), F.sum(F.size("w")).alias("words"))
    types = {r.type: (r["names"], r.words) for r in per.collect()}  # a row a type
    return Bayes(counts, types, counts.select("word").distinct().count(), smooth)


def scores(phrases: DataFrame, model: Bayes) -> DataFrame:
    """(phrase, type, score) of distinct phrases (column phrase) for each type, score in logs.

    A word adds log((c + s) / (words + s (V + 1))).  Only (type, word) pairs that were seen are
    joined; what a word adds unseen is the same for all, and goes by their number.
    """
    s, v = model.smooth, model.vocabulary + 1
    every = sum(n for n, _ in model.types.values())
    asked = phrases.select("phrase").where("phrase is not null").distinct().withColumn("w", words_of(F.col("phrase")))
    words = asked.select("phrase", F.explode("w").alias("word")).groupBy("phrase", "word").agg(F.count("*").alias("k"))
    seen = words.join(model.counts, "word").groupBy("phrase", "type").agg(F.sum(F.col("k") * (F.log(F.col("c") + s) - math.log(s))).alias("more"))
    flat = [F.struct(F.lit(t).alias("type"), F.lit(math.log(n / every)).alias("prior"), F.lit(math.log(s / (words_ + s * v))).alias("none")) for t, (n, words_) in sorted(model.types.items())]
    listed = F.array(*flat) if flat else F.expr("cast(array() as array<struct<type:int,prior:double,none:double>>)")
    base = asked.select("phrase", F.size("w").alias("n"), F.explode(listed).alias("t")).select("phrase", F.col("t.type").alias("type"), (F.col("t.prior") + F.col("n") * F.col("t.none")).alias("base"))
    return base.join(seen, ["phrase", "type"], "left").select("phrase", "type", (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("score"))


def classified(phrases: DataFrame, model: Bayes) -> DataFrame:
    """(phrase, type, p): the likeliest type and its share of all types; ties go to the smaller code."""
    per = scores(phrases, model).groupBy("phrase").agg(F.max_by("type", F.struct("score", -F.col("type"))).alias("type"), F.max("score").alias("top"), F.collect_list("score").alias("all"))
    return per.select("phrase", "type", (1.0 / F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))).alias("p"))
