"""Dictionary forms of English words: singulars, simple forms, abbreviations.

The rules are a table of endings, tried from the top; the first that a word ends with
counts.  Words of fewer than four letters stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words with forms of their own that no ending tells of.
IRREGULAR = {"goes": "go", "does": "do", "mice": "mouse", "data": "datum", "feet": "foot"}
# Fixed values: (ending, what takes its place, least length of the word, letters that must not stand before it).
ENDINGS = [
    ("elves", "elf", 4, ""),
    ("indices", "index", 4, ""),
    ("theses", "thesis", 4, ""),
    ("aderies", "aderie", 4, ""),
    ("ies", "y", 4, ""),
    ("hes", "h", 4, ""),
    ("oes", "o", 6, ""),
    ("oes", "oe", 4, ""),
    ("sses", "ss", 4, ""),
    ("igases", "igase", 4, ""),
    ("gases", "gas", 4, ""),
    ("mases", "mas", 4, ""),
    ("vases", "vas", 6, ""),
    ("iases", "ias", 4, ""),
    ("abuses", "abuse", 4, ""),
    ("cuses", "cuse", 4, ""),
    ("fuses", "fuse", 4, ""),
    ("uses", "us", 5, "aeiou"),
    ("xes", "x", 4, ""),
    ("zes", "z", 4, ""),
    ("es", "e", 4, ""),
    ("ras", "ra", 4, ""),
    ("oci", "ocus", 4, ""),
    ("cti", "ctus", 4, ""),
    ("s", "", 4, "aeius"),
]


def singular(word: Column) -> Column:
    """The singular of an English word, lower-cased; null stays null."""
    w = F.lower(word)
    out = F.when(F.length(w) < 4, w)
    for plural, one in IRREGULAR.items():
        out = out.when(w == plural, one)
    for ending, one, least, barred in ENDINGS:
        cut = F.concat(F.substring(w, F.lit(1), F.length(w) - len(ending)), F.lit(one))
        out = out.when(w.rlike(f"^.{{{least - len(ending)},}}(?<![{barred}]){ending}$" if barred else f"^.{{{max(0, least - len(ending))},}}{ending}$"), cut)
    return out.otherwise(w)


def simple_form(word: Column) -> Column:
    """A word, lower-cased, without the ending of a past or a continuous form."""
    w = F.lower(word)
    cut = lambda k: F.substring(w, F.lit(1), F.length(w) - k)
    return F.when(w.endswith("ied"), F.concat(cut(3), F.lit("y"))).when(w.endswith("ed"), cut(2)).when(w.endswith("ing"), cut(3)).otherwise(w)


def expanded_abbreviations(words: DataFrame, table: DataFrame) -> DataFrame:
    """Words (column word, others) with `full`, what a table (short, full) has for them: lower-cased and without a last period; the word itself where it has nothing."""
    key = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\.$", "")
    known = table.where("short is not null and full is not null").groupBy(key(F.col("short")).alias("_k")).agg(F.min("full").alias("full"))
    return words.withColumn("_k", key(F.col("word"))).join(known, "_k", "left").withColumn("full", F.coalesce("full", "word")).drop("_k")
