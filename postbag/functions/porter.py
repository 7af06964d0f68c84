"""Porter's stemmer, as a column and for single words.

The rules are tables of endings; both forms read the same tables.  A word's form marks
vowels 0 and consonants 1 (y after a consonant is a vowel), its measure is the number of
vowel-consonant turns before an ending.  Letters beyond a-z and digits are consonants.
Words of one or two letters stay as they are.  `stems` stems distinct words, each once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings and what takes their place, for stems of measure 1 or more.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
# Endings that go where the measure is 2 or more (ion only after s or t).
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _ending(endings) -> str:
    """A pattern of the longest ending: the first place from which one reaches the word's end."""
    return "(" + "|".join("(?<=[st])ion" if e == "ion" else e for e in endings) + ")$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def form(word: Column) -> Column:
    marked = F.regexp_replace(F.translate(word, "aeiou", "00000"), "[^0y]", "1")
    # each y takes its mark from the letter before it, y itself included
    run = F.aggregate(F.filter(F.split(marked, ""), lambda c: c != ""), F.lit(""), lambda a, c: F.concat(a, F.when(c != "y", c).when(a.endswith("1"), "0").otherwise("1")))
    return F.when(F.instr(marked, "y") > 0, run).otherwise(marked)


def _measure(f: Column, n: Column) -> Column:
    return F.regexp_count(F.substring(f, F.lit(1), n), F.lit("0+1+"))


def _cut(w: Column, k: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - k)


def _closed(w: Column, f: Column, n: Column) -> Column:
    """Whether the first n letters end consonant, vowel, consonant, the last not w, x or y."""
    return F.substring(f, F.lit(1), n).endswith("101") & ~F.substring(w, n, F.lit(1)).isin("w", "x", "y")


def _doubled(w: Column, f: Column) -> Column:
    n = F.length(w)
    return (n > 1) & f.endswith("1") & (F.substring(w, n, F.lit(1)) == F.substring(w, n - 1, F.lit(1)))


def _plural(w: Column) -> Column:
    return F.when(w.endswith("sses") | w.endswith("ies"), _cut(w, 2)).when(w.endswith("s") & ~w.endswith("ss"), _cut(w, 1)).otherwise(w)


def _past(w: Column) -> Column:
    def mended(x: Column) -> Column:
        def by(f: Column) -> Column:
            n = F.length(x)
            return (
                F.when(x.endswith("at") | x.endswith("bl") | x.endswith("iz"), F.concat(x, F.lit("e")))
                .when(_doubled(x, f) & ~F.substring(x, n, F.lit(1)).isin("l", "s", "z"), _cut(x, 1))
                .when((_measure(f, n) == 1) & _closed(x, f, n), F.concat(x, F.lit("e")))
                .otherwise(x)
            )

        return let(form(x), by)

    def by(f: Column) -> Column:
        n = F.length(w)
        vowel = lambda k: F.instr(F.substring(f, F.lit(1), n - k), "0") > 0
        return (
            F.when(w.endswith("eed"), F.when(_measure(f, n - 3) > 0, _cut(w, 1)).otherwise(w))
            .when(w.endswith("ed") & vowel(2), let(_cut(w, 2), mended))
            .when(w.endswith("ing") & vowel(3), let(_cut(w, 3), mended))
            .otherwise(w)
        )

    return F.when(w.endswith("ed") | w.endswith("ing"), let(form(w), by)).otherwise(w)


def _final_y(w: Column) -> Column:
    return F.when(w.endswith("y"), F.when(F.instr(F.substring(form(w), F.lit(1), F.length(w) - 1), "0") > 0, F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)).otherwise(w)


def _replaced(endings, least: int, new: Callable[[Column], Column] | None = None) -> Callable[[Column], Column]:
    """The step that puts `new` of its ending (nothing, if left out) at a word's end, where the measure is high enough."""
    pattern = _ending(endings)

    def step(w: Column) -> Column:
        def by(e: Column) -> Column:
            n = F.length(w) - F.length(e)
            cut = F.substring(w, F.lit(1), n)
            return F.when(_measure(form(w), n) >= least, cut if new is None else F.concat(cut, new(e))).otherwise(w)

        return F.when(w.rlike(pattern), let(F.regexp_extract(w, pattern, 1), by)).otherwise(w)

    return step


def _mapped(rules: dict[str, str]) -> Callable[[Column], Column]:
    pairs = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in rules.items()) + ")"
    return _replaced(rules, 1, lambda e: F.expr(pairs)[e])


def _tail(w: Column) -> Column:
    def by(f: Column) -> Column:
        n = F.length(w)
        m = _measure(f, n)
        no_e = F.when(w.endswith("e") & ((m > 1) | ((m == 1) & ~_closed(w, f, n - 1))), _cut(w, 1)).otherwise(w)
        return let(no_e, lambda x: F.when(x.endswith("ll") & (m > 1), _cut(x, 1)).otherwise(x))

    return F.when(w.endswith("e") | w.endswith("ll"), let(form(w), by)).otherwise(w)


def stem(word: Column) -> Column:
    """The stem of a lower-case word."""
    steps = (_plural, _past, _final_y, _mapped(STEP_2), _mapped(STEP_3), _replaced(STEP_4, 2), _tail)

    def run(w: Column, k: int) -> Column:
        return w if k == len(steps) else let(steps[k](w), lambda x: run(x, k + 1))

    return F.when(F.length(word) > 2, run(word, 0)).otherwise(word)


def stems(words: DataFrame) -> DataFrame:
    """(word, stem) of distinct words (column word)."""
    return words.select("word").where("word is not null").distinct().select("word", stem(F.col("word")).alias("stem"))


def _form_of(w: str) -> str:
    f = ""
    for c in w:
        f += "0" if c in "aeiou" or (c == "y" and f.endswith("1")) else "1"
    return f


def _m(w: str) -> int:
    return len(re.findall("0+1+", _form_of(w)))


def _ends_closed(w: str) -> bool:
    return _form_of(w).endswith("101") and w[-1] not in "wxy"


def _by_table(w: str, endings, least: int) -> str:
    found = re.search(_ending(endings), w)
    if not found or _m(w[: found.start()]) < least:
        return w
    return w[: found.start()] + (endings[found[0]] if isinstance(endings, dict) else "")


def stem_word(w: str) -> str:
    """The stem of one lower-case word, as `stem` gives it."""
    if len(w) <= 2:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _m(w[:-3]) else w
    else:
        for e in ("ed", "ing"):
            if w.endswith(e) and "0" in _form_of(w[: -len(e)]):
                w = w[: -len(e)]
                if w.endswith(("at", "bl", "iz")) or (_m(w) == 1 and _ends_closed(w) and not (w[-1:] == w[-2:-1])):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _form_of(w)[-1] == "1" and w[-1] not in "lsz":
                    w = w[:-1]
                break
    if w.endswith("y") and "0" in _form_of(w[:-1]):
        w = w[:-1] + "i"
    w = _by_table(_by_table(w, STEP_2, 1), STEP_3, 1)
    w = _by_table(w, STEP_4, 2)
    m = _m(w)
    if w.endswith("e") and (m > 1 or (m == 1 and not _ends_closed(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and m > 1 else w
