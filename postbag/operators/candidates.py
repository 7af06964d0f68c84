"""Candidate names in texts: runs of capitalised words, with their places in the text.

A text is cut into sentences: at `.`, `!` or `?` before a space and a capital, digit or
quotation mark (not after an initial or a title such as `Mr.`), and at the end of lines of
fewer than 40 characters, as in lists and signatures.  Sentences of 2,000 characters or
more are left out.  In a sentence a small machine goes from word to word: a capitalised word
opens or lengthens a run, joining words wait for one, and what stands between two words must
be white space, `&` or `'`, three characters at most.  A run is cut at two joining words one
after the other, at `'s`, at doubled `-`, `.` or `'`, and at words that are never part of a
name; greetings and other common first and last words are trimmed, and what is a dictionary
word, a taboo name (days, months) or a part of a mail header goes.

Places are characters of the text as given.  A candidate is `original` unless its line is
quoted with `>` or stands below a reply's or forward's heading.  Null and empty texts have
none.  The word lists are parameters: a language's dictionary at most, as they go to every
task (`MOST_WORDS`).

What a sentence has depends on its own characters alone, so a task keeps the names of the
last `KEPT` sentences it met: greetings, signatures and quoted lines come again and again.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that join two capitalised words of a name.
JOINS = ["and", "for", "a", "the", "at", "in", "of", "de", "van", "von", "da", "ibn", "mac", "bin", "del", "dos", "di", "la", "du", "ben", "no", "ap", "le", "bint", "do", "den"]
# Words cut off at a run's start and end, whatever their case.
FIRST_WORDS = ["hey", "the", "a", "an", "hello", "dear", "hi", "met", "from", "quote", "from:", "and", "my", "our", "regarding", "quoting", "on behalf of", "behalf of", "sorry", "but", "for", "to", "at", "in", "of", "on", "with", "ok", "your", "i", "to:", "thanks", "let", "does", "sure", "thank", "you", "about", "&", "yes", "if", "by", "why", "said", "even", "am", "respected", "although", "as"]
LAST_WORDS = ["i", "and", "for", "a", "the", "to", "at", "in", "of"]
# Words that no candidate may have.
BAD_WORDS = ["not", "i'm", "i'll", "i am", "n't", "i've", "have", "i'd", "you've", "we've", "they've", "email", "to", "from", "date", "subject", "begin pgp"]
# Days, months and the like that are no names by themselves.
TABOO = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec", "mon", "tue", "tues", "wed", "thu", "thurs", "fri", "sat", "sun", "january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "ok", "am", "pm", "folks"]
# Titles and short forms whose period ends no sentence.
SHORT_FORMS = ["mr", "mrs", "ms", "dr", "prof", "st", "mt", "jr", "sr", "inc", "ltd", "co", "corp", "vs", "aka", "etc", "no"]
#: Shorter lines end a sentence, longer sentences are junk.
SHORT_LINE, LONGEST_SENTENCE = 40, 2000
MOST_WORDS = 1_000_000
#: Sentences whose names a task keeps.
KEPT = 4096

_WORD = re.compile(r"[^\W_][\w'’.\-]*")
_STOP = re.compile(r"""[.!?]+["')\]]*(?=\s+["'(\[]*[^\Wa-z_])""")
_BETWEEN = re.compile(r"[\s&']{1,3}\Z")
_HEADING = re.compile(r"^\s*(?:On\b.*\bwrote:|-{3,} ?(?:Original|Forwarded) [Mm]essage.*|_{8,})\s*$", re.M)
_CUT = re.compile(r"(?:(?<=\s)|^)(?:(?:" + "|".join(JOINS) + r")[\s&']{1,3}){2,}|['\-.]{2,}|['’]s(?=\s|$)")
_EDGE = re.compile(r"^\W+|\W+$")
_TOKEN = re.compile(r"\S+")
_FIRST, _LAST = tuple(w + " " for w in FIRST_WORDS), tuple(" " + w for w in LAST_WORDS)
_BAD, _BAD_FIRST, _BAD_LAST, _BAD_INSIDE = frozenset(BAD_WORDS + FIRST_WORDS), tuple(w + " " for w in BAD_WORDS), tuple(" " + w for w in BAD_WORDS), tuple(f" {w} " for w in BAD_WORDS)


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """(first, end) of each sentence."""
    begin = 0
    at = 0
    for line in text.split("\n"):
        end = at + len(line)
        for m in _STOP.finditer(text, max(begin, at), end):
            before = text[max(begin, m.start() - 12) : m.start()]
            last = re.split(r"[^\w]", before)[-1].lower()
            if text[m.start()] == "." and (last in SHORT_FORMS or len(last) == 1):
                continue
            yield begin, m.end()
            begin = m.end()
        if len(line) < SHORT_LINE:
            yield begin, end
            begin = end
        at = end + 1
    if begin < len(text):
        yield begin, len(text)


def runs(text: str, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """(first, end) of each run of capitalised words of a sentence."""
    first = last = None  # the run so far
    behind = begin  # end of the last word looked at
    for m in _WORD.finditer(text, begin, end):
        word = m[0]
        near = first is not None and _BETWEEN.match(text, behind, m.start()) is not None
        if first is not None and not near:
            yield first, last
            first = None
        if word[0].isupper():
            first, last = (m.start() if first is None else first), m.end()
        elif first is not None and word not in JOINS:
            yield first, last
            first = None
        behind = m.end()
    if first is not None:
        yield first, last


def parts(text: str, first: int, end: int, dictionary: frozenset = frozenset(), never: frozenset = frozenset()) -> Iterator[tuple[int, int]]:
    """(first, end) of the names in a run."""
    if end - first < 3:
        if text[first:end].isupper() and end - first > 1 and text[first:end].lower() not in TABOO:
            yield first, end
        return
    cuts, at = [], first
    for m in _CUT.finditer(text[first:end]):
        cuts.append((at, first + m.start()))
        at = first + m.end()
    cuts.append((at, end))
    for lo, hi in cuts:
        lo, hi = _bare(text, lo, hi)
        if lo >= hi or text[lo:hi].lower() in dictionary:
            continue
        lo, hi = _trimmed(text, lo, hi)
        begin = None
        for m in [*_TOKEN.finditer(text[lo:hi]), None]:
            if m is not None and (not never or _EDGE.sub("", m[0]).lower() not in never):
                begin, stop = lo + m.start() if begin is None else begin, lo + m.end()
                continue
            if begin is not None:
                a, b = _bare(text, begin, stop)
                low = " ".join(text[a:b].lower().split())
                if a < b and low not in TABOO and not _bad(low) and (b - a > 2 or text[a:b].isupper()):
                    yield a, b
            begin = None


def _bare(text: str, lo: int, hi: int) -> tuple[int, int]:
    while lo < hi and not text[lo].isalnum():
        lo += 1
    while hi > lo and not text[hi - 1].isalnum():
        hi -= 1
    return lo, hi


def _trimmed(text: str, lo: int, hi: int) -> tuple[int, int]:
    """Without common words at both ends."""
    while (low := text[lo:hi].lower()).startswith(_FIRST):
        lo += len(next(w for w in _FIRST if low.startswith(w)))
        while lo < hi and text[lo].isspace():
            lo += 1
    while (low := text[lo:hi].lower()).endswith(_LAST):
        hi -= len(next(w for w in _LAST if low.endswith(w)))
        while hi > lo and text[hi - 1].isspace():
            hi -= 1
    return lo, hi


def _bad(low: str) -> bool:
    return low in _BAD or low.startswith(_BAD_FIRST) or low.endswith(_BAD_LAST) or any(w in low for w in _BAD_INSIDE)


def names_of(sentence: str, dictionary: frozenset = frozenset(), never: frozenset = frozenset()) -> tuple[tuple[str, int, int], ...]:
    """(name, first, end) of a sentence's names in order, places counted from its start."""
    found = (part for run in runs(sentence, 0, len(sentence)) for part in parts(sentence, *run, dictionary, never))
    return tuple((" ".join(sentence[a:b].split()), a, b) for a, b in found)


def names_in(text: str, dictionary: frozenset = frozenset(), never: frozenset = frozenset(), of=names_of) -> list[tuple[str, int, int]]:
    """(name, first, end) in order; white space in a name is one space.  `of` gives a sentence's names."""
    out = []
    for lo, hi in sentences(text):
        if hi - lo < LONGEST_SENTENCE:
            out += [(name, lo + a, lo + b) for name, a, b in of(text[lo:hi], dictionary, never)]
    return out


def original_end(text: str) -> int:
    """Where a reply's or forward's heading begins, else the text's end."""
    m = _HEADING.search(text)
    return m.start() if m else len(text)


def candidates(docs: DataFrame, text: str = "text", dictionary: Iterable[str] = (), never: Iterable[str] = ()) -> DataFrame:
    """(doc_id, text, start, stop, original) of every candidate; other columns of `docs` are not carried."""
    words, split = frozenset(w.lower() for w in dictionary), frozenset(w.lower() for w in never)
    if len(words) + len(split) > MOST_WORDS:
        raise ValueError("word lists go to every task and must be a language's dictionary at most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lru_cache(KEPT)(lambda sentence, *lists: names_of(sentence, words, split))
        for b in batches:
            rows = []
            for doc, body in zip(*(b.column(c).to_pylist() for c in ("doc_id", "body")), strict=True):
                whole = original_end(body or "")
                for name, a, z in names_in(body or "", of=of):
                    line = body.rfind("\n", 0, a) + 1
                    rows.append((doc, name, a, z, z <= whole and not body.startswith(">", line)))
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["doc_id", "text", "start", "stop", "original"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("body")).mapInArrow(run, "doc_id long, text string, start int, stop int, original boolean")
