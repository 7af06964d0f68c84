"""A text query language compiled to columns.

Terms, "phrases", AND / OR / NOT (also + and -), field:term, wildcards (* and ?),
fuzzy terms (word~1), boosts (word^2, for ranked search), and parentheses; the default
operator is OR.  Text is analysed
once into a token array (lower-cased words without possessives, stop words as gaps,
stemmed); a query becomes array predicates on it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from postbag.functions.porter import let, stem, stem_word
from postbag.functions.text import STOP_WORDS

#: Fields that stand behind the names of a query.
FIELD_SETS = {"full": ("body", "subject"), "original": ("body_original", "subject"), "subject": ("subject",), "attachments": ("attachment_text",)}

def tokens(text: Column, stemmed: bool = True, words: list[str] | None = None) -> Column:
    """Analysed tokens in order: lower-cased words without possessives, stemmed; a stop word leaves an empty one.

    With a query's `words`, only tokens that could meet one of them are stemmed: a stem and its
    word differ in the stem's last two letters at most, and no word is shorter than its stem.
    """
    raw = F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"['’]s\b", "")), r"[^\p{L}\p{N}]+")
    kept = F.transform(F.filter(raw, lambda w: w != ""), lambda w: F.when(w.isin(STOP_WORDS), "").otherwise(w))
    if not stemmed or words == []:
        return kept
    if words is None:
        return F.transform(kept, stem)
    begin = sorted({s[: max(1, len(s) - 2)] + f".{{{len(s) - max(1, len(s) - 2)},}}" for s in map(stem_word, words)})

    def short(w: Column) -> Column:
        out = F.when(w == "", w)
        for x in words:
            out = out.when(w == x, stem_word(x))
        return out.when(w.rlike("^(" + "|".join(begin) + ")"), stem(w)).otherwise(w)

    return F.transform(kept, short)


def analyse(text: str) -> list[str]:
    """Analysed terms of a query; stop words inside leave a gap (an empty term), at the ends they go."""
    raw = re.split(r"[\W_]+", re.sub(r"['’]s\b", "", text).lower())
    out = ["" if w in STOP_WORDS else stem_word(w) for w in raw if w]
    while out and not out[0]:
        out.pop(0)
    while out and not out[-1]:
        out.pop()
    return out


def query_words(query: str) -> list[str] | None:
    """A query's words, for `tokens`; None where wildcards or fuzzy terms ask for all tokens."""
    if re.search(r"[*?~]", query):
        return None
    raw = re.split(r"[\W_]+", re.sub(r"['’]s\b", "", query).lower())
    return sorted({w for w in raw if w and w not in STOP_WORDS})


@dataclass
class Node:
    kind: str  # term, phrase, wild, fuzzy, and, or, not
    value: object = None
    name: str | None = None
    parts: list[Node] = field(default_factory=list)
    text: str | None = None
    boost: float = 1.0


_LEX = re.compile(r'\s*(?:(\()|(\))|(AND|&&)(?=\s)|(OR|\|\||\|)(?=\s)|(NOT|!)(?=\s)|([+-])(?=\S)|(?:(\w+):)?"([^"]*)"(?:\^(\d+(?:\.\d+)?))?|(?:(\w+):)?([^\s()"]+))')


def parse(query: str) -> Node:
    """Syntax tree of a query; ValueError where parentheses do not match."""
    items, at = [], 0
    query = query.strip()
    while at < len(query):
        m = _LEX.match(query, at)
        if not m or m.end() == at:
            raise ValueError(f"cannot read query at {query[at:]!r}")
        at = m.end()
        items.append(m.groups())
    pos = 0

    def unit() -> Node:
        nonlocal pos
        g = items[pos]
        pos += 1
        if g[0]:
            inner = either()
            if pos >= len(items) or not items[pos][1]:
                raise ValueError("missing )")
            pos += 1
            return inner
        if g[4]:
            return Node("not", parts=[unit()])
        if g[5]:
            inner = unit()
            return Node("not", parts=[inner]) if g[5] == "-" else Node("must", parts=[inner])
        if g[7] is not None:
            return Node("phrase", analyse(g[7]), g[6], text=g[7], boost=float(g[8] or 1))
        word, name, boost = g[10], g[9], 1.0
        if word is None:
            raise ValueError("operator without operand")
        if m := re.fullmatch(r"(.+)\^(\d+(?:\.\d+)?)", word):
            word, boost = m[1], float(m[2])
        if "*" in word or "?" in word:
            return Node("wild", word.lower(), name, boost=boost)
        if m := re.fullmatch(r"(\w+)~(\d?)", word):
            return Node("fuzzy", (m[1].lower(), int(m[2] or 2)), name, boost=boost)
        return Node("phrase", analyse(word), name, text=word, boost=boost)

    def both() -> list[Node]:
        nonlocal pos
        group = [unit()]
        while pos < len(items) and items[pos][2]:
            pos += 1
            group.append(unit())
        return group

    def either() -> Node:
        nonlocal pos
        out = []
        while pos < len(items) and not items[pos][1]:
            if items[pos][3]:
                pos += 1
                continue
            group = both()
            out.append(group[0] if len(group) == 1 else Node("and", parts=group))
        must = [p for p in out if p.kind in ("must", "not")]
        rest = [p for p in out if p.kind not in ("must", "not")]
        if must:
            # required and forbidden parts decide; optional ones only rank unless nothing is required
            need = [p.parts[0] if p.kind == "must" else p for p in must]
            if rest and all(p.kind == "not" for p in must):
                need.append(Node("or", parts=rest))
            return Node("and", parts=need)
        return out[0] if len(out) == 1 else Node("or", parts=out)

    tree = either()
    if pos != len(items):
        raise ValueError("unexpected )")
    return tree


def _phrase(cols: Column, want: list[str]) -> Column:
    """Whether the terms stand one after the other; an empty term stands for any token."""
    if not want:
        return F.lit(False)
    if len(want) == 1:
        return F.array_contains(cols, want[0])
    at = lambda i: [F.get(cols, i + k) == t for k, t in enumerate(want) if t]

    def met(i: Column) -> Column:
        out = F.lit(True)
        for c in at(i):
            out = out & F.coalesce(c, F.lit(False))
        return out

    return F.array_contains(cols, want[0]) & F.exists(F.sequence(F.lit(0), F.greatest(F.size(cols) - 1, F.lit(0))), met)


def _some(tokens_: Column, test) -> Column:
    return F.exists(tokens_, lambda w: (w != "") & test(w))


def matches(tree: Node, fields: dict[str, Column], default: tuple[str, ...]) -> Column:
    """The tree as one Boolean column over token arrays."""
    if tree.kind == "and":
        out = F.lit(True)
        for p in tree.parts:
            out = out & matches(p, fields, default)
        return out
    if tree.kind == "or":
        out = F.lit(False)
        for p in tree.parts:
            out = out | matches(p, fields, default)
        return out
    if tree.kind == "must":
        return matches(tree.parts[0], fields, default)
    if tree.kind == "not":
        return ~matches(tree.parts[0], fields, default)
    out = F.lit(False)
    for name in (tree.name,) if tree.name in fields else default:
        col = fields[name]
        if tree.kind == "phrase":
            hit = _phrase(col, tree.value)
        elif tree.kind == "wild":
            pattern = "^" + "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in tree.value) + "$"
            hit = _some(col, lambda w: w.rlike(pattern))
        else:
            word, far = tree.value
            hit = _some(col, lambda w: F.levenshtein(w, F.lit(stem_word(word))) <= far)
        out = out | hit
    return out


def compile_query(query: str, fields: dict[str, Column], default: tuple[str, ...]) -> Column:
    """The query as one Boolean column; a field's tokens are made once a row, not at each of their uses."""
    tree, names = parse(query), [n for n in fields if n in default or f"{n}:" in query]

    def bound(k: int, got: dict[str, Column]) -> Column:
        return matches(tree, got, default) if k == len(names) else let(fields[names[k]], lambda c: bound(k + 1, {**got, names[k]: c}))

    return bound(0, dict(fields))


def occurrences(col: Column, term: str) -> Column:
    """How often an analysed term stands in a token array."""
    want = analyse(term)
    return F.size(F.filter(col, lambda w: w == want[0])).cast("long") if want else F.lit(0).cast("long")


def at_least(cols: list[Column], query: str, k: int) -> Column:
    """The terms of a query stand `k` times or more in the fields together."""
    total = F.lit(0)
    for c in cols:
        for term in dict.fromkeys(filter(None, analyse(query))):
            total = total + F.size(F.filter(c, F.lit(term).eqNullSafe))
    return total >= k


def matched_terms(col: Column, terms: list[str]) -> Column:
    """Those of `terms` that stand in a token array, as given."""
    return F.array_compact(F.array(*[F.when(_phrase(col, analyse(t)), F.lit(t)) for t in terms]))


def highlight(text: Column, terms: list[str]) -> Column:
    """Text with whole-word occurrences of the terms in <mark> tags."""
    if not terms:
        return text
    return F.regexp_replace(text, r"(?i)(?<!\p{L})(" + "|".join(re.escape(t) for t in terms) + r")(?!\p{L})", "<mark>$1</mark>")
