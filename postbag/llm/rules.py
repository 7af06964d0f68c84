"""Quality rules as a short-circuit cascade, in built-in expressions only.

A rule is a name and a Boolean column that is true for documents it rejects.  Each
rule is run alone over a bounded sample, every row several times; its cost is the
time taken beyond that of a rule that is always false, its selectivity the share
rejected.  Rules are then ordered by rejection per cost and put into one
CASE expression, which evaluates a rule only for documents that all earlier rules
let pass.  The order changes the work, never the verdict.

Counts are made once a row: they pass through a generator, which filters on the
result are not pushed under, so that a filter does not repeat the splitting.

Null and empty texts have no words: all counts are 0, the base check fails.  White
space is tab to carriage return and space; letters outside ASCII are ordinary word
characters.  Repeated rows are judged each for itself.  Columns of the input other
than doc_id and text are left alone.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postbag.llm import common

SPACE = r"[\x20\x09-\x0D]+"
#: Rows that cost and selectivity are estimated on, at most, and how often each is run.
SAMPLE_ROWS, REPEATS = 1_000, 3
WINDOW = 5


def words_of(text: str = "text") -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), "")


def repeated_words(words: str = "_w", grams: str = "_g") -> Column:
    """Words inside windows of five that are found twice or more, all places counted.

    Most texts have no such window, which one distinct count shows.  Else windows
    are sorted by their hash so that equal ones are neighbours, and the lengths of
    the places they cover are added up: n log n, whatever the text.
    """
    pairs = f"array_sort(transform({grams}, (g, i) -> struct(g, i)))"
    places = f"array_sort(filter(transform(_p, (p, k) -> if((k > 0 and _p[k - 1].g = p.g) or (k < size(_p) - 1 and _p[k + 1].g = p.g), p.i, null)), x -> x is not null))"
    total = f"aggregate(transform(_q, (x, k) -> if(k < size(_q) - 1, least({WINDOW}, _q[k + 1] - x), {WINDOW})), 0, (a, x) -> a + x)"
    # let-bindings: a one-element array and transform name an intermediate result
    bound = f"transform(array({pairs}), _p -> transform(array({places}), _q -> {total})[0])[0]"
    return F.expr(f"cast(if(size({grams}) = size(array_distinct({grams})), 0, {bound}) as bigint)")


def measured(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, columns to `carry`, and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = ", ".join(f"_w[i{'' if k == 0 else f' + {k}'}]" for k in range(WINDOW))
    lined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry).withColumn("_w", words_of()).withColumn("_l", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    gram = lined.withColumn("_g", F.expr(f"if(size(_w) < {WINDOW}, cast(array() as array<bigint>), transform(sequence(0, size(_w) - {WINDOW}), i -> xxhash64({words})))"))
    counts = F.struct(
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated_words().alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
    )
    return gram.select("doc_id", "text", *carry, F.inline_outer(F.array(counts)))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def default_rules() -> dict[str, Column]:
    """Rules over the columns of `measured`; each is true for a document to reject."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    text = F.coalesce(F.col("text"), F.lit(""))
    letters = F.length(F.regexp_replace(text, r"[^A-Za-z]+", ""))
    capitals = F.length(F.regexp_replace(text, r"[^A-Z]+", ""))
    return {
        "symbols": F.col("n_symbols") > 0.4 * n,
        "repeated_lines": (F.col("n_dup_lines") >= 4) & (2 * F.col("n_dup_lines") > F.col("n_lines")),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 25 * n),
        # over 50 follows from the other two and is the cheaper look, so it comes first
        "capitals": (capitals > 50) & (letters >= 100) & (2 * capitals > letters),
        # no run of 1,001 in a text of fewer characters
        "unbroken_run": (F.length(text) > 1000) & text.rlike(r"[^\x20\x09-\x0D]{1001}"),
    }


def plan_cascade(docs: DataFrame, rules: dict[str, Column] | None = None, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, Column, float, float]]:
    """(name, rule, share rejected, seconds) in the order of rejection per cost."""
    rules = rules or default_rules()
    total = docs.count()
    part = docs.select("doc_id", "text").sample(min(1.0, 1.2 * sample_rows / max(1, total)), 7).limit(sample_rows)
    sample = common.written(measured(part), "rules-sample").withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def run(rule: Column) -> tuple[float, float]:
        best = None
        for _ in range(2):  # the first run compiles the expression
            began = time.perf_counter()
            share = sample.agg(F.avg(F.coalesce(rule, F.lit(False)).cast("double")).alias("x")).first().x or 0.0
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        return share, best

    idle = run(F.col("n_words") < 0)[1]
    found = []
    for name, rule in rules.items():
        share, took = run(rule)
        found.append((name, rule, share, max(took - idle, 1e-4)))
    return sorted(found, key=lambda x: (-(x[2] + 1e-6) / x[3], x[0]))


def cascade(plan: list[tuple[str, Column, float, float]]) -> Column:
    """The name of the first rule that rejects, or null: later rules are not evaluated."""
    out = None
    for name, rule, _, _ in plan:
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return out if out is not None else F.lit(None).cast("string")


def judge(docs: DataFrame, rules: dict[str, Column] | None = None, sample_rows: int = SAMPLE_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts, base_failed and kept (false if the base check or any rule rejects) of every document, after columns to `carry`."""
    plan = plan_cascade(docs, rules, sample_rows)
    got = measured(docs, carry).withColumn("base_failed", base_failed())
    verdict = F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(plan))
    return got.select("doc_id", *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", verdict.isNull().alias("kept"))
