"""Benchmark decontamination with a distributed positional inverted index.

The index is a written table of postings (term, next term, doc_id, place) of the
terms that the query set asks for, from whole texts.  Each query window is looked up
by its rarest place: of its terms, the one with the fewest postings in the corpus,
intersected at once with its neighbour's list (place + 1 or - 1).  Postings give
alignments (document, item, shift); each is then compared word for word, so what is
returned is exact.  Only built-in expressions are used.

Words are runs of letters A-Z (lower-cased), digits and all characters outside
ASCII.  Null or empty texts have no words: such documents have n_words 0, such items
no window.  An item of fewer words than a window is one window.  Items are told
apart by a 128-bit hash of their words; item_id is only reported.  So items with
equal texts are each reported, texts under one item_id are each searched, and the
passages of an item without item_id are hits that no item is named for.  Rows of one
doc_id, and rows without one, each get their own counts.  A very long text is one row.
Empty tables give counts of 0 or no rows.  Other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postbag.llm import common

BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Rows of the query-side tables up to which they are sent to all executors; beyond, both sides are shuffled.
SEND_ROWS = 500_000


def split_words(text: str = "text") -> Column:
    """Words with their case kept."""
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), BREAK), "")


def lower_az(word: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SEND_ROWS else df


def index_terms(docs: DataFrame) -> DataFrame:
    """(doc_id, place, term, next) of every word of every text."""
    words = docs.select("doc_id", split_words().alias("w"))
    pairs = words.select("doc_id", F.posexplode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))).alias("place", "x"))
    return pairs.select("doc_id", "place", F.col("x.a").alias("a"), F.col("x.b").alias("b"))


def term_counts(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """Postings of each of `terms` in the corpus: counted before the shuffle."""
    words = docs.select(F.explode(split_words()).alias("w"))
    # spellings are counted as they stand and lower-cased after: far fewer rows
    return words.select(lower_az(F.col("w")).alias("term")).join(_sent(terms, n_terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def items_of(benchmark: DataFrame, key: str = "item_id") -> DataFrame:
    """(item, words, names): a row per text with words lower-cased and the ids it stands under; items without words left out."""
    rows = benchmark.select(F.col(key).cast("string").alias("name"), F.transform(split_words(), lower_az).alias("words")).where(F.size("words") > 0)
    keyed = rows.select(F.unhex(F.md5(F.array_join("words", " "))).alias("item"), "words", "name")
    return keyed.groupBy("item").agg(F.first("words").alias("words"), F.collect_set("name").alias("names"))


def anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, at, t1, t2): for each window the rarest term and its neighbour in it.

    t2 is null for one-word windows.  Windows that choose the same place share a row.
    """
    place = items.select("item", F.size("words").alias("m"), F.posexplode("words").alias("at", "term")).join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    starts = F.explode(F.expr(f"sequence(greatest(0, at - {window - 1}), least(at, greatest(0, m - {window})))"))
    chosen = (
        place.select("item", "at", "m", "n", starts.alias("start"))
        .groupBy("item", "start")
        .agg(F.min(F.struct("n", "at")).alias("x"), F.first("m").alias("m"))
        .select("item", F.col("x.at").alias("p"), F.least(F.col("start") + window, F.col("m")).alias("stop"), "start")
        # the pair (p, p + 1), or (p - 1, p) where the window ends at p
        .select("item", F.when((F.col("p") + 1 < F.col("stop")) | (F.col("p") == F.col("start")), F.col("p")).otherwise(F.col("p") - 1).alias("at"))
        .distinct()
    )
    return chosen.join(items, "item").select("item", "at", F.col("words")[F.col("at")].alias("t1"), F.get("words", F.col("at") + 1).alias("t2"))


def postings(docs: DataFrame, pairs: DataFrame, n_pairs: int) -> DataFrame:
    """The index: written postings (t1, doc_id, place) of the wanted neighbours."""
    first = pairs.select("t1", "t2").distinct()
    rows = index_terms(docs).select("doc_id", "place", lower_az(F.col("a")).alias("t1"), "b")
    match = rows.join(_sent(first, n_pairs), "t1").where(F.col("t2").isNull() | (lower_az(F.col("b")) == F.col("t2")))
    return common.written(match.select("t1", "t2", "doc_id", "place"), "postings")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items (sorted as strings), contaminated."""
    # a row without an id goes by a hash of its text; what a shared key finds is compared with each row's own words
    docs = common.doc_ids_and_text(docs).select(F.coalesce("doc_id", F.xxhash64("text")).alias("doc_id"), "text", F.col("doc_id").alias("id"))
    items = common.written(items_of(benchmark), "items")
    terms = items.select(F.explode("words").alias("term")).distinct()
    counts = common.written(term_counts(docs, terms, terms.count()), "terms")
    pairs = common.written(anchors(items, counts, window), "anchors")
    n_pairs = pairs.count()
    index = postings(docs, pairs, n_pairs)

    same = (F.col("i.t1") == F.col("p.t1")) & F.col("i.t2").eqNullSafe(F.col("p.t2"))
    aligned = index.alias("i").join(pairs.alias("p"), same).select("i.doc_id", "p.item", (F.col("i.place") - F.col("p.at")).alias("shift")).distinct()
    listed = aligned.join(items, "item").groupBy("doc_id").agg(F.collect_list(F.struct("names", "shift", "words")).alias("found"))

    # places of an item whose word stands in the document at shift + place; runs of a window's length are hits
    runs = f"""
      transform(found, f -> struct(f.names as names, f.shift as shift, size(f.words) as m,
        filter(transform(f.words, (x, j) -> if(get(w, f.shift + j) <=> x, -1, j)), j -> j >= 0) as misses))"""
    # between two misses (or an end) lies a run; it counts if it is as long as a window or as a shorter item
    spans = f"""
      flatten(transform(r, f -> filter(
        transform(array_append(f.misses, f.m), (x, k) -> struct(f.names as names, f.shift + if(k = 0, 0, f.misses[k - 1] + 1) as lo, f.shift + x as hi, f.m as m)),
        s -> s.hi - s.lo >= least({window}, s.m))))"""
    # rows: a document, its words only once, hits as spans
    joined = docs.join(listed, "doc_id", "left").select(F.col("id").alias("doc_id"), split_words().alias("raw"), "found")
    # through a generator, so that the words are lower-cased once a document and not anew for each item word looked up
    lowered = joined.select("doc_id", F.size("raw").cast("long").alias("n_words"), "found", F.explode(F.array(F.when(F.col("found").isNotNull(), F.transform("raw", lower_az)))).alias("w"))
    spanned = lowered.select("doc_id", "n_words", F.when(F.col("found").isNotNull(), F.expr(f"transform(array({runs}), r -> {spans})[0]")).alias("s"))
    hits = F.when(F.col("s").isNull(), F.lit(0)).otherwise(F.expr("size(array_distinct(flatten(transform(s, x -> sequence(x.lo, x.hi - 1)))))")).cast("long")
    names = F.coalesce(F.expr("array_sort(array_distinct(flatten(transform(s, x -> x.names))))"), F.expr("cast(array() as array<string>)"))
    # through a generator, so that a filter on the result does not repeat the work above it
    counted = spanned.select("doc_id", "n_words", F.inline_outer(F.array(F.struct(hits.alias("n_hit"), names.alias("items")))))
    return counted.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def near(docs: DataFrame, queries: DataFrame, within: int) -> DataFrame:
    """Proximity matches: (query, doc_id, place) where all terms of a query (query, terms)
    stand within `within` words of its rarest term at `place`; each counts once."""
    docs = common.doc_ids_and_text(docs)
    asked = queries.select("query", F.explode(F.array_distinct(F.transform("terms", lower_az))).alias("term"))
    terms = asked.select("term").distinct()
    n = terms.count()
    rows = index_terms(docs).select("doc_id", "place", lower_az(F.col("a")).alias("term")).join(_sent(terms, n), "term")
    index = common.written(rows, "near")
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    ranked = asked.join(counts, "term", "left").withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(F.coalesce("n", F.lit(0)), "term"))).withColumn("wanted", F.count("*").over(Window.partitionBy("query")))
    start = ranked.where("k = 1").join(index, "term").select("query", "wanted", "doc_id", "place")
    other = ranked.where("k > 1").select("query", "term").join(index, "term").select("query", "term", "doc_id", F.col("place").alias("there"))
    cell = lambda c: F.floor(c / within)  # noqa: E731  neighbouring cells hold all places within reach
    spread = start.withColumn("cell", F.explode(F.array(*[cell(F.col("place")) + d for d in (-1, 0, 1)])))
    met = spread.join(other.withColumn("cell", cell(F.col("there"))), ["query", "doc_id", "cell"]).where(F.abs(F.col("there") - F.col("place")) <= within)
    full = met.groupBy("query", "doc_id", "place", "wanted").agg(F.countDistinct("term").alias("got")).where("got = wanted - 1").select("query", "doc_id", "place")
    return full.unionByName(start.where("wanted = 1").select("query", "doc_id", "place"))
