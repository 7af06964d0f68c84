"""Entity mentions, the entity book, lexicons, lens scores and search over archives."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postbag.functions import text as T
from postbag.plans import fulltext

# Codes of coarse entity types.
PERSON, PLACE, ORGANISATION, OTHER = 1, 2, 3, 26
_ORG_WORDS = ["inc", "ltd", "corp", "company", "university", "institute", "department", "bank", "group"]
_PLACE_WORDS = ["street", "road", "avenue", "city", "county", "river", "lake", "mountain", "island"]

#: A run of capitalised words, join words allowed between two of them.
NAME_PATTERN = r"\p{Lu}[\p{L}'’-]*(?:[ ]+(?:(?:of|the|and|for|de|van|von)[ ]+)*\p{Lu}[\p{L}'’-]*)*"


def mentions(docs: DataFrame, text: str = "text", weight: int = 1) -> DataFrame:
    """Candidate names of each text: (doc_id, text, start, type, score).

    Sentence starts that are single words are left out, as nothing tells them from
    ordinary words.
    """
    found = docs.select("doc_id", F.explode(F.split(F.col(text), r"(?<=[.!?])\s+|\n+")).alias("sentence")).select("doc_id", "sentence", F.explode(F.regexp_extract_all("sentence", F.lit(f"({NAME_PATTERN})"), 1)).alias("text"))
    start = F.instr("sentence", F.col("text")) - 1
    several = F.instr(F.trim("text"), " ") > 0
    return found.where((F.length("sentence") < 2000) & (several | (start > 0))).select("doc_id", "text", start.alias("start"), entity_type(F.col("text")).alias("type"), F.when(several, 0.9).otherwise(0.5).alias("score"))


def entity_type(c: Column) -> Column:
    w = F.split(F.lower(c), r"\s+")
    has = lambda ws: F.arrays_overlap(w, F.array(*map(F.lit, ws)))
    return F.when(has(_ORG_WORDS), ORGANISATION).when(has(_PLACE_WORDS), PLACE).when(F.size(w).between(2, 3), PERSON).otherwise(OTHER)


def entity_book(found: DataFrame, floor: float = 0.001) -> DataFrame:
    """Entities by type and canonical name: display name (first met), names, score, messages.

    Mentions are summed up by text with plain numbers before texts are put together: the first
    text of an entity in a message counts that message, and only texts' sums are collected.
    """
    m = found.where(F.col("score") >= floor).withColumn("cname", T.entity_key(F.col("text"))).where("cname != ''")
    in_message = Window.partitionBy("doc_id", "type", "cname").orderBy("start", "text")  # an entity's mentions in one message
    # a null doc_id is no message: it is none to count, and the first place of all
    told = m.select("type", "cname", "text", "doc_id", "start", "score").withColumn("first", F.row_number().over(in_message) == 1)
    counted = (F.col("first") & F.col("doc_id").isNotNull()).cast("long")
    texts = told.groupBy("type", "cname", "text").agg(F.max("score").alias("score"), F.sum(counted).alias("n"), F.min(F.when(F.col("first"), F.col("doc_id"))).alias("doc"), F.max((F.col("first") & F.col("doc_id").isNull()).cast("int")).alias("none"))
    place = F.when((F.col("none") == 1) | F.col("doc").isNotNull(), F.struct(-F.col("none"), "doc"))
    return texts.groupBy("type", "cname").agg(F.min_by("text", place).alias("display"), F.array_sort(F.collect_set("text")).alias("names"), F.max("score").alias("score"), F.sum("n").alias("messages"))


def entity_dates(found: DataFrame, messages: DataFrame) -> DataFrame:
    m = found.withColumn("cname", T.entity_key(F.col("text"))).select("type", "cname", "doc_id").distinct().join(messages.select("doc_id", "date"), "doc_id")
    return m.groupBy("type", "cname").agg(F.count("*").alias("messages"), F.min("date").alias("first"), F.max("date").alias("last"))


def types_above(book: DataFrame, theta: float) -> DataFrame:
    return book.where(F.col("score") > theta).groupBy("type").agg(F.count("*").alias("n"))


def top_entities(book: DataFrame, per_type: int, total: int) -> DataFrame:
    w = Window.partitionBy("type").orderBy(F.desc("score"), F.desc("messages"), "cname")
    return book.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_type).orderBy(F.desc("messages"), "cname").limit(total)


def co_occurring(found: DataFrame, name: str) -> DataFrame:
    """Names that stand in a message with the given one, by number of messages."""
    key = " ".join(sorted(w for w in re.split(r"[\s\".;,\-#@&()]+", name.lower()) if w))
    m = found.withColumn("cname", T.entity_key(F.col("text"))).select("doc_id", "cname").distinct()
    return m.join(m.where(F.col("cname") == key).select("doc_id"), "doc_id", "left_semi").where(F.col("cname") != key).groupBy("cname").agg(F.count("*").alias("n"))


def expansions(found: DataFrame, docs: DataFrame, name: str, top: int | None = 10) -> DataFrame:
    """Fuller forms of a name, from nearer sources first: the same message 1.0, its thread
    0.9, anywhere 0.7.  `docs` has doc_id, thread_id and whether it `asks`."""
    wanted = name.lower()
    hit = found.where((F.instr(F.lower("text"), wanted) > 0) & (F.lower("text") != wanted)).select("doc_id", "text")
    j = hit.join(docs.select("doc_id", "thread_id", "asks"), "doc_id")
    near = docs.where("asks").select(F.col("thread_id").alias("t")).distinct()
    scored = j.join(near, j.thread_id == near.t, "left").select("text", F.when(F.col("asks"), 1.0).when(F.col("t").isNotNull(), 0.9).otherwise(0.7).alias("score"))
    out = scored.groupBy("text").agg(F.max("score").alias("score"), F.count("*").alias("n"))
    return out.orderBy(F.desc("score"), F.desc("n"), "text").limit(top) if top else out


def expand_lexicon(entries: dict[str, str]) -> dict[str, str]:
    """Queries with `{caption}` references replaced, in order of dependence; a cycle
    leaves its references as they are."""
    out: dict[str, str] = {}

    def full(caption: str, above: tuple[str, ...]) -> str:
        if caption not in out:
            out[caption] = re.sub(r"\{([^}]+)\}", lambda m: full(m[1], (*above, caption)) if m[1] in entries and m[1] not in (*above, caption) else m[0], entries[caption])
        return out[caption]

    for c in entries:
        full(c, ())
    return out


def lexicon_hits(docs: DataFrame, entries: dict[str, str], text: str = "text") -> DataFrame:
    """(doc_id, caption) of each category that a text matches, `None` where no one does."""
    full = expand_lexicon(entries)
    toks = docs.select("doc_id", fulltext.tokens(F.col(text), words=fulltext.query_words(" ".join(full.values()))).alias("t"))
    flags = [F.when(fulltext.compile_query(q.replace("|", " OR "), {"t": F.col("t")}, ("t",)), c) for c, q in full.items()]
    got = toks.select("doc_id", F.array_compact(F.array(*flags)).alias("c"))
    return got.select("doc_id", F.explode(F.when(F.size("c") > 0, F.col("c")).otherwise(F.array(F.lit("None")))).alias("caption"))


def lens(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """Scores of page terms: page score x messages with the phrase x boost, best first.

    `terms` has term, page_score, boost; short terms and punctuation are dropped.  A term
    of several words is met by its longest word, then looked for as a phrase.
    """
    t = terms.select(F.trim(F.regexp_replace(F.regexp_replace(F.lower("term"), r"[^\p{L}\p{N} ]", ""), r" +", " ")).alias("term"), "page_score", "boost").where(F.length("term") > 2)
    key = F.array_max(F.transform(F.split("term", " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = t.select("term", key.alias("w")).distinct()
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))).alias("w"))
    met = words.join(keyed, "w").select("doc_id", "term")
    several = F.instr("term", " ") > 0
    plain = docs.select("doc_id", F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" ")).alias("_t"))
    phrases = met.where(several).join(plain, "doc_id").where(F.contains("_t", F.concat(F.lit(" "), F.col("term"), F.lit(" ")))).select("doc_id", "term")
    hits = met.where(~several).unionByName(phrases).groupBy("term").agg(F.countDistinct("doc_id").alias("index_score"))
    return t.join(hits, "term", "left").select("term", F.coalesce("index_score", F.lit(0)).alias("index_score"), (F.col("page_score") * F.coalesce("index_score", F.lit(0)) * F.col("boost")).alias("score")).orderBy(F.desc("score"), "term")


def leads(docs: DataFrame, asked: DataFrame, by_line: bool = False, text: str = "text") -> DataFrame:
    """Names (or lines) of a free text (doc_id, text) by how many messages hold them: a
    name's page score is how often the text has it."""
    if by_line:
        rows = asked.select(F.explode(F.split("text", r"\r?\n")).alias("text"))
    else:
        rows = mentions(asked).select("text")
    terms = rows.select(F.lower(F.trim("text")).alias("term")).where("term != ''").groupBy("term").agg(F.count("*").cast("double").alias("page_score")).withColumn("boost", F.lit(1.0))
    return lens(docs, terms, text).where("index_score > 0")


def across_archives(entities: DataFrame, query: str, parts: bool = False) -> DataFrame:
    """Entities of many archives (archive_id, display, ...) that hold the query: one of its
    words, then the phrase; with `parts` the phrase alone, which may begin and end inside words."""
    holds = F.instr(F.lower("display"), query.lower()) > 0
    if not parts:
        wanted = [w for w in re.split(r"\W+", query.lower()) if w]
        holds = holds & F.arrays_overlap(F.split(F.lower("display"), r"[^\p{L}\p{N}]+"), F.array(*map(F.lit, wanted)))
    return entities.where(holds).dropDuplicates(["archive_id", "display"])


def type_tree(types: DataFrame) -> DataFrame:
    """Counts of a `a/b/c` type path at each of its levels."""
    parts = F.split("path", "/")
    return types.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("level"), "n").groupBy("level").agg(F.sum("n").alias("n"))


def with_captions(hits: DataFrame, captions: list[str]) -> DataFrame:
    """Texts that hold all of the captions (`None`: those without any)."""
    return hits.where(F.col("caption").isin(captions)).groupBy("doc_id").agg(F.countDistinct("caption").alias("n")).where(F.col("n") == len(set(captions))).select("doc_id")


def without_kill_phrases(found: DataFrame, phrases: DataFrame) -> DataFrame:
    """Mentions that are not on a list of phrases (column phrase), whatever case and spaces."""
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    bad = phrases.select(key(F.col("phrase")).alias("_k")).distinct()
    return found.where("text is not null").withColumn("_k", key(F.col("text"))).join(bad, "_k", "left_anti").drop("_k")


def name_table(found: DataFrame, hits: DataFrame, people: DataFrame) -> DataFrame:
    """Per name: mentions, messages, messages by caption (as a map), and people met in them."""
    named = found.withColumn("cname", T.entity_key(F.col("text")))
    base = named.groupBy("cname").agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("messages"))
    docs = named.select("cname", "doc_id").distinct()
    tone = docs.join(hits, "doc_id").groupBy("cname", "caption").agg(F.countDistinct("doc_id").alias("n")).groupBy("cname").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("caption", "n")))).alias("captions"))
    met = docs.join(people, "doc_id").groupBy("cname").agg(F.countDistinct("contact_id").alias("people"))
    return base.join(tone, "cname", "left").join(met, "cname", "left").select("cname", "mentions", "messages", F.coalesce("captions", F.expr("cast(map() as map<string,bigint>)")).alias("captions"), F.coalesce("people", F.lit(0)).alias("people"))


def closest(features: DataFrame, target: str, top: int | None = None) -> DataFrame:
    """Entities most like the target by cosine of their features (entity, feature, weight):
    addresses and names that stand with them.  Only features of the target are joined."""
    norm = features.groupBy("entity").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    mine = features.where(F.col("entity") == target).select("feature", F.col("weight").alias("w"))
    dot = features.where(F.col("entity") != target).join(mine, "feature").groupBy("entity").agg(F.sum(F.col("weight") * F.col("w")).alias("dot"))
    own = mine.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("own"))
    scored = dot.join(norm, "entity").join(F.broadcast(own), how="cross")  # one row on the right
    out = scored.select("entity", (F.col("dot") / (F.col("norm") * F.col("own"))).alias("score"))
    return out.orderBy(F.desc("score"), "entity").limit(top) if top else out
