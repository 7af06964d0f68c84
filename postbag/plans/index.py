"""A written index of messages: terms by field with their places, and ranked search over it.

Text is analysed once, when messages are added.  Each field has a profile: `number` (numbers
and dates stay whole, stems), `english` (stems), `standard` (words as they are) or `keyword`
(the whole value).  A text's terms are put together with their places where the text is,
stems of words are kept by each task; stop words leave a gap in the places.

The index is a folder of Parquet tables.  `postings` has a row a (term, field, message) with
the places and the field's length, dealt over partitions by a hash of the term and sorted by
it, so a search reads the few partitions and row groups of its own terms.  `sizes` has each
batch's messages and words by field.  `add` appends a batch; a batch's files are whole or
not there.  A frequent term's postings are spread over several files.

Search compiles a query to one scan of its terms' postings, one grouping by message, a
Boolean column and a score: BM25 with the frequencies of the index.  No text is read.

Null and empty texts have no terms; a message in no field is not in the index.  Messages
that are added twice are there twice: leave out known ones before (see
`operators.messages`).  An index of empty tables has no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag.functions import porter
from postbag.functions import text as T
from postbag.plans import fulltext
from postbag.sinks.shared import written

#: Partitions of the postings by term, and files that a partition's messages are spread over.
BUCKETS, SPREAD = 64, 4
K1, B = 1.2, 0.75
#: Terms that a wildcard may stand for; beyond, the query is refused.
MOST_LIKE = 1024
PROFILES = {"body": "number", "subject": "number", "body_original": "english"}
_SCHEMA = "term string, field string, doc_id long, tf long, places array<int>, length long, bucket int"
_SIZES = "field string, messages long, words long"


def words_of(text: Column, profile: str) -> Column:
    """The words of a field in order, stop words as empty ones (not stemmed)."""
    if profile == "keyword":
        return F.when(text.isNull() | (text == ""), F.expr("cast(array() as array<string>)")).otherwise(F.array(text))
    if profile == "number":
        plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"['’]s\b", "")
        return F.transform(F.filter(T.number_tokens(plain), lambda w: w != ""), lambda w: F.when(w.isin(fulltext.STOP_WORDS), "").otherwise(w))
    return fulltext.tokens(text, stemmed=False)


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


_stem = lru_cache(1 << 18)(porter.stem_word)
_FOUND = "term string, field string, doc_id long, places array<int>, length long"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each term of a text with its places, from rows of whole texts' words."""
    for b in batches:
        for k in range(b.num_rows):  # one text at a time
            doc, name, stems, words, length = (b.column(c)[k].as_py() for c in ("doc_id", "field", "stems", "w", "length"))
            at: dict[str, list[int]] = {}
            for i, w in enumerate(words):
                if w:
                    at.setdefault(_stem(w) if stems else w, []).append(i)
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.string()), pa.repeat(name, n), pa.repeat(pa.scalar(doc, pa.int64()), n), pa.array(at.values(), pa.list_(pa.int32())), pa.repeat(pa.scalar(length, pa.int64()), n)], names=["term", "field", "doc_id", "places", "length"])


@dataclass
class Index:
    """An index in a folder; `fields` are the columns it covers with their profiles."""

    spark: SparkSession
    path: str
    fields: dict[str, str] = field(default_factory=lambda: dict(PROFILES))

    def add(self, messages: DataFrame) -> None:
        """Add messages: doc_id and the fields, those that are columns of it."""
        own = {f: p for f, p in self.fields.items() if f in messages.columns}
        listed = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(p in ("number", "english")).alias("stems"), words_of(F.col(f).cast("string"), p).alias("w")) for f, p in own.items()])
        texts = messages.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(listed).alias("x")).select("doc_id", "x.field", "x.stems", "x.w").withColumn("length", F.size(F.filter("w", lambda w: w != "")).cast("long")).where("length > 0")
        texts = written(texts, "texts")  # texts are cut into words once
        found = texts.mapInArrow(_placed, _FOUND)
        rows = found.select("term", "field", "doc_id", F.size("places").cast("long").alias("tf"), "places", "length", bucket_of(F.col("term")).alias("bucket"))
        dealt = rows.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))).sortWithinPartitions("bucket", "term", "field", "doc_id")
        dealt.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        sizes = texts.groupBy("field").agg(F.count("*").alias("messages"), F.sum("length").alias("words"))
        sizes.write.mode("append").parquet(f"{self.path}/sizes")

    def postings(self) -> DataFrame:
        return self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/postings")

    def sizes(self) -> dict[str, tuple[int, int]]:
        """(messages, words) of each field."""
        rows = self.spark.read.schema(_SIZES).parquet(f"{self.path}/sizes").groupBy("field").agg(F.sum("messages").alias("m"), F.sum("words").alias("w")).collect()  # a row a field
        return {r.field: (r.m, r.w) for r in rows}

    def frequencies(self, terms: list[tuple[str, str]]) -> dict[tuple[str, str], int]:
        """Messages that hold each (field, term)."""
        if not terms:
            return {}
        rows = self._of(terms).groupBy("field", "term").agg(F.count("*").alias("n")).collect()  # a row a term asked for
        return {(r.field, r.term): r.n for r in rows}

    def _of(self, terms: list[tuple[str, str]]) -> DataFrame:
        words = sorted({t for _, t in terms})
        buckets = sorted({r[0] for r in self.spark.createDataFrame([(w,) for w in words], "t string").select(bucket_of(F.col("t"))).collect()})
        return self.postings().where(F.col("bucket").isin(buckets) & F.col("term").isin(words) & F.col("field").isin(sorted({f for f, _ in terms})))

    def analysed(self, text: str, name: str) -> list[str]:
        """A phrase's terms as its field has them; stop words inside leave a gap, at the ends they go."""
        profile = self.fields[name]
        if profile == "keyword":
            return [text]
        bare = re.sub(r"['’]s\b", "", text)
        raw = [w for w in ((T.number_words(bare)) if profile == "number" else re.split(r"[\W_]+", bare.lower())) if w]
        out = ["" if w in fulltext.STOP_WORDS else porter.stem_word(w) if profile != "standard" else w for w in raw]
        while out and not out[0]:
            out.pop(0)
        while out and not out[-1]:
            out.pop()
        return out

    def search(self, query: str, fields: tuple[str, ...] = ("body", "subject"), limit: int | None = None, least: int = 1) -> DataFrame:
        """(doc_id, score) of messages that match, best first where a limit is given.

        `least`: how often the query's terms must stand in the fields together.
        """
        tree = fulltext.parse(query)
        leaves: list[tuple[str, list[str], float]] = []  # (field, terms, boost) of each phrase or term

        def leaf(name: str, terms: list[str], boost: float) -> int:
            if (name, terms, boost) not in leaves:
                leaves.append((name, terms, boost))
            return leaves.index((name, terms, boost))

        def walk(n: fulltext.Node) -> tuple:
            if n.kind in ("and", "or", "not", "must"):
                return n.kind, [walk(p) for p in n.parts]
            names = (n.name,) if n.name in self.fields else fields
            if n.kind == "phrase":
                return "any", [leaf(f, t, n.boost) for f in names if (t := self.analysed(n.text, f))]
            return "any", [leaf(f, [t], n.boost) for f, t in self._like(n, names)]

        shape = walk(tree)

        asked = sorted({(f, t) for f, ts, _ in leaves for t in ts if t})
        if not asked:
            return self.spark.createDataFrame([], "doc_id long, score double")
        at = {x: k for k, x in enumerate(asked)}
        sizes, n = self.sizes(), self.frequencies(asked)
        rows = self._of(asked)
        entry = F.struct("tf", "places", "length")
        per = rows.groupBy("doc_id").agg(*[F.max(F.when((F.col("field") == f) & (F.col("term") == t), entry)).alias(f"_{k}") for (f, t), k in at.items()])

        def hit(k: int) -> Column:
            name, terms, _ = leaves[k]
            cols = [(j, F.col(f"_{at[name, t]}")) for j, t in enumerate(terms) if t]
            out = F.lit(True)
            for _, c in cols:
                out = out & c.isNotNull()
            if len(cols) > 1:
                rest = cols[1:]

                def beside(p: Column) -> Column:
                    got = F.lit(True)
                    for j, c in rest:
                        got = got & F.array_contains(c["places"], p + j)
                    return got

                out = out & F.coalesce(F.exists(cols[0][1]["places"], beside), F.lit(False))
            return out

        def truth(s: tuple) -> Column:
            kind, parts = s
            if kind == "any":
                out = F.lit(False)
                for k in parts:
                    out = out | hit(k)
                return out
            if kind == "not":
                return ~truth(parts[0])
            if kind == "must":
                return truth(parts[0])
            out = F.lit(kind == "and")
            for p in parts:
                out = out & truth(p) if kind == "and" else out | truth(p)
            return out

        def wanted(s: tuple) -> set[int]:
            if s[0] == "not":
                return set()
            return set(s[1]) if s[0] == "any" else set().union(*[wanted(p) for p in s[1]])

        score, total = F.lit(0.0), F.lit(0)
        for k in sorted(wanted(shape)):
            name, terms, boost = leaves[k]
            m, w = sizes.get(name, (0, 0))
            for t in terms:
                if t and (name, t) in n:
                    c = F.col(f"_{at[name, t]}")
                    df = n[name, t]
                    idf = F.log(F.lit(1 + (m - df + 0.5) / (df + 0.5)))
                    part = idf * c["tf"] * (K1 + 1) / (c["tf"] + K1 * (1 - B + B * c["length"] / (w / m)))
                    score = score + F.when(hit(k), boost * part).otherwise(0.0)
                    total = total + F.coalesce(c["tf"], F.lit(0))
        out = per.where(truth(shape) & (total >= least)).select("doc_id", score.alias("score"))
        return out.orderBy(F.desc("score"), "doc_id").limit(limit) if limit else out

    def _like(self, n: fulltext.Node, names: tuple[str, ...]) -> list[tuple[str, str]]:
        """The (field, term)s of the index that a wildcard or fuzzy term meets."""
        if n.kind == "wild":
            pattern = "^" + "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in n.value) + "$"
            test = F.col("term").rlike(pattern)
        else:
            word, far = n.value
            test = F.levenshtein("term", F.lit(porter.stem_word(word))) <= far
        rows = self.postings().where(F.col("field").isin(list(names)) & test).select("field", "term").distinct().limit(MOST_LIKE + 1).collect()
        if len(rows) > MOST_LIKE:
            raise ValueError(f"more than {MOST_LIKE} terms meet {n.value!r}: ask for longer words")
        return sorted((r.field, r.term) for r in rows)
