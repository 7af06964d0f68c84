"""Line deduplication over levelled sorted runs of line hashes, in built-in expressions only.

A line's key is the line without white space at both ends, A-Z lower-cased.  Keys of
`min_chars` code points or more that stand in `min_docs` documents or more lose all
their lines except those of the largest doc_id that holds the key.

Each text is split and hashed once: the written line table holds a row for each long
line (doc_id, row, key hash, place).  A key's documents are counted with a partial sum
before the shuffle, so a line in a third of all documents is one row a task.  Lines of
frequent keys go, from the largest doc_ids to the smallest, batch after batch against
`Runs`: written runs of key hashes, bucketed and sorted, so that the merge anti-join of
a batch reads them without a shuffle.  Keys that no run has are new: their keeper is the
batch's largest doc_id, and they are added as a run of their own.  `fan` runs of a level
are compacted to one of the next.  Runs never share a key, so a key has one keeper.

Keys are compared by 128-bit hashes.  Null and empty texts are one empty line.  Each row
is a document, so rows of one doc_id each count; those of the largest doc_id all keep
the line.  A row without doc_id counts, but keeps a frequent line only if no document
with an id has it.  Texts of any length are one row; their lines are taken out by place
in one pass.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag.llm import common

MIN_CHARS, MIN_DOCS = 40, 5
#: Batches that a whole table is cut into by doc_id, and runs of a level that are compacted to one.
BATCHES, FAN = 6, 3
#: White space that does not count at a line's ends; \n cannot stand inside a line.
_SPACE = r"concat(' ', char(9), char(11), char(12), char(13))"


class Runs:
    """Levelled sorted runs of key hashes (h1, h2, top), no key in two of them.

    Runs are tables in the session's catalog with files in the shared folder, bucketed
    by key; `drop` removes both.
    """

    def __init__(self, spark: SparkSession, fan: int = FAN):
        self.spark, self.fan = spark, fan
        self.levels: list[list[str]] = [[]]
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def add(self, keys: DataFrame) -> DataFrame:
        """Add a batch of distinct keys (h1, h2, top); returns those that were new.

        Full levels are compacted first, so what is returned can be read until the next call.
        """
        at = 0
        while at < len(self.levels) and len(self.levels[at]) >= self.fan:
            self._compact(at)
            at += 1
        fresh = keys.select("h1", "h2", "top")
        for name in self.names():
            fresh = fresh.join(self.spark.table(name).select("h1", "h2"), ["h1", "h2"], "left_anti")
        name = self._write(fresh)
        self.levels[0].append(name)
        return self.spark.table(name)

    def merged(self) -> DataFrame:
        """All keys with their keepers."""
        out = None
        for name in self.names():
            part = self.spark.table(name)
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], "h1 long, h2 long, top long")

    def drop(self) -> None:
        for name in self.names():
            self._drop(name)
        self.levels = [[]]

    def _write(self, rows: DataFrame) -> str:
        name = f"postbag_run_{uuid.uuid4().hex}"
        path = f"{common.scratch_dir(self.spark)}/{name}"
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        return name

    def _compact(self, level: int) -> None:
        old = self.levels[level]
        merged = self.spark.table(old[0])
        for name in old[1:]:
            merged = merged.unionByName(self.spark.table(name))
        new = self._write(merged.repartition(self.buckets, "h1", "h2"))
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(new)
        self.levels[level] = []
        for name in old:
            self._drop(name)

    def _drop(self, name: str) -> None:
        path = f"{common.scratch_dir(self.spark)}/{name}"
        self.spark.sql(f"drop table if exists {name}")
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row, h1, h2, place, first) of every line whose key is long enough.

    `row` tells rows of one doc_id with different texts apart; `first` marks a key's
    first line in its row.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_t"))
    keyed = base.select("doc_id", F.xxhash64("doc_id", "_t").alias("row"), F.split("_t", "\n").alias("_l"))
    # a line shorter than a key need not be stripped
    cut = f"filter(transform(_l, (x, i) -> struct(i as place, if(length(x) < {min_chars}, null, btrim(x, {_SPACE})) as k)), s -> length(s.k) >= {min_chars})"
    low = f"if(octet_length(s.k) = length(s.k), lower(s.k), translate(s.k, '{string.ascii_uppercase}', '{string.ascii_lowercase}'))"
    hashed = f"array_sort(transform(transform({cut}, s -> struct(s.place as place, {low} as k)), s -> struct(xxhash64(s.k) as h1, xxhash64(1L, s.k) as h2, s.place as place)))"
    # let-binding: equal keys are neighbours in the sorted array
    told = f"transform(array({hashed}), _p -> transform(_p, (s, i) -> struct(s.h1 as h1, s.h2 as h2, s.place as place, not (get(_p, i - 1).h1 <=> s.h1 and get(_p, i - 1).h2 <=> s.h2) as first)))[0]"
    return keyed.select("doc_id", "row", F.expr(f"inline({told})"))


def frequent(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2) of keys that stand in enough documents."""
    return rows.where("first").groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("h1", "h2")


def _batches(docs: DataFrame, n: int) -> list[int]:
    """Ids at which a table is cut into `n` batches of about equal size."""
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [k / n for k in range(1, n)], 1000).alias("x")).first().x
    return sorted(set(cuts or []))


def drops(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """(doc_id, row, places): the places, in order, of the lines that each row loses."""
    spark = docs.sparkSession
    found = common.written(lines(docs, min_chars), "lines")
    cuts = _batches(docs, batches)
    # batch 0 holds the largest ids; rows without an id come last
    batch = F.coalesce(sum((F.col("doc_id") < c).cast("int") for c in cuts), F.lit(len(cuts))) if cuts else F.lit(0)
    # written, so that the join's sides are plain shuffles, whose hot keys Spark splits
    keys = common.written(frequent(found, min_docs), "keys")
    often = found.join(keys, ["h1", "h2"], "left_semi").select("doc_id", "row", "h1", "h2", "place", batch.alias("batch"))
    often = common.written(often, "frequent")
    runs = Runs(spark, fan)
    for k in range(len(cuts) + 1):
        own = often.where(F.col("batch") == k).groupBy("h1", "h2").agg(F.max("doc_id").alias("top"))
        runs.add(own)
    keepers = common.written(runs.merged(), "keepers")
    lost = often.join(keepers, ["h1", "h2"]).where("top is not null and (doc_id is null or doc_id < top)")
    runs.drop()
    return common.written(lost.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("place")).alias("places")), "drops")


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """Per row: doc_id, kept (the text without the lines lost), n_lines (before), n_dropped."""
    lost = drops(docs, min_chars, min_docs, batches, fan).select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), "places")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_t"))
    joined = base.join(lost, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("doc_id", "_t") == F.col("_r")), "left")
    begin = "if(k = 0, 0, places[k - 1] + 1)"
    rest = f"array_join(flatten(transform(sequence(0, size(places)), k -> slice(_l, {begin} + 1, if(k = size(places), size(_l), places[k]) - {begin}))), '\n')"
    kept = f"if(places is null, _t, transform(array(split(_t, '\n')), _l -> {rest})[0])"
    return joined.select("doc_id", F.expr(kept).alias("kept"), (F.length("_t") - F.length(F.replace("_t", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_dropped"))
