"""Near-duplicate documents by min-max hashing.

A document's set is that of its word shingles.  Under each of `rows * bands / 2` hash
functions both the smallest and the largest value are kept: two signature values
for one evaluation.  Values are cut into bands; documents that share a band are
candidates, and links are confirmed on full sets.

A large group of copies is never expanded into its pairs, and no link between
components is passed over.  Documents with equal sets are one class.  In each band
bucket classes are first compared with one representative only; confirmed links are
merged to components, and only classes of different components that still share a
bucket are compared further: with a second representative, then those outside the
bucket's largest component with all others.  This last step joins on a bound that
every link meets: each set has a parity bitmap of about three bits a shingle, and two
sets differ in at least as many shingles as their bitmaps differ in bits.  So of the
pairs just under the wanted similarity few are made, and none that is linked is lost.

Null and empty texts have the empty set: no links, component of their own.  A text of
fewer words than a shingle has its whole word sequence as its one shingle.  Rows of
one doc_id are one document; if their texts differ, the largest set (of equally large
ones that with the greatest digest) stands for its links.  Rows of null doc_id are left out.  An empty table gives
no rows.  A very long text is one step of a worker (tens of bytes of memory for each
of its bytes).  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postbag.llm import common
from postbag.llm.tokens import Words

BANDS, ROWS = 40, 6
_A = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 32, BANDS * ROWS // 2, dtype=np.uint64) | np.uint64(1)
_B = np.random.Generator(np.random.PCG64(8)).integers(0, 1 << 32, BANDS * ROWS // 2, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of distinct shingles, sorted inside each text; where each text begins)."""
    words = Words(texts)
    words.data = _LOWER[words.data]
    h = words.hashes()
    n = len(words.bounds) - 1
    count = np.diff(words.first)
    each = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    total = int(each.sum())
    doc = np.repeat(np.arange(n), each)
    at = words.first[:-1][doc] + np.arange(total) - np.repeat(np.cumsum(each) - each, each)
    full = np.minimum(size, count[doc])
    mixed = np.zeros(total, np.uint64)
    for k in range(size):
        part = h[np.minimum(at + k, len(h) - 1)] if len(h) else h
        mixed = np.where(k < full, (mixed ^ part) * np.uint64(0x9E3779B97F4A7C15), mixed)
        mixed ^= mixed >> np.uint64(31)
    mixed ^= full.astype(np.uint64)  # a short sequence is not a shingle of a longer text
    order = np.lexsort((mixed, doc))
    mixed = mixed[order]
    new = np.ones(total, bool)
    new[1:] = (mixed[1:] != mixed[:-1]) | (doc[1:] != doc[:-1])
    bounds = np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=n))])
    return mixed[new], bounds


def bands(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A band key per text and band; texts with an empty set get zeros."""
    n = len(bounds) - 1
    some = np.flatnonzero(np.diff(bounds))
    out = np.zeros((n, BANDS), np.int64)
    if not len(some):
        return out
    x = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    begin = bounds[:-1][some]
    signature = np.empty((BANDS * ROWS, len(some)), np.uint32)
    v = np.empty_like(x)
    for i, (a, b) in enumerate(zip(_A, _B, strict=True)):
        np.multiply(x, np.uint32(a), out=v)
        v += np.uint32(b)
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        v ^= v >> np.uint32(13)
        np.minimum.reduceat(v, begin, out=signature[2 * i])
        np.maximum.reduceat(v, begin, out=signature[2 * i + 1])
    for k in range(BANDS):
        key = np.full(len(some), k + 1, np.uint64)
        for row in signature[k * ROWS : (k + 1) * ROWS]:
            key = (key ^ row) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
        out[some, k] = key.view(np.int64)
    return out


def digests(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A 128-bit hash of each set; null for the empty one."""
    raw = values.tobytes()
    return pa.array([xxhash.xxh3_128_digest(raw[8 * i : 8 * j]) if j > i else None for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())


def bitmaps(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """A parity bitmap per text: each shingle flips one bit.  Bits: the power of two from
    three a shingle on, 512 at least; a longer one folds to half by exclusive or."""
    out = []
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        bits = max(512, 1 << int(3 * (j - i) - 1).bit_length())
        spot = (values[i:j] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)).astype(np.int64) & (bits - 1)
        flags = (np.bincount(spot, minlength=bits) & 1).astype(np.uint8)
        out.append(np.packbits(flags, bitorder="little").view(np.int64))
    return out


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, digest, bands, bits) of every whole text."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text", 3_000_000):
            values, bounds = shingles(b.column("text"), size)
            keys = bands(values, bounds)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
            maps = bitmaps(values, bounds)
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, maps)]), pa.int32()), pa.array(np.concatenate(maps)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(bounds)), digests(values, bounds), lists, flat], names=["doc_id", "n_shingles", "digest", "bands", "bits"])

    return common.doc_ids_and_text(docs).mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<bigint>, bits array<bigint>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, items, digest): the whole shingle set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            values, bounds = shingles(b.column("text"), size)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, digests(values, bounds)], names=["id", "items", "digest"])

    return docs.mapInArrow(run, "id long, items array<bigint>, digest binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose sets are alike enough."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    ok = 100 * both >= percent * (F.size("x") + F.size("y") - both)
    return pairs.join(left, "a").join(right, "b").where(ok).select("a", "b")


def within(a: str, b: str, total: Column, percent: int) -> Column:
    """Whether bitmaps allow a link: sets with `total` shingles between them may differ in
    (100 - percent) / (100 + percent) of these, and differ in a shingle for each bit."""
    fold = lambda x: f"transform(slice({x}, 1, size({x}) div 2), (v, i) -> v ^ {x}[i + size({x}) div 2])"
    # sizes of linked sets differ by a quarter at most, so bitmaps by one folding
    left, right = f"if(size({a}) > size({b}), {fold(a)}, {a})", f"if(size({b}) > size({a}), {fold(b)}, {b})"
    apart = F.expr(f"aggregate(zip_with({left}, {right}, (p, q) -> bit_count(p ^ q)), 0, (s, x) -> s + x)")
    return (100 + percent) * apart <= (100 - percent) * total


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable over edges (a, b); alternating large and small stars."""
    e = common.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    before = None
    while True:
        # large star: each larger neighbour is tied to the smallest neighbour (or itself)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: each smaller neighbour and the node itself are tied to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v"))).distinct()
        e = common.written(small, "edges")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            return e.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "id")
        before = now


def cluster(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest linked doc_id), kept."""
    spark = docs.sparkSession
    docs = common.doc_ids_and_text(docs).where("doc_id is not null")
    rows = common.written(sketches(docs, size), "sketches")
    classes = common.written(rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("id")), "classes")
    # one row of each class: the least doc_id of a digest
    first_of = rows.join(classes, (rows.digest == classes.digest) & (rows.doc_id == classes.id), "left_semi")
    leaders = common.written(first_of.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.struct("n_shingles", "digest", "bands", "bits")).alias("s")), "leaders")
    keyed = leaders.select("id", F.explode("s.bands").alias("bucket"))
    crowded = keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).where("n > 1").select("bucket", "low", "high")
    members = common.written(keyed.join(crowded, "bucket"), "members")
    sets = common.written(full_sets(docs.join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"), size).groupBy("id").agg(F.max_by("items", F.struct(F.size("items"), "digest")).alias("items")), "sets")

    links = None
    comp = None
    for rep in ("low", "high", None):
        if comp is None:
            open_ = members.select("bucket", "id", "low", "high", F.col("id").alias("comp"))
        else:
            tied = members.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
            # buckets with more than one component, and the component with most classes in each
            per = tied.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
            mixed = per.groupBy("bucket").agg(F.count("*").alias("k"), F.max_by("comp", F.struct("n", "comp")).alias("major")).where("k > 1").select("bucket", "major")
            open_ = common.written(tied.join(mixed, "bucket"), "open")
        if rep:
            target = open_.select("bucket", F.col("id").alias("b"), F.col("comp").alias("cb")).where(F.col("b") == F.col(rep)) if comp is not None else None
            if target is None:
                pairs = open_.where(F.col("id") != F.col(rep)).select(F.col("id").alias("a"), F.col(rep).alias("b"))
            else:
                pairs = open_.join(target, "bucket").where("comp != cb").select(F.col("id").alias("a"), "b")
        else:
            # what is left: classes of different components, each pair at the first band they share
            held = open_.join(leaders, "id")
            side = lambda k: [F.col("id").alias(k), F.col("comp").alias(f"c{k}"), F.col("s.n_shingles").alias(f"n{k}"), F.col("s.bands").alias(f"x{k}"), F.col("s.bits").alias(f"m{k}")]
            a = held.where("comp != major").select("bucket", "major", *side("a"))
            b = held.select("bucket", *side("b"))
            once = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("major")) | (F.col("a") < F.col("b")))
            size_ok = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
            first = F.expr("array_position(zip_with(xa, xb, (p, q) -> p = q), true)") == F.expr("array_position(xa, bucket)")
            pairs = a.join(b, "bucket").where(once & size_ok & within("ma", "mb", F.col("na") + F.col("nb"), percent) & first).select("a", "b")
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        found = common.written(confirmed(pairs, sets, percent), "links")
        if comp is not None and found.isEmpty():
            continue
        links = found if links is None else links.unionByName(found)
        comp = components(links)
    named = classes.join(comp, "id", "left").select("digest", F.coalesce("comp", "id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), (F.col("doc_id") == own).alias("kept"))
