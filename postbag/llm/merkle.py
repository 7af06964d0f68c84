"""A Merkle manifest of a dataset, one DataFrame a level.

Each row is a leaf: the hash of its fields.  Leaves of one group (a language) stand in
order of doc_id; runs of `fanout` nodes are hashed into parents until one node is left,
the group's subroot.  Subroots in order of the group form the top tree in the same way.

Indices are row numbers taken without one task for a group: rows are range-partitioned
by (group, doc_id) and written sorted, so a number is the place in the file plus the rows
of that group in earlier files.  A level is one grouping by (group, index div fanout),
each group at most `fanout` hashes.  Proofs are made from the top down: a node's siblings
go in front of those of its parent, so a level's join has as many rows as the level above
has nodes, and only the last has a row a leaf.

A hash is the lowercase hex SHA-256 of its inputs, joined as text.  A null field is `-`,
else its byte count, `:` and its value; an empty text is `0:`.  The null group comes first,
the others in bytewise order.  Rows of one doc_id are leaves of their own, in order of
their hashes; equal leaves too.  Null doc_ids come first in their group.  A text of any
length is hashed in its scan and does not move.  An empty table gives no rows.  Columns
beside the five fields are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postbag.llm import common

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """A value with its length, `-` for null."""
    c = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def leaf(**changed: Column) -> Column:
    """The leaf hash of a row; `changed` stands in for fields of that name."""
    return digest(*[field(changed.get(f, F.col(f))) for f in FIELDS])


def lower_az(c: Column) -> Column:
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def indexed(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` (grp and others) with idx, the place in its group by `order` from 0, and n, the group's size."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the last key lets equal rows be dealt out; which of them comes first makes no difference
    keyed = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = ["grp", *order, "_tie"]
    sorted_ = keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_tie")
    placed = common.written(sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "placed")
    spans = placed.groupBy("grp", "_part").agg(F.count("*").alias("_c"), F.min("_pos").alias("_lo"))
    whole = Window.partitionBy("grp")  # a row a file and group
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select("grp", "_part", (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_lo")).alias("_off"), F.sum("_c").over(whole).alias("n"))
    return placed.join(offsets, ["grp", "_part"]).withColumn("idx", F.col("_pos") + F.col("_off")).drop("_part", "_pos", "_off")


def _runs(nodes: DataFrame, fanout: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(grp, up, n, kids): runs of `fanout` nodes, kids in order."""
    kid = F.struct("idx", "hash", *carry)
    return nodes.groupBy("grp", F.expr(f"idx div {fanout}").alias("up"), "n").agg(F.array_sort(F.collect_list(kid)).alias("kids"))


def levels(nodes: DataFrame, fanout: int = FANOUT, carry: tuple[str, ...] = ()) -> list[DataFrame]:
    """Runs of each level from the leaves up, until every group has one node."""
    out = []
    while True:
        level = common.written(_runs(nodes, fanout, carry), "level")
        out.append(level)
        carry = ()
        most = level.agg(F.max("n").alias("n")).first().n
        if most is None or most == 1:
            return out
        joined = F.array_join(F.transform("kids", lambda k: k["hash"]), "")
        nodes = level.where("n > 1").select("grp", F.col("up").alias("idx"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), F.sha2(joined, 256).alias("hash"))


def subroots(tree: list[DataFrame]) -> DataFrame:
    """(grp, hash): the last node of each group."""
    out = None
    for level in tree:
        part = level.where("n = 1").select("grp", F.col("kids")[0]["hash"].alias("hash"))
        out = part if out is None else out.unionByName(part)
    return out


def proofs(tree: list[DataFrame], above: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(grp, idx, hash, carry, steps, rest of `above`) of each leaf of a tree.

    `above` has a row a group: grp, steps (the siblings above its last node) and other
    columns that are passed down.  A step holds the siblings to the left and to the right.
    """
    more = [c for c in above.columns if c not in ("grp", "steps")]
    down = None
    for k in range(len(tree) - 1, -1, -1):
        level, extra = tree[k], carry if k == 0 else ()
        kid = [F.col("kid.idx").alias("idx"), F.col("kid.hash").alias("hash"), *[F.col(f"kid.{c}").alias(c) for c in extra]]
        last = level.where("n = 1").join(above, "grp").select("grp", F.col("kids")[0].alias("kid"), "steps", *more).select("grp", *kid, "steps", *more)
        if down is None:
            down = last
            continue
        part = lambda lo, size: F.array_join(F.transform(F.slice("kids", lo, size), lambda x: x["hash"]), "")
        met = level.where("n > 1").join(down.select("grp", F.col("idx").alias("up"), "steps", *more), ["grp", "up"])
        met = met.select("grp", "kids", F.posexplode("kids").alias("at", "kid"), "steps", *more)
        step = F.struct(part(F.lit(1), F.col("at")).alias("left"), part(F.col("at") + 2, F.greatest(F.size("kids") - F.col("at") - 1, F.lit(0))).alias("right"))
        down = met.select("grp", *kid, F.concat(F.array(step), F.col("steps")).alias("steps"), *more).unionByName(last)
        if k:
            down = common.written(down, "down")
    return down


def fold(node: Column, steps: Column) -> Column:
    """The root that a node and its steps lead to."""
    return F.aggregate(steps, node, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(steps: Column) -> Column:
    """The hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, fanout: int = FANOUT, **carry: Column) -> DataFrame:
    """Per row: doc_id, lang, leaf, subroot, root, steps (its proof), and columns to `carry`, computed in the scan."""
    kept = tuple(carry)
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("grp"),  # the null group sorts before all others
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf().alias("hash"),
        *[c.alias(name) for name, c in carry.items()],
    )
    tree = levels(indexed(rows, ["doc_id", "hash"]), fanout, ("doc_id", *kept))
    tops = common.written(subroots(tree).select(F.lit("").alias("grp"), F.col("grp").alias("name"), "hash"), "subroots")
    top = levels(indexed(tops, ["name"]), fanout, ("name",))
    root = subroots(top).select("grp", F.col("hash").alias("root"), F.expr(f"cast(array() as {_STEP})").alias("steps"))
    above = common.written(proofs(top, root, ("name",)).select(F.col("name").alias("grp"), F.col("hash").alias("subroot"), "root", "steps"), "above")
    got = proofs(tree, above, ("doc_id", *kept))
    return got.select("doc_id", F.when(F.col("grp") != "", F.substring("grp", 2, 2147483647)).alias("lang"), F.col("hash").alias("leaf"), "subroot", "root", "steps", *kept)
