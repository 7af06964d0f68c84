"""Linking of names: fuller names near a mention, names across archives, entities alike.

Names meet by their words: a looked-up name is keyed by its rarest word among the names to
be found, joined on that word, and then held against the whole name.  So a word that a third
of all names have is a key only for names of nothing rarer; names of such a word are dealt
into parts of about `PART` and the looked-up name goes to each.

Nearness goes by levels (same message, thread, correspondents, ...), each a table
(doc_id, key).  Levels are looked through one after the other, and mentions that have
enough are left out of the next.  At a level names are first cut down to the best few of
each (key, looked-up name), in salted groups, so that neither a busy sender's names nor
his mentions meet all of the others.

A name that equals the looked-up one is no fuller name.  Null and empty names match
nothing; messages without a key at a level are not near there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postbag.sinks.shared import written

#: Parts that a group's names are ranked in before they are ranked together.
SALT = 16
#: Names of one word that meet its looked-up names in one part; rows of a join that one task is to hold.
PART, ROWS = 50_000, 200_000


def tasks(df: DataFrame, rows: int = 0) -> int:
    """Partitions of a join of about so many rows, at least the session's number.

    Names shrink so much in a shuffle that partitions put together by bytes need far more
    memory as rows; a number that is given is kept.
    """
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + rows // ROWS)


def canonical(c: Column) -> Column:
    """Lower case, words apart by one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def acronym(c: Column) -> Column:
    """First letters of the capitalised words of a name."""
    return F.array_join(F.regexp_extract_all(c, F.lit(r"(?<![\p{L}\p{N}])(\p{Lu})"), 1), "")


def containing(names: DataFrame, asked: DataFrame, acronyms: bool = False) -> DataFrame:
    """(asked, name): names (column name) that hold a looked-up name (column asked) word for word, or that it is short for.

    Equal names are among them.
    """
    known = written(names.select("name").where("name is not null").distinct().where(canonical(F.col("name")) != ""), "known")
    wanted = asked.select("asked").where("asked is not null").distinct().withColumn("q", canonical(F.col("asked"))).where("q != ''")
    words = known.select("name", F.explode(F.array_distinct(F.split(canonical(F.col("name")), " "))).alias("word"))
    counts = written(words.groupBy("word").agg(F.count("*").alias("n")), "counts")
    parts = wanted.select("asked", "q", F.explode(F.array_distinct(F.split("q", " "))).alias("word")).join(counts, "word", "left")
    # a word that no name has rules the looked-up name out: it is the rarest
    rarest = parts.groupBy("asked", "q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("k")).where("k.n > 0")
    split = F.expr(f"cast(1 + (k.n - 1) div {PART} as int)")
    rarest = rarest.select("asked", "q", F.col("k.word").alias("word"), F.explode(F.sequence(F.lit(0), split - 1)).alias("part"))
    # at most a word for each `PART` rows of words
    often = F.broadcast(counts.where(F.col("n") > PART).select("word", F.expr(f"cast(1 + (n - 1) div {PART} as int)").alias("k")))
    dealt = words.join(often, "word", "left").select("name", "word", F.coalesce(F.pmod(F.xxhash64("name"), F.col("k")).cast("int"), F.lit(0)).alias("part"))
    dealt = dealt.repartition(tasks(names, counts.agg(F.sum("n").alias("n")).first().n or 0), "word", "part")
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    holds = F.contains(pad(canonical(F.col("name"))), pad(F.col("q")))
    # a looked-up name has one rarest word and a name lies in one part of it, so no pair comes twice
    out = dealt.join(rarest, ["word", "part"]).where(holds).select("asked", "name")
    if acronyms:
        short = wanted.where(F.col("asked").rlike(r"^\p{Lu}{3,}$"))
        out = out.unionByName(short.join(known.select("name", acronym(F.col("name")).alias("a")), F.col("a") == F.col("asked")).where(~holds).select("asked", "name"))
    return out


def across(names: DataFrame, lookups: DataFrame) -> DataFrame:
    """(asked, archive_id, name, ...) of every looked-up name in every archive; `names` has archive_id, name and more."""
    found = written(containing(names, lookups), "found")
    n = tasks(names, found.count())
    return names.repartition(n, "name").join(found.repartition(n, "name"), "name").select("asked", *names.columns)


def _best(rows: DataFrame, group: list[str], order: list[Column], top: int) -> DataFrame:
    """The first `top` rows of each group, ranked within salted parts and then together."""
    salted = rows.withColumn("_s", F.pmod(F.xxhash64("name"), F.lit(SALT)))
    inside = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_s").orderBy(*order))).where(F.col("_r") <= top)
    return inside.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= top).drop("_s", "_r")


def nearest(asked: DataFrame, found: DataFrame, levels: list[DataFrame | None], most: int = 5, acronyms: bool = True) -> DataFrame:
    """(ask, name, level, n): for each mention (ask, doc_id, text) the `most` nearest fuller names.

    `found` has the names of messages (doc_id, name); `levels` are tables (doc_id, key) from
    near to far, None for the whole archive.  A name counts at the nearest level it stands in,
    where the ones that stand in more messages of that key come first, then by the alphabet.
    """
    asks = asked.where("text is not null").select("ask", "doc_id", "text")
    pairs = containing(found, asks.select(F.col("text").alias("asked")), acronyms)
    pairs = written(pairs.where(canonical(F.col("asked")) != canonical(F.col("name"))).select(F.col("asked").alias("text"), "name"), "pairs")
    # names with what they are looked up by; by name, so that they need no other shuffle to be distinct
    held = found.select("doc_id", "name").repartition(tasks(found), "name").join(pairs, "name").select("doc_id", "name", "text").distinct()
    held = written(held, "held")
    size = tasks(found, held.count())
    got = None
    for k, level in enumerate(levels):
        open_ = asks
        if got is not None:
            full = got.groupBy("ask").agg(F.count("*").alias("n")).where(F.col("n") >= most)
            open_ = asks.join(full, "ask", "left_anti")
        if level is None:
            at, ours = held.withColumn("key", F.lit("")), open_.withColumn("key", F.lit(""))
        else:
            keyed = level.where("key is not null").select("doc_id", F.col("key").cast("string").alias("key")).distinct()
            ours = written(open_.join(keyed, "doc_id"), "asks")
            # only what stands near an ask is counted
            near = keyed.join(ours.select("key").distinct(), "key", "left_semi")
            at = held.repartition(size, "doc_id").join(near, "doc_id")
        # a message has a name and a key once
        per = at.repartition(size, "key", "text", "name").groupBy("key", "text", "name").agg(F.count("*").alias("n"))
        # what an ask has already is less than `most`, so twice as many hold all that it can get
        few = _best(per, ["key", "text"], [F.desc("n"), F.col("name")], 2 * most)
        new = ours.select("ask", "text", "key").join(few, ["key", "text"]).groupBy("ask", "name").agg(F.max("n").alias("n"))
        if got is not None:
            new = new.join(got.select("ask", "name"), ["ask", "name"], "left_anti")
        new = new.withColumn("level", F.lit(k))
        ranked = _best(new, ["ask"], [F.desc("n"), F.col("name")], most)
        both = ranked if got is None else got.unionByName(ranked)
        place = Window.partitionBy("ask").orderBy("level", F.desc("n"), "name")  # at most twice `most` rows an ask
        got = written(both.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= most).drop("_r"), "near")
    return got.select("ask", "name", "level", "n") if got is not None else asks.select("ask", F.lit(None).cast("string").alias("name"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("n")).where("false")


#: Scores of an expansion's sources, near to far.
SOURCES = (("participant", 1.0), ("message", 1.0), ("thread", 0.9), ("correspondents", 0.8), ("archive", 0.7))


def expanded(asked: DataFrame, found: DataFrame, people: DataFrame, threads: DataFrame, correspondents: DataFrame, most: int = 5) -> DataFrame:
    """(ask, name, score, source): fuller forms of names, from the message's people outwards until enough are found.

    `people` has the names of a message's people (doc_id, name), `threads` (doc_id, key) its
    thread, `correspondents` (doc_id, key) the people but for the owner.
    """
    own = found.select("doc_id", F.col("doc_id").cast("string").alias("key")).unionByName(asked.select("doc_id", F.col("doc_id").cast("string").alias("key"))).distinct()
    first = nearest(asked, people, [own.unionByName(people.select("doc_id", F.col("doc_id").cast("string").alias("key"))).distinct()], most).withColumn("level", F.lit(0))
    rest = nearest(asked, found, [own, threads, correspondents, None], most).withColumn("level", F.col("level") + 1)
    both = first.unionByName(rest).groupBy("ask", "name").agg(F.min(F.struct("level", (-F.col("n")).alias("m"))).alias("x"))
    place = Window.partitionBy("ask").orderBy("x", "name")  # at most twice `most` rows an ask
    source = F.array(*[F.lit(s) for s, _ in SOURCES])[F.col("x.level")]
    score = F.array(*[F.lit(v) for _, v in SOURCES])[F.col("x.level")]
    return both.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= most).select("ask", "name", score.alias("score"), source.alias("source"))


def features(found: DataFrame, addresses: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(name, kind, feature, weight, prior): what stands with each name in messages.

    Kind `name`: other names of its messages; kind `address`: the messages' addresses.  The
    weight is the number of messages, the prior the name's share of all messages with names.
    With `only` (name), features are made for its names alone; others keep just their prior,
    in a row of kind `none`.
    """
    held = written(found.where("name is not null").select("doc_id", "name").distinct(), "held")
    every = held.agg(F.countDistinct("doc_id").alias("n")).first().n or 1
    prior = held.groupBy("name").agg((F.count("*") / F.lit(every)).alias("prior"))
    wanted = held if only is None else held.join(only.select("name").distinct(), "name", "left_semi")
    near = wanted.join(held.select("doc_id", F.col("name").alias("feature")), "doc_id").where(F.col("name") != F.col("feature")).groupBy("name", "feature").agg(F.count("*").alias("weight")).withColumn("kind", F.lit("name"))
    mail = wanted.join(addresses.where("email is not null").select("doc_id", F.lower("email").alias("feature")).distinct(), "doc_id").groupBy("name", "feature").agg(F.count("*").alias("weight")).withColumn("kind", F.lit("address"))
    rows = near.unionByName(mail).withColumn("weight", F.col("weight").cast("long"))
    return rows.join(prior, "name", "right").select("name", F.coalesce("kind", F.lit("none")).alias("kind"), "feature", F.coalesce("weight", F.lit(0)).alias("weight"), "prior")


def alike(index: DataFrame, asked: DataFrame, own: list[str] | None = None, most: int | None = None) -> DataFrame:
    """(asked, name, score): fuller names of several words for each looked-up name, by what they stand with.

    Shared names count their weight by the inverse of their own prior, shared addresses (but
    the owner's) their weight; each sum is divided by the length of the fuller name's weights,
    and half of both goes with the fuller name's prior.
    """
    index = written(index, "features")
    pairs = written(containing(index, asked).where((canonical(F.col("asked")) != canonical(F.col("name"))) & (F.instr(F.trim("name"), " ") > 0)), "pairs")
    priors = index.select("name", "prior").distinct()
    index = index.where("kind != 'none'")
    norms = index.groupBy("name", "kind").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    mine = index.join(asked.select(F.col("asked").alias("name")).distinct(), "name").select(F.col("name").alias("asked"), "kind", "feature")
    theirs = index.select("name", "kind", "feature", "weight")
    # a fuller name brings its own few features; a looked-up name's many never meet all its fuller names
    shared = pairs.join(theirs, "name").join(mine, ["asked", "kind", "feature"])
    if own:
        shared = shared.where(~((F.col("kind") == "address") & F.col("feature").isin([o.lower() for o in own])))
    told = shared.join(priors.select(F.col("name").alias("feature"), F.col("prior").alias("share")), "feature", "left")
    part = F.when(F.col("kind") == "name", F.col("weight") / F.col("share")).otherwise(F.col("weight"))
    sums = told.groupBy("asked", "name", "kind").agg(F.sum(part).alias("s")).join(norms, ["name", "kind"]).groupBy("asked", "name").agg(F.sum(0.5 * F.col("s") / F.col("norm")).alias("s"))
    out = pairs.join(sums, ["asked", "name"], "left").join(priors, "name").select("asked", "name", (F.coalesce("s", F.lit(0.0)) * F.col("prior")).alias("score"))
    return _best(out, ["asked"], [F.desc("score"), F.col("name")], most) if most else out
