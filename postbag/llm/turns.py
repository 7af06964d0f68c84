"""Conversation structure repair: the cheapest edits that give alternating turns.

Wanted are conversations whose roles' initials read `(s?(ua)+)?`.  A turn is kept (K),
gets another role (R) or is deleted (D); turns without text are inserted (I) anywhere.
Blank and repeated turns must go.  Of the cheapest edit lists the one is taken whose
initials are least in ASCII order.

A layer of the dynamic program is a turn; its macro edits are a run of inserts and then
the turn's own edit.  Their codes (D, ID, IID, IIK, ..., R) are free of prefixes, so two
edit lists compare as their macros do, one by one.  So a state needs no list: it keeps its
cost, its rank among the layer's lists, its parent and its macro; (parent's rank, code)
gives the next layer's ranks.  Lists are rebuilt from the parent pointers at the end.  A
layer is its states' ranks and their costs above the least; there are few such layers, so
each step from one to the next is worked out once and kept.

`plan` streams a conversation's turns through one task in order, with a byte a turn and
state in memory and no texts; a conversation is one unit of that work, however long.
Repeated turns are found before, by a grouping of hashes with partial sums.  `apply` joins
edits and turns on (conversation, number), so a long conversation is dealt out again.

Null roles and texts are one space.  Turns are ordered by number (null first), then role
and text; equal ones are neighbours, and all but one are repeats.  A null conv_id is a
conversation of its own.  A role counts by its first character; other characters than s, u and a, or none,
cannot be kept.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postbag.llm import common

SPACE = " \t\n\x0b\x0c\r"
#: Costs of edits, and of keeping a turn that is cut off.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: Inserts before a turn, at most.  Two of them lead from a state to itself, or to one that the
#: state without them is as good as; only after a lone system turn two end a conversation.
RUN, LAST_RUN = 1, 2
#: Macro edits in ASCII order; their place is their code.
CODES = sorted("I" * r + e for r in range(RUN + 1) for e in "KRD")
#: States: nothing yet, a system turn, a user turn, an assistant turn last.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_KEPT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}


def _moves(initial: str, fault: str) -> list[tuple[int, int, int, int]]:
    """(state, code, next state, cost) of all macro edits of a turn."""
    out, late = [], CUT_OFF if fault == "truncated" else 0
    for state in range(4):
        at = state
        for r in range(RUN + 1):
            if r:
                at = _NEXT[at]
            code = lambda e, r=r: CODES.index("I" * r + e)
            out.append((state, code("D"), at, INSERT * r + DELETE))
            if fault not in ("blank", "duplicate"):
                if (to := _KEPT.get((at, initial))) is not None:
                    out.append((state, code("K"), to, INSERT * r + late))
                out.append((state, code("R"), _NEXT[at], INSERT * r + REROLE + late))
    return out


_MOVES = {(i, f): _moves(i, f) for i in ("s", "u", "a", "") for f in ("", "blank", "duplicate", "truncated")}


#: Whatever may follow a state can follow any other for this much more (a kept system turn is
#: deleted, 4, a turn inserted at both ends, 6), so states farther above the least are left out.
MARGIN = 10
#: A layer: (cost above the layer's least, rank) of each state, None where it is not reached.
Layer = tuple[tuple[int, int] | None, ...]
_STEPS: dict[tuple[Layer, str, str], tuple[Layer, int, tuple[int, int, int, int]]] = {}
_FIRST: Layer = ((0, 0), None, None, None)


def _step(layer: Layer, initial: str, fault: str) -> tuple[Layer, int, tuple[int, int, int, int]]:
    """The next layer, what the least cost grows by, and a pointer (parent and code) of each state."""
    best: dict[int, tuple[int, int, int, int]] = {}
    for state, code, to, cost in _MOVES[initial, fault]:
        if layer[state] is not None:
            found = (layer[state][0] + cost, layer[state][1], code, state)
            if to not in best or found < best[to]:
                best[to] = found
    least = min(b[0] for b in best.values())
    best = {s: b for s, b in best.items() if b[0] <= least + MARGIN}
    order = sorted(best, key=lambda s: best[s][1:])
    after = tuple((best[s][0] - least, order.index(s)) if s in best else None for s in range(4))
    return after, least, tuple(best[s][3] * len(CODES) + best[s][2] if s in best else 255 for s in range(4))


class Repair:
    """Takes one conversation's turns in order; `close` and `path` give the cheapest edit list."""

    def __init__(self):
        self.layer, self.least, self.count = _FIRST, 0, 0
        self.back = [bytearray() for _ in range(4)]

    def add(self, initial: str, fault: str) -> None:
        key = (self.layer, initial if initial in ("s", "u", "a") else "", fault)
        if (found := _STEPS.get(key)) is None:
            found = _STEPS[key] = _step(*key)
        self.layer, more, back = found
        self.least += more
        for column, pointer in zip(self.back, back, strict=True):
            column.append(pointer)
        self.count += 1

    def costs(self) -> dict[int, int]:
        """The cost of each state that is reached."""
        return {s: self.least + x[0] for s, x in enumerate(self.layer) if x is not None}

    def close(self) -> tuple[int, int, int]:
        """(cost, state before the last inserts, number of last inserts)."""
        ends = [(self.least + x[0] + INSERT * r, x[1], r, s) for s, r in ((EMPTY, 0), (ASSISTANT, 0), (USER, 1), (SYSTEM, LAST_RUN)) if (x := self.layer[s]) is not None]
        cost, _, r, s = min(ends)
        return cost, s, r

    def path(self, state: int) -> tuple[bytearray, bytearray]:
        """Codes of all turns, and the states before them."""
        codes, before = bytearray(self.count), bytearray(self.count)
        for k in range(self.count - 1, -1, -1):
            parent, code = divmod(self.back[state][k], len(CODES))
            codes[k], before[k] = code, parent
            state = parent
        return codes, before


def numbered(rows: DataFrame) -> DataFrame:
    """(conv_id, i, turn, role, text, again): turns in order from 1, and whether role and text stood before."""
    base = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    keyed = base.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "role", "text")})
    seen = keyed.groupBy("conv_id", "h1", "h2").agg(F.count("*").alias("n"), F.min("turn").alias("low"), F.bool_or(F.col("turn").isNull()).alias("none")).where("n > 1")
    seen = seen.select(F.col("conv_id").alias("_c"), F.col("h1").alias("_1"), F.col("h2").alias("_2"), "low", "none")
    met = keyed.join(seen, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")), "left")
    later = F.when(F.col("_1").isNull(), False).when(F.col("none"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("low"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    last = lambda c: F.lag(c).over(w).eqNullSafe(F.col(c))
    beside = (F.row_number().over(w) > 1) & last("turn") & last("role") & last("text")
    return met.select("conv_id", F.row_number().over(w).cast("long").alias("i"), "turn", "role", "text", (later | beside).alias("again"))


def fault(text: Column, again: Column) -> Column:
    """A turn's first fault: blank, duplicate, truncated, or empty."""
    return F.when(~text.rlike(r"[^\x20\x09-\x0D]"), "blank").when(again, "duplicate").when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise("")


def _dealt(rows: DataFrame) -> DataFrame:
    """Conversations whole and in order, over all shuffle partitions: the rows are small, the work on them is not, so they are not put together by bytes."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "i")


EDITS = "conv_id long, i long, macro string, first string, number long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def plan(turns: DataFrame) -> DataFrame:
    """The cheapest edits of conversations as `numbered` gives them, a row a turn.

    A turn's row has its macro, the role of the first turn that the macro puts out if that
    is inserted or gets another role, and how many turns stand before it in the result.  A
    conversation's last row (i = turns + 1) has the inserts at its end and its counts.
    """
    common.ship(turns.sparkSession)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 7]
    names = [c.split(" ")[0] for c in EDITS.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    def written(conv: int | None, state: Repair, counts: dict[str, int]) -> Iterator[tuple]:
        cost, end, tail = state.close()
        codes, before = state.path(end)
        number = 0
        for k, (code, s) in enumerate(zip(codes, before, strict=True)):
            macro = CODES[code]
            yield conv, k + 1, macro, _NAMES[_NEXT[s]], number, *[None] * 6
            number += len(macro) - (macro[-1] == "D")
        yield conv, state.count + 1, "I" * tail, _NAMES[_NEXT[end]], number, *[counts[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal")], cost

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, conv, counts, low, last, kinds_, initial = None, None, {}, None, None, 0, None

        def close() -> Iterator[pa.RecordBatch]:
            if low is not None:
                counts["gaps"] = last - low + 1 - kinds_
            rows = []
            for r in written(conv, state, counts):
                rows.append(r)
                if len(rows) == 10_000:
                    yield batch(rows)
                    rows = []
            yield batch(rows)

        for b in batches:
            for c, turn, role, wrong in zip(*(b.column(x).to_pylist() for x in ("conv_id", "turn", "initial", "fault")), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        yield from close()
                    state, conv, low, last, kinds_, initial = Repair(), c, None, None, 0, None
                    counts = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal"), 0)
                if turn is not None and turn != last:
                    low, last, kinds_ = turn if low is None else low, turn, kinds_ + 1
                if wrong:
                    counts[wrong] += 1
                if initial is not None and initial + role not in ("su", "ua", "au"):
                    counts["illegal"] += 1
                initial = role
                state.add(role, wrong)
        if state is not None:
            yield from close()

    rows = turns.select("conv_id", "i", "turn", F.substring("role", 1, 1).alias("initial"), fault(F.col("text"), F.col("again")).alias("fault"))
    return _dealt(rows).select("conv_id", "turn", "initial", "fault").mapInArrow(run, EDITS)


def apply(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits with what they put out: `out` holds (role, text) of inserts and then of the turn, if it stays."""
    t = turns.select(F.col("conv_id").alias("_c"), F.col("i").alias("_i"), "role", "text")
    met = edits.join(t, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("i") == F.col("_i")), "left")
    other = F.when(F.col("first") == "user", "assistant").otherwise("user")
    runs = F.length(F.regexp_replace("macro", "[KRD]", ""))
    role_at = lambda k: F.when(k % 2 == 0, F.col("first")).otherwise(other)
    inserted = F.when(runs == 0, F.expr("cast(array() as array<struct<role:string,text:string>>)")).otherwise(F.transform(F.sequence(F.lit(0), runs - 1), lambda k: F.struct(role_at(k).alias("role"), F.lit("").alias("text"))))
    own = F.when(F.col("macro").endswith("K"), F.array(F.struct("role", "text"))).when(F.col("macro").endswith("R"), F.array(F.struct(role_at(runs).alias("role"), F.col("text")))).otherwise(F.expr("cast(array() as array<struct<role:string,text:string>>)"))
    return met.select("conv_id", "i", "macro", "number", F.concat(inserted, own).alias("out"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, number from 0, role, text)."""
    turns = common.written(numbered(rows), "turns")
    return apply(turns, plan(turns)).select("conv_id", "number", F.posexplode("out").alias("k", "x")).select("conv_id", (F.col("number") + F.col("k")).alias("number"), "x.role", "x.text")


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(rows: DataFrame) -> DataFrame:
    """A row a conversation: counts, cost, edits' initials, and the hash of the repaired `role:text` lines."""
    turns = common.written(numbered(rows), "turns")
    done = apply(turns, plan(turns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, sha, some = [], hashlib.sha256(), False
        for b in batches:
            out = []
            for conv, macro, put, *counts in zip(*(b.column(c).to_pylist() for c in ("conv_id", "macro", "out", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")), strict=True):
                audit.append(macro)
                for x in put:
                    sha.update(f"{chr(10) if some else ''}{x['role']}:{x['text']}".encode())
                    some = True
                if counts[0] is not None:  # the conversation's last row
                    out.append((conv, *counts, "".join(audit), sha.hexdigest()))
                    audit, sha, some = [], hashlib.sha256(), False
            types = [*[pa.int64()] * 7, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=[c.split(" ")[0] for c in REPORT.split(", ")])

    return _dealt(done).drop("i", "number").mapInArrow(run, REPORT)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, a fifth of the rows or so, by crc32 of `conv_id:turn`."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20
    base = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.expr("sequence(1, if(kind = 3, 2, 1))")).alias("copy")
    return base.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies).drop("copy")
