"""Sequence packing as a cutting-stock problem solved by column generation.

A document's ids are cut into full sequences and one remainder.  Remainders fall
into length classes of `grain` ids; the class histogram (at most `size / grain`
rows, whatever the input) is all that the driver sees.  There a linear program over
patterns (how many pieces of each class share a sequence) is solved by revised
simplex; new patterns are priced by a knapsack dynamic program.  Patterns used a
whole number of times are dealt out, the few pieces that rounding leaves are
placed first-fit decreasing.  Pieces are ranked within their class (rank inside
the partition plus pieces of the class in earlier partitions), so each finds its
pattern, copy and place by its rank alone and no group meets in one task.

Null or empty texts are one piece that holds just the end id.  An empty table
gives no rows.  Equal documents are separate pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postbag.llm import common
from postbag.llm.tokens import encoder, vocabulary_path

SIZE = 2048
GRAIN = 8


def price(value: np.ndarray, width: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the best total of `value` whose `width`s fit, and the counts."""
    dense = np.full(room + 1, -1.0)
    index = np.zeros(room + 1, np.int64)
    dense[width], index[width] = value, np.arange(len(width))
    dense, best, pick = dense[1:], np.zeros(room + 1), np.zeros(room + 1, np.int64)
    back = best[::-1]  # back[room - c] is best[c]
    for c in range(1, room + 1):
        total = dense[:c] + back[room - c + 1 :]
        w = int(total.argmax())
        if total[w] > best[c - 1]:
            best[c], pick[c] = total[w], w + 1
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(value), np.int64), room
    while c > 0:
        if pick[c]:
            counts[index[pick[c]]] += 1
            c -= pick[c]
        else:
            c -= 1
    return float(best[room]), counts


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By elimination with row pivots, in plain array operations: threaded solvers can
    stand still in a process that has forked, as a driver has."""
    n = len(matrix)
    work = np.hstack([matrix, np.eye(n)])
    for i in range(n):
        top = i + int(np.abs(work[i:, i]).argmax())
        work[[i, top]] = work[[top, i]]
        work[i] /= work[i, i]
        factor = work[:, i].copy()
        factor[i] = 0
        work -= factor[:, None] * work[i]
    return work[:, n:]


def solve(width: np.ndarray, demand: np.ndarray, room: int, gap: float = 2e-3, most: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Column generation: (patterns, one a row; times each is used, fractional).

    Ends when Farley's bound shows the plan within `gap` of the best one.
    """
    m = len(width)
    basis = np.diag(room // width).astype(float)  # columns are patterns
    inverse = np.diag(1.0 / (room // width))
    use = (inverse * demand).sum(1)
    for step in range(most):
        dual = inverse.sum(0)
        worth, column = price(dual, width, room)
        if worth <= 1 + gap:
            break
        direction = (inverse * column).sum(1)
        ok = direction > 1e-9
        ratio = np.where(ok, use / np.where(ok, direction, 1), np.inf)
        leave = int(ratio.argmin())
        move = ratio[leave]
        use = np.maximum(use - move * direction, 0)
        use[leave] = move
        basis[:, leave] = column
        row = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, row)
        inverse[leave] = row
        if step % 200 == 199:
            inverse = _inverse(basis)
            use = np.maximum((inverse * demand).sum(1), 0)
    return basis.T.round().astype(np.int64), use


def plan(demand: dict[int, int], room: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Whole patterns: (copies, [(class, pieces of it)]); together they hold `demand` exactly."""
    width = np.array(sorted(demand), np.int64)
    left = np.array([demand[w] for w in width.tolist()], np.int64)
    out = []
    if len(width):
        patterns, use = solve(width, left.astype(float), room)
        for row, times in zip(patterns, np.floor(use + 1e-9).astype(np.int64), strict=True):
            kinds = np.flatnonzero(row)
            times = min([int(times), *(left[kinds] // row[kinds]).tolist()])
            if times > 0:
                left[kinds] -= times * row[kinds]
                out.append((times, list(zip(width[kinds].tolist(), row[kinds].tolist(), strict=True))))
    bins: list[tuple[int, dict[int, int]]] = []
    for w, n in zip(width[::-1].tolist(), left[::-1].tolist(), strict=True):
        i = 0
        while n:
            while i < len(bins) and bins[i][0] < w:
                i += 1
            if i == len(bins):
                if n * w > 64 * room:  # never after a rounded program; keeps the list short all the same
                    each = room // w
                    out.append((n // each, [(w, each)]))
                    n %= each
                    continue
                bins.append((room, {}))
            space, held = bins[i]
            k = min(n, space // w)
            held[w] = held.get(w, 0) + k
            bins[i] = (space - k * w, held)
            n -= k
    out += [(1, list(held.items())) for _, held in bins]
    return out


def _cut(docs: DataFrame, vocabulary: str, end: int, size: int, grain: int) -> DataFrame:
    """Pieces with their class (0: a full sequence) and rank within class and partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(vocabulary_path(vocabulary))
        met = np.zeros(size // grain + 1, np.int64)
        for b in common.slices(batches, "text"):
            ids, counts = enc.encode(b.column("text"), end)
            ids = ids.astype("<u4")
            pieces = -(-counts // size)
            n = int(pieces.sum())
            doc = np.repeat(np.arange(len(counts)), pieces)
            nth = np.arange(n) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = nth * size
            length = np.minimum(counts[doc] - start, size)
            begin = (np.cumsum(counts) - counts)[doc] + start
            sums = np.array([zlib.crc32(ids[i : i + k]) for i, k in zip(begin.tolist(), length.tolist(), strict=True)], np.int64)
            kind = np.where(length == size, 0, -(-length // grain))
            order = np.argsort(kind, kind="stable")
            first = np.searchsorted(kind[order], kind[order])
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(n) - first + met[kind[order]]
            met += np.bincount(kind, minlength=len(met))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(sums), pa.array(counts[doc]), pa.array(np.full(n, part, np.int32)), pa.array(kind.astype(np.int32)), pa.array(rank)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "kind", "rank"],
            )

    return common.doc_ids_and_text(docs).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, kind int, rank long")


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end: int = 1, size: int = SIZE, grain: int = GRAIN) -> DataFrame:
    """Pieces of `docs` (doc_id, text) with their place: a row per piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    common.ship(docs.sparkSession)
    pieces = common.written(_cut(docs, vocabulary, end, size, grain), "pieces")
    counts = pieces.groupBy("kind", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("kind", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    total = {r.kind: r.n for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # size / grain + 1 rows at most

    full = total.pop(0, 0)
    first = 0
    rows: dict[int, list[tuple[int, int, int, int]]] = {}  # class: (first rank, pieces a copy, first sequence, place in it)
    taken: dict[int, int] = {}
    for copies, kinds in plan(total, size // grain):
        for place, (kind, each) in enumerate(kinds):
            rows.setdefault(kind, []).append((taken.get(kind, 0), each, first, place))
            taken[kind] = taken.get(kind, 0) + copies * each
        first += copies
    rows[0] = [(0, 1, first, 0)] if full else []
    table = {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in rows.items() if v}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, rank = np.asarray(b.column("kind")), np.asarray(b.column("rank"))
            seq, spot = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
            for k in np.unique(kind).tolist():
                base, each, start, at = table[k]
                mine = np.flatnonzero(kind == k)
                i = np.searchsorted(base, rank[mine], "right") - 1
                inside = rank[mine] - base[i]
                seq[mine] = start[i] + inside // each[i]
                spot[mine] = at[i] * (size + 1) + inside % each[i]
            keep = [b.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(spot)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "spot"])

    ranked = pieces.join(shift, ["kind", "part"]).withColumn("rank", F.col("rank") + F.col("shift"))
    placed = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind", "rank").mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, spot long")
    # a sequence holds `size` pieces at most, so its window is small whatever the input
    inside = Window.partitionBy("sequence_id").orderBy("spot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("spot")


def padding(packed: DataFrame, size: int = SIZE) -> DataFrame:
    """A row: sequences, ids, and padded ids (a sequence as long as a power of two has none)."""
    held = packed.groupBy("sequence_id").agg(F.sum("length").alias("ids"))
    exact = F.expr("bit_count(ids) = 1")
    return held.agg(F.count("*").alias("sequences"), F.sum("ids").alias("ids"), F.sum(F.when(exact, 0).otherwise(size - F.col("ids"))).alias("padded"))
