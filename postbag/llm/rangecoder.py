"""Token-ID output in a context-mixing range-coded block format.

Ids are cut into blocks of `block` ids.  A block starts with fresh models and has
its own CRC-32, so it can be read alone and damage stays inside it.  Each id is
coded under a mixture of four predictions:

* order 2: the id that last followed the same two ids;
* order 1: the id that last followed the same id;
* order 0: the counts of all ids of the block so far (recounted at `epochs`);
* novel: adaptive counts of the high part of ids that order 0 did not hold (id //
  256), the low byte being uniform within it.

Orders 1 and 2 keep their successors in slots with a context tag (exact for order 1,
12 bits beyond the slot for order 2); a slot of another context predicts nothing.
How often each successor was right in a row, and whether both orders name the same
id, select one of 32 sets of mixing weights.  Weights follow how often each
prediction was right (recounted every `REFRESH` ids), so the mixture adapts.  An id
that order 2 names is coded in order 2's share, else in order 1's, else in order 0's,
else as novel.  An arithmetic coder with a 62-bit range and 32-bit digits writes it.

All blocks of a segment are coded side by side: place t of every block is one numpy
step.  The writer knows all ids, so its models are computed for whole segments by
sorting, and only the arithmetic goes step by step; the reader's models go in step.

Empty documents are legal (length 0, or just the end id); an empty table gives an
empty file; ids from 0 to 65,535 are coded, larger ones are refused.  Rows of null
doc_id have no place in the order and are left out; rows of equal doc_id stand one
after the other, by text.  A very long text is encoded in one step (tens of bytes of
memory for each of its bytes) and runs over as many blocks as it needs.  Columns
other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postbag.llm import common
from postbag.llm.tokens import encoder, vocabulary_path

MAGIC = b"PBRC2\0"
BLOCK = 4096
#: Ids of a segment after which it is closed; it is coded in one go.
SEGMENT = 8 << 20
#: Bytes of text that a partition of the writer should hold, so that its ids fill most of
#: one segment: a step over many blocks costs little more than one over few.
PART_BYTES = 44_000_000
REFRESH = 128
#: Bits of the slot number of orders 1 and 2.
_B1, _B2 = 11, 12
_STATES = 32
_TOP, _LOW, _MASK = np.int64(1) << 62, np.int64(1) << 30, (1 << 30) - 1
#: Blocks whose models the writer computes at a time.
_GROUP = 64
#: First guesses of how often order 2, order 1, order 0, none is right.
_PRIOR = np.array([8, 5, 12, 6], np.int32)
_FLOOR = 16


def epochs(block: int) -> list[int]:
    """Places at which order 0 counts anew: close together at first, then every 1,024 ids, to 2,048."""
    return [e for e in (0, 64, 256, 1024, 2048) if e < block]


def _contexts(p1: np.ndarray, p2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slot, tag) of order 1 and of order 2, from the last id and the one before."""
    h2 = p1 * 0x9E3779B1
    h2 += p2 * 0x85EBCA77
    h2 >>= 8
    h2 &= (1 << (_B2 + 12)) - 1
    return p1 & ((1 << _B1) - 1), p1 >> _B1, h2 >> 12, h2 & 0xFFF


class _Weights:
    """Adaptive mixing weights of `n` blocks, as upper ends of the shares (of 4,096) by state."""

    def __init__(self, n: int):
        self.right = np.tile(_PRIOR, (n * _STATES, 1))
        state = np.tile(np.arange(_STATES), n)
        s2, s1, agree = state >> 3, (state >> 1) & 3, state & 1
        self.on = np.ones((n * _STATES, 4), bool)
        self.on[:, 0], self.on[:, 1] = s2 > 0, (s1 > 0) & (agree == 0)

    def ends(self, seen: bool) -> np.ndarray:
        """Ends of the shares of orders 2, 1 and 0, 13 bits each; order 0 has none before anything was seen."""
        on = self.on if seen else self.on & np.array([True, True, False, True])
        right = self.right * on
        share = (right * np.int32(4096 - 4 * _FLOOR) // right.sum(1, dtype=np.int32)[:, None] + _FLOOR) * on
        a = share[:, 0].astype(np.int64)
        b = a + share[:, 1]
        return a | b << 13 | (b + share[:, 2]) << 26

    def learn(self, cells: np.ndarray) -> None:
        """Count cells (state of a block times four, plus kind); old counts fade."""
        self.right += np.bincount(cells, minlength=self.right.size).astype(np.int32).reshape(-1, 4)
        old = self.right.sum(1) > 400
        self.right[old] = (self.right[old] + 1) >> 1


class _Novel:
    """Adaptive counts of the high part of novel ids."""

    def __init__(self, n: int):
        self.count = np.ones((n, 256), np.int32)
        self.cum = np.zeros((n, 257), np.int32)
        self.refresh()

    def refresh(self) -> None:
        freq = self.count * np.int32(4096 - 256) // self.count.sum(1, dtype=np.int32)[:, None] + 1
        freq[np.arange(len(freq)), freq.argmax(1)] += 4096 - freq.sum(1, dtype=np.int32)
        np.cumsum(freq, axis=1, out=self.cum[:, 1:])

    def slots(self) -> np.ndarray:
        """For each of the 4,096 places the high part (8 bits), its begin and size (12 bits each), for decoding."""
        size = np.diff(self.cum, axis=1)
        entry = np.arange(256, dtype=np.uint32) | (self.cum[:, :-1].astype(np.uint32) << np.uint32(8)) | (size.astype(np.uint32) << np.uint32(20))
        return np.repeat(entry.ravel(), size.ravel())

    def learn(self, cells: np.ndarray) -> None:
        self.count += 4 * np.bincount(cells, minlength=self.count.size).astype(np.int32).reshape(-1, 256)


def _successors(ids: np.ndarray, slot: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """For each place the successor that its slot names and its run (1 to 3) above bit 16; 0 if none.

    Places of a slot are neighbours after a stable sort, so the entry that a place
    finds is its left neighbour, and its run is that of the neighbours before.
    """
    n, block = ids.shape
    order = np.argsort(slot.astype(np.uint16), axis=1, kind="stable")
    order += (np.arange(n) * block)[:, None]
    order = order.ravel()
    key = ((slot << 16) | tag).ravel()[order]
    sym = ids.ravel()[order]
    valid = np.zeros(n * block, bool)
    valid[1:] = key[1:] == key[:-1]
    valid[::block] = False
    hit = np.zeros(n * block + 2, np.int32)
    hit[3:] = valid[1:] & (sym[1:] == sym[:-1])
    run = 1 + hit[1:-1] + (hit[1:-1] & hit[:-2])  # hits at the one and the two places before
    out = np.zeros(n * block, np.int32)
    out[1:] = np.where(valid[1:], sym[:-1] | (run[1:] << 16), 0)
    back = np.empty_like(out)
    back[order] = out
    return back.reshape(n, block)


def _shares(grid: np.ndarray, length: np.ndarray, start: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, ...]:
    """Models of the blocks (rows) of `grid`: fills in each id's begin and size within its range.

    Returned are place, block, begin and size of the novel ids inside the novel share.
    `length` is the ids of each block.
    """
    n, block = grid.shape
    p1, p2 = np.zeros((n, block), np.int64), np.zeros((n, block), np.int64)
    p1[:, 1:], p2[:, 2:] = grid[:, :-1], grid[:, :-2]
    slot1, tag1, slot2, tag2 = _contexts(p1, p2)
    e1, e2 = _successors(grid, slot1, tag1), _successors(grid, slot2, tag2)
    s1, s2 = e1 >> 16, e2 >> 16
    e1 &= 0xFFFF
    e2 &= 0xFFFF
    hit2, hit1 = (e2 == grid) & (s2 > 0), (e1 == grid) & (s1 > 0)
    state = (s2 << 3) + (s1 << 1)
    state += (e1 == e2) & (s1 > 0) & (s2 > 0)
    kind = np.where(hit2, 0, np.where(hit1, 1, 3)).astype(np.int8)
    lane = np.arange(n, dtype=np.int32)[:, None]
    keys = grid | (lane << 16)
    place, many = np.zeros((n, block), np.int32), np.ones((n, block), np.int32)
    marks = epochs(block)
    for a, b in zip(marks[1:], [*marks[2:], block], strict=True):
        many[:, a:b] = a
        held = np.sort(grid[:, :a].astype(np.uint16), axis=1) | (lane << 16)
        held = held.ravel()
        edge = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
        size, name = np.diff(np.append(edge, len(held))), held[edge]
        at = np.flatnonzero(kind[:, a:b] == 3)
        rows, cols = at // (b - a), at % (b - a) + a
        at = rows * block + cols
        wanted = keys.take(at)
        run = np.minimum(np.searchsorted(name, wanted), len(edge) - 1)
        met = name[run] == wanted
        at, run = at[met], run[met]
        kind.reshape(-1)[at] = 2
        place.reshape(-1)[at] = edge[run] - rows[met] * a
        many.reshape(-1)[at] = size[run]
    weights, novel = _Weights(n), _Novel(n)
    state += lane * _STATES
    epoch, fresh = 0, []
    cuts = sorted({*range(0, block, REFRESH), *marks})
    whole = bool((length == block).all())
    for a, b in zip(cuts, [*cuts[1:], block], strict=True):
        if a in marks and a:
            epoch = a
            novel.refresh()
        cell, k = state[:, a:b], kind[:, a:b]
        found = weights.ends(epoch > 0).take(cell)
        ends = np.stack([np.zeros_like(found), found & 8191, (found >> 13) & 8191, found >> 26, np.full_like(found, 4096)])
        at = np.arange(k.size).reshape(k.shape) + k * np.int64(k.size)
        low = ends.take(at)
        at += k.size
        width = ends.take(at) - low
        total = max(epoch, 1)
        start[:, a:b] = low * total + width * place[:, a:b]
        part[:, a:b] = width * np.where(k == 2, many[:, a:b], total)
        live = k >= 0 if whole else np.arange(a, b)[None] < length[:, None]
        weights.learn(((cell << 2) + k)[live])
        rows, cols = np.nonzero((k == 3) & live)
        sym = grid[rows, cols + a]
        f0 = novel.cum[rows, sym >> 8]
        f = novel.cum[rows, (sym >> 8) + 1] - f0
        fresh.append((cols + a, rows, (f0 << 8) + (sym & 255) * f, f))
        novel.learn(rows * 256 + (sym >> 8))
    return tuple(np.concatenate(x) for x in zip(*fresh, strict=True))


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit digits of all blocks one after the other, digits per block)."""
    n = -(-len(ids) // block)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    last = len(ids) - (n - 1) * block
    grid = np.zeros(n * block, np.int32)
    grid[: len(ids)] = ids
    grid = grid.reshape(n, block)
    length = np.full(n, block)
    length[-1] = last
    start, part = np.empty((block, n), np.int32), np.empty((block, n), np.int32)
    fresh = []
    for i in range(0, n, _GROUP):
        j = min(n, i + _GROUP)
        x, y = np.empty((j - i, block), np.int32), np.empty((j - i, block), np.int32)
        when, row, low, width = _shares(grid[i:j], length[i:j], x, y)
        start[:, i:j], part[:, i:j] = x.T, y.T
        fresh.append((when, row + i, low, width))
    when, row, fresh_low, fresh_width = (np.concatenate(x) for x in zip(*fresh, strict=True))
    order = np.argsort(when.astype(np.uint16), kind="stable") if block <= 1 << 16 else np.argsort(when, kind="stable")
    row, fresh_low, fresh_width = row[order], fresh_low[order].astype(np.int64), fresh_width[order].astype(np.int64)
    ends = np.searchsorted(when[order], np.arange(block + 1)).tolist()
    digits = np.zeros((block + 8, n), np.int64)
    flat = digits.reshape(-1)
    low, width = np.zeros(n, np.int64), np.full(n, _TOP, np.int64)
    at = np.arange(n, dtype=np.int64)
    left = epochs(block)[1:]
    total, k = 4096, n
    for t in range(block if n > 1 else last):
        if t == last and n > 1:
            k = n - 1
        if left and t == left[0]:
            total = 4096 * left.pop(0)
        unit = width[:k] // total
        low[:k] += unit * start[t, :k]
        unit *= part[t, :k]
        i, j = ends[t], ends[t + 1]
        if j > i:
            rest = row[i:j]
            fine = unit.take(rest) >> 20
            low[rest] += fine * fresh_low[i:j]
            unit[rest] = fine * fresh_width[i:j]
        width[:k] = unit
        small = np.flatnonzero(unit < _LOW)
        if len(small):  # one digit is enough: no share is below 2**-30 of the range
            x, spot = low.take(small), at.take(small)
            flat[spot] = x >> 30
            x &= _MASK
            x <<= 32
            low[small] = x
            width[small] <<= 32
            spot += n
            at[small] = spot
    flat[at] = low >> 30
    at += n
    flat[at] = (low & _MASK) << 2
    at += n
    used = (at - np.arange(n)) // n
    carry = np.zeros(n, np.int64)
    for row_ in digits[: int(used.max())][::-1]:
        row_ += carry
        carry = row_ >> 32
        row_ &= 0xFFFFFFFF
    keep = np.arange(int(used.max()))[None, :] < used[:, None]
    return digits[: int(used.max())].T[keep].astype("<u4"), used


def decode_blocks(words: np.ndarray, used: np.ndarray, size: int, block: int = BLOCK) -> np.ndarray:
    n = len(used)
    if n == 0:
        return np.zeros(0, np.uint16)
    last = size - (n - 1) * block
    source = np.concatenate([words, np.zeros(3, np.uint32)]).astype(np.int64)
    at = np.cumsum(used) - used
    code = (source[at] << 30) | (source[at + 1] >> 2)
    at = np.minimum(at + 1, len(source) - 2)
    # what a shift brings in: two bits of a digit and thirty of the next
    source = ((source[:-1] & 3) << 30) | (source[1:] >> 2)
    end = len(source) - 1
    width = np.full(n, _TOP, np.int64)
    lane = np.arange(n, dtype=np.int64)
    # successors of order 1, then of order 2: id, run above it, tag above both
    table = np.zeros((n << _B1) + (n << _B2), np.int32)
    base = np.stack([lane << _B1, (n << _B1) + (lane << _B2)])
    weights, novel = _Weights(n), _Novel(n)
    slots = novel.slots()
    ends = weights.ends(False)
    p1, p2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
    steps = block if n > 1 else last
    out = np.zeros((steps, n), np.uint16)
    cells = np.zeros((REFRESH, n), np.int32)
    marks = set(epochs(block))
    epoch, done, k = 0, 0, n
    slot, tag, state0 = np.empty((2, n), np.int64), np.empty((2, n), np.int64), lane << 5
    fresh_cells = [np.zeros(0, np.int64)]
    first_of, most, runs = lane, n - 1, None
    for t in range(steps):
        if t == last and n > 1:  # the last block has ended
            k = n - 1
            slot, tag, base, state0, code, width, p1, p2, first_of, at = (x[..., :k] for x in (slot, tag, base, state0, code, width, p1, p2, first_of, at))
        if t and (t in marks or t % REFRESH == 0):
            weights.learn(cells[: t - done, : n if last >= t else n - 1].ravel())
            done = t
            if t in marks:
                epoch = t
                novel.learn(np.concatenate(fresh_cells))
                fresh_cells = [fresh_cells[0]]
                novel.refresh()
                slots = novel.slots()
                held = np.sort(np.ascontiguousarray(out[:t].T), axis=1)
                new = np.ones((n, t), bool)
                np.not_equal(held[:, 1:], held[:, :-1], out=new[:, 1:])
                held = held.ravel()
                edge = np.flatnonzero(new)
                length = np.diff(np.append(edge, n * t))
                # for each place: where the id's run begins in its block, its length, the id
                runs = np.repeat((edge % t << 29) | (length << 16) | held[edge], length)
                first_of, most = lane[:k] * t, n * t - 1
            ends = weights.ends(epoch > 0)
        slot[0], tag[0], slot[1], tag[1] = _contexts(p1, p2)
        slot += base
        found = table.take(slot).astype(np.int64)
        run = found >> 16
        run &= 3
        np.multiply(run, (found >> 18) == tag, out=run)
        found &= 0xFFFF
        c1, c2 = found
        state = run[1] << 2
        state += run[0]
        state <<= 1
        state += (c1 == c2) & (run[0] > 0) & (run[1] > 0)
        state += state0
        share = ends.take(state)
        total = max(epoch, 1)
        unit = width // (4096 * total)
        step = unit * total
        x = (share & 8191) * step
        share >>= 13
        b = (share & 8191) * step
        by2 = code < x
        other = code >= b
        sym = np.where(by2, c2, c1)
        low = np.where(by2, 0, x)
        b -= x
        wide = np.where(by2, x, b)
        state <<= 2
        state += other
        state += ~by2
        # order 0's share, taken for all blocks and used where neither successor was right
        y = share & 8191
        share >>= 13
        share -= y
        share *= unit
        y *= step
        m = code - y
        if epoch:
            j = (m / share).astype(np.int64)  # a double may miss the floor by one
            m -= j * share
            j -= m < 0
            j += m >= share
            j += first_of
            np.maximum(j, 0, out=j)
            np.minimum(j, most, out=j)
            run0 = runs.take(j)
            sym = np.where(other, run0 & 0xFFFF, sym)
            run0 >>= 16
            wide = np.where(other, (run0 & 8191) * share, wide)
            run0 >>= 13
            run0 *= share
            run0 += y
            low = np.where(other, run0, low)
        share *= total
        share += y
        fresh = code >= share
        state += fresh
        new = np.flatnonzero(fresh)
        if len(new):
            top = share.take(new)
            fine = (step.take(new) * 4096 - top) >> 20
            value = np.minimum((code.take(new) - top) // fine, (1 << 20) - 1)
            entry = slots.take((new << 12) + (value >> 8)).astype(np.int64)
            high = entry & 255
            f = entry >> 20
            f0 = entry & 0xFFF00
            byte = (value - f0) // f
            f0 += byte * f
            low[new] = top + fine * f0
            wide[new] = fine * f
            sym[new] = (high << 8) | byte
            fresh_cells.append((new << 8) + high)
        code -= low
        cells[t - done, :k] = state
        # a run grows by a hit, else the slot begins anew with this id
        run *= found == sym
        run += 1
        np.minimum(run, 3, out=run)
        run <<= 16
        run |= sym
        run |= tag << 18
        table[slot] = run
        p2, p1 = p1, sym
        out[t, :k] = sym
        # where the range is narrow a digit comes in
        small = wide < _LOW
        shift = small * np.int64(32)
        wide <<= shift
        width = wide
        code <<= shift
        code |= source.take(at) * small
        at += small
        np.minimum(at, end, out=at)
    return np.ascontiguousarray(out.T).reshape(-1)[:size] if n > 1 else out[:, 0].copy()


def pack(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """One self-contained segment: header, block index with checksums, digits."""
    if len(ids) and int(ids.max()) > 65_535:
        raise ValueError("ids above 65,535 are not coded by this format")
    words, used = encode_blocks(ids, block)
    raw = np.ascontiguousarray(ids, "<u2")
    sums = np.array([zlib.crc32(raw[i : i + block]) for i in range(0, len(raw), block)], "<u4")
    return MAGIC + struct.pack("<IQI", block, len(ids), len(used)) + used.astype("<u4").tobytes() + sums.tobytes() + words.tobytes()


def unpack(data: bytes) -> np.ndarray:
    """The ids of a segment; ValueError names the first damaged block."""
    if data[:6] != MAGIC:
        raise ValueError("not a segment of this format")
    block, total, n = struct.unpack_from("<IQI", data, 6)
    at = 6 + struct.calcsize("<IQI")
    used = np.frombuffer(data, "<u4", n, at).astype(np.int64)
    sums = np.frombuffer(data, "<u4", n, at + 4 * n)
    words = np.frombuffer(data, "<u4", -1, at + 8 * n)
    if len(words) != used.sum():
        raise ValueError("segment is cut short")
    ids = decode_blocks(words, used, total, block)
    for i in range(n):
        if zlib.crc32(np.ascontiguousarray(ids[i * block : (i + 1) * block], "<u2")) != sums[i]:
            raise ValueError(f"block {i}: checksum differs")
    return ids


_FILE = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("doc_tokens", pa.binary()), ("data", pa.binary())])


def write_tokens(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end: int = 1, block: int = BLOCK) -> DataFrame:
    """Encode `docs` (doc_id, text) in ascending doc_id order; the written file, a row per segment.

    Rows are dealt by ranges of doc_id and sorted inside each, so the order of
    (part, segment) is that of doc_id.  Null texts hold just the end id.
    """
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(vocabulary_path(vocabulary))
        ids, names, sizes, held, number = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            row = [[part], [number], [len(flat)], [np.concatenate(names).astype("<i8").tobytes()], [np.concatenate(sizes).astype("<i8").tobytes()], [pack(flat, block)]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, _FILE, strict=True)], schema=_FILE)

        for b in common.slices(batches, "text"):
            flat, counts = enc.encode(b.column("text"), end)
            ids.append(flat)
            names.append(np.asarray(b.column("doc_id")))
            sizes.append(counts)
            held += len(flat)
            if held >= SEGMENT:
                yield close()
                ids, names, sizes, held, number = [], [], [], 0, number + 1
        if ids:
            yield close()

    rows = common.doc_ids_and_text(docs).where("doc_id is not null")
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    most = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(max(1, min(most, -(-held // PART_BYTES))), "doc_id").sortWithinPartitions("doc_id", "text")
    out = rows.mapInArrow(run, "part int, segment int, n_tokens long, doc_ids binary, doc_tokens binary, data binary")
    return common.written(out, "tokens", "none")


def offsets(file: DataFrame) -> DataFrame:
    """Ids before each segment: sums within a part, then over parts."""
    per = file.select("part", "segment", "n_tokens")
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = per.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "before")
    return per.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part").select("part", "segment", (F.col("before") + F.col("inside")).alias("offset"))


def read_documents(file: DataFrame) -> DataFrame:
    """Documents of a written file: doc_id, start, n_tokens, ids_crc32, part, segment."""
    common.ship(file.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, segment, names, sizes, data in zip(*(b.column(c) for c in ("part", "segment", "doc_ids", "doc_tokens", "data")), strict=True):
                ids = unpack(data.as_buffer().to_pybytes()).astype("<u4")
                count = np.frombuffer(sizes.as_py(), "<i8")
                stop = np.cumsum(count)
                edge = [0, *stop.tolist()]
                sums = np.array([zlib.crc32(ids[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True)], np.int64)
                n = len(count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(names.as_py(), "<i8")), pa.array(stop - count), pa.array(count), pa.array(sums), pa.array(np.full(n, part.as_py(), np.int32)), pa.array(np.full(n, segment.as_py(), np.int32))],
                    names=["doc_id", "local", "n_tokens", "ids_crc32", "part", "segment"],
                )

    rows = file.select("part", "segment", "doc_ids", "doc_tokens", "data").mapInArrow(run, "doc_id long, local long, n_tokens long, ids_crc32 long, part int, segment int")
    return rows.join(offsets(file), ["part", "segment"]).select("doc_id", (F.col("offset") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
