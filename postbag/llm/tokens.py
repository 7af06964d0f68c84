"""Word-level cached encoding with a public tokenizer file.

Ids equal those of `Tokenizer.encode(text, add_special_tokens=False)`.  The
tokenizer drops white space before its merges, so a text may be cut at ASCII white
space without changing its ids; each distinct chunk is then encoded once per
worker and found again by a 64-bit hash of its bytes.  Hashes are taken for all
chunks of a batch at once from one running sum over its bytes, so the cost of a
word that was met before is a few array reads.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa

from postbag.llm.common import plain

#: Letters whose lower-casing and normal form do not depend on their neighbours.
_SIMPLE = re.compile(r"([!-&(-/:-@\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
#: Chunks kept per worker; beyond it the table starts anew, so memory is bounded.
CACHE_CHUNKS = 2_500_000
#: Letter runs kept per worker, so that "word," and "word." share their merges.
CACHE_RUNS = 300_000
#: Longer chunks are hashed one by one with a cryptographic hash.
LONG = 64
#: Bytes that running sums are taken over at a time.
PIECE = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MIX = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def byte_level() -> dict[int, int]:
    """Byte values that byte-level vocabularies write as another character."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(hidden)}


class Words:
    """Chunks between ASCII white space in an array of texts, with a hash of each."""

    powers = inverses = np.zeros(0, np.uint64)

    def __init__(self, texts: pa.Array):
        texts = plain(texts)
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        whole = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.data = data = whole[offsets[0] : offsets[-1]]
        self.bounds = offsets - offsets[0]
        n = len(data)
        space = _SPACE[data]
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        inner = self.bounds[(self.bounds > 0) & (self.bounds < n)]
        before[inner], after[inner - 1] = True, True
        np.logical_not(space, out=space)
        self.start = np.flatnonzero(before & space)
        self.end = np.flatnonzero(after & space) + 1
        self.first = np.searchsorted(self.start, self.bounds)

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode()

    def hashes(self) -> np.ndarray:
        """A hash of each chunk's bytes; sums run over pieces of `PIECE` bytes, so memory does not grow with a batch."""
        if len(Words.powers) < PIECE + LONG + 1:
            step = np.full(PIECE + LONG + 1, _BASE, np.uint64)
            step[0] = 1
            Words.powers = np.cumprod(step)
            step[1:] = _INVERSE
            Words.inverses = np.cumprod(step)
        size = (self.end - self.start).astype(np.uint64)
        h = np.empty(len(size), np.uint64)
        cuts = np.searchsorted(self.start, np.arange(0, len(self.data) + PIECE, PIECE))
        run = np.zeros(PIECE + LONG + 1, np.uint64)
        for i, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if lo == hi:
                continue
            first = i * PIECE
            start = self.start[lo:hi] - first
            end = np.minimum(self.end[lo:hi] - first, start + LONG)
            terms = _MIX[self.data[first : first + int(end[-1])]]
            terms *= Words.powers[: len(terms)]
            np.cumsum(terms, out=run[1 : len(terms) + 1])
            h[lo:hi] = (run[end] - run[start]) * Words.inverses[start]
        h ^= size * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        for i in np.flatnonzero(size > LONG):
            h[i] = int.from_bytes(hashlib.blake2b(self.data[self.start[i] : self.end[i]].tobytes(), digest_size=8).digest(), "little")
        h[h == 0] = 1
        return h


class HashTable:
    """uint64 keys (not 0) to the order in which they were added, in arrays."""

    def __init__(self, bits: int = 16):
        self.clear(bits)

    def clear(self, bits: int = 16) -> None:
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int32)
        self.count = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it is new."""
        at = (h & np.uint64(self.mask)).astype(np.int64)
        key = self.keys[at]
        out = self.values[at]
        out[key == 0] = -1
        left = np.flatnonzero((key != h) & (key != 0))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            key = self.keys[at]
            hit = key == h[left]
            out[left[hit]] = self.values[at[hit]]
            out[left[key == 0]] = -1
            more = ~hit & (key != 0)
            left, at = left[more], at[more]
        return out

    def add(self, h: np.ndarray) -> None:
        """Number distinct new keys in order."""
        while 2 * (self.count + len(h)) > self.mask:
            used = np.flatnonzero(self.keys)
            keys, values = self.keys[used], self.values[used]
            count = self.count
            self.clear(int(self.mask).bit_length() + 1)
            self._put(keys, values)
            self.count = count
        self._put(h, np.arange(self.count, self.count + len(h), dtype=np.int32))
        self.count += len(h)

    def _put(self, h: np.ndarray, values: np.ndarray) -> None:
        at = (h & np.uint64(self.mask)).astype(np.int64)
        while len(h):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[free]
            mine = self.keys[at] == h
            self.values[at[mine]] = values[mine]
            rest = ~mine
            h, values, at = h[rest], values[rest], (at[rest] + 1) & self.mask


class ChunkEncoder:
    """Encodes arrays of texts to one flat array of ids.

    `special_as_text`: strings of special tokens inside a text are ordinary text.
    Null texts have no ids.
    """

    def __init__(self, path: str, special_as_text: bool = False, cache: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = special_as_text
        self.model = self.full.model
        self.vocab_size = self.full.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocab_size <= 65_536 else "<u4")
        self.limit, self.table = cache, HashTable()
        self.shift = byte_level()
        pre = self.full.pre_tokenizer
        probe = "the, end"
        #: Whether a letter run alone has the ids that it has between marks.
        self.simple = pre is not None and self.full.encode(probe, add_special_tokens=False).ids == [k for part in ("the", ",", "end") for k in self._merge(part)]
        self._clear()

    def _clear(self) -> None:
        self.table.clear()
        self.runs: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.pool = np.zeros(1 << 16, self.dtype)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int32)

    def _merge(self, run: str) -> list[int]:
        return [k.id for k in self.model.tokenize(run if run.isascii() else run.encode().decode("latin-1").translate(self.shift))]

    def _bytes(self, chunk: str) -> bytes:
        m = _SIMPLE(chunk) if self.simple and "<|" not in chunk else None
        if m is None:
            return np.array(self.full.encode(chunk, add_special_tokens=False).ids, self.dtype).tobytes()
        lead, run, trail = m.groups()
        run = run.lower()
        ids = self.runs.get(run)
        if ids is None:
            if len(self.runs) >= CACHE_RUNS:
                self.runs.clear()
            self.runs[run] = ids = np.array(self._merge(run), self.dtype).tobytes()
        if lead or trail:
            for k in (lead, trail):
                if k not in self.marks:
                    if len(self.marks) > 50_000:
                        self.marks = {"": b"", lead: self.marks.get(lead, b"")}
                    self.marks[k] = np.array(self.full.encode(k, add_special_tokens=False).ids, self.dtype).tobytes()
            ids = self.marks[lead] + ids + self.marks[trail]
        return ids

    def _learn(self, hashes: np.ndarray, chunks: list[str]) -> None:
        got = [self._bytes(c) for c in chunks]
        size = self.dtype.itemsize
        lengths = np.fromiter((len(b) // size for b in got), np.int64, len(got))
        flat = np.frombuffer(b"".join(got), self.dtype)
        n, at = self.table.count, self.used
        while at + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + len(got) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.pool[at : at + len(flat)] = flat
        self.start[n : n + len(got)] = at + np.cumsum(lengths) - lengths
        self.length[n : n + len(got)] = lengths
        self.table.add(hashes)
        self.used += len(flat)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, ids per text).  `end`: an id added after each text."""
        words = Words(texts)
        h = words.hashes()
        if self.table.count > self.limit:
            self._clear()
        slot = self.table.find(h)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            fresh, where = np.unique(h[missing], return_index=True)
            self._learn(fresh, [words.text(i) for i in missing[where]])
            slot[missing] = self.table.find(h[missing])
        lengths = self.length[slot].astype(np.int64)
        stop = np.cumsum(lengths)
        bound = np.concatenate([[0], stop])
        counts = np.diff(bound[words.first])
        total = int(bound[-1])
        begin = self.start[slot]
        if end is None:
            begin -= stop - lengths
            index = np.repeat(begin, lengths)
            index += np.arange(total)
            return self.pool[index], counts
        # each text's end is one more entry, taken from the pool's last place
        out = np.empty(total + len(counts), self.dtype)
        begin -= stop - lengths
        index = np.repeat(begin, lengths)
        index += np.arange(total)
        ends = np.cumsum(counts + 1) - 1
        keep = np.ones(len(out), bool)
        keep[ends] = False
        out[keep] = self.pool[index]
        out[ends] = end
        return out, counts + 1


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, special_as_text: bool = False) -> ChunkEncoder:
    """One encoder per worker process and tokenizer file."""
    key = (path, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, special_as_text)
    return _ENCODERS[key]


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies; looked up on the machine that uses it."""
    import public_tokenizers

    return public_tokenizers.path(name)
