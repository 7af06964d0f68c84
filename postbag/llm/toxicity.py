"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text, each
on all windows of eight words of its own class.  The trained bytes stay whole; the
rest of a dictionary's size holds the most usual words of its class in a fixed
frame.  (The frame keeps a window above the size below which zstandard stores bytes
as they are, and ties a match to the start or end of the word.)  Every window of one
framed word of a document is compressed with either dictionary; ordinary length less
toxic length is its distance.  A window counts as toxic from a threshold on,
calibrated on labelled documents that the dictionaries have not seen; number, share,
sum and maximum of a document's distances go through a logistic calibration to a
score from 0 to 1.
A worker compresses each distinct word once and finds it again by a hash.

Null and empty texts have no window; their score is the calibration's value at
zero distances.  Whole texts are read; equal texts have equal scores.  An empty table
gives no rows; without labels of both kinds every score is their smoothed share.
Rows of null doc_id are scored, not learned from; repeated rows are scored each for
itself.  A very long text is one step of a worker (tens of bytes of memory for each
of its bytes).  Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postbag.llm import common
from postbag.llm.tokens import HashTable, Words

#: Labelled documents that the model is fitted on, at most (about).
FIT_ROWS = 8_000
#: Words of a window that a dictionary is trained on.
TRAIN_WORDS = 8
DICTIONARY = 65_536
#: Distinct words whose distance a worker keeps.
CACHE_WORDS = 2_500_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BEFORE, _AFTER = b"\x01\x02\x03\x04\x05\x06", b"\x06\x05\x04\x03\x02\x01"


def framed(word: bytes) -> bytes:
    return _BEFORE + b" " + word + b" " + _AFTER


def _train(texts: list[str], size: int) -> bytes:
    """A dictionary of at most `size` bytes: what zstandard learns from all windows of
    the texts, then framed words, the most usual ones last, where offsets are short."""
    windows, count = [], Counter()
    for t in pc.utf8_lower(pa.array(texts, pa.string())).to_pylist():
        words = _WORD.findall(t)  # the words that scoring finds
        count.update(words)
        windows += [f" {' '.join(words[i : i + TRAIN_WORDS])} ".encode() for i in range(0, len(words), TRAIN_WORDS)]
    trained = b""
    if len(windows) > 50:
        try:
            trained = zstandard.train_dictionary(size // 4, windows).as_bytes()
        except zstandard.ZstdError:  # too few or too equal samples for the trainer
            trained = b""
    room, usual = size - len(trained), []
    for w, _ in count.most_common():
        word = framed(w.encode())
        if len(word) <= room:  # a word too long for the rest leaves it to shorter ones
            usual.append(word)
            room -= len(word)
    return trained + b"".join(reversed(usual)) or framed(b"")


class Model:
    """Dictionaries, window threshold and calibration; small enough to send to workers."""

    def __init__(self, ordinary: bytes, toxic: bytes, threshold: int, weights: list[float], scale: list[list[float]]):
        self.ordinary, self.toxic, self.threshold, self.weights, self.scale = ordinary, toxic, threshold, weights, scale
        self._tools = None

    def __getstate__(self):
        return self.__dict__ | {"_tools": None}

    def _open(self):
        if self._tools is None:
            out = []
            for raw in (self.ordinary, self.toxic):
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                p = zstandard.ZstdCompressionParameters(window_log=18, hash_log=16, chain_log=17, search_log=6, min_match=3, target_length=64, strategy=zstandard.STRATEGY_BTOPT, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
                d.precompute_compress(compression_params=p)
                out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress)
            self._tools = [out[0], out[1], HashTable(), np.zeros(1 << 14, np.int32)]
        return self._tools

    def distances(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(distance of each word of all texts in order, first word of each text and the end)."""
        ordinary, toxic, table, known = self._open()
        words = Words(pc.utf8_lower(common.plain(texts).cast(pa.string()).fill_null("")))
        h = words.hashes()
        if table.count > CACHE_WORDS:
            table.clear()
        slot = table.find(h)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            fresh, where = np.unique(h[missing], return_index=True)
            at = missing[where]
            new = np.empty(len(at), np.int32)
            data, start, end = words.data, words.start, words.end
            for i, k in enumerate(at.tolist()):
                w = framed(data[start[k] : end[k]].tobytes())
                new[i] = len(ordinary(w)) - len(toxic(w))
            n = table.count
            while n + len(new) > len(known):
                known = self._tools[3] = np.concatenate([known, np.zeros_like(known)])
            known[n : n + len(new)] = new
            table.add(fresh)
            slot[missing] = table.find(h[missing])
        return known[slot], words.first

    @staticmethod
    def summary(distances: np.ndarray, first: np.ndarray, threshold: int) -> np.ndarray:
        """A row per text: log count, log sum, root of the share and maximum of toxic windows."""
        over = distances >= threshold
        held = np.where(over, distances, 0)
        n = np.diff(first)
        count = np.diff(np.concatenate([[0], np.cumsum(over)])[first]).astype(float)
        total = np.diff(np.concatenate([[0], np.cumsum(held)])[first]).astype(float)
        top = np.zeros(len(n))
        some = n > 0
        if some.any():
            top[some] = np.maximum.reduceat(held, first[:-1][some])
        return np.stack([np.log1p(count), np.log1p(np.maximum(total, 0)), np.sqrt(count / (n + 3)), top], 1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        x = self.summary(*self.distances(texts), self.threshold)
        x = (x - np.array(self.scale[0])) / np.array(self.scale[1])
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights[1:]) + self.weights[0], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.diag([1e-6] + [1] * x.shape[1])
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * np.concatenate([[0], w[1:]]))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str], labels: list[int]) -> Model:
    """Dictionaries from even rows, threshold and calibration from odd rows."""
    rows = [(t or "", y) for t, y in zip(texts, labels, strict=True)]
    train, held = rows[::2], rows[1::2]
    toxic = [t for t, y in train if y]
    ordinary = [t for t, y in train if not y]
    model = Model(_train(ordinary, DICTIONARY), _train(toxic, DICTIONARY), 1, [0.0] * 5, [[0.0] * 4, [1.0] * 4])
    found = model.distances(pa.array([t for t, _ in held], pa.string()))
    y = np.array([k for _, k in held], float)
    if len(y) == 0 or y.min() == y.max():
        share = (sum(k for _, k in rows) + 0.5) / (len(rows) + 1)
        model.weights[0] = float(np.log(share / (1 - share)))
        return model
    best = None
    for threshold in range(1, 13):
        x = Model.summary(*found, threshold)
        scale = [x.mean(0).tolist(), np.maximum(x.std(0), 1e-6).tolist()]
        z = (x - scale[0]) / scale[1]
        w = _logistic(z, y)
        p = np.clip(1 / (1 + np.exp(-np.clip(z @ w[1:] + w[0], -30, 30))), 1e-6, 1 - 1e-6)
        loss = -float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
        if best is None or loss < best[0]:
            best = (loss, threshold, w.tolist(), scale)
    _, model.threshold, model.weights, model.scale = best
    return model


def fit_table(docs: DataFrame, labels: DataFrame, label: str, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on at most about `fit_rows` labelled rows, chosen by a hash of doc_id.

    The fit is one task, so no text comes to the driver; only the model does.
    """
    common.ship(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    share = min(1.0, fit_rows / max(1, known.count()))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))
    # a document under several labels counts as the lowest of them
    wanted = known.where(chosen).groupBy("doc_id").agg(F.min("y").alias("y"))
    rows = common.doc_ids_and_text(docs).where(chosen).join(wanted, "doc_id").repartition(1).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for b in batches:
            texts += b.column("text").to_pylist()
            y += b.column("y").to_pylist()
        m = fit(texts, y)
        cells = [[m.ordinary], [m.toxic], [m.threshold], [list(map(float, m.weights))], [list(map(float, m.scale[0]))], [list(map(float, m.scale[1]))]]
        kinds = (pa.binary(), pa.binary(), pa.int32(), *[pa.list_(pa.float64())] * 3)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["ordinary", "toxic", "threshold", "weights", "centre", "spread"])

    got = rows.mapInArrow(run, "ordinary binary, toxic binary, threshold int, weights array<double>, centre array<double>, spread array<double>").collect()  # one row
    if not got:
        return fit([], [])
    r = got[0]
    return Model(bytes(r.ordinary), bytes(r.toxic), r.threshold, list(r.weights), [list(r.centre), list(r.spread)])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every whole text."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(b.column("text")))], names=["doc_id", "score"])

    return common.doc_ids_and_text(docs).mapInArrow(run, "doc_id long, score double")
