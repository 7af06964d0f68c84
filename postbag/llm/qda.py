"""Quality classification by a regularised quadratic discriminant.

A document is a vector of transformed statistics (lengths, kinds of characters,
repetition of words and lines).  Each class has a mean and a covariance, shrunk
towards the pooled covariance and its diagonal by weights chosen on held-back
training rows; the Cholesky factor of each is computed once.  The score is the
logistic of the difference of log-densities (Mahalanobis distances plus
determinants) and log priors, scaled by a slope fitted on the same rows.

Null and empty texts have zero statistics and are scored like any other vector.
Whole texts are read; equal texts have equal scores.  If a class has no training
row the score is the share of the other; without labels it is 0.5.  An empty table
gives no rows; a row of null doc_id is scored, not learned from; repeated rows are
scored each for itself.  A very long text is one step of a worker, about sixty bytes
of memory for each of its bytes.  Columns other than doc_id and text are not read,
whatever their names (`carry` hands them on; they must not be called `_score`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from postbag.llm import common
from postbag.llm.tokens import Words

#: Labelled documents that the classifier is fitted on, at most (about).
FIT_ROWS = 20_000
NAMES = ("bytes", "words", "word_bytes", "letters", "upper", "digits", "marks", "symbols", "bars", "lines", "short_words", "distinct_words", "same_as_before", "repeated_pairs", "top_word", "caps_words")

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_KINDS = {"letters": _LETTER}
for _name, _set in (("upper", range(65, 91)), ("digits", range(48, 58)), ("marks", b".,;:!?'\"()-"), ("symbols", b"#*$%&|<>{}[]=+~^@/\\_"), ("bars", b"|"), ("lines", b"\n")):
    _KINDS[_name] = np.zeros(256, bool)
    _KINDS[_name][list(_set)] = True


def _distinct_per_group(group: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, count of the most frequent key) per group."""
    mixed = key ^ (group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(mixed, kind="stable")
    s = mixed[order]
    if not len(s):
        return np.zeros(n), np.zeros(n)
    head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    size = np.diff(np.append(head, len(s)))
    owner = group[order[head]]
    most = np.zeros(n)
    np.maximum.at(most, owner, size)
    return np.bincount(owner, minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of transformed statistics per text, in the order of NAMES."""
    words = Words(texts)
    n = len(words.bounds) - 1
    size = np.diff(words.bounds).astype(float)
    count = np.diff(words.first).astype(float)
    out = {"bytes": np.log1p(size), "words": np.log1p(count)}
    some = np.flatnonzero(size)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(n)
        if len(some):
            total[some] = np.add.reduceat(flags, words.bounds[:-1][some], dtype=np.int64)
        return total

    for name, kind in _KINDS.items():
        out[name] = np.arcsin(np.sqrt(np.clip(per_text(kind[words.data]) / np.maximum(size, 1), 0, 1)))
    length = words.end - words.start
    doc = np.repeat(np.arange(n), np.diff(words.first))
    out["word_bytes"] = np.log1p(np.bincount(doc, length, n) / np.maximum(count, 1))
    share = lambda x: np.arcsin(np.sqrt(np.clip(x / np.maximum(count, 1), 0, 1)))
    out["short_words"] = share(np.bincount(doc, length <= 3, n))
    h = words.hashes()
    distinct, most = _distinct_per_group(doc, h, n)
    # distinct words fall with length in any text: measured against the root of the count
    out["distinct_words"] = np.log1p(distinct) - 0.8 * np.log1p(count)
    out["top_word"] = share(most)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    out["same_as_before"] = share(np.bincount(doc, same, n))
    inside = doc[1:] == doc[:-1]
    pair = (h[1:] * np.uint64(31) ^ h[:-1])[inside]
    pairs = np.bincount(doc[1:][inside], minlength=n).astype(float)
    kinds, _ = _distinct_per_group(doc[1:][inside], pair, n)
    out["repeated_pairs"] = np.arcsin(np.sqrt(np.clip(1 - kinds / np.maximum(pairs, 1), 0, 1))) * (pairs > 0)
    upper = _KINDS["upper"]
    caps = upper[words.data[words.start]] & upper[words.data[np.minimum(words.start + 1, words.end - 1)]] if len(doc) else np.zeros(0, bool)
    out["caps_words"] = share(np.bincount(doc, caps, n))
    return np.stack([out[k] for k in NAMES], 1) if n else np.zeros((0, len(NAMES)))


class Discriminant:
    """Means, inverse Cholesky factors and log determinants of two classes."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pooling: float, diagonal: float):
        self.centre, self.spread = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = (x - self.centre) / self.spread
        parts = [z[y == c] for c in (0, 1)]
        covs = [np.einsum("ij,ik->jk", p - p.mean(0), p - p.mean(0)) for p in parts]  # no threaded product in a driver that has forked
        pooled = sum(covs) / max(1, len(z) - 2)
        self.mean, self.root, self.constant = [], [], []
        for p, s in zip(parts, covs, strict=True):
            own = s / max(1, len(p) - 1)
            mix = (1 - pooling) * own + pooling * pooled
            mix = (1 - diagonal) * mix + diagonal * np.eye(z.shape[1]) * np.trace(mix) / z.shape[1]
            factor = np.linalg.cholesky(mix + 1e-6 * np.eye(z.shape[1]))
            self.mean.append(p.mean(0))
            self.root.append(np.linalg.inv(factor))
            self.constant.append(np.log(len(p) / len(z)) - np.log(np.diag(factor)).sum())
        self.slope = 1.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.spread
        d = [c - 0.5 * np.square((z - m) @ r.T).sum(1) for m, r, c in zip(self.mean, self.root, self.constant, strict=True)]
        return d[1] - d[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x), -30, 30)))


class Constant:
    def __init__(self, share: float):
        self.share = share

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def _loss(margin: np.ndarray, y: np.ndarray, slope: float) -> float:
    m = slope * margin
    return float(np.mean(np.logaddexp(0, np.where(y == 1, -m, m))))


def train(x: np.ndarray, y: np.ndarray) -> Discriminant | Constant:
    if len(y) == 0 or min((y == 0).sum(), (y == 1).sum()) < 5:
        return Constant(float((y.sum() + 0.5) / (len(y) + 1)))
    fold = np.arange(len(y)) % 4 == 0
    best = None
    for pooling in (0.02, 0.1, 0.3, 0.6, 0.9):
        for diagonal in (0.01, 0.05, 0.2):
            if min((y[~fold] == 0).sum(), (y[~fold] == 1).sum()) < 3:
                continue
            margin = Discriminant(x[~fold], y[~fold], pooling, diagonal).margin(x[fold])
            for slope in (0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0):
                loss = _loss(margin, y[fold], slope)
                if best is None or loss < best[0]:
                    best = (loss, pooling, diagonal, slope)
    _, pooling, diagonal, slope = best or (0, 0.3, 0.05, 0.2)
    model = Discriminant(x, y, pooling, diagonal)
    model.slope = slope
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> Discriminant | Constant:
    """Fit on at most about `fit_rows` labelled rows, chosen by a hash of doc_id."""
    common.ship(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    share = min(1.0, fit_rows / max(1, known.count()))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))
    # a document under several labels counts as the lowest of them
    wanted = known.where(chosen).groupBy("doc_id").agg(F.min("y").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            x = statistics(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "x"])

    # statistics before the join: no text is shuffled
    rows = common.doc_ids_and_text(docs).where(chosen).mapInArrow(run, "doc_id long, x array<double>")
    got = rows.join(wanted, "doc_id").toPandas()
    got = got.iloc[sorted(range(len(got)), key=lambda i: (got["doc_id"].iloc[i], tuple(got["x"].iloc[i])))]
    x = np.array(got["x"].tolist(), float).reshape(-1, len(NAMES))
    return train(x, got["y"].to_numpy())


def score(docs: DataFrame, model: Discriminant | Constant, carry: bool = False) -> DataFrame:
    """doc_id, score of every whole text; with `carry` all columns of `docs` and `_score`."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            own = pa.array(model.scores(statistics(b.column("text"))))
            columns, names = (b.columns, b.schema.names) if carry else ([b.column("doc_id")], ["doc_id"])
            yield pa.RecordBatch.from_arrays([*columns, own], names=[*names, "_score" if carry else "score"])

    if carry:
        return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_score", DoubleType())]))
    return common.doc_ids_and_text(docs).mapInArrow(run, "doc_id long, score double")
