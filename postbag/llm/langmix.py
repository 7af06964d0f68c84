"""Language identification by mixture inference.

Each language has smoothed likelihoods of hashed byte trigrams, counted on a
bounded sample of documents with a known language.  A document is a mixture: each
of its words comes from one language, with the document's proportions.  Expectation
maximisation estimates the proportions; then languages are dropped, least share
first, for as long as the penalised likelihood (log-likelihood less half the number
of languages times the log of the number of words) does not fall.  The prediction
is the language with the largest share of the set that is left.

Texts that are null, empty or have no letter are `und` with score 0.  Whole texts
are read; equal texts have equal predictions, whatever stands beside them.  With no
usable training row all predictions are `und`.  An empty table gives no rows; rows of
null doc_id are predicted, not learned from; repeated rows are predicted each for
itself.  A very long text is one step of a worker (tens of bytes of memory a byte).
Languages with equal shares rank by name.  Other columns than doc_id, text and the
language are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postbag.llm import common

#: Documents that likelihoods are counted on, at most (about).
FIT_ROWS = 20_000
BITS = 15
STEPS = 12
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of all texts, each with a space before it and two after it, so that
    no trigram reaches into the next text, and where each begins."""
    texts = common.plain(texts).fill_null("").cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = off - off[0] + 3 * np.arange(len(off))
    out = np.full(int(bounds[-1]) + 2, 32, np.uint8)
    keep = np.ones(int(bounds[-1]), bool)
    keep[bounds[:-1]] = keep[bounds[1:] - 1] = keep[bounds[1:] - 2] = False
    out[: len(keep)][keep] = _FOLD[data]
    return out, bounds


def _grams(data: np.ndarray) -> np.ndarray:
    """The bucket of the trigram at each byte."""
    a, b, c = (data[i : len(data) - 2 + i].astype(np.uint32) for i in range(3))
    g = (a * np.uint32(2654435761) + b * np.uint32(40503 * 65537) + c * np.uint32(2246822519)) >> np.uint32(32 - BITS)
    return g.astype(np.int32)


def _inner(data: np.ndarray) -> np.ndarray:
    """Places whose trigram counts: those that begin with two spaces lie between words or texts."""
    return (data[:-2] != 32) | (data[1:-1] != 32)


def has_letter(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(pc.match_substring_regex(common.plain(texts).cast(pa.string()).fill_null(""), r"\p{L}"))


def fit(docs: DataFrame, lang: str = "lang", fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihood of each bucket by language) from rows with text and language."""
    common.ship(docs.sparkSession)
    known = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    share = min(1.0, fit_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select(F.col(lang).alias("lang"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in common.slices(batches, "text"):
            langs = np.array(b.column("lang").to_pylist(), object)
            data, bounds = _bytes(b.column("text"))
            inner = _inner(data)
            grams = _grams(data)[inner]
            row = np.repeat(np.arange(len(langs)), np.diff(bounds))[inner]
            for name in set(langs.tolist()):
                found = np.bincount(grams[(langs == name)[row]], minlength=1 << BITS)
                held[name] = held.get(name, 0) + found
        for name, found in held.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(found[at].astype(np.int64))], names=["lang", "bucket", "n"])

    counts = chosen.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique())
    table = np.zeros((len(names), 1 << BITS))
    for i, name in enumerate(names):
        mine = counts[counts["lang"] == name]
        table[i, mine["bucket"]] = mine["n"]
    table += 0.3
    return names, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def infer(texts: pa.Array, table: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(proportions, languages kept, words) of each text: EM, then penalised selection."""
    data, bounds = _bytes(texts)
    n_docs, k = len(bounds) - 1, len(table)
    end = int(bounds[-1])
    grams, inner = _grams(data)[:end], _inner(data)[:end]
    solid = data[1 : end + 1] != 32
    first = np.flatnonzero((data[:end] == 32) & solid)  # the space before each word
    doc = np.searchsorted(bounds, first, "right") - 1
    words = np.bincount(doc, minlength=n_docs)
    share = np.full((n_docs, k), 1.0 / k)
    kept = np.ones((n_docs, k), bool)
    if not len(first):
        return share, kept, words
    loglik = np.stack([np.add.reduceat(np.where(inner, row[grams], 0), first) for row in table])
    top = loglik.max(0)
    like = np.exp(np.maximum(loglik - top, -60)).astype(np.float32)
    some = np.flatnonzero(words)
    begin = np.searchsorted(doc, some)
    count = words[some]

    def fold(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, begin)

    part = np.full((k, len(some)), 1.0 / k, np.float32)
    for _ in range(steps):
        joint = like * np.repeat(part, count, axis=1)
        joint /= joint.sum(0)
        part = np.stack([fold(row) for row in joint]) / count
        part = np.maximum(part, 1e-6).astype(np.float32)
        part /= part.sum(0)
    order = np.argsort(-part, axis=0, kind="stable")
    best = np.full(len(some), -np.inf)
    size = np.ones(len(some), np.int64)
    for s in range(1, k + 1):
        mask = np.zeros_like(part)
        np.put_along_axis(mask, order[:s], 1, 0)
        mix = part * mask
        mix /= mix.sum(0)
        value = fold(np.log(np.maximum((like * np.repeat(mix.astype(np.float32), count, axis=1)).sum(0), 1e-30), dtype=np.float64)) - 0.5 * s * np.log(count + 1)
        better = value > best
        best[better], size[better] = value[better], s
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(k)[:, None].repeat(len(some), 1), 0)
    chosen = rank < size
    final = part * chosen
    final /= final.sum(0)
    share[some], kept[some] = final.T, chosen.T
    return share, kept, words


def predict(docs: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score, langs (the set kept, largest share first) and shares."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text", 1_500_000):
            text = b.column("text")
            ok = has_letter(text)
            preds, scores, langs, shares = [], [], [], []
            if names:
                share, kept, words = infer(text, table)
                order = np.argsort(-share, axis=1, kind="stable")
                ok = ok & (words > 0)
                for i in range(len(ok)):
                    if ok[i]:
                        mine = [j for j in order[i].tolist() if kept[i, j]]
                        preds.append(names[mine[0]])
                        scores.append(min(1.0, float(share[i, mine[0]])))
                        langs.append([names[j] for j in mine])
                        shares.append([float(share[i, j]) for j in mine])
                    else:
                        preds.append("und")
                        scores.append(0.0)
                        langs.append([])
                        shares.append([])
            else:
                preds, scores, langs, shares = ["und"] * len(ok), [0.0] * len(ok), [[]] * len(ok), [[]] * len(ok)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], names=["doc_id", "lang_pred", "score", "langs", "shares"])

    return common.doc_ids_and_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, langs array<string>, shares array<double>")
