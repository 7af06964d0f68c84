"""Token counts of documents in flat, unindexed token files by a separator scan.

A flat file is nothing but ids, little-endian unsigned 16-bit, in which each
document ends with a separator id; no table says where documents lie.  It is kept
as numbered blocks of equal size that ignore document boundaries.  Each block is
searched on its own for separators (one vectorised comparison).  What a block
cannot know, how many documents ended before it and how many ids of its first
document lie in earlier blocks, is stitched from block summaries by a prefix scan.

Texts are encoded with special strings as ordinary text, so a separator never
stands inside a document.  Null texts are empty documents (0 ids); an empty table
gives an empty file and no rows; ids after the last separator of a file belong to
no document and are reported by `scan` as `ordinal` = documents of the file with
`closed` false.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postbag.llm import common
from postbag.llm.tokens import encoder, vocabulary_path

SEPARATOR = 49_407
BLOCK = 1 << 18


def write_flat(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """Encode `docs` to flat files, one a partition: rows (file, block, ids), and the
    ids of its documents in order as rows (file, first, doc_ids)."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file = TaskContext.get().partitionId()
        enc = encoder(vocabulary_path(vocabulary), True)
        number, docs_before = 0, 0
        rest = np.zeros(0, "<u2")

        def row(number, ids, first, names) -> pa.RecordBatch:
            cells = [[file], [number], [ids], [first], [names]]
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["file", "block", "ids", "first", "doc_ids"])

        for b in common.slices(batches, "text"):
            ids, counts = enc.encode(b.column("text"), separator)
            yield row(None, None, docs_before, np.asarray(b.column("doc_id")).astype("<i8").tobytes())
            docs_before += len(counts)
            rest = np.concatenate([rest, ids.astype("<u2")])
            while len(rest) >= block:
                yield row(number, rest[:block].tobytes(), None, None)
                rest, number = rest[block:], number + 1
        if len(rest):
            yield row(number, rest.tobytes(), None, None)

    rows = common.doc_ids_and_text(docs).where("doc_id is not null").mapInArrow(run, "file int, block long, ids binary, first long, doc_ids binary")
    return common.written(rows, "flat", "zstd")


def _find(separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, number, raw in zip(*(b.column(c) for c in ("file", "block", "ids")), strict=True):
                ids = np.frombuffer(raw.as_py(), "<u2")
                ends = np.flatnonzero(ids == separator)
                lengths = np.diff(ends, prepend=-1) - 1
                tail = len(ids) - (int(ends[-1]) + 1 if len(ends) else 0)
                cells = [[file.as_py()], [number.as_py()], [len(ends)], [tail], [lengths.tolist()]]
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["file", "block", "n", "tail", "lengths"])

    return run


def scan(flat: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """Documents found in flat files: file, ordinal, n_tokens (without the separator), closed."""
    common.ship(flat.sparkSession)
    found = common.written(flat.where("block is not null").select("file", "block", "ids").mapInArrow(_find(separator), "file int, block long, n long, tail long, lengths array<bigint>"), "found")
    # prefix scan over block summaries: documents ended before, and ids carried in since the last separator
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    brief = found.select("file", "block", "n", "tail")
    run = brief.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    span = Window.partitionBy("file", "before").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.lag(F.when(F.col("n") > 0, F.col("tail"))).over(Window.partitionBy("file").orderBy("block"))
    # blocks with equal `before` follow one block that held a separator: its tail, then whole blocks
    carried = (
        run.withColumn("opened", F.coalesce(last, F.lit(0)))
        .withColumn("lead_in", F.first("opened").over(Window.partitionBy("file", "before").orderBy("block")))
        .withColumn("whole", F.coalesce(F.sum("tail").over(span), F.lit(0)))
        .select("file", "block", "before", (F.col("lead_in") + F.col("whole")).alias("carry"))
    )
    stitched = found.join(carried, ["file", "block"])
    closed = stitched.select("file", "before", "carry", F.posexplode("lengths").alias("i", "length")).select(
        "file", (F.col("before") + F.col("i")).alias("ordinal"), (F.col("length") + F.when(F.col("i") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("closed")
    )
    final = stitched.groupBy("file").agg(F.max_by(F.struct((F.col("before") + F.col("n")).alias("ordinal"), (F.col("tail") + F.when(F.col("n") == 0, F.col("carry")).otherwise(0)).alias("n_tokens")), "block").alias("x"))
    opened = final.where("x.n_tokens > 0").select("file", "x.ordinal", "x.n_tokens", F.lit(False).alias("closed"))
    return closed.unionByName(opened)


def documents_of(flat: DataFrame) -> DataFrame:
    """The doc_id of each ordinal, from the list that was kept beside the flat files."""
    common.ship(flat.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, first, raw in zip(*(b.column(c) for c in ("file", "first", "doc_ids")), strict=True):
                names = np.frombuffer(raw.as_py(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), file.as_py(), np.int32)), pa.array(first.as_py() + np.arange(len(names))), pa.array(names)], names=["file", "ordinal", "doc_id"])

    return flat.where("doc_ids is not null").select("file", "first", "doc_ids").mapInArrow(run, "file int, ordinal long, doc_id long")


def count_tokens(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """doc_id and n_tokens of each document, found in the flat files by the scan."""
    flat = write_flat(docs, vocabulary, separator, block)
    return documents_of(flat).join(scan(flat, separator).where("closed"), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "n_tokens")
