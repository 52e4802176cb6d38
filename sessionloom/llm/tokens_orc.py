"""Token ids written as ORC and read back.

Documents are range-partitioned and sorted by id, so each file covers a range
of ids: stripe and row-group statistics prune reads by id range, Bloom filters
prune look-ups of single ids, and files and stripes are read in parallel. ORC's
integer run-length encoding stores the ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WordIds, materialise, scratch_path, slices

SCHEMA = "part int, ordinal long, doc_id long, ids array<int>"


def write_token_orc(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 16 << 20, row_index_stride: int = 2000, bloom_fpp: float = 0.01) -> None:
    """Write (part, ordinal, doc_id, ids) in ascending doc_id order over all files.

    ``part`` numbers the ranges and ``ordinal`` the rows of one. Rows of one
    id, however many, spread over ranges by their place in the input; null ids
    come first; null text is the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, words, ordinal = TaskContext.get().partitionId(), WordIds.of(tokenizer), 0
        for some in slices(batches, 1):
            ids, offsets = words.ids_of(some.column(1), end_id)
            n = some.num_rows
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view("<i4")))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(ordinal, ordinal + n)), some.column(0), lists], names=["part", "ordinal", "doc_id", "ids"])
            ordinal += n
        words.forget()

    (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .withColumn("place", F.monotonically_increasing_id())
        .repartitionByRange("doc_id", "place")
        .sortWithinPartitions("doc_id", "place")
        .select("doc_id", "text")
        .mapInArrow(run, SCHEMA)
        .write.option("orc.compress", "LZ4")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.row.index.stride", str(row_index_stride))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(bloom_fpp))
        .orc(path)
    )


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def token_index(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each stored document.

    ``start`` counts the ids of all documents before it: a running sum within
    its range, plus the totals of the ranges before, of which there is one row
    a range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4").view(np.uint8)
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "ordinal", "doc_id", "n_tokens", "ids_crc32"])

    rows = materialise(stored.mapInArrow(run, "part int, ordinal long, doc_id long, n_tokens long, ids_crc32 long"), "token-index")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    parts = parts.select("part", before(W.orderBy("part")).alias("base"))
    return (
        rows.withColumn("within", before(W.partitionBy("part").orderBy("ordinal")))
        .join(parts, "part")
        .select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
    )


def token_binary_output(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as ORC under ``path`` (a new shared folder if none) and index what was written.

    One row per row of ``docs``; repeated rows and null ids are written too; an
    empty table gives an empty result; further columns are not read.
    """
    path = path or scratch_path(docs.sparkSession, "token-orc")
    write_token_orc(docs, path, tokenizer, end_id, id_col, text_col)
    return token_index(read_token_orc(docs.sparkSession, path))
