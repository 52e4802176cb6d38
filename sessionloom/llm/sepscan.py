"""Token counts of flat, unindexed token files by separator scan.

A token file is one stream of fixed-width ids in which each document ends with
the end-of-document id; nothing tells where documents begin. Blocks of any
size are read from any place of a file, each by one task. A block is searched
for the separator by one vectorised comparison and gives the lengths of the
documents that end in it, its first one as far as the block has it, and the
rest after its last separator. A prefix scan over the blocks of a file then
carries those rests forward, so a document may span any number of blocks.

Only one row per block and one per document are shuffled, never ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WordIds, materialise, scratch_path, slices

#: Ids in one block.
BLOCK_IDS = 1 << 18
#: Documents listed in one row of a file's list of ids.
LIST_ROWS = 4096


def _file_system(path: str):
    """The file system of a path or address, as Arrow knows it, and the path there."""
    from pyarrow.fs import FileSystem

    scheme, colon, rest = path.partition(":")
    return FileSystem.from_uri(f"file://{rest}" if colon and scheme == "file" and not rest.startswith("//") else path)


def write_token_files(docs: DataFrame, tokenizer: str, path: str, separator: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write each partition as one flat file of unsigned 16-bit ids under ``path``: rows (file, first, stop, doc_ids).

    A row lists documents in the order written: ``first`` is the place of its
    first one in the file, ``stop`` the file's length after its last one. Each
    attempt of a task writes a file of its own, and only the files of attempts
    whose rows were committed are listed, so tasks may be repeated at will.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, out, first, stop = WordIds.of(tokenizer), None, 0, 0
        if max(words.size - 1, separator) > 65535:
            raise ValueError("ids of this tokenizer need more than 16 bits")
        file = f"{path}/tokens-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        for some in slices(batches, 1, LIST_ROWS):
            if out is None:
                fs, at = _file_system(file)
                fs.create_dir(at.rpartition("/")[0])
                out = fs.open_output_stream(at)
            ids, _ = words.ids_of(some.column(1), separator)
            out.write(ids.astype("<u2").tobytes())
            stop += 2 * len(ids)
            listed = pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([first]), pa.array([stop]), listed], names=["file", "first", "stop", "doc_ids"])
            first += some.num_rows
        if out is not None:
            out.close()
        words.forget()

    written = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "file string, first long, stop long, doc_ids array<long>")
    return materialise(written, "token-lists")


def count_tokens(files: DataFrame, separator: int, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Tokens of each document, as rows (file, ordinal, n_tokens), without the separator.

    ``files`` has (file, length): addresses of flat files that tasks can read,
    and their bytes, a whole number of little-endian ids of ``width`` bytes.
    Null lengths count as 0. Ids after a file's last separator are no
    document. A file that is listed twice is counted once. An empty table
    gives an empty result; further columns are not read.
    """
    dtype = {1: "u1", 2: "<u2", 4: "<u4"}[width]
    size = width * block_ids

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block in zip(*(c.to_pylist() for c in batch.columns)):
                fs, at = _file_system(file)
                with fs.open_input_file(at) as f:
                    ids = np.frombuffer(f.read_at(size, block * size), dtype)
                ends = np.flatnonzero(ids == separator)
                lengths = np.diff(ends, prepend=-1) - 1
                tail = len(ids) - (int(ends[-1]) + 1 if len(ends) else 0)
                lists = pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), pa.array(lengths, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([tail], pa.int64()), lists], names=["file", "block", "n_ends", "tail", "lengths"])

    blocks = files.groupBy("file").agg(F.max("length").alias("length")).where("length > 0")
    blocks = blocks.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("length") / size) - 1)).alias("block"))
    # one row a block, so that it takes this many tasks to read them, however few bytes the rows are
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = materialise(blocks.repartition(tasks, "file", "block").mapInArrow(scan, "file string, block long, n_ends long, tail long, lengths array<long>"), "separators")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    run = F.sum("tail").over(before)  # of all blocks before
    # what the blocks up to and with the last one that has a separator leave behind is not carried further
    settled = F.max(F.when(F.col("n_ends") > 0, F.col("run_total") - F.col("tail"))).over(before)
    stitched = (
        found.select("file", "block", "n_ends", "tail")
        .withColumn("run_total", F.coalesce(run, F.lit(0)) + F.col("tail"))
        .withColumn("carry", F.col("run_total") - F.col("tail") - F.coalesce(settled, F.lit(0)))
        .withColumn("first", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
        .where("n_ends > 0")
        .select("file", "block", "carry", "first")
    )
    return (
        found.select("file", "block", "lengths")
        .join(stitched, ["file", "block"])
        .select("file", "carry", "first", F.posexplode("lengths").alias("i", "length"))
        .select("file", (F.col("first") + F.col("i")).alias("ordinal"), (F.col("length") + F.when(F.col("i") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"))
    )


def document_token_counts(docs: DataFrame, tokenizer: str, separator: int | None = None, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write ``docs`` as token files and count each document's tokens from them: (doc_id, n_tokens).

    The separator is the id after the tokenizer's last one, which no text can
    give. One row per row of ``docs``, repeated rows and null ids too; null
    text counts as empty and has 0 tokens; an empty table gives an empty
    result; further columns are not read.
    """
    separator = WordIds.of(tokenizer).size if separator is None else separator
    lists = write_token_files(docs, tokenizer, scratch_path(docs.sparkSession, "token-files"), separator, id_col, text_col)
    listed = lists.select("file", "first", F.posexplode("doc_ids").alias("i", "doc_id")).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")
    counts = count_tokens(lists.select("file", F.col("stop").alias("length")), separator, block_ids=block_ids)
    return listed.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
