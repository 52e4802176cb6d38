"""Exact deduplication by deterministic block naming, in DataFrame operations only.

A normalised text is cut into blocks of a fixed number of characters. Distinct
blocks are sorted and take integer names; then, level by level, adjacent pairs
of names take new names, until each text is one name. A text of n blocks is
finished after ceil(log2 n) levels, so its identity is (level, name): texts of
other levels have another number of blocks, and on one level equal names mean
equal pairs, down to equal blocks. No identity rests on a hash.

Scale: block contents are shuffled once, after a map-side distinct; all later
shuffles carry integers. A hash of the block serves only to look its name up;
where two different blocks share the hash, the contents are compared. Hot
groups: distinct and the group counts combine on the map side, and the look-up
joins have a shuffle on either side, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise

#: Characters of one block.
BLOCK_CHARS = 4096


def normalised(text: Column) -> Column:
    """Each run of white space as one space; single spaces, the usual case, are not matched as they stay what they are."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*", " ")


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_chars: int, key) -> DataFrame:
    long_ = F.regexp_extract_all("norm", F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    cut = F.when(F.length("norm") <= block_chars, F.array("norm")).otherwise(long_)  # a text of one block needs no pattern
    return (
        docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
        .select("doc_id", F.unhex(F.sha2("norm", 256)).alias("sha"), cut.alias("blocks"))
        .select("doc_id", "sha", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
        .withColumn("key", key(F.col("block")))
    )


def _named(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Sorted rows take rising integers; the partition number is the name's upper part."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def name_blocks(docs: DataFrame, id_col: str, text_col: str, block_chars: int, key) -> DataFrame:
    """One row (doc_id, sha, n, pos, name) per block of each row of ``docs``."""
    blocks = _blocks(docs, id_col, text_col, block_chars, key)
    names = materialise(_named(blocks.select("key", "block").distinct(), ["block"]).select("key", "name"), "block-names")
    contested = names.groupBy("key").count().where("count > 1").select("key")
    cols = ["doc_id", "sha", "n", "pos"]
    if contested.isEmpty():
        return blocks.select(*cols, "key").join(names, "key").select(*cols, "name")
    contested = materialise(contested, "block-contested")
    rank = F.row_number().over(W.partitionBy("key").orderBy("block"))
    told = blocks.join(contested, "key", "left_semi").select("key", "block").distinct().withColumn("rank", rank)
    spare = names.join(contested, "key", "left_semi").withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy("name")))
    told = materialise(told.join(spare, ["key", "rank"]).select("key", "block", "name"), "block-told")
    plain = blocks.select(*cols, "key").join(names.join(contested, "key", "left_anti"), "key")
    return plain.select(*cols, "name").unionByName(blocks.join(told, ["key", "block"]).select(*cols, "name"))


def name_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, key=F.xxhash64) -> DataFrame:
    """Identity (level, name) of each normalised text, as rows (doc_id, sha, level, name, copies).

    ``copies`` counts rows that agree in id and text. ``key`` looks names up and
    may collide; it is a parameter so that tests can make it collide.
    """
    cur = materialise(name_blocks(docs, id_col, text_col, block_chars, key).withColumn("copies", F.lit(1).cast("long")), "names-0")
    most = cur.agg(F.max("n")).first()[0] or 1
    done, level = [], 0
    while True:
        done.append(cur.where("n = 1").select("doc_id", "sha", F.lit(level).alias("level"), "name", "copies"))
        if most == 1:
            break
        even = F.col("pos") % 2 == 0
        pairs = (
            cur.where("n > 1")
            .groupBy("doc_id", "sha", "n", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"), F.sum(F.when(even, F.col("copies"))).alias("copies"))
        )
        pairs = materialise(pairs, "pairs")
        names = materialise(_named(pairs.select("a", "b").distinct(), ["a", "b"]), "pair-names")
        level += 1
        cur = materialise(pairs.join(names, ["a", "b"]).select("doc_id", "sha", F.ceil(F.col("n") / 2).cast("int").alias("n"), "pos", "name", "copies"), "names")
        most = (most + 1) // 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.groupBy("doc_id", "sha", "level", "name").agg(F.sum("copies").alias("copies"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, key=F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` has
    become one space; null counts as empty. The smallest id of equal texts is
    ``keep_id``; null ids come last, so keep_id is null only in a group without
    any id. Of rows that repeat id and text, one is kept. An empty table gives
    an empty result; further columns of ``docs`` are not read.
    """
    ids = materialise(name_documents(docs, id_col, text_col, block_chars, key), "identities")
    groups = materialise(ids.groupBy("level", "name").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "identity-groups")
    return (
        ids.join(groups, ["level", "name"])
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    )
