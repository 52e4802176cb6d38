"""Hard negatives by anchor spanning-tree bounds.

Anchors are dealt to blocks and each block gets a minimum spanning tree. A
candidate's score at a parent anchor, plus or minus the edge's length times the
candidate's norm, bounds its score at the child, so only candidates whose
bounds meet the child's window are scored again. Every block of anchors meets
every part of the candidates once in each of two passes: the first finds the
best positives, the second the negatives in the windows that they set. Both
passes keep bounded lists an anchor, in tasks and after them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

#: Candidates of one task, anchors of one block, candidates scored at once.
PART_ROWS, BLOCK_ROWS, TILE = 1 << 17, 1 << 10, 2048


def _matrix(column: pa.ChunkedArray, scale: float) -> np.ndarray:
    """Vectors as rows of whole numbers; shorter vectors end in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, size = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), max(1, int(size.max(initial=0)))))
    out[np.arange(out.shape[1]) < size[:, None]] = np.floor(scale * values)
    return out


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, which are null) of a column of integers."""
    return column.fill_null(0).to_numpy(), column.is_null().to_numpy()


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a minimum spanning tree, by growing it from the first row.

    ``order`` lists rows as they join the tree; parents, as places in that
    order (-1: the root), always come before their children.
    """
    n = len(vectors)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
    place = np.zeros(n, np.int64)
    near, link = np.full(n, np.inf), np.zeros(n, np.int64)
    left = np.ones(n, dtype=bool)
    at = 0
    for i in range(n):
        order[i], place[at], left[at] = at, i, False
        if i:
            parent[i], edge[i] = place[link[at]], near[at]
        d = np.sqrt(((vectors - vectors[at]) ** 2).sum(axis=1))
        closer = left & (d < near)
        near[closer], link[closer] = d[closer], at
        if i + 1 < n:
            at = int(np.where(left, near, np.inf).argmin())
    return order, parent, edge


class Tree:
    """Anchors of one block with their spanning tree, level by level."""

    def __init__(self, vectors: np.ndarray, parent: np.ndarray, edge: np.ndarray):
        self.vectors, self.parent = vectors, parent
        self.edge = edge * (1 + 1e-9) + 1e-6  # no bound may suffer from rounding
        depth = np.zeros(len(parent), np.int64)
        for i, p in enumerate(parent.tolist()):
            depth[i] = 0 if p < 0 else depth[p] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=-1)) + 1)]
        self.scored = self.skipped = 0

    def scores(self, some: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(anchors, candidates): exact scores, NaN where the bounds leave the anchor's window [low, high]."""
        k, m = len(self.parent), len(some)
        least, most, out = np.empty((k, m)), np.empty((k, m)), np.full((k, m), np.nan)
        short = norms.min(initial=np.inf)
        for level in self.levels:
            up, edge = self.parent[level], self.edge[level]
            if up[0] < 0:
                whole = np.ones(len(level), dtype=bool)
            else:  # no candidate of this tile can leave the window: no need to look at each
                whole = (most[up].min(axis=1) + edge * short >= low[level]) & (least[up].max(axis=1) - edge * short <= high[level])
            rows = level[whole]
            if len(rows):
                out[rows] = least[rows] = most[rows] = self.vectors[rows] @ some.T
                self.scored += len(rows) * m
            for a in level[~whole].tolist():
                p, reach = self.parent[a], self.edge[a] * norms
                np.subtract(least[p], reach, out=least[a])
                np.add(most[p], reach, out=most[a])
                at = np.flatnonzero((most[a] >= low[a]) & (least[a] <= high[a]))
                out[a, at] = least[a, at] = most[a, at] = some[at] @ self.vectors[a]
                self.scored += len(at)
                self.skipped += m - len(at)
        return out


class Best:
    """The best rows of each of ``n`` lists, by score, then the smaller id, null ids last."""

    def __init__(self, n: int, size: int):
        self.size, self.least = size, np.full(n, -np.inf)
        self.key, self.score, self.id, self.no_id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, key: np.ndarray, score: np.ndarray, id_: np.ndarray, no_id: np.ndarray) -> None:
        key, score = np.concatenate([self.key, key]), np.concatenate([self.score, score])
        id_, no_id = np.concatenate([self.id, id_]), np.concatenate([self.no_id, no_id])
        by = np.lexsort((id_, no_id, -score, key))
        key = key[by]
        begins = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1]) if len(key) else np.zeros(0, np.int64)
        rank = np.arange(len(key)) - np.repeat(begins, np.diff(np.append(begins, len(key))))
        keep = by[rank < self.size]
        self.key, self.score, self.id, self.no_id = key[rank < self.size], score[keep], id_[keep], no_id[keep]
        last = rank == self.size - 1
        self.least[key[last]] = score[by[last]]


def _tiles(candidates: pa.Table, scale: float, width: int):
    """(vectors, norms, ids, null ids, labels, rows) of at most ``TILE`` candidates at a time."""
    for start in range(0, candidates.num_rows, TILE):
        some = candidates.slice(start, TILE)
        x = _matrix(some.column("vec"), scale)
        norms = np.sqrt((x**2).sum(axis=1))
        if x.shape[1] != width:
            x = np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))[:, :width]
        yield x, norms, *_numbers(some.column("id")), some.column("label").to_numpy(), some.column("row").to_numpy()


def _tree_of(anchors: pa.Table, scale: float) -> tuple[Tree, pa.Table]:
    anchors = anchors.sort_by("place")
    return Tree(_matrix(anchors.column("vec"), scale), anchors.column("parent").to_numpy(), anchors.column("edge").to_numpy()), anchors


def best_positives(anchors: pa.Table, candidates: pa.Table, scale: float, count: int) -> pa.Table:
    """(row, id, score): the best ``count`` other candidates of each anchor's label; an anchor's window opens at its worst of these so far."""
    tree, anchors = _tree_of(anchors, scale)
    label, row = anchors.column("label").to_numpy(), anchors.column("row").to_numpy()
    best, top = Best(len(row), count), np.full(len(row), np.inf)
    for x, norms, ids, no_id, labels, rows in _tiles(candidates, scale, tree.vectors.shape[1]):
        s = tree.scores(x, norms, best.least, top)
        a, c = np.nonzero((s >= best.least[:, None]) & (label[:, None] == labels))
        other = row[a] != rows[c]
        a, c = a[other], c[other]
        best.add(a, s[a, c], ids[c], no_id[c])
    return pa.table({"row": pa.array(row[best.key], pa.int64()), "id": pa.array(best.id, pa.int64(), mask=best.no_id), "score": pa.array(best.score.astype(np.int64))})


def best_negatives(anchors: pa.Table, candidates: pa.Table, scale: float, count: int, low: tuple[int, int], high: tuple[int, int]) -> pa.Table:
    """(row, n, id, score): the best ``count`` candidates of other labels in the window of each positive ``n`` of each anchor.

    A window begins at its lowest score, and as soon as enough are known, at
    the worst of them.
    """
    tree, anchors = _tree_of(anchors, scale)
    label, row = anchors.column("label").to_numpy(), anchors.column("row").to_numpy()
    positives = anchors.column("positives").to_pylist()
    width = max((len(p) for p in positives), default=0)
    bottom, top = np.full((len(row), width), np.inf), np.full((len(row), width), -np.inf)
    for a, scores in enumerate(positives):
        for n, p in enumerate(scores):
            bottom[a, n], top[a, n] = -(-low[0] * p // low[1]), high[0] * p // high[1]
    best = Best(len(row) * width, count)
    ceiling = np.where(bottom <= top, top, -np.inf).max(axis=1, initial=-np.inf)
    for x, norms, ids, no_id, labels, rows in _tiles(candidates, scale, tree.vectors.shape[1]):
        floor = np.maximum(bottom, best.least.reshape(len(row), width))
        s = tree.scores(x, norms, np.where(floor <= top, floor, np.inf).min(axis=1, initial=np.inf), ceiling)
        a, c = np.nonzero((s >= np.where(floor <= top, floor, np.inf).min(axis=1, initial=np.inf)[:, None]) & (s <= ceiling[:, None]))
        other = label[a] != labels[c]
        a, c = a[other], c[other]
        got = s[a, c]
        i, n = np.nonzero((got[:, None] >= floor[a]) & (got[:, None] <= top[a]))
        best.add(a[i] * width + n, got[i], ids[c[i]], no_id[c[i]])
    key = best.key if width else best.key.astype(np.int64)
    return pa.table({"row": pa.array(row[key // max(1, width)], pa.int64()), "n": pa.array((key % max(1, width) + 1).astype(np.int32)), "id": pa.array(best.id, pa.int64(), mask=best.no_id), "score": pa.array(best.score.astype(np.int64))})


def _first(found: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The best ``count`` rows of each key with their place ``k``, of what the tasks have kept."""
    w = W.partitionBy(*keys).orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("k", F.row_number().over(w)).where(F.col("k") <= count)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100), scale: float = 256.0,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", part_rows: int = PART_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor and positive.

    Components become floor(scale * x); scores are inner products with the
    anchor, exact below 2^53. An anchor's positives are its best rows of the
    same label but itself; a positive's negatives the best rows of other
    labels whose score is between the fractions ``low`` and ``high`` of the
    positive's; higher scores first, ties by the smaller id, null ids last.

    Rows with a null label, a null vector, or a null or non-finite component
    take no part. Each row counts by itself, also if its id is repeated;
    ``is_anchor`` null is false; shorter vectors count as ending in zeros. A
    positive without negatives, an anchor without positives and an empty table
    give no rows; other columns are not read.

    Parts and blocks are dealt by a hash of a row number, so their sizes don't
    depend on labels, repeated vectors or how the table is laid out.
    """
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = materialise(rows, "vectors")
    n, k = rows.agg(F.count("*"), F.count_if("anchor")).first()
    parts, blocks = max(1, -(-n // part_rows)), max(1, -(-k // block_rows))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    vec = rows.schema["vec"].dataType.simpleString()

    def grow(table: pa.Table) -> pa.Table:
        order, parent, edge = spanning_tree(_matrix(table.column("vec"), scale))
        table = table.take(pa.array(order))
        return table.append_column("place", pa.array(np.arange(len(order)))).append_column("parent", pa.array(parent, pa.int64())).append_column("edge", pa.array(edge))

    anchors = rows.where("anchor").select(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), "row", "id", "label", "vec")
    anchors = materialise(anchors.groupBy("block").applyInArrow(grow, f"block long, row long, id long, label long, vec {vec}, place long, parent long, edge double"), "anchors")
    candidates = rows.select(F.pmod(F.xxhash64("row"), F.lit(parts)).alias("part"), every(blocks).alias("block"), "row", "id", "label", "vec").groupBy("part", "block")

    first = lambda a, c: best_positives(a, c, scale, positives)
    found = anchors.withColumn("part", every(parts)).groupBy("part", "block").cogroup(candidates).applyInArrow(first, "row long, id long, score long")
    chosen = materialise(_first(found, ["row"], positives).select("row", F.col("k").alias("n"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    listed = chosen.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "positive_score"))), lambda x: x.positive_score).alias("positives"))
    windows = anchors.join(listed, "row", "left").withColumn("positives", F.coalesce("positives", F.array().cast("array<bigint>")))
    second = lambda a, c: best_negatives(a, c, scale, negatives, low, high)
    found = windows.withColumn("part", every(parts)).groupBy("part", "block").cogroup(candidates).applyInArrow(second, "row long, n int, id long, score long")
    found = _first(found, ["row", "n"], negatives)
    return (
        found.join(chosen, ["row", "n"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
        .select("anchor_id", "positive_id", F.col("k").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
