"""Packing of documents into token windows by Karmarkar-Karp multiway differencing.

Each task packs the documents of its own partition, so packing needs no
shuffle and no group of documents is gathered: whole windows are cut off the
front of a document as they come, and the rests wait in a chunk of bounded
size, which is then dealt to windows by differencing. The unit is the piece
(document, start, length); ids themselves never leave the task.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIds, slices

WINDOW = 4096
#: Rests packed together; bounds a task's memory and the differencing's size.
CHUNK = 1024
#: A rest is cut evenly into pieces of at most this many ids, which fit together more closely.
PIECE = 1024

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Deal ``lengths`` to ``k`` windows: (window of each length, sum of each window).

    A partial partition has k sums. The two whose sums differ most are merged
    again and again, the largest sums of one with the smallest of the other, so
    that their imbalances cancel.
    """
    n = len(lengths)
    nxt = np.full(n + 1, -1, dtype=np.int64)  # pieces of one sum, as a chain
    parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    heap = []
    for i in range(n):
        heap.append((-int(lengths[i]), i))
        parts[i] = (np.array([lengths[i]], dtype=np.int64), np.array([i]), np.array([i]))  # non-zero sums, rising; heads; tails
    heapq.heapify(heap)
    fresh = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        (sa, ha, ta), (sb, hb, tb) = parts.pop(a), parts.pop(b)
        free = k - len(sa)  # zero sums of a
        if len(sb) <= free:
            sums, heads, tails = np.concatenate([sa, sb]), np.concatenate([ha, hb]), np.concatenate([ta, tb])
        else:
            m = len(sb) - free  # the largest of either meet zeros of the other; the m smallest of both meet
            nxt[ta[:m]] = hb[m - 1 :: -1]
            sums = np.concatenate([sa[:m] + sb[m - 1 :: -1], sa[m:], sb[m:]])
            heads = np.concatenate([ha, hb[m:]])
            tails = np.concatenate([tb[m - 1 :: -1], ta[m:], tb[m:]])
        order = np.argsort(sums, kind="stable")
        parts[fresh] = (sums[order], heads[order], tails[order])
        least = 0 if len(sums) < k else int(sums[order[0]])
        heapq.heappush(heap, (least - int(sums[order[-1]]), fresh))
        fresh += 1
    window = np.empty(n, dtype=np.int64)
    sums, heads, _ = parts.popitem()[1]
    for w, i in enumerate(heads):
        while i >= 0:
            window[i] = w
            i = nxt[i]
    return window, sums


def near_equal_windows(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each length: as few windows as differencing fills without excess.

    The count starts at the least possible and rises while the capacity is
    exceeded; the least sufficient count is then found by halving.
    """
    low = max(1, math.ceil(int(lengths.sum()) / capacity))
    best, sums = differencing(lengths, low)
    if sums.max() <= capacity:
        return best
    step, high = 1, low + 1
    while True:
        best, sums = differencing(lengths, high)
        if sums.max() <= capacity:
            break
        low, step = high, 2 * step
        high = min(high + step, len(lengths))
    while high - low > 1:
        mid = (low + high) // 2
        tried, sums = differencing(lengths, mid)
        if sums.max() <= capacity:
            best, high = tried, mid
        else:
            low = mid
    return best


def packed(docs: Iterable[tuple[int | None, np.ndarray]], first: int, window: int, chunk: int, piece: int = PIECE) -> Iterator[list[tuple]]:
    """Pieces of (doc_id, ids), as rows of SCHEMA; sequences count from ``first``."""
    sequence = first
    rests: list[tuple] = []
    rows: list[tuple] = []
    for doc_id, ids in docs:
        total = len(ids)
        for start in range(0, total - window + 1, window):
            rows.append((doc_id, start, window, zlib.crc32(ids[start : start + window]), total, sequence, 0))
            sequence += 1
        rest = total % window
        cuts = -(-rest // piece)
        for i in range(cuts):
            start, stop = total - rest + rest * i // cuts, total - rest + rest * (i + 1) // cuts
            rests.append((doc_id, start, stop - start, zlib.crc32(ids[start:stop]), total))
        if len(rests) >= chunk:
            dealt, sequence = deal(rests, sequence, window)
            yield rows + dealt
            rests, rows = [], []
        elif len(rows) >= 4 * chunk:
            yield rows
            rows = []
    if rests:
        rows += deal(rests, sequence, window)[0]
    if rows:
        yield rows


def deal(rests: list[tuple], sequence: int, window: int) -> tuple[list[tuple], int]:
    windows = near_equal_windows(np.array([r[2] for r in rests], dtype=np.int64), window)
    used = [0] * (int(windows.max()) + 1)
    rows = []
    for rest, w in zip(rests, windows.tolist()):
        rows.append((*rest, sequence + w, used[w]))
        used[w] += rest[2]
    return rows, sequence + len(used)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunk: int = CHUNK, piece: int = PIECE) -> DataFrame:
    """One row per piece of a document: columns of SCHEMA.

    Every document is its text's ids and ``end_id``; null and empty texts are
    the end id alone. A document is cut into whole windows
    and a rest of pieces of nearly equal length; each id lies in one piece. Null ids and repeated rows
    are packed like others; an empty table gives an empty result; further
    columns are not read. Sequence ids are unique: the partition's number is
    their upper part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = WordIds.of(tokenizer)

        def documents():
            for some in slices(batches, 1):
                ids, offsets = words.ids_of(some.column(1), end_id)
                at = offsets.tolist()
                for doc_id, a, b in zip(some.column(0).to_pylist(), at, at[1:]):
                    yield doc_id, ids[a:b]

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for rows in packed(documents(), TaskContext.get().partitionId() << 33, window, chunk, piece):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
        words.forget()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)
