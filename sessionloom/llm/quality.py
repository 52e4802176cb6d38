"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its words, their character
n-grams and its word pairs, all hashed to buckets; a softmax over a linear map
of that mean gives the classes. Training is stochastic gradient descent in
numpy over a bounded sample of labelled documents; scoring runs in tasks over
whole texts and shuffles nothing.

A pair's bucket is the difference of the words' hashes, so all immediate
repetitions, of whatever word, share one learned vector.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, held_out

#: Labelled documents to learn from, at most about this many of each class.
SAMPLE_PER_CLASS = 2000
#: Words of more characters are hashed as arrays, in pieces of so many n-grams, and aren't kept.
LONG, PIECE = 80, 1 << 16
BUCKETS = 1 << 17
DIM, EPOCHS, RATE = 16, 6, 0.4
NGRAMS = (3, 4)


_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def word_features(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams."""
    out = [zlib.crc32(word.encode()) % BUCKETS]
    if len(word) > LONG:
        for piece in long_ngrams(word):
            out += piece.tolist()
        return out
    marked = f"<{word}>"
    for n in NGRAMS:
        out += [zlib.crc32(marked[i : i + n].encode(), n) % BUCKETS for i in range(len(marked) - n + 1)]
    return out


def long_ngrams(word: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a word of any length, piece by piece: crc32 of all windows of a piece at once."""
    marked = f"<{word}>"
    for n in NGRAMS:
        for i in range(0, len(marked) - n + 1, PIECE):
            data = np.frombuffer(marked[i : i + PIECE + n - 1].encode(), np.uint8)
            # where characters begin, and the end
            at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
            first, size = at[:-n], at[n:] - at[:-n]
            crc = np.full(len(first), n ^ 0xFFFFFFFF, np.uint32)
            for k in range(int(size.max())):
                own = size > k
                crc[own] = _CRC[(crc[own] ^ data[first[own] + k]) & 255] ^ (crc[own] >> 8)
            yield ((crc ^ np.uint32(0xFFFFFFFF)) % BUCKETS).astype(np.int64)


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    return BUCKETS + (hashes[1:] - hashes[:-1]) % BUCKETS


def _bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the whole text, and how often each occurs."""
    words = (text or "").split()
    total = np.zeros(2 * BUCKETS, np.int64)
    # in pieces; a piece begins with the last word of the one before
    for i in range(0, len(words), 50_000):
        some, ids = words[max(0, i - 1) : i + 50_000], []
        for w in some[1:] if i else some:
            if len(w) > LONG:
                ids.append(zlib.crc32(w.encode()) % BUCKETS)
                for piece in long_ngrams(w):
                    total[:BUCKETS] += np.bincount(piece, minlength=BUCKETS)
            else:
                ids += word_features(w)
        ids += pair_buckets(np.array([zlib.crc32(w.encode()) % BUCKETS for w in some], dtype=np.int64)).tolist()
        total += np.bincount(np.array(ids, dtype=np.int64), minlength=2 * BUCKETS)
    ids = np.flatnonzero(total)
    return ids, total[ids]


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, prior: np.ndarray, seed: int = 7) -> np.ndarray:
    """Class scores of each bucket, by which a document's logits are a mean, plus the log prior in the last row."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (2 * BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((classes, DIM), np.float32), np.zeros(classes, np.float32)
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            ids, counts = bags[i]
            rate = RATE * (1 - done / steps)
            done += 1
            if not len(ids):
                continue
            share = (counts / counts.sum()).astype(np.float32)
            doc = share @ vectors[ids]
            z = out @ doc + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out.T @ p
            out -= rate * np.outer(p, doc)
            bias -= 0.1 * rate * p
            # a bucket's step grows with its share, but not to nothing in a long text
            vectors[ids] -= rate * np.outer(np.sqrt(share), back)
    return np.concatenate([vectors @ out.T, [bias + prior]]).astype(np.float32)


class Scorer:
    """Probabilities of whole texts; keeps the sums of words it has met, up to a limit."""

    def __init__(self, table: np.ndarray, limit: int = 400_000):
        self.table, self.limit = table[:-1], limit
        self.last = table[-1]
        self.slots: dict[str, int] = {}
        self.sums = np.zeros((limit, table.shape[1]), np.float32)
        self.sizes = np.zeros(limit, np.int64)
        self.hashes = np.zeros(limit, np.int64)

    def _learn(self, words: list[str]) -> None:
        at = len(self.slots)
        self.slots.update(zip(words, range(at, at + len(words))))
        long = [w for w in words if len(w) > LONG]
        for w in long:
            k, own = self.slots[w], zlib.crc32(w.encode()) % BUCKETS
            total, size = self.table[own].astype(np.float64), 1
            for piece in long_ngrams(w):
                total += self.table[piece].sum(axis=0, dtype=np.float64)
                size += len(piece)
            self.sums[k], self.sizes[k], self.hashes[k] = total, size, own
        # long words come last
        words = words[: len(words) - len(long)]
        if not words:
            return
        features = [word_features(w) for w in words]
        sizes = np.array([len(f) for f in features])
        flat = np.fromiter((i for f in features for i in f), np.int64, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        self.sums[at : at + len(words)] = np.add.reduceat(self.table[flat], starts, axis=0)
        self.sizes[at : at + len(words)] = sizes
        self.hashes[at : at + len(words)] = flat[starts]

    def probabilities(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        z = self.last.astype(np.float64)
        total, size = np.zeros(len(z)), 0
        # in pieces, so that any text fits the cache; a piece begins with the last word of the one before
        for i in range(0, len(words), 50_000):
            some = words[max(0, i - 1) : i + 50_000]
            missing = list(set(some).difference(self.slots))
            if len(self.slots) + len(missing) > self.limit:
                self.slots.clear()
                missing = list(set(some))
            if missing:
                self._learn(sorted(missing, key=lambda w: len(w) > LONG))
            slots = np.fromiter(map(self.slots.__getitem__, some), np.int64, len(some))
            pairs = pair_buckets(self.hashes[slots])
            own = slots[1:] if i else slots
            total += self.sums[own].sum(axis=0, dtype=np.float64) + self.table[pairs].sum(axis=0, dtype=np.float64)
            size += int(self.sizes[own].sum()) + len(pairs)
            for w in missing:
                if len(w) > LONG:
                    del self.slots[w]
        z = z + total / max(1, size)
        p = np.exp(z - z.max())
        return p / p.sum()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> np.ndarray:
    """Learn from labelled documents that are not held out: about ``per_class`` of each class.

    Repeated labels count once; an id labelled both ways is learned both ways.
    Null ids and labels other than 0 and 1 are left out. Without any label the
    scores are all one half.
    """
    keys = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                some = batch.slice(i, 100)
                bags = [_bag(t) for t in some.column(2).to_pylist()]
                ids, counts = (pa.array([b[k] for b in bags], pa.list_(t)) for k, t in enumerate([pa.int32(), pa.int64()]))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), ids, counts], names=["doc_id", "label", "ids", "counts"])

    # the sample has about 2 * per_class rows, whatever the input's size
    chosen = F.broadcast(bounded_sample(keys, "label", "doc_id", per_class))
    rows = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .join(chosen, "doc_id")
        .select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text")
        .mapInArrow(run, "doc_id long, label int, ids array<int>, counts array<long>")
        .dropDuplicates(["doc_id", "label"])
        .toArrow()
        .sort_by([("doc_id", "ascending"), ("label", "ascending")])
    )
    marks = rows.column("label").to_numpy()
    if not len(marks):
        return np.zeros((2 * BUCKETS + 1, 2), np.float32)
    bags = [(np.asarray(x.values), np.asarray(y.values)) for x, y in zip(rows.column("ids"), rows.column("counts"))]
    share = {r["label"]: r["count"] for r in keys.groupBy("label").count().collect()}
    prior = np.log([(share.get(c, 0) + 1) / (np.sum(marks == c) + 1) for c in (0, 1)])
    return train(bags, marks, 2, prior - prior.max())


def with_quality(docs: DataFrame, table: np.ndarray, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """``docs`` with the probability of label 1; a column of the name is replaced.

    Null and empty texts get the score of no words, the prior's. Repeated rows
    and nulls elsewhere are kept; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(table)
    kept = docs.drop(score_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                p = pa.array([float(scorer.probabilities(t)[1]) for t in some.column(text_col).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*some.columns, p], names=[*some.schema.names, score_col])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(score_col, T.DoubleType())]))


def score(docs: DataFrame, table: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.5 on) of each row, by ``with_quality``; further columns are not read."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    scored = with_quality(own, table)
    return scored.select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
