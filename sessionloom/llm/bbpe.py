"""Byte-level BPE by length-bucketed numpy matrices, and its inverse.

The distinct pre-tokens of a batch become rows of padded id matrices, one for
each length bucket. In every round each unfinished row merges its leftmost
pair of least rank, found in a hash table of mergeable pairs, and the matrix is
compacted by the merged cell; a row leaves when none of its pairs is mergeable.
A long pre-token is cut into rows of one width. Ids are right where each two
neighbours come out of merging just the two of them, so a seam is a row too:
the last ids before it and the first after it, merged as one text, and spliced
in from an id that they share with the row before to one that they share with
the row after. Where there is no such id, short rows follow one another from
the last sure id until they meet one. All of it is linear in the length.
Bounded caches keep what a worker has encoded.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as the Rust regex library has it: the White_Space property.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NONE = np.int32(2**31 - 1)
#: Longer pre-tokens are cut into rows of half so many bytes, as with one merge a round a row costs its length squared.
ROW_BYTES = 128
#: Ids on either side of a seam that are merged anew.
SEAM = 4


def with_white(pattern: str) -> str:
    """``pattern`` with \\s and \\S spelled out, as Python's class differs in four characters."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        if c == r"\s":
            out.append(WHITE if inside else f"[{WHITE}]")
        elif c == r"\S" and not inside:
            out.append(f"[^{WHITE}]")
        else:
            inside = c == "[" or inside and c != "]"
            out.append(c)
        i += len(c)
    return "".join(out)


class PairTable:
    """(left id, right id) -> merged id, by open addressing in two arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, ids = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ids.append(rank)
        keys, ids = np.array(keys, dtype=np.int64), np.array(ids, dtype=np.int32)
        self.shift = np.uint64(64 - max(8, int(len(keys) * 3).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.ids = np.full(size + 64, -1, dtype=np.int64), np.full(size + 64, NONE, dtype=np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # of those that want a free slot one gets it, the others move on
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]
            got = self.keys[at] == keys[left]
            self.ids[at[got]] = ids[left[got]]
            at, left = at[~got] + 1, left[~got]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merged id of each pair, NONE where the pair isn't mergeable; -1 is padding."""
        keys = a.astype(np.int64) << 32 | b.astype(np.int64)
        keys[(a < 0) | (b < 0)] = -2
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ids[at], NONE)
        more = np.flatnonzero((found != keys) & (found != -1) & (keys >= 0))
        while len(more):
            at[more] += 1
            found = self.keys[at[more]]
            hit = found == keys[more]
            out[more[hit]] = self.ids[at[more[hit]]]
            more = more[~hit & (found != -1)]
        return out


class ByteBpe:
    """Encoder and decoder for one file of base64 tokens and ranks."""

    _loaded: dict[tuple[str, str], "ByteBpe"] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = 400_000):
        self.ranks = ranks
        self.pattern = regex.compile(with_white(pattern))
        self.pairs = PairTable(ranks)
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.decimals = [str(i) for i in range(len(self.tokens))]
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.lengths = np.array([len(t) for t in self.tokens])
        self.limit = limit
        self.words: dict[str, bytes | None] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> "ByteBpe":
        if (path, pattern) not in cls._loaded:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            cls._loaded[path, pattern] = cls(ranks, pattern)
        return cls._loaded[path, pattern]

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each pre-token."""
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        long = np.flatnonzero(lengths > ROW_BYTES)
        if not len(long):
            return self._merge_matrices(pieces, lengths)
        short = np.flatnonzero(lengths <= ROW_BYTES)
        out: list[np.ndarray] = [np.empty(0, dtype=np.int32)] * len(pieces)
        for i, ids in zip(short.tolist(), self._merge_matrices([pieces[i] for i in short], lengths[short])):
            out[i] = ids
        for i in long.tolist():
            out[i] = self._merge_cut(pieces[i])
        return out

    def _merge_matrices(self, pieces: list[bytes], lengths: np.ndarray | None = None) -> list[np.ndarray]:
        lengths = np.array([len(p) for p in pieces], dtype=np.int64) if lengths is None else lengths
        out: list[np.ndarray] = [np.empty(0, dtype=np.int32)] * len(pieces)
        some = np.flatnonzero(lengths > 0)
        buckets = np.where(lengths[some] <= 16, (lengths[some] + 1) // 2 * 2, 1 << np.ceil(np.log2(np.maximum(lengths[some], 1))).astype(np.int64))
        for width in np.unique(buckets):
            rows = some[buckets == width]
            step = max(1, (1 << 21) // int(width))
            for i in range(0, len(rows), step):
                self._merge_rows(pieces, rows[i : i + step], int(width), lengths, out)
        return out

    def _placed(self, ids: np.ndarray, start: int) -> list[tuple[int, int]]:
        """(where it begins, id) of each id."""
        ends = np.cumsum(self.lengths[ids])
        return list(zip((ends - self.lengths[ids] + start).tolist(), ids.tolist()))

    def _merge_cut(self, piece: bytes) -> np.ndarray:
        """Ids of a long pre-token: rows of one width, and a row for each seam between two of them."""
        width = ROW_BYTES // 2
        starts = range(0, len(piece), width)
        rows = [self._placed(ids, start) for start, ids in zip(starts, self._merge_matrices([piece[i : i + width] for i in starts]))]
        spans = [(a[-SEAM:][0][0], b[:SEAM][-1][0] + int(self.lengths[b[:SEAM][-1][1]])) for a, b in zip(rows, rows[1:])]
        seams = [self._placed(ids, start) for (start, _), ids in zip(spans, self._merge_matrices([piece[a:b] for a, b in spans]))]
        known = [set(row) for row in rows]
        out, k = rows[0], 0
        while k + 1 < len(rows):
            cut = (k + 1) * width
            tail = dict.fromkeys(out[-4 * SEAM :])
            seam = seams[k]
            left = max((i for i, x in enumerate(seam) if x[0] < cut and x in tail), default=None)
            right = min((i for i, x in enumerate(seam) if x[0] >= cut and x in known[k + 1]), default=None)
            if left is None or right is None:
                k = self._chain(piece, out, known)
                if k < 0:
                    break
            else:
                while out[-1] != seam[left]:
                    out.pop()
                out += seam[left + 1 : right + 1]
                k += 1
            # the rest of the row that the last id is part of
            row = rows[k]
            out += row[row.index(out[-1]) + 1 :]
        return np.array([i for _, i in out], dtype=np.int32)

    def _chain(self, piece: bytes, out: list[tuple[int, int]], known: list[set[tuple[int, int]]]) -> int:
        """Go on from the last sure ids row by row, until an id of one of the rows is met; that row's number, or -1 at the end."""
        width = ROW_BYTES // 2
        after = out[-1][0] // width + 1 if out else 0
        back, size = 2, ROW_BYTES
        while True:
            first = out[-back] if len(out) >= back else (0, None)
            ids = self._placed(self._merge_matrices([piece[first[0] : first[0] + size]])[0], first[0])
            if first[1] is not None and ids[0] != first:
                back, size = back + 2, size * 2
                continue
            end = first[0] + size >= len(piece)
            sure = ids if end else ids[: max(2, len(ids) - SEAM)]
            if not end and len(ids) <= SEAM + 1:
                size *= 2
                continue
            del out[len(out) - back + 1 if first[1] is not None else 0 :]
            for x in sure[1:] if first[1] is not None else sure:
                out.append(x)
                row = x[0] // width
                if row >= after and x in known[row]:
                    return row
            if end:
                return -1
            back, size = 2, ROW_BYTES

    def _merge_rows(self, pieces: list[bytes], rows: np.ndarray, width: int, lengths: np.ndarray, out: list[np.ndarray]) -> None:
        data = np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in rows]), np.uint8).reshape(len(rows), width)
        size = lengths[rows]
        ids = np.where(np.arange(width) < size[:, None], self.byte_ids[data], np.int32(-1))
        rank = self.pairs.merged(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1) if width > 1 else np.full((len(rows), 1), NONE)
        while True:
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            least = rank[np.arange(len(rows)), at] if rank.shape[1] else np.full(len(rows), NONE)
            for r in np.flatnonzero(least == NONE):
                out[rows[r]] = ids[r, : size[r]].copy()
            live = np.flatnonzero(least != NONE)
            if not len(live):
                return
            rows, size, ids, rank, at, least = rows[live], size[live] - 1, ids[live], rank[live], at[live], least[live]
            n, w = ids.shape
            each = np.arange(n)
            ids[each, at] = least
            keep = np.ones((n, w), dtype=bool)
            keep[each, at + 1] = False
            ids = ids[keep].reshape(n, w - 1)
            # the pair's own rank goes; those on either side are looked up anew
            keep = np.ones((n, w - 1), dtype=bool)
            keep[each, at] = False
            rank = rank[keep].reshape(n, w - 2)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < w - 2)
            rank[left, at[left] - 1] = self.pairs.merged(ids[left, at[left] - 1], ids[left, at[left]])
            rank[right, at[right]] = self.pairs.merged(ids[right, at[right]], ids[right, at[right] + 1])

    def _bytes_of(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, pre-token by pre-token, as little-endian 32-bit integers."""
        cut = [self.pattern.findall(t) for t in texts]
        distinct = list({p for pieces in cut for p in pieces})
        ids = dict(zip(distinct, (x.astype("<u4").tobytes() for x in self.merge([p.encode() for p in distinct]))))
        return [b"".join(map(ids.__getitem__, pieces)) for pieces in cut]

    def _learn(self, words: list[str]) -> dict[str, bytes | None]:
        # a word is kept with the space before it; white space at its ends may belong to a longer run
        plain = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        out: dict[str, bytes | None] = dict.fromkeys(words)
        out.update(zip(plain, self._bytes_of([" " + w for w in plain])))
        return out

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text; null counts as empty.

        Between single spaces no pre-token crosses a space, so those words are
        looked up one by one; a text with longer runs of white space next to a
        space is cut as a whole.
        """
        out: list[bytes] = [b""] * len(texts)
        parts = [(t or "").split(" ") for t in texts]
        seen: set[str] = set()
        for p in parts:
            seen.update(p[1:])
        missing = list(seen.difference(self.words))
        if len(self.words) + len(missing) > self.limit:
            self.words.clear()
            missing = list(seen)
        self.words.update(self._learn(missing))
        heads, whole, words = [], [], self.words
        for i, p in enumerate(parts):
            try:
                out[i] = b"".join([words[w] for w in p[1:]])
                if p[0] and (len(p) == 1 or not p[0][-1].isspace()):
                    heads.append(i)
                elif p[0]:
                    whole.append(i)
            except TypeError:
                whole.append(i)
        for w in missing:  # long words aren't kept, so memory is bounded whatever the words
            if len(w) > 64:
                del words[w]
        for i, x in zip(heads, self._bytes_of([parts[i][0] for i in heads])):
            out[i] = x + out[i]
        for i, x in zip(whole, self._bytes_of([texts[i] for i in whole])):
            out[i] = x
        return [np.frombuffer(x, dtype="<u4") for x in out]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of each row: the text's ids, without special tokens; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(ranks_path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                ids = pa.array([x.astype(np.int32) for x in bpe.encode_all(some.column(1).to_pylist())], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column(0), ids], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, data) from (doc_id, ids): the bytes that the ids stand for; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(ranks_path, pattern)
        for batch in batches:
            data = pa.array([bpe.decode(np.array(x or [], dtype=np.int64)) for x in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), data], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode, and give digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Both steps run in one task, so ids aren't shipped between them. One row per
    row of ``docs``, repeated rows and null ids too; null and empty texts have
    no ids; an empty table gives an empty result; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(ranks_path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                n, ids_hex, data_hex = [], [], []
                for ids in bpe.encode_all(some.column(1).to_pylist()):
                    n.append(len(ids))
                    ids_hex.append(hashlib.sha256(",".join(map(bpe.decimals.__getitem__, ids.tolist())).encode()).hexdigest())
                    data_hex.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), pa.array(ids_hex), pa.array(data_hex)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
