"""SentencePiece BPE by a table of prefixes, and its inverse.

The encoding of every prefix of a word ends in one certain piece. An automaton
finds the pieces that end at each place; the one whose predecessor, the last
piece of the prefix before it, merges with it to exactly those two pieces is
that prefix's last piece. One pass fills the table, in time linear in the
text, and the ids are read off it backwards. Which two pieces stay two is
found once a pair, from the order in which each is merged, and kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SPACE = "▁"
#: Joins words in one pass of the automaton; never part of a word.
_GAP = "\n"


class PieceBpe:
    """Encoder and decoder for one BPE model file with byte fallback and the identity normaliser.

    Words are runs of spaces with the mergeable characters after them; any
    other character is a word of its own. No piece crosses words, so each
    distinct word is encoded once and kept: at most ``limit`` words and pairs,
    each of at most 64 characters, so memory is bounded whatever the texts.
    """

    _loaded: dict[str, "PieceBpe"] = {}

    def __init__(self, path: str, limit: int = 300_000):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, spec = model.normalizer_spec, model.trainer_spec
        if spec.model_type != spec.BPE or not spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or spec.treat_whitespace_as_suffix:
            raise ValueError("this encoder takes BPE models with byte fallback, a space put in front and no normalising")
        kinds = model.SentencePiece
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("this encoder takes models without user-defined and unused pieces")
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.byte_ids = [i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE]
        self.end = spec.eos_id
        self.decimals = [str(i) for i in range(len(model.pieces))]
        self.data = [b"" if p.type == kinds.CONTROL else spec.unk_surface.encode() if p.type == kinds.UNKNOWN else bytes([self.byte_ids.index(i)]) if p.type == kinds.BYTE else p.piece.replace(SPACE, " ").encode() for i, p in enumerate(model.pieces)]
        self.is_byte = np.zeros(len(model.pieces), dtype=bool)
        self.is_byte[self.byte_ids] = True
        self.silent = np.array([not d for d in self.data])
        self.spaced = np.array([p.type == kinds.NORMAL and p.piece.startswith(SPACE) for p in model.pieces])
        several = [p for p in self.score if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in several):
            raise ValueError("pieces of this model cross words")
        # runs of spaces are merged last, from the left, as their pieces share the lowest score
        runs = [p for p in several if not p.strip(SPACE)]
        self.runs = {len(p) for p in runs}
        least = min((self.score[p] for p in several if p.strip(SPACE)), default=0.0)
        if len({self.score[p] for p in runs}) > 1 or any(self.score[p] >= least for p in runs):
            raise ValueError("pieces of spaces of this model are not its last merges")
        letters = sorted({c for p in several for c in p} - {SPACE})
        # words end where letters meet other characters too, if no piece has both
        kinds_of = [{c.isalpha() for c in p} for p in (p.strip(SPACE) for p in several)]
        groups = [letters] if any(len(k) > 1 for k in kinds_of) else [[c for c in letters if c.isalpha()], [c for c in letters if not c.isalpha()]]
        runs_of = "|".join(f"[{''.join(map(re.escape, g))}]+" for g in groups if g)
        self.words = re.compile(f"{SPACE}*(?:{runs_of})|{SPACE}+|[^{SPACE}]" if runs_of else f"{SPACE}+|[^{SPACE}]", re.S)
        self.letters = set(letters)
        self.automaton = ahocorasick.Automaton()
        self.text: list[str] = []
        # of each piece the steps that build it: the step's score, and its first and last part after it
        self.steps: list[list[tuple[float, str, str]]] = []
        for p in [*(p for p in several if p.strip(SPACE)), *letters, SPACE]:
            steps = self._steps(p)
            if len(p) == 1 or steps[-1][1] == p:  # other pieces are never the outcome of merging
                self.automaton.add_word(p, (len(self.text), len(p)))
                self.text.append(p)
                self.steps.append(steps)
        self.automaton.make_automaton()
        self.ids_of_piece = [np.asarray([self.id[p]] if p in self.id else [self.byte_ids[b] for b in p.encode()], dtype="<u4").tobytes() for p in self.text]
        self.limit = limit
        self.stays: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> "PieceBpe":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _steps(self, text: str) -> list[tuple[float, str, str]]:
        """How a short text is merged, the best pair first, the leftmost of equals: (score, first part, last part) after each step.

        The list begins with the single characters.
        """
        parts, score = list(text), self.score
        out = [(0.0, parts[0], parts[-1])]
        while True:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1], -np.inf)
                if s > best:
                    best, at = s, i
            if at < 0:
                return out
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            out.append((best, parts[0], parts[-1]))

    def _stay(self, a: int, b: int) -> bool:
        """Whether piece ``b`` after piece ``a`` is merged to just these two.

        Until a pair across the border is merged, either side takes its own
        steps, the better of the two next ones first. The pair across, which
        changes with the parts at the border, must never be better.
        """
        left, right = self.steps[a], self.steps[b]
        i = j = 1
        ok = True
        while True:
            across = self.score.get(left[i - 1][2] + right[j - 1][1], -np.inf)
            mine = left[i][0] if i < len(left) else -np.inf
            other = right[j][0] if j < len(right) else -np.inf
            if across > mine and across >= other:
                ok = False
                break
            if mine == other == -np.inf:
                break
            if mine >= other:
                i += 1
            else:
                j += 1
        if len(self.stays) >= self.limit:
            self.stays.clear()
        self.stays[a << 20 | b] = ok
        return ok

    def _spaces(self, n: int) -> bytes:
        """Ids of n spaces that no letter has taken: the leftmost pair that is a piece is merged again and again."""
        done: list[int] = []
        for _ in range(n):
            done.append(1)
            # left of the newest space nothing can be merged, so only pairs with it are new
            while len(done) > 1 and done[-2] + done[-1] in self.runs:
                done[-2:] = [done[-2] + done[-1]]
        return np.asarray([self.id[SPACE * k] for k in done], dtype="<u4").tobytes()

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words as little-endian 32-bit integers.

        Words are laid side by side; of the spaces before a word the last one
        alone can merge with a letter, so the table begins with it.
        """
        spaces = [len(w) - len(w.lstrip(SPACE)) for w in words]
        joined = _GAP.join([w[max(0, n - 1) :] if n < len(w) else "" for w, n in zip(words, spaces)])
        last = [-1] * (len(joined) + 1)
        begins = bytearray(len(joined) + 1)
        begins[0] = 1
        at = joined.find(_GAP)
        while at >= 0:
            begins[at + 1] = 1
            at = joined.find(_GAP, at + 1)
        stays, stay = self.stays, self._stay
        for end, (piece, length) in self.automaton.iter(joined):
            if last[end] < 0:
                start = end - length + 1
                before = last[start - 1]
                if begins[start] or before >= 0 and ((ok := stays.get(before << 20 | piece)) or ok is None and stay(before, piece)):
                    last[end] = piece
        out: list[bytes] = []
        text, ids, place = self.text, self.ids_of_piece, 0
        for w, n in zip(words, spaces):
            if n == len(w):
                out.append(self._spaces(n))
                place += 1
                continue
            size = len(w) - max(0, n - 1)
            found, at = [], place + size - 1
            while at >= place:
                found.append(last[at])
                at -= len(text[last[at]])
            found.reverse()
            place += size + 1
            if n and text[found[0]] == SPACE:
                out.append(self._spaces(n) + b"".join([ids[p] for p in found[1:]]))
            else:
                out.append((self._spaces(n - 1) if n > 1 else b"") + b"".join([ids[p] for p in found]))
        return out

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that are not kept yet, by the table; a character that merges with nothing is its piece or its bytes."""
        out: dict[str, bytes] = {}
        table = []
        for w in words:
            if len(w) == 1 and w not in self.letters and w != SPACE:
                ids = [self.id[w]] if w in self.id else [self.byte_ids[b] for b in w.encode()]
                out[w] = np.asarray(ids, dtype="<u4").tobytes()
            else:
                table.append(w)
        start, size = 0, 0
        for i, w in enumerate(table):
            size += len(w)
            if size > 1 << 18 or i == len(table) - 1:
                out.update(zip(table[start : i + 1], self._encode_words(table[start : i + 1])))
                start, size = i + 1, 0
        return out

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text and the end id; null counts as empty, which is the end id alone."""
        cut = [self.words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        distinct = set().union(*cut)
        new = [w for w in distinct if w not in self.known]
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
            new = list(distinct)
        found = self._learn(new)
        long = {w: x for w, x in found.items() if len(w) > 64}
        self.known.update((w, x) for w, x in found.items() if len(w) <= 64)
        end = np.asarray([self.end], dtype="<u4").tobytes()
        known = self.known
        look = known.__getitem__ if not long else lambda w: long[w] if w in long else known[w]
        return [np.frombuffer(b"".join([*map(look, words), end]), dtype="<u4") for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces with spaces, without the one put in front; bytes that are no character give U+FFFD each.

        Bytes make up a character only where no other id is between them.
        """
        ids = np.asarray(ids, dtype=np.int64)
        shown = ids[~self.silent[ids]]
        parts = [self.data[i] for i in shown.tolist()]
        if parts and self.spaced[shown[0]]:
            parts[0] = parts[0][1:]
        raw = self.is_byte[ids]
        if not raw.any():
            return b"".join(parts).decode()
        edges = np.flatnonzero(np.diff(np.concatenate([[False], raw, [False]])))
        place = np.cumsum(~self.silent[ids]) - 1
        out, at = [], 0
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            first, stop = int(place[a]), int(place[b - 1]) + 1
            out += [b"".join(parts[at:first]).decode(), _characters(b"".join(parts[first:stop]))]
            at = stop
        return "".join([*out, b"".join(parts[at:]).decode()])


def _characters(data: bytes) -> str:
    """The characters of UTF-8 bytes; each byte that is part of none gives U+FFFD."""
    out, at = [], 0
    while True:
        try:
            return "".join([*out, data[at:].decode()])
        except UnicodeDecodeError as e:
            out += [data[at : at + e.start].decode(), "\ufffd"]
            at += e.start + 1


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of each row, the end id last; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PieceBpe.of(model)
        for some in slices(batches, 1):
            ids = pa.array([x.astype(np.int32) for x in bpe.encode_all(some.column(1).to_pylist())], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([some.column(0), ids], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PieceBpe.of(model)
        for batch in batches:
            text = pa.array([bpe.decode(np.asarray(x or [], dtype=np.int64)) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode, and give digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Both steps run in one task, so ids aren't shipped between them. One row per
    row of ``docs``, repeated rows and null ids too; null and empty texts are
    the end id alone; an empty table gives an empty result; further columns
    are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PieceBpe.of(model)
        for some in slices(batches, 1):
            n, ids_hex, text_hex = [], [], []
            for ids in bpe.encode_all(some.column(1).to_pylist()):
                n.append(len(ids))
                ids_hex.append(hashlib.sha256(" ".join(map(bpe.decimals.__getitem__, ids.tolist())).encode()).hexdigest())
                text_hex.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
