"""Helpers shared by the corpus operators: held-out fold, bounded samples, word ids."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise, scratch_path  # noqa: F401


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model may learn from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded_sample(keys: DataFrame, stratum: str, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows of each stratum (all, if it has fewer), chosen by a hash of the key.

    One small aggregate counts the strata; the choice is a filter, so nothing
    is sorted or gathered and the same rows are chosen on each run.
    """
    counts = {r[stratum]: r["count"] for r in keys.groupBy(stratum).count().collect()}
    unit = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(77)), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        if value is not None:
            keep = keep | ((F.col(stratum) == F.lit(value)) & (unit < min(1.0, bound / n)))
    return keys.where(keep)


_TOKENIZERS: dict[str, "WordIds"] = {}
#: Words of these characters alone are cut into pre-tokens here; others go to the tokenizer whole.
_NOT_SIMPLE = "[^\\x21-\\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff ]+| ")
#: Texts with such characters, or with the string of an added token, are encoded whole.
_ODD = "[\\x1c-\\x1f\u0130\u03a3\u0300-\u036f]"
#: The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on.
_SHOWN = {b: chr(b) for b in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
_SHOWN |= {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_AS_BYTES = {chr(c): "".join(_SHOWN[b] for b in chr(c).encode()) for c in [*range(0xDF, 0xF7), *range(0xF8, 0x100)]}
_BREAK = np.uint32(2**32 - 1)


class WordIds:
    """Ids of whole texts by a lower-casing tokenizer whose pre-tokens never cross white space.

    Such a tokenizer gives a text the ids of its words in order, so each
    distinct word of a worker is encoded once and kept, as is each distinct
    pre-token. Texts are cut into words and the words numbered by Arrow; ids
    of the numbered words are then laid out by numpy. New pre-tokens go to the
    library joined by spaces; as each ends in an id that carries the
    end-of-word mark, the ids are cut apart again. Either cache is emptied at
    ``limit`` entries and keeps none of more than ``LONGEST`` characters, which
    bounds memory whatever the words.
    """

    LONGEST = 64

    def __init__(self, path: str, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # for pre-tokens, which are lower-case words in byte characters already: the same model without the steps before it
        bare = json.loads(self.tokenizer.to_str()) | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        vocab = self.tokenizer.get_vocab()
        self.size = max(vocab.values()) + 1
        self.ends = np.zeros(self.size, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.odd = "|".join([_ODD, *(re.escape(t.content) for t in added)])
        self.limit = limit
        self.cache: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {" ": _BREAK.tobytes()}

    @classmethod
    def of(cls, path: str) -> "WordIds":
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = cls(path)
        return _TOKENIZERS[path]

    def forget(self) -> None:
        """Empty the caches, at the end of a task, as a worker's memory is needed by other tasks then."""
        self.cache, self.pieces = {}, {" ": _BREAK.tobytes()}
        pa.default_memory_pool().release_unused()

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _learn_pieces(self, wanted: set[str]) -> None:
        known = self.pieces
        new = list(wanted.difference(known))
        if len(known) + len(new) > self.limit:
            known.clear()
            known[" "] = _BREAK.tobytes()
            new = list(wanted.difference(known))
        self.passing = [p for p in new if len(p) > self.LONGEST]
        for i in range(0, len(new), 8000):
            some = new[i : i + 8000]
            joined = " ".join(some)
            if not joined.isascii():
                for c, shown in _AS_BYTES.items():
                    joined = joined.replace(c, shown)
            ids = np.asarray(self.bare.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) != len(some):
                known.update((p, self.whole(p)) for p in some)
                continue
            data, start = ids.tobytes(), 0
            for p, stop in zip(some, ends):
                known[p] = data[4 * start : 4 * stop]
                start = stop

    def _learn(self, words: list[str]) -> None:
        odd = pc.match_substring_regex(pa.array(words, pa.string()), _NOT_SIMPLE).to_numpy(zero_copy_only=False).tolist()
        simple = [w for w, x in zip(words, odd) if not x]
        if simple:
            found = _PIECES.findall(" ".join(simple).lower())
            self._learn_pieces(set(found))
            data = b"".join(map(self.pieces.__getitem__, found))
            for p in self.passing:
                del self.pieces[p]
            at = np.flatnonzero(np.frombuffer(data, "<u4") == _BREAK) * 4
            for w, a, b in zip(simple, [0, *(at + 4).tolist()], [*at.tolist(), len(data)]):
                self.cache[w] = data[a:b]
        if len(simple) < len(words):
            for w, x in zip(words, odd):
                if x:
                    self.cache[w] = self.whole(w)

    def ids_of(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all texts in one array of 32-bit integers, and where each text begins.

        Null counts as empty; ``end``, if given, follows each text. Texts with
        characters that Arrow takes for white space and the tokenizer doesn't,
        whose lower case depends on the context, or in which the tokenizer
        finds added tokens are encoded whole.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        whole = np.flatnonzero(pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False))
        if len(whole):
            mask = np.zeros(n, dtype=bool)
            mask[whole] = True
            held = {i: self.whole(texts[i].as_py()) for i in whole.tolist()}
            texts = pc.if_else(pa.array(mask), "", texts)
        cut = pc.utf8_split_whitespace(texts)
        words = cut.values.slice(cut.offsets[0].as_py(), cut.offsets[-1].as_py() - cut.offsets[0].as_py()).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = words.indices.to_numpy()
        first = cut.offsets.to_numpy() - cut.offsets[0].as_py()

        new = [w for w in distinct if w and w not in self.cache]
        if len(self.cache) + len(new) > self.limit:
            self.cache.clear()
            new = [w for w in distinct if w]
        self.cache[""] = b""
        self._learn(new)
        known = list(map(self.cache.__getitem__, distinct))
        for w in new:
            if len(w) > self.LONGEST:
                del self.cache[w]
        size = np.fromiter(map(len, known), np.int32, len(known)) >> 2
        ids = np.frombuffer(b"".join(known), "<u4")
        each = size[number]
        stop = np.zeros(len(each) + 1, dtype=np.int64)
        np.cumsum(each, out=stop[1:])
        offsets = stop[first]
        start = np.cumsum(size, dtype=np.int64) - size
        at = np.repeat(start[number] - stop[:-1], each)
        at += np.arange(len(at))
        flat = ids[at]
        if len(whole):
            parts, at = [], 0
            for i, x in held.items():
                parts += [flat[at : offsets[i]], np.frombuffer(x, "<u4")]
                at = offsets[i]
            flat = np.concatenate([*parts, flat[at:]])
            more = np.zeros(n + 1, dtype=np.int64)
            more[whole + 1] = [len(x) // 4 for x in held.values()]
            offsets = offsets + np.cumsum(more)
        if end is not None:
            offsets = offsets + np.arange(n + 1)
            out = np.empty(offsets[-1], dtype="<u4")
            last = np.zeros(len(out), dtype=bool)
            last[offsets[1:] - 1] = True
            out[last], out[~last] = end, flat
            flat = out
        return flat, offsets

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, offsets = self.ids_of(pa.array(texts, pa.large_string()))
        return [ids[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def slices(batches: Iterable[pa.RecordBatch], column: int, rows: int = 512, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of at most so many rows and, but for single rows, about so many bytes in that column."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        start = 0
        while start < batch.num_rows:
            n = int(np.searchsorted(np.cumsum(lengths[start : start + rows], dtype=np.int64), size)) + 1
            n = min(n, rows, batch.num_rows - start)
            yield batch.slice(start, n)
            start += n


def without_duplicates(docs: DataFrame, classes_of: Callable[[DataFrame, str], DataFrame], id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay when one of each class does, with the columns of ``docs``.

    ``classes_of(docs, id_col)`` gives (doc_id, kept) and a class, ``keep_id``
    or ``class_id``, of each row. Of a class the row of the least id stays,
    null ids last. Where ids are unique, the usual case, only the ids of
    dropped rows are joined. Where some repeat or are null, rows are written
    with numbers of their own and classes are made of those, so that each row
    is judged by its own text.
    """
    several = docs.groupBy(F.col(id_col).alias("id")).count().where("count > 1 OR id IS NULL")
    if several.isEmpty():
        gone = materialise(classes_of(docs, id_col).where("NOT kept").select(F.col("doc_id").alias(unused(docs))).distinct(), "dropped")
        return docs.join(gone, docs[id_col] == gone[gone.columns[0]], "left_anti")
    row = unused(docs)
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    classes = classes_of(rows.select(*docs.columns, row), row)
    class_id = "class_id" if "class_id" in classes.columns else "keep_id"
    classes = materialise(classes.select(F.col("doc_id").alias("_r"), F.col(class_id).alias("_c")).join(rows.select(F.col(row).alias("_r"), F.col(id_col).alias("_i")), "_r"), "row-classes")
    first = classes.groupBy("_c").agg(F.min(F.struct(F.col("_i").isNull().alias("n"), "_i", "_r")).alias("first"))
    stay = materialise(first.select(F.col("first._r").alias("_r")), "stay")
    return rows.join(stay, rows[row] == stay["_r"], "left_semi").select(*docs.columns)


def unused(docs: DataFrame) -> str:
    """A column name that ``docs`` has not."""
    taken, name = {c.lower() for c in docs.columns}, "_row"
    while name in taken:
        name += "_"
    return name
