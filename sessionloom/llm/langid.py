"""Language identification by a byte convolutional network.

Lower-cased UTF-8 is cut into fixed-length windows. Filters of several widths
run over byte vectors, the largest response of each filter in a window passes
on, and a softmax gives the languages; a text's probabilities are the mean
over its windows, by their bytes. Training is in numpy on all windows of a
bounded sample of texts; scoring runs in tasks over whole texts, in batches of windows, and
shuffles nothing.

For scoring, the filters are folded into two tables over byte pairs: a filter
of up to four bytes responds with the sum of one entry of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, held_out, unused

WINDOW = 192
#: Texts to learn from, with all their windows: at most about this many of each language.
SAMPLE_PER_LANGUAGE = 250
WIDTHS, FILTERS, DIM = (2, 3, 4), 10, 8
EPOCHS, RATE, BATCH = 3, 0.01, 128
UNKNOWN = "und"


def windows(data: bytes, size: int = WINDOW) -> bytes:
    """``data`` padded with zeros to a positive multiple of ``size``."""
    return data + bytes(-len(data) % size or (0 if data else size))


class ByteCnn:
    """Byte vectors, filters of several widths, and the softmax layer."""

    def __init__(self, languages: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages = languages
        n = len(WIDTHS) * FILTERS
        self.p = {
            "emb": rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
            **{f"w{k}": rng.normal(0, (k * DIM) ** -0.5, (k * DIM, FILTERS)).astype(np.float32) for k in WIDTHS},
            "b": np.zeros(n, np.float32),
            "out": rng.normal(0, n**-0.5, (n, len(languages))).astype(np.float32),
            "bias": np.zeros(len(languages), np.float32),
        }

    def fit(self, codes: np.ndarray, labels: np.ndarray, seed: int = 5) -> None:
        """``codes``: (n, WINDOW) bytes. Half of them are cut short in each epoch, as short texts are."""
        rng = np.random.default_rng(seed)
        p = self.p
        m1, m2, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(codes))
            for i in range(0, len(order), BATCH):
                rows = order[i : i + BATCH]
                x = codes[rows].copy()
                short = np.flatnonzero(rng.random(len(rows)) < 0.5)
                stop = rng.integers(6, x.shape[1], len(short))
                x[short] = np.where(np.arange(x.shape[1]) < stop[:, None], x[short], 0)
                for name, g in self._gradient(x, labels[rows]).items():
                    if name == "w2":
                        t += 1
                    m1[name] += 0.1 * (g - m1[name])
                    m2[name] += 0.01 * (g * g - m2[name])
                    p[name] -= RATE * (m1[name] / (1 - 0.9 ** max(t, 1))) / (np.sqrt(m2[name] / (1 - 0.99 ** max(t, 1))) + 1e-6)

    def _gradient(self, x: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        # as in scoring, zeros after the window let every filter begin at all places but the last
        x = np.pad(x, ((0, 0), (0, max(WIDTHS) - 2)))
        emb = p["emb"][x]
        pooled, where = [], []
        for k in WIDTHS:
            view = np.lib.stride_tricks.sliding_window_view(emb[:, : x.shape[1] - max(WIDTHS) + k], k, axis=1)  # (n, t, DIM, k)
            flat = view.transpose(0, 1, 3, 2).reshape(n, -1, k * DIM)
            response = flat @ p[f"w{k}"]
            at = response.argmax(axis=1)  # (n, FILTERS)
            where.append(at)
            pooled.append(np.take_along_axis(response, at[:, None, :], axis=1)[:, 0])
        z = np.concatenate(pooled, axis=1) + p["b"]
        h = np.maximum(z, 0)
        logits = h @ p["out"] + p["bias"]
        q = np.exp(logits - logits.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        q[np.arange(n), labels] -= 1
        q /= n
        g = {"out": h.T @ q, "bias": q.sum(axis=0), "emb": np.zeros_like(p["emb"])}
        back = (q @ p["out"].T) * (z > 0)
        g["b"] = back.sum(axis=0)
        for i, k in enumerate(WIDTHS):
            part = back[:, i * FILTERS : (i + 1) * FILTERS]
            patch = x[np.arange(n)[:, None, None], where[i][:, :, None] + np.arange(k)]  # (n, FILTERS, k)
            vectors = p["emb"][patch].reshape(n, FILTERS, k * DIM)
            g[f"w{k}"] = np.einsum("nf,nfd->df", part, vectors)
            to = (part[:, :, None] * p[f"w{k}"].T[None]).reshape(n, FILTERS, k, DIM)
            np.add.at(g["emb"], patch.ravel(), to.reshape(-1, DIM))
        return g

    def folded(self) -> dict:
        """What scoring needs: the tables over byte pairs and the output layer."""
        p, n = self.p, len(WIDTHS) * FILTERS
        single = np.zeros((4, 256, n), np.float32)
        for i, k in enumerate(WIDTHS):
            for j in range(k):
                single[j, :, i * FILTERS : (i + 1) * FILTERS] = p["emb"] @ p[f"w{k}"][j * DIM : (j + 1) * DIM]
        return {"languages": self.languages, "single": single, "b": p["b"], "out": p["out"], "bias": p["bias"]}


class Scorer:
    def __init__(self, model: dict):
        self.languages, self.b, self.out, self.bias = model["languages"], model["b"], model["out"], model["bias"]
        s = model["single"]
        n = s.shape[2]
        self.first = (s[0][:, None] + s[1][None]).reshape(65536, n)
        self.second = (s[2][:, None] + s[3][None]).reshape(65536, n)

    def window_probabilities(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty((len(codes), len(self.languages)), np.float32)
        for i in range(0, len(codes), 64):
            x = codes[i : i + 64].astype(np.uint16)
            # two more zeros let filters narrower than four bytes reach the end
            x = np.pad(x, ((0, 0), (0, 2)))
            pair = (x[:, :-1] << 8) | x[:, 1:]
            response = self.first[pair[:, :-2]]
            response += self.second[pair[:, 2:]]
            h = np.maximum(response.max(axis=1) + self.b, 0)
            z = h @ self.out + self.bias
            q = np.exp(z - z.max(axis=1, keepdims=True))
            out[i : i + 64] = q / q.sum(axis=1, keepdims=True)
        return out

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """(texts, languages); the mean over all windows of each text by their bytes."""
        data = [t.lower().encode() for t in texts]
        padded = [windows(d) for d in data]
        counts = np.array([len(w) // WINDOW for w in padded])
        codes = np.frombuffer(b"".join(padded), np.uint8).reshape(-1, WINDOW)
        starts = np.cumsum(counts) - counts
        weight = np.full(len(codes), WINDOW, np.float64)
        weight[starts + counts - 1] = [len(d) - WINDOW * (c - 1) or 1 for d, c in zip(data, counts.tolist())]
        q = self.window_probabilities(codes) * weight[:, None]
        return np.add.reduceat(q, starts, axis=0) / np.add.reduceat(weight, starts)[:, None]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> dict | None:
    """Learn from texts with a language that are not held out; None if there are none."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                data = windows(text.lower().encode()) if text else b""
                n = len(data) // WINDOW
                columns = [np.full(n, doc_id), np.arange(n) * WINDOW, [lang] * n, [data[i * WINDOW : (i + 1) * WINDOW] for i in range(n)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.string(), pa.binary()])], names=["doc_id", "start", "lang", "data"])

    schema = "doc_id long, start long, lang string, data binary"
    table = bounded_sample(rows, "lang", "doc_id", per_language).mapInArrow(run, schema).dropDuplicates(["doc_id", "start", "lang"]).toArrow()
    table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("lang", "ascending")])
    if not table.num_rows:
        return None
    languages = sorted(set(table.column("lang").to_pylist()))
    codes = np.frombuffer(b"".join(table.column("data").to_pylist()), np.uint8).reshape(-1, WINDOW)
    labels = np.array([languages.index(x) for x in table.column("lang").to_pylist()])
    net = ByteCnn(languages)
    net.fit(codes, labels)
    return net.folded()


def _labelled(texts: list[str | None], letters: list[bool], scorer: Scorer | None) -> tuple[list[str], list[float]]:
    lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [k for k, x in enumerate(letters) if x and scorer]
    if known:
        q = scorer.probabilities([texts[k] for k in known])
        for k, best, p in zip(known, q.argmax(axis=1).tolist(), q.max(axis=1).tolist()):
            lang[k], score[k] = scorer.languages[best], min(1.0, p)
    return lang, score


def with_language(docs: DataFrame, model: dict | None, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """``docs`` with a predicted language and its probability; columns of the two names are replaced.

    ``und`` with score 0 if the text is null or has no letter, or if nothing
    was learned. Of equally likely languages the first by name is taken.
    Repeated rows and nulls elsewhere are kept; an empty table gives an empty
    result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(pred_col, score_col)
    letter = unused(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value) if sent.value else None
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                some = batch.slice(i, 200)
                lang, score = _labelled(some.column(text_col).to_pylist(), some.column(letter).to_pylist(), scorer)
                own = [c for c in some.schema.names if c != letter]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in own), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*own, pred_col, score_col])

    marked = kept.withColumn(letter, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    schema = T.StructType([*kept.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    return marked.mapInArrow(run, schema)


def identify(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row, by ``with_language``; further columns are not read."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return with_language(own, model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
