"""Near-duplicate detection by ProbMinHash, banding and verification.

A text is its five-word shingles, weighted by how often each occurs. Its
signature holds, for each of M places, the shingle that arrives there first
when each shingle arrives as a Poisson process of its weight; a shingle's
process ends early once it can no longer be first anywhere. Two signatures
agree in a place with the probability Jaccard index of the two texts, the
measure that links are verified on; of texts that repeat no shingle it is the
Jaccard index. Bands of the signature are buckets, in which candidates meet.

Links are pairs of different texts with a probability Jaccard index of at
least the threshold, verified on the texts. Classes are the connected
components. Equal texts (same words) are one vertex from the start. Buckets
are never expanded into all their pairs:

1. In each bucket every member meets one leader, chosen by a hash of the
   vertex, so that a family has the same few leaders in all its buckets; two
   such rounds, with verification and components in between, of which the
   later ones go over new links alone. A sketch of one bit a place, which the
   bucket's rows carry, drops most unlike pairs beforehand.
2. A bucket that lies in one component is done. Elsewhere the members outside
   the bucket's largest component meet the others, in tiles of bounded size.
   First tiles of signatures tell which members have a partner in another
   component whose signature agrees enough; then those members alone meet
   again with their texts, which are compared unless a link joins the two
   components already. A tile gives back members or links that join
   components, never all its pairs.

So each pair that shares a bucket and could still join two components is
looked at, and no other. A link is missed only if its texts share no bucket or
their signatures disagree by chance (both below 1e-4 at the threshold).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components, merged_components
from .common import discard, materialise

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
M = BANDS * ROWS
#: Signatures that agree in a smaller share of places aren't verified: about 4 standard deviations below the threshold.
LEAST_AGREEMENT = 0.64
#: Bits in which two sketches may differ: at the threshold 12.5 of 125 are expected, with a standard deviation of 3.4.
MOST_BITS = 30
#: Members of a tile, of either side.
TILE = 256

_WORD = re.compile(r"\w+")
_GOLD, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S11, _S32 = (np.uint64(x) for x in (30, 27, 31, 11, 32))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash, on arrays."""
    x = (x ^ (x >> _S30)) * _A
    x = (x ^ (x >> _S27)) * _B
    return x ^ (x >> _S31)


class Shingles:
    """Hashes of a text's shingles; keeps the hashes of words of at most 64 characters, up to a limit."""

    def __init__(self, limit: int = 200_000):
        self.limit, self.words = limit, {}

    def of(self, words: list[str]) -> np.ndarray:
        """One hash per place; a text of fewer than five words is one shingle, one without words has none."""
        if not words:
            return np.empty(0, np.uint64)
        distinct = set(words)
        missing = distinct.difference(self.words)
        if len(self.words) + len(missing) > self.limit:
            self.words.clear()
            missing = distinct
        new = {w: xxhash.xxh3_64_intdigest(w) for w in missing}
        long = {w for w in missing if len(w) > 64}
        self.words.update(new)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        for w in long:
            del self.words[w]
        n = max(1, len(h) - SHINGLE + 1)
        out = np.zeros(n, np.uint64)
        for i in range(min(SHINGLE, len(h))):
            out = mix(out * _GOLD + h[i : i + n] + np.uint64(i))
        return out


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def prob_min_hash(shingles: np.ndarray, weights: np.ndarray, m: int = M) -> np.ndarray:
    """The first shingle to arrive at each of ``m`` places, as its hash."""
    first = np.full(m, np.inf)
    time = np.zeros(len(shingles))
    alive = np.arange(len(shingles))
    step, done, points = max(1, -(-2 * m // len(shingles))), 0, []
    while len(alive):
        own = shingles[alive]
        x = mix(own[:, None] + np.arange(done + 1, done + step + 1, dtype=np.uint64) * _GOLD)
        wait = -np.log(((x >> _S11).astype(np.float64) + 1) * 2.0**-53) / weights[alive][:, None]
        at = time[alive][:, None] + np.cumsum(wait, axis=1)
        place = (mix(x ^ _B) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, place.ravel(), at.ravel())
        points.append((at.ravel(), place.ravel(), np.repeat(own, step)))
        time[alive] = at[:, -1]
        alive = alive[at[:, -1] < first.max()]
        done += step
    out = np.zeros(m, np.uint64)
    for at, place, own in points:
        won = at == first[place]
        out[place[won]] = own[won]
    return out


#: Distinct shingles in order, and how often each occurs; None if none is repeated.
Weighted = tuple[np.ndarray, np.ndarray | None]


def weighted(shingles: np.ndarray) -> Weighted:
    ordered = np.sort(shingles)
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    if len(begins) == len(ordered):
        return ordered, None
    return ordered[begins], np.diff(np.append(begins, len(ordered))).astype(np.float64)


def signature(shingles: np.ndarray) -> np.ndarray:
    distinct, counts = weighted(shingles)
    return prob_min_hash(distinct, np.ones(len(distinct)) if counts is None else counts)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD
    for i in range(ROWS):
        out = mix(out + parts[:, i])
    return out.view(np.int64)


def sketch(sig: np.ndarray) -> tuple[int, int]:
    """One bit of each place, as two integers: a short form of the signature that travels with a bucket's rows."""
    bits = np.zeros(128, np.uint8)
    bits[:M] = mix(sig) & np.uint64(1)
    return tuple(np.packbits(bits).view(np.int64).tolist())


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, vid, sig, bands, bits_a, bits_b) of each row; vid is a 128-bit hash of the words, the rest is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, known = Shingles(), {}
        types = [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.int64()]
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                some, out = batch.slice(i, 500), []
                for text in some.column(1).to_pylist():
                    words = words_of(text)
                    vid = xxhash.xxh3_128_digest(" ".join(words))
                    if vid not in known:
                        if len(known) > 2000:
                            known.clear()
                        sig = signature(shingles.of(words)) if words else None
                        known[vid] = (None,) * 4 if sig is None else (sig.astype(np.uint32).view(np.int32), band_hashes(sig), *sketch(sig))
                    out.append((vid, *known[vid]))
                columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), *columns], names=["doc_id", "text_hash", "vid", "sig", "bands", "bits_a", "bits_b"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, vid binary, sig array<int>, bands array<long>, bits_a long, bits_b long")


def probability_jaccard(x: Weighted, y: Weighted, least: float = 0.0) -> float:
    """The sum over common shingles i of 1 / sum over all j of max(x_j / x_i, y_j / y_i).

    It doesn't depend on the scale of either side's weights. Below ``least`` an
    upper bound may be given instead.
    """
    both = np.concatenate([x[0], y[0]])
    by = np.argsort(both, kind="stable")
    again = np.flatnonzero(both[by[1:]] == both[by[:-1]])
    if not len(again):
        return 0.0
    left, right = (np.ones(len(z[0])) if z[1] is None else z[1] for z in (x, y))
    a, b = left[by[again]], right[by[again + 1] - len(left)]
    all_x, all_y = left.sum(), right.sum()
    bound = np.minimum(a / all_x, b / all_y).sum()
    if bound < least:
        return float(bound)
    # in order of a / b the shingles from i on have the greater share in x, those before it in y
    order = np.argsort(a / b, kind="stable")
    a, b = a[order], b[order]
    from_x = all_x - a.sum() + np.cumsum(a[::-1])[::-1]
    to_y = all_y - b.sum() + np.cumsum(b) - b
    return float((1 / (from_x / a + to_y / b)).sum())


def _similar(x: Weighted, y: Weighted, threshold: float) -> bool:
    """Whether the probability Jaccard index reaches the threshold; without repeats it is that of the sets."""
    least = threshold - 1e-9
    if x[1] is not None or y[1] is not None:
        return probability_jaccard(x, y, least) >= least
    if min(len(x[0]), len(y[0])) < least * max(len(x[0]), len(y[0])):
        return False
    both = np.concatenate([x[0], y[0]])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common >= least * (len(both) - common)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The links among pairs (src, dst)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, known = Shingles(), {}

        def distinct(v, text):
            if v not in known:
                if len(known) > 500:
                    known.clear()
                known[v] = weighted(shingles.of(words_of(text)))
            return known[v]

        for batch in batches:
            src, dst, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for k, (a, b) in enumerate(zip(src, dst)):
                x = distinct(a, None if a in known else batch.column(2)[k].as_py())
                y = distinct(b, None if b in known else batch.column(3)[k].as_py())
                if _similar(x, y, threshold):
                    out.append((a, b))
            columns = [list(c) for c in zip(*out)] or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["src", "dst"])

    one = texts.select(F.col("v").alias("dst"), F.col("text").alias("dst_text"))
    two = texts.select(F.col("v").alias("src"), F.col("text").alias("src_text"))
    return pairs.join(one, "dst").join(two, "src").select("src", "dst", "src_text", "dst_text").mapInArrow(run, "src long, dst long")


def _agreeing(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Pairs (src, dst) whose signatures agree in at least that share of places."""
    one = reps.select(F.col("v").alias("dst"), F.col("sig").alias("dst_sig"))
    two = reps.select(F.col("v").alias("src"), F.col("sig").alias("src_sig"))
    agree = F.aggregate(F.zip_with("src_sig", "dst_sig", lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return pairs.join(one, "dst").join(two, "src").where(agree >= least * M).select("src", "dst")


_TILE_COLUMNS = ["b", "k", "v", "component", "main", "outside", "i", "j"]


class _Tile:
    """Members of a bucket, some outside its largest component on the left, some of all on the right."""

    def __init__(self, table: pa.Table, least: float):
        self.outside = table.column("outside").to_numpy()
        self.v, self.c, self.main = (table.column(x).to_numpy() for x in ("v", "component", "main"))
        self.sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, M)
        self.band, self.least = table.column("k")[0].as_py(), least
        self.right = np.flatnonzero(~self.outside)

    def candidates(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each row of the left with those of the right that agree enough, the best first; a pair is given in its first common band only."""
        right = self.right
        sig, v, c = self.sig[right], self.v[right], self.c[right]
        for i in np.flatnonzero(self.outside):
            same = sig == self.sig[i]
            agree = same.sum(axis=1)
            # two outsiders meet in two tiles; one of them is enough
            hit = np.flatnonzero((agree >= self.least * M) & (c != self.c[i]) & ((c == self.main[i]) | (v > self.v[i])))
            if len(hit):
                hit = hit[same[hit].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == self.band]
                if len(hit):
                    yield i, right[hit[np.argsort(-agree[hit], kind="stable")]]


def _tile_needs(least: float):
    """The rows of a tile that have a candidate in it."""

    def run(table: pa.Table) -> pa.Table:
        needed = np.zeros(table.num_rows, dtype=bool)
        for i, partners in _Tile(table, least).candidates():
            needed[i] = True
            needed[partners] = True
        return table.select(_TILE_COLUMNS).filter(pa.array(needed))

    return run


def _tile_links(least: float, threshold: float):
    """Links between components within one tile."""

    def run(table: pa.Table) -> pa.Table:
        tile, texts, shingles, sets, links = _Tile(table, least), table.column("text"), Shingles(), {}, []
        v, c = tile.v, tile.c
        parent = {x: x for x in c.tolist()}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def distinct(i):
            if v[i] not in sets:
                sets[v[i]] = weighted(shingles.of(words_of(texts[i].as_py())))
            return sets[v[i]]

        for i, partners in tile.candidates():
            for j in partners:
                x, y = find(int(c[i])), find(int(c[j]))
                if x != y and _similar(distinct(i), distinct(j), threshold):
                    parent[x] = y
                    links.append((int(v[i]), int(v[j])))
        src, dst = zip(*links) if links else ((), ())
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return run


def _rest_links(buckets: DataFrame, labels: DataFrame, reps: DataFrame, texts: DataFrame, least: float, threshold: float, tile: int) -> DataFrame:
    """Links between members of a bucket that lie in different components, as a written table.

    A tile holds some of the members outside the bucket's largest component
    and some of all members. Signatures are compared first, and texts go only
    where a member has a candidate.
    """
    members = materialise(buckets.join(labels, "v", "left").select("b", "k", "v", F.coalesce("component", "v").alias("component")), "members")
    counts = members.groupBy("b", "component").count()
    open_ = counts.groupBy("b").agg(F.sum("count").alias("n"), F.max(F.struct("count", "component")).alias("top")).where("n > top.count")
    open_ = materialise(open_.select("b", F.col("top.component").alias("main"), F.ceil(F.col("n") / tile).cast("int").alias("js"), F.ceil((F.col("n") - F.col("top.count")) / tile).cast("int").alias("is_")), "open-buckets")
    rows = members.join(open_, "b")
    block = lambda n: F.pmod(F.xxhash64("v"), F.col(n)).cast("int")
    steps = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["b", "k", "v", "component", "main"]
    left = rows.where("component <> main").select(*cols, F.lit(True).alias("outside"), block("is_").alias("i"), steps("js").alias("j"))
    right = rows.select(*cols, F.lit(False).alias("outside"), steps("is_").alias("i"), block("js").alias("j"))
    signed = reps.select("v", "sig")
    needs = left.unionByName(right).join(signed, "v").groupBy("b", "i", "j").applyInArrow(_tile_needs(least), "b long, k int, v long, component long, main long, outside boolean, i int, j int")
    needs = materialise(needs, "tile-needs")
    links = needs.join(signed, "v").join(texts, "v").groupBy("b", "i", "j").applyInArrow(_tile_links(least, threshold), "src long, dst long")
    links = materialise(links, "links")
    discard(members, open_, needs)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, least_agreement: float = LEAST_AGREEMENT, most_bits: int = MOST_BITS, rounds: int = 2, tile: int = TILE) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, kept.

    With ``least_agreement`` 0 and ``most_bits`` 128 every pair that shares a
    bucket and could join two components is compared by its texts.

    Words are runs of letters, digits and underscores, in lower case. A text of
    fewer than five words is one shingle. Null and empty texts and others
    without words are equal, so they form one class. ``class_id`` is the least
    id of the class; null ids come last. Of rows that repeat id and words one
    is kept. An empty table gives an empty result; further columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = materialise(signatures(docs, "doc_id", "text"), "signatures")
    one = [F.first(c).alias(c) for c in ("sig", "bands", "bits_a", "bits_b")]
    reps = signed.groupBy("vid").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"), *one)
    reps = materialise(reps.withColumn("v", F.monotonically_increasing_id()), "vertices")

    spread = materialise(reps.select("v", F.posexplode("bands").alias("k", "b")), "bands")
    crowded = materialise(spread.groupBy("b").count().where("count > 1").select("b"), "crowded")
    buckets = materialise(spread.join(crowded, "b").join(reps.select("v", "bits_a", "bits_b"), "v"), "buckets")
    discard(spread, crowded)

    # texts of the vertices that share a bucket; rows are found by id and a hash of the text, so that null and repeated ids meet their own text only
    wanted = buckets.select("v").distinct().join(reps.select("v", "vid", F.col("one.doc_id").alias("one_id"), F.col("one.text_hash").alias("one_hash")), "v")
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    found = wanted.join(hashed, wanted.one_id.eqNullSafe(hashed.doc_id) & (wanted.one_hash == hashed.text_hash)).select("v", "vid", "text")

    def right_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [xxhash.xxh3_128_digest(" ".join(words_of(t))) == vid for vid, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(2)], names=["v", "text"])

    texts = materialise(found.mapInArrow(right_text, "v long, text string").dropDuplicates(["v"]), "texts")

    labels = None
    for k in range(rounds):
        members = buckets if labels is None else buckets.join(labels, "v", "left").withColumn("component", F.coalesce("component", "v"))
        value = F.struct(F.xxhash64("v", F.lit(k)).alias("h"), "v", "bits_a", "bits_b", *([] if labels is None else ["component"]))
        leaders = materialise(members.groupBy("b").agg(F.min(value).alias("leader")), "leaders")
        differ = lambda c: F.bit_count(F.col(c).bitwiseXOR(F.col(f"leader.{c}")))
        met = members.join(leaders, "b").where((F.col("v") != F.col("leader.v")) & (differ("bits_a") + differ("bits_b") <= most_bits))
        if labels is not None:
            met = met.where(F.col("component") != F.col("leader.component"))
        pairs = met.select(F.least("v", "leader.v").alias("src"), F.greatest("v", "leader.v").alias("dst")).distinct()
        pairs = materialise(_agreeing(pairs, reps, least_agreement), "pairs")
        new = materialise(_verified(pairs, texts, threshold), "links")
        discard(leaders, pairs)
        labels = connected_components(new) if labels is None else merged_components(labels, new)
    labels = merged_components(labels, _rest_links(buckets, labels, reps, texts, least_agreement, threshold, tile))
    discard(buckets, texts)

    vertex = materialise(reps.select("vid", "v").join(labels, "v", "left").select("vid", F.coalesce("component", "v").alias("component")), "vertex-classes")
    placed = materialise(signed.select("doc_id", "vid").groupBy("doc_id", "vid").agg(F.count("*").alias("copies")).join(vertex, "vid"), "placed")
    discard(signed, reps, vertex)
    classes = materialise(placed.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"), F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "vid")).alias("head")), "classes")
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("vid") == F.col("head.vid"))
    return (
        placed.join(classes, "component")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("doc_id", "class_id", "class_size", (first & (F.col("copy") == 1)).alias("kept"))
    )
