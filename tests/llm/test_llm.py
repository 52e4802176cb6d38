"""The corpus operators against brute force, round trips, held-out accuracy, and odd tables."""

import base64
import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import bbpe, dialogue, exact, hardneg, html_main, langid, media, minhash, packing, piecebpe, quality, queries, sepscan, tokens_orc
from sessionloom.llm.common import WordIds, bounded_sample, slices, without_duplicates
from sessionloom.operators import graph

SF = "/root/testdata/sf0.001"
WORDS = P.path("word_bpe_49k.json")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
DOC = "doc_id long, text string, lang string, source string, sig string, kept boolean"

ODD = [None, "", " ", "a", "a  b", "a b", "a\tb", "A b", "x" * 9000, "x" * 9000 + "y", "é ñ ß", "naïve  café\n", "don't I'LL we'll", "\x1c a\x1cb", "日本語 テスト", "<|endoftext|> hi", "a<|startoftext|>B <|ENDOFTEXT|>", "aaaa" * 400, "\x00", "one two three four five six", "One two, three four five six!"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    rows = [(i, t, "en", "s", "x", True) for i, t in enumerate(ODD)] + [(3, "a", "en", "s", "x", True), (None, "a", None, None, None, None), (None, None, None, None, None, None), (30, "x" * 9000, "en", "s", "x", False)]
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("block, key", [(4096, F.xxhash64), (3, F.xxhash64), (3, lambda c: F.length(c).cast("long")), (4, lambda c: F.lit(1).cast("long"))])
def test_exact_dedup_equals_brute_force(odd, block, key):
    """Also where all look-up hashes collide, so that names rest on contents alone."""
    got = exact.exact_dedup(odd, block_chars=block, key=key).collect()
    rows = [(r.doc_id, norm(r.text)) for r in odd.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    assert len(got) == len(rows)
    text = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for r in got:
        ids = groups[text[r.text_sha256]]
        least = min((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size) == (least, len(ids))
    kept = [r for r in got if r.kept]
    assert sorted(text[r.text_sha256] for r in kept) == sorted(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_empty_tables_give_empty_results(spark, none):
    assert exact.exact_dedup(none).count() == minhash.near_duplicates(none).count() == 0
    assert bbpe.round_trip(none, RANKS, P.PATTERN).count() == media.text_media(none).count() == 0
    assert packing.pack_documents(none, WORDS).count() == sepscan.document_token_counts(none, WORDS).count() == tokens_orc.token_binary_output(none, WORDS).count() == 0
    assert langid.identify(none, langid.fit(none)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(none, quality.fit(none, labels)).count() == 0
    assert html_main.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def tiktoken_ids(text):
    import tiktoken

    if not hasattr(tiktoken_ids, "e"):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
        tiktoken_ids.e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return tiktoken_ids.e.encode_ordinary(text or "")


def test_byte_bpe_equals_the_library(odd, docs):
    rnd = random.Random(2)
    texts = ODD + ["".join(rnd.choice("ab '\n\t é日1.!\x1c\x0b") for _ in range(rnd.randint(1, 40))) for _ in range(500)] + [r.text for r in docs.limit(50).collect()]
    bpe = bbpe.ByteBpe.of(RANKS, P.PATTERN)
    for text, ids in zip(texts, bpe.encode_all(texts)):
        assert ids.tolist() == tiktoken_ids(text) and bpe.decode(ids) == (text or "").encode()
    small = bbpe.ByteBpe(bpe.ranks, P.PATTERN, limit=5)
    assert [x.tolist() for x in small.encode_all(texts[:40])] == [tiktoken_ids(t) for t in texts[:40]]
    for r in bbpe.round_trip(odd, RANKS, P.PATTERN).join(odd.dropDuplicates(["doc_id", "text"]), "doc_id").where("doc_id <> 3").collect():
        ids = tiktoken_ids(r.text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())


def test_byte_bpe_of_long_pre_tokens():
    """Rows cut from a long pre-token, with seams that fit and seams that don't, give the ids of the library."""
    import time

    rnd = random.Random(3)
    bpe = bbpe.ByteBpe.of(RANKS, P.PATTERN)
    long = ["a" * 5001, "ab" * 3000, "".join(rnd.choice("abcdefgh") for _ in range(20_000)), "".join(rnd.choice("etaoinshrdlu") for _ in range(200_000)), "".join(rnd.choice("日本語ñé") for _ in range(3000)), "!=-" * 2000]
    long += [x * (3000 // len(x)) + y for x in ("-", "=", "_", "abc", "ing", "ee", "the", "é", "日", "ha", "xyzzy", "0", "ab" * 31 + "c", "....", "*-") for y in ("", "q", "ab")]
    long += ["".join(rnd.choice([x, y]) * rnd.randint(1, 90) for _ in range(60)) for x, y in ("ab", "e-", "a日", "0o", "=-")] + [" " * 700, "\n" * 500, " \n" * 300]
    for text, ids in zip(long, bpe.encode_all(long)):
        assert ids.tolist() == tiktoken_ids(text)
    for n in (129, 130, 191, 192, 193, 256, 257):
        for _ in range(20):
            text = "".join(rnd.choice("aeinrst") for _ in range(n))
            assert bpe._merge_cut(text.encode()).tolist() == tiktoken_ids(text)
    text = "".join(rnd.choice("etaoinshrdlu") for _ in range(800_000))
    began = time.perf_counter()
    ids = bpe.encode_all([text])[0]
    assert time.perf_counter() - began < 15  # linear: a few seconds on an idle machine
    assert ids.tolist() == tiktoken_ids(text)


def test_caches_of_words_are_bounded_in_bytes():
    """2,000 words of 100 kB each leave nothing behind in any cache."""
    import sys

    rnd = random.Random(1)
    words, bpe, shingles, pieces = WordIds(WORDS), bbpe.ByteBpe(bbpe.ByteBpe.of(RANKS, P.PATTERN).ranks, P.PATTERN), minhash.Shingles(), piecebpe.PieceBpe.of(P.path("piece_bpe_32k.model"))
    pieces.known.clear()
    for i in range(2000):
        text = f"w{rnd.randrange(10**9)} x " + f"{i}-" * (20_000 if i < 4 else 40) + " y"
        words.encode_all([text])
        bpe.encode_all([text])
        shingles.of(minhash.words_of(text.replace("-", "")))
        pieces.encode_all([text])
    for cache in (words.cache, words.pieces, bpe.words, shingles.words, pieces.known):
        assert sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in cache.items()) < 4_000_000 and all(len(k) <= 64 for k in cache)


def test_bpe_frames_round_trip(odd):
    back = bbpe.decode(bbpe.encode(odd, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert sorted((str(r.doc_id), bytes(r.data)) for r in back.collect()) == sorted((str(r.doc_id), (r.text or "").encode()) for r in odd.collect())


def word_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(word_ids, "t"):
        word_ids.t = Tokenizer.from_file(WORDS)
    return word_ids.t.encode(text or "", add_special_tokens=False).ids


def test_word_ids_equal_the_library(docs):
    rnd = random.Random(4)
    texts = ODD + ["İstanbul ΣΑΣ", "é É à", "''s", "½ ²x", "ß STRASSE ẞ", "Ab'S don't!!'t can't'll9a0"] + ["".join(rnd.choice("aB '\n\té日1.,!-\x1ć") for _ in range(rnd.randint(1, 30))) for _ in range(800)] + [r.text for r in docs.limit(60).collect()]
    for limit in (600_000, 30):
        words = WordIds(WORDS, limit)
        assert [x.tolist() for x in words.encode_all(texts)] == [word_ids(t) for t in texts]
        ids, offsets = words.ids_of(pa.array(texts).slice(3), 2)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [[*word_ids(t), 2] for t in texts[3:]]
    assert word_ids("<|endoftext|> hi")[0] == 49407


def test_slices_are_bounded():
    batch = pa.RecordBatch.from_arrays([pa.array([None, "a" * 50, "b" * 9, "", "c" * 9, "d" * 9, None])], names=["t"])
    got = [s.column(0).to_pylist() for s in slices([batch, batch.slice(0, 0)], 0, rows=3, size=20)]
    assert [x for part in got for x in part] == batch.column(0).to_pylist() and max(map(len, got)) <= 3
    assert all(len(part) == 1 or sum(len(x or "") for x in part[:-1]) < 20 for part in got)


def test_packing_covers_each_id_once(odd):
    pieces = packing.pack_documents(odd, WORDS, window=64, chunk=8, piece=16).collect()
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64
    want, got = defaultdict(int), defaultdict(int)
    for r in odd.collect():
        ids = np.array([*word_ids(r.text), 2], "<u4")
        want[r.doc_id] += len(ids)
    for p in pieces:
        got[p.doc_id] += p.length
    assert got == want
    ids = np.array([*word_ids("x" * 9000 + "y"), 2], "<u4")
    mine = sorted((p.start, p.length, p.ids_crc32) for p in pieces if p.doc_id == 9)
    assert [s for s, _, _ in mine] == np.cumsum([0, *[n for _, n, _ in mine]])[:-1].tolist()
    assert all(c == zlib.crc32(ids[s : s + n].tobytes()) for s, n, c in mine)


def test_differencing_is_near_equal():
    lengths = np.random.default_rng(0).integers(1, 1024, 700)
    window, sums = packing.differencing(lengths, 90)
    assert np.array_equal(np.bincount(window, weights=lengths, minlength=90), sums) and sums.max() - sums.min() < 0.02 * sums.mean()
    fit = packing.near_equal_windows(lengths, 4096)
    loads = np.bincount(fit, weights=lengths)
    assert loads.max() <= 4096 and len(loads) <= 1.02 * lengths.sum() / 4096 + 1
    assert packing.near_equal_windows(np.array([4096, 4096, 1]), 4096).max() == 2


def test_separator_scan_stitches_blocks(spark, odd, docs, tmp_path):
    counts = {r.doc_id: r.n_tokens for r in sepscan.document_token_counts(docs, WORDS, block_ids=37).collect()}
    assert counts == {r.doc_id: len(word_ids(r.text)) for r in docs.collect()}
    got = sorted((str(r.doc_id), r.n_tokens) for r in sepscan.document_token_counts(odd, WORDS, block_ids=5).collect())
    assert got == sorted((str(r.doc_id), len(word_ids(r.text))) for r in odd.collect())
    for k, (width, block) in enumerate([(2, 1), (2, 2), (4, 3), (4, 100)]):
        (tmp_path / f"f{k}").write_bytes(np.array([5, 9, 9, 1, 2, 3, 9, 4], f"<u{width}").tobytes())
        files = spark.createDataFrame([(f"file://{tmp_path}/f{k}", 8 * width), (f"{tmp_path}/none", None)], "file string, length long")
        assert [r.n_tokens for r in sepscan.count_tokens(files, 9, width, block).orderBy("ordinal").collect()] == [1, 0, 3]


def test_token_orc_is_indexed_from_its_files(spark, odd, docs):
    start = 0
    for r, d in zip(tokens_orc.token_binary_output(docs, WORDS).orderBy("start").collect(), docs.orderBy("doc_id").collect()):
        ids = np.array([*word_ids(d.text), 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    rows = tokens_orc.token_binary_output(odd, WORDS).orderBy("start").collect()
    assert len(rows) == odd.count() and [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i))
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()


def test_token_orc_look_ups_are_pruned(spark, docs, tmp_path):
    """A range of ids, and a single id that is not there, are read from few rows or none."""
    path = f"file://{tmp_path}/tokens"
    many = docs.crossJoin(spark.range(40).select(F.col("id").alias("k"))).select((F.col("doc_id") * 1000 + F.col("k") * 2).alias("doc_id"), F.substring("text", 1, 80).alias("text"))
    tokens_orc.write_token_orc(many, path, WORDS, row_index_stride=1000)
    stored, total = tokens_orc.read_token_orc(spark, path), many.count()

    def scanned(found):
        rows = found.select("doc_id", "ordinal").collect()
        plan = found.select("doc_id", "ordinal")
        scan = plan._jdf.queryExecution()
        scan.executedPlan().executeCollect()
        leaves, read = scan.executedPlan().collectLeaves(), 0
        for i in range(leaves.size()):
            read += leaves.apply(i).metrics().apply("numOutputRows").value()
        return rows, read

    ids = sorted(r.doc_id for r in many.select("doc_id").collect())
    rows, read = scanned(stored.where(F.col("doc_id").between(ids[100], ids[180])))
    assert sorted(r.doc_id for r in rows) == ids[100:181] and read < total / 2
    rows, read = scanned(stored.where(F.col("doc_id") == ids[4000]))
    assert len(rows) == 1 and read < total / 2
    # between ids that are there, so only the Bloom filter can tell
    rows, read = scanned(stored.where(F.col("doc_id") == ids[4000] + 1))
    assert not rows and read == 0


def test_media_round_trip(spark, odd):
    store = media.store_text_media(odd)
    stored_of = {r.doc_id: bytes(r.media) for r in store.collect()}
    for r in media.read_text_media(store).join(odd.where("doc_id <> 3"), "doc_id").collect():
        data = (r.text or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        stored = stored_of[r.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert media.decode(stored).tobytes() == payload and np.load(io.BytesIO(bytes(r.tile))).shape == (16, 16)


def bmp(pixels):
    h, w = pixels.shape[:2]
    rows = b"".join(pixels[y, :, ::-1].tobytes().ljust((w * 3 + 3) // 4 * 4, b"\0") for y in range(h - 1, -1, -1))
    return b"BM" + (54 + len(rows)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24) + rows


def test_media_formats(spark):
    rgb = np.random.default_rng(0).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert np.array_equal(media.decode(bmp(rgb)), rgb)
    assert np.array_equal(media.decode(b"P6 #c\n7 5\n255\n" + rgb.tobytes()), rgb)
    assert np.array_equal(media.decode(b"P2\n2 1\n255\n3 4\n"), [[3, 4]])
    assert np.array_equal(media.decode(b"P2\n3 1\n15\n0 7 15\n"), [[0, 119, 255]]) and np.array_equal(media.decode(b"P5\n2 1\n1\n\x00\x01"), [[0, 255]])
    indexed = bytearray(bmp(np.zeros((2, 4, 3), np.uint8))[:54]) + bytes([1, 2, 3, 0, 4, 5, 6, 0]) + bytes([0, 1, 1, 0, 1, 0, 0, 1])
    indexed[10], indexed[28] = 62, 8
    assert np.array_equal(media.decode(bytes(indexed))[1], [[3, 2, 1], [6, 5, 4], [6, 5, 4], [3, 2, 1]])
    indexed[-1] = 9
    for bad in (b"P2\n2 1\n255\n300 4\n", b"P2\n1 1\n9\n-1", b"P2\n1 1\n9\nx", b"P5\n2 1\n1\n\x00\x02", b"P5 9999999999 9999999999 255\n", bytes(indexed), b"BM" + bytes(60)):
        with pytest.raises(ValueError):
            media.decode(bad)
    grey = rgb[:, :, 0]
    big = np.kron(grey, np.ones((6, 4), int))
    assert np.array_equal(media.area_resize(big, 5, 7) // 256, grey)
    table = spark.createDataFrame([(1, bytearray(bmp(rgb)), "w"), (2, indexed, "w"), (3, None, "w")], "id int, media binary, width string")
    got = {r.id: (r.width, r.height, r.error) for r in media.media_tiles(table).collect()}
    assert got[1] == (7, 5, None) and got[2][2] and got[3] == (None, None, "null")


def test_html_blocks(spark):
    page = """<html><head><title>T x</title></head><body><header><h1>Site name</h1><nav><ul><li><a>Home</a></li></ul></nav></header><div class="cookie-notice">We use cookies, accept all of them.</div>
    <div class="content"><h2>Real title</h2><p>This is the &eacute; main <b>te</b>xt of the page&nbsp;with  many words.<aside>Buy this now</aside><ul><li>first point made</li></ul><p>More &lt;tag&gt; text that goes on and on and on, as the main text of a page does.</p><form><input>Your mail</form></div>
    <div class="comments"><p>Great article thank you so much for it</p></div><footer>c 2020</footer>"""
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "just text < 5 &amp; more"), (5, "u", "<div><p>a<script>x"), (1, "u", page), (None, "u", "<p>x " * 3000)]
    got = html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    assert text[1] == "Real title This is the é main text of the page with many words. first point made More <tag> text that goes on and on and on, as the main text of a page does."
    short = html_main.main_text("<nav>Home</nav><article><p>A few words.<aside>Buy this now</aside><form>x</form><p>And more.</article><p>Elsewhere", html_main.Weights({}))
    assert short.startswith("A few words. And more.")
    assert (text[2], text[3], text[4], text[5]) == ("", "", "just text < 5 & more", "a") and text[None] == " ".join(["x"] * 3000)


@pytest.mark.parametrize("wrapper", ["page has-sidebar", "layout no-sidebar", "post with-header", "content share-enabled", "sidebar-right", "page widget header"])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_html_wrapper_named_after_boilerplate(wrapper, inner):
    """A wrapper's class doesn't empty the page; what is boilerplate within the wrapper still goes."""
    words, end = (" ".join(f"{k}{i}" for i in range(50)) for k in "we")
    page = f'<a href="#c">Skip to it</a><div class="{wrapper}"><nav><a>Home</a></nav><{inner}><p>{words}</p><div class="ad">Buy this</div><p>{end}</p></{inner}><div class="sidebar"><p>Other posts</p></div></div>'
    got = html_main.main_text(page, html_main.Weights({}))
    assert got.removeprefix("Skip to it ") == f"{words} {end}"
    if inner == "article":
        counts = html_main.page_counts(page)
        assert counts["w", "p", True] == 100


def test_html_names_still_cut():
    text, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"c{i}" for i in range(300))
    page = f'<article><p>{text}</p></article><div class="comments"><article><p>{other}</p></article></div><div class="related"><p>{other}</p></div>'
    assert html_main.main_text(page, html_main.Weights({})) == text
    assert html_main.main_text(page.replace("article", "div"), html_main.Weights({})) == text


@pytest.mark.parametrize("wrapper", ["article", "main", 'div class="content"'])
@pytest.mark.parametrize("inner", ["<aside><ul>{}</ul></aside>", "<form>{}</form>", '<div class="related">{}</div>', "<aside>x</aside>{}"])
@pytest.mark.parametrize("n", [1, 30, 1000])
def test_html_text_is_not_broken_by_what_is_left_out(wrapper, inner, n):
    """Asides and forms of any length, between the halves of an article."""
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(80))
    many = "<aside><p>more</aside>" * (n if wrapper != 'div class="content"' else min(n, 10)) if inner.startswith("<aside>x") else "<li><a>more</a></li><input>" * n
    page = f"<nav>Home</nav><{wrapper}><p>{one}</p>{inner.format(many)}<p>{two}</p></{wrapper.split()[0]}><footer>c</footer>"
    learned = html_main.Weights({("w", "p"): (5000, 10), ("t", "p"): (500, 10), ("t", "aside"): (0, 500), ("t", "a"): (5, 500), ("t", "li"): (5, 500)})
    for weights in (html_main.Weights({}), learned):
        assert html_main.main_text(page, weights) == f"{one} {two}"


@pytest.mark.parametrize("kept", ['<h2 id="related-work">{}</h2>', '<h1 class="page-header">{}</h1>', '<div class="article-header"><h1>{}</h1></div>', '<div class="share-price">{}</div>', '<p class="ad-hoc">{}</p>', "<p title=don't href=x>{}</p>", '<p title="a > b">{}</p>', "<p data-class=sidebar>{}</p>"])
@pytest.mark.parametrize("wrapper", ["article", "main"])
def test_html_names_that_only_look_like_boilerplate(kept, wrapper):
    words, own = " ".join(f"w{i}" for i in range(60)), "This isn't anything else"
    page = f"<body><nav>Home</nav><{wrapper}>{kept.format(own)}<p>{words}</p></{wrapper}><footer>c</footer>"
    assert html_main.main_text(page, html_main.Weights({})) == f"{own} {words}"


@pytest.mark.parametrize("left", ['<div class="cookie-notice">{}</div>', '<div class="side-bar">{}</div>', '<section id="comments">{}</section>', '<div id="relatedPosts">{}</div>', '<div class="social-links bottom">{}</div>', '<p class="notice">{}</p>', '<section class="post-comments">{}</section>', '<div class="ad-slot">{}</div>', "<div class=newsletter_signup-form>{}</div>"])
def test_html_names_of_boilerplate(left):
    words, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"o{i}" for i in range(20))
    for page in (f"<article><p>{words}</p>{left.format(other)}</article>", f"<div class=content><p>{words}</p>{left.format(other)}</div>"):
        assert html_main.main_text(page, html_main.Weights({})) == words


def test_html_hostile_pages_take_linear_time():
    import time

    n = 20_000
    pages = ["<div>" * n + "</p>" * n + "x y", "<div>" * n + "</b></i>" * n, "<b>" * n + "<p>t" * n, '<a title="' * n, "<a " * n, "<a title='x" * n + ">t", "<!" * n, "<!-- " * n, "</" * n, "<li><b>" * n, "<div class=" + "a" * n + ">t", "<p class='" + "ad-" * n + "'>t", "<script>" * n, "<p " + "= " * n, "&" * n, "<" * n]
    for page in pages:
        began = time.process_time()
        html_main.main_text(page, html_main.Weights({}))
        html_main.page_counts(page)
        assert time.process_time() - began < 2, page[:40]


def test_html_without_article(spark):
    """The pages with their article mark taken away, by weights that were learned from marked ones."""
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights, right, n = html_main.learn_weights(pages), 0, 0
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", article)).split())
        got = html_main.main_text(re.sub(r"</?article>", "", r.html), weights)
        right, n = right + (got == want), n + 1
    assert right >= 0.95 * n


def test_html_articles_of_the_pages(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_main.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]+>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", article)).split())


@pytest.mark.parametrize("aside", [
    '<ol class="commentlist"><li>Ann: what a nice text this is<li>Bob: I do not think so</ol>', '<section class="responses"><p>Ann says what a nice text this is</p></section>', '<div class="discussion"><p>Bob does not think so at all</p></div>',
    '<div id="disqus_thread"><p>Please enable the scripts to see all of this</p></div>', '<div class="alert alert-info">We have new terms of use since today</div>', "<p hidden>This is not shown to any reader</p>", '<div style="color: red; display:none">This is not shown either to them</div>',
    '<div data-x="a" hidden="until-found">Nor is this one shown</div>', "<div style='visibility: hidden'>Nor that</div>",
])
@pytest.mark.parametrize("marked", [True, False])
def test_html_without_comments_notices_and_what_is_not_shown(spark, aside, marked):
    """Inside and after the article, whether the page marks it or not."""
    words = "It was a long day in the old town and the river ran high under the bridge where they met again. " * 4
    article = f"<h1>On the river</h1><p>{words}</p>%s<p>{words}</p><section class='discussion'><p>{words}</p></section><p data-hidden='no' title='hidden'>{words}</p>"
    want = " ".join(f"On the river {words} {words} {words} {words}".split())
    wrap = "<article>%s</article>" if marked else "<div>%s</div>"
    pages = [(1, "u", f"<html><body><nav><a href=x>Home</a></nav>{wrap % (article % aside)}</body></html>"), (2, "u", f"<html><body><nav><a href=x>Home</a></nav>{wrap % (article % '')}{aside}</body></html>")]
    got = html_main.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [r.text for r in got] == [want, want]


@pytest.mark.parametrize("aside", [
    '<ol class="commentlist"><li>Ann: what a nice text this is<li>Bob: I do not think so</ol>', '<section class="responses"><p>Ann says what a nice text this is</p></section>', '<div class="discussion"><p>Bob does not think so at all</p></div>',
    '<div id="disqus_thread"><p>Please enable the scripts to see all of this</p></div>', '<div class="alert alert-info">We have new terms of use since today</div>', "<p hidden>This is not shown to any reader</p>", '<div style="color: red; display:none">This is not shown either to them</div>',
    '<div data-x="a" hidden="until-found">Nor is this one shown</div>', "<div style='visibility: hidden'>Nor that</div>",
])
@pytest.mark.parametrize("marked", [True, False])
def test_html_without_comments_notices_and_what_is_not_shown(spark, aside, marked):
    """Inside and after the article, whether the page marks it or not."""
    words = "It was a long day in the old town and the river ran high under the bridge where they met again. " * 4
    article = f"<h1>On the river</h1><p>{words}</p>%s<p>{words}</p><section class='discussion'><p>{words}</p></section><p data-hidden='no' title='hidden'>{words}</p>"
    want = " ".join(f"On the river {words} {words} {words} {words}".split())
    wrap = "<article>%s</article>" if marked else "<div>%s</div>"
    pages = [(1, "u", f"<html><body><nav><a href=x>Home</a></nav>{wrap % (article % aside)}</body></html>"), (2, "u", f"<html><body><nav><a href=x>Home</a></nav>{wrap % (article % '')}{aside}</body></html>")]
    got = html_main.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [r.text for r in got] == [want, want]


def jaccard_classes(rows, threshold=0.8):
    """Classes of texts by the probability Jaccard index of their weighted shingles, from every pair."""
    counts = {i: (Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := re.findall(r"\w+", (t or "").lower())) else Counter()) for i, t in rows}
    sets = {i: set(c) for i, c in counts.items()}
    repeats = {i for i, c in counts.items() if c and max(c.values()) > 1}

    def probability(x, y):
        return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())

    def linked(a, b):
        x, y = sets[a], sets[b]
        if counts[a] == counts[b]:
            return True
        if not repeats & {a, b}:
            return min(len(x), len(y)) >= threshold * max(len(x), len(y)) and len(x & y) >= threshold * len(x | y)
        # the index is at most the share of either side that is common
        return all(sum(counts[i][k] for k in x & y) >= threshold * counts[i].total() > 0 for i in (a, b)) and probability(counts[a], counts[b]) >= threshold

    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and linked(a, b):
                parent[find(b)] = find(a)
    out = defaultdict(set)
    for i in sets:
        out[find(i)].add(i)
    return {frozenset(x) for x in out.values()}


def test_near_duplicates_equal_brute_force(spark):
    """Families with copies, near copies, near misses and chains; one family large enough for several tiles."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    rows, n = [], 0
    for family in range(14):
        base = [rnd.choice(words) for _ in range(rnd.randint(30, 160))]
        for member in range(60 if family == 0 else rnd.randint(1, 6)):
            w = list(base)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            rows.append((n, " ".join(w) if member % 2 else " ".join(w).capitalize() + "."))
            n += 1
    rows += [(n, "a b"), (n + 1, "A b!"), (n + 2, None), (n + 3, ""), (n + 4, "..")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = minhash.near_duplicates(df, tile=16).collect()
    classes = defaultdict(set)
    for r in got:
        classes[r.class_id].add(r.doc_id)
    assert {frozenset(c) for c in classes.values()} == jaccard_classes(rows)
    assert all(r.class_id == min(classes[r.class_id]) and r.class_size == len(classes[r.class_id]) for r in got)
    assert sorted(r.doc_id for r in got if r.kept) == sorted(min(c) for c in classes.values())


def test_a_large_family_meets_few_leaders_and_its_links_are_joined_once(spark, monkeypatch):
    """Members of a family meet few leaders for all their buckets, and later rounds of components go over new links alone."""
    rnd = random.Random(11)
    base, rows, pairs, edges = [f"w{rnd.randrange(4000)}" for _ in range(200)], [], [], []
    for n in range(300):
        w = list(base)
        for _ in range(2):
            w[rnd.randrange(200)] = f"x{rnd.randrange(4000)}"
        rows.append((n, " ".join(w)))
    agreeing, components = minhash._agreeing, graph.connected_components
    monkeypatch.setattr(minhash, "_agreeing", lambda p, *a: pairs.append(p.count()) or agreeing(p, *a))
    for module in (minhash, graph):
        monkeypatch.setattr(module, "connected_components", lambda e, *a: edges.append(e.count()) or components(e, *a))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 300 and {r.class_id for r in got} == {0}
    assert 0 < sum(pairs) < 8 * 300 and sum(edges) < 8 * 300, (pairs, edges)


def test_near_duplicates_with_unequal_repeats_equal_brute_force(spark):
    """Weights decide: a passage that one copy repeats often and the other does not breaks their link, a few repeats don't; texts that are mostly one repeated passage are linked."""
    rnd = random.Random(10)
    rows = []
    for k in range(40):
        w = [f"w{rnd.randrange(4000)}" for _ in range(120)]
        footer = [f"f{rnd.randrange(4000)}" for _ in range(18)]
        longer = w + (w[-20:] * 200, w[-8:], w[-12:], footer[:9] + w)[k % 4]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(longer))]
    for k in range(100, 110):
        often = [f"o{rnd.randrange(4000)}" for _ in range(30)] * 40
        rows += [(2 * k + i, " ".join(often + [f"u{rnd.randrange(4000)}" for _ in range(60)])) for i in (0, 1)]
    classes = defaultdict(set)
    for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        classes[r.class_id].add(r.doc_id)
    assert {frozenset(c) for c in classes.values()} == jaccard_classes(rows)
    pairs = [set(c) for c in classes.values() if len(c) == 2]
    assert all({2 * k, 2 * k + 1} in pairs for k in range(100, 110)) and not any({2 * k, 2 * k + 1} in pairs for k in range(0, 40, 4)) and len(pairs) > 10


def test_near_duplicates_of_documents_equal_brute_force(spark):
    """All classes of a whole table, so the recall of links between classes is 1."""
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    classes = defaultdict(set)
    for r in minhash.near_duplicates(docs).collect():
        classes[r.class_id].add(r.doc_id)
    assert {frozenset(c) for c in classes.values()} == jaccard_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_near_duplicates_of_long_texts(spark):
    """Texts of many thousand words, equal but for a few, and one of a single endless word."""
    rnd = random.Random(12)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(60_000)]
    near = [*base[:30_000], "x", *base[30_500:]]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base[:20_000])), (4, "z" * 2_000_000), (5, "z" * 2_000_000 + " ")]
    classes = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert classes == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_near_duplicates_of_odd_rows(odd):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(list)
    for r in got:
        by[r.class_id].append(r)
    assert all(sum(r.kept for r in rs) == 1 and all(r.class_size == len(rs) for r in rs) for rs in by.values())


def test_near_duplicates_of_many_null_ids(spark):
    """Texts without ids, and others that share one, are found by their own text, so each is read once."""
    rnd = random.Random(13)
    base = [" ".join(f"w{rnd.randrange(3000)}" for _ in range(40)) for _ in range(150)]
    texts = [t + x for t in base for x in ("", " more", "!")]
    rows = [(None if i % 2 else 7, t) for i, t in enumerate(texts)] + [(None, base[0])] * 50
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and Counter(r.class_size for r in got) == {3: 447, 53: 53} and sum(r.kept for r in got) == 150


def test_probability_jaccard_equals_its_definition():
    rnd = np.random.default_rng(2)
    for _ in range(200):
        x, y = ({int(k): float(rnd.integers(1, 9)) for k in rnd.choice(12, rnd.integers(1, 12), replace=False)} for _ in range(2))
        a, b = ((np.array(sorted(z), np.uint64), np.array([z[k] for k in sorted(z)])) for z in (x, y))
        want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())
        assert minhash.probability_jaccard(a, b) == pytest.approx(want) and (minhash.probability_jaccard(a, b, 0.5) < 0.5) == (want < 0.5)


def test_prob_min_hash_estimates_probability_jaccard():
    rng = np.random.default_rng(6)
    ids = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.uniform(0.5, 3, 300), rng.uniform(0.5, 3, 300)
    a[200:], b[:80] = 0, 0
    both = np.flatnonzero((a > 0) & (b > 0))
    want = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in both)
    m = 4000
    got = (minhash.prob_min_hash(ids[a > 0], a[a > 0], m) == minhash.prob_min_hash(ids[b > 0], b[b > 0], m)).mean()
    assert abs(got - want) < 4 * (want * (1 - want) / m) ** 0.5


def test_language_and_quality_on_held_out_rows(spark):
    """At ten times the size, where there are labels enough."""
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = queries.op4_language_id(spark, sf).join(docs, "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = queries.op1_quality(spark, sf).join(labels, "doc_id").where("held_out")
    assert scored.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] > 0.95
    assert scored.where("score < 0 OR score > 1 OR score IS NULL").isEmpty()


def test_quality_reads_whole_words_and_texts():
    """Of long words all n-grams, and of texts to learn from all words."""
    slow = lambda w: [zlib.crc32(w.encode()) % quality.BUCKETS] + [zlib.crc32(f"<{w}>"[i : i + n].encode(), n) % quality.BUCKETS for n in (3, 4) for i in range(len(w) + 3 - n)]
    ends = "a" * 40, "z" * 40
    good, spam = ends[0] + "good" * 500 + ends[1], ends[0] + "spam" * 5000 + ends[1]
    words = [good, spam, "日本語é😀x" * 30, "b" * 79, "b" * 80, "b" * 81, "日" * (quality.PIECE + 5)]
    assert all(quality.word_features(w) == slow(w) for w in words)
    assert set(quality.word_features(good)[1:]) != set(quality.word_features(spam)[1:])
    table = np.random.default_rng(3).normal(size=(2 * quality.BUCKETS + 1, 2)).astype(np.float32)
    scorer = quality.Scorer(table)
    text = " ".join(["one", good, "two", good, spam, *(f"w{i}" for i in range(900)), words[2]])
    for _ in range(2):
        ids, counts = quality._bag(text)
        want = [i for w in text.split() for i in slow(w)] + quality.pair_buckets(np.array([slow(w)[0] for w in text.split()])).tolist()
        assert np.repeat(ids, counts).tolist() == sorted(want)
        z = table[want].astype(np.float64).mean(axis=0) + table[-1]
        p = np.exp(z - z.max())
        assert np.allclose(scorer.probabilities(text), p / p.sum(), atol=1e-6)
    assert all(len(w) <= quality.LONG for w in scorer.slots)


def test_language_and_quality_of_odd_rows(spark, odd):
    model = langid.fit(odd)
    rows = langid.identify(odd, model).collect()
    assert len(rows) == odd.count()
    lang = {r.doc_id: (r.lang_pred, r.score) for r in rows if r.doc_id is not None}
    assert lang[0] == lang[1] == lang[2] == ("und", 0.0) and lang[8][0] == "en"
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(1, 1), (None, 1), (5, None)], "doc_id long, quality int")
    table = quality.fit(odd, labels, per_class=100)
    scored = quality.score(odd, table).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)
    assert {r.held_out for r in scored if r.doc_id is None} == {False}


def test_quality_scores_equal_brute_force(spark, docs, odd):
    """Scores of whole documents from the fitted vectors, feature by feature."""
    table = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), per_class=60)
    rows = docs.select("doc_id", "text").unionByName(odd.where("doc_id IS NOT NULL AND doc_id <> 3").select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    got = {r.doc_id: r for r in quality.score(rows, table).collect()}
    for r in rows.collect():
        words = (r.text or "").split()
        ids = [i for w in words for i in quality.word_features(w)]
        hashes = np.array([zlib.crc32(w.encode()) % quality.BUCKETS for w in words], dtype=np.int64)
        ids += quality.pair_buckets(hashes).tolist()
        z = table[-1] + (table[ids].astype(np.float64).mean(axis=0) if ids else 0)
        p = 1 / (1 + np.exp(z[0] - z[1]))
        assert abs(got[r.doc_id].score - p) < 1e-5 and got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_languages_equal_brute_force(spark, docs, odd):
    """Predictions for whole documents from the fitted network, convolved window by window."""
    model = langid.fit(docs, per_language=20)
    rows = docs.select("doc_id", "text").limit(60).unionByName(odd.where("doc_id IS NOT NULL AND doc_id <> 3").select((F.col("doc_id") + 10**6).alias("doc_id"), "text")).collect()
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        data, total = r.text.lower().encode(), np.zeros(len(model["languages"]))
        for at in range(0, len(data), langid.WINDOW):
            own = data[at : at + langid.WINDOW]
            x = np.frombuffer(own.ljust(langid.WINDOW + 2, b"\0"), np.uint8)
            response = sum(model["single"][j][x[j : len(x) - 3 + j]] for j in range(4))
            z = np.maximum(response.max(axis=0) + model["b"], 0) @ model["out"] + model["bias"]
            p = np.exp(z - z.max())
            total += len(own) * p / p.sum()
        total /= len(data)
        assert abs(got[r.doc_id].score - total.max()) < 1e-4 and total[model["languages"].index(got[r.doc_id].lang_pred)] > total.max() - 1e-4


def test_window_tables_equal_the_convolution():
    net = langid.ByteCnn(["a", "b"])
    x = np.random.default_rng(1).integers(0, 256, (9, langid.WINDOW)).astype(np.uint8)
    padded = np.pad(x, ((0, 0), (0, 3)))
    pooled = []
    for k in langid.WIDTHS:
        view = np.lib.stride_tricks.sliding_window_view(net.p["emb"][padded], k, axis=1).transpose(0, 1, 3, 2).reshape(9, -1, k * langid.DIM)
        pooled.append((view @ net.p[f"w{k}"])[:, : langid.WINDOW - 1].max(axis=1))
    h = np.maximum(np.concatenate(pooled, axis=1) + net.p["b"], 0)
    z = h @ net.p["out"] + net.p["bias"]
    want = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose(langid.Scorer(net.folded()).window_probabilities(x), want / want.sum(axis=1, keepdims=True), atol=1e-4)


def test_bounded_sample_is_stable(spark):
    keys = spark.range(20000).select(F.col("id"), (F.col("id") % 2).alias("k"))
    n = {r.k: r["count"] for r in bounded_sample(keys, "k", "id", 500).groupBy("k").count().collect()}
    assert all(400 < c < 600 for c in n.values())
    assert bounded_sample(keys, "k", "id", 10**6).count() == 20000


def test_rows_without_duplicates(spark):
    """Repeated and null ids are judged by their own rows; extra columns with names of the helpers stay."""
    schema = "doc_id long, text string, _row long, kept boolean, class_id long"
    rows = [(1, "one two"), (1, "one two"), (1, "other"), (2, "three"), (2, "one two"), (None, "four"), (None, "three"), (None, None), (7, None), (9, "five six")]
    odd = spark.createDataFrame([(*r, 5, False, 6) for r in rows], schema)
    for classes in (exact.exact_dedup, minhash.near_duplicates):
        for docs, want in ((odd, [(1, "one two"), (1, "other"), (2, "three"), (7, None), (9, "five six"), (None, "four")]), (odd.where("doc_id >= 2 AND text <> 'one two'"), [(2, "three"), (9, "five six")])):
            got = without_duplicates(docs, classes)
            assert got.columns == docs.columns
            assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
        assert without_duplicates(odd.where("doc_id < 0"), classes).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "exact_dedup", "near_dedup", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None), (10**6 + 1, "12 34"), (10**6 + 2, docs.first().text)], "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    # columns with names that the stages use themselves
    for name in ("lang_pred", "lang_score", "_letter", "_row", "quality_score", "kept", "class_id", "keep_id"):
        docs = docs.withColumn(name, F.lit("mine"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, before, SF)
        assert docs.columns == columns and docs.where("lang_pred <> 'mine' OR quality_score <> 'mine' OR _letter <> 'mine'").isEmpty()
        kept, all_ = {r.doc_id for r in docs.collect()}, {r.doc_id for r in before.collect()}
        assert kept <= all_
        if name == "language_id":
            assert all_ - kept == {10**6, 10**6 + 1}
        if name == "exact_dedup":
            want = defaultdict(list)
            for r in before.collect():
                want[norm(r.text)].append(r.doc_id)
            assert kept == {min(ids) for ids in want.values()}
        if name == "near_dedup":
            assert kept == {min(c) for c in jaccard_classes([(r.doc_id, r.text) for r in before.collect()])}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.collect()} == kept


def test_pipeline_stages_of_odd_rows(spark, odd, none):
    """Null and repeated ids, null texts and empty tables, in every stage."""
    import corpus_pipeline

    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, docs = docs.count(), stage(spark, docs, SF)
            assert docs.columns == odd.columns and docs.count() <= before
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def piece_library():
    import sentencepiece as spm

    if not hasattr(piece_library, "sp"):
        piece_library.sp = spm.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    return piece_library.sp


def test_piece_bpe_equals_the_library(odd, docs):
    """Ids and decoded texts of odd and random texts, runs of spaces, long unbroken texts, and of a tiny cache."""
    rnd = random.Random(5)
    sp, bpe = piece_library(), piecebpe.PieceBpe.of(P.path("piece_bpe_32k.model"))
    texts = ODD + [" " * n + "the" + " " * (40 - n) for n in range(40)] + ["▁a ▁", "<s> </s>", "　a", "﻿ab", "😀😀 ok", "梦梦", "\n \nx"]
    texts += ["".join(rnd.choice("ab '\n\t é日1.!\x1c\x0bthe  ing▁") for _ in range(rnd.randint(1, 60))) for _ in range(1000)]
    texts += ["".join(rnd.choice("etaoinshrdlu") for _ in range(n)) for n in (5, 300, 100_000)] + [r.text for r in docs.limit(50).collect()]
    small = piecebpe.PieceBpe(P.path("piece_bpe_32k.model"), limit=20)
    for text, ids in zip(texts, bpe.encode_all(texts)):
        assert ids.tolist() == sp.encode(text or "", add_eos=True) and bpe.decode(ids) == sp.decode(ids.tolist())
    for some in (texts[:30], texts[30:60]):
        assert [x.tolist() for x in small.encode_all(some)] == [sp.encode(t or "", add_eos=True) for t in some]
    for _ in range(1000):
        ids = [rnd.choice([rnd.randrange(32_000), rnd.randrange(3, 259), rnd.randrange(3)]) for _ in range(rnd.randint(1, 12))]
        assert bpe.decode(np.array(ids)) == sp.decode(ids)


def test_piece_bpe_frames(spark, odd, none):
    model = P.path("piece_bpe_32k.model")
    back = piecebpe.decode(piecebpe.encode(odd, model), model)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(r.doc_id), r.text or "") for r in odd.collect())
    assert piecebpe.round_trip(none, model).count() == 0
    for r in piecebpe.round_trip(odd, model).join(odd.dropDuplicates(["doc_id", "text"]), "doc_id").where("doc_id <> 3 AND doc_id < 1000").collect():
        ids = piece_library().encode(r.text or "", add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())


VEC = "vec_id long, embedding array<float>, label int, row long, vec string"


def hard_negatives_by_force(rows, is_anchor, positives=5, negatives=10):
    ok = [r for r in rows if r[2] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    q = [[int(np.floor(256 * float(np.float32(x)))) for x in r[1]] for r in ok]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, a in enumerate(ok):
        if a[0] is None or not is_anchor(a[0]):
            continue
        scores = [(sum(x * y for x, y in zip(q[i], q[j])), b[0], b[2], j) for j, b in enumerate(ok) if j != i]
        for p, pid, *_ in sorted((s for s in scores if s[2] == a[2]), key=order)[:positives]:
            near = sorted((s for s in scores if s[2] != a[2] and 30 * p <= 100 * s[0] <= 90 * p), key=order)[:negatives]
            out += [(a[0], pid, k + 1, s[1], p, s[0]) for k, s in enumerate(near)]
    return sorted(map(str, out))


@pytest.mark.parametrize("part_rows, block_rows", [(1 << 17, 1 << 10), (70, 3)])
def test_hard_negatives_equal_brute_force(spark, part_rows, block_rows):
    """Clusters, repeated vectors, ids and rows, ties, nulls, non-finite components, short vectors, names that clash."""
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(6, 8))
    rows = [(i, [float(x) for x in np.float32(centres[i % 6] + 0.2 * rnd.normal(size=8))], int(rnd.integers(3)), i, "x") for i in range(300)]
    rows += [(300 + i, rows[5][1], i % 2, 0, "x") for i in range(60)] + [rows[10], rows[11], rows[11], rows[12][:2] + (0, 0, None)]
    rows += [(None, rows[7][1], 1, 0, None), (None, rows[7][1], 2, 0, None), (400, None, 1, 0, ""), (401, rows[0][1], None, 0, ""), (410, [1.0, None], 1, 0, ""), (420, [float("nan")], 1, 0, ""), (430, [float("inf")], 1, 0, ""), (440, [0.5, 0.5], 1, 0, ""), (450, [], 1, 0, ""), (460, [-x for x in rows[0][1]], 0, 0, "")]
    got = hardneg.hard_negatives(spark.createDataFrame(rows, VEC).repartition(3), F.col("vec_id") % 10 == 0, part_rows=part_rows, block_rows=block_rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == hard_negatives_by_force(rows, lambda i: i % 10 == 0)
    assert hardneg.hard_negatives(spark.createDataFrame([], VEC), F.col("vec_id") % 10 == 0).count() == 0


def test_spanning_tree_bounds_spare_most_scores_of_clusters():
    """Bounds never lose a candidate of the window, and far clusters aren't scored."""
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(20, 16)) * 300
    near = lambda n: np.floor(np.repeat(centres, n, axis=0) + rnd.normal(size=(20 * n, 16)))
    anchors, x = near(5), near(50)
    order, parent, edge = hardneg.spanning_tree(anchors)
    assert sorted(order.tolist()) == list(range(100)) and all(p < i for i, p in enumerate(parent))
    assert all(abs(edge[i] - np.linalg.norm(anchors[order[i]] - anchors[order[p]])) < 1e-6 for i, p in enumerate(parent) if p >= 0)
    tree = hardneg.Tree(anchors[order], parent, edge)
    exact = anchors[order] @ x.T
    low = np.sort(exact, axis=1)[:, -40]
    s = tree.scores(x, np.sqrt((x**2).sum(axis=1)), low, np.full(100, np.inf))
    wanted = exact >= low[:, None]
    assert (s[wanted] == exact[wanted]).all() and (np.isnan(s) | (s == exact)).all()
    assert tree.skipped > 0.5 * exact.size


TURN = "conv_id long, turn long, role string, text string, sign string, kind int"
WHITE = " \t\n\x0b\f\r"


def repair_by_force(rows):
    """Report of one conversation's rows (turn, role, text), which are damaged already, by comparing whole audits."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    grammar = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    inf = (10**9, "")
    best = {(len(rows), q): min([(0, "")] if q in (0, 3) else [inf]) for q in range(4)}
    for i in range(len(rows), -1, -1):
        if i < len(rows):
            (_, role, _), fault = rows[i], faults[i]
            for q in range(4):
                some = [(2 + best[i + 1, q][0], "D" + best[i + 1, q][1])]
                if fault in ("", "truncated"):
                    for letter, cost, initial in [("K", 0, role[:1]), ("R", 1, "u"), ("R", 1, "a")]:
                        if (q, initial) in grammar:
                            c, a = best[i + 1, grammar[q, initial]]
                            some.append((cost + 5 * (fault == "truncated") + c, letter + a))
                best[i, q] = min(some)
        for _ in range(4):
            for (q, initial), to in grammar.items():
                if initial != "s":
                    best[i, q] = min(best[i, q], (5 + best[i, to][0], "I" + best[i, to][1]))
    cost, audit = best[0, 0]
    q, at, lines = 0, 0, []
    for letter in audit:
        want = "a" if q == 2 else "u"
        if letter == "I":
            lines.append({"u": "user:", "a": "assistant:"}[want])
            q = grammar[q, want]
            continue
        _, role, text = rows[at]
        at += 1
        if letter != "D":
            role = role if letter == "K" else {"u": "user", "a": "assistant"}[want]
            lines.append(f"{role}:{text}")
            q = grammar[q, role[:1]]
    turns = [t for t, *_ in rows if t is not None]
    initials = [r[1][:1] for r in rows]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def odd_turns():
    rnd = random.Random(11)
    rows = []
    for conv in [*range(250), None]:
        for turn in range(rnd.randint(1, 12)):
            text = rnd.choice(["", " \n", "ok.", "why?", "yes! ", "cut", "cut \t", None, f"t{turn}.", "é…", " ."])
            rows.append((conv, rnd.choice([turn, turn, turn, None, turn + 3, -turn]), rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User", "s"]), text, "x", 9))
    rows += rows[:40] + [(7, 1, "user", "again and again", "x", 1)] * 200
    rows += [(1000, i, "user" if i % 2 else "assistant", f"line {i}" + "." * (i % 3), "", 0) for i in range(3000)]
    return rows


def test_conversation_repair_equals_brute_force(spark):
    """Ties, null and repeated turns, other roles, null ids, long conversations, conversations without rows, clashing names."""
    rows = odd_turns()
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        convs[conv].append((turn, role, text))
    ids = spark.createDataFrame([(c,) for c in [*convs, 5000]], "conv_id long")
    turns = spark.createDataFrame(rows, TURN).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in dialogue.repair_report(turns, ids).collect()}
    assert got.pop(5000) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: repair_by_force(x)[:-1] for c, x in convs.items()}
    assert len({x[6] for x in got.values()}) > 50  # rows are never inserted: deleting a neighbour is cheaper
    lines = defaultdict(list)
    for r in dialogue.repaired_turns(turns).orderBy("conv_id", "position").collect():
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: x for c, x in lines.items()} == {c: y for c, x in convs.items() if (y := repair_by_force(x)[-1])}
    none = spark.createDataFrame([], TURN)
    assert dialogue.repair_report(none).count() == dialogue.repaired_turns(none).count() == dialogue.repair_report(dialogue.damaged(none), none).count() == 0


def test_suffixes_are_shared_and_blocks_agree_with_whole_conversations(monkeypatch):
    """Blocks and pieces of any size, and an automaton that is emptied often, give the same report."""
    rnd = random.Random(12)
    whole = dialogue.Suffixes()
    words = ["".join(chr(65 + rnd.randrange(16)) for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    for w in words:
        whole.nodes(w, None)
    assert len(whole.ahead) == len({w[i:] for w in words for i in range(len(w))}) + 1
    small = dialogue.Suffixes(limit=10)
    long = "".join(chr(65 + rnd.randrange(16)) for _ in range(500))
    monkeypatch.setattr(dialogue, "PIECE", 1000)
    at = whole.nodes(long, None)[0][0]
    for piece in (1, 7, 32):
        monkeypatch.setattr(dialogue, "PIECE", piece)
        for q in range(4):
            state, audit, spent = q, "", 0
            costs, cuts = None, []
            for start in range(len(long) - 50, -1, -50):
                cuts.append((long[start : start + 50], costs))
                costs = small.nodes(long[start : start + 50], costs)[1]
            for signs, after in reversed(cuts):
                for node in small.nodes(signs, after)[0]:
                    audit, spent, state = audit + small.audit[node][state], spent + small.spent[node][state], small.final[node][state]
            assert (audit, spent) == (whole.audit[at][q], whole.spent[at][q])


def test_damage_is_by_the_checksum_of_conversation_and_turn(spark):
    rows = [(c, t, "assistant", f"a. b! {c}?", "", 0) for c in range(40) for t in range(9)] + [(None, None, None, None, None, None), (3, None, None, None, None, None)]
    got = sorted(map(str, dialogue.damaged(spark.createDataFrame(rows, TURN)).collect()))
    want = []
    for c, t, role, text, *_ in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if d:
            out = f"Row(conv_id={c}, turn={t}, role={('user' if d == 4 else role)!r}, text={('' if d == 1 else re.sub('[.!?]', '', text) if d == 2 else text)!r})"
            want += [out] * (2 if d == 3 else 1)
    assert got == sorted(want)
