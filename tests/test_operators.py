"""Golden cases, built by hand, and properties: order does not matter, sessions do not mix."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.functions.text import name_similarity, normalised_name, text_similarity
from sessionloom.operators import alignment as al
from sessionloom.operators import attribution as at
from sessionloom.operators import calibration as ca
from sessionloom.operators import encounters as en
from sessionloom.operators import frames as fr
from sessionloom.operators import identity as idn
from sessionloom.operators import intervals as iv
from sessionloom.operators import ledger as lg
from sessionloom.operators import lexical as lx
from sessionloom.operators import quality as qa
from sessionloom.operators import timeline as tl
from sessionloom.operators import transcript as tr
from sessionloom.operators import vectors as vec
from sessionloom.operators.graph import connected_components, merged_components
from sessionloom.sources import capture as cp

UTT = "session_id long, utt_id string, source_index long, track_id string, player_id string, start_s double, end_s double, text string, energy double"


def utterances(spark, rows, session=1):
    return spark.createDataFrame([(session, f"{session}-{i}", i, t, t, float(s), float(e), x, float(g)) for i, (t, s, e, x, g) in enumerate(rows)], UTT)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_merged_components_are_those_of_all_edges(spark):
    """New edges within a component, between two, to new vertices and among new ones; also none."""
    rnd = random.Random(4)
    edges = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(90)]
    table = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    for cut in (0, 40, 90):
        got = merged_components(connected_components(table(edges[:cut])), table(edges[cut:]))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, connected_components(table(edges)).collect()))


BLEED = [("t1", 1.0, 2.5, "the guard advances", 0.9), ("t2", 1.1, 2.6, "the guard advances", 0.2), ("t1", 9.0, 9.5, "elsewhere", 0.5)]


def test_bleed_and_overlap(spark):
    u = utterances(spark, BLEED).unionByName(utterances(spark, BLEED, 2))
    pairs = {(r.session_id, r.a, r.b) for r in tr.overlap_pairs(u).collect()}
    assert pairs == {(s, f"{s}-{a}", f"{s}-{b}") for s in (1, 2) for a, b in ((0, 1), (1, 0))}
    edges = tr.bleed_edges(u)
    primary = {r.utt_id: r.bleed_of for r in tr.bleed_primary(u, tr.bleed_components(edges)).collect()}
    assert primary == {"1-0": None, "1-1": "1-0", "2-0": None, "2-1": "2-0"}
    assert [(r.track_a, r.track_b, r.primary) for r in tr.bleed_warnings(edges).orderBy("session_id").collect()] == [("t1", "t2", "1-0"), ("t1", "t2", "2-0")]


def test_overlap_plan_has_no_nested_loop(spark):
    plan = tr.overlap_pairs(utterances(spark, BLEED))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    plan = tr.bleed_edges(utterances(spark, BLEED))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_order_of_input_does_not_matter(spark):
    rows = [("t1", i * 1.5, i * 1.5 + 1, f"word {i % 3}", 0.1 * i) for i in range(12)] + [("t2", i * 1.5 + 0.2, i * 1.5 + 1.1, f"word {i % 3}", 0.5) for i in range(12)]
    u = utterances(spark, rows)
    want = sorted(map(tuple, tr.ordered_ids(tr.overlap_ids(u)).select("utt_id", "id", F.array_join("overlap_ids", ",")).collect()))
    got = sorted(map(tuple, tr.ordered_ids(tr.overlap_ids(u.repartition(7, "text").orderBy(F.desc("utt_id")))).select("utt_id", "id", F.array_join("overlap_ids", ",")).collect()))
    assert got == want


def test_split_at_gaps(spark):
    w = spark.createDataFrame([(1, "u", i, t, s, e) for i, (t, s, e) in enumerate([("First", 4.0, 4.5), ("sentence", 4.6, 5.0), ("Second", 6.0, 6.4), ("sentence", 6.5, 7.0)])], "session_id long, utt_id string, pos long, t string, s double, e double")
    assert [r.text for r in tr.split_at_gaps(w).orderBy("part").collect()] == ["First sentence", "Second sentence"]


def test_backchannel_and_speech_seconds(spark):
    assert value(spark, tr.is_backchannel(F.lit("Yeah."), F.lit(0.4))) and not value(spark, tr.is_backchannel(F.lit("Yeah."), F.lit(2.0)))
    tracks = spark.createDataFrame([(1, "a", "p1"), (1, "b", "p2"), (1, "c", "p3")], "session_id long, track_id string, player_id string")
    vad = spark.createDataFrame([(1, "a", 1.0, 8.0), (1, "b", 1.1, 3.4)], "session_id long, track_id string, start_s double, end_s double")
    assert {r.player_id: r.speech_s for r in tr.speech_seconds(tracks, vad).collect()} == {"p1": 7.0, "p2": 2.3, "p3": 0.0}


def test_strict_segments_fail(spark):
    bad = utterances(spark, [("t", 2.0, 1.0, "x", -1.0)])
    assert tr.validate_segments(bad).select("valid", "energy").first()[:] == (False, 0.0)
    with pytest.raises(Exception, match="bad bounds"):
        tr.strict_segments(bad).collect()


def test_interval_joins_equal_brute_force(spark):
    rnd = random.Random(5)
    a = [(1, i, rnd.uniform(0, 90)) for i in range(60)]
    b = [(1, i, rnd.uniform(0, 90)) for i in range(60)]
    left = spark.createDataFrame([(k, i, s, s + i % 9) for k, i, s in a], "k long, i long, ls double, le double")
    right = spark.createDataFrame([(k, i, s, s + i % 4) for k, i, s in b], "k long, j long, rs double, re double")
    want = {(i, j) for (_, i, s), (_, j, t) in itertools.product(a, b) if s <= t + j % 4 and t <= s + i % 9}
    assert sorted(want) == sorted(map(tuple, iv.interval_join(left, right, ["k"], ("ls", "le", "rs", "re"), 3.0).select("i", "j").collect()))
    want = {(i, j) for (_, i, s), (_, j, t) in itertools.product(a, b) if s - 1 <= t <= s + 2}
    assert sorted(want) == sorted(map(tuple, iv.band_join(left, right, ["k"], "ls", "rs", 1.0, 2.0).select("i", "j").collect()))


def test_points_in_intervals_of_any_length(spark):
    """The pairs of brute force for lengths from 0 to hours; an interval becomes two rows at most, a point one a doubling."""
    rnd = random.Random(6)
    points = [(rnd.randrange(3), i, rnd.choice([None, rnd.uniform(-100, 4000)]) if i % 9 == 0 else rnd.uniform(-100, 4000)) for i in range(400)]
    spans = [(rnd.randrange(3), i, a, a + rnd.choice([0.0, 0.1, 0.25, 1.5, 2.0, 30.0, 600.0, 3600.0]) * rnd.choice([1, 1, 0.7])) for i in range(300) for a in [rnd.choice([rnd.uniform(-100, 4000), points[i][2] or 0.0])]] + [(1, 900, None, 3.0), (1, 901, 5.0, None), (1, 902, 5.0, 4.0)]
    p, s = spark.createDataFrame(points, "k long, p long, t double"), spark.createDataFrame(spans, "k long, s long, a double, b double")
    got = sorted((r.p, r.s) for r in iv.point_join(p, s, ["k"], "t", ("a", "b")).collect())
    assert got == sorted((x[1], y[1]) for x in points for y in spans if x[0] == y[0] and None not in (x[2], y[2], y[3]) and y[2] <= x[2] <= y[3])
    width = lambda y: 2.0 ** np.ceil(np.log2(max(y[3] - y[2], 0.25)))
    assert all(np.floor(y[3] / width(y)) - np.floor(y[2] / width(y)) <= 1 for y in spans[:300])
    assert len({width(y) for y in spans[:300]}) <= 15


def test_rolls_have_uncertainties_of_their_own(spark):
    df = spark.createDataFrame
    numbers = df([(1, "a", 12, 10.0), (1, "b", 12, 100.0), (1, "c", None, 10.0), (1, "d", 7, 10.0), (1, "e", 12, 300.0)], "session_id long, utt_id string, number long, mid_s double")
    rolls = df([(1, 1, 12, 11.0, None), (1, 2, 12, 90.0, 10.0), (1, 3, 12, 70.0, 30.0), (1, 4, 12, 298.0, 1.9), (2, 5, 7, 10.0, 9.0)], "session_id long, roll_id long, total long, t_s double, uncertainty_s double")
    got = {r.utt_id: (r.n, r.roll_id, r.reason) for r in lx.roll_total_evidence(numbers, rolls).collect()}
    assert got == {"a": (1, 1, "matched_roll_total"), "b": (2, None, "ambiguous_roll"), "c": (0, None, "not_numeric_only"), "d": (0, None, "no_aligned_roll"), "e": (0, None, "no_aligned_roll")}
    said = df([(1, "a", 10.0, ["x"], False), (1, "b", 50.0, [], True), (2, "c", 10.0, None, None)], "session_id long, utt_id string, mid_s double, overlap_ids array<string>, is_backchannel boolean")
    scores, sims = df([("a", 1.0)], "utt_id string, lex_ic double"), df([(1, "a", "table", 0.2), (1, "a", "character", 0.7), (1, "b", "character", 0.4)], "session_id long, utt_id string, kind string, similarity double")
    anchors = df([(1, 20.0, 8.0), (1, 55.0, 2.9)], "session_id long, t_audio_s double, uncertainty_s double")
    got = {r.utt_id: (r.roll_prox, r.overlap, r.backchannel, r.voice_margin, r.active_character_ids) for r in at.evidence(said, scores, sims, anchors, df([(1, "z"), (1, "y"), (1, "y")], "session_id long, character_id string")).collect()}
    assert got == {"a": (1.0, 1.0, 0.0, pytest.approx(0.5), ["y", "z"]), "b": (0.0, 0.0, 1.0, None, ["y", "z"]), "c": (0.0, 0.0, 0.0, None, [])}


def test_as_of(spark):
    left = spark.createDataFrame([(1, 5.0), (1, 10.0), (1, 0.5), (2, 5.0)], "k long, t double")
    right = spark.createDataFrame([(1, 5.0, "a"), (1, 1.0, "z"), (1, 5.0, "b")], "k long, rt double, v string")
    got = {(r.k, r.t): r.v for r in iv.as_of(left, right, ["k"], "t", "rt", ["v"], ["v"]).collect()}
    assert got == {(1, 5.0): "b", (1, 10.0): "b", (1, 0.5): None, (2, 5.0): None}
    strict = {(r.k, r.t): r.v for r in iv.as_of(left, right, ["k"], "t", "rt", ["v"], ["v"], strict=True).collect()}
    assert strict[1, 5.0] == "z"


def test_connected_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.v: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_names(spark):
    assert value(spark, normalised_name(F.lit("Séren#1234"))) == "seren" and value(spark, normalised_name(F.lit("  cyd_h  "))) == "cyd h"
    assert value(spark, name_similarity(F.lit("ash b"), F.lit("ash b"))) == 1.0 and value(spark, name_similarity(F.lit(""), F.lit("a"))) == 0.0
    assert value(spark, text_similarity(F.lit("a b"), F.lit("b a"))) == 1.0
    players = spark.createDataFrame([("pl_ash", "Ash B.", "ashb", None), ("pl_cy", "Cydra", "cydra", None)], "player_id string, display_name string, username string, account string")
    got = idn.suggestions(spark.createDataFrame([("Ashh B.",), ("zzzqqq",)], "name string"), players).collect()
    assert [(r.name, r.player_id) for r in got] == [("Ashh B.", "pl_ash")]


def test_bound_tracks_are_one_to_one(spark):
    players = spark.createDataFrame([("p1", "Ann", "ann", None, "7"), ("p2", "Bob", "bob", None, None)], "player_id string, display_name string, username string, account string, user_id string")
    tracks = spark.createDataFrame([(1, "a", "xx", "7"), (1, "b", "Ann", None), (1, "c", "bob", None), (1, "d", "qqq", None)], "session_id long, track_id string, name string, user_id string")
    got = {r.track_id: (r.player_id, r.reason) for r in idn.bind_tracks(tracks, players).collect()}
    assert got == {"a": ("p1", "matched"), "b": (None, "player_taken"), "c": ("p2", "matched"), "d": (None, "no_match")}


def test_mapping_decided_twice_fails(spark):
    p = spark.createDataFrame([("p1", ["x"])], "player_id string, hints array<string>")
    assert idn.apply_mappings(p, spark.createDataFrame([("n", "p1")], "name string, player_id string")).first().hints == ["x", "n"]
    with pytest.raises(Exception, match="decided twice"):
        idn.apply_mappings(p, spark.createDataFrame([("n", "p1"), ("n", "p1")], "name string, player_id string")).collect()


def test_suggestions_equal_all_pairs(spark):
    """Names that share a part are all that are similar enough."""
    rnd = random.Random(8)
    base = ["".join(rnd.choice("abcdeilnorst ") for _ in range(rnd.randint(1, 12))) for _ in range(60)]
    noisy = ["".join(rnd.choice("abcxyz") if rnd.random() < 0.35 else c for c in n) for n in base] + ["ab", "x", "zz top", ""]
    players = spark.createDataFrame([(f"p{i}", n, None, None) for i, n in enumerate(base)], "player_id string, display_name string, username string, account string")
    observed = spark.createDataFrame([(n,) for n in noisy], "name string")
    got = {(r.name, r.player_id): r.score for r in idn.suggestions(observed, players, k=1000).collect()}
    pairs = observed.distinct().crossJoin(players).select("name", "player_id", normalised_name(F.col("name")).alias("a"), normalised_name(F.col("display_name")).alias("b"))
    pairs = pairs.select("name", "player_id", F.round(name_similarity(F.col("a"), F.col("b")), 4).alias("score")).where("score >= 0.4")
    assert got == {(r.name, r.player_id): r.score for r in pairs.collect()} and len(got) > 90


def test_ranks_sums_and_blocks(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("n"))
    rows = sorted(iv.in_order(df, ["v"], {"upto": "n"}).collect())
    assert [r["rank"] for r in rows] == list(range(1, 1001)) and [r.upto for r in rows] == list(np.cumsum([r.n for r in rows]))
    assert iv.in_order(df.where("v < 0"), ["v"]).count() == 0
    assert iv.in_blocks(spark.range(7).withColumnRenamed("id", "a"), spark.range(50), "id", size=9).distinct().count() == 350


def test_vocatives_and_long_terms(spark):
    texts = spark.createDataFrame([(1, "Aveline, take the bridge."), (2, "Aveline is a brave ranger."), (3, "so, aveline! one two three four five")], "id long, text string")
    lexicon = spark.createDataFrame([("vocative", "in", 1.0, "Aveline"), ("x", "out", 1.0, "two three four five"), ("y", "in", 1.0, " ")], "class string, polarity string, weight double, term string")
    assert sorted((r.id, r["class"], r.pos) for r in lx.phrase_markers(texts, lexicon).collect()) == [(1, "vocative", 0), (3, "vocative", 1), (3, "x", 3)]


def test_spoken_numbers(spark):
    assert lx.normalise("I'll roll nineteen — doesn't that hit?") == "i will roll 19 does not that hit"
    assert lx.normalise("twenty one") == "21"
    said = {"two hundred": 200, "and": None, "one twenty": 21, "five six": 11, "and five": 5, "five and": 5, "hundred": None, "zero hundred": None, "12": 12, "12 five": None, "two hundred and thirty one": 231, "dragon": None, "": None, "９": None}
    df = spark.createDataFrame([(k,) for k in said], "t string").select("t", lx.spoken_number(F.split("t", " ")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == said and {k: lx.number_said(k.split()) for k in said} == said


def test_archive_pages(spark):
    inner = '<div class="message rollresult" data-messageid="m1"><span class="by">Bob:</span><div>Hits <b>hard</b></div><div class="message">inner</div></div>'
    assert cp.page_messages(f"<p class='message'>no</p><div id='textchat'>{inner}<li data-message-id=m2 class='x'>emote</li></div>") == [{"id": "m1", "who": "Bob", "source_kind": "rollresult", "text": "Hits hard inner"}, {"id": "m2", "who": None, "source_kind": None, "text": "emote"}]
    assert [m["text"] for m in cp.page_messages("just <b>text</b> &amp; more")] == ["just text & more"] and cp.page_messages(" ") == cp.page_messages(None) == []
    assert len(cp.page_messages("<div class=message>" * 20000)) == 1
    raws = {1: '[{"id": "a", "text": "x"}, "bare"]', 2: '"[1]"', 3: '{"html": "<div class=message>hi</div>"}', 4: "{broken", 5: '{"messages": [{"kind": "turnorder", "id": "t"}], "turnorder_events": [{"id": "t"}, {"id": "u", "entries": [{"name": "a", "value": 1.5}]}, {"id": "u"}, {}]}'}
    df = spark.createDataFrame(list(raws.items()), "session_id long, raw string")
    routes = {r.session_id: r.r for r in df.select("session_id", cp.route(F.col("raw")).alias("r")).collect()}
    assert routes == {1: "json", 2: "json", 3: "html", 4: "html", 5: "json"}
    json_ = df.where("session_id IN (1, 2, 5)")
    assert sorted((r.session_id, r.source_index, r.id, r.text) for r in cp.json_messages(json_).collect()) == [(1, 0, "a", "x"), (1, 1, None, "bare"), (2, 0, None, "1"), (5, 0, "t", None)]
    assert [r.text for r in cp.html_messages(df.where("session_id IN (3, 4)")).orderBy("session_id").collect()] == ["hi", "{broken"]
    events = cp.turnorder_events(json_)
    assert sorted(((r.source_index, r.id, r.entries and r.entries[0].value) for r in events.collect()), key=str) == [(0, "t", None), (2, "u", 1.5), (4, None, None)]
    assert {r.text for r in cp.turnorder_messages(events).collect()} == {"Turn order updated"}


def test_quoted_spans(spark):
    words = F.array(*map(F.lit, ["He", "said", '"Halt', 'now."', "“Halt”"]))
    assert [tuple(x) for x in value(spark, lx.quoted_spans(words))] == [(2, 3), (4, 4)]
    assert value(spark, lx.quoted_spans(F.array(F.lit('"open'), F.lit("end")))) == []


def test_frames(spark):
    flags = [1, 1, 1, 0, 1, 1, 0, 0, 0, 0, 1, 0, 0, 0]
    mask = spark.createDataFrame([("t", i, bool(f)) for i, f in enumerate(flags)], "track_id string, frame_ix long, voiced boolean")
    assert [r.n for r in fr.runs(mask).orderBy("run").collect()] == [3, 1, 2, 4, 1, 3]
    assert [(r.first_ix, r.last_ix) for r in fr.shaped_runs(mask).collect()] == [(0, 5)]
    one = spark.createDataFrame([("t", 0.0, 65.0)], "track_id string, start_s double, end_s double")
    got = fr.padded_segments(one, 0.3, 0.0, 30.0, 0.5).orderBy("start_s").collect()
    assert [(r.start_s, r.end_s) for r in got] == [(0.0, 30.0), (29.5, 59.5), (59.0, 65.0)]
    two = spark.createDataFrame([("t", 0.0, 2.0), ("t", 1.0, 3.0), ("t", 5.0, 6.0)], "track_id string, start_s double, end_s double")
    assert fr.union_length(two).first().covered_s == 4.0


def test_alignment_chain_equals_the_dense_optimum():
    rnd = random.Random(3)
    for _ in range(60):
        cells = {(rnd.randrange(8), rnd.randrange(8)): rnd.randrange(8, 16) * 100 for _ in range(14)}
        rows = sorted(cells, key=lambda c: (c[0], -c[1]))
        weights = [cells[c] + al.ROLL_COST + al.SPEECH_COST for c in rows]
        got = al.best_chain([c[0] for c in rows], [c[1] for c in rows], weights)
        assert all(rows[a][0] < rows[b][0] and rows[a][1] < rows[b][1] for a, b in zip(got, got[1:]))
        best = np.zeros((9, 9), int)
        for i, j in itertools.product(range(8), range(8)):
            best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + (cells[i, j] + al.ROLL_COST + al.SPEECH_COST if (i, j) in cells else 0))
        assert sum(weights[i] for i in got) == best[8, 8]


def test_clock(spark):
    def encode(ms):
        return "".join(al.ID_ALPHABET[ms // 64**k % 64] for k in range(7, -1, -1))

    assert value(spark, al.id_millis(F.lit(encode(1786921453345) + "abc"))) == 1786921453345
    assert value(spark, al.id_millis(F.lit("not-a-push-id"))) is None and value(spark, al.id_millis(F.lit("-"))) is None
    points = spark.createDataFrame([(1, 10, 10.0), (1, 30, 30.0)], "session_id long, seq long, t_s double")
    rolls = spark.createDataFrame([(1, s, s, None) for s in (10, 20, 40)], "session_id long, seq long, roll_id long, expected_s double")
    got = {r.seq: (r.t_audio_s, r.anchor) for r in al.anchors(al.project(rolls, points, al.fit_scale(points, points))).collect()}
    assert got == {10: (10.0, "matched"), 20: (20.0, "interpolated"), 40: (40.0, "extrapolated")}


def test_projection_ends_by_their_own_slopes(spark):
    """Both ends by their own two points, one point by the usual step, none by the expected time, never below 0; residuals of leaving one out."""
    df = spark.createDataFrame
    points = df([(1, 10, 100.0), (1, 12, 102.0), (1, 14, 110.0), (1, 15, 112.0), (2, 5, 50.0)], "session_id long, seq long, t_s double")
    rolls = df([(1, s, s, None) for s in (1, 9, 11, 12, 17)] + [(2, 3, 3, None), (2, 60, 60, None), (3, 4, 4, 9.5), (3, 6, 6, None)], "session_id long, seq long, roll_id long, expected_s double")
    fits = al.fit_scale(points, points)
    assert {r.session_id: (r.scale_s, r.fallback_s) for r in fits.collect()} == {1: (pytest.approx((abs(102 - 105) + abs(110 - (102 + 10 * 2 / 3))) / 2), 2.0), 2: (0.25, 1.0)}
    got = {(r.session_id, r.seq): (r.t_audio_s, r.anchor) for r in al.project(rolls, points, fits).collect()}
    assert got == {
        (1, 1): (91.0, "extrapolated"), (1, 9): (99.0, "extrapolated"), (1, 11): (101.0, "interpolated"), (1, 12): (102.0, "matched"), (1, 17): (116.0, "extrapolated"),
        (2, 3): (48.0, "extrapolated"), (2, 60): (105.0, "extrapolated"), (3, 4): (9.5, "extrapolated"), (3, 6): (6.0, "extrapolated"),
    }
    out = {(r.session_id, r.seq): round(r.residual_s, 6) for r in al.leave_one_out(points, fits).collect()}
    assert out == {(1, 10): 6.0, (1, 12): 3.0, (1, 14): round(110 - (102 + 20 / 3), 6), (1, 15): 2.0, (2, 5): 0.0}
    basis = df([(1, "wallclock"), (2, "order_only")], "session_id long, basis string")
    quality = {r.session_id: tuple(r)[1:] for r in al.alignment_quality(al.anchors(al.project(rolls, points, fits)), points, fits, basis).collect()}
    # rolls 1, 9 and 11 are one run, from its first to the match after it; 17 is another, from that match to itself
    assert quality[1] == (0.2, 2.5, 14.0, None) and quality[2] == (0.0, 0.0, 57.0, None) and quality[3] == (0.0, None, 0.0, None)


def test_smoothing_sees_what_it_has_changed(spark):
    rows = [(1, i, f"u{i}", m, 0.5, []) for i, m in enumerate("ABAB")] + [(2, i, f"v{i}", m, c, []) for i, (m, c) in enumerate([("A", 0.5), ("B", 0.9), ("A", 0.5)])]
    got = at.smoothed(spark.createDataFrame(rows, "session_id long, ord long, utt_id string, mode string, confidence double, flags array<string>"))
    assert "".join(r.mode for r in got.where("session_id = 1").orderBy("ord").collect()) == "AAAB"
    assert "".join(r.mode for r in got.where("session_id = 2").orderBy("ord").collect()) == "ABA"


def test_nearest_character_must_be_active(spark):
    s = spark.createDataFrame([(1, "u", "c1", 0.99), (1, "u", "c2", 0.98)], "session_id long, utt_id string, character_id string, similarity double")
    assert at.nearest_character(s, spark.createDataFrame([(1, "c2")], "session_id long, character_id string")).first().character_id == "c2"
    assert at.nearest_character(s, spark.createDataFrame([(1, "c2"), (1, "c1")], "session_id long, character_id string")).isEmpty()


def test_clusters(spark):
    rnd = np.random.default_rng(1)
    centres = np.eye(4)
    vectors = np.concatenate([c + rnd.normal(0, 0.03, (5, 4)) for c in centres])
    owner = vec.agglomerate(vectors, 0.18)
    assert len(set(owner)) == 4 and all(len(set(owner[i * 5 : i * 5 + 5])) == 1 for i in range(4))
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(vectors)], "session_id long, id long, vector array<double>")
    assert vec.cluster(df, ["session_id"], 0.18).select("cluster").distinct().count() == 4
    for n in (1, 2, 60):
        many = np.round(rnd.normal(0, 1, (n, 3)), 1)
        owner, centroid, size = list(range(n)), {i: v for i, v in enumerate(many)}, dict.fromkeys(range(n), 1)
        unit = lambda v: v / max(np.linalg.norm(v), 1e-300)
        while len(centroid) > 1:
            far, i, j = min((round(1 - unit(centroid[i]) @ unit(centroid[j]), 12), i, j) for i, j in itertools.combinations(centroid, 2))
            if far > 0.3:
                break
            centroid[i] = (centroid[i] * size[i] + centroid.pop(j) * size[j]) / (size[i] + size[j])
            size[i] += size[j]
            owner = [i if o == j else o for o in owner]
        assert vec.agglomerate(many, 0.3).tolist() == np.unique(owner, return_inverse=True)[1].tolist()
    assert len(vec.agglomerate(np.zeros((0, 3)))) == 0
    equal = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [1.0, 0.0])], "profile_id string, centroid array<double>")
    assert not vec.match_profiles(spark.createDataFrame([("c", [1.0, 0.0])], "cluster_id string, centroid array<double>"), equal).where("labelled").count()


def test_samples_and_folds(spark):
    items = spark.createDataFrame([(f"u{i:02d}", "a" if i < 10 else "b", 0.5 if i == 11 else 0.9) for i in range(12)], "id string, mode string, score double")
    assert ca.uncertain_sample(items, items.where("id = 'u00'"), 1).first().id == "u11"
    assert sorted(r.mode for r in ca.stratified_sample(items, ["mode"], 6).collect()) == ["a"] * 5 + ["b"]
    folds = {r.id: r.fold for r in ca.folds(items).collect()}
    assert folds == {f"u{i:02d}": i % 5 for i in range(12)}
    report = ca.calibration_report(items.limit(19), spark.createDataFrame([("a", "a")], "label string, predicted string"))
    assert report.first().message == "need 8 more labels"


EVENT = "session_id long, ord long, id string, kind string, t_start_s double, t_end_s double, player_id string, character_id string, character_display string, is_npc boolean, is_dm boolean, confidence double, text string, mode string, rolls array<struct<roll_id:long,kind:string>>, utterances array<string>"


def event(session, ord_, kind="speech", start=0.0, end=0.0, player=None, character=None, name=None, text=None, mode=None, rolls=(), npc=False, dm=False):
    return (session, ord_, f"e_{ord_}", kind, float(start), float(end), player, character, name, npc, dm, 1.0, text, mode, [(i, k) for i, k in rolls], [])


def test_beats_conserve_events(spark):
    events = spark.createDataFrame([event(s, i + 1, "speech" if i % 4 else "gap", i * 10, i * 10 + 9, f"p{i % 3}", text="the thing") for s in (1, 2) for i in range(40)], EVENT)
    scored = tl.boundary_signals(events, ["thing"])
    bounds = tl.session_bounds(events, events.select("session_id", F.lit(0.0).alias("duration_s")).distinct())
    cuts = tl.merge_short(events, tl.pick_peaks(tl.boundary_candidates(scored), bounds), 40.0)
    beats = tl.assign_beats(events, cuts)
    assert beats.count() == 80 and beats.select("session_id", "id").distinct().count() == 80
    spans = beats.groupBy("session_id", "beat").agg(F.min("t_start_s").alias("t")).orderBy("session_id", "t").collect()
    assert len(spans) > 2 and all(b.t - a.t >= 30 for a, b in zip(spans, spans[1:]) if a.session_id == b.session_id)
    alone = tl.assign_beats(events.where("session_id = 1"), cuts.where("session_id = 1"))
    assert sorted(map(tuple, alone.select("id", "beat").collect())) == sorted(map(tuple, beats.where("session_id = 1").select("id", "beat").collect()))


def test_peaks_keep_their_distance(spark):
    """The same as comparing each candidate with all that are taken, scores that tie and negative times included."""
    rnd = random.Random(8)
    rows = [(s, i, rnd.uniform(-50, 900), float(rnd.randrange(6))) for s in (1, 2, 3) for i in range(200)]
    bounds = spark.createDataFrame([(s, -20.0, 880.0) for s in (1, 2, 3)], "session_id long, start_s double, end_s double")
    got = tl.pick_peaks(spark.createDataFrame(rows, "session_id long, ord long, t_start_s double, score double").repartition(3), bounds, 25.0)
    want = []
    for s in (1, 2, 3):
        taken = []
        for _, i, t, _ in sorted((r for r in rows if r[0] == s), key=lambda r: (-r[3], r[1])):
            if t + 20 >= 25 and 880 - t >= 25 and all(abs(t - x) >= 25 for x in taken):
                taken.append(t)
                want.append((s, i, t))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_beats_count_rolls_in_speech_and_classify(spark):
    """Each class, rolls of speech, dominant characters, titles and their numbers, words across events."""
    talk = lambda s, n, *rows: [event(s, i + 1, **r) for i, r in enumerate(rows)]
    ic = dict(mode="in_character")
    rows = [
        *talk(1, 0, dict(start=0, end=4, character="b", name="Bo", rolls=[(1, "attack"), (2, "check")], **ic), dict(kind="roll", start=5, end=5, rolls=[(3, "other")])),
        *talk(2, 0, dict(start=0, end=4, character="b", name="Bo", text="as PREVIOUSLY told", **ic)),
        *talk(3, 0, dict(start=0, end=4, character="b", name="Bo", mode="non_speech"), dict(start=4, end=5, text="my character", **ic), dict(start=5, end=6, text="sheet", **ic)),
        *talk(4, 0, dict(start=0, end=4, text="we prepare", **ic)),
        *talk(5, 0, dict(start=0, end=1, character="b", name="Bo", **ic), dict(start=1, end=9, character="a", name="Al", mode="narration"), dict(start=9, end=9, kind="gap")),
        *talk(6, 0, dict(start=0, end=1, text="to the old mill", **ic)),
        *talk(7, 0, dict(kind="combat_end", start=0, end=0)),
        *talk(8, 0, dict(start=0, end=1, text="character", mode="in_character"), dict(start=1, end=2, text="sheet", mode="in_character")),
    ]
    assigned = spark.createDataFrame(rows, EVENT).withColumn("beat", F.lit(1).cast("long"))
    got = {r.session_id: r for r in tl.beats(assigned, ["Mill"]).collect()}
    assert {s: r.kind for s, r in got.items()} == {1: "combat", 2: "recap", 3: "table", 4: "planning", 5: "social", 6: "exploration", 7: "combat", 8: "table"}
    assert (got[1].n_attack, got[1].n_check, got[1].n_other, got[1].n_events) == (1, 1, 1, 2)
    assert (got[5].participants, got[5].dominant, got[5].title, got[5].ratio, got[5].t_end_s) == (["a", "b"], ["a", "b"], "social: Al + Bo", round(1 / 9, 6), 9.0)
    assert got[6].title == "exploration: Mill" and got[7].title == "combat: segment 1" and got[3].participants == ["b"]
    twice = spark.createDataFrame([event(1, 1, text="mill"), event(1, 2, text="the mill")], EVENT).withColumn("beat", F.col("ord"))
    assert sorted(r.title for r in tl.beats(twice, ["mill"]).collect()) == ["exploration: mill", "exploration: mill (2)"]


def test_density_and_fresh_terms(spark):
    """Density counts rolls in speech, both ways from the mean, by the window's length, and is 0 without events before; a term is new once it is four events old."""
    counts = [0, 0, 3, 1, 0, 0]
    rows = [event(1, i + 1, start=i, end=i, rolls=[(10 * i + k, "check") for k in range(n)], text=t) for i, (n, t) in enumerate(zip(counts, ["the", "Mill", "", "old mill", "", "mill"]))]
    got = {r.ord: r for r in tl.boundary_signals(spark.createDataFrame(rows, EVENT), ["mill"]).collect()}

    def cusum(i):
        left, right = counts[max(0, i - 4) : i], counts[i : i + 4]
        if not left:
            return 0.0
        run = top = 0.0
        for x in right:
            run = max(0.0, run + abs(x - sum(left) / len(left)) - 0.1)
            top = max(top, run)
        return min(1.0, top / len(right)) * 3

    assert [round(got[i + 1].density, 9) for i in range(6)] == [round(cusum(i), 9) for i in range(6)]
    assert [got[i + 1].glossary for i in range(6)] == [0, 2, 0, 0, 0, 0]


@pytest.mark.parametrize("spans, kept", [
    ([(0, 5, "speech"), (5, 20, "speech"), (20, 40, "speech")], [0, 2]),  # the first joins the one after
    ([(0, 20, "speech"), (20, 23, "speech"), (23, 40, "speech")], [0, 2]),  # others the one before
    ([(0, 20, "speech"), (20, 20, "combat_start"), (20, 40, "speech")], [0, 1]),  # a start of combat opens what follows
    ([(0, 20, "speech"), (20, 20, "combat_end"), (20, 40, "speech")], [0, 2]),
    ([(0, 0, "session_start"), (0, 20, "speech"), (20, 40, "speech")], [0, 2]),
    ([(0, 20, "speech"), (20, 22, "combat_start")], [0]),  # the last has none after
    ([(0, 2, "speech"), (2, 4, "speech"), (4, 6, "speech")], [0]),
    ([(0, 20, "speech"), (20, 22, "combat_start"), (22, 25, "speech"), (25, 40, "speech")], [0, 1]),
])
def test_short_spans_join_a_neighbour(spark, spans, kept):
    events = spark.createDataFrame([(1, i, float(a), float(b), m) for i, (a, b, m) in enumerate(spans)], "session_id long, ord long, t_start_s double, t_end_s double, kind string")
    cuts = events.where("ord > 0").select("session_id", "ord", "t_start_s")
    assert sorted(r.ord for r in tl.merge_short(events, cuts, 10.0).collect()) == kept[1:]


def test_speech_events_and_standalone_rolls(spark):
    df = spark.createDataFrame
    speech = df([(1, "u1", "p", 1.0, 2.0, "hi"), (1, "u2", "q", 3.0, 4.0, "ho"), (2, "u1", "p", 1.0, 2.0, "x")], "session_id long, utt_id string, player_id string, start_s double, end_s double, text string")
    attributions = df([(1, "u1", "in_character", "npc_a", 1.5), (2, "u1", "uncertain", None, -1.0)], "session_id long, utt_id string, mode string, character_id string, confidence double")
    players, characters = df([("p", "Pia", True)], "player_id string, display_name string, is_dm boolean"), df([("npc_a", "Ann", True)], "character_id string, name string, is_npc boolean")
    rolls = df([(1, i, 9 - i, float(i), "check", "p") for i in range(5)], "session_id long, roll_id long, seq long, t_s double, kind string, who string")
    anchors = df([(1, 0, "u1", "matched", 0.0), (1, 1, "u1", "matched", 0.0), (1, 2, None, "interpolated", 4.0), (1, 3, None, "order_only", 40.0)], "session_id long, roll_id long, matched_utt_id string, anchor string, uncertainty_s double")
    got = {(r.session_id, r.utt_id): (r.mode, r.character_display, r.speaker_display, r.is_dm, r.confidence, [x.roll_id for x in r.rolls]) for r in tl.speech_events(speech, attributions, players, characters, rolls, anchors).collect()}
    assert got == {(1, "u1"): ("in_character", "Ann", "Pia", True, 1.0, [1, 0]), (1, "u2"): (None, None, None, False, 1.0, []), (2, "u1"): ("uncertain", None, "Pia", True, 0.0, [])}
    alone = tl.standalone_rolls(rolls, anchors)
    assert {r.roll_id: r.confidence for r in alone.collect()} == {2: 0.6, 3: 0.0}
    turns = df([(1, 4, 0.0, "started"), (1, 5, 9.0, "ended"), (1, 6, 9.5, "changed")], "session_id long, seq long, t_s double, marker string")
    chat = df([(1, "c", 1.0, None, "hm", 7.0)], "session_id long, chat_id string, t_start_s double, t_end_s double, text string, confidence double")
    bounds = tl.session_bounds(speech.select("session_id", F.col("end_s").alias("t_end_s")), df([(2, 60.0)], "session_id long, duration_s double"))
    events = tl.event_union(tl.speech_events(speech, attributions, players, characters, rolls, anchors), alone, turns, tl.gaps(speech, ends=bounds), bounds, chat)
    order = ["e_combat_start_4", "e_session_start", "e_chat_c", "e_speech_u1", "e_roll_2", "e_roll_3", "e_speech_u2", "e_session_end", "e_combat_end_5", "e_turnorder_6"]
    assert [r.id for r in events.where("session_id = 1").orderBy("ord").collect()] == order
    assert [r.id for r in events.where("session_id = 2 AND kind = 'gap'").collect()] == ["e_gap_1jk_1aao_0"]
    assert sorted(x.roll_id for r in events.collect() for x in r.rolls) == [0, 1, 2, 3]
    assert tl.timeline_violations(events, speech, rolls, anchors).count() == 0
    assert [r.id for r in tl.rolls_in_window(events.where("session_id = 1"), 1.5, 2.5).orderBy("ord").collect()] == ["e_speech_u1", "e_roll_2"]
    assert [r.id for r in tl.events_for(events, df([(1, "npc_a"), (1, "npc_a"), (2, "npc_a")], "session_id long, character_id string")).collect()] == ["e_speech_u1"]


def test_timeline_rules(spark):
    """Each rule finds what breaks it, and the counters of the same pass agree."""
    df = spark.createDataFrame
    rows = [list(event(1, i, start=i, end=i + 1)) for i in range(1, 9)]
    rows[1][2] = rows[2][2]
    rows[3][2] = "s:4"
    rows[4][5] = 0.0
    rows[5][4:6] = [1.0, 2.0]
    for i, c in ((0, None), (1, float("nan")), (6, -0.1), (7, 1.1)):
        rows[i][11] = c
    rows[7][14], rows[7][15] = [(1, "check"), (9, "check")], ["u1", "u9"]
    speech, rolls = df([(1, "u1")], "session_id long, utt_id string"), df([(1, 1), (1, 2)], "session_id long, roll_id long")
    anchors = df([(1, 1, "u1"), (1, 2, None), (1, 2, "u7"), (1, 5, None)], "session_id long, roll_id long, matched_utt_id string")
    bad = tl.timeline_violations(df([tuple(r) for r in rows], EVENT), speech, rolls, anchors)
    want = {"duplicate_id": ["e_3", "e_3"], "bad_id": ["s:4"], "bad_confidence": ["e_1", "e_3", "e_7", "e_8"], "negative_length": ["e_5"], "out_of_order": ["e_6"], "missing_utterance": ["e_8"], "missing_roll": ["e_8"], "several_anchors": ["2"], "anchor_without_roll": ["5"], "anchor_without_utterance": ["2"]}
    got = {}
    for r in bad.collect():
        got.setdefault(r.rule, []).append(r.id)
    assert {k: sorted(v) for k, v in got.items()} == want and set(want) == set(tl.EVENT_RULES)
    assert {r.rule: r.n for r in qa.observed_counts(bad, "rule", tl.EVENT_RULES).collect()} == {k: len(v) for k, v in want.items()}


def test_encounters(spark):
    rolls = spark.createDataFrame([(1, i, i, float(i), w, k, 5 + 2 * (w == "B"), t) for i, (w, k, t) in enumerate([("A", "initiative", None), ("A", "attack", None), ("B", "damage", "x"), ("A", "damage", "x")])], "session_id long, roll_id long, seq long, t_s double, who string, kind string, total long, target string")
    none = spark.createDataFrame([], "session_id long, seq long, t_s double, names array<string>"), spark.createDataFrame([], "name string, actor string")
    got = {r.roll_id: (r.round, r.turn, r.entry) for r in en.rounds_and_turns(en.rolls_with_order(rolls.withColumn("actor", F.col("who")), *none)).collect()}
    assert got == {0: (1, 1, "A"), 1: (1, 1, "A"), 2: (1, 2, "B"), 3: (2, 1, "A")}
    assert {(r.side, r.name): r.damage for r in en.damage_sums(rolls).collect()} == {("actor", "A"): 5, ("actor", "B"): 7, ("target", "x"): 12}
    checks = spark.createDataFrame([(1, i, float(t), "p", "s", "the relic") for i, t in enumerate((3, 22, 200))], "session_id long, roll_id long, t_s double, who string, skill string, subject string")
    assert [(r.group_no, r.attempt) for r in en.attempt_groups(checks).orderBy("roll_id").collect()] == [(1, 1), (1, 2), (2, 1)]
    assert value(spark, en.verdict_of(F.lit("You succeed"))) == "success" and value(spark, en.skill_of(F.lit("skill: Persuasion"))) == "persuasion"


def test_rounds_follow_the_order_in_force(spark):
    """Leavers are released, come back with a fresh turn, names stand for actors, and what has no turn has its reason; sessions don't mix."""
    rolls = [("B", "attack"), ("Ann", "attack"), ("B", "attack"), ("X", "attack"), (None, "attack"), ("B", "attack"), ("Ann", "attack"), ("B", "initiative"), ("B", "attack")]
    rows = [(s, i, float(i), i, w, None if w is None else {"Ann": "a", "B": "b"}.get(w, "x"), k) for s in (1, 2) for i, (w, k) in enumerate(rolls)]
    orders = [(1, 0, 0.5, ["A", "B"]), (1, 1, 4.5, ["A"]), (1, 2, 4.6, ["B", "A"]), (1, 3, 5.5, ["A"]), (1, 4, 6.5, ["B", "A"])]
    df = spark.createDataFrame(rows, "session_id long, roll_id long, t_s double, seq long, who string, actor string, kind string")
    placed = en.rounds_and_turns(en.rolls_with_order(df.repartition(4), spark.createDataFrame(orders, "session_id long, seq long, t_s double, names array<string>"), spark.createDataFrame([("A", "a")], "name string, actor string")))
    got = {(r.session_id, r.roll_id): (r.round, r.turn, r.entry) if r.reason is None else r.reason for r in placed.collect()}
    absent, unresolved = "actor is absent from initiative order", "actor could not be resolved"
    # between rolls 5 and 7 B has left the order, so its next roll opens no round, but the second of Ann does
    assert [got[1, i] for i in range(9)] == ["no initiative order was available", (1, 1, "A"), (1, 2, "B"), absent, unresolved, (2, 1, "B"), (2, 2, "A"), (2, 1, "B"), (2, 1, "B")]
    # without orders the rolls from the first initiative on count, in order of first appearance
    assert {i: x for (s, i), x in got.items() if s == 2} == {7: (1, 1, "B"), 8: (1, 1, "B")}
    assert {(r.roll_id, r.reason) for r in en.unassigned(placed).where("session_id = 1").collect()} == {(0, "no initiative order was available"), (3, absent), (4, unresolved)}


def test_quality_entries(spark):
    tracks = spark.createDataFrame([(1, "t", None, 0.001, False)], "session_id long, track_id string, player_id string, speech_ratio double, aligned boolean")
    sessions = spark.createDataFrame([(1, True, "wallclock")], "session_id long, has_capture boolean, basis string")
    none = spark.createDataFrame([], "session_id long, code string")
    found = qa.intake_rules(tracks, sessions, none)
    assert sorted(r.code for r in found.collect()) == ["TRACK_DURATION_MISMATCH", "TRACK_SILENT", "TRACK_UNMAPPED"]
    counts = qa.severity_counts(qa.with_catalog(found, qa.catalog(spark))).first()
    assert (counts.error, counts.warning, counts.exit_code) == (1, 2, 2)


def test_ledger_upserts_are_idempotent(spark):
    flags = spark.createDataFrame([(1, "a", "X", None, "open"), (1, "a", "Y", None, "resolved")], "session_id long, stage string, code string, utterance_id string, state string")
    new = spark.createDataFrame([(1, "a", "Z", None), (1, "a", "Y", None)], "session_id long, stage string, code string, utterance_id string")
    once = lg.refresh_flags(flags, new)
    assert {(r.code, r.state) for r in once.collect()} == {("Y", "resolved"), ("Z", "open")}
    twice = lg.refresh_flags(once.withColumnRenamed("utt", "utterance_id"), new)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))
    inputs = spark.createDataFrame([(1, "p", "s"), (2, "p", None)], "k long, path string, sha string")
    metas = lg.input_digest(inputs, ["k"]).withColumn("version", F.lit(1)).withColumn("status", F.lit("ok"))
    metas, none = metas.withColumn("params_hash", F.lit(None).cast("string")), spark.createDataFrame([], "k long, name string, value string")
    assert lg.stale(inputs, metas, 1, ["k"], none, inputs).isEmpty() and lg.stale(inputs, metas, 2, ["k"], none, inputs).count() == 2


def test_capture_formulas(spark):
    assert value(spark, cp.dice_sides(F.lit("2d6+d8"))) == [6, 6, 8] and value(spark, cp.modifier_sum(F.lit("2d6 + 3 - 1d4 - 1"))) == 2
    assert cp.markup_text("<p>a &lt;b&gt;</p><script>x</script>c&#33;&#x41;&bogus;") == "a <b> c!A&bogus;"
    assert value(spark, cp.name_mentions(F.lit("The Goblin met Ann Lee and the goblin, the Goblin"), F.lit("x"), F.lit(None).cast("string"))) == ["Goblin", "Ann Lee"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], UTT)
    for out in (tr.overlap_ids(none), tr.bleed_components(tr.bleed_edges(none)), tl.gaps(none), tr.validate_segments(none)):
        assert out.count() == 0
