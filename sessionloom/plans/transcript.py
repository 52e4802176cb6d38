"""Queries on timed speech and energy frames, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import comparison_text, text_similarity
from ..operators import frames as fr
from ..operators import transcript as tr
from . import adapters as ad

Q, S = {}, {}
UTT, TWO, WORDS, FRAMES = ad.UTTERANCES, ad.TWO_TRACKS, ad.WORDS, ad.FRAMES


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


@query("tr01_validate_segments", """SELECT event_id AS utt_id, value AS start_s, value + (event_id % 5) - 1 AS end_s, greatest(value - 50, 0) AS energy, value >= 0 AND value + (event_id % 5) - 1 > value AS valid FROM events""")
def _(spark, sf):
    segments = ad.table(spark, sf, "events").selectExpr("event_id AS utt_id", "value AS start_s", "value + (event_id % 5) - 1 AS end_s", "value - 50 AS energy")
    return tr.validate_segments(segments)


@query("tr02_canonical_words", f"""WITH {WORDS} SELECT session_id, utt_id, row_number() OVER (PARTITION BY utt_id ORDER BY s, e, t) - 1 AS pos, t, s, e FROM (SELECT session_id, utt_id, round(s, 3) AS s, round(CASE WHEN pos % 11 = 10 THEN s - 1 ELSE e END, 3) AS e, trim(t) AS t FROM words) WHERE t <> '' AND e >= s""")
def _(spark, sf):
    listed = ad.words(spark, sf).selectExpr("session_id", "utt_id", "struct(t, s, CASE WHEN pos % 11 = 10 THEN s - 1 ELSE e END AS e) AS w").groupBy("session_id", "utt_id").agg(F.collect_list("w").alias("words"))
    out = listed.select("session_id", "utt_id", F.posexplode(tr.canonical_words(F.col("words"))).alias("pos", "w"))
    return out.select("session_id", "utt_id", F.col("pos").cast("long").alias("pos"), "w.t", "w.s", "w.e")


VAD = """vad AS (SELECT session_id, track_id, source_index * 2 + k AS idx, start_s + k * (end_s - start_s) * 0.5 AS start_s, start_s + (k + 1) * (end_s - start_s) * 0.5 - 0.05 AS end_s, energy + k * 0.25 AS mean_rms FROM utterances, (SELECT unnest([0, 1]) AS k))"""


def _vad(spark, sf):
    return ad.utterances(spark, sf).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).selectExpr("session_id", "track_id", "source_index * 2 + k AS idx", "start_s + k * (end_s - start_s) * 0.5D AS start_s", "start_s + (k + 1) * (end_s - start_s) * 0.5D - 0.05D AS end_s", "energy + k * 0.25D AS mean_rms")


@query("tr03_attach_energy", f"""WITH {UTT}, {VAD} SELECT u.session_id, u.utt_id, coalesce((SELECT arg_max(v.mean_rms, {{'o': round(least(u.end_s, v.end_s) - greatest(u.start_s, v.start_s), 9), 'i': -v.idx}}) FROM vad v WHERE v.session_id = u.session_id AND v.track_id = u.track_id AND v.start_s < u.end_s AND u.start_s < v.end_s), 0) AS energy FROM (SELECT * REPLACE (start_s - 1.3 AS start_s, end_s - 1.3 AS end_s) FROM utterances) u""")
def _(spark, sf):
    u = ad.utterances(spark, sf).withColumn("start_s", F.col("start_s") - 1.3).withColumn("end_s", F.col("end_s") - 1.3)
    return tr.attach_energy(u, _vad(spark, sf)).select("session_id", "utt_id", "energy")


@query("tr04_split_at_gaps", f"""WITH {WORDS}, flagged AS (SELECT *, CASE WHEN s - lag(e) OVER w > 0.75 THEN 1 ELSE 0 END AS new FROM words WINDOW w AS (PARTITION BY session_id, utt_id ORDER BY s, e, pos)), parts AS (SELECT *, sum(new) OVER (PARTITION BY session_id, utt_id ORDER BY s, e, pos) AS part FROM flagged) SELECT session_id, utt_id, part::BIGINT AS part, min(s) AS start_s, max(e) AS end_s, count(*) AS n_words, string_agg(t, ' ' ORDER BY s, e, pos) AS text FROM parts GROUP BY 1, 2, 3""")
def _(spark, sf):
    return tr.split_at_gaps(ad.words(spark, sf))


@query("tr05_ordered_ids", f"""WITH {TWO} SELECT session_id, utt_id, printf('u%06d', row_number() OVER (PARTITION BY session_id ORDER BY start_s, track_id, end_s, text, source_index)) AS id FROM two_tracks""")
def _(spark, sf):
    return tr.ordered_ids(ad.two_tracks(spark, sf)).select("session_id", "utt_id", "id")


@query("tr06_overlaps", f"""WITH {TWO} SELECT a.session_id, a.utt_id, coalesce((SELECT string_agg(b.utt_id, ',' ORDER BY b.utt_id) FROM two_tracks b WHERE b.session_id = a.session_id AND b.track_id <> a.track_id AND least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s) > 0.2), '') AS overlap_ids FROM two_tracks a""")
def _(spark, sf):
    return tr.overlap_ids(ad.two_tracks(spark, sf)).select("session_id", "utt_id", F.array_join("overlap_ids", ",").alias("overlap_ids"))


@query("tr07_comparison_text", f"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[\\p{{P}}\\p{{S}}]+', ' ', 'g'), '\\s+', ' ', 'g')) AS cmp FROM conversations""")
def _(spark, sf):
    return ad.table(spark, sf, "conversations").select("conv_id", "turn", comparison_text(F.col("text")).alias("cmp"))


SIMILAR = """CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN 1 ELSE greatest(len(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(b, ' '))))::DOUBLE / len(list_distinct(string_split(a, ' ') || string_split(b, ' '))), 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b))) END"""
CMP = "trim(regexp_replace(regexp_replace(lower(text), '[\\p{P}\\p{S}]+', ' ', 'g'), '\\s+', ' ', 'g'))"

#: DuckDB's edit distance counts bytes, so letters of two bytes become one sign in both.
ASCII = f"regexp_replace({CMP}, '[^ -~]', '?', 'g')"


@query("tr08_text_similarity", f"""WITH t AS (SELECT conv_id, turn, {ASCII} AS a, lead({ASCII}) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) SELECT conv_id, turn, round({SIMILAR}, 6) AS similarity FROM t WHERE b IS NOT NULL""")
def _(spark, sf):
    from pyspark.sql import Window as W

    t = ad.table(spark, sf, "conversations").withColumn("a", F.regexp_replace(comparison_text(F.col("text")), "[^ -~]", "?")).withColumn("b", F.lead("a").over(W.partitionBy("conv_id").orderBy("turn")))
    return t.where("b IS NOT NULL").select("conv_id", "turn", F.round(text_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


EDGES = f"""{TWO}, c AS (SELECT *, {CMP} AS cmp FROM two_tracks), pairs AS (SELECT x.session_id, x.utt_id AS a_utt_id, y.utt_id AS b_utt_id, x.track_id AS a_track_id, y.track_id AS b_track_id, x.energy AS a_energy, y.energy AS b_energy, x.source_index AS a_source_index, y.source_index AS b_source_index, x.cmp AS a, y.cmp AS b
 FROM c x JOIN c y ON x.session_id = y.session_id AND x.utt_id < y.utt_id AND x.track_id <> y.track_id AND abs(x.start_s - y.start_s) <= 0.75), edges AS (SELECT * FROM pairs WHERE {SIMILAR} >= 0.85)"""


@query("tr09_bleed_edges", f"""WITH {EDGES} SELECT session_id, a_utt_id, b_utt_id FROM edges""")
def _(spark, sf):
    return tr.bleed_edges(ad.two_tracks(spark, sf)).select("session_id", "a_utt_id", "b_utt_id")


GROUPS = f"""{EDGES}, both_ways AS MATERIALIZED (SELECT session_id, a_utt_id AS a, b_utt_id AS b FROM edges UNION SELECT session_id, b_utt_id, a_utt_id FROM edges),
reached AS (SELECT session_id, a AS u, a AS v FROM both_ways UNION SELECT r.session_id, r.u, e.b FROM reached r JOIN both_ways e ON e.session_id = r.session_id AND e.a = r.v), comp AS (SELECT session_id, u AS utt_id, min(v) AS component FROM reached GROUP BY 1, 2)"""


@query("tr10_bleed_components", f"WITH RECURSIVE {GROUPS} SELECT * FROM comp")
def _(spark, sf):
    return tr.bleed_components(tr.bleed_edges(ad.two_tracks(spark, sf)))


@query("tr11_bleed_primary", f"WITH RECURSIVE {GROUPS}, r AS (SELECT session_id, utt_id, component, first_value(utt_id) OVER (PARTITION BY session_id, component ORDER BY round(energy, 12) DESC, track_id, source_index) AS f FROM two_tracks JOIN comp USING (session_id, utt_id)) SELECT session_id, utt_id, component, CASE WHEN f <> utt_id THEN f END AS bleed_of FROM r")
def _(spark, sf):
    two = ad.two_tracks(spark, sf)
    return tr.bleed_primary(two, tr.bleed_components(tr.bleed_edges(two)))


@query("tr12_bleed_warnings", f"""WITH {EDGES} SELECT session_id, least(a_track_id, b_track_id) AS track_a, greatest(a_track_id, b_track_id) AS track_b, arg_max(CASE WHEN round(a_energy, 12) > round(b_energy, 12) OR (round(a_energy, 12) = round(b_energy, 12) AND a_track_id < b_track_id) THEN a_utt_id ELSE b_utt_id END, {{'a': a_source_index, 'b': b_source_index}}) AS primary, count(*) AS n_edges FROM edges GROUP BY 1, 2, 3""")
def _(spark, sf):
    return tr.bleed_warnings(tr.bleed_edges(ad.two_tracks(spark, sf)))


BACK = f"(end_s - start_s) <= 1.5 AND {CMP} IN (" + ", ".join(f"'{w}'" for w in tr.BACKCHANNELS) + ")"


@query("tr13_backchannel", f"""WITH {UTT} SELECT session_id, utt_id, {BACK} AS is_backchannel FROM utterances""")
def _(spark, sf):
    return ad.utterances(spark, sf).select("session_id", "utt_id", tr.is_backchannel(F.col("text"), F.col("end_s") - F.col("start_s")).alias("is_backchannel"))


@query("tr14_speech_seconds", f"""WITH {UTT} SELECT session_id, player_id, round(sum(CASE WHEN source_index % 3 = 0 THEN 0 ELSE end_ms - start_ms END) / 1000.0, 3)::DOUBLE AS speech_s FROM utterances GROUP BY 1, 2""")
def _(spark, sf):
    u = ad.utterances(spark, sf)
    return tr.speech_seconds(u, u.where("source_index % 3 <> 0"))


@query("tr15_monotone_words", f"""WITH {WORDS}, w AS (SELECT session_id, utt_id AS segment, pos, t, CAST(round(s * 1000) AS BIGINT) - 400 * (pos % 3) AS s_ms, CAST(round(e * 1000) AS BIGINT) AS e_ms FROM words), m AS (SELECT *, max(e_ms) OVER (PARTITION BY session_id ORDER BY segment, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM w) SELECT session_id, segment, pos, t, greatest(s_ms, coalesce(prior, 0)) AS s_ms, e_ms FROM m WHERE e_ms > greatest(s_ms, coalesce(prior, 0))""")
def _(spark, sf):
    w = ad.words(spark, sf).selectExpr("session_id", "utt_id AS segment", "pos", "t", "CAST(round(s * 1000) AS BIGINT) - 400 * (pos % 3) AS s_ms", "CAST(round(e * 1000) AS BIGINT) AS e_ms")
    return tr.monotone_words(w)


@query("tr16_rebase_words", f"""WITH {WORDS}, w AS (SELECT session_id, utt_id AS window_id, pos, t, 300 * pos - 150 AS s_ms, 300 * pos + 100 AS e_ms FROM words), win AS (SELECT session_id, utt_id AS window_id, start_ms AS w_start_ms, start_ms + 9000 AS w_end_ms FROM utterances) SELECT session_id, window_id, pos, t, greatest(w_start_ms + s_ms, w_start_ms) AS s_ms, greatest(least(w_start_ms + e_ms, w_end_ms), greatest(w_start_ms + s_ms, w_start_ms) + 1) AS e_ms FROM w JOIN win USING (session_id, window_id) WHERE w_start_ms + s_ms < w_end_ms AND w_start_ms + e_ms > w_start_ms""")
def _(spark, sf):
    w = ad.words(spark, sf).selectExpr("session_id", "utt_id AS window_id", "pos", "t", "300 * pos - 150 AS s_ms", "300 * pos + 100 AS e_ms")
    return tr.rebase_words(w, ad.utterances(spark, sf).selectExpr("session_id", "utt_id AS window_id", "start_ms AS w_start_ms", "start_ms + 9000 AS w_end_ms"))


DB = f"{FRAMES}, db AS (SELECT *, round(20 * log10(rms), 6) AS db FROM frames)"
RATIO = f"""{DB}, ranked AS (SELECT track_id, db, row_number() OVER (PARTITION BY track_id ORDER BY db) - 1 AS r, count(*) OVER (PARTITION BY track_id) AS n FROM db), fl AS (SELECT track_id, db AS floor_db, greatest(-55.0, least(-35.0, db + 12.0))::DOUBLE AS threshold FROM ranked WHERE r = floor(n * 0.1)), ratio AS (SELECT track_id, floor_db, threshold, round(avg(CASE WHEN db > threshold THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS ratio FROM db JOIN fl USING (track_id) GROUP BY 1, 2, 3)"""


@query("fr01_speech_ratio", f"WITH {RATIO} SELECT * FROM ratio")
def _(spark, sf):
    return fr.speech_ratio(ad.frames(spark, sf))


@query("fr02_silent_tracks", f"WITH {RATIO} SELECT * FROM ratio WHERE ratio < 0.005")
def _(spark, sf):
    return fr.silent_tracks(fr.speech_ratio(ad.frames(spark, sf)))


ADAPT = f"""{DB}, th AS (SELECT track_id, quantile_cont(db, 0.1) AS p10, quantile_cont(db, 0.5) AS p50, quantile_cont(db, 0.9) AS p90 FROM db GROUP BY 1), ath AS (SELECT *, greatest(-55.0, least(-35.0, least(p10, -60.0) + 12.0))::DOUBLE AS threshold FROM th),
mask AS (SELECT d.track_id, d.frame_ix, d.rms, (p90 - p10 <= 3 AND p50 >= -55.0) OR d.db >= threshold AS voiced FROM db d JOIN ath USING (track_id))"""


@query("fr03_adaptive_threshold", f"WITH {ADAPT} SELECT track_id, round(p10, 6) AS p10, round(p50, 6) AS p50, round(p90, 6) AS p90, round(threshold, 6) AS threshold FROM ath")
def _(spark, sf):
    return fr.adaptive_threshold(ad.frames(spark, sf)).select("track_id", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p90", "threshold")])


@query("fr04_voiced_mask", f"WITH {ADAPT} SELECT track_id, count(*) AS frames, count(*) FILTER (voiced) AS voiced, sum(CASE WHEN voiced THEN frame_ix ELSE 0 END)::BIGINT AS ix_sum FROM mask GROUP BY 1")
def _(spark, sf):
    return fr.voiced_mask(ad.frames(spark, sf)).groupBy("track_id").agg(F.count("*").alias("frames"), F.count_if("voiced").alias("voiced"), F.sum(F.when(F.col("voiced"), F.col("frame_ix")).otherwise(0)).alias("ix_sum"))


RUNS = f"""{ADAPT}, r0 AS (SELECT *, CASE WHEN lag(voiced) OVER w = voiced THEN 0 ELSE 1 END AS new FROM mask WINDOW w AS (PARTITION BY track_id ORDER BY frame_ix)), r1 AS (SELECT *, sum(new) OVER (PARTITION BY track_id ORDER BY frame_ix) AS run FROM r0), runs AS (SELECT track_id, run::BIGINT AS run, bool_or(voiced) AS voiced, min(frame_ix) AS first_ix, max(frame_ix) AS last_ix, count(*) AS n FROM r1 GROUP BY 1, 2),
s0 AS (SELECT *, voiced OR (lag(run) OVER w IS NOT NULL AND lead(run) OVER w IS NOT NULL AND n < 3) AS v2 FROM runs WINDOW w AS (PARTITION BY track_id ORDER BY run)), s1 AS (SELECT *, CASE WHEN lag(v2) OVER (PARTITION BY track_id ORDER BY run) = v2 THEN 0 ELSE 1 END AS new FROM s0), s2 AS (SELECT *, sum(new) OVER (PARTITION BY track_id ORDER BY run) AS run2 FROM s1),
shaped AS (SELECT track_id, first_ix, last_ix, n FROM (SELECT track_id, run2, bool_or(v2) AS v, min(first_ix) AS first_ix, max(last_ix) AS last_ix, sum(n)::BIGINT AS n FROM s2 GROUP BY 1, 2) WHERE v AND n >= 2),
dur AS (SELECT track_id, (max(frame_ix) + 1) * 0.02::DOUBLE - 0.01 AS duration_s FROM frames GROUP BY 1),
iv AS (SELECT track_id, round(first_ix * 0.02::DOUBLE, 6) AS start_s, round(least((last_ix + 1) * 0.02::DOUBLE, duration_s), 6) AS end_s FROM shaped JOIN dur USING (track_id))"""


@query("fr05_runs", f"WITH {RUNS} SELECT * FROM runs")
def _(spark, sf):
    return fr.runs(fr.voiced_mask(ad.frames(spark, sf)))


def _shaped(spark, sf):
    return fr.shaped_runs(fr.voiced_mask(ad.frames(spark, sf)))


def _intervals(spark, sf):
    durations = ad.frames(spark, sf).groupBy("track_id").agg(((F.max("frame_ix") + 1) * 0.02 - 0.01).alias("duration_s"))
    return fr.run_intervals(_shaped(spark, sf), durations)


@query("fr06_shaped_runs", f"WITH {RUNS} SELECT * FROM shaped")
def _(spark, sf):
    return _shaped(spark, sf)


@query("fr07_intervals", f"WITH {RUNS} SELECT * FROM iv")
def _(spark, sf):
    return _intervals(spark, sf)


SEGS = f"""{RUNS}, wide AS (SELECT track_id, round(greatest(start_s - 0.06, 0.0), 6) AS start_s, round(end_s + 0.06, 6) AS end_s FROM iv WHERE round(end_s - start_s, 6) >= 0.04),
i0 AS (SELECT *, max(end_s) OVER (PARTITION BY track_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cov FROM wide), i1 AS (SELECT *, sum(CASE WHEN cov IS NULL OR start_s > cov THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM i0),
merged AS (SELECT track_id, island, min(start_s) AS a, max(end_s) AS b FROM i1 GROUP BY 1, 2), cutn AS (SELECT *, CASE WHEN round(b - a, 6) <= 0.5 THEN 1 ELSE ceil(round((round(b - a, 6) - 0.1) / 0.4, 6)) END::BIGINT AS n FROM merged), cutk AS (SELECT *, unnest(range(0, n)) AS k FROM cutn),
segs AS (SELECT track_id, round(a + k * 0.4, 6) AS start_s, round(least(round(a + k * 0.4, 6) + 0.5, b), 6) AS end_s FROM cutk)"""


@query("fr08_padded_segments", f"WITH {SEGS} SELECT * FROM segs")
def _(spark, sf):
    return fr.padded_segments(_intervals(spark, sf))


@query("fr09_union_length", f"""WITH {UTT}, iv AS (SELECT session_id AS track_id, start_s - (source_index % 3) * 2 AS start_s, end_s FROM utterances), i0 AS (SELECT *, max(end_s) OVER (PARTITION BY track_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cov FROM iv), i1 AS (SELECT *, sum(CASE WHEN cov IS NULL OR start_s > cov THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM i0) SELECT track_id, round(sum(s), 6) AS covered_s FROM (SELECT track_id, island, max(end_s) - min(start_s) AS s FROM i1 GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf):
    return fr.union_length(ad.utterances(spark, sf).selectExpr("session_id AS track_id", "start_s - (source_index % 3) * 2 AS start_s", "end_s"))


@query("fr10_interval_energy", f"""WITH {RUNS} SELECT i.track_id, i.start_s, i.end_s, round(avg(f.rms), 6) AS mean_rms FROM iv i JOIN frames f ON f.track_id = i.track_id AND f.frame_ix BETWEEN floor(round(i.start_s / 0.02, 6)) AND greatest(ceil(round(i.end_s / 0.02, 6)) - 1, floor(round(i.start_s / 0.02, 6))) GROUP BY 1, 2, 3""")
def _(spark, sf):
    return fr.interval_energy(_intervals(spark, sf), ad.frames(spark, sf))


@query("fr11_duration_outliers", """WITH s AS (SELECT o_custkey, quantile_cont(o_totalprice, 0.5) AS median_s, max(o_totalprice) AS recording_s FROM orders GROUP BY 1) SELECT o_custkey AS session_id, o_orderkey AS track_id, o_totalprice AS duration_s, round(median_s, 6) AS median_s, recording_s, abs(o_totalprice - median_s) <= 20000 AS aligned FROM orders JOIN s USING (o_custkey)""")
def _(spark, sf):
    tracks = ad.table(spark, sf, "orders").selectExpr("o_custkey AS session_id", "o_orderkey AS track_id", "o_totalprice AS duration_s")
    return fr.duration_outliers(tracks, 20000.0).withColumn("median_s", F.round("median_s", 6))
