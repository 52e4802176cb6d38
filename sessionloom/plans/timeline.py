"""Queries on events, beats, encounters and checks, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import timeline as tl
from ..operators.quality import observed_counts
from ..operators.transcript import is_backchannel
from ..session import materialise
from . import adapters as ad
from .transcript import BACK

Q, S = {}, {}
TERMS = ["thing", "that", "tion", "the"]


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


def _turns(rolls):
    """SQL of the turn orders that stand in a table of rolls."""
    return f"""turn0 AS (SELECT session_id, seq, t_s, CASE WHEN k % 2 = 0 THEN k % 5 + 1 ELSE 0 END AS n_entries FROM {rolls} WHERE kind = 'initiative'),
turn1 AS (SELECT *, coalesce(lag(n_entries > 0) OVER (PARTITION BY session_id ORDER BY seq), false) AS was FROM turn0),
turnorder AS (SELECT session_id, seq, t_s, n_entries, CASE WHEN n_entries > 0 AND NOT was THEN 'started' WHEN n_entries = 0 AND was THEN 'ended' ELSE 'changed' END AS marker FROM turn1)"""


# Speech, rolls and turn orders of this module: silences before every second turn, a narrator, some telling words; two sessions in three are without fights.
BASE = f"""{ad.UTTERANCES}, {ad.ROLLS},
utt2 AS (SELECT * REPLACE (start_s + 10 * (source_index // 2) AS start_s, end_s + 10 * (source_index // 2) AS end_s, replace(utt_id, ':', '-') AS utt_id, CASE WHEN source_index % 4 = 2 THEN 'system' ELSE player_id END AS player_id,
  text || CASE (session_id + source_index) % 8 WHEN 0 THEN ' Previously' WHEN 1 THEN ' we plan' ELSE '' END AS text) FROM utterances),
rolls2 AS (SELECT * REPLACE (CASE WHEN session_id % 3 = 0 THEN kind WHEN kind = 'check' THEN kind ELSE 'other' END AS kind) FROM rolls),
{_turns('rolls2')},
anchors AS (SELECT r.session_id, r.roll_id, u.utt_id AS matched_utt_id, (r.roll_id % 13)::DOUBLE AS uncertainty_s, CASE WHEN u.utt_id IS NOT NULL OR r.roll_id % 5 = 0 THEN 'matched' ELSE 'interpolated' END AS anchor FROM rolls2 r LEFT JOIN utt2 u ON r.roll_id % 3 = 0 AND u.session_id = r.session_id AND u.source_index = r.seq % 5 WHERE r.roll_id % 11 <> 0),
latest AS (SELECT session_id, max(t) AS t FROM (SELECT session_id, end_s AS t FROM utt2 UNION ALL SELECT session_id, t_s FROM anchors JOIN rolls2 USING (session_id, roll_id)) GROUP BY 1),
bounds AS (SELECT session_id, 0.0::DOUBLE AS start_s, greatest(t, CASE WHEN session_id % 3 = 1 THEN 500.0 + session_id ELSE t END)::DOUBLE AS end_s FROM latest),
gap0 AS (SELECT session_id, coalesce(max(end_s) OVER (PARTITION BY session_id ORDER BY start_s, end_s, utt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS t_start_s, start_s AS t_end_s FROM utt2),
gaps AS (SELECT * FROM (SELECT session_id, t_start_s, t_end_s FROM gap0 UNION ALL SELECT session_id, coalesce(e, 0.0), end_s FROM bounds LEFT JOIN (SELECT session_id, max(end_s) AS e FROM utt2 GROUP BY 1) USING (session_id)) WHERE t_end_s - t_start_s > 2.0)"""
LINKS = f"""{BASE},
alone AS (SELECT r.*, CASE WHEN a.anchor = 'matched' THEN 1.0 ELSE greatest(0.0, 1 - a.uncertainty_s / 10) END::DOUBLE AS confidence FROM rolls2 r JOIN anchors a USING (session_id, roll_id) WHERE a.matched_utt_id IS NULL),
linked AS (SELECT a.session_id, a.matched_utt_id AS utt_id, list({{'roll_id': r.roll_id, 'kind': r.kind}} ORDER BY r.seq, r.roll_id) AS rolls FROM anchors a JOIN rolls2 r USING (session_id, roll_id) WHERE a.matched_utt_id IS NOT NULL GROUP BY 1, 2),
spoken AS (SELECT u.session_id, u.utt_id, u.player_id, u.text, u.start_s, u.end_s, a.mode, a.character_id, greatest(0.0, least(1.0, coalesce(a.confidence, 1.0))) AS confidence, upper(u.player_id) AS speaker_display, r_name AS character_display, coalesce(r_name IS NOT NULL, false) AS is_npc, u.player_id = 'system' AS is_dm, coalesce(l.rolls, []) AS rolls
  FROM utt2 u LEFT JOIN (SELECT session_id, utt_id, CASE WHEN player_id = 'system' THEN 'narration' WHEN length(text) % 7 = 0 THEN 'out_of_character' WHEN length(text) % 13 = 0 THEN 'non_speech' ELSE 'in_character' END AS mode, CASE length(text) % 4 WHEN 0 THEN 'npc' || (length(text) % 3) WHEN 1 THEN 'pc' || (length(text) % 5) END AS character_id, (length(text) % 130) / 100.0::DOUBLE AS confidence FROM utt2 WHERE source_index % 7 <> 6) a USING (session_id, utt_id) LEFT JOIN linked l USING (session_id, utt_id) LEFT JOIN region ON 'npc' || r_regionkey = a.character_id)"""
CHAT = "SELECT session_id, roll_id AS chat_id, t_s + 0.5 AS t_start_s, CASE WHEN roll_id % 2 = 0 THEN t_s + 1.5 END AS t_end_s, 'we saw that thing ' || roll_id AS text, (roll_id % 150) / 100.0 - 0.1 AS confidence FROM rolls2 WHERE roll_id % 9 = 0"
EVENTS = f"""{LINKS}, chat AS ({CHAT}),
ev0 AS (SELECT session_id, 'e_speech_' || utt_id AS id, 'speech' AS kind, start_s AS t_start_s, end_s AS t_end_s, player_id, character_id, character_display, is_npc, is_dm, confidence, text, mode, rolls, [utt_id] AS utterances FROM spoken
UNION ALL SELECT session_id, 'e_roll_' || roll_id, 'roll', t_s, t_s, who, NULL, NULL, false, false, confidence, NULL, NULL, [{{'roll_id': roll_id, 'kind': kind}}], [] FROM alone
UNION ALL SELECT session_id, 'e_' || k || '_' || seq, k, t_s, t_s, NULL, NULL, NULL, false, false, 1.0, NULL, NULL, [], [] FROM (SELECT *, CASE marker WHEN 'started' THEN 'combat_start' WHEN 'ended' THEN 'combat_end' ELSE 'turnorder' END AS k FROM turnorder)
UNION ALL SELECT session_id, 'e_gap_' || lower(to_base(floor(t_start_s * 1000 + 0.5)::BIGINT, 36)) || '_' || lower(to_base(floor(t_end_s * 1000 + 0.5)::BIGINT, 36)) || '_' || (row_number() OVER (PARTITION BY session_id ORDER BY t_start_s) - 1), 'gap', t_start_s, t_end_s, NULL, NULL, NULL, false, false, 1.0, NULL, NULL, [], [] FROM gaps
UNION ALL SELECT session_id, 'e_session_start', 'session_start', start_s, start_s, NULL, NULL, NULL, false, false, 1.0, NULL, NULL, [], [] FROM bounds
UNION ALL SELECT session_id, 'e_session_end', 'session_end', end_s, end_s, NULL, NULL, NULL, false, false, 1.0, NULL, NULL, [], [] FROM bounds
UNION ALL SELECT session_id, 'e_chat_' || chat_id, 'chat', t_start_s, coalesce(t_end_s, t_start_s), NULL, NULL, NULL, false, false, greatest(0.0, least(1.0, coalesce(confidence, 1.0))), text, NULL, [], [] FROM chat),
ev AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t_start_s, t_end_s, id) AS ord FROM ev0)"""


def _speech(spark, sf):
    u = ad.utterances(spark, sf).withColumn("start_s", F.expr("start_s + 10 * (source_index DIV 2)")).withColumn("end_s", F.expr("end_s + 10 * (source_index DIV 2)"))
    u = u.withColumn("utt_id", F.replace(F.col("utt_id"), F.lit(":"), F.lit("-"))).withColumn("player_id", F.expr("CASE WHEN source_index % 4 = 2 THEN 'system' ELSE player_id END"))
    return u.withColumn("text", F.expr("concat(text, CASE (session_id + source_index) % 8 WHEN 0 THEN ' Previously' WHEN 1 THEN ' we plan' ELSE '' END)"))


def _rolls(spark, sf):
    return ad.rolls(spark, sf).withColumn("kind", F.expr("CASE WHEN session_id % 3 = 0 THEN kind WHEN kind = 'check' THEN kind ELSE 'other' END"))


def _turnorder(rolls):
    t = rolls.where("kind = 'initiative'").selectExpr("session_id", "seq", "t_s", "CASE WHEN k % 2 = 0 THEN k % 5 + 1 ELSE 0 END AS n_entries")
    return tl.combat_markers(t)


class _Tables:
    """Speech, rolls and anchors of all sessions, written once, as most of what a timeline holds is made of them."""

    def __init__(self, spark, sf):
        self.speech, self.rolls = materialise(_speech(spark, sf), "speech"), materialise(_rolls(spark, sf), "rolls")
        # two rolls in three stand alone, some have no anchor at all, and the others belong to one of a session's first speeches, where there is one
        said = self.speech.select("session_id", F.col("source_index").alias("_i"), F.col("utt_id").alias("matched_utt_id"))
        rolls = self.rolls.where("roll_id % 11 <> 0").selectExpr("session_id", "roll_id", "CASE WHEN roll_id % 3 = 0 THEN seq % 5 END AS _i", "CAST(roll_id % 13 AS DOUBLE) AS uncertainty_s")
        kind = F.when(F.col("matched_utt_id").isNotNull() | (F.col("roll_id") % 5 == 0), "matched").otherwise("interpolated")
        self.anchors = materialise(rolls.join(said, ["session_id", "_i"], "left").withColumn("anchor", kind).drop("_i"), "anchors")
        self.regions = ad.table(spark, sf, "region")

    def bounds(self):
        anchored = self.anchors.join(self.rolls, ["session_id", "roll_id"]).select("session_id", F.col("t_s").alias("t_end_s"))
        ends = self.speech.select("session_id", F.col("end_s").alias("t_end_s")).unionByName(anchored)
        durations = ends.select("session_id").distinct().where("session_id % 3 = 1").withColumn("duration_s", F.expr("500.0D + session_id"))
        return tl.session_bounds(ends, durations)

    def turnorder(self):
        return _turnorder(self.rolls)

    def gaps(self):
        return tl.gaps(self.speech, ends=self.bounds())

    def chat(self):
        return self.rolls.where("roll_id % 9 = 0").selectExpr("session_id", "roll_id AS chat_id", "t_s + 0.5D AS t_start_s", "CASE WHEN roll_id % 2 = 0 THEN t_s + 1.5D END AS t_end_s", "concat('we saw that thing ', roll_id) AS text", "(roll_id % 150) / 100.0D - 0.1D AS confidence")

    def attributions(self):
        mode = "CASE WHEN player_id = 'system' THEN 'narration' WHEN length(text) % 7 = 0 THEN 'out_of_character' WHEN length(text) % 13 = 0 THEN 'non_speech' ELSE 'in_character' END AS mode"
        return self.speech.where("source_index % 7 <> 6").selectExpr("session_id", "utt_id", mode, "CASE length(text) % 4 WHEN 0 THEN concat('npc', length(text) % 3) WHEN 1 THEN concat('pc', length(text) % 5) END AS character_id", "(length(text) % 130) / 100.0D AS confidence")

    def speech_events(self):
        players = self.speech.selectExpr("player_id", "upper(player_id) AS display_name", "player_id = 'system' AS is_dm").distinct()
        characters = self.regions.selectExpr("concat('npc', r_regionkey) AS character_id", "r_name AS name", "true AS is_npc")
        return tl.speech_events(self.speech, self.attributions(), players, characters, self.rolls, self.anchors)

    def standalone(self):
        return tl.standalone_rolls(self.rolls, self.anchors)

    def events(self):
        bounds = materialise(self.bounds(), "bounds")
        return tl.event_union(self.speech_events(), self.standalone(), self.turnorder(), tl.gaps(self.speech, ends=bounds), bounds, self.chat())


def _events(spark, sf):
    return _Tables(spark, sf).events()


@query("src18_combat_markers", f"WITH {ad.ROLLS}, {_turns('rolls')} SELECT session_id, seq, n_entries, marker FROM turnorder")
def _(spark, sf):
    """Turn orders of all sessions, those too that have no fights elsewhere in this module."""
    return _turnorder(ad.rolls(spark, sf)).select("session_id", "seq", "n_entries", "marker")


def _ids(rolls):
    return F.array_join(F.transform(rolls, lambda x: F.concat_ws(":", x.roll_id, x.kind)), ",")


IDS = "coalesce(array_to_string([x.roll_id || ':' || x.kind FOR x IN rolls], ','), '')"


@query("ev01_event_union", f"WITH {EVENTS} SELECT session_id, ord, id, kind, t_start_s, t_end_s, player_id, character_id, character_display, is_dm, round(confidence, 6) AS confidence, mode, {IDS} AS rolls, len(utterances) AS n_utterances FROM ev")
def _(spark, sf):
    return _events(spark, sf).select("session_id", "ord", "id", "kind", "t_start_s", "t_end_s", "player_id", "character_id", "character_display", "is_dm", F.round("confidence", 6).alias("confidence"), "mode", _ids(F.col("rolls")).alias("rolls"), F.size("utterances").cast("long").alias("n_utterances"))


@query("ev02_speech_events", f"WITH {LINKS} SELECT session_id, utt_id, mode, character_id, round(confidence, 6) AS confidence, speaker_display, character_display, is_npc, is_dm, {IDS} AS rolls FROM spoken")
def _(spark, sf):
    return _Tables(spark, sf).speech_events().select("session_id", "utt_id", "mode", "character_id", F.round("confidence", 6).alias("confidence"), "speaker_display", "character_display", "is_npc", "is_dm", _ids(F.col("rolls")).alias("rolls"))


@query("ev03_standalone_rolls", f"WITH {LINKS} SELECT session_id, roll_id, who, kind, total, round(confidence, 6) AS confidence FROM alone")
def _(spark, sf):
    return _Tables(spark, sf).standalone().select("session_id", "roll_id", "who", "kind", "total", F.round("confidence", 6).alias("confidence"))


@query("ev04_gaps", f"WITH {BASE} SELECT session_id, round(t_start_s, 6) AS t_start_s, round(t_end_s, 6) AS t_end_s FROM gaps")
def _(spark, sf):
    return _Tables(spark, sf).gaps().select("session_id", F.round("t_start_s", 6).alias("t_start_s"), F.round("t_end_s", 6).alias("t_end_s"))


query("ev05_session_bounds", f"WITH {BASE} SELECT session_id, start_s, end_s FROM bounds")(lambda spark, sf: _Tables(spark, sf).bounds())

# each rule is broken by some rows
BROKEN = f"""{EVENTS},
x AS (SELECT * REPLACE (CASE WHEN ord % 17 = 0 THEN 'e_1' WHEN ord % 19 = 0 THEN 's:' || id ELSE id END AS id, CASE WHEN ord % 13 = 0 THEN t_start_s - 1 ELSE t_end_s END AS t_end_s, CASE WHEN ord % 23 = 0 THEN 1.5 WHEN ord % 29 = 0 THEN NULL WHEN ord % 31 = 0 THEN 'nan'::DOUBLE ELSE confidence END AS confidence) FROM ev),
y AS (SELECT *, count(*) OVER (PARTITION BY session_id, id) AS n, lag(row(t_start_s, t_end_s, id)) OVER (PARTITION BY session_id ORDER BY ord) AS b FROM x),
said AS (SELECT session_id, utt_id FROM utt2 WHERE source_index <> 1), rolled AS (SELECT session_id, roll_id FROM rolls2 WHERE roll_id % 10 <> 7),
tied AS (SELECT session_id, roll_id, matched_utt_id FROM anchors UNION ALL SELECT session_id, roll_id, NULL FROM anchors WHERE roll_id % 40 = 1),
bad AS (SELECT session_id, 'duplicate_id' AS rule, id FROM y WHERE n > 1 UNION ALL SELECT session_id, 'bad_id', id FROM y WHERE NOT regexp_matches(id, '^e[A-Za-z0-9_-]+$') UNION ALL SELECT session_id, 'negative_length', id FROM y WHERE t_end_s < t_start_s UNION ALL SELECT session_id, 'out_of_order', id FROM y WHERE b >= row(t_start_s, t_end_s, id)
UNION ALL SELECT session_id, 'bad_confidence', id FROM y WHERE confidence IS NULL OR isnan(confidence) OR confidence < 0 OR confidence > 1
UNION ALL SELECT session_id, 'missing_utterance', id FROM (SELECT session_id, id, unnest(utterances) AS utt_id FROM x) ANTI JOIN said USING (session_id, utt_id) UNION ALL SELECT session_id, 'missing_roll', id FROM (SELECT session_id, id, unnest([r.roll_id FOR r IN rolls]) AS roll_id FROM x) ANTI JOIN rolled USING (session_id, roll_id)
UNION ALL SELECT session_id, 'several_anchors', roll_id::VARCHAR FROM tied GROUP BY session_id, roll_id HAVING count(*) > 1 UNION ALL SELECT session_id, 'anchor_without_roll', roll_id::VARCHAR FROM tied ANTI JOIN rolled USING (session_id, roll_id)
UNION ALL SELECT session_id, 'anchor_without_utterance', roll_id::VARCHAR FROM (SELECT session_id, roll_id, matched_utt_id AS utt_id FROM tied WHERE matched_utt_id IS NOT NULL) ANTI JOIN said USING (session_id, utt_id))"""


def _broken(spark, sf):
    made = _Tables(spark, sf)
    x = made.events().withColumn("id", F.expr("CASE WHEN ord % 17 = 0 THEN 'e_1' WHEN ord % 19 = 0 THEN concat('s:', id) ELSE id END")).withColumn("t_end_s", F.expr("CASE WHEN ord % 13 = 0 THEN t_start_s - 1 ELSE t_end_s END"))
    x = x.withColumn("confidence", F.expr("CASE WHEN ord % 23 = 0 THEN 1.5D WHEN ord % 29 = 0 THEN NULL WHEN ord % 31 = 0 THEN double('NaN') ELSE confidence END"))
    again = made.anchors.where("roll_id % 40 = 1").withColumn("matched_utt_id", F.lit(None).cast("string"))
    return tl.timeline_violations(materialise(x, "events"), made.speech.where("source_index <> 1"), made.rolls.where("roll_id % 10 <> 7"), made.anchors.unionByName(again))


query("ev06_violations", f"WITH {BROKEN} SELECT * FROM bad")(lambda spark, sf: _broken(spark, sf))


@query("ev06_violation_counters", f"WITH {BROKEN} SELECT rule, count(*) AS n FROM bad GROUP BY rule")
def _(spark, sf):
    """Counters that the pass which writes the violations has gathered."""
    return observed_counts(_broken(spark, sf), "rule", tl.EVENT_RULES)


@query("ev07_window_lookup", f"WITH {EVENTS} SELECT session_id, ord, id FROM ev WHERE t_end_s >= 60 + session_id AND t_start_s <= 120 + session_id")
def _(spark, sf):
    return tl.in_window(_events(spark, sf), 60 + F.col("session_id"), 120 + F.col("session_id")).select("session_id", "ord", "id")


@query("ev07_rolls_in_window", f"WITH {EVENTS} SELECT session_id, ord, id, kind FROM ev WHERE t_end_s >= 60 + session_id AND t_start_s <= 120 + session_id AND len(rolls) > 0")
def _(spark, sf):
    return tl.rolls_in_window(_events(spark, sf), 60 + F.col("session_id"), 120 + F.col("session_id")).select("session_id", "ord", "id", "kind")


@query("ev07_events_for_character", f"WITH {EVENTS} SELECT session_id, ord, id, character_id FROM ev WHERE character_id = 'npc' || (session_id % 3)")
def _(spark, sf):
    wanted = ad.table(spark, sf, "conversations").selectExpr("conv_id AS session_id", "concat('npc', conv_id % 3) AS character_id")
    return tl.events_for(_events(spark, sf), wanted).select("session_id", "ord", "id", "character_id")


FRESH = " OR ".join(f"(contains(said, '{t}') AND NOT contains(prior, '{t}'))" for t in TERMS)
JD = lambda a, b: f"CASE WHEN len(list_distinct({a} || {b})) = 0 THEN 0.0 ELSE 1 - len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct({a} || {b})) END"
SET = lambda c, w: f"coalesce(list_filter(list_distinct(list({c}) OVER {w}), lambda x: x IS NOT NULL), [])"
RUN = "list_reduce([{'run': x, 'top': 0.0::DOUBLE} FOR x IN ns], lambda s, x: {'run': greatest(0.0, s.run + abs(x.run - mean) - 0.1), 'top': greatest(s.top, s.run + abs(x.run - mean) - 0.1)}, {'run': 0.0::DOUBLE, 'top': 0.0::DOUBLE}).top"
SIGNALS = f"""{EVENTS}, f0 AS (SELECT *, lag(kind) OVER w AS bk, lag(t_end_s - t_start_s) OVER w AS bd, len(rolls)::DOUBLE AS n, lower(trim(coalesce(text, ''))) AS said, CASE WHEN is_npc THEN character_id END AS npc FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY ord)),
f1 AS (SELECT *, avg(n) OVER l AS mean, list(n) OVER r AS ns, coalesce(string_agg(said, ' ') OVER l, '') AS prior, {SET('player_id', 'l')} AS lp, {SET('player_id', 'r')} AS rp, {SET('npc', 'l')} AS ln, {SET('npc', 'r')} AS rn, bk = 'gap' AND bd >= 8 AS quiet
 FROM f0 WINDOW l AS (PARTITION BY session_id ORDER BY ord ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY session_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
sig AS (SELECT session_id, ord, t_start_s, CASE WHEN quiet THEN least(2.0, bd / 8) * 5 ELSE 0.0 END AS silence, CASE WHEN kind IN ('combat_start', 'combat_end') THEN 8.0 ELSE 0.0 END AS turnorder,
 CASE WHEN mean IS NULL THEN 0.0 ELSE least(1.0, {RUN} / len(ns)) * 3 END AS density, ({JD('lp', 'rp')}) * 3 AS speakers, ({JD('ln', 'rn')}) * 3 AS characters, CASE WHEN {FRESH} THEN 2.0 ELSE 0.0 END AS glossary, CASE WHEN quiet AND is_dm AND mode = 'narration' THEN 4.0 ELSE 0.0 END AS narration FROM f1),
scored AS MATERIALIZED (SELECT *, round(silence + turnorder + density + speakers + characters + glossary + narration, 6) AS score FROM sig)"""


def _scored(spark, sf):
    return tl.boundary_signals(_events(spark, sf), TERMS)


for _name, _col in (("bt01_silence", "silence"), ("bt02_turnorder", "turnorder"), ("bt03_density", "density"), ("bt04_speakers", "speakers"), ("bt05_characters", "characters"), ("bt06_glossary", "glossary"), ("bt07_narration", "narration")):
    query(_name, f"WITH {SIGNALS} SELECT session_id, ord, round({_col}, 6)::DOUBLE AS {_col} FROM scored")(lambda spark, sf, c=_col: _scored(spark, sf).select("session_id", "ord", F.round(c, 6).alias(c)))


@query("bt08_candidates", f"WITH {SIGNALS} SELECT session_id, ord, score, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, ord) AS rank, concat_ws(',', CASE WHEN silence > 0 THEN 'silence' END, CASE WHEN turnorder > 0 THEN 'turnorder' END, CASE WHEN density > 0 THEN 'density' END, CASE WHEN speakers > 0 THEN 'speakers' END, CASE WHEN characters > 0 THEN 'characters' END, CASE WHEN glossary > 0 THEN 'glossary' END, CASE WHEN narration > 0 THEN 'narration' END) AS signals FROM scored WHERE score > 0 AND ord > 1")
def _(spark, sf):
    return tl.boundary_candidates(_scored(spark, sf)).select("session_id", "ord", "score", "rank", F.array_join("signals", ",").alias("signals"))


def _cuts(spark, sf):
    """(events, peaks, cuts) of all sessions; the events are written once, as all three read them."""
    events = materialise(_events(spark, sf), "events")
    bounds = tl.session_bounds(events, events.select("session_id", F.lit(0.0).alias("duration_s")).distinct())
    peaks = materialise(tl.pick_peaks(tl.boundary_candidates(tl.boundary_signals(events, TERMS)), bounds), "peaks")
    return events, peaks, tl.merge_short(events, peaks, 40.0)


# both folds as recursion: over the candidates of a session by rank, and over its spans in order
PEAKS = f"""{SIGNALS}, bnd AS MATERIALIZED (SELECT session_id, max(t_end_s) AS end_s FROM ev GROUP BY 1),
cand AS MATERIALIZED (SELECT session_id, ord, t_start_s AS t, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, ord) AS rank, t_start_s >= 30 AND end_s - t_start_s >= 30 AS inside FROM scored JOIN bnd USING (session_id) WHERE score > 0 AND ord > 1),
picks AS (SELECT session_id, 0::BIGINT AS k, []::DOUBLE[] AS ts, []::BIGINT[] AS os FROM bnd UNION ALL
  SELECT p.session_id, p.k + 1, CASE WHEN c.inside AND NOT coalesce(list_bool_or([abs(x - c.t) < 30 FOR x IN p.ts]), false) THEN list_append(p.ts, c.t) ELSE p.ts END, CASE WHEN c.inside AND NOT coalesce(list_bool_or([abs(x - c.t) < 30 FOR x IN p.ts]), false) THEN list_append(p.os, c.ord) ELSE p.os END FROM picks p JOIN cand c ON c.session_id = p.session_id AND c.rank = p.k + 1),
peaks AS MATERIALIZED (SELECT session_id, unnest(o) AS ord FROM (SELECT session_id, arg_max(os, k) AS o FROM picks GROUP BY 1))"""
CUTS = f"""{PEAKS},
spans0 AS (SELECT e.*, 1 + coalesce(sum(CASE WHEN c.ord IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY e.session_id ORDER BY e.ord), 0)::BIGINT AS n FROM ev e LEFT JOIN peaks c ON e.session_id = c.session_id AND e.ord = c.ord),
spans AS MATERIALIZED (SELECT session_id, n, min(ord) AS ord, arg_min(t_start_s, ord) AS t0, arg_max(t_end_s, ord) AS t1, arg_min(kind IN ('session_start', 'combat_start'), ord) AS opens FROM spans0 GROUP BY 1, 2),
fold AS (SELECT session_id, 0::BIGINT AS k, NULL::BIGINT AS w_ord, NULL::DOUBLE AS w_t0, NULL::BOOLEAN AS w_opens, []::BIGINT[] AS os FROM bnd UNION ALL
  SELECT session_id, k + 1, CASE WHEN short AND (o_opens OR len(os) = 0) THEN o_ord END, CASE WHEN short AND (o_opens OR len(os) = 0) THEN o_t0 END, CASE WHEN short AND (o_opens OR len(os) = 0) THEN o_opens END, CASE WHEN short THEN os ELSE list_append(os, o_ord) END
  FROM (SELECT f.session_id, f.k, f.os, coalesce(f.w_ord, s.ord) AS o_ord, coalesce(f.w_t0, s.t0) AS o_t0, coalesce(f.w_opens, s.opens) AS o_opens, s.t1 - coalesce(f.w_t0, s.t0) < 40 AS short FROM fold f JOIN spans s ON s.session_id = f.session_id AND s.n = f.k + 1)),
cuts AS MATERIALIZED (SELECT session_id, unnest(o[2:]) AS ord FROM (SELECT session_id, arg_max(os, k) AS o FROM fold GROUP BY 1)),
assigned AS MATERIALIZED (SELECT e.*, 1 + coalesce(sum(CASE WHEN c.ord IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY e.session_id ORDER BY e.ord), 0)::BIGINT AS beat FROM ev e LEFT JOIN cuts c ON e.session_id = c.session_id AND e.ord = c.ord)"""

query("bt09_pick_peaks", f"WITH RECURSIVE {PEAKS} SELECT session_id, ord, t_start_s FROM peaks JOIN ev USING (session_id, ord)")(lambda spark, sf: _cuts(spark, sf)[1])
query("bt10_merge_short", f"WITH RECURSIVE {CUTS} SELECT session_id, ord, t_start_s FROM cuts JOIN ev USING (session_id, ord)")(lambda spark, sf: _cuts(spark, sf)[2])


def _assigned(spark, sf):
    events, _, cuts = _cuts(spark, sf)
    return materialise(tl.assign_beats(events, cuts), "assigned")


@query("bt11_assign_beats", f"WITH RECURSIVE {CUTS} SELECT session_id, ord, id, beat FROM assigned")
def _(spark, sf):
    return _assigned(spark, sf).select("session_id", "ord", "id", "beat")


PLACE = ", ".join(f"CASE WHEN bool_or(contains(both_said, '{t}')) THEN '{t}' END" for t in TERMS)
BEATS = f"""{CUTS}, told AS (SELECT *, concat_ws(' ', lag(said) OVER (PARTITION BY session_id, beat ORDER BY ord), said) AS both_said, greatest(0.0, t_end_s - t_start_s) AS air FROM (SELECT *, lower(trim(coalesce(text, ''))) AS said FROM assigned)),
voices AS (SELECT session_id, beat, list(character_id ORDER BY s DESC, character_id) AS dominant, list(character_id ORDER BY character_id) AS participants FROM (SELECT session_id, beat, character_id, round(sum(air), 9) AS s FROM told WHERE kind = 'speech' AND character_id IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
shown AS (SELECT session_id, beat, string_agg(character_display, ' + ' ORDER BY character_display) AS names FROM (SELECT DISTINCT session_id, beat, character_display FROM told WHERE character_display <> '' QUALIFY dense_rank() OVER (PARTITION BY session_id, beat ORDER BY character_display) <= 2) GROUP BY 1, 2),
b0 AS (SELECT session_id, beat, min(t_start_s) AS t_start_s, arg_max(t_end_s, ord) AS t_end_s, count(*) AS n_events, bool_or(kind IN ('combat_start', 'combat_end', 'turnorder') OR len([r FOR r IN rolls IF r.kind IN ('attack', 'damage', 'initiative', 'save', 'death_save')]) > 0) AS combat,
 bool_or(regexp_matches(both_said, '{tl.RECAP}')) AS recap, bool_or(regexp_matches(both_said, '{tl.TABLE}')) OR bool_or(kind = 'speech' AND coalesce(mode, '') IN ('out_of_character', 'non_speech')) AS tab, bool_or(regexp_matches(both_said, '{tl.PLAN}')) AS plan,
 count(*) FILTER (kind = 'speech') AS speeches, sum(CASE WHEN kind = 'speech' AND mode = 'in_character' THEN air ELSE 0.0 END) AS i, sum(CASE WHEN kind = 'speech' THEN air ELSE 0.0 END) AS a, coalesce({PLACE}) AS place,
 {', '.join(f"sum(len([r FOR r IN rolls IF r.kind = '{k}']))::BIGINT AS n_{k}" for k in tl.KINDS)} FROM told GROUP BY session_id, beat),
b1 AS (SELECT b0.*, coalesce(participants, []) AS participants, coalesce(dominant, []) AS dominant, names, CASE WHEN combat THEN 'combat' WHEN recap THEN 'recap' WHEN tab THEN 'table' WHEN plan THEN 'planning' WHEN speeches > 1 AND len(coalesce(dominant, [])) > 1 THEN 'social' ELSE 'exploration' END AS kind FROM b0 LEFT JOIN voices USING (session_id, beat) LEFT JOIN shown USING (session_id, beat)),
b2 AS (SELECT *, kind || ': ' || coalesce(place, names, 'segment ' || beat) AS base FROM b1), beats AS (SELECT *, row_number() OVER (PARTITION BY session_id, base ORDER BY beat) AS nth FROM b2)"""


def _beats(spark, sf):
    return tl.beats(_assigned(spark, sf), TERMS)


@query("bt12_classes", f"WITH RECURSIVE {BEATS} SELECT session_id, beat, kind, n_events FROM beats")
def _(spark, sf):
    return _beats(spark, sf).select("session_id", "beat", "kind", "n_events")


@query("bt13_roll_counts", f"WITH RECURSIVE {BEATS} SELECT session_id, beat, {', '.join('n_' + k for k in tl.KINDS)} FROM beats")
def _(spark, sf):
    return _beats(spark, sf).select("session_id", "beat", *[f"n_{k}" for k in tl.KINDS])


@query("bt14_speech_measures", f"WITH RECURSIVE {BEATS} SELECT session_id, beat, round(CASE WHEN a > 0 THEN i / a ELSE 0.0 END, 6) AS ratio, array_to_string(participants, ',') AS participants, array_to_string(dominant, ',') AS dominant FROM beats")
def _(spark, sf):
    return _beats(spark, sf).select("session_id", "beat", "ratio", F.array_join("participants", ",").alias("participants"), F.array_join("dominant", ",").alias("dominant"))


@query("bt15_titles", f"WITH RECURSIVE {BEATS} SELECT session_id, beat, CASE WHEN nth = 1 THEN base ELSE base || ' (' || nth || ')' END AS title FROM beats")
def _(spark, sf):
    return _beats(spark, sf).select("session_id", "beat", "title")


@query("bt16_segmentation_metrics", f"WITH RECURSIVE {BEATS}, truth AS (SELECT session_id, beat, CASE WHEN beat % 3 = 0 THEN 'social' ELSE kind END AS kind, t_start_s + (beat % 2) * 2 AS t_start_s, t_end_s FROM beats WHERE beat % 5 <> 4) SELECT session_id, round(abs(count(b.kind) - count(t.kind)) / greatest(count(t.kind), 1), 6)::DOUBLE AS count_error, round(sum(CASE WHEN b.kind = t.kind THEN 1.0 ELSE 0.0 END) / greatest(count(t.kind), 1), 6)::DOUBLE AS class_accuracy, round(sum(CASE WHEN abs(b.t_start_s - t.t_start_s) <= 1.0 AND abs(b.t_end_s - t.t_end_s) <= 1.0 THEN 1.0 ELSE 0.0 END) / greatest(count(t.kind), 1), 6)::DOUBLE AS boundary_accuracy FROM beats b FULL JOIN truth t USING (session_id, beat) GROUP BY session_id")
def _(spark, sf):
    b = _beats(spark, sf)
    truth = b.where("beat % 5 <> 4").withColumn("kind", F.expr("CASE WHEN beat % 3 = 0 THEN 'social' ELSE kind END")).withColumn("t_start_s", F.expr("t_start_s + (beat % 2) * 2"))
    return tl.segmentation_metrics(b, truth)


REPORT = f"""{BASE}, sec AS (SELECT session_id, player_id, round(sum(end_ms - start_ms) / 1000.0, 3)::DOUBLE AS speech_s, count(*) AS n_utterances, count(*) FILTER ({BACK}) AS n_backchannels, count(*) FILTER (player_id <> coalesce(was, '')) AS n_turns FROM (SELECT *, lag(player_id) OVER (PARTITION BY session_id ORDER BY start_s, utt_id) AS was FROM utt2) GROUP BY 1, 2), gp AS (SELECT session_id, count(*) AS n_gaps, round(max(t_end_s - t_start_s), 6) AS longest_gap_s FROM gaps GROUP BY 1)"""


@query("speaking_report", f"WITH {REPORT} SELECT sec.*, coalesce(n_gaps, 0) AS n_gaps, coalesce(longest_gap_s, 0) AS longest_gap_s FROM sec LEFT JOIN gp USING (session_id)")
def _(spark, sf):
    """Speech, backchannels, changes of speaker and silences of each session and player."""
    made = _Tables(spark, sf)
    u = made.speech
    was = F.lag("player_id").over(W.partitionBy("session_id").orderBy("start_s", "utt_id"))
    said = u.withColumn("_was", was).groupBy("session_id", "player_id").agg(
        F.round(F.sum(F.col("end_ms") - F.col("start_ms")) / 1000.0, 3).alias("speech_s"), F.count("*").alias("n_utterances"),
        F.count_if(is_backchannel(F.col("text"), F.col("end_s") - F.col("start_s"))).alias("n_backchannels"), F.count_if(F.col("player_id") != F.coalesce("_was", F.lit(""))).alias("n_turns"),
    )
    quiet = made.gaps().groupBy("session_id").agg(F.count("*").alias("n_gaps"), F.round(F.max(F.col("t_end_s") - F.col("t_start_s")), 6).alias("longest_gap_s"))
    return said.join(quiet, "session_id", "left").na.fill(0, ["n_gaps", "longest_gap_s"])
