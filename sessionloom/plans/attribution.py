"""Queries on attribution and narrator assignment, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution as at
from ..session import ship_package
from . import adapters as ad

Q, S = {}, {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


U, R = ad.UTTERANCES, ad.ROLLS
EV = f"""{U}, {R}, u AS (SELECT session_id, utt_id, source_index, player_id, start_s, end_s, (start_ms + end_ms) / 2000.0::DOUBLE AS mid_s, end_s - start_s AS duration, length(text) % 3 AS n_profiles, CASE WHEN length(text) % 17 = 0 THEN 1 ELSE 0 END AS n_quotes, (source_index % 2)::DOUBLE AS overlap, (source_index % 5 = 0)::INT AS backchannel, text FROM utterances),
anchors AS (SELECT session_id, t_s AS t_audio_s, 0.25 * 2 ** (roll_id % 9) AS uncertainty_s FROM rolls WHERE roll_id % 3 = 0), active AS (SELECT user_id AS session_id, list_sort(list(DISTINCT 'c' || (event_id % 7))) AS ids FROM events WHERE event_id % 4 = 0 GROUP BY 1),
sims AS (SELECT session_id, utt_id, 'c' || k AS character_id, CASE WHEN k = 0 THEN 'table' ELSE 'character' END AS kind, ((length(text) * (k + 3)) % 100) / 100.0::DOUBLE AS similarity FROM utterances, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE k > 0 OR source_index % 6 <> 5),
sc AS (SELECT utt_id, (length(text) % 10) / 5.0::DOUBLE AS lex_ic, (length(text) % 7) / 5.0::DOUBLE AS lex_ooc FROM utterances WHERE source_index % 4 <> 3),
ev AS (SELECT u.*, lex_ic, lex_ooc, table_sim, character_sim, character_sim - table_sim AS margin, coalesce(active.ids, []) AS active_ids, CASE WHEN EXISTS (SELECT 1 FROM anchors r WHERE r.session_id = u.session_id AND abs(r.t_audio_s - u.mid_s) <= r.uncertainty_s + 2) THEN 1.0 ELSE 0.0 END::DOUBLE AS roll_prox FROM u LEFT JOIN active ON active.session_id = u.session_id LEFT JOIN sc USING (utt_id) LEFT JOIN (SELECT utt_id, max(similarity) FILTER (kind = 'table') AS table_sim, max(similarity) FILTER (kind = 'character') AS character_sim FROM sims GROUP BY 1) USING (utt_id)),
scored AS (SELECT *, 1 / (1 + exp(-greatest(-30, least(30, 0.8 * coalesce(lex_ic, 0) - 1.1 * coalesce(lex_ooc, 0) - 0.45 * roll_prox + 0.9 * coalesce(table_sim, 0) + 1.2 * coalesce(character_sim, 0) + 1.1 * coalesce(margin, 0) - 0.15 * overlap - 0.2 * backchannel + 0.05 * least(duration, 20))))) AS score FROM ev),
banded AS (SELECT *, CASE WHEN n_profiles = 0 THEN 'uncertain' WHEN n_quotes > 0 THEN 'narration' WHEN duration < 0.6 THEN 'uncertain' WHEN score >= 0.65 THEN 'in_character' WHEN score <= 0.35 THEN 'out_of_character' ELSE 'uncertain' END AS mode, concat_ws(',', CASE WHEN n_profiles = 0 THEN 'no_profiles' END, CASE WHEN n_quotes > 0 THEN 'quoted' END, CASE WHEN duration < 0.6 THEN 'too_short' END, CASE WHEN score < 0.65 AND score > 0.35 THEN 'uncertain' END) AS flags FROM scored)"""


def _u(spark, sf):
    return ad.utterances(spark, sf).selectExpr("session_id", "utt_id", "source_index", "player_id", "start_s", "end_s", "(start_ms + end_ms) / 2000.0D AS mid_s", "end_s - start_s AS duration", "length(text) % 3 AS n_profiles", "CASE WHEN length(text) % 17 = 0 THEN 1 ELSE 0 END AS n_quotes", "CASE WHEN source_index % 2 = 1 THEN array('x') ELSE array() END AS overlap_ids", "source_index % 5 = 0 AS is_backchannel", "text")


def _sims(spark, sf):
    return ad.utterances(spark, sf).withColumn("k", F.explode(F.array(*map(F.lit, range(4))))).where("k > 0 OR source_index % 6 <> 5").selectExpr("session_id", "utt_id", "concat('c', k) AS character_id", "CASE WHEN k = 0 THEN 'table' ELSE 'character' END AS kind", "((length(text) * (k + 3)) % 100) / 100.0D AS similarity")


def _evidence(spark, sf):
    scores = ad.utterances(spark, sf).where("source_index % 4 <> 3").selectExpr("utt_id", "(length(text) % 10) / 5.0D AS lex_ic", "(length(text) % 7) / 5.0D AS lex_ooc")
    anchors = ad.rolls(spark, sf).where("roll_id % 3 = 0").selectExpr("session_id", "t_s AS t_audio_s", "0.25D * pow(2, roll_id % 9) AS uncertainty_s")
    active = ad.table(spark, sf, "events").where("event_id % 4 = 0").selectExpr("user_id AS session_id", "concat('c', event_id % 7) AS character_id")
    return at.evidence(_u(spark, sf), scores, _sims(spark, sf), anchors, active)


def _scored(spark, sf):
    e = _evidence(spark, sf)
    return e.withColumn("score", at.weighted_score(e.columns))


def _banded(spark, sf):
    return at.banded(_scored(spark, sf)).withColumn("confidence", F.abs(F.col("score") - 0.5) * 2).withColumn("ord", F.col("source_index"))


@query("at01_evidence", f"WITH {EV} SELECT utt_id, round(coalesce(lex_ic, -1), 6) AS lex_ic, round(coalesce(table_sim, -1), 6) AS voice_sim_table, round(coalesce(character_sim, -1), 6) AS voice_sim_character, round(margin, 6) AS voice_margin, roll_prox, overlap, backchannel::DOUBLE AS backchannel, array_to_string(active_ids, ',') AS active FROM ev")
def _(spark, sf):
    e = _evidence(spark, sf)
    return e.select("utt_id", *[F.round(F.coalesce(c, F.lit(-1.0)), 6).alias(c) for c in ("lex_ic", "voice_sim_table", "voice_sim_character")], F.round("voice_margin", 6).alias("voice_margin"), "roll_prox", "overlap", "backchannel", F.array_join("active_character_ids", ",").alias("active"))


@query("at02_score", f"WITH {EV} SELECT utt_id, round(score, 6) AS score FROM scored")
def _(spark, sf):
    return _scored(spark, sf).select("utt_id", F.round("score", 6).alias("score"))


@query("at03_bands", f"WITH {EV} SELECT utt_id, mode, flags FROM banded")
def _(spark, sf):
    return _banded(spark, sf).select("utt_id", "mode", F.array_join("flags", ",").alias("flags"))


NEAR = f"{EV}, n0 AS (SELECT *, row_number() OVER w AS r, lead(similarity) OVER w AS nx FROM sims WHERE kind = 'character' AND (session_id + substr(character_id, 2)::INT) % 4 <> 0 WINDOW w AS (PARTITION BY utt_id ORDER BY similarity DESC, character_id)), near AS (SELECT utt_id, character_id, similarity FROM n0 WHERE r = 1 AND similarity >= 0.5 AND (nx IS NULL OR round(similarity - nx, 9) >= 0.08))"


def _nearest(spark, sf):
    s = _sims(spark, sf).where("kind = 'character'")
    active = s.select("session_id", "character_id").distinct().where("(session_id + CAST(substr(character_id, 2) AS INT)) % 4 <> 0")
    return at.nearest_character(s, active)


@query("at04_nearest_character", f"WITH {NEAR} SELECT * FROM near")
def _(spark, sf):
    return _nearest(spark, sf)


@query("at05_evidence_record", f"WITH {EV} SELECT utt_id, count(*) AS n, max(similarity) AS first, list_sort(list(similarity), 'DESC')[2] AS second, round(max(similarity) - list_sort(list(similarity), 'DESC')[2], 6) AS margin FROM sims GROUP BY 1")
def _(spark, sf):
    return at.evidence_record(_sims(spark, sf))


@query("at06_quote_children", f"WITH {NEAR} SELECT u.utt_id, k AS span, coalesce(character_id, '') AS character_id FROM u CROSS JOIN (SELECT unnest([0, 1]) AS k) LEFT JOIN near ON u.utt_id = near.utt_id WHERE n_quotes > 0")
def _(spark, sf):
    spans = _u(spark, sf).where("n_quotes > 0").select("utt_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("span"))
    return at.quote_children(spans, _nearest(spark, sf)).na.fill("", ["character_id"])


# the rule as recursion, each row seeing the mode that the one before ended with
SMOOTH = f"""{EV}, seq AS MATERIALIZED (SELECT session_id, utt_id, source_index AS ord, mode, abs(score - 0.5) * 2 AS confidence, row_number() OVER w AS n, lead(mode) OVER w AS after FROM banded WINDOW w AS (PARTITION BY session_id ORDER BY source_index, utt_id)),
run AS (SELECT *, mode AS final, false AS smoothed FROM seq WHERE n = 1 UNION ALL
  SELECT s.*, CASE WHEN coalesce(r.final = s.after AND s.mode <> r.final AND s.confidence <= 0.62, false) THEN r.final ELSE s.mode END, coalesce(r.final = s.after AND s.mode <> r.final AND s.confidence <= 0.62, false) FROM run r JOIN seq s ON s.session_id = r.session_id AND s.n = r.n + 1)"""


query("at07_smoothed", f"WITH RECURSIVE {SMOOTH} SELECT session_id, ord, utt_id, final AS mode, round(confidence, 6) AS confidence, smoothed FROM run")(lambda spark, sf: at.smoothed(_banded(spark, sf)).withColumn("confidence", F.round("confidence", 6)))


@query("at08_mode_summary", f"WITH {NEAR} SELECT session_id, count(*) FILTER (mode = 'in_character') AS in_character, count(*) FILTER (mode = 'out_of_character') AS out_of_character, count(*) FILTER (mode = 'narration') AS narration, count(*) FILTER (mode = 'uncertain') AS uncertain, count(*) FILTER (mode = 'in_character' AND character_id IS NULL) AS unknown_character FROM banded LEFT JOIN near USING (utt_id) GROUP BY 1")
def _(spark, sf):
    return at.mode_summary(_banded(spark, sf).join(_nearest(spark, sf), "utt_id", "left"))


TRUTH = "CASE source_index % 3 WHEN 0 THEN 'in_character' WHEN 1 THEN 'out_of_character' ELSE 'uncertain' END"


@query("at09_mode_accuracy", f"WITH {EV} SELECT {TRUTH} AS mode, count(*) AS n, round(avg((mode = {TRUTH})::INT), 6) AS accuracy FROM banded GROUP BY {TRUTH}")
def _(spark, sf):
    return at.mode_accuracy(_banded(spark, sf), _u(spark, sf).selectExpr("utt_id", f"{TRUTH} AS mode"))


@query("at11_flag_entries", f"WITH {EV}, f AS (SELECT session_id, utt_id, unnest(string_split(flags, ',')) AS code FROM banded WHERE flags <> '') SELECT *, CASE WHEN code = 'no_profiles' THEN 'error' ELSE 'info' END AS severity FROM f")
def _(spark, sf):
    return at.flag_entries(_banded(spark, sf))


@query("at12_pending", f"WITH {EV} SELECT utt_id FROM banded WHERE mode = 'uncertain' AND text NOT IN (SELECT text FROM u WHERE source_index = 0)")
def _(spark, sf):
    b = _banded(spark, sf)
    cache = at.pending_adjudications(_u(spark, sf).where("source_index = 0").withColumn("mode", F.lit("uncertain")), spark.createDataFrame([], "key string"), "p", "s")
    return at.pending_adjudications(b, cache, "p", "s").select("utt_id")


ADJ = f"{EV}, ans AS (SELECT utt_id, CASE WHEN source_index % 2 = 0 THEN 'in_character' ELSE 'sung' END AS m, 0.3 AS c FROM u WHERE source_index % 3 <> 0), adj AS (SELECT b.*, CASE WHEN m IS NULL THEN 'none' WHEN m = 'in_character' AND c <= abs(score - 0.5) * 2 THEN 'accepted' ELSE 'rejected' END AS status FROM banded b LEFT JOIN ans USING (utt_id))"


def _adjudicated(spark, sf):
    answers = _u(spark, sf).where("source_index % 3 <> 0").selectExpr("utt_id", "CASE WHEN source_index % 2 = 0 THEN 'in_character' ELSE 'sung' END AS mode", "0.3D AS confidence")
    b = _banded(spark, sf).withColumn("candidates", F.array(F.lit("in_character"), F.lit("out_of_character"))).withColumn("source", F.lit("deterministic"))
    return at.apply_adjudications(b, answers)


@query("at13_apply_adjudications", f"WITH {ADJ} SELECT utt_id, status, CASE WHEN status = 'accepted' THEN 'in_character' ELSE mode END AS mode, CASE WHEN status = 'accepted' THEN 'llm' ELSE 'deterministic' END AS source, concat_ws(',', nullif(flags, ''), CASE WHEN status = 'accepted' THEN 'adjudicated' END) AS flags FROM adj")
def _(spark, sf):
    return _adjudicated(spark, sf).select("utt_id", "status", "mode", "source", F.array_join("flags", ",").alias("flags"))


@query("at14_revert", f"WITH {ADJ} SELECT utt_id, 'deterministic' AS source, CASE WHEN status = 'accepted' THEN 'in_character' ELSE '' END AS overridden_from, flags FROM adj")
def _(spark, sf):
    return at.revert_adjudications(_adjudicated(spark, sf)).select("utt_id", "source", F.coalesce("overridden_from", F.lit("")).alias("overridden_from"), F.array_join("flags", ",").alias("flags"))


@query("at15_review_queue", f"WITH {EV}, q AS (SELECT session_id, utt_id, start_s, split_part(flags, ',', 1) AS flag, round(greatest(0.0, 1 - abs(score - 0.5) * 2) * duration, 6) AS impact FROM banded WHERE flags <> '') SELECT utt_id, flag, round(impact, 4) AS impact, row_number() OVER (PARTITION BY session_id ORDER BY impact DESC, start_s, utt_id) AS place FROM q")
def _(spark, sf):
    return at.review_queue(_banded(spark, sf)).select("utt_id", "flag", F.round("impact", 4).alias("impact"), "place")


@query("at16_apply_reviews", f"WITH {EV}, r AS (SELECT *, source_index % 4 = 1 OR source_index % 6 = 2 AS rev FROM banded) SELECT utt_id, CASE WHEN source_index % 4 = 1 THEN 'narration' WHEN source_index % 6 = 2 THEN 'out_of_character' ELSE mode END AS mode, rev AS reviewed, CASE WHEN rev THEN CASE WHEN contains(flags, 'quoted') THEN 'quoted' ELSE '' END ELSE flags END AS flags FROM r")
def _(spark, sf):
    b = _banded(spark, sf).withColumn("cluster_id", F.concat(F.lit("k"), F.col("source_index") % 6))
    d = _u(spark, sf).where("source_index % 4 = 1").selectExpr("utt_id AS target", "'narration' AS mode").unionByName(_u(spark, sf).where("source_index % 6 = 2").selectExpr("'k2' AS target", "'out_of_character' AS mode").distinct())
    return at.apply_reviews(b, d).select("utt_id", "mode", "reviewed", F.array_join("flags", ",").alias("flags"))


# Narrator assignment.
STOP = ["the", "and", "that"]
NP = f"""{U}, {R}, raw AS (SELECT session_id, utt_id, start_s, regexp_extract_all(text, '(?:^|[^A-Za-z])([A-Z][a-z]{{2,}})', 1) AS l, text FROM utterances), w AS (SELECT session_id, utt_id, start_s, unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS name FROM utterances), names AS (SELECT session_id, utt_id, start_s, name FROM w WHERE regexp_full_match(name, '[A-Z][a-z]{{2,}}') AND lower(name) NOT IN ('the', 'and', 'that'))"""


def _names(spark, sf):
    u = ad.utterances(spark, sf)
    found = u.select("session_id", "utt_id", "start_s", F.explode(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z])([A-Z][a-z]{2,})(?![A-Za-z])"), F.lit(1))).alias("name"))
    return found.where(~F.lower("name").isin(STOP))


@query("np01_narrator_mode", f"WITH {U} SELECT utt_id, CASE WHEN regexp_matches(text, '{at.QUOTE}') OR (regexp_matches(lower(text), '{at.DIRECT}') AND NOT regexp_matches(lower(text), '{at.NARRATION}')) THEN 'voice' ELSE 'narration' END AS mode FROM utterances")
def _(spark, sf):
    return ad.utterances(spark, sf).select("utt_id", at.narrator_mode(F.col("text")).alias("mode"))


@query("np02_discovered_names", f"WITH {NP} SELECT session_id, name, min(start_s) AS first_s FROM names GROUP BY 1, 2")
def _(spark, sf):
    return at.discovered_names(ad.utterances(spark, sf), STOP)


ACT = f"{NP}, act AS (SELECT u.session_id, u.utt_id, u.start_s, u.end_s, u.player_id, (SELECT max({{'t': n.start_s, 'n': n.name}}) FROM names n WHERE n.session_id = u.session_id AND n.start_s <= u.start_s) AS a FROM utterances u), win AS (SELECT session_id, utt_id, a.n AS name, round(8.0 * (1 - (start_s - a.t) / 45.0), 6)::DOUBLE AS evidence FROM act WHERE a IS NOT NULL AND start_s - a.t <= 45)"


def _active(spark, sf):
    return at.active_name(ad.utterances(spark, sf), _names(spark, sf))


@query("np03_active_name", f"WITH {ACT} SELECT utt_id, coalesce(a.n, '') AS name FROM act")
def _(spark, sf):
    return _active(spark, sf).select("utt_id", F.coalesce("name", F.lit("")).alias("name"))


@query("np04_window_evidence", f"WITH {ACT} SELECT session_id, utt_id, name, evidence FROM win")
def _(spark, sf):
    return at.window_evidence(_active(spark, sf))


@query("np05_bank_evidence", f"WITH {U} SELECT session_id, utt_id, 'N' || (source_index % 4) AS name, 3.0::DOUBLE AS evidence FROM utterances WHERE source_index % 4 < 2")
def _(spark, sf):
    u = ad.utterances(spark, sf).withColumn("cluster_id", F.concat(F.lit("v"), F.col("source_index") % 4))
    p = u.where("source_index % 4 < 2").selectExpr("cluster_id", "concat('N', source_index % 4) AS name").distinct()
    return at.bank_evidence(u, p)


RM = f"{NP}, rm AS (SELECT u.session_id, u.utt_id, r.target AS name, count(*) * 2.0::DOUBLE AS evidence FROM utterances u JOIN rolls r ON r.session_id = u.session_id AND r.target IS NOT NULL AND r.t_s BETWEEN u.start_s - 45 AND u.start_s + 45 GROUP BY 1, 2, 3)"


def _roll_mentions(spark, sf):
    return at.roll_mention_evidence(ad.utterances(spark, sf), ad.rolls(spark, sf).where("target IS NOT NULL").selectExpr("session_id", "target AS name", "t_s"))


@query("np06_roll_mentions", f"WITH {RM} SELECT * FROM rm")
def _(spark, sf):
    return _roll_mentions(spark, sf)


@query("np07_address", f"WITH {NP}, p AS (SELECT *, lag(utt_id) OVER w AS pu, lag(player_id) OVER w AS pp, lag(end_s) OVER w AS pe FROM utterances WINDOW w AS (PARTITION BY session_id ORDER BY start_s, utt_id)) SELECT DISTINCT p.session_id, p.utt_id, n.name, 4.0::DOUBLE AS evidence FROM p JOIN names n ON n.session_id = p.session_id AND n.utt_id = p.pu WHERE pp <> player_id AND p.start_s - pe <= 3")
def _(spark, sf):
    return at.address_evidence(ad.utterances(spark, sf), _names(spark, sf))


def _continued(spark, sf):
    ship_package(spark)
    rows = at.window_evidence(_active(spark, sf)).unionByName(_roll_mentions(spark, sf))
    return at.continuity(rows, ad.utterances(spark, sf).withColumn("interrupted", F.col("player_id") == "user"))


# one speech after the other, with the name that led last and when
LED = f"""{ACT}, {RM.removeprefix(NP + ", ")}, found AS (SELECT session_id, utt_id, name, sum(evidence) AS e FROM (SELECT * FROM win UNION ALL SELECT * FROM rm) GROUP BY 1, 2, 3), listed AS (SELECT session_id, utt_id, list({{'n': name, 'e': e}} ORDER BY name) AS l FROM found GROUP BY 1, 2),
said AS MATERIALIZED (SELECT session_id, utt_id, start_s, player_id = 'user' AS cut_in, coalesce(l, []) AS l, row_number() OVER (PARTITION BY session_id ORDER BY start_s, utt_id) AS k FROM utterances LEFT JOIN listed USING (session_id, utt_id)),
led AS (SELECT session_id, 0::BIGINT AS k, NULL::VARCHAR AS utt_id, NULL::VARCHAR AS last, 0.0::DOUBLE AS last_s, (SELECT any_value(l) FROM said) AS total FROM (SELECT DISTINCT session_id FROM said) UNION ALL
  SELECT session_id, k, utt_id, CASE WHEN len(total) > 0 THEN list_sort(list_transform(total, lambda x: {{'s': -x.e, 'n': x.n}}))[1].n ELSE was END, CASE WHEN len(total) > 0 THEN start_s ELSE last_s END, total
  FROM (SELECT *, CASE WHEN bonus IS NULL THEN l WHEN list_contains(list_transform(l, lambda x: x.n), was) THEN list_transform(l, lambda x: {{'n': x.n, 'e': x.e + CASE WHEN x.n = was THEN bonus ELSE 0 END}}) ELSE list_append(l, {{'n': was, 'e': bonus}}) END AS total
    FROM (SELECT s.session_id, s.k, s.utt_id, s.start_s, s.l, p.last_s, CASE WHEN NOT s.cut_in THEN p.last END AS was, CASE WHEN NOT s.cut_in AND p.last IS NOT NULL AND s.start_s - p.last_s <= 45 THEN round(2.0 * (1 - (s.start_s - p.last_s) / 45.0), 6) END AS bonus FROM led p JOIN said s ON s.session_id = p.session_id AND s.k = p.k + 1)))"""

query("np08_continuity", f"WITH RECURSIVE {LED} SELECT session_id, utt_id, t.n AS name, round(t.e, 4) AS total FROM (SELECT session_id, utt_id, unnest(total) AS t FROM led WHERE k > 0)")(lambda spark, sf: _continued(spark, sf).withColumn("total", F.round("total", 4)))


@query("np09_winners", f"WITH {RM}, t AS (SELECT *, row_number() OVER w AS r, coalesce(lead(evidence) OVER w, 0) AS nx FROM rm WINDOW w AS (PARTITION BY session_id, utt_id ORDER BY evidence DESC, name)) SELECT session_id, utt_id, name FROM t WHERE r = 1 AND round(evidence - nx, 6) >= 1.5 AND name <> 'npc2'")
def _(spark, sf):
    known = spark.createDataFrame([("npc0",), ("npc1",)], "name string")
    return at.winners(_roll_mentions(spark, sf).withColumnRenamed("evidence", "total"), known)


@query("np10_proposals", f"WITH {ACT} SELECT 'v' || (source_index % 4) AS cluster_id, name, count(DISTINCT win.utt_id) AS n FROM win JOIN utterances USING (session_id, utt_id) WHERE name <> 'Thing' GROUP BY 1, 2 HAVING count(DISTINCT win.utt_id) >= 2")
def _(spark, sf):
    u = ad.utterances(spark, sf).select("session_id", "utt_id", F.concat(F.lit("v"), F.col("source_index") % 4).alias("cluster_id"))
    return at.proposals(at.window_evidence(_active(spark, sf)), u, spark.createDataFrame([("Thing",)], "name string"))
