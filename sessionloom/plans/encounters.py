"""Queries on encounters and checks, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encounters as en
from . import adapters as ad

Q, S = {}, {}
TERMS = ["thing", "that", "tion", "the"]


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


R, U = ad.ROLLS, ad.UTTERANCES
BOTH = f"{R}, {U}"


def _rolls(spark, sf):
    return ad.rolls(spark, sf)


@query("en01_roll_occurrences", f"WITH {R} SELECT session_id, roll_id, CASE WHEN who IN ('p0', 'p1') THEN 'ch_' || who ELSE who END AS actor, count(*) OVER (PARTITION BY session_id, roll_id) AS n_seen FROM rolls")
def _(spark, sf):
    names = _rolls(spark, sf).where("who IN ('p0', 'p1')").select("who", F.concat(F.lit("ch_"), "who").alias("actor_id")).distinct()
    return en.roll_occurrences(_rolls(spark, sf), names).select("session_id", "roll_id", "actor", "n_seen")


@query("en02_targets", f"""WITH {R} SELECT session_id, roll_id, nullif(regexp_extract(CASE WHEN target IS NULL THEN 'roll ' || kind ELSE 'rolls against: ' || target END, '{en.TARGET}', 1), '') AS found FROM rolls""")
def _(spark, sf):
    ref = F.when(F.col("target").isNull(), F.concat(F.lit("roll "), "kind")).otherwise(F.concat(F.lit("rolls against: "), "target"))
    return _rolls(spark, sf).select("session_id", "roll_id", en.target_of(ref).alias("found"))


@query("en03_order_at_roll", f"WITH {R}, t AS (SELECT session_id, seq, t_s, CASE WHEN k % 2 = 0 THEN k % 5 + 1 ELSE 0 END AS n_entries FROM rolls WHERE kind = 'initiative') SELECT r.session_id, r.roll_id, coalesce((SELECT arg_max(t.n_entries, {{'t': t.t_s, 's': t.seq}}) FROM t WHERE t.session_id = r.session_id AND t.t_s <= r.t_s), -1) AS n_entries FROM rolls r")
def _(spark, sf):
    t = _rolls(spark, sf).where("kind = 'initiative'").selectExpr("session_id", "seq", "t_s", "CASE WHEN k % 2 = 0 THEN k % 5 + 1 ELSE 0 END AS n_entries")
    return en.order_at_roll(_rolls(spark, sf), t).select("session_id", "roll_id", F.coalesce("n_entries", F.lit(-1)).alias("n_entries"))


SCOPE = f"""{R}, g0 AS (SELECT *, CASE WHEN t_s - lag(t_s) OVER w > 14 THEN 1 ELSE 0 END AS gap FROM rolls WINDOW w AS (PARTITION BY session_id ORDER BY t_s, seq)), g1 AS (SELECT *, sum(gap) OVER (PARTITION BY session_id ORDER BY t_s, seq ROWS UNBOUNDED PRECEDING) AS isle FROM g0),
fi AS (SELECT session_id, coalesce(arg_min(isle, {{'t': t_s, 's': seq}}) FILTER (kind = 'initiative'), min(isle)) AS isle, coalesce(min({{'t': t_s, 's': seq}}) FILTER (kind = 'initiative'), min({{'t': t_s, 's': seq}})) AS f FROM g1 GROUP BY 1), sc AS (SELECT g1.* FROM g1 JOIN fi ON g1.session_id = fi.session_id AND g1.isle = fi.isle AND {{'t': g1.t_s, 's': g1.seq}} >= fi.f),
seen AS (SELECT session_id, who, min({{'t': t_s, 's': seq}}) AS f FROM sc GROUP BY 1, 2), place AS (SELECT session_id, who, row_number() OVER (PARTITION BY session_id ORDER BY f) AS place FROM seen)"""


@query("en04_trackerless_scope", f"WITH {SCOPE} SELECT session_id, roll_id, place FROM sc JOIN place USING (session_id, who)")
def _(spark, sf):
    return en.trackerless_scope(_rolls(spark, sf), 14.0).select("session_id", "roll_id", "place")


# Orders come from initiative rolls, in three sessions of four; one name stands for an actor; some actors aren't resolved.
ACTED = f"""{SCOPE.replace('> 14', '> 20')}, oc AS (SELECT *, CASE WHEN who = 'p3' AND roll_id % 5 = 0 THEN NULL ELSE 'ch_' || who END AS actor FROM rolls),
od AS (SELECT session_id, t_s, arg_max([x.n FOR x IN [{{'b': 1, 'n': 'p0'}}, {{'b': 2, 'n': 'Hero'}}, {{'b': 4, 'n': 'p2'}}, {{'b': 8, 'n': 'p3'}}] IF ((k * 7 + 5) // x.b) % 2 = 1], seq) AS names FROM rolls WHERE kind = 'initiative' AND session_id % 4 <> 3 GROUP BY 1, 2),
own AS (SELECT session_id, list(who ORDER BY f) AS names FROM (SELECT session_id, who, min({{'t': t_s, 's': seq}}) AS f FROM rolls GROUP BY 1, 2) GROUP BY 1),
free AS (SELECT session_id FROM oc ANTI JOIN od USING (session_id) GROUP BY 1),
active AS (SELECT oc.*, coalesce(od.names, []) AS names FROM oc ASOF LEFT JOIN od ON oc.session_id = od.session_id AND oc.t_s >= od.t_s WHERE oc.session_id NOT IN (SELECT session_id FROM free)
 UNION ALL SELECT oc.*, own.names FROM oc JOIN free USING (session_id) JOIN own USING (session_id) SEMI JOIN sc USING (session_id, roll_id)),
ro AS MATERIALIZED (SELECT *, list_filter(names, lambda x: x = who OR (x = 'Hero' AND actor = 'ch_p1'))[1] AS entry, row_number() OVER (PARTITION BY session_id ORDER BY t_s, seq, roll_id) AS n FROM active),
tu AS (SELECT session_id, 0::BIGINT AS n, NULL::BIGINT AS roll_id, 1 AS round, []::VARCHAR[] AS acted, []::VARCHAR[] AS names, NULL::VARCHAR AS reason FROM (SELECT DISTINCT session_id FROM ro) UNION ALL
  SELECT session_id, n, roll_id, CASE WHEN opens AND list_contains(acted, entry) THEN round + 1 ELSE round END, CASE WHEN NOT opens THEN acted WHEN list_contains(acted, entry) THEN [entry] ELSE list_append(acted, entry) END, names, reason
  FROM (SELECT *, reason IS NULL AND kind <> 'initiative' AS opens FROM (SELECT t.session_id, r.n, r.roll_id, t.round, r.kind, r.entry, r.names, CASE WHEN r.names <> t.names THEN list_filter(t.acted, lambda x: list_contains(r.names, x)) ELSE t.acted END AS acted,
    CASE WHEN r.actor IS NULL THEN 'actor could not be resolved' WHEN len(r.names) = 0 THEN 'no initiative order was available' WHEN r.entry IS NULL THEN 'actor is absent from initiative order' END AS reason FROM tu t JOIN ro r ON r.session_id = t.session_id AND r.n = t.n + 1))),
placed AS (SELECT tu.session_id, tu.roll_id, CASE WHEN reason IS NULL THEN round END AS round, entry, reason, tu.n, who FROM tu JOIN ro ON tu.session_id = ro.session_id AND tu.n = ro.n),
rounds AS (SELECT session_id, roll_id, round, CASE WHEN round IS NOT NULL THEN dense_rank() OVER (PARTITION BY session_id, round ORDER BY f) END AS turn, CASE WHEN reason IS NULL THEN entry END AS entry, reason FROM (SELECT *, min(n) OVER (PARTITION BY session_id, round, who) AS f FROM placed))"""


def _placed(spark, sf):
    rolls = _rolls(spark, sf).withColumn("actor", F.expr("CASE WHEN who = 'p3' AND roll_id % 5 = 0 THEN NULL ELSE concat('ch_', who) END"))
    names = "transform(filter(array(struct(1 AS b, 'p0' AS n), struct(2 AS b, 'Hero' AS n), struct(4 AS b, 'p2' AS n), struct(8 AS b, 'p3' AS n)), x -> ((k * 7 + 5) DIV x.b) % 2 = 1), x -> x.n) AS names"
    orders = _rolls(spark, sf).where("kind = 'initiative' AND session_id % 4 <> 3").selectExpr("session_id", "seq", "t_s", names)
    actors = spark.createDataFrame([("Hero", "ch_p1")], "name string, actor string")
    return en.rounds_and_turns(en.rolls_with_order(rolls, orders, actors))


query("en05_rounds_and_turns", f"WITH RECURSIVE {ACTED} SELECT session_id, roll_id, round, turn, entry FROM rounds")(lambda spark, sf: _placed(spark, sf).drop("reason"))
query("en06_unassigned", f"WITH RECURSIVE {ACTED} SELECT session_id, roll_id, reason FROM rounds WHERE reason IS NOT NULL")(lambda spark, sf: en.unassigned(_placed(spark, sf)))


@query("en07_damage_sums", f"WITH {R}, h AS (SELECT * FROM rolls WHERE kind = 'damage' AND target IS NOT NULL) SELECT session_id, 'actor' AS side, who AS name, sum(total)::BIGINT AS damage FROM h GROUP BY 1, 3 UNION ALL SELECT session_id, 'target', target, sum(total)::BIGINT FROM h GROUP BY 1, 3")
def _(spark, sf):
    return en.damage_sums(_rolls(spark, sf))


SP = f"{BOTH}, sp AS (SELECT session_id, 'p' || (source_index % 4) AS who, utt_id, (start_ms + end_ms) / 2000.0::DOUBLE AS mid_s FROM utterances)"


@query("en08_narration", f"WITH {SP} SELECT sp.session_id, sp.utt_id, arg_min(r.roll_id, {{'d': round(abs(r.t_s - sp.mid_s), 6), 't': r.t_s, 'r': r.roll_id}}) AS roll_id FROM sp JOIN rolls r ON r.session_id = sp.session_id AND r.who = sp.who AND r.t_s BETWEEN sp.mid_s - 8 AND sp.mid_s + 8 GROUP BY 1, 2")
def _(spark, sf):
    sp = ad.utterances(spark, sf).selectExpr("session_id", "concat('p', source_index % 4) AS who", "utt_id", "(start_ms + end_ms) / 2000.0D AS mid_s")
    return en.attach_narration(sp, _rolls(spark, sf))


@query("en09_notable", f"WITH {R} SELECT session_id, roll_id, die IN (1, 20) AS notable FROM rolls")
def _(spark, sf):
    return _rolls(spark, sf).select("session_id", "roll_id", en.notable(F.col("die")).alias("notable"))


query("en10_encounter_summary", f"WITH RECURSIVE {ACTED}, per AS (SELECT session_id, round, max(turn) AS turns, sum(CASE WHEN kind = 'damage' AND target IS NOT NULL THEN total ELSE 0 END) AS damage FROM ro JOIN rounds USING (session_id, roll_id) WHERE round IS NOT NULL GROUP BY 1, 2) SELECT session_id, count(*) AS n_rounds, sum(turns)::BIGINT AS n_turns, sum(damage)::BIGINT AS damage_total FROM per GROUP BY 1")(lambda spark, sf: en.encounter_summary(_rolls(spark, sf), _placed(spark, sf)).select("session_id", "n_rounds", "n_turns", "damage_total"))


@query("ck01_stated_intent", f"WITH {BOTH}, c AS (SELECT * FROM rolls WHERE kind = 'check') SELECT c.session_id, c.roll_id, coalesce((SELECT CASE WHEN c.t_s - max(u.end_s) <= 12 THEN arg_max(u.utt_id, {{'e': u.end_s, 'u': u.utt_id}}) END FROM utterances u WHERE u.session_id = c.session_id AND u.end_s <= c.t_s), '') AS intent FROM c")
def _(spark, sf):
    c = _rolls(spark, sf).where("kind = 'check'")
    return en.stated_intent(c, ad.utterances(spark, sf)).select("session_id", "roll_id", F.coalesce("intent", F.lit("")).alias("intent"))


RULED = f"{BOTH}, c AS (SELECT * FROM rolls WHERE kind = 'check'), ruled AS (SELECT c.session_id, c.roll_id, c.who, c.t_s, min({{'s': u.start_s, 'u': u.utt_id, 'x': u.text}}) AS b FROM c LEFT JOIN utterances u ON u.session_id = c.session_id AND u.player_id <> 'user' AND u.start_s BETWEEN c.t_s AND c.t_s + 12 GROUP BY 1, 2, 3, 4)"


def _ruled(spark, sf):
    c = _rolls(spark, sf).where("kind = 'check'")
    return en.adjudication(c, ad.utterances(spark, sf).where("player_id <> 'user'"))


@query("ck02_adjudication", f"WITH {RULED} SELECT session_id, roll_id, coalesce(b.u, '') AS ruling FROM ruled")
def _(spark, sf):
    return _ruled(spark, sf).select("session_id", "roll_id", F.coalesce("ruling", F.lit("")).alias("ruling"))


@query("ck03_skills", f"WITH {R} SELECT session_id, roll_id, coalesce(nullif(lower(regexp_extract(CASE roll_id % 3 WHEN 0 THEN 'Skill: Stealth' WHEN 1 THEN 'ability = Wisdom' ELSE 'roll' END, '{en.SKILL}', 1)), ''), 'unknown') AS skill FROM rolls WHERE kind = 'check'")
def _(spark, sf):
    return _rolls(spark, sf).where("kind = 'check'").select("session_id", "roll_id", en.skill_of(F.expr("CASE roll_id % 3 WHEN 0 THEN 'Skill: Stealth' WHEN 1 THEN 'ability = Wisdom' ELSE 'roll' END")).alias("skill"))


SQLQ = lambda p: p.replace("'", "''")


@query("ck04_verdicts", f"WITH {RULED} SELECT session_id, roll_id, CASE WHEN regexp_matches(lower(b.x), '{SQLQ(en.FAILURE)}') THEN 'failure' WHEN regexp_matches(lower(b.x), '{SQLQ(en.SUCCESS)}') THEN 'success' ELSE 'unknown' END AS verdict FROM ruled")
def _(spark, sf):
    return _ruled(spark, sf).select("session_id", "roll_id", en.verdict_of(F.col("ruling_text")).alias("verdict"))


@query("ck05_attempt_groups", f"""WITH {R}, c AS (SELECT *, 'skill' || (roll_id % 2) AS skill, CASE roll_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'the relic' WHEN 2 THEN 'old relic door' WHEN 3 THEN 'a dog' ELSE 'door' END AS subject FROM rolls WHERE kind = 'check'),
l AS (SELECT *, lag(subject) OVER w AS ws, lag(t_s) OVER w AS wt FROM c WINDOW w AS (PARTITION BY session_id, who, skill ORDER BY t_s, roll_id)),
n AS (SELECT *, CASE WHEN coalesce(t_s - wt <= 90 AND (ws = subject OR subject = '' OR ws = '' OR len(list_intersect(list_filter(string_split(ws, ' '), lambda x: length(x) >= 4), list_filter(string_split(subject, ' '), lambda x: length(x) >= 4))) > 0), false) THEN 0 ELSE 1 END AS new FROM l),
g AS (SELECT *, sum(new) OVER (PARTITION BY session_id, who, skill ORDER BY t_s, roll_id ROWS UNBOUNDED PRECEDING) AS g FROM n),
f AS (SELECT *, row_number() OVER (PARTITION BY session_id, who, skill, g ORDER BY t_s, roll_id) AS attempt, min({{'t': t_s, 'r': roll_id}}) OVER (PARTITION BY session_id, who, skill, g) AS first FROM g)
SELECT session_id, roll_id, attempt, dense_rank() OVER (PARTITION BY session_id ORDER BY first) AS group_no FROM f""")
def _(spark, sf):
    c = _rolls(spark, sf).where("kind = 'check'").withColumn("skill", F.expr("concat('skill', roll_id % 2)")).withColumn("subject", F.expr("CASE roll_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'the relic' WHEN 2 THEN 'old relic door' WHEN 3 THEN 'a dog' ELSE 'door' END"))
    return en.attempt_groups(c).select("session_id", "roll_id", "attempt", "group_no")


@query("ck06_topics", f"""WITH {U}, n AS (SELECT session_id, t.term, count(*) FILTER (contains(lower(text), t.term)) AS n FROM utterances, (SELECT unnest({TERMS!r}) AS term) t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, term) AS rk FROM n WHERE n >= 2) SELECT s.session_id, coalesce(term, '') AS topic, coalesce(n, 0) AS n_speeches FROM (SELECT DISTINCT session_id FROM utterances) s LEFT JOIN (SELECT * FROM r WHERE rk = 1) r USING (session_id)""")
def _(spark, sf):
    return en.topics(ad.utterances(spark, sf), TERMS).select("session_id", F.coalesce("topic", F.lit("")).alias("topic"), F.coalesce("n_speeches", F.lit(0)).alias("n_speeches"))


@query("ck07_scene_outcome", f"WITH {U} SELECT session_id, CASE " + " ".join(f"WHEN bool_or(regexp_matches(lower(text), '{SQLQ(p)}')) THEN '{k}'" for k, p in (("refusal", en.REFUSAL), ("agreement", en.AGREEMENT), ("transition", en.TRANSITION))) + " ELSE 'unknown' END AS outcome FROM utterances GROUP BY 1")
def _(spark, sf):
    return en.scene_outcome(ad.utterances(spark, sf))


THREADS = "CASE WHEN source_index % 3 = 0 THEN 'I will guard ' ELSE 'unless ' END"


@query("ck08_open_threads", f"WITH {U}, x AS (SELECT session_id, utt_id, {THREADS} || text AS text FROM utterances), p AS (SELECT session_id, utt_id, 'promise' AS kind, trim(regexp_extract(text, '{SQLQ(en.PROMISE)}', 1), E' \\n\\t') AS phrase FROM x UNION ALL SELECT session_id, utt_id, 'stake', trim(regexp_extract(text, '{SQLQ(en.STAKE)}', 1), E' \\n\\t') FROM x) SELECT * FROM p WHERE phrase <> ''")
def _(spark, sf):
    x = ad.utterances(spark, sf).withColumn("text", F.expr(f"concat({THREADS}, text)"))
    return en.open_threads(x).withColumn("phrase", F.trim("phrase", F.lit(" \n\t")))


@query("ck09_participants", f"WITH {R} SELECT session_id, string_agg(DISTINCT who, ',' ORDER BY who) AS participants, coalesce(string_agg(DISTINCT who, ',' ORDER BY who) FILTER (who IN ('p1', 'p3')), '') AS npcs FROM rolls GROUP BY 1")
def _(spark, sf):
    return en.participants(_rolls(spark, sf).withColumnRenamed("who", "player_id"), ["p1", "p3"])
