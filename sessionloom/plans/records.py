"""Queries on alignment, data quality and the ledger, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..operators import alignment as al
from ..operators import ledger as lg
from ..operators import quality as qa
from ..session import materialise, ship_package
from . import adapters as ad

Q, S = {}, {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


R, U = ad.ROLLS, ad.UTTERANCES
A = al.ID_ALPHABET
ENC = " || ".join(f"substr('{A}', ((t_wall_ms // {64**k}) % 64 + 1)::INT, 1)" for k in range(7, -1, -1))
ENC_SPARK = "concat(" + ", ".join(f"substr('{A}', CAST((t_wall_ms DIV {64**k}L) % 64 + 1 AS INT), 1)" for k in range(7, -1, -1)) + ")"


def _messages(spark, sf):
    m = ad.rolls(spark, sf).withColumn("id", F.expr(f"CASE WHEN roll_id % 97 = 0 THEN 'not-a-push-id' ELSE concat({ENC_SPARK}, 'abc') END"))
    m = m.withColumn("id_ms", al.id_millis(F.col("id")))
    return m.withColumn("t_wall_ms", F.expr("CASE WHEN session_id % 3 = 0 THEN t_wall_ms END"))


MSG = f"{R}, msg AS (SELECT * REPLACE (CASE WHEN session_id % 3 = 0 THEN t_wall_ms END AS t_wall_ms), CASE WHEN roll_id % 97 = 0 THEN NULL ELSE t_wall_ms END AS id_ms FROM rolls), b0 AS (SELECT *, CASE WHEN id_ms < lag(id_ms) OVER (PARTITION BY session_id ORDER BY seq) THEN 1 ELSE 0 END AS back FROM msg), basis AS (SELECT session_id, CASE WHEN max((t_wall_ms IS NOT NULL)::INT) = 1 THEN 'wallclock' WHEN max((id_ms IS NULL)::INT) = 0 AND max(back) = 0 THEN 'messageid' ELSE 'order_only' END AS basis FROM b0 GROUP BY 1), rec AS (SELECT session_id, min(t_wall_ms) + 5000 AS started_ms, 20000000.0 AS duration_s FROM rolls GROUP BY 1), timed AS (SELECT m.*, basis, duration_s, (CASE basis WHEN 'wallclock' THEN t_wall_ms WHEN 'messageid' THEN id_ms END - started_ms) / 1000.0::DOUBLE AS t_audio_s FROM msg m JOIN rec USING (session_id) JOIN basis USING (session_id))"


def _timed(spark, sf):
    rec = ad.rolls(spark, sf).groupBy("session_id").agg((F.min("t_wall_ms") + 5000).alias("started_ms"), F.lit(20000000.0).alias("duration_s"))
    m = _messages(spark, sf)
    return al.recording_time(m, rec, al.basis(m))


@query("al01_id_millis", f"WITH {MSG} SELECT roll_id, coalesce(id_ms, -1) AS id_ms FROM msg")
def _(spark, sf):
    return _messages(spark, sf).select("roll_id", F.coalesce("id_ms", F.lit(-1)).alias("id_ms"))


@query("al02_basis", f"WITH {MSG} SELECT * FROM basis")
def _(spark, sf):
    return al.basis(_messages(spark, sf))


@query("al03_recording_time", f"WITH {MSG} SELECT roll_id, coalesce(t_audio_s, -1e9) AS t_audio_s FROM timed")
def _(spark, sf):
    return _timed(spark, sf).select("roll_id", F.coalesce("t_audio_s", F.lit(-1e9)).alias("t_audio_s"))


@query("al04_clock_issues", f"WITH {MSG}, x AS (SELECT * REPLACE (CASE WHEN roll_id % 53 = 0 THEN t_audio_s - 1e8 ELSE t_audio_s END AS t_audio_s, CASE WHEN roll_id % 31 = 0 THEN id_ms - 100000000 ELSE id_ms END AS id_ms) FROM timed), y AS (SELECT *, id_ms < lag(id_ms) OVER (PARTITION BY session_id ORDER BY seq) AS b FROM x) SELECT session_id, 'CLOCK_STEP_BACK' AS code, count(*) AS n FROM y WHERE b GROUP BY 1 UNION ALL SELECT session_id, 'TIME_OUTSIDE', count(*) FROM y WHERE t_audio_s < -300 OR t_audio_s > duration_s + 300 GROUP BY 1 UNION ALL SELECT session_id, 'ORDER_ONLY', count(*) FROM y WHERE basis = 'order_only' GROUP BY 1")
def _(spark, sf):
    x = _timed(spark, sf).withColumn("t_audio_s", F.expr("CASE WHEN roll_id % 53 = 0 THEN t_audio_s - 1e8D ELSE t_audio_s END")).withColumn("id_ms", F.expr("CASE WHEN roll_id % 31 = 0 THEN id_ms - 100000000 ELSE id_ms END"))
    return al.clock_issues(x)


EXP = f"{R}, m AS (SELECT session_id, seq, t_s + 1 AS t_audio_s, seq AS ord FROM rolls WHERE roll_id % 4 <> 0), r AS (SELECT r.*, m.t_audio_s AS expected_s FROM rolls r LEFT JOIN m USING (session_id, seq) WHERE r.total IS NOT NULL AND r.roll_id % 9 <> 0)"


def _expected(spark, sf):
    rolls = ad.rolls(spark, sf)
    m = rolls.where("roll_id % 4 <> 0").select("session_id", "seq", (F.col("t_s") + 1).alias("t_audio_s"), F.col("seq").alias("ord"))
    return al.expected_times(rolls.withColumn("total", F.expr("CASE WHEN roll_id % 9 <> 0 THEN total END")), m)


@query("al05_expected_times", f"WITH {EXP} SELECT session_id, roll_id, coalesce(expected_s, -1) AS expected_s FROM r")
def _(spark, sf):
    return _expected(spark, sf).select("session_id", "roll_id", F.coalesce("expected_s", F.lit(-1.0)).alias("expected_s"))


NUM = f"{EXP}, num AS (SELECT session_id, source_index AS utt_ord, player_id, (start_ms + end_ms) / 2000.0::DOUBLE AS mid_s, source_index % 2 = 0 AS cue, unnest([source_index * 7 % 40, source_index * 11 % 90]) AS number FROM utterances), spoken AS (SELECT DISTINCT session_id, seq, who, expected_s, total, unnest([total, die]) AS number FROM r), cand AS (SELECT session_id, seq, utt_ord, round(max(CASE WHEN number = total THEN 10 ELSE 8 END) + max(CASE WHEN who = player_id THEN 3 ELSE 0 END) + max(CASE WHEN cue THEN 1 ELSE 0 END) + max(coalesce(greatest(0.0, 2 * (1 - abs(expected_s - mid_s) / 60)), 0.0)), 6) AS score FROM spoken JOIN num USING (session_id, number) GROUP BY 1, 2, 3)"
NUM = f"{U}, {NUM}"


def _candidates(spark, sf):
    n = ad.utterances(spark, sf).selectExpr("session_id", "source_index AS utt_ord", "player_id", "(start_ms + end_ms) / 2000.0D AS mid_s", "source_index % 2 = 0 AS cue", "explode(array(source_index * 7 % 40, source_index * 11 % 90)) AS number")
    return al.candidates(_expected(spark, sf).withColumn("dice", F.array("die")), n)


@query("al06_candidates", f"WITH {NUM} SELECT session_id, seq, utt_ord, score::DOUBLE AS score FROM cand")
def _(spark, sf):
    return _candidates(spark, sf)


@query("al07_align")
def _(spark, sf):
    ship_package(spark)
    return al.align(_candidates(spark, sf))


_PTS = "{R}, pts AS (SELECT session_id, seq, t_s + CASE WHEN roll_id % 23 = 0 THEN 90 ELSE 0 END AS t_s FROM rolls{ONLY}), o AS (SELECT *, round(abs(t_s - (lag(t_s) OVER w + (lead(t_s) OVER w - lag(t_s) OVER w) * (seq - lag(seq) OVER w) / (lead(seq) OVER w - lag(seq) OVER w))), 6) AS off FROM pts WINDOW w AS (PARTITION BY session_id ORDER BY seq)), cut AS (SELECT session_id, greatest(20.0, coalesce(quantile_cont(off, 0.5), 20.0)) AS c FROM o GROUP BY 1), fit AS (SELECT o.session_id, seq, t_s FROM o JOIN cut USING (session_id) WHERE off IS NULL OR off <= c)"
# One roll in five has a match, in most sessions; a few sessions have one or two, or none.
SOME = "roll_id % 5 = 0 AND session_id % 7 <> 6 AND (session_id % 7 <> 5 OR seq <= 8)"
PTS, PTS_ALL = _PTS.replace("{R}", R).replace("{ONLY}", f" WHERE {SOME}"), _PTS.replace("{R}", R).replace("{ONLY}", "")


def _matches(spark, sf, only=SOME):
    return ad.rolls(spark, sf).where(only).selectExpr("session_id", "seq", "t_s + CASE WHEN roll_id % 23 = 0 THEN 90 ELSE 0 END AS t_s")


def _points(spark, sf, only=SOME):
    return al.robust_fit(_matches(spark, sf, only))


def _fits(spark, sf):
    return al.fit_scale(_matches(spark, sf), _points(spark, sf))


@query("al08_robust_fit", f"WITH {PTS_ALL} SELECT * FROM fit")
def _(spark, sf):
    return _points(spark, sf, "true")


FIT = f"""{PTS}, sc0 AS (SELECT session_id, greatest(0.25, coalesce(quantile_cont(off2, 0.5), 0.25)) AS scale FROM (SELECT session_id, abs(t_s - (lag(t_s) OVER w + (lead(t_s) OVER w - lag(t_s) OVER w) * (seq - lag(seq) OVER w) / (lead(seq) OVER w - lag(seq) OVER w))) AS off2 FROM pts WINDOW w AS (PARTITION BY session_id ORDER BY seq)) GROUP BY 1),
sl AS (SELECT session_id, quantile_cont(s, 0.5) AS slope FROM (SELECT session_id, (t_s - lag(t_s) OVER w) / (seq - lag(seq) OVER w) AS s FROM fit WINDOW w AS (PARTITION BY session_id ORDER BY seq)) GROUP BY 1),
fits AS (SELECT session_id, scale, CASE WHEN slope > 0 THEN slope ELSE 1.0 END AS fallback FROM sc0 LEFT JOIN sl USING (session_id)), fn AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS i, count(*) OVER (PARTITION BY session_id) AS n FROM fit)"""
BEYOND = lambda q, n, f: f"greatest(0.0, {n}.t_s + ({q} - {n}.seq) * CASE WHEN {f}.seq IS NULL THEN fallback ELSE greatest(0.0, ({n}.t_s - {f}.t_s) / ({n}.seq - {f}.seq)) END)"
PROJ = f"""{FIT}, ax AS (SELECT r.session_id, r.seq, r.roll_id, r.kind, CASE WHEN r.session_id % 3 <> 1 THEN r.t_s + 2 END AS expected_s, coalesce(scale, 0.25) AS scale, coalesce(fallback, 1.0) AS fallback,
 (SELECT max(i) FROM fn WHERE fn.session_id = r.session_id AND fn.seq < r.seq) AS ia, (SELECT min(i) FROM fn WHERE fn.session_id = r.session_id AND fn.seq > r.seq) AS ib FROM rolls r LEFT JOIN fits USING (session_id)),
proj AS (SELECT ax.*, round(CASE WHEN own.seq IS NOT NULL THEN own.t_s WHEN ia IS NOT NULL AND ib IS NOT NULL THEN a.t_s + (b.t_s - a.t_s) * (ax.seq - a.seq) / (b.seq - a.seq) WHEN ia IS NOT NULL THEN {BEYOND('ax.seq', 'a', 'a0')} WHEN ib IS NOT NULL THEN {BEYOND('ax.seq', 'b', 'b0')} ELSE greatest(0.0, coalesce(expected_s, ax.seq * fallback)) END, 6) AS t_audio_s,
 round(CASE WHEN own.seq IS NOT NULL THEN scale WHEN ia IS NOT NULL AND ib IS NOT NULL THEN scale + 0.5 + 0.5 * least(ax.seq - a.seq, b.seq - ax.seq) WHEN ia IS NOT NULL THEN scale + 1 + ax.seq - a.seq WHEN ib IS NOT NULL THEN scale + 1 + b.seq - ax.seq ELSE scale + 10 END, 6)::DOUBLE AS uncertainty_s,
 CASE WHEN own.seq IS NOT NULL THEN 'matched' WHEN ia IS NOT NULL AND ib IS NOT NULL THEN 'interpolated' ELSE 'extrapolated' END AS anchor
 FROM ax LEFT JOIN fn own ON own.session_id = ax.session_id AND own.seq = ax.seq LEFT JOIN fn a ON a.session_id = ax.session_id AND a.i = ia LEFT JOIN fn a0 ON a0.session_id = ax.session_id AND a0.i = ia - 1 LEFT JOIN fn b ON b.session_id = ax.session_id AND b.i = ib LEFT JOIN fn b0 ON b0.session_id = ax.session_id AND b0.i = ib + 1),
anch AS (SELECT * REPLACE (max(t_audio_s) OVER (PARTITION BY session_id ORDER BY seq, roll_id) AS t_audio_s) FROM proj),
loo AS (SELECT p.session_id, p.seq, p.t_s, abs(p.t_s - CASE WHEN p.i > 1 AND p.i < p.n THEN a.t_s + (b.t_s - a.t_s) * (p.seq - a.seq) / (b.seq - a.seq) WHEN p.i < p.n THEN {BEYOND('p.seq', 'b', 'b0')} WHEN p.i > 1 THEN {BEYOND('p.seq', 'a', 'a0')} ELSE p.t_s END) AS residual_s
 FROM fn p LEFT JOIN fits USING (session_id) LEFT JOIN fn a ON a.session_id = p.session_id AND a.i = p.i - 1 LEFT JOIN fn a0 ON a0.session_id = p.session_id AND a0.i = p.i - 2 LEFT JOIN fn b ON b.session_id = p.session_id AND b.i = p.i + 1 LEFT JOIN fn b0 ON b0.session_id = p.session_id AND b0.i = p.i + 2)"""
QUALITY = f"""{PROJ}, iso AS (SELECT *, sum((anchor = 'matched')::INT) OVER w AS run, coalesce(lag(t_audio_s) OVER w, t_audio_s) AS l, coalesce(lead(t_audio_s) OVER w, t_audio_s) AS r FROM anch WINDOW w AS (PARTITION BY session_id ORDER BY seq, roll_id)),
gp AS (SELECT session_id, max(g) AS gap FROM (SELECT session_id, run, greatest(0.0, arg_max(r, (seq, roll_id)) - arg_min(l, (seq, roll_id))) AS g FROM iso WHERE anchor <> 'matched' GROUP BY 1, 2) GROUP BY 1),
kn AS (SELECT session_id, quantile_cont(abs(fit.t_s - expected_s), 0.5) AS known, quantile_cont(fit.t_s - expected_s, 0.5) AS drift FROM anch JOIN fit USING (session_id, seq) WHERE expected_s IS NOT NULL GROUP BY 1), lo AS (SELECT session_id, quantile_cont(residual_s, 0.5) AS left_out FROM loo GROUP BY 1)
SELECT session_id, round(avg((anchor = 'matched')::INT), 6) AS anchored_fraction, coalesce(round(coalesce(any_value(known), any_value(left_out)), 6), -1) AS median_residual_s, coalesce(round(any_value(gap), 6), -1) AS largest_gap_s, coalesce(round(CASE WHEN session_id % 3 = 0 THEN any_value(drift) END, 6), -1) AS drift_s FROM anch LEFT JOIN gp USING (session_id) LEFT JOIN kn USING (session_id) LEFT JOIN lo USING (session_id) GROUP BY 1"""


def _projected(spark, sf):
    rolls = ad.rolls(spark, sf).selectExpr("session_id", "seq", "roll_id", "CASE WHEN session_id % 3 <> 1 THEN t_s + 2 END AS expected_s")
    return al.project(rolls, _points(spark, sf), _fits(spark, sf))


@query("al09_project", f"WITH {PROJ} SELECT session_id, seq, round(t_audio_s, 4) AS t_audio_s, round(uncertainty_s, 4) AS uncertainty_s, anchor FROM proj")
def _(spark, sf):
    return _projected(spark, sf).select("session_id", "seq", F.round("t_audio_s", 4).alias("t_audio_s"), F.round("uncertainty_s", 4).alias("uncertainty_s"), "anchor")


@query("al10_anchors", f"WITH {PROJ} SELECT session_id, seq, round(t_audio_s, 4) AS t_audio_s FROM anch")
def _(spark, sf):
    return al.anchors(_projected(spark, sf)).select("session_id", "seq", F.round("t_audio_s", 4).alias("t_audio_s"))


@query("al11_alignment_quality", f"WITH {QUALITY}")
def _(spark, sf):
    """Sessions with a wall clock, with expected times of another kind, and with an order only."""
    basis = ad.rolls(spark, sf).selectExpr("session_id", "CASE session_id % 3 WHEN 0 THEN 'wallclock' WHEN 1 THEN 'order_only' ELSE 'id_time' END AS basis").distinct()
    return al.alignment_quality(al.anchors(_projected(spark, sf)), _points(spark, sf), _fits(spark, sf), basis).na.fill(-1.0)


@query("al11_leave_one_out", f"WITH {PROJ} SELECT session_id, seq, round(residual_s, 4) AS residual_s FROM loo")
def _(spark, sf):
    return al.leave_one_out(_points(spark, sf), _fits(spark, sf)).select("session_id", "seq", F.round("residual_s", 4).alias("residual_s"))


TURNS = PROJ.replace("CASE WHEN r.session_id % 3 <> 1 THEN r.t_s + 2 END AS expected_s", "NULL::DOUBLE AS expected_s")
query("al12_turnorder", f"WITH {TURNS} SELECT p.session_id, p.seq, CASE WHEN r.total IS NULL THEN 0 ELSE 1 END AS n_entries, round(t_audio_s, 4) AS t_audio_s FROM proj p JOIN rolls r USING (session_id, seq) WHERE r.kind = 'initiative'")(lambda spark, sf: al.project_turnorder(ad.rolls(spark, sf).where("kind = 'initiative'").select("session_id", "seq", "roll_id", F.array(F.struct(F.col("who").alias("name"), F.col("total").alias("value")), F.struct(F.lit(None).cast("string").alias("name"), F.col("total").alias("value"))).alias("entries")), _points(spark, sf), _fits(spark, sf)).select("session_id", "seq", F.size("entries").alias("n_entries"), F.round("t_audio_s", 4).alias("t_audio_s")))


# Data quality.
TR = "tracks AS (SELECT o_custkey AS session_id, o_orderkey AS track_id, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderstatus END AS player_id, (o_orderkey % 400) / 1000.0::DOUBLE AS speech_ratio, o_totalprice > 20000 AS aligned FROM orders), sessions AS (SELECT c_custkey AS session_id, c_custkey % 3 <> 0 AS has_capture, CASE WHEN c_custkey % 5 = 0 THEN 'order_only' ELSE 'wallclock' END AS basis FROM customer)"


def _tracks(spark, sf):
    return ad.table(spark, sf, "orders").selectExpr("o_custkey AS session_id", "o_orderkey AS track_id", "CASE WHEN o_orderkey % 6 <> 0 THEN o_orderstatus END AS player_id", "(o_orderkey % 400) / 1000.0D AS speech_ratio", "o_totalprice > 20000 AS aligned")


def _sessions(spark, sf):
    return ad.table(spark, sf, "customer").selectExpr("c_custkey AS session_id", "c_custkey % 3 <> 0 AS has_capture", "CASE WHEN c_custkey % 5 = 0 THEN 'order_only' ELSE 'wallclock' END AS basis")


ENT = f"{TR}, found AS (SELECT session_id, 'TRACK_UNMAPPED' AS code, track_id::VARCHAR AS subject FROM tracks WHERE player_id IS NULL UNION ALL SELECT session_id, 'TRACK_SILENT', track_id::VARCHAR FROM tracks WHERE speech_ratio < 0.005 UNION ALL SELECT session_id, 'TRACK_DURATION_MISMATCH', track_id::VARCHAR FROM tracks WHERE NOT aligned UNION ALL SELECT session_id, 'NO_TRACKS', '' FROM sessions WHERE session_id NOT IN (SELECT session_id FROM tracks) UNION ALL SELECT session_id, 'NO_CAPTURE', '' FROM sessions WHERE NOT has_capture UNION ALL SELECT session_id, 'ORDER_ONLY', '' FROM sessions WHERE basis = 'order_only'), ent AS (SELECT * FROM found WHERE NOT (code = 'ORDER_ONLY' AND session_id % 2 = 0))"


def _entries(spark, sf):
    reported = _sessions(spark, sf).where("session_id % 2 = 0").select("session_id", F.lit("ORDER_ONLY").alias("code"))
    return qa.intake_rules(_tracks(spark, sf), _sessions(spark, sf), reported).na.fill("", ["subject"])


@query("qa01_intake_rules", f"WITH {ENT} SELECT * FROM ent")
def _(spark, sf):
    return _entries(spark, sf)


@query("qa02_unmapped_accounts", f"WITH {R} SELECT session_id, account, n, row_number() OVER (PARTITION BY session_id ORDER BY account) AS ord FROM (SELECT session_id, CASE WHEN who = 'p3' THEN '(unknown)' ELSE who END AS account, count(*) AS n FROM rolls WHERE roll_id % 3 <> 0 GROUP BY 1, 2)")
def _(spark, sf):
    r = ad.rolls(spark, sf).selectExpr("session_id", "CASE WHEN who = 'p3' THEN ' ' ELSE who END AS account", "CASE WHEN roll_id % 3 = 0 THEN 'x' END AS player_id")
    return qa.unmapped_accounts(r)


@query("qa03_absent_players", f"WITH {TR}, roster AS (SELECT session_id, unnest(['F', 'O', 'P']) AS player_id FROM sessions) SELECT * FROM roster WHERE (session_id, player_id) NOT IN (SELECT (session_id, player_id) FROM tracks WHERE player_id IS NOT NULL)")
def _(spark, sf):
    roster = _sessions(spark, sf).select("session_id", F.explode(F.array(*map(F.lit, "FOP"))).alias("player_id"))
    return qa.absent_players(roster, _tracks(spark, sf))


@query("qa04_mismatch_entries", f"WITH {TR} SELECT session_id, 'TRACK_DURATION_MISMATCH' AS code, string_agg(track_id::VARCHAR, ', ' ORDER BY track_id::VARCHAR) AS subject FROM tracks WHERE NOT aligned GROUP BY 1")
def _(spark, sf):
    return qa.mismatch_entries(_tracks(spark, sf))


CAT = "cat AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{s}', '{h}', {i})" for i, (c, s, h) in enumerate(qa.CATALOG)) + ") v(code, severity, hint, catalog_ord)), "
CATD = f"{ENT}, {CAT} full_ AS (SELECT session_id, e.code, subject, coalesce(severity, 'warning') AS severity, replace(coalesce(hint, ''), '{{subject}}', subject) AS hint, coalesce(catalog_ord, 999) AS catalog_ord FROM (SELECT session_id, CASE WHEN code = 'NO_CAPTURE' THEN 'OWN_CODE' ELSE code END AS code, subject FROM ent) e LEFT JOIN cat USING (code))"


def _full(spark, sf):
    e = _entries(spark, sf).withColumn("code", F.expr("CASE WHEN code = 'NO_CAPTURE' THEN 'OWN_CODE' ELSE code END"))
    return qa.with_catalog(e, qa.catalog(spark)).na.fill("", ["hint"])


@query("qa05_with_catalog", f"WITH {CATD} SELECT * FROM full_")
def _(spark, sf):
    return _full(spark, sf)


@query("qa06_deduplicated", f"WITH {CATD} SELECT session_id, code, subject, severity, CASE WHEN code = 'NO_TRACKS' THEN 'first' ELSE 'a' END AS message FROM full_")
def _(spark, sf):
    f = _full(spark, sf)
    copies = f.withColumn("message", F.expr("CASE WHEN code = 'NO_TRACKS' THEN 'first' ELSE 'a' END")).withColumn("arrival", F.lit(1)).unionByName(f.withColumn("message", F.lit("z")).withColumn("arrival", F.lit(0)))
    return qa.deduplicated(copies).select("session_id", "code", "subject", "severity", "message")


@query("qa07_severity_counts", f"WITH {CATD}, g AS (SELECT session_id, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM full_ GROUP BY 1) SELECT *, CASE WHEN error > 0 THEN 2 WHEN warning > 0 THEN 1 ELSE 0 END AS exit_code FROM g")
def _(spark, sf):
    return qa.severity_counts(_full(spark, sf))


@query("qa09_unparsed_sample", f"WITH {U} SELECT session_id, arg_min(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 240), source_index) AS sample, count(*) AS n FROM utterances WHERE source_index % 3 = 1 GROUP BY 1")
def _(spark, sf):
    m = ad.utterances(spark, sf).withColumn("recognised", F.expr("source_index % 3 <> 1")).withColumn("ord", F.col("source_index"))
    return qa.unparsed_sample(m)


RULES = {"price_positive": "o_totalprice > 100000", "status_known": "o_orderstatus IN ('F', 'O')", "priority_form": "o_orderpriority LIKE '_-%'"}


@query("qa10_constraints", " UNION ALL ".join(f"SELECT o_orderkey, '{n}' AS rule FROM orders WHERE NOT coalesce({c}, false)" for n, c in RULES.items()))
def _(spark, sf):
    return qa.constraint_violations(ad.table(spark, sf, "orders"), "o_orderkey", RULES)


@query("qa10_counters", "SELECT 'rows' AS rule, count(*) AS n FROM orders UNION ALL " + " UNION ALL ".join(f"SELECT '{n}', count(*) FILTER (NOT coalesce({c}, false)) FROM orders" for n, c in RULES.items()))
def _(spark, sf):
    """Rows and violations, counted by the pass that writes the violations."""
    counters = Observation()
    materialise(qa.constraint_violations(ad.table(spark, sf, "orders"), "o_orderkey", RULES, counters), "violations")
    return spark.createDataFrame(list(counters.get.items()), "rule string, n long")


# The ledger.
@query("lg01_upsert_sessions", "WITH a AS (SELECT c_custkey AS session_id, c_name AS title, c_acctbal AS created_at FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS session_id, upper(c_name) AS title, -1.0 AS created_at FROM customer WHERE c_custkey % 2 = 0) SELECT session_id, coalesce(b.title, a.title) AS title, coalesce(a.created_at, b.created_at)::DOUBLE AS created_at FROM a FULL JOIN b USING (session_id)")
def _(spark, sf):
    c = ad.table(spark, sf, "customer")
    return lg.upsert_sessions(c.where("c_custkey % 3 <> 0").selectExpr("c_custkey AS session_id", "c_name AS title", "c_acctbal AS created_at"), c.where("c_custkey % 2 = 0").selectExpr("c_custkey AS session_id", "upper(c_name) AS title", "-1.0D AS created_at"))


@query("lg02_session_page", "SELECT o_orderkey AS session_id, o_totalprice AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 25")
def _(spark, sf):
    s = ad.table(spark, sf, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey AS session_id", "o_totalprice AS total", "o_orderdate AS date")
    return lg.session_page(s, 25, 50).select("session_id", "total")


def _runs(spark, sf):
    return ad.table(spark, sf, "orders").selectExpr("o_custkey AS session_id", "o_orderpriority AS stage", "o_orderstatus AS status", "o_orderdate AS started_at", "o_orderkey AS run_id")


LAST = "arg_max(o_orderstatus, {'d': o_orderdate, 'k': o_orderkey})"


@query("lg03_latest_status", f"SELECT c_custkey AS session_id, coalesce(s, 'new') AS status FROM customer LEFT JOIN (SELECT o_custkey, {LAST} AS s FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def _(spark, sf):
    return lg.latest_status(_sessions(spark, sf), _runs(spark, sf))


STAGES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "6-NONE"]


@query("lg04_stage_status", f"SELECT session_id, stage, coalesce(s, 'pending') AS status FROM (SELECT c_custkey AS session_id, unnest({STAGES!r}) AS stage FROM customer) LEFT JOIN (SELECT o_custkey AS session_id, o_orderpriority AS stage, {LAST} AS s FROM orders GROUP BY 1, 2) USING (session_id, stage)")
def _(spark, sf):
    return lg.stage_status(_sessions(spark, sf), _runs(spark, sf), STAGES)


@query("lg05_rebuild_history", "SELECT o_orderkey AS run_id, o_orderpriority AS stage, o_orderstatus AS status FROM orders WHERE o_orderkey % 10 <> 0")
def _(spark, sf):
    o = ad.table(spark, sf, "orders")
    lines = o.select(F.when(F.col("o_orderkey") % 10 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("status")))).alias("value"))
    return lg.rebuild_history(lines, "run_id bigint, stage string, status string")


FL = "fl AS (SELECT DISTINCT o_custkey AS session_id, o_orderpriority AS stage, 'C' || (o_orderkey % 3) AS code, CASE WHEN o_orderkey % 2 = 0 THEN 'u' ELSE '' END AS utt, CASE WHEN o_orderkey % 3 = 1 THEN 'open' ELSE 'resolved' END AS state FROM orders WHERE o_orderstatus <> 'P'), nw AS (SELECT DISTINCT o_custkey AS session_id, o_orderpriority AS stage, 'C' || (o_orderkey % 3) AS code, CASE WHEN o_orderkey % 2 = 0 THEN 'u' ELSE '' END AS utt FROM orders WHERE o_orderstatus = 'P')"


@query("lg06_refresh_flags", f"WITH {FL}, k AS (SELECT * FROM fl WHERE state <> 'open' OR (session_id, stage) NOT IN (SELECT (session_id, stage) FROM nw)) SELECT session_id, stage, code, utt, coalesce(state, 'open') AS state FROM k FULL JOIN nw USING (session_id, stage, code, utt)")
def _(spark, sf):
    o = ad.table(spark, sf, "orders")
    base = ["o_custkey AS session_id", "o_orderpriority AS stage", "concat('C', o_orderkey % 3) AS code", "CASE WHEN o_orderkey % 2 = 0 THEN 'u' END AS utterance_id"]
    flags = o.where("o_orderstatus <> 'P'").selectExpr(*base, "CASE WHEN o_orderkey % 3 = 1 THEN 'open' ELSE 'resolved' END AS state").distinct()
    return lg.refresh_flags(flags, o.where("o_orderstatus = 'P'").selectExpr(*base))


@query("lg07_resolve_flags", "SELECT o_orderkey AS flag_id, CASE WHEN o_orderkey % 4 = 0 THEN 'dismissed' ELSE o_orderstatus END AS state FROM orders")
def _(spark, sf):
    o = ad.table(spark, sf, "orders")
    return lg.resolve_flags(o.selectExpr("o_orderkey AS flag_id", "o_orderstatus AS state"), o.where("o_orderkey % 4 = 0").selectExpr("o_orderkey AS flag_id", "'dismissed' AS state"))


@query("lg08_open_counts", "SELECT o_orderpriority AS code, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def _(spark, sf):
    return lg.open_counts(ad.table(spark, sf, "orders").selectExpr("o_orderpriority AS code", "CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'x' END AS state"))


@query("lg09_agent_runs", "SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'running' END AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders")
def _(spark, sf):
    o = ad.table(spark, sf, "orders")
    return lg.agent_runs(o.selectExpr("o_custkey AS session_id", "o_orderkey AS run_id", "o_orderdate AS started_at"), o.where("o_orderkey % 3 = 0").selectExpr("o_orderkey AS run_id", "o_orderstatus AS status")).select("run_id", "status", "place")


@query("lg10_repair_interrupted", "SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'O' THEN 'interrupted' ELSE o_orderstatus END AS status FROM orders")
def _(spark, sf):
    return lg.repair_interrupted(ad.table(spark, sf, "orders").selectExpr("o_orderkey AS run_id", "CASE WHEN o_orderstatus = 'O' THEN 'running' ELSE o_orderstatus END AS status"))


DG = "dg AS (SELECT l_orderkey AS k, sha256(string_agg(l_linenumber || '-' || l_partkey || '=' || CASE WHEN l_partkey % 10 = 0 THEN repeat('0', 64) ELSE sha256(l_partkey::VARCHAR) END, E'\\n' ORDER BY l_linenumber || '-' || l_partkey || '=' || CASE WHEN l_partkey % 10 = 0 THEN repeat('0', 64) ELSE sha256(l_partkey::VARCHAR) END)) AS digest FROM lineitem GROUP BY 1)"


@query("lg11_stale", f"WITH {DG} SELECT k, CASE WHEN k % 7 = 0 THEN 'never_run' WHEN k % 7 = 1 THEN 'failed' WHEN k % 7 = 2 THEN 'version' WHEN k % 7 = 4 AND k % 2 = 0 THEN 'params' WHEN k % 7 = 3 THEN 'inputs' ELSE 'output_missing' END AS reason FROM dg WHERE k % 7 <= 3 OR (k % 7 = 4 AND k % 2 = 0) OR k % 5 = 0")
def _(spark, sf):
    i = ad.table(spark, sf, "lineitem").selectExpr("l_orderkey AS k", "concat(l_linenumber, '-', l_partkey) AS path", "CASE WHEN l_partkey % 10 <> 0 THEN sha2(CAST(l_partkey AS STRING), 256) END AS sha")
    params = ad.table(spark, sf, "orders").where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS k", "explode(map('priority', o_orderpriority, 'status', o_orderstatus)) AS (name, value)")
    metas = lg.input_digest(i, ["k"]).where("k % 7 <> 0").withColumn("status", F.expr("CASE WHEN k % 7 = 1 THEN 'error' ELSE 'ok' END")).withColumn("version", F.expr("CASE WHEN k % 7 = 2 THEN 1 ELSE 2 END")).withColumn("digest", F.expr("CASE WHEN k % 7 = 3 THEN 'other' ELSE digest END"))
    before = lg.params_digest(params.withColumn("value", F.expr("CASE WHEN k % 7 = 4 AND name = 'priority' THEN NULL ELSE value END")), ["k"])
    return lg.stale(i, metas.join(before, "k", "left"), 2, ["k"], params, metas.where("k % 5 <> 0"))


@query("lg11b_input_digest", f"WITH {DG} SELECT k, digest FROM dg")
def _(spark, sf):
    i = ad.table(spark, sf, "lineitem").selectExpr("l_orderkey AS k", "concat(l_linenumber, '-', l_partkey) AS path", "CASE WHEN l_partkey % 10 <> 0 THEN sha2(CAST(l_partkey AS STRING), 256) END AS sha")
    return lg.input_digest(i, ["k"])


@query("lg12_run_log", "SELECT user_id AS run_id, count(*) FILTER (event_id % 5 NOT IN (0, 1)) AS n_messages, count(*) FILTER (event_id % 5 = 0) AS n_malformed, coalesce(arg_max(event_type, event_id) FILTER (event_id % 5 = 1), '') AS result, sum(CASE WHEN event_id % 5 <> 0 THEN event_id % 100 ELSE 0 END)::BIGINT AS tokens FROM events GROUP BY 1")
def _(spark, sf):
    lines = ad.table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 5 == 0, F.lit("oops {")).otherwise(F.to_json(F.struct(F.when(F.col("event_id") % 5 == 1, "result").otherwise("message").alias("type"), F.col("event_type").alias("text"), (F.col("event_id") % 100).alias("tokens")))).alias("line"))
    return lg.run_log(lines)
