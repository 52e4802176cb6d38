"""Queries on sources and streams, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity as idn
from ..session import scratch_path, ship_package
from ..sources import capture as cp
from ..streaming import live
from . import adapters as ad

Q, S = {}, {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


def _events(spark, sf):
    return ad.table(spark, sf, "events")


def _captures(spark, sf):
    """One JSON capture per user, with fields under changing names and some bare items."""
    item = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("bare "), "event_id")).otherwise(
        F.to_json(F.struct(F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("m"), "event_id")).alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("t_wall_ms"), F.when(F.col("event_id") % 2 == 1, F.col("user_id")).alias("t_wallclock"), F.col("event_type").alias("who"), F.when(F.col("event_id") % 3 == 0, F.lit("x")).alias("playerId"), F.concat(F.lit("/r 2d6+"), F.col("event_id") % 4).alias("text"), F.when(F.col("event_id") % 4 == 0, F.struct(F.lit("1d20").alias("formula"), (F.col("event_id") % 20).alias("total"))).alias("roll")))
    )
    order = F.to_json(F.struct(F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("m"), F.col("event_id") % 70)).alias("id"), F.col("event_id").alias("seq"), F.array(F.struct(F.lit("orc").alias("name"), (F.col("event_id") % 20).alias("value"))).alias("entries")))
    rows = _events(spark, sf).select(F.col("user_id").alias("session_id"), F.struct("event_id", item.alias("i")).alias("i"), F.when(F.col("event_type") == "signup", F.struct("event_id", order.alias("i"))).alias("o"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x.i)
    raw = F.to_json(F.struct(F.lit("live").alias("mode"), listed("i").alias("messages"), listed("o").alias("turnorder_events")))
    # a third are arrays of messages, another third are JSON strings
    messages = F.get_json_object(raw, "$.messages")
    return rows.groupBy("session_id").agg(F.when(F.col("session_id") % 3 == 0, messages).when(F.col("session_id") % 3 == 1, F.to_json(F.array(raw)).substr(F.lit(2), F.length(F.to_json(F.array(raw))) - 2)).otherwise(raw).alias("raw"))


M = "m AS (SELECT user_id AS session_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS source_index, event_id % 11 = 0 AS bare, event_type FROM events)"


@query("src01_json_messages", f"WITH {M} SELECT session_id, source_index, CASE WHEN bare OR event_id % 5 = 0 THEN '' ELSE 'm' || event_id END AS id, CASE WHEN bare THEN -1 ELSE session_id END AS t_wall_ms, CASE WHEN bare THEN '' ELSE event_type END AS who, CASE WHEN NOT bare AND event_id % 3 = 0 THEN 'x' ELSE '' END AS player_id, CASE WHEN bare THEN 'bare ' || event_id ELSE '/r 2d6+' || event_id % 4 END AS text, CASE WHEN NOT bare AND event_id % 4 = 0 THEN event_id % 20 ELSE -1 END AS total FROM m")
def _(spark, sf):
    m = cp.json_messages(_captures(spark, sf))
    return m.select("session_id", "source_index", "id", "t_wall_ms", "who", "player_id", "text", "total").na.fill("", ["id", "who", "player_id"]).na.fill(-1, ["t_wall_ms", "total"])


@query("src01_turnorder_events", "WITH o AS (SELECT user_id AS session_id, event_id AS seq, event_id % 20 AS value, CASE WHEN event_id % 3 <> 0 THEN 'm' || event_id % 70 END AS id, (SELECT count(*) FROM events x WHERE x.user_id = e.user_id) + row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS source_index FROM events e WHERE event_type = 'signup' AND user_id % 3 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY session_id, id ORDER BY seq) AS r FROM o) SELECT session_id, source_index, id, seq, 'orc ' || value AS entry FROM r WHERE id IS NULL OR r = 1")
def _(spark, sf):
    e = cp.turnorder_events(_captures(spark, sf))
    return e.select("session_id", "source_index", "id", "seq", F.concat(F.get("entries", F.lit(0))["name"], F.lit(" "), F.get("entries", F.lit(0))["value"].cast("int")).alias("entry"))


PAGE_TEXT = "trim(replace(replace(replace(replace(replace(replace(regexp_replace(t || ' ' || k, '\\s+', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'))"


@query("src02_html_messages", f"WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages WHERE html IS NOT NULL) SELECT page_id AS session_id, k AS source_index, 'a' || k AS id, CASE k WHEN 0 THEN 'Bob' ELSE '' END AS who, CASE k WHEN 0 THEN 'general' ELSE '' END AS source_kind, {PAGE_TEXT} AS text FROM p, (SELECT unnest([0, 1]) AS k)")
def _(spark, sf):
    """A message with inner elements, and one of another element and order of attributes; what is outside the chat doesn't count."""
    ship_package(spark)
    t = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    one = F.concat(F.lit('<div class="message general" data-messageid="a0"><div class="by">Bob:</div><script>x()</script><div><b>'), t, F.lit("</b></div><br>0</div>"))
    two = F.concat(F.lit('<li data-messageid="a1" class="message"><i>'), t, F.lit("</i> 1</li>"))
    return cp.html_messages(ad.table(spark, sf, "pages").where("html IS NOT NULL").select(F.col("page_id").alias("session_id"), F.concat(F.lit('<p class="message">x</p><div id=textchat>'), one, two, F.lit("</div>")).alias("raw"))).na.fill("", ["who", "source_kind"])


@query("src03_route", "SELECT event_id, CASE WHEN event_id % 6 IN (0, 3, 4) THEN 'json' ELSE 'html' END AS route FROM events")
def _(spark, sf):
    raw = F.expr("CASE event_id % 6 WHEN 0 THEN concat(' {\"mode\": \"live\", \"messages\": [', event_id, ']}') WHEN 1 THEN '{broken' WHEN 2 THEN '<div></div>' WHEN 3 THEN concat('[', event_id, ']') WHEN 4 THEN '\"[1]\"' ELSE '{\"html\": \"<p>x</p>\"}' END")
    return _events(spark, sf).select("event_id", cp.route(raw).alias("route"))


FILES = "CASE event_id % 4 WHEN 0 THEN 'b-chat-capture.json' WHEN 1 THEN 'a.json' WHEN 2 THEN 'c.HTML' ELSE 'd.txt' END"


@query("src04_preferred_capture", f"WITH f AS (SELECT user_id AS session_id, {FILES} AS path, event_id FROM events), r AS (SELECT session_id, path, row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN path LIKE '%chat-capture.json' THEN 0 WHEN path LIKE '%.json' THEN 1 WHEN lower(path) LIKE '%.html' THEN 2 ELSE 3 END, path) AS r FROM f) SELECT session_id, path FROM r WHERE r = 1")
def _(spark, sf):
    return cp.preferred_capture(_events(spark, sf).selectExpr("user_id AS session_id", f"{FILES} AS path"))


@query("src05_capture_mode", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'archive' WHEN event_id % 2 = 0 THEN 'live' ELSE 'post_hoc' END AS mode FROM events")
def _(spark, sf):
    return _events(spark, sf).select("event_id", cp.capture_mode(F.when(F.col("event_id") % 3 == 0, "html").otherwise("json"), F.when(F.col("event_id") % 2 == 0, "live")).alias("mode"))


@query("src06_message_order", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 3 <> 0 THEN event_id % 50 END NULLS LAST, CASE WHEN event_id % 2 = 0 THEN -event_id END NULLS LAST, event_id) AS ord FROM events")
def _(spark, sf):
    return cp.message_order(_events(spark, sf).selectExpr("user_id AS session_id", "event_id", "event_id AS source_index", "CASE WHEN event_id % 3 <> 0 THEN event_id % 50 END AS t_wall_ms", "CASE WHEN event_id % 2 = 0 THEN -event_id END AS seq")).select("event_id", "ord")


@query("src07_new_turnorder", "WITH e AS (SELECT user_id AS session_id, event_id AS source_index, CASE WHEN event_id % 5 <> 0 THEN event_id % 40 END AS id FROM events), m AS (SELECT DISTINCT session_id, id FROM e WHERE source_index % 9 = 0 AND id IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY session_id, id ORDER BY source_index) AS r FROM e WHERE id IS NOT NULL) SELECT session_id, source_index FROM k WHERE r = 1 AND (session_id, id) NOT IN (SELECT (session_id, id) FROM m) UNION ALL SELECT session_id, source_index FROM e WHERE id IS NULL")
def _(spark, sf):
    e = _events(spark, sf).selectExpr("user_id AS session_id", "event_id AS source_index", "CASE WHEN event_id % 5 <> 0 THEN event_id % 40 END AS id")
    return cp.new_turnorder(e.where("source_index % 9 = 0"), e).select("session_id", "source_index")


KINDS = ["general", "emote", "whisper", "desc", "rollresult", "system", "strange"]
KIND = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"


@query("src08_message_kind", "SELECT event_id, CASE WHEN event_id % 7 = 4 OR event_id % 10 = 3 THEN 'roll' ELSE CASE event_id % 7 WHEN 0 THEN 'chat' WHEN 1 THEN 'emote' WHEN 2 THEN 'whisper' WHEN 3 THEN 'description' WHEN 5 THEN 'system' ELSE 'other' END END AS kind FROM events")
def _(spark, sf):
    return _events(spark, sf).select("event_id", cp.message_kind(F.expr(KIND), F.expr("CASE WHEN event_id % 10 = 3 THEN 'so [[1d6]]' ELSE 'hi' END")).alias("kind"))


FORM = "concat(event_id % 3 + 1, 'd', event_id % 12 + 4, '+', event_id % 7, '-2')"
DUCKFORM = FORM.replace("concat(", "(").replace(", ", " || ")


@query("src09_formula", f"SELECT event_id, CASE WHEN event_id % 6 = 5 THEN '' ELSE {DUCKFORM} END AS formula FROM events")
def _(spark, sf):
    f = F.expr(FORM)
    pick = lambda k, c: F.when(F.col("event_id") % 6 == k, c)
    markup = F.coalesce(pick(1, F.concat(F.lit('<i data-formula="'), f, F.lit('">'))), pick(4, F.concat(F.lit('<i title="Rolling '), f, F.lit(' = 5">'))))
    text = F.coalesce(pick(2, F.concat(F.lit("x [["), f, F.lit("]]"))), pick(3, F.concat(F.lit("/roll "), f)))
    return _events(spark, sf).select("event_id", F.coalesce(cp.formula_of(pick(0, f), markup, text), F.lit("")).alias("formula"))


@query("src10_dice_sides", "SELECT event_id, array_to_string(list_transform(range(0, event_id % 3 + 1), lambda x: event_id % 12 + 4), ',') AS sides FROM events")
def _(spark, sf):
    return _events(spark, sf).select("event_id", F.array_join(cp.dice_sides(F.expr(FORM)), ",").alias("sides"))


@query("src11_modifier", "SELECT event_id, event_id % 7 - 2 AS modifier FROM events")
def _(spark, sf):
    return _events(spark, sf).select("event_id", cp.modifier_sum(F.expr(FORM)).alias("modifier"))


def _dice(spark, sf):
    """Two captured dice: a bare number or an object, and an object under changing names."""
    one = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 20 + 1).cast("string")).otherwise(F.format_string('{"v": %d}', F.col("event_id") % 20 + 1))
    two = F.when(F.col("event_id") % 4 == 0, F.format_string('{"value": %d, "sides": 20, "used": true}', F.col("event_id") % 17 + 1)).when(F.col("event_id") % 4 == 1, F.format_string('{"result": %d, "size": 20, "discarded": "true"}', F.col("event_id") % 17 + 1)).when(F.col("event_id") % 4 == 2, F.format_string('{"value": %d, "d": 20, "drop": false}', F.col("event_id") % 17 + 1)).otherwise(F.format_string('{"die": %d, "sides": 20, "kept": false}', F.col("event_id") % 17 + 1))
    return _events(spark, sf).withColumn("dice", F.transform(cp.kept_dice(F.array(one, two, F.lit('{"label": 1}')), F.array(F.lit(20), F.lit(20))), lambda d: F.struct(d["sides"].alias("sides"), d["value"].cast("long").alias("value"), d["dropped"].alias("dropped"))))


@query("src12_markup_dice", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '8:' || event_id % 8 || ':false,6:' || event_id % 6 || ':true' WHEN event_id % 3 = 1 THEN '20:' || event_id % 20 || ':false,4:7:false' ELSE '' END AS dice FROM events")
def _(spark, sf):
    e = F.col("event_id")
    markup = F.when(e % 3 == 0, F.concat(F.lit('<i class="die d8">'), e % 8, F.lit('</i><i data-die="'), e % 6, F.lit('" class="die dropped">x</i>'))).when(e % 3 == 1, F.concat(F.lit('<span title="Rolling 1d20+1d4 = ('), e % 20, F.lit(')+(7)">9</span>'))).otherwise(F.lit("<b>4</b>"))
    dice = F.transform(cp.markup_dice(markup, F.when(e % 3 == 0, F.array(F.lit(8), F.lit(6))).otherwise(F.array(F.lit(20), F.lit(4)))), lambda d: F.concat_ws(":", d["sides"].cast("string"), d["value"].cast("long").cast("string"), d["dropped"].cast("string")))
    return _events(spark, sf).select("event_id", F.array_join(dice, ",").alias("dice"))


@query("src12_dice", "SELECT event_id, '20:' || (event_id % 20 + 1) || ':false,20:' || (event_id % 17 + 1) || ':' || (event_id % 2 = 1) AS dice FROM events")
def _(spark, sf):
    return _dice(spark, sf).select("event_id", F.array_join(F.transform("dice", lambda d: F.concat_ws(":", d["sides"], d["value"], d["dropped"])), ",").alias("dice"))


@query("src13_total", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 7 WHEN event_id % 4 = 1 THEN event_id % 90 WHEN event_id % 8 = 2 THEN event_id % 70 ELSE event_id % 20 + 1 + CASE WHEN event_id % 2 = 0 THEN event_id % 17 + 1 ELSE 0 END + 3 END AS total FROM events")
def _(spark, sf):
    return _dice(spark, sf).select("event_id", cp.resolved_total(F.expr("CASE WHEN event_id % 4 = 0 THEN 7L END"), F.expr("CASE WHEN event_id % 4 = 1 THEN concat('sum = ', event_id % 90) WHEN event_id % 8 = 2 THEN concat('<b>= 3 + </b><strong class=x> ', event_id % 70, '</strong>') END"), F.col("dice"), F.lit(3)).cast("long").alias("total"))


@query("src14_roll_kind", "SELECT event_id, ['death_save', 'initiative', 'save', 'check', 'damage', 'attack', 'other'][event_id % 7 + 1] AS kind FROM events")
def _(spark, sf):
    words = ["Death save", "Initiative!", "saving throw", "Skill check", "Damage roll", "Attack, to hit", "tables"]
    return _events(spark, sf).select("event_id", cp.roll_kind(F.get(F.array(*map(F.lit, words)), (F.col("event_id") % 7).cast("int"))).alias("kind"))


# two d20, of which one may be dropped already; flags, words, formulas and totals in turn
ADVANTAGE = """WITH x AS (SELECT event_id, event_id % 20 + 1 AS a, event_id % 17 + 1 AS b, CASE WHEN event_id % 13 = 0 THEN 'kl' WHEN event_id % 13 = 1 THEN ' ADV ' END AS flag, CASE event_id % 9 WHEN 0 THEN 'with disadvantage' WHEN 1 THEN 'Advantage!' END AS said, CASE event_id % 7 WHEN 0 THEN '2d20kh1' WHEN 1 THEN '2 D20 KL' END AS form, CASE WHEN event_id % 5 = 0 THEN 3 WHEN event_id % 5 < 4 THEN event_id % 20 + 1 + 3 END AS total, event_id % 11 = 0 AS d0, event_id % 11 IN (0, 1) AS d1 FROM events),
t AS (SELECT *, total - 3 AS net, CASE WHEN flag = ' ADV ' THEN 'advantage' WHEN flag = 'kl' THEN 'disadvantage' WHEN said LIKE '%disadv%' THEN 'disadvantage' WHEN said LIKE '%dvant%' THEN 'advantage' WHEN form LIKE '%kh%' THEN 'advantage' WHEN form LIKE '%KL%' THEN 'disadvantage' WHEN a <> b AND total - 3 IN (a, b) THEN CASE WHEN total - 3 = greatest(a, b) THEN 'advantage' ELSE 'disadvantage' END ELSE 'none' END AS told FROM x),
c AS (SELECT *, CASE WHEN net IN (a, b) THEN net WHEN told = 'advantage' THEN greatest(a, b) ELSE least(a, b) END AS chosen, NOT d0 AND NOT d1 AND told <> 'none' AS marks FROM t),
d AS (SELECT *, CASE WHEN marks THEN a <> chosen ELSE d0 END AS da, CASE WHEN marks THEN b <> chosen ELSE d1 END AS db FROM c),
u AS (SELECT *, CASE WHEN NOT da THEN a WHEN NOT db THEN b END AS kept FROM d)
SELECT event_id, '6:4:false,20:' || a || ':' || da || ',20:' || b || ':' || db AS dice, CASE WHEN told = 'none' AND (d0 OR d1) THEN CASE WHEN (d0 AND a < coalesce(kept, a)) OR (d1 AND b < coalesce(kept, b)) THEN 'advantage' ELSE 'disadvantage' END ELSE told END AS advantage, coalesce(CASE WHEN event_id % 17 = 0 THEN 1 ELSE kept END, -1) AS used FROM u"""


@query("src15_advantage", ADVANTAGE)
def _(spark, sf):
    die = lambda sides, value, dropped: F.struct(F.lit(sides).alias("sides"), F.expr(value).alias("value"), F.expr(dropped).alias("dropped"))
    dice = F.array(die(6, "4L", "false"), die(20, "event_id % 20 + 1", "event_id % 11 = 0"), die(20, "event_id % 17 + 1", "event_id % 11 IN (0, 1)"))
    e = _events(spark, sf).withColumn("dice", dice)
    said, form = F.expr("CASE event_id % 9 WHEN 0 THEN 'with disadvantage' WHEN 1 THEN 'Advantage!' END"), F.expr("CASE event_id % 7 WHEN 0 THEN '2d20kh1' WHEN 1 THEN '2 D20 KL' END")
    total, flag = F.expr("CASE WHEN event_id % 5 = 0 THEN 3L WHEN event_id % 5 < 4 THEN event_id % 20 + 1 + 3 END"), F.expr("CASE WHEN event_id % 13 = 0 THEN 'kl' WHEN event_id % 13 = 1 THEN ' ADV ' END")
    out = e.select("event_id", cp.advantage_of(said, form, F.col("dice"), total, F.lit(3), flag, F.expr("CASE WHEN event_id % 17 = 0 THEN 1L END")).alias("x"))
    return out.select("event_id", F.array_join(F.transform("x.dice", lambda d: F.concat_ws(":", d["sides"], d["value"], d["dropped"])), ",").alias("dice"), "x.advantage", F.coalesce("x.used", F.lit(-1)).alias("used"))


@query("src16_target", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'orc' WHEN 1 THEN 'elf' WHEN 2 THEN 'ogre king' ELSE '' END AS target FROM events")
def _(spark, sf):
    e = F.col("event_id") % 4
    return _events(spark, sf).select("event_id", F.coalesce(cp.target_of(F.when(e == 0, "orc"), F.when(e == 1, '<b data-target="elf">'), F.when(e == 2, "Target: ogre king")), F.lit("")).alias("target"))


NAMED = rf"""WITH {ad.UTTERANCES}, t AS (SELECT utt_id, player_id, text || CASE WHEN source_index % 3 = 0 THEN ' Enemy: the Old ' || player_id || ', npc = Goblin King! | Target: damage;' ELSE ' Hail Émile Zola and the Éowyn' END AS text, CASE WHEN source_index % 4 = 0 THEN 'a  Red Dragon. ' END AS target FROM utterances),
f AS (SELECT utt_id, player_id, list_transform(CASE WHEN target IS NULL THEN [] ELSE [target] END || regexp_extract_all(text, '(?i)(?:target|npc|creature|enemy|opponent)\s*[:=]\s*([^,;|]+)', 1) || regexp_extract_all(text, '\b([A-Z][\p{{L}}\p{{M}}0-9''’.-]*(?:\s+[A-Z][\p{{L}}\p{{M}}0-9''’.-]*)+)\b', 1) || regexp_extract_all(text, '\b(?:the|a|an)\s+([A-Z][\p{{L}}\p{{M}}0-9''’.-]*)\b', 1), lambda x: regexp_replace(regexp_replace(trim(regexp_replace(x, '\s+', ' ', 'g')), '[.,:;!?]+$', ''), '(?i)^(?:the|a|an)\s+', '')) AS names FROM t),
g AS (SELECT utt_id, list_filter(names, lambda x: x <> '' AND NOT list_contains({cp.GENERIC_NAMES}, lower(x)) AND lower(x) <> lower(player_id)) AS names FROM f)
SELECT utt_id, array_to_string(list_filter(names, lambda x, i: list_position(list_transform(names, lambda y: lower(y)), lower(x)) = i), ',') AS names FROM g"""


@query("src17_name_mentions", NAMED)
def _(spark, sf):
    u = ad.utterances(spark, sf).withColumn("text", F.expr("concat(text, CASE WHEN source_index % 3 = 0 THEN concat(' Enemy: the Old ', player_id, ', npc = Goblin King! | Target: damage;') ELSE ' Hail Émile Zola and the Éowyn' END)"))
    return u.select("utt_id", F.array_join(cp.name_mentions(F.col("text"), F.col("player_id"), F.expr("CASE WHEN source_index % 4 = 0 THEN 'a  Red Dragon. ' END")), ",").alias("names"))


@query("src19_parser_metrics", "SELECT user_id AS session_id, count(*) FILTER (event_type <> 'error') AS parsed, count(*) FILTER (event_type = 'error') AS unrecognised, count(*) FILTER (event_type = 'click') AS rolls, count(*) FILTER (event_type = 'signup') AS turnorder FROM events GROUP BY 1")
def _(spark, sf):
    return cp.parser_metrics(_events(spark, sf).selectExpr("user_id AS session_id", "CASE event_type WHEN 'error' THEN 'other' WHEN 'click' THEN 'roll' WHEN 'signup' THEN 'turnorder' ELSE 'chat' END AS kind"))


@query("src20_roll_records", "SELECT event_id, printf('r%04d', row_number() OVER (PARTITION BY user_id ORDER BY event_id)) AS roll_no, CASE WHEN event_id % 4 < 2 THEN 'p' || event_id % 4 ELSE '' END AS player_id FROM events")
def _(spark, sf):
    p = spark.createDataFrame([("a0", "p0"), ("a1", "p1")], "account string, player_id string")
    r = _events(spark, sf).selectExpr("user_id AS session_id", "event_id", "event_id AS ord", "concat('a', event_id % 4) AS account")
    return cp.roll_records(r, p).select("event_id", "roll_no", F.coalesce("player_id", F.lit("")).alias("player_id"))


def _info(spark, sf):
    text = F.concat(
        F.lit("Recording "), "o_orderkey", F.lit("\n\nGuild:\t\tG"), "o_custkey", F.lit("\nServer: other\nStart time:\t2024-01-0"), 1 + F.col("o_orderkey") % 9, F.lit("T10:00:00Z\nChannel: table\nCodec: flac\nTracks: 4\n\t1: ann#"), 1000 + F.col("o_orderkey") % 9000,
        F.lit(" (12345678901234567"), F.col("o_orderkey") % 10, F.lit(")\n\tbob: the bold\n\t (123456789012345678)\n\t#1234\nNotes:\n\tcarl\n"),
    )
    lines = ad.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return cp.recording_info(lines)


PEOPLE = "SELECT o_orderkey::VARCHAR AS path, k AS index, CASE k WHEN 1 THEN 1 ELSE -1 END AS line_index, CASE k WHEN 1 THEN 'ann' WHEN 2 THEN 'bob: the bold' WHEN 3 THEN '' ELSE 'carl' END AS name, CASE k WHEN 1 THEN (1000 + o_orderkey % 9000)::VARCHAR ELSE '' END AS discriminator, CASE k WHEN 1 THEN '12345678901234567' || (o_orderkey % 10) WHEN 3 THEN '123456789012345678' ELSE '' END AS user_id FROM orders, (SELECT unnest([1, 2, 3, 4]) AS k)"


@query("src21_info_participants", PEOPLE)
def _(spark, sf):
    return _info(spark, sf)[1].na.fill("", ["discriminator", "user_id"]).na.fill(-1, ["line_index"])


@query("src21_info_header", "SELECT o_orderkey::VARCHAR AS path, '2024-01-0' || (1 + o_orderkey % 9) || ' 10:00:00' AS started_at, 'G' || o_custkey AS guild, 'table' AS channel FROM orders")
def _(spark, sf):
    return _info(spark, sf)[0].withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"))


@query("src21_info_unparsed", "SELECT o_orderkey::VARCHAR AS path, 0 AS line_no, 'Recording ' || o_orderkey AS line FROM orders UNION ALL SELECT o_orderkey::VARCHAR, 6, 'Codec: flac' FROM orders UNION ALL SELECT o_orderkey::VARCHAR, 11, '#1234' FROM orders")
def _(spark, sf):
    return _info(spark, sf)[2]


@query("src22_track_name", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_orderkey % 10 END AS index, 'track name' AS name, CASE WHEN o_orderkey % 2 = 0 THEN (1000 + o_orderkey % 9000)::VARCHAR ELSE '' END AS discriminator FROM orders")
def _(spark, sf):
    f = F.expr("concat(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat(o_orderkey % 10, '-') END, 'track name', CASE WHEN o_orderkey % 2 = 0 THEN concat('_', 1000 + o_orderkey % 9000) ELSE '' END, '.flac')")
    return ad.table(spark, sf, "orders").select("o_orderkey", cp.track_name(f).alias("t")).select("o_orderkey", F.coalesce("t.index", F.lit(-1)).alias("index"), "t.name", F.coalesce("t.discriminator", F.lit("")).alias("discriminator"))


NUMBERED = """WITH x AS (SELECT o_custkey AS session_id, o_orderkey::VARCHAR AS file, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 5 + 1 END AS index FROM orders), o AS (SELECT *, index IS NOT NULL AND row_number() OVER (PARTITION BY session_id, index ORDER BY file) = 1 AS own FROM x),
rest AS (SELECT session_id, file, row_number() OVER (PARTITION BY session_id ORDER BY index NULLS LAST, file) AS k FROM o WHERE NOT own), room AS (SELECT session_id, unnest(range(1, count(*) + 1)) AS track_no FROM x GROUP BY 1),
free AS (SELECT session_id, track_no, row_number() OVER (PARTITION BY session_id ORDER BY track_no) AS k FROM room r WHERE NOT EXISTS (SELECT 1 FROM o WHERE own AND o.session_id = r.session_id AND o.index = r.track_no))
SELECT session_id, file, index AS track_no FROM o WHERE own UNION ALL SELECT session_id, file, track_no FROM rest JOIN free USING (session_id, k)"""
query("src23_track_ids", NUMBERED)(lambda spark, sf: cp.track_ids(ad.table(spark, sf, "orders").selectExpr("o_custkey AS session_id", "CAST(o_orderkey AS STRING) AS file", "CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 5 + 1 AS INT) END AS index")).withColumn("track_no", F.col("track_no").cast("long")))


def _round_trip(df, how):
    path = scratch_path(df.sparkSession, how)
    df.write.json(path)
    return path


@query("src24_checked_artifact", "SELECT o_orderkey, o_orderpriority FROM orders")
def _(spark, sf):
    o, path = ad.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), scratch_path(spark, "artifact")
    cp.write_checked(o, path, {"o_orderkey: not negative": "o_orderkey >= 0"})
    return cp.read_checked(spark, path, "o_orderkey bigint NOT NULL, o_orderpriority string NOT NULL", {"o_orderpriority: not empty": "o_orderpriority <> ''"})


@query("src24_artifact_issues", "SELECT issue, count(*) AS n FROM (SELECT 'key: odd' AS issue FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'priority: urgent' FROM orders WHERE o_orderpriority LIKE '%URGENT%') GROUP BY 1")
def _(spark, sf):
    o = ad.table(spark, sf, "orders").withColumn("_bad", F.lit(None).cast("string"))
    return cp.artifact_issues(o, {"key: odd": "o_orderkey % 2 = 1", "priority: urgent": "NOT o_orderpriority LIKE '%URGENT%'"}).groupBy("issue").agg(F.count("*").alias("n"))


@query("src25_label_log", "SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, toxic FROM labels")
def _(spark, sf):
    path, rows = scratch_path(spark, "labels"), ad.table(spark, sf, "labels")
    cp.append_labels(rows.select("doc_id", "quality"), path)
    cp.append_labels(rows.selectExpr("doc_id", "toxic AS quality"), path)
    return cp.read_labels(spark, path, "doc_id bigint, quality int")


@query("src26_glossary", "SELECT item_id, split_part(split_part(text, ' ', 1), chr(10), 1) AS term FROM benchmark WHERE item_id % 3 <> 0")
def _(spark, sf):
    return cp.glossary_terms(ad.table(spark, sf, "benchmark").selectExpr("item_id", "concat(CASE WHEN item_id % 3 = 0 THEN '' ELSE ' - ' END, split_part(split_part(text, ' ', 1), '\\n', 1), '  ') AS value")).select("item_id", "term")


@query("src27_vector_store", "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def _(spark, sf):
    path = cp.write_vectors(ad.table(spark, sf, "embeddings").select("vec_id", "embedding"), scratch_path(spark, "vectors"))
    return spark.read.parquet(path).select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@query("src28_registry", "SELECT 'pl_' || n_nationkey AS id, n_name AS name FROM nation")
def _(spark, sf):
    n = ad.table(spark, sf, "nation").agg(F.collect_list(F.struct(F.concat(F.lit("pl_"), "n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("players"))
    return cp.read_registry(spark, _round_trip(n, "registry"), "id:string,name:string")


def _versions(spark, sf):
    path, n = scratch_path(spark, "versions"), ad.table(spark, sf, "nation").select("n_nationkey", "n_name")
    cp.write_versioned(n.where("n_nationkey < 20"), path, 1)
    cp.write_versioned(n.withColumn("n_name", F.concat("n_name", F.lit("2"))), path, 2)
    return path


query("src29_versioned_sink", "SELECT n_nationkey, n_name || '2' AS n_name FROM nation")(lambda spark, sf: cp.read_active(spark, _versions(spark, sf), "n_nationkey int, n_name string"))
query("src29_run_log", "SELECT 1 AS version, count(*) FILTER (n_nationkey < 20) AS \"rows\" FROM nation UNION ALL SELECT 2, count(*) FROM nation")(lambda spark, sf: cp.read_run_log(spark, _versions(spark, sf)))


@query("src29_glossary_sink", "SELECT DISTINCT p_type AS term FROM part")
def _(spark, sf):
    """Written as Markdown and read back."""
    path = scratch_path(spark, "glossary")
    cp.write_glossary(ad.table(spark, sf, "part").selectExpr("p_type AS term"), path)
    return cp.glossary_terms(spark.read.text(path)).select("term")


HELD_BACK = "CASE WHEN event_id % 10 = 0 THEN 3 ELSE least(2, 3 * (unix_micros(ts) - lo) / (hi - lo + 1)) END"


# Streams: the events in slices of a file source, run to their end.
def _stream(spark, sf, slice_of="least(3, 4 * (unix_micros(ts) - lo) / (hi - lo + 1))", closed=False):
    """Events in four slices, by time unless told otherwise, and a closing row if wished; a slice is a batch, as its files are newer than those before."""
    e = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    path, staged = scratch_path(spark, "slices"), scratch_path(spark, "staged")
    span = e.agg(F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi"))
    files = max(4, spark.sparkContext.defaultParallelism)
    cut = e.crossJoin(F.broadcast(span)).withColumn("_s", F.expr(f"CAST({slice_of} AS INT)"))
    cut.select(*e.columns, "_s").write.partitionBy("_s").parquet(staged)
    sliced = spark.read.parquet(staged)
    for k in range(4):  # each reads its own folder
        sliced.where(F.col("_s") == k).drop("_s").repartition(files).write.mode("append").parquet(path)
    if closed:
        live.close_source(spark, e.schema, path, "ts")
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files).parquet(path)


def _messages(stream):
    """Renderings of 50 messages a user; one in seven has no id."""
    return stream.selectExpr("user_id AS game", "CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 50 AS STRING) WHEN event_id % 2 = 0 THEN '' END AS id", "concat('w', event_id % 3) AS who", "concat('t', event_id % 5) AS text", "event_type AS markup", "event_id AS seq", "ts")


RENDERED = """m AS (SELECT user_id AS game, 'w' || (event_id % 3) AS who, 't' || (event_id % 5) AS text, event_type AS markup, event_id AS seq, ts,
CASE WHEN event_id % 7 <> 0 THEN 'id:' || (event_id % 50) ELSE 'fingerprint:' || sha256(event_type || chr(0) || 't' || (event_id % 5) || chr(0) || 'w' || (event_id % 3)) END AS key FROM events)"""


@query("st01_live_upsert", f"WITH {RENDERED} SELECT game, key, arg_min(seq, (ts, seq)) AS first_seq, min(ts) AS first_at, max(ts) AS last_at, arg_max(who, (ts, seq)) AS who, arg_max(text, (ts, seq)) AS text, arg_max(markup, (ts, seq)) AS markup, count(*) AS version FROM m GROUP BY game, key")
def _(spark, sf):
    out = live.run_to_end(live.upsert(_messages(_stream(spark, sf)), "100 days"), "update").drop("batch")
    latest = live.latest_rows(out.withColumn("_k", F.struct("game", "key")), "_k", "version").drop("_k")
    return latest.withColumn("first_at", F.col("first_at").cast("timestamp_ntz")).withColumn("last_at", F.col("last_at").cast("timestamp_ntz"))


@query("st01_first_renderings", f"WITH {RENDERED} SELECT game, key, count(*) AS n FROM (SELECT DISTINCT game, key FROM m) GROUP BY game, key")
def _(spark, sf):
    return live.run_to_end(live.first_renderings(_messages(_stream(spark, sf)), "100 days"), "append").groupBy("game", "key").agg(F.count("*").alias("n"))


@query("st02_order_changes", "WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT user_id, event_id, event_type FROM e WHERE b IS NULL OR b <> event_type")
def _(spark, sf):
    return live.changes(_events(spark, sf), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query("st02_order_changes_stream", S["st02_order_changes"])
def _(spark, sf):
    """The stream is closed, so the rows of its last day come out too."""
    return live.run_to_end(live.change_stream(_stream(spark, sf, closed=True), "user_id", "event_id", "event_type", "ts"), "append")


@query("st03_retention", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 40")
def _(spark, sf):
    return live.retained(_events(spark, sf), ["user_id"], ["ts", "event_id"], 40).select("user_id", "event_id")


@query("st03_retention_stream", S["st03_retention"])
def _(spark, sf):
    """Rows come in any order: every tenth is held back to the last batch."""
    out = live.run_to_end(live.retention_stream(_stream(spark, sf, HELD_BACK), "user_id", "event_id", "ts", 40), "update")
    return live.still_retained(out, "user_id", "event_id")


@query("st04_replay", "WITH e AS (SELECT user_id, event_id AS sequence, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events), b AS (SELECT * FROM e WHERE r <= 20), c AS (SELECT user_id, min(sequence) AS lo FROM b GROUP BY 1) SELECT b.user_id, sequence, 5000 < lo - 1 AS truncated FROM b JOIN c USING (user_id) WHERE sequence > 5000")
def _(spark, sf):
    return live.replay(_events(spark, sf).selectExpr("user_id", "event_id AS sequence"), ["user_id"], 5000, 20)


@query("st05_window_counts", "SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    out = live.run_to_end(live.windowed_counts(_stream(spark, sf), "ts", "event_type", "1 day"), "complete")
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("day"), "n")


@query("st05_session_gaps_stream", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM r GROUP BY user_id, run HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM events)")
def _(spark, sf):
    """Runs that ended before the last watermark; later ones are still open."""
    out = live.run_to_end(live.session_runs(_stream(spark, sf), "ts", "user_id", "6 hours"), "append")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("st05_stream_static_join", "SELECT event_id, coalesce(n_name, '') AS n_name FROM events LEFT JOIN nation ON user_id = n_nationkey")
def _(spark, sf):
    dim = ad.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("user_id"), "n_name")
    return live.run_to_end(_stream(spark, sf).join(dim, "user_id", "left").select("event_id", F.coalesce("n_name", F.lit("")).alias("n_name")), "append")


@query("st05_combat_markers_stream", f"WITH t AS (SELECT ts, user_id, event_id, CASE WHEN event_id % 4 < 2 THEN 0 ELSE event_id % 4 END AS entries FROM events WHERE event_type <> 'error'), m AS (SELECT *, coalesce(lag(entries > 0) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS was FROM t) SELECT user_id, event_id, entries, CASE WHEN entries > 0 AND NOT was THEN 'started' WHEN entries = 0 AND was THEN 'ended' ELSE 'changed' END AS marker FROM m WHERE ts <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM events WHERE event_type <> 'error')")
def _(spark, sf):
    t = _stream(spark, sf).where("event_type <> 'error'").withColumn("entries", F.expr("CASE WHEN event_id % 4 < 2 THEN 0 ELSE event_id % 4 END"))
    return live.run_to_end(live.marker_stream(t, "user_id", "event_id", "entries", "ts"), "append")


@query("st05_identity_stream", "WITH p AS (SELECT lower(n_name) AS key, 'pl_' || n_nationkey AS player_id FROM nation) SELECT event_id, coalesce(player_id, '') AS player_id FROM events LEFT JOIN nation ON user_id % 40 = n_nationkey LEFT JOIN p ON key = lower(n_name)")
def _(spark, sf):
    """Names of a stream, in capitals and with a number, looked up as in ID-04."""
    n = ad.table(spark, sf, "nation")
    players = n.selectExpr("concat('pl_', n_nationkey) AS player_id", "n_name AS username", "n_name AS display_name", "CAST(NULL AS STRING) AS account")
    names = n.selectExpr("CAST(n_nationkey AS LONG) AS _n", "concat(' ', n_name, '#1234') AS name")
    named = _stream(spark, sf).withColumn("_n", F.expr("user_id % 40")).join(F.broadcast(names), "_n", "left").select("event_id", "name")
    return live.run_to_end(idn.exact_lookup(named, players, "user").select("event_id", F.coalesce("player_id", F.lit("")).alias("player_id")), "append")


@query("st05_late_rows", "WITH b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events), w AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY AS mark FROM events, b WHERE event_id % 10 <> 0 AND 3 * (epoch_us(ts) - lo) / (hi - lo + 1) < 2), x AS (SELECT event_id % 10 = 0 AND time_bucket(INTERVAL '6 hours', ts) + INTERVAL 6 HOUR <= mark AS late FROM events, w) SELECT count(*) AS \"rows\", count(*) FILTER (late) AS late, count(*) FILTER (NOT late) AS counted FROM x")
def _(spark, sf):
    """Every tenth row is held back to the last batch; what is late there goes by the watermark that the batch before ended with windows by."""
    counts, rows, late = live.windowed_counts_and_late(_stream(spark, sf, HELD_BACK), "ts", "event_type", "6 hours")
    return counts.agg(F.lit(rows).cast("long").alias("rows"), F.lit(late).cast("long").alias("late"), F.sum("n").alias("counted"))
