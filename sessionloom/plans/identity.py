"""Queries on identities and lexical evidence, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import name_similarity, normalised_name
from ..operators import identity as idn
from ..operators import lexical as lx
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


NORM = lambda c: f"trim(regexp_replace(lower(regexp_replace(strip_accents({c}), '#\\d{{2,6}}$', '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
PL = "players AS (SELECT 'pl_' || n_nationkey AS player_id, n_name AS display_name, CASE WHEN n_nationkey % 3 <> 0 THEN lower(n_name) || ' user#1234' END AS username, CASE WHEN n_nationkey % 2 = 0 THEN n_name || ' acct' END AS account, CASE WHEN n_nationkey % 4 = 0 THEN 'u' || n_nationkey END AS user_id FROM nation)"
OBS = "observed AS (SELECT c_custkey % 50 AS session_id, c_custkey AS track_id, CASE c_custkey % 4 WHEN 0 THEN 'Nation ' || c_nationkey WHEN 1 THEN 'nation_' || c_nationkey || 'x' WHEN 2 THEN 'NATION_' || c_nationkey || ' acct' WHEN 3 THEN CASE WHEN c_custkey % 8 = 3 THEN 'Ñatiôn ' || c_nationkey || ' 日本#12' ELSE c_name END END AS name, CASE WHEN c_custkey % 7 = 0 THEN 'u' || c_nationkey END AS user_id FROM customer)"
KEYS = f"keys AS (SELECT 'user' AS kind, {NORM('username')} AS key, player_id, 1 AS priority FROM players UNION ALL SELECT 'user', {NORM('display_name')}, player_id, 2 FROM players UNION ALL SELECT 'account', {NORM('account')}, player_id, 1 FROM players), known AS (SELECT DISTINCT key AS k, player_id FROM keys WHERE key <> '')"


def _players(spark, sf):
    return ad.table(spark, sf, "nation").selectExpr("concat('pl_', n_nationkey) AS player_id", "n_name AS display_name", "CASE WHEN n_nationkey % 3 <> 0 THEN concat(lower(n_name), ' user#1234') END AS username", "CASE WHEN n_nationkey % 2 = 0 THEN concat(n_name, ' acct') END AS account", "CASE WHEN n_nationkey % 4 = 0 THEN concat('u', n_nationkey) END AS user_id")


def _observed(spark, sf):
    return ad.table(spark, sf, "customer").selectExpr("c_custkey % 50 AS session_id", "c_custkey AS track_id", "CASE c_custkey % 4 WHEN 0 THEN concat('Nation ', c_nationkey) WHEN 1 THEN concat('nation_', c_nationkey, 'x') WHEN 2 THEN concat('NATION_', c_nationkey, ' acct') WHEN 3 THEN CASE WHEN c_custkey % 8 = 3 THEN concat('Ñatiôn ', c_nationkey, ' 日本#12') ELSE c_name END END AS name", "CASE WHEN c_custkey % 7 = 0 THEN concat('u', c_nationkey) END AS user_id")


@query("id01_normalised_name", f"WITH {OBS} SELECT track_id, {NORM('name')} AS n FROM observed")
def _(spark, sf):
    return _observed(spark, sf).select("track_id", normalised_name(F.col("name")).alias("n"))


@query("id02_edit_distance", f"WITH {OBS} SELECT track_id, levenshtein(regexp_replace(name, '[^ -~]', '?', 'g'), 'NATION_10')::INT AS d FROM observed")
def _(spark, sf):
    return _observed(spark, sf).select("track_id", F.levenshtein("name", F.lit("NATION_10")).alias("d"))


PREFIX = lambda x, y: f"CASE WHEN least(length({x}), length({y})) >= 3 AND (starts_with({x}, {y}) OR starts_with({y}, {x})) THEN least(0.95, 0.6 + 0.4 * least(length({x}), length({y})) / greatest(length({x}), length({y}))) ELSE 0.0 END"
SIM = lambda a, b: f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 ELSE least(0.99, greatest(1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})), len(list_intersect(string_split({a}, ' '), string_split({b}, ' ')))::DOUBLE / greatest(len(list_distinct(string_split({a}, ' '))), len(list_distinct(string_split({b}, ' ')))), {PREFIX(a, b)}, list_max(flatten(list_transform(string_split({a}, ' '), lambda x: list_transform(string_split({b}, ' '), lambda y: {PREFIX('x', 'y')})))))) END"
FOUND = f"{PL}, {OBS}, {KEYS}, names AS (SELECT DISTINCT name, {NORM('name')} AS n FROM observed), scored AS (SELECT name, player_id, max(round({SIM('n', 'k')}, 4)) AS score FROM names, known GROUP BY 1, 2), found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, player_id) AS rank FROM scored WHERE score >= 0.4) WHERE rank <= 3)"


@query("id03_name_similarity", f"WITH {OBS}, x AS (SELECT track_id, {NORM('name')} AS a, 'nation 10 user' AS b FROM observed) SELECT track_id, round({SIM('a', 'b')}, 4)::DOUBLE AS score FROM x")
def _(spark, sf):
    return _observed(spark, sf).select("track_id", F.round(name_similarity(normalised_name(F.col("name")), F.lit("nation 10 user")), 4).alias("score"))


@query("id04_exact_lookup", f"WITH {PL}, {OBS}, {KEYS}, one AS (SELECT key, arg_min(player_id, {{'p': priority, 'i': player_id}}) AS player_id FROM keys WHERE kind = 'user' AND key <> '' GROUP BY 1) SELECT track_id, coalesce(player_id, '') AS player_id FROM observed LEFT JOIN one ON key = {NORM('name')}")
def _(spark, sf):
    return idn.exact_lookup(_observed(spark, sf), _players(spark, sf), "user").select("track_id", F.coalesce("player_id", F.lit("")).alias("player_id"))


@query("id05_dimension_lookup", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 2 = 0")
def _(spark, sf):
    dim = ad.table(spark, sf, "nation").where("n_nationkey % 2 = 0").selectExpr("n_nationkey AS c_nationkey", "n_name")
    return idn.dimension_lookup(ad.table(spark, sf, "customer"), dim, "c_nationkey").select("c_custkey", "n_name")


@query("id06_active_at", "WITH c AS (SELECT 'ch_' || n_nationkey AS character_id, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey END AS f, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 20 END AS t FROM nation), s AS (SELECT DISTINCT conv_id AS session_id, conv_id % 40 AS number FROM conversations) SELECT session_id, character_id FROM s, c WHERE (f IS NULL OR number >= f) AND (t IS NULL OR number <= t)")
def _(spark, sf):
    c = ad.table(spark, sf, "nation").selectExpr("concat('ch_', n_nationkey) AS character_id", "CASE WHEN n_nationkey % 3 <> 0 THEN concat('session-', n_nationkey) END AS active_from", "CASE WHEN n_nationkey % 2 = 0 THEN concat('session-', n_nationkey + 20) END AS active_to")
    return idn.active_at(c, ad.table(spark, sf, "conversations").selectExpr("conv_id AS session_id", "conv_id % 40 AS number").distinct())


@query("id07_suggestions", f"WITH {FOUND} SELECT name, player_id, score::DOUBLE AS score, rank FROM found")
def _(spark, sf):
    return idn.suggestions(_observed(spark, sf), _players(spark, sf))


@query("id08_registry_stub", f"WITH u AS (SELECT replace({NORM('c_name')}, ' ', '_') AS k, min(c_name) AS username FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1), a AS (SELECT replace({NORM('upper(c_name)')}, ' ', '_') AS k, min(upper(c_name)) AS account FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1) SELECT 'pl_' || k AS player_id, coalesce(username, '') AS username, coalesce(account, '') AS account FROM u FULL JOIN a USING (k)")
def _(spark, sf):
    c = ad.table(spark, sf, "customer")
    out = idn.registry_stub(c.where("c_custkey % 3 <> 0").selectExpr("c_name AS name"), c.where("c_custkey % 2 = 0").selectExpr("upper(c_name) AS name"))
    return out.na.fill("", ["username", "account"])


BIND = f"""{FOUND}, t AS (SELECT *, {NORM('name')} AS n FROM observed), t1 AS (SELECT t.session_id, t.track_id, p.player_id, 1 AS tier FROM t JOIN players p ON t.user_id = p.user_id), r AS (SELECT * FROM t WHERE track_id NOT IN (SELECT track_id FROM t1)),
eq AS (SELECT session_id, track_id, min(player_id) AS player_id, count(DISTINCT player_id) AS c FROM r JOIN (SELECT DISTINCT key, player_id FROM keys WHERE kind = 'user' AND key <> '') ON key = n GROUP BY 1, 2), t2 AS (SELECT session_id, track_id, player_id, 2 FROM eq WHERE c = 1),
top AS (SELECT name, arg_min(player_id, rank) AS player_id, max(score) AS s, max(score) - coalesce(min(CASE WHEN rank = 2 THEN score END), 0) AS lead FROM found WHERE rank <= 2 GROUP BY 1), t3 AS (SELECT r.session_id, r.track_id, top.player_id, 3 FROM r JOIN top USING (name) WHERE r.track_id NOT IN (SELECT track_id FROM eq) AND s >= 0.8 AND round(lead, 6) >= 0.05),
claims AS (SELECT *, row_number() OVER (PARTITION BY session_id, player_id ORDER BY tier, track_id) AS f FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3))"""


@query("id09_bind_tracks", f"WITH {BIND} SELECT o.session_id, o.track_id, CASE WHEN f = 1 THEN player_id ELSE '' END AS player_id, CASE WHEN f = 1 THEN tier ELSE 0 END AS tier, CASE WHEN f IS NULL THEN 'no_match' WHEN f > 1 THEN 'player_taken' ELSE 'matched' END AS reason FROM observed o LEFT JOIN claims USING (session_id, track_id)")
def _(spark, sf):
    return idn.bind_tracks(_observed(spark, sf), _players(spark, sf)).na.fill("", ["player_id"]).na.fill(0, ["tier"])


@query("id10_merged_candidates", f"WITH {FOUND}, m AS (SELECT track_id % 100 AS track_id, player_id, max(score) AS score FROM observed JOIN found USING (name) GROUP BY 1, 2) SELECT * FROM (SELECT track_id, player_id, score::DOUBLE AS score, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, player_id) AS rank FROM m) WHERE rank <= 3")
def _(spark, sf):
    o = _observed(spark, sf)
    return idn.merged_candidates(o.select("name", (F.col("track_id") % 100).alias("track_id")), idn.suggestions(o, _players(spark, sf)))


@query("id11_participants", "WITH t AS (SELECT o_custkey AS session_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS track_index, o_orderpriority AS name FROM orders), p AS (SELECT session_id, track_index + 1 AS index, upper(name) AS participant FROM t WHERE track_index % 2 = 0), n AS (SELECT session_id, lower(participant) AS l, min(participant) AS n FROM p GROUP BY 1, 2) SELECT t.session_id, t.track_index, coalesce(i.participant, n.n, '') AS participant FROM t LEFT JOIN p i ON i.session_id = t.session_id AND i.index = t.track_index LEFT JOIN n ON n.session_id = t.session_id AND n.l = lower(t.name)")
def _(spark, sf):
    from pyspark.sql import Window as W

    t = ad.table(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("track_index"), F.col("o_orderpriority").alias("name"))
    p = t.where("track_index % 2 = 0").selectExpr("session_id", "track_index + 1 AS index", "upper(name) AS participant")
    return idn.associate_participants(t, p).select("session_id", "track_index", F.coalesce("participant", F.lit("")).alias("participant"))


@query("id12_integrity", f"WITH {PL} SELECT 'no_identity' AS problem, player_id AS id FROM players WHERE username IS NULL AND account IS NULL AND user_id IS NULL UNION ALL SELECT 'duplicate_character', 'x' || (s_nationkey % 50) FROM supplier GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'duplicate_npc', 'x' || (c_nationkey * 2) FROM customer GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'character_and_npc', id FROM (SELECT 'x' || (s_nationkey % 50) AS id FROM supplier INTERSECT SELECT 'x' || (c_nationkey * 2) FROM customer)")
def _(spark, sf):
    return idn.integrity_problems(_players(spark, sf), ad.table(spark, sf, "supplier").selectExpr("concat('x', s_nationkey % 50) AS character_id"), ad.table(spark, sf, "customer").selectExpr("concat('x', c_nationkey * 2) AS npc_id"))


@query("id13_worklist", f"WITH {OBS}, o AS (SELECT DISTINCT 'track' AS kind, name FROM observed WHERE user_id IS NULL UNION ALL SELECT DISTINCT 'account', 'a' || (event_id % 37) FROM events WHERE event_id % 3 = 0) SELECT kind, name, row_number() OVER (PARTITION BY kind ORDER BY name) AS ord FROM o")
def _(spark, sf):
    rolls = ad.table(spark, sf, "events").selectExpr("concat('a', event_id % 37) AS name", "CASE WHEN event_id % 3 <> 0 THEN 'p' END AS player_id")
    return idn.worklist(_observed(spark, sf).withColumn("player_id", F.col("user_id")), rolls)


@query("id14_apply_mappings", f"WITH {PL}, d AS (SELECT c_name AS name, 'pl_' || c_nationkey AS player_id FROM customer) SELECT player_id, coalesce(string_agg(name, ',' ORDER BY name), '') AS hints FROM players LEFT JOIN d USING (player_id) GROUP BY 1")
def _(spark, sf):
    p = _players(spark, sf).withColumn("hints", F.array().cast("array<string>"))
    d = ad.table(spark, sf, "customer").selectExpr("c_name AS name", "concat('pl_', c_nationkey) AS player_id")
    return idn.apply_mappings(p, d).select("player_id", F.array_join("hints", ",").alias("hints"))


@query("id15_insert_absent", "SELECT 'n' || n_nationkey AS npc_id FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT 'n' || c_nationkey FROM customer")
def _(spark, sf):
    return idn.insert_absent(ad.table(spark, sf, "nation").where("n_nationkey % 2 = 0").selectExpr("concat('n', n_nationkey) AS npc_id"), ad.table(spark, sf, "customer").selectExpr("concat('n', c_nationkey) AS npc_id"), "npc_id")


TERMS = "terms AS (SELECT item_id AS ord, regexp_extract(text, '^\\s*([A-Za-z]+)', 1) AS term FROM benchmark UNION ALL SELECT 100000 + n_nationkey, n_name || '  x' FROM nation), clean AS (SELECT ord, trim(regexp_replace(term, '\\s+', ' ', 'g')) AS term FROM terms), dict AS (SELECT folded, term, row_number() OVER (ORDER BY folded, term) AS place FROM (SELECT lower(term) AS folded, arg_min(term, {'o': ord, 't': term}) AS term FROM clean WHERE term <> '' GROUP BY 1))"


def _dictionary(spark, sf):
    terms = ad.table(spark, sf, "benchmark").selectExpr("item_id AS ord", r"regexp_extract(text, '^\\s*([A-Za-z]+)', 1) AS term").unionByName(ad.table(spark, sf, "nation").selectExpr("CAST(100000 + n_nationkey AS BIGINT) AS ord", "concat(n_name, '  x') AS term"))
    return idn.term_dictionary(terms)


@query("id16_term_dictionary", f"WITH {TERMS} SELECT folded, term, place FROM dict")
def _(spark, sf):
    return _dictionary(spark, sf)


@query("id17_budgeted_prefix", f"WITH {TERMS}, r AS (SELECT place % 3 AS g, place, term, sum(length(term) + 2) OVER (PARTITION BY place % 3 ORDER BY place) - 2 AS s FROM dict) SELECT g, string_agg(term, ', ' ORDER BY place) AS prompt FROM r WHERE s <= 120 GROUP BY 1")
def _(spark, sf):
    return idn.budgeted_prefix(_dictionary(spark, sf).withColumn("g", F.col("place") % 3), 120, ["g"])


# Lexical evidence.
U = ad.UTTERANCES
LEX = [("intent", "in", 1.5, "the"), ("intent", "in", 0.5, "and the"), ("table", "out", 2.0, "of"), ("table", "out", 1.0, "in the of"), ("name", "in", 0.25, "de la"), ("vocative", "in", 0.5, "la"), ("vocative", "out", 0.5, "of the"), ("phrase", "out", 0.75, "and the of in"), ("broken", "sideways", -1.0, " ")]
LEXSQL = "lex AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{p}', {w}::DOUBLE, '{t}')" for c, p, w, t in LEX) + ") v(class, polarity, weight, term))"
TOK = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _lex(spark):
    return spark.createDataFrame(LEX, "class string, polarity string, weight double, term string")


def _texts(spark, sf):
    return ad.utterances(spark, sf).withColumnRenamed("utt_id", "id")


@query("txt01_normalised_text")
def _(spark, sf):
    ship_package(spark)
    return ad.utterances(spark, sf).select("session_id", "utt_id", lx.normalised_text(F.col("text")).alias("text"))


WORDS_SAID = "CASE event_id % 6 WHEN 0 THEN small WHEN 1 THEN tens || ' ' || small WHEN 2 THEN small || ' hundred and ' || tens WHEN 3 THEN 'and ' || small || ' and' WHEN 4 THEN (event_id * 7)::VARCHAR ELSE small || ' dragons' END"


@query("txt02_spoken_number", f"WITH x AS (SELECT event_id, list_extract({lx.SMALL_NUMBERS}, (event_id % 20 + 1)::INT) AS small, event_id % 20 AS s, list_extract({lx.TENS}, (event_id % 8 + 1)::INT) AS tens, 10 * (event_id % 8 + 2) AS t FROM events) SELECT event_id, {WORDS_SAID} AS said, CASE event_id % 6 WHEN 0 THEN s WHEN 1 THEN t + s WHEN 2 THEN CASE WHEN s > 0 THEN 100 * s + t ELSE -1 END WHEN 3 THEN s WHEN 4 THEN event_id * 7 ELSE -1 END AS number FROM x")
def _(spark, sf):
    pick = lambda words, i: F.element_at(F.array(*map(F.lit, words)), i.cast("int") + 1)
    x = ad.table(spark, sf, "events").withColumn("small", pick(lx.SMALL_NUMBERS, F.col("event_id") % 20)).withColumn("tens", pick(lx.TENS, F.col("event_id") % 8))
    x = x.withColumn("said", F.expr(WORDS_SAID.replace("(event_id * 7)::VARCHAR", "CAST(event_id * 7 AS STRING)")))
    return x.select("event_id", "said", F.coalesce(lx.spoken_number(F.split("said", " ")), F.lit(-1)).alias("number"))


@query("txt03_rule_table", f"""WITH {LEXSQL}, d AS (SELECT class, max(weight) AS weight, CASE class WHEN 'table' THEN 'ooc' WHEN 'story' THEN 'ic' END AS polarity, list(DISTINCT term) AS terms FROM lex GROUP BY 1),
o AS (SELECT 'w' || n_regionkey || CASE n_regionkey WHEN 1 THEN '_ic' ELSE '' END AS class, max(n_nationkey)::DOUBLE AS weight, NULL::VARCHAR AS polarity, list(DISTINCT n_name) AS terms FROM nation GROUP BY 1 UNION ALL SELECT 'table', 9.0, 'ic', ['of', 'dice'] UNION ALL SELECT 'proper_noun', 2.5, 'ooc', ['gone']),
r AS (SELECT class, coalesce(o.weight, d.weight) AS weight, CASE WHEN o.class IS NULL THEN d.polarity ELSE o.polarity END AS polarity, list_distinct(coalesce(d.terms, []) || coalesce(o.terms, [])) AS terms FROM d FULL JOIN o USING (class)),
n AS (SELECT 'glossary' AS class, 0.45 AS usual, (SELECT list(DISTINCT r_name) FROM region) AS terms UNION ALL SELECT 'proper_noun', 0.35, (SELECT list(DISTINCT n_name) FROM nation WHERE n_nationkey % 2 = 0) UNION ALL SELECT 'vocative', 0.3, (SELECT list(DISTINCT n_name) FROM nation WHERE n_nationkey % 2 = 1))
SELECT class, weight, coalesce(polarity, CASE WHEN regexp_matches(class, '(?i)(^|[_-])ic($|[_-])') THEN 'ic' ELSE 'ooc' END) AS polarity, array_to_string(list_sort(terms), ',') AS terms FROM (SELECT * FROM r WHERE class NOT IN (SELECT class FROM n) UNION ALL SELECT n.class, coalesce(r.weight, usual), 'ic', n.terms FROM n LEFT JOIN r USING (class))""")
def _(spark, sf):
    d = _lex(spark).groupBy("class").agg(F.max("weight").alias("weight"), F.collect_set("term").alias("terms")).withColumn("polarity", F.expr("CASE class WHEN 'table' THEN 'ooc' WHEN 'story' THEN 'ic' END"))
    nation = ad.table(spark, sf, "nation")
    o = nation.groupBy(F.expr("concat('w', n_regionkey, CASE n_regionkey WHEN 1 THEN '_ic' ELSE '' END)").alias("class")).agg(F.max("n_nationkey").cast("double").alias("weight"), F.collect_set("n_name").alias("terms")).withColumn("polarity", F.lit(None).cast("string"))
    o = o.unionByName(spark.sql("SELECT 'table' AS class, 9.0D AS weight, 'ic' AS polarity, array('of', 'dice') AS terms UNION ALL SELECT 'proper_noun', 2.5D, 'ooc', array('gone')"))
    names = ad.table(spark, sf, "region").selectExpr("'glossary' AS class", "r_name AS term").unionByName(nation.selectExpr("CASE WHEN n_nationkey % 2 = 0 THEN 'proper_noun' ELSE 'vocative' END AS class", "n_name AS term"))
    return lx.rule_table(d, o, names).withColumn("terms", F.array_join("terms", ","))


@query("txt04_lexicon_issues", "WITH l AS (SELECT p_type AS class, p_name AS term, p_size - 5.0 AS weight, CASE WHEN p_partkey % 3 = 0 THEN 'in' WHEN p_partkey % 3 = 1 THEN 'out' ELSE '?' END AS polarity FROM part) SELECT class, term, 'bad_weight' AS issue FROM l WHERE weight < 0 UNION ALL SELECT class, term, 'bad_polarity' FROM l WHERE polarity = '?' UNION ALL SELECT class, term, 'empty_term' FROM l WHERE trim(term) = ''")
def _(spark, sf):
    return lx.lexicon_issues(ad.table(spark, sf, "part").selectExpr("p_type AS class", "p_name AS term", "CAST(p_size - 5 AS DOUBLE) AS weight", "CASE WHEN p_partkey % 3 = 0 THEN 'in' WHEN p_partkey % 3 = 1 THEN 'out' ELSE '?' END AS polarity"))


MARK = f"{U}, {LEXSQL}, tk AS (SELECT utt_id AS id, text, {TOK('text')} AS t FROM utterances), g AS (SELECT id, n, unnest(range(0, len(t) - n + 1)) AS pos, t, text FROM tk, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(t) >= n), marks AS (SELECT DISTINCT id, class, polarity, weight, term, pos FROM g JOIN lex ON array_to_string({TOK('term')}, ' ') = array_to_string(t[pos + 1:pos + n], ' ') AND (class <> 'vocative' OR regexp_matches(text, '(?i)(?:^|[,!?;])\\s*' || term || '\\s*[,!?:]')))"


@query("txt05_phrase_markers", f"WITH {MARK} SELECT * FROM marks")
def _(spark, sf):
    return lx.phrase_markers(_texts(spark, sf), _lex(spark))


@query("txt06_real_names", f"WITH {U}, pl AS (SELECT DISTINCT player_id AS owner, regexp_extract(lower(text), '([a-z]{{3,}})', 1) AS token FROM utterances WHERE source_index = 0), tk AS (SELECT utt_id AS id, player_id, {TOK('text')} AS t FROM utterances), w AS (SELECT id, player_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM tk) SELECT id, owner, pos FROM w JOIN pl USING (token) WHERE player_id <> owner AND token NOT IN ('the', 'and') AND token <> ''")
def _(spark, sf):
    u = _texts(spark, sf)
    players = u.where("source_index = 0").select("player_id", F.regexp_extract(F.lower("text"), "([a-z]{3,})", 1).alias("display_name")).distinct().where("display_name <> ''")
    return lx.real_name_markers(u, players, spark.createDataFrame([("the and",)], "name string"))


@query("txt07_roll_totals", f"WITH {U}, {ad.ROLLS}, n AS (SELECT session_id, utt_id, CASE WHEN source_index % 3 <> 2 THEN source_index * 7 % 90 END AS number, (start_ms + end_ms) / 2000.0::DOUBLE AS mid_s FROM utterances), c AS (SELECT n.session_id, n.utt_id, n.number, count(r.roll_id) AS n, min(r.roll_id) AS one FROM n LEFT JOIN rolls r ON r.session_id = n.session_id AND r.total % 10 = n.number % 10 AND abs(r.t_s - n.mid_s) <= CASE WHEN roll_id % 8 < 7 THEN 0.5 * 2 ** (roll_id % 8) ELSE 1.5 END GROUP BY 1, 2, 3) SELECT session_id, utt_id, n, CASE WHEN n = 1 THEN one END AS roll_id, CASE WHEN number IS NULL THEN 'not_numeric_only' WHEN n = 0 THEN 'no_aligned_roll' WHEN n = 1 THEN 'matched_roll_total' ELSE 'ambiguous_roll' END AS reason FROM c")
def _(spark, sf):
    """Numbers by their last digit, so that many meet; each roll with an uncertainty of its own, from half a second to half a minute, or none."""
    n = ad.utterances(spark, sf).selectExpr("session_id", "utt_id", "CASE WHEN source_index % 3 <> 2 THEN source_index * 7 % 90 % 10 END AS number", "(start_ms + end_ms) / 2000.0D AS mid_s")
    rolls = ad.rolls(spark, sf).selectExpr("session_id", "roll_id", "total % 10 AS total", "t_s", "CASE WHEN roll_id % 8 < 7 THEN 0.5D * pow(2, roll_id % 8) END AS uncertainty_s")
    return lx.roll_total_evidence(n, rolls)


@query("txt08_polarity_scores", f"WITH {MARK}, s AS (SELECT id, coalesce(sum(weight) FILTER (polarity = 'in'), 0) AS i, coalesce(sum(weight) FILTER (polarity = 'out'), 0) AS o, count(*) AS n FROM marks GROUP BY 1) SELECT id, round(coalesce(i, 0), 6) AS in_score, round(coalesce(o, 0), 6) AS out_score, round(coalesce(i, 0) / greatest(1.0, coalesce(i, 0) + coalesce(o, 0)), 6) AS share, round(coalesce(n, 0)::DOUBLE / greatest(1, len(t)), 6) AS density FROM tk LEFT JOIN s USING (id)")
def _(spark, sf):
    return lx.polarity_scores(_texts(spark, sf), lx.phrase_markers(_texts(spark, sf), _lex(spark)))


QUOTED = f"""{U}, qw AS MATERIALIZED (SELECT session_id, utt_id, i - 1 AS pos, CASE WHEN (i - 1) % 5 = 1 THEN '"' || l[i] WHEN (i - 1) % 5 = 3 THEN l[i] || '"' ELSE l[i] END AS t FROM (SELECT session_id, utt_id, string_split(text, ' ') AS l, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM utterances)),
st AS (SELECT session_id, utt_id, 0::BIGINT AS k, -1::BIGINT AS open, -1::BIGINT AS first FROM (SELECT DISTINCT session_id, utt_id FROM qw) UNION ALL
  SELECT session_id, utt_id, k + 1, CASE WHEN shut THEN -1 ELSE at_ END, CASE WHEN shut THEN at_ ELSE -1 END FROM (SELECT *, at_ >= 0 AND regexp_matches(regexp_replace(t, '[.,!?;:]+$', ''), '.["”]$') AS shut FROM (SELECT s.session_id, s.utt_id, s.k, w.t, CASE WHEN s.open >= 0 THEN s.open WHEN t[1] IN ('"', '“') THEN w.pos ELSE -1 END AS at_ FROM st s JOIN qw w ON w.session_id = s.session_id AND w.utt_id = s.utt_id AND w.pos = s.k)))"""


@query("txt09_quoted_spans", f"WITH RECURSIVE {QUOTED} SELECT session_id, utt_id, first, k - 1 AS last FROM st WHERE first >= 0")
def _(spark, sf):
    w = ad.utterances(spark, sf).select("session_id", "utt_id", F.transform(F.split("text", " "), lambda x, i: F.when(i % 5 == 1, F.concat(F.lit('"'), x)).when(i % 5 == 3, F.concat(x, F.lit('"'))).otherwise(x)).alias("w"))
    return w.select("session_id", "utt_id", F.explode(lx.quoted_spans(F.col("w"))).alias("s")).select("session_id", "utt_id", F.col("s.first").cast("long").alias("first"), F.col("s.last").cast("long").alias("last"))


@query("txt10_numbers", "WITH x AS (SELECT event_id, 'roll ' || event_id % 20 || ' and ' || user_id || ' then ' || event_id % 20 AS t FROM events) SELECT event_id, CASE WHEN event_id % 20 = split_part(t, ' ', 4)::INT THEN (event_id % 20)::VARCHAR ELSE (event_id % 20) || ',' || split_part(t, ' ', 4) END AS numbers FROM x")
def _(spark, sf):
    x = ad.table(spark, sf, "events").selectExpr("event_id", "concat('roll ', event_id % 20, ' and ', user_id, ' then ', event_id % 20) AS t")
    return x.select("event_id", F.array_join(lx.numbers_mentioned(F.col("t")), ",").alias("numbers"))
