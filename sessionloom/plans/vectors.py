"""Queries on vectors, profiles and calibration, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as ca
from ..operators import vectors as vec
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


V = "v AS (SELECT vec_id AS id, vec_id // 64 AS session_id, vec_id % 4 AS player_id, 'c' || label AS character_id, embedding::DOUBLE[] AS vector, (vec_id % 30) / 10.0::DOUBLE AS duration_s, vec_id % 2 AS ooc, (vec_id // 2) % 2 AS roll_prox FROM embeddings)"


def _v(spark, sf):
    return ad.table(spark, sf, "embeddings").selectExpr("vec_id AS id", "vec_id DIV 64 AS session_id", "vec_id % 4 AS player_id", "concat('c', label) AS character_id", "transform(embedding, x -> CAST(x AS DOUBLE)) AS vector", "(vec_id % 30) / 10.0D AS duration_s", "vec_id % 2 AS ooc", "(vec_id DIV 2) % 2 AS roll_prox")


@query("vec01_l2_normalised", f"WITH {V} SELECT id, round(list_sum(list_transform(vector, lambda x: abs(x))) / sqrt(list_inner_product(vector, vector)), 5) AS l1, round(vector[1] / sqrt(list_inner_product(vector, vector)), 5) AS first FROM v")
def _(spark, sf):
    u = _v(spark, sf).select("id", vec.l2_normalised(F.col("vector"), 64).alias("u"))
    return u.select("id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + F.abs(x)), 5).alias("l1"), F.round(F.col("u")[0], 5).alias("first"))


@query("vec02_z_scores", "WITH x AS (SELECT vec_id AS id, vec_id % 4 AS p, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings) SELECT id, round((a - avg(a) OVER (PARTITION BY p)) / stddev_pop(a) OVER (PARTITION BY p), 5) AS a_z, round((b - avg(b) OVER (PARTITION BY p)) / stddev_pop(b) OVER (PARTITION BY p), 5) AS b_z FROM x")
def _(spark, sf):
    x = _v(spark, sf).select("id", "player_id", F.col("vector")[0].alias("a"), F.col("vector")[1].alias("b"))
    return vec.z_scores(x, ["a", "b"], ["player_id"]).select("id", F.round("a_z", 5).alias("a_z"), F.round("b_z", 5).alias("b_z"))


@query("vec03_incomplete_features", "WITH u AS (SELECT vec_id AS utt_id, (vec_id % 30) / 10.0 AS d FROM embeddings), f AS (SELECT vec_id AS utt_id, CASE WHEN vec_id % 9 = 0 THEN NULL ELSE 1 END AS x, CASE WHEN vec_id % 13 = 0 THEN NULL ELSE 1 END AS p FROM embeddings WHERE vec_id % 7 <> 0 UNION ALL SELECT vec_id, 1, 1 FROM embeddings WHERE vec_id % 11 = 0 AND vec_id % 7 <> 0), g AS (SELECT utt_id, count(*) AS n, max((x IS NULL)::INT) AS bad, max((p IS NULL)::INT) AS nobody FROM f GROUP BY 1), r AS (SELECT utt_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' WHEN nobody = 1 THEN 'no_player' WHEN bad = 1 AND d >= 0.6 THEN 'not_finite' END AS problem FROM u LEFT JOIN g USING (utt_id)) SELECT * FROM r WHERE problem IS NOT NULL")
def _(spark, sf):
    e = ad.table(spark, sf, "embeddings")
    f = e.where("vec_id % 7 <> 0").selectExpr("vec_id AS utt_id", "CASE WHEN vec_id % 9 <> 0 THEN 1.0D END AS x", "CASE WHEN vec_id % 13 <> 0 THEN 1 END AS player_id").unionByName(e.where("vec_id % 11 = 0 AND vec_id % 7 <> 0").selectExpr("vec_id AS utt_id", "1.0D AS x", "1 AS player_id"))
    return vec.incomplete_features(e.selectExpr("vec_id AS utt_id", "(vec_id % 30) / 10.0D AS duration_s"), f, ["x"])


@query("vec04_cosine", f"WITH {V}, p AS (SELECT id, vector AS a, lead(vector) OVER (ORDER BY id) AS b FROM v) SELECT id, round(list_cosine_similarity(a, b), 5) AS similarity FROM p WHERE b IS NOT NULL")
def _(spark, sf):
    v = _v(spark, sf)
    n = v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("b"))
    return v.join(n, "id").select("id", F.round(vec.cosine(F.col("vector"), F.col("b")), 5).alias("similarity"))


@query("vec05_representation", f"WITH {V} SELECT id, len(vector) + 2 AS n, round(list_sum(vector) + 0.35 * (duration_s + ooc), 5) AS total FROM v")
def _(spark, sf):
    r = _v(spark, sf).select("id", vec.representation(F.col("vector"), [F.col("duration_s"), F.col("ooc").cast("double")]).alias("r"))
    return r.select("id", F.size("r").cast("long").alias("n"), F.round(F.aggregate("r", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("vec06_cluster")
def _(spark, sf):
    ship_package(spark)
    return vec.cluster(_v(spark, sf), ["session_id", "player_id"])


STATS = f"{V}, m AS (SELECT *, id // 4 % 3 AS cluster FROM v), stats AS (SELECT session_id, player_id, cluster, count(*) AS n, round(sum(duration_s), 6) AS airtime_s, round(sum(duration_s * (1 + ooc + roll_prox)), 6) AS table_score, session_id || ':' || player_id || ':v' || cluster AS cluster_id FROM m GROUP BY 1, 2, 3)"


def _stats(spark, sf):
    return vec.cluster_stats(_v(spark, sf).withColumn("cluster", F.expr("id DIV 4 % 3")), ["session_id", "player_id"])


@query("vec07_cluster_stats", f"WITH {STATS} SELECT * FROM stats")
def _(spark, sf):
    return _stats(spark, sf)


@query("vec08_default_voice", f"WITH {STATS} SELECT session_id, player_id, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, player_id ORDER BY table_score DESC, cluster_id) AS r FROM stats) WHERE r = 1")
def _(spark, sf):
    return vec.default_voice(_stats(spark, sf), ["session_id", "player_id"]).select("session_id", "player_id", "cluster_id")


MEAN = lambda src, keys, name: f"{name} AS (SELECT {keys}, list(x ORDER BY p) AS centroid FROM (SELECT {keys}, p, avg(x) AS x FROM (SELECT {keys}, unnest(vector) AS x, generate_subscripts(vector, 1) AS p FROM {src}) GROUP BY ALL) GROUP BY ALL)"
MATCH = f"{V}, even AS (SELECT character_id AS profile_id, vector FROM v WHERE id % 2 = 0), odd AS (SELECT character_id || ':' || player_id AS cluster_id, vector FROM v WHERE id % 2 = 1), {MEAN('even', 'profile_id', 'profiles')}, {MEAN('odd', 'cluster_id', 'clusters')}, met AS (SELECT cluster_id, profile_id, round(list_cosine_similarity(c.centroid, p.centroid), 6) AS similarity FROM clusters c, profiles p), matches AS (SELECT *, row_number() OVER w AS rank, round(similarity - lead(similarity, 1, 0.0) OVER w, 6) AS margin FROM met WINDOW w AS (PARTITION BY cluster_id ORDER BY similarity DESC, profile_id))"


def _profiles(spark, sf):
    return vec.centroids(_v(spark, sf).where("id % 2 = 0").withColumnRenamed("character_id", "profile_id"), ["profile_id"])


def _clusters(spark, sf):
    return vec.centroids(_v(spark, sf).where("id % 2 = 1").withColumn("cluster_id", F.concat_ws(":", "character_id", "player_id")), ["cluster_id"])


@query("vec09_match_profiles", f"WITH {MATCH} SELECT cluster_id, profile_id, round(similarity, 4) AS similarity, rank, rank = 1 AND similarity >= 0.78 AND margin >= 0.08 AS labelled FROM matches")
def _(spark, sf):
    return vec.match_profiles(_clusters(spark, sf), _profiles(spark, sf)).select("cluster_id", "profile_id", F.round("similarity", 4).alias("similarity"), "rank", "labelled")


@query("vec10_unlabelled", f"WITH {MATCH}, l AS (SELECT cluster_id, max((rank = 1 AND similarity >= 0.95 AND margin >= 0.08)::INT) AS l FROM matches WHERE cluster_id <> 'c1:1' GROUP BY 1) SELECT cluster_id, CASE WHEN l IS NULL THEN 'no_profiles' ELSE 'no_match' END AS reason FROM clusters LEFT JOIN l USING (cluster_id) WHERE coalesce(l, 0) = 0")
def _(spark, sf):
    c = _clusters(spark, sf)
    return vec.unlabelled(c, vec.match_profiles(c, _profiles(spark, sf), 0.95).where("cluster_id <> 'c1:1'"))


@query("vec11_seed_profiles", f"WITH {V}, l AS (SELECT * FROM v WHERE character_id NOT IN ('c0', 'c1')), {MEAN('l', 'player_id, character_id', 'm')} SELECT player_id, character_id, n, sessions, round(list_sum(centroid), 5) AS total FROM m JOIN (SELECT player_id, character_id, count(*) AS n, string_agg(DISTINCT session_id::VARCHAR, ',' ORDER BY session_id::VARCHAR) AS sessions FROM l GROUP BY 1, 2) USING (player_id, character_id)")
def _(spark, sf):
    v = _v(spark, sf).withColumn("session_id", F.col("session_id").cast("string"))
    seeded = vec.seed_profiles(v, v.where("character_id IN ('c0', 'c1')").select("player_id", "character_id").distinct())
    return seeded.select("player_id", "character_id", "n", F.array_join("sessions", ",").alias("sessions"), F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("vec12_update_profiles", f"WITH {V}, even AS (SELECT character_id AS profile_id, vector FROM v WHERE id % 2 = 0), odd AS (SELECT character_id AS profile_id, vector FROM v WHERE id % 2 = 1 AND character_id <> 'c3'), {MEAN('even', 'profile_id', 'a')}, {MEAN('odd', 'profile_id', 'b')} SELECT profile_id, 10 + CASE WHEN b.centroid IS NULL THEN 0 ELSE 5 END AS n, 1 + CASE WHEN b.centroid IS NULL THEN 0 ELSE 1 END AS version, round(CASE WHEN b.centroid IS NULL THEN list_sum(a.centroid) ELSE 0.9 * list_sum(a.centroid) + 0.1 * list_sum(b.centroid) END, 5) AS total FROM a LEFT JOIN b USING (profile_id)")
def _(spark, sf):
    p = _profiles(spark, sf).select("profile_id", "centroid", F.lit(10).alias("n"), F.array(F.lit("s1")).alias("sessions"), F.lit(1).alias("version"))
    c = vec.centroids(_v(spark, sf).where("id % 2 = 1 AND character_id <> 'c3'").withColumnRenamed("character_id", "profile_id"), ["profile_id"]).select("profile_id", "centroid", F.lit(5).alias("n"), F.array(F.lit("s2")).alias("sessions"))
    return vec.update_profiles(p, c).select("profile_id", "n", "version", F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


JR = "j AS (SELECT o_custkey AS profile_id, o_orderkey AS entry_id, o_orderdate AS at_, round(o_totalprice * 100)::BIGINT % 1000 AS next_version, o_orderstatus FROM orders)"


@query("vec13_recover", f"WITH {JR}, i AS (SELECT profile_id, arg_max(next_version, {{'a': at_, 'e': entry_id}}) AS n FROM j WHERE o_orderstatus <> 'F' GROUP BY 1) SELECT c_custkey AS profile_id, coalesce(n, 1) AS version FROM customer LEFT JOIN i ON c_custkey = profile_id")
def _(spark, sf):
    o = ad.table(spark, sf, "orders")
    intents = o.selectExpr("o_custkey AS profile_id", "o_orderkey AS entry_id", "o_orderdate AS at", "CAST(round(o_totalprice * 100) AS BIGINT) % 1000 AS next_version", "'intent' AS kind")
    commits = o.where("o_orderstatus = 'F'").selectExpr("o_custkey AS profile_id", "o_orderkey AS entry_id", "o_orderdate AS at", "0L AS next_version", "'commit' AS kind")
    return vec.recover(ad.table(spark, sf, "customer").selectExpr("c_custkey AS profile_id", "1L AS version"), intents.unionByName(commits))


@query("vec14_valid_profiles", f"WITH {V} SELECT id FROM v WHERE id % 5 <> 0 AND id % 7 <> 0")
def _(spark, sf):
    p = _v(spark, sf).withColumn("centroid", F.expr("CASE WHEN id % 5 = 0 THEN slice(vector, 1, 63) WHEN id % 7 = 0 THEN transform(vector, x -> double('NaN')) ELSE vector END"))
    return vec.valid_profiles(p, 64).select("id")


# Calibration, on the labels of documents.
L = "l AS (SELECT doc_id AS id, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS label, CASE WHEN n_chars > 1500 OR toxic = 1 THEN 'good' ELSE 'bad' END AS predicted, source, lang, n_chars, abs(n_chars - 1500) / 1000.0::DOUBLE AS margin, (n_chars % 1000) / 1000.0::DOUBLE AS score, toxic FROM labels JOIN documents USING (doc_id))"


def _l(spark, sf):
    return ad.table(spark, sf, "labels").join(ad.table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id").selectExpr("doc_id AS id", "CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS label", "CASE WHEN n_chars > 1500 OR toxic = 1 THEN 'good' ELSE 'bad' END AS predicted", "source", "lang", "n_chars", "abs(n_chars - 1500) / 1000.0D AS margin", "(n_chars % 1000) / 1000.0D AS score", "toxic")


@query("ca01_uncertain_sample", f"WITH {L} SELECT id, score FROM l WHERE id % 3 <> 0 ORDER BY abs(score - 0.5), id LIMIT 50")
def _(spark, sf):
    return ca.uncertain_sample(_l(spark, sf), _l(spark, sf).where("id % 3 = 0"), 50).select("id", "score")


@query("ca02_stratified_sample", f"WITH {L}, k AS (SELECT *, count(*) OVER (PARTITION BY source, lang) AS n, row_number() OVER (PARTITION BY source, lang ORDER BY id) AS k, count(*) OVER () AS t FROM l) SELECT id FROM k ORDER BY round(40 * n / t - (k - 1), 9) DESC, source, lang, k LIMIT 40")
def _(spark, sf):
    return ca.stratified_sample(_l(spark, sf), ["source", "lang"], 40).select("id")


@query("ca03_feature_matrix", f"WITH {L} SELECT id, CASE WHEN id % 3 = 0 THEN 0.0 ELSE score END AS a, CASE WHEN id % 3 = 0 THEN 0.0 ELSE margin END AS b, CASE WHEN id % 3 = 0 THEN toxic::DOUBLE ELSE 0.0 END AS c FROM l")
def _(spark, sf):
    rows = _l(spark, sf).select("id", F.expr("CASE WHEN id % 3 = 0 THEN map('c', CAST(toxic AS DOUBLE)) ELSE map('a', score, 'b', margin) END").alias("features"))
    return ca.feature_matrix(rows, ["a", "b", "c"])


@query("ca04_folds", f"WITH {L} SELECT id, (row_number() OVER (ORDER BY id) - 1) % 5 AS fold FROM l")
def _(spark, sf):
    return ca.folds(_l(spark, sf)).select("id", "fold")


def _fitted(spark, sf):
    ship_package(spark)
    rows = ca.folds(_l(spark, sf).selectExpr("id", "label", "least(n_chars, 5000) / 5000.0D AS a", "CAST(toxic AS DOUBLE) AS b"))
    return rows, ca.one_vs_rest(rows, ["good", "bad"], ["a", "b"])


query("ca05_one_vs_rest")(lambda spark, sf: _fitted(spark, sf)[1])
query("ca06_predict")(lambda spark, sf: ca.predict(*_fitted(spark, sf), ["a", "b"]))


@query("ca07_class_metrics", f"WITH {L}, c AS (SELECT unnest(['good', 'bad']) AS class), t AS (SELECT class, count(*) FILTER (label = class AND predicted = class) AS tp, count(*) FILTER (predicted = class) AS pp, count(*) FILTER (label = class) AS support FROM l, c GROUP BY 1) SELECT class, round(tp / pp, 6) AS precision, round(tp / support, 6) AS recall, round(2 * (tp / pp) * (tp / support) / (tp / pp + tp / support), 6) AS f1, support FROM t")
def _(spark, sf):
    return ca.class_metrics(_l(spark, sf))


@query("ca08_threshold_sweep", f"WITH {L}, r AS (SELECT *, rank() OVER (ORDER BY margin) - 1 AS before, count(*) OVER () AS n, f AS fraction, ceil(round(f * count(*) OVER (PARTITION BY f), 9)) AS flagged FROM l, (SELECT unnest([0.25, 0.5, 0.75]) AS f)), x AS (SELECT *, (rank() OVER (PARTITION BY fraction ORDER BY margin) - 1) >= flagged AS rest FROM r) SELECT fraction::DOUBLE AS fraction, max(flagged)::BIGINT AS flagged, round(sum(CASE WHEN rest AND label <> predicted THEN 1 ELSE 0 END) / greatest(1, sum(CASE WHEN rest THEN 1 ELSE 0 END)), 6)::DOUBLE AS residual_error, round(max(CASE WHEN NOT rest THEN margin END), 6) AS cut_margin FROM x GROUP BY 1")
def _(spark, sf):
    return ca.threshold_sweep(_l(spark, sf))


@query("ca09_profile_accuracy", f"WITH {V}, even AS (SELECT character_id AS profile_id, vector FROM v WHERE id % 2 = 0), {MEAN('even', 'profile_id', 'profiles')}, b AS (SELECT id, character_id, arg_max(profile_id, {{'s': round(list_cosine_similarity(vector, centroid), 9), 'p': profile_id}}) AS nearest FROM v, profiles WHERE id % 2 = 1 GROUP BY 1, 2) SELECT count(*) AS n, round(avg((nearest = character_id)::INT), 6) AS accuracy FROM b")
def _(spark, sf):
    return ca.profile_accuracy(_v(spark, sf).where("id % 2 = 1"), _profiles(spark, sf))


@query("ca10_hold_out", f"WITH {V} SELECT id, session_id = (SELECT max(session_id) FROM v) AS held_out FROM v")
def _(spark, sf):
    return ca.hold_out(_v(spark, sf)).select("id", "held_out")


@query("ca10_hold_out_without_sessions", f"WITH {V} SELECT id, row_number() OVER (ORDER BY id) > count(*) OVER () - greatest(1, count(*) OVER () // 5) AS held_out FROM v")
def _(spark, sf):
    v = _v(spark, sf)
    return ca.hold_out(v.withColumn("session_id", F.lit(None).cast(v.schema["session_id"].dataType))).select("id", "held_out")


@query("ca11_merged_profiles", f"WITH {V} SELECT player_id, character_id, CASE WHEN character_id < 'c5' THEN -1 ELSE count(*) END AS n FROM v GROUP BY 1, 2")
def _(spark, sf):
    v = _v(spark, sf)
    old = v.where("character_id < 'c5'").select("player_id", "character_id").distinct()
    return vec.seed_profiles(v, old).select("player_id", "character_id", "n").unionByName(old.withColumn("n", F.lit(-1).cast("long")))


@query("ca12_report", f"WITH {L} SELECT count(*) AS n_labels, round(avg((label = predicted)::INT), 6) AS accuracy, CASE WHEN count(*) < 20 THEN 'need ' || (20 - count(*)) || ' more labels' ELSE 'ok' END AS message FROM l")
def _(spark, sf):
    return ca.calibration_report(_l(spark, sf), _l(spark, sf))
