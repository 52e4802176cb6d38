"""Operators on feature vectors: normalising, clustering, profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import in_blocks

# Fixed values.
STOP_DISTANCE, MATCH_LEAST, MATCH_MARGIN, KEEP = 0.28, 0.78, 0.08, 0.9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalised(a: Column, dim: int | None = None) -> Column:
    """The vector at length 1; a zero, non-finite or wrongly sized one fails the query. (VEC-01)"""
    n = norm(a)
    fine = n.isNotNull() & ~F.isnan(n) & (n > 0) & (n < float("inf")) & ((F.size(a) == dim) if dim else F.lit(True))
    checked = F.when(fine, n).otherwise(F.raise_error(F.lit("vector without a length")).cast("double"))
    return F.transform(a, lambda x: x.cast("double") / checked)


def z_scores(features: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """Each field as deviations from its group's mean; 0 where the group doesn't vary. (VEC-02)

    Means and deviations combine on the map side, so a group of any size is no hot key.
    """
    stats = features.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(*[x for f in fields for x in (F.avg(f).alias(f"_avg_{f}"), F.stddev_pop(f).alias(f"_std_{f}"))])
    out = features.join(stats, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    z = lambda f: F.when(F.col(f"_std_{f}") <= 1e-12, F.lit(0.0)).otherwise((F.col(f) - F.col(f"_avg_{f}")) / F.col(f"_std_{f}"))
    return out.select(*features.columns, *[z(f).alias(f"{f}_z") for f in fields])


def incomplete_features(utterances: DataFrame, features: DataFrame, fields: list[str], shortest: float = 0.6) -> DataFrame:
    """(utt_id, problem): utterances without one complete feature row. (VEC-03)"""
    bad = F.lit(False)
    for f in fields:
        bad = bad | F.col(f).isNull() | F.isnan(f)
    held = features.groupBy("utt_id").agg(F.count("*").alias("n"), F.max(bad.cast("int")).alias("bad"), F.max(F.col("player_id").isNull().cast("int")).alias("nobody"))
    both = utterances.select("utt_id", "duration_s").join(held, "utt_id", "left")
    problem = F.when(F.coalesce("n", F.lit(0)) == 0, "missing").when(F.col("n") > 1, "repeated").when(F.col("nobody") == 1, "no_player").when((F.col("bad") == 1) & (F.col("duration_s") >= shortest), "not_finite")
    return both.select("utt_id", problem.alias("problem")).where("problem IS NOT NULL")


def cosine(a: Column, b: Column, none: float = 0.0) -> Column:
    """Cosine similarity; ``none`` if a length is 0 or the sizes differ. (VEC-04)"""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (n == 0) | n.isNull(), F.lit(none)).otherwise(dot(a, b) / n)


def representation(embedding: Column, prosody: list[Column], weight: float = 0.35) -> Column:
    """The embedding and the weighted prosody fields as one vector. (VEC-05)"""
    return F.concat(F.transform(embedding, lambda x: x.cast("double")), F.transform(F.array(*prosody), lambda x: x * weight))


def agglomerate(vectors: np.ndarray, stop: float = STOP_DISTANCE) -> np.ndarray:
    """Cluster number of each vector: the two nearest centroids merge until the nearest are further apart than ``stop``.

    The lowest (left, right) pair wins ties.
    """
    n = len(vectors)
    owner, centroid, size, alive = np.arange(n), vectors.astype(float).copy(), np.ones(n), np.ones(n, bool)
    unit = centroid / np.maximum(np.linalg.norm(centroid, axis=1), 1e-300)[:, None]
    # the nearest centroid to the right of each; memory grows with the vectors, not with their square
    nearest, apart = np.full(n, -1), np.full(n, np.inf)

    def look(i: int) -> None:
        apart[i] = np.inf
        row = np.where(alive[i + 1 :], np.round(1 - unit[i + 1 :] @ unit[i], 12), np.inf)
        if len(row):
            nearest[i] = i + 1 + row.argmin()
            apart[i] = row.min()

    for i in range(n):
        look(i)
    while n:
        a = int(apart.argmin())
        if not apart[a] <= stop:
            break
        b = int(nearest[a])
        centroid[a] = (centroid[a] * size[a] + centroid[b] * size[b]) / (size[a] + size[b])
        unit[a] = centroid[a] / max(np.linalg.norm(centroid[a]), 1e-300)
        size[a] += size[b]
        alive[b], apart[b] = False, np.inf
        owner[owner == b] = a
        row = np.round(1 - unit[:a] @ unit[a], 12)
        stale = alive & ((nearest == a) | (nearest == b))
        nearer = alive[:a] & ~stale[:a] & ((row < apart[:a]) | ((row == apart[:a]) & (a < nearest[:a])))
        nearest[:a][nearer], apart[:a][nearer] = a, row[nearer]
        stale[a] = True
        for i in np.flatnonzero(stale):
            look(i)
    return np.unique(owner, return_inverse=True)[1]


def cluster(vectors: DataFrame, keys: list[str], stop: float = STOP_DISTANCE) -> DataFrame:
    """(keys, id, cluster): the vectors of each group clustered. (VEC-06)

    Each merge depends on all before it, so a group, one speaker in one
    session, is clustered in one task, in memory that grows with its vectors.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        return pdf[[*keys, "id"]].assign(cluster=agglomerate(np.stack(pdf["vector"].to_numpy()), stop).astype("int64"))

    types = dict(vectors.dtypes)
    return vectors.select(*keys, "id", "vector").groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in [*keys, "id"]) + ", cluster long")


def centroids(members: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """(keys, centroid): the mean vector of each group, by position. (part of VEC-07 and VEC-11)"""
    flat = members.select(*keys, F.posexplode(vector).alias("_p", "_x"))
    mean = flat.groupBy(*keys, "_p").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    return mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_x"))), lambda s: s["_x"]).alias("centroid"))


def cluster_stats(members: DataFrame, keys: list[str]) -> DataFrame:
    """Per cluster: id, members, airtime, table score. (VEC-07)"""
    by = [*keys, "cluster"]
    sums = members.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.sum("duration_s"), 6).alias("airtime_s"), F.round(F.sum(F.col("duration_s") * (1 + F.col("ooc") + F.col("roll_prox"))), 6).alias("table_score"))
    return sums.withColumn("cluster_id", F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.concat(F.lit("v"), "cluster")))


def default_voice(stats: DataFrame, keys: list[str]) -> DataFrame:
    """The cluster with the highest table score of each group, then by id. (VEC-08)"""
    w = W.partitionBy(*keys).orderBy(F.desc("table_score"), "cluster_id")
    return stats.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def match_profiles(clusters: DataFrame, profiles: DataFrame, least: float = MATCH_LEAST, margin: float = MATCH_MARGIN) -> DataFrame:
    """(cluster_id, profile_id, similarity, margin, rank, labelled). (VEC-09)

    The margin is to the next profile, or to 0 for the last. Profiles are met
    in blocks.
    """
    p = profiles.select("profile_id", F.col("centroid").alias("_c"))
    met = in_blocks(clusters.select("cluster_id", "centroid"), p, "profile_id").withColumn("similarity", F.round(cosine(F.col("centroid"), F.col("_c")), 6))
    w = W.partitionBy("cluster_id").orderBy(F.desc("similarity"), "profile_id")
    ranked = met.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("margin", F.round(F.col("similarity") - F.lead("similarity", 1, 0.0).over(w), 6))
    return ranked.select("cluster_id", "profile_id", "similarity", "margin", "rank", ((F.col("rank") == 1) & (F.col("similarity") >= least) & (F.col("margin") >= margin)).alias("labelled"))


def unlabelled(clusters: DataFrame, matches: DataFrame) -> DataFrame:
    """Clusters without a labelled profile, with the reason. (VEC-10)"""
    any_ = matches.groupBy("cluster_id").agg(F.max(F.col("labelled").cast("int")).alias("_l"))
    return clusters.select("cluster_id").join(any_, "cluster_id", "left").where("coalesce(_l, 0) = 0").select("cluster_id", F.when(F.col("_l").isNull(), "no_profiles").otherwise("no_match").alias("reason"))


def seed_profiles(labels: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(player_id, character_id, centroid, n, sessions) of labelled vectors; only missing ones if some exist. (VEC-11)"""
    keys = ["player_id", "character_id"]
    if existing is not None:
        labels = labels.where("character_id IS NOT NULL").join(existing.select(*keys), keys, "left_anti")
    info = labels.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("session_id")).alias("sessions"))
    return centroids(labels, keys).join(info, keys)


def update_profiles(profiles: DataFrame, confirmed: DataFrame, keep: float = KEEP) -> DataFrame:
    """Profiles moved a tenth towards their confirmed cluster; count, sessions and version rise. (VEC-12)"""
    out = profiles.join(confirmed.select("profile_id", F.col("centroid").alias("_c"), F.col("n").alias("_n"), F.col("sessions").alias("_s")), "profile_id", "left")
    moved = F.zip_with("centroid", "_c", lambda a, b: a * keep + b * (1 - keep))
    return out.select("profile_id", F.when(F.col("_c").isNull(), F.col("centroid")).otherwise(moved).alias("centroid"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), F.array_sort(F.array_union("sessions", F.coalesce("_s", F.array().cast(dict(profiles.dtypes)["sessions"])))).alias("sessions"), (F.col("version") + F.when(F.col("_c").isNull(), 0).otherwise(1)).alias("version"))


def recover(profiles: DataFrame, journal: DataFrame) -> DataFrame:
    """Profiles overridden by their newest intent that was never committed. (VEC-13)"""
    open_ = journal.where("kind = 'intent'").join(journal.where("kind = 'commit'").select("entry_id"), "entry_id", "left_anti")
    newest = open_.groupBy("profile_id").agg(F.max_by("next_version", F.struct("at", "entry_id")).alias("_next"))
    return profiles.join(newest, "profile_id", "left").withColumn("version", F.coalesce("_next", "version")).drop("_next")


def valid_profiles(profiles: DataFrame, dim: int) -> DataFrame:
    """Profiles with a finite centroid of the right size. (VEC-14)"""
    return profiles.where((F.size("centroid") == dim) & F.forall("centroid", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
