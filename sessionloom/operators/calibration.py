"""Operators that sample, train and measure: labelling work lists, folds, metrics, thresholds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import in_blocks, in_order
from .vectors import cosine

# Fixed values.
EPOCHS, RATE, L2, MOST_FOLDS, LEAST_LABELS = 160, 0.05, 0.01, 5, 20
#: Labels that a model is fitted on, at most about so many.
MOST_FITTED = 20_000


def uncertain_sample(items: DataFrame, labelled: DataFrame, limit: int) -> DataFrame:
    """The unlabelled items whose score is nearest to one half. (CA-01)"""
    open_ = items.join(labelled.select("id"), "id", "left_anti")
    return open_.orderBy(F.abs(F.col("score") - 0.5), "id").limit(limit)


def stratified_sample(items: DataFrame, strata: list[str], limit: int) -> DataFrame:
    """``limit`` items, each from the stratum with the largest outstanding need. (CA-02)

    The k-th draw of a stratum of n has need limit * n / total - (k - 1), so
    the draws of all strata are ranked at once and no loop is needed.
    """
    nth = F.row_number().over(W.partitionBy(*strata).orderBy("id"))
    # no stratum gives more than all, so Spark keeps the first ones of each partition before it shuffles
    first = items.withColumn("_k", nth).where(F.col("_k") <= limit)
    sizes = items.groupBy(*strata).agg(F.count("*").alias("_n"))
    same = [first[c].eqNullSafe(sizes[c]) for c in strata]
    held = first.join(sizes, same).select(*[first[c] for c in items.columns], "_k", "_n")
    total = items.agg(F.count("*").alias("_total"))
    need = F.round(F.lit(limit) * F.col("_n") / F.col("_total") - (F.col("_k") - 1), 9)
    return held.crossJoin(F.broadcast(total)).withColumn("need", need).orderBy(F.desc("need"), *strata, "_k").limit(limit).drop("_n", "_k", "_total")


def feature_matrix(labels: DataFrame, keys: list[str]) -> DataFrame:
    """One column per feature key, 0 where a row lacks it. (CA-03)"""
    flat = labels.select("id", F.explode("features").alias("k", "v"))
    return labels.select("id").join(flat.groupBy("id").pivot("k", keys).agg(F.first("v")), "id", "left").na.fill(0.0, keys)


def folds(labels: DataFrame, most: int = MOST_FOLDS) -> DataFrame:
    """Labels with fold: the rank by id modulo the number of folds. (CA-04)

    The rank comes from range partitions and their sizes, so no single task
    sorts all labels.
    """
    n = labels.agg(F.count("*").alias("_n"))  # one row
    return in_order(labels, ["id"]).crossJoin(F.broadcast(n)).withColumn("fold", ((F.col("rank") - 1) % F.least(F.lit(most), F.col("_n"))).cast("long")).drop("rank", "_n")


def fit_logistic(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, l2: float = L2) -> np.ndarray:
    """Weights and bias by per-row updates in order."""
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(epochs):
        for row, target in zip(x, y):
            z = max(-35.0, min(35.0, float(w @ row) + b))
            g = 1 / (1 + math.exp(-z)) - target
            w -= rate * (g * row + l2 * w)
            b -= rate * g
    return np.append(w, b)


def one_vs_rest(labels: DataFrame, classes: list[str], keys: list[str], most: int = MOST_FITTED) -> DataFrame:
    """(fold, class, weights): one model for each fold held out and class. (CA-05)

    Fits run in parallel over (fold, class); each row goes to every other
    fold's fits. Updates depend on the order of rows, so one task makes a fit;
    of more than ``most`` labels about so many are learned from, chosen by a
    hash of the id, which bounds it.
    """
    n, n_folds = labels.agg(F.count("*"), F.max("fold")).first()
    unit = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    labels = labels.where(unit < min(1.0, most / max(1, n)))
    fits = F.explode(F.array_remove(F.array(*[F.lit(i).cast("long") for i in range((n_folds or 0) + 1)]), F.col("fold")))
    x = F.array(*[F.col(k).cast("double") for k in keys])
    rows = labels.select("id", "label", x.alias("x"), fits.alias("held")).withColumn("class", F.explode(F.array(*map(F.lit, classes))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        w = fit_logistic(np.stack(pdf["x"].to_numpy()), (pdf["label"] == pdf["class"]).to_numpy(float))
        return pd.DataFrame({"fold": pdf["held"].iloc[:1], "class": pdf["class"].iloc[:1], "weights": [w.tolist()]})

    return rows.groupBy("held", "class").applyInPandas(run, "fold long, class string, weights array<double>")


def predict(rows: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """(id, label, predicted, confidence, margin): the best class by its fold's models. (CA-06)"""
    x = rows.select("id", "label", "fold", F.array(*[F.col(k).cast("double") for k in keys], F.lit(1.0)).alias("x"))
    z = F.aggregate(F.zip_with("x", "weights", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    scored = x.join(F.broadcast(models), "fold").withColumn("p", 1 / (1 + F.exp(-z)))
    w = W.partitionBy("id").orderBy(F.desc("p"), "class")
    ranked = scored.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead("p").over(w))
    return ranked.where("_r = 1").select("id", "label", F.col("class").alias("predicted"), F.col("p").alias("confidence"), F.coalesce(F.col("p") - F.col("_next"), F.lit(1.0)).alias("margin"))


def class_metrics(predicted: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support), 0 on empty denominators. (CA-07)"""
    both = predicted.groupBy("label", "predicted").agg(F.count("*").alias("n"))
    sides = both.select(F.explode(F.array_distinct(F.array("label", "predicted"))).alias("class"), "label", "predicted", "n")
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    t = sides.groupBy("class").agg(count((F.col("label") == F.col("class")) & (F.col("predicted") == F.col("class"))).alias("tp"), count(F.col("predicted") == F.col("class")).alias("pp"), count(F.col("label") == F.col("class")).alias("support"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    m = t.withColumn("p", ratio("tp", "pp")).withColumn("r", ratio("tp", "support"))
    return m.select("class", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0), 6).alias("f1"), "support")


def threshold_sweep(predicted: DataFrame, fractions: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(fraction, flagged, residual_error, cut_margin): the least certain share flagged. (CA-08)

    Margins are counted by value first and summed over range partitions.
    """
    levels = predicted.groupBy("margin").agg(F.count("*").alias("n"), F.sum(F.when(F.col("label") != F.col("predicted"), 1).otherwise(0)).alias("wrong"))
    held = in_order(levels, ["margin"], {"upto": "n"}).crossJoin(F.broadcast(levels.agg(F.sum("n").alias("total"))))  # the total is one row
    each = held.withColumn("fraction", F.explode(F.array(*map(F.lit, fractions)))).withColumn("flagged", F.ceil(F.round(F.col("fraction") * F.col("total"), 9)))
    # levels wholly beyond the cut count as left; the one it runs through is flagged whole
    rest = F.col("upto") - F.col("n") >= F.col("flagged")
    return each.groupBy("fraction").agg(F.max("flagged").alias("flagged"), F.round(F.sum(F.when(rest, F.col("wrong")).otherwise(0)) / F.greatest(F.lit(1), F.sum(F.when(rest, F.col("n")).otherwise(0))), 6).alias("residual_error"), F.round(F.max(F.when(~rest, F.col("margin"))), 6).alias("cut_margin"))


def profile_accuracy(labels: DataFrame, profiles: DataFrame) -> DataFrame:
    """(n, accuracy): how often the nearest profile is the label's own. (CA-09)"""
    p = profiles.select("profile_id", F.col("centroid").alias("_c"))
    met = in_blocks(labels.select("id", "character_id", "vector"), p, "profile_id").withColumn("_s", F.round(cosine(F.col("vector"), F.col("_c"), -1.0), 9))
    best = met.groupBy("id", "character_id").agg(F.max_by("profile_id", F.struct("_s", "profile_id")).alias("nearest"))
    return best.agg(F.count("*").alias("n"), F.round(F.avg((F.col("nearest") == F.col("character_id")).cast("double")), 6).alias("accuracy"))


def hold_out(labels: DataFrame, order: str = "id", share: int = 5) -> DataFrame:
    """Labels with held_out: those of the greatest session id or, where no label has a session, the last fifth, one at least. (CA-10)

    Places come from range partitions (``in_order``), so that no task sorts all labels.
    """
    ends = labels.agg(F.max("session_id").alias("_last"), F.count("*").alias("_n"))
    placed = in_order(labels, [order]).crossJoin(F.broadcast(ends))
    tail = F.col("rank") > F.col("_n") - F.greatest(F.lit(1), F.floor(F.col("_n") / share))
    return placed.withColumn("held_out", F.when(F.col("_last").isNull(), tail).otherwise(F.coalesce(F.col("session_id") == F.col("_last"), F.lit(False)))).drop("_last", "_n", "rank")


def calibration_report(labels: DataFrame, predicted: DataFrame, least: int = LEAST_LABELS) -> DataFrame:
    """One row: labels, accuracy, and what is missing if there are too few. (CA-12)"""
    n = labels.agg(F.count("*").alias("n_labels"))
    acc = predicted.agg(F.round(F.avg((F.col("label") == F.col("predicted")).cast("double")), 6).alias("accuracy"))
    return n.crossJoin(F.broadcast(acc)).withColumn("message", F.when(F.col("n_labels") < least, F.concat(F.lit("need "), F.lit(least) - F.col("n_labels"), F.lit(" more labels"))).otherwise("ok"))
