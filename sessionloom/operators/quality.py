"""Operators for data-quality entries: rules, catalog, de-duplication, counts, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise

# Severities in order, and the catalog of codes with severity and hint.
SEVERITIES = ["error", "warning", "info"]
CATALOG = [
    ("TRACK_UNMAPPED", "error", "map {subject} to a player"), ("ACCOUNT_UNMAPPED", "warning", "map account {subject}"), ("TRACK_SILENT", "warning", "check {subject}"),
    ("TRACK_DURATION_MISMATCH", "warning", "compare {subject}"), ("NO_TRACKS", "error", "add tracks"), ("NO_CAPTURE", "warning", "add a capture"), ("ORDER_ONLY", "info", "no clock"),
]


def intake_rules(tracks: DataFrame, sessions: DataFrame, reported: DataFrame) -> DataFrame:
    """(session_id, code, subject): what the rules find, less the codes a producer has reported. (QA-01)"""
    pick = lambda code, where: tracks.where(where).select("session_id", F.lit(code).alias("code"), F.col("track_id").cast("string").alias("subject"))
    none = sessions.join(tracks.select("session_id").distinct(), "session_id", "left_anti").select("session_id", F.lit("NO_TRACKS").alias("code"), F.lit(None).cast("string").alias("subject"))
    bare = sessions.where("NOT has_capture").select("session_id", F.lit("NO_CAPTURE").alias("code"), F.lit(None).cast("string").alias("subject"))
    only = sessions.where("basis = 'order_only'").select("session_id", F.lit("ORDER_ONLY").alias("code"), F.lit(None).cast("string").alias("subject"))
    found = pick("TRACK_UNMAPPED", "player_id IS NULL").unionByName(pick("TRACK_SILENT", "speech_ratio < 0.005")).unionByName(pick("TRACK_DURATION_MISMATCH", "NOT aligned")).unionByName(none).unionByName(bare).unionByName(only)
    return found.join(reported.select("session_id", "code").distinct(), ["session_id", "code"], "left_anti")


def unmapped_accounts(rolls: DataFrame) -> DataFrame:
    """(session_id, account, n, ord): rolls of accounts without a player. (QA-02)"""
    g = rolls.where("player_id IS NULL").groupBy("session_id", F.coalesce(F.nullif(F.trim("account"), F.lit("")), F.lit("(unknown)")).alias("account")).agg(F.count("*").alias("n"))
    return g.withColumn("ord", F.row_number().over(W.partitionBy("session_id").orderBy("account")).cast("long"))


def absent_players(roster: DataFrame, tracks: DataFrame) -> DataFrame:
    """Expected players of a session that have no track. (QA-03)"""
    return roster.join(tracks.select("session_id", "player_id"), ["session_id", "player_id"], "left_anti")


def mismatch_entries(tracks: DataFrame) -> DataFrame:
    """One entry per session that lists the tracks off the median duration. (QA-04)"""
    return tracks.where("NOT aligned").groupBy("session_id").agg(F.lit("TRACK_DURATION_MISMATCH").alias("code"), F.array_join(F.sort_array(F.collect_list(F.col("track_id").cast("string"))), ", ").alias("subject"))


def catalog(spark) -> DataFrame:
    rows = [(c, s, h, i) for i, (c, s, h) in enumerate(CATALOG)]
    return spark.createDataFrame(rows, "code string, severity string, hint string, catalog_ord int")


def with_catalog(entries: DataFrame, known: DataFrame) -> DataFrame:
    """Entries with severity and hint of their code; unknown codes are kept as warnings. (QA-05)"""
    held = entries.join(F.broadcast(known), "code", "left")
    return held.withColumn("severity", F.coalesce("severity", F.lit("warning"))).withColumn("hint", F.replace(F.col("hint"), F.lit("{subject}"), F.coalesce("subject", F.lit("")))).withColumn("catalog_ord", F.coalesce("catalog_ord", F.lit(999)))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def deduplicated(entries: DataFrame) -> DataFrame:
    """One entry per session, code and subject: the gravest, then by catalog, message and arrival. (QA-06)"""
    w = W.partitionBy("session_id", "code", F.coalesce("subject", F.lit(""))).orderBy(severity_rank(F.col("severity")), "catalog_ord", "message", "arrival")
    return entries.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def severity_counts(entries: DataFrame) -> DataFrame:
    """(session_id, error, warning, info, exit_code). (QA-07)"""
    g = entries.groupBy("session_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return g.withColumn("exit_code", F.when(F.col("error") > 0, 2).when(F.col("warning") > 0, 1).otherwise(0))


def unparsed_sample(messages: DataFrame, most: int = 240) -> DataFrame:
    """The first unrecognised message of each session, shortened. (QA-09)"""
    flat = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, most)
    return messages.where("NOT recognised").groupBy("session_id").agg(F.min_by(flat, "ord").alias("sample"), F.count("*").alias("n"))


def constraint_violations(table: DataFrame, key: str, rules: dict[str, str], counters: Observation | None = None) -> DataFrame:
    """(key, rule) of rows for which a rule, a SQL condition, is false; unknown is a violation too. (QA-10)

    ``counters``, if given, has the number of rows and of violations of each
    rule once the result has been computed, from the same pass.
    """
    broken = {name: ~F.coalesce(F.expr(c), F.lit(False)) for name, c in rules.items()}
    if counters is not None:
        table = table.observe(counters, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(name) for name, c in broken.items()])
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in broken.items()]))
    return table.select(key, F.explode(found).alias("rule"))


def observed_counts(violations: DataFrame, column: str, names: list[str]) -> DataFrame:
    """(column, n): how often each of ``names`` occurs, counted while ``violations`` are written. (QA-10)

    The written table can be read from ``scratch_path`` of the result; names
    that don't occur are left out.
    """
    counters = Observation()
    written = materialise(violations.observe(counters, *[F.count_if(F.col(column) == name).alias(name) for name in names]), "violations")
    out = violations.sparkSession.createDataFrame([(name, n) for name, n in counters.get.items() if n], f"{column} string, n long")
    out.scratch_path = written.scratch_path
    return out
