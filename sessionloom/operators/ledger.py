"""Operators on ledger tables: upserts, latest states, change detection, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert_sessions(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """New values win; created_at stays. (LG-01)"""
    n = new.select("session_id", *[F.col(c).alias(f"_{c}") for c in new.columns if c != "session_id"])
    both = sessions.join(n, "session_id", "full_outer")
    return both.select("session_id", *[F.coalesce(*(("created_at", "_created_at") if c == "created_at" else (f"_{c}", c))).alias(c) for c in sessions.columns if c != "session_id"])


def session_page(sessions: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of sessions, newest first; the limit is held to 1..1000. (LG-02)"""
    return sessions.orderBy(F.desc("date"), F.desc("session_id")).offset(max(0, offset)).limit(min(1000, max(1, limit)))


def latest_status(sessions: DataFrame, runs: DataFrame) -> DataFrame:
    """(session_id, status) of the last run, new without any. (LG-03)"""
    last = runs.groupBy("session_id").agg(F.max_by("status", F.struct("started_at", "run_id")).alias("status"))
    return sessions.select("session_id").join(last, "session_id", "left").withColumn("status", F.coalesce("status", F.lit("new")))


def stage_status(sessions: DataFrame, runs: DataFrame, stages: list[str]) -> DataFrame:
    """Every stage of every session, pending where none has run. (LG-04)"""
    last = runs.groupBy("session_id", "stage").agg(F.max_by("status", F.struct("started_at", "run_id")).alias("status"))
    all_ = sessions.select("session_id").withColumn("stage", F.explode(F.array(*map(F.lit, stages))))
    return all_.join(last, ["session_id", "stage"], "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def rebuild_history(lines: DataFrame, schema: str) -> DataFrame:
    """Stage runs out of metadata documents; unreadable ones are skipped. (LG-05)"""
    parsed = lines.select(F.from_json("value", schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("m"))
    return parsed.where("m IS NOT NULL AND m._corrupt_record IS NULL AND m.stage IS NOT NULL").select("m.*").drop("_corrupt_record")


FLAG = ["session_id", "stage", "code", "utt"]


def refresh_flags(flags: DataFrame, new: DataFrame) -> DataFrame:
    """Open flags of the refreshed session and stage give way to the new ones; resolved ones stay. (LG-06)"""
    key = lambda df: df.withColumn("utt", F.coalesce("utterance_id", F.lit("")))
    touched = new.select("session_id", "stage").distinct().withColumn("_t", F.lit(True))
    kept = key(flags).join(touched, ["session_id", "stage"], "left").where("_t IS NULL OR state <> 'open'").select(*FLAG, "state")
    fresh = key(new).select(*FLAG).distinct().withColumn("_new", F.lit("open"))
    return kept.join(fresh, FLAG, "full_outer").select(*FLAG, F.coalesce("state", "_new").alias("state"))


def resolve_flags(flags: DataFrame, decisions: DataFrame) -> DataFrame:
    """Flags with the state their decision gives them. (LG-07)"""
    return flags.join(decisions.select("flag_id", F.col("state").alias("_s")), "flag_id", "left").withColumn("state", F.coalesce("_s", "state")).drop("_s")


def open_counts(flags: DataFrame) -> DataFrame:
    """(code, n) of open flags. (LG-08)"""
    return flags.where("state = 'open'").groupBy("code").agg(F.count("*").alias("n"))


def agent_runs(starts: DataFrame, finishes: DataFrame) -> DataFrame:
    """Runs with their end if it is known, newest first by ``place``. (LG-09)"""
    out = starts.join(finishes, "run_id", "left").withColumn("status", F.coalesce("status", F.lit("running")))
    return out.withColumn("place", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("started_at"), F.desc("run_id"))).cast("long"))


def repair_interrupted(runs: DataFrame) -> DataFrame:
    """Runs that were under way become interrupted. (LG-10)"""
    return runs.withColumn("status", F.when(F.col("status").isin("queued", "running"), "interrupted").otherwise(F.col("status")))


def input_digest(inputs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, digest) over the sorted (path, sha) of the inputs; an absent input counts as zeros."""
    pair = F.concat_ws("=", "path", F.coalesce("sha", F.lit("0" * 64)))
    return inputs.groupBy(*keys).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(pair)), "\n"), 256).alias("digest"))


def params_digest(params: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, params_hash) over the sorted (name, value) of the parameters; a null value counts as null."""
    pair = F.to_json(F.struct("name", "value"))
    return params.groupBy(*keys).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(pair)), "\n"), 256).alias("params_hash"))


def stale(inputs: DataFrame, metas: DataFrame, version: int, keys: list[str], params: DataFrame, outputs: DataFrame) -> DataFrame:
    """Keys to run again, with the first reason. (LG-11)

    never_run, failed, version, params, inputs, or output_missing: what was
    made is not among ``outputs`` (keys). ``metas`` have digest, version,
    params_hash and status of the last run, ``params`` (keys, name, value) the
    parameters of the next one; keys without any have the digest of none.
    """
    both = input_digest(inputs, keys).join(params_digest(params, keys), keys, "left").withColumn("params_hash", F.coalesce("params_hash", F.sha2(F.lit(""), 256)))
    both = both.join(metas.select(*keys, F.col("digest").alias("_d"), F.col("version").alias("_v"), F.coalesce("params_hash", F.sha2(F.lit(""), 256)).alias("_p"), F.col("status").alias("_s")), keys, "left")
    both = both.join(outputs.select(*keys).distinct().withColumn("_there", F.lit(True)), keys, "left")
    reason = (
        F.when(F.col("_s").isNull(), "never_run").when(F.col("_s") != "ok", "failed").when(~F.col("_v").eqNullSafe(F.lit(version)), "version").when(F.col("_p") != F.col("params_hash"), "params")
        .when(~F.col("_d").eqNullSafe(F.col("digest")), "inputs").when(F.col("_there").isNull(), "output_missing")
    )
    return both.select(*keys, reason.alias("reason")).where("reason IS NOT NULL")


def run_log(lines: DataFrame) -> DataFrame:
    """(run_id, n_messages, n_malformed, result, tokens) of logs of one JSON document a line. (LG-12)"""
    m = F.from_json("line", "type string, text string, tokens bigint")
    held = lines.withColumn("m", m).withColumn("kind", F.when(F.col("m.type").isNull(), "malformed").when(F.col("m.type") == "result", "result").otherwise("message"))
    return held.groupBy("run_id").agg(F.count_if(F.col("kind") == "message").alias("n_messages"), F.count_if(F.col("kind") == "malformed").alias("n_malformed"), F.coalesce(F.max_by("m.text", F.when(F.col("kind") == "result", F.col("line_no"))), F.lit("")).alias("result"), F.coalesce(F.sum("m.tokens"), F.lit(0)).alias("tokens"))
