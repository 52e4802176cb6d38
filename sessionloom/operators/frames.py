"""Operators on energy frames (session/track, frame_ix, rms): thresholds, voiced runs, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import running_islands

# Fixed values.
FRAME_S = 0.02
RISE_DB, LEAST_DB, MOST_DB, SILENT_RATIO = 12.0, -55.0, -35.0, 0.005


def decibels(frames: DataFrame) -> DataFrame:
    return frames.withColumn("db", F.round(20 * F.log10("rms"), 6))


def speech_ratio(frames: DataFrame) -> DataFrame:
    """(track_id, floor_db, threshold, ratio): share of frames strictly above floor + 12 dB, clamped. (FR-01)

    The floor is the element at a tenth of the sorted frames. Counting equal
    levels first keeps the ranked rows to one per level and track.
    """
    levels = decibels(frames).groupBy("track_id", "db").agg(F.count("*").alias("n"))
    w = W.partitionBy("track_id")
    upto = w.orderBy("db").rowsBetween(W.unboundedPreceding, 0)
    ranked = levels.withColumn("_upto", F.sum("n").over(upto)).withColumn("_all", F.sum("n").over(w))
    floor = F.min(F.when(F.col("_upto") > F.floor(F.col("_all") * 0.1), F.col("db"))).over(w)
    cut = F.greatest(F.lit(LEAST_DB), F.least(F.lit(MOST_DB), F.col("floor_db") + RISE_DB))
    held = ranked.withColumn("floor_db", floor).withColumn("threshold", cut)
    return held.groupBy("track_id", "floor_db", "threshold").agg(F.round(F.sum(F.when(F.col("db") > F.col("threshold"), F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("ratio"))


def silent_tracks(ratios: DataFrame) -> DataFrame:
    """Tracks with next to no speech. (FR-02)"""
    return ratios.where(F.col("ratio") < SILENT_RATIO)


def adaptive_threshold(frames: DataFrame) -> DataFrame:
    """(track_id, p10, p50, p90, threshold): interpolated 10th percentile, at most -60, plus 12 dB, clamped. (FR-03)"""
    stats = decibels(frames).groupBy("track_id").agg(*[F.expr(f"percentile(db, {p})").alias(n) for n, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))])
    return stats.withColumn("threshold", F.greatest(F.lit(LEAST_DB), F.least(F.lit(MOST_DB), F.least(F.col("p10"), F.lit(-60.0)) + RISE_DB)))


def voiced_mask(frames: DataFrame) -> DataFrame:
    """Frames with ``voiced``: at or above the threshold, or all of a loud track of little range. (FR-04)"""
    held = decibels(frames).join(adaptive_threshold(frames), "track_id")
    flat = (F.col("p90") - F.col("p10") <= 3) & (F.col("p50") >= LEAST_DB)
    return held.select("track_id", "frame_ix", "rms", (flat | (F.col("db") >= F.col("threshold"))).alias("voiced"))


def runs(mask: DataFrame, flag: str = "voiced") -> DataFrame:
    """Run-length encoding: (track_id, run, flag, first_ix, last_ix, n). (FR-05)"""
    w = W.partitionBy("track_id").orderBy("frame_ix")
    new = F.when(F.lag(flag).over(w) == F.col(flag), 0).otherwise(1)
    held = mask.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return held.groupBy("track_id", "run").agg(F.first(flag).alias(flag), F.min("frame_ix").alias("first_ix"), F.max("frame_ix").alias("last_ix"), F.count("*").alias("n"))


def shaped_runs(mask: DataFrame, least_silence: int = 3, least_speech: int = 2) -> DataFrame:
    """Voiced runs after short silences between speech are filled and then short speech is dropped. (FR-06)

    Both steps work on runs, of which there are far fewer than frames.
    """
    w = W.partitionBy("track_id").orderBy("run")
    first = runs(mask)
    inner = F.lag("run").over(w).isNotNull() & F.lead("run").over(w).isNotNull()
    filled = first.withColumn("voiced", F.col("voiced") | (inner & (F.col("n") < least_silence)))
    new = F.when(F.lag("voiced").over(w) == F.col("voiced"), 0).otherwise(1)
    again = filled.withColumn("_new", new).withColumn("run2", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    joined = again.groupBy("track_id", "run2").agg(F.first("voiced").alias("voiced"), F.min("first_ix").alias("first_ix"), F.max("last_ix").alias("last_ix"), F.sum("n").alias("n"))
    return joined.where(F.col("voiced") & (F.col("n") >= least_speech)).select("track_id", "first_ix", "last_ix", "n")


def run_intervals(runs_: DataFrame, durations: DataFrame, frame_s: float = FRAME_S) -> DataFrame:
    """Runs as intervals in seconds, clipped to the track's duration. (FR-07)"""
    return runs_.join(durations, "track_id").select("track_id", F.round(F.col("first_ix") * frame_s, 6).alias("start_s"), F.round(F.least((F.col("last_ix") + 1) * frame_s, "duration_s"), 6).alias("end_s"))


def padded_segments(intervals: DataFrame, least: float = 0.04, pad: float = 0.06, most: float = 0.5, overlap: float = 0.1) -> DataFrame:
    """Short intervals dropped, the rest padded, merged where they touch, and long ones cut with an overlap. (FR-08)"""
    wide = intervals.where(F.round(F.col("end_s") - F.col("start_s"), 6) >= least).select("track_id", F.round(F.greatest(F.col("start_s") - pad, F.lit(0.0)), 6).alias("start_s"), F.round(F.col("end_s") + pad, 6).alias("end_s"))
    merged = running_islands(wide, ["track_id"], "start_s", "end_s", ["end_s"]).groupBy("track_id", "island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    length = F.round(F.col("end_s") - F.col("start_s"), 6)
    pieces = F.when(length <= most, 1).otherwise(F.ceil(F.round((length - overlap) / (most - overlap), 6))).cast("int")
    cut = merged.withColumn("k", F.explode(F.sequence(F.lit(0), pieces - 1)))
    start = F.round(F.col("start_s") + F.col("k") * (most - overlap), 6)
    return cut.select("track_id", start.alias("start_s"), F.round(F.least(start + most, "end_s"), 6).alias("end_s"))


def union_length(intervals: DataFrame) -> DataFrame:
    """Seconds covered by a track's intervals. (FR-09)"""
    islands = running_islands(intervals, ["track_id"], "start_s", "end_s", ["end_s"]).groupBy("track_id", "island").agg((F.max("end_s") - F.min("start_s")).alias("_s"))
    return islands.groupBy("track_id").agg(F.round(F.sum("_s"), 6).alias("covered_s"))


def interval_energy(intervals: DataFrame, frames: DataFrame, frame_s: float = FRAME_S) -> DataFrame:
    """Mean rms of the frames of each interval. (FR-10)

    Each interval lists the frames it covers, so the join is on equal keys.
    """
    ix = F.sequence(F.floor(F.round(F.col("start_s") / frame_s, 6)), F.greatest(F.ceil(F.round(F.col("end_s") / frame_s, 6)) - 1, F.floor(F.round(F.col("start_s") / frame_s, 6))))
    return intervals.withColumn("frame_ix", F.explode(ix)).join(frames, ["track_id", "frame_ix"]).groupBy("track_id", "start_s", "end_s").agg(F.round(F.avg("rms"), 6).alias("mean_rms"))


def duration_outliers(tracks: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Tracks with the session's median duration, the longest, and whether they keep to the median. (FR-11)"""
    stats = tracks.groupBy("session_id").agg(F.expr("percentile(duration_s, 0.5)").alias("median_s"), F.max("duration_s").alias("recording_s"))
    return tracks.join(stats, "session_id").withColumn("aligned", F.abs(F.col("duration_s") - F.col("median_s")) <= tolerance)
