"""Operators that recover clocks and align dice rolls with speech."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values.
ID_ALPHABET = "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
PLAUSIBLE_MS = (946684800000, 4102444800000)
OUTSIDE_S = 300.0
TOTAL_POINTS, DIE_POINTS, SPEAKER_POINTS, CUE_POINTS, LEAST_SCORE = 10, 8, 3, 1, 8
ROLL_COST, SPEECH_COST = 100, 5  # hundredths


def id_millis(id_: Column) -> Column:
    """Milliseconds in the first eight characters of a sortable id; null if they aren't a plausible time. (AL-01)"""
    chars = F.filter(F.split(F.substring(id_, 1, 8), ""), lambda c: c != "")
    digits = F.transform(chars, lambda c: (F.instr(F.lit(ID_ALPHABET), c) - 1).cast("bigint"))
    ms = F.aggregate(digits, F.lit(0).cast("bigint"), lambda acc, d: acc * 64 + d)
    fine = (F.size(chars) == 8) & ~F.exists(digits, lambda d: d < 0) & (ms >= PLAUSIBLE_MS[0]) & (ms < PLAUSIBLE_MS[1])
    return F.when(fine, ms)


def basis(messages: DataFrame) -> DataFrame:
    """(session_id, basis): wallclock, else messageid if ids decode and never go back, else order_only. (AL-02)"""
    w = W.partitionBy("session_id").orderBy("seq")
    held = messages.withColumn("_back", F.when(F.col("id_ms") < F.lag("id_ms").over(w), 1).otherwise(0))
    g = held.groupBy("session_id").agg(F.max(F.col("t_wall_ms").isNotNull().cast("int")).alias("_wall"), F.max(F.col("id_ms").isNull().cast("int")).alias("_bad"), F.max("_back").alias("_back"))
    return g.select("session_id", F.when(F.col("_wall") == 1, "wallclock").when((F.col("_bad") == 0) & (F.col("_back") == 0), "messageid").otherwise("order_only").alias("basis"))


def recording_time(messages: DataFrame, recordings: DataFrame, bases: DataFrame) -> DataFrame:
    """Messages with t_audio_s since the recording's start, null without a trusted clock. (AL-03)"""
    held = messages.join(recordings, "session_id", "left").join(bases, "session_id", "left")
    t = F.when(F.col("basis") == "wallclock", F.col("t_wall_ms")).when(F.col("basis") == "messageid", F.col("id_ms"))
    return held.withColumn("t_audio_s", (t - F.col("started_ms")) / 1000)


def clock_issues(timed: DataFrame) -> DataFrame:
    """(session_id, code, n): times outside the recording by over five minutes, steps back, order-only sessions. (AL-04)"""
    w = W.partitionBy("session_id").orderBy("seq")
    back = timed.withColumn("_b", F.col("id_ms") < F.lag("id_ms").over(w)).where("_b").groupBy("session_id").agg(F.count("*").alias("n")).select("session_id", F.lit("CLOCK_STEP_BACK").alias("code"), "n")
    out = timed.where((F.col("t_audio_s") < -OUTSIDE_S) | (F.col("t_audio_s") > F.col("duration_s") + OUTSIDE_S)).groupBy("session_id").agg(F.count("*").alias("n")).select("session_id", F.lit("TIME_OUTSIDE").alias("code"), "n")
    only = timed.where("basis = 'order_only'").groupBy("session_id").agg(F.count("*").alias("n")).select("session_id", F.lit("ORDER_ONLY").alias("code"), "n")
    return back.unionByName(out).unionByName(only)


def expected_times(rolls: DataFrame, messages: DataFrame) -> DataFrame:
    """Rolls that have a total, with the first known time of their sequence number. (AL-05)"""
    first = messages.where("t_audio_s IS NOT NULL").groupBy("session_id", "seq").agg(F.min_by("t_audio_s", "ord").alias("expected_s"))
    return rolls.where("total IS NOT NULL").join(first, ["session_id", "seq"], "left")


def candidates(rolls: DataFrame, numbers: DataFrame, trusted: bool = True) -> DataFrame:
    """(session_id, seq, utt_ord, score): pairs in which a roll's total or a kept die was spoken. (AL-06)

    Numbers meet in an equi-join; a pair without one cannot reach the least
    score, so nothing else is compared.
    """
    spoken = rolls.select("session_id", "seq", "who", "expected_s", F.explode(F.array_distinct(F.concat(F.array("total"), "dice"))).alias("number"), "total")
    met = spoken.join(numbers, ["session_id", "number"])
    hit = F.when(F.col("number") == F.col("total"), TOTAL_POINTS).otherwise(DIE_POINTS)
    near = F.greatest(F.lit(0.0), 2 * (1 - F.abs(F.col("expected_s") - F.col("mid_s")) / 60)) if trusted else F.lit(0.0)
    score = F.max(hit) + F.max(F.when(F.col("who") == F.col("player_id"), SPEAKER_POINTS).otherwise(0)) + F.max(F.when(F.col("cue"), CUE_POINTS).otherwise(0)) + F.max(F.coalesce(near, F.lit(0.0)))
    return met.groupBy("session_id", "seq", "utt_ord").agg(F.round(score, 6).alias("score"))


def best_chain(seqs: list[int], ords: list[int], weights: list[int]) -> list[int]:
    """Indices of the heaviest chain that rises strictly in both coordinates.

    Rows come ordered by (seq, -ord). The frontier holds, by rising ord, the
    best chains so far, so each row costs one search.
    """
    ends: list[int] = []  # ords of the frontier, rising; their weights rise too
    best: list[tuple[int, int]] = []  # (weight, index)
    before = [-1] * len(seqs)
    for i, (o, w) in enumerate(zip(ords, weights)):
        at = bisect.bisect_left(ends, o)
        total = w + (best[at - 1][0] if at else 0)
        before[i] = best[at - 1][1] if at else -1
        if at < len(ends) and ends[at] == o and best[at][0] >= total or at and best[at - 1][0] >= total:
            continue
        stop = at
        while stop < len(ends) and best[stop][0] <= total:
            stop += 1
        ends[at:stop], best[at:stop] = [o], [(total, i)]
    out, i = [], best[-1][1] if best else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(found: DataFrame) -> DataFrame:
    """(session_id, seq, utt_ord): the matches that maximise the score less the costs of what stays unmatched. (AL-07)

    That optimum is the heaviest chain over candidates whose weight is the
    score plus both costs; only those sparse candidates of one session meet in
    one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq", "utt_ord"], ascending=[True, False])
        weights = (pdf["score"] * 100).round().astype(int) + ROLL_COST + SPEECH_COST
        return pdf.iloc[best_chain(pdf["seq"].tolist(), pdf["utt_ord"].tolist(), weights.tolist())][["session_id", "seq", "utt_ord"]]

    return found.where(F.col("score") >= LEAST_SCORE).select("session_id", "seq", "utt_ord", "score").groupBy("session_id").applyInPandas(run, "session_id long, seq long, utt_ord long")


def robust_fit(matches: DataFrame, most: float = 20.0) -> DataFrame:
    """Matches without inner points that lie far off the line of their neighbours. (AL-08)"""
    w = W.partitionBy("session_id").orderBy("seq")
    ps, pt, ns, nt = F.lag("seq").over(w), F.lag("t_s").over(w), F.lead("seq").over(w), F.lead("t_s").over(w)
    off = F.abs(F.col("t_s") - (pt + (nt - pt) * (F.col("seq") - ps) / (ns - ps)))
    held = matches.withColumn("off", F.round(off, 6))
    cut = held.groupBy("session_id").agg(F.greatest(F.lit(most), F.expr("percentile(off, 0.5)")).alias("_cut"))
    return held.join(cut, "session_id").where(F.col("off").isNull() | (F.coalesce("_cut", F.lit(most)) >= F.col("off"))).drop("_cut", "off")


def fit_scale(matches: DataFrame, points: DataFrame) -> DataFrame:
    """(session_id, scale_s, fallback_s): how far matches lie off the line of their neighbours, and the usual time of one step. (AL-08)

    ``points`` are those that ``robust_fit`` keeps of ``matches``. The scale is
    the median deviation of inner matches, at least 0.25; the fallback the
    median slope, 1 where there is none or it isn't above 0.
    """
    w = W.partitionBy("session_id").orderBy("seq")
    slope = lambda t0, q0: (F.col("t_s") - t0) / (F.col("seq") - q0)
    ps, pt, ns, nt = F.lag("seq").over(w), F.lag("t_s").over(w), F.lead("seq").over(w), F.lead("t_s").over(w)
    off = F.abs(F.col("t_s") - (pt + (nt - pt) * (F.col("seq") - ps) / (ns - ps)))
    scale = matches.withColumn("_off", off).groupBy("session_id").agg(F.greatest(F.lit(0.25), F.coalesce(F.expr("percentile(_off, 0.5)"), F.lit(0.25))).alias("scale_s"))
    steps = points.withColumn("_s", slope(pt, ps)).groupBy("session_id").agg(F.expr("percentile(_s, 0.5)").alias("_step"))
    return scale.join(steps, "session_id", "left").select("session_id", "scale_s", F.when(F.col("_step") > 0, F.col("_step")).otherwise(1.0).alias("fallback_s"))


def _chord(q: Column, a: Column, b: Column) -> Column:
    """Time at ``q`` on the line through two points (q, t); null if either is missing."""
    return a["t"] + (b["t"] - a["t"]) * (q - a["q"]) / (b["q"] - a["q"])


def _beyond(q: Column, near: Column, far: Column, fallback: Column) -> Column:
    """Time at ``q`` past the end point ``near``, by the slope from the point next to it, never below 0."""
    slope = F.when(far.isNotNull(), F.greatest(F.lit(0.0), (near["t"] - far["t"]) / (near["q"] - far["q"]))).otherwise(fallback)
    return F.greatest(F.lit(0.0), near["t"] + (q - near["q"]) * slope)


def project(rolls: DataFrame, points: DataFrame, fits: DataFrame) -> DataFrame:
    """Rolls with t_audio_s, its uncertainty and its kind. (AL-09)

    A roll at a fitted point's sequence number is matched. Others are on the
    line between the nearest points before and after, or beyond the end by the
    slope of the two points there; without points at the expected time, or a
    step a number. An as-of in both directions over one sorted axis: points
    carry their time forwards and backwards by windows, and each end's slope.
    """
    w = W.partitionBy("session_id").orderBy("seq")
    point = F.struct(F.col("seq").alias("q"), F.col("t_s").alias("t"))
    p = points.select("session_id", "seq", F.struct(point.alias("at"), F.lag(point).over(w).alias("before"), F.lead(point).over(w).alias("after")).alias("_p"))
    axis = rolls.withColumn("_roll", F.lit(True)).join(p, ["session_id", "seq"], "full_outer").join(fits, "session_id", "left")
    held = axis.withColumn("_a", F.last("_p", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("_b", F.first("_p", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)))
    q, a, b, own = F.col("seq"), F.col("_a"), F.col("_b"), F.col("_p")
    scale, fallback = F.coalesce("scale_s", F.lit(0.25)), F.coalesce("fallback_s", F.lit(1.0))
    inside = a.isNotNull() & b.isNotNull()
    end = a.isNotNull() | b.isNotNull()
    t = (
        F.when(own.isNotNull(), own["at"]["t"]).when(inside, _chord(q, a["at"], b["at"])).when(a.isNotNull(), _beyond(q, a["at"], a["before"], fallback)).when(b.isNotNull(), _beyond(q, b["at"], b["after"], fallback))
        .otherwise(F.greatest(F.lit(0.0), F.coalesce("expected_s", q * fallback)))
    )
    gap = F.least(q - a["at"]["q"], b["at"]["q"] - q)  # null sides don't count
    unc = F.when(own.isNotNull(), scale).when(inside, scale + 0.5 + 0.5 * gap).when(end, scale + 1 + gap).otherwise(scale + 10)
    kind = F.when(own.isNotNull(), "matched").when(inside, "interpolated").otherwise("extrapolated")
    return held.where("_roll").select(*rolls.columns, F.round(t, 6).alias("t_audio_s"), F.round(unc, 6).alias("uncertainty_s"), kind.alias("anchor"))


def anchors(projected: DataFrame) -> DataFrame:
    """Projected rolls whose times never fall along the sequence. (AL-10)"""
    w = W.partitionBy("session_id").orderBy("seq", "roll_id").rowsBetween(W.unboundedPreceding, 0)
    return projected.withColumn("t_audio_s", F.max("t_audio_s").over(w))


def leave_one_out(points: DataFrame, fits: DataFrame) -> DataFrame:
    """``points`` with ``residual_s``: the distance from where the other points would put each. (AL-11)

    An inner point is held against the line through its neighbours, an end
    point against the slope of the two points next to it, the only point of a
    session against itself.
    """
    w = W.partitionBy("session_id").orderBy("seq")
    point = F.struct(F.col("seq").alias("q"), F.col("t_s").alias("t"))
    near = {f"_{k}": F.lead(point, k).over(w) for k in (1, 2)} | {f"_b{k}": F.lag(point, k).over(w) for k in (1, 2)}
    held = points.select("session_id", "seq", "t_s", *[c.alias(k) for k, c in near.items()]).join(fits, "session_id", "left")
    q, fallback = F.col("seq"), F.coalesce("fallback_s", F.lit(1.0))
    b1, a1 = F.col("_b1"), F.col("_1")
    put = F.when(b1.isNotNull() & a1.isNotNull(), _chord(q, b1, a1)).when(a1.isNotNull(), _beyond(q, a1, F.col("_2"), fallback)).when(b1.isNotNull(), _beyond(q, b1, F.col("_b2"), fallback)).otherwise(F.col("t_s"))
    return held.select("session_id", "seq", "t_s", F.abs(F.col("t_s") - put).alias("residual_s"))


def alignment_quality(anchored: DataFrame, points: DataFrame, fits: DataFrame, basis: DataFrame) -> DataFrame:
    """(session_id, anchored_fraction, median_residual_s, largest_gap_s, drift_s). (AL-11)

    Residuals are those of matched rolls with an expected time; a session
    without any has those of leaving one point out. The gap is the longest
    stretch of a run of rolls that aren't matched, between the anchors on
    either side; null if all are. ``basis`` (session_id, basis) is one row a
    session; only a wall clock has a drift.
    """
    w = W.partitionBy("session_id").orderBy("seq", "roll_id")
    ok, t = F.col("anchor") == "matched", F.col("t_audio_s")
    held = anchored.withColumn("_run", F.sum(ok.cast("long")).over(w)).withColumn("_left", F.coalesce(F.lag(t).over(w), t)).withColumn("_right", F.coalesce(F.lead(t).over(w), t))
    runs = held.where(~ok).groupBy("session_id", "_run").agg(F.greatest(F.lit(0.0), F.max_by("_right", F.struct("seq", "roll_id")) - F.min_by("_left", F.struct("seq", "roll_id"))).alias("_gap"))
    gaps = runs.groupBy("session_id").agg(F.round(F.max("_gap"), 6).alias("largest_gap_s"))
    matched = anchored.where(ok).join(points.select("session_id", "seq", "t_s"), ["session_id", "seq"]).where("expected_s IS NOT NULL").withColumn("_res", F.col("t_s") - F.col("expected_s"))
    known = matched.groupBy("session_id").agg(F.expr("percentile(abs(_res), 0.5)").alias("_known"), F.expr("percentile(_res, 0.5)").alias("_drift"))
    left_out = leave_one_out(points, fits).groupBy("session_id").agg(F.expr("percentile(residual_s, 0.5)").alias("_out"))
    share = anchored.groupBy("session_id").agg(F.round(F.avg(ok.cast("double")), 6).alias("anchored_fraction"))
    out = share.join(known, "session_id", "left").join(left_out, "session_id", "left").join(gaps, "session_id", "left").join(basis, "session_id", "left")
    drift = F.when(F.col("basis") == "wallclock", F.col("_drift"))
    return out.select("session_id", "anchored_fraction", F.round(F.coalesce("_known", "_out"), 6).alias("median_residual_s"), "largest_gap_s", F.round(drift, 6).alias("drift_s"))


def project_turnorder(turnorder: DataFrame, points: DataFrame, fits: DataFrame) -> DataFrame:
    """Order snapshots on the recording's clock, with usable entries only. (AL-12)"""
    kept = turnorder.withColumn("entries", F.filter("entries", lambda e: e["name"].isNotNull() & e["value"].isNotNull()))
    return project(kept.withColumn("expected_s", F.lit(None).cast("double")), points, fits)
