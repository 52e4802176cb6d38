"""Operators on one clock of events: union, gaps, boundary signals, beats."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ascii_edges

# Fixed values.
GAP_S, SILENCE_S, SPACING_S = 2.0, 8.0, 30.0
WEIGHTS = {"silence": 5.0, "turnorder": 8.0, "density": 3.0, "speakers": 3.0, "characters": 3.0, "glossary": 2.0, "narration": 4.0}
COMBAT_ROLLS = ["attack", "damage", "initiative", "save", "death_save"]
RECAP, TABLE, PLAN = r"\b(recap|previously)\b", r"\b(rules?|break|character sheet)\b", r"\b(plan|planning|strategy|prepare|preparing)\b"
KINDS = ["attack", "damage", "save", "check", "initiative", "death_save", "other"]


def gaps(speech: DataFrame, least: float = GAP_S, ends: DataFrame | None = None) -> DataFrame:
    """(session_id, t_start_s, t_end_s): stretches longer than ``least`` without speech. (EV-04)

    With ``ends`` (session_id, end_s) the rest after the last speech counts
    too, and the whole of a session without speech.
    """
    w = W.partitionBy("session_id").orderBy("start_s", "end_s", "utt_id")
    covered = F.coalesce(F.max("end_s").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    inner = speech.select("session_id", covered.alias("t_start_s"), F.col("start_s").alias("t_end_s"))
    if ends is not None:
        last = speech.groupBy("session_id").agg(F.max("end_s").alias("_last"))
        inner = inner.unionByName(ends.join(last, "session_id", "left").select("session_id", F.coalesce("_last", F.lit(0.0)).alias("t_start_s"), F.col("end_s").alias("t_end_s")))
    return inner.where(F.col("t_end_s") - F.col("t_start_s") > least)


def speech_events(speech: DataFrame, attributions: DataFrame, players: DataFrame, characters: DataFrame, rolls: DataFrame, anchors: DataFrame) -> DataFrame:
    """Speech with its attribution, the names of speaker and character, and the rolls anchored in it. (EV-02)

    Columns: those of ``speech`` and mode, character_id, confidence (1 where
    nothing is attributed, kept within 0 and 1), speaker_display,
    character_display, is_npc, is_dm, rolls ((roll_id, kind) in order of the
    rolls; empty if none). Attributions have one row an utterance, players and
    characters one an id; ids that they lack leave nulls, and ``is_dm`` and
    ``is_npc`` false. Rolls are grouped before they are joined, by their
    utterance.
    """
    linked = anchors.where("matched_utt_id IS NOT NULL").join(rolls.select("session_id", "roll_id", "seq", "kind"), ["session_id", "roll_id"])
    pick = lambda x: F.struct(x.roll_id.alias("roll_id"), x.kind.alias("kind"))
    linked = linked.groupBy("session_id", F.col("matched_utt_id").alias("utt_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "roll_id", "kind"))), pick).alias("rolls"))
    out = speech.join(attributions.select("session_id", "utt_id", "mode", "character_id", "confidence"), ["session_id", "utt_id"], "left").join(linked, ["session_id", "utt_id"], "left")
    out = out.join(players.select("player_id", F.col("display_name").alias("speaker_display"), "is_dm"), "player_id", "left").join(characters.select("character_id", F.col("name").alias("character_display"), "is_npc"), "character_id", "left")
    sure = F.coalesce("confidence", F.lit(1.0))
    return (
        out.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)))
        .withColumn("is_dm", F.coalesce("is_dm", F.lit(False)))
        .withColumn("is_npc", F.coalesce("is_npc", F.lit(False)))
        .withColumn("rolls", F.coalesce("rolls", F.array().cast(out.schema["rolls"].dataType)))
    )


def standalone_rolls(rolls: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchored rolls that no speech has, with ``confidence``: 1 if matched, else falling to 0 at 10 s of uncertainty. (EV-03)"""
    alone = anchors.where("matched_utt_id IS NULL").select("session_id", "roll_id", F.when(F.col("anchor") == "matched", 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("uncertainty_s") / 10)).alias("confidence"))
    return rolls.join(alone, ["session_id", "roll_id"])


def event_union(speech: DataFrame, rolls: DataFrame, turnorder: DataFrame, gap_rows: DataFrame, bounds: DataFrame, chat: DataFrame | None = None) -> DataFrame:
    """All kinds on one clock, with ``ord`` by start, end and id. (EV-01)

    ``speech`` and ``rolls`` are those of EV-02 and EV-03, so each anchored
    roll appears in the ``rolls`` of one event. ``bounds`` (session_id,
    start_s, end_s) gives the first and last row of each session. ``chat``
    (session_id, chat_id, t_start_s, t_end_s, text, confidence) may lack an end
    or a confidence. Markers of a start or end of combat are kinds of their own.
    """
    one_roll = F.array(F.struct("roll_id", "kind"))
    kind = F.when(F.col("marker") == "started", "combat_start").when(F.col("marker") == "ended", "combat_end").otherwise("turnorder")
    nth = F.row_number().over(W.partitionBy("session_id").orderBy("t_start_s")) - 1
    base36 = lambda t: F.lower(F.conv(F.floor(F.col(t) * 1000 + 0.5).cast("string"), 10, 36))
    at = lambda t: (F.col(t).alias("t_start_s"), F.col(t).alias("t_end_s"))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(1.0))))
    parts = [
        speech.select(
            "session_id", F.concat(F.lit("e_speech_"), "utt_id").alias("id"), F.lit("speech").alias("kind"), F.col("start_s").alias("t_start_s"), F.col("end_s").alias("t_end_s"), F.array(F.col("utt_id").cast("string")).alias("utterances"),
            "player_id", "character_id", "character_display", "is_npc", "is_dm", "confidence", "text", "mode", "rolls",
        ),
        rolls.select("session_id", F.concat(F.lit("e_roll_"), "roll_id").alias("id"), F.lit("roll").alias("kind"), *at("t_s"), F.col("who").alias("player_id"), "confidence", one_roll.alias("rolls")),
        turnorder.select("session_id", F.concat(F.lit("e_"), kind, F.lit("_"), "seq").alias("id"), kind.alias("kind"), *at("t_s")),
        gap_rows.select("session_id", F.concat_ws("_", F.lit("e_gap"), base36("t_start_s"), base36("t_end_s"), nth).alias("id"), F.lit("gap").alias("kind"), "t_start_s", "t_end_s"),
        bounds.select("session_id", F.lit("e_session_start").alias("id"), F.lit("session_start").alias("kind"), *at("start_s")),
        bounds.select("session_id", F.lit("e_session_end").alias("id"), F.lit("session_end").alias("kind"), *at("end_s")),
    ]
    if chat is not None:
        parts.append(chat.select("session_id", F.concat(F.lit("e_chat_"), "chat_id").alias("id"), F.lit("chat").alias("kind"), "t_start_s", F.coalesce("t_end_s", "t_start_s").alias("t_end_s"), clamped.alias("confidence"), "text"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    ordered = F.row_number().over(W.partitionBy("session_id").orderBy("t_start_s", "t_end_s", "id")).cast("long")
    filled = {"confidence": F.lit(1.0), "is_dm": F.lit(False), "is_npc": F.lit(False), "rolls": F.array().cast(out.schema["rolls"].dataType), "utterances": F.array().cast("array<string>")}
    out = out.select(*[F.coalesce(c, filled[c]).alias(c) if c in filled else c for c in out.columns])
    return out.withColumn("ord", ordered).select("ord", "session_id", "id", "kind", "t_start_s", "t_end_s", "player_id", "character_id", "character_display", "is_npc", "is_dm", "confidence", "text", "mode", "rolls", "utterances")


def session_bounds(ends: DataFrame, durations: DataFrame) -> DataFrame:
    """(session_id, start_s, end_s): the given duration, or the latest of ``ends`` (session_id, t_end_s) if that is later. (EV-05)"""
    last = ends.groupBy("session_id").agg(F.max("t_end_s").alias("_last"))
    return last.join(durations, "session_id", "left").select("session_id", F.lit(0.0).alias("start_s"), F.greatest("_last", F.coalesce("duration_s", "_last")).alias("end_s"))


def timeline_violations(events: DataFrame, speech: DataFrame, rolls: DataFrame, anchors: DataFrame) -> DataFrame:
    """(session_id, rule, id) of what breaks the timeline's rules. (EV-06)

    Of events: duplicate_id, bad_id, bad_confidence (null, not finite or not
    within 0 and 1), negative_length, out_of_order (not after the event before
    by start, end and id), missing_utterance and missing_roll (what they refer
    to). Of anchors, whose id is the roll's: several_anchors, anchor_without_roll,
    anchor_without_utterance. Three windows see every event; references are
    checked by anti-joins.
    """
    w = W.partitionBy("session_id").orderBy("ord")
    place = F.struct("t_start_s", "t_end_s", "id")
    held = events.withColumn("_n", F.count("*").over(W.partitionBy("session_id", "id"))).withColumn("_before", F.lag(place).over(w))
    sure = F.col("confidence").isNotNull() & ~F.isnan("confidence") & F.col("confidence").between(0, 1)
    rules = F.array_compact(F.array(
        F.when(F.col("_n") > 1, F.lit("duplicate_id")), F.when(~F.col("id").rlike("^e[A-Za-z0-9_-]+$"), F.lit("bad_id")), F.when(~sure, F.lit("bad_confidence")),
        F.when(F.col("t_end_s") < F.col("t_start_s"), F.lit("negative_length")), F.when(F.col("_before") >= place, F.lit("out_of_order")),
    ))
    out = held.select("session_id", F.explode(rules).alias("rule"), "id")
    said, rolled = speech.select("session_id", F.col("utt_id").cast("string").alias("_ref")), rolls.select("session_id", F.col("roll_id").cast("string").alias("_ref"))
    named = lambda df, rule: df.select("session_id", F.lit(rule).alias("rule"), "id")
    for column, known, rule in ((F.col("utterances"), said, "missing_utterance"), (F.transform("rolls", lambda x: x.roll_id.cast("string")), rolled, "missing_roll")):
        out = out.unionByName(named(events.select("session_id", "id", F.explode(column).alias("_ref")).join(known, ["session_id", "_ref"], "left_anti"), rule))
    tied = anchors.select("session_id", F.col("roll_id").cast("string").alias("id"), F.col("matched_utt_id").cast("string").alias("_utt"))
    out = out.unionByName(named(tied.groupBy("session_id", "id").count().where("count > 1"), "several_anchors"))
    out = out.unionByName(named(tied.withColumn("_ref", F.col("id")).join(rolled, ["session_id", "_ref"], "left_anti"), "anchor_without_roll"))
    return out.unionByName(named(tied.where("_utt IS NOT NULL").withColumnRenamed("_utt", "_ref").join(said, ["session_id", "_ref"], "left_anti"), "anchor_without_utterance"))


EVENT_RULES = ["duplicate_id", "bad_id", "bad_confidence", "negative_length", "out_of_order", "missing_utterance", "missing_roll", "several_anchors", "anchor_without_roll", "anchor_without_utterance"]


def in_window(events: DataFrame, start: Column | float, end: Column | float) -> DataFrame:
    """Events that meet a closed interval. (EV-07)"""
    at = lambda x: x if isinstance(x, Column) else F.lit(x)
    return events.where((F.col("t_end_s") >= at(start)) & (F.col("t_start_s") <= at(end)))


def rolls_in_window(events: DataFrame, start: Column | float, end: Column | float) -> DataFrame:
    """Events with rolls that meet a closed interval, in speech or alone. (EV-07)"""
    return in_window(events, start, end).where(F.size("rolls") > 0)


def events_for(events: DataFrame, characters: DataFrame) -> DataFrame:
    """Events of the (session_id, character_id) asked for. (EV-07)"""
    return events.join(characters.select("session_id", "character_id").distinct(), ["session_id", "character_id"], "left_semi")


def _jaccard_distance(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def _cusum(counts: Column, mean: Column, slack: float = 0.1) -> Column:
    """The highest running sum of distances from the mean, restarted at 0, over the window's length, at most 1."""
    zero = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("top"))

    def step(s: Column, x: Column) -> Column:
        run = F.greatest(F.lit(0.0), s.run + F.abs(x - mean) - slack)
        return F.struct(run.alias("run"), F.greatest(s.top, run).alias("top"))

    return F.least(F.lit(1.0), F.aggregate(counts, zero, step, lambda s: s.top) / F.greatest(F.size(counts), F.lit(1)))


def boundary_signals(events: DataFrame, terms: list[str]) -> DataFrame:
    """``events`` with the seven boundary signals and their sum ``score``. (BT-01 to BT-08)

    All are frames of at most four rows on either side, so one sort of each
    session serves them all. ``terms`` is a short glossary, matched as
    substrings; a term counts where the four events before, joined by spaces,
    don't have it. Density counts the rolls of every event, those in speech too.
    """
    w = W.partitionBy("session_id").orderBy("ord")
    left, right = w.rowsBetween(-4, -1), w.rowsBetween(0, 3)
    before_kind, silence = F.lag("kind").over(w), F.lag(F.col("t_end_s") - F.col("t_start_s")).over(w)
    said = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    npc = F.when(F.col("is_npc"), F.col("character_id"))
    distance = lambda c: _jaccard_distance(F.collect_set(c).over(left), F.collect_set(c).over(right))
    quiet = (before_kind == "gap") & (silence >= SILENCE_S)
    fresh = F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(F.col("_said"), t) & ~F.contains(F.col("_prior"), t)) if terms else F.lit(False)
    out = (
        events.withColumn("_said", said)
        .withColumn("_n", F.size("rolls").cast("double"))
        .withColumn("_prior", F.array_join(F.collect_list("_said").over(left), " "))
        .withColumn("_mean", F.avg("_n").over(left))
        .withColumn("silence", F.when(quiet, F.least(F.lit(2.0), silence / SILENCE_S) * WEIGHTS["silence"]).otherwise(0.0))
        .withColumn("turnorder", F.when(F.col("kind").isin("combat_start", "combat_end"), WEIGHTS["turnorder"]).otherwise(0.0))
        .withColumn("density", F.when(F.col("_mean").isNull(), 0.0).otherwise(_cusum(F.collect_list("_n").over(right), F.col("_mean")) * WEIGHTS["density"]))
        .withColumn("speakers", distance("player_id") * WEIGHTS["speakers"])
        .withColumn("characters", distance(npc) * WEIGHTS["characters"])
        .withColumn("glossary", F.when(fresh, WEIGHTS["glossary"]).otherwise(0.0))
        .withColumn("narration", F.when(quiet & F.col("is_dm") & (F.col("mode") == "narration"), WEIGHTS["narration"]).otherwise(0.0))
        .drop("_said", "_prior", "_n", "_mean")
    )
    return out.withColumn("score", F.round(sum((F.coalesce(F.col(k), F.lit(0.0)) for k in WEIGHTS), F.lit(0.0)), 6))


def boundary_candidates(scored: DataFrame) -> DataFrame:
    """Events after a session's first whose score is positive, with rank and the names of the signals. (BT-08)"""
    named = F.array_compact(F.array(*[F.when(F.col(k) > 0, F.lit(k)) for k in WEIGHTS]))
    w = W.partitionBy("session_id").orderBy(F.desc("score"), "ord")
    return scored.where("score > 0 AND ord > 1").select("session_id", "ord", "t_start_s", "score", named.alias("signals"), F.row_number().over(w).cast("long").alias("rank"))


def pick_peaks(candidates: DataFrame, bounds: DataFrame, spacing: float = SPACING_S) -> DataFrame:
    """(session_id, ord, t_start_s): candidates by falling score that keep ``spacing`` to those taken and to the bounds. (BT-09)

    Sessions stream through their tasks by falling score. What is taken is kept
    by stretches of one spacing, of which each holds one peak at most, so a
    candidate is compared with three of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, taken = None, {}
        for batch in batches:
            keep = []
            for i, (own, t, start, end) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("session_id", "t_start_s", "start_s", "end_s")))):
                if own != session:
                    session, taken = own, {}
                at = math.floor(t / spacing)
                if t - start >= spacing and end - t >= spacing and all(abs(taken.get(k, math.inf) - t) >= spacing for k in (at - 1, at, at + 1)):
                    taken[at] = t
                    keep.append(i)
            if keep:
                yield batch.take(pa.array(keep)).select(["session_id", "ord", "t_start_s"])

    rows = candidates.join(bounds, "session_id").select("session_id", "ord", "t_start_s", "start_s", "end_s", "score")
    ordered = rows.repartition("session_id").sortWithinPartitions("session_id", F.desc("score"), "ord")
    return ordered.mapInArrow(run, rows.select("session_id", "ord", "t_start_s").schema)


def merge_short(events: DataFrame, cuts: DataFrame, least: float) -> DataFrame:
    """(session_id, ord, t_start_s): cuts without those that leave a span shorter than ``least``. (BT-10)

    A short span joins the one before, but the first of a session and those
    that open with the start of a combat or of the session join the one after; the
    last, having none after, the one before. A span lasts from the start of
    its first event to the end of its last. The spans of a session, which its
    cuts bound, are folded in order.
    """
    first, last = lambda c: F.min_by(c, "ord"), lambda c: F.max_by(c, "ord")
    opens = F.col("kind").isin("session_start", "combat_start")
    spans = assign_beats(events, cuts).groupBy("session_id", "beat").agg(F.min("ord").alias("ord"), first("t_start_s").alias("t0"), last("t_end_s").alias("t1"), F.coalesce(first(F.coalesce(opens, F.lit(False))), F.lit(False)).alias("opens"))
    listed = spans.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("ord", "t0", "t1", "opens"))).alias("s"))
    waiting = "struct<ord:bigint,t0:double,opens:boolean>"
    start = F.struct(F.lit(None).cast(waiting).alias("wait"), F.array().cast("array<struct<ord:bigint,t0:double>>").alias("out"))

    def step(s, x):
        own = F.coalesce(s["wait"], F.struct(x["ord"].alias("ord"), x["t0"].alias("t0"), x["opens"].alias("opens")))
        short = x["t1"] - own["t0"] < least
        forward = short & (own["opens"] | (F.size(s["out"]) == 0))
        return F.struct(F.when(forward, own).alias("wait"), F.when(short, s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(own["ord"].alias("ord"), own["t0"].alias("t0"))))).alias("out"))

    kept = listed.select("session_id", F.explode(F.aggregate("s", start, step, lambda s: F.slice(s["out"], 2, F.greatest(F.size(s["out"]), F.lit(1))))).alias("p"))
    return kept.select("session_id", F.col("p.ord").alias("ord"), F.col("p.t0").alias("t_start_s"))


def assign_beats(events: DataFrame, cuts: DataFrame) -> DataFrame:
    """Events with ``beat``: 1 plus the number of cuts at or before. (BT-11)"""
    marked = events.join(cuts.select("session_id", "ord", F.lit(1).alias("_cut")), ["session_id", "ord"], "left")
    w = W.partitionBy("session_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    return marked.withColumn("beat", (1 + F.coalesce(F.sum("_cut").over(w), F.lit(0))).cast("long")).drop("_cut")


def beats(assigned: DataFrame, terms: list[str]) -> DataFrame:
    """One row per beat: class, roll counts by kind, ratio of speech in character, participants, title. (BT-12 to BT-15)

    Columns: session_id, beat, kind, t_start_s, t_end_s (of its last event),
    n_events, ratio, participants (characters who speak, by id), dominant (by
    falling airtime, then id), title, and n_ for each kind of roll. Rows are
    combined for each character of a beat first. A word or term is found in an
    event's text or across its border with the event before.
    """
    speech, long_ = F.col("kind") == "speech", F.greatest(F.lit(0.0), F.col("t_end_s") - F.col("t_start_s"))
    own = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    joined = F.concat_ws(" ", F.lag(own).over(W.partitionBy("session_id", "beat").orderBy("ord")), own)
    told = assigned.withColumn("_text", joined)
    flag = lambda c: F.max(F.when(c, 1).otherwise(0))
    of_kind = lambda k: F.size(F.filter("rolls", lambda r: r.kind == k))
    has = lambda p: flag(F.col("_text").rlike(ascii_edges(p)))
    flags = {
        "_combat": flag(F.col("kind").isin("combat_start", "combat_end", "turnorder") | F.exists("rolls", lambda r: r.kind.isin(COMBAT_ROLLS))),
        "_aside": flag(speech & F.col("mode").isin("out_of_character", "non_speech")),
        "_recap": has(RECAP), "_table": has(TABLE), "_plan": has(PLAN),
        **{f"_t{i}": flag(F.contains("_text", F.lit(t.lower()))) for i, t in enumerate(terms)},
    }
    sums = {
        "n_events": F.count("*"), "_speeches": F.count_if(speech), "_all": F.sum(F.when(speech, long_).otherwise(0.0)), "_in": F.sum(F.when(speech & (F.col("mode") == "in_character"), long_).otherwise(0.0)),
        **{f"n_{k}": F.sum(of_kind(k)).cast("long") for k in KINDS},
    }
    per = told.groupBy("session_id", "beat", "character_id").agg(
        F.min("t_start_s").alias("t_start_s"), F.max(F.struct("ord", "t_end_s")).alias("_last"), F.collect_set(F.nullif("character_display", F.lit(""))).alias("_names"),
        *[c.alias(k) for k, c in flags.items()], *[c.alias(k) for k, c in sums.items()],
    )
    air = F.when(F.col("character_id").isNotNull() & (F.col("_speeches") > 0), F.struct((-F.round("_all", 9)).alias("s"), F.col("character_id").alias("id")))
    base = per.groupBy("session_id", "beat").agg(
        F.min("t_start_s").alias("t_start_s"), F.max("_last")["t_end_s"].alias("t_end_s"), F.array_sort(F.collect_list(air)).alias("_air"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_names")))).alias("_names"),
        *[F.max(k).alias(k) for k in flags], *[F.sum(k).alias(k) for k in sums],
    )
    yes = lambda k: F.col(k) == 1
    kind = (
        F.when(yes("_combat"), "combat").when(yes("_recap"), "recap").when(yes("_aside") | yes("_table"), "table").when(yes("_plan"), "planning")
        .when((F.col("_speeches") > 1) & (F.size("_air") > 1), "social").otherwise("exploration")
    )
    dominant = F.transform("_air", lambda x: x.id)
    place = F.coalesce(*[F.when(yes(f"_t{i}"), F.lit(t)) for i, t in enumerate(terms)], F.nullif(F.array_join(F.slice("_names", 1, 2), " + "), F.lit("")), F.concat(F.lit("segment "), F.col("beat")))
    titled = base.withColumn("kind", kind).withColumn("_base", F.concat("kind", F.lit(": "), place)).withColumn("ratio", F.round(F.when(F.col("_all") > 0, F.col("_in") / F.col("_all")).otherwise(0.0), 6))
    nth = F.row_number().over(W.partitionBy("session_id", "_base").orderBy("beat"))
    title = F.when(nth == 1, F.col("_base")).otherwise(F.concat("_base", F.lit(" ("), nth, F.lit(")")))
    return titled.select("session_id", "beat", "kind", "t_start_s", "t_end_s", "n_events", "ratio", F.array_sort(dominant).alias("participants"), dominant.alias("dominant"), title.alias("title"), *[f"n_{k}" for k in KINDS])


def segmentation_metrics(found: DataFrame, truth: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(session_id, count_error, class_accuracy, boundary_accuracy) by position, as shares of the true beats. (BT-16)

    A boundary is right where both its start and its end are within the tolerance.
    """
    a = found.select("session_id", "beat", F.col("kind").alias("_k"), F.col("t_start_s").alias("_s"), F.col("t_end_s").alias("_e"))
    b = truth.select("session_id", "beat", F.col("kind").alias("_tk"), F.col("t_start_s").alias("_ts"), F.col("t_end_s").alias("_te"))
    both = a.join(b, ["session_id", "beat"], "full_outer")
    n, nt = F.count("_k"), F.count("_tk")
    share = lambda c: F.round(F.sum(F.when(c, 1.0).otherwise(0.0)) / F.greatest(nt, F.lit(1)), 6)
    near = (F.abs(F.col("_s") - F.col("_ts")) <= tolerance) & (F.abs(F.col("_e") - F.col("_te")) <= tolerance)
    return both.groupBy("session_id").agg(F.round(F.abs(n - nt) / F.greatest(nt, F.lit(1)), 6).alias("count_error"), share(F.col("_k") == F.col("_tk")).alias("class_accuracy"), share(near).alias("boundary_accuracy"))


def combat_markers(turnorder: DataFrame) -> DataFrame:
    """Turn-order snapshots with ``marker``: started, ended or changed. (SRC-18)"""
    w = W.partitionBy("session_id").orderBy("seq")
    full = F.col("n_entries") > 0
    was = F.lag(full, 1, False).over(w)
    return turnorder.withColumn("marker", F.when(full & ~was, "started").when(~full & was, "ended").otherwise("changed"))
