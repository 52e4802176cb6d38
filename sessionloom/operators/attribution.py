"""Operators that decide who speaks as whom: evidence, scores, bands, smoothing, review."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ascii_edges
from .intervals import band_join, point_join

# Fixed values.
IN_CHARACTER, OUT_OF_CHARACTER, SIM_LEAST, SIM_LEAD, SHORTEST_S = 0.65, 0.35, 0.5, 0.08, 0.6
WEIGHTS = {
    "bias": 0.0, "voice_sim_table": 0.9, "voice_sim_character": 1.2, "voice_margin": 1.1, "prosody_f0_mean": 0.02, "prosody_f0_std": 0.02, "prosody_f0_range": 0.02, "prosody_rate_wps": 0.02, "prosody_intensity_mean": 0.02,
    "prosody_intensity_std": 0.02, "prosody_spectral_tilt": 0.02, "prosody_jitter_proxy": 0.02, "prosody_pause_ratio": 0.02, "lex_ooc": -1.1, "lex_ic": 0.8, "roll_prox": -0.45, "chat_prox": -0.35,
    "addressee_character": 0.35, "addressee_dm": -0.2, "duration": 0.05, "backchannel": -0.2, "overlap": -0.15,
}
AMBIGUITY_FLAGS = ["uncertain", "no_profiles", "too_short"]
SMOOTH_MOST = 0.62
DECAY_S, DECAY_POINTS, NEAR_S, BANK_POINTS, ROLL_POINTS, ADDRESS_POINTS, WIN_MARGIN = 45.0, 8.0, 3.0, 3.0, 2.0, 4.0, 1.5
NARRATION = r"^(the|a|an)\s|\b(he|she|they|it)\s+(was|were|is|are|had|has|walked|looked|said|stood)\b|\b(says?|asks?|shouts?)\s*[:,]"
DIRECT = r"\b(i|me|my|we|our|you|your)\b"
QUOTE = r'"[^"]+"|“[^”]+”|‘[^’]+’'


def evidence(utterances: DataFrame, scores: DataFrame, similarities: DataFrame, anchors: DataFrame, active: DataFrame, slack: float = 2.0) -> DataFrame:
    """One row per utterance with all that a score needs. (AT-01)

    ``utterances`` have overlap_ids and is_backchannel, ``anchors`` (session_id,
    t_audio_s, uncertainty_s) a row for each roll: a roll is near where an
    utterance's middle is within its own uncertainty and ``slack``. That join is
    reduced to a flag, similarities to the best of either kind, before they
    are joined back; the margin is null unless both kinds are known. ``active``
    (session_id, character_id) become a sorted list of each session.
    """
    reach = F.col("uncertainty_s") + slack
    spans = anchors.select("session_id", (F.col("t_audio_s") - reach).alias("_from"), (F.col("t_audio_s") + reach).alias("_to"))
    near = point_join(utterances.select("session_id", "utt_id", "mid_s"), spans, ["session_id"], "mid_s", ("_from", "_to")).select("session_id", "utt_id").distinct().withColumn("roll_prox", F.lit(1.0))
    best = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("similarity"))).alias(f"voice_sim_{kind}")
    sims = similarities.groupBy("session_id", "utt_id").agg(best("table"), best("character"))
    present = active.groupBy("session_id").agg(F.sort_array(F.collect_set("character_id")).alias("active_character_ids"))
    out = utterances.join(scores, "utt_id", "left").join(sims, ["session_id", "utt_id"], "left").join(near, ["session_id", "utt_id"], "left").join(present, "session_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return (
        out.withColumn("voice_margin", F.col("voice_sim_character") - F.col("voice_sim_table"))
        .withColumn("roll_prox", F.coalesce("roll_prox", F.lit(0.0)))
        .withColumn("overlap", flag(F.size("overlap_ids") > 0))
        .withColumn("backchannel", flag(F.col("is_backchannel")))
        .withColumn("active_character_ids", F.coalesce("active_character_ids", F.array().cast("array<string>")))
    )


def weighted_score(columns: list[str], weights: dict[str, float] = WEIGHTS) -> Column:
    """Sigmoid of the weighted evidence among ``columns``; nulls and absent columns are 0, the duration at most 20. (AT-02)"""
    z = F.lit(weights["bias"])
    for k, w in weights.items():
        if k in columns:
            x = F.coalesce(F.col(k).cast("double"), F.lit(0.0))
            z = z + w * (F.least(x, F.lit(20.0)) if k == "duration" else x)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def banded(scored: DataFrame) -> DataFrame:
    """mode and flags from the score, with overrides in order. (AT-03)"""
    none, quoted, short = F.col("n_profiles") == 0, F.col("n_quotes") > 0, F.col("duration") < SHORTEST_S
    mode = F.when(none, "uncertain").when(quoted, "narration").when(short, "uncertain").when(F.col("score") >= IN_CHARACTER, "in_character").when(F.col("score") <= OUT_OF_CHARACTER, "out_of_character").otherwise("uncertain")
    middle = (F.col("score") < IN_CHARACTER) & (F.col("score") > OUT_OF_CHARACTER)
    flags = F.array_compact(F.array(F.when(none, "no_profiles"), F.when(quoted, "quoted"), F.when(short, "too_short"), F.when(middle, "uncertain")))
    return scored.withColumn("mode", mode).withColumn("flags", flags)


def nearest_character(similarities: DataFrame, active: DataFrame) -> DataFrame:
    """(utt_id, character_id, similarity): the nearest active character, if near enough and ahead of the next. (AT-04)"""
    held = similarities.join(active, ["session_id", "character_id"], "left_semi")
    w = W.partitionBy("utt_id").orderBy(F.desc("similarity"), "character_id")
    ranked = held.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead("similarity").over(w))
    good = (F.col("similarity") >= SIM_LEAST) & (F.col("_next").isNull() | (F.round(F.col("similarity") - F.col("_next"), 9) >= SIM_LEAD))
    return ranked.where(F.col("_r") == 1).where(good).select("utt_id", "character_id", "similarity")


def evidence_record(similarities: DataFrame) -> DataFrame:
    """(utt_id, n, first, second, margin). (AT-05)"""
    s = F.sort_array(F.collect_list("similarity"), asc=False)
    g = similarities.groupBy("utt_id").agg(F.count("*").alias("n"), s.alias("s"))
    return g.select("utt_id", "n", F.try_element_at("s", F.lit(1)).alias("first"), F.coalesce(F.try_element_at("s", F.lit(2)), F.lit(0.0)).alias("second")).withColumn("margin", F.round(F.col("first") - F.col("second"), 6))


def quote_children(spans: DataFrame, nearest: DataFrame) -> DataFrame:
    """One row per quoted span with its utterance's character. (AT-06)"""
    return spans.join(nearest.select("utt_id", "character_id"), "utt_id", "left")


def smoothed(attributions: DataFrame, most: float = SMOOTH_MOST) -> DataFrame:
    """A weak decision between two equal neighbours takes their mode; later rows see earlier changes. (AT-07)

    A row next to a changed one never changes: the mode that the change brought
    in is its own. So of a run of rows that would change by the modes given,
    the first, third and so on do, and windows are enough.
    """
    w = W.partitionBy("session_id").orderBy("ord", "utt_id")
    before, after = F.lag("mode").over(w), F.lead("mode").over(w)
    weak = F.coalesce((before == after) & (F.col("mode") != before) & (F.col("confidence") <= most), F.lit(False))
    held = attributions.select("session_id", "ord", "utt_id", "mode", "confidence", weak.alias("_weak"), before.alias("_before"), F.row_number().over(w).alias("_n"))
    ended = F.max(F.when(~F.col("_weak"), F.col("_n"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    flip = F.col("_weak") & ((F.col("_n") - F.coalesce("_ended", F.lit(0))) % 2 == 1)
    return held.withColumn("_ended", ended).select("session_id", "ord", "utt_id", F.when(flip, F.col("_before")).otherwise(F.col("mode")).alias("mode"), "confidence", flip.alias("smoothed"))


def mode_summary(attributions: DataFrame) -> DataFrame:
    """(session_id, n of each mode, in-character rows without a character). (AT-08)"""
    n = lambda m: F.count_if(F.col("mode") == m).alias(m)
    return attributions.groupBy("session_id").agg(n("in_character"), n("out_of_character"), n("narration"), n("uncertain"), F.count_if((F.col("mode") == "in_character") & F.col("character_id").isNull()).alias("unknown_character"))


def mode_accuracy(attributions: DataFrame, truth: DataFrame) -> DataFrame:
    """(mode, n, accuracy) against the truth's modes. (AT-09)"""
    both = attributions.select("utt_id", F.col("mode").alias("_m")).join(truth.select("utt_id", "mode"), "utt_id")
    return both.groupBy("mode").agg(F.count("*").alias("n"), F.round(F.avg((F.col("_m") == F.col("mode")).cast("double")), 6).alias("accuracy"))


def flag_entries(attributions: DataFrame) -> DataFrame:
    """(session_id, utt_id, code, severity): errors only for missing profiles. (AT-11)"""
    return attributions.select("session_id", "utt_id", F.explode("flags").alias("code")).withColumn("severity", F.when(F.col("code") == "no_profiles", "error").otherwise("info"))


def pending_adjudications(attributions: DataFrame, cache: DataFrame, provider: str, system: str) -> DataFrame:
    """Uncertain spans with their content key, less those already answered. (AT-12)"""
    key = F.sha2(F.to_json(F.struct(F.lit(provider).alias("provider"), F.lit(system).alias("system"), "text")), 256)
    return attributions.where("mode = 'uncertain'").withColumn("key", key).join(cache.select("key").distinct(), "key", "left_anti")


def apply_adjudications(attributions: DataFrame, answers: DataFrame) -> DataFrame:
    """Accept answers that name a listed candidate and claim no more confidence than the score had. (AT-13)"""
    a = answers.select("utt_id", F.col("mode").alias("_m"), F.col("confidence").alias("_c"))
    held = attributions.join(a, "utt_id", "left")
    fine = F.coalesce(F.array_contains("candidates", F.col("_m")) & (F.col("_c") <= F.col("confidence")), F.lit(False))
    out = held.withColumn("status", F.when(F.col("_m").isNull(), "none").when(fine, "accepted").otherwise("rejected"))
    return out.withColumn("source", F.when(fine, "llm").otherwise(F.col("source"))).withColumn("flags", F.when(fine, F.array_append("flags", F.lit("adjudicated"))).otherwise(F.col("flags"))).withColumn("mode", F.when(fine, F.col("_m")).otherwise(F.col("mode"))).drop("_m", "_c")


def revert_adjudications(attributions: DataFrame) -> DataFrame:
    """Adjudicated rows count as deterministic again; their mode stays and is noted. (AT-14)"""
    was = F.col("source") == "llm"
    return attributions.withColumn("overridden_from", F.when(was, F.col("mode"))).withColumn("flags", F.when(was, F.filter("flags", lambda f: f != "adjudicated")).otherwise(F.col("flags"))).withColumn("source", F.when(was, "deterministic").otherwise(F.col("source")))


def review_queue(attributions: DataFrame) -> DataFrame:
    """Flagged rows with impact and place: doubt times duration, largest first. (AT-15)"""
    q = attributions.where(F.size("flags") > 0).withColumn("flag", F.element_at("flags", 1)).withColumn("impact", F.round(F.greatest(F.lit(0.0), 1 - F.col("confidence")) * F.col("duration"), 6))
    return q.withColumn("place", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("impact"), "start_s", "utt_id")).cast("long"))


def apply_reviews(attributions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions by utterance or by cluster change the mode and clear the ambiguity flags. (AT-16)"""
    d = decisions.select(F.col("target").alias("_t"), F.col("mode").alias("_m"))
    one = attributions.join(d.withColumnRenamed("_m", "_um"), attributions.utt_id == F.col("_t"), "left").drop("_t")
    both = one.join(d.withColumnRenamed("_m", "_cm"), F.col("cluster_id") == F.col("_t"), "left").drop("_t").withColumn("_m", F.coalesce("_um", "_cm"))
    cleared = F.filter("flags", lambda f: ~f.isin(AMBIGUITY_FLAGS))
    return both.withColumn("flags", F.when(F.col("_m").isNotNull(), cleared).otherwise(F.col("flags"))).withColumn("mode", F.coalesce("_m", "mode")).withColumn("reviewed", F.col("_m").isNotNull()).drop("_m", "_um", "_cm")


def narrator_mode(text: Column) -> Column:
    """voice if quoted, or in the first or second person without a narration pattern; else narration. (NP-01)"""
    low = F.lower(text)
    return F.when(text.rlike(QUOTE) | (low.rlike(ascii_edges(DIRECT)) & ~low.rlike(ascii_edges(NARRATION))), "voice").otherwise("narration")


def discovered_names(utterances: DataFrame, stop: list[str]) -> DataFrame:
    """(session_id, name, first_s): capitalised words and when they were first said. (NP-02)"""
    found = utterances.select("session_id", "start_s", F.explode(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z])([A-Z][a-z]{2,})(?![A-Za-z])"), F.lit(1))).alias("name"))
    return found.where(~F.lower("name").isin(stop)).groupBy("session_id", "name").agg(F.min("start_s").alias("first_s"))


def active_name(utterances: DataFrame, mentions: DataFrame) -> DataFrame:
    """Utterances with the name mentioned last at or before their start. (NP-03)"""
    from .intervals import as_of

    return as_of(utterances, mentions.withColumn("mention_s", F.col("start_s")), ["session_id"], "start_s", "start_s", ["name"], ["name", "mention_s"])


def window_evidence(active: DataFrame) -> DataFrame:
    """(session_id, utt_id, name, evidence): fading with the time since the mention. (NP-04)"""
    age = F.col("start_s") - F.col("mention_s")
    return active.where(F.col("name").isNotNull() & (age <= DECAY_S)).select("session_id", "utt_id", "name", F.round(DECAY_POINTS * (1 - age / DECAY_S), 6).alias("evidence"))


def bank_evidence(utterances: DataFrame, profiles: DataFrame) -> DataFrame:
    """(session_id, utt_id, name, evidence): points for the profile of the same cluster. (NP-05)"""
    return utterances.join(profiles, "cluster_id").select("session_id", "utt_id", "name", F.lit(BANK_POINTS).alias("evidence"))


def roll_mention_evidence(utterances: DataFrame, mentions: DataFrame) -> DataFrame:
    """(session_id, utt_id, name, evidence): points per roll that names a character nearby in time. (NP-06)"""
    met = band_join(utterances.select("session_id", "utt_id", "start_s"), mentions.select("session_id", "name", "t_s"), ["session_id"], "start_s", "t_s", DECAY_S, DECAY_S)
    return met.groupBy("session_id", "utt_id", "name").agg((F.count("*") * ROLL_POINTS).alias("evidence"))


def address_evidence(utterances: DataFrame, mentions: DataFrame) -> DataFrame:
    """(session_id, utt_id, name, evidence): names that another player said just before, with nobody between. (NP-07)"""
    w = W.partitionBy("session_id").orderBy("start_s", "utt_id")
    prev = utterances.withColumn("_p", F.lag("utt_id").over(w)).withColumn("_pp", F.lag("player_id").over(w)).withColumn("_pe", F.lag("end_s").over(w))
    near = prev.where((F.col("_pp") != F.col("player_id")) & (F.col("start_s") - F.col("_pe") <= NEAR_S))
    said = mentions.select("session_id", F.col("utt_id").alias("_p"), "name").distinct()
    return near.join(said, ["session_id", "_p"]).select("session_id", "utt_id", "name", F.lit(ADDRESS_POINTS).alias("evidence"))


def continuity(evidence_rows: DataFrame, narrator: DataFrame) -> DataFrame:
    """(session_id, utt_id, name, total): evidence with the fading lead of the previous winner. (NP-08)

    The winner feeds back, so one session's evidence is folded in order in one
    task; rows are bounded by a session's narrator speeches and names.
    """

    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["start_s"], pdf["utt_id"], pdf["interrupted"], pdf["evidence"]), key=lambda r: r[:2])
        out, last, last_s = [], None, 0.0
        for start, utt, interrupted, found in rows:
            if interrupted:
                last = None
            total = {e["name"]: e["evidence"] for e in found}
            if last is not None and start - last_s <= DECAY_S:
                total[last] = total.get(last, 0.0) + round(2.0 * (1 - (start - last_s) / DECAY_S), 6)
            out += [(key[0], utt, n, float(t)) for n, t in total.items()]
            if total:
                last, last_s = min(total, key=lambda n: (-total[n], n)), start
        return pd.DataFrame(out, columns=["session_id", "utt_id", "name", "total"])

    summed = evidence_rows.groupBy("session_id", "utt_id", "name").agg(F.sum("evidence").alias("evidence"))
    listed = summed.where("name IS NOT NULL").groupBy("session_id", "utt_id").agg(F.array_sort(F.collect_list(F.struct("name", "evidence"))).alias("evidence"))
    rows = narrator.select("session_id", "utt_id", "start_s", "interrupted").join(listed, ["session_id", "utt_id"], "left")
    rows = rows.withColumn("evidence", F.coalesce("evidence", F.array().cast(listed.schema["evidence"].dataType)))
    return rows.groupBy("session_id").applyInPandas(run, "session_id long, utt_id string, name string, total double")


def winners(totals: DataFrame, known: DataFrame, margin: float = WIN_MARGIN) -> DataFrame:
    """(session_id, utt_id, name): the leading known name if it leads by enough. (NP-09)"""
    w = W.partitionBy("session_id", "utt_id").orderBy(F.desc("total"), "name")
    ranked = totals.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.coalesce(F.lead("total").over(w), F.lit(0.0)))
    return ranked.where((F.col("_r") == 1) & (F.round(F.col("total") - F.col("_next"), 6) >= margin)).join(known, "name", "left_semi").select("session_id", "utt_id", "name")


def proposals(evidence_rows: DataFrame, clusters: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """(cluster_id, name, n): unknown names met at least twice with a voice cluster. (NP-10)"""
    met = evidence_rows.join(clusters, ["session_id", "utt_id"]).join(known, "name", "left_anti")
    return met.groupBy("cluster_id", "name").agg(F.count_distinct("session_id", "utt_id").alias("n")).where(F.col("n") >= least)
