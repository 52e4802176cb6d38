"""Operators on timed speech: validation, splitting, overlap, bleed, speech time.

Tables have session_id; windows and joins lead with it, so sessions are
independent and spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import comparison_text, text_similarity
from .graph import connected_components
from .intervals import band_join, interval_join

# Fixed values.
WORD_GAP_S, OVERLAP_S, BLEED_S, BLEED_SIMILARITY, BACKCHANNEL_S = 0.75, 0.2, 0.75, 0.85, 1.5
BACKCHANNELS = ["yeah", "yea", "yes", "yep", "yup", "mhm", "mm hm", "uh huh", "uhhuh", "okay", "ok", "right", "sure", "no", "nope", "hmm", "hm", "mm", "got it", "gotcha", "all right", "alright"]


def validate_segments(segments: DataFrame) -> DataFrame:
    """Segments with ``valid`` and energy clamped at 0: finite bounds, start >= 0, end > start. (TR-01)"""
    fine = F.col("start_s").isNotNull() & F.col("end_s").isNotNull() & ~F.isnan("start_s") & ~F.isnan("end_s") & (F.col("start_s") >= 0) & (F.col("end_s") > F.col("start_s")) & (F.col("end_s") < float("inf"))
    return segments.withColumn("valid", F.coalesce(fine, F.lit(False))).withColumn("energy", F.greatest(F.coalesce("energy", F.lit(0.0)), F.lit(0.0)))


def strict_segments(segments: DataFrame) -> DataFrame:
    """Valid segments; the query fails at the first other one."""
    checked = validate_segments(segments)
    return checked.withColumn("valid", F.when(F.col("valid"), True).otherwise(F.raise_error(F.lit("segment with bad bounds")).cast("boolean"))).where("valid").drop("valid")


def canonical_words(words: Column) -> Column:
    """array<struct<t,s,e>> without invalid words, in ms, ordered by (s, e, t). (TR-02)"""
    rounded = F.transform(words, lambda w: F.struct(F.round(w.s, 3).alias("s"), F.round(w.e, 3).alias("e"), F.trim(w.t).alias("t")))
    kept = F.filter(rounded, lambda w: (w.t != "") & w.s.isNotNull() & w.e.isNotNull() & (w.s >= 0) & (w.e >= w.s))
    return F.transform(F.array_sort(kept), lambda w: F.struct(w.t.alias("t"), w.s.alias("s"), w.e.alias("e")))


def attach_energy(segments: DataFrame, vad: DataFrame) -> DataFrame:
    """Energy of the speech window with the largest overlap, the first of equals; 0 without. (TR-03)"""
    v = vad.select("session_id", "track_id", F.col("idx").alias("_idx"), F.col("start_s").alias("_vs"), F.col("end_s").alias("_ve"), F.col("mean_rms").alias("_rms"))
    keyed = segments.drop("energy")
    met = interval_join(keyed.select("session_id", "track_id", "utt_id", "start_s", "end_s"), v, ["session_id", "track_id"], ("start_s", "end_s", "_vs", "_ve"), 20.0)
    overlap = F.least("end_s", "_ve") - F.greatest("start_s", "_vs")
    best = met.withColumn("_o", overlap).where("_o > 0").groupBy("session_id", "utt_id").agg(F.max_by("_rms", F.struct("_o", -F.col("_idx"))).alias("energy"))
    return keyed.join(best, ["session_id", "utt_id"], "left").withColumn("energy", F.coalesce("energy", F.lit(0.0)))


def split_at_gaps(words: DataFrame, gap: float = WORD_GAP_S) -> DataFrame:
    """Parts of utterances between pauses longer than ``gap``: (session_id, utt_id, part, start_s, end_s, n_words, text). (TR-04)"""
    w = W.partitionBy("session_id", "utt_id").orderBy("s", "e", "pos")
    new = F.when(F.col("s") - F.lag("e").over(w) > gap, 1).otherwise(0)
    parts = words.withColumn("_new", new).withColumn("part", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    listed = F.array_sort(F.collect_list(F.struct("s", "e", "pos", "t")))
    return parts.groupBy("session_id", "utt_id", "part").agg(F.min("s").alias("start_s"), F.max("e").alias("end_s"), F.count("*").alias("n_words"), F.array_join(F.transform(listed, lambda x: x.t), " ").alias("text"))


def ordered_ids(utterances: DataFrame) -> DataFrame:
    """``id`` u000001… in the order start, track, end, text, source index. (TR-05)"""
    w = W.partitionBy("session_id").orderBy("start_s", "track_id", "end_s", "text", "source_index")
    return utterances.withColumn("id", F.format_string("u%06d", F.row_number().over(w)))


def overlap_pairs(utterances: DataFrame, least: float = OVERLAP_S, width: float = 20.0) -> DataFrame:
    """(session_id, a, b): utterances of different tracks that share more than ``least`` seconds, either way round. (TR-06)"""
    cols = ["utt_id", "track_id", "start_s", "end_s"]
    a = utterances.select("session_id", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = utterances.select("session_id", *[F.col(c).alias(f"b_{c}") for c in cols])
    met = interval_join(a, b, ["session_id"], ("a_start_s", "a_end_s", "b_start_s", "b_end_s"), width)
    return met.where((F.col("a_track_id") != F.col("b_track_id")) & (F.least("a_end_s", "b_end_s") - F.greatest("a_start_s", "b_start_s") > least)).select("session_id", F.col("a_utt_id").alias("a"), F.col("b_utt_id").alias("b"))


def overlap_ids(utterances: DataFrame) -> DataFrame:
    """Each utterance with the sorted ids it overlaps."""
    found = overlap_pairs(utterances).groupBy("session_id", F.col("a").alias("utt_id")).agg(F.sort_array(F.collect_set("b")).alias("overlap_ids"))
    return utterances.join(found, ["session_id", "utt_id"], "left").withColumn("overlap_ids", F.coalesce("overlap_ids", F.array().cast("array<string>")))


def bleed_edges(utterances: DataFrame, within: float = BLEED_S, similarity: float = BLEED_SIMILARITY) -> DataFrame:
    """(session_id, a, b, a_track, b_track, a_energy, b_energy): likely copies of one speech in two tracks, a < b. (TR-09)

    The time band is joined and checked before any text is compared.
    """
    base = utterances.withColumn("_cmp", comparison_text(F.col("text")))
    cols = ["utt_id", "track_id", "start_s", "energy", "source_index", "_cmp"]
    a = base.select("session_id", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = base.select("session_id", *[F.col(c).alias(f"b_{c}") for c in cols])
    met = band_join(a, b, ["session_id"], "a_start_s", "b_start_s", within, within)
    near = met.where((F.col("a_utt_id") < F.col("b_utt_id")) & (F.col("a_track_id") != F.col("b_track_id")))
    return near.where(text_similarity(F.col("a__cmp"), F.col("b__cmp")) >= similarity).drop("a__cmp", "b__cmp")


def bleed_components(edges: DataFrame) -> DataFrame:
    """(session_id, utt_id, component) of the ends of bleed edges. (TR-10)"""
    key = lambda c: F.struct("session_id", c)
    found = connected_components(edges.select(key("a_utt_id").alias("src"), key("b_utt_id").alias("dst")).select(F.struct(F.col("src.session_id").alias("s"), F.col("src.a_utt_id").alias("u")).alias("src"), F.struct(F.col("dst.session_id").alias("s"), F.col("dst.b_utt_id").alias("u")).alias("dst")))
    return found.select(F.col("v.s").alias("session_id"), F.col("v.u").alias("utt_id"), F.col("component.u").alias("component"))


def bleed_primary(utterances: DataFrame, components: DataFrame) -> DataFrame:
    """Members of components with ``bleed_of``: the loudest copy's id, null for itself. (TR-11)"""
    w = W.partitionBy("session_id", "component").orderBy(F.round("energy", 12).desc(), "track_id", "source_index")
    ranked = utterances.join(components, ["session_id", "utt_id"]).withColumn("_first", F.first("utt_id").over(w))
    return ranked.select("session_id", "utt_id", "component", F.when(F.col("_first") != F.col("utt_id"), F.col("_first")).alias("bleed_of"))


def bleed_warnings(edges: DataFrame) -> DataFrame:
    """One row per session and pair of tracks, naming the louder end of its last edge. (TR-12)"""
    louder = F.when((F.round("a_energy", 12) > F.round("b_energy", 12)) | ((F.round("a_energy", 12) == F.round("b_energy", 12)) & (F.col("a_track_id") < F.col("b_track_id"))), F.col("a_utt_id")).otherwise(F.col("b_utt_id"))
    return edges.groupBy("session_id", F.least("a_track_id", "b_track_id").alias("track_a"), F.greatest("a_track_id", "b_track_id").alias("track_b")).agg(F.max_by(louder, F.struct("a_source_index", "b_source_index")).alias("primary"), F.count("*").alias("n_edges"))


def is_backchannel(text: Column, duration: Column) -> Column:
    """Short and nothing but an acknowledgement. (TR-13)"""
    return (duration <= BACKCHANNEL_S) & comparison_text(text).isin(BACKCHANNELS)


def speech_seconds(tracks: DataFrame, vad: DataFrame) -> DataFrame:
    """Seconds of speech per player, 0 for players without any. (TR-14)"""
    total = vad.groupBy("session_id", "track_id").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("_s"))
    return tracks.select("session_id", "track_id", "player_id").distinct().join(total, ["session_id", "track_id"], "left").groupBy("session_id", "player_id").agg(F.round(F.coalesce(F.sum("_s"), F.lit(0.0)), 3).alias("speech_s"))


def monotone_words(words: DataFrame) -> DataFrame:
    """Words clipped to the running end of their track; those inside it are dropped. (TR-15)"""
    w = W.partitionBy("session_id").orderBy("segment", "pos").rowsBetween(W.unboundedPreceding, -1)
    ended = words.withColumn("_end", F.max("e_ms").over(w))
    return ended.withColumn("s_ms", F.greatest("s_ms", F.coalesce("_end", F.lit(0)))).where(F.col("e_ms") > F.col("s_ms")).drop("_end")


def rebase_words(words: DataFrame, windows: DataFrame) -> DataFrame:
    """Times relative to a window made absolute and clamped to it; words outside are dropped. (TR-16)"""
    met = words.join(windows, ["session_id", "window_id"])
    s, e = F.greatest(F.col("w_start_ms") + F.col("s_ms"), F.col("w_start_ms")), F.least(F.col("w_start_ms") + F.col("e_ms"), F.col("w_end_ms"))
    inside = (F.col("w_start_ms") + F.col("s_ms") < F.col("w_end_ms")) & (F.col("w_start_ms") + F.col("e_ms") > F.col("w_start_ms"))
    return met.where(inside).withColumn("s_ms", s).withColumn("e_ms", F.greatest(e, F.col("s_ms") + 1)).select("session_id", "window_id", "pos", "t", "s_ms", "e_ms")
