"""Operators on dice rolls: occurrences, rounds, damage, narration, checks, scenes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ascii_edges
from .intervals import as_of, band_join

# Fixed values.
SILENCE_S, NARRATION_S, CHECK_S, GROUP_S = 20.0, 8.0, 12.0, 90.0
FAILURE, SUCCESS = r"\b(?:fail(?:s|ed|ure)?|miss(?:es|ed)?)\b", r"\b(?:succeed(?:s|ed)?|success|pass(?:es|ed)?|made it|works)\b"
REFUSAL, AGREEMENT = r"\b(?:refus(?:e|es|ed|al)|no deal|reject(?:s|ed)?|won't|will not)\b", r"\b(?:agree(?:s|d)?|deal|done|accept(?:s|ed)?)\b"
TRANSITION = r"\b(?:we move on|let's move on|scene shifts|combat begins|initiative begins)\b"
PROMISE, STAKE = r"(?i)\b((?:we'?ll|i'?ll|we will|i will)\b[^.!?]{2,120})", r"(?i)\b((?:pay|reward|price|if|unless)\b[^.!?]{2,120})"
TARGET, SKILL = r"(?i)(?:target|against)\s*[:=]\s*([A-Za-z0-9 _-]+)", r"(?i)(?:^|[;|,\s])(?:skill|ability)\s*[:=]\s*([^;|,]+)"


def roll_occurrences(rolls: DataFrame, names: DataFrame) -> DataFrame:
    """Rolls with the actor's id (by name; else the name itself), how often the id occurs, and its target. (EN-01)"""
    n = F.count("*").over(W.partitionBy("session_id", "roll_id"))
    return rolls.join(names, "who", "left").withColumn("actor", F.coalesce("actor_id", "who")).withColumn("n_seen", n).drop("actor_id")


def target_of(text: Column) -> Column:
    """What follows ``target:`` or ``against:``, null without. (EN-02)"""
    return F.nullif(F.trim(F.regexp_extract(text, TARGET, 1)), F.lit(""))


def order_at_roll(rolls: DataFrame, turnorder: DataFrame) -> DataFrame:
    """Rolls with the entries of the latest order snapshot at or before them. (EN-03)"""
    return as_of(rolls, turnorder, ["session_id"], "t_s", "t_s", ["seq"], ["n_entries"])


def trackerless_scope(rolls: DataFrame, silence: float = SILENCE_S) -> DataFrame:
    """Rolls of the stretch from a session's first initiative roll, or its first roll if it has none, to a silence, with each actor's place. (EN-04)"""
    w = W.partitionBy("session_id").orderBy("t_s", "seq")
    held = rolls.withColumn("_gap", F.when(F.col("t_s") - F.lag("t_s").over(w) > silence, 1).otherwise(0)).withColumn("_isle", F.sum("_gap").over(w.rowsBetween(W.unboundedPreceding, 0)))
    place = F.struct("t_s", "seq", "_isle")
    first = F.coalesce(F.min(F.when(F.col("kind") == "initiative", place)).over(W.partitionBy("session_id")), F.min(place).over(W.partitionBy("session_id")))
    scoped = held.withColumn("_f", first).where((F.col("_isle") == F.col("_f._isle")) & (F.struct("t_s", "seq") >= F.struct("_f.t_s", "_f.seq")))
    seen = F.min(F.struct("t_s", "seq")).over(W.partitionBy("session_id", "who"))
    return scoped.withColumn("_seen", seen).withColumn("place", F.dense_rank().over(W.partitionBy("session_id").orderBy("_seen")).cast("long")).drop("_gap", "_isle", "_f", "_seen")


def rolls_with_order(rolls: DataFrame, orders: DataFrame, actors: DataFrame, silence: float = SILENCE_S) -> DataFrame:
    """The rolls of each session's encounter with the ``order`` in force: (name, actor) of each entry. (EN-03 to EN-05)

    ``rolls`` have session_id, roll_id, t_s, seq, who, actor (null if not
    resolved) and kind; ``orders`` session_id, seq, t_s and names; ``actors``
    (name, actor) one row a name. A session with any order takes part with all
    its rolls, and before its first order the order is null. Others take part
    with the scope of EN-04, in order of each actor's first roll.
    """
    entries = orders.select("session_id", "seq", "t_s", F.posexplode_outer("names").alias("_i", "name")).join(actors.select("name", F.col("actor").alias("_a")), "name", "left")
    entry = F.when(F.col("name").isNotNull(), F.struct("_i", "name", F.col("_a").alias("actor")))
    plain = lambda x: F.struct(x["name"].alias("name"), x["actor"].alias("actor"))
    listed = entries.groupBy("session_id", "seq", "t_s").agg(F.transform(F.array_sort(F.collect_list(entry)), plain).alias("order"))
    tracked = orders.select("session_id").distinct()
    with_tracker = as_of(rolls.join(tracked, "session_id", "left_semi"), listed, ["session_id"], "t_s", "t_s", ["seq"], ["order"])
    free = rolls.join(tracked, "session_id", "left_anti")
    first = free.where("who IS NOT NULL").groupBy("session_id", "who").agg(F.min(F.struct("t_s", "seq")).alias("_first"))
    inferred = first.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("_first", "who"))).alias("_o"))
    inferred = inferred.select("session_id", F.transform("_o", lambda x: F.struct(x["who"].alias("name"), F.lit(None).cast("string").alias("actor"))).alias("order"))
    return with_tracker.unionByName(trackerless_scope(free, silence).drop("place").join(inferred, "session_id", "left"))


class _Cycle:
    """Round and who has acted in it; an entry that leaves the order leaves the round."""

    def __init__(self) -> None:
        self.round, self.acted, self.names = 1, set(), []

    def place(self, who: str | None, actor: str | None, kind: str, order: list[dict]) -> tuple[str | None, str | None]:
        """(entry of the order, reason why there is none) of the next roll."""
        names = [e["name"] for e in order]
        if names != self.names:
            self.names = names
            self.acted.intersection_update(names)
        if actor is None:
            return None, "actor could not be resolved"
        if not names:
            return None, "no initiative order was available"
        entry = next((e["name"] for e in order if e["name"] == who or e["actor"] == actor), None)
        if entry is None:
            return None, "actor is absent from initiative order"
        if kind != "initiative":
            if entry in self.acted:
                self.round += 1
                self.acted.clear()
            self.acted.add(entry)
        return entry, None


def rounds_and_turns(rolls: DataFrame) -> DataFrame:
    """(session_id, roll_id, round, turn, entry, reason) of the rolls of ``rolls_with_order``. (EN-05)

    An entry of the order that acts again opens a new round, unless it has left
    the order in between; initiative is recorded but opens nothing. Turns are
    the actors of a round in order of their first roll. A roll whose actor is
    not resolved, has no order or is not in it has a reason instead. Sessions
    stream through their tasks in order; the state is one round's entries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, cycle = None, _Cycle()
        for batch in batches:
            rounds, entries, reasons = [], [], []
            for own, who, actor, kind, order in zip(*(batch.column(c).to_pylist() for c in ("session_id", "who", "actor", "kind", "order"))):
                if own != session:
                    session, cycle = own, _Cycle()
                entry, reason = cycle.place(who, actor, kind, order or [])
                rounds.append(None if reason else cycle.round)
                entries.append(entry)
                reasons.append(reason)
            columns = [*(batch.column(c) for c in ("session_id", "roll_id", "who", "t_s", "seq")), pa.array(rounds, pa.int32()), pa.array(entries, pa.string()), pa.array(reasons, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["session_id", "roll_id", "who", "t_s", "seq", "round", "entry", "reason"])

    rows = rolls.select("session_id", "roll_id", "who", "t_s", F.col("seq").cast("long").alias("seq"), "actor", "kind", "order").repartition("session_id").sortWithinPartitions("session_id", "t_s", "seq", "roll_id")
    kept = rows.select("session_id", "roll_id", "who", "t_s", "seq").schema
    placed = rows.mapInArrow(run, T.StructType([*kept.fields, T.StructField("round", T.IntegerType()), T.StructField("entry", T.StringType()), T.StructField("reason", T.StringType())]))
    first = F.min(F.struct("t_s", "seq", "roll_id")).over(W.partitionBy("session_id", "round", "who"))
    turn = F.when(F.col("round").isNotNull(), F.dense_rank().over(W.partitionBy("session_id", "round").orderBy("_first")))
    return placed.withColumn("_first", first).select("session_id", "roll_id", "round", turn.cast("int").alias("turn"), "entry", "reason")


def unassigned(placed: DataFrame) -> DataFrame:
    """(session_id, roll_id, reason) of the rolls that have no turn. (EN-06)"""
    return placed.where("reason IS NOT NULL").select("session_id", "roll_id", "reason")


def damage_sums(rolls: DataFrame) -> DataFrame:
    """(session_id, side, name, damage): targeted damage by actor and by target. (EN-07)"""
    hit = rolls.where("kind = 'damage' AND target IS NOT NULL")
    side = lambda s, c: hit.groupBy("session_id", F.lit(s).alias("side"), F.col(c).alias("name")).agg(F.sum("total").alias("damage"))
    return side("actor", "who").unionByName(side("target", "target"))


def attach_narration(speech: DataFrame, turns: DataFrame, within: float = NARRATION_S) -> DataFrame:
    """(session_id, utt_id, roll_id): the nearest turn of the same actor within some seconds of a speech. (EN-08)"""
    met = band_join(speech.select("session_id", "who", "utt_id", "mid_s"), turns.select("session_id", "who", "roll_id", "t_s"), ["session_id", "who"], "mid_s", "t_s", within, within)
    return met.groupBy("session_id", "utt_id").agg(F.min_by("roll_id", F.struct(F.round(F.abs(F.col("t_s") - F.col("mid_s")), 6), "t_s", "roll_id")).alias("roll_id"))


def notable(die: Column, sides: int = 20) -> Column:
    """A d20 that shows its highest or lowest number. (EN-09)"""
    return die.isin(1, sides)


def encounter_summary(rolls: DataFrame, placed: DataFrame) -> DataFrame:
    """One row per session: rounds, turns, totals, and the rounds nested with their rolls. (EN-10)"""
    both = rolls.join(placed.where("round IS NOT NULL").select("session_id", "roll_id", "round", "turn"), ["session_id", "roll_id"])
    per = both.groupBy("session_id", "round").agg(F.max("turn").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "t_s", "roll_id", "who", "kind", "total"))).alias("rolls"), F.sum(F.when((F.col("kind") == "damage") & F.col("target").isNotNull(), F.col("total")).otherwise(0)).alias("damage"))
    return per.groupBy("session_id").agg(F.count("*").alias("n_rounds"), F.sum("turns").alias("n_turns"), F.sum("damage").alias("damage_total"), F.array_sort(F.collect_list(F.struct("round", "turns", "damage", "rolls"))).alias("rounds"))


def stated_intent(checks: DataFrame, speech: DataFrame, within: float = CHECK_S) -> DataFrame:
    """Checks with the latest speech that ends at or before them, if recent enough. (CK-01)"""
    found = as_of(checks, speech.withColumn("intent_end_s", F.col("end_s")).withColumn("intent", F.col("utt_id")), ["session_id"], "t_s", "end_s", ["utt_id"], ["intent", "intent_end_s"])
    near = F.col("t_s") - F.col("intent_end_s") <= within
    return found.withColumn("intent", F.when(near, F.col("intent"))).drop("intent_end_s")


def adjudication(checks: DataFrame, speech: DataFrame, within: float = CHECK_S) -> DataFrame:
    """Checks with the narrator's first speech that starts within some seconds after. (CK-02)"""
    met = band_join(checks.select("session_id", "roll_id", "t_s"), speech.select("session_id", F.col("utt_id").alias("ruling"), "start_s", "text"), ["session_id"], "t_s", "start_s", 0.0, within)
    best = met.groupBy("session_id", "roll_id").agg(F.min(F.struct("start_s", "ruling", "text")).alias("b"))
    return checks.join(best, ["session_id", "roll_id"], "left").withColumn("ruling", F.col("b.ruling")).withColumn("ruling_text", F.col("b.text")).drop("b")


def skill_of(ref: Column) -> Column:
    """What follows ``skill:`` or ``ability:``, else unknown. (CK-03)"""
    return F.coalesce(F.nullif(F.trim(F.lower(F.regexp_extract(ref, SKILL, 1))), F.lit("")), F.lit("unknown"))


def verdict_of(text: Column) -> Column:
    """failure before success, else unknown. (CK-04)"""
    return F.when(F.lower(text).rlike(ascii_edges(FAILURE)), "failure").when(F.lower(text).rlike(ascii_edges(SUCCESS)), "success").otherwise("unknown")


def attempt_groups(checks: DataFrame, within: float = GROUP_S) -> DataFrame:
    """Checks with group and attempt: the same actor and skill soon after, about the same or no subject. (CK-05)

    Groups are numbered by their first check in the session.
    """
    w = W.partitionBy("session_id", "who", "skill").orderBy("t_s", "roll_id")
    long_words = lambda c: F.filter(F.split(F.lower(c), r"\W+"), lambda x: F.length(x) >= 4)
    was = F.lag("subject").over(w)
    alike = (was == F.col("subject")) | (F.col("subject") == "") | (was == "") | F.arrays_overlap(long_words(was), long_words(F.col("subject")))
    goes_on = F.coalesce((F.col("t_s") - F.lag("t_s").over(w) <= within) & alike, F.lit(False))
    held = checks.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = W.partitionBy("session_id", "who", "skill", "_g")
    held = held.withColumn("attempt", F.row_number().over(g.orderBy("t_s", "roll_id")).cast("long")).withColumn("_first", F.min(F.struct("t_s", "roll_id")).over(g))
    return held.withColumn("group_no", F.dense_rank().over(W.partitionBy("session_id").orderBy("_first")).cast("long")).drop("_new", "_g", "_first")


def topics(speech: DataFrame, terms: list[str]) -> DataFrame:
    """The glossary term in the most speeches of a session, two at least; then by name. (CK-06)"""
    said = F.lower("text")
    counts = speech.groupBy("session_id").agg(*[F.count_if(F.contains(said, F.lit(t))).alias(f"_{i}") for i, t in enumerate(terms)])
    listed = F.array(*[F.struct((-F.col(f"_{i}")).alias("n"), F.lit(t).alias("term")) for i, t in enumerate(terms)])
    best = F.array_min(F.filter(listed, lambda x: x.n <= -2))
    return counts.select("session_id", best.term.alias("topic"), (-best.n).alias("n_speeches"))


def scene_outcome(speech: DataFrame) -> DataFrame:
    """refusal, else agreement, else transition, else unknown, over a scene's speeches. (CK-07)"""
    any_ = lambda p: F.max(F.when(F.lower("text").rlike(ascii_edges(p)), 1).otherwise(0)) == 1
    return speech.groupBy("session_id").agg(F.when(any_(REFUSAL), "refusal").when(any_(AGREEMENT), "agreement").when(any_(TRANSITION), "transition").otherwise("unknown").alias("outcome"))


def open_threads(speech: DataFrame) -> DataFrame:
    """First promise and first stake phrase of each speech. (CK-08)"""
    pick = lambda kind, p: speech.select("session_id", "utt_id", F.lit(kind).alias("kind"), F.trim(F.regexp_extract("text", ascii_edges(p), 1)).alias("phrase")).where("phrase <> ''")
    return pick("promise", PROMISE).unionByName(pick("stake", STAKE))


def participants(events: DataFrame, npcs: list[str]) -> DataFrame:
    """Sorted speakers and non-player characters of a scene. (CK-09)"""
    return events.groupBy("session_id").agg(F.array_join(F.sort_array(F.collect_set("player_id")), ",").alias("participants"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("player_id").isin(npcs), F.col("player_id")))), ",").alias("npcs"))
