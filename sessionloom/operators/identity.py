"""Operators that resolve identities: lookups, suggestions, binding, registry upkeep.

Names meet by equi-joins on parts that any similar pair shares, so neither
side has to be small; where a dimension is, Spark broadcasts it by its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import name_similarity, normalised_name
from .intervals import in_order

# Fixed values.
SUGGEST_LEAST, BIND_LEAST, BIND_LEAD = 0.4, 0.8, 0.05
#: Characters of normalised names, rare ones first: any order is right, this one meets few pairs.
RARE_FIRST = "9876543210zqjxkvbpgwyfmcudlhrnsiotae "


def identity_keys(players: DataFrame) -> DataFrame:
    """(kind, key, player_id, priority): what a player may be known by; user names before display names before accounts."""
    pick = lambda kind, c, p: players.select(F.lit(kind).alias("kind"), normalised_name(F.col(c)).alias("key"), "player_id", F.lit(p).alias("priority"))
    return pick("user", "username", 1).unionByName(pick("user", "display_name", 2)).unionByName(pick("account", "account", 1)).where("key <> ''")


def exact_lookup(observed: DataFrame, players: DataFrame, kind: str) -> DataFrame:
    """Observed names with the player of the first matching key, or null. (ID-04)"""
    keys = identity_keys(players).where(F.col("kind") == kind).groupBy("key").agg(F.min(F.struct("priority", "player_id")).player_id.alias("player_id"))
    return observed.withColumn("key", normalised_name(F.col("name"))).join(keys, "key", "left").drop("key")


def dimension_lookup(rows: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left lookup in a dimension whose key is unique. (ID-05)"""
    return rows.join(dim, key, "left")


def trailing_number(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"(\d+)\D*$", 1), F.lit("")).cast("int")


def active_at(characters: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, character_id): characters whose open or closed range covers the session's number. (ID-06)

    A range becomes the blocks of 64 numbers that it covers among those that
    occur, and sessions meet it in their number's block.
    """
    c = characters.withColumn("_from", trailing_number(F.col("active_from"))).withColumn("_to", trailing_number(F.col("active_to")))
    ends = sessions.agg(F.min("number").alias("_low"), F.max("number").alias("_high"))  # one row
    c = c.crossJoin(F.broadcast(ends)).withColumn("_low", F.greatest("_from", "_low")).withColumn("_high", F.least("_to", "_high")).where("_low <= _high")
    c = c.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_low") / 64), F.floor(F.col("_high") / 64))))
    met = sessions.withColumn("_block", F.floor(F.col("number") / 64)).join(c, "_block").where("number BETWEEN _low AND _high")
    return met.select("session_id", "character_id")


def meeting_parts(name: Column, least: float) -> Column:
    """Parts of a normalised name of which two names share one if their similarity may reach ``least``, above 0.

    Names with a word in common share the word, those that begin alike their
    first three letters. For the edit distance at least that share of the
    longer name's letters occur in both, so by the pigeonhole principle the
    rarest letters of either, but for so many less one, have one in common.
    """
    words = F.split(name, " ")
    starts = F.transform(F.filter(F.array_append(words, name), lambda x: F.length(x) >= 3), lambda x: F.concat(F.lit("<"), F.substring(x, 1, 3)))
    letters = F.filter(F.split(name, ""), lambda x: x != "")
    nth = lambda i, x: F.size(F.filter(F.slice(letters, 1, i + 1), lambda y: y == x))
    rare = F.array_sort(F.transform(letters, lambda x, i: F.struct(F.instr(F.lit(RARE_FIRST), x).alias("r"), F.concat(F.lit("#"), x, nth(i, x).cast("string")).alias("k"))))
    most = F.size(letters) - F.ceil(F.round(F.lit(least) * F.size(letters), 9)).cast("int") + 1
    return F.array_distinct(F.concat(F.transform(words, lambda x: F.concat(F.lit("="), x)), starts, F.transform(F.slice(rare, 1, F.greatest(most, F.lit(1))), lambda s: s["k"])))


def suggestions(observed: DataFrame, players: DataFrame, k: int = 3, least: float = SUGGEST_LEAST) -> DataFrame:
    """(name, player_id, score, rank): the best players for each distinct observed name. (ID-07)

    Distinct names are scored, so a name that occurs a million times costs one
    row, and only with names that share a part with them.
    """
    names = observed.select("name").distinct().withColumn("_n", normalised_name(F.col("name")))
    known = identity_keys(players).select(F.col("key").alias("_k"), "player_id").distinct()
    left = names.where("_n <> ''").select("_n").distinct().withColumn("_part", F.explode(meeting_parts(F.col("_n"), least)))
    right = known.select("_k").distinct().withColumn("_part", F.explode(meeting_parts(F.col("_k"), least)))
    met = left.join(right, "_part").select("_n", "_k").distinct()
    alike = met.withColumn("score", F.round(name_similarity(F.col("_n"), F.col("_k")), 4)).where(F.col("score") >= least)
    scored = names.join(alike, "_n").join(known, "_k")
    best = scored.groupBy("name", "player_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("name").orderBy(F.desc("score"), "player_id")).cast("long")).where(F.col("rank") <= k)


def slug(name: Column) -> Column:
    return F.regexp_replace(normalised_name(name), " ", "_")


def registry_stub(users: DataFrame, accounts: DataFrame) -> DataFrame:
    """(player_id, username, account): one player per distinct user slug; accounts join on equal names, else get their own row. (ID-08)"""
    u = users.withColumn("_k", slug(F.col("name"))).where("_k <> ''").groupBy("_k").agg(F.min("name").alias("username"))
    a = accounts.withColumn("_k", slug(F.col("name"))).where("_k <> ''").groupBy("_k").agg(F.min("name").alias("account"))
    return u.join(a, "_k", "full_outer").select(F.concat(F.lit("pl_"), "_k").alias("player_id"), "username", "account")


def bind_tracks(tracks: DataFrame, players: DataFrame) -> DataFrame:
    """(session_id, track_id, player_id, tier, reason): one player per track and track per player. (ID-09)

    Tier 1 is the user id, tier 2 an unambiguous equal name, tier 3 the best
    fuzzy name with a lead. Within a tier the first track takes the player;
    later claimants and tracks whose player is taken stay unmatched.
    """
    t = tracks.withColumn("_n", normalised_name(F.col("name")))
    by_id = t.join(players.select(F.col("user_id").alias("_uid"), "player_id"), F.col("user_id") == F.col("_uid")).select("session_id", "track_id", "player_id", F.lit(1).alias("tier"))
    rest = t.join(by_id.select("session_id", "track_id"), ["session_id", "track_id"], "left_anti")
    keys = identity_keys(players).where("kind = 'user'").select(F.col("key").alias("_n"), "player_id").distinct()
    equal = rest.join(keys, "_n").groupBy("session_id", "track_id").agg(F.min("player_id").alias("player_id"), F.count_distinct("player_id").alias("_c"))
    by_name = equal.where("_c = 1").select("session_id", "track_id", "player_id", F.lit(2).alias("tier"))
    fuzzy_in = rest.join(equal.select("session_id", "track_id"), ["session_id", "track_id"], "left_anti")
    found = suggestions(fuzzy_in, players, k=2)
    top = found.groupBy("name").agg(F.max_by("player_id", -F.col("rank")).alias("player_id"), F.max("score").alias("_s"), (F.max("score") - F.coalesce(F.min(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0))).alias("_lead"))
    good = top.where((F.col("_s") >= BIND_LEAST) & (F.round("_lead", 6) >= BIND_LEAD)).select("name", "player_id")
    by_fuzzy = fuzzy_in.join(good, "name").select("session_id", "track_id", "player_id", F.lit(3).alias("tier"))
    claims = by_id.unionByName(by_name).unionByName(by_fuzzy)
    first = F.row_number().over(W.partitionBy("session_id", "player_id").orderBy("tier", "track_id"))
    claims = claims.withColumn("_first", first)
    out = tracks.select("session_id", "track_id").join(claims, ["session_id", "track_id"], "left")
    reason = F.when(F.col("tier").isNull(), "no_match").when(F.col("_first") > 1, "player_taken").otherwise("matched")
    return out.select("session_id", "track_id", F.when(F.col("_first") == 1, F.col("player_id")).alias("player_id"), F.when(F.col("_first") == 1, F.col("tier")).alias("tier"), reason.alias("reason"))


def merged_candidates(names: DataFrame, found: DataFrame, k: int = 3) -> DataFrame:
    """(track_id, player_id, score, rank): the best score of each player over a track's names. (ID-10)"""
    best = names.join(found.select("name", "player_id", "score"), "name").groupBy("track_id", "player_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("track_id").orderBy(F.desc("score"), "player_id")).cast("long")).where(F.col("rank") <= k)


def associate_participants(tracks: DataFrame, participants: DataFrame) -> DataFrame:
    """Tracks with the participant of the same index, else of the same name in any case. (ID-11)"""
    by_index = participants.select("session_id", F.col("index").alias("track_index"), F.col("participant").alias("_i"))
    by_name = participants.groupBy("session_id", F.lower("participant").alias("_l")).agg(F.min("participant").alias("_n"))
    out = tracks.withColumn("_l", F.lower("name")).join(by_index, ["session_id", "track_index"], "left").join(by_name, ["session_id", "_l"], "left")
    return out.withColumn("participant", F.coalesce("_i", "_n")).drop("_i", "_n", "_l")


def integrity_problems(players: DataFrame, characters: DataFrame, npcs: DataFrame) -> DataFrame:
    """(problem, id): repeated ids, ids of two kinds, players without any identity. (ID-12)"""
    twice = lambda df, c, kind: df.groupBy(F.col(c).alias("id")).count().where("count > 1").select(F.lit(f"duplicate_{kind}").alias("problem"), "id")
    both = characters.select(F.col("character_id").alias("id")).intersect(npcs.select(F.col("npc_id").alias("id"))).select(F.lit("character_and_npc").alias("problem"), "id")
    bare = players.where("coalesce(username, account, user_id) IS NULL").select(F.lit("no_identity").alias("problem"), F.col("player_id").alias("id"))
    return twice(players, "player_id", "player").unionByName(twice(characters, "character_id", "character")).unionByName(twice(npcs, "npc_id", "npc")).unionByName(both).unionByName(bare)


def worklist(tracks: DataFrame, rolls: DataFrame) -> DataFrame:
    """(kind, name, ord): distinct names still unbound, numbered within their kind. (ID-13)"""
    open_ = tracks.where("player_id IS NULL").select(F.lit("track").alias("kind"), "name").unionByName(rolls.where("player_id IS NULL").select(F.lit("account").alias("kind"), "name"))
    distinct = open_.where("name IS NOT NULL AND trim(name) <> ''").distinct()
    ranked = in_order(distinct, ["kind", "name"])
    first = ranked.groupBy("kind").agg(F.min("rank").alias("_first"))
    return ranked.join(first, "kind").select("kind", "name", (F.col("rank") - F.col("_first") + 1).alias("ord"))


def apply_mappings(players: DataFrame, decisions: DataFrame) -> DataFrame:
    """Players whose hints have the newly mapped names added; a name decided twice fails. (ID-14)"""
    once = decisions.groupBy("name").agg(F.min("player_id").alias("player_id"), F.count("*").alias("_c"))
    once = once.withColumn("name", F.when(F.col("_c") == 1, F.col("name")).otherwise(F.raise_error(F.concat(F.lit("decided twice: "), "name"))))
    new = once.groupBy("player_id").agg(F.sort_array(F.collect_list("name")).alias("_new"))
    return players.join(new, "player_id", "left").withColumn("hints", F.array_union("hints", F.coalesce("_new", F.array().cast("array<string>")))).drop("_new")


def insert_absent(dim: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``dim`` and the rows of ``new`` whose key it lacks, one per key. (ID-15)"""
    return dim.unionByName(new.dropDuplicates([key]).join(dim.select(key), key, "left_anti"))


def term_dictionary(terms: DataFrame) -> DataFrame:
    """Terms with white space collapsed, distinct in any case, the first spelling kept, sorted. (ID-16)"""
    clean = terms.withColumn("term", F.trim(F.regexp_replace("term", r"\s+", " "))).where("term <> ''")
    first = clean.groupBy(F.lower("term").alias("folded")).agg(F.min(F.struct("ord", "term")).term.alias("term"))
    return in_order(first, ["folded", "term"]).withColumnRenamed("rank", "place")


def budgeted_prefix(terms: DataFrame, limit: int, keys: list[str]) -> DataFrame:
    """Per key the terms in order while their joined length stays within the limit. (ID-17)"""
    w = W.partitionBy(*keys).orderBy("place")
    held = terms.withColumn("_sum", F.sum(F.length("term") + 2).over(w.rowsBetween(W.unboundedPreceding, 0)) - 2).where(F.col("_sum") <= limit)
    return held.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x.term), ", ").alias("prompt"))
