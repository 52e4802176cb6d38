"""Engine tables derived from the driver's tables, for Spark and as SQL text for DuckDB.

All derivations are deterministic and cover every row. Times are whole
milliseconds before they become seconds, so both engines have equal doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def utterances(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    return (
        table(spark, sf, "conversations")
        .withColumn("dur_ms", 60 * F.length("text"))
        .withColumn("start_ms", F.coalesce(F.sum(F.col("dur_ms") + 500 * (F.col("turn") % 5)).over(w), F.lit(0)))
        .selectExpr(
            "conv_id AS session_id", "concat(conv_id, ':', turn) AS utt_id", "turn AS source_index", "role AS track_id", "role AS player_id", "text",
            "start_ms", "start_ms + dur_ms AS end_ms", "start_ms / 1000.0D AS start_s", "(start_ms + dur_ms) / 1000.0D AS end_s", "(length(text) % 100) / 100.0D AS energy",
        )
    )


UTTERANCES = """
utt0 AS (SELECT conv_id, turn, role, text, 60 * length(text) AS dur_ms FROM conversations),
utt1 AS (SELECT *, coalesce(sum(dur_ms + 500 * (turn % 5)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM utt0),
utterances AS (SELECT conv_id AS session_id, conv_id || ':' || turn AS utt_id, turn AS source_index, role AS track_id, role AS player_id, text,
  start_ms, start_ms + dur_ms AS end_ms, start_ms / 1000.0::DOUBLE AS start_s, (start_ms + dur_ms) / 1000.0::DOUBLE AS end_s, (length(text) % 100) / 100.0::DOUBLE AS energy FROM utt1)"""


def two_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Each utterance and its bleed into another track, 300 ms later and quieter."""
    u = utterances(spark, sf)
    copy = u.selectExpr(
        "session_id", "concat(utt_id, 'b') AS utt_id", "source_index + 100000 AS source_index", "CASE track_id WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'user' ELSE 'user' END AS track_id",
        "CASE track_id WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'user' ELSE 'user' END AS player_id", "text", "start_ms + 300 AS start_ms", "end_ms + 300 AS end_ms",
        "(start_ms + 300) / 1000.0D AS start_s", "(end_ms + 300) / 1000.0D AS end_s", "energy / 2 AS energy",
    )
    return u.unionByName(copy)


TWO_TRACKS = UTTERANCES + """,
two_tracks AS (SELECT * FROM utterances UNION ALL
  SELECT session_id, utt_id || 'b', source_index + 100000, CASE track_id WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'user' ELSE 'user' END,
  CASE track_id WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'user' ELSE 'user' END, text, start_ms + 300, end_ms + 300, (start_ms + 300) / 1000.0::DOUBLE, (end_ms + 300) / 1000.0::DOUBLE, energy / 2 FROM utterances)"""


def words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each utterance, 300 ms apart, with a pause of 900 ms more before each seventh."""
    return utterances(spark, sf).select("session_id", "utt_id", "start_ms", F.posexplode(F.split("text", " ")).alias("pos", "t")).selectExpr(
        "session_id", "utt_id", "CAST(pos AS BIGINT) AS pos", "t", "(start_ms + 300 * pos + 900 * (pos DIV 7)) / 1000.0D AS s", "(start_ms + 300 * pos + 900 * (pos DIV 7) + 250) / 1000.0D AS e"
    )


WORDS = UTTERANCES + """,
wordlists AS (SELECT session_id, utt_id, start_ms, unnest(string_split(text, ' ')) AS t, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM utterances),
words AS (SELECT session_id, utt_id, pos, t, (start_ms + 300 * pos + 900 * (pos // 7)) / 1000.0::DOUBLE AS s, (start_ms + 300 * pos + 900 * (pos // 7) + 250) / 1000.0::DOUBLE AS e FROM wordlists)"""


def rolls(spark: SparkSession, sf: str) -> DataFrame:
    """Dice rolls: one per event, of the event's user."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return (
        table(spark, sf, "events")
        .withColumn("seq", F.row_number().over(w).cast("long"))
        .selectExpr(
            "user_id AS session_id", "event_id AS roll_id", "seq", "(12000 * seq + 1000 * (event_id % 5)) / 1000.0D AS t_s", "unix_millis(CAST(ts AS TIMESTAMP)) AS t_wall_ms", "concat('p', event_id % 4) AS who",
            "CASE event_type WHEN 'click' THEN 'attack' WHEN 'purchase' THEN 'damage' WHEN 'view' THEN 'check' WHEN 'signup' THEN 'initiative' ELSE 'other' END AS kind",
            "CAST(round(value) AS BIGINT) AS total", "event_id % 20 + 1 AS die", "CASE WHEN event_id % 2 = 0 THEN concat('npc', event_id % 3) END AS target",
            "CAST(regexp_extract(props, '\"k\": *(\\\\d+)', 1) AS BIGINT) AS k",
        )
    )


ROLLS = """
rolls0 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
rolls AS (SELECT user_id AS session_id, event_id AS roll_id, seq, (12000 * seq + 1000 * (event_id % 5)) / 1000.0::DOUBLE AS t_s, epoch_us(ts) // 1000 AS t_wall_ms, 'p' || (event_id % 4) AS who,
  CASE event_type WHEN 'click' THEN 'attack' WHEN 'purchase' THEN 'damage' WHEN 'view' THEN 'check' WHEN 'signup' THEN 'initiative' ELSE 'other' END AS kind,
  CAST(round(value) AS BIGINT) AS total, event_id % 20 + 1 AS die, CASE WHEN event_id % 2 = 0 THEN 'npc' || (event_id % 3) END AS target,
  CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS BIGINT) AS k FROM rolls0)"""


def frames(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return table(spark, sf, "lineitem").selectExpr("l_suppkey AS track_id", "l_discount + 0.001D AS rms", "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").withColumn("frame_ix", F.row_number().over(w).cast("long") - 1).select("track_id", "frame_ix", "rms")


FRAMES = """
frames AS (SELECT l_suppkey AS track_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS frame_ix, l_discount + 0.001::DOUBLE AS rms FROM lineitem)"""
