"""Streaming operators, and batch twins where one is of use."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import scratch_path, ship_package

_STORE = "spark.sql.streaming.stateStore.providerClass"


def run_to_end(stream: DataFrame, mode: str, progress: list[dict] | None = None) -> DataFrame:
    """Run a stream over all that its source has now; the result is a table in the shared folder.

    Batches are written with their number, so a batch that is run again after a
    failure replaces its own rows. In complete mode the last batch is the result.
    State is kept by RocksDB, off the heap. ``progress``, if given, gets one
    entry a batch: number, state_rows, dropped and the observed counters.
    """
    spark = stream.sparkSession
    ship_package(spark)
    out, state = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")

    def write(batch: DataFrame, number: int) -> None:
        target = f"{out}/all" if mode == "complete" else f"{out}/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        running = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
        running.awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    if progress is not None:
        for p in running.recentProgress:
            ops = p["stateOperators"]
            seen = {name: row.asDict() for name, row in (p["observedMetrics"] or {}).items()}
            progress.append({"batch": p["batchId"], "state_rows": sum(o["numRowsTotal"] for o in ops), "dropped": sum(o["numRowsDroppedByWatermark"] for o in ops), "counters": seen})
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{out}/all")
    numbered = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    rows = spark.read.schema(numbered).option("basePath", out).parquet(out)
    return rows.drop("batch") if mode == "append" else rows


#: The time of a closing row, in microseconds. Such a row only moves the watermark past all others and is none itself.
CLOSING_US = 253_370_764_800_000_000


def close_source(spark: SparkSession, schema: T.StructType, path: str, time: str) -> None:
    """Add a closing row to the files of a stream that has ended, so that rows which wait for the watermark come out."""
    row = [(F.timestamp_micros(F.lit(CLOSING_US)) if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    spark.range(1).select(*row).coalesce(1).write.mode("append").parquet(path)


def message_key(id_: Column, markup: Column, text: Column, who: Column) -> Column:
    """``id:`` and the id; for a message without one a fingerprint of markup, text and speaker. (ST-01)"""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.when(part(id_) != "", F.concat(F.lit("id:"), id_.cast("string"))).otherwise(F.concat(F.lit("fingerprint:"), F.sha2(F.concat_ws("\0", part(markup), part(text), part(who)), 256)))


class _Upsert(StatefulProcessor):
    """First place and newest content of the messages of a bucket, each forgotten ``ttl_ms`` after it was last seen.

    The messages of a bucket are one value of columns, read and written at once
    by a batch that touches it: a call of the state store for each message costs
    far more than the message. A bucket has one timer, ``due``, that is never
    later than the first of its messages to go.
    """

    COLUMNS = dict(game="string", key="string", first_us="long", first_seq="long", last_us="long", last_seq="long", who="string", text="string", markup="string", version="long")

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("messages", "due long, " + ", ".join(f"{c} array<{t}>" for c, t in self.COLUMNS.items()))

    def _held(self) -> tuple[int | None, dict[tuple, list]]:
        """The timer, and first place, last place, who, text, markup and version by game and key."""
        state = self.state.get()
        if state is None:
            return None, {}
        due, *columns = state
        return due, {(game, name): [(us, seq), (last_us, last_seq), *rest] for game, name, us, seq, last_us, last_seq, *rest in zip(*columns)}

    @staticmethod
    def _columns(messages: dict[tuple, list]) -> list[list]:
        return [list(c) for c in zip(*((*name, *first, *last, *rest) for name, (first, last, *rest) in messages.items()))]

    def _goes(self, message: list) -> int:
        return message[1][0] // 1000 + self.ttl_ms

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        due, messages = self._held()
        seen = {}
        for batch in rows:
            for game, name, us, seq, *content in zip(*(batch[c].tolist() for c in ("game", "key", "us", "seq", "who", "text", "markup"))):
                at, message = (int(us), int(seq)), messages.get((game, name))
                if message is None:
                    message = messages[game, name] = [at, at, *content, 1]
                else:
                    message[0] = min(message[0], at)
                    if at >= message[1]:
                        message[1:5] = at, *content
                    message[5] += 1
                seen[game, name] = message
        first = min(map(self._goes, seen.values()))
        if due is None or first < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(first)
            due = first
        self.state.update((due, *self._columns(messages)))
        yield pd.DataFrame(dict(zip(self.COLUMNS, self._columns(seen))))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        messages = {name: m for name, m in self._held()[1].items() if self._goes(m) > passed}
        if messages:
            due = min(map(self._goes, messages.values()))
            self.handle.registerTimer(due)
            self.state.update((due, *self._columns(messages)))
        else:
            self.state.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def upsert(messages: DataFrame, ttl: str, late: str = "1 day", buckets: int = 1024) -> DataFrame:
    """Messages by key: the newest content with the first sequence number and time. (ST-01, update mode)

    ``messages`` (game, id, who, text, markup, seq, ts) repeats a message each
    time it is rendered. What is newest and first goes by time, then by sequence
    number, so it doesn't depend on how rows fall into batches; ``version``
    counts the renderings. Once the watermark, ``late`` behind the newest row,
    is ``ttl`` past a message's last rendering its state goes; rendered again
    after that, it is a new message. Null ids and empty ones go by fingerprint.

    State is dealt by a hash of game and key to ``buckets``, so a game of any
    size is spread. A batch reads and writes the buckets that it touches: more
    buckets suit more live messages, and their number is fixed as long as a
    checkpoint is used.
    """
    game_type = messages.schema["game"].dataType.simpleString()
    key = message_key(F.col("id"), F.col("markup"), F.col("text"), F.col("who")).alias("key")
    keyed = messages.withWatermark("ts", late).select(F.col("game").cast("string").alias("game"), key, "who", "text", "markup", F.col("seq").cast("long").alias("seq"), F.unix_micros("ts").alias("us"), "ts")
    schema = ", ".join(f"{c} {t}" for c, t in _Upsert.COLUMNS.items())
    bucket = F.pmod(F.xxhash64("game", "key"), F.lit(buckets)).alias("bucket")
    found = keyed.select(bucket, "*").groupBy("bucket").transformWithStateInPandas(_Upsert(_millis(ttl)), schema, "Update", "EventTime")
    at = lambda c: F.timestamp_micros(f"{c}_us").alias(f"{c}_at")
    return found.select(F.col("game").cast(game_type).alias("game"), "key", "first_seq", at("first"), at("last"), "who", "text", "markup", "version")


def first_renderings(messages: DataFrame, late: str = "1 day") -> DataFrame:
    """The first rendering of each message that arrives, as soon as it does; state lasts as long as the watermark needs it. (ST-01, append mode)"""
    keyed = messages.withColumn("key", message_key(F.col("id"), F.col("markup"), F.col("text"), F.col("who")))
    return keyed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["game", "key"])


def _millis(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1000)


def latest_rows(updates: DataFrame, key: str, version: str) -> DataFrame:
    """The last update of each key."""
    return updates.groupBy(key).agg(F.max_by(F.struct(*[c for c in updates.columns if c != key]), version).alias("_r")).select(key, "_r.*")


def changes(snapshots: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Snapshots that differ from the one before. (ST-02, batch)"""
    was = F.lag(value).over(W.partitionBy(*keys).orderBy(*order))
    return snapshots.withColumn("_was", was).where(F.col("_was").isNull() | (F.col("_was") != F.col(value))).drop("_was")


class _InOrder(StatefulProcessor):
    """A fold over the rows of a key in order of time: rows wait until the watermark has passed them."""

    def __init__(self, step: Callable[[Any, Any], tuple[Any, Any]], row: str, last: str, names: list[str], key_type: str):
        self.step, self.row, self.last_type, self.names, self.key_type = step, row, last, names, key_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.last = handle.getValueState("last", self.last_type)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for batch in rows:
            self.waiting.appendList([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in batch[["us", "ord", "value"]].itertuples(index=False)])
            self.handle.registerTimer(-(-int(batch["us"].min()) // 1000))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get())
        ready, later = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        last = self.last.get() if self.last.exists() else None
        out = []
        for _, ord_, value in ready:
            last, found = self.step(last, value)
            if found is not None:
                out.append((key[0], ord_, value, found))
        if ready:
            self.last.update(last)
            if later:
                self.waiting.put(later)
                self.handle.registerTimer(-(-later[0][0] // 1000))
            else:
                self.waiting.clear()
        yield pd.DataFrame(out, columns=self.names) if out else pd.DataFrame()

    def close(self) -> None:
        pass


def in_order_of_time(stream: DataFrame, key: str, order: str, value: str, time: str, step: Callable[[Any, Any], tuple[Any, Any]], last: str, result: str, late: str = "1 day") -> DataFrame:
    """(key, order, value, result) of a fold over each key's rows by time, then ``order``; ``step`` (state, value) gives (state, result), null results are left out.

    Rows come out once the watermark, ``late`` behind the newest row, has
    passed them, so rows of a later batch with earlier times are in their
    place. A closing row (``close_source``) lets out all that wait; without one
    the last rows go on waiting. State: the rows that wait, and one row
    ``last`` a key. Rows later than the watermark are dropped and counted in
    the progress.
    """
    fields = {c: stream.schema[c].dataType.simpleString() for c in (key, order, value)}
    # on the time itself, so Spark leaves the condition after the watermark
    own = F.coalesce(F.unix_micros(time) < CLOSING_US, F.lit(True))
    rows = stream.withWatermark(time, late).where(own).select(key, time, F.unix_micros(time).alias("us"), F.col(order).alias("ord"), F.col(value).alias("value"))
    processor = _InOrder(step, f"us long, ord {fields[order]}, value {fields[value]}", last, [key, order, value, "result"], fields[key])
    schema = f"{key} {fields[key]}, {order} {fields[order]}, {value} {fields[value]}, result {result}"
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def _changed(last: tuple | None, value: Any) -> tuple[tuple, bool | None]:
    """As SQL compares: after null anything is a change, null after a value is none."""
    return (value,), True if last is None or last[0] is None or value is not None and last[0] != value else None


def change_stream(snapshots: DataFrame, key: str, order: str, value: str, time: str, late: str = "1 day") -> DataFrame:
    """(key, order, value) of the snapshots of each key that differ from the one before by time. (ST-02)"""
    kind = snapshots.schema[value].dataType.simpleString()
    return in_order_of_time(snapshots, key, order, value, time, _changed, f"value {kind}", "boolean", late).drop("result")


def _marker(last: tuple | None, entries: int) -> tuple[tuple, str]:
    was, full = last is not None and last[0], entries > 0
    return (full,), "started" if full and not was else "ended" if was and not full else "changed"


def marker_stream(turnorder: DataFrame, key: str, order: str, entries: str, time: str, late: str = "1 day") -> DataFrame:
    """(key, order, entries, marker) of turn-order snapshots by time: combat started, ended or changed. (ST-05, streamed SRC-18)"""
    return in_order_of_time(turnorder, key, order, entries, time, _marker, "full boolean", "string", late).withColumnRenamed("result", "marker")


class _Newest(StatefulProcessor):
    """The newest ``cap`` rows of a key; what goes in and what goes out comes out."""

    def __init__(self, cap: int, names: list[str]):
        self.cap, self.names = cap, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "us long, ord long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        old = sorted(self.kept.get())
        for batch in rows:
            new = sorted((int(a), int(b)) for a, b in batch[["us", "ord"]].itertuples(index=False))
            held = sorted([*old, *new])[-self.cap :]
            stays = set(held)
            out = [(key[0], o, True) for u, o in new if (u, o) in stays] + [(key[0], o, False) for u, o in old if (u, o) not in stays]
            old = held
            if out:
                yield pd.DataFrame(out, columns=self.names)
        self.kept.put(old)

    def close(self) -> None:
        pass


def retention_stream(stream: DataFrame, key: str, order: str, time: str, cap: int) -> DataFrame:
    """(key, order, kept): each row that enters the newest ``cap`` of its key, and again, with ``kept`` false, when newer ones put it out. (ST-03)

    A key's state never exceeds ``cap`` rows. A row that is older than all of a
    full key's never enters. ``order`` is unique in a key and decides between
    equal times. What is retained is what entered and hasn't left.
    """
    fields = {c: stream.schema[c].dataType.simpleString() for c in (key, order)}
    rows = stream.select(key, F.unix_micros(time).alias("us"), F.col(order).cast("long").alias("ord"))
    return rows.groupBy(key).transformWithStateInPandas(_Newest(cap, [key, order, "kept"]), f"{key} {fields[key]}, {order} long, kept boolean", "Update", "None")


def still_retained(changes_: DataFrame, key: str, order: str) -> DataFrame:
    """What entered and hasn't left, of a written stream of changes."""
    return changes_.groupBy(key, order).agg(F.bool_and("kept").alias("_in")).where("_in").drop("_in")


def retained(rows: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """The newest ``cap`` rows of each key. (ST-03)"""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")


def replay(rows: DataFrame, keys: list[str], cursor: int, buffer: int) -> DataFrame:
    """Buffered rows after a cursor; truncated if some of them have left the buffer. (ST-04)"""
    kept = retained(rows, keys, ["sequence"], buffer)
    low = F.min("sequence").over(W.partitionBy(*keys))
    return kept.withColumn("truncated", F.lit(cursor) < low - 1).where(F.col("sequence") > cursor)


def windowed_counts(stream: DataFrame, time: str, key: str, width: str, late: str = "1 day") -> DataFrame:
    """Rows per key and tumbling window. (ST-05)"""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def windowed_counts_and_late(stream: DataFrame, time: str, key: str, width: str, late: str = "1 day") -> tuple[DataFrame, int, int]:
    """(counts, rows, late rows) of a stream that is run to its end. (ST-05)

    Rows are counted by an observation of the source as they come in. A row
    whose window the watermark has passed is dropped by the aggregate, so what
    the windows lack of the observed rows is late, exactly, wherever partial
    counts are combined. Null times and null windows count as late.
    """
    progress: list[dict] = []
    out = run_to_end(windowed_counts(stream.observe("source", F.count(F.lit(1)).alias("rows")), time, key, width, late), "update", progress)
    latest = out.groupBy(key, "start").agg(F.max_by("n", "batch").alias("n"))
    rows = sum(p["counters"]["source"]["rows"] for p in progress if "source" in p["counters"])
    return latest, rows, rows - (latest.agg(F.sum("n")).first()[0] or 0)


def session_runs(stream: DataFrame, time: str, key: str, gap: str, late: str = "1 day") -> DataFrame:
    """Runs of rows of a key no further apart than a gap; a run comes out once the watermark passes it. (ST-05)"""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
