"""Streaming operators: batches in any cut, state that shrinks, late rows, and batch twins."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from sessionloom.session import scratch_path
from sessionloom.streaming import live

T0 = datetime.datetime(2024, 1, 1)


def at(hours):
    return T0 + datetime.timedelta(hours=hours)


def stream_of(spark, batches, schema):
    """A file stream that gives one list of rows a batch."""
    path = scratch_path(spark, "batches")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


MESSAGE = "game long, id string, who string, text string, markup string, seq long, ts timestamp"


def test_rerendered_messages_keep_their_first_place(spark):
    batches = [
        [(1, "a", "w", "old", "<p>", 1, at(0)), (1, None, "w", "hi", "<p>", 2, at(1)), (2, "a", "w", "other game", "<p>", 3, at(1))],
        [(1, "a", "w", "new", "<b>", 4, at(2)), (1, "", "w", "hi", "<p>", 5, at(2)), (1, None, "v", "hi", "<p>", 6, at(2))],
        [(1, "a", "w", "late", "<i>", 7, at(1.5)), (1, "b", None, None, None, 8, at(-1))],
    ]
    out = live.run_to_end(live.upsert(stream_of(spark, batches, MESSAGE), "100 days"), "update").drop("batch")
    latest = live.latest_rows(out.withColumn("k", F.struct("game", "key")), "k", "version").collect()
    got = {(r.game, r.key.split(":")[0], r.who): (r.first_seq, r.first_at, r.text, r.markup, r.version) for r in latest}
    assert got == {
        (1, "id", "w"): (1, at(0), "new", "<b>", 3), (2, "id", "w"): (3, at(1), "other game", "<p>", 1), (1, "fingerprint", "w"): (2, at(1), "hi", "<p>", 2),
        (1, "fingerprint", "v"): (6, at(2), "hi", "<p>", 1), (1, "id", None): (8, at(-1), None, None, 1),
    }


def test_state_of_messages_goes_after_its_time(spark):
    """Twenty batches an hour apart of ten messages each: state holds those of the last hours, and a message that comes back is new."""
    batches = [[(1, f"{h}-{i}", "w", "t", "m", 10 * h + i, at(h)) for i in range(10)] for h in range(20)] + [[(1, "0-0", "w", "again", "m", 999, at(20))]]
    progress = []
    out = live.run_to_end(live.upsert(stream_of(spark, batches, MESSAGE), "2 hours", late="1 hour"), "update", progress)
    rows = [p["state_rows"] for p in progress]
    assert max(rows) <= 10 * 6 and rows[-1] <= 10 * 5
    assert out.where("key = 'id:0-0'").count() == 2 and [r.first_seq for r in out.where("text = 'again'").collect()] == [999]
    progress = []
    live.run_to_end(live.first_renderings(stream_of(spark, batches, MESSAGE), "1 hour"), "append", progress)
    assert max(p["state_rows"] for p in progress) <= 10 * 5


def test_state_of_messages_is_read_and_written_by_bucket(spark):
    """However many messages are live, a batch has at most 1,024 values to read and write."""
    batches = [[(i % 50, str(i), "w", f"t{b}", "m", 4000 * b + i, at(b)) for i in range(4000)] for b in (0, 1)]
    progress = []
    out = live.run_to_end(live.upsert(stream_of(spark, batches, MESSAGE), "100 days"), "update", progress)
    assert max(p["state_rows"] for p in progress) <= 1024
    got = sorted((r.batch, r.game, r.key, r.first_seq, r.first_at, r.last_at, r.text, r.version) for r in out.collect())
    assert got == sorted((b, i % 50, f"id:{i}", i, at(0), at(b), f"t{b}", b + 1) for b in (0, 1) for i in range(4000))


def test_messages_of_a_bucket_go_one_by_one(spark):
    """A message is new again once the watermark is past its time; its neighbours in the bucket that were seen later aren't."""
    render = lambda name, seq, hours: (1, name, "w", "t", "m", seq, at(hours))
    batches = [[render("a", 1, 0), render("b", 2, 0)], [render("b", 3, 2)], [render("c", 4, 4)], [render("c", 5, 5.5)], [render("a", 6, 5), render("b", 7, 5)], [render("d", 8, 100)], [render("d", 9, 200)], [render("b", 10, 201), render("d", 11, 201)]]
    progress = []
    out = live.run_to_end(live.upsert(stream_of(spark, batches, MESSAGE), "3 hours", late="1 hour", buckets=1), "update", progress)
    assert {p["state_rows"] for p in progress} == {1}
    assert sorted((r.batch, r.key, r.first_seq, r.version) for r in out.collect()) == [
        (0, "id:a", 1, 1), (0, "id:b", 2, 1), (1, "id:b", 2, 2), (2, "id:c", 4, 1), (3, "id:c", 4, 2), (4, "id:a", 6, 1), (4, "id:b", 2, 3),
        (5, "id:d", 8, 1), (6, "id:d", 8, 2), (7, "id:b", 10, 1), (7, "id:d", 8, 3),
    ]


def test_games_of_messages_are_exact(spark):
    """Large ids beside a null one, which is a game too."""
    rows = [(g, "a", "w", "t", "m", 2**60 + i, at(i)) for i, g in enumerate([2**60 + 1, 2**60 + 2, None, 2**60 + 1, None])]
    out = live.run_to_end(live.upsert(stream_of(spark, [rows], MESSAGE), "100 days"), "update")
    assert {(r.game, r.first_seq - 2**60, r.version) for r in out.collect()} == {(2**60 + 1, 0, 2), (2**60 + 2, 1, 1), (None, 2, 2)}


def test_folds_in_order_of_time_whatever_the_batches(spark):
    """Rows that come in later batches with earlier times are in their place; those behind the watermark are dropped and counted."""
    rnd = random.Random(9)
    rows = [(k, i, rnd.choice([0, 0, 2, 3]), at(i * 0.1)) for i in range(300) for k in (1, 2)]
    mixed = sorted(rows, key=lambda r: r[1] + rnd.randrange(40))
    schema = "session_id long, seq long, entries long, ts timestamp"
    stream = stream_of(spark, [mixed[i : i + 60] for i in range(0, 600, 60)], schema)
    passed = at(299 * 0.1 - 10)

    def want(step, last=None):
        out = []
        for k in (1, 2):
            last = None
            for _, seq, entries, ts in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
                last, found = step(last, entries)
                if found is not None and ts <= passed:
                    out.append((k, seq, entries, found))
        return sorted(out)

    progress = []
    got = live.run_to_end(live.marker_stream(stream, "session_id", "seq", "entries", "ts", late="10 hours"), "append", progress)
    assert sorted(map(tuple, got.collect())) == want(live._marker) and sum(p["dropped"] for p in progress) == 0
    got = live.run_to_end(live.change_stream(stream, "session_id", "seq", "entries", "ts", late="10 hours"), "append")
    assert sorted(map(tuple, got.collect())) == [r[:3] for r in want(live._changed)]
    late = stream_of(spark, [rows[:400], rows[400:500], rows[500:] + [(1, 1000, 5, at(0)), (2, 1001, 5, at(1))]], schema)
    progress = []
    live.run_to_end(live.marker_stream(late, "session_id", "seq", "entries", "ts", late="1 hour"), "append", progress)
    assert sum(p["dropped"] for p in progress) == 2


def test_folds_of_a_closed_stream_give_all_rows(spark):
    """The rows of the last stretch, which the watermark of the newest row doesn't pass, come out once the stream is closed, and its closing row doesn't."""
    schema = "session_id long, seq long, entries long, ts timestamp"
    rows = [(k, 2**60 + i, (i // 3) % 2, at(i)) for i in range(30) for k in (1, 2)]
    path = scratch_path(spark, "closed")
    for some in (rows[:20], rows[20:]):
        data = spark.createDataFrame(some, schema)
        data.coalesce(1).write.mode("append").parquet(path)
    live.close_source(spark, data.schema, path, "ts")
    closed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    progress = []
    got = live.run_to_end(live.change_stream(closed, "session_id", "seq", "entries", "ts"), "append", progress)
    assert sorted(map(tuple, got.collect())) == sorted(r[:3] for r in rows if (r[1] - 2**60) % 3 == 0) and sum(p["dropped"] for p in progress) == 0


def test_changes_to_and_from_null_are_those_of_the_batch(spark):
    schema = "session_id long, seq long, kind string, ts timestamp"
    rows = [(1, i, kind, at(i)) for i, kind in enumerate(["a", None, None, "b", "b", None, "b", "a"])] + [(2, 0, None, at(0)), (2, 1, "a", at(1))]
    path = scratch_path(spark, "nulls")
    data = spark.createDataFrame(rows, schema)
    data.coalesce(1).write.parquet(path)
    live.close_source(spark, data.schema, path, "ts")
    got = live.run_to_end(live.change_stream(spark.readStream.schema(schema).parquet(path), "session_id", "seq", "kind", "ts"), "append")
    batch = live.changes(data, ["session_id"], ["ts", "seq"], "kind").select("session_id", "seq", "kind")
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))


@pytest.mark.parametrize("cap", [1, 7, 1000])
def test_retention_stream_equals_the_batch_and_is_capped(spark, cap):
    rnd = random.Random(cap)
    rows = [(rnd.randrange(3), i, at(rnd.randrange(50))) for i in range(400)]
    progress = []
    schema = "session_id long, seq long, ts timestamp"
    out = live.run_to_end(live.retention_stream(stream_of(spark, [rows[i : i + 80] for i in range(0, 400, 80)], schema), "session_id", "seq", "ts", cap), "update", progress)
    batch = live.retained(spark.createDataFrame(rows, schema), ["session_id"], ["ts", "seq"], cap)
    assert sorted(map(tuple, live.still_retained(out, "session_id", "seq").collect())) == sorted((r.session_id, r.seq) for r in batch.collect())
    assert max(p["state_rows"] for p in progress) <= 3 * cap


def test_late_rows_are_counted_exactly(spark):
    """Of partial counts in many partitions too: a row is late where its window has been passed."""
    batches = [[("a", at(h + i / 200)) for i in range(100)] for h in (0, 10, 20)] + [[("a", at(0.5))] * 30 + [("b", at(1.5))] * 12 + [("a", at(20.5))] * 5 + [("b", None)] * 2]
    counts, rows, late = live.windowed_counts_and_late(stream_of(spark, batches, "kind string, ts timestamp"), "ts", "kind", "1 hour", late="2 hours")
    assert (rows, late) == (349, 44)
    assert sorted((r.kind, r.start, r.n) for r in counts.collect()) == [("a", at(0), 100), ("a", at(10), 100), ("a", at(20), 105)]
