"""Sources and sinks: parts of captures, info texts, checked and versioned artifacts, rules of staleness."""

import threading

import pytest
from pyspark.sql import functions as F

from sessionloom.functions.text import comparison_text, normalised_name
from sessionloom.operators import calibration as ca
from sessionloom.operators import ledger as lg
from sessionloom.operators import lexical as lx
from sessionloom.session import scratch_path
from sessionloom.sources import capture as cp

DIE = "array<struct<sides:int,value:long,dropped:boolean>>"


@pytest.mark.parametrize("text, formula, dice, total, explicit, used, want", [
    ("", "", [(20, 5, False), (20, 17, False)], 20, None, None, ("advantage", [True, False], 17)),  # 20 - 3 is the higher
    ("", "", [(20, 5, False), (20, 17, False)], 8, None, None, ("disadvantage", [False, True], 5)),
    ("", "", [(20, 5, False), (20, 17, False)], 30, None, None, ("none", [False, False], 5)),
    ("with Disadvantage", "", [(20, 5, False), (6, 6, False), (20, 17, False)], None, None, None, ("disadvantage", [False, False, True], 5)),
    ("", "2 d20 KH1", [(20, 5, False), (20, 17, False)], None, None, 4, ("advantage", [True, False], 4)),
    ("advantage", "", [(20, 5, False)], 8, None, None, ("none", [False], 5)),  # one d20 tells nothing
    ("", "", [(20, 5, False)], 8, " High", None, ("advantage", [False], 5)),  # but a flag does
    ("", "", [(20, 5, True), (20, 17, False)], 99, None, None, ("advantage", [True, False], 17)),  # by what was dropped
    ("", "", [(20, 17, True), (20, 5, False)], None, None, None, ("disadvantage", [True, False], 5)),
    ("", "", [(20, 9, False), (20, 9, False)], 12, None, None, ("none", [False, False], 9)),
    (None, None, [], None, None, None, ("none", [], None)),
])
def test_advantage(spark, text, formula, dice, total, explicit, used, want):
    row = spark.createDataFrame([(text, formula, dice, total, explicit, used)], f"t string, f string, d {DIE}, n long, e string, u long")
    r = row.select(cp.advantage_of(F.col("t"), F.col("f"), F.col("d"), F.col("n"), F.lit(3), F.col("e"), F.col("u")).alias("x")).first().x
    assert (r.advantage, [d.dropped for d in r.dice], r.used) == want


@pytest.mark.parametrize("text, speaker, target, want", [
    ("Old Bram and old bram met the Ogre", "Ann", None, ["Old Bram", "Ogre"]),
    ("Target: a Red Dragon., NPC = goblin | enemy:Attack", "goblin", "the  Lich!", ["Lich", "Red Dragon", "Red"]),
    ("see Zoë Müller-Löw and D'Arc O’Neil; a Damage", None, None, ["Zoë Müller-Löw", "D'Arc O’Neil"]),
    ("", "x", None, []), (None, None, None, None),
])
def test_name_mentions(spark, text, speaker, target, want):
    row = spark.createDataFrame([(text, speaker, target)], "t string, s string, x string")
    assert row.select(cp.name_mentions(F.col("t"), F.col("s"), F.col("x")).alias("n")).first().n == want


def test_info_texts_keep_what_they_do_not_understand(spark):
    texts = {
        "a": "Recording 1\n\nGuild:\tG one\nserver: other\nStart time: never\nStarted: 2024-01-02T03:04:05Z\nTracks: 2\n\t1: ann#1234 (12345678901234567)\n\t2) bob: the bold\n\t\n\t(123456789012345678)\n\t#1234\nChannel: table\n\tzoe\nfoo: bar\n???",
        "b": "  lone#99 (1)\r\nGuild:\r\nusers:\r\n  1:\r\n  77",
        "c": "",
    }
    lines = spark.createDataFrame(list(texts.items()), "path string, t string").select("path", F.posexplode(F.split("t", "\n")).alias("line_no", "line"))
    header, people, lost = cp.recording_info(lines)
    assert {r.path: (r.started_at and r.started_at.isoformat(), r.guild, r.channel) for r in header.collect()} == {"a": ("2024-01-02T03:04:05", "G one", "table"), "b": (None, None, None)}
    got = sorted((r.path, r["index"], r.line_index, r.name, r.discriminator, r.user_id) for r in people.collect())
    assert got == [
        ("a", 1, 1, "ann", "1234", "12345678901234567"), ("a", 2, 2, "bob: the bold", None, None), ("a", 3, None, "", None, "123456789012345678"), ("a", 4, None, "zoe", None, None),
        ("b", 1, None, "lone#99 (1)", None, None), ("b", 2, None, "1:", None, None), ("b", 3, None, "77", None, None),
    ]
    assert sorted((r.path, r.line) for r in lost.collect()) == [("a", "#1234"), ("a", "???"), ("a", "Recording 1"), ("a", "foo: bar")]


def test_compatibility_forms(spark):
    value = lambda c, x: spark.createDataFrame([(x,)], "t string").select(c(F.col("t")).alias("n")).first().n
    assert [value(normalised_name, x) for x in ("Sére", "ﬁne#12", "Ａｎｎ①#123456", "日本 ー!", "a#1", None, "", "½")] == ["sere", "fine", "ann1", "日本 ー", "a 1", None, "", "1 2"]
    assert [value(comparison_text, x) for x in ("ﬁne—Ａ!", "é", None)] == ["fine a", "é", None]


def test_checked_artifacts_name_their_first_five_issues(spark):
    path = scratch_path(spark, "lines")
    rows = ['{"a": 1, "b": "x"}', '{"a": "oops", "b": "x"}', '{"b": "x"}', "not json", '{"a": -1, "b": "x"}', '{"a": 3}', '{"a": 4}']
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(path)
    schema, rules = "a bigint NOT NULL, b string NOT NULL", {"a: not negative": "a >= 0"}
    with pytest.raises(ValueError) as e:
        cp.read_checked(spark, path, schema, rules)
    assert [x.split(":")[0] for x in str(e.value).split("schema: ")[1].split("; ")] == ["malformed", "a", "a", "malformed", "a"]
    fine = scratch_path(spark, "lines")
    table = spark.createDataFrame([(1, "x"), (2, "y")], "a long, b string")
    with pytest.raises(ValueError, match="a: small"):
        cp.write_checked(table, fine, {"a: small": "a < 2"})
    cp.write_checked(table, fine, {"a: small": "a < 3"})
    assert sorted(map(tuple, cp.read_checked(spark, fine, schema, rules).collect())) == [(1, "x"), (2, "y")]


def test_a_reader_never_misses_the_pointer(spark):
    """Readers that run while versions change see one of them, whole, each time."""
    path = scratch_path(spark, "versions")
    version = lambda v: spark.createDataFrame([(v, i) for i in range(v)], "v int, i int")
    cp.write_versioned(version(1), path, 1)
    seen, failed, stop = [], [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                rows = cp.read_active(spark, path, "v int, i int").collect()
                seen.append((rows[0].v, len(rows)))
            except Exception as e:
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for v in range(2, 8):
        cp.write_versioned(version(v), path, v)
    stop.set()
    reader.join()
    assert not failed, str(failed[0])[:3000]
    assert seen and all(v == n for v, n in seen) and seen == sorted(seen)
    assert sorted((r.version, r.rows) for r in cp.read_run_log(spark, path).collect()) == [(v, v) for v in range(1, 8)]
    glossary = scratch_path(spark, "glossary")
    cp.write_glossary(spark.createDataFrame([("b",), ("a",), (" a ",), ("",), (None,)], "term string"), glossary)
    lines = [r.value for r in spark.read.text(glossary).collect()]
    assert lines[0] == "# Glossary" and [r.term for r in cp.glossary_terms(spark.read.text(glossary)).collect()] == ["a", "b"]


def test_staleness_rules(spark):
    df = spark.createDataFrame
    inputs = df([(k, "p", "s") for k in range(8)], "k int, path string, sha string")
    params = df([(k, "x", "1") for k in (3, 4)] + [(5, "x", None)], "k int, name string, value string")
    digest = {r.k: r.digest for r in lg.input_digest(inputs, ["k"]).collect()}
    own = {r.k: r.params_hash for r in lg.params_digest(params, ["k"]).collect()}
    metas = [(1, digest[1], 2, None, "error"), (2, digest[2], 1, None, "ok"), (3, digest[3], 2, None, "ok"), (4, digest[4], 2, own[4], "ok"), (5, "other", 2, own[5], "ok"), (6, digest[6], 2, None, "ok"), (7, digest[7], 2, own[3], "ok")]
    metas = df(metas, "k int, digest string, version int, params_hash string, status string")
    got = {r.k: r.reason for r in lg.stale(inputs, metas, 2, ["k"], params, df([(k,) for k in (1, 2, 3, 4, 5, 7)], "k int")).collect()}
    assert got == {0: "never_run", 1: "failed", 2: "version", 3: "params", 5: "inputs", 6: "output_missing", 7: "params"}


def test_rules_of_the_campaign(spark):
    df, schema = spark.createDataFrame, "class string, weight double, polarity string, terms array<string>"
    defaults = df([("dice", 1.0, "ooc", ["d20"]), ("mood_ic", 0.5, None, ["thee"]), ("glossary", 0.9, "ooc", ["old"]), ("plain", 0.1, "ic", [])], schema)
    overrides = df([("dice", 2.0, None, ["d20", "d6"]), ("vocative", 0.7, "ooc", ["gone"]), ("plain", 0.2, None, ["x"])], schema)
    got = {r["class"]: (r.weight, r.polarity, r.terms) for r in lx.rule_table(defaults, overrides, df([("glossary", "Mill"), ("vocative", "Ann")], "class string, term string")).collect()}
    assert got == {"dice": (2.0, "ooc", ["d20", "d6"]), "mood_ic": (0.5, "ic", ["thee"]), "glossary": (0.9, "ic", ["Mill"]), "vocative": (0.7, "ic", ["Ann"]), "proper_noun": (0.35, "ic", []), "plain": (0.2, "ooc", ["x"])}


def test_hold_out_without_sessions(spark):
    rows = [(i, None) for i in range(11)]
    labels = spark.createDataFrame(rows, "id long, session_id long")
    assert sorted(r.id for r in ca.hold_out(labels).where("held_out").collect()) == [9, 10]
    assert [r.id for r in ca.hold_out(labels.where("id < 3")).where("held_out").collect()] == [2]
    some = labels.withColumn("session_id", F.when(F.col("id") < 5, F.col("id") % 3))
    assert sorted(r.id for r in ca.hold_out(some).where("held_out").collect()) == [2]
