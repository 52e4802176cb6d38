"""Sources: chat captures as JSON or HTML, recording infos, track names, registries; and sinks.

A capture is a column of documents; all functions turn columns into columns or
rows, so any number of captures are read in one job.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ascii_edges

# The fields of a captured message under all their names.
MESSAGE = "id string, seq bigint, t_wall_ms bigint, t_wallclock bigint, who string, player_id string, playerId string, kind string, text string, `to` string, target string, whisper_to string, outer_html string, outerHTML string, roll struct<formula:string,total:bigint,target:string>, formula string, total bigint"
CAPTURE = "mode string, messages array<string>, turnorder_events array<string>"
ORDER = "id string, seq bigint, t_wall_ms bigint, t_wallclock bigint, who string, kind string, entries array<struct<name:string,value:double>>, turnorder array<struct<name:string,value:double>>"
#: The fields of a captured die under all their names.
DIE = "value double, v double, result double, die double, sides int, size int, d int, dropped string, `drop` string, discarded string, used boolean, kept boolean"
GENERIC_NAMES = ["attack", "damage", "to hit", "hit", "initiative", "saving throw", "save", "check", "ability check", "death save", "result", "total", "action", "weapon", "spell"]
#: A word in capitals, and what names a creature in front of a colon.
CAPITAL, LABEL = r"[A-Z][\p{L}\p{M}0-9'’.-]*", r"(?i)(?:target|npc|creature|enemy|opponent)\s*[:=]\s*([^,;|]+)"
INFO_START, INFO_GUILD, INFO_CHANNEL = ["start time", "started", "start", "recording started"], ["guild", "server"], ["channel", "voice channel"]


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw): one row per file below ``path``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def document(raw: Column) -> Column:
    """A capture's own text: what a JSON string holds, else the text itself."""
    return F.when(F.ltrim(raw).startswith('"'), F.coalesce(F.get_json_object(F.when(F.try_parse_json(raw).isNotNull(), F.trim(raw)), "$"), raw)).otherwise(raw)


def archive_html(raw: Column) -> Column:
    """The page of an archive: a field of a JSON object, else the document itself."""
    doc = document(raw)
    return F.coalesce(*[F.get_json_object(doc, f"$.{name}") for name in ("html", "archive_html", "chat_archive_html")], doc)


def route(raw: Column) -> Column:
    """json for arrays and objects, but objects with a page in them; else html, so that broken JSON is kept as text. (SRC-03)"""
    doc = document(raw)
    return F.when(F.ltrim(doc).rlike(r"^[\[{]") & F.try_parse_json(doc).isNotNull() & (archive_html(raw) == doc), "json").otherwise("html")


def _items(captures: DataFrame) -> DataFrame:
    """Captures with their mode, messages and order events as JSON texts; an array is a list of messages."""
    doc = document(F.col("raw"))
    parsed = F.from_json(F.when(F.ltrim(doc).startswith("["), F.concat(F.lit('{"messages":'), doc, F.lit("}"))).otherwise(doc), CAPTURE)
    return captures.select("session_id", parsed.alias("c")).select("session_id", F.col("c.mode").alias("capture_mode"), F.coalesce("c.messages", F.array().cast("array<string>")).alias("messages"), F.coalesce("c.turnorder_events", F.array().cast("array<string>")).alias("events"))


def json_messages(captures: DataFrame) -> DataFrame:
    """(session_id, source_index, …): messages with alias fields coalesced; bare items are their text. (SRC-01)"""
    rows = _items(captures).select("session_id", "capture_mode", F.posexplode("messages").alias("source_index", "item"))
    held = rows.withColumn("m", F.when(F.ltrim("item").startswith("{"), F.from_json("item", MESSAGE)))
    pick = lambda *names: F.coalesce(*[F.col(f"m.{n}") for n in names])
    return held.select(
        "session_id", F.col("source_index").cast("long").alias("source_index"), pick("id").alias("id"), pick("seq").alias("seq"), pick("t_wall_ms", "t_wallclock").alias("t_wall_ms"), pick("who").alias("who"), pick("player_id", "playerId").alias("player_id"),
        pick("kind").alias("source_kind"), F.coalesce(F.col("m.text"), F.when(F.col("m").isNull(), F.col("item"))).alias("text"), pick("to", "whisper_to", "target").alias("whisper_to"), pick("outerHTML", "outer_html").alias("markup"),
        F.coalesce("m.roll.formula", "m.formula").alias("formula"), F.coalesce("m.roll.total", "m.total").alias("total"),
    )


def turnorder_events(captures: DataFrame) -> DataFrame:
    """(session_id, source_index, id, seq, t_wall_ms, who, entries) of a capture's order changes. (SRC-01)

    Messages of kind turnorder or with entries come first, then the events
    listed beside the messages whose id none of those and no earlier event has;
    they follow the messages in place. Items that are no objects are left out.
    """
    items = _items(captures)
    listed = lambda c, at: items.select("session_id", F.posexplode(c).alias("pos", "item"), F.size("messages").alias("n")).where(F.ltrim("item").startswith("{")).select("session_id", at.cast("long").alias("source_index"), F.from_json("item", ORDER).alias("e")).select(
        "session_id", "source_index", F.col("e.id").alias("id"), F.col("e.seq").alias("seq"), F.coalesce("e.t_wall_ms", "e.t_wallclock").alias("t_wall_ms"), F.col("e.who").alias("who"), F.col("e.kind").alias("kind"), F.coalesce("e.entries", "e.turnorder").alias("entries")
    )
    own = listed("messages", F.col("pos")).where("kind = 'turnorder' OR entries IS NOT NULL")
    return own.unionByName(new_turnorder(own, listed("events", F.col("n") + F.col("pos")))).drop("kind")


def turnorder_messages(events: DataFrame) -> DataFrame:
    """Order events as messages of their own, to be united with the others. (SRC-01)"""
    return events.select("session_id", "source_index", "id", "seq", "t_wall_ms", "who", F.lit("turnorder").alias("source_kind"), F.lit("Turn order updated").alias("text"))


def html_messages(captures: DataFrame) -> DataFrame:
    """(session_id, source_index, id, who, source_kind, text): message elements of an archive page. (SRC-02)

    Elements of class ``message`` or with a message id, the outermost ones,
    within the element ``textchat`` if there is one. A page with text but no
    such element is one message, so that nothing is lost.
    """
    found = F.pandas_udf(lambda pages: pages.map(page_messages), "array<struct<id:string,who:string,source_kind:string,text:string>>")
    rows = captures.select("session_id", F.posexplode(found(archive_html(F.col("raw")))).alias("source_index", "m"))
    return rows.select("session_id", F.col("source_index").cast("long").alias("source_index"), "m.*")


_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?>=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_KINDS = ["general", "emote", "whisper", "desc", "rollresult", "gmrollresult", "system"]


def _elements(page: str, wanted: Callable[[dict[str, str]], bool]) -> list[tuple[dict[str, str], str]]:
    """Attributes and inner markup of the outermost elements that are wanted; only tags of an element's own name are counted to find its end."""
    out, name, depth, attributes, begin = [], None, 0, {}, 0
    for m in _TAG.finditer(page):
        tag = m[2].lower()
        if name is None:
            if not m[1] and tag not in _VOID:
                attributes = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer(m[3])}
                if wanted(attributes):
                    name, depth, begin = tag, 1, m.end()
        elif tag == name:
            depth += -1 if m[1] else 1
            if not depth:
                out.append((attributes, page[begin : m.start()]))
                name = None
    return out if name is None else [*out, (attributes, page[begin:])]


def _is_message(attributes: dict[str, str]) -> bool:
    return "message" in attributes.get("class", "").lower().split() or "data-messageid" in attributes or "data-message-id" in attributes


def markup_text(markup: str) -> str:
    """Text of markup: scripts dropped, tags as white space, the basic and all numeric references decoded, white space collapsed."""
    bare = re.sub(r"(?is)<\s*(?:script|style)[^>]*>.*?<\s*/\s*(?:script|style)\s*>", " ", markup)
    named = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}

    def char(m: re.Match) -> str:
        code = int(m[2]) if m[2] else int(m[3], 16) if m[3] else None
        return named[m[1].lower()] if m[1] else chr(code) if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else m[0]

    return " ".join(re.sub(r"(?i)&(?:(amp|lt|gt|quot|apos|nbsp)|#(\d{1,8})|#x([\da-f]{1,8}));", char, re.sub(r"<[^>]*>", " ", bare)).split())


def page_messages(page: str | None) -> list[dict[str, str | None]]:
    """Messages of one page in order; see ``html_messages``."""
    if not page or not page.strip():
        return []
    root = _elements(page, lambda a: a.get("id", "").lower() == "textchat")
    out = []
    for attributes, inner in _elements(root[0][1] if root else page, _is_message):
        by = _elements(inner, lambda a: not {"by", "speaker"}.isdisjoint(a.get("class", "").lower().split()))
        who = (by[0][0].get("data-who") or by[0][0].get("data-speaker") or markup_text(by[0][1])).strip().rstrip(":").strip() if by else ""
        who = who or attributes.get("data-who") or attributes.get("data-speaker")
        text = markup_text(inner)
        if who:
            text = re.sub(rf"(?i)^{re.escape(who)}\s*:?\s*", "", text).strip()
        kinds = [k for k in _KINDS if k in attributes.get("class", "").lower().split()]
        out.append({"id": attributes.get("data-messageid") or attributes.get("data-message-id"), "who": who, "source_kind": kinds[0] if kinds else None, "text": text})
    return out or [{"id": None, "who": None, "source_kind": None, "text": markup_text(page)}]


def preferred_capture(files: DataFrame) -> DataFrame:
    """One capture per session: named captures before other JSON before HTML, then by path. (SRC-04)"""
    p = F.lower("path")
    rank = F.when(p.endswith("chat-capture.json"), 0).when(p.endswith(".json"), 1).when(p.rlike(r"\.html?$"), 2).otherwise(3)
    return files.withColumn("_r", F.row_number().over(W.partitionBy("session_id").orderBy(rank, "path"))).where("_r = 1").drop("_r")


def capture_mode(source: Column, mode: Column) -> Column:
    """live, post_hoc or archive. (SRC-05)"""
    return F.when(source == "html", "archive").when(mode == "live", "live").otherwise("post_hoc")


def message_order(messages: DataFrame) -> DataFrame:
    """``ord``: by wall time, then number, then place; nulls last. (SRC-06)"""
    w = W.partitionBy("session_id").orderBy(F.asc_nulls_last("t_wall_ms"), F.asc_nulls_last("seq"), "source_index")
    return messages.withColumn("ord", F.row_number().over(w).cast("long"))


def new_turnorder(messages: DataFrame, events: DataFrame) -> DataFrame:
    """Order events that no message and no earlier event has the id of; those without id all stay. (SRC-07)"""
    first = F.row_number().over(W.partitionBy("session_id", "id").orderBy("source_index"))
    known = events.where("id IS NOT NULL").withColumn("_r", first).where("_r = 1").drop("_r").join(messages.where("id IS NOT NULL").select("session_id", "id").distinct(), ["session_id", "id"], "left_anti")
    return known.unionByName(events.where("id IS NULL"))


def message_kind(source: Column, text: Column) -> Column:
    """(SRC-08)"""
    return F.when(source.isin("rollresult", "gmrollresult") | text.rlike(r"\[\[|/r(oll)? "), "roll").when(source == "general", "chat").when(source == "emote", "emote").when(source == "whisper", "whisper").when(source == "desc", "description").when(source == "system", "system").when(source == "turnorder", "turnorder").otherwise("other")


def formula_of(explicit: Column, markup: Column, text: Column) -> Column:
    """The explicit field, a data attribute, an inline roll, a command, a title. (SRC-09)"""
    pick = lambda c, p: F.nullif(F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), p, 1)), F.lit(""))
    return F.coalesce(F.nullif(F.trim(explicit), F.lit("")), pick(markup, r'data-formula="([^"]*)"'), pick(text, r"\[\[([^\]]+)\]\]"), pick(text, r"(?i)/r(?:oll)? ([^<\n]+)"), pick(markup, r'title="[Rr]olling ([^"=]+)'))


def dice_sides(formula: Column) -> Column:
    """The sides of each die that ``NdM`` terms roll, N from 1 to 100. (SRC-10)"""
    terms = F.regexp_extract_all(formula, F.lit(r"(?i)(\d*d\d+)"), F.lit(1))
    expand = F.transform(terms, lambda t: F.array_repeat(F.regexp_extract(t, r"(?i)d(\d+)", 1).cast("int"), F.coalesce(F.regexp_extract(t, r"^(\d*)", 1).try_cast("int"), F.lit(1))))
    fine = F.filter(expand, lambda a: (F.size(a) >= 1) & (F.size(a) <= 100))
    return F.flatten(fine)


def modifier_sum(formula: Column) -> Column:
    """The signed constants beside the dice. (SRC-11)"""
    rest = F.regexp_replace(F.regexp_replace(formula, r"\s", ""), r"(?i)[+-]?\d*d\d+(k[hl]?\d+)?", "")
    return F.aggregate(F.regexp_extract_all(rest, F.lit(r"([+-]?\d+)"), F.lit(1)), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))


def kept_dice(items: Column, sides: Column) -> Column:
    """array<struct<sides,value,dropped>> of captured dice, each a number or an object as JSON text. (SRC-12)

    Alias fields are coalesced, missing sides filled by position; a die is
    dropped if one of the drop fields is true or it isn't used or kept. Items
    without a value are left out.
    """

    def one(x, i):
        e = F.from_json(F.when(F.ltrim(x).startswith("{"), x), DIE)
        flag = F.coalesce(e["dropped"], e["drop"], e["discarded"])
        value = F.coalesce(F.when(x.rlike(r'^"?-?\d+(\.\d+)?"?$'), F.replace(x, F.lit('"'), F.lit("")).try_cast("double")), e["value"], e["v"], e["result"], e["die"])
        dropped = F.coalesce(flag.isin("true", "1"), F.lit(False)) | ~F.coalesce(e["used"], F.lit(True)) | ~F.coalesce(e["kept"], F.lit(True))
        return F.struct(F.coalesce(e["sides"], e["size"], e["d"], F.get(sides, i)).alias("sides"), value.alias("value"), dropped.alias("dropped"))

    return F.filter(F.transform(items, one), lambda d: d["value"].isNotNull())


def markup_dice(markup: Column, sides: Column) -> Column:
    """Dice of a message's markup: its die elements, else the numbers in brackets of its titles. (SRC-12)"""
    number = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r'data-(?:die|value|result)\s*=\s*"(-?\d+(?:\.\d+)?)"', 1), F.lit("")), F.nullif(F.regexp_extract(x, r">\D*?(-?\d+(?:\.\d+)?)", 1), F.lit(""))).try_cast("double")
    own = lambda x: F.nullif(F.coalesce(F.nullif(F.regexp_extract(x, r'data-(?:sides|size)\s*=\s*"(\d+)"', 1), F.lit("")), F.regexp_extract(x, r'class\s*=\s*"(?:[^"]*\s)?d(\d+)[\s"]', 1)), F.lit("")).try_cast("int")
    elements = F.regexp_extract_all(markup, F.lit(r'(?i)(<[^>]*(?:class\s*=\s*"(?:[^"]*\s)?(?:die|diceroll|basicdiceroll)[\s"]|data-die\s*=)[^>]*>[^<]*)'), F.lit(1))
    dice = F.filter(F.transform(elements, lambda x, i: F.struct(F.coalesce(own(x), F.get(sides, i)).alias("sides"), number(x).alias("value"), x.rlike(r'(?i)(?:class|data-dropped)\s*=\s*"[^"]*(?:drop|discarded)').alias("dropped"))), lambda d: d["value"].isNotNull())
    titles = F.regexp_extract_all(markup, F.lit(r'(?i)(?:title|aria-label)\s*=\s*"([^"]*)"'), F.lit(1))
    groups = F.flatten(F.transform(titles, lambda t: F.regexp_extract_all(t, F.lit(r"\(([-+\d.,\s]+)\)"), F.lit(1))))
    numbers = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1))))
    titled = F.transform(numbers, lambda x, i: F.struct(F.get(sides, i).alias("sides"), x.try_cast("double").alias("value"), F.lit(False).alias("dropped")))
    return F.when(F.size(dice) > 0, dice).otherwise(titled)


def resolved_total(explicit: Column, markup: Column, dice: Column, modifier: Column) -> Column:
    """The explicit total, a number in a strong tag, ``= N``, else kept dice and modifier; null without dice. (SRC-13)"""
    found = lambda p: F.nullif(F.regexp_extract(F.coalesce(markup, F.lit("")), p, 1), F.lit("")).try_cast("double")
    kept = F.aggregate(F.filter(dice, lambda d: ~d["dropped"]), F.lit(0.0), lambda s, d: s + d["value"])
    return F.coalesce(explicit.cast("double"), found(r"(?i)<strong[^>]*>\s*(-?\d+(?:\.\d+)?)\s*</strong>"), found(r"=\s*(-?\d+(?:\.\d+)?)\s*(?:<|$)"), F.when(F.size(dice) > 0, kept + modifier))


def roll_kind(text: Column) -> Column:
    """Keywords in order; the first found decides. (SRC-14)"""
    t = F.lower(text)
    return F.when(t.rlike(r"death\s*save|death_save"), "death_save").when(t.rlike("initiative"), "initiative").when(t.rlike(ascii_edges(r"saving\s*throw|\bsave\b")), "save").when(t.rlike(ascii_edges(r"\bcheck\b|perception|athletics|acrobatics|insight|investigation")), "check").when(t.rlike("damage"), "damage").when(t.rlike(r"attack|to\s*hit"), "attack").otherwise("other")


def advantage_of(text: Column, formula: Column, dice: Column, total: Column, modifier: Column, explicit: Column, used: Column) -> Column:
    """struct<dice,advantage,used>: advantage, disadvantage or none, the dice with what was not chosen dropped, and the d20 that counts. (SRC-15)

    An explicit flag decides; of two or more d20 else the words of the text,
    kh or kl in the formula, or which d20 makes the total. Then, unless some
    are dropped already, all d20 but those of the chosen value are. If some
    are dropped and nothing else tells, a lower dropped one means advantage.
    ``dice`` are (sides, value, dropped).
    """
    flag = F.lower(F.trim(F.coalesce(explicit, F.lit(""))))
    said, form = F.coalesce(text, F.lit("")), F.coalesce(formula, F.lit(""))
    is20 = lambda d: d["sides"] == 20
    d20 = F.filter(dice, is20)
    values = F.transform(d20, lambda d: F.coalesce(d["value"], F.lit(0)))
    high, low, net = F.array_max(values), F.array_min(values), total - modifier
    several, none_dropped = F.size(d20) >= 2, ~F.exists(d20, lambda d: F.coalesce(d["dropped"], F.lit(False)))
    by_total = F.array_contains(values, net) & (high != low)
    told = (
        F.when(flag.isin("advantage", "adv", "high", "kh"), "advantage").when(flag.isin("disadvantage", "disadv", "low", "kl"), "disadvantage").when(~several, "none")
        .when(said.rlike("(?i)disadvantage"), "disadvantage").when(said.rlike("(?i)advantage"), "advantage").when(form.rlike(r"(?i)2\s*d\s*20\s*kh"), "advantage").when(form.rlike(r"(?i)2\s*d\s*20\s*kl"), "disadvantage")
        .when(F.coalesce(by_total, F.lit(False)), F.when(net == high, "advantage").otherwise("disadvantage")).otherwise("none")
    )
    chosen = F.when(F.coalesce(F.array_contains(values, net), F.lit(False)), net).when(told == "advantage", high).otherwise(low)
    drop = several & none_dropped & (told != "none")
    dropped = lambda d: F.when(drop & is20(d), ~F.coalesce(d["value"] == chosen, F.lit(False))).otherwise(F.coalesce(d["dropped"], F.lit(False)))
    out = F.transform(dice, lambda d: F.struct(d["sides"].alias("sides"), d["value"].alias("value"), dropped(d).alias("dropped")))
    first = F.try_element_at(F.filter(out, lambda d: is20(d) & ~d["dropped"]), F.lit(1))["value"]
    gone = F.filter(d20, lambda d: F.coalesce(d["dropped"], F.lit(False)))
    back = F.when(F.exists(gone, lambda d: d["value"] < F.coalesce(first, d["value"])), "advantage").otherwise("disadvantage")
    return F.struct(out.alias("dice"), F.when(several & (told == "none") & ~none_dropped, back).otherwise(told).alias("advantage"), F.coalesce(used, first).alias("used"))


def target_of(explicit: Column, markup: Column, text: Column) -> Column:
    """(SRC-16)"""
    pick = lambda c, p: F.nullif(F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), p, 1)), F.lit(""))
    return F.coalesce(F.nullif(F.trim(explicit), F.lit("")), pick(markup, r'data-target="([^"]*)"'), pick(text, r"(?i)target:\s*([\w ]+)"))


def name_mentions(text: Column, speaker: Column, target: Column) -> Column:
    """Proper names: the explicit target, labelled names, runs of words in capitals, words in capitals after an article. (SRC-17)

    White space is folded, trailing stops and leading articles go; generic
    labels and the speaker are left out; of spellings that differ in case the
    first is kept. Letters are those of any script, word edges those of ASCII.
    """
    all_of = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    edge = ascii_edges(r"\b")
    runs = all_of(rf"{edge}({CAPITAL}(?:\s+{CAPITAL})+){edge}")
    after = all_of(rf"{edge}(?:the|a|an)\s+({CAPITAL}){edge}")
    found = F.concat(F.when(target.isNull(), F.array().cast("array<string>")).otherwise(F.array(target)), all_of(LABEL), runs, after)
    plain = lambda n: F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(n, r"\s+", " ")), "[.,:;!?]+$", ""), r"(?i)^(?:the|a|an)\s+", "")
    fine = F.filter(F.transform(found, plain), lambda n: (n != "") & ~F.lower(n).isin(GENERIC_NAMES) & ~F.coalesce(F.lower(n) == F.lower(speaker), F.lit(False)))
    return F.filter(fine, lambda n, i: F.array_position(F.transform(fine, lambda m: F.lower(m)), F.lower(n)) == i + 1)


def parser_metrics(messages: DataFrame) -> DataFrame:
    """(session_id, parsed, unrecognised, rolls, turnorder). (SRC-19)"""
    n = lambda k: F.count_if(F.col("kind") == k)
    return messages.groupBy("session_id").agg(F.count_if(F.col("kind") != "other").alias("parsed"), n("other").alias("unrecognised"), n("roll").alias("rolls"), n("turnorder").alias("turnorder"))


def roll_records(rolls: DataFrame, players: DataFrame) -> DataFrame:
    """Rolls numbered r0001… in order, with the account's player. (SRC-20)"""
    w = W.partitionBy("session_id").orderBy("ord")
    return rolls.join(players, "account", "left").withColumn("roll_no", F.format_string("r%04d", F.row_number().over(w)))


def recording_info(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Header (path, started_at, guild, channel), participants (path, index, line_index, name, discriminator, user_id) and unparsed lines (path, line_no, line) of info texts. (SRC-21)

    A heading (tracks, channels, users, participants) opens the list; a line
    ``key: value`` closes it. Indented lines of the list, and others that are
    no ``key: value``, are participants ``1: name#1234 (id)``, all parts
    optional but a name or an id. The first value of a key counts; unknown keys
    and what else has no place are kept as unparsed. ``index`` numbers a text's
    participants, ``line_index`` is the number in the line.
    """
    text = F.regexp_replace("line", r"[\s]+$", "")
    bare = F.trim(F.regexp_replace(text, r"^\s+", ""))
    keyed = r"^\s*([A-Za-z][A-Za-z ]*?)\s*:\s*(.*)$"
    w = W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    held = lines.select("path", "line_no", text.alias("_text"), bare.alias("_bare"), F.col("line").rlike(r"^[\t ]+\S").alias("_indented")).where("_bare <> ''")
    held = held.withColumn("_heading", F.col("_text").rlike(r"(?i)^\s*(tracks|channels|users|participants)\s*:\s*(\d+)?\s*$")).withColumn("_keyed", ~F.col("_heading") & F.col("_text").rlike(keyed))
    # within the list indented lines are its own, whatever they look like; others with a key close it
    held = held.withColumn("_in", F.coalesce(F.last(F.when(F.col("_heading"), True).when(F.col("_keyed") & ~F.col("_indented"), False), ignorenulls=True).over(w), F.lit(False)))
    rest = F.regexp_replace("_bare", r"^\d{1,4}\s*[:.)-]\s*(?=.)", "")
    user = F.nullif(F.regexp_extract(rest, r"\((\d{17,20})\)\s*$", 1), F.lit(""))
    named = F.trim(F.regexp_replace(rest, r"\s*\(\d{17,20}\)\s*$", ""))
    held = held.withColumn("line_index", F.nullif(F.regexp_extract("_bare", r"^(\d{1,4})\s*[:.)-]\s*.", 1), F.lit("")).cast("int")).withColumn("user_id", user).withColumn("discriminator", F.nullif(F.regexp_extract(named, r"#(\d{4})\s*$", 1), F.lit(""))).withColumn("name", F.trim(F.regexp_replace(named, r"#\d{4}\s*$", "")))
    person = ~F.col("_heading") & F.col("_indented") & (F.col("_in") | ~F.col("_keyed")) & ((F.col("name") != "") | F.col("user_id").isNotNull())
    listed = ~F.col("_heading") & F.col("_indented") & F.col("_in")
    key, value = F.lower(F.regexp_extract("_text", keyed, 1)), F.trim(F.regexp_extract("_text", keyed, 2))
    known = [*INFO_START, *INFO_GUILD, *INFO_CHANNEL]
    held = held.withColumn("_person", person).withColumn("_key", F.when(F.col("_keyed") & ~listed & (value != ""), key)).withColumn("_value", value)
    first = lambda keys: F.min_by(F.when(F.col("_key").isin(keys), F.col("_value")), F.when(F.col("_key").isin(keys), F.col("line_no")))
    when = F.min_by(F.expr("try_to_timestamp(_value)"), F.when(F.col("_key").isin(INFO_START) & F.expr("try_to_timestamp(_value)").isNotNull(), F.col("line_no")))
    header = held.groupBy("path").agg(when.alias("started_at"), first(INFO_GUILD).alias("guild"), first(INFO_CHANNEL).alias("channel"))
    people = held.where("_person").withColumn("index", F.row_number().over(W.partitionBy("path").orderBy("line_no")).cast("long"))
    lost = ~F.col("_person") & ~F.col("_heading") & (listed | ~F.col("_keyed") | (F.col("_key").isNotNull() & ~F.col("_key").isin(known)))
    return header, people.select("path", "index", "line_index", "name", "discriminator", "user_id"), held.where(lost).select("path", "line_no", F.col("_bare").alias("line"))


def track_name(file: Column) -> Column:
    """struct<index,name,discriminator> of a track's file name. (SRC-22)"""
    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    index = F.nullif(F.regexp_extract(stem, r"^(\d+)[-_ ]", 1), F.lit("")).cast("int")
    tail = F.nullif(F.regexp_extract(stem, r"[_#](\d{4,6})$", 1), F.lit(""))
    return F.struct(index.alias("index"), F.regexp_replace(F.regexp_replace(stem, r"^\d+[-_ ]", ""), r"[_#]\d{4,6}$", "").alias("name"), tail.alias("discriminator"))


def track_ids(files: DataFrame) -> DataFrame:
    """Files with a number of their own: the first of an index keeps it, others take the next free ones in order. (SRC-23)"""
    first = F.row_number().over(W.partitionBy("session_id", "index").orderBy("file"))
    held = files.withColumn("_own", F.col("index").isNotNull() & (first == 1))
    kept = held.where("_own").select("session_id", "file", F.col("index").alias("track_no"))
    rest = held.where("NOT _own").withColumn("_k", F.row_number().over(W.partitionBy("session_id").orderBy(F.asc_nulls_last("index"), "file")))
    n = files.groupBy("session_id").agg(F.count("*").alias("n"))
    free = n.select("session_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("track_no")).join(kept.select("session_id", "track_no"), ["session_id", "track_no"], "left_anti")
    free = free.withColumn("_k", F.row_number().over(W.partitionBy("session_id").orderBy("track_no")))
    return kept.unionByName(rest.join(free, ["session_id", "_k"]).select("session_id", "file", "track_no"))


def glossary_terms(lines: DataFrame) -> DataFrame:
    """One term per list item. (SRC-26)"""
    return lines.withColumn("term", F.regexp_extract("value", r"^\s*[-*]\s+(.+?)\s*$", 1)).where("term <> ''")


def _commit(spark: SparkSession, path: str, text: str) -> None:
    """Give a small file its name, which is new, by one rename: readers see it whole or not at all."""
    jvm = spark.sparkContext._jvm
    target, temp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path[: path.rindex('/')]}/_{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(temp, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(temp, target):
        raise OSError(f"{path} could not be put in its place")


def write_versioned(table: DataFrame, path: str, version: int) -> None:
    """A version of a table, then a pointer to it. (SRC-29)

    Pointers are files of their own, made by one rename and never replaced; the
    greatest is in force. So a reader finds one whole version at any time, on
    stores whose renames don't overwrite too. A pointer counts the rows of its
    version, so the pointers are the run log as well (``read_run_log``). A
    version is written once.
    """
    spark, rows = table.sparkSession, Observation()
    table.observe(rows, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").json(f"{path}/version={version}")
    _commit(spark, f"{path}/log/{version}.json", json.dumps({"version": version, "rows": rows.get["n"]}) + "\n")


def read_active(spark: SparkSession, path: str, schema: str) -> DataFrame:
    version = read_run_log(spark, path).agg(F.max("version")).first()[0]
    return spark.read.schema(schema).json(f"{path}/version={version}")


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """(version, rows) of every version that was written. (SRC-29)"""
    return spark.read.schema("version int, rows long").json(f"{path}/log")


def write_glossary(terms: DataFrame, path: str) -> None:
    """Distinct terms as a Markdown list under a heading, in order, for SRC-26 to read. (SRC-29)"""
    items = terms.select(F.trim("term").alias("term")).where("term <> ''").distinct().select(F.col("term").alias("_o"), F.concat(F.lit("- "), "term").alias("value"))
    head = terms.sparkSession.createDataFrame([("", "# Glossary\n")], "_o string, value string")
    items.unionByName(head).repartitionByRange("_o").sortWithinPartitions("_o").select("value").write.mode("errorifexists").text(path)


def artifact_issues(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(place, issue) of rows that break a rule, a SQL condition by name, or are no JSON of the schema (``_bad``). (SRC-24)"""
    found = F.array(F.when(F.col("_bad").isNotNull(), F.concat(F.lit("malformed: "), F.substring("_bad", 1, 80))), *[F.when(F.col("_bad").isNull() & ~F.coalesce(F.expr(c), F.lit(False)), F.lit(name)) for name, c in rules.items()])
    return rows.select(F.monotonically_increasing_id().alias("place"), F.explode(F.array_compact(found)).alias("issue"))


def read_checked(spark: SparkSession, path: str, schema: str, rules: dict[str, str] | None = None) -> DataFrame:
    """JSON rows of a fixed schema; rows that break it or a rule fail the read, with the first five issues named. (SRC-24)

    A field ``NOT NULL`` in the schema is a rule of its own. The issues come
    from one pass that keeps five; a file that is missing or changes later fails too.
    """
    fields = T.StructType.fromDDL(schema)
    rules = {f"{f.name}: required": f"`{f.name}` IS NOT NULL" for f in fields if not f.nullable} | (rules or {})
    loose = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + [T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(loose).option("columnNameOfCorruptRecord", "_bad").json(path)
    first = [r.issue for r in artifact_issues(rows, rules).orderBy("place").limit(5).collect()]
    if first:
        raise ValueError(f"{path} does not match its schema: {'; '.join(first)}")
    return spark.read.schema(loose).option("columnNameOfCorruptRecord", "_bad").option("mode", "FAILFAST").json(path).drop("_bad")


def write_checked(table: DataFrame, path: str, rules: dict[str, str]) -> None:
    """Write JSON rows, unless one breaks a rule: nothing is written then, and the first five issues are named. (SRC-24)"""
    first = [r.issue for r in artifact_issues(table.withColumn("_bad", F.lit(None).cast("string")), rules).orderBy("place").limit(5).collect()]
    if first:
        raise ValueError(f"refusing to write {path}: {'; '.join(first)}")
    table.write.mode("errorifexists").json(path)


def append_labels(labels: DataFrame, path: str) -> None:
    """(SRC-25)"""
    labels.write.mode("append").json(path)


def read_labels(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The label log; a malformed line fails the query and is named. (SRC-25)"""
    rows = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where(F.when(F.col("_bad").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("malformed label: "), "_bad")).cast("boolean"))).drop("_bad")


def write_vectors(features: DataFrame, path: str) -> str:
    """Vectors as Parquet, under a name from the content of all rows; returns the path. (SRC-27)"""
    digest = features.agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), F.sum(F.xxhash64(*features.columns).cast("decimal(38,0)")).cast("string")), 256).alias("d")).first()[0]
    features.write.mode("overwrite").parquet(f"{path}/{digest[:16]}")
    return f"{path}/{digest[:16]}"


def read_registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Players of a registry document, one row each. (SRC-28)"""
    return spark.read.schema(f"players array<struct<{schema}>>").option("multiLine", True).json(path).select(F.explode("players").alias("p")).select("p.*")
