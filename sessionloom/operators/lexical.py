"""Operators that score texts against a lexicon, and find numbers, names and quotes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import point_join

# Contractions, and words for numbers.
CONTRACTIONS = {
    "can't": "cannot", "couldn't": "could not", "didn't": "did not", "doesn't": "does not", "don't": "do not", "i'd": "i would", "i'll": "i will", "i'm": "i am", "i've": "i have", "isn't": "is not", "it'll": "it will",
    "let's": "let us", "shouldn't": "should not", "that's": "that is", "they're": "they are", "wasn't": "was not", "we'll": "we will", "we're": "we are", "weren't": "were not", "won't": "will not", "wouldn't": "would not", "you're": "you are",
}
SMALL_NUMBERS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]

NUMBERS = {w: i for i, w in enumerate(SMALL_NUMBERS)} | {w: 10 * (i + 2) for i, w in enumerate(TENS)}

_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


def number_said(tokens: list[str]) -> int | None:
    """The number that all ``tokens`` say together, None if they don't; see ``spoken_number``."""
    if len(tokens) == 1 and tokens[0].isascii() and tokens[0].isdigit():
        return int(tokens[0])
    total, seen = 0, False
    for t in tokens:
        if t == "and":
            continue
        if t in NUMBERS:
            total += NUMBERS[t]
        elif t == "hundred" and total > 0:
            total *= 100
        else:
            return None
        seen = True
    return total if seen else None


def spoken_number(tokens: Column) -> Column:
    """The number that all tokens of an array say together, else null. (TXT-02)

    Number words add up in any order, ``hundred`` multiplies what was said
    before it if that isn't 0, ``and`` is skipped anywhere, and digits count
    alone only, up to 18 of them.
    """
    known = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(False).alias("seen"), F.lit(True).alias("fine"))

    def step(s, t):
        value = F.try_element_at(known, t)
        hundred = (t == "hundred") & (s["total"] > 0)
        total = F.when(hundred, s["total"] * 100).otherwise(s["total"] + F.coalesce(value, F.lit(0)))
        return F.struct(total.alias("total"), (s["seen"] | value.isNotNull() | hundred).alias("seen"), (s["fine"] & (value.isNotNull() | hundred | (t == "and"))).alias("fine"))

    said = F.aggregate(tokens, start, step, lambda s: F.when(s["fine"] & s["seen"], s["total"]))
    return F.when((F.size(tokens) == 1) & F.get(tokens, F.lit(0)).rlike(r"^[0-9]{1,18}$"), F.get(tokens, F.lit(0)).try_cast("long")).otherwise(said)


def normalise(text: str) -> str:
    words = " ".join(_TOKEN.findall(text.lower().replace("’", "'").replace("‘", "'")))
    tokens = " ".join(CONTRACTIONS.get(t, t) for t in words.split()).replace("'", " ").split()
    out, i = [], 0
    while i < len(tokens):
        for n in (3, 2, 1):
            value = number_said(tokens[i : i + n]) if i + n <= len(tokens) else None
            if value is not None:
                out.append(str(value))
                i += n
                break
        else:
            out.append(tokens[i])
            i += 1
    return " ".join(out)


def normalised_text(text: Column) -> Column:
    """Lower case, contractions spelled out, spoken numbers as digits; null stays null. (TXT-01)"""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: normalise(t) if t is not None else None)

    return F.pandas_udf(run, "string")(text)


def tokens_of(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


#: Classes whose terms are names of the campaign, with their usual weights.
NAME_CLASSES = {"glossary": 0.45, "proper_noun": 0.35, "vocative": 0.3}


def rule_table(defaults: DataFrame, overrides: DataFrame, names: DataFrame) -> DataFrame:
    """(class, weight, polarity, terms) of the rules in force. (TXT-03)

    Both sides have class, weight, polarity and terms. An override replaces
    weight and polarity and adds its terms. ``names`` (class, term) are the
    glossary, the names of characters that are not players' (proper_noun) and
    of those that are (vocative): they replace all terms of their class, which
    keeps its weight and is in character. A class without a polarity is in
    character if ``ic`` is a part of its name.
    """
    d = defaults.select("class", F.col("weight").alias("_w"), F.col("polarity").alias("_p"), F.col("terms").alias("_t"))
    o = overrides.select("class", F.col("weight").alias("_ow"), F.col("polarity").alias("_op"), F.col("terms").alias("_ot"), F.lit(True).alias("_o"))
    none = F.array().cast("array<string>")
    merged = d.join(o, "class", "full_outer").select("class", F.coalesce("_ow", "_w").alias("weight"), F.when(F.col("_o"), F.col("_op")).otherwise(F.col("_p")).alias("polarity"), F.array_union(F.coalesce("_t", none), F.coalesce("_ot", none)).alias("terms"))
    given = names.groupBy("class").agg(F.collect_set("term").alias("_names"))
    usual = names.sparkSession.createDataFrame(list(NAME_CLASSES.items()), "class string, _usual double")
    named = usual.join(given, "class", "left").join(merged.select("class", "weight"), "class", "left")
    named = named.select("class", F.coalesce("weight", "_usual").alias("weight"), F.lit("ic").alias("polarity"), F.coalesce("_names", none).alias("terms"))
    out = merged.where(~F.col("class").isin(*NAME_CLASSES)).unionByName(named)
    by_name = F.when(F.col("class").rlike("(?i)(?:^|[_-])ic(?:$|[_-])"), "ic").otherwise("ooc")
    return out.select("class", "weight", F.coalesce("polarity", by_name).alias("polarity"), F.array_sort("terms").alias("terms"))


def lexicon_issues(lexicon: DataFrame) -> DataFrame:
    """(class, term, issue) of unusable rules. (TXT-04)"""
    issue = F.array_compact(F.array(F.when(F.trim("term") == "", "empty_term"), F.when(F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") < 0), "bad_weight"), F.when(~F.col("polarity").isin("in", "out"), "bad_polarity")))
    return lexicon.select("class", "term", F.explode(issue).alias("issue"))


def phrase_markers(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(id, class, polarity, weight, term, pos): terms found as runs of tokens. (TXT-05)

    Token n-grams of the lengths that terms have meet the terms in an
    equi-join, so a text is never compared with every term. Terms of the class
    ``vocative`` count only where the text addresses with them: after its
    beginning or one of , ! ? ; and before one of , ! ? :
    """
    terms = lexicon.select("class", "polarity", "weight", "term", tokens_of(F.col("term")).alias("_t")).withColumn("gram", F.array_join("_t", " ")).withColumn("_n", F.size("_t"))
    lengths = sorted(r[0] for r in terms.where("_n > 0").select("_n").distinct().collect())  # of terms: a few numbers

    def found(own: DataFrame) -> DataFrame:
        toks = texts.select("id", tokens_of(F.col("text")).alias("t"))
        gram = lambda n: lambda i: F.array_join(F.slice("t", i, n), " ")
        runs = [toks.where(F.size("t") >= n).select("id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), gram(n))).alias("pos", "gram")) for n in lengths or [1]]
        grams = runs[0]
        for r in runs[1:]:
            grams = grams.unionByName(r)
        return grams.join(own.drop("_t", "_n"), "gram")

    plain = found(terms.where("class IS DISTINCT FROM 'vocative'"))
    addressed = F.regexp_like("text", F.concat(F.lit(r"(?i)(?:^|[,!?;])\s*"), "gram", F.lit(r"\s*[,!?:]")))
    called = found(terms.where("class = 'vocative'")).join(texts.select("id", "text"), "id").where(addressed)  # texts of matches only
    columns = ["id", "class", "polarity", "weight", "term", F.col("pos").cast("long").alias("pos")]
    return plain.select(*columns).unionByName(called.select(*columns)).dropDuplicates(["id", "class", "term", "pos"])


def real_name_markers(texts: DataFrame, players: DataFrame, characters: DataFrame) -> DataFrame:
    """(id, owner, pos): other players' first names, but for words that characters have too. (TXT-06)"""
    names = players.select(F.col("player_id").alias("owner"), F.element_at(tokens_of(F.col("display_name")), 1).alias("token")).join(characters.select(F.explode(tokens_of(F.col("name"))).alias("token")).distinct(), "token", "left_anti")
    words = texts.select("id", "player_id", F.posexplode(tokens_of(F.col("text"))).alias("pos", "token"))
    return words.join(names, "token").where(F.col("player_id") != F.col("owner")).select("id", "owner", F.col("pos").cast("long").alias("pos"))


def roll_total_evidence(numbers: DataFrame, rolls: DataFrame, usual: float = 1.5) -> DataFrame:
    """(session_id, utt_id, n, roll_id, reason) of utterances, by the rolls whose total they say. (TXT-07)

    An utterance that is one number meets the rolls of that total whose time is
    within their own uncertainty (``uncertainty_s``, or the usual one) of its
    middle. One roll is a match and is named; several are ambiguous.
    """
    reach = F.coalesce("uncertainty_s", F.lit(usual))
    spans = rolls.select("session_id", "total", "roll_id", (F.col("t_s") - reach).alias("_from"), (F.col("t_s") + reach).alias("_to"))
    said = numbers.where("number IS NOT NULL").select("session_id", "utt_id", F.col("number").alias("total"), "mid_s")
    met = point_join(said, spans, ["session_id", "total"], "mid_s", ("_from", "_to"))
    n = met.groupBy("session_id", "utt_id").agg(F.count("*").alias("n"), F.min("roll_id").alias("_one"))
    out = numbers.join(n, ["session_id", "utt_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    reason = F.when(F.col("number").isNull(), "not_numeric_only").when(F.col("n") == 0, "no_aligned_roll").when(F.col("n") == 1, "matched_roll_total").otherwise("ambiguous_roll")
    return out.select("session_id", "utt_id", "n", F.when(F.col("n") == 1, F.col("_one")).alias("roll_id"), reason.alias("reason"))


def polarity_scores(texts: DataFrame, markers: DataFrame) -> DataFrame:
    """(id, in_score, out_score, share, density). (TXT-08)"""
    part = lambda p: F.coalesce(F.sum(F.when(F.col("polarity") == p, F.col("weight"))), F.lit(0.0))
    sums = markers.groupBy("id").agg(part("in").alias("_in"), part("out").alias("_out"), F.count("*").alias("_n"))
    held = texts.select("id", F.size(tokens_of(F.col("text"))).alias("_tokens")).join(sums, "id", "left").na.fill(0)
    total = F.greatest(F.lit(1.0), F.col("_in") + F.col("_out"))
    return held.select("id", F.round("_in", 6).alias("in_score"), F.round("_out", 6).alias("out_score"), F.round(F.col("_in") / total, 6).alias("share"), F.round(F.col("_n") / F.greatest(F.lit(1), F.col("_tokens")), 6).alias("density"))


def quoted_spans(words: Column) -> Column:
    """array<struct<first,last>> of quoted runs of words, straight or curly. (TXT-09)

    A state machine over the words: a word that begins with a quote opens, one
    that ends with a quote closes; an unclosed quote is none.
    """
    opens = lambda w: F.substring(w, 1, 1).isin('"', "“")
    closes = lambda w: F.regexp_replace(w, r"[.,!?;:]+$", "").rlike('.["”]$')
    start = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("open"), F.array().cast("array<struct<first:int,last:int>>").alias("spans"))

    def step(s, w):
        at = F.when(s.open >= 0, s.open).when(opens(w), s.i).otherwise(-1)
        shut = (at >= 0) & closes(w)
        return F.struct((s.i + 1).alias("i"), F.when(shut, F.lit(-1)).otherwise(at).alias("open"), F.when(shut, F.concat(s.spans, F.array(F.struct(at.alias("first"), s.i.alias("last"))))).otherwise(s.spans).alias("spans"))

    return F.aggregate(words, start, step, lambda s: s.spans)


def numbers_mentioned(text: Column) -> Column:
    """Distinct numbers among the tokens of a normalised text, in order. (TXT-10)"""
    return F.array_distinct(F.transform(F.filter(F.split(text, " "), lambda x: x.rlike(r"^\d{1,9}$")), lambda x: x.cast("bigint")))
