"""Column functions on text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def ascii_edges(pattern: str) -> str:
    """``pattern`` with every word boundary among ASCII letters, digits and underscores only, as in most engines.

    Java versions differ in whether an accented letter is part of a word.
    """
    return pattern.replace(r"\b", _EDGE)


# Accented letters and what they fold to.
MARKED, BARE = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
#: Characters that neither form of compatibility changes but for the accents above: ASCII, Latin-1 letters, quotes and dashes, basic Greek, Cyrillic, kana and Han.
_SETTLED = r"\x00-\x7F\xA1\xAB\xBB\xBF\xC0-\xFF\u03B1-\u03C9\u0391-\u03A9\u0410-\u0418\u041A-\u0438\u043A-\u044F\u2013\u2014\u2018-\u201E\u3041-\u304A\u30A1-\u30AA\u4E00-\u9FFF"


def _normal_form(text: Column, form: str) -> Column:
    """NFKD or NFKC of a text. Only texts with a character that could change go to Python, in batches; the others stay where they are."""

    def run(texts: pd.Series) -> pd.Series:
        import unicodedata

        return texts.map(lambda t: unicodedata.normalize(form, t) if t is not None else None)

    odd = F.pandas_udf(run, "string")(F.when(text.rlike(f"[^{_SETTLED}]"), text))
    return F.coalesce(odd, text)


def normalised_name(name: Column) -> Column:
    """NFKD without marks, without a trailing #1234, lower case, all but letters and digits as single spaces."""
    bare = F.regexp_replace(F.translate(_normal_form(name, "NFKD"), MARKED, BARE), r"\p{M}+", "")
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(bare, r"#\d{2,6}$", "")), r"[^\p{L}\p{N}]+", " "))


def comparison_text(text: Column) -> Column:
    """NFKC, lower case; runs of punctuation and symbols as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_normal_form(text, "NFKC")), r"[\p{P}\p{S}]+", " "), r"\s+", " "))


def text_similarity(a: Column, b: Column) -> Column:
    """The larger of token-set Jaccard and 1 - edit distance / longer length; 0 if either is empty."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    jaccard = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    edit = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    # equal texts need no edit distance, which costs the product of the lengths
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(F.greatest(jaccard, edit))


def name_similarity(a: Column, b: Column) -> Column:
    """Similarity of two columns of normalised names: the best of edit distance, token overlap and prefixes; 1 only when equal."""
    ta, tb = F.split(a, " "), F.split(b, " ")
    edit = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    tokens = F.size(F.array_intersect(ta, tb)) / F.greatest(F.size(F.array_distinct(ta)), F.size(F.array_distinct(tb)))
    prefix = lambda x, y: F.when((F.least(F.length(x), F.length(y)) >= 3) & (F.startswith(x, y) | F.startswith(y, x)), F.least(F.lit(0.95), 0.6 + 0.4 * F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y)))).otherwise(F.lit(0.0))
    each = F.array_max(F.flatten(F.transform(ta, lambda x: F.transform(tb, lambda y: prefix(x, y)))))
    best = F.greatest(edit, tokens, prefix(a, b), each)
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(F.least(best, F.lit(0.99)))
