"""Text functions as column expressions: normalization for Arabic-script and Latin text, words, keys, small parsers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The marks and invisible characters that go, the letters and digits that fold, the white space class.
MARKS = "[ً-ٰٟۖ-ۭـ​-‏‪-‮⁦-⁩﻿]"
LETTERS_FROM = "أإآٱىةکیھۀگپچژ"
LETTERS_TO = "اااايهكيههكبجز"
DIGITS_FROM = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
DIGITS_TO = "01234567890123456789"
WHITE = "[\\t\\n\\x0b\\f\\r \u0085   -     　]+"
EMBEDDING_MARKS = "[ؐ-ًؚ-ٰٟۖ-ۭـ]"
WORD = r"[\p{L}\p{N}]+"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition, which has no built-in; texts that are composed already pass as they are."""
    return text.map(lambda t: t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))


def _plain(text: Column) -> Column:
    """Whether a text has Latin letters and signs alone (below U+0300), among which nothing is composed, dropped or folded."""
    return ~text.rlike("[^\\x{0}-\\x{2ff}]")


def fold(text: Column) -> Column:
    """normalize() for text that is composed already: all JVM-side."""
    t = F.translate(F.regexp_replace(text, MARKS, ""), LETTERS_FROM + DIGITS_FROM, LETTERS_TO + DIGITS_TO)
    return F.trim(F.regexp_replace(F.lower(F.when(_plain(text), text).otherwise(t)), WHITE, " "))


#: Characters that composing may change: marks, jamo, and letters that are written by others.
COMPOSING = "[\\p{M}\u0340-\u0345\u0374\u037e\u0387\u1100-\u11ff\u1f71-\u1ffd\u2000\u2001\u2126\u212a\u212b\u2329\u232a\uf900-\ufaff\ufb1d-\ufb4e]"


def composed(text: Column) -> Column:
    """A text in composed form. Only texts that composing may change are sent to Python; null stays null."""
    return F.coalesce(nfc(F.when(~_plain(text) & text.rlike(COMPOSING), text)), text)


def normalize(text: Column) -> Column:
    """Compose, drop marks, fold letters and digits, lower case, one space for white space. Null stays null."""
    return fold(composed(text))


def once(value: Column, body) -> Column:
    """body(value) with value computed once for each row; a column used within a lambda may be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(WORD), F.lit(0))


def token_line(norm: Column) -> Column:
    """' w1 w2 ': a phrase match is then a literal containment."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(norm, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def index_line(text: Column) -> Column:
    """The token line of a text's folded words; white space need not be put in order for it."""
    c = composed(text)
    t = F.translate(F.regexp_replace(c, MARKS, ""), LETTERS_FROM + DIGITS_FROM, LETTERS_TO + DIGITS_TO)
    return token_line(F.lower(F.when(_plain(c), c).otherwise(t)))


def clean_marks(text: Column) -> Column:
    """Marks and lengthening strokes go, white space becomes single spaces; letters stay as they are."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, EMBEDDING_MARKS, ""), r"\s+", " "))


def first_int(text: Column) -> Column:
    return F.regexp_extract(F.translate(text, DIGITS_FROM, DIGITS_TO), "[0-9]+", 0).try_cast("int")


def order_key(label: Column, year: Column) -> Column:
    """Sort key of a death year: centuries at their middle, years as they are, the rest last."""
    digits = F.translate(label, DIGITS_FROM, DIGITS_TO)
    century = F.regexp_extract(F.regexp_extract(digits, r"(?:^ق|قرن)\s*[0-9]+", 0), "[0-9]+", 0).try_cast("int")
    return F.when(century.isNotNull(), century * 100 - 50).when(year.between(1, 1500), year).otherwise(99999)


def printed_number(label: Column) -> Column:
    d = F.translate(label, DIGITS_FROM, DIGITS_TO)
    return F.coalesce(F.regexp_extract(d, r"^\s*([0-9]+)", 1).try_cast("int"), F.regexp_extract(d, r"([0-9]+)\s*$", 1).try_cast("int"))


def title_of(text: Column, limit: int = 60) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…"))).otherwise(t)


def email_norm(text: Column) -> Column:
    return F.lower(F.trim(text))


def email_valid(text: Column) -> Column:
    """One @, a dotted domain, no white space, 254 characters at most."""
    e = email_norm(text)
    return F.coalesce(e.rlike(r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$") & (F.length(e) <= 254), F.lit(False))


def signature(norm: Column, limit: int = 200) -> Column:
    return F.substring(F.regexp_replace(norm, r"[^\p{L}\p{N}_]", ""), 1, limit)


def contains_words(line: Column, query: list[str]) -> Column:
    """Every word of query is in a padded token line."""
    out = F.lit(True)
    for w in query:
        out = out & line.contains(f" {w} ")
    return out


def phrase(line: Column, query: list[str]) -> Column:
    return line.contains(f" {' '.join(query)} ")


def prefix_all(words: Column, terms: list[str]) -> Column:
    """Each term begins some word."""

    def begun(t: str) -> Column:
        return F.exists(words, lambda w: F.startswith(w, F.lit(t)))

    out = F.lit(True)
    for t in terms:
        out = out & begun(t)
    return out


def name_core(norm: Column, titles: list[str]) -> Column:
    """A name without leading titles, while more than one word remains."""
    listed = F.array(*[F.lit(t) for t in titles])
    ws = F.split(norm, " ")
    # the first word that is no title, or the last word
    first = F.array_min(F.filter(F.transform(ws, lambda w, i: F.when(~F.array_contains(listed, w), i)), lambda i: i.isNotNull()))
    start = F.least(F.coalesce(first, F.size(ws) - 1), F.size(ws) - 1)
    return F.array_join(F.slice(ws, start + 1, F.size(ws)), " ")
