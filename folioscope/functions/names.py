"""Names in questions, language tags of collection names, honorific letters: per-text rules that need their neighbours."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DIGITS_FROM, DIGITS_TO, LETTERS_FROM, LETTERS_TO, MARKS, WHITE, fold, nfc, once

_FOLDED = str.maketrans(LETTERS_FROM + DIGITS_FROM, LETTERS_TO + DIGITS_TO)
_MARKS, _WHITE = re.compile(MARKS), re.compile(WHITE)

# Titles that may lead a name, language words, what honorific letters stand for.
TITLES = ("الشيخ", "السيد", "الإمام", "العلامة", "المحقق", "الميرزا", "الحاج", "الشهيد", "المولى", "آية الله", "الفقيه", "المرحوم", "الأستاذ", "الدكتور")
LANGUAGES = ("عربي", "عربى", "فارسي", "فارسى", "انگليزي", "انگليزى", "انگليسي", "انگليسى", "فرانسوي", "فرانسوى", "آلماني", "آلمانى")
HONORIFICS = {"N": "عليه السلام", "C": "صلى الله عليه وآله وسلم", "S": "عليهم السلام", "X": "عليها السلام", "J": "عليهما السلام", "R": "رحمه الله", "L": "عز وجل"}


def plain(text: str) -> str:
    """normalize() of functions.text, for one string."""
    t = _MARKS.sub("", unicodedata.normalize("NFC", text)).translate(_FOLDED).lower()
    return _WHITE.sub(" ", t).strip(" ")


_TITLES = sorted({plain(t) for t in TITLES})


def core_words(name: str) -> list[str]:
    """The words of a name without leading titles, one at least, without signs."""
    words = plain(name).split()
    while len(words) > 1 and words[0] in _TITLES:
        words = words[1:]
    return [w for w in (re.sub(r"\W", "", w) for w in words) if w]


def strip_names(text: Column, names: list[str]) -> Column:
    """text without whole-word runs equal to a name's core, and without the titles right before a run; white space as single spaces.

    All of it is array expressions: runs are found by comparing slices of the folded words, and each run is widened to the
    last word before it that is no title. Null stays null.
    """
    cores = [c for c in map(core_words, names) if c]
    words = F.filter(F.split(nfc(text), r"\s+"), lambda w: w != "")
    if not cores:
        return F.array_join(words, " ")
    titles = F.array(*[F.lit(t) for t in _TITLES])

    def runs(v: Column) -> Column:
        line = v["line"]
        places = F.sequence(F.lit(0), F.size(line) - 1)
        # the place after the last word before i that is no title
        back = lambda i: F.coalesce(F.array_max(F.filter(v["firm"], lambda x: x < i)) + 1, F.lit(0))

        def of(core: list[str]) -> Column:
            own = F.array(*[F.lit(w) for w in core])
            starts = F.filter(places, lambda i: F.slice(line, i + 1, len(core)) == own)
            return F.transform(starts, lambda i: F.struct(back(i).alias("lo"), (i + len(core)).alias("hi")))

        return F.concat(*map(of, cores))

    folded = lambda w: F.transform(w, lambda x: F.regexp_replace(fold(x), r"[^\p{L}\p{N}_]", ""))
    firm = lambda line: F.filter(F.transform(line, lambda x, i: F.when(~F.array_contains(titles, x), i)), lambda i: i.isNotNull())
    outside = lambda w, r: F.filter(w, lambda x, i: ~F.exists(r, lambda s: (i >= s["lo"]) & (i < s["hi"])))
    kept = once(words, lambda w: F.when(F.size(w) == 0, w).otherwise(once(once(folded(w), lambda line: F.struct(line.alias("line"), firm(line).alias("firm"))), lambda v: once(runs(v), lambda r: outside(w, r)))))
    return F.array_join(kept, " ")


def lang_strip(text: Column) -> tuple[Column, Column]:
    """(text without language tags at its ends, hint): ar or fa if all tags taken off agree, else null."""
    tag = "(?:" + "|".join(LANGUAGES) + ")"
    tail, head = rf"(?:\s*[،,]\s*{tag}\s*|\s*[-ـ]\s*{tag}\s*)+$", rf"^(?:\s*{tag}\s*[،,]\s*)+"
    last = F.regexp_extract(text, tail, 0)
    rest = F.regexp_replace(text, tail, "")
    ends = F.concat(last, F.regexp_extract(rest, head, 0))
    fa, ar = ends.contains("فارس"), ends.contains("عرب")
    return F.trim(F.regexp_replace(rest, head, "")), F.when(fa & ~ar, "fa").when(ar & ~fa, "ar")


def honorific_spell(text: Column) -> Column:
    """Lone honorific letters spelt out, in four passes of patterns.

    A lone L after white space is an ornament and goes. The others get a space before them where a sign that closes or a
    letter of another script stands there, and one after them before such a letter or a sign that opens. Then each is
    replaced by what it stands for, and texts that changed get single spaces.
    """
    letters, alone, free = "[" + "".join(HONORIFICS) + "]", "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"
    out = F.regexp_replace(text, f"(?U)(?<=\\s)L{free}", "")
    out = F.regexp_replace(out, f"(?U)(?<=[^\\s(«\\[﴿A-Za-z0-9])({letters}){free}", " $1")
    out = F.regexp_replace(out, f"{alone}({letters})(?=[[\\p{{L}}\\p{{N}}(«﴿]&&[^A-Za-z0-9]])", "$1 ")
    for letter, phrase in HONORIFICS.items():
        out = F.regexp_replace(out, f"{alone}{letter}{free}", phrase)
    return F.when(out != text, F.regexp_replace(out, " {2,}", " ")).otherwise(text)
