"""Column functions over text."""

from __future__ import annotations

import json
import unicodedata
from functools import cache

from pyspark.sql import Column, functions as F

# fixed values: weak spoken openers
FILLER_OPENERS = ["um", "uh", "okay", "ok", "so", "well", "like", "yeah", "also", "äh", "ehm", "ja", "naja"]

# fixed values: words that announce an answer
ANSWER_MARKERS = ["because", "so", "reason", "explain", "means", "actually", "turns out", "the truth", "answer",
                  "weil", "deshalb", "deswegen", "erklärung", "bedeutet", "eigentlich"]


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text) -> Column:
    return F.regexp_extract_all(F.lower(as_col(text)), F.lit("([a-zà-ÿ']+)"), 1)


def has_number(text) -> Column:
    return as_col(text).rlike("[0-9]")


def ends_sentence(text) -> Column:
    return F.trim(as_col(text)).rlike("[.!?]$")


def ends_complete(text) -> Column:
    return F.trim(as_col(text)).rlike('[.!?"]$')


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


@cache
def ascii_forms() -> tuple[str, str, dict[str, str]]:
    """What the ASCII part of each character's compatibility decomposition is: characters with one letter or mark, these
    letters and marks, and the characters that become several letters."""
    one, to, several = [], [], {}
    for c in map(chr, range(0x80, 0x20000)):
        base = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if sum(x.isalnum() for x in base) > 1 or (len(base) > 1 and any(x.isalnum() for x in base)):
            several[c] = base
        elif base:
            one.append(c)
            to.append(base if len(base) == 1 else " ")
    return "".join(one), "".join(to), several


def fold_text(text) -> Column:
    """Lower-case ASCII letters and digits, single-spaced: compatibility forms taken apart, other characters dropped."""
    one, to, several = ascii_forms()
    t = as_col(text)
    forms = F.from_json(F.lit(json.dumps(several)), "map<string,string>")  # one constant
    # each distinct character beyond ASCII is looked up once; what it becomes is ASCII
    others = F.array_distinct(F.regexp_extract_all(t, F.lit("([^\\x00-\\x7f])"), F.lit(1)))
    found = F.filter(others, lambda c: F.try_element_at(forms, c).isNotNull())
    t = F.aggregate(found, t, lambda a, c: F.replace(a, c, F.try_element_at(forms, c)))
    plain = F.lower(F.translate(t, one, to))
    ascii_only = F.regexp_replace(plain, "[^\\x00-\\x7f]", "")
    return F.trim(F.regexp_replace(ascii_only, "[^a-z0-9]+", " "))


def clean_caption_token(text) -> Column:
    """Without leading punctuation; null when no letter or digit is left."""
    t = F.trim(F.regexp_replace(F.trim(as_col(text)), "^[\\s,;:.\\-–—]+", ""))
    return F.when(t.rlike("[A-Za-z0-9]"), t)


def file_slug(text, limit: int = 60) -> Column:
    s = F.regexp_replace(F.regexp_replace(as_col(text), "[^\\p{L}\\p{N}_\\s-]", ""), "\\s+", "_")
    return F.substring(s, 1, limit)


def first_upper(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1_000_000))


def make_title(text) -> Column:
    """First sentence when 12 to 70 characters long, else everything; at most 11 words."""
    t = F.trim(as_col(text))
    first = F.element_at(F.split(t, "(?<=[.!?])\\s", 2), 1)
    pick = F.when(F.length(first).between(12, 70), first).otherwise(t)
    pick = F.regexp_replace(F.regexp_replace(pick, "\\s+", " "), "^[ ,.\\-]+|[ ,.\\-]+$", "")
    parts = F.split(pick, " ")
    cut = F.when(F.size(parts) > 11, F.concat(F.array_join(F.slice(parts, 1, 11), " "), F.lit("…"))).otherwise(pick)
    return F.when(cut == "", F.lit("Untitled clip")).otherwise(first_upper(cut))
