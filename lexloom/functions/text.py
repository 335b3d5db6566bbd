"""Text column functions. Patterns are written so that Java, RE2 and Python read them alike (no bare \\w, \\d or \\s)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.lexicon import NUMBER_UNITS

#: Python's white space, as a class body
SPACE = r"\t-\r\x{1c}-\x{1f}\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"
URL = rf"(?i)(https?://[^{SPACE}]+|www\.[^{SPACE}]+|(pic\.)?twitter\.com/[^{SPACE}]+|t\.co/[^{SPACE}]+|bit\.ly/[^{SPACE}]+)"
NUMBER_UNIT = rf"(?i)^\p{{Nd}}+(\.\p{{Nd}}+)?({'|'.join(NUMBER_UNITS)})?$"
SANE = r"^[a-zA-Z\x{900}-\x{97F}]+$"
NO_LETTER = r"^[^\p{L}]+$"


def clean(text: Column) -> Column:
    """Handles and tags lose their sign, links go, white space collapses; null becomes empty."""
    out = F.coalesce(text, F.lit(""))
    out = F.regexp_replace(out, f"@([{WORD}]+)", "$1")
    out = F.regexp_replace(out, f"#([{WORD}]+)", "$1")
    out = F.regexp_replace(out, URL, "")
    return F.trim(F.regexp_replace(out, f"[{SPACE}]+", " "))


def clean_sql(text: str) -> str:
    """DuckDB form of clean()."""
    out = f"coalesce({text}, '')"
    for pattern, to in ((f"@([{WORD}]+)", r"\1"), (f"#([{WORD}]+)", r"\1"), (URL, ""), (f"[{SPACE}]+", " ")):
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"trim({out}, ' ')"


def tokens(text: Column) -> Column:
    """Lower-cased tokens between white space."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), f"[{SPACE}]+"), "")


def tokens_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[{SPACE}]+'), lambda x: x <> '')"


def first_token(text: Column) -> Column:
    return F.coalesce(F.get(F.array_remove(F.split(text, f"[{SPACE}]+"), ""), F.lit(0)), F.lit(""))


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.regexp_replace(text, f"[{SPACE}]+", "") == "")


def is_number_like(token: Column) -> Column:
    """All digits, or digits together with Latin letters."""
    return token.rlike(r"^\p{Nd}+$") | (token.rlike(r"\p{Nd}") & token.rlike("[a-zA-Z]"))


def non_linguistic_kind(token: Column) -> Column:
    """Why a token is not a word (null if it may be one): the reasons overlap, the first that holds is named."""
    return (
        F.when(F.coalesce(token, F.lit("")) == "", "empty")
        .when(token.rlike(rf"(?i)^(https?://|www\.)[^{SPACE}]+$"), "url")
        .when(token.rlike(f"^@[{WORD}]+$"), "mention")
        .when(token.rlike(f"^#[{WORD}]+$"), "hashtag")
        .when(token.rlike(NUMBER_UNIT), "number")
        .when(token.rlike(NO_LETTER), "marks")
        .when(~token.rlike(SANE), "charset")
    )


def non_linguistic(token: Column) -> Column:
    return non_linguistic_kind(token).isNotNull()


def fuzzy_limit(length: Column) -> Column:
    return F.when(length <= 9, 1).otherwise(2)


def strip_marks(token: Column) -> Column:
    """Drop everything but letters, digits, underscores and white space (combining signs go too)."""
    return F.regexp_replace(token, f"[^{WORD}{SPACE}]", "")


def flat(text: Column) -> Column:
    """Tabs and line breaks as spaces, for delimited files."""
    return F.translate(text, "\t\n", "  ")


def length_bucket(token: Column, top: int = 8) -> Column:
    return F.least(F.length(token), F.lit(top))


def lemma(word: Column) -> Column:
    """Dictionary form: lower case without underscores; null unless alphabetic."""
    out = F.replace(F.lower(word), F.lit("_"), F.lit(""))
    return F.when(out.rlike(r"^\p{L}+$"), out)


def parse_json(text: Column) -> Column:
    """A JSON value from the text itself, from a fenced block, or from its first `{` to its last `}`; else null."""
    t = F.trim(F.coalesce(text, F.lit("")))
    fenced = F.nullif(F.trim(F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)), F.lit(""))
    braced = F.nullif(F.regexp_extract(t, r"(?s)\{.*\}", 0), F.lit(""))
    return F.coalesce(F.try_parse_json(F.nullif(t, F.lit(""))), F.try_parse_json(fenced), F.try_parse_json(braced))


# Typographic signs and ligatures with their plain forms.
PLAIN = {"‘": "'", "’": "'", "“": '"', "”": '"', "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff"}


#: UTF-8 that was read as Latin-1 or Windows-1252: a lead and its followers, as the characters they turned into
_FOLLOWER = "[\x80-\xbf\u20ac\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\u017d\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\u017e\u0178]"
_MISREAD = re.compile(f"(?:[\xc2-\xdf]{_FOLLOWER}|[\xe0-\xef]{_FOLLOWER}{{2}}|[\xf0-\xf4]{_FOLLOWER}{{3}})+")
_TELLING = re.compile(f"[\xc2\xc3]{_FOLLOWER}|\xe2\u20ac{_FOLLOWER}|\xe0[\xa4\xa5]{_FOLLOWER}|\xf0\u0178{_FOLLOWER}{{2}}")


def _reread(found: re.Match) -> str:
    raw = bytearray()
    for c in found[0]:
        raw += c.encode("latin-1") if ord(c) < 256 else c.encode("cp1252")
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return found[0]


def repair_misread(text: str) -> str:
    """Undo UTF-8 read as Latin-1 or Windows-1252.

    Where every character beyond ASCII takes part in such a sequence the text is reread as a whole; otherwise only sequences
    that hardly occur in plain text are.
    """
    if text.isascii():
        return text
    if _MISREAD.sub("", text).isascii():
        return _MISREAD.sub(_reread, text)
    return _TELLING.sub(_reread, text)


def repair_unicode(text: Column, fixer=None) -> Column:
    """Unicode repair: misread UTF-8, plain quotes and ligatures, NFC; or `fixer` (text to text) in their place.

    Only texts with a character that the built-in repair could change travel to Arrow batches: up to U+00BF there is none, and
    quotes and ligatures are replaced in the JVM.
    """

    @F.pandas_udf("string")
    def repaired(s: pd.Series) -> pd.Series:
        return s.map(fixer or (lambda t: unicodedata.normalize("NFC", repair_misread(t))), na_action="ignore")

    if fixer:
        return repaired(text)
    out = F.coalesce(repaired(F.when(text.rlike(r"[^\x{00}-\x{BF}]"), text)), text)
    for sign, plain in PLAIN.items():
        out = F.replace(out, F.lit(sign), F.lit(plain))
    return out


# What stands for a missing key in settings that were never filled in, in lower case.
PLACEHOLDERS = ("changeme", "change_me", "none", "null", "placeholder", "test", "todo", "xxx")


def key_problem(key: Column, shortest: int = 10) -> Column:
    """Why a secret cannot be a real one (null if it can): missing, a placeholder, or too short."""
    k = F.trim(F.coalesce(key, F.lit("")))
    return F.when(k == "", "missing").when(F.lower(k).isin(*PLACEHOLDERS) | F.lower(k).startswith("your"), "placeholder").when(F.length(k) < shortest, "too short")


def noise(text: Column, level: int) -> Column:
    """Deterministic typing noise: 1 plain, 2 vowels dropped inside words, 3 acoustic drift and doubled endings."""
    low = F.lower(text)
    if level == 1:
        return low
    if level == 2:
        return F.regexp_replace(low, r"([^aeiou\P{L}])[aeiou]+", "$1")
    drift = F.translate(low, "vz", "wj")
    return F.regexp_replace(F.regexp_replace(drift, "ai", "e"), r"a( |$)", "aa$1")
