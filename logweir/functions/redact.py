"""Addresses replaced in texts, at any depth of a table.

An IPv4 address is four numbers up to 255, of at most three digits each, with dots between and neither
letter, digit nor underscore beside them. An IPv6 address stands between blanks: eight groups of one to
four hexadecimal digits, or fewer with one `::` for those left out; one of a link may have a zone. So an
IPv6 address in brackets, after a sign or before a comma stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..paths import rebuild, strings

MARK = "REDACTED"
#: One to three digits that are no more than 255, and four of them in a row.
NUMBER = "(?!25[6-9]|(?:2[6-9]|[3-9][0-9])[0-9])[0-9]{1,3}"
FOUR = rf"(?=[0-9])(?<![0-9A-Za-z_])(?:{NUMBER}\.){{3}}{NUMBER}(?![0-9A-Za-z_])"
#: What a word that can be an IPv6 address begins with.
SIX = r"(?<!\S)[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:"


def _pieces(text: Column, inside: str, change) -> Column:
    """The text with change() of each of its longest stretches of characters of a class."""
    cut = F.split(text, f"(?<={inside})(?!{inside})|(?<!{inside})(?={inside})")
    return F.array_join(F.transform(cut, change), "")


def _groups(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))


def _is_six(word: Column) -> Column:
    own = F.substring_index(word, "%", 1)
    zone = ~F.contains(word, F.lit("%")) | F.startswith(F.lower(word), F.lit("fe80:")) & F.rlike(word, F.lit("%[0-9A-Za-z]+$"))
    halves = F.split(own, "::")
    groups = F.flatten(F.transform(halves, _groups))
    hexadecimal = F.forall(groups, lambda g: F.rlike(g, F.lit("^[0-9A-Fa-f]{1,4}$")))
    return zone & hexadecimal & ((F.size(halves) == 1) & (F.size(groups) == 8) | (F.size(halves) == 2) & (F.size(groups) <= 7))


def _six(word: Column) -> Column:
    return F.when(F.rlike(word, F.lit(SIX)), F.when(_is_six(word), F.lit(MARK)).otherwise(word)).otherwise(word)


def redact_text(column: Column) -> Column:
    """A text without its IPv4 and IPv6 addresses; texts that can hold none are left as they are."""
    four = F.regexp_replace(column, FOUR, MARK)
    words = F.regexp_extract_all(four, F.lit(rf"{SIX}\S*"), F.lit(0))
    some = F.rlike(four, F.lit(":[0-9A-Fa-f]{0,4}:")) & F.exists(words, _is_six)
    return F.when(some, _pieces(four, r"\S", _six)).otherwise(four)


def redact_ip(df: DataFrame) -> DataFrame:
    """Every text of every column at every depth; keys are left alone."""
    return rebuild(df, strings(redact_text))
