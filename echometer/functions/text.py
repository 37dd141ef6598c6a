"""Text normalisation and handle functions, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from echometer.functions.emoji import name_emoji

# The characters of the URL rule (the range `$` to `_` spans digits, capitals and
# most ASCII punctuation) and the punctuation that becomes a space.
URL = r"https?://[!$-_a-z]+"
LEADING_MARK = r"^RT"
HANDLE_AFTER_AT = r"@[\p{L}\p{N}_]+"
PUNCTUATION = r".,/#@!¡?¿$%\^&*;:{}=\-_`~()”“\""

# Every white-space character of Unicode plus the four ASCII separators. The part beyond Latin-1
# sits inside one range so that a letter is rejected after two tests.
_SPACE_LATIN = r" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"
_SPACE_HIGH = r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = f"{_SPACE_LATIN}[\\u1680-\\u3000&&[{_SPACE_HIGH}]]"
# The same with the punctuation; its two quotes beyond Latin-1 join that range.
_GAP = f"{_SPACE_LATIN}{PUNCTUATION.replace('”“', '')}[\\u1680-\\u3000&&[{_SPACE_HIGH}”“]]"

# A handle's `@` follows no word character; the `@` is tested first because it is rare.
MENTION = r"@(?<![A-Za-z0-9_]@)([A-Za-z0-9_]+)"


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, "")


def drop_leading_mark(text: Column) -> Column:
    """Drop a leading ``RT``, with or without a word boundary after it."""
    return F.regexp_replace(text, LEADING_MARK, "")


def strip_handles(text: Column) -> Column:
    """Remove the word after each ``@`` and keep the ``@``."""
    return F.regexp_replace(text, HANDLE_AFTER_AT, "@")


def blank_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, f"[{PUNCTUATION}]", " ")


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, f"[{_SPACE}]+", " ")


def squeeze(text: Column) -> Column:
    """White-space split and re-join: single spaces, none at the ends."""
    return F.trim(collapse_spaces(text))


def normalize(text: Column, emoji: dict[str, str] | None = None) -> Column:
    """The whole normalisation; null stays null.

    Equal to the single steps in their order (URLs, emoji, leading mark, handles, punctuation,
    spaces, lower case, ends) in three regex passes: a handle and its ``@`` both end up as a
    space, and so do punctuation and white space. Texts without URL skip its pass. Each
    intermediate text stands once in the expression, so that a plan never repeats it.
    """
    text = F.when(F.contains(text, F.lit("://")), strip_urls(text)).otherwise(text)
    if emoji:
        text = name_emoji(text, emoji)
    text = F.regexp_replace(text, f"{LEADING_MARK}|{HANDLE_AFTER_AT}", " ")
    return F.trim(F.lower(F.regexp_replace(text, f"[{_GAP}]+", " ")))


def mentions(text: Column) -> Column:
    """Distinct mentioned handles in lower case; null text gives an empty array."""
    found = F.regexp_extract_all(F.lower(text), F.lit(MENTION), F.lit(1))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def count_at_signs(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("@"), F.lit("")))


def cap_tokens(text: Column, most: int = 256) -> Column:
    """First ``most`` space-separated tokens: the input length of a fixed-width model."""
    return F.array_join(F.slice(F.split(squeeze(text), " "), 1, most), " ")
