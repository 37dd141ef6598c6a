"""Values as the dashboard shows them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label limit, band limits and colours.
LABEL_LIMIT = 0.5
BANDS = ((20, "very_low", "hsl(360, 67%, 44%)"), (50, "low", "hsl(360, 71%, 66%)"), (80, "high", "hsl(185, 57%, 50%)"))
TOP_BAND = ("very_high", "hsl(184, 77%, 34%)")
LABEL_COLORS = {"NEGATIVE": "hsl(360, 67%, 44%)", "POSITIVE": "hsl(184, 77%, 34%)"}
MAGNITUDES = ("", "K", "M", "B", "T")


def sentiment_label(score: Column) -> Column:
    """NEGATIVE below one half, else POSITIVE; a missing score counts as positive."""
    return F.when(score < LABEL_LIMIT, "NEGATIVE").otherwise("POSITIVE")


def label_color(score: Column) -> Column:
    return F.when(score < LABEL_LIMIT, LABEL_COLORS["NEGATIVE"]).otherwise(LABEL_COLORS["POSITIVE"])


def positive_share(score: Column) -> Column:
    """Aggregate: percentage of rows not below one half; a missing score counts as positive."""
    return F.avg(F.when(score < LABEL_LIMIT, 0).otherwise(1)) * 100


def _banded(score: Column, place: int) -> Column:
    (limit, *values), *others = BANDS
    chosen = F.when(score < limit, values[place])
    for limit, *values in others:
        chosen = chosen.when(score < limit, values[place])
    return chosen.otherwise(TOP_BAND[place])


def score_band(score: Column) -> Column:
    return _banded(score, 0)


def score_color(score: Column) -> Column:
    return _banded(score, 1)


def percent_text(score: Column) -> Column:
    """Whole percent, half to even."""
    return F.when(F.isnan(score), "nan%").otherwise(
        F.concat(F.bround(score, 0).cast("bigint").cast("string"), F.lit("%"))
    )


def compact_number(count: Column) -> Column:
    """A whole number in two significant digits (half to even) with K, M, B or T.

    There is no suffix beyond T, so that 1e15 shows as 1000T.
    """
    size = F.abs(count.cast("double"))
    digits = F.floor(F.log10(F.greatest(size, F.lit(1.0)))) + 1
    step = F.pow(F.lit(10.0), F.greatest(digits - 2, F.lit(0)))
    rounded = F.bround(count / step, 0) * step
    most = len(MAGNITUDES) - 1
    power = F.least(F.floor(F.log10(F.greatest(F.abs(rounded), F.lit(1.0))) / 3).cast("int"), F.lit(most))
    shown = F.format_string("%.1f", rounded / F.pow(F.lit(1000.0), power))
    suffix = F.element_at(F.array(*(F.lit(m) for m in MAGNITUDES)), power + 1)
    return F.when(count.isNotNull(), F.concat(F.regexp_replace(shown, r"\.0$", ""), suffix))


def display_time(moment: Column) -> Column:
    """For example ``09:08:07 - Jul 5, 2020``."""
    return F.date_format(moment, "HH:mm:ss - MMM d, yyyy")


def export_time(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")
