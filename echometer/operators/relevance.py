"""Dropping posts that are hardly about the account they mention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echometer.functions.text import count_at_signs

# Fixed value: more handles than this make a post irrelevant.
MOST_HANDLES = 2


def _opens_with(text: Column, account: Column, mark: str = "@") -> Column:
    """Plain prefix test: case counts, and a longer handle with the same start matches too."""
    return F.startswith(text, F.concat(F.lit(mark), account))


def repeats_account(text: Column, account: Column) -> Column:
    """Whether the text is a retweet of the account."""
    return _opens_with(text, account, "RT @")


def talks_to_other(text: Column, reply: Column, account: Column) -> Column:
    """Opens with a handle that is not the account's and is no reply to the account."""
    return (
        F.startswith(text, F.lit("@"))
        & ~_opens_with(text, account)
        & ~reply.eqNullSafe(account)
    )


def names_too_many(text: Column, reply: Column, account: Column) -> Column:
    """More than two ``@``, unless retweet of, opening with or reply to the account."""
    return (
        ~repeats_account(text, account)
        & ~_opens_with(text, account)
        & ~reply.eqNullSafe(account)
        & (count_at_signs(text) > MOST_HANDLES)
    )


def keep_relevant(
    rows: DataFrame, text: str = "FULL_TEXT", reply: str = "REPLY_TO", account: str = "ACCOUNT"
) -> DataFrame:
    columns = F.col(text), F.col(reply), F.col(account)
    return rows.where(~talks_to_other(*columns) & ~names_too_many(*columns))
