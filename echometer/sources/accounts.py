"""The tracked accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echometer.schemas import ACCOUNTS


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    """Accounts from one CSV file, with ``position`` increasing in file order."""
    accounts = (
        spark.read.schema(ACCOUNTS)
        .option("header", True)
        .csv(path)
        .withColumn("position", F.monotonically_increasing_id())
    )
    return check_accounts(accounts)


def check_accounts(accounts: DataFrame) -> DataFrame:
    """Fail on a missing or repeated ``id``: every post must find exactly one account."""
    faulty = (
        accounts.groupBy("id")
        .count()
        .where(F.col("id").isNull() | (F.col("count") > 1))
        .limit(5)
        .collect()
    )
    if faulty:
        raise ValueError(f"missing or repeated account ids: {[row['id'] for row in faulty]}")
    return accounts
