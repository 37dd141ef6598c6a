import datetime as dt

import pytest
from pyspark.sql import functions as F

from echometer.schemas import FACT, PARTITION_BATCH, PARTITION_DAY, STATUS
from echometer.sources import accounts, emoji, facts, posts

# Invented accounts: two handles with an underscore, one in mixed case.
CSV = """﻿id,account,name,image,color,party
zeta,zeta_z,Zeta Zúñiga,zeta.jpg,#111111,Red
alfa,Alfa_Mixed,Alfa,alfa.jpg,#222222,
mid,midway,"Mid, the third",mid.jpg,#333333,Blue"""


def test_accounts_in_file_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV, encoding="utf-8")
    rows = accounts.read_accounts(spark, str(tmp_path / "a.csv")).orderBy("position").collect()
    assert [r["id"] for r in rows] == ["zeta", "alfa", "mid"]
    assert (rows[0]["name"], rows[1]["party"], rows[2]["name"]) == ("Zeta Zúñiga", None, "Mid, the third")


@pytest.mark.parametrize("line", ["zeta,other,Z,z.jpg,#0,", ",nobody,N,n.jpg,#0,"])
def test_faulty_account_ids(spark, tmp_path, line):
    (tmp_path / "a.csv").write_text(CSV + "\n" + line, encoding="utf-8")
    with pytest.raises(ValueError):
        accounts.read_accounts(spark, str(tmp_path / "a.csv"))


def test_emoji_names(spark, tmp_path):
    (tmp_path / "codes.csv").write_text("emoji,name\n🥑,:old:\n🙄,:eyes:\n🥑,:avocado:\n🚀,:rocket:", encoding="utf-8")
    (tmp_path / "local.csv").write_text("emoji,name\n:avocado:,aguacate\n:eyes:,ojos", encoding="utf-8")
    codes = emoji.read_names(spark, str(tmp_path / "codes.csv"))
    assert emoji.as_mapping(codes) == {"🥑": ":avocado:", "🙄": ":eyes:", "🚀": ":rocket:"}
    local = emoji.read_names(spark, str(tmp_path / "local.csv"))
    assert emoji.as_mapping(emoji.translate_names(codes, local)) == {"🥑": "aguacate", "🙄": "ojos", "🚀": ":rocket:"}


def test_posts_from_files_and_messages(spark, tmp_path):
    line = '{"id": 1284798583040913410, "full_text": "hola", "lang": "es", "user": {"screen_name": "u", "followers_count": 3}, "extra": 1}'
    (tmp_path / "p.json").write_text(line + "\n")
    from_file = posts.read_posts(spark, str(tmp_path)).first()
    messages = spark.createDataFrame([(line.encode(),)], "value binary")
    from_message = posts.posts_from_text(messages).first()
    assert from_file == from_message
    assert from_file["id"] == 1284798583040913410 and from_file["retweeted_status"] is None
    assert posts.read_posts(spark, str(tmp_path)).schema == STATUS


def fact_rows(spark, days, start=0):
    data = [
        (start + i, "t", dt.datetime(2024, 1, 9), "f", "p", 1, 2, 3, 4, dt.datetime(2015, 1, 1), dt.datetime(2024, 1, d, 23, 59, 59), 0, None)
        for i, d in enumerate(days)
    ]
    return spark.createDataFrame(data, FACT)


@pytest.fixture
def table(spark, tmp_path):
    spark.sql(f"CREATE DATABASE store LOCATION '{tmp_path}/store'")
    facts.create_table(spark, "store.tweets")
    yield "store.tweets"
    spark.sql("DROP DATABASE store CASCADE")


def test_append_batches_and_reset(spark, table):
    facts.append(fact_rows(spark, [1, 2]), table)
    facts.append(fact_rows(spark, [1, 2]), table)
    facts.write_batch(fact_rows(spark, [2, 3], 10), table, "run-0")
    facts.write_batch(fact_rows(spark, [2, 3], 10), table, "run-0")
    stored = facts.read_facts(spark, table)
    assert stored.columns == [*FACT.fieldNames(), PARTITION_DAY]
    assert stored.count() == 6
    assert {r[0] for r in stored.where("TWEET_ID = 11").select(PARTITION_DAY).collect()} == {dt.date(2024, 1, 3)}
    facts.create_table(spark, table)
    assert facts.read_facts(spark, table).count() == 0


def test_retention(spark, table, tmp_path):
    facts.append(fact_rows(spark, range(1, 10)), table)
    facts.write_batch(fact_rows(spark, [4, 5, 9], 100), table, "run-1")
    as_of = "2024-01-07 00:00:01"
    kept = facts.kept_rows(facts.read_facts(spark, table), as_of)
    assert kept.count() == 7
    assert facts.drop_expired(spark, table, as_of) == 5
    assert facts.read_facts(spark, table).exceptAll(kept).count() == 0
    assert facts.read_facts(spark, table).count() == 7
    # The files are gone as well.
    assert spark.read.parquet(f"{tmp_path}/store/tweets").count() == 7
    assert facts.drop_expired(spark, table, as_of) == 0
    assert PARTITION_BATCH in spark.table(table).columns


def test_retention_equals_row_rule(spark):
    rows = fact_rows(spark, range(1, 10))
    as_of = dt.datetime(2024, 1, 8, 12)
    by_row = rows.where(F.to_date("TWEET_TIMESTAMP") >= F.date_sub(F.lit(dt.date(2024, 1, 8)), 2))
    assert facts.kept_rows(rows, as_of).exceptAll(by_row).count() == 0
    assert facts.kept_rows(rows, as_of).count() == by_row.count() == 4


def test_export_as_text(spark):
    row = facts.as_export(fact_rows(spark, [1])).first()
    assert (row["TWEET_TIMESTAMP"], row["ACCOUNT_CREATION_DATE"]) == ("2024-01-01 23:59:59", "2015-01-01 00:00:00")
