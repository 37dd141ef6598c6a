import datetime as dt

import pytest
from pyspark.sql import functions as F

from echometer.plans import dashboard

NOW = dt.datetime(2024, 1, 2, 12, 0, 0, 500_000)
SCHEMA = "TWEET_ID long, TARGET string, TWEET_TIMESTAMP timestamp_ntz, FULL_TEXT string, IS_RT int, SENTIMENT double"


def facts(spark):
    ago = lambda **k: NOW.replace(microsecond=0) - dt.timedelta(**k)
    rows = [
        (1, "a", ago(minutes=15), "edge", 0, 0.9),
        (2, "a", ago(minutes=15, microseconds=1), "just out", 0, 0.1),
        (3, "a", ago(seconds=1), "retweet", 1, 1.0),
        (4, "a", ago(seconds=1), "low", 0, 0.49),
        (5, "b", ago(seconds=-30), "future", 0, None),
        (6, "b", ago(minutes=59), "older", 0, 0.2),
        (7, "zz", ago(hours=5), "unknown target", 0, 0.2),
        (8, "a", None, "no time", 0, 0.9),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def accounts(spark):
    rows = [("b", "B", "b.jpg", "#1", None, 0), ("a", "A", "a.jpg", "#2", "p", 1), ("c", "C", "c.jpg", "#3", None, 2)]
    return spark.createDataFrame(rows, "id string, name string, image string, color string, party string, position long")


def metrics(spark, *args):
    return {r["target"]: (r["responses"], r["sentiment"]) for r in dashboard.account_metrics(facts(spark), *args, as_of=NOW).collect()}


def test_window_edges_and_null_scores(spark):
    assert metrics(spark, 15) == {"a": (3, pytest.approx(200 / 3)), "b": (1, 100.0)}
    assert metrics(spark, 15, True) == {"a": (2, 50.0), "b": (1, 100.0)}
    assert metrics(spark, 60)["b"] == (2, 50.0)
    assert metrics(spark, 1440)["zz"] == (1, 0.0)


def test_other_windows_mean_fifteen_minutes(spark):
    assert [dashboard.checked_minutes(m) for m in (15, 60, 1440, 30, 0, None)] == [15, 60, 1440, 15, 15, 15]
    assert metrics(spark, 61) == metrics(spark, 15)


def test_totals_weigh_targets_equally(spark):
    got = dashboard.headline(dashboard.account_metrics(facts(spark), 1440, as_of=NOW)).first()
    assert got["responses"] == 7
    assert got["sentiment"] == pytest.approx((50 + 50 + 0) / 3)
    assert (got["responses_text"], got["approval_text"]) == ("7", "33%")
    empty = dashboard.headline(dashboard.account_metrics(facts(spark), 15, as_of="2030-01-01 00:00:00")).first()
    assert (empty["responses"], empty["sentiment"], empty["approval_text"]) == (0, 0.0, "0%")


def test_cards_follow_account_order(spark):
    cards = dashboard.account_cards(accounts(spark), dashboard.account_metrics(facts(spark), 1440, as_of=NOW)).collect()
    assert [c["target"] for c in cards] == ["b", "a"]
    assert (cards[1]["responses_text"], cards[1]["approval_text"], cards[1]["approval_band"]) == ("4", "50%", "high")


def test_latest(spark):
    latest = dashboard.latest_posts(facts(spark), 60, as_of=NOW)
    assert [r["TWEET_ID"] for r in latest.collect()] == [5, 4, 3, 1, 2]
    shown = dashboard.latest_cards(latest, accounts(spark)).collect()
    assert [r["full_text"] for r in shown] == ["future", "low", "retweet", "edge", "just out"]
    assert (shown[1]["time"], shown[1]["image"], shown[1]["sentiment"]) == ("11:59:59 - Jan 2, 2024", "a.jpg", "NEGATIVE")
    assert [r["TWEET_ID"] for r in dashboard.latest_posts(facts(spark), 60, True, NOW).collect()] == [5, 4, 1, 2, 6]


def test_latest_needs_a_known_account(spark):
    latest = dashboard.latest_posts(facts(spark), 1440, as_of=NOW, most=10)
    with pytest.raises(Exception, match="no account with id zz"):
        dashboard.latest_cards(latest, accounts(spark)).collect()


def test_now_is_the_default(spark):
    rows = facts(spark).withColumn("TWEET_TIMESTAMP", F.current_timestamp() - F.make_dt_interval(mins=F.col("TWEET_ID").cast("int") * 10))
    assert {r["TWEET_ID"] for r in dashboard.recent(rows, 15).collect()} == {1}
    assert {1, 2, 3, 4, 5} <= {r["TWEET_ID"] for r in dashboard.recent(rows, 60).collect()} <= {1, 2, 3, 4, 5, 6}
