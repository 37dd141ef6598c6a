from pyspark.sql import functions as F

from echometer.operators.scoring import LexiconScorer, log_odds_lexicon
from echometer.plans import ingest
from echometer.schemas import STATUS


def status(i, text, count=1, at="2024-01-05 10:00:00"):
    user = ("u", count, count, count, count, "2015-01-01 00:00:00")
    return {"id": i, "created_at": at, "full_text": text, "lang": "es", "user": dict(zip(
        ("screen_name", "followers_count", "favourites_count", "friends_count", "statuses_count", "created_at"), user))}


def stored(spark, rows, **options):
    accounts = spark.createDataFrame([("t1", "abc_"), ("t2", "two")], "id string, account string")
    scorer = LexiconScorer(spark.createDataFrame([("hola", 1.0)], "word string, weight double"))
    df = spark.createDataFrame(rows, STATUS).repartition(3)
    got = ingest.ingest(df, accounts, scorer, **options).collect()
    return sorted((r["TWEET_ID"], r["TARGET"], r["TWEETS_COUNT"]) for r in got)


ROWS = [status(i, "@abc_ hola") for i in range(1, 6)]
COPIES = [status(5, "@abc_ hola", n) for n in (3, 9, 4)]
UNUSABLE = [status(None, "@abc_ a"), status(None, "@abc_ b"), status(7, "@abc_ hola", at="soon"), status(8, "@abc_", at=None)]


def test_newest_copy_stays_and_unusable_posts_go(spark):
    want = [(1, "t1", 1), (2, "t1", 1), (3, "t1", 1), (4, "t1", 1), (5, "t1", 9)]
    assert stored(spark, ROWS + COPIES + UNUSABLE) == want


def test_copies_take_one_of_the_latest_places(spark):
    assert stored(spark, ROWS + COPIES, most_recent=3) == [(3, "t1", 1), (4, "t1", 1), (5, "t1", 9)]


def test_repeated_words_add_up_in_both_forms(spark):
    lexicon = spark.createDataFrame([("hola", 1.0), ("hola", 2.0), (None, 9.0)], "word string, weight double")
    rows = spark.createDataFrame([("hola x",), ("x",)], "t string")
    for limit in (0, 10):
        got = LexiconScorer(lexicon, inline_words=limit).score(rows, "t", "s").select(F.round("s", 6)).collect()
        assert sorted(r[0] for r in got) == [0.5, 0.952574]


def test_learned_weights(spark):
    rows = spark.createDataFrame([("a a b", 1), ("b c", 0), ("zz", None)], "t string, y int")
    got = {r["word"]: round(r["weight"], 6) for r in log_odds_lexicon(rows, "t", "y").collect()}
    # ln of (3/6)/(1/5), (2/6)/(2/5), (1/6)/(2/5)
    assert got == {"a": 0.916291, "b": -0.182322, "c": -0.875469}
