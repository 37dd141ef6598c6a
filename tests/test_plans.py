import pytest
from pyspark.sql import functions as F

from echometer.checks import queries, views
from echometer.operators import scoring, targets
from echometer.plans import dashboard
from echometer.sources import facts

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def table(spark):
    name = queries._fresh_table(spark)
    facts.append(queries._ingested(spark, SF), name)
    return facts.read_facts(spark, name)


def test_metrics_prune_and_combine(table):
    text = plan(dashboard.account_metrics(table, 60, True, "2024-01-30 10:00:00"))
    assert "event_date" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(TWEET_TIMESTAMP" in text
    assert "partial_count" in text and text.count("Exchange") == 1
    schema = text.split("ReadSchema: ")[1]
    assert "FULL_TEXT" not in schema and "SENTIMENT" in schema


def test_default_now_prunes_too(table):
    text = plan(dashboard.account_metrics(table, 15))
    assert "event_date" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(TWEET_TIMESTAMP" in text


def test_latest_is_a_top_k(table):
    assert "TakeOrderedAndProject" in plan(dashboard.latest_posts(table, 60, as_of="2024-01-30 10:00:00"))


def test_latest_k_limits_before_its_shuffles(spark):
    text = plan(targets.latest_k(views.interactions(spark, SF), 10))
    assert text.count("WindowGroupLimit") == 4


def test_ingest_path_does_not_shuffle(spark):
    text = plan(queries.interaction_frame(spark, SF))
    assert "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text
    assert "BroadcastHashJoin" in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_inline_scoring_is_one_pass(spark):
    rows = queries._unscored(spark, SF)
    text = plan(scoring.score_with_rule(rows, queries._scorer(spark)))
    assert text.count("ArrowEvalPython") == 1 and "Exchange hashpartitioning" not in text


def test_newest_copies_reads_its_source_once(spark):
    from echometer.plans.ingest import newest_copies

    rows = [
        (1, "a", 5, 1, 1, 1, "x", 0),
        (1, "a", 5, 1, 1, 1, "x", 1),  # differs only in IS_RT: the larger wins, whatever the order
        (1, "a", 4, 9, 9, 9, "y", 0),
        (2, "a", None, 1, 1, 1, "z", 0),
        (2, "a", 0, 1, 1, 1, "w", 0),
    ]
    schema = "TWEET_ID long, TARGET string, TWEETS_COUNT long, FAVOURITES_COUNT long, FOLLOWERS_COUNT long, FRIENDS_COUNT long, FULL_TEXT string, IS_RT int"
    directed = spark.createDataFrame(rows, schema).withColumn("TWEET_TIMESTAMP", F.lit(None).cast("timestamp"))
    for source in (directed, directed.orderBy(F.desc("IS_RT"))):
        got = sorted(tuple(r) for r in newest_copies(source).collect())
        assert [g[:8] for g in got] == [(1, "a", 5, 1, 1, 1, "x", 1), (2, "a", 0, 1, 1, 1, "w", 0)]
    assert newest_copies(directed).columns == directed.columns


def test_newest_copies_plan_has_one_scan(spark, tmp_path):
    from echometer.plans.ingest import newest_copies

    path = str(tmp_path / "directed")
    spark.range(100).selectExpr(
        "id % 10 AS TWEET_ID", "'t' AS TARGET", "id AS TWEETS_COUNT", "0L AS FAVOURITES_COUNT", "0L AS FOLLOWERS_COUNT",
        "0L AS FRIENDS_COUNT", "CAST(NULL AS timestamp) AS TWEET_TIMESTAMP", "'x' AS FULL_TEXT", "0 AS IS_RT",
    ).write.parquet(path)
    plan = newest_copies(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert plan.count("Exchange") == 1
