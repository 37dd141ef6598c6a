import datetime
import functools
import json
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from echometer.checks import queries
from echometer.operators.scoring import LexiconScorer, ModelScorer
from echometer.plans.ingest import ingest
from echometer.schemas import FACT
from echometer.sources import facts
from echometer.sources.posts import read_posts, stream_posts
from echometer.streaming import ingest as streaming
from echometer.streaming.rolling import current_windows, rolling_metrics, start_current, start_rolling

ACCOUNTS = [("t1", "abc_"), ("t2", "MixedCase")]


def accounts(spark):
    return spark.createDataFrame(ACCOUNTS, "id string, account string")


def lexicon(spark):
    return LexiconScorer(spark.createDataFrame([("hola", 1.0), ("mal", -1.0)], "word string, weight double"))


def post(i, text, at="2024-01-05 10:00:00", lang="es"):
    user = {"screen_name": "u", "followers_count": 1, "favourites_count": 2, "friends_count": 3, "statuses_count": 4, "created_at": "2015-01-01 00:00:00"}
    return {"id": i, "created_at": at, "full_text": text, "lang": lang, "user": user}


def land(folder, rows):
    folder.mkdir(exist_ok=True)
    name = uuid.uuid4().hex
    (folder / f".{name}").write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")
    (folder / f".{name}").rename(folder / f"{name}.json")


@pytest.fixture
def place(spark, tmp_path):
    name = f"s{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/db'")
    facts.create_table(spark, f"{name}.tweets")
    yield tmp_path, f"{name}.tweets"
    spark.sql(f"DROP DATABASE {name} CASCADE")


def run(spark, place, scorer=None, **options):
    folder, table = place
    query = streaming.start_ingest(
        stream_posts(spark, str(folder / "in")), accounts(spark), scorer or lexicon(spark), table, str(folder / "progress"), language="es", **options
    )
    query.awaitTermination()
    return query


def stored(spark, place):
    return sorted((r["TWEET_ID"], r["TARGET"]) for r in facts.read_facts(spark, place[1]).collect())


def test_stream_equals_batch_and_drops_repeats(spark, place):
    first = [post(i, f"@abc_ hola {i % 7}") for i in range(40)] + [post(5, "@abc_ hola 5")] * 30
    land(place[0] / "in", first)
    land(place[0] / "in", first[:10] + [post(50, "@x @abc_ no"), post(51, "@mixedcase mal", lang="en"), post(52, "y @MIXEDCASE mal")])
    query = run(spark, place)
    batch = ingest(read_posts(spark, str(place[0] / "in")), accounts(spark), lexicon(spark), language="es").drop("INSERT_TIMESTAMP")
    rows = facts.read_facts(spark, place[1]).select(*batch.columns)
    assert rows.count() == batch.count() == 41
    assert rows.exceptAll(batch).count() == 0
    counters = query.recentProgress[0]["observedMetrics"]
    assert counters["received"]["rows"] == 83 and counters["kept"]["rows"] == 41

    # The number of files follows the volume, not the number of state partitions.
    assert len([*place[0].glob("db/tweets/event_date=*/*/*.parquet")]) <= 2

    # A restart goes on after what was read, and knows the posts of the earlier run.
    land(place[0] / "in", [post(5, "@abc_ hola 5"), post(60, "@abc_ hola")])
    run(spark, place)
    assert stored(spark, place) == sorted([(i, "t1") for i in range(40)] + [(52, "t2"), (60, "t1")])


def test_repeated_micro_batch_replaces_its_rows(spark, place):
    land(place[0] / "in", [post(i, "@abc_ hola") for i in range(5)])
    run(spark, place)
    # What a driver lost between writing and committing leaves behind: the batch runs again.
    (place[0] / "progress" / "commits" / "0").unlink()
    for extra in place[0].glob("progress/*/*1*"):
        if extra.is_file() and extra.name.lstrip(".").split(".")[0] == "1" and extra.parent.name in ("offsets", "commits"):
            extra.unlink()
    for checksum in place[0].glob("progress/commits/.0.crc"):
        checksum.unlink()
    run(spark, place)
    assert stored(spark, place) == [(i, "t1") for i in range(5)]


def partitions(spark, table):
    return [row[0] for row in spark.sql(f"SHOW PARTITIONS {table}").collect()]


def batch_of(spark, ids, day="2024-01-05"):
    rows = [(i, "t1", day) for i in ids]
    df = spark.createDataFrame(rows, "TWEET_ID long, TARGET string, day string")
    names = [f.name for f in FACT.fields if f.name not in ("TWEET_ID", "TARGET")]
    values = {"TWEET_TIMESTAMP": F.to_timestamp("day"), "INSERT_TIMESTAMP": F.to_timestamp("day"), "ACCOUNT_CREATION_DATE": F.to_timestamp("day")}
    return df.select("TWEET_ID", "TARGET", *(values.get(n, F.lit(1)).cast(FACT[n].dataType).alias(n) for n in names))


def test_compaction_bounds_partitions_and_survives_a_replay(spark, place):
    table = place[1]
    for n in range(50):
        facts.write_batch(batch_of(spark, [2 * n, 2 * n + 1], f"2024-01-0{5 + n % 2}"), table, f"run-{n}")
        if n % 20 == 19:
            facts.compact(spark, table)
    facts.compact(spark, table)
    want = [(i, "t1") for i in range(100)]
    assert stored(spark, place) == want
    assert sorted(partitions(spark, table)) == [
        "event_date=2024-01-05/ingest_batch=run-to-48", "event_date=2024-01-06/ingest_batch=run-49", "event_date=2024-01-06/ingest_batch=run-to-47",
    ]
    assert len([*place[0].glob("db/tweets/event_date=*/*/*.parquet")]) == 3
    facts.write_batch(batch_of(spark, [98, 99], "2024-01-06"), table, "run-49")
    assert stored(spark, place) == want and facts.compact(spark, table) == 0
    assert facts.drop_expired(spark, table, "2024-01-08 00:00:00") == 1


@pytest.mark.parametrize("dropped", [0, 1, 3])
def test_broken_compaction_is_finished(spark, place, dropped):
    table = place[1]
    for n in range(4):
        facts.write_batch(batch_of(spark, [n]), table, f"run-{n}")
    # What a driver lost after writing the merged rows, or while dropping the old ones, leaves behind.
    facts.write_batch(batch_of(spark, [0, 1, 2]), table, "pending-run-to-2")
    for n in range(dropped):
        spark.sql(f"ALTER TABLE {table} DROP PARTITION (event_date='2024-01-05', ingest_batch='run-{n}')")
    facts.compact(spark, table)
    assert stored(spark, place) == [(n, "t1") for n in range(4)]
    assert len(partitions(spark, table)) == 2


def test_late_rows(spark, place):
    land(place[0] / "in", [post(1, "@abc_ hola", "2024-01-10 10:00:00")])
    run(spark, place)
    land(place[0] / "in", [post(2, "@abc_ a", "2024-01-08 10:00:01"), post(3, "@abc_ b", "2024-01-07 10:00:00")])
    run(spark, place)
    assert stored(spark, place) == [(1, "t1"), (2, "t1")]


def test_wrong_clock_does_not_shut_out_later_posts(spark, place):
    now = str(datetime.datetime.now(datetime.timezone.utc))[:19]
    land(place[0] / "in", [post(1, "@abc_ hola", "2099-01-10 10:00:00"), post(2, "@abc_ hola", now)])
    run(spark, place)
    land(place[0] / "in", [post(3, "@abc_ hola", now), post(1, "@abc_ hola", "2099-01-10 10:00:00")])
    run(spark, place)
    assert stored(spark, place) == [(1, "t1"), (2, "t1"), (3, "t1")]


def test_unusable_posts_are_counted(spark, place):
    land(place[0] / "in", [post(1, "@abc_ hola"), post(2, "@abc_ hola", "soon"), post(None, "@abc_ hola"), post(3, "@abc_ hola", None)])
    query = run(spark, place)
    assert dict(query.recentProgress[0]["observedMetrics"]["received"].asDict()) == {"rows": 4, "unusable": 3}
    assert stored(spark, place) == [(1, "t1")]


def test_costly_scorer(spark, place):
    land(place[0] / "in", [post(i, f"@abc_ {'x' * (i % 3 + 1)}") for i in range(9)])
    run(spark, place, ModelScorer(lambda: lambda texts: np.array([[len(t)] for t in texts], dtype=float)))
    got = {r["TWEET_ID"]: r["SENTIMENT"] for r in facts.read_facts(spark, place[1]).collect()}
    assert got == {i: pytest.approx(1 / (1 + np.exp(-(i % 3 + 1)))) for i in range(9)}


def test_too_many_accounts_are_refused(spark, place, monkeypatch):
    monkeypatch.setattr(streaming, "INLINE_ACCOUNTS", 1)
    land(place[0] / "in", [post(1, "@abc_ hola")])
    with pytest.raises(ValueError, match="at most 1 accounts"):
        run(spark, place)


def test_interval_trigger(spark, place):
    folder, table = place
    land(folder / "in", [post(1, "@abc_ hola")])
    query = streaming.start_ingest(
        stream_posts(spark, str(folder / "in"), max_files=1), accounts(spark), lexicon(spark), table, str(folder / "progress"), interval="1 second"
    )
    try:
        query.processAllAvailable()
        land(folder / "in", [post(2, "@abc_ hola")])
        query.processAllAvailable()
    finally:
        query.stop()
    assert stored(spark, place) == [(1, "t1"), (2, "t1")]


def test_rolling_windows_close_by_watermark(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", "a", 0.2 + 0.1 * (m % 5)) for m in range(60)] + [("2024-01-01 03:00:00", "b", 0.9)]
    source = spark.createDataFrame(rows, "t string, TARGET string, SENTIMENT double").select(F.col("t").cast("timestamp").alias("TWEET_TIMESTAMP"), "TARGET", "SENTIMENT")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    start_rolling(rolling_metrics(stream, lateness="1 hour"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    got = {str(r["window_start"])[11:16]: (r["responses"], round(r["sentiment"])) for r in out.where("target = 'a'").collect()}
    assert got["00:00"] == (60, 40) and got["23:15"] == (15, 40) and got["00:45"] == (15, 40)
    assert out.where("target = 'b'").count() == 0
    assert out.agg(F.max("window_end").cast("string")).first()[0] == "2024-01-01 01:45:00"


def test_current_windows_keep_a_task_for_each_state_partition(spark, tmp_path):
    rows = [(f"2024-01-01 {h:02d}:30:00", t, 0.1 * h) for h in range(6) for t in "ab"]
    source = spark.createDataFrame(rows, "t string, TARGET string, SENTIMENT double").select(F.col("t").cast("timestamp").alias("TWEET_TIMESTAMP"), "TARGET", "SENTIMENT")
    source.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    query = start_current(rolling_metrics(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(job) for job in tracker.getJobIdsForGroup(str(query.runId))]
    tasks = {tracker.getStageInfo(stage).numTasks for job in jobs for stage in job.stageIds if tracker.getStageInfo(stage)}
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) in tasks
    assert len([*tmp_path.glob("out/batch=0/*.parquet")]) == 1
    assert current_windows(spark, str(tmp_path / "out")).count() == 48


def test_compaction_writes_days_of_the_same_batches_together(spark, place, monkeypatch):
    table, written = place[1], []
    days = [f"2024-01-0{d}" for d in range(1, 6)]
    for n in range(4):
        batch = [batch_of(spark, [10 * n + i], day) for i, day in enumerate(days if n != 1 else days[:3])]
        facts.write_batch(functools.reduce(lambda a, b: a.union(b), batch), table, f"run-{n}")
    want, write = stored(spark, place), facts.write_batch
    monkeypatch.setattr(facts, "write_batch", lambda *a: (written.append(a[2]), write(*a)))
    assert facts.compact(spark, table) == 3 * 3 + 2 * 2
    assert written == ["pending-run-to-2"] * 2
    assert stored(spark, place) == want and len(want) == 18
    assert sorted(partitions(spark, table)) == [
        f"event_date={day}/ingest_batch=run-{n}" for day in days for n in ("3", "to-2")
    ]


@pytest.mark.parametrize("events", [0, 40])
def test_compacted_facts_ingests_once(spark, tmp_path, monkeypatch, events):
    spark.createDataFrame([(0, "ASIA"), (1, "MIDDLE EAST"), (2, "AFRICA"), (3, "EUROPE"), (4, "AMERICA")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    rows = [(i, datetime.datetime(2024, 1, 1 + i % 3), i // 2, "view", 1.0 * i, "{}") for i in range(events)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    seen, ingested = spark.sparkContext.accumulator(0), queries._ingested

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def counted(*a):
        df = ingested(*a)
        return df.mapInArrow(watched, df.schema)

    want = ingested(spark, str(tmp_path)).count()
    monkeypatch.setattr(queries, "_ingested", counted)
    assert queries.compacted_facts(spark, str(tmp_path)).count() == want == seen.value
    assert (want > 0) == (events > 0)
