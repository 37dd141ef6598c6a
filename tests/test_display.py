import datetime as dt
import decimal
import math

from pyspark.sql import functions as F

from echometer.functions import clock, display


def run(spark, values, function, kind="double"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


def two_digits(number):
    """Two significant digits, half to even, with the suffix of the power of a thousand."""
    with decimal.localcontext(prec=2, rounding=decimal.ROUND_HALF_EVEN):
        shown = +decimal.Decimal(number)
    group = min(max(shown.adjusted(), 0) // 3, 4) if shown else 0
    return f"{shown.scaleb(-3 * group).normalize():f}" + " KMBT"[group].strip()


def test_compact_number(spark):
    # Fixed values.
    golden = {0: "0", 7: "7", 155: "160", 999: "1K", 1250: "1.2K", 1350: "1.4K", 995000: "1M", 15000000: "15M"}
    assert run(spark, list(golden), display.compact_number, "bigint") == list(golden.values())
    values = [*range(0, 3000, 7), *(d * 10**p + r for p in range(1, 14) for d in (1, 12, 125, 995) for r in (0, 1) if d * 10**p < 9.9e14)]
    assert run(spark, values, display.compact_number, "bigint") == [two_digits(v) for v in values]
    assert run(spark, [10**15, 2_550_000_000_000_000, None, -1250], display.compact_number, "bigint") == ["1000T", "2600T", None, "-1.2K"]


def test_percent_text(spark):
    values = [0.5, 1.5, 2.5, 66.67, 0.0, 100.0, math.nan, None]
    assert run(spark, values, display.percent_text) == ["0%", "2%", "2%", "67%", "0%", "100%", "nan%", None]


def test_bands_and_labels(spark):
    assert run(spark, [19.9, 20.0, 50.0, 80.0, math.nan], display.score_band) == [
        "very_low", "low", "high", "very_high", "very_high",
    ]
    assert run(spark, [19.9, 80.0], display.score_color) == ["hsl(360, 67%, 44%)", "hsl(184, 77%, 34%)"]
    assert run(spark, [0.49, 0.5, None], display.sentiment_label) == ["NEGATIVE", "POSITIVE", "POSITIVE"]


def test_times(spark):
    moment = dt.datetime(2020, 7, 5, 9, 8, 7)
    assert run(spark, [moment], display.display_time, "timestamp_ntz") == ["09:08:07 - Jul 5, 2020"]
    assert run(spark, [moment], display.export_time, "timestamp_ntz") == ["2020-07-05 09:08:07"]


def test_post_time(spark):
    texts = ["Wed Oct 10 20:19:24 +0000 2018", "2018-10-10 20:19:24", "2018-10-10T20:19:24Z", "Wed Oct 10 22:19:24 +0200 2018", "soon", None]
    want = "2018-10-10 20:19:24"
    got = run(spark, texts, lambda c: display.export_time(clock.post_time(c)), "string")
    assert got == [want, want, want, want, None, None]


def test_bounds(spark):
    as_of = dt.datetime(2024, 1, 3, 0, 5, 9, 999999)
    for given in (as_of, as_of.replace(tzinfo=dt.timezone.utc), as_of.isoformat(), F.lit(str(as_of)).cast("timestamp")):
        row = spark.range(1).select(
            display.export_time(clock.minutes_before(given, 15)).alias("m"),
            clock.days_before(given, 2).alias("d"),
        ).first()
        assert tuple(row) == ("2024-01-02 23:50:09", dt.date(2024, 1, 1))
    age = spark.range(1).select((F.current_timestamp() - clock.minutes_before(None, 15)).alias("a")).first()["a"]
    assert dt.timedelta(minutes=15) <= age < dt.timedelta(minutes=15, seconds=1)
