"""The registered queries: every operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echometer.checks import views
from echometer.functions import clock, display, text
from echometer.functions.emoji import name_emoji
from echometer.operators import audit, relevance, scoring, targets
from echometer.operators.flatten import flatten
from echometer.plans import dashboard, ingest
from echometer.schemas import PARTITION_DAY
from echometer.session import scratch_path
from echometer.sources import accounts as account_source
from echometer.sources import emoji as emoji_source
from echometer.sources import facts as fact_table
from echometer.sources.posts import posts_from_text, stream_posts
from echometer.streaming.ingest import start_ingest
from echometer.streaming.rolling import current_windows, rolling_metrics, start_current, start_rolling

Query = Callable[[SparkSession, str], DataFrame]


def _six(column: str | Column) -> Column:
    return F.round(column, 6)


def _rounded(df: DataFrame, column: str = "sentiment") -> DataFrame:
    return df.withColumn(column, _six(column))


def _lower(df: DataFrame) -> DataFrame:
    return df.toDF(*(name.lower() for name in df.columns))


def _processed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("PROCESSED_TEXT", text.normalize(F.col("FULL_TEXT")))


def _metrics(spark: SparkSession, sf_dir: str, minutes: int, exclude_retweets: bool = False) -> DataFrame:
    return dashboard.account_metrics(
        views.interactions(spark, sf_dir),
        minutes,
        exclude_retweets,
        views.newest_second(spark, sf_dir),
    )


# Dashboard


def account_metrics_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_metrics(spark, sf_dir, 15))


def account_metrics_60m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_metrics(spark, sf_dir, 60))


def account_metrics_1440m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_metrics(spark, sf_dir, 1440))


def account_metrics_no_rt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_metrics(spark, sf_dir, 1440, exclude_retweets=True))


def account_metrics_all_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.interactions(spark, sf_dir)
    return _rounded(
        rows.groupBy(F.col("TARGET").alias("target")).agg(
            F.count(F.lit(1)).alias("responses"),
            F.sum("IS_RT").alias("retweets"),
            F.count_if(F.col("SENTIMENT").isNull()).alias("unscored"),
            display.positive_share(F.col("SENTIMENT")).alias("sentiment"),
        )
    )


def overall_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(dashboard.totals(_metrics(spark, sf_dir, 1440)))


def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(dashboard.headline(_metrics(spark, sf_dir, 1440)))


def dashboard_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = dashboard.account_cards(views.accounts(spark, sf_dir), _metrics(spark, sf_dir, 1440))
    return _rounded(cards)


def _latest(spark: SparkSession, sf_dir: str, exclude_retweets: bool) -> DataFrame:
    latest = dashboard.latest_posts(
        views.interactions(spark, sf_dir), 1440, exclude_retweets, views.newest_second(spark, sf_dir)
    )
    return dashboard.latest_cards(latest, views.accounts(spark, sf_dir))


def latest_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir, False)


def latest_posts_no_rt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir, True)


def sentiment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("SENTIMENT")
    return views.interactions(spark, sf_dir).select(
        F.col("TWEET_ID").alias("tweet_id"),
        display.sentiment_label(score).alias("label"),
        display.label_color(score).alias("color"),
    )


def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice").cast("double")
    cents = F.round(price * 100).cast("bigint")
    percent = (cents % 20001) / 200.0
    return views.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        display.compact_number(cents % 1000).alias("small"),
        display.compact_number(cents).alias("cents"),
        display.compact_number(cents * F.col("o_orderkey") * 1000).alias("large"),
        display.percent_text(percent).alias("percent"),
        display.score_band(percent).alias("band"),
        display.score_color(percent).alias("color"),
    )


def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    moment = clock.post_time(F.col("created_at"))
    return views.raw_posts(spark, sf_dir).select(
        F.col("id").alias("tweet_id"),
        moment.cast("timestamp_ntz").alias("tweet_timestamp"),
        display.display_time(moment).alias("shown"),
        display.export_time(moment).alias("exported"),
    )


# Targets and relevance


def high_water_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lower(targets.high_water_marks(views.interactions(spark, sf_dir)))


def incremental_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.interactions(spark, sf_dir)
    yesterday = clock.minutes_before(views.newest_second(spark, sf_dir), 1440)
    known = rows.where(F.col("TWEET_TIMESTAMP") < yesterday.cast("timestamp_ntz"))
    fresh = targets.after_high_water(rows, targets.high_water_marks(known))
    return _lower(fresh.select("TWEET_ID", "TARGET"))


def relevant_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = relevance.keep_relevant(views.interactions(spark, sf_dir))
    return kept.select(
        F.col("TWEET_ID").alias("tweet_id"),
        F.col("TARGET").alias("target"),
        text.count_at_signs(F.col("FULL_TEXT")).alias("at_signs"),
    )


def _flat_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten(views.raw_posts(spark, sf_dir))


def directed_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = targets.directed_at(_flat_posts(spark, sf_dir), views.accounts(spark, sf_dir))
    return _lower(pairs.select("TWEET_ID", "TARGET", "IS_REPLY"))


def assigned_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = targets.assign_targets(_flat_posts(spark, sf_dir), views.accounts(spark, sf_dir))
    return _lower(pairs.select("TWEET_ID", "TARGET"))


def assigned_targets_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = targets.assign_targets(
        _flat_posts(spark, sf_dir), views.accounts(spark, sf_dir), inline_accounts=0
    )
    return _lower(pairs.select("TWEET_ID", "TARGET"))


def co_mention_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lower(targets.co_mentioned(_flat_posts(spark, sf_dir), views.accounts(spark, sf_dir)))


def directed_and_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ingest.directed_posts(
        views.raw_posts(spark, sf_dir), views.accounts(spark, sf_dir), language="es"
    )
    return _lower(kept.select("TWEET_ID", "TARGET", "ACCOUNT", "FULL_TEXT"))


def incremental_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One polling cycle: the newest 100 posts per account beyond the stored ids, then the rules."""
    posts, accounts = views.raw_posts(spark, sf_dir), views.accounts(spark, sf_dir)
    yesterday = clock.minutes_before(views.newest_second(spark, sf_dir), 1440)
    stored = ingest.directed_posts(posts, accounts, "es").where(F.col("TWEET_TIMESTAMP") < yesterday)
    fresh = ingest.directed_posts(posts, accounts, "es", stored=stored, most_recent=100)
    return _lower(fresh.select("TWEET_ID", "TARGET"))


def latest_k_per_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = targets.latest_k(views.interactions(spark, sf_dir), 100)
    return _lower(latest.select("TWEET_ID", "TARGET"))


def document_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("cc @"), "source", F.lit(" (@"), F.upper("lang"), F.lit("), a@b.c "), "text")
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(text.mentions(said)).alias("handle")
    )


def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = targets.in_language(views.table(spark, sf_dir, "documents"), "es", "lang")
    return kept.select("doc_id", "lang")


# Text


def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lower(_processed(views.interactions(spark, sf_dir)).select("TWEET_ID", "PROCESSED_TEXT"))


def normalized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", text.normalize(F.col("text")).alias("processed_text")
    )


def normalization_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = {
        "without_urls": text.strip_urls,
        "without_mark": text.drop_leading_mark,
        "without_handles": text.strip_handles,
        "without_punctuation": text.blank_punctuation,
        "single_spaced": text.collapse_spaces,
        "lower_case": F.lower,
        "stripped": F.trim,
    }
    rows = views.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("RT @A_1: "), "text").alias("value")
    )
    for name, step in steps.items():
        rows = rows.withColumn("value", step(F.col("value"))).withColumn(name, F.md5("value"))
    return rows.drop("value")


def emoji_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_posts(spark, sf_dir).select(
        F.col("TWEET_ID").alias("tweet_id"),
        text.normalize(F.col("FULL_TEXT"), views.EMOJI).alias("processed_text"),
    )


def distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lower(audit.distinct_texts(_processed(views.interactions(spark, sf_dir))))


def model_input_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap is the operator: a fixed-width model reads 256 tokens of a text of any length."""
    words = F.split(text.squeeze(F.col("text")), " ")
    return views.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(words).alias("tokens"),
        F.md5(text.cap_tokens(F.col("text"))).alias("input_md5"),
    )


# Scores


def _scorer(spark: SparkSession) -> scoring.LexiconScorer:
    return scoring.LexiconScorer(views.lexicon(spark))


def _scores(scored: DataFrame) -> DataFrame:
    return _rounded(_lower(scored.select("TWEET_ID", "SENTIMENT")))


def _unscored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _processed(views.interactions(spark, sf_dir).drop("SENTIMENT"))


def lexicon_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = views.table(spark, sf_dir, "documents").select(
        "doc_id", text.normalize(F.col("text")).alias("processed_text")
    )
    scored = _scorer(spark).score(documents, "processed_text", "score")
    return scored.select("doc_id", _six("score").alias("score"))


def learned_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = views.table(spark, sf_dir, "documents").select(
        "doc_id", text.normalize(F.col("text")).alias("processed_text")
    )
    labels = views.table(spark, sf_dir, "labels").select("doc_id", "quality")
    learned = scoring.log_odds_lexicon(documents.join(labels, "doc_id"), "processed_text", "quality")
    return learned.select("word", _six("weight").alias("weight"))


def lexicon_scores_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = views.table(spark, sf_dir, "documents").select(
        "doc_id", text.normalize(F.col("text")).alias("processed_text")
    )
    scorer = scoring.LexiconScorer(views.lexicon(spark), inline_words=0)
    scored = scorer.score(documents, "processed_text", "score")
    return scored.select("doc_id", _six("score").alias("score"))


def rule_and_lexicon_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(scoring.score_with_rule(_unscored(spark, sf_dir), _scorer(spark)))


def retweet_rule_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(scoring.score_by_branches(_unscored(spark, sf_dir), _scorer(spark)))


def deduplicated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(scoring.score_deduplicated(_unscored(spark, sf_dir), _scorer(spark)))


def score_join_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _unscored(spark, sf_dir)
    scores = _scorer(spark).score(audit.distinct_texts(rows), "PROCESSED_TEXT", "SENTIMENT")
    return _scores(scoring.join_back(rows, scores))


def ml_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = views.table(spark, sf_dir, "documents").select(
        "doc_id", text.normalize(F.col("text")).alias("PROCESSED_TEXT")
    )
    labels = views.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    learned = scoring.log_odds_lexicon(documents.join(labels, "doc_id"), "PROCESSED_TEXT", "label")
    # Words of the corpus grow with it, so they are joined.
    scorer = scoring.LexiconScorer(learned, inline_words=0)
    scored = scorer.score(documents, "PROCESSED_TEXT", "score")
    return scored.select("doc_id", _six("score").alias("score"))


# Storage and audit


def retention_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = fact_table.kept_rows(
        views.interactions(spark, sf_dir), views.newest_second(spark, sf_dir)
    )
    return _lower(kept.select("TWEET_ID", "TARGET"))


def null_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lower(audit.null_audit(views.interactions(spark, sf_dir)))


def rows_per_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = targets.assign_targets(_flat_posts(spark, sf_dir), views.accounts(spark, sf_dir))
    return _lower(audit.rows_per_id(pairs))


def flatten_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = views.raw_posts(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
    return _naive(flatten(posts_from_text(messages)).drop("INSERT_TIMESTAMP"))


def _naive(rows: DataFrame) -> DataFrame:
    """Timestamps without a zone, as the test tables have them."""
    moments = {
        f.name: F.col(f.name).cast("timestamp_ntz")
        for f in rows.schema.fields
        if f.dataType.typeName() == "timestamp"
    }
    return _lower(rows.withColumns(moments))


def interaction_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = ingest.interactions(
        views.raw_posts(spark, sf_dir), views.accounts(spark, sf_dir), "es", views.EMOJI
    )
    return _naive(frame.drop("INSERT_TIMESTAMP"))


def _fresh_table(spark: SparkSession) -> str:
    """An empty fact table in a database of its own inside the shared folder."""
    folder = scratch_path(spark, "facts")
    database = folder.rsplit("/", 1)[1].replace("-", "_")
    spark.sql(f"CREATE DATABASE {database} LOCATION '{folder}'")
    fact_table.create_table(spark, f"{database}.tweets")
    return f"{database}.tweets"


def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingest(
        views.raw_posts(spark, sf_dir), views.accounts(spark, sf_dir), _scorer(spark), "es", views.EMOJI
    )


def _stored(facts: DataFrame) -> DataFrame:
    return _rounded(_naive(facts.drop("INSERT_TIMESTAMP")))


def batch_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ingested(spark, sf_dir)
    return _stored(rows.withColumn(PARTITION_DAY, F.to_date("TWEET_TIMESTAMP")))


def fact_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _fresh_table(spark)
    fact_table.append(_ingested(spark, sf_dir), table)
    return _stored(fact_table.read_facts(spark, table))


def compacted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored rows, written as eight batches of a run and merged twice on the way."""
    table = _fresh_table(spark)
    # Posts are scored once; each batch then reads its own folder.
    dealt = scratch_path(spark, "batches")
    rows = _ingested(spark, sf_dir).withColumn("_batch", F.pmod("TWEET_ID", F.lit(8)))
    rows.write.partitionBy("_batch").parquet(dealt)
    for batch in range(8):
        fresh = spark.read.schema(rows.schema).parquet(dealt).where(F.col("_batch") == batch).drop("_batch")
        fact_table.write_batch(fresh, table, f"run-{batch}")
        if batch in (4, 7):
            fact_table.compact(spark, table)
    return _stored(fact_table.read_facts(spark, table))


def retention_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _fresh_table(spark)
    fact_table.append(_ingested(spark, sf_dir), table)
    fact_table.drop_expired(spark, table, views.newest_second(spark, sf_dir))
    facts = fact_table.read_facts(spark, table)
    return facts.groupBy(PARTITION_DAY).agg(F.count(F.lit(1)).alias("stored"))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    landing = scratch_path(spark, "landing")
    views.raw_posts(spark, sf_dir).write.json(landing)
    table = _fresh_table(spark)
    query = start_ingest(
        stream_posts(spark, landing),
        views.accounts(spark, sf_dir),
        _scorer(spark),
        table,
        scratch_path(spark, "progress"),
        language="es",
        emoji=views.EMOJI,
    )
    query.awaitTermination()
    return _stored(fact_table.read_facts(spark, table))


def stream_rolling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.table(spark, sf_dir, "events")
    stream = (
        spark.readStream.schema(events.schema)
        .parquet(f"{sf_dir}/event*.parquet")
        .select(
            F.col("ts").cast("timestamp").alias("TWEET_TIMESTAMP"),
            F.col("event_type").alias("TARGET"),
            (F.col("value") / (F.col("value") + 15.0)).alias("SENTIMENT"),
        )
    )
    path = scratch_path(spark, "rolling")
    start_rolling(rolling_metrics(stream), path, scratch_path(spark, "progress")).awaitTermination()
    return _rounded(_naive(spark.read.parquet(path)))


def stream_current_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows, open ones too, after several micro-batches."""
    landing, path = scratch_path(spark, "landing"), scratch_path(spark, "current")
    views.table(spark, sf_dir, "events").repartition(4, "event_id").write.parquet(landing)
    stream = (
        spark.readStream.schema(spark.read.parquet(landing).schema)
        .option("maxFilesPerTrigger", 1)
        .parquet(landing)
        .select(
            F.col("ts").cast("timestamp").alias("TWEET_TIMESTAMP"),
            F.col("event_type").alias("TARGET"),
            (F.col("value") / (F.col("value") + 15.0)).alias("SENTIMENT"),
        )
    )
    metrics = rolling_metrics(stream, lateness="60 days")
    start_current(metrics, path, scratch_path(spark, "progress")).awaitTermination()
    return _rounded(_naive(current_windows(spark, path)))


def emoji_names_long_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two emoji side by side, named by tables read from CSV and folded."""
    folder = scratch_path(spark, "emoji")
    rows = [(place, *row) for place, row in enumerate(views.EMOJI_TABLE)]
    table = spark.createDataFrame(rows, "place int, emoji string, code string, name string")
    for file, key, name in (("codes", "emoji", "code"), ("local", "code", "name")):
        named = table.where(F.col(name).isNotNull()).select(F.col(key).alias("emoji"), F.col(name).alias("name"))
        named.write.option("header", True).csv(f"{folder}/{file}")
    codes, local = (emoji_source.read_names(spark, f"{folder}/{file}") for file in ("codes", "local"))
    names = emoji_source.as_mapping(emoji_source.translate_names(codes, local))
    of = {place: row[0] for place, row in enumerate(views.EMOJI_TABLE)}
    symbols, many = F.array(*(F.lit(of[k]) for k in range(len(of)))), len(of)
    said = views.table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(
            F.lit("a "),
            F.element_at(symbols, (F.col("event_id") % many + 1).cast("int")),
            F.element_at(symbols, (F.floor(F.col("event_id") / many) % many + 1).cast("int")),
            F.lit("\u00e9"),
        ).alias("said"),
    )
    return said.select("event_id", name_emoji(F.col("said"), names).alias("named"))


def emoji_names_large_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two emoji of a table of 3,500 entries in every event, named by the trie of the table."""
    names = {views.large_emoji(i): f"e{i}" for i in range(views.LARGE_EMOJI)}
    many = views.LARGE_EMOJI
    symbols = F.array(*(F.lit(views.large_emoji(i)) for i in range(many)))
    said = views.table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(
            F.lit("a "),
            F.element_at(symbols, (F.col("event_id") % many + 1).cast("int")),
            F.lit(" b "),
            F.element_at(symbols, (F.floor(F.col("event_id") / many) % many + 1).cast("int")),
            F.element_at(symbols, (F.col("event_id") * 7 % many + 1).cast("int")),
            F.lit("\u00e9"),
        ).alias("said"),
    )
    return said.select("event_id", name_emoji(F.col("said"), names).alias("named"))


def accounts_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "accounts")
    rows = views.accounts(spark, sf_dir)
    rows.drop("position").write.option("header", True).csv(path)
    return account_source.read_accounts(spark, path).drop("position")


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        account_metrics_15m,
        account_metrics_60m,
        account_metrics_1440m,
        account_metrics_no_rt,
        account_metrics_all_time,
        overall_totals,
        headline,
        dashboard_cards,
        latest_posts,
        latest_posts_no_rt,
        sentiment_labels,
        display_values,
        parsed_times,
        high_water_marks,
        incremental_slice,
        relevant_interactions,
        directed_at,
        assigned_targets,
        assigned_targets_by_join,
        co_mention_exclusion,
        directed_and_relevant,
        incremental_pull,
        latest_k_per_account,
        document_mentions,
        language_filter,
        normalized_text,
        normalized_documents,
        normalization_steps,
        emoji_names,
        distinct_texts,
        model_input_tokens,
        lexicon_scores,
        learned_lexicon,
        lexicon_scores_by_join,
        rule_and_lexicon_scores,
        retweet_rule_split,
        deduplicated_scores,
        score_join_back,
        ml_scores,
        retention_keep,
        null_audit,
        rows_per_id,
        flatten_status,
        interaction_frame,
        batch_ingest,
        fact_roundtrip,
        compacted_facts,
        retention_drop,
        stream_ingest,
        stream_rolling_counts,
        stream_current_windows,
        emoji_names_long_table,
        emoji_names_large_table,
        accounts_csv,
    )
}
