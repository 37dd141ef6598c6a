"""The registered queries as plain SQL over the same tables, for comparison."""

from __future__ import annotations

from echometer.checks.views import EMOJI, EMOJI_TABLE, WEIGHTS

_ACCOUNTS = """
accounts AS (
  SELECT r_name AS id, replace(r_name, ' ', '_') AS account,
         upper(left(r_name, 1)) || lower(substring(r_name, 2)) AS plain_name,
         lower(replace(r_name, ' ', '_')) || '.jpg' AS image,
         '#00000' || r_regionkey AS color, CAST(NULL AS VARCHAR) AS party,
         CAST(r_regionkey AS BIGINT) AS position
  FROM region)
"""

_INTERACTIONS = """
interactions AS (
  SELECT e.event_id AS tweet_id,
         r.r_name AS target,
         replace(r.r_name, ' ', '_') AS account,
         e.ts AS tweet_timestamp,
         CASE e.event_type
           WHEN 'view'     THEN concat('@', replace(r.r_name, ' ', '_'), ' hola #tag', e.user_id, '!  ok')
           WHEN 'click'    THEN concat('RT @', replace(r.r_name, ' ', '_'), ' gracias https://t.co/', e.event_id, '?a=1 fin')
           WHEN 'error'    THEN concat('@other ', 'cc @', replace(r.r_name, ' ', '_'))
           WHEN 'signup'   THEN concat('hoy @', replace(r.r_name, ' ', '_'), ' @x1 @x2 ¿qué tal?')
           ELSE                 concat('Nota de @', replace(r.r_name, ' ', '_'), ' n', e.user_id % 7)
         END AS full_text,
         CASE WHEN e.user_id % 3 = 0 THEN replace(r.r_name, ' ', '_')
              WHEN e.user_id % 3 = 1 THEN '' ELSE NULL END AS reply_to,
         CASE WHEN e.event_type = 'click' THEN 1 ELSE 0 END AS is_rt,
         CASE WHEN e.user_id % 11 = 0 THEN NULL ELSE e.value / (e.value + 15.0) END AS sentiment
  FROM events e JOIN region r ON e.user_id % 5 = r.r_regionkey)
"""

_POSTS = """
named AS (
  SELECT e.*, replace(r.r_name, ' ', '_') AS a, replace(s.r_name, ' ', '_') AS b
  FROM events e
  JOIN region r ON e.user_id % 5 = r.r_regionkey
  JOIN region s ON (e.user_id + 1 + e.event_id % 3) % 5 = s.r_regionkey),
bodies AS (
  SELECT *,
         CASE event_type
           WHEN 'view'   THEN concat('@', a, ' hola #tag', user_id, '!  ok 🥑')
           WHEN 'click'  THEN concat('gracias https://t.co/', event_id, '?a=1 fin')
           WHEN 'error'  THEN concat('@other cc @', a)
           WHEN 'signup' THEN concat('hoy @', a, ' @x1 @x2 ¿qué tal? 🙄')
           ELSE               concat('Nota de @', lower(a), ' n', user_id % 7, ' me@', a, '.com')
         END || CASE WHEN event_id % 4 = 0 THEN concat(' y @', b) ELSE '' END AS body
  FROM named),
posts AS (
  SELECT event_id AS tweet_id,
         CASE WHEN event_type = 'click'
              THEN concat('RT @', CASE WHEN event_id % 2 = 0 THEN a ELSE 'zzz' END, ' ', body)
              ELSE body END AS full_text,
         user_id * 7 AS followers_count, user_id * 3 AS favourites_count,
         user_id % 100 AS friends_count, event_id AS tweets_count,
         TIMESTAMP '2015-01-01 06:07:08' + to_days(CAST(user_id % 1000 AS INTEGER)) AS account_creation_date,
         date_trunc('second', ts) AS tweet_timestamp,
         CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS is_rt,
         CASE event_id % 5 WHEN 0 THEN a WHEN 1 THEN lower(b) WHEN 2 THEN '' ELSE NULL END AS reply_to,
         CASE WHEN event_id % 10 = 3 THEN 'en' ELSE 'es' END AS lang
  FROM bodies)
"""

_DIRECTED = f"""
{_ACCOUNTS}, {_POSTS},
named_posts AS (
  SELECT *,
         list_distinct(regexp_extract_all(lower(full_text), '(^|[^A-Za-z0-9_])@([A-Za-z0-9_]+)', 2)) AS mentions,
         lower(nullif(reply_to, '')) AS reply
  FROM posts),
pairs AS (
  SELECT p.*, c.id AS target, c.account,
         coalesce(p.reply = lower(c.account), false) AS is_reply,
         (SELECT count(*) FROM accounts o WHERE list_contains(p.mentions, lower(o.account))) AS tracked
  FROM named_posts p
  JOIN accounts c ON list_contains(p.mentions, lower(c.account)) OR p.reply = lower(c.account)),
assigned AS (SELECT * FROM pairs WHERE is_reply OR tracked <= 1)
"""

_RELEVANT = """
  NOT (starts_with(full_text, '@') AND NOT starts_with(full_text, '@' || account)
       AND coalesce(reply_to, '') <> account)
  AND NOT (NOT starts_with(full_text, 'RT @' || account) AND NOT starts_with(full_text, '@' || account)
       AND coalesce(reply_to, '') <> account
       AND length(full_text) - length(replace(full_text, '@', '')) > 2)
"""

_SPACES = (
    r"[ \t\n\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
_STEPS = (
    ("without_urls", "regexp_replace({}, 'https?://[!$-_a-z]+', '', 'g')"),
    ("without_mark", "regexp_replace({}, '^RT', '')"),
    ("without_handles", r"regexp_replace({}, '@[\p{{L}}\p{{N}}_]+', '@', 'g')"),
    ("without_punctuation", r"regexp_replace({}, '[.,/#@!¡?¿$%^&*;:{{}}=\-_`~()”“\"]', ' ', 'g')"),
    ("single_spaced", "regexp_replace({}, '" + _SPACES.replace("{", "{{").replace("}", "}}") + "', ' ', 'g')"),
    ("lower_case", "lower({})"),
    ("stripped", "trim({})"),
)


def _normalized(column: str, emoji: bool = False) -> str:
    expression = column
    for name, step in _STEPS:
        if name == "without_mark" and emoji:
            for key in sorted(EMOJI, key=len, reverse=True):
                expression = f"replace({expression}, '{key}', '{EMOJI[key]}')"
        expression = step.format(expression)
    return expression


def _steps() -> str:
    columns, expression = [], "'RT @A_1: ' || text"
    for name, step in _STEPS:
        expression = step.format(expression)
        columns.append(f"md5({expression}) AS {name}")
    return "SELECT doc_id, " + ", ".join(columns) + " FROM documents"


_LEXICON = (
    "lexicon(word, weight) AS (VALUES "
    + ", ".join(f"('{word}', CAST({weight} AS DOUBLE))" for word, weight in WEIGHTS.items())
    + ")"
)


def _lexicon_score(key: str, source: str) -> str:
    """Scores of ``source(key, processed_text)`` as relation ``answers``."""
    return f"""
{_LEXICON},
answers AS (
  SELECT t.{key}, 1 / (1 + exp(-coalesce(sum(l.weight), 0))) AS score
  FROM (SELECT {key}, unnest(string_split(processed_text, ' ')) AS word FROM {source}) t
  LEFT JOIN lexicon l USING (word) GROUP BY t.{key})
"""


_NOW = "(SELECT date_trunc('second', max(ts)) FROM events)"


def _metrics(minutes: int, exclude_retweets: bool = False) -> str:
    return f"""
{_INTERACTIONS},
metrics AS (
  SELECT target, count(*) AS responses,
         avg(CASE WHEN sentiment < 0.5 THEN 0 ELSE 1 END) * 100 AS sentiment
  FROM interactions
  WHERE date_trunc('second', tweet_timestamp) >= {_NOW} - INTERVAL {minutes} MINUTE
    {"AND is_rt = 0" if exclude_retweets else ""}
  GROUP BY target)
"""


def _metric_rows(minutes: int, exclude_retweets: bool = False) -> str:
    return (
        f"WITH {_metrics(minutes, exclude_retweets)} "
        "SELECT target, responses, round(sentiment, 6) AS sentiment FROM metrics"
    )


def _compact(number: str) -> str:
    n = f"CAST({number} AS DOUBLE)"
    step = f"power(10.0, greatest(CASE WHEN {n} < 1 THEN 1 ELSE floor(log10({n})) + 1 END - 2, 0))"
    rounded = f"(round_even({n} / {step}, 0) * {step})"
    cases = []
    for power, suffix in enumerate(("", "K", "M", "B", "T")):
        scaled = f"({rounded} / {1000.0 ** power})"
        cases.append(
            f"WHEN {rounded} < {1000.0 ** (power + 1)} THEN "
            f"CASE WHEN {scaled} = floor({scaled}) THEN CAST(CAST({scaled} AS BIGINT) AS VARCHAR) "
            f"ELSE printf('%.1f', {scaled}) END || '{suffix}'"
        )
    return "CASE " + " ".join(cases) + " END"


def _percent(number: str) -> str:
    return f"CAST(CAST(round_even({number}, 0) AS BIGINT) AS VARCHAR) || '%'"


def _color(number: str) -> str:
    return (
        f"CASE WHEN {number} < 20 THEN 'hsl(360, 67%, 44%)' WHEN {number} < 50 THEN 'hsl(360, 71%, 66%)' "
        f"WHEN {number} < 80 THEN 'hsl(185, 57%, 50%)' ELSE 'hsl(184, 77%, 34%)' END"
    )


def _band(number: str) -> str:
    return (
        f"CASE WHEN {number} < 20 THEN 'very_low' WHEN {number} < 50 THEN 'low' "
        f"WHEN {number} < 80 THEN 'high' ELSE 'very_high' END"
    )


_LABEL = "CASE WHEN sentiment < 0.5 THEN 'NEGATIVE' ELSE 'POSITIVE' END"
_LABEL_COLOR = "CASE WHEN sentiment < 0.5 THEN 'hsl(360, 67%, 44%)' ELSE 'hsl(184, 77%, 34%)' END"


def _latest(exclude_retweets: bool) -> str:
    return f"""
WITH {_INTERACTIONS}, {_ACCOUNTS},
latest AS (
  SELECT * FROM interactions
  WHERE date_trunc('second', tweet_timestamp) >= {_NOW} - INTERVAL 1440 MINUTE
    {"AND is_rt = 0" if exclude_retweets else ""}
  ORDER BY date_trunc('second', tweet_timestamp) DESC, tweet_id DESC LIMIT 5)
SELECT target, strftime(tweet_timestamp, '%H:%M:%S - %b %-d, %Y') AS time, image, full_text,
       {_LABEL} AS sentiment, {_LABEL_COLOR} AS color
FROM latest JOIN accounts ON target = id
"""


_PROCESSED = f"""
{_INTERACTIONS},
processed AS (SELECT *, {_normalized("full_text")} AS processed_text FROM interactions)
"""

_PROCESSED_DOCUMENTS = f"""
processed AS (SELECT doc_id, {_normalized("text")} AS processed_text FROM documents)
"""

_RULED = f"""
WITH {_PROCESSED}, {_lexicon_score("tweet_id", "processed")}
SELECT tweet_id, round(CASE WHEN starts_with(full_text, 'RT @' || account) THEN 1.0 ELSE score END, 6) AS sentiment
FROM processed JOIN answers USING (tweet_id)
"""

_PLAIN_SCORES = f"""
WITH {_PROCESSED}, {_lexicon_score("tweet_id", "processed")}
SELECT tweet_id, round(score, 6) AS sentiment FROM answers
"""

_DOCUMENT_SCORES = f"""
WITH {_PROCESSED_DOCUMENTS}, {_lexicon_score("doc_id", "processed")}
SELECT doc_id, round(score, 6) AS score FROM answers
"""

_LEARNED = f"""
{_PROCESSED_DOCUMENTS},
words AS (
  SELECT quality, unnest(string_split(processed_text, ' ')) AS word FROM processed JOIN labels USING (doc_id)
  WHERE quality IN (0, 1)),
counts AS (
  SELECT word, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad FROM words GROUP BY word),
learned AS (
  SELECT word, ln(((good + 1) / (sum(good) OVER () + count(*) OVER ()))
                  / ((bad + 1) / (sum(bad) OVER () + count(*) OVER ()))) AS weight FROM counts)
"""

_INGEST = f"""
{_DIRECTED},
kept AS (
  SELECT *, {_normalized("full_text", emoji=True)} AS processed_text
  FROM assigned WHERE lang = 'es' AND {_RELEVANT})
"""

_FRAME = """tweet_id, target, full_text, processed_text, followers_count, favourites_count,
  friends_count, tweets_count, account_creation_date, tweet_timestamp, is_rt"""

_STORED = f"""
WITH {_INGEST},
texts AS (SELECT DISTINCT processed_text AS key_text, processed_text FROM kept),
{_lexicon_score("key_text", "texts")}
SELECT {_FRAME},
       round(CASE WHEN starts_with(full_text, 'RT @' || account) THEN 1.0 ELSE score END, 6) AS sentiment,
       CAST(tweet_timestamp AS DATE) AS event_date
FROM kept JOIN answers ON processed_text = key_text
"""

_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_SHARE = f"(({_CENTS} % 20001) / 200.0::DOUBLE)"

ORACLE: dict[str, str] = {
    "account_metrics_15m": _metric_rows(15),
    "account_metrics_60m": _metric_rows(60),
    "account_metrics_1440m": _metric_rows(1440),
    "account_metrics_no_rt": _metric_rows(1440, exclude_retweets=True),
    "account_metrics_all_time": f"""
WITH {_INTERACTIONS}
SELECT target, count(*) AS responses, CAST(sum(is_rt) AS BIGINT) AS retweets,
       count(*) FILTER (sentiment IS NULL) AS unscored,
       round(avg(CASE WHEN sentiment < 0.5 THEN 0 ELSE 1 END) * 100, 6) AS sentiment
FROM interactions GROUP BY target
""",
    "overall_totals": f"""
WITH {_metrics(1440)}
SELECT CAST(coalesce(sum(responses), 0) AS BIGINT) AS responses,
       round(coalesce(avg(sentiment), 0), 6) AS sentiment FROM metrics
""",
    "headline": f"""
WITH {_metrics(1440)},
totals AS (
  SELECT CAST(coalesce(sum(responses), 0) AS BIGINT) AS responses,
         coalesce(avg(sentiment), 0) AS sentiment FROM metrics)
SELECT responses, {_compact("responses")} AS responses_text, round(sentiment, 6) AS sentiment,
       {_percent("sentiment")} AS approval_text, {_color("sentiment")} AS approval_color
FROM totals
""",
    "dashboard_cards": f"""
WITH {_ACCOUNTS}, {_metrics(1440)}
SELECT position, target,
       CASE WHEN id = 'MIDDLE EAST' THEN 'Middle East' ELSE plain_name END AS name,
       image, color, party, responses, {_compact("responses")} AS responses_text,
       round(sentiment, 6) AS sentiment, {_percent("sentiment")} AS approval_text,
       {_band("sentiment")} AS approval_band, {_color("sentiment")} AS approval_color
FROM accounts JOIN metrics ON id = target
""",
    "latest_posts": _latest(False),
    "latest_posts_no_rt": _latest(True),
    "sentiment_labels": f"""
WITH {_INTERACTIONS} SELECT tweet_id, {_LABEL} AS label, {_LABEL_COLOR} AS color FROM interactions
""",
    "display_values": f"""
SELECT o_orderkey, {_compact(f"{_CENTS} % 1000")} AS small, {_compact(_CENTS)} AS cents,
       {_compact(f"{_CENTS} * o_orderkey * 1000")} AS large, {_percent(_SHARE)} AS percent,
       {_band(_SHARE)} AS band, {_color(_SHARE)} AS color
FROM orders
""",
    "parsed_times": f"""
WITH {_POSTS}
SELECT tweet_id, tweet_timestamp, strftime(tweet_timestamp, '%H:%M:%S - %b %-d, %Y') AS shown,
       strftime(tweet_timestamp, '%Y-%m-%d %H:%M:%S') AS exported
FROM posts
""",
    "high_water_marks": f"""
WITH {_INTERACTIONS} SELECT target, max(tweet_id) AS max_id FROM interactions GROUP BY target
""",
    "incremental_slice": f"""
WITH {_INTERACTIONS},
marks AS (
  SELECT target, max(tweet_id) AS max_id FROM interactions
  WHERE tweet_timestamp < {_NOW} - INTERVAL 1440 MINUTE GROUP BY target)
SELECT tweet_id, target FROM interactions LEFT JOIN marks USING (target)
WHERE max_id IS NULL OR tweet_id > max_id
""",
    "relevant_interactions": f"""
WITH {_INTERACTIONS}
SELECT tweet_id, target,
       CAST(length(full_text) - length(replace(full_text, '@', '')) AS INTEGER) AS at_signs
FROM interactions WHERE {_RELEVANT}
""",
    "directed_at": f"WITH {_DIRECTED} SELECT tweet_id, target, is_reply FROM pairs",
    "assigned_targets": f"WITH {_DIRECTED} SELECT tweet_id, target FROM assigned",
    "assigned_targets_by_join": f"WITH {_DIRECTED} SELECT tweet_id, target FROM assigned",
    "co_mention_exclusion": (
        f"WITH {_DIRECTED} SELECT tweet_id, target FROM pairs WHERE NOT (is_reply OR tracked <= 1)"
    ),
    "directed_and_relevant": (
        f"WITH {_DIRECTED} SELECT tweet_id, target, account, full_text FROM assigned "
        f"WHERE lang = 'es' AND {_RELEVANT}"
    ),
    "incremental_pull": f"""
WITH {_INGEST},
stored AS (
  SELECT target, max(tweet_id) AS mark FROM kept
  WHERE tweet_timestamp < {_NOW} - INTERVAL 1440 MINUTE GROUP BY target),
pulled AS (
  SELECT * FROM assigned LEFT JOIN stored USING (target)
  WHERE lang = 'es' AND (mark IS NULL OR tweet_id > mark)
  QUALIFY row_number() OVER (PARTITION BY target ORDER BY tweet_id DESC) <= 100)
SELECT tweet_id, target FROM pulled WHERE {_RELEVANT}
""",
    "latest_k_per_account": f"""
WITH {_INTERACTIONS}
SELECT tweet_id, target FROM interactions
QUALIFY row_number() OVER (PARTITION BY target ORDER BY tweet_id DESC) <= 100
""",
    "document_mentions": """
SELECT doc_id, unnest(list_distinct(
         regexp_extract_all(lower('cc @' || source || ' (@' || upper(lang) || '), a@b.c ' || text),
                            '(^|[^A-Za-z0-9_])@([A-Za-z0-9_]+)', 2))) AS handle
FROM documents
""",
    "language_filter": "SELECT doc_id, lang FROM documents WHERE lang = 'es'",
    "learned_lexicon": f"WITH {_LEARNED} SELECT word, round(weight, 6) AS weight FROM learned",
    "ml_scores": f"""
WITH {_LEARNED},
own AS (SELECT doc_id, unnest(string_split(processed_text, ' ')) AS word FROM processed)
SELECT doc_id, round(1 / (1 + exp(-coalesce(sum(weight), 0))), 6) AS score
FROM own LEFT JOIN learned USING (word) GROUP BY doc_id
""",
    "normalized_text": f"WITH {_PROCESSED} SELECT tweet_id, processed_text FROM processed",
    "normalized_documents": f"WITH {_PROCESSED_DOCUMENTS} SELECT doc_id, processed_text FROM processed",
    "normalization_steps": _steps(),
    "emoji_names": f"""
WITH {_POSTS} SELECT tweet_id, {_normalized("full_text", emoji=True)} AS processed_text FROM posts
""",
    "distinct_texts": f"WITH {_PROCESSED} SELECT DISTINCT full_text, processed_text FROM processed",
    "model_input_tokens": f"""
WITH squeezed AS (
  SELECT doc_id, string_split(trim(regexp_replace(text, '{_SPACES}', ' ', 'g')), ' ') AS words
  FROM documents)
SELECT doc_id, CAST(len(words) AS INTEGER) AS tokens,
       md5(array_to_string(words[1:256], ' ')) AS input_md5
FROM squeezed
""",
    "lexicon_scores": _DOCUMENT_SCORES,
    "lexicon_scores_by_join": _DOCUMENT_SCORES,
    "rule_and_lexicon_scores": _RULED,
    "retweet_rule_split": _RULED,
    "deduplicated_scores": _RULED,
    "score_join_back": _PLAIN_SCORES,
    "retention_keep": f"""
WITH {_INTERACTIONS}
SELECT tweet_id, target FROM interactions
WHERE CAST(tweet_timestamp AS DATE) >= CAST({_NOW} AS DATE) - 2
""",
    "null_audit": f"""
WITH {_INTERACTIONS}
SELECT count(*) - count(tweet_id) AS tweet_id, count(*) - count(target) AS target,
       count(*) - count(account) AS account, count(*) - count(tweet_timestamp) AS tweet_timestamp,
       count(*) - count(full_text) AS full_text, count(*) - count(reply_to) AS reply_to,
       count(*) - count(is_rt) AS is_rt, count(*) - count(sentiment) AS sentiment
FROM interactions
""",
    "rows_per_id": f'WITH {_DIRECTED} SELECT tweet_id, count(*) AS "rows" FROM assigned GROUP BY tweet_id',
    "flatten_status": f"""
WITH {_POSTS}
SELECT tweet_id, full_text, followers_count, favourites_count, friends_count, tweets_count,
       account_creation_date, tweet_timestamp, is_rt, reply_to, lang
FROM posts
""",
    "interaction_frame": f"WITH {_INGEST} SELECT {_FRAME} FROM kept",
    "batch_ingest": _STORED,
    "fact_roundtrip": _STORED,
    "compacted_facts": _STORED,
    "stream_ingest": _STORED,
    "retention_drop": f"""
WITH {_INGEST}
SELECT CAST(tweet_timestamp AS DATE) AS event_date, count(*) AS stored
FROM kept WHERE CAST(tweet_timestamp AS DATE) >= CAST({_NOW} AS DATE) - 2
GROUP BY 1
""",
    "stream_rolling_counts": """
WITH spans AS (
  SELECT event_type AS target, value / (value + 15.0) AS sentiment,
         unnest([time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '2024-01-01') - to_minutes(15 * k)
                 for k in [0, 1, 2, 3]]) AS window_start
  FROM events)
SELECT window_start, window_start + INTERVAL 60 MINUTE AS window_end, target,
       count(*) AS responses,
       round(avg(CASE WHEN sentiment < 0.5 THEN 0 ELSE 1 END) * 100, 6) AS sentiment
FROM spans
GROUP BY window_start, target
HAVING window_start + INTERVAL 60 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 2 DAY
""",
    "stream_current_windows": """
WITH spans AS (
  SELECT event_type AS target, value / (value + 15.0) AS sentiment,
         unnest([time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '2024-01-01') - to_minutes(15 * k)
                 for k in [0, 1, 2, 3]]) AS window_start
  FROM events)
SELECT window_start, window_start + INTERVAL 60 MINUTE AS window_end, target, count(*) AS responses,
       round(avg(CASE WHEN sentiment < 0.5 THEN 0 ELSE 1 END) * 100, 6) AS sentiment
FROM spans GROUP BY window_start, target
""",
    "emoji_names_long_table": f"""
WITH names(place, name) AS (VALUES {", ".join(f"({k}, '{name or code}')" for k, (_, code, name) in enumerate(EMOJI_TABLE))})
SELECT event_id, 'a ' || a.name || b.name || chr(233) AS named
FROM events JOIN names a ON event_id % {len(EMOJI_TABLE)} = a.place
JOIN names b ON event_id // {len(EMOJI_TABLE)} % {len(EMOJI_TABLE)} = b.place
""",
    "accounts_csv": f"""
WITH {_ACCOUNTS}
SELECT id, account, CASE WHEN id = 'MIDDLE EAST' THEN 'Middle East' ELSE plain_name END AS name,
       image, color, party
FROM accounts
""",
    "emoji_names_large_table": """
WITH ids AS (SELECT event_id, event_id % 3500 AS a, (event_id // 3500) % 3500 AS b, (event_id * 7) % 3500 AS c FROM events)
SELECT event_id, 'a e' || a || ' b e' || b || 'e' || c || chr(233) AS named FROM ids
""",
}
