"""Queries and check SQL: the streaming operators, run to the end of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.curation import emails
from checks.duck import ctes, round_even
from checks.mail import SCORED_HEADERS, SCORED_SENDERS, authored
from checks.verdicts import LAYER_CTES, SCORES, evidence, verdict_sql
from checks.urls import EMAIL_URLS, PARSED, scored_urls
from mailsieve.plans.deep_analysis import Evidence, deep_analyze
from mailsieve.plans.facts import KEYS, FactStore
from mailsieve.session import shared_dir
from mailsieve.sources.derived import AS_OF, load_table
from mailsieve.streaming.jobs import (
    deep_score_batches,
    first_seen,
    late_url_scores,
    score_stream,
    sender_sessions,
    sender_sessions_stream,
    timed_urls,
    windowed_verdicts,
)

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def as_stream(df: DataFrame, name: str) -> DataFrame:
    """The rows of a table as files arriving in a folder."""
    spark = df.sparkSession
    path = folder(spark, f"{name}-in")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all input and read what it appended."""
    spark = stream.sparkSession
    out = folder(spark, f"{name}-out")
    job = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", folder(spark, f"{name}-state"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def events(spark, sf) -> DataFrame:
    """Events with an instant that does not depend on the session's time zone."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    rows = load_table(spark, sf, "events")
    return rows.select(
        "event_id", "user_id", "event_type", F.timestamp_micros(micros).alias("received_at")
    )


MAIL_ONLY = f"""{ctes("emails")}, {SCORES}, {SCORED_HEADERS}, {SCORED_SENDERS}, {authored("emails")},
  lay AS (SELECT c.email_id, c.is_phishing, c.confidence, CASE WHEN c.is_phishing THEN c.confidence ELSE 1.0::DOUBLE - c.confidence END AS text_risk,
    NULL::DOUBLE AS url_risk, h.risk_score AS headers_risk, NULL::DOUBLE AS links_risk, NULL::DOUBLE AS visual_risk, NULL::DOUBLE AS crawl_risk,
    s.risk_score AS sender_risk, a.is_ai_generated
    FROM cl c LEFT JOIN headers h USING (email_id) LEFT JOIN senders s USING (email_id) LEFT JOIN authorship a USING (email_id))"""


@query("score_stream", f"{MAIL_ONLY} SELECT email_id, verdict AS overall_verdict FROM {verdict_sql()}")
def _score_stream(spark, sf):
    scored = score_stream(as_stream(emails(spark, sf), "mail"), as_of=AS_OF)
    return drained(scored.select("email_id", "overall_verdict"), "scored")


@query(
    "deep_score_batches",
    f"{LAYER_CTES} SELECT email_id, verdict AS overall_verdict, {round_even('combined')} AS overall_risk_score FROM {verdict_sql()}",
)
def _deep_batches(spark, sf):
    """All layers per micro-batch; equal to the batch plan row by row."""
    out = folder(spark, "deep-out")
    tables = evidence(spark, sf)

    def sink(batch: DataFrame, number: int) -> None:
        columns = ["email_id", "overall_verdict", "overall_risk_score"]
        batch.select(*columns).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = as_stream(emails(spark, sf), "deep")
    deep_score_batches(
        stream, sink, folder(spark, "deep-state"), tables, as_of=AS_OF
    ).awaitTermination()
    return spark.read.parquet(out).drop("batch")


def stored(spark, sf) -> FactStore:
    """All evidence in a fact store, added in two batches of which the second comes twice."""
    store = FactStore(folder(spark, "facts"), 16)
    tables = evidence(spark, sf)
    for number in (0, 1, 1):
        part = {n: getattr(tables, n).filter(F.col("page_id") % 2 == number) for n in KEYS}
        store.add(Evidence(**{n: t.drop("page_id") if n != "pages" else t for n, t in part.items()}), number)
    return store


@query("deep_score_facts", ORACLE["deep_score_batches"])
def _deep_facts(spark, sf):
    """Micro-batches that read the facts on their own URLs; equal to the batch plan."""
    out, store = folder(spark, "facts-out"), stored(spark, sf)

    def sink(batch: DataFrame, number: int) -> None:
        batch.select("email_id", "overall_verdict", "overall_risk_score").write.mode("overwrite").parquet(f"{out}/batch={number}")

    deep_score_batches(as_stream(emails(spark, sf), "deep"), sink, folder(spark, "facts-state"), store, as_of=AS_OF).awaitTermination()
    return spark.read.parquet(out).drop("batch")


# Vendor counts that come in some time after a mail with the URL.
LATE_SQL = """seen AS (SELECT CASE page_id % 10 WHEN 0 THEN 'http://paypal-secure.xyz/login' ELSE url END AS url, page_id * 7 % 12 AS malicious, page_id % 3 AS suspicious,
    60 - page_id % 12 AS harmless, 1767225600 - page_id * 244 + page_id % 4 * 1800 AS observed FROM pages)"""
LATE_CTES = f"""{ctes("emails")}, {PARSED}, {EMAIL_URLS}, {LATE_SQL},
  m AS (SELECT u.*, e.received_epoch AS received FROM email_urls u JOIN emails e USING (email_id)),
  j AS (SELECT m.email_id, m.pos, m.url, m.received, s.observed, NULL::BIGINT AS age, NULL::BOOLEAN AS ssl_valid, NULL::BIGINT AS days_left, s.malicious, s.suspicious
    FROM m LEFT JOIN seen s ON m.url = s.url AND s.observed BETWEEN m.received AND m.received + 3600)"""
LATE = f"SELECT email_id, pos, observed, risk_score, is_suspicious FROM {scored_urls('SELECT * FROM j')}"


def late_reputation(spark, sf) -> DataFrame:
    found = spark.sql(f"WITH {LATE_SQL.replace('FROM pages', 'FROM {pages}')} SELECT * FROM seen", pages=load_table(spark, sf, "pages"))
    return found.withColumn("observed_at", F.timestamp_seconds("observed")).drop("observed")


def late_rows(scored: DataFrame) -> DataFrame:
    return scored.select("email_id", F.col("pos").cast("long").alias("pos"), F.unix_seconds("observed_at").alias("observed"), "risk_score", "is_suspicious")


@query("late_url_scores", f"{LATE_CTES} {LATE}")
def _late(spark, sf):
    return late_rows(late_url_scores(timed_urls(emails(spark, sf)), late_reputation(spark, sf)))


@query("late_url_scores_stream", f"{LATE_CTES} {LATE} WHERE observed IS NOT NULL OR received < (SELECT least(max(received), (SELECT max(observed) FROM seen)) FROM m) - 600 - 3600")
def _late_stream(spark, sf):
    """Two streams; mails without an observation come out once none can come any more."""
    urls = timed_urls(as_stream(emails(spark, sf), "mails"))
    return late_rows(drained(late_url_scores(urls, as_stream(late_reputation(spark, sf), "seen")), "late"))


_MINUTE = "CAST(floor(epoch(ts) / 60) AS BIGINT)"


@query(
    "windowed_verdicts",
    """SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS window_start, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 + 3600 AS window_end,
    event_type AS verdict, count(*) AS emails FROM events GROUP BY ALL""",
)
def _tumbling(spark, sf):
    out = windowed_verdicts(events(spark, sf), "1 hour", verdict="event_type")
    return out.withColumns({c: F.unix_seconds(c) for c in ("window_start", "window_end")})


@query(
    "windowed_verdicts_sliding",
    """SELECT s AS window_start, s + 3600 AS window_end, event_type AS verdict, count(*) AS emails FROM
    (SELECT event_type, unnest([(CAST(floor(epoch(ts) / 1200) AS BIGINT) - k) * 1200 FOR k IN range(3)]) AS s FROM events) GROUP BY ALL""",
)
def _sliding(spark, sf):
    out = windowed_verdicts(events(spark, sf), "1 hour", "20 minutes", verdict="event_type")
    return out.withColumns({c: F.unix_seconds(c) for c in ("window_start", "window_end")})


@query(
    "windowed_verdicts_stream",
    """SELECT s AS window_start, event_type AS verdict, n AS emails FROM (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS s, event_type, count(*) AS n
    FROM events GROUP BY ALL) WHERE s + 3600 <= (SELECT epoch(max(ts)) - 600 FROM events)""",
)
def _window_stream(spark, sf):
    """Windows closed by the watermark when the input ends."""
    counted = windowed_verdicts(as_stream(events(spark, sf), "events"), "1 hour", verdict="event_type")
    closed = drained(counted, "windows")
    return closed.select(F.unix_seconds("window_start").alias("window_start"), "verdict", "emails")


# First copies by slices of a day, none in the 3 slices before.
FIRST_SEEN = """d AS (SELECT sha256(payload) AS text_hash, event_id, epoch_us(ts) AS us, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS slice
    FROM (SELECT *, event_type || ':' || CAST(user_id % 7 AS VARCHAR) AS payload FROM events)),
  f AS (SELECT text_hash, slice, min(us) AS us FROM d GROUP BY ALL),
  e AS (SELECT f.*, (SELECT min(event_id) FROM d WHERE d.text_hash = f.text_hash AND d.us = f.us) AS event_id,
    slice - lag(slice) OVER (PARTITION BY f.text_hash ORDER BY slice) AS gap FROM f)"""


def messages(spark, sf) -> DataFrame:
    """Events as short messages, of which many are equal."""
    rows = load_table(spark, sf, "events").select("event_id", F.concat_ws(":", "event_type", (F.col("user_id") % 7).cast("string")).alias("text"))
    return events(spark, sf).join(rows, "event_id")


@query("first_seen", f"{ctes('emails')} SELECT sha256(text) AS text_hash, min(email_id) AS email_id FROM emails GROUP BY ALL")
def _first(spark, sf):
    """The first copy of each mail; all of them come at one time, so the smallest id is first."""
    mails = emails(spark, sf).withColumn("received_at", F.lit(AS_OF).cast("timestamp"))
    return first_seen(mails).select("text_hash", "email_id")


@query("first_seen_slices", f"WITH {FIRST_SEEN} SELECT text_hash, event_id, us AS first_us FROM e WHERE gap IS NULL OR gap > 3")
def _first_slices(spark, sf):
    kept = first_seen(messages(spark, sf), "1 day", 3, key="event_id")
    return kept.select("text_hash", "event_id", F.unix_micros("received_at").alias("first_us"))


@query(
    "first_seen_stream",
    f"""WITH {FIRST_SEEN} SELECT text_hash, event_id, us AS first_us FROM e WHERE (gap IS NULL OR gap > 3)
    AND (slice + 1) * 86400000 < (SELECT epoch_ms(max(ts)) - 3600000 FROM events)""",
)
def _first_stream(spark, sf):
    """Slices closed by the watermark when the input ends."""
    kept = drained(first_seen(as_stream(messages(spark, sf), "messages"), "1 day", 3, key="event_id"), "first")
    return kept.select("text_hash", "event_id", F.unix_micros("received_at").alias("first_us"))


# Sessions by the time to the event before.
SESSIONS = """s AS (SELECT user_id, count(*) AS emails, CAST(round(epoch(min(ts)) * 1000000) AS BIGINT) AS session_start, CAST(round(epoch(max(ts)) * 1000000) AS BIGINT) + 1800000000 AS session_end
    FROM (SELECT *, sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no
      FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM e)) GROUP BY user_id, no)"""
# Half of the events go to one sender.
HOT = "e AS (SELECT event_id, ts, CASE WHEN event_id % 2 = 0 THEN -1 ELSE user_id END AS user_id FROM events)"


@query("sender_sessions", f"WITH e AS (SELECT * FROM events), {SESSIONS} SELECT * FROM s")
def _sessions(spark, sf):
    out = sender_sessions(events(spark, sf), "user_id", "30 minutes")
    return out.withColumns({c: F.unix_micros(c) for c in ("session_start", "session_end")})


def hot_sender(spark, sf) -> DataFrame:
    who = F.when(F.col("event_id") % 2 == 0, F.lit(-1)).otherwise(F.col("user_id"))
    return events(spark, sf).withColumn("user_id", who.cast("long"))


@query("sender_sessions_hot", f"WITH {HOT}, {SESSIONS} SELECT * FROM s")
def _sessions_hot(spark, sf):
    """One sender holds half of the events."""
    out = sender_sessions(hot_sender(spark, sf), "user_id", "30 minutes")
    return out.withColumns({c: F.unix_micros(c) for c in ("session_start", "session_end")})


@query(
    "sender_sessions_stream",
    f"""WITH {HOT}, {SESSIONS} SELECT * FROM s
    WHERE (session_end + 999) // 1000 < (SELECT epoch_ms(max(ts)) - 600000 FROM events)""",
)
def _sessions_stream(spark, sf):
    """Sessions closed by the watermark when the input ends."""
    out = drained(sender_sessions_stream(as_stream(hot_sender(spark, sf), "sessions"), "user_id", "30 minutes"), "sessions")
    return out.withColumns({c: F.unix_micros(c) for c in ("session_start", "session_end")})


@query(
    "windowed_verdicts_sliding_stream",
    """SELECT s AS window_start, event_type AS verdict, count(*) AS emails FROM
    (SELECT event_type, unnest([(CAST(floor(epoch(ts) / 1200) AS BIGINT) - k) * 1200 FOR k IN range(3)]) AS s FROM events)
    WHERE s + 3600 <= (SELECT epoch(max(ts)) - 600 FROM events) GROUP BY ALL""",
)
def _sliding_stream(spark, sf):
    """Sliding windows closed by the watermark when the input ends."""
    counted = windowed_verdicts(as_stream(events(spark, sf), "events"), "1 hour", "20 minutes", verdict="event_type")
    return drained(counted, "sliding").select(F.unix_seconds("window_start").alias("window_start"), "verdict", "emails")


@query("stream_equals_batch", "SELECT 0 AS differing")
def _same(spark, sf):
    """Rows in which the micro-batch run and the batch plan differ."""
    streamed = QUERIES["deep_score_batches"](spark, sf)
    batch = deep_analyze(emails(spark, sf), evidence(spark, sf), as_of=AS_OF).select(*streamed.columns)
    differing = streamed.exceptAll(batch).unionAll(batch.exceptAll(streamed))
    return differing.agg(F.count(F.lit(1)).cast("int").alias("differing"))
