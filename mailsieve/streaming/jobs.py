"""Streaming forms of the layers: the same transformations on unbounded tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mailsieve.operators.scoring import RuleScorer
from mailsieve.operators.urls import score_urls
from mailsieve.operators.verdicts import aggregate_risk
from mailsieve.plans.deep_analysis import Evidence, deep_analyze, mail_layers, url_rows
from mailsieve.plans.facts import FactStore, keys_of
from mailsieve.rules.verdicts import LAYER_WEIGHTS
from mailsieve.session import written


def score_stream(stream: DataFrame, scorer=None, as_of: str = "") -> DataFrame:
    """Verdict from text, sender and headers for each arriving email.

    Stateless: no shuffle, no state store; append output.
    """
    layers = mail_layers_with_time(stream, scorer or RuleScorer(), as_of)
    ran = {
        "headers_risk": F.col("headers.risk_score"),
        "sender_risk": F.col("sender_check.risk_score"),
        "is_ai_generated": F.col("authorship.is_ai_generated"),
    }
    missing = {
        f"{layer}_risk": F.lit(None).cast("double")
        for layer in LAYER_WEIGHTS
        if f"{layer}_risk" not in ran and layer != "text"
    }
    return aggregate_risk(layers.withColumns({**ran, **missing}))


def mail_layers_with_time(stream: DataFrame, scorer, as_of: str) -> DataFrame:
    """mail_layers, keeping received_at for event-time operators."""
    keyed = stream.withColumn("email_id", F.struct("email_id", "received_at"))
    layers = mail_layers(keyed, scorer, as_of)
    return layers.withColumn("received_at", F.col("email_id.received_at")).withColumn(
        "email_id", F.col("email_id.email_id")
    )


def deep_score_batches(
    stream: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    evidence: Evidence | FactStore | None = None,
    scorer=None,
    as_of: str = "",
    trigger: dict | None = None,
) -> StreamingQuery:
    """All layers per micro-batch, for the layers that join and group.

    With a FactStore a micro-batch reads the evidence on its own URLs and domains only, as
    far as it has been added by then; with tables it looks through all of them.

    sink gets the rows and the number of the batch; a batch that is tried again has the
    same number, so a sink that writes under it never doubles rows. trigger holds the
    arguments of DataStreamWriter.trigger; by default what is there is read once.
    """

    def run(batch: DataFrame, number: int) -> None:
        found = evidence
        if isinstance(evidence, FactStore):
            keys = written(keys_of(url_rows(batch)), "batch-keys")
            found = evidence.evidence(batch.sparkSession, keys)
        sink(deep_analyze(batch, found, scorer, as_of), number)

    writer = stream.writeStream.foreachBatch(run).trigger(**(trigger or {"availableNow": True}))
    return writer.option("checkpointLocation", checkpoint).start()


def timed_urls(emails: DataFrame) -> DataFrame:
    """email_id, received_at, pos and url: one row per URL. Narrow, batch or stream."""
    keyed = emails.withColumn("email_id", F.struct("email_id", "received_at"))
    return url_rows(keyed).select("email_id.email_id", "email_id.received_at", "pos", "url")


def late_url_scores(
    urls: DataFrame, reputation: DataFrame, within: str = "1 hour", watermark: str = "10 minutes", strict_brands: bool = False
) -> DataFrame:
    """Scores of URLs with the vendor counts that come in after the mail.

    urls has email_id, received_at, pos and url, reputation has url, observed_at, malicious,
    suspicious and harmless; both tables or both streams. A row per observation of the URL
    from received_at until within, or one row with NULL counts if none came. A stream keeps
    a mail until the watermark has passed its time, and an observation as long as a mail it
    belongs to can still come; rows behind the watermark drop. NULL URLs meet nothing.

    Time is cut into slices of at least within. A mail looks into its own slice, and an
    observation stands in its own and the one before, so they meet once, and a URL that is
    always there is many groups instead of one in which all mails meet all observations.
    """
    # An eighth more, as months differ in length.
    width = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {within}")) * 9 / 8 + 1

    def place(at: str) -> Column:
        return F.floor(F.unix_micros(at) / F.floor(width)).cast("long")

    mails = urls.withColumnRenamed("url", "mail_url").withColumn("mail_slice", place("received_at")).withWatermark("received_at", watermark)
    seen = reputation.select(
        F.col("url").alias("seen_url"), "observed_at", F.col("malicious").alias("vt_malicious"), F.col("suspicious").alias("vt_suspicious"), F.col("harmless").alias("vt_harmless"),
        F.explode(F.array(place("observed_at"), place("observed_at") - 1)).alias("seen_slice"),
    ).withWatermark("observed_at", watermark)
    near = (
        (F.col("mail_url") == F.col("seen_url"))
        & (F.col("mail_slice") == F.col("seen_slice"))
        & (F.col("observed_at") >= F.col("received_at"))
        & (F.col("observed_at") <= F.col("received_at") + F.expr(f"INTERVAL {within}"))
    )
    rows = mails.join(seen, near, "left").withColumnRenamed("mail_url", "url").drop("seen_url")
    scored = score_urls(rows, strict_brands)
    return scored.select("email_id", "received_at", "pos", "url", "observed_at", "vt_malicious", "vt_suspicious", "domain", "risk_score", "is_suspicious", "flags")


def windowed_verdicts(
    scored: DataFrame, window: str, slide: str | None = None, watermark: str = "10 minutes",
    at: str = "received_at", verdict: str = "overall_verdict",
) -> DataFrame:
    """Counts per verdict in tumbling or sliding windows; rows behind the watermark drop.

    Counts are combined before the shuffle, so a busy window does not load one task.
    """
    span = F.window(at, window, slide) if slide else F.window(at, window)
    return (
        scored.withWatermark(at, watermark)
        .groupBy(span.alias("w"), F.col(verdict).alias("verdict"))
        .agg(F.count(F.lit(1)).alias("emails"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "verdict",
            "emails",
        )
    )


def first_seen(
    stream: DataFrame, slice: str = "1 day", remember: int = 30, watermark: str = "1 hour",
    at: str = "received_at", key: str = "email_id", text: str = "text",
) -> DataFrame:
    """text_hash, key and at of the first copy of each text; batch or stream.

    Time is cut into slices. The earliest copy of a slice (ties go to the smallest key) is a
    first one if the text was in none of the remember slices before. Only digests, keys and
    times travel: copies combine before the shuffle, so a text sent to everyone is one row a
    task and slice. A stream holds the first copy per text and open slice and one number per
    text, which a timer drops once the text has been absent for so long; slices close with
    the watermark, and rows behind it drop. A NULL text counts as an empty one, a row without
    a time is left out.
    """
    width = _micros(slice)
    rows = stream.filter(F.col(at).isNotNull()).select(
        F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_hash"), F.floor(F.unix_micros(at) / F.lit(width)).cast("long").alias("slice"),
        F.unix_micros(at).alias("us"), F.col(key).alias("key"),
    )
    if stream.isStreaming:
        return _first_seen_stream(rows, width, remember, watermark, at, key)
    found = rows.groupBy("text_hash", "slice").agg(F.min(F.struct("us", "key")).alias("first"))
    before = F.lag("slice").over(Window.partitionBy("text_hash").orderBy("slice"))
    kept = found.withColumn("gap", F.col("slice") - before).filter(F.col("gap").isNull() | (F.col("gap") > remember))
    return kept.select("text_hash", F.col("first.key").alias(key), F.timestamp_micros("first.us").alias(at))


def _first_seen_stream(rows: DataFrame, width: int, remember: int, watermark: str, at: str, key: str) -> DataFrame:
    kind = rows.schema["key"].dataType.simpleString()

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by([("us", "ascending"), ("key", "ascending")])
            first = table.group_by(["text_hash", "slice"], use_threads=False).aggregate([("us", "first"), ("key", "first")])
            yield from first.rename_columns({"us_first": "us", "key_first": "key"}).select(["text_hash", "slice", "us", "key"]).to_batches()

    def step(hashed: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, open_slices = None, {}
        if state.exists:
            last, *held = state.get
            open_slices = {s: (us, k) for s, us, k in zip(*map(list, held))}
        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.slice not in open_slices or (row.us, row.key) < open_slices[row.slice]:
                    open_slices[row.slice] = (row.us, row.key)
        now, out = state.getCurrentWatermarkMs(), []
        for s in sorted(s for s in open_slices if (s + 1) * width // 1000 < now):
            us, k = open_slices.pop(s)
            if last is None or s - last > remember:
                out.append((hashed[0], k, us))
            last = s if last is None else max(s, last)
        # The next slice to close, or the end of the last one in which a copy would be a later one.
        wake = (min(open_slices) + 1 if open_slices else last + remember + 1) * width // 1000
        if not open_slices and wake < now:
            state.remove()
        else:
            slices = sorted(open_slices)
            state.update((last, slices, [open_slices[s][0] for s in slices], [open_slices[s][1] for s in slices]))
            state.setTimeoutTimestamp(max(wake, now + 1))
        yield pd.DataFrame(out, columns=["text_hash", key, at])

    # withWatermark needs a time; a combined row has the time of its first copy.
    cells = rows.mapInArrow(combine, f"text_hash string, slice long, us long, key {kind}").withColumn("at", F.timestamp_micros("us"))
    found = cells.withWatermark("at", watermark).groupBy("text_hash").applyInPandasWithState(
        step, f"text_hash string, {key} {kind}, {at} long", f"last long, slices array<long>, firsts array<long>, keys array<{kind}>", "append", GroupStateTimeout.EventTimeTimeout
    )
    return found.withColumn(at, F.timestamp_micros(at))


def _micros(duration: str) -> int:
    """Microseconds of a duration of days or shorter units, as in '30 minutes'."""
    n, unit = duration.split()
    return int(n) * {"second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}[unit.rstrip("s")]


def _cells(events: DataFrame, sender: str, gap: int, at: str) -> DataFrame:
    """sender, cell, lo, hi and n: events within one stretch of the gap's length are less than
    the gap apart, so they are always of one session and combine before the shuffle."""
    micros = F.unix_micros(at)
    rows = events.select(F.col(sender).alias("sender"), micros.alias("at"), F.floor(micros / F.lit(gap)).cast("long").alias("cell"))
    return rows.filter("at IS NOT NULL").groupBy("sender", "cell").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count(F.lit(1)).alias("n"))


def _islands(rows: DataFrame, gap: int, *keys: str) -> DataFrame:
    """Adds island: the number of the session among the rows of the keys, by time."""
    order = Window.partitionBy(*keys).orderBy("lo")
    apart = F.coalesce(F.col("lo") - F.lag("hi").over(order) > gap, F.lit(True))
    return rows.withColumn("apart", apart).withColumn("island", F.sum(F.col("apart").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


SLICE = 64


def sender_sessions(events: DataFrame, sender: str, gap: str, at: str = "received_at") -> DataFrame:
    """Bursts of activity per sender, closed after a gap: sender, session_start, session_end
    (the last event plus the gap) and emails.

    Events meet in cells of the gap's length before the shuffle, cells in slices of SLICE
    cells, each a group of its own, and only sessions that touch a slice's edge are looked
    at per sender: two rows a slice at most. So one sender's events are spread over as many
    tasks as there are slices. A NULL sender is one more sender, a NULL time no event.
    """
    width = _micros(gap)
    cells = _cells(events, sender, width, at).withColumn("slice", F.floor(F.col("cell") / SLICE))
    parts = _islands(cells, width, "sender", "slice").groupBy("sender", "slice", "island").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.min("cell").alias("first"), F.max("cell").alias("last")
    )
    edge = (F.col("first") == F.col("slice") * SLICE) | (F.col("last") == F.col("slice") * SLICE + (SLICE - 1))
    inner = parts.filter(~edge).select("sender", "lo", "hi", "n")
    joined = _islands(parts.filter(edge).select("sender", "lo", "hi", "n"), width, "sender").groupBy("sender", "island")
    whole = inner.unionAll(joined.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).drop("island"))
    return whole.select(
        F.col("sender").alias(sender), F.timestamp_micros("lo").alias("session_start"),
        F.timestamp_micros(F.col("hi") + width).alias("session_end"), F.col("n").alias("emails"),
    )


def sender_sessions_stream(
    events: DataFrame, sender: str, gap: str, watermark: str = "10 minutes", at: str = "received_at"
) -> DataFrame:
    """sender_sessions of a stream; a session is given out once no event can join it.

    Events meet in cells before the shuffle, so a busy sender sends a row per task and cell.
    Each sender keeps its open sessions: those that end after the watermark, so their number
    is bounded by its delay. A timer gives them out. Rows without a time are left out.
    """
    width = _micros(gap)
    micros = F.unix_micros(at)
    rows = events.filter(F.col(at).isNotNull()).select(F.col(sender).alias("sender"), F.floor(micros / F.lit(width)).cast("long").alias("cell"), micros.alias("us"))
    kind = rows.schema["sender"].dataType.simpleString()

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = pa.Table.from_batches([batch]).group_by(["sender", "cell"]).aggregate([("us", "min"), ("us", "max"), ("us", "count")])
            yield from cells.select(["sender", "us_min", "us_max", "us_count"]).rename_columns(["sender", "lo", "hi", "n"]).to_batches()

    def step(who: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [list(x) for x in zip(*state.get)] if state.exists else []
        for frame in frames:
            parts += frame[["lo", "hi", "n"]].to_numpy().tolist()
        sessions: list[list[int]] = []
        for lo, hi, n in sorted(parts):
            if sessions and lo - sessions[-1][1] <= width:
                sessions[-1][1] = max(sessions[-1][1], hi)
                sessions[-1][2] += n
            else:
                sessions.append([lo, hi, n])
        now, ends = state.getCurrentWatermarkMs(), [-(-(hi + width) // 1000) for _, hi, _ in sessions]
        done = [x for x, end in zip(sessions, ends) if end < now]
        left = [x for x, end in zip(sessions, ends) if end >= now]
        if left:
            state.update(tuple(map(list, zip(*left))))
            state.setTimeoutTimestamp(max(now + 1, min(end for end in ends if end >= now)))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(who[0], lo, hi + width, n) for lo, hi, n in done], columns=[sender, "session_start", "session_end", "emails"])

    cells = rows.mapInArrow(combine, f"sender {kind}, lo long, hi long, n long").withColumn("at", F.timestamp_micros("hi"))
    out = cells.withWatermark("at", watermark).groupBy("sender").applyInPandasWithState(
        step, f"{sender} {kind}, session_start long, session_end long, emails long", "los array<long>, his array<long>, ns array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )
    return out.withColumns({c: F.timestamp_micros(c) for c in ("session_start", "session_end")})
