"""Streams over several micro-batches: same rows as in batch, and state that ends."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from checks.streams import folder
from mailsieve.operators.urls import domain_facts
from mailsieve.plans.deep_analysis import Evidence
from mailsieve.plans.facts import FactStore, keys_of
from mailsieve.session import small_side
from mailsieve.streaming.jobs import first_seen, late_url_scores, sender_sessions, sender_sessions_stream

ZERO = dt.datetime(2026, 1, 1)


def arriving(spark, batches, schema):
    """One file per batch, read one at a time."""
    path = folder(spark, "arriving")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream):
    """All rows given out, and the state rows after each batch."""
    spark, out = stream.sparkSession, folder(stream.sparkSession, "given")
    job = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", folder(spark, "state")).trigger(availableNow=True).start()
    job.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in job.recentProgress if p["stateOperators"]]
    return spark.read.schema(stream.schema).parquet(out).collect(), states


def at(minutes):
    return ZERO + dt.timedelta(minutes=minutes)


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_of_late_rows(spark, seed):
    """Rows within the watermark join their sessions whatever batch they come in."""
    rng = random.Random(seed)
    rows = [(i, "hot" if i % 2 else f"s{i % 5}", at(rng.randint(0, 3000) + rng.random())) for i in range(400)]
    rows.sort(key=lambda r: r[2] + dt.timedelta(minutes=rng.randint(0, 50)))
    batches = [rows[i : i + 60] for i in range(0, len(rows), 60)] + [[(-1, "end", at(10_000))]]
    schema = "event_id int, user string, received_at timestamp"
    stream = sender_sessions_stream(arriving(spark, batches, schema), "user", "15 minutes", "1 hour")
    got, states = run(stream)
    table = spark.createDataFrame(rows, schema)
    want = sender_sessions(table, "user", "15 minutes").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert states[-1] == 1  # the open session of the last row


def test_sessions_by_hand(spark):
    """At the gap exactly, one cell, slice edges, a NULL sender and a NULL time."""
    minutes = [0, 10, 20, 30.5, 41, 63 * 10 + 9.5, 64 * 10 + 1, 65 * 10 + 12, 2000]
    rows = [("a", at(m)) for m in minutes] + [(None, at(5)), (None, at(6)), ("b", None)]
    out = sender_sessions(spark.createDataFrame(rows, "who string, received_at timestamp"), "who", "10 minutes")
    got = {(r.who, r.session_start, r.emails) for r in out.collect()}
    assert got == {("a", at(0), 3), ("a", at(30.5), 1), ("a", at(41), 1), ("a", at(639.5), 2), ("a", at(662), 1), ("a", at(2000), 1), (None, at(5), 2)}


def test_a_hot_sender_is_spread(spark):
    """Events combine below the first exchange, and its cells are dealt by slice."""
    rows = spark.range(200_000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 1000)).alias("who"),
        (F.lit(ZERO).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int") * 5)).alias("received_at"),
    )
    out = sender_sessions(rows, "who", "1 minute")
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    exchanges = [i for i, line in enumerate(plan) if "Exchange hashpartitioning" in line]
    assert exchanges and "HashAggregate" in plan[exchanges[-1] + 1] and "partial_min" in plan[exchanges[-1] + 1]
    assert any("hashpartitioning(sender" in plan[i] and "slice" in plan[i] for i in exchanges)
    hot = out.filter("who = 'hot'")
    assert hot.agg(F.sum("emails")).first()[0] == 100_000


def test_first_seen_forgets(spark):
    """Texts that stay away are dropped by the timer: state follows the texts of the last days."""
    batches = [[(100 * d + k, f"text {d} {k}" if k else "daily", at(1440 * d + 10 * k)) for k in range(20)] for d in range(12)]
    batches += [[(5000, "text 0 3", at(1440 * 12))], [(5001, "end", at(1440 * 60))]]
    schema = "email_id int, text string, received_at timestamp"
    rows = [r for b in batches for r in b]
    got, states = run(first_seen(arriving(spark, batches, schema), "1 day", 3))
    want = first_seen(spark.createDataFrame(rows, schema), "1 day", 3).filter(F.col("received_at") < F.lit(at(1440 * 59)))
    assert sorted((r.email_id, r.text_hash) for r in got) == sorted((r.email_id, r.text_hash) for r in want.collect())
    ids = {r.email_id for r in got}
    # The daily text counts once; a text that comes back after the remembered slices again.
    assert {i for i in ids if i % 100 == 0 and i < 1200} == {0} and 5000 in ids
    assert max(states) <= 6 * 20 and states[-1] <= 2


def test_first_seen_keeps_the_earliest_of_late_copies(spark):
    schema = "email_id int, text string, received_at timestamp"
    batches = [[(1, "x", at(50)), (2, None, at(5))], [(3, "x", at(20)), (4, "", at(1))], [(9, "end", at(9000))]]
    got, _ = run(first_seen(arriving(spark, batches, schema), "1 day", 2, watermark="2 hours"))
    assert {r.email_id for r in got} == {3, 4}


def test_late_evidence_changes_the_score(spark):
    """An observation two batches after the mail counts; one beyond the hour does not."""
    mails = [[(1, at(0), 0, "https://plain.example.org/a"), (2, at(1), 0, "https://plain.example.org/b")], [(3, at(30), 0, None)], [(9, at(5000), 0, "x")]]
    seen = [[("https://plain.example.org/b", at(-1), 9, 0, 1)], [("https://plain.example.org/a", at(40), 6, 1, 1)], [("https://plain.example.org/b", at(62), 9, 0, 1), ("y", at(5000), 0, 0, 1)]]
    kinds = "email_id int, received_at timestamp, pos int, url string", "url string, observed_at timestamp, malicious long, suspicious long, harmless long"
    got, states = run(late_url_scores(arriving(spark, mails, kinds[0]), arriving(spark, seen, kinds[1]), "1 hour", "2 hours"))
    rows = {r.email_id: r for r in got}
    assert rows.keys() == {1, 2, 3} and len(got) == 3
    assert rows[1].is_suspicious and rows[1].risk_score == 0.3 and rows[1].vt_malicious == 6
    assert rows[2].observed_at is None and rows[2].risk_score == 0.0 and rows[3].vt_malicious is None
    batch = late_url_scores(*[spark.createDataFrame([r for b in x for r in b], k) for x, k in zip((mails, seen), kinds)])
    assert sorted(map(str, got)) == sorted(str(r) for r in batch.filter("email_id <> 9").collect())


def test_fact_store_reads_the_keys_only(spark):
    store = FactStore(folder(spark, "facts"), 8)
    old = [(f"d{i}.org", at(0), at(-9000), f"r{i}") for i in range(200)]
    new = [(f"d{i}.org", at(10), at(-100), "moved") for i in range(0, 200, 2)] + [(None, at(0), at(0), "nobody")]
    kinds = "domain string, observed_at timestamp, creation_at timestamp, registrar string"
    for number, rows in ((0, old), (1, new), (1, new)):
        store.add(Evidence(registry=spark.createDataFrame(rows, kinds)), number)
    keys = keys_of(spark.createDataFrame([("https://d4.org/x",), ("http://d5.org",), ("http://unknown.org",), (None,)], "url string"))
    found = store.evidence(spark, keys)
    assert found.tls is None and found.pages is None and found.registry.columns == kinds.replace(",", "").split(" ")[::2]
    assert sorted((r.domain, r.registrar) for r in found.registry.collect()) == [("d4.org", "moved"), ("d4.org", "r4"), ("d5.org", "r5")]
    plan = found.registry._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "Broadcast" in plan
    facts = {r.domain: (r.domain_age_days, r.registrar) for r in domain_facts(found.registry, None, "2026-01-02T00:00:00Z").collect()}
    assert facts == {"d4.org": (1, "moved"), "d5.org": (7, "r5")}
    assert FactStore(folder(spark, "nothing")).evidence(spark, keys) == Evidence()


def test_small_side_counts_bytes(spark):
    few = spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("s"))
    hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hint(small_side(few)) and not hint(small_side(few, max_bytes=50_000)) and not hint(small_side(few, max_rows=99))
