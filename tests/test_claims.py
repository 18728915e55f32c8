"""The live outbox: whatever the micro-batches, the rows of a record are those of its messages in order of time."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trolley.operators import curation
from trolley.streaming import claims

START = datetime(2024, 1, 1)


def plain(messages, end):
    """reason, attempts and second of what happens to each record until `end`."""
    out = {}
    for record in sorted({m[0] for m in messages}):
        now, log = None, []

        def due():
            return None if not now else now["started"] + 300 if now["status"] == "processing" else now["pause"]

        def catch_up(to):
            while (at := due()) is not None and at <= to:
                log.append(("reset" if now["status"] == "processing" else "ready", now["attempts"], at))
                now.update(status="pending", pause=None)

        for _, _, kind, at, _ in sorted((m for m in messages if m[0] == record), key=lambda m: (m[3], ["change", "ok", "failed", "claim"].index(m[2]))):
            catch_up(at)
            if kind == "change" and not now:
                now = {"status": "pending", "attempts": 0, "pause": None, "started": 0}
                log.append(("created", 0, at))
            elif kind == "claim" and now and now["status"] == "pending" and now["pause"] is None:
                now.update(status="processing", attempts=now["attempts"] + 1, started=at)
                log.append(("claimed", now["attempts"], at))
            elif kind == "failed" and now:
                now.update(status="pending", pause=at + 60)
                log.append(("failed", now["attempts"], at))
            elif kind == "ok" and now:
                log.append(("processed", now["attempts"], at))
                now = None
        catch_up(end)
        out[record] = log
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_rows_do_not_depend_on_batches(spark, tmp_path, batches):
    rng = random.Random(batches)
    messages = []
    for record in range(40):
        at = rng.randrange(100)
        messages.append((record, record % 7, "change", at, None))
        for _ in range(rng.randrange(7)):
            at += rng.choice([0, 10, 59, 60, 61, 299, 300, 400])
            messages.append((record, record % 7, rng.choice(["claim", "claim", "ok", "failed"]), at, "x" * 600))
    spark.conf.set(*claims.STATE_STORE)
    end = max(m[3] for m in messages) + 1000
    steps = sorted(messages, key=lambda m: m[3])
    size = -(-len(steps) // batches)
    # a record's messages of one second stay together
    cuts = [0]
    for k in range(1, batches):
        at = max(k * size, cuts[-1])
        while at < len(steps) and steps[at][3] == steps[at - 1][3]:
            at += 1
        cuts.append(at)
    parts = [steps[a:b] for a, b in zip(cuts, [*cuts[1:], len(steps)], strict=True)] + [[(99, None, "end", end, None)]]
    for part in parts:
        rows = [(r, p, k, START + timedelta(seconds=s), e) for r, p, k, s, e in part]
        spark.createDataFrame(rows, claims.MESSAGES).write.mode("append").parquet(f"{tmp_path}/in")
        live = claims.stream_claims(spark.readStream.schema(claims.MESSAGES).parquet(f"{tmp_path}/in"))
        live.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
    spark.conf.unset(claims.STATE_STORE[0])
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/out").orderBy("record_id", "at", "seq").collect():
        got.setdefault(r.record_id, []).append((r.reason, r.attempts, int((r.at - START).total_seconds())))
        assert r.product_id == r.record_id % 7 and len(r.last_error or "") <= 500
    assert got == plain(messages, end)


def test_state_is_kept_by_bucket(spark, tmp_path):
    """Two records of a bucket don't touch each other, and there are no more keys of state than buckets."""
    spark.conf.set(*claims.STATE_STORE)
    rows = [(r, 7, kind, START + timedelta(seconds=s), None) for r in range(60) for kind, s in [("change", r), ("claim", r + 60)][: 1 + r % 2]] + [(None, 8, "change", START, None)]
    spark.createDataFrame(rows, claims.MESSAGES).write.parquet(f"{tmp_path}/in")
    live = claims.stream_claims(spark.readStream.schema(claims.MESSAGES).parquet(f"{tmp_path}/in"), buckets=3)
    query = live.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    spark.conf.unset(claims.STATE_STORE[0])
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators) <= 3
    got = sorted((r.record_id if r.record_id is not None else -1, r.seq, r.reason, r.product_id) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted([(r, 1, "created", 7) for r in range(60)] + [(r, 2, "claimed", 7) for r in range(1, 60, 2)] + [(-1, 1, "created", 8)])


def test_two_records_of_one_product(spark):
    changes = spark.createDataFrame([(1, 7, "create"), (2, 7, "update"), (3, 8, "update")], "record_id long, product_id long, intent string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    results = spark.createDataFrame([(1, True, None), (2, False, "timeout"), (2, False, "again")], "record_id long, ok boolean, error string")
    got = {r.record_id: (r.status, r.attempts, r.last_error) for r in curation.claim_state(curation.change_rows(changes), results, "2024-01-02 00:00:00").collect()}
    assert got == {1: ("processed", 1, None), 2: ("pending", 1, "again"), 3: ("pending", 0, None)}
