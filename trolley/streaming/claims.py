"""The outbox as a live stream: the state of each change record, with timers that bring back what waits or is stuck.

Messages (record_id, product_id, kind, at, error) are `change` (a new record), `claim`, `ok` and `failed`. A claim takes a pending record
whose pause is over; a failure sends it back with a pause; a claim without a result for a while is stale and the record is pending again. All is
kept by record (in buckets of records), so two records of one product don't touch each other. What is due before a message is done before it, whether the timer or the message comes
first, so the rows don't depend on how messages fall into micro-batches, as long as those of a record come in order.

A record's state goes when it is processed. Claims and results of records that aren't open are ignored, as are claims of records that are
not to be had; a second `change` of an open record too. Messages of one time go as change, ok, failed, claim. Null ids are one record; rows without a time are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MESSAGES = "record_id long, product_id long, kind string, at timestamp, error string"
ROWS = "record_id long, product_id long, reason string, status string, attempts int, at timestamp, backoff_until timestamp, last_error string, seq long"
KINDS = ("change", "ok", "failed", "claim")
STATE = "record_id array<long>, product_id array<long>, status array<string>, attempts array<int>, started array<long>, pause array<long>, last_error array<string>, seq array<long>"
_NAMES = [c.split(" ")[0] for c in ROWS.split(", ")]
_KEPT = [c.split(" ")[0] for c in STATE.split(", ")][1:]


class Records(StatefulProcessor):
    """Rows of what happens to the records of a bucket; times are microseconds.

    The state is the bucket's open records, a column an array, read and written once a batch as one value; a bucket's next timer is that of its first record that is due.
    """

    def __init__(self, backoff_seconds: int, stale_minutes: int, longest_error: int = 500):
        self.backoff, self.stale, self.longest_error = backoff_seconds * 1_000_000, stale_minutes * 60_000_000, longest_error

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("records", STATE)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        messages = pd.concat(list(rows))
        order = messages["kind"].map({k: i for i, k in enumerate(KINDS)})
        messages = messages[order.notna()].assign(order=order).sort_values(["at", "order"], kind="stable")
        records, out = self._read(), []
        whole = lambda c: [None if x is pd.NA else x for x in messages[c].astype("Int64")]
        times = (messages["at"].astype("datetime64[us]").astype("int64")).tolist()
        errors = [x if isinstance(x, str) else None for x in messages["error"]]
        for record, product, kind, at, error in zip(whole("record_id"), whole("product_id"), messages["kind"], times, errors, strict=True):
            now = records.get(record)
            if now and (due := self._due(now)) is not None and due <= at:
                self._expire(record, now, due, out)
            if now:
                self._apply(record, now, kind, error, at, out)
                if now["status"] == "processed":
                    del records[record]
            elif kind == "change":
                now = records[record] = dict(zip(_KEPT, (product, "pending", 0, None, None, None, 0), strict=True))
                self._say(record, now, "created", at, out)
        self._write(records)
        yield self._frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        records, out = self._read(), []
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        if (mark := timerValues.getCurrentWatermarkInMs()) is not None:
            until = max(until, mark * 1000)
        for record, now in records.items():
            if (due := self._due(now)) is not None and due <= until:
                self._expire(record, now, due, out)
        if out:
            self._write(records)
        yield self._frame(out)

    def _due(self, now: dict) -> int | None:
        """When the record comes back by itself, if it does."""
        return now["started"] + self.stale if now["status"] == "processing" else now["pause"]

    def _expire(self, record: int | None, now: dict, at: int, out: list) -> None:
        reason = "reset" if now["status"] == "processing" else "ready"
        now.update(status="pending", started=None, pause=None)
        self._say(record, now, reason, at, out)

    def _apply(self, record: int | None, now: dict, kind: str, error: str | None, at: int, out: list) -> None:
        if kind == "claim" and now["status"] == "pending" and now["pause"] is None:
            now.update(status="processing", attempts=now["attempts"] + 1, started=at)
            self._say(record, now, "claimed", at, out)
        elif kind == "failed":
            now.update(status="pending", started=None, pause=at + self.backoff, last_error=None if error is None else error[: self.longest_error])
            self._say(record, now, "failed", at, out)
        elif kind == "ok":
            now.update(status="processed", started=None, pause=None, last_error=None)
            self._say(record, now, "processed", at, out)

    def _say(self, record: int | None, now: dict, reason: str, at: int, out: list) -> None:
        now["seq"] += 1
        out.append((record, now["product_id"], reason, now["status"], now["attempts"], at, now["pause"], now["last_error"], now["seq"]))

    def _frame(self, out: list) -> pd.DataFrame:
        columns = dict(zip(_NAMES, zip(*out, strict=True), strict=True)) if out else {c: () for c in _NAMES}
        kinds = {"record_id": "Int64", "product_id": "Int64", "attempts": "int32", "seq": "int64"}
        made = {c: pd.Series(list(columns[c]), dtype=kinds.get(c, "object")) for c in _NAMES}
        for c in ("at", "backoff_until"):
            made[c] = pd.Series(pd.array(list(columns[c]), dtype="Int64").to_numpy("int64", na_value=pd.NaT.value).view("datetime64[us]")).astype("datetime64[ns]")
        return pd.DataFrame(made)

    def _read(self) -> dict:
        """The open records by id, each as a dict of what is kept of it."""
        return {row[0]: dict(zip(_KEPT, row[1:], strict=True)) for row in zip(*self.state.get(), strict=True)} if self.state.exists() else {}

    def _write(self, records: dict) -> None:
        if not records:
            self.state.clear()
            return
        self.state.update((list(records), *([now[c] for now in records.values()] for c in _KEPT)))
        if (first := min((due for now in records.values() if (due := self._due(now)) is not None), default=None)) is not None:
            self.handle.registerTimer(-(-first // 1000))


def stream_claims(messages: DataFrame, backoff_seconds: int = 60, stale_minutes: int = 5, late: str = "0 seconds", buckets: int = 1024) -> DataFrame:
    """A stream of messages to a stream of what happens to the records (ROWS); seq numbers a record's rows.

    Records are kept in `buckets` by hash, since each key of a state costs about as much as hundreds of messages; the number can't change while a
    checkpoint is used. Timers go by the time of the messages. The session's state store must be RocksDB (`state_store`).
    """
    timed = messages.select("record_id", "product_id", "kind", "at", "error").where("at is not null").withWatermark("at", late)
    return timed.withColumn("bucket", F.pmod(F.xxhash64("record_id"), F.lit(buckets))).groupBy("bucket").transformWithStateInPandas(Records(backoff_seconds, stale_minutes), ROWS, "Append", "EventTime")


#: What the session needs for states with timers.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def current_records(rows: DataFrame) -> DataFrame:
    """The newest row of each record."""
    names = [c for c in _NAMES if c not in ("record_id", "seq")]
    newest = rows.groupBy("record_id").agg(F.max_by(F.struct(*names), "seq").alias("r"))
    return newest.select("record_id", "r.*")
