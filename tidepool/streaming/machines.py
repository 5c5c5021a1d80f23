"""Keyed state machines on streams: histories of states with approval of doubtful ones, and ingest jobs with retries.

Both take two kinds of rows in one stream and emit a row for whatever they decide, so a sink of them is a log that can be
replayed. State is a few rows a key: the state that holds, what waits for the watermark, what waits for a decision.
Every access to it is a message to the JVM and every row in it is packed by itself, so a call reads and writes the state
that holds once, what a trigger brought waits as one row of arrays, and a key has a timer for the first of that, not one for
each row; when it fires, all that is due is applied, and the first of the rest has the next.

States: observations (id, value, t) wait until the watermark has passed t and are then applied in order of (t, id), so the
result doesn't depend on triggers, Arrow batches or the order of arrival within the delay. One that comes later than that
and lies before the state that holds is put aside as out_of_order, as is one that comes with a reason of its own. A
decision (approve, reject) settles what was put aside; what was out of order is approved without being applied.

Jobs: a request (session_id, commit_id) opens a job once; the same commit again is the same job, unless that isn't
finished and has no usable payload: then it is opened anew. Reports move a job through its stages; a failure is retried
after a time that doubles, by a processing-time timer, up to a number of attempts; a report of another stage or of an
earlier opening counts nothing.

Cases: rows without a key or id are dropped; repeats of an id that waits count once; decisions on unknown ids give
`unknown`; an observation without t counts at the time it comes with the watermark, as late.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_ROWS = "key string, id string, value string, t timestamp, status string, reason string, before string"
STATE_NAMES = ["key", "id", "value", "t", "status", "reason", "before"]
_EPOCH = datetime(1970, 1, 1)


def state_store(spark: SparkSession) -> None:
    """Keyed state machines keep several kinds of state, which only this store has."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _us(t: object) -> int | None:
    """Microseconds since 1970 of a timestamp that a pandas column holds."""
    return None if t is None or t is pd.NaT else int(pd.Timestamp(t).value // 1000)


def _packed(rows: list[tuple]) -> tuple:
    """Rows as one row of arrays."""
    return tuple(map(list, zip(*rows, strict=True)))


class States(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.holds = handle.getValueState("holds", "value string, since long, seen long")
        self.waits = handle.getListState("waits", "ids array<string>, values array<string>, times array<long>, reasons array<string>")
        self.aside = handle.getMapState("aside", "id string", "value string, t long, reason string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        mark = max(timerValues.getCurrentWatermarkInMs(), 0) * 1000
        fresh, decisions = [], []
        for part in rows:
            for kind, i, value, t, reason in zip(part["kind"], part["id"], part["value"], part["t"], part["reason"], strict=True):
                if i is None:
                    continue
                at = _us(t)
                (fresh if kind == "observation" else decisions).append((i, value, mark if at is None else at, reason))
        out: list[tuple] = []
        if fresh:
            self.waits.appendValue(_packed(fresh))
            self._wake(t for _, _, t, _ in fresh if t > mark)
        if any(t <= mark for _, _, t, _ in fresh):
            out += self._due(mark)
        for i, verdict, _, _ in decisions:
            out += self._decided(i, verdict)
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        if out := self._due(max(timerValues.getCurrentWatermarkInMs() * 1000, expiredTimerInfo.getExpiryTimeInMs() * 1000), True):
            yield self._rows(key, out)

    def _rows(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame([(key[0], *r) for r in out], columns=STATE_NAMES)
        made["t"] = pd.to_datetime(made["t"], unit="us")
        return made

    def _wake(self, times: Iterable[int]) -> None:
        if (first := min(times, default=None)) is not None:
            self.handle.registerTimer(-(-first // 1000))

    def _due(self, mark: int, fired: bool = False) -> list[tuple]:
        """A timer that fired leaves one for the first of what still waits."""
        rows = {r[0]: r for packed in self.waits.get() for r in zip(*packed, strict=True)}
        due = sorted((r for r in rows.values() if r[2] <= mark), key=lambda r: (r[2], r[0]))
        rest = [r for r in rows.values() if r[2] > mark]
        if fired:
            self._wake(r[2] for r in rest)
        if not due:
            return []
        if rest:
            self.waits.put([_packed(rest)])
        else:
            self.waits.clear()
        return self._observed(due)

    def _observed(self, rows: list[tuple]) -> list[tuple]:
        held = now = tuple(self.holds.get()) if self.holds.exists() else None
        out: list[tuple] = []
        for i, value, t, reason in rows:
            late = not reason and now is not None and t < now[1]
            if reason or late:
                reason = reason or "out_of_order"
                self.aside.updateValue((i,), (value, t, reason))
                out.append((i, value, t, "pending", reason, None))
            elif now is None:
                now = (value, t, t)
                out.append((i, value, t, "created", None, None))
            elif value == now[0]:
                now = (value, now[1], t)
                out.append((i, value, t, "touched", None, None))
            else:
                out.append((i, value, t, "updated", None, now[0]))
                now = (value, t, t)
        if now != held:
            self.holds.update(now)
        return out

    def _decided(self, i: str, verdict: str) -> list[tuple]:
        if not self.aside.containsKey((i,)):
            return [(i, None, None, "unknown", verdict, None)]
        value, t, reason = tuple(self.aside.getValue((i,)))
        self.aside.removeKey((i,))
        if verdict != "approve":
            return [(i, value, t, "rejected", reason, None)]
        out = [(i, value, t, "approved", reason, None)]
        return out if reason == "out_of_order" else [*out, *self._observed([(i, value, t, None)])]

    def close(self) -> None:
        pass



def state_log(observations: DataFrame, decisions: DataFrame | None = None, delay: str = "1 hour") -> DataFrame:
    """What becomes of each observation (key, id, value, t; reason, where it is to wait) and of each decision (key, id, decision).

    Rows: key, id, value, t, status (created, touched, updated, pending, approved, rejected, unknown), reason, before."""
    state_store(observations.sparkSession)
    own = observations.withColumn("reason", F.col("reason") if "reason" in observations.columns else F.lit(None).cast("string"))
    # the watermark is taken from a copy of t that isn't kept, so late rows reach the machine instead of being dropped
    rows = own.withColumn("_mark", F.col("t")).withWatermark("_mark", delay).select(F.col("key").cast("string").alias("key"), F.lit("observation").alias("kind"), F.col("id").cast("string").alias("id"), F.col("value").cast("string").alias("value"), F.col("t").cast("timestamp").alias("t"), "reason")
    if decisions is not None:
        more = decisions.select(F.col("key").cast("string").alias("key"), F.lit("decision").alias("kind"), F.col("id").cast("string").alias("id"), F.col("decision").alias("value"), F.lit(None).cast("timestamp").alias("t"), F.lit(None).cast("string").alias("reason"))
        rows = rows.unionByName(more)
    return rows.filter("key IS NOT NULL").groupBy("key").transformWithStateInPandas(States(), STATE_ROWS, "Append", "EventTime")


STAGES = ["stage2", "stage3"]
MOST_ATTEMPTS, FIRST_WAIT_S = 3, 30.0
JOB_ROWS = "session_id string, commit_id string, job string, status string, stage string, attempt int, error string, at timestamp"
JOB_NAMES = ["session_id", "commit_id", "job", "status", "stage", "attempt", "error", "at"]


class Jobs(StatefulProcessor):
    """A job: RECEIVED; then for each stage <STAGE>_RUNNING, and <STAGE>_FAILED until its next attempt; COMPLETED, or FAILED after the last one."""

    def __init__(self, stages: list[str], attempts: int, wait_s: float) -> None:
        self.stages, self.attempts, self.wait_s = stages, attempts, wait_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "opened int, status string, stage int, attempt int, usable boolean, retry long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        out: list[tuple] = []
        inputs = [r for part in rows for r in zip(part["kind"], part["job"], part["stage"], part["ok"], part["usable"], part["error"], strict=True)]
        for kind, job, stage, ok, usable, error in sorted(inputs, key=lambda r: r[0] != "request"):
            out += self._asked(bool(usable)) if kind == "request" else self._told(key, job, stage, bool(ok), error, now)
        yield self._rows(key, out, now)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        out: list[tuple] = []
        if self.job.exists():
            opened, status, stage, attempt, usable, retry = tuple(self.job.get())
            if status.endswith("_FAILED") and retry <= expiredTimerInfo.getExpiryTimeInMs():
                out.append(self._runs(opened, stage, attempt + 1, usable))
        yield self._rows(key, out, now)

    def _rows(self, key: tuple, out: list[tuple], now: int) -> pd.DataFrame:
        at = _EPOCH + timedelta(milliseconds=now)
        return pd.DataFrame([(key[0], key[1], f"{key[0]}:{key[1]}:{opened}", *r, at) for opened, *r in out], columns=JOB_NAMES)

    def _runs(self, opened: int, stage: int, attempt: int, usable: bool) -> tuple:
        status = f"{self.stages[stage].upper()}_RUNNING"
        self.job.update((opened, status, stage, attempt, usable, 0))
        return opened, status, self.stages[stage], attempt, None

    def _asked(self, usable: bool) -> list[tuple]:
        opened = 1
        if self.job.exists():
            opened, status, stage, attempt, had, _ = tuple(self.job.get())
            if status == "COMPLETED" or had:
                return [(opened, "KNOWN", None, attempt, status)]
            opened += 1
        return [(opened, "RECEIVED", None, 0, None), self._runs(opened, 0, 1, usable)]

    def _told(self, key: tuple, job: str, name: str, ok: bool, error: str | None, now: int) -> list[tuple]:
        if not self.job.exists():
            return []
        opened, status, stage, attempt, usable, _ = tuple(self.job.get())
        if job != f"{key[0]}:{key[1]}:{opened}" or status != f"{name.upper()}_RUNNING":
            return []
        if ok and stage + 1 < len(self.stages):
            return [self._runs(opened, stage + 1, 1, usable)]
        if ok:
            self.job.update((opened, "COMPLETED", stage, attempt, usable, 0))
            return [(opened, "COMPLETED", name, attempt, None)]
        if attempt >= self.attempts:
            self.job.update((opened, "FAILED", stage, attempt, usable, 0))
            return [(opened, "FAILED", name, attempt, error)]
        retry = now + int(self.wait_s * 1000 * 2 ** (attempt - 1))
        self.handle.registerTimer(retry)
        self.job.update((opened, f"{name.upper()}_FAILED", stage, attempt, usable, retry))
        return [(opened, f"{name.upper()}_FAILED", name, attempt, error)]

    def close(self) -> None:
        pass


def job_log(requests: DataFrame, reports: DataFrame, stages: list[str] | None = None, attempts: int = MOST_ATTEMPTS, wait_s: float = FIRST_WAIT_S) -> DataFrame:
    """Every step of each job, from requests (session_id, commit_id, users, turns) and reports of workers (session_id, commit_id, job, stage, ok, error).

    A row with a status of <STAGE>_RUNNING asks a worker to run that stage; its report names the job. users and turns are arrays of strings:
    a payload is usable if both have one that isn't blank. KNOWN: the job was there already; `error` is its status."""
    state_store(requests.sparkSession)
    full = lambda c: F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.coalesce(F.btrim(x) != "", F.lit(False)))
    none = lambda kind: F.lit(None).cast(kind)
    first = requests.select("session_id", "commit_id", F.lit("request").alias("kind"), none("string").alias("job"), none("string").alias("stage"), none("boolean").alias("ok"), (full(F.col("users")) & full(F.col("turns"))).alias("usable"), none("string").alias("error"))
    second = reports.select("session_id", "commit_id", F.lit("report").alias("kind"), "job", "stage", "ok", none("boolean").alias("usable"), "error")
    rows = first.unionByName(second).filter("session_id IS NOT NULL AND commit_id IS NOT NULL")
    return rows.groupBy("session_id", "commit_id").transformWithStateInPandas(Jobs(stages or STAGES, attempts, wait_s), JOB_ROWS, "Append", "ProcessingTime")
