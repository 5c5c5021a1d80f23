"""Keyed state machines on streams."""

import random
import time
from collections import Counter
from datetime import UTC, datetime, timedelta

import pandas as pd
import pytest

from tidepool.streaming import machines

T0 = datetime(2024, 1, 1)
OBS = "key string, id string, value string, t timestamp, reason string"


def feed(spark, folder, parts, schema):
    """Files that a stream takes one by one."""
    folder.mkdir(exist_ok=True)
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{len(list(folder.iterdir())):05d}-{n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def run(log, tmp_path):
    q = log.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return log.sparkSession.read.schema(log.schema).parquet(str(tmp_path / "out"))


def brute(rows):
    """Observations in order of time."""
    now, out = {}, []
    for key, i, value, t, reason in sorted(rows, key=lambda r: (r[3], r[1])):
        if reason:
            out.append((key, i, "pending", None))
        elif key not in now:
            out.append((key, i, "created", None))
            now[key] = value
        elif now[key] == value:
            out.append((key, i, "touched", None))
        else:
            out.append((key, i, "updated", now[key]))
            now[key] = value
    return Counter(out)


END = ("zz", "end", "x", T0 + timedelta(days=400), None)


@pytest.mark.parametrize(("files", "batch", "seed"), [(1, 10, 0), (6, 3, 1), (3, 10_000, 2)])
def test_states_dont_depend_on_batches_or_order(spark, tmp_path, files, batch, seed):
    """A hundred observations of a key in one trigger, small Arrow batches, files in any order within the delay."""
    rng = random.Random(seed)
    rows = [(f"k{i % 3 if i % 2 else 0}", f"{i:04d}", rng.choice("abc"), T0 + timedelta(minutes=rng.randrange(300)), "doubt" if i % 37 == 5 else None) for i in range(240)]
    rows += rows[:5]  # repeats
    rng.shuffle(rows)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = run(machines.state_log(feed(spark, tmp_path / "in", [*(rows[i::files] for i in range(files)), [END], [END]], OBS), delay="6 hours"), tmp_path).filter("key <> 'zz'").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert Counter((r.key, r.id, r.status, r.before) for r in got) == brute(set(rows))
    assert all(r.reason == "doubt" for r in got if r.status == "pending")


def test_late_rows_wait_and_are_decided(spark, tmp_path):
    """What comes behind the watermark and before the state that holds is put aside; decisions come as a second stream."""
    at = lambda h: T0 + timedelta(hours=h)
    parts = [[("k", "1", "a", at(0), None)], [("k", "2", "b", at(10), None)], [("k", "3", "x", at(100), "manual"), ("k", "7", "y", at(101), "manual"), ("o", "9", "q", at(100), None)], [("k", "4", "late", at(5), None), ("k", "5", "c", at(50), None)], [("k", "6", "later", at(1), None)], [END]]
    (tmp_path / "verdicts").mkdir()
    verdicts = spark.readStream.schema("key string, id string, decision string, n int").parquet(str(tmp_path / "verdicts"))
    obs = feed(spark, tmp_path / "in", parts, OBS)
    first = run(machines.state_log(obs, verdicts, "1 hour"), tmp_path)
    got = {r.id: (r.status, r.reason) for r in first.collect()}
    # 4 comes in the trigger in which the watermark passes 2 as well, so it is still applied before it
    assert got["1"] == ("created", None) and got["4"] == got["2"] == got["5"] == ("updated", None)
    assert got["6"] == ("pending", "out_of_order") and got["3"] == got["7"] == ("pending", "manual")
    spark.createDataFrame([("k", "3", "approve", 1), ("k", "6", "approve", 1), ("k", "7", "reject", 1), ("k", "77", "approve", 1)], "key string, id string, decision string, n int").write.mode("append").parquet(str(tmp_path / "verdicts"))
    more = run(machines.state_log(obs, verdicts, "1 hour"), tmp_path)
    seen = Counter((r.id, r.status, r.before) for r in more.filter("key = 'k'").collect()) - Counter((r.id, r.status, r.before) for r in first.filter("key = 'k'").collect())
    # what was out of order is approved without being applied
    assert seen == Counter([("3", "approved", None), ("3", "updated", "c"), ("6", "approved", None), ("7", "rejected", None), ("77", "unknown", None)])


REQ = "session_id string, commit_id string, users array<string>, turns array<string>"
REP = "session_id string, commit_id string, job string, stage string, ok boolean, error string"


def test_jobs_go_through_stages_and_are_retried(spark, tmp_path):
    good, blank = (["u"], ["hello"]), ([" "], ["hello"])
    for name in ("req", "rep"):
        (tmp_path / name).mkdir()
    requests = spark.readStream.schema(REQ).parquet(str(tmp_path / "req"))
    reports = spark.readStream.schema(REP).parquet(str(tmp_path / "rep"))

    log = machines.job_log(requests, reports, wait_s=0.2)
    q = log.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    seen = Counter()

    def step(want, req=(), rep=()):
        """Rows come, and within some seconds the log has these new lines and no others."""
        for name, rows, schema in (("req", req, REQ), ("rep", rep, REP)):
            if rows:
                spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        for _ in range(60):
            time.sleep(0.5)
            assert q.exception() is None
            now = Counter(tuple(r)[2:] for r in spark.read.schema(machines.JOB_ROWS).parquet(str(tmp_path / "out")).drop("at").collect()) if (tmp_path / "out").exists() else Counter()
            if {*(now - seen)} >= want:
                break
        assert {*(now - seen)} == want
        seen.update(now - seen)

    try:
        steps(step, good, blank)
    finally:
        q.stop()


def steps(step, good, blank):
    step(
        {("s:c1:1", "RECEIVED", None, 0, None), ("s:c1:1", "STAGE2_RUNNING", "stage2", 1, None), ("s:c1:1", "KNOWN", None, 1, "STAGE2_RUNNING"), ("s:c2:1", "RECEIVED", None, 0, None), ("s:c2:1", "STAGE2_RUNNING", "stage2", 1, None)},
        [("s", "c1", *good), ("s", "c1", *good), ("s", "c2", *blank), (None, "c", *good)],
    )
    # the unfinished job without a usable payload is opened anew; reports of the old one, or of none, count nothing
    step({("s:c2:2", "RECEIVED", None, 0, None), ("s:c2:2", "STAGE2_RUNNING", "stage2", 1, None)}, [("s", "c2", *good)])
    step({("s:c1:1", "STAGE3_RUNNING", "stage3", 1, None)}, rep=[("s", "c1", "s:c1:1", "stage2", True, None), ("s", "c2", "s:c2:1", "stage2", True, None), ("s", "c9", "s:c9:1", "stage2", True, None)])
    # a failure is retried by itself
    step({("s:c1:1", "STAGE3_FAILED", "stage3", 1, "boom"), ("s:c1:1", "STAGE3_RUNNING", "stage3", 2, None)}, rep=[("s", "c1", "s:c1:1", "stage3", False, "boom")])
    step({("s:c1:1", "COMPLETED", "stage3", 2, None)}, rep=[("s", "c1", "s:c1:1", "stage3", True, None)])
    step({("s:c1:1", "KNOWN", None, 2, "COMPLETED")}, [("s", "c1", *blank)])
    for n in (1, 2):
        step({("s:c2:2", "STAGE2_FAILED", "stage2", n, "no"), ("s:c2:2", "STAGE2_RUNNING", "stage2", n + 1, None)}, rep=[("s", "c2", "s:c2:2", "stage2", False, "no")])
    step({("s:c2:2", "FAILED", "stage2", 3, "no")}, rep=[("s", "c2", "s:c2:2", "stage2", False, "no")])


def test_a_key_has_few_timers_and_few_reads():
    """Messages go by the triggers of a key and not by its rows; what a timer leaves is woken by the next one."""
    calls = Counter()

    class Store:
        def __init__(self, name):
            self.name, self.rows = name, []

        def __getattr__(self, verb):
            def call(*args):
                calls[f"{self.name}.{verb}"] += 1
                if verb in ("update", "put", "clear"):
                    self.rows = {"update": lambda: [args[0]], "put": lambda: list(args[0]), "clear": list}[verb]()
                elif verb in ("appendValue", "appendList"):
                    self.rows += [args[0]] if verb == "appendValue" else args[0]
                elif verb == "exists":
                    return bool(self.rows)
                elif verb == "get":
                    return self.rows[0] if self.name == "holds" else iter(self.rows)

            return call

    class Handle:
        timers: set = set()

        def registerTimer(self, ms):
            self.timers.add(ms)

        getValueState = getListState = getMapState = lambda self, name, *_: Store(name)

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    m, handle = machines.States(), Handle()
    m.init(handle)
    rows = pd.DataFrame([("observation", f"{i:03d}", "ab"[i % 2], T0 + timedelta(minutes=i), None) for i in range(200)], columns=["kind", "id", "value", "t", "reason"])
    assert sum(map(len, m.handleInputRows(("k",), iter([rows[::2], rows[1::2]]), At(0)))) == 0
    assert len(handle.timers) == 1
    first = int(T0.replace(tzinfo=UTC).timestamp() * 1000)
    got = []
    for ms in (first, first + 50 * 60_000, first + 10**9):
        while due := sorted(t for t in handle.timers if t <= ms):
            handle.timers.remove(due[0])
            got += [r for part in m.handleExpiredTimer(("k",), At(ms), At(due[0])) for r in part["id"]]
        assert len(handle.timers) <= 1
    assert got == [f"{i:03d}" for i in range(200)] and calls["waits.get"] == calls["holds.exists"] == 3 and calls["holds.update"] == 3
