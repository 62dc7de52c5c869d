from datetime import datetime, timedelta

import pytest

from patchloom.operators.bookkeeping import lifecycle_rollup
from patchloom.streaming import guard, lifecycle

LOG = "review_id long, ts timestamp, seq long, status string, stage string, error string"


def test_batches_add_up_to_the_rollup(spark, tmp_path):
    rows = [(i % 4, datetime(2024, 1, 1, i), i, ["queued", "running", "done"][i % 3], f"st{i}", "e" * 3000 if i == 11 else "") for i in range(12)]
    frame = spark.createDataFrame(rows, LOG)
    for part in (rows[:5], rows[5:]):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        stream = spark.readStream.schema(LOG).parquet(f"{tmp_path}/log")
        lifecycle.follow_lifecycle(stream, f"{tmp_path}/changes", f"{tmp_path}/state").awaitTermination()
    state = lifecycle.current_state(spark.read.parquet(f"{tmp_path}/changes"))
    want = {r["review_id"]: r for r in lifecycle_rollup(frame).collect()}
    assert {r["review_id"]: r for r in state.collect()} == want and len(want[3]["error"]) == 2000


def test_the_review_table_takes_batches_as_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lifecycle, "MERGE_RUNS", 3)
    monkeypatch.setattr(lifecycle, "MERGE_SHARE", 1e9)  # merging by number alone
    store, state = lifecycle.review_store(spark, f"{tmp_path}/reviews"), lambda df: {r["review_id"]: r for r in df.collect()}
    rows, opened = [], {}

    def part(k):
        new = [(None if i == 4 else (7 * k + i) % 9, datetime(2024, 1, 1, k, i), 10 * k + i, ["queued", "running", "failed", "done"][(k + i) % 4], f"st{k}", f"e{i}") for i in range(5)]
        rows.extend(new)
        spark.createDataFrame(new, LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")

    def follow():
        log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
        lifecycle.follow_reviews(log, store, f"{tmp_path}/state", grace_seconds=3600).awaitTermination()

    for k in range(6):  # a start of the stream for each part
        part(k)
        follow()
        want = state(lifecycle_rollup(spark.createDataFrame(rows, LOG)))
        assert state(store.read(lifecycle.REVIEWS)) == want and len(store.run_bytes(lifecycle.REVIEWS)) <= 3
        opened[k] = (store.read(lifecycle.REVIEWS), want)
    assert all(state(df) == want for df, want in opened.values())  # readers stay with what they opened
    follow()  # nothing new: no version
    version = store.version()

    # a run that dies before, and one that dies after its commit, are repeated to the same end
    part(6)
    replace = store.replace
    for late in (False, True):

        def dying(*args, late=late):
            if late:
                replace(*args)
            raise RuntimeError("lost")

        monkeypatch.setattr(store, "replace", dying)
        with pytest.raises(Exception, match="lost"):
            follow()
        assert store.version() == version + late
    monkeypatch.setattr(store, "replace", replace)
    follow()
    assert state(store.read(lifecycle.REVIEWS)) == state(lifecycle_rollup(spark.createDataFrame(rows, LOG)))
    assert store.read(lifecycle.REVIEWS).count() == 10


def test_requests_are_guarded_as_they_come(spark, tmp_path):
    schema = "repository_id long, number long, head_sha string, force boolean"
    spark.createDataFrame([(1, 1, "a", False), (1, 1, "a", True), (1, 2, "b", False), (2, 9, "", True)], schema).write.parquet(f"{tmp_path}/asked")
    pulls = spark.createDataFrame([(1, 1, "a"), (1, 2, "old")], "repository_id long, number long, last_reviewed_sha string")
    guarded = lifecycle.guard_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/asked"), pulls)
    guarded.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {(r["number"], r["force"]): (r["accepted"], r["reason"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, False): (False, "already reviewed"), (1, True): (True, None), (2, False): (True, None), (9, True): (False, "no head commit")}


def test_one_review_of_a_head_at_a_time(spark, tmp_path):
    start = datetime(2024, 1, 1)
    schema = "repository_id long, number long, at timestamp, seq long, kind string, head_sha string, force boolean"
    # (minutes, kind, head, force) and the answer; None for events that aren't requests
    story = [
        (0, "request", "a", False, "ok"), (1, "request", "a", False, "under review"), (1, "request", "a", True, "under review"), (2, "request", None, True, "no head commit"),
        (5, "failed", "a", None, None), (6, "request", "a", False, "ok"), (9, "finished", "a", None, None), (10, "request", "a", False, "already reviewed"), (11, "request", "a", True, "ok"),
        (12, "request", "b", False, "ok"), (13, "finished", "a", None, None), (14, "request", "b", False, "under review"), (80, "request", "b", False, "ok"),
        (90, "closed", None, None, None), (91, "request", "a", False, "ok"), (92, "closed", None, None, None),
    ]
    rows = [(r, 7, start + timedelta(minutes=m), i, kind, head, force) for r in (1, 2) for i, (m, kind, head, force, _) in enumerate(story)]
    for a, b in ((0, 2), (2, 7), (7, 12), (12, 16)):  # the stream is started anew for each part
        part = [r for r in rows if a <= r[3] < b]
        spark.createDataFrame(part[::-1], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        guard.follow_requests(spark.readStream.schema(schema).parquet(f"{tmp_path}/events"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {(r["repository_id"], r["seq"]): r["reason"] or "ok" for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(r, i): s[4] for r in (1, 2) for i, s in enumerate(story) if s[4]}
    plain = [(m[2], m[3], m[4], m[5], m[6]) for m in rows if m[0] == 1]
    decided, state = guard.decide(plain, (None, None, None))
    assert [d[2] or "ok" for d in decided] == [s[4] for s in story if s[4]] and state is None


def test_pulls_share_groups_and_are_forgotten_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(guard, "BUCKETS", 2)
    schema = "repository_id long, number long, at timestamp, seq long, kind string, head_sha string, force boolean"
    day, large = (lambda n: datetime(2024, 1, 1) + timedelta(days=n)), 2**60 + 1
    pulls = [(1, n) for n in range(300)] + [(None, large), (large, None)]
    events = lambda some, n, kind, seq: [(r, p, day(n), seq, kind, "a", None) for r, p in some]
    batches = [events(pulls, 0, "request", 1) + events(pulls, 1, "finished", 2), events(pulls[:100], 150, "request", 3), events(pulls, 200, "request", 4), events(pulls, 200, "request", 5)]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        stream = guard.follow_requests(spark.readStream.schema(schema).parquet(f"{tmp_path}/events"), f"{tmp_path}/out", f"{tmp_path}/state")
        stream.awaitTermination()
        held = [s["numRowsTotal"] for p in stream.recentProgress for s in p["stateOperators"]]
        assert max(held) <= 2  # not one row a pull request
    got = {(r["repository_id"], r["number"], r["seq"]): r["reason"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(*p, 1): None for p in pulls} | {(*p, 3): "already reviewed" for p in pulls[:100]}
    # heard of 50 days ago, or not for 199, and then once more
    want |= {(*p, 4): "already reviewed" if i < 100 else None for i, p in enumerate(pulls)} | {(*p, 5): "already reviewed" if i < 100 else "under review" for i, p in enumerate(pulls)}
    assert got == want
