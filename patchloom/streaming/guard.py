"""Review requests guarded by state of their own, kept between batches by Structured Streaming.

Events (repository_id, number, at, seq, kind, head_sha, force) are requests, the ends of reviews (`finished`, `failed`),
and `closed`. A request is refused without a head; while a review of the same head runs, until its lease is over; and if
the head was reviewed and the request isn't forced. So the guard needs no table of pull requests, and two requests that
come together can't both start a review. Events of a pull request are taken in order of (at, seq) inside of a batch, and
batches as they come. State goes when a pull request is closed, or when nothing was heard of it for KEEP days of event
time. A stream that is started again goes on from its checkpoint.

Pull requests share BUCKETS groups by hash, as calling Python costs milliseconds a group and microseconds an event. A group
holds its pull requests side by side, and is written anew when one of them changes. The number is part of a checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LEASE = timedelta(hours=1)
KEEP_DAYS = 90
KEYS = ["repository_id", "number"]
DECISION = "repository_id long, number long, seq long, accepted boolean, reason string"
#: Of each pull request of a group, in the same place of every list; times in microseconds.
STATE = "repository_id array<string>, number array<string>, running array<string>, since array<long>, reviewed array<string>, expires array<long>"
BUCKETS = 4096
MICROS = timedelta(microseconds=1)


def decide(events: list[tuple], state: tuple, lease: timedelta | int = LEASE) -> tuple[list[tuple], tuple | None]:
    """(seq, accepted, reason) of each request among the events (at, seq, kind, head, force) in order, and the state after; None once closed."""
    running, since, reviewed = state
    out, open_ = [], True
    for at, seq, kind, head, force in events:
        if kind == "closed":
            running, since, reviewed, open_ = None, None, None, False
            continue
        open_ = True
        if kind == "request":
            if not head:
                reason = "no head commit"
            elif running == head and at < since + lease:
                reason = "under review"
            elif reviewed == head and not force:
                reason = "already reviewed"
            else:
                reason, running, since = None, head, at
            out.append((seq, reason is None, reason))
        elif running == head:
            running, since = None, None
        if kind == "finished":
            reviewed = head
    return out, (running, since, reviewed) if open_ else None


def guard_requests(events: DataFrame) -> DataFrame:
    """A stream of events -> each request's DECISION, once."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = {(r, n): (*rest, expires) for r, n, *rest, expires in zip(*state.get, strict=True)} if state.exists else {}
        events: dict[tuple, list[tuple]] = {}
        for part in [] if state.hasTimedOut else parts:
            columns = [part[c].tolist() for c in (*KEYS, "micros", "seq", "kind", "head_sha", "force")]
            for repository, number, at, seq, kind, head, force in zip(*columns, strict=True):
                events.setdefault((repository, number), []).append((at, seq, kind, None if head != head else head, force is not None and force == force and bool(force)))
        watermark = state.getCurrentWatermarkMs() * 1000
        kept = {pull: x for pull, x in kept.items() if x[-1] > watermark or pull in events}
        out: list[tuple] = []
        for pull, rows in events.items():
            rows.sort(key=lambda r: r[:2])
            decided, after = decide(rows, kept.pop(pull, (None, None, None, None))[:3], LEASE // MICROS)
            if after is not None:
                kept[pull] = (*after, max(rows[-1][0], watermark) + timedelta(days=KEEP_DAYS) // MICROS)
            out += [(*pull, *d) for d in decided]
        if kept:
            state.update(tuple(map(list, zip(*[(*pull, *x) for pull, x in kept.items()], strict=True))))
            state.setTimeoutTimestamp(-(-min(x[-1] for x in kept.values()) // 1000))  # whole milliseconds, upwards
        elif state.exists:
            state.remove()
        if out:
            repository, number, seq, accepted, reason = zip(*out, strict=True)
            whole = lambda ids: pd.array([None if x is None else int(x) for x in ids], "Int64")
            yield pd.DataFrame({"repository_id": whole(repository), "number": whole(number), "seq": seq, "accepted": accepted, "reason": reason})

    # ids as text, as pandas would make fractions of them beside a null
    timed = events.withWatermark("at", "1 day").select(F.pmod(F.xxhash64(*KEYS), F.lit(BUCKETS)).alias("bucket"), *[F.col(k).cast("string").alias(k) for k in KEYS], "at", F.unix_micros("at").alias("micros"), "seq", "kind", "head_sha", "force")
    return timed.groupBy("bucket").applyInPandasWithState(run, DECISION, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def follow_requests(events: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Starts a query that adds the decisions of each batch to `path`, as that batch's part."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")  # the same files again if the batch is repeated

    writer = guard_requests(events).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
