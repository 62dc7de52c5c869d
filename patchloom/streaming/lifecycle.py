"""Review events and requests as streams: the same rollup and guard, kept up to date by Structured Streaming.

The rollup keeps one row of state for each review, so its state grows with reviews and not with events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bookkeeping import guard_reviews, lifecycle_rollup
from ..sources.store import Store
from ..tables import folders, forget, materialize

REVIEWS = "reviews"
#: Batches are merged into the table once they have this share of its bytes, or are so many.
MERGE_SHARE, MERGE_RUNS = 0.5, 64


def follow_lifecycle(events: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Starts a query that appends each batch's changed reviews, with the batch's number, to `path`; current_state reads it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:012d}")  # the same files again if the batch is repeated

    writer = lifecycle_rollup(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_state(changes: DataFrame) -> DataFrame:
    """The latest row of each review among the written changes."""
    rest = [c for c in changes.columns if c not in ("review_id", "batch")]
    latest = changes.groupBy("review_id").agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return latest.select("review_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def review_store(spark: SparkSession, root: str) -> Store:
    """The versions of the rollup: a row a review."""
    return Store(spark, root, {REVIEWS: ["review_id"]})


def follow_reviews(events: DataFrame, store: Store, checkpoint: str, available_now: bool = True, grace_seconds: float = 86_400):
    """Starts a query that keeps the rollup in a store: each batch is a version in which its reviews' rows are replaced.

    Readers (store.read) see whole batches and one row a review. A batch that Spark repeats after a failure replaces the
    same rows by the same. Batches are merged into the table from time to time, so what a reader reads grows with reviews
    and not with events; a row is rewritten about 1 / MERGE_SHARE times for each doubling, or once in MERGE_RUNS batches.
    A null review_id is a review. Batches without changes make no version. Old versions go after the grace time.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = materialize(batch)  # state is read once
        if not rows.isEmpty():
            store.replace(REVIEWS, rows, rows.select("review_id"))
            first, *later = store.run_bytes(REVIEWS)
            if later and (sum(later) >= MERGE_SHARE * first or len(later) >= MERGE_RUNS):
                store.compact(REVIEWS)
                store.sweep(grace_seconds=grace_seconds)
        forget(batch.sparkSession, folders(rows))

    writer = lifecycle_rollup(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def guard_stream(requests: DataFrame, pulls: DataFrame) -> DataFrame:
    """A stream of requests (repository_id, number, head_sha, force), each accepted or refused by the stored pull requests."""
    known = pulls.select("repository_id", "number", "last_reviewed_sha")
    return guard_reviews(requests.join(known, ["repository_id", "number"], "left"))
