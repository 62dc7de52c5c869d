"""Writers of result tables: chunk sets replaced by repository and version, results added by run, states updated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Store


def chunk_store(spark: SparkSession, path: str) -> Store:
    """The versions of the chunk table at `path`."""
    return Store(spark, path, {"chunks": ["repository_id"]})


def replace_chunks(chunks: DataFrame, repositories: DataFrame, path: str) -> int:
    """Replaces the chunks of the given repositories, also by none, in one step; other repositories are not touched.

    The new version's number. A reader sees all of the old set or all of the new one, and a run that dies leaves the old.
    """
    return chunk_store(chunks.sparkSession, path).replace("chunks", chunks, repositories, order=("repository_id", "file_path"))


def read_chunks(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The chunks of a version, the latest one by default; what is committed later doesn't change the DataFrame."""
    return chunk_store(spark, path).read("chunks", version)


def finish_reviews(reviews: DataFrame, findings: DataFrame, summaries: DataFrame, completed_at) -> DataFrame:
    """Reviews with summary, finding_count, status done and completed_at where the batch has a summary."""
    counted = findings.groupBy("review_id").agg(F.count_if(F.col("surfaced")).alias("n"))
    batch = summaries.select("review_id", F.col("summary").alias("new_summary")).join(counted, "review_id", "left").withColumn("hit", F.lit(True))
    hit = F.col("hit").isNotNull()
    out = reviews.join(batch, "review_id", "left").withColumns(
        {
            "summary": F.when(hit, F.col("new_summary")).otherwise(F.col("summary")),
            "finding_count": F.when(hit, F.coalesce("n", F.lit(0))).otherwise(F.col("finding_count")),
            "status": F.when(hit, "done").otherwise(F.col("status")),
            "completed_at": F.when(hit, completed_at).otherwise(F.col("completed_at")),
        }
    )
    return out.select(*reviews.columns)


def mark_reviewed(pulls: DataFrame, reviews: DataFrame) -> DataFrame:
    """Pull requests with the head of their newest finished review as last_reviewed_sha."""
    heads = reviews.where("status = 'done'").groupBy("pull_request_id").agg(F.max_by("head_sha", F.struct("completed_at", "review_id")).alias("sha"))
    joined = pulls.join(heads, pulls["id"] == heads["pull_request_id"], "left")
    return joined.withColumn("last_reviewed_sha", F.coalesce("sha", "last_reviewed_sha")).select(*pulls.columns)


def append_results(root: str, run: str, **tables: DataFrame) -> None:
    """Adds each table to root/<name> as the part of this run; a run that is repeated replaces its own part."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{root}/{name}/run={run}")
