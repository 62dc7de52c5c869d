"""Pull requests, reviews and findings as tables: merges, guards, rollups, rankings and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.findings import FEEDBACK_VERDICTS, SEVERITIES, severity_rank, up_to_date
from ..tables import materialize, number_rows

#: The fields that a refresh takes from the live pull request.
SUMMARY_FIELDS = ["title", "author", "state", "html_url", "head_sha", "base_sha", "github_updated_at", "additions", "deletions", "changed_files"]
ERROR_CHARS = 2000
#: Refreshed repositories up to which their list is broadcast.
BROADCAST_REPOSITORIES = 100_000


def register(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Repositories of the batch to add: not known yet, the first of each full_name (by id)."""
    first = F.row_number().over(W.partitionBy("full_name").orderBy("id"))
    return incoming.join(known.select("full_name"), "full_name", "left_anti").withColumn("nth", first).where("nth = 1").drop("nth")


def refresh_pulls(stored: DataFrame, live: DataFrame, refreshed: DataFrame) -> DataFrame:
    """stored and live pull requests merged on (repository_id, number).

    Live ones give their summary fields; stored ones of a refreshed repository that are no longer live become closed,
    all of them if nothing is live there. Other repositories stay as they are, and nothing but the summary fields changes.
    """
    fields = [f for f in SUMMARY_FIELDS if f in stored.columns and f in live.columns]
    batch = refreshed.select("repository_id").distinct().withColumn("refreshed", F.lit(True))
    # other repositories' pull requests pass without a shuffle, as long as the list of these is short enough to broadcast
    touched = materialize(batch.select("repository_id").unionByName(live.select("repository_id")).where("repository_id is not null").distinct())
    if touched.limit(BROADCAST_REPOSITORIES + 1).count() <= BROADCAST_REPOSITORIES:
        touched = F.broadcast(touched)
    seen = live.select("repository_id", "number", F.lit(True).alias("is_live"), *[F.col(f).alias(f"new_{f}") for f in fields])
    merged = stored.join(touched, "repository_id", "left_semi").join(seen, ["repository_id", "number"], "full_outer").join(batch, "repository_id", "left")
    out = []
    for c in stored.columns:
        if c == "state":
            gone = F.when(F.col("refreshed") & F.col("is_live").isNull(), "closed").otherwise(F.col("state"))
            out.append((F.when(F.col("is_live"), F.col("new_state")).otherwise(gone) if "state" in fields else gone).alias(c))
        else:
            out.append(F.when(F.col("is_live"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c))
    return merged.select(*out).unionByName(stored.join(touched, "repository_id", "left_anti"))


def vanished_pulls(stored: DataFrame, live: DataFrame, refreshed: DataFrame) -> DataFrame:
    """(repository_id, number) that are stored but not live, of the refreshed repositories: those that refresh_pulls closes."""
    keys = ["repository_id", "number"]
    return stored.select(*keys).join(refreshed.select("repository_id").distinct(), "repository_id", "left_semi").join(live.select(*keys), keys, "left_anti")


def guard_reviews(requests: DataFrame) -> DataFrame:
    """Requests with accepted and the reason of a refusal: no head, or the head was reviewed and it isn't forced."""
    head, last = F.col("head_sha"), F.col("last_reviewed_sha")
    reason = F.when(F.coalesce(head, F.lit("")) == "", "no head commit").when(~F.coalesce(F.col("force"), F.lit(False)) & last.eqNullSafe(head), "already reviewed")
    return requests.withColumn("reason", reason).withColumn("accepted", reason.isNull())


def trigger_upsert(stored: DataFrame, requests: DataFrame, repositories: DataFrame, order: str = "request_id") -> DataFrame:
    """Accepted requests merged into the stored pull requests, description and base_ref included; the last one of each by `order`."""
    rest = [c for c in requests.columns if c not in ("repository_id", "number")]
    last = requests.where("accepted").groupBy("repository_id", "number").agg(F.max_by(F.struct(*rest), order).alias("r"))
    accepted = last.select("repository_id", "number", "r.*").join(repositories.select(F.col("id").alias("repository_id"), F.col("url").alias("repo_url")), "repository_id")
    url = F.coalesce(F.nullif(F.col("html_url"), F.lit("")), F.concat("repo_url", F.lit("/pull/"), F.col("number").cast("string")))
    fields = [c for c in [*SUMMARY_FIELDS, "description", "base_ref"] if c in stored.columns and c in requests.columns]
    seen = accepted.withColumn("html_url", url).select("repository_id", "number", F.lit(True).alias("hit"), *[F.col(f).alias(f"new_{f}") for f in fields])
    merged = stored.join(seen, ["repository_id", "number"], "full_outer")
    return merged.select(*[F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in stored.columns])


def job_context(reviews: DataFrame, pulls: DataFrame, repositories: DataFrame) -> DataFrame:
    """One row a review with its pull request and repository."""
    p = pulls.select(F.col("id").alias("pull_request_id"), "repository_id", "number", F.col("title").alias("pr_title"))
    r = repositories.select(F.col("id").alias("repository_id"), "full_name", "language")
    return reviews.join(p, "pull_request_id").join(r, "repository_id")


def latest_review(reviews: DataFrame) -> DataFrame:
    """The newest review of each pull request, by created_at and id; an aggregate, combined before the shuffle."""
    rest = [c for c in reviews.columns if c != "pull_request_id"]
    newest = reviews.groupBy("pull_request_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("r"))
    return newest.select("pull_request_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def open_pulls(pulls: DataFrame) -> DataFrame:
    """Open ones of each repository, the latest update first and those without one before all."""
    order = W.partitionBy("repository_id").orderBy(F.desc_nulls_first("github_updated_at"), "number")
    return pulls.where("state = 'open'").withColumn("place", F.row_number().over(order)).withColumn("up_to_date", up_to_date(F.col("last_reviewed_sha"), F.col("head_sha")))


def list_repositories(repositories: DataFrame) -> DataFrame:
    """Repositories, the newest first, with their `place` in that order from 0; numbered range by range, not in one task."""
    return number_rows(repositories, [F.desc("created_at"), F.col("id").asc()], "place")


def rank_findings(findings: DataFrame, key: str = "finding_id") -> DataFrame:
    """Surfaced findings of each review in order of severity, then confidence."""
    best = F.coalesce("adjusted_confidence", "confidence")
    order = W.partitionBy("review_id").orderBy(severity_rank(F.col("severity")), best.desc(), key)
    return findings.where("surfaced").withColumn("place", F.row_number().over(order))


def severity_counts(findings: DataFrame) -> DataFrame:
    """Surfaced findings by review and severity, with the severity's place in the order."""
    counted = findings.where("surfaced").groupBy("review_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("severity").isin(SEVERITIES)).withColumn("severity_rank", severity_rank(F.col("severity")))


def surfaced_count(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """finding_count of every review, 0 included."""
    counted = findings.groupBy("review_id").agg(F.count_if(F.col("surfaced")).alias("finding_count"))
    return reviews.join(counted, "review_id", "left").withColumn("finding_count", F.coalesce("finding_count", F.lit(0)))


def lifecycle_rollup(log: DataFrame) -> DataFrame:
    """Status, stage, first start, completion and error of each review from its events (review_id, ts, seq, status, stage, error)."""
    at = F.struct("ts", "seq")
    return log.groupBy("review_id").agg(
        F.max_by("status", at).alias("status"),
        F.max_by("stage", at).alias("stage"),
        F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"),
        F.max(F.when(F.col("status").isin("done", "failed"), F.col("ts"))).alias("completed_at"),
        F.substring(F.max_by("error", at), 1, ERROR_CHARS).alias("error"),
    )


def accept_feedback(feedback: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feedback with a known verdict on an existing finding, and the rest."""
    known = feedback.where(F.col("verdict").isin(FEEDBACK_VERDICTS)).join(findings.select("finding_id").distinct(), "finding_id", "left_semi")
    missing = feedback.join(findings.select("finding_id").distinct(), "finding_id", "left_anti")
    bad = feedback.where(~F.coalesce(F.col("verdict").isin(FEEDBACK_VERDICTS), F.lit(False))).join(findings.select("finding_id").distinct(), "finding_id", "left_semi")
    return known, missing.unionByName(bad)


def effective_verdict(findings: DataFrame, results: DataFrame) -> DataFrame:
    """The verification's final verdict where there is one, else the finding's own."""
    final = results.select("finding_id", "final_verdict")
    return findings.join(final, "finding_id", "left").withColumn("effective_verdict", F.coalesce("final_verdict", "verdict")).drop("final_verdict")


def without_children_of(children: DataFrame, parents_gone: DataFrame, key: str) -> DataFrame:
    """Rows whose parent isn't among the deleted ones."""
    return children.join(parents_gone.select(key).distinct(), key, "left_anti")
