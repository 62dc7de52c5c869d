"""Readers and parsers of raw inputs: repository snapshots, pull-request JSON, static-analysis reports, model replies."""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Size limit and directories that are skipped anywhere in a path.
MAX_SOURCE_BYTES = 500_000
ARCHIVE_BATCH_BYTES = 8 << 20  # unpacked sources handed on together
SKIPPED = [".git", ".venv", "venv", "node_modules", "__pycache__", "build", "dist", ".tox", ".mypy_cache", "site-packages"]
PR = "number bigint, title string, body string, state string, html_url string, updated_at string, user struct<login:string>, head struct<sha:string>, base struct<sha:string,ref:string>, additions int, deletions int, changed_files int"
PR_FILES = "array<struct<filename:string,status:string,additions:int,deletions:int,patch:string,previous_filename:string>>"
REPORT = "results array<struct<check_id:string,path:string,start:struct<line:int>,end:struct<line:int>,extra:struct<severity:string,message:string>>>"
REPLY = "summary string, findings array<struct<file:string,start_line:int,end_line:int,severity:string,category:string,title:string,description:string,evidence:string,suggested_fix:string,confidence:double>>"
REQUIRED = ["file", "start_line", "end_line", "severity", "category", "title", "description", "confidence"]


def usable_sources(files: DataFrame) -> DataFrame:
    """Rows (path, size, ...) of Python files that aren't large or in a skipped directory, paths without the first part."""
    kept = files.withColumn("path", F.regexp_replace("path", "^[^/]*/", ""))
    skipped = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED)))
    return kept.where(F.col("path").endswith(".py") & (F.col("size") <= MAX_SOURCE_BYTES) & ~skipped)


def expand_archives(archives: DataFrame) -> DataFrame:
    """(repository_id, content: a .tar.gz) -> (repository_id, path, size, content) of regular files, one archive a task step.

    Decoded by replacement, as UTF-8: `source` has U+FFFD for bad bytes. Repartition before heavy work.
    """

    def packed(repo: int, rows: list[tuple]) -> pa.RecordBatch:
        names, sizes, sources = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([repo] * len(rows), pa.int64()), pa.array(names), pa.array(sizes, pa.int64()), pa.array(sources)], ["repository_id", "path", "size", "source"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for repo, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                # read as a stream, so that only this batch of sources is unpacked
                with tarfile.open(fileobj=io.BytesIO(blob), mode="r|gz") as archive:
                    for member in archive:
                        if member.isfile() and member.name.endswith(".py") and member.size <= MAX_SOURCE_BYTES:
                            rows.append((member.name, member.size, archive.extractfile(member).read().decode("utf-8", "replace")))
                            held += member.size
                            archive.members = []
                        if held >= ARCHIVE_BATCH_BYTES:
                            yield packed(repo, rows)
                            rows, held = [], 0
                if rows:
                    yield packed(repo, rows)

    found = archives.select(F.col("repository_id").cast("long").alias("repository_id"), "content").mapInArrow(run, "repository_id long, path string, size long, source string")
    return usable_sources(found)


def snapshot_files(spark: SparkSession, folder: str) -> DataFrame:
    """Python files below a folder with one directory a repository: (repository, path, size, source)."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(folder)
    below = "^.*/" + re.escape(folder.rstrip("/").split("/")[-1]) + "/([^/]+)/(.*)$"
    repo, tail = F.regexp_extract("path", below, 1), F.regexp_extract("path", below, 2)
    rows = read.select(repo.alias("repository"), F.concat(F.lit("x/"), tail).alias("path"), F.col("length").alias("size"), "content")
    return decode_sources(usable_sources(rows))


def decode_sources(files: DataFrame, content: str = "content") -> DataFrame:
    """The binary content as UTF-8 text in `source`; bad bytes become U+FFFD, as Python replaces them."""
    return files.select(*[c for c in files.columns if c != content], F.make_valid_utf8(F.col(content).cast("string")).alias("source"))


def _or(value: Column, default: str) -> Column:
    """The value, or the default where it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def pr_summary(raw: DataFrame, json: str = "json", keep: tuple[str, ...] = ("repository_id",)) -> DataFrame:
    """Flat summary of each pull request's JSON; rows without a number are left out."""
    pr = raw.select(*keep, F.from_json(json, PR).alias("p")).where("p.number is not null")
    zero = F.lit(0)
    return pr.select(
        *keep, F.col("p.number").alias("number"), _or(F.col("p.title"), "").alias("title"), F.col("p.user.login").alias("author"), _or(F.col("p.state"), "open").alias("state"),
        _or(F.col("p.html_url"), "").alias("html_url"), _or(F.col("p.head.sha"), "").alias("head_sha"), F.col("p.base.sha").alias("base_sha"),
        F.try_to_timestamp(F.col("p.updated_at")).alias("github_updated_at"), F.coalesce("p.additions", zero).alias("additions"), F.coalesce("p.deletions", zero).alias("deletions"),
        F.coalesce("p.changed_files", zero).alias("changed_files"), F.col("p.body").alias("description"), F.col("p.base.ref").alias("base_ref"),
    )


def pr_files(raw: DataFrame, json: str = "json", keep: tuple[str, ...] = ("repository_id", "number")) -> DataFrame:
    """One row a changed file of the files JSON, with its place."""
    rows = raw.select(*keep, F.posexplode(F.from_json(json, PR_FILES)).alias("file_pos", "f"))
    zero = F.lit(0)
    return rows.select(*keep, "file_pos", "f.filename", _or(F.col("f.status"), "modified").alias("status"), F.coalesce("f.additions", zero).alias("additions"), F.coalesce("f.deletions", zero).alias("deletions"), "f.patch", "f.previous_filename")


def pr_detail(summary: DataFrame, files: DataFrame) -> DataFrame:
    """Summaries with their files as an array in order."""
    keys = ["repository_id", "number"]
    rest = [c for c in files.columns if c not in keys]
    grouped = files.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("files"))
    return summary.join(grouped, keys, "left")


def static_report(reports: DataFrame, json: str = "report", keep: tuple[str, ...] = ("review_id",)) -> DataFrame:
    """Hits of static-analysis reports with their own JSON; none for empty or malformed reports."""
    parsed = reports.select(*keep, F.from_json(json, REPORT)["results"].alias("r"), F.from_json(json, "results array<string>")["results"].alias("raw"))
    rows = parsed.select(*keep, F.posexplode(F.arrays_zip("r", "raw")).alias("pos", "x"))
    start = F.coalesce(F.col("x.r.start.line"), F.lit(0))
    return rows.select(*keep, "pos", F.coalesce("x.r.check_id", F.lit("unknown")).alias("rule_id"), F.coalesce("x.r.path", F.lit("")).alias("file_path"), start.alias("start_line"), F.coalesce(F.col("x.r.end.line"), start).alias("end_line"), F.col("x.r.extra.severity").alias("severity"), F.col("x.r.extra.message").alias("message"), F.col("x.raw").alias("raw"))


def model_output(replies: DataFrame, json: str = "reply", keep: tuple[str, ...] = ("review_id",)) -> tuple[DataFrame, DataFrame]:
    """Findings of valid replies (with the place in the reply), and the replies to ask for again."""
    parsed = replies.withColumn("__p", F.from_json(json, REPLY))
    whole = F.coalesce(F.forall("__p.findings", lambda f: ~F.array_contains(F.array(*[f[c].isNull() for c in REQUIRED]), F.lit(True))), F.lit(True))
    valid = F.col("__p.summary").isNotNull() & whole
    marked = parsed.withColumn("__valid", F.coalesce(valid, F.lit(False)))
    good = marked.where("__valid").select(*keep, F.col("__p.summary").alias("summary"), F.posexplode_outer("__p.findings").alias("pos", "f")).where("f is not null").select(*keep, "summary", "pos", "f.*")
    return good, marked.where(~F.col("__valid")).drop("__p", "__valid")
