"""Prompt texts for batch inference, put together in order, and the model hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_validation, truncate_text
from ..sources.store import Store
from ..tables import materialize

# Fixed values.
PATCH_CHARS, CHUNK_CHARS = 6000, 1500
FINDING_FIELDS = ["file", "start_line", "end_line", "severity", "category", "title", "description", "evidence", "suggested_fix", "confidence"]
NO_DIFF, NO_DESCRIPTION, NO_CONTEXT, NO_STATIC = "(no textual diff)", "(no description provided)", "(no related context retrieved)", "(no static findings)"

#: Prompts that are asked before their replies are kept.
PART_PROMPTS = 10_000


def joined_in_order(place: str, text: str, between: str) -> Column:
    """The group's texts in order of their places, without null ones; null if there is no other."""
    return F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(text).alias("t")))), lambda x: x["t"]), between), F.lit(""))


def _fenced(kind: str, body: Column) -> Column:
    return F.concat(F.lit(f"\n```{kind}\n"), body, F.lit("\n```"))


def changed_sections(files: DataFrame, empty_is_none: bool = True) -> DataFrame:
    """review_id and one text of its files (file_pos, filename, status, symbols, patch), cut before they are gathered.

    NO_DIFF stands for a null patch and, if empty_is_none, for an empty one. A file without a name has no text.
    """
    names = F.when(F.size("symbols") > 0, F.concat(F.lit(", symbols: "), F.array_join("symbols", ", "))).otherwise(F.lit(""))
    patch = _or(F.col("patch"), NO_DIFF) if empty_is_none else F.coalesce("patch", F.lit(NO_DIFF))
    block = F.concat(F.lit("## "), "filename", F.lit(" ("), "status", names, F.lit(")"), _fenced("diff", truncate_text(patch, PATCH_CHARS)))
    return files.select("review_id", "file_pos", block.alias("block")).groupBy("review_id").agg(joined_in_order("file_pos", "block", "\n\n").alias("changed_sections"))


def retrieved_sections(chunks: DataFrame) -> DataFrame:
    """review_id and one text of its retrieved chunks in rank order."""
    tags = F.array_compact(F.array(F.when(F.col("is_test"), F.lit("test")), F.when(is_validation(F.col("symbol_name")), F.lit("validation/rule"))))
    tag = F.when(F.size(tags) > 0, F.concat(F.lit(" ["), F.array_join(tags, ", "), F.lit("]"))).otherwise(F.lit(""))
    head = F.concat(F.lit("## "), "file_path", F.lit("::"), F.coalesce("symbol_name", F.lit("module")), F.lit(" (lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(")"), tag)
    block = F.concat(head, _fenced("python", truncate_text(F.col("content"), CHUNK_CHARS)))
    return chunks.select("review_id", "rank", block.alias("block")).groupBy("review_id").agg(joined_in_order("rank", "block", "\n\n").alias("retrieved_sections"))


def static_section(hits: DataFrame) -> DataFrame:
    """review_id and one line for each of its static-analysis hits."""
    message = F.regexp_replace(F.coalesce("message", F.lit("")), r"^\s+|\s+$", "")
    line = F.regexp_replace(F.concat(F.lit("- "), "rule_id", F.lit(" @ "), "file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit(" ["), F.coalesce("severity", F.lit("info")), F.lit("] "), message), r"\s+$", "")
    return hits.select("review_id", "id", line.alias("line")).groupBy("review_id").agg(joined_in_order("id", "line", "\n").alias("static_section"))


def _or(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def review_prompts(reviews: DataFrame, changed: DataFrame, retrieved: DataFrame, static: DataFrame, task: str) -> DataFrame:
    """review_id and its prompt; placeholders stand for missing parts. The closing task is the caller's wording."""
    df = reviews.join(changed, "review_id", "left").join(retrieved, "review_id", "left").join(static, "review_id", "left")
    parts = [
        F.lit("# Pull request\n\n## Title\n"), F.coalesce("pr_title", F.lit("")),
        F.lit("\n\n## Description (stated intent)\n"), _or(F.col("pr_description"), NO_DESCRIPTION),
        F.lit("\n\n# Changed code\n"), F.coalesce("changed_sections", F.lit("")),
        F.lit("\n\n# Retrieved repository context\n"), _or(F.col("retrieved_sections"), NO_CONTEXT),
        F.lit("\n\n# Static analysis\n"), _or(F.col("static_section"), NO_STATIC),
        F.lit("\n\n# Task\n" + task),
    ]
    return df.select("review_id", F.concat(*parts).alias("prompt"))


def verification_prompts(findings: DataFrame, task: str) -> DataFrame:
    """finding_id and its second-pass prompt: the whole finding as indented JSON, then excerpt, retrieved_sections and static_section, and the caller's task."""
    quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1), F.lit("null"))
    texts = {"file", "severity", "category", "title", "description", "evidence", "suggested_fix"}
    shown = [F.concat(F.lit(f'  "{c}": '), F.when(F.col(c).isNull(), "null").otherwise(quoted(c) if c in texts else F.col(c).cast("string"))) for c in FINDING_FIELDS]
    body = F.concat(F.lit("{\n"), F.concat_ws(",\n", *shown), F.lit("\n}"))
    parts = [
        F.lit("# Finding under review\n"), body,
        F.lit("\n\n# Relevant diff\n"), _or(F.col("excerpt"), "(diff excerpt unavailable)"),
        F.lit("\n\n# Repository context\n"), _or(F.col("retrieved_sections"), "(no related context)"),
        F.lit("\n\n# Static analysis\n"), _or(F.col("static_section"), "(none)"),
        F.lit("\n\n# Task\n" + task),
    ]
    return findings.select("finding_id", F.concat(*parts).alias("prompt"))


def run_model(prompts: DataFrame, key: str, load: Callable[[], Callable[[list[str]], list[str]]], batch: int = 16) -> DataFrame:
    """key and reply; `load` is called once in each task. Write the replies before using them twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for whole in batches:
            for i in range(0, whole.num_rows, batch):
                model = model or load()
                part = whole.slice(i, batch)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(model(part.column(1).to_pylist())), pa.string())], names=[key, "reply"])

    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, "prompt").mapInArrow(run, f"{key} {kind}, reply string")


def reply_store(spark: SparkSession, path: str) -> Store:
    """The replies kept at `path`: one for each different prompt, by its hash."""
    return Store(spark, path, {"replies": []})


def resumed_model(prompts: DataFrame, key: str, store: Store, load: Callable[[], Callable[[list[str]], list[str]]], batch: int = 16, part: int = PART_PROMPTS) -> DataFrame:
    """As run_model, but each different prompt is asked once, ever, and its reply kept in the store.

    Prompts without a kept reply are dealt by hash over parts of about `part`; each part's replies are committed when it is
    done. After a failure, of a task or of the driver, the same call goes on with the parts that are missing, so no more
    than a part is asked again. A null prompt has a null reply and isn't asked.
    """
    asked = prompts.select(key, "prompt").withColumn("prompt_hash", F.sha2("prompt", 256))
    different = asked.where("prompt is not null").groupBy("prompt_hash").agg(F.first("prompt").alias("prompt"))
    known = store.read("replies").select("prompt_hash") if store.version() else None
    missing = materialize(different if known is None else different.join(known, "prompt_hash", "left_anti"))
    n = missing.count()
    parts = -(-n // part)
    for i in range(parts):
        mine = missing.where(F.pmod(F.xxhash64("prompt_hash"), F.lit(parts)) == i)
        store.append("replies", run_model(mine.repartition("prompt_hash"), "prompt_hash", load, batch))
    if not store.version():
        return asked.select(key, F.lit(None).cast("string").alias("reply"))
    # the whole store is read once; only the replies asked for go on
    hashes = asked.select("prompt_hash").distinct()
    replies = store.read("replies").join(hashes, "prompt_hash", "left_semi").groupBy("prompt_hash").agg(F.first("reply").alias("reply"))
    return asked.join(materialize(replies), "prompt_hash", "left").select(key, "reply")
