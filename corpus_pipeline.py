"""The training-data pipeline: rules, near duplicates, decontamination, mixing, shards.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before kept, and its result is written
as Parquet and read again for the next. All but the last return the columns of documents; the last returns the shard
manifest.

Rows with null, empty or very long texts, null sources and repeated or null doc_ids pass each stage as its operator says:
texts without ten words go in the first; of rows that are alike one stays in the second, so later stages see each once;
ties among these fall to the smallest doc_id. Other columns are carried to the last stage, whatever their names. An empty
table gives an empty table of each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from patchloom.llm.decontaminate import remove_contaminated
from patchloom.llm.mixing import take_mix
from patchloom.llm.quality_rules import keep_good
from patchloom.llm.sharding import shard_documents
from patchloom.llm.simhash import keep_one
from patchloom.tables import folders, forget, materialize, recording


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their own counts and their host's verdict keep."""
    return keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates."""
    return keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold enough of a benchmark passage."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for every epoch of its source that takes it."""
    return take_mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, source and lang of every row."""
    return shard_documents(docs, carry=("source", "lang"))


#: Metadata of a result's doc_id, kept by Parquet: the folders that its stage wrote on its way.
LEFT = "folders_left_by_the_stage"


def _staged(stage: Callable[..., DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage; when it begins, what the stage before wrote on its way is deleted, unless docs still reads it.

    The list of these folders comes with docs itself, so runs side by side, over one folder or several, don't meet.
    """

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if left := docs.schema["doc_id"].metadata.get(LEFT):
            read = {f.rsplit("/", 1)[-1] for f in folders(docs)}
            forget(spark, [p for p in left if p.rsplit("/", 1)[-1] not in read])
        with recording() as made:
            found = stage(spark, docs, sf_dir)
        return found.withMetadata("doc_id", {LEFT: made})

    run_stage.__doc__ = stage.__doc__
    return run_stage


STAGES = [
    (name, _staged(stage))
    for name, stage in [
        ("quality_rules", quality_stage),
        ("near_duplicates", near_duplicate_stage),
        ("decontamination", decontamination_stage),
        ("mixing", mixing_stage),
        ("sharding", sharding_stage),
    ]
]

#: Fingerprints (XXH64) and the label rounds can't be written in DuckDB SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), done_with=before)
        before = [docs]
    return docs
