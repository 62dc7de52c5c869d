"""Written tables in the folder that driver and executors share, and columns that a small helper appends batch by batch."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir"):
        return found
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, kind: str = "tables") -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"


_recorded: ContextVar[list[str] | None] = ContextVar("recorded", default=None)
#: Every folder that this process's materialize wrote and forget has not deleted, by its name without a scheme.
_written: dict[str, str] = {}


def _plain(folder: str) -> str:
    return urlsplit(folder).path.rstrip("/")


@contextmanager
def recording() -> Iterator[list[str]]:
    """The paths that materialize writes to meanwhile."""
    made: list[str] = []
    before = _recorded.set(made)
    try:
        yield made
    finally:
        _recorded.reset(before)


def materialize(df: DataFrame, done_with: list[DataFrame] | None = None) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: computed once, and safe from lost executors.

    done_with: tables of this kind that df came from and that nothing else reads; they are deleted once df is whole.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    _written[_plain(path)] = path
    if (made := _recorded.get()) is not None:
        made.append(path)
    for table in done_with or []:
        forget(df.sparkSession, folders(table))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folders(table: DataFrame) -> set[str]:
    """The folders of all files that a table is read from."""
    return {name.rsplit("/", 1)[0] for name in table.inputFiles()}


def forget(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes those of the folders that this process's materialize wrote; all others stay, whatever they are called."""
    for folder in paths:
        if written := _written.pop(_plain(folder), None):
            path = spark._jvm.org.apache.hadoop.fs.Path(written)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def number_rows(df: DataFrame, order: list[str | Column], name: str, sums: dict[str, str] | None = None) -> DataFrame:
    """df with each row's place in the order over all rows, from 0: range partitions, counted, then numbered inside.

    sums: names of running sums of columns over all rows before, by the same way.
    """
    sums = sums or {}
    dealt = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    above = W.partitionBy("__part").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    heads = dealt.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__sum_{k}") for k, c in sums.items()])
    heads = heads.select("__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in heads.columns[1:]])
    out = dealt.withColumn("__part", part).join(F.broadcast(heads), "__part").withColumn(name, F.col("__n") + inside)
    for k, c in sums.items():
        out = out.withColumn(k, F.col(f"__sum_{k}") + F.coalesce(F.sum(c).over(above), F.lit(0)))
    return out.select(*df.columns, name, *sums)


def append_columns(df: DataFrame, source: str, fields: str, func: Callable[[list], list], batch: int = 512, keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those to `keep`), then `fields`, made from `batch` values of a column at a time; a narrow step, row by row.

    func returns a list or an Arrow array for each field. What isn't kept doesn't come back from Python.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = df.columns if keep is None else keep
    sent = df if keep is None else df.select(*kept, F.col(source).alias("__source"))
    at = df.columns.index(source) if keep is None else len(kept)
    schema = T.StructType([*sent.schema.fields[: len(kept)], *T._parse_datatype_string(fields).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, batch):
                part = whole.slice(i, batch)
                made = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(func(part.column(at).to_pylist()), list(arrow)[len(kept) :], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *made], names=arrow.names)

    return sent.mapInArrow(run, schema)
