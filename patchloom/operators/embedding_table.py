"""Embeddings of chunk contents in buckets by (repository_id, content_hash), so that refreshes join them where they lie.

The table has one row for each content of a repository. Refreshes look their chunks' keys up in it, and only these keys
are shuffled, to the table's own buckets; stored keys and vectors are read by bucket, in place, keys alone where no vector
is needed. Contents that lack an embedding are embedded once each and become a run of their own, committed as a version
of a Store: readers stay with the version that they opened, and a refresh that dies shows nowhere. If another writer commits
first, what it added is taken out of the run, and nothing is embedded again.

Each run is bucketed alike, so all runs of a version are one bucketed scan. compact() makes them one run, drops contents
that no chunk has any more, and may deal the table over another number of buckets as it grows. The number is kept in the
version's schema, so readers need not know it.

Chunks with a null repository or hash take no part: they get no embedding and are not stored. Of several embeddings of
one key that are added together, the least counts; a key that is stored already keeps what it has. Without any version, or
any chunk, results are empty or without embeddings. Contents of any length are told apart by their hash alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import Conflict, Run, Store
from ..tables import materialize
from .indexing import KEYS, embed

TABLE = "embeddings"
DATABASE = "spark_catalog.default"
EMBEDDINGS = T.StructType([T.StructField("repository_id", T.LongType()), T.StructField("content_hash", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
COLUMNS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EMBEDDINGS)


class EmbeddingTable:
    """A folder of embeddings. `buckets` counts for its first run; about 128 MB of embeddings a bucket is a good size."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        if set(root) & set("*?[]{}"):
            raise ValueError(f"a pattern is no folder name: {root}")
        self.spark, self.store, self.first_buckets = spark, Store(spark, root, {TABLE: []}), buckets

    def version(self) -> int:
        return self.store.version()

    def buckets(self, version: int | None = None) -> int:
        known = self.store.manifest(version).get(TABLE)
        return T.StructType.fromJson(json.loads(known["schema"]))["content_hash"].metadata["buckets"] if known else self.first_buckets

    # reading

    def _scan(self, runs: list[str], buckets: int) -> DataFrame:
        # a bucketed table needs a name in the catalog while it is looked up, and not longer
        name, files = f"{DATABASE}.{TABLE}_{uuid.uuid4().hex}", f"{self.store.root}/{TABLE}/{{{','.join(runs)}}}/rows"
        quoted = files.replace("\\", "\\\\").replace("'", "\\'")
        try:
            self.spark.sql(f"CREATE TABLE {name} ({COLUMNS}) USING parquet CLUSTERED BY ({', '.join(KEYS)}) INTO {buckets} BUCKETS LOCATION '{quoted}'")
            return self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def read(self, version: int | None = None) -> DataFrame:
        """repository_id, content_hash and embedding at a version, in buckets."""
        known = self.store.manifest(version).get(TABLE)
        return self._scan(known["runs"], self.buckets(version)) if known else self.spark.createDataFrame([], EMBEDDINGS)

    def _keys(self, chunks: DataFrame, version: int) -> DataFrame:
        """How many chunks have each key; counted before they are dealt over the table's buckets."""
        keys = chunks.select(F.col("repository_id").cast("bigint"), "content_hash").where("repository_id is not null and content_hash is not null")
        return keys.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_chunks")).repartition(self.buckets(version), *KEYS)

    def vectors(self, chunks: DataFrame, version: int | None = None) -> DataFrame:
        """The chunks' different keys that have an embedding, with it."""
        at = self.version() if version is None else version
        return self._keys(chunks, at).join(self.read(at), KEYS).select(*KEYS, "embedding")

    def attach(self, chunks: DataFrame, version: int | None = None) -> DataFrame:
        """All chunks with `embedding`, null where the table has none."""
        return chunks.join(materialize(self.vectors(chunks, version)), KEYS, "left")

    def missing(self, chunks: DataFrame, version: int | None = None) -> DataFrame:
        """One chunk for each key without an embedding; contents are read for these keys only."""
        at = self.version() if version is None else version
        keys = materialize(self._keys(chunks, at).join(self.read(at).select(*KEYS), KEYS, "left_anti").select(*KEYS))
        return chunks.join(keys, KEYS, "left_semi").dropDuplicates(KEYS)

    def stats(self, chunks: DataFrame, version: int | None = None) -> DataFrame:
        """total, reused and embedded chunks of each repository, against a version; chunks without a key aren't counted."""
        at = self.version() if version is None else version
        known = self.read(at).select(*KEYS, F.lit(True).alias("known"))
        reused = F.sum(F.when(F.col("known"), F.col("n_chunks")).otherwise(0))
        return self._keys(chunks, at).join(known, KEYS, "left").groupBy("repository_id").agg(F.sum("n_chunks").alias("total"), reused.alias("reused"), (F.sum("n_chunks") - reused).alias("embedded"))

    # writing

    def _deal(self, rows: DataFrame, buckets: int) -> DataFrame:
        return rows.select(*[F.col(f.name).cast(f.dataType) for f in EMBEDDINGS]).repartition(buckets, *KEYS)

    def _write(self, dealt: DataFrame, buckets: int) -> Run:
        """A run that no version names yet; rows that were dealt make a file a bucket."""
        name, run = f"{DATABASE}.{TABLE}_{uuid.uuid4().hex}", uuid.uuid4().hex
        try:
            dealt.write.format("parquet").bucketBy(buckets, *KEYS).option("path", f"{self.store.root}/{TABLE}/{run}/rows").saveAsTable(name)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        schema = T.StructType([T.StructField(f.name, f.dataType, metadata={"buckets": buckets} if f.name == "content_hash" else {}) for f in EMBEDDINGS])
        return Run(TABLE, run, schema.json())

    def add(self, embedded: DataFrame) -> int:
        """A version with these embeddings (repository_id, content_hash, embedding) besides the stored ones; its number."""
        whole = embedded.where("repository_id is not null and content_hash is not null and embedding is not null")
        rows = whole.groupBy(*KEYS).agg(F.min("embedding").alias("embedding"))
        while True:
            begun = self.version()
            buckets = self.buckets(begun)
            new = self._deal(rows, buckets).join(self.read(begun).select(*KEYS), KEYS, "left_anti").select(*EMBEDDINGS.names)
            run = self._write(new, buckets)
            try:
                return self.store.commit(run, expected=begun)
            except Conflict:
                rows = self._scan([run.name], buckets)

    def refresh(self, chunks: DataFrame, text: str = "content", load: Callable | None = None) -> int:
        """The version in which every chunk's content has an embedding; each content that lacked one is embedded once."""
        lacking = self.missing(chunks).select(*KEYS, text)
        return self.add(embed(lacking, text, load) if load else embed(lacking, text))

    def compact(self, live: DataFrame | None = None, buckets: int | None = None) -> int:
        """A version of one run: the keys of the `live` chunks, or all, over so many buckets, or as many as before.

        Runs committed meanwhile stay after it; with another number of buckets they make it a Conflict.
        """
        begun = self.version()
        before = self.buckets(begun)
        after = buckets or before
        kept = self.read(begun) if live is None else self.vectors(live, begun)
        return self.store.stand_in(TABLE, begun, self._write(self._deal(kept, after), after), alone=after != before)
