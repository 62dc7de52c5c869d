"""A stored index for exact nearest chunks by cosine: blocks round pivots, skipped by the triangle inequality.

About one in BLOCK_CHUNKS of a repository's vectors, drawn by hash, are pivots; every vector belongs to the nearest one's
block, whose radius is the largest angle to it. No vector of a block is nearer to a query than the query's angle to the
pivot less the radius, since angles obey the triangle inequality (a vector of zeros is at a right angle to all).

A search computes each query's angles to its repository's pivots, multiplies the FIRST blocks with the least bounds, takes
the k-th distance as a ceiling, and multiplies the blocks whose bound is below it, the others not at all. The result is
that of multiplying everything. Much is skipped where vectors lie in groups, little where they are spread evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.store import Store
from ..tables import materialize
from .lexical_index import QUERY, Found
from .retrieval import CHUNK_BLOCK, QUERY_BLOCK, blockwise, cosine_distances, cosine_topk, top_per_query, with_masks

BLOCK_CHUNKS = 256
FIRST = 2
#: Radians by which bounds are loosened, for rounding.
SLACK = 1e-4
BLOCK = ["repository_id", "block"]


def angle(distance: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - distance)))


class VectorIndex:
    """The index in a folder; chunks have repository_id, id, file_path and vector. Those without a vector take no part."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.store = Store(spark, path, {"pivots": ["repository_id"], "vectors": ["repository_id"]})

    def refresh(self, chunks: DataFrame, repositories: DataFrame | None = None) -> int:
        """The given repositories (those of chunks by default) get exactly these vectors; the version that has them."""
        done = materialize((chunks if repositories is None else repositories).select("repository_id").distinct())
        began = self.store.version()
        rows = chunks.where("vector is not null").join(done, "repository_id", "left_semi").select("repository_id", F.col("id").cast("long").alias("id"), "file_path", "vector")
        draw = F.xxhash64("id", F.lit("pivot"))
        sizes = rows.groupBy("repository_id").agg(F.count(F.lit(1)).alias("n"), F.min(draw).alias("least"))
        chance = F.lit(2.0**64) / F.greatest(F.lit(1), F.least(F.col("n"), F.lit(BLOCK_CHUNKS)))
        drawn = ((draw.cast("double") + 2.0**63) < chance) | (draw == F.col("least"))
        pivots = materialize(rows.join(F.broadcast(sizes) if sizes.limit(100_001).count() <= 100_000 else sizes, "repository_id").where(drawn).select(*rows.columns))
        asked = rows.select(F.col("id").alias("review_id"), F.col("repository_id").cast("long").alias("seq"), "repository_id", "vector")
        near = materialize(cosine_topk(pivots, asked, 1)).select(F.col("review_id").alias("id"), F.col("seq").alias("__repository"), F.col("chunk_id").alias("block"), "distance")
        placed = rows.join(near, (rows["id"] == near["id"]) & (rows["repository_id"] == F.col("__repository"))).select(rows["repository_id"], "block", rows["id"].alias("chunk_id"), "file_path", "vector", "distance")
        placed = materialize(placed)
        radii = placed.groupBy(*BLOCK).agg(F.max(angle(F.col("distance"))).alias("radius"), F.count(F.lit(1)).alias("n"))
        named = pivots.select("repository_id", F.col("id").alias("block"), F.col("vector").alias("pivot")).join(radii, BLOCK)
        runs = [self.store.write("pivots", named, done), self.store.write("vectors", placed.drop("distance"), done, order=("repository_id", "block"))]
        return self.store.commit(*runs, expected=began)

    def search(self, queries: DataFrame, k: int, changed: DataFrame | None = None, version: int | None = None) -> Found:
        """The k nearest chunks of each query (review_id, seq, repository_id, vector), without the review's changed files."""
        at = self.store.version() if version is None else version
        asked = materialize(with_masks(queries, changed))
        pivots = self.store.read("pivots", at)
        to = cosine_distances(pivots.select("repository_id", F.col("block").alias("id"), F.col("pivot").alias("vector")), asked)
        to = to.join(asked.select(*QUERY, "repository_id"), QUERY).withColumnRenamed("chunk_id", "block").join(pivots.select(*BLOCK, "radius", "n"), BLOCK)
        bound = 1 - F.cos(F.greatest(F.lit(0.0), angle(F.col("distance")) - F.col("radius") - SLACK))
        nth = F.row_number().over(W.partitionBy(*QUERY).orderBy("bound", "distance", "block"))
        blocks = materialize(to.select(*QUERY, *BLOCK, "n", "distance", bound.alias("bound")).withColumn("nth", nth))
        vectors = self.store.read("vectors", at)

        def multiply(wanted: DataFrame) -> DataFrame:
            """Queries and a block's vectors, both dealt over parts if they are many, meet in a task for each pair of parts."""
            named = materialize(wanted.select(*QUERY, *BLOCK, "n"))
            parts = named.groupBy(*BLOCK).agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("rows"), F.ceil(F.max("n") / CHUNK_BLOCK).cast("int").alias("columns"))
            parts = materialize(parts)
            every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
            left = named.drop("n").join(asked, [*QUERY, "repository_id"]).join(parts, BLOCK).withColumn("row", F.pmod(F.xxhash64(*QUERY), F.col("rows")).cast("int")).withColumn("column", every("columns"))
            right = vectors.join(parts, BLOCK).withColumn("column", F.pmod(F.xxhash64("chunk_id"), F.col("columns")).cast("int")).withColumn("row", every("rows"))
            return blockwise(left, right.select(*BLOCK, "chunk_id", "file_path", "vector", "row", "column"), [*BLOCK, "row", "column"], k)

        first = materialize(top_per_query(multiply(blocks.where(F.col("nth") <= FIRST)), "distance", k))
        ceilings = first.groupBy(*QUERY).agg(F.count(F.lit(1)).alias("found"), F.max("distance").alias("ceiling")).where(F.col("found") == k)
        ruled = materialize(blocks.join(ceilings, QUERY, "left").withColumn("scored", (F.col("nth") <= FIRST) | (F.col("bound") <= F.coalesce("ceiling", F.lit(2.0)))))
        rest = multiply(ruled.where(F.col("scored") & (F.col("nth") > FIRST)))
        work = ruled.groupBy(*QUERY).agg(F.sum("n").alias("vectors"), F.sum(F.when(F.col("scored"), F.col("n")).otherwise(0)).alias("scored"))
        return Found(top_per_query(first.unionByName(rest), "distance", k), work)
