"""Retrieval: exact cosine search, BM25 over an inverted index, reciprocal-rank fusion, domain re-ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.text import is_validation, tokenize_code
from ..tables import materialize

if TYPE_CHECKING:
    from .lexical_index import LexicalIndex
    from .vector_index import VectorIndex

# Fixed values.
K1, B = 1.5, 0.75
RRF_OFFSET = 60
SEMANTIC_WEIGHT, LEXICAL_WEIGHT = 1.0, 0.3
TEST_WEIGHT, VALIDATION_WEIGHT = 0.82, 0.82
TOP_K, LEAST_FETCH = 8, 5
MAX_QUERIES, MAX_QUERY_CHARS = 6, 2000
#: Places that scores are rounded to before ranking, so that sums in another order rank alike.
PLACES = 9
#: Queries and chunks of a repository that meet in one task at most, on average.
QUERY_BLOCK, CHUNK_BLOCK = 4096, 8192
#: The same where each pair is a row of the result, which a task holds for one block at a time.
PAIR_QUERIES, PAIR_CHUNKS = 512, 2048


def exclude_files(chunks: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks (or postings) without those whose file a review changed."""
    return chunks.join(changed.select(*keys).distinct(), keys, "left_anti")


def forward_index(chunks: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(repository_id, chunk_id, file_path, carried columns, len, terms): the tokens of each chunk counted in its row, without a shuffle.

    A chunk without content (null) has no terms and a null length: it counts as a chunk, but not for the mean length.
    """
    tokens = chunks.select("repository_id", F.col("id").alias("chunk_id"), "file_path", *carry, tokenize_code(F.col("content")).alias("t"))
    names, at = [*tokens.columns[:-1], "len", "terms"], len(tokens.columns) - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column(at))
            coded = batch.column(at).flatten().dictionary_encode()
            k = max(1, len(coded.dictionary))
            row = np.repeat(np.arange(batch.num_rows), sizes.fill_null(0).to_numpy(zero_copy_only=False))
            pair, tf = np.unique(row * k + coded.indices.to_numpy(), return_counts=True)
            terms = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(pair % k)), pa.array(tf, pa.int64())], ["term", "tf"])
            ends = pa.array(np.searchsorted(pair, np.arange(batch.num_rows + 1) * k), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], sizes.cast(pa.int32()), pa.ListArray.from_arrays(ends, terms)], names)

    schema = T.StructType(tokens.schema.fields[:at]).add("len", T.IntegerType()).add("terms", T._parse_datatype_string("array<struct<term:string,tf:bigint>>"))
    return tokens.mapInArrow(count, schema)


def inverted_index(chunks: DataFrame) -> DataFrame:
    """(repository_id, chunk_id, file_path, len, term, tf): one row a chunk and term."""
    return forward_index(chunks).select("repository_id", "chunk_id", "file_path", "len", F.inline("terms"))


def document_frequency(index: DataFrame, keys: tuple[str, ...] = ("repository_id",)) -> DataFrame:
    """Chunks that hold each term."""
    return index.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("df"))


def length_stats(chunks: DataFrame, keys: tuple[str, ...] = ("repository_id",)) -> DataFrame:
    """Chunks and their tokens, empty chunks included."""
    size = F.size(tokenize_code(F.col("content")))
    return chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("total_len"), F.avg(size).alias("avg_len"))


def lengths() -> tuple[Column, Column]:
    """Aggregates of chunks: those that have a content, and all tokens."""
    return F.count("len").alias("known"), F.sum("len").alias("total_len")


def mean_length() -> Column:
    """Tokens of a chunk that has a content; null if none has."""
    return F.try_divide("total_len", "known")


def without(reviews: DataFrame, gone: DataFrame) -> DataFrame:
    """reviews (review_id, repository_id, n, known, total_len), less what rows of the same columns hold for each."""
    counts = ["n", "known", "total_len"]
    less = gone.groupBy("review_id", "repository_id").agg(*[F.sum(c).alias(f"gone_{c}") for c in counts])
    left = [(F.col(c) - F.coalesce(f"gone_{c}", F.lit(0))).alias(c) for c in counts]
    return reviews.join(less, ["review_id", "repository_id"], "left").select("review_id", "repository_id", *left)


def idf(n: Column, df: Column) -> Column:
    """max(0, (n - df + 0.5) / (df + 0.5)), without a logarithm."""
    return F.greatest(F.lit(0.0), (n - df + 0.5) / (df + 0.5))


def bm25_scores(chunks: DataFrame, queries: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """(review_id, seq, chunk_id, score > 0) of queries (review_id, seq, repository_id, text) over their repository.

    The index is built and written once for a repository. A review's own numbers, without its changed files, come by
    subtracting what those files hold. Postings meet query terms first, so that only terms in use are joined further.
    """
    terms = queries.select("review_id", "seq", "repository_id", F.explode(F.array_distinct(tokenize_code(F.col("text")))).alias("term"))
    used = terms.select("repository_id", "term").distinct()
    whole = materialize(forward_index(chunks))
    postings = whole.select("repository_id", "chunk_id", "file_path", "len", F.inline("terms"))
    index = materialize(postings.join(used, ["repository_id", "term"]))
    df = document_frequency(index)
    stats = whole.groupBy("repository_id").agg(F.count(F.lit(1)).alias("n"), *lengths())
    reviews = queries.select("review_id", "repository_id").distinct().join(stats, "repository_id")
    if changed is not None:
        gone = changed.select("review_id", "file_path").distinct()
        files = whole.groupBy("repository_id", "file_path").agg(F.count(F.lit(1)).alias("n"), *lengths())
        file_df = index.groupBy("repository_id", "file_path", "term").agg(F.count(F.lit(1)).alias("gone_df"))
        out = gone.join(queries.select("review_id", "repository_id").distinct(), "review_id")
        reviews = without(reviews, out.join(files, ["repository_id", "file_path"]))
        less_df = out.join(file_df, ["repository_id", "file_path"]).groupBy("review_id", "repository_id", "term").agg(F.sum("gone_df").alias("gone_df"))
    hits = terms.join(index, ["repository_id", "term"])
    if changed is not None:
        hits = hits.join(gone, ["review_id", "file_path"], "left_anti")
    hits = hits.join(df, ["repository_id", "term"]).join(reviews, ["review_id", "repository_id"])
    if changed is not None:
        hits = hits.join(less_df, ["review_id", "repository_id", "term"], "left").withColumn("df", F.col("df") - F.coalesce("gone_df", F.lit(0)))
    avg = mean_length()
    ratio = F.when(avg > 0, F.col("len") / avg).otherwise(F.lit(1.0))
    part = idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * ratio))
    return hits.groupBy("review_id", "seq", "chunk_id").agg(F.round(F.sum(part), PLACES).alias("score")).where("score > 0")


def half_up(x: Column, places: int) -> Column:
    """x rounded as DuckDB does it: the double that the multiplication gives, halves away from zero. F.round goes by x's shortest decimals."""
    return F.signum(x) * F.floor(F.abs(x) * 10.0**places + 0.5) / 10.0**places


def _dealt(asked: DataFrame, usable: DataFrame, rows: int, columns: int) -> tuple[DataFrame, DataFrame]:
    """A repository's queries (review_id, seq) and chunks (chunk_id) dealt over blocks of about so many, each block repeated for every one of the other side."""
    blocks = lambda df, size, name: df.groupBy("repository_id").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    grid = materialize(blocks(asked, rows, "__rows").join(blocks(usable, columns, "__columns"), "repository_id"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(grid, "repository_id").withColumn("__row", F.pmod(F.xxhash64("review_id", "seq"), F.col("__rows")).cast("int")).withColumn("__column", every("__columns"))
    right = usable.join(grid, "repository_id").withColumn("__column", F.pmod(F.xxhash64("chunk_id"), F.col("__columns")).cast("int")).withColumn("__row", every("__rows"))
    return left, right


def cosine_distances(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(review_id, seq, chunk_id, distance) of every query and chunk of one repository; 1 for a vector of zeros, null without a vector.

    Both are dealt over blocks, and each pair of blocks meets in a task, which multiplies them and holds their pairs only.
    """
    asked, usable = queries.select("review_id", "seq", "repository_id", "vector"), chunks.select("repository_id", F.col("id").alias("chunk_id"), "vector")
    left, right = _dealt(asked, usable, PAIR_QUERIES, PAIR_CHUNKS)

    def multiply(own: pa.Table, block: pa.Table) -> pa.Table:
        known = [x.column("vector").combine_chunks().is_valid().to_numpy(zero_copy_only=False) for x in (own, block)]
        distance = np.zeros((own.num_rows, block.num_rows))
        if known[0].any() and known[1].any():
            a, b = (_matrix(x.column("vector").filter(pa.array(k))) for x, k in zip((own, block), known, strict=True))
            norms = np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
            cosine = np.divide(a @ b.T, norms, out=np.zeros_like(norms), where=norms != 0)
            distance[np.ix_(*known)] = np.floor((1 - cosine) * 10.0**PLACES + 0.5) / 10.0**PLACES
        row, column = pa.array(np.repeat(np.arange(own.num_rows), block.num_rows)), pa.array(np.tile(np.arange(block.num_rows), own.num_rows))
        ids = {c: own.column(c).combine_chunks().take(row) for c in ("review_id", "seq")}
        return pa.table(ids | {"chunk_id": block.column("chunk_id").combine_chunks().take(column), "distance": pa.array(distance.ravel(), mask=~np.outer(*known).ravel())})

    schema = T.StructType([left.schema["review_id"], left.schema["seq"], right.schema["chunk_id"]]).add("distance", T.DoubleType())
    return _cogrouped(left, right, ["review_id", "seq", "vector"], ["chunk_id", "vector"], ["repository_id", "__row", "__column"], multiply, schema)


def _cogrouped(left: DataFrame, right: DataFrame, own: list[str], others: list[str], keys: list[str], func: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType | str) -> DataFrame:
    """The named columns of both sides, met by the keys in their common type: unlike a join, a cogroup doesn't bring them to
    one, and an int and the same long go to different tasks."""
    alike = lambda other: [F.coalesce(k, F.lit(None).cast(other.schema[k].dataType)).alias(k) for k in keys]
    return left.select(*own, *alike(right)).groupBy(*keys).cogroup(right.select(*others, *alike(left)).groupBy(*keys)).applyInArrow(func, schema)


def with_masks(queries: DataFrame, changed: DataFrame | None) -> DataFrame:
    """Queries with a vector, and the files that their review changed as `masked`."""
    asked = queries.where("vector is not null").select("review_id", "seq", "repository_id", "vector")
    if changed is None:
        return asked.withColumn("masked", F.lit(None).cast("array<string>"))
    return asked.join(changed.groupBy("review_id").agg(F.collect_set("file_path").alias("masked")), "review_id", "left")


def cosine_topk(chunks: DataFrame, queries: DataFrame, k: int, changed: DataFrame | None = None) -> DataFrame:
    """(review_id, seq, chunk_id, distance): the k nearest chunks of each query in its repository, exactly.

    A repository's queries and chunks are dealt over blocks, and each pair of blocks meets in a task, which multiplies
    them and keeps each query's k best; a window takes the k best of all. A review's changed files are masked before.
    Chunks and queries without a vector take no part; a vector of zeros is at distance 1 from all.
    """
    asked = materialize(with_masks(queries, changed))
    usable = chunks.where("vector is not null").select("repository_id", F.col("id").cast("long").alias("chunk_id"), "file_path", "vector")
    left, right = _dealt(asked, usable, QUERY_BLOCK, CHUNK_BLOCK)
    return top_per_query(blockwise(left, right, ["repository_id", "__row", "__column"], k), "distance", k)


def blockwise(left: DataFrame, right: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(review_id, seq, chunk_id, distance): for each block, named by the keys, the k nearest of its chunks (chunk_id,
    file_path, vector) for each of its queries (review_id, seq, vector, masked); one task multiplies a block."""

    def search(own: pa.Table, block: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if own.num_rows and block.num_rows:
            ids, files = block.column("chunk_id").to_numpy(), np.array(block.column("file_path").to_pylist(), object)
            there = _unit(_matrix(block.column("vector")))
            for a in range(0, own.num_rows, 256):
                part = own.slice(a, 256)
                distance = np.round(1 - _unit(_matrix(part.column("vector"))) @ there.T, PLACES)
                for row, review, seq, masked in zip(distance, *(part.column(c).to_pylist() for c in ("review_id", "seq", "masked")), strict=True):
                    open_ = np.flatnonzero(~np.isin(files, masked)) if masked else np.arange(len(ids))
                    best = open_[np.lexsort((ids[open_], row[open_]))[:k]]
                    for column, values in zip(out, ([review] * len(best), [seq] * len(best), ids[best].tolist(), row[best].tolist()), strict=True):
                        column += values
        return pa.table(dict(zip(("review_id", "seq", "chunk_id", "distance"), (pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)), strict=True)))

    schema = "review_id long, seq long, chunk_id long, distance double"
    own = left.withColumn("seq", F.col("seq").cast("long"))
    return _cogrouped(own, right, ["review_id", "seq", "vector", "masked"], ["chunk_id", "file_path", "vector"], keys, search, schema)


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows, from Arrow's own flat values."""
    flat = vectors.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def top_per_query(hits: DataFrame, value: str, k: int, largest: bool = False) -> DataFrame:
    """The k best rows of each (review_id, seq); ties by chunk."""
    order = F.desc(value) if largest else F.asc(value)
    nth = F.row_number().over(W.partitionBy("review_id", "seq").orderBy(order, "chunk_id"))
    return hits.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


def best_per_chunk(hits: DataFrame, value: str, largest: bool = False) -> DataFrame:
    """Each chunk's best value over the queries of a review."""
    return hits.groupBy("review_id", "chunk_id").agg((F.max if largest else F.min)(value).alias(value))


def ranked(best: DataFrame, value: str, largest: bool = False) -> DataFrame:
    """Rank from 1 within a review; ties by chunk."""
    order = F.desc(value) if largest else F.asc(value)
    return best.withColumn("rank", F.row_number().over(W.partitionBy("review_id").orderBy(order, "chunk_id")))


def rrf_score(rank: Column) -> Column:
    return 1.0 / (RRF_OFFSET + rank)


def rrf_fuse(semantic: DataFrame, lexical: DataFrame) -> DataFrame:
    """The union of two ranked lists with the weighted sum of their reciprocal ranks."""
    s = semantic.select("review_id", "chunk_id", F.col("rank").alias("s_rank"))
    t = lexical.select("review_id", "chunk_id", F.col("rank").alias("t_rank"))
    zero = F.lit(0.0)
    score = SEMANTIC_WEIGHT * F.coalesce(rrf_score(F.col("s_rank")), zero) + LEXICAL_WEIGHT * F.coalesce(rrf_score(F.col("t_rank")), zero)
    return s.join(t, ["review_id", "chunk_id"], "full_outer").select("review_id", "chunk_id", score.alias("score"))


def domain_rerank(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    """distance = weight / score, smaller for tests and for checking code."""
    known = chunks.select(F.col("id").alias("chunk_id"), "symbol_name", "is_test")
    weight = F.when(F.col("is_test"), TEST_WEIGHT).otherwise(1.0) * F.when(is_validation(F.col("symbol_name")), VALIDATION_WEIGHT).otherwise(1.0)
    return fused.join(known, "chunk_id").withColumn("distance", F.round(weight / F.col("score"), PLACES)).select("review_id", "chunk_id", "score", "distance")


def final_topk(reranked: DataFrame, k: int = TOP_K) -> DataFrame:
    return ranked(reranked, "distance").where(F.col("rank") <= k)


def usable_queries(queries: DataFrame) -> DataFrame:
    """The first MAX_QUERIES queries of each review that aren't blank, cut to MAX_QUERY_CHARS."""
    cut = queries.withColumn("text", F.substring("text", 1, MAX_QUERY_CHARS)).where(~F.col("text").rlike(r"^\s*$"))
    return cut.withColumn("nth", F.row_number().over(W.partitionBy("review_id").orderBy("seq"))).where(F.col("nth") <= MAX_QUERIES).drop("nth")


def retrieve_context(chunks: DataFrame, queries: DataFrame, changed: DataFrame | None = None, k: int = TOP_K, index: LexicalIndex | None = None, vectors: VectorIndex | None = None) -> DataFrame:
    """(review_id, chunk_id, score, distance, rank): both searches, fused, re-ranked and cut to k for each review.

    With a stored lexical index of the same chunks, that one is searched, and no chunk is tokenized; likewise with one of
    their vectors.
    """
    used, fetch = usable_queries(queries), max(k, LEAST_FETCH)
    nearest = vectors.search(used, fetch, changed).hits if vectors else cosine_topk(chunks, used.where("vector is not null"), fetch, changed)
    semantic = ranked(best_per_chunk(nearest, "distance"), "distance")
    lexical = index.search(used, fetch, changed).hits if index else top_per_query(bm25_scores(chunks, used, changed), "score", fetch, largest=True)
    lexical = ranked(best_per_chunk(lexical, "score", largest=True), "score", largest=True)
    return final_topk(domain_rerank(rrf_fuse(semantic, lexical), chunks), k)
