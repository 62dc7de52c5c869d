"""Near duplicates by SimHash fingerprints and BK-trees.

Fingerprints that differ in at most RADIUS of 64 bits are linked, and linked documents form components. Two such
fingerprints agree on at least two of six bit blocks, so each fingerprint goes to fifteen shards, one for each pair
of blocks, keyed by the bits of the pair. Each shard has a BK-tree, whose edges carry the Hamming distance from child
to parent; every fingerprint of the shard is looked up in it, along the edges within the radius of its own distance.
Trees travel to their shard's queries by the shuffle. They aren't broadcast, as fingerprints grow with the corpus.

Copies of one fingerprint are one vertex, so that groups of copies cost nothing. A shard of more than SHARD_LIMIT
fingerprints is cut into chunks, and each pair of chunks gets a tree of its own. Tasks return a spanning forest of
each shard's links and not all its pairs.

Null and empty texts have fingerprint zero and are linked like any other. Rows that share a doc_id keep a row each.
Null doc_ids take part, but are never a component's id unless all its ids are null. An empty table gives an empty one.
A very long text is handled alone, whole, its shingles in parts. A bit that exactly half the shingles set is 0. Columns of
any other name are not read, or carried unchanged where rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_space_words, map_texts, materialize

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Bit blocks (first bit, width); RADIUS differing bits leave two of these six blocks alone.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
SHARD_LIMIT = 8192
#: Fingerprints that a task handles at once, and (query, node) pairs that a search step holds.
FOREST_ROWS, STEP_PAIRS = 50_000, 1_000_000

FINGERPRINT = T.StructType([T.StructField("fp", T.LongType())])


def fingerprint(text: bytes | None) -> int:
    """The unsigned 64-bit SimHash of a text."""
    words = lower_space_words(text)
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(flat[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())], np.uint64)
    votes = np.zeros(64, np.int64)
    for part in np.array_split(hashes, max(1, len(hashes) // 100_000)):
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _prints(texts: list[bytes | None]) -> list[np.ndarray]:
    return [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, one row for each document."""
    return map_texts(docs, [doc_id], text, FINGERPRINT, _prints)


class Forest:
    """A BK-tree for each run of equal shard numbers, in flat arrays. Fingerprints of a shard are distinct."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        n = len(fp)
        self.fp = fp
        self.root = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        self.tree = np.repeat(np.arange(len(self.root)), np.diff(np.append(self.root, n)))
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        left, group = np.arange(n), self.tree.copy()
        while len(left):
            # the first item of each group is a node; the others move on to the child at their distance from it
            order = np.argsort(group, kind="stable")
            left, group = left[order], group[order]
            first = np.concatenate([[True], group[1:] != group[:-1]])
            node = left[first][np.cumsum(first) - 1][~first]
            left = left[~first]
            distance = np.bitwise_count(fp[left] ^ fp[node]).astype(np.int64)
            parent[left], edge[left] = node, distance
            group = node * 65 + distance
        child = np.flatnonzero(parent >= 0)
        key = parent[child] * 65 + edge[child]
        order = np.argsort(key)
        self.child, self.key = child[order], key[order]

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of linked items, in pieces; each pair from either side."""
        sizes = np.bincount(self.tree)
        step = max(1, STEP_PAIRS // int(sizes.max()))
        for a in range(0, len(self.fp), step):
            query = np.arange(a, min(a + step, len(self.fp)))
            node = self.root[self.tree[query]]
            while len(query):
                distance = np.bitwise_count(self.fp[query] ^ self.fp[node]).astype(np.int64)
                near = (distance <= radius) & (query != node)
                if near.any():
                    yield query[near], node[near]
                low = np.searchsorted(self.key, node * 65 + np.maximum(distance - radius, 0), "left")
                high = np.searchsorted(self.key, node * 65 + np.minimum(distance + radius, 64), "right")
                n = high - low
                query = np.repeat(query, n)
                node = self.child[np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]


def first_of_component(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n items, the first item that it is linked with over any number of links."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            open_ = low < high
            if not open_.any():
                break
            np.minimum.at(label, high[open_], low[open_])
            while (label[label] != label).any():
                label = label[label]
    return label


def _link_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard -> links (a, b) that join each shard's linked fingerprints; shards may span batches."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[np.ndarray] = []

    def solve(rows: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)])
        shard = np.cumsum(new)
        alone = np.bincount(shard)[shard] == 1
        rows, shard = rows[~alone], shard[~alone]
        if not len(rows):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, schema=schema)
        fp = np.ascontiguousarray(rows[:, -1])
        label = first_of_component(len(fp), Forest(shard, fp.view(np.uint64)).links(RADIUS))
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[label[moved]])], schema=schema)

    for batch in batches:
        if batch.num_rows:
            held.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
        if sum(map(len, held)) >= FOREST_ROWS:
            rows = np.concatenate(held)
            last = np.flatnonzero((rows[:, :-1] != rows[-1, :-1]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield solve(rows[:cut])
            held = [rows[cut:]]
    if held:
        yield solve(np.concatenate(held))


def near_links(distinct: DataFrame, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints `fp` at RADIUS or fewer differing bits."""
    keys = []
    for i, ((a, n), (b, m)) in enumerate(combinations(BLOCKS, 2)):
        bits = F.shiftrightunsigned("fp", a).bitwiseAND((1 << n) - 1) * (1 << m) + F.shiftrightunsigned("fp", b).bitwiseAND((1 << m) - 1)
        keys.append(F.lit(i << 22).cast("long") + bits)
    rows = distinct.select(F.explode(F.array(*keys)).alias("shard"), "fp")
    large = materialize(rows.groupBy("shard").count().where(F.col("count") > shard_limit))
    whole = rows.select("shard", F.lit(0).alias("c"), F.lit(0).alias("d"), "fp")
    if large.limit(1).count():
        chunks = F.ceil(F.col("count") / shard_limit).cast("int")
        cut = rows.join(large, "shard").withColumn("n", chunks).withColumn("x", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
        pairs = cut.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        cut = pairs.select("shard", (F.least("x", "y") + 1).alias("c"), (F.greatest("x", "y") + 1).alias("d"), "fp")
        whole = whole.join(large.select("shard"), "shard", "left_anti").unionByName(cut)
    dealt = whole.repartition("shard", "c", "d").sortWithinPartitions("shard", "c", "d")
    return dealt.mapInArrow(_link_shards, "a long, b long")


def connected_components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of the links (a, b).

    Each round, a node hooks to its smallest neighbour, hooks are followed to their ends, and links are drawn between
    what is left. At least half of the nodes with links go in each round.
    """
    left = materialize(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up")))
        while True:
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            followed = materialize(hook.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            hook = followed.select("node", "up")
            if not followed.where("moved").limit(1).count():
                break
        to_a, to_b = hook.toDF("a", "x"), hook.toDF("b", "y")
        left = materialize(left.join(to_a, "a").join(to_b, "b").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if found is None:
            found = hook.toDF("node", "component")
        else:
            then = hook.toDF("component", "up")
            found = found.join(then, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    return found if found is not None else left.select(F.col("a").alias("node"), F.col("b").alias("component"))


def groups_of(marked: DataFrame, shard_limit: int = SHARD_LIMIT) -> tuple[DataFrame, DataFrame]:
    """From rows (doc_id, fp, uid): fp and component of each fingerprint, and each component's first row (doc_id, uid), nulls last.

    Both are written, so that joins with them can split a component or fingerprint of very many rows.
    """
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("uid"))
    distinct = materialize(marked.groupBy("fp").agg(F.min(first).alias("first")))
    component = materialize(connected_components(near_links(distinct.select("fp"), shard_limit)))
    linked = materialize(distinct.join(component, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component")), done_with=[distinct, component])
    lowest = materialize(linked.groupBy("component").agg(F.min("first").alias("first")).select("component", "first.doc_id", "first.uid"))
    return linked.select("fp", "component"), lowest


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) for every row."""
    marked = materialize(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))))
    linked, lowest = groups_of(marked.withColumn("uid", F.lit(0).cast("long")), shard_limit)
    names = linked.join(lowest.select("component", F.col("doc_id").alias("component_id")), "component").select(F.col("fp").alias("__fp"), "component_id")
    return marked.join(names, F.col("fp") == F.col("__fp")).select(F.col("doc_id").alias(doc_id), "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """One row of each component, with all columns: one with the smallest doc_id, and one without a doc_id only if all are."""
    inner = [f"__c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, inner, strict=True))
    marked = map_texts(docs.toDF(*inner), inner, at[text], FINGERPRINT, _prints)
    marked = materialize(marked.withColumn("__uid", F.monotonically_increasing_id()))
    _, lowest = groups_of(marked.select(F.col(at[doc_id]).alias("doc_id"), "fp", F.col("__uid").alias("uid")), shard_limit)
    kept = marked.join(lowest.select(F.col("uid").alias("__uid")), "__uid", "left_semi")
    return kept.select(*[F.col(v).alias(k) for k, v in at.items()])


def op6_simhash_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
