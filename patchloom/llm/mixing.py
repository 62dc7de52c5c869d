"""Mixing sources to target weights with a low-discrepancy schedule.

Sources in code-point order, null last, have the weights 1, 2, 3, 1, ... and share the words of all documents; a
source's target stops at MAX_EPOCHS times its size, and the others share the excess. A target is a number of blocks of
BLOCK_WORDS words, the last one cut to the word. The van der Corput point of each slot 0, 1, 2, ..., mapped through the
cumulative numbers of blocks, names the slot's source. A source's slots, ranked, take the blocks of its stream, one each:
its documents in shuffled order, gone through up to MAX_EPOCHS times. So any run of slots has the weights of the whole. A
source whose blocks are all placed leaves its later slots empty. After as many slots as there are blocks, some sources
still lack a few; the points go on for these alone, up to a power of two of slots, by which each source has enough (an
interval of b in N holds 2 b dyadic cells of that depth, each with one point). Documents follow their first block's slot.

A null text has size 0. Documents of size 0 are never taken. The order is the doc_id's md5, the size, then the text's
hash; rows that share all are equal but told apart, so repeated rows each have their own place, and whichever is first,
the result has the same rows. Other columns are only carried, whatever their names. Reruns agree. Rows with a null source are a source of their own, rows with a null doc_id documents
like any other. An empty table gives an empty mix. Sizes count whole texts, however long.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import join_small, materialize, number_rows

WEIGHTS = (1, 2, 3)
BLOCK_WORDS = 1024
MAX_EPOCHS = 3
#: Cells of the unit interval that slots and sources meet in: this many at least, and twice the sources.
CELLS = 1024


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def van_der_corput(n: Column) -> Column:
    """The base-2 radical inverse: the bits of n mirrored at the point."""
    return F.conv(F.reverse(F.lpad(F.bin(n), 40, "0")), 2, 10).cast("double") / F.lit(float(1 << 40))


def shuffled(doc_id: Column) -> Column:
    """A document's place in the shuffled order: the first 60 bits of its id's md5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """For each source: source_no, source_size, target, quota (the target in whole words), base and lo, the sizes and targets of all sources before."""
    sources = number_rows(sized.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()], "source_no")
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("source_no", F.lit(len(weights))).cast("int") + 1)
    numbered = materialize(sources.withColumn("weight", share).withColumn("most", (max_epochs * F.col("source_size")).cast("double")))
    total = numbered.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        # words for each unit of weight, given the sources that are full at the level before
        is_full = F.lit(level) * F.col("weight") > F.col("most")
        got = numbered.agg(F.coalesce(F.sum(F.when(is_full, F.col("most"))), F.lit(0.0)).alias("held"), F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0.0)).alias("open"), F.count_if(is_full).alias("n")).first()
        if got["n"] == full or not got["open"]:
            break
        full, level = got["n"], (total - got["held"]) / got["open"]
    target = F.least(F.col("most"), F.lit(level) * F.col("weight"))
    with_target = numbered.withColumn("target", target).withColumn("quota", F.round("target").cast("long")).drop("most", "weight")
    return number_rows(with_target, ["source_no"], "__place", sums={"base": "source_size", "lo": "target"}).drop("__place")


def placed_documents(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (uid, doc_id, source, size): documents with their first word's place in the source's stream, and the sources."""
    sources = materialize(source_targets(rows))
    spread = join_small(rows, sources.drop("lo"), "source", F.col("uid")).withColumn("__order", shuffled(F.col("doc_id")))
    ranked = number_rows(spread, ["source_no", "__order", "size", "tie", "uid"], "__place", sums={"__words": "size"})
    start = F.col("__words") - F.col("base")
    return materialize(ranked.select("uid", "doc_id", "source", "size", "source_no", "source_size", "target", "quota", start.alias("start"))), sources


def _named(points: DataFrame, cut: DataFrame, count: int) -> DataFrame:
    """(slot, source_no) of the points that lie in a source's interval; both meet in cells of the unit interval."""
    cells = cut.withColumn("cell", F.explode(F.sequence(F.least(F.lit(count - 1), F.floor(F.col("lo") * count)), F.least(F.lit(count - 1), F.floor(F.col("hi") * count)))))
    points = points.select(F.col("id").alias("slot"), van_der_corput(F.col("id")).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * count))
    within = (F.col("u") >= F.col("lo")) & ((F.col("u") < F.col("hi")) | F.col("last"))
    few = count <= 20 * CELLS  # there are at most twice as many pieces as cells
    return points.join(F.broadcast(cells) if few else cells, "cell").where(within).select("slot", "source_no")


def slots(spark, sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, source_no and rank, the block of the source's stream that the slot takes, from 0 to its last block."""
    blocks = sources.where("quota > 0").select("source_no", F.ceil(F.col("quota") / block_words).cast("long").alias("blocks"))
    numbered = materialize(number_rows(blocks, ["source_no"], "__place", sums={"before": "blocks"}).drop("__place"))
    n = numbered.agg(F.sum("blocks")).first()[0] or 0
    share = lambda x: x.cast("double") / F.lit(float(max(1, n)))
    end = F.col("before") + F.col("blocks")
    cut = numbered.select("source_no", "blocks", share(F.col("before")).alias("lo"), share(end).alias("hi"), (end == n).alias("last"))
    count = max(CELLS, 2 * cut.count())
    first = materialize(_named(spark.range(n), cut, count))
    have = first.groupBy("source_no").agg(F.count(F.lit(1)).alias("have"))
    lacking = materialize(cut.join(have, "source_no", "left").where(F.coalesce("have", F.lit(0)) < F.col("blocks")).drop("have"))
    named = first.unionByName(materialize(_named(spark.range(n, 1 << (4 * n).bit_length()), lacking, count))) if n else first
    # ranked in two steps: runs of slots first, then inside of each run
    run = max(1, math.isqrt(n))
    named = named.withColumn("run", F.floor(F.col("slot") / run))
    before = W.partitionBy("source_no").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = named.groupBy("source_no", "run").count().withColumn("head", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = F.row_number().over(W.partitionBy("source_no", "run").orderBy("slot")) - 1
    ranked = named.join(runs, ["source_no", "run"]).select("slot", "source_no", (F.col("head") + inside).alias("rank"))
    return join_small(ranked, blocks, "source_no", F.col("slot"), how="inner").where("rank < blocks").drop("blocks")


def schedule(placed: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix: slot, source_no, uid, epoch, offset in the block, first_word and n_words of each piece of a document in a slot."""
    ranked = materialize(slots(placed.sparkSession, sources, block_words))
    epochs = F.least(F.lit(max_epochs), F.ceil(F.col("quota") / F.col("source_size"))).cast("int")
    docs = placed.where("size > 0 and quota > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
    docs = docs.withColumn("at", F.col("epoch") * F.col("source_size") + F.col("start")).where("at < quota")
    end = F.least(F.col("at") + F.col("size"), F.col("quota"))
    pieces = docs.withColumn("end", end).withColumn("rank", F.explode(F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("end") - 1) / block_words))))
    lo = F.greatest(F.col("at"), F.col("rank") * block_words)
    hi = F.least(F.col("end"), (F.col("rank") + 1) * block_words)
    pieces = pieces.select("source_no", "rank", "uid", "epoch", (lo - F.col("rank") * block_words).alias("offset"), (lo - F.col("at")).alias("first_word"), (hi - lo).alias("n_words"))
    return pieces.join(ranked, ["source_no", "rank"]).select("slot", "source_no", "uid", "epoch", "offset", "first_word", "n_words")


def sized_rows(docs: DataFrame, doc_id: str, source: str, text: str, uid: Column) -> DataFrame:
    return materialize(docs.select(uid.alias("uid"), F.xxhash64(text).alias("tie"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, the words that the schedule takes, and first_slot, where it begins (null if never)."""
    placed, sources = placed_documents(sized_rows(docs, doc_id, source, text, F.monotonically_increasing_id()))
    taken = schedule(placed, sources).groupBy("uid").agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"))
    return placed.join(taken, "uid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot")


def take_mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixed corpus in the schedule's order: each row once for every epoch that takes some of it, whole, with all its columns, where its first piece is."""
    every = materialize(docs.withColumn("__uid", F.monotonically_increasing_id()))
    placed, sources = placed_documents(sized_rows(every, doc_id, source, text, F.col("__uid")))
    copies = schedule(placed, sources).groupBy(F.col("uid").alias("__uid"), "epoch").agg(F.min(F.struct("slot", "offset")).alias("__at")).drop("epoch")
    taken = every.join(materialize(copies), "__uid").orderBy("__at")
    return taken.select(*docs.columns)


def op8_source_mix(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: sizes, targets, words taken and the slot where each document begins."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
