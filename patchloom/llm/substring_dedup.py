"""Substring deduplication by relative Lempel-Ziv factors.

The reference of a document is all documents with a smaller doc_id, indexed in blocks: shuffle partitions that map each
phrase of WINDOW words to the first place, in the earliest document, where it stands. A document is parsed greedily: a
factor starts at the first phrase that the index knows, with its reference and the place in it, and goes on to the
longest piece that stands there. Where the index names another place for the next phrase, the reference may go on as
well; its own index entries tell, as equal phrases have equal entries (a phrase that a reference holds twice may end
a factor early). Phrases that cross a factor's end are looked up
too, and start the next factor. So each factor is a verbatim piece of its reference, and each known phrase lies in a
factor. Factors are at least WINDOW words long; their words are removed.

The index is a shuffle and not a broadcast. Most phrases occur once, and they must not be shuffled: each phrase has an
anchor, the smallest hash of its ANCHOR-word runs, and only one in twenty positions is one. Anchors go first; phrases
follow only where their anchor occurs in two documents. A phrase's key is two 64-bit hashes, its own and its anchor's.
Small sides of joins are written before, so that Spark can split a phrase or anchor that very many documents share.

Rows are told apart by doc_id and the text's hash: rows of one doc_id are no reference for each other, and each keeps
or loses its own words. Null and empty texts, and texts of fewer than WINDOW words, keep all words. Copies of a text
are removed whole but for those of the smallest doc_id. A row with a null doc_id keeps its words and is no reference.
An empty table gives an empty result. A text larger than a slice is handled alone, whole. Columns of any other name
are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, covered, flatten, map_texts, materialize, sliced, space_words

WINDOW = 50
ANCHOR = 13

_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    """Word -> 64-bit hash, kept for the words seen."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    c = a * _P1 + (b ^ (b >> np.uint64(29))) * _P2
    return c ^ (c >> np.uint64(32))


def over_runs(values: np.ndarray, width: int, join: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """join of each `width` values in a row, from powers of two; one entry for each full run."""
    out, held, power, n = None, 0, values, 1
    while True:
        if width & n:
            part = power if out is None else power[held:]
            out = part if out is None else join(out[: len(part)], part[: len(out)])
            held += n
        if 2 * n > width:
            return out[: max(0, len(values) - width + 1)]
        power = join(power[:-n], power[n:]) if len(power) > n else power[:0]
        n *= 2


def phrases(texts: list[list[bytes]], memo: dict, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """document, place, hash and anchor of every phrase of `window` words."""
    words, bounds = flatten(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    if len(words) < window:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    base = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    whole = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :])
    lowest = over_runs(over_runs(base, anchor, _join), window - anchor + 1, np.minimum)
    own = over_runs(base, window, _join)
    return doc[whole], whole - bounds[doc[whole]], own[whole], lowest[whole]


def _slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute  # noqa: F401

    for batch in batches:
        sizes = np.nan_to_num(pa.compute.binary_length(batch.column(text).cast(pa.binary())).to_numpy(zero_copy_only=False).astype(float))
        for a, b in sliced(sizes, SLICE_BYTES):
            yield batch.slice(a, b - a)


PLACES = T.ArrayType(T.LongType())
MEASURED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("whole", T.StringType()), T.StructField("anchors", PLACES)])


def _sha256(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def measured_texts(own: DataFrame, window: int, anchor: int) -> DataFrame:
    """For every row (doc_id, row, text): doc_id, row, n_words, the digest of all words, and the anchors of its phrases. One pass."""
    memo = _Hashes()

    def measure(texts: list[bytes | None]) -> list:
        words = [space_words(t) for t in texts]
        doc, _, _, lowest = phrases(words, memo, window, anchor)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (lowest[1:] != lowest[:-1])
        ends = np.searchsorted(doc[new], np.arange(len(texts) + 1))
        return [list(map(len, words)), list(map(_sha256, words)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(lowest[new].view(np.int64)))]

    return materialize(map_texts(own, ["doc_id", "row"], "text", MEASURED, measure))


def with_first_copies(every: DataFrame, window: int) -> DataFrame:
    """every with copy_of: the smallest doc_id with the same words, if it is smaller and they are enough for a factor."""
    long = every.where("doc_id is not null").where(F.col("n_words") >= window)
    first = long.groupBy("whole").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    return every.join(materialize(first), "whole", "left").withColumn("copy_of", F.when(F.col("first") < F.col("doc_id"), F.col("first"))).drop("first")


def shared_anchors(every: DataFrame) -> DataFrame:
    """doc_id, row, and those of its anchors that a later document has too (refs) and that an earlier one has (asks).

    Later copies of a whole text need no search, and are no reference that the first copy isn't.
    """
    found = materialize(every.where("doc_id is not null and copy_of is null").select("doc_id", "row", F.explode("anchors").alias("anchor")))
    shared = materialize(found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b"))
    pick = lambda when: F.collect_set(F.when(when, F.col("anchor")))
    sets = found.join(shared, "anchor").groupBy("doc_id", "row").agg(pick(F.col("doc_id") < F.col("b")).alias("refs"), pick(F.col("doc_id") > F.col("a")).alias("asks"))
    return materialize(sets, done_with=[found, shared])


def _phrases_of(window: int, anchor: int) -> Callable:
    """From (doc_id, uid, text, anchors): the phrases whose anchor is in the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in _slices(batches, 2):
            doc, place, own, lowest = phrases([space_words(t) for t in batch.column(2).cast(pa.binary()).to_pylist()], memo, window, anchor)
            known = batch.column(3).flatten().to_numpy().view(np.uint64)
            of = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False))
            # membership of (document, anchor) pairs, by one hash for the pair; a false member costs only a lookup
            pair = lambda d, h: _join(d.astype(np.uint64) + np.uint64(1), h)
            keep = np.isin(pair(doc, lowest), pair(of, known))
            at = pa.array(doc[keep])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(place[keep].astype(np.int32)), pa.array(own[keep].view(np.int64)), pa.array(lowest[keep].view(np.int64))],
                ["doc_id", "uid", "place", "phrase", "anchor"],
            )

    return run


def index_hits(candidates: DataFrame, window: int, anchor: int) -> DataFrame:
    """uid, place and entry (doc_id, uid, place) of each phrase that an earlier document holds; the entry is the first of all.

    A phrase of an anchor's last document is no reference, and one of its first document has none: neither is shuffled.
    """
    schema = "doc_id long, uid long, place int, phrase long, anchor long"
    refs, asks = (candidates.where(F.size(c) > 0).select("doc_id", "uid", "text", c).mapInArrow(_phrases_of(window, anchor), schema) for c in ("refs", "asks"))
    index = materialize(refs.groupBy("phrase", "anchor").agg(F.min(F.struct("doc_id", "uid", "place")).alias("entry")))
    return materialize(asks.join(index, ["phrase", "anchor"]).where("entry.doc_id < doc_id").select("uid", "place", "entry"), done_with=[index])


def _parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, as their lists may be long."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


RUN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("uid", T.LongType()), T.StructField("place", T.IntegerType())])


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, places, entries) -> (uid, runs): phrases in a row whose entries are in a row as well, joined to the first, their number, and the first entry."""
    import pyarrow.compute  # noqa: F401

    for batch in _parts(batches, 1000):
        place = batch.column(1).flatten().to_numpy()
        doc_id, uid, there = (x.to_numpy() for x in batch.column(2).flatten().flatten())
        row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
        by = np.lexsort((place, row))
        place, doc_id, uid, there, row = place[by], doc_id[by], uid[by], there[by], row[by]
        new = np.ones(len(by), bool)
        new[1:] = (row[1:] != row[:-1]) | (uid[1:] != uid[:-1]) | (place[1:] != place[:-1] + 1) | (there[1:] != there[:-1] + 1)
        head = np.flatnonzero(new)
        n = np.diff(np.append(head, len(by)))
        fields = [pa.array(place[head], pa.int32()), pa.array(n, pa.int32()), pa.array(doc_id[head]), pa.array(uid[head]), pa.array(there[head], pa.int32())]
        ends = pa.array(np.searchsorted(row[head], np.arange(batch.num_rows + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, RUN.fieldNames()))], ["uid", "runs"])


def _longest(own: list[dict], i: int, at: int, others: dict[int, list[dict]]) -> int:
    """Phrases from place `at` in run i on that its reference holds in a row."""
    run = own[i]
    shift, n = run["place"] - run["start"], run["start"] + run["n"] - at
    theirs = others.get(run["uid"], [])
    while i + 1 < len(own) and own[i + 1]["start"] == at + n:
        i += 1
        there = at + n + shift
        k = bisect_right(theirs, there, key=lambda r: r["start"]) - 1
        if k < 0 or there >= theirs[k]["start"] + theirs[k]["n"]:
            # a phrase that no earlier document has: its entry is its own place
            if (run["uid"], there) != (own[i]["uid"], own[i]["place"]):
                break
            n += own[i]["n"]
            continue
        skip = there - theirs[k]["start"]
        if (theirs[k]["uid"], theirs[k]["place"] + skip) != (own[i]["uid"], own[i]["place"]):
            break
        more = min(theirs[k]["n"] - skip, own[i]["n"])
        n += more
        if more < own[i]["n"]:  # their run ends inside of ours
            break
    return n


def parse(own: list[dict], others: dict[int, list[dict]], window: int) -> list[dict]:
    """Greedy factors of a document from its runs and those of its references."""
    out, i = [], 0
    at = own[0]["start"] if own else 0
    while i < len(own):
        n = _longest(own, i, at, others)
        out.append({"start": at, "n_words": n + window - 1, "reference": own[i]["doc_id"], "reference_start": own[i]["place"] + at - own[i]["start"]})
        at += n
        while i < len(own) and own[i]["start"] + own[i]["n"] <= at:
            i += 1
        if i < len(own):
            at = max(at, own[i]["start"])
    return out


FACTOR = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("reference", T.LongType()), T.StructField("reference_start", T.IntegerType())])


def _by_row(df: DataFrame, func: Callable, name: str, kind: T.DataType) -> DataFrame:
    """df's first column, and func of the others as a column."""
    from pyspark.sql.pandas.types import to_arrow_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, 64):
            made = [func(*x) for x in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, to_arrow_type(kind))], [batch.schema.names[0], name])

    return df.mapInArrow(run, T.StructType([df.schema.fields[0], T.StructField(name, kind)]))


def factors_of_hits(hits: DataFrame, window: int) -> DataFrame:
    """uid and factors of every document with hits. Only where a run meets the next one do the references' runs come along."""
    grouped = hits.groupBy("uid").agg(F.collect_list("place").alias("places"), F.collect_list("entry").alias("entries"))
    kind = T.StructType([T.StructField("uid", T.LongType()), T.StructField("runs", T.ArrayType(RUN))])
    runs = materialize(grouped.mapInArrow(runs_of, kind), done_with=[hits])
    meets = F.filter("runs", lambda r, i: F.coalesce(F.get("runs", i + 1)["start"] == r["start"] + r["n"], F.lit(False)))
    marked = runs.withColumn("open", F.array_distinct(F.transform(meets, lambda r: r["uid"])))
    one = lambda r: F.struct(r["start"].alias("start"), (r["n"] + (window - 1)).alias("n_words"), r["doc_id"].alias("reference"), r["place"].alias("reference_start"))
    alone = marked.where(F.size("open") == 0).select("uid", F.transform("runs", one).alias("factors"))
    linked = marked.where(F.size("open") > 0)
    asked = linked.select("uid", F.explode("open").alias("other"))
    theirs = runs.select(F.col("uid").alias("other"), F.col("runs").alias("theirs"))
    others = asked.join(theirs, "other").groupBy("uid").agg(F.collect_list(F.struct("other", "theirs")).alias("others"))
    made = lambda own, others: parse(own, {x["other"]: x["theirs"] for x in others or []}, window)
    return alone.unionByName(_by_row(linked.select("uid", "runs").join(others, "uid", "left"), made, "factors", T.ArrayType(FACTOR)))


def row_keys(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("row"), F.col(text).alias("text"))


def searched_factors(own: DataFrame, every: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """(uid, factors) of the documents that were searched and have any, and the searched documents (doc_id, row, text, uid)."""
    candidates = materialize(own.join(shared_anchors(every), ["doc_id", "row"]).withColumn("uid", F.monotonically_increasing_id()))
    return factors_of_hits(index_hits(candidates, window, anchor), window), candidates.select("doc_id", "row", "text", "uid")


def factors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, row (the text's hash) and factors, once for each doc_id and text with any. A later copy of a whole text is one factor."""
    own = row_keys(docs, doc_id, text)
    every = with_first_copies(measured_texts(own, window, anchor), window)
    found, searched = searched_factors(own, every, window, anchor)
    one = F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("n_words"), F.col("copy_of").alias("reference"), F.lit(0).alias("reference_start"))
    whole = every.where("copy_of is not null").select("doc_id", "row", F.array(one).alias("factors"))
    both = searched.drop("text").join(found, "uid").select("doc_id", "row", "factors").unionByName(whole)
    return both.dropDuplicates(["doc_id", "row"])


def kept_words(words: list[bytes], found: list[dict] | None) -> list[bytes]:
    """The words outside all factors."""
    if not found:
        return words
    gone = covered(len(words), np.array([f["start"] for f in found], np.int64), np.array([f["n_words"] for f in found], np.int64))
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def dedup_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every row.

    Whole texts are digested where they are read; only digests meet those of the shortened texts.
    """
    own = row_keys(docs, doc_id, text)
    every = with_first_copies(measured_texts(own, window, anchor), window)
    found, searched = searched_factors(own, every, window, anchor)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 2):
            words = [space_words(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            left = [kept_words(w, f) for w, f in zip(words, batch.column(3).to_pylist(), strict=True)]
            removed = [len(w) - len(x) for w, x in zip(words, left, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(map(_sha256, left), pa.string())], ["doc_id", "row", "n_removed", "kept"])

    cut = searched.join(found, "uid").select("doc_id", "row", "text", "factors").mapInArrow(digest, "doc_id long, row long, n_removed long, kept string")
    cut = materialize(cut.groupBy("doc_id", "row").agg(F.max("n_removed").alias("n_removed"), F.max("kept").alias("kept")))
    copied = F.col("copy_of").isNotNull()
    return every.join(cut, ["doc_id", "row"], "left").select(
        "doc_id",
        "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"),
    )


def remove_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """All columns, with the text of the kept words joined by single spaces; texts without duplicates stay as they are."""
    found = materialize(factors(docs, doc_id, text, window, anchor)).select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("factors").alias("__factors"))
    names = docs.columns
    at = names.index(text)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, at):
            texts, cuts = batch.column(at).cast(pa.binary()).to_pylist(), batch.column(len(names)).to_pylist()
            made = [b" ".join(kept_words(space_words(t), f)) if f else t for t, f in zip(texts, cuts, strict=True)]
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(made, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    same = (docs[doc_id].cast("long") == F.col("__id")) & (F.xxhash64(docs[text]) == F.col("__row"))
    return docs.join(found, same, "left").select(*[docs[c] for c in names], "__factors").mapInArrow(strip, docs.schema)


def op10_relative_lz_dedup(spark, sf_dir: str) -> DataFrame:
    """Words, removed words and a digest of the kept ones of every document."""
    return dedup_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
