"""Benchmark decontamination with suffix arrays over shards of the training texts.

A shard is a slice of documents. Its suffix array orders the positions at which a benchmark window could start by
the words that follow, as far as the longest window goes. Every benchmark suffix is looked up in it by binary
search; equal windows on one diagonal join up to the longest verbatim matches with their places.

A window is WINDOW consecutive words of an item, or the whole item if it is shorter. Equal windows of the benchmark are
one, with the set of items that hold them, so that a passage which very many items share is searched once and gives one
match for each place. A document is contaminated if its words within matches are at least a twentieth of all its words.

Null and empty texts have no words and are never contaminated; an item without words has no window. Items that share an
id count as one, and so do those without an id: their passages count like any other, but the list of names leaves them
out. Repeated documents each get their own row, and so do those without an id. Without items, nothing is contaminated.
A benchmark of any size gives the same result: more blocks of items, each carried to all rows. A text larger than a
slice is handled alone, whole. An empty table gives an empty result. Item names are sorted as strings; of equal longest
matches at a place one is given. Columns of any other name are not read, or carried unchanged where rows are kept.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, flatten, map_texts

WINDOW = 13
#: Bytes of benchmark text that go to the tasks at once; a larger benchmark is searched in several rounds of blocks.
BLOCK_BYTES = 8 << 20
MIN_SHARE = 20

MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_start", T.LongType()), T.StructField("doc_start", T.LongType()), T.StructField("n_words", T.LongType())])
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("matches", T.ArrayType(MATCH)), T.StructField("item_ids", T.ArrayType(T.StringType()))])


class Suffixes:
    """The distinct windows of a block of benchmark items (id, text), with all their places and items."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        vocabulary: defaultdict[bytes, int] = defaultdict(count(1).__next__)  # 0: a word of no item
        number: dict[str | None, int] = {}
        known: dict[tuple, int] = {}
        rows: list[tuple[int, ...]] = []
        pairs, single = set(), set()
        at, owner, start = [], [], []
        for item, text in items:
            ids = [vocabulary[w] for w in alnum_words(text)]
            width = min(window, len(ids))
            no = number.setdefault(item, len(number))
            for s in range(len(ids)):
                row = tuple(ids[s : s + width]) if s + width <= len(ids) else None
                if row and (found := known.setdefault(row, len(rows))) == len(rows):
                    rows.append(row)
                at.append(found if row else -1)
                owner.append(no)
                start.append(s)
            at.append(-1)  # no window goes on from one item to the next
            owner.append(no)
            start.append(len(ids))
            pairs.update(zip(ids, ids[1:]))
            if len(ids) == 1:
                single.add(ids[0])
        self.names = list(number)
        self.vocabulary = dict(vocabulary)
        self.window = window
        #: Of each place of the benchmark: the window that begins there or -1, the item, and the place in it.
        self.at, self.owner, self.start = (np.array(x, np.int64) for x in (at, owner, start))
        self.length = np.array([len(r) for r in rows], np.int64)
        self.shortest = int(self.length.min(initial=window))
        by = np.argsort(self.at, kind="stable")
        self.places = by[np.searchsorted(self.at[by], 0) :]
        self.edge = np.searchsorted(self.at[self.places], np.arange(len(rows) + 1))
        sets: dict[tuple, int] = {}
        self.item_set = np.array([sets.setdefault(tuple(sorted(set(self.owner[self._places(w)].tolist()))), len(sets)) for w in range(len(rows))], np.int64)
        self.sets = [np.array(s, np.int64) for s in sets]
        low, high = np.zeros((len(rows), window), ">u4"), np.full((len(rows), window), 0xFFFFFFFF, ">u4")
        for i, row in enumerate(rows):
            low[i, : len(row)] = high[i, : len(row)] = row
        self.low, self.high = (x.view(f"S{4 * window}").ravel() for x in (low, high))
        self.base = len(vocabulary) + 1
        self.pairs = np.array(sorted(a * self.base + b for a, b in pairs), np.int64)
        self.single = np.zeros(self.base, bool)
        self.single[list(single)] = True

    def _places(self, window: int) -> np.ndarray:
        return self.places[self.edge[window] : self.edge[window + 1]]

    def order(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shard's suffix array: positions in the order of their first `window` words, and those words as keys.

        Left out are suffixes that equal no benchmark text even over the shortest window.
        """
        first, then = ids[:-1], ids[1:]
        near = np.flatnonzero((first > 0) & (then > 0))
        near = near[np.isin(first[near] * self.base + then[near], self.pairs)]
        linked = np.zeros(len(ids), bool)
        linked[near] = True
        steps = max(1, self.shortest - 1)
        total = np.concatenate([[0], np.cumsum(linked, dtype=np.int64), np.full(steps, linked.sum())])
        begins = total[steps : steps + len(ids)] - total[: len(ids)] == steps
        if self.shortest == 1:
            begins |= self.single[ids]
        at = np.flatnonzero(begins)
        padded = np.concatenate([ids, np.zeros(self.window, ids.dtype)])
        keys = padded[at[:, None] + np.arange(self.window)].astype(">u4").view(f"S{4 * self.window}").ravel() if len(at) else np.empty(0, f"S{4 * self.window}")
        by = np.argsort(keys, kind="stable")
        return at[by], keys[by]

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, position) pairs that are equal, by binary search of every window; in order of position, the longest first."""
        at, keys = self.order(ids)
        low, high = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        n = high - low
        window = np.repeat(np.arange(len(n)), n)
        position = at[np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        by = np.lexsort((-self.length[window], position))
        return window[by], position[by]

    def measure(self, texts: list[bytes | None]) -> list:
        words, bounds = flatten([alnum_words(t) for t in texts])
        lengths = np.diff(bounds)
        # one word of no item between documents, so that no match runs over an end
        ids = np.zeros(len(words) + len(texts), np.int64)
        spot = np.arange(len(words)) + np.repeat(np.arange(len(texts)), lengths)
        ids[spot] = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        begin = bounds[:-1] + np.arange(len(texts))
        window, position = self.search(ids)
        edge = np.searchsorted(position, np.append(begin, len(ids)))
        matches, names = [], []
        for first, a, b in zip(begin.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            matches.append(self.longest(window[a:b], position[a:b] - first) if b > a else [])
            sets = np.unique(self.item_set[window[a:b]])
            names.append([self.names[i] for i in np.unique(np.concatenate([self.sets[s] for s in sets]))] if b > a else [])
        return [lengths, matches, names]

    def longest(self, window: np.ndarray, position: np.ndarray) -> list[dict]:
        """Longest verbatim matches from the first place on that isn't in one yet, until all windows of a document are."""
        out: list[dict] = []

        def found(place: int, first: int, n: int) -> None:
            out.append({"item_id": self.names[self.owner[place]], "item_start": int(self.start[place]), "doc_start": int(first), "n_words": int(n)})

        full = self.length[window] == self.window
        wide, at = window[full], position[full]
        i = 0
        while i < len(wide):
            places, n = self._places(wide[i]), 0
            while i + n + 1 < len(wide) and at[i + n + 1] == at[i] + n + 1:
                on = places[self.at[places + n + 1] == wide[i + n + 1]]
                if not len(on):
                    break
                places, n = on, n + 1
            found(places[0], at[i], n + self.window)
            i += n + 1
        begin, end = (np.array([m["doc_start"] + k * m["n_words"] for m in out], np.int64) for k in (0, 1))
        for w, p in zip(window[~full].tolist(), position[~full].tolist(), strict=True):  # whole items shorter than a window
            k = int(np.searchsorted(begin, p, "right")) - 1
            if k < 0 or end[k] < p + self.length[w]:
                found(self._places(w)[0], p, self.length[w])
        return out


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """The items, in blocks of about block_bytes by hash; one block if all fit. An item alone may be larger."""
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(text).cast("binary").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text") + 16).alias("n")).first()["n"] or 0
    n = 1 if total <= block_bytes else 2 * -(-total // block_bytes)
    for i in range(n):
        block = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i) if n > 1 else items
        yield sorted(((r["id"], bytes(r["text"])) for r in block.collect()), key=lambda x: (x[0] is None, x[0] or "", x[1]))


def match_documents(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The `keep` columns of every row, its n_words, its longest matches and the ids of the items that it shares windows with.

    With several blocks of items, each row's text and matches so far are carried along to the next block.
    """
    inner = [f"__k{i}" for i in range(len(keep))]
    body = inner[keep.index(text)] if text in keep else "__body"
    df = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, inner, strict=True)], *([] if body in inner else [F.col(text).alias(body)]))
    held: list[str] = []
    blocks = item_blocks(benchmark, item_id, item_text, block_bytes)
    items = next(blocks)
    while items is not None:
        following = next(blocks, None)
        shared = docs.sparkSession.sparkContext.broadcast(Suffixes(items, window))
        carried = [*inner, *held] if following is None or body in inner else [*inner, body, *held]
        df = map_texts(df, carried, body, FOUND, lambda texts, s=shared: s.value.measure(texts))
        names = [f"__m{len(held)}", f"__i{len(held)}"]
        df, held, items = df.withColumnsRenamed(dict(zip(("matches", "item_ids"), names))), [*held, *names], following
        if items is not None:
            df = df.drop("n_words")
    every = [F.concat(*held[::2]).alias("matches"), F.array_distinct(F.concat(*held[1::2])).alias("item_ids")]
    return df.select(*[F.col(k).alias(c) for c, k in zip(keep, inner, strict=True)], "n_words", *every)


def hit_words(matches: Column) -> Column:
    """Number of words that the matches cover, each counted once."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["doc_start"].alias("a"), (m["doc_start"] + m["n_words"]).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, start, lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(s["end"], x["a"]))).alias("n")))["n"]


def summarize(found: DataFrame) -> DataFrame:
    """n_hit and contaminated from a row's matches."""
    return found.withColumn("n_hit", hit_words(F.col("matches"))).withColumn("contaminated", (F.col("n_hit") > 0) & (MIN_SHARE * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, matches, item_ids, n_hit, contaminated."""
    return summarize(match_documents(docs, benchmark, [doc_id], text, **options))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    inner = [f"__c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, inner, strict=True))
    every = summarize(match_documents(docs.toDF(*inner), benchmark, inner, at[text], **options))
    return every.where(~F.col("contaminated")).select(*[F.col(v).alias(k) for k, v in at.items()])


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Words, hit words and items of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_join(F.array_sort("item_ids"), ",")  # leaves nulls out
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated")
