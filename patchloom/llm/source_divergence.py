"""How far the sources of a language are apart: smoothed shares of terms, compared between sources and with the language.

Terms are runs of letters (A-Z lower-cased; all non-ASCII characters count as letters). A language keeps the V terms that
at least MIN_DOCS of its documents hold. In a group (lang, source), as in a language, a kept term with count c has the
share p = 1 + floor(SCALE * (c + 5) / (N + 5 V)), N being the sum of counts. All arithmetic is in whole numbers.

Terms above their language's share: terms are grouped by (group count, language count); the difference is evaluated once
for each such cell, equal values are merged, and the cells are ranked by the number of terms before them, so only the few
cells of the first ranks are expanded to terms, in UTF-8 order. Distances between sources: kept terms are numbered and
dealt over blocks of BLOCK_TERMS, sources over tiles of TILE, and each pair of tiles meets in one task for each block,
which sums the differences over its terms; terms that neither source has enter by number. So neither all terms of a
source nor all sources of a term come together in one task, and no pair of rows is shuffled.

Null text, lang and source are read as ''. Repeated rows are documents of their own. A text without terms still makes its
group. Whole texts are read, a very long one alone. Equal values rank by item in UTF-8 order. Without kept terms all
distances are 0. Other columns are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import materialize, number_rows, sliced

MIN_DOCS = 30
TOP = 50
# Fixed values of the smoothing.
SCALE, PRIOR = 1_000_000_000, 5
BLOCK_TERMS, TILE = 4096, 256
#: Bytes of text after which a task hands on its counts, and different terms of them.
COUNT_BYTES, COUNT_TERMS = 32 << 20, 200_000

#: For bytes.translate: A-Z become a-z; all that no term can hold becomes a space.
_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
GROUP = ["lang", "source"]


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), written: occurrences and documents of each term; a null term for each group."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*GROUP, "text")])
    schema = "lang string, source string, term string, n long, docs long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def hand_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, within) in held.items():
                terms = [None, *n]
                columns = [[lang] * len(terms), [source] * len(terms)]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.string()) for c in columns), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(within.__getitem__, n)], pa.int64())],
                    names=[*GROUP, "term", "n", "docs"],
                )
            held.clear()

        size = 0
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            lengths = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False)
            for a, b in sliced(lengths, COUNT_BYTES):
                part = batch.slice(a, b - a)
                for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts.slice(a, b - a).to_pylist(), strict=True):
                    own = Counter(terms_of(text))
                    n, within = held[lang, source]
                    n.update(own)
                    within.update(own.keys())
                size += int(lengths[a:b].sum())
                if size >= COUNT_BYTES or sum(len(n) for n, _ in held.values()) >= COUNT_TERMS:
                    yield from hand_on()
                    size = 0
        yield from hand_on()

    import pyarrow.compute  # noqa: F401  binary_length above

    return materialize(read.mapInArrow(count, schema).groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exactly; null without terms."""
    wide = lambda c: c.cast("decimal(38,0)")
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(20,0)")
    below = (total + PRIOR * terms).cast("decimal(20,0)")
    return (1 + F.call_function("div", wide(above), wide(F.when(below > 0, below)))).cast("long")


class Audit:
    """The written tables that both comparisons start from: groups, languages and counts of kept terms."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS):
        counts = term_counts(docs)
        by_lang = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        # kept terms, numbered: place
        self.kept = materialize(number_rows(by_lang.where(F.col("docs") >= min_docs).drop("docs"), ["lang", "term"], "place"))
        langs = self.kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
        #: lang, source, term, n, lang_n, place of kept terms that a group holds.
        self.held = materialize(counts.drop("docs").join(self.kept, ["lang", "term"]))
        groups = counts.where("term is null").select(*GROUP).join(self.held.groupBy(*GROUP).agg(F.sum("n").alias("total")), GROUP, "left")
        groups = groups.join(langs, "lang", "left").select(*GROUP, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "terms", "lang_total")])
        #: lang, source, total, terms, lang_total and number of every group.
        self.groups = materialize(number_rows(groups, GROUP, "number"))


def distinctive_terms(audit: Audit, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the terms of each group furthest above their language's share."""
    cells = audit.held.groupBy(*GROUP, "n", "lang_n").agg(F.count(F.lit(1)).alias("times")).join(audit.groups, GROUP)
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    cells = materialize(cells.select(*GROUP, "n", "lang_n", "times", (p - q).alias("value")).where("value > 0"))
    # equal values are one; each has a term at least, so no more than `top` values matter
    values = cells.groupBy(*GROUP, "value").agg(F.sum("times").alias("times"))
    best = values.withColumn("nth", F.row_number().over(W.partitionBy(*GROUP).orderBy(F.desc("value")))).where(F.col("nth") <= top)
    before = F.coalesce(F.sum("times").over(W.partitionBy(*GROUP).orderBy("nth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    chosen = best.withColumn("before", before).where(F.col("before") < top).select(*GROUP, "value", "before")
    open_cells = materialize(cells.join(chosen, [*GROUP, "value"]).select(*GROUP, "n", "lang_n", "value", "before"))
    terms = audit.held.join(open_cells, [*GROUP, "n", "lang_n"])
    # a value may have any number of terms; its first ones in UTF-8 order fill the ranks that are left
    nth = F.row_number().over(W.partitionBy(*GROUP).orderBy(F.desc("value"), "term"))
    return terms.withColumn("rank", nth).where(F.col("rank") <= top).select(*GROUP, F.col("term").alias("item"), "value", "rank")


def _tile_sums(rows: pa.Table, width: int) -> pa.Table:
    """(a, b, part) for pairs of sources a < b of a block's two tiles: the sum over the block's terms of |p - q| above that of two absent terms."""
    number, column, p, tile = (rows.column(c).to_numpy() for c in ("number", "column", "p", "tile"))
    first, last = int(tile.min()), int(tile.max())
    marks = column < 0
    names, base = number[marks], p[marks]
    order = np.argsort(names)
    names, base, of = names[order], base[order], tile[marks][order]
    matrix = np.repeat(base[:, None], width, axis=1)
    matrix[np.searchsorted(names, number[~marks]), column[~marks]] = p[~marks]
    out: list[list[np.ndarray]] = [[], [], []]
    for i in np.flatnonzero(of == first):
        others = np.flatnonzero(of == last)
        others = others[others > i]
        part = np.abs(matrix[others] - matrix[i]).sum(axis=1) - width * np.abs(base[others] - base[i])
        for c, x in zip(out, (np.full(len(others), names[i]), names[others], part), strict=True):
            c.append(x)
    return pa.table({k: pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for k, c in zip(("a", "b", "part"), out, strict=True)})


def source_distances(audit: Audit, width: int = BLOCK_TERMS, tile: int = TILE) -> DataFrame:
    """(lang, source, item, value, rank): every other source of the language, the furthest first."""
    groups = materialize(audit.groups.withColumn("base", share(F.lit(0), F.col("total"), F.col("terms"))))
    tiles = materialize(groups.withColumn("tile", F.expr(f"number div {tile}")).select(*GROUP, "number", "total", "terms", "base", "tile"))
    langs = tiles.groupBy("lang").agg(F.min("tile").alias("first"), F.max("tile").alias("last"))
    block, at = F.expr(f"place div {width}"), F.expr(f"cast(place % {width} as int)")
    blocks = audit.kept.select("lang", block.alias("block")).distinct()
    marks = tiles.join(blocks, "lang").select("lang", "block", "number", "tile", F.lit(-1).alias("column"), F.col("base").alias("p"))
    terms = audit.held.join(tiles, GROUP).select("lang", block.alias("block"), "number", "tile", at.alias("column"), share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    rows = marks.unionByName(terms).join(langs, "lang")
    met = rows.withColumn("other", F.explode(F.sequence("first", "last"))).withColumns({"ta": F.least("tile", "other"), "tb": F.greatest("tile", "other")})
    sums = met.select("block", "ta", "tb", "lang", "number", "tile", "column", "p").groupBy("lang", "block", "ta", "tb").applyInArrow(lambda t: _tile_sums(t, width), "a long, b long, part long")
    parts = materialize(sums.groupBy("a", "b").agg(F.sum("part").alias("part")))
    both = parts.unionByName(parts.select(F.col("b").alias("a"), F.col("a").alias("b"), "part"))
    side = lambda name, *more: groups.select(F.col("number").alias(name), F.col("base").alias(f"base_{name}"), F.col("source").alias(f"source_{name}"), *more)
    apart = both.join(side("a", "lang", "terms"), "a").join(side("b"), "b")
    value = F.col("part") + F.col("terms") * F.abs(F.col("base_a") - F.col("base_b"))
    # languages without kept terms have no blocks: all their sources are at distance 0
    bare = groups.where("terms = 0")
    none = bare.select("lang", F.col("source").alias("source_a")).join(bare.select("lang", F.col("source").alias("source_b")), "lang").where("source_a <> source_b")
    every = apart.select("lang", "source_a", "source_b", value.alias("value")).unionByName(none.withColumn("value", F.lit(0).cast("long")))
    rank = F.row_number().over(W.partitionBy("lang", "source_a").orderBy(F.desc("value"), "source_b"))
    return every.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), "value", rank.alias("rank"))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    """Both comparisons of every (lang, source) of documents: part `pair`, and part `term` to rank 50."""
    audit = Audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    pairs, terms = source_distances(audit), distinctive_terms(audit)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))
