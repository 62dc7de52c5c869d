"""Helpers shared by the training-data operators: word rules, batch maps over texts, shared tables, hot-key-safe joins."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..tables import materialize, number_rows

#: Bytes of text that a task handles at once; a longer text is handled alone.
SLICE_BYTES = 2 << 20
#: Rows up to which a table counts as small enough to broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 20_000

_SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: For bytes.translate: A-Z become a-z; all that no letter-or-digit word can hold becomes a space.
_ALNUM = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words of a-z, 0-9 and non-ASCII characters after lower-casing A-Z; none for null."""
    return text.translate(_ALNUM).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space; none for null."""
    return text.split() if text else []


def lower_space_words(text: bytes | None) -> list[bytes]:
    """As space_words, after lower-casing A-Z."""
    return text.lower().split() if text else []


def word_ids(words: list[bytes]) -> np.ndarray:
    """A number for each distinct word, in order of first sight."""
    ids: defaultdict[bytes, int] = defaultdict(count().__next__)
    return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))


def flatten(docs: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    """All words of a batch, and where each document's begin (one more entry than documents)."""
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    return [w for d in docs for w in d], np.concatenate([[0], np.cumsum(lengths)])


def covered(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Mask of n positions: which lie in one of the spans."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:-1]) > 0


def per_document(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of true entries between each two bounds."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def sliced(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` together, of one row at least."""
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def map_texts(df: DataFrame, keep: list[str], text: str, fields: T.StructType, func: Callable[[list[bytes | None]], list], limit: int = SLICE_BYTES) -> DataFrame:
    """Each row's `keep` columns, then `fields` computed by func from the texts of a slice of rows.

    func gets the UTF-8 texts (None for null) and returns one sequence or Arrow array for each field.
    """
    own = text in keep  # then it isn't sent twice
    source = df.select(*[F.col(c) for c in keep], *([] if own else [F.col(text).alias("__text")]))
    at = keep.index(text) if own else len(keep)
    schema = T.StructType([*source.schema.fields[: len(keep)], *fields.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            sizes = np.nan_to_num(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(float))
            for a, b in sliced(sizes, limit):
                made = func(texts.slice(a, b - a).to_pylist())
                columns = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                columns += [x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, list(arrow)[len(keep):], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=arrow.names)

    import pyarrow.compute  # noqa: F401  binary_length above

    return source.mapInArrow(run, schema)


def join_small(df: DataFrame, small: DataFrame, key: str, salt_by: Column, how: str = "left", limit: int = BROADCAST_ROWS, salts: int = 32) -> DataFrame:
    """df joined null-safely on `key` with a table of one row a key, whatever share of df's rows has one key.

    A table of up to `limit` rows is broadcast. A larger one is repeated for each of `salts` salts, and df's rows
    of a key are dealt over them by salt_by, so that no task gets all rows of a key.
    """
    right = small.withColumnRenamed(key, "__key")
    if small.limit(limit + 1).count() <= limit:
        return df.join(F.broadcast(right), df[key].eqNullSafe(F.col("__key")), how).drop("__key")
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = df.withColumn("__s", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    return left.join(right, left[key].eqNullSafe(F.col("__key")) & (F.col("__s") == F.col("__salt")), how).drop("__key", "__salt", "__s")
