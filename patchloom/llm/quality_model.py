"""A quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

The n-grams are words and pairs of words, and runs of one and two word shapes (case, digits and signs, repeats
folded), each hashed to a weight. A text's value of an n-gram is its share among all of its kind. Training reads at
most about MAX_LABELLED different labelled documents, chosen by hash, in SHARDS parts; each part's learner runs FTRL-proximal over its
own documents, and the weights are averaged. Scoring is a sparse dot product in the tasks that read the texts.

Labels come only from documents whose crc32 (of the doc_id as text) mod 4 is not 2. Null and empty texts get the score
of the bias. Without labels every score is 0.5. Repeated rows get a row each, and count once in training; a doc_id with
several labels takes the largest. A null doc_id is not held out and has no label. An empty table gives an empty result.
A very long text is scored alone, whole; in training a document is held as its n-grams only.
A score equal to the threshold is predicted 1. Columns of any other name are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flatten, map_texts, materialize, space_words

BITS = 18
MAX_LABELLED = 20_000
SHARDS = 8
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.0001
#: A text's shares of each kind of n-gram sum to this.
SCALE = 20.0
THRESHOLD = 0.7

_SHAPE = bytes(0x30 if 0x30 <= b <= 0x39 else 0x41 if 0x41 <= b <= 0x5A else 0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)
_P = np.uint64(0x9E3779B97F4A7C15)


def _spread(x: np.ndarray) -> np.ndarray:
    return ((x * _P) >> np.uint64(64 - BITS)).astype(np.int64)


def _codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word and of its shape, each distinct word worked out once."""
    seen = dict.fromkeys(words)
    own = np.fromiter((zlib.crc32(w) for w in seen), np.uint64, len(seen))
    shape = np.fromiter((zlib.crc32(_RUN.sub(rb"\1", w.translate(_SHAPE)), 1) for w in seen), np.uint64, len(seen))
    for i, w in enumerate(seen):
        seen[w] = i
    at = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
    return own[at], shape[at]


def ngrams(texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: the document and the weight number of each occurrence."""
    words, bounds = flatten([space_words(t) for t in texts])
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    own, shape = _codes(words)
    whole = np.flatnonzero(doc[:-1] == doc[1:])
    pair = lambda x, salt: (x[whole] + np.uint64(salt)) * np.uint64(0x100000001B3) + x[whole + 1]
    twin = (own[whole] == own[whole + 1]).astype(np.uint64) << np.uint64(42)  # a pair of shapes also tells whether the words are equal
    return [(doc, _spread(own)), (doc[whole], _spread(pair(own, 2))), (doc, _spread(shape + np.uint64(1 << 40))), (doc[whole], _spread(pair(shape, 1 << 41) + twin))]


def margins(texts: list[bytes | None], weights: np.ndarray) -> np.ndarray:
    """The linear score of each text; the last weight is the bias."""
    total = np.full(len(texts), float(weights[-1]))
    for doc, index in ngrams(texts):
        n = np.bincount(doc, minlength=len(texts))
        total += SCALE * np.bincount(doc, weights[index], minlength=len(texts)) / np.maximum(1, n)
    return total


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class FTRL:
    """FTRL-proximal with a learning rate for each coordinate, for the logistic loss."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, index: np.ndarray | slice) -> np.ndarray:
        z = self.z[index]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[index])) / ALPHA + L2))

    def learn(self, index: np.ndarray, value: np.ndarray, label: float) -> None:
        w = self.weights(index)
        gradient = (sigmoid(np.array(w @ value)) - label) * value
        n = self.n[index]
        self.z[index] += gradient - (np.sqrt(n + gradient**2) - np.sqrt(n)) / ALPHA * w
        self.n[index] = n + gradient**2


def _examples(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for text in texts:
        parts = [(index, np.full(len(index), SCALE / max(1, len(index)))) for _, index in ngrams([text])]
        index = np.concatenate([i for i, _ in parts] + [[1 << BITS]])
        value = np.concatenate([v for _, v in parts] + [[1.0]])
        index, back = np.unique(index, return_inverse=True)
        yield index, np.bincount(back, value)


def _train_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        for i, text, label in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            rows.append((zlib.crc32(str(i).encode()), next(_examples([text])), label))
    if not rows:
        return
    # the order of learning doesn't hang on the order of reading
    rows.sort(key=lambda r: (r[0], len(r[1][0]), r[1][0].tobytes()))
    learner = FTRL((1 << BITS) + 1)
    for _ in range(EPOCHS):
        for _, (index, value), label in rows:
            learner.learn(index, value, float(label))
    yield pa.RecordBatch.from_arrays([pa.array([len(rows)]), pa.array([learner.weights(slice(None)).astype(np.float32).tobytes()], pa.binary())], ["n", "weights"])


def remainder(doc_id: str, by: int):
    """crc32 of the doc_id as text, modulo `by`; null for null."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(by))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, doc_id: str = "doc_id", text: str = "text", held_out: int = 2) -> DataFrame:
    """(doc_id, text, label, row) of about `most` different labelled documents at most, chosen by hash among those not held out.

    First by doc_id, then, if these have more texts, by the text's hash `row`; repeated rows are one. Written, as it is read several times.
    """
    known = labels.where(F.col(label).isNotNull() & (remainder("doc_id", 4) != held_out)).groupBy("doc_id").agg(F.max(label).alias("__label"))
    below = lambda share: int(share * (1 << 30))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < below(min(1.0, most / max(1, known.count()))))
    rows = docs.join(F.broadcast(chosen.withColumnRenamed("doc_id", "__id")), docs[doc_id] == F.col("__id")).select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), F.col("__label").alias("label"))
    rows = rows.withColumn("row", F.xxhash64("text"))
    n = rows.select("doc_id", "row").distinct().count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("row", "doc_id"), F.lit(1 << 30)) < below(most / n))
    return materialize(rows.dropDuplicates(["doc_id", "row"]))


def train(sample: DataFrame) -> np.ndarray:
    """Weights averaged over the parts by their documents; SHARDS vectors of fixed size go to the driver."""
    dealt = sample.repartition(SHARDS, F.pmod(F.xxhash64("doc_id", "row"), F.lit(SHARDS))).select("doc_id", "text", "label")
    total, n = np.zeros((1 << BITS) + 1), 0
    for part in dealt.mapInArrow(_train_part, "n long, weights binary").collect():
        total += part["n"] * np.frombuffer(part["weights"], np.float32)
        n += part["n"]
    return total / max(1, n)


SCORE = T.StructType([T.StructField("score", T.DoubleType())])


def score_quality(docs: DataFrame, weights: np.ndarray, keep: list[str], text: str = "text") -> DataFrame:
    """The `keep` columns of each document with its score."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    return map_texts(docs, keep, text, SCORE, lambda texts: [sigmoid(margins(texts, shared.value))])


def op5_ftrl_quality(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = train(labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", MAX_LABELLED))
    scored = score_quality(docs, weights, ["doc_id"])
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
