"""Toxicity by a classifier chain: categories in order, each linear model seeing the probabilities of those before.

Categories are learnt, as labels.toxic is the only label: the toxic documents of the sample are clustered by their
features into KINDS kinds (spherical k-means from the documents that differ most), a category each, and the last category
is the label itself. A model is a logistic regression on words and on beginnings of longer words, each standing once,
twice or three times and more in the text, and on the earlier categories' probabilities. The features are the
MAX_FEATURES that tell the labels apart best (chi-square) of those in MIN_DOCS sample documents or more. In training
those probabilities are out-of-fold: each row's come from models fitted without its fold, so that a later model doesn't
trust them more than it may. The fits of a category run as Spark tasks, one for each fold and one for all rows.

Training reads about MAX_LABELLED different labelled documents at most, chosen by hash, whose crc32 (of the doc_id as
text) mod 4 is not 2; the others are held out. The driver holds the sample's feature numbers, MAX_LABELLED times
TIMES * MAX_FEATURES of four bytes if every document had every feature three times, and no text. Null and empty texts have
no words, so their probabilities are the intercepts'. Without labels all probabilities are 0.5 and nothing is toxic.
Repeated rows get a row each, and count once in training. An empty table gives an empty result. A very long text is
handled alone, whole. Of features with one chi-square the first by code point are taken; a score equal to the threshold is
not toxic. A doc_id with several labels takes the largest. Columns of any other name are not read.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, flatten, map_texts
from .quality_model import labelled_sample, remainder, sigmoid

#: Kinds of toxic documents, and the categories in the chain's order.
KINDS = 2
CHAIN = [*(f"kind_{k + 1}" for k in range(KINDS)), "toxic"]
MAX_LABELLED = 12_000
MIN_DOCS = 5
MAX_FEATURES = 2_000
#: Lengths, in characters, of the beginnings of words; a word has those that are shorter than it.
STEMS = (5, 6, 7)
#: A feature counts up to this often; each count is a weight of its own.
TIMES = 3
FOLDS = 4
STEPS, RATE, L2 = 150, 0.3, 0.0002
THRESHOLD = 0.35


@dataclass
class Rows:
    """Sample documents as flat lists of weight numbers, with labels and folds."""

    index: np.ndarray
    bounds: np.ndarray
    toxic: np.ndarray
    fold: np.ndarray


def kinds_of(rows: Rows, features: int) -> np.ndarray:
    """For each document its kind among the toxic ones, or -1: spherical k-means on which features a document has."""
    out = np.full(len(rows.toxic), -1)
    own = np.flatnonzero(rows.toxic > 0)
    doc = np.repeat(np.arange(len(out)), np.diff(rows.bounds))
    use = (rows.index < features) & (rows.toxic[doc] > 0)
    doc, index = np.searchsorted(own, doc[use]), rows.index[use]
    if len(own) < KINDS or not len(index):
        out[own] = 0
        return out
    value = 1 / np.sqrt(np.bincount(doc, minlength=len(own)))[doc]

    def unit(weights: np.ndarray) -> np.ndarray:
        centre = np.bincount(index, value * weights[doc], minlength=features)
        return centre / max(np.linalg.norm(centre), 1e-12)

    near = lambda centre: np.bincount(doc, value * centre[index], minlength=len(own))
    only = lambda k: (np.arange(len(own)) == k).astype(float)
    # the common features say nothing on kinds: what counts is what a document has beyond the mean
    mean = unit(np.ones(len(own)))
    centres, closest = [], near(mean)
    for _ in range(KINDS):
        centres.append(unit(only(int(np.argmin(closest)))))
        closest = np.maximum(closest, near(centres[-1])) if len(centres) > 1 else near(centres[0])
    for _ in range(20):
        kind = np.argmax([near(c) for c in centres], axis=0)
        moved = [unit((kind == k).astype(float)) if (kind == k).any() else c for k, c in enumerate(centres)]
        if all(np.allclose(a, b) for a, b in zip(moved, centres)):
            break
        centres = moved
    out[own] = kind
    return out


def fit(rows: Rows, words: int, earlier: np.ndarray, label: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Weights of the words, of the earlier probabilities and the intercept, by Adam on the regularised log loss."""
    doc = np.repeat(np.arange(len(use)), np.diff(rows.bounds))
    inside = use[doc]
    doc, index = doc[inside], rows.index[inside]
    k = earlier.shape[1]
    w = np.zeros(words + k + 1)
    mean = min(max(label[use].mean() if use.any() else 0.5, 1e-3), 1 - 1e-3)
    w[-1] = np.log(mean / (1 - mean))
    first, second, n = np.zeros_like(w), np.zeros_like(w), max(1, int(use.sum()))
    for step in range(1, STEPS + 1):
        margin = np.bincount(doc, w[index], minlength=len(use)) + earlier @ w[words : words + k] + w[-1]
        error = np.where(use, sigmoid(margin) - label, 0.0) / n
        gradient = np.concatenate([np.bincount(index, error[doc], minlength=words), earlier.T @ error, [error.sum()]])
        gradient[:-1] += L2 * w[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        w -= RATE * (1 - step / (STEPS + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    return w


def probability(w: np.ndarray, words: int, index: np.ndarray, doc: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    k = earlier.shape[1]
    return sigmoid(np.clip(np.bincount(doc, w[index], minlength=len(earlier)) + earlier @ w[words : words + k] + w[-1], -20, 20))


def word_features(word: bytes) -> list[bytes]:
    """The word, and its beginnings, marked with a star."""
    text = word.decode("utf-8", "replace")
    return [word, *(text[:n].encode() + b"*" for n in STEMS if len(text) > n)]


def feature_counts(texts: list[bytes | None], number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """document, feature and count, for the features of each document that have a number."""
    words, bounds = flatten([alnum_words(t) for t in texts])
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    lists = [[number[f] for f in word_features(w) if f in number] for w in ids]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.array([f for x in lists for f in x], np.int64)
    head = np.cumsum(sizes) - sizes
    n = sizes[at]
    doc = np.repeat(np.repeat(np.arange(len(texts)), np.diff(bounds)), n)
    feature = flat[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(head[at], n)] if len(flat) else np.empty(0, np.int64)
    pair, times = np.unique(doc * max(1, len(number)) + feature, return_counts=True)
    return pair // max(1, len(number)), pair % max(1, len(number)), times


def indicators(doc: np.ndarray, feature: np.ndarray, times: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """document and weight number: one for each count that the feature reaches."""
    parts = [(doc[times > k], feature[times > k] + k * features) for k in range(TIMES)]
    doc, index = np.concatenate([d for d, _ in parts]), np.concatenate([i for _, i in parts])
    order = np.argsort(doc, kind="stable")
    return doc[order], index[order]


@dataclass
class Chain:
    vocabulary: dict[bytes, int]
    weights: dict[str, np.ndarray]

    def score(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Probabilities of each category, in the chain's order."""
        n = len(self.vocabulary)
        doc, index = indicators(*feature_counts(texts, self.vocabulary), n)
        earlier = np.zeros((len(texts), 0))
        for w in self.weights.values():
            earlier = np.column_stack([earlier, probability(w, TIMES * n, index, doc, earlier)])
        return list(earlier.T)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """doc_ids, texts and labels of a few hundred sample rows at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            yield part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist()


def chosen_features(sample: DataFrame) -> dict[bytes, int]:
    """The MAX_FEATURES features with the largest chi-square, numbered; counted in the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, toxic = Counter(), Counter()
        for _, texts, labels in _texts(batches):
            for text, label in zip(texts, labels, strict=True):
                found = {f for w in set(alnum_words(text)) for f in word_features(w)}
                seen.update(found)
                if label:
                    toxic.update(found)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64()), pa.array([toxic[f] for f in seen], pa.int64())], ["feature", "n", "toxic"])

    sample = sample.select("doc_id", "text", "label")
    total = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    if not total["n"]:
        return {}
    share = total["toxic"] / total["n"]
    counted = sample.mapInArrow(count, "feature binary, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where(F.col("n") >= MIN_DOCS)
    chi = F.pow(F.col("toxic") - F.col("n") * share, F.lit(2.0)) / F.greatest(F.col("n") * (share * (1 - share)), F.lit(1e-9))
    best = counted.select("feature", chi.alias("chi")).orderBy(F.desc("chi"), "feature").limit(MAX_FEATURES).collect()
    return {bytes(r["feature"]): i for i, r in enumerate(best)}


def numbered_rows(sample: DataFrame, vocabulary: dict[bytes, int]) -> Rows:
    """The sample's weight numbers and labels, which go to the driver; texts don't."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, labels in _texts(batches):
            doc, index = indicators(*feature_counts(texts, vocabulary), len(vocabulary))
            bounds = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([int(bool(y)) for y in labels], pa.int32()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(index.astype(np.int32)))], ["doc_id", "toxic", "index"])

    got = sample.select("doc_id", "text", "label").mapInArrow(number, "doc_id long, toxic int, index array<int>").orderBy("doc_id", "toxic", "index").toArrow().combine_chunks()
    if not got.num_rows:
        return Rows(np.empty(0, np.int64), np.zeros(1, np.int64), np.empty(0), np.empty(0, np.int64))
    index, ids = got.column("index").combine_chunks(), got.column("doc_id").to_pylist()
    sizes = pa.compute.list_value_length(index).to_numpy(zero_copy_only=False)
    fold = np.array([zlib.crc32(f"fold {i}".encode()) % FOLDS for i in ids])
    return Rows(index.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), got.column("toxic").to_numpy().astype(float), fold)


def train_chain(sample: DataFrame) -> Chain:
    """The chain fitted on the bounded sample (doc_id, text, label), a written table."""
    import pyarrow.compute  # noqa: F401

    spark = sample.sparkSession
    vocabulary = chosen_features(sample)
    rows = numbered_rows(sample, vocabulary)
    n = len(rows.fold)
    if not n:
        return Chain({}, {c: np.zeros(i + 1) for i, c in enumerate(CHAIN)})
    words = TIMES * len(vocabulary)
    doc = np.repeat(np.arange(n), np.diff(rows.bounds))
    kind = kinds_of(rows, len(vocabulary))
    labels = {c: (kind == k).astype(float) for k, c in enumerate(CHAIN[:-1])} | {CHAIN[-1]: rows.toxic}
    held = spark.sparkContext.broadcast((rows, labels))
    earlier, weights = np.zeros((n, 0)), {}
    for category in CHAIN:

        def fit_folds(batches: Iterator[pa.RecordBatch], category=category, earlier=earlier) -> Iterator[pa.RecordBatch]:
            rows, labels = held.value
            for batch in batches:
                for fold in batch.column(0).to_pylist():  # FOLDS stands for no fold left out
                    w = fit(rows, words, earlier, labels[category], rows.fold != fold)
                    yield pa.RecordBatch.from_arrays([pa.array([fold]), pa.array([pickle.dumps(w)], pa.binary())], ["fold", "weights"])

        fitted = {r["fold"]: pickle.loads(r["weights"]) for r in spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(fit_folds, "fold long, weights binary").collect()}
        out_of_fold = np.zeros(n)
        for fold in range(FOLDS):
            here = rows.fold == fold
            out_of_fold[here] = probability(fitted[fold], words, rows.index, doc, earlier)[here]
        weights[category] = fitted[FOLDS]
        earlier = np.column_stack([earlier, out_of_fold])
    return Chain(vocabulary, weights)


def score_toxicity(docs: DataFrame, model: Chain, keep: list[str], text: str = "text") -> DataFrame:
    """The `keep` columns with p_<category> for each category of the chain."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = T.StructType([T.StructField(f"p_{c}", T.DoubleType()) for c in model.weights])
    return map_texts(docs, keep, text, fields, lambda texts: shared.value.score(texts))


def op2_toxicity_chain(spark, sf_dir: str) -> DataFrame:
    """Probabilities of all categories for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train_chain(labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", MAX_LABELLED))
    scored = score_toxicity(docs, model, ["doc_id"])
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), *[f"p_{c}" for c in CHAIN], F.col("p_toxic").alias("score"), (F.col("p_toxic") > THRESHOLD).alias("toxic"))
