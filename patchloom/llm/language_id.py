"""Language of texts by a byte convolutional network.

A text is cut into windows of WINDOW bytes that overlap by the widest filter less one, so that no run of bytes is missed.
In a window every byte has an embedding; filters of several widths slide over them, each filter's largest response in
the window is kept, and a softmax over languages follows. A text's probabilities are the mean of its windows', weighted
by their bytes; the language is the most probable one, the first by code point in a tie.

Training, in numpy and in one task, reads windows drawn by hash from anywhere in at most MAX_TEXTS different texts of each
language, chosen by the text's hash; that bounds the sample, whatever the size of the corpus or of a group of copies.
Everything else covers every byte of every text. At most MAX_LANGS languages, those with the most texts, are learnt.

Learning leaves out rows that `held_out` marks, and rows without text or language. Texts that are null or have no letter
(no alphabetic character) are `und` with score 0, as is every text where nothing was learnt. With one language learnt, its
score is 1. Repeated rows count once in training and get a row each. A null doc_id is not held out. Columns of any other
name are not read. An empty table gives an empty result; a very long text is scored alone, in blocks of windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import BROADCAST_ROWS, map_texts, materialize
from .quality_model import remainder

MAX_TEXTS, MAX_LANGS = 800, 200
WINDOW, DIMENSIONS = 256, 8
WIDTHS, FILTERS = (2, 3, 4), 16
EPOCHS, BATCH, RATE = 6, 32, 0.004
#: Windows of one text that training reads; windows that are held, and multiplied, at once.
DRAWN, BLOCK, NEAR = 4, 512, 16
#: Places of a window at which every filter looks; the next window begins there.
STEP = WINDOW - max(WIDTHS) + 1
UNKNOWN = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text.decode("utf-8", "replace"))))


def window_starts(size: int) -> np.ndarray:
    """Where the windows of a text of so many bytes begin; the last one is padded."""
    return np.arange(max(1, -(-size // STEP))) * STEP


def windows_of(text: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows as rows of codes (byte + 1, 0 after the end) and their bytes."""
    codes = np.zeros(int(starts[-1]) + WINDOW, np.int16)
    codes[: len(text)] = np.frombuffer(text[: len(codes)], np.uint8)
    codes[: len(text)] += 1
    rows = np.lib.stride_tricks.sliding_window_view(codes, WINDOW)[starts]
    return rows, np.minimum(STEP, len(text) - starts)


class ByteNetwork:
    """Embedding, filters of each width with their largest response, softmax."""

    def __init__(self, langs: list[str], seed: int = 7):
        draw = np.random.default_rng(seed)
        self.langs = langs
        normal = lambda *shape: (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.weights = {"embedding": normal(257, DIMENSIONS) * 16}
        for w in WIDTHS:
            self.weights[f"filter{w}"] = normal(w * DIMENSIONS, FILTERS)
            self.weights[f"bias{w}"] = np.zeros(FILTERS, np.float32)
        self.weights["out"] = normal(len(WIDTHS) * FILTERS, len(langs))
        self.weights["out_bias"] = np.zeros(len(langs), np.float32)

    def pooled(self, codes: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]:
        """Each window's largest rectified responses, where each filter had them, and the embedded bytes."""
        embedded = self.weights["embedding"][codes]
        found, places = [], {}
        for w in WIDTHS:
            spans = np.concatenate([embedded[:, k : STEP + k] for k in range(w)], axis=2)
            response = spans.reshape(-1, w * DIMENSIONS) @ self.weights[f"filter{w}"]
            response = response.reshape(len(codes), STEP, FILTERS)
            places[w] = response.argmax(axis=1)
            found.append(np.maximum(np.take_along_axis(response, places[w][:, None], axis=1)[:, 0] + self.weights[f"bias{w}"], 0))
        return np.concatenate(found, axis=1), places, embedded

    def scorer(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embedding, all filters as rows of the widest one's length (the rest zero) and biases, for `probabilities`."""
        rows = np.zeros((len(WIDTHS) * FILTERS, max(WIDTHS) * DIMENSIONS), np.float32)
        for i, w in enumerate(WIDTHS):
            rows[i * FILTERS : (i + 1) * FILTERS, : w * DIMENSIONS] = self.weights[f"filter{w}"].T
        return np.ascontiguousarray(self.weights["embedding"].T), rows, np.concatenate([self.weights[f"bias{w}"] for w in WIDTHS])

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        """As softmax of pooled, by one product for all filters over a few windows at a time, which stay in cache."""
        embedding, filters, bias = self.scorer()
        best = np.empty((len(codes), len(filters)), np.float32)
        for a in range(0, len(codes), NEAR):
            block = codes[a : a + NEAR]
            embedded = np.take(embedding, block, axis=1)
            spans = np.concatenate([embedded[:, :, k : STEP + k] for k in range(max(WIDTHS))]).reshape(filters.shape[1], -1)
            best[a : a + NEAR] = (filters @ spans).reshape(len(filters), len(block), STEP).max(axis=2).T
        return self.softmax(np.maximum(best + bias, 0))

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        logits = pooled @ self.weights["out"] + self.weights["out_bias"]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of windows."""
        pooled, places, embedded = self.pooled(codes)
        off = self.softmax(pooled)
        off[np.arange(len(codes)), labels] -= 1
        off /= len(codes)
        found = {"out": pooled.T @ off, "out_bias": off.sum(axis=0), "embedding": np.zeros_like(self.weights["embedding"])}
        back = (off @ self.weights["out"].T) * (pooled > 0)
        row = np.arange(len(codes))[:, None]
        for i, w in enumerate(WIDTHS):
            part = back[:, i * FILTERS : (i + 1) * FILTERS]  # windows x filters
            at = places[w][:, :, None] + np.arange(w)  # windows x filters x width
            spans = embedded[row[:, :, None], at].reshape(len(codes), FILTERS, w * DIMENSIONS)
            found[f"filter{w}"] = np.einsum("nf,nfd->df", part, spans)
            found[f"bias{w}"] = part.sum(axis=0)
            to_bytes = np.einsum("nf,df->nfd", part, self.weights[f"filter{w}"]).reshape(-1, DIMENSIONS)
            np.add.at(found["embedding"], codes[row[:, :, None], at].reshape(-1), to_bytes)
        return found

    def fit(self, codes: np.ndarray, labels: np.ndarray, seed: int = 11) -> None:
        """Adam over shuffled batches, the rate falling to nothing."""
        draw, step = np.random.default_rng(seed), 0
        mean = {k: np.zeros_like(x) for k, x in self.weights.items()}
        square = {k: np.zeros_like(x) for k, x in self.weights.items()}
        total = EPOCHS * -(-len(codes) // BATCH)
        for _ in range(EPOCHS):
            order = draw.permutation(len(codes))
            for a in range(0, len(codes), BATCH):
                chosen = order[a : a + BATCH]
                rate = RATE * (1 - step / total)
                step += 1
                for k, g in self.gradients(codes[chosen], labels[chosen]).items():
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.001 * (g * g - square[k])
                    self.weights[k] -= (rate * mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def text_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """The mean over each text's windows, weighted by their bytes; windows of all texts share batches."""
        total, weight = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        rows: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        owner: list[np.ndarray] = []

        def score() -> None:
            own, size = np.concatenate(owner), np.concatenate(sizes).astype(float)
            np.add.at(total, own, self.probabilities(np.concatenate(rows)) * size[:, None])
            np.add.at(weight, own, size)
            rows.clear(), sizes.clear(), owner.clear()

        for i, text in enumerate(texts):
            starts = window_starts(len(text))
            for a in range(0, len(starts), BLOCK):
                part = starts[a : a + BLOCK]
                codes, size = windows_of(text[part[0] : part[-1] + WINDOW], part - part[0])
                rows.append(codes)
                sizes.append(size)
                owner.append(np.full(len(part), i))
                if sum(map(len, rows)) >= BLOCK:
                    score()
        if rows:
            score()
        return total / np.maximum(weight, 1)[:, None]


def sample_windows(docs: DataFrame, text: str = "text", lang: str = "lang", held_out: Column | None = None, most: int = MAX_TEXTS) -> DataFrame:
    """(lang, key, windows): windows of at most `most` different texts of each language, written.

    The texts with the smallest hashes are chosen, first among each of 64 shares, so that no task gets all of a language.
    """
    usable = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & ~(held_out if held_out is not None else F.lit(False)))
    rows = usable.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("key"))
    first = lambda df, *keys: df.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy("key"))).where(F.col("nth") <= most).drop("nth")
    keys = rows.select("lang", "key").distinct().withColumn("share", F.pmod("key", F.lit(64)))
    chosen = materialize(first(first(keys, "lang", "share"), "lang").drop("share"))
    largest = chosen.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).select("lang")
    chosen = chosen.join(F.broadcast(largest), "lang", "left_semi")
    small = chosen.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    picked = rows.join(F.broadcast(chosen) if small else chosen, ["lang", "key"], "left_semi")

    def draw(texts: list[bytes | None]) -> list:
        return [[_drawn(t) for t in texts]]

    schema = T.StructType([T.StructField("windows", T.ArrayType(T.BinaryType()))])
    return materialize(map_texts(picked, ["lang", "key"], "text", schema, draw).dropDuplicates(["lang", "key"]))


def _drawn(text: bytes | None) -> list[bytes]:
    """Up to DRAWN windows of a text, from anywhere in it; none of a text without letters."""
    if not has_letter(text):
        return []
    starts = window_starts(len(text))
    if len(starts) > DRAWN:
        starts = np.sort(np.random.default_rng(len(text)).choice(starts, DRAWN, replace=False))
    return [text[s : s + WINDOW] for s in starts.tolist()]


def train(sample: DataFrame) -> ByteNetwork | None:
    """The network fitted to a bounded sample, in one task; its weights, of fixed size, come to the driver."""
    langs = [r["lang"] for r in sample.where(F.size("windows") > 0).select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((key, lang, w) for b in batches for lang, key, ws in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for w in ws)
        if not rows:
            return
        codes = np.concatenate([windows_of(w, np.zeros(1, np.int64))[0] for *_, w in rows])
        network = ByteNetwork(langs)
        network.fit(codes, np.array([langs.index(lang) for _, lang, _ in rows]))
        flat = [(k, x.shape, x.astype(np.float32).tobytes()) for k, x in network.weights.items()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, *_ in flat]), pa.array([list(s) for _, s, _ in flat], pa.list_(pa.int64())), pa.array([x for *_, x in flat], pa.binary())], ["name", "shape", "value"])

    network = ByteNetwork(langs)
    for r in sample.coalesce(1).mapInArrow(run, "name string, shape array<long>, value binary").collect():
        network.weights[r["name"]] = np.frombuffer(r["value"], np.float32).reshape(r["shape"])
    return network


FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict_language(docs: DataFrame, network: ByteNetwork | None, keep: list[str], text: str = "text") -> DataFrame:
    """The `keep` columns of each document with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def score(texts: list[bytes | None]) -> list:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if shared.value is not None and has_letter(t)]
        if known:
            found = shared.value.text_probabilities([texts[i] for i in known])
            for i, best, p in zip(known, found.argmax(axis=1), found.max(axis=1), strict=True):
                names[i], scores[i] = shared.value.langs[best], min(1.0, float(p))
        return [names, scores]

    return map_texts(docs, keep, text, FIELDS, score)


def op12_byte_network_language(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those whose crc32 (of the doc_id as text) mod 3 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    network = train(sample_windows(docs, held_out=held_out))
    return predict_language(docs, network, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
