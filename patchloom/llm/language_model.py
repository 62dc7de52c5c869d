"""Language-model scores: a log-bilinear neural model trained with noise-contrastive estimation, and a unigram base.

Words are counted over all training documents. The WORDS most frequent ones have output vectors, in classes of equal
size by frequency, about as many classes as words in each; all other words are one more class, inside of which the
smoothed count decides. From the ORDER tokens before, their vectors, each times the weights of its distance, add up to
a query. Its products with the class vectors, and with the vectors of the words in the class, are the scores of the two
levels. Training is noise-contrastive on both: true targets against classes, and words of the target's class, drawn by
their counts; every training token is a target. Every trainer, a task, learns from its own documents from one start, and
each row of weights is averaged over the trainers by how often they used it. As an average of models that have seen little
is hardly a model, small partitions are joined until a trainer has about TRAINER_TOKENS. Scoring normalises with softmaxes over all classes and
over all words of the class, in batched matrix products, so that a text's score is a log10 probability.

Counts have no bound, so tasks hold those of at most HEAD_WORDS tokens, all that reach a count which the driver finds
from a histogram; a document's rarer tokens, each once with its number, go through a join with the counts. Tokens are
known by 64-bit hashes.

Null and empty texts are the end token alone. Repeated rows get a row each. Learning leaves out documents whose crc32
(of the doc_id as text) mod 5 is 1; a null doc_id is not held out. Without training documents all scores come from
the smoothing alone. A text larger than a slice is handled alone, whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flatten, lower_space_words, map_texts, materialize, sliced
from .quality_model import remainder

#: Words with output vectors at most, and the training count that such a word has at least.
WORDS, MIN_COUNT = 16_384, 2
ORDER = 5
WIDTH = 16
#: Input vectors for all other tokens, shared by hash.
SHARED = 2048
HEAD_WORDS = 300_000
BATCH, NOISE, RATE = 8192, 16, 0.05
#: Score matrices have this many entries at most.
STEP_SCORES = 1 << 17
#: Rows of weights that elementwise products take at once, as rows of WIDTH are too short for numpy; BATCH is a multiple of it.
TILE = 64
#: Sums of exponentials below this, or above its inverse, are taken again from the largest score on.
SMALLEST = 1e-25
PIECES = 64
#: Training tokens of a trainer on average, at least, as far as there are so many.
TRAINER_TOKENS = 2_000_000

END = b"\n"  # no word holds white space


def token_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return hash_array(np.array(words, object), categorize=False).view(np.int64)


def token_hash(word: bytes) -> int:
    return int(token_hashes([word])[0])


def hashed_tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each document's words and then its end, and where documents begin."""
    words, bounds = flatten([[*lower_space_words(t), END] for t in texts])
    return token_hashes(words), bounds


def _slices(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[bytes | None]]:
    import pyarrow.compute  # noqa: F401

    for batch in batches:
        texts = batch.column(0).cast(pa.binary())
        sizes = np.nan_to_num(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(float))
        for a, b in sliced(sizes, limit):
            yield texts.slice(a, b - a).to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts of the texts of a task, handed on whenever there are many."""
    token, c = np.empty(0, np.int64), np.empty(0, np.int64)
    for texts in _slices(batches, 4 << 20):
        found = np.unique(hashed_tokens(texts)[0], return_counts=True)
        token, c = (np.concatenate(x) for x in zip((token, c), found))
        by = np.argsort(token, kind="stable")  # two sorted runs
        token, c = token[by], c[by]
        head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        token, c = token[head], np.add.reduceat(c, head)
        if len(token) > 1_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(c)], ["token", "c"])
            token, c = token[:0], c[:0]
    if len(token):
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(c)], ["token", "c"])


def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """token (hash) and c, its count in all texts."""
    return docs.select(text).mapInArrow(_count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The head: tokens (sorted hashes) with their ranks by count, counts by rank; and the totals of all tokens."""

    token: np.ndarray
    rank: np.ndarray
    c: np.ndarray
    n: int
    distinct: int

    def __post_init__(self) -> None:
        self.words = int(min(WORDS, (self.c >= MIN_COUNT).sum()))
        self.classes = max(1, int(np.ceil(np.sqrt(self.words))))
        self.per_class = max(1, -(-self.words // self.classes))
        self.classes = -(-self.words // self.per_class)
        #: The target that stands for all words without an output vector.
        self.rest = self.classes * self.per_class

    @cached_property
    def _starts(self) -> np.ndarray:
        """Where the tokens with each value of their first 20 bits begin."""
        return np.searchsorted(self.token, (np.arange(1 << 20) - (1 << 19)) << 44).astype(np.int32)

    def ranks(self, tokens: np.ndarray) -> np.ndarray:
        """Each token's rank, or -1 outside of the head."""
        if not len(self.token):
            return np.full(len(tokens), -1)
        last = len(self.token) - 1
        at = np.minimum(self._starts[(tokens >> 44) + (1 << 19)], last)
        ahead = np.flatnonzero((self.token[at] < tokens) & (at < last))
        while len(ahead):
            at[ahead] += 1
            ahead = ahead[(self.token[at[ahead]] < tokens[ahead]) & (at[ahead] < last)]
        return np.where(self.token[at] == tokens, self.rank[at], -1)

    @cached_property
    def log_smoothed(self) -> np.ndarray:
        return np.log10(self.c + 0.5) if len(self.c) else np.full(1, np.log10(0.5))

    @property
    def base_mass(self) -> float:
        return self.n + 0.5 * (self.distinct + 1)

    @property
    def rest_mass(self) -> float:
        """Smoothed mass of the words without output vectors, one unseen word included."""
        return float(self.n - self.c[: self.words].sum()) + 0.5 * (self.distinct - self.words + 1)


def head_of(counts: DataFrame, most: int | None = None) -> Vocabulary:
    """All tokens that reach a count such that there are HEAD_WORDS at most, as arrays on the driver."""
    most = HEAD_WORDS if most is None else most
    # a histogram over steps of the logarithm of the count: a few hundred rows
    step = F.floor(F.log2(F.col("c").cast("double")) * 16)
    found = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n"), F.min("c").alias("least")).orderBy(F.desc("step")).collect()
    held, least = 0, None
    for r in found:
        if held + r["v"] > most:
            break
        held, least = held + r["v"], r["least"]
    top = counts.where(F.col("c") >= (1 << 62 if least is None else least)).toArrow()
    token, c = top.column("token").to_numpy(), top.column("c").to_numpy()
    by = np.lexsort((token, -c))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    order = np.argsort(token)
    return Vocabulary(token[order], rank[order], c[by], sum(r["n"] for r in found), sum(r["v"] for r in found))


class Codes:
    """Codes of words: the rank in the head, or -1, -2, ... for other words, whose hashes are in `tail` in that order, for the texts coded last."""

    def __init__(self, known: Vocabulary):
        self.known = known
        self.tail = np.empty(0, np.int64)

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all tokens, each document's words and then its end, and where documents begin."""
        tokens, bounds = hashed_tokens(texts)
        code = self.known.ranks(tokens)
        rare = np.flatnonzero(code < 0)
        self.tail, place = np.unique(tokens[rare], return_inverse=True)
        code[rare] = -1 - place
        return code, bounds


class LogBilinear:
    """Rows of weights, WIDTH and a bias each: input vectors, distance weights, class vectors, word vectors."""

    def __init__(self, known: Vocabulary):
        self.known = known
        draw = np.random.default_rng(20)
        v, k = known.rest, known.classes + 1
        self.inputs, self.pad = 0, v + SHARED
        self.at_distance = self.pad + 1
        self.at_class = self.at_distance + ORDER
        self.at_word = self.at_class + k
        self.rows = draw.normal(0, 0.1, (self.at_word + v, WIDTH + 1)).astype(np.float32)
        self.rows[self.pad] = 0  # before the first token
        self.rows[self.at_distance : self.at_class] = 1
        counts = np.zeros(v + 1)
        counts[: known.words] = known.c[: known.words] + 0.5
        self.cumulated = np.concatenate([[0], np.cumsum(counts)])
        mass = np.add.reduceat(counts, np.arange(0, v + 1, known.per_class))
        mass[-1] = known.rest_mass
        self.class_noise = mass / mass.sum()
        self.word_noise = np.maximum(counts[:v], 1e-9) / np.repeat(mass[:-1], known.per_class)
        self.rows[self.at_class : self.at_word, WIDTH] = np.log(self.class_noise)
        self.rows[self.at_word :, WIDTH] = np.log(self.word_noise)
        self.rows[self.at_word + known.words :, WIDTH] = -1e4  # places of the last class that no word has
        self.class_chance, self.word_chance = (np.log(NOISE * x).astype(np.float32) for x in (self.class_noise, self.word_noise))
        self.squares = np.full(self.rows.shape, 0.1, np.float32)
        #: Of class and word vectors; all zero between steps.
        self.gradient = np.zeros((len(self.rows) - self.at_class, WIDTH + 1), np.float32)
        self.used = np.zeros(len(self.rows))

    def layout(self, codes: np.ndarray, bounds: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input rows and targets in one line, ORDER empty places before each document; and the tokens' places in it."""
        own = codes.copy()
        rare = np.flatnonzero((codes < 0) | (codes >= self.known.words))
        low = codes[rare]
        spread = low % SHARED
        spread[low < 0] = tail[-1 - low[low < 0]] % SHARED
        own[rare] = self.known.rest + spread
        spot = np.arange(len(codes)) + ORDER * (1 + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)))
        line = np.full(len(codes) + ORDER * (len(bounds) - 1), self.pad)
        target = np.full(len(line), -1)
        line[spot] = own
        target[spot] = np.where((codes < 0) | (codes >= self.known.words), self.known.rest, codes)
        return line, target, spot

    def distance_tiles(self) -> np.ndarray:
        """The distance weights, each TILE times in a line."""
        return np.tile(self.rows[self.at_distance : self.at_class, :WIDTH], TILE)

    def queries(self, near: np.ndarray, tiles: np.ndarray) -> np.ndarray:
        """The queries of all places but the first ORDER, a multiple of TILE, from the input vectors of all."""
        n = len(near) - ORDER
        query = self._tiled(near, 0, n) * tiles[0]
        for i in range(1, ORDER):
            query += self._tiled(near, i, n) * tiles[i]
        return query.reshape(n, WIDTH)

    @staticmethod
    def _tiled(near: np.ndarray, i: int, n: int) -> np.ndarray:
        """The n input vectors that lie 1 + i places before, TILE of them a row."""
        return near[ORDER - 1 - i : ORDER - 1 - i + n].reshape(-1, TILE * WIDTH)

    def queries_of(self, line: np.ndarray, spot: np.ndarray) -> np.ndarray:
        """The queries of these places of the line, a BATCH at a time; the last column is 1."""
        inputs, tiles = np.ascontiguousarray(self.rows[: self.at_distance, :WIDTH]), self.distance_tiles()
        out = np.ones((len(spot), WIDTH + 1), np.float32)
        line = np.concatenate([line, np.full(-(len(line) - ORDER) % TILE, self.pad)])
        starts = np.arange(ORDER, len(line), BATCH)
        edge = np.append(np.searchsorted(spot, starts), len(spot))
        for k, a in enumerate(starts.tolist()):
            places = spot[edge[k] : edge[k + 1]]
            out[edge[k] : edge[k + 1], :WIDTH] = self.queries(inputs[line[a - ORDER : a + BATCH]], tiles)[places - a]
        return out

    def _noise_rows(self, rows: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """Noise rows, the log of the expected number of each taken off their bias, all with the sign turned."""
        turned = -self.rows[rows]
        turned[..., WIDTH] += chance
        return turned

    def _against_noise(self, query: np.ndarray, turned: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients by the queries (not by their last column) and by the noise rows, of which each block of queries has NOISE of its own."""
        blocks = [(k, edge[k], edge[k + 1]) for k in np.flatnonzero(np.diff(edge)).tolist()]
        false = np.empty((len(query), NOISE), np.float32)
        for k, a, b in blocks:
            np.matmul(query[a:b], turned[k].T, out=false[a:b])
        np.exp(false, out=false)
        false += 1
        np.reciprocal(false, out=false)
        d_query, d_noise = np.empty_like(query), np.zeros((len(turned), NOISE, WIDTH + 1), np.float32)
        for k, a, b in blocks:
            np.matmul(false[a:b], turned[k], out=d_query[a:b])
            np.matmul(false[a:b].T, query[a:b], out=d_noise[k])
        np.negative(d_noise, out=d_noise)
        return d_query, d_noise

    def _for_true(self, query: np.ndarray, own: np.ndarray, chance: np.ndarray, gradient: np.ndarray, first_row: int) -> np.ndarray:
        """Gradient by the queries; that by the rows is added. own: each query's row, in order."""
        held = self.rows[own]
        true = np.einsum("ij,ij->i", query, held)
        true -= chance
        true = 1 / (1 + np.exp(true))
        head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        gradient[own[head] - first_row] += np.add.reduceat(true[:, None] * query, head, axis=0)
        return true[:, None] * held

    @staticmethod
    def _summed(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct numbers, and the sum of the rows of each."""
        by = np.argsort(index.astype(np.uint16) if index.max(initial=0) < 1 << 16 else index, kind="stable")
        index = index[by]
        head = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
        return index[head], np.add.reduceat(rows[by], head, axis=0)

    def _ascend(self, rows: np.ndarray, gradient: np.ndarray) -> None:
        square = self.squares[rows]
        square += gradient * gradient
        self.squares[rows] = square
        np.sqrt(square, out=square)
        np.divide(gradient, square, out=square)
        square *= RATE
        self.rows[rows] += square

    def step(self, line: np.ndarray, target: np.ndarray, draw: np.random.Generator) -> int:
        """One ascent on the noise-contrastive objective of all targets but the first ORDER places; their number."""
        known = self.known
        target = target[ORDER:]
        real = np.flatnonzero(target >= 0)
        if not len(real):
            return 0
        line = np.concatenate([line, np.full(-len(target) % TILE, self.pad)])
        near, tiles = self.rows[: self.at_distance, :WIDTH][line], self.distance_tiles()
        every = self.queries(near, tiles)
        own = target[real]
        by = np.argsort(own.astype(np.uint16) if known.rest < 1 << 16 else own, kind="stable")
        real, own = real[by], own[by]
        query = np.ones((len(real), WIDTH + 1), np.float32)
        query[:, :WIDTH] = every[real]
        kind = own // known.per_class
        gradient, touched = self.gradient, np.zeros(len(self.gradient), bool)
        # classes
        noise = np.minimum(np.searchsorted(np.cumsum(self.class_noise), draw.random(NOISE), "right"), known.classes)
        d_query, d_noise = self._against_noise(query, self._noise_rows(self.at_class + noise, self.class_chance[noise])[None], np.array([0, len(query)]))
        np.add.at(gradient, noise, d_noise[0])
        touched[noise] = touched[kind] = True
        d_query += self._for_true(query, self.at_class + kind, self.class_chance[kind], gradient, self.at_class)
        # words of the classes, a block of queries each
        inside = int(np.searchsorted(own, known.rest))
        if inside:
            edge = np.searchsorted(own[:inside], np.arange(known.classes + 1) * known.per_class)
            low, high = (self.cumulated[np.arange(known.classes) * known.per_class + x] for x in (0, known.per_class))
            words = np.searchsorted(self.cumulated, low[:, None] + draw.random((known.classes, NOISE)) * (high - low)[:, None], "right") - 1
            words = np.minimum(words, known.words - 1)
            d_part, d_held = self._against_noise(query[:inside], self._noise_rows(self.at_word + words, self.word_chance[words]), edge)
            d_query[:inside] += d_part
            drawn, d_drawn = self._summed(words.ravel(), d_held.reshape(-1, WIDTH + 1))
            gradient[self.at_word - self.at_class + drawn] += d_drawn
            touched[self.at_word - self.at_class + drawn] = touched[self.at_word - self.at_class + own[:inside]] = True
            d_query[:inside] += self._for_true(query[:inside], self.at_word + own[:inside], self.word_chance[own[:inside]], gradient, self.at_class)
        hit = np.flatnonzero(touched)
        # back to the input vectors
        back = np.zeros((len(every), WIDTH), np.float32)
        back[real] = d_query[:, :WIDTH]
        d_near, d_distance, back = np.zeros(near.shape, np.float32), np.zeros((ORDER, WIDTH + 1), np.float32), back.reshape(-1, TILE * WIDTH)
        for i in range(ORDER):
            d_distance[i, :WIDTH] = (back * self._tiled(near, i, len(every))).sum(axis=0).reshape(TILE, WIDTH).sum(axis=0)
            part = self._tiled(d_near, i, len(every))
            part += back * tiles[i]
        used, summed = self._summed(line, d_near)
        d_input = np.zeros((len(used), WIDTH + 1), np.float32)
        d_input[:, :WIDTH] = summed
        d_input[used == self.pad] = 0
        for rows, part in ((used, d_input), (np.arange(self.at_distance, self.at_class), d_distance), (self.at_class + hit, gradient[hit])):
            self._ascend(rows, part)
        gradient[hit] = 0
        self.used[: self.at_distance] += np.bincount(line, minlength=self.at_distance)
        self.used[self.at_distance : self.at_word] += len(real)
        self.used[self.at_word : self.at_word + known.rest] += np.bincount(own[:inside], minlength=known.rest)
        self.used[self.at_class + hit] += 1
        return len(real)

    def log_probability(self, query: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of each target's probability, normalised over the classes and over the words of its class."""
        known = self.known
        by = np.argsort(target, kind="stable")
        query, own = query[by], target[by]
        kind = own // known.per_class
        edge = np.searchsorted(own, np.arange(known.classes + 1) * known.per_class)
        found = self._log_softmax(query, self.at_class, known.classes + 1, kind)
        for k in np.flatnonzero(np.diff(edge)).tolist():
            a, b = edge[k], edge[k + 1]
            first = self.at_word + k * known.per_class
            found[a:b] += self._log_softmax(query[a:b], first, known.per_class, own[a:b] - k * known.per_class)
        out = np.empty(len(target))
        out[by] = found
        return out

    def _log_softmax(self, query: np.ndarray, first: int, n: int, own: np.ndarray) -> np.ndarray:
        held = np.ascontiguousarray(self.rows[first : first + n].T)
        out = np.empty(len(query))
        step = max(1, STEP_SCORES // n)
        block, ones, at = np.empty((min(step, len(query)), n), np.float32), np.ones(n, np.float32), np.arange(step) * n
        for a in range(0, len(query), step):
            part = query[a : a + step]
            score = np.matmul(part, held, out=block[: len(part)])
            mine = score.reshape(-1)[at[: len(part)] + own[a : a + step]].astype(float)
            with np.errstate(over="ignore"):
                total = (np.exp(score, out=score) @ ones).astype(float)
            out[a : a + step] = mine - np.log(np.maximum(total, SMALLEST))
            # sums out of float32's reach: from the largest score on
            far = np.flatnonzero(~((total > SMALLEST) & (total < 1 / SMALLEST)))
            if len(far):
                score = part[far] @ held
                most = score.max(axis=1, keepdims=True)
                total = np.exp(score - most).sum(axis=1).astype(float)
                out[a + far] = mine[far] - most[:, 0] - np.log(total)
        return out


def learn_texts(model: LogBilinear, codes: Codes, texts: list[bytes | None], draw: np.random.Generator) -> int:
    """Trains the model on every token of the texts as a target; their number."""
    line, target, _ = model.layout(*codes.encode(texts), codes.tail)
    return sum(model.step(line[a - ORDER : a + BATCH], target[a - ORDER : a + BATCH], draw) for a in range(ORDER, len(line), BATCH))


def train_model(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> np.ndarray:
    """The rows after one pass over all training documents, a model a task, averaged by pieces of the rows."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        model, codes, n, draw = LogBilinear(known), Codes(known), 0, np.random.default_rng(5)
        for texts in _slices(batches, 1 << 20):
            n += learn_texts(model, codes, texts, draw)
        if n:
            weights = [p.tobytes() for p in np.array_split(model.rows, PIECES)]
            used = [p.astype(np.float32).tobytes() for p in np.array_split(model.used, PIECES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(weights, pa.binary()), pa.array(used, pa.binary())], ["piece", "weights", "used"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for piece, weights, used in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                times = np.frombuffer(used, np.float32).astype(float)[:, None] + 1e-6
                rows = np.frombuffer(weights, np.float32).reshape(-1, WIDTH + 1)
                total = held.setdefault(piece, [0.0, 0.0])
                total[0] = total[0] + times
                total[1] = total[1] + times * rows
        for piece, (times, rows) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([(rows / times).astype(np.float32).tobytes()], pa.binary())], ["piece", "weights"])

    trainers = max(1, vocabulary.n // TRAINER_TOKENS)
    trained = docs.select(text).coalesce(trainers).mapInArrow(learn, "piece int, weights binary, used binary")
    pieces = trained.repartition(PIECES, "piece").mapInArrow(average, "piece int, weights binary").collect()  # one model
    if not pieces:
        return LogBilinear(vocabulary).rows
    return np.concatenate([np.frombuffer(r["weights"], np.float32).reshape(-1, WIDTH + 1) for r in sorted(pieces, key=lambda r: r["piece"])])


LONGS = T.ArrayType(T.LongType())
HEAD_SCORES = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("n_head", T.LongType()), T.StructField("head_base", T.DoubleType()),
    T.StructField("head_score", T.DoubleType()), T.StructField("tail", LONGS), T.StructField("times", LONGS),
])


def head_scores(model: LogBilinear, codes: Codes, texts: list[bytes | None]) -> list:
    """For each text: tokens, those of the head, their base and model scores (all of the model's for others but the count), and the other tokens with their numbers."""
    known = model.known
    code, bounds = codes.encode(texts)
    line, target, spot = model.layout(code, bounds, codes.tail)
    query = model.queries_of(line, spot)
    score = model.log_probability(query, target[spot]) / np.log(10)
    in_head = code >= 0
    smoothed = known.log_smoothed[np.maximum(code, 0)]
    score += np.where(in_head & (code >= known.words), smoothed - np.log10(known.rest_mass), 0.0)
    base = np.where(in_head, smoothed - np.log10(known.base_mass), 0.0)
    head = bounds[:-1]
    rare = np.flatnonzero(~in_head)
    n = max(1, len(codes.tail))
    pair, times = np.unique(np.repeat(np.arange(len(texts)), np.diff(bounds))[rare] * n + (-1 - code[rare]), return_counts=True)
    ends = pa.array(np.searchsorted(pair, np.arange(len(texts) + 1) * n), pa.int32())
    tail = codes.tail[pair % n]
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (tail, times)]
    return [np.diff(bounds), np.add.reduceat(in_head.astype(np.int64), head), np.add.reduceat(base, head), np.add.reduceat(score, head), *lists]


def score_texts(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, rows: np.ndarray, keep: list[str], text: str = "text") -> DataFrame:
    """The `keep` columns of each document with n_tokens, n_known, base_score and score."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, rows))
    held: list = []

    def run(texts: list[bytes | None]) -> list:
        if not held:
            known, weights = shared.value
            model = LogBilinear(known)
            model.rows = weights
            held.extend((model, Codes(known)))
        return head_scores(*held, texts)

    scored = materialize(map_texts(docs, keep, text, HEAD_SCORES, run).withColumn("__row", F.monotonically_increasing_id()))
    rare = scored.select("__row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("__row", F.col("t.tail").alias("token"), F.col("t.times").alias("times"))
    found = rare.join(counts, "token", "left")
    known = F.sum(F.when(F.col("c").isNotNull(), F.col("times")))
    sums = found.groupBy("__row").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"), F.sum("times").alias("n"), known.alias("known"))
    zero = F.lit(0)
    logs, n, known = F.coalesce("logs", F.lit(0.0)), F.coalesce("n", zero), F.coalesce("known", zero)
    return scored.drop("tail", "times").join(sums, "__row", "left").select(
        *keep,
        "n_tokens",
        (F.col("n_head") + known).alias("n_known"),
        (F.col("head_base") + logs - n * float(np.log10(vocabulary.base_mass))).alias("base_score"),
        (F.col("head_score") + logs - n * float(np.log10(vocabulary.rest_mass))).alias("score"),
    )


def language_model_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    held_out = F.coalesce(remainder("doc_id", 5) == 1, F.lit(False))
    training = own.where(~held_out)
    counts = materialize(count_tokens(training))
    vocabulary = head_of(counts)
    scored = score_texts(own, counts, vocabulary, train_model(training, vocabulary), ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(vocabulary.n).cast("long").alias("train_tokens"), "base_score", "score")


def op4_log_bilinear_scores(spark, sf_dir: str) -> DataFrame:
    """Base and model scores of every document."""
    return language_model_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
