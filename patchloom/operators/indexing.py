"""Re-indexing: reuse of embeddings by content hash, index counts, embedding hooks."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import append_columns

KEYS = ["repository_id", "content_hash"]
DIMENSIONS = 384


def known_embeddings(existing: DataFrame) -> DataFrame:
    """One embedding for each (repository_id, content_hash): that of the smallest id."""
    return existing.groupBy(*KEYS).agg(F.min_by("embedding", "id").alias("embedding"))


def reuse_embeddings(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New chunks with the embedding of a known chunk of the same content, else null."""
    return new.join(known_embeddings(existing), KEYS, "left")


def to_embed(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Distinct new contents without an embedding; hashes alone are compared."""
    return new.join(existing.select(*KEYS).distinct(), KEYS, "left_anti").dropDuplicates(KEYS)


def index_stats(new: DataFrame, existing: DataFrame) -> DataFrame:
    """total, reused and embedded chunks of each repository."""
    known = existing.select(*KEYS).distinct().withColumn("known", F.lit(True))
    reused = F.count_if(F.coalesce("known", F.lit(False)))
    return new.select(*KEYS).join(known, KEYS, "left").groupBy("repository_id").agg(F.count(F.lit(1)).alias("total"), reused.alias("reused"), (F.count(F.lit(1)) - reused).alias("embedded"))


def hash_embedder(texts: list[str]) -> np.ndarray:
    """Where no model is plugged in: signed feature hashing of words (their md5) to unit vectors."""
    out = np.zeros((len(texts), DIMENSIONS))
    for row, text in zip(out, texts, strict=True):
        for word, times in Counter(text.split()).items():
            code = int(hashlib.md5(word.encode()).hexdigest()[:15], 16)
            row[code % DIMENSIONS] += times * (1 - 2 * (code // DIMENSIONS % 2))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def embed(df: DataFrame, text: str = "content", load: Callable[[], Callable[[list[str]], np.ndarray]] = lambda: hash_embedder, batch: int = 256) -> DataFrame:
    """df with `embedding`; `load` is called once in each task and gives the function that embeds a batch of texts."""
    held: list = []

    def run(texts: list) -> list[list]:
        if not held:
            held.append(load())
        return [list(np.asarray(held[0](["" if t is None else t for t in texts]), np.float32))]

    return append_columns(df, text, "embedding array<float>", run, batch)
