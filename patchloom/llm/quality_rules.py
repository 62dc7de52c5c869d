"""Quality rules whose last word is the host's: failure rates by host, shrunk by a beta prior fitted to all hosts.

A document's own counts decide first (`base_failed`). A host with too many failing documents, after shrinkage,
takes its other documents with it. Null and empty texts have no words and fail. A null host is a host of its own.
Repeated rows count each time. An empty table gives an empty result. A host whose shrunk rate is the limit itself is kept.
A very long text is handled alone, whole. Columns of any other name are not read, or carried unchanged where rows are kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import covered, flatten, join_small, map_texts, materialize, per_document, space_words, word_ids

MIN_WORDS = 10
REPEAT_WINDOW = 5
MAX_REPEAT_PERCENT = 20
#: A host is rejected if its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5

_SYMBOLS = b"#*$%&|<>"
_NOT_COUNTED = bytes([0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)])  # white space, and bytes that continue a character
_MIX = np.uint64(0x9E3779B97F4A7C15)

RULES = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])


def repeated_in_document(ids: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """For each document, the words in windows of `width` words that the document holds twice or more."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    n = len(ids)
    if n < width:
        return np.zeros(len(bounds) - 1, np.int64)
    starts = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
    key = doc[starts].astype(np.uint64)
    for j in range(width):
        key = (key + ids[starts + j].astype(np.uint64)) * _MIX
        key ^= key >> np.uint64(29)
    order = np.argsort(key)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    a, b = starts[order[same]], starts[order[same + 1]]
    if not ((doc[a] == doc[b]).all() and all((ids[a + j] == ids[b + j]).all() for j in range(width))):
        # two windows with one hash: tell them apart by their words
        table = np.column_stack([doc[starts], *(ids[starts + j] for j in range(width))])
        _, back, times = np.unique(table, axis=0, return_inverse=True, return_counts=True)
        hit = starts[times[back.ravel()] > 1]
    else:
        hit = np.unique(np.concatenate([a, b]))
    return per_document(covered(n, hit, width), bounds)


def _duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if not x.isspace() and x]
    return len(lines) - len(set(lines))


def _measure(texts: list[bytes | None]) -> list:
    texts = [t or b"" for t in texts]
    words, bounds = flatten([space_words(t) for t in texts])
    return [
        np.diff(bounds),
        [len(t.translate(None, _NOT_COUNTED)) for t in texts],
        [len(t) - len(t.translate(None, _SYMBOLS)) for t in texts],
        [_duplicate_lines(t) for t in texts],
        repeated_in_document(word_ids(words), bounds, REPEAT_WINDOW),
    ]


def document_rules(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The `keep` columns of each document with its counts and base_failed."""
    found = map_texts(docs, keep, text, RULES, _measure)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def host_verdicts(rules: DataFrame, host: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """For each host: documents, failures, the shrunk failure rate and the verdict.

    The beta prior has the mean and the variance of the hosts' rates (method of moments, hosts weighted by their
    documents, the binomial share of the variance taken out). Hosts that don't differ get the overall rate.
    """
    hosts = rules.groupBy(host).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    n, f = F.col("host_docs"), F.col("host_failed")
    total = hosts.agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.count(F.lit(1)).alias("k"), F.sum(n * n).cast("double").alias("nn"), F.sum(f * f / n).alias("ff")).first()
    alpha, beta = prior(total["n"] or 0, total["f"] or 0, total["k"], total["nn"] or 0.0, total["ff"] or 0.0)
    rate = (f + F.lit(alpha)) / (n + F.lit(alpha + beta))
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", F.col("host_rate") > max_rate)


def prior(n: int, f: int, hosts: int, nn: float, ff: float) -> tuple[float, float]:
    """alpha and beta from the sums over hosts of n, f, n*n and f*f/n."""
    if not n:
        return 1.0, 1.0
    mean = f / n
    if not 0 < mean < 1:
        return 1.0 + f, 1.0 + (n - f)
    spread = ff - n * mean * mean  # sum of n * (rate - mean)^2
    scale = n - nn / n
    between = max(0.0, (spread - (hosts - 1) * mean * (1 - mean)) / scale) if scale > 0 else 0.0
    strength = mean * (1 - mean) / between - 1 if between > 0 else float(n)
    strength = min(max(strength, 1.0), float(n))
    return mean * strength, (1 - mean) * strength


def judge(rules: DataFrame, host: str = "source", doc_id: str = "doc_id", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Rules with the host's columns and kept."""
    joined = join_small(rules, host_verdicts(rules, host, max_rate), host, F.col(doc_id))
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row for each document with counts, the host's figures and kept. The texts are read once."""
    rules = materialize(document_rules(docs.select(doc_id, host, text), [doc_id, host], text))
    return judge(rules, host, doc_id, max_rate)


def keep_good(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    One pass counts and writes the rows, without the texts of those that fail; hosts are judged from what it wrote, and
    their verdicts meet the rows when these are read again.
    """
    inner = [f"__c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, inner, strict=True))
    counted = document_rules(docs.toDF(*inner), inner, at[text])
    passed = materialize(counted.withColumn(at[text], F.when(~F.col("base_failed"), F.col(at[text]))).select(*inner, "base_failed"))
    verdicts = materialize(host_verdicts(passed, at[host], max_rate))
    judged = join_small(passed.where("not base_failed"), verdicts, at[host], F.col(at[doc_id]))
    return judged.where("not host_rejected").select(*[F.col(v).alias(k) for k, v in at.items()])


def op3_host_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
