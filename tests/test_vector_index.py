"""Exact search by blocks round pivots: equal to multiplying everything, with blocks left out where vectors lie in groups."""

import random

import numpy as np
from pyspark.sql import functions as F

from patchloom.operators import retrieval, vector_index
from patchloom.operators.vector_index import VectorIndex

CHUNKS = "repository_id long, id long, file_path string, vector array<float>"
QUERIES = "review_id long, seq long, repository_id long, vector array<float>"


def plain(hits):
    return sorted((r["review_id"], r["seq"], r["chunk_id"], round(r["distance"], 8)) for r in hits.collect())


def test_search_equals_multiplying_everything(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_CHUNKS", 40)
    draw, noise = random.Random(6), np.random.default_rng(6)
    centres = noise.standard_normal((30, 24))
    near = lambda c, spread: (centres[c] + spread * noise.standard_normal(24)).tolist()
    rows = [(draw.choice([0, 0, 0, 1]), i, f"f{i % 9}.py", near(i % 30, 0.05)) for i in range(3000)]
    rows += [(0, 5000, "f1.py", [0.0] * 24), (1, 5001, "f1.py", None), (2, 5002, "alone.py", near(1, 0.1)), (0, 5003, None, near(2, 0.1)), (0, 17, "copy.py", rows[17][3])]
    asked = [(r, s, draw.choice([0, 0, 1, 2, 7]), near((5 * r + s) % 30, 0.05)) for r in range(6) for s in range(4)]
    asked += [(6, 0, 0, [0.0] * 24), (6, 1, 0, None), (6, 2, 0, (-centres[3]).tolist())]
    chunks, queries = spark.createDataFrame(rows, CHUNKS).repartition(3), spark.createDataFrame(asked, QUERIES)
    changed = spark.createDataFrame([(0, "f1.py"), (1, "f2.py"), (1, "f3.py"), (6, "alone.py")], "review_id long, file_path string")
    index = VectorIndex(spark, str(tmp_path / "index"))
    index.refresh(chunks)
    for gone in (None, changed):
        found = index.search(queries, 6, gone)
        assert plain(found.hits) == plain(retrieval.cosine_topk(chunks, queries, 6, gone))
    work = found.work.where("review_id < 6").agg(F.sum("vectors"), F.sum("scored")).first()
    assert 0 < work[1] < 0.4 * work[0]
    # a refreshed repository has its new vectors only, the others keep theirs
    index.refresh(chunks.where("repository_id = 0 and id % 2 = 0"))
    rest = chunks.where("repository_id <> 0 or id % 2 = 0")
    assert plain(index.search(queries, 6).hits) == plain(retrieval.cosine_topk(rest, queries, 6))


def test_both_indexes_retrieve_the_same_context(spark, tmp_path):
    from patchloom.operators.lexical_index import LexicalIndex

    draw, noise = random.Random(7), np.random.default_rng(7)
    words = ["check", "limit", "parse", "load", "store", "value", "index"]
    rows = [(i % 2, i, f"f{i % 7}.py", " ".join(draw.choices(words, k=6)), f"fn_{i}", i % 5 == 0, noise.standard_normal(8).tolist()) for i in range(120)]
    chunks = spark.createDataFrame(rows, "repository_id long, id long, file_path string, content string, symbol_name string, is_test boolean, vector array<float>")
    queries = spark.createDataFrame([(r, s, r % 2, " ".join(draw.choices(words, k=2)), noise.standard_normal(8).tolist()) for r in range(4) for s in range(3)], "review_id long, seq long, repository_id long, text string, vector array<float>")
    changed = spark.createDataFrame([(0, "f1.py"), (3, "f2.py")], "review_id long, file_path string")
    lexical, vectors = LexicalIndex(spark, str(tmp_path / "l")), VectorIndex(spark, str(tmp_path / "v"))
    lexical.refresh(chunks)
    vectors.refresh(chunks)
    rows_of = lambda df: sorted(tuple(r) for r in df.collect())
    want = rows_of(retrieval.retrieve_context(chunks, queries, changed))
    assert len(want) == 32 and rows_of(retrieval.retrieve_context(chunks, queries, changed, index=lexical, vectors=vectors)) == want
