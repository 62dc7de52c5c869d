import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.operators import retrieval

CHUNKS = "id long, repository_id long, content string, file_path string, symbol_name string, start_line int, end_line int, is_test boolean, vector array<float>"


def chunk(i, text, path="a.py", repo=0, symbol=None, test=False, vector=None):
    return (i, repo, text, path, symbol, 1, 2, test, vector or [1.0, 0.0])


def test_lexical_match_ranks_first(spark):
    chunks = spark.createDataFrame([chunk(1, "total = price * amount"), chunk(2, "def parse_header(line): return header"), chunk(3, "")], CHUNKS)
    queries = spark.createDataFrame([(1, 0, 0, "header of a line")], "review_id long, seq long, repository_id long, text string")
    got = retrieval.bm25_scores(chunks, queries).orderBy(F.desc("score")).collect()
    assert [r["chunk_id"] for r in got] == [2] and got[0]["score"] > 0


WORDS = {"self": ["self"], "return": ["return"], "check_rule": ["check_rule", "check", "rule"], "user_id": ["user_id", "user", "id"], "alpha": ["alpha"], "beta": ["beta"], "42": ["42"], "check": ["check"]}


def test_bm25_by_subtraction_equals_a_matrix_of_what_is_left(spark):
    draw = np.random.default_rng(3)
    names, terms = list(WORDS), sorted({t for x in WORDS.values() for t in x})
    expand = np.array([[x.count(t) for t in terms] for x in WORDS.values()])
    picks = draw.integers(0, 2, (40, len(names))) * draw.integers(0, 4, (40, len(names)))
    rows = [chunk(i, " ".join(np.repeat(names, p)), f"f{i % 5}.py", i % 2) for i, p in enumerate(picks)]
    asked = draw.integers(0, 2, (8, len(names)))
    queries = [(i // 2, i % 2, i // 2 % 2, " ".join(np.repeat(names, p))) for i, p in enumerate(asked)]
    changed = [(0, "f1.py"), (0, "f2.py"), (1, "f0.py"), (2, "absent.py")]
    got = retrieval.bm25_scores(spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(queries, "review_id long, seq long, repository_id long, text string"), spark.createDataFrame(changed, "review_id long, file_path string"))
    found = {(r["review_id"], r["seq"], r["chunk_id"]): r["score"] for r in got.collect()}
    tf = picks @ expand  # chunk, term
    for (review, seq, repo, _), p in zip(queries, asked):
        left = np.array([i % 2 == repo and (review, f"f{i % 5}.py") not in changed for i in range(40)])
        df, length = (tf[left] > 0).sum(axis=0), tf.sum(axis=1)
        weight = np.clip((left.sum() - df + 0.5) / (df + 0.5), 0, None) * (p @ expand > 0)
        slow = 1.5 * (0.25 + 0.75 * length / length[left].mean())
        scores = (2.5 * tf / (tf + slow[:, None])) @ weight
        for i in range(40):
            assert abs(found.pop((review, seq, i), 0.0) - (scores[i] if left[i] else 0)) < 1e-8
    assert not found


@pytest.mark.parametrize("blocks", [(4096, 8192), (2, 7)], ids=["one pair of blocks", "many"])
def test_cosine_search_equals_direct(spark, monkeypatch, blocks):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(retrieval, "CHUNK_BLOCK", blocks[1])
    random.seed(4)
    vec = lambda: [random.gauss(0, 1) for _ in range(8)]
    rows = [(i, i % 2, f"f{i % 3}.py", None if i == 7 else [0.0] * 8 if i == 9 else vec()) for i in range(60)]
    asked = [(r, s, r % 2, None if (r, s) == (3, 1) else vec()) for r in range(6) for s in range(2)] + [(8, 0, 5, vec())]
    chunks = spark.createDataFrame(rows, "id long, repository_id long, file_path string, vector array<float>")
    queries = spark.createDataFrame(asked, "review_id long, seq long, repository_id long, vector array<float>")
    changed = [(0, "f0.py"), (2, "f1.py"), (2, "f2.py")]
    near = retrieval.cosine_topk(chunks, queries, 5, spark.createDataFrame(changed, "review_id long, file_path string"))
    got = {}
    for r in near.orderBy("review_id", "seq", "distance", "chunk_id").collect():
        got.setdefault((r["review_id"], r["seq"]), []).append((r["chunk_id"], r["distance"]))
    unit = lambda v: np.array(v, np.float32).astype(float) / (np.linalg.norm(np.array(v, np.float32).astype(float)) or 1)
    for review, seq, repo, vector in asked:
        want = [] if vector is None else sorted((1 - unit(vector) @ unit(v), i) for i, own, path, v in rows if own == repo and v is not None and (review, path) not in changed)[:5]
        assert [i for i, _ in got.get((review, seq), [])] == [i for _, i in want]
        assert np.allclose([d for _, d in got.get((review, seq), [])], [d for d, _ in want], atol=1e-7)


def test_cosine_search_meets_keys_of_other_types(spark):
    draw = np.random.default_rng(2)
    chunks = spark.createDataFrame([(i, i % 20, "a.py", draw.normal(size=4).tolist()) for i in range(100)], "id long, repository_id int, file_path string, vector array<float>")
    queries = spark.createDataFrame([(r, 0, r, draw.normal(size=4).tolist()) for r in range(20)], "review_id long, seq int, repository_id long, vector array<float>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several tasks
    try:
        got = [(r["review_id"], r["chunk_id"] % 20) for r in retrieval.cosine_topk(chunks, queries, 3).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got) == [(r, r) for r in range(20) for _ in range(3)]


def test_hybrid_is_the_union(spark):
    chunks = spark.createDataFrame([chunk(1, "alpha", "a.py", vector=[1.0, 0.0]), chunk(2, "needle_word", "b.py", vector=[0.0, 1.0]), (3, 0, "other", "c.py", None, 1, 2, False, None)], CHUNKS)
    queries = spark.createDataFrame([(1, 0, 0, "needle_word", [1.0, 0.0])], "review_id long, seq long, repository_id long, text string, vector array<float>")
    got = retrieval.retrieve_context(chunks, queries, k=2).collect()
    assert {r["chunk_id"] for r in got} == {1, 2}
    blank = spark.createDataFrame([(1, 0, 0, "  ", [1.0, 0.0])], queries.schema)
    assert retrieval.retrieve_context(chunks, blank, k=2).count() == 0


@pytest.mark.parametrize("blocks", [(512, 2048), (3, 7)], ids=["one pair of blocks", "many"])
def test_distances_of_all_pairs_by_blocks(spark, monkeypatch, blocks):
    monkeypatch.setattr(retrieval, "PAIR_QUERIES", blocks[0])
    monkeypatch.setattr(retrieval, "PAIR_CHUNKS", blocks[1])
    draw = np.random.default_rng(8)
    vec = lambda: np.float32(draw.normal(size=6)).tolist()
    rows = [(i, i % 2, None if i == 7 else [0.0] * 6 if i == 9 else vec()) for i in range(50)]
    asked = [(i, i % 3, i % 2, None if i == 3 else vec()) for i in range(20)] + [(99, 0, 5, vec())]
    found = retrieval.cosine_distances(spark.createDataFrame(rows, "id long, repository_id int, vector array<float>"), spark.createDataFrame(asked, "review_id long, seq long, repository_id long, vector array<float>"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("FlatMapCoGroupsInArrow")[0] and "lambda" not in plan  # no row of a pair before its distance
    got = {(r["review_id"], r["chunk_id"]): r["distance"] for r in found.collect()}
    assert set(got) == {(q, i) for q, _, own, _ in asked for i, repo, _ in rows if own == repo}
    for q, _, own, a in asked:
        for i, repo, b in rows:
            if own == repo:
                cosine = None if a is None or b is None else np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) if any(b) else 0
                assert got[q, i] is None if cosine is None else abs(got[q, i] - 1 + cosine) < 1e-8


def test_halves_are_rounded_as_the_sql_does(spark):
    import duckdb

    values = [k / 10**9 for k in range(500, 2 * 10**9, 3_333_000)] + [-0.0000005, 0.0, 1.0, 36199.640467465]
    want = [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 6)", [x]).fetchone()[0] for x in values]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in values], "x double").coalesce(1).select(retrieval.half_up(F.col("x"), 6)).collect()]
    assert got == want
