"""Embeddings in buckets: the results of plain joins, no shuffle of stored rows, versions, races and re-dealing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.operators import indexing
from patchloom.operators.embedding_table import EmbeddingTable
from patchloom.sources.store import Conflict

CHUNKS = "repository_id int, id long, content_hash string, content string, note string"


def chunks(spark, rows):
    return spark.createDataFrame([(r, i, h, f"text of {h}", "kept") for r, i, h in rows], CHUNKS)


def counted(asked):
    """An embedder that adds one to an accumulator for every text."""

    def embedder(texts):
        asked.add(len(texts))
        return np.array([[len(t), sum(t.encode()) % 251] for t in texts], np.float32)

    return lambda: embedder


def expected(h):
    text = f"text of {h}"
    return [float(len(text)), float(sum(text.encode()) % 251)]


def contents(table, version=None):
    return {(r["repository_id"], r["content_hash"]): r["embedding"] for r in table.read(version).collect()}


def shuffled_scans(df):
    """Exchanges of the physical plan that lie above a scan of bucketed files."""
    plan, found, depth = df._jdf.queryExecution().executedPlan().toString().splitlines(), 0, []
    for line in plan:
        at = len(line) - len(line.lstrip(" :+-*()0123456789"))
        depth = [(d, n) for d, n in depth if d < at]
        depth.append((at, line.strip(" :+-*()0123456789")))
        if "Bucketed: true" in line:
            found += any(n.startswith("Exchange") for _, n in depth)
    return found, sum("Bucketed: true" in line for line in plan)


def test_refreshes_embed_what_is_new_once(spark, tmp_path):
    table, asked = EmbeddingTable(spark, str(tmp_path / "t"), buckets=5), spark.sparkContext.accumulator(0)
    first = [(1, i, f"h{i % 7}") for i in range(40)] + [(2, 50, "h1"), (None, 51, "h1"), (1, 52, None)]
    assert table.read().count() == 0 and table.stats(chunks(spark, first)).count() == 2
    assert table.refresh(chunks(spark, first), load=counted(asked)) == 1
    assert asked.value == 8  # seven contents of 1, one of 2; none without a key
    second = [(1, i, f"h{i % 9}") for i in range(100)] + [(2, 200, "h2"), (3, 201, "h1")]
    new = chunks(spark, second)
    stats = {r["repository_id"]: (r["total"], r["reused"], r["embedded"]) for r in table.stats(new).collect()}
    assert stats == {1: (100, 78, 22), 2: (1, 0, 1), 3: (1, 0, 1)}
    opened = table.read()
    assert table.refresh(new, load=counted(asked)) == 2 and asked.value == 12
    assert table.refresh(new, load=counted(asked)) == 3 and asked.value == 12  # nothing left
    keys = {(r, h) for r, _, h in first + second if r is not None and h is not None}
    assert contents(table) == {(r, h): expected(h) for r, h in keys}
    assert opened.count() == 8 and len(contents(table, 1)) == 8

    whole = table.attach(chunks(spark, first + second))
    assert whole.columns == ["repository_id", "content_hash", "id", "content", "note", "embedding"]
    got = sorted(((r["repository_id"], r["id"], r["content_hash"]), r["embedding"]) for r in whole.where("repository_id is not null and content_hash is not null").collect())
    assert got == sorted(((r, i, h), expected(h)) for r, i, h in first + second if r is not None and h is not None)
    assert whole.where("embedding is null").count() == 2 and whole.count() == len(first + second)


def test_equals_plain_joins(spark, tmp_path):
    table = EmbeddingTable(spark, str(tmp_path / "t"), buckets=3)
    old = spark.createDataFrame([(i, i % 3, f"h{i % 11}", [float(i)]) for i in range(60)], "id long, repository_id int, content_hash string, embedding array<float>")
    table.add(indexing.known_embeddings(old))
    new = chunks(spark, [(i % 4, i, f"h{i % 17}") for i in range(200)])
    plain = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert plain(table.attach(new)) == plain(indexing.reuse_embeddings(new, old))
    assert plain(table.missing(new)) == plain(indexing.to_embed(new, old))
    cast = indexing.index_stats(new, old).withColumn("repository_id", F.col("repository_id").cast("long"))
    assert plain(table.stats(new)) == plain(cast)


def test_stored_rows_are_not_shuffled(spark, tmp_path):
    table = EmbeddingTable(spark, str(tmp_path / "t"), buckets=6)
    for k in range(3):
        table.refresh(chunks(spark, [(i % 5, i, f"h{i}") for i in range(100 * k, 100 * k + 150)]))
    new = chunks(spark, [(i % 5, i, f"h{i}") for i in range(0, 900, 3)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled_scans(table.vectors(new)) == (0, 1)
        # the last count by repository shuffles counts, above the join
        counts = table.stats(new)._jdf.queryExecution().executedPlan().toString()
        assert counts.count("Exchange") == 3 and "embedding" not in counts.split("FileScan")[1].split("ReadSchema")[1].split("\n")[0]
        assert shuffled_scans(table.read().groupBy("repository_id").count())[0] == 0
        plan = new.join(table.read(), "content_hash")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2  # the check sees exchanges where there are some
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert table.vectors(new).count() == len({(i % 5, i) for i in range(0, 900, 3) if i < 350})


def test_a_race_keeps_both_and_embeds_nothing_again(spark, tmp_path, monkeypatch):
    table, other, asked = EmbeddingTable(spark, str(tmp_path / "t"), 4), EmbeddingTable(spark, str(tmp_path / "t"), 4), spark.sparkContext.accumulator(0)
    commit, raced = table.store.commit, []

    def late(*runs, expected=None):
        if not raced:
            raced.append(other.add(spark.createDataFrame([(1, "h1", [9.0]), (1, "h1", [8.0]), (7, "x", [7.0]), (7, "y", None)], "repository_id long, content_hash string, embedding array<float>")))
        return commit(*runs, expected=expected)

    monkeypatch.setattr(table.store, "commit", late)
    assert table.refresh(chunks(spark, [(1, 1, "h1"), (1, 2, "h2")]), load=counted(asked)) == 2
    assert asked.value == 2
    assert contents(table) == {(1, "h1"): [8.0], (7, "x"): [7.0], (1, "h2"): expected("h2")}


def test_compaction_drops_dead_contents_and_deals_anew(spark, tmp_path):
    table = EmbeddingTable(spark, str(tmp_path / "it's"), buckets=3)
    for k in range(3):
        table.refresh(chunks(spark, [(1, i, f"h{i}") for i in range(10 * k, 10 * k + 15)]))
    opened, everything = table.read(), contents(table)
    assert len(everything) == 35 and len(opened.inputFiles()) > 3
    live = chunks(spark, [(1, i, f"h{i % 20}") for i in range(50)])
    table.compact(live, buckets=8)
    assert table.buckets() == 8 and table.buckets(3) == 3 and len(table.read().inputFiles()) <= 8
    assert contents(table) == {k: v for k, v in everything.items() if int(k[1][1:]) < 20} and opened.count() == 35
    table.refresh(chunks(spark, [(2, 1, "z")]))
    assert len(contents(table)) == 21

    # what another writer dealt over other buckets meanwhile is not mixed in
    stand_in = table.store.stand_in
    table.store.stand_in = lambda *a, **k: (EmbeddingTable(spark, str(tmp_path / "it's")).refresh(chunks(spark, [(3, 1, "w")])), stand_in(*a, **k))[1]
    with pytest.raises(Conflict):
        table.compact(buckets=2)
    table.compact()
    table.store.stand_in = stand_in
    assert contents(table)[3, "w"] and len(contents(table)) == 22
    table.store.sweep(keep=1, grace_seconds=0)
    assert len(contents(table)) == 22
    with pytest.raises(ValueError):
        EmbeddingTable(spark, "/data/{a,b}")
