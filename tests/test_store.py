"""Versions of tables, and the lexical index that is kept in them."""

import random

import pytest
from pyspark.sql import functions as F

from patchloom import tables
from patchloom.operators import prompts, retrieval
from patchloom.operators.lexical_index import LexicalIndex
from patchloom.sources import writers
from patchloom.sources.store import Conflict, Store

SCHEMA = "repository_id long, file_path string, id long"


def chunk_rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def kept(df):
    return sorted((r["repository_id"] or 0, r["file_path"], r["id"]) for r in df.collect())


def test_a_reader_keeps_its_version(spark, tmp_path):
    path = str(tmp_path / "chunks")
    first = chunk_rows(spark, [(1, "a", 1), (1, "b", 2), (2, "a", 3), (None, "n", 4)])
    assert writers.replace_chunks(first, first, path) == 1
    old = writers.read_chunks(spark, path)
    done = spark.createDataFrame([(1,), (None,), (9,)], "repository_id long")
    # a row of a repository that isn't replaced is left out
    assert writers.replace_chunks(chunk_rows(spark, [(1, "c", 5), (2, "x", 6)]), done, path) == 2
    assert kept(old) == kept(first) == kept(writers.read_chunks(spark, path, 1))
    assert kept(writers.read_chunks(spark, path)) == [(1, "c", 5), (2, "a", 3)]


def test_a_run_without_commit_shows_nowhere_and_is_swept(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"chunks": ["repository_id"]})
    first = chunk_rows(spark, [(1, "a", 1)])
    store.replace("chunks", first, first)
    dead = store.write("chunks", chunk_rows(spark, [(1, "z", 7)]), first)
    assert kept(store.read("chunks")) == [(1, "a", 1)] and store.version() == 1
    assert store.sweep() == []  # it may still be at work
    assert store.sweep(grace_seconds=0) == [dead.name] and kept(store.read("chunks")) == [(1, "a", 1)]


def test_writers_at_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"chunks": ["repository_id"], "notes": ["repository_id"]})
    row = lambda *r: chunk_rows(spark, [r])
    one, two = store.write("chunks", row(1, "a", 1), row(1, "a", 1)), store.write("chunks", row(2, "b", 2), row(2, "b", 2))
    note = store.write("notes", row(5, "n", 1), row(5, "n", 1))
    assert store.commit(one) == 1 and store.commit(two, note) == 2
    assert kept(store.read("chunks")) == [(1, "a", 1), (2, "b", 2)] and kept(store.read("notes")) == [(5, "n", 1)]
    late = store.write("chunks", row(1, "late", 3), row(1, "late", 3))
    with pytest.raises(Conflict):
        store.commit(late, expected=1)
    assert not store._publish(2, {}) and store.version() == 2
    with pytest.raises(ValueError):
        store.commit(store.write("chunks", row(1, "a", 1).withColumn("id", F.lit("text")), row(1, "a", 1)))


def test_compaction_and_sweep(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"chunks": ["repository_id"]})
    for i in range(4):
        rows = chunk_rows(spark, [(r, f"f{i}", 10 * i + r) for r in range(i, 6)])
        store.replace("chunks", rows, rows)
    before = kept(store.read("chunks"))
    assert before == [(r, f"f{min(r, 3)}", 10 * min(r, 3) + r) for r in range(6)]
    assert store.compact("chunks") == 5 and kept(store.read("chunks")) == before and len(store.manifest()["chunks"]["runs"]) == 1
    rows = chunk_rows(spark, [(2, "last", 99)])
    store.replace("chunks", rows, rows)
    assert kept(store.keys_since("chunks", 5).withColumns({"file_path": F.lit(""), "id": F.lit(0)})) == [(2, "", 0)]
    assert len(store.sweep(keep=1, grace_seconds=0)) == 4 and [r[1] for r in kept(store.read("chunks"))].count("last") == 1
    assert store.version() == 6


def test_files_do_not_grow_with_repositories(spark, tmp_path):
    path = tmp_path / "chunks"
    many = spark.range(5000).select(F.col("id").alias("repository_id"), F.lit("f").alias("file_path"), "id")
    writers.replace_chunks(many, many, str(path))
    assert 1 <= len(list(path.glob("chunks/*/rows/*.parquet"))) <= 8 and writers.read_chunks(spark, str(path)).count() == 5000


def test_only_own_folders_are_deleted(spark, tmp_path):
    foreign = tmp_path / "lake" / "tables" / "mine"
    spark.range(3).write.parquet(str(foreign))
    source = spark.read.parquet(str(foreign))
    own = tables.materialize(source.where("id > 0"), done_with=[source])
    assert source.count() == 3 and own.count() == 2
    last = tables.materialize(own, done_with=[own])
    tables.forget(spark, [str(foreign), str(tmp_path)])
    assert source.count() == 3 and last.count() == 2 and not any(tables.folders(own) & tables.folders(last))
    with pytest.raises(Exception):
        own.count()


CHUNKS = "repository_id long, id long, file_path string, content string"


def code_rows(draw, n, repositories=3):
    """Chunks whose files each have words of their own, besides frequent ones."""
    rows = []
    for i in range(n):
        file = draw.randrange(60)
        words = draw.choices(["self", "return", "data", "value"], k=8) + draw.choices([f"topic{file}", f"topic{file}_part", f"only{file}"], k=draw.randint(0, 6))
        rows.append((draw.choice([0] * 6 + list(range(repositories))), i, f"src/f{file}.py", " ".join(words)))
    return rows + [(1, n, "empty.py", ""), (1, n + 1, "null.py", None), (2, n + 2, None, "self topic1")]


def plain(hits):
    return sorted((r["review_id"], r["seq"], r["chunk_id"], round(r["score"], 7)) for r in hits.collect())


def test_search_equals_full_scoring_and_skips_blocks(spark, tmp_path):
    draw = random.Random(2)
    chunks = spark.createDataFrame(code_rows(draw, 9000), CHUNKS).repartition(4)
    texts = ["topic7 only7", "self return topic12_part", "self data", "nothing of this", "only3 topic4 topic5", ""]
    queries = spark.createDataFrame([(r, s, r % 3, t) for r in range(4) for s, t in enumerate(texts)], "review_id long, seq long, repository_id long, text string")
    changed = spark.createDataFrame([(0, "src/f7.py"), (0, "src/f1.py"), (3, "src/f12.py"), (1, "no/such.py")], "review_id long, file_path string")
    index = LexicalIndex(spark, str(tmp_path / "index"))
    index.refresh(chunks)
    for gone in (None, changed):
        found = index.search(queries, 5, gone)
        assert plain(found.hits) == plain(retrieval.top_per_query(retrieval.bm25_scores(chunks, queries, gone), "score", 5, largest=True))
    # frequent words with one of a single file: the other files' blocks can't reach the floor
    work = {(r["review_id"], r["seq"]): r for r in found.work.collect()}
    assert 0 < work[0, 1]["scored"] < 0.2 * work[0, 1]["postings"]


def test_refreshes_equal_a_fresh_index(spark, tmp_path):
    draw = random.Random(3)
    rows = code_rows(draw, 3000)
    index = LexicalIndex(spark, str(tmp_path / "index"))
    index.refresh(spark.createDataFrame(rows, CHUNKS))
    kinds = lambda ix: (sorted(map(tuple, ix.postings().select("repository_id", "chunk_id", "term", "tf", "len").collect())), sorted(map(tuple, ix.statistics().collect())))
    states = [[(r, i, f, c + " extra" if c and i == 5 else c) for r, i, f, c in rows if i != 9]]  # one changed, one gone
    states.append([x for x in states[0] if x[0] != 1] + [(7, 90_000, "new.py", "brand new")])  # a repository gone, one new
    states.append(states[1] + [(2, 100_000 + i, f"grown/{i}.py", "grown self") for i in range(5000)])  # one outgrows its ranges
    for n, state in enumerate(states):
        every = spark.createDataFrame([(r,) for r in range(9)], "repository_id long")
        before = index.store.version()
        index.refresh(spark.createDataFrame(state, CHUNKS), every)
        fresh = LexicalIndex(spark, str(tmp_path / f"fresh{n}"))
        fresh.refresh(spark.createDataFrame(state, CHUNKS))
        assert kinds(index) == kinds(fresh)
        if n == 0:
            assert index.store.keys_since("postings", before).count() in (1, 2)  # the ranges that changed
    # a refresh of a repository leaves the others
    index.refresh(spark.createDataFrame([(0, 1, "a.py", "alone")], CHUNKS))
    assert {(r["repository_id"], r["n"]) for r in index.statistics().collect()} >= {(0, 1), (7, 1)}


def test_model_calls_survive_a_failing_task(spark, tmp_path):
    calls, broken = tmp_path / "calls", tmp_path / "broken"
    broken.write_text("")
    calls.mkdir()

    def load():
        def model(texts):
            if broken.exists() and "ask 37" in texts:
                raise RuntimeError("no answer")
            for x in texts:
                (calls / f"{x} {random.random()}").write_text("")
            return [x.upper() for x in texts]

        return model

    asked = spark.createDataFrame([(i, f"ask {i % 60}" if i % 10 else None) for i in range(200)], "id long, prompt string").repartition(3)
    store = prompts.reply_store(spark, str(tmp_path / "replies"))
    with pytest.raises(Exception, match="no answer"):
        prompts.resumed_model(asked, "id", store, load, batch=1, part=8)
    broken.unlink()
    got = {r["id"]: r["reply"] for r in prompts.resumed_model(asked, "id", store, load, batch=1, part=8).collect()}
    assert got == {i: f"ASK {i % 60}" if i % 10 else None for i in range(200)}
    times = [f.name.rsplit(" ", 1)[0] for f in calls.iterdir()]
    # each of 54 different prompts once, and those of the part that failed once more at most
    assert set(times) == {f"ask {i}" for i in range(60) if i % 10} and len(times) <= 54 + 24
    before = len(times)
    assert prompts.resumed_model(asked, "id", store, load).count() == 200 and len(list(calls.iterdir())) == before
