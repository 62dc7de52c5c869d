import io
import tarfile

from pyspark.sql import functions as F

from patchloom.operators import indexing
from patchloom.sources import raw, writers


def test_snapshots(spark, tmp_path):
    files = {"app/service.py": b"x = 1\n", "venv/lib.py": b"no", "a/build/x.py": b"no", "README.md": b"no", "bad.py": b"\xff\xed\xa0\x80ok", "big.py": b"#" * 500_001, "UP.PY": b"no"}
    for name, body in files.items():
        path = tmp_path / "snap" / "repo1" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    want = {"app/service.py": "x = 1\n", "bad.py": files["bad.py"].decode("utf-8", "replace")}
    got = raw.snapshot_files(spark, str(tmp_path / "snap")).collect()
    assert {r["path"]: r["source"] for r in got} == want and {r["repository"] for r in got} == {"repo1"}
    blob = io.BytesIO()
    with tarfile.open(fileobj=blob, mode="w:gz") as archive:
        for name, body in files.items():
            info = tarfile.TarInfo(f"owner-repo-sha/{name}")
            info.size = len(body)
            archive.addfile(info, io.BytesIO(body))
    packed = spark.createDataFrame([(7, bytearray(blob.getvalue()))], "repository_id long, content binary")
    assert {(r["repository_id"], r["path"], r["source"]) for r in raw.expand_archives(packed).collect()} == {(7, p, s) for p, s in want.items()}


def test_defaults_of_pull_requests_and_reports(spark):
    pulls = spark.createDataFrame([(1, '{"number": 3, "title": null, "state": "", "updated_at": "2024-01-02T03:04:05Z"}'), (1, '{"title": "no number"}'), (1, "{bad")], "repository_id long, json string")
    (row,) = raw.pr_summary(pulls).collect()
    assert (row["number"], row["title"], row["state"], row["head_sha"], row["author"], row["additions"], str(row["github_updated_at"])) == (3, "", "open", "", None, 0, "2024-01-02 03:04:05")
    reports = spark.createDataFrame([(1, '{"results": [{"start": {"line": 4}}, {"check_id": "r", "path": "a.py"}]}'), (2, "{bad"), (3, ""), (4, None), (5, '{"results": []}')], "review_id long, report string")
    assert [(r["review_id"], r["rule_id"], r["file_path"], r["start_line"], r["end_line"]) for r in raw.static_report(reports).orderBy("pos").collect()] == [(1, "unknown", "", 4, 4), (1, "r", "a.py", 0, 0)]
    replies = spark.createDataFrame([(1, '{"summary": "s", "findings": []}'), (2, '{"summary": "s", "findings": [{"file": "a"}]}'), (3, "{bad"), (4, None)], "review_id long, reply string")
    good, bad = raw.model_output(replies)
    assert good.count() == 0 and {r["review_id"] for r in bad.collect()} == {2, 3, 4}


def test_replaced_chunks(spark, tmp_path):
    schema = "repository_id long, file_path string, content string"
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "repository_id long")
    old = spark.createDataFrame([(1, "old.py", "x"), (2, "gone.py", "y"), (3, "kept.py", "z")], schema)
    writers.replace_chunks(old, ids(1, 2, 3), f"{tmp_path}/chunks")
    kept = {f: f.stat().st_mtime_ns for f in (tmp_path / "chunks").rglob("*.parquet")}
    for _ in range(2):  # a repeated run changes nothing
        writers.replace_chunks(spark.createDataFrame([(1, "new.py", "n"), (7, "not asked for.py", "n")], schema), ids(1, 2), f"{tmp_path}/chunks")
        assert {(r["repository_id"], r["file_path"]) for r in writers.read_chunks(spark, f"{tmp_path}/chunks").collect()} == {(1, "new.py"), (3, "kept.py")}
    assert kept and kept == {f: f.stat().st_mtime_ns for f in kept}  # no file of the old set is touched


def test_results_of_a_repeated_run(spark, tmp_path):
    for run, rows in (("r1", [(1,), (2,)]), ("r2", [(3,)]), ("r1", [(1,), (2,)])):
        writers.append_results(str(tmp_path), run, reviews=spark.createDataFrame(rows, "id long"))
    assert sorted((r["run"], r["id"]) for r in spark.read.parquet(f"{tmp_path}/reviews").collect()) == [("r1", 1), ("r1", 2), ("r2", 3)]


def test_finished_reviews(spark):
    reviews = spark.createDataFrame([(1, 10, "h1", "running", None, None, None), (2, 10, "h2", "queued", None, None, None)], "review_id long, pull_request_id long, head_sha string, status string, summary string, finding_count long, completed_at timestamp")
    findings = spark.createDataFrame([(1, True), (1, False)], "review_id long, surfaced boolean")
    finished = writers.finish_reviews(reviews, findings, spark.createDataFrame([(1, "fine")], "review_id long, summary string"), F.lit("2024-01-01").cast("timestamp"))
    assert {(r["review_id"], r["status"], r["summary"], r["finding_count"]) for r in finished.collect()} == {(1, "done", "fine", 1), (2, "queued", None, None)}
    pulls = spark.createDataFrame([(10, None), (11, "old")], "id long, last_reviewed_sha string")
    assert {tuple(r) for r in writers.mark_reviewed(pulls, finished).collect()} == {(10, "h1"), (11, "old")}


def test_embeddings(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, ""), (4, None)], "id long, content string")
    got = {r["id"]: r["embedding"] for r in indexing.embed(df).collect()}
    assert got[1] == got[2] and abs(sum(x * x for x in got[1]) - 1) < 1e-5 and len(got[3]) == indexing.DIMENSIONS and got[3] == got[4]
