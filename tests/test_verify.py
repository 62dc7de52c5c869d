import random
import time

from pyspark.sql import functions as F

from patchloom.operators import bookkeeping, verify

FINDING = "finding_id long, review_id long, file string, start_line int, end_line int, severity string, category string, confidence double"
CHANGED = "review_id long, filename string, added_ranges array<struct<start:int,end:int>>, n_lines int, symbols array<struct<start_line:int,end_line:int>>"
HITS = "review_id long, file_path string, start_line int, end_line int, rule_id string, severity string, message string"


def run(spark, findings, changed, hits=()):
    return verify.run_deterministic(spark.createDataFrame(findings, FINDING), spark.createDataFrame(changed, CHANGED), spark.createDataFrame(list(hits), HITS))


def test_checks(spark):
    changed = [(1, "a.py", [(10, 12)], 40, [(8, 20)]), (1, "b.py", [(1, 2)], None, None), (1, "c.py", [(1, 1)], 0, [])]
    findings = [
        (1, 1, "a.py", 11, 11, "high", "security", 0.7), (2, 1, "x.py", 11, 11, "high", "security", 0.7), (3, 1, "a.py", 99, 99, "high", "security", 0.7),
        (4, 1, "b.py", 1, 1, "high", "maintainability", 0.7), (5, 1, "c.py", 1, 1, "high", "security", 0.7),
    ]
    got = {r["finding_id"]: r for r in run(spark, findings, changed, [(1, "src/a.py", 11, 12, "r", None, "m"), (1, "", 1, 1, "r", None, "m")]).collect()}
    facts = {k: (r["file_matches"], r["line_in_diff"], r["lines_valid"], r["symbol_exists"], r["static_corroborates"], r["passed_deterministic"]) for k, r in got.items()}
    assert facts == {
        1: (True, True, True, True, True, True), 2: (False, False, None, None, False, False), 3: (True, False, False, False, False, False),
        4: (True, True, None, None, True, True), 5: (True, True, False, None, True, False),
    }


def test_verdicts_and_decisions(spark):
    changed = [(1, "a.py", [(1, 99)], None, None)]
    findings = [(1, 1, "zz.py", 1, 1, "high", "security", 0.9), (2, 1, "a.py", 1, 1, "high", "maintainability", 0.6), (3, 1, "a.py", 2, 2, "low", "security", 0.6), (4, 1, "a.py", 3, 3, "low", "security", 0.95), (5, 1, "a.py", 4, 4, "low", "security", 0.5), (6, 1, "a.py", 50, 50, "low", "security", 0.8)]
    judged = verify.verdicts(run(spark, findings, changed, [(1, "a.py", 50, 50, "r", None, "m")]))
    decisions = spark.createDataFrame([(3, True, "yes", 1.4), (1, True, "ignored", 1.0)], "finding_id long, is_real boolean, reasoning string, adjusted_confidence double")
    final = verify.surface(verify.apply_decisions(judged, decisions))
    got = {r["finding_id"]: (r["escalated"], r["verdict"], round(r["adjusted_confidence"], 6), r["surfaced"]) for r in final.collect()}
    assert got == {1: (False, "rejected", 0.2, False), 2: (False, "verified", 0.6, True), 3: (True, "verified", 1.0, True), 4: (False, "verified", 0.95, True), 5: (True, "uncertain", 0.5, False), 6: (False, "verified", 0.9, True)}
    order = [r["finding_id"] for r in bookkeeping.rank_findings(final).orderBy("place").collect()]
    assert order == [2, 3, 4, 6]
    counts = {(r["severity"], r["n"]) for r in bookkeeping.severity_counts(final).collect()}
    assert counts == {("high", 1), ("low", 3)}


def test_refresh_and_guard(spark):
    schema = "repository_id long, number long, title string, state string, head_sha string, github_updated_at timestamp, last_reviewed_sha string"
    stored = spark.createDataFrame([(1, 1, "old", "open", "a", None, "a"), (1, 2, "old", "open", "b", None, None), (2, 1, "old", "open", "c", None, "c")], schema)
    live = spark.createDataFrame([(1, 1, "new", "open", "z", None), (1, 3, "new", "open", "y", None)], "repository_id long, number long, title string, state string, head_sha string, github_updated_at timestamp")
    one, both = (spark.createDataFrame([(i,) for i in x], "repository_id long") for x in ((1,), (1, 2)))
    got = {(r["repository_id"], r["number"]): (r["title"], r["state"], r["head_sha"], r["last_reviewed_sha"]) for r in bookkeeping.refresh_pulls(stored, live, one).collect()}
    assert got == {(1, 1): ("new", "open", "z", "a"), (1, 2): ("old", "closed", "b", None), (1, 3): ("new", "open", "y", None), (2, 1): ("old", "open", "c", "c")}
    assert [tuple(r) for r in bookkeeping.vanished_pulls(stored, live, one).collect()] == [(1, 2)]
    # a repository that was refreshed and has nothing live
    closed = {(r["repository_id"], r["number"]) for r in bookkeeping.refresh_pulls(stored, live, both).where("state = 'closed'").collect()}
    assert closed == {(1, 2), (2, 1)} == {tuple(r) for r in bookkeeping.vanished_pulls(stored, live, both).collect()}
    asked = spark.createDataFrame([("", "x", True), ("a", "a", False), ("a", "a", True), ("a", None, None), (None, None, True)], "head_sha string, last_reviewed_sha string, force boolean")
    assert [r["accepted"] for r in bookkeeping.guard_reviews(asked).collect()] == [False, False, True, True, False]


def test_the_last_request_of_a_pull_counts(spark):
    schema = "repository_id long, number long, title string, state string, html_url string, head_sha string, description string"
    stored = spark.createDataFrame([(1, 1, "old", "open", "u", "a", "d"), (1, 2, "old", "open", "u", "b", "d")], schema)
    rows = [(1, 1, "first", "open", None, "c", "x", 1, True), (1, 1, "last", "open", "", "d", "y", 2, True), (1, 1, "refused", "open", None, "e", "z", 3, False), (1, 9, "new", "open", "w", "f", None, 4, True)]
    asked = spark.createDataFrame(rows, schema + ", request_id long, accepted boolean")
    repositories = spark.createDataFrame([(1, "https://h/o/r")], "id long, url string")
    got = {r["number"]: (r["title"], r["html_url"], r["head_sha"], r["description"]) for r in bookkeeping.trigger_upsert(stored, asked, repositories).collect()}
    assert got == {1: ("last", "https://h/o/r/pull/1", "d", "y"), 2: ("old", "u", "b", "d"), 9: ("new", "w", "f", None)}


def test_same_files_and_overlaps_equal_all_pairs(spark):
    draw = random.Random(4)
    names = ["", "a.py", "b/a.py", "/a.py", "xa.py", "c/b/a.py", "é.py", "dé.py", "a.p", None]
    spans = lambda: sorted(draw.choices(range(1, 40), k=2), reverse=draw.random() < 0.1)
    findings = [(i, draw.choice([1, 1, 2, 3, None]), draw.choice(names), *spans(), "high", "security", 0.5) for i in range(300)]
    hits = [(draw.choice([1, 2, 2, 4, None]), draw.choice(names), *spans(), "r", None, "m") for _ in range(60)]
    same = lambda a, b: a is not None and b is not None and (a.endswith(b) or b.endswith(a))
    near = [(f, h) for f in findings for h in hits if f[1] is not None and f[1] == h[0] and same(f[2], h[1])]
    table, found = spark.createDataFrame(findings, FINDING), spark.createDataFrame(hits, HITS).withColumn("id", F.monotonically_increasing_id())
    assert sorted(r["finding_id"] for r in verify.static_corroborates(table, found).collect()) == sorted({f[0] for f, h in near if h[3] >= f[3] and h[2] <= f[4]})
    assert sorted((r["finding_id"], r["path"], r["start_line"], r["end_line"]) for r in verify.static_for_files(table, found).collect()) == sorted((f[0], h[1], h[2], h[3]) for f, h in near)


def test_a_review_with_very_many_findings_and_hits(spark):
    n = 100_000
    lines = ((F.col("id") * 7919) % 50_000).cast("int")
    common = dict(review_id=F.lit(1).cast("long"), start_line=lines, end_line=lines + 1)
    findings = spark.range(n).withColumns(common | {"finding_id": F.col("id"), "file": F.concat(F.lit("src/m"), (F.col("id") % 300).cast("string"), F.lit(".py"))})
    hits = spark.range(n).withColumns(common | {"file_path": F.concat(F.lit("m"), (F.col("id") % 300 + 150).cast("string"), F.lit(".py")), "start_line": lines + 2, "end_line": lines + 2})
    began = time.time()
    got = verify.static_corroborates(findings, hits).count()
    took = time.time() - began
    near = findings.select("file", "start_line").distinct().collect()
    there = {(r["file_path"], r["start_line"]) for r in hits.collect()}
    few = {(f.removeprefix("src/"), s) for f, s in near}
    want = {(f, s) for f, s in few if (f, s) in there or (f, s + 1) in there}
    per = findings.groupBy("file", "start_line").count().collect()
    assert got == sum(r["count"] for r in per if (r["file"].removeprefix("src/"), r["start_line"]) in want) and took < 60


def test_pulls_of_other_repositories_are_not_shuffled(spark, tmp_path):
    schema = "repository_id long, number long, state string, head_sha string"
    rows = [(r, n, "open", f"s{n}") for r in range(50) for n in range(20)] + [(None, 1, "open", "x")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/stored")
    stored = spark.read.parquet(f"{tmp_path}/stored")
    live = spark.createDataFrame([(3, 1, "open", "new"), (4, 99, "open", "first")], schema)
    merged = bookkeeping.refresh_pulls(stored, live, spark.createDataFrame([(3,)], "repository_id long"))
    assert merged.count() == len(rows) + 1 and merged.where("state = 'closed'").count() == 19
    untouched = merged._jdf.queryExecution().optimizedPlan().toString().split("Union")[1].count("Join LeftAnti")
    assert untouched == 1 and {r["head_sha"] for r in merged.where("repository_id = 4 and number in (1, 99)").collect()} == {"s1", "first"}
    plan = stored.join(F.broadcast(live.select("repository_id")), "repository_id", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
