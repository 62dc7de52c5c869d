from pyspark.sql import functions as F

from patchloom.operators import diffs


def test_ranges(spark):
    lines = {"all apart": [40, 12, 91], "one run": [6, 5, 7, 8], "two of a pair": [101, 100, 100], "mixed": [3, 30, 31, 4, 33, 300]}
    rows = [(k, n) for k, ns in lines.items() for n in ns]
    want = {"all apart": [(12, 12), (40, 40), (91, 91)], "one run": [(5, 8)], "two of a pair": [(100, 101)], "mixed": [(3, 4), (30, 31), (33, 33), (300, 300)]}
    got = diffs.ranges_from_lines(spark.createDataFrame(rows, "key string, line int"), ["key"]).collect()
    assert sorted(tuple(r) for r in got) == sorted((k, *span) for k, spans in want.items() for span in spans)
    one = diffs.changed_ranges(spark.createDataFrame([*rows, ("nulls", None)], "key string, line int"), ["key"])
    assert {r["key"]: [tuple(x) for x in r["added_ranges"]] for r in one.collect()} == want


def test_patches(spark):
    patches = [
        ("two hunks", "@@ -20,2 +31,4 @@ class K:\n-gone\n-gone too\n+a\n+b\n  kept\n+c\n@@ -70,1 +80,0 @@\n-last"),
        ("only removed", "@@ -7,3 +6,1 @@\n ctx\n-x\n-y\n"),
        ("no lengths", "@@ -9 +9 @@\n-p\n+q\n\\ No newline at end of file\n"),
        ("empty context", "@@ -2,3 +2,4 @@\n\n+x\n\n\n+y"),
        ("null", None),
        ("text", "@ no hunk\n+x"),
    ]
    files = spark.createDataFrame(patches, "filename string, patch string")
    got = {r["filename"]: (r["added_lines"], r["removed_lines"], [tuple(x) for x in r["added_ranges"]]) for r in diffs.parse_file_patches(files).collect()}
    assert got == {
        "two hunks": ([31, 32, 34], [20, 21, 70], [(31, 32), (34, 34)]), "only removed": ([], [8, 9], []), "no lengths": ([9], [9], [(9, 9)]),
        "empty context": ([3, 6], [], [(3, 3), (6, 6)]), "null": ([], [], []), "text": ([], [], []),
    }
    ranges = F.col("added_ranges")
    two = diffs.parse_file_patches(files.where("filename = 'two hunks'"), keep=["filename"])
    assert two.columns == ["filename", "added_lines", "removed_lines", "added_ranges"]
    spans = {(1, 30): False, (33, 33): False, (33, 90): True, (1, 500): True, (32, 33): True, (35, 36): False}
    assert list(two.select(*[diffs.touches(ranges, F.lit(a), F.lit(b)) for a, b in spans]).first()) == list(spans.values())
    assert list(two.select(*[diffs.contains_line(ranges, F.lit(n)) for n in (31, 33, 34)]).first()) == [True, False, True]


def test_whole_diff(spark):
    plain = "--- a/lib/k.py\t2020-01-01\n+++ b/lib/k.py\t2020-01-02\n@@ -40 +41,2 @@\n-z\n+z1\n+z2\n--- a/docs/k.md\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-one\n-two\n"
    git = "diff --git a/from.py b/to.py\nsimilarity index 91%\nrename from from.py\nrename to to.py\n--- a/from.py\n+++ b/to.py\n@@ -15 +15 @@\n--- reads as a header\n+k\ndiff --git a/fresh.py b/fresh.py\nnew file mode 100644\n--- /dev/null\n+++ b/fresh.py\n@@ -0,0 +1,2 @@\n+k\n+l\n"
    got = diffs.parse_unified_diffs(spark.createDataFrame([(1, plain), (2, git), (3, None), (4, "no diff")], "id int, diff string"), ["id"]).collect()
    assert sorted((r["id"], r["path"], r["status"], r["added_lines"], r["removed_lines"]) for r in got) == [
        (1, "docs/k.md", "removed", [], [1, 2]), (1, "lib/k.py", "modified", [41, 42], [40]), (2, "fresh.py", "added", [1, 2], []), (2, "to.py", "renamed", [15], [15]),
    ]
    assert {tuple(map(tuple, r["added_ranges"])) for r in got} == {(), ((41, 42),), ((1, 2),), ((15, 15),)}


def test_quoted_names(spark):
    cases = {
        'diff --git "a/tab\\there.py" "b/tab\\there.py"\n--- "a/tab\\there.py"\n+++ "b/tab\\there.py"\n@@ -1 +1 @@\n-x\n+y\n': ("tab\there.py", "modified"),
        'diff --git "a/caf\\303\\251.py" b/plain.py\nsimilarity index 100%\nrename from "caf\\303\\251.py"\nrename to plain.py\n': ("plain.py", "renamed"),
        'diff --git a/plain.py "b/say \\"hi\\".py"\nsimilarity index 100%\nrename from plain.py\nrename to "say \\"hi\\".py"\n': ('say "hi".py', "renamed"),
        'diff --git "a/back\\\\slash" "b/back\\\\slash"\nnew file mode 100644\nindex 0..0\n--- /dev/null\n+++ "b/back\\\\slash"\n@@ -0,0 +1 @@\n+y\n': ("back\\slash", "added"),
        'diff --git "a/new\\nline" "b/new\\nline"\ndeleted file mode 100644\n--- "a/new\\nline"\n+++ /dev/null\n@@ -1 +0,0 @@\n-y\n': ("new\nline", "removed"),
        "diff --git a/x b/y z b/x b/y z\nold mode 100644\nnew mode 100755\n": ("x b/y z", "modified"),
        "diff --git a/p b/q b/r\nsimilarity index 100%\nrename from p\nrename to q b/r\n": ("q b/r", "renamed"),
    }
    table = spark.createDataFrame(list(enumerate(cases)), "id int, diff string")
    got = {r["id"]: (r["path"], r["status"]) for r in diffs.parse_unified_diffs(table, ["id"]).collect()}
    assert list(map(got.get, range(len(cases)))) == list(cases.values())


def test_rows_that_share_a_key_or_have_none(spark):
    rows = [(1, "@@ -1 +1,2 @@\n a\n+b"), (1, "@@ -5 +9,3 @@\n a\n+b\n+c"), (None, "@@ -1 +4 @@\n+x"), (None, None)]
    files = spark.createDataFrame(rows, "id int, patch string").repartition(2)
    assert sorted((r["id"] or 0, r["added_lines"]) for r in diffs.parse_file_patches(files).collect()) == [(0, []), (0, [4]), (1, [2]), (1, [10, 11])]
    assert sorted((r["id"] or 0, r["side"], r["line"]) for r in diffs.patch_line_numbers(files, ["id"]).collect()) == [(0, "added", 4), (1, "added", 2), (1, "added", 10), (1, "added", 11)]


def test_lines_that_look_like_headers(spark):
    git = "diff --git a/q.sql b/q.sql\n--- a/q.sql\n+++ b/q.sql\n@@ -1,3 +1,3 @@\n a\n--- old note\n+++ counter;\n b\n"
    plain = "--- a/q.sql\n+++ b/q.sql\n@@ -1,3 +1,3 @@\n a\n--- old note\n+++ counter;\n b\n--- a/r.sql\n+++ b/r.sql\n@@ -1 +1,2 @@\n a\n+++ c\n"
    short = "--- a/s.py\n+++ b/s.py\n@@ -1,9 +1,1 @@\n+a\n--- a/t.py\t2024\n+++ b/t.py\t2024\n@@ -3 +3 @@\n-a\n+b\n"
    twice = "diff --git a/u.py b/u.py\n--- a/u.py\n+++ b/u.py\n@@ -1 +1 @@\n+a\ndiff --git a/u.py b/u.py\n--- a/u.py\n+++ b/u.py\n@@ -7 +7 @@\n+a\n"
    moved = "diff --git a/old b.txt b/new b.txt\nsimilarity index 100%\nrename from old b.txt\nrename to new b.txt\n"
    diffs_ = spark.createDataFrame(list(enumerate([git, plain, short, twice, moved])), "id int, diff string")
    got = sorted((r["id"], r["path"], r["status"], r["added_lines"], r["removed_lines"]) for r in diffs.parse_unified_diffs(diffs_, ["id"]).collect())
    assert got == [
        (0, "q.sql", "modified", [2], [2]), (1, "q.sql", "modified", [2], [2]), (1, "r.sql", "modified", [2], []), (2, "s.py", "modified", [1], []), (2, "t.py", "modified", [3], [3]),
        (3, "u.py", "modified", [7], []), (4, "new b.txt", "renamed", [], []),
    ]
