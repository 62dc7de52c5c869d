import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from patchloom.functions import findings as ff
from patchloom.functions import text as ft


# forms that name a repository, with made-up owners, and what may stand before and behind them
FORMS = ["{}", "https://github.com/{}", "http://github.com/{}", "git@github.com:{}"]
ENDS = ["", "/", ".git", ".git/", " ", "\n", "\t\n", "\x1f", " "]


def test_every_form_of_a_repository(spark):
    names = [("acme-tools", "patch.kit"), ("a_b", "x-1"), ("Q9", "_")]
    rows = [(space + form.format(f"{o}/{r}") + end, o, r) for form in FORMS for end in ENDS for o, r in names for space in ("", "\t ")]
    got = spark.createDataFrame(rows, "url string, o string, r string").select("url", "o", "r", ft.parse_repo_url(F.col("url")).alias("found")).collect()
    assert len(got) == len(rows) and all(x["found"] == (x["o"], x["r"], f"{x['o']}/{x['r']}") for x in got)


@pytest.mark.parametrize("url", [None, "", "  ", "word", "a/b/c", "https://gitlab.example/a/b", "https://github.com/", "https://github.com/a", "https://github.com/a/b/pull/3", "a b/c", "git@github.com/a/b", "/b", "a/", "ä/b"])
def test_what_is_no_repository(spark, url):
    assert spark.createDataFrame([(url,)], "url string").select(ft.parse_repo_url(F.col("url")).alias("r")).first()["r"] is None


TEXTS = ["", "a", "a\n", "a\n\nb", "a\r\nb\rc", "x\x0by\x0cz", "a\x1cb\x1dc\x1ed", "n\x85m o p\n", "\n", "snake_case HTTPServer2 __init__ ٤٢ café_au", "_ __ a__b 7up x_1_ é9", "foo(bar_baz, 0x1F)  # 3_000"]


def scanned(text):
    """Tokens by a walk over the characters: a run of digits, or a letter or underscore with all that may follow it."""
    letters, found, i = "abcdefghijklmnopqrstuvwxyz_ABCDEFGHIJKLMNOPQRSTUVWXYZ", [], 0
    while i < len(text):
        begin = i
        if text[i] in letters:
            while i < len(text) and (text[i] in letters or text[i] in "0123456789"):
                i += 1
        elif unicodedata.category(text[i]) == "Nd":
            while i < len(text) and unicodedata.category(text[i]) == "Nd":
                i += 1
        else:
            i += 1
            continue
        word = text[begin:i].lower()
        found += [word, *filter(None, word.split("_"))] if "_" in word else [word]
    return found


def test_lines_tokens_and_hashes_equal_direct_ones(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = {r["i"]: r for r in df.select("i", ft.split_lines(F.col("t")).alias("lines"), ft.tokenize_code(F.col("t")).alias("tokens"), ft.content_hash(F.col("t")).alias("h")).collect()}
    for i, text in enumerate(TEXTS):
        assert (got[i]["lines"], got[i]["tokens"], got[i]["h"]) == (text.splitlines(), scanned(text), hashlib.sha256(text.encode()).hexdigest())


def test_paths_and_symbols(spark):
    df = spark.createDataFrame([("lib/tests/a.py", "recheck_all"), ("pkg/case_test.py", "AUTHORIZED"), ("Testing/util.py", None), ("app/contest.py", "run"), ("test_top.py", "Sanitizer")], "p string, s string")
    assert [tuple(r) for r in df.select(ft.is_test_path(F.col("p")), ft.is_validation(F.col("s"))).collect()] == [(True, True), (True, True), (True, False), (False, False), (True, True)]


def test_excerpt_truncate_anchor_duration(spark):
    df = spark.sql("select 'a\nb\nc' as t, timestamp'2024-01-01 00:00:00' as a, timestamp'2024-01-01 00:03:04.600' as b")
    lines = ft.split_lines(F.col("t"))
    row = df.select(
        ft.excerpt(lines, F.lit(2), F.lit(2), 1).alias("e"), ft.excerpt(ft.split_lines(F.lit("")), F.lit(1), F.lit(1)).alias("none"), ft.truncate_text(F.lit("abcdef"), 3).alias("cut"),
        ft.line_anchor(F.lit("u"), F.lit("s"), F.lit("f"), F.lit(3), F.lit(3)).alias("one"), ft.line_anchor(F.lit("u"), F.lit("s"), F.lit("f"), F.lit(3), F.lit(5)).alias("two"),
        ft.review_duration(F.col("a"), F.col("b")).alias("d"), ft.review_duration(F.col("b"), F.col("a")).alias("back"), ft.review_duration(F.lit(None).cast("timestamp"), F.col("a")).alias("open"),
    ).first()
    assert tuple(row) == ("1: a\n2: b\n3: c", "", "abc\n... [truncated]", "u/blob/s/f#L3", "u/blob/s/f#L3-L5", "3m 5s", "0s", None)


def test_normalize_findings(spark):
    rows = [(5, 2, "bogus", "test_coverage", 1.7), (0, 3, " High ", "Security", float("nan")), (1, 1, None, None, -1.0)]
    got = ff.normalize_findings(spark.createDataFrame(rows, "start_line int, end_line int, severity string, category string, confidence double")).collect()
    assert [tuple(r) for r in got] == [(5, 5, "medium", "maintainability", 1.0), (1, 3, "high", "security", 0.0), (1, 1, "medium", "maintainability", 0.0)]


def test_surfacing(spark):
    df = spark.createDataFrame([("rejected", 0.99), ("verified", 0.9), ("verified", 0.1), ("uncertain", 0.99)], "v string, c double")
    assert [r[0] for r in df.select(ff.should_surface(F.col("v"), F.col("c"))).collect()] == [False, True, False, True]
