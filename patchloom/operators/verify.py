"""Checks of findings against diffs, sources, symbols and static-analysis hits, and the verdicts that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.findings import CORROBORATION_BONUS, REJECTED_AT_MOST, SEMANTIC_BELOW, SEMANTIC_CATEGORIES, clamp, should_surface
from .diffs import touches

# Fixed values.
REJECTED_REASON = "Failed deterministic checks (not attributable to this PR's diff)."
UNDECIDED_REASON = "Verifier error: no decision"


def attach_changed_files(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """file_matches and the file's added_ranges, n_lines and symbols, by (review_id, file).

    changed: one row a changed file of a review (review_id, filename, added_ranges, and n_lines and symbols if known).
    """
    files = changed
    for name, kind in (("n_lines", "int"), ("symbols", "array<struct<start_line:int,end_line:int>>")):
        if name not in files.columns:
            files = files.withColumn(name, F.lit(None).cast(kind))
    files = files.select("review_id", F.col("filename").alias("file"), "added_ranges", "n_lines", "symbols", F.lit(True).alias("file_matches"))
    return findings.join(files, ["review_id", "file"], "left").withColumn("file_matches", F.coalesce("file_matches", F.lit(False)))


def line_in_diff() -> Column:
    return touches(F.col("added_ranges"), F.col("start_line"), F.col("end_line"))


def lines_valid() -> Column:
    """null without a source; else whether 1 <= start <= end <= lines."""
    return F.when(F.col("n_lines").isNotNull(), (F.col("start_line") >= 1) & (F.col("start_line") <= F.col("end_line")) & (F.col("end_line") <= F.col("n_lines")))


def symbol_exists() -> Column:
    """null without symbols; else whether one overlaps the finding."""
    return F.when(F.size("symbols") > 0, F.exists("symbols", lambda s: (F.col("end_line") >= s["start_line"]) & (F.col("start_line") <= s["end_line"])))


def same_files(files: DataFrame, paths: DataFrame) -> DataFrame:
    """(review_id, file, path) of distinct (review_id, file) and (review_id, path) where one is a suffix of the other, as
    strings; the empty path is a suffix of all.

    Of the longer name those suffixes are looked up that are as long as some name of the other side, so the rows joined
    are names times different lengths and not all pairs of a review.
    """
    own, other = files.where("file is not null"), paths.where("path is not null")

    def within(longer: DataFrame, name: str, shorter: DataFrame, part: str, also_equal: bool) -> DataFrame:
        lengths = shorter.groupBy("review_id").agg(F.collect_set(F.length(part)).alias("__n"))
        fits = F.filter("__n", lambda n: n <= F.length(name) if also_equal else n < F.length(name))
        cut = longer.join(lengths, "review_id").select("review_id", name, F.explode(fits).alias("__n"))
        return cut.select("review_id", name, F.right(F.col(name), F.col("__n")).alias(part)).join(shorter, ["review_id", part])

    return within(own, "file", other, "path", True).unionByName(within(other, "path", own, "file", False))


def static_corroborates(findings: DataFrame, hits: DataFrame, key: str = "finding_id") -> DataFrame:
    """finding keys with a hit of the review on the same file that overlaps them.

    A span has such a hit if, among the hits that begin before its end, the furthest end is not before its start: one
    running maximum over the distinct spans of a file answers it, and no finding meets a hit. Hits without a path, which
    lie in all files, are a line of their own in each review, so that they aren't repeated for each file.
    """
    spans = findings.select("review_id", "file", F.col("start_line").alias("s"), F.col("end_line").alias("e")).where("file is not null").distinct()
    ends = hits.groupBy("review_id", F.col("file_path").alias("path"), F.col("start_line").alias("at")).agg(F.max("end_line").alias("end"))
    named, anywhere = ends.where("path <> ''"), ends.where("path = ''")
    pairs = same_files(spans.select("review_id", "file").distinct(), named.select("review_id", "path").distinct())
    none = F.lit(None).cast("int")
    on_file = named.join(pairs, ["review_id", "path"]).select("review_id", F.col("file").alias("line"), "at", "end", F.lit(None).cast("string").alias("file"), none.alias("s"))
    on_all = anywhere.select("review_id", F.lit(None).cast("string").alias("line"), "at", "end", F.lit(None).cast("string").alias("file"), none.alias("s"))
    asked = spans.withColumn("line", F.explode(F.array(F.col("file"), F.lit(None).cast("string")))).select("review_id", "line", F.col("e").alias("at"), none.alias("end"), "file", "s")
    # at one place hits come first: they begin at the span's last line at the latest
    order = W.partitionBy("review_id", "line").orderBy("at", F.col("s").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    furthest = F.max("end").over(order)
    found = on_file.unionByName(on_all).unionByName(asked).withColumn("furthest", furthest).where("s is not null and furthest >= s")
    found = found.select("review_id", "file", F.col("s").alias("start_line"), F.col("at").alias("end_line")).distinct()
    return findings.join(found, ["review_id", "file", "start_line", "end_line"], "left_semi").select(key)


def static_for_files(findings: DataFrame, hits: DataFrame, key: str = "finding_id") -> DataFrame:
    """Each finding's hits on the same file, wherever they are: names are matched first, so only results are joined."""
    left = findings.select(key, "review_id", "file")
    right = hits.select("review_id", "id", "rule_id", F.col("file_path").alias("path"), "start_line", "end_line", F.col("severity").alias("hit_severity"), "message")
    pairs = same_files(left.select("review_id", "file").distinct(), right.select("review_id", "path").distinct())
    return left.join(pairs, ["review_id", "file"]).join(right, ["review_id", "path"]).select(key, "file", *[c for c in right.columns if c != "review_id"])


def run_deterministic(findings: DataFrame, changed: DataFrame, hits: DataFrame, key: str = "finding_id") -> DataFrame:
    """findings with the five checks and passed_deterministic. A null check can't be made and doesn't disqualify."""
    attached = attach_changed_files(findings, changed)
    found = static_corroborates(findings, hits, key).withColumn("static_corroborates", F.lit(True))
    checked = attached.withColumns({"line_in_diff": line_in_diff(), "lines_valid": lines_valid(), "symbol_exists": symbol_exists()}).join(found, key, "left")
    true = F.lit(True)
    passed = F.col("file_matches") & F.col("line_in_diff") & F.coalesce("lines_valid", true) & F.coalesce("symbol_exists", true)
    return checked.withColumn("static_corroborates", F.coalesce("static_corroborates", F.lit(False))).withColumn("passed_deterministic", passed).drop("added_ranges", "n_lines", "symbols")


def verdicts(checked: DataFrame) -> DataFrame:
    """verdict, adjusted_confidence, escalated and reason; an escalated finding's verdict is null until it is decided."""
    base = F.when(F.col("static_corroborates"), clamp(F.col("confidence") + CORROBORATION_BONUS)).otherwise(F.col("confidence"))
    passed = F.col("passed_deterministic")
    escalated = passed & F.col("category").isin(SEMANTIC_CATEGORIES) & (base < SEMANTIC_BELOW)
    return checked.withColumns(
        {
            "escalated": escalated,
            "verdict": F.when(~passed, "rejected").when(~escalated, "verified"),
            "adjusted_confidence": F.when(~passed, F.least("confidence", F.lit(REJECTED_AT_MOST))).otherwise(base),
            "reason": F.when(~passed, REJECTED_REASON),
        }
    )


def apply_decisions(judged: DataFrame, decisions: DataFrame, key: str = "finding_id") -> DataFrame:
    """Escalated findings with their decision (is_real, reasoning, decided_confidence); without one they are uncertain."""
    left = judged.join(decisions.select(key, "is_real", "reasoning", F.col("adjusted_confidence").alias("decided")), key, "left")
    known = F.col("escalated") & F.col("is_real").isNotNull()
    final = F.when(~F.col("escalated"), F.col("verdict")).when(~known, "uncertain").when(F.col("is_real"), "verified").otherwise("rejected")
    adjusted = F.when(known, clamp(F.col("decided"))).otherwise(F.col("adjusted_confidence"))
    reason = F.when(~F.col("escalated"), F.col("reason")).when(~known, UNDECIDED_REASON).otherwise(F.col("reasoning"))
    return left.withColumns({"verdict": final, "adjusted_confidence": adjusted, "reason": reason}).drop("is_real", "reasoning", "decided")


def surface(judged: DataFrame) -> DataFrame:
    return judged.withColumn("surfaced", should_surface(F.col("verdict"), F.col("adjusted_confidence")))
