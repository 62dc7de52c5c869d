"""Column functions on source text, paths and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted repository references, line ends, test paths, names of checking code, white space, code tokens.
REPO_URL = r"^(?:https?://github\.com/|git@github\.com:)?([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?/?$"
LINE_ENDS = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
TEST_PATH = r"(?i)(^|/)(tests?|testing)(/|$)|(^|/)test_[^/]*\.py$|_test\.py$"
VALIDATION = r"(?iu)(valid|verif|check|ensure|assert|constraint|rule|permission|authori[sz]|guard|require|allow|forbid|limit|policy|invariant|sanitiz)"
OUTER_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
CODE_TOKEN = r"([A-Za-z_][A-Za-z0-9_]*|\p{Nd}+)"
TRUNCATED = "\n... [truncated]"


def parse_repo_url(url: Column) -> Column:
    """struct(owner, repo, full_name); null for anything that is no repository reference."""
    text = F.regexp_replace(url, OUTER_SPACE, "")
    owner, repo = F.regexp_extract(text, REPO_URL, 1), F.regexp_extract(text, REPO_URL, 2)
    return F.when(owner != "", F.struct(owner.alias("owner"), repo.alias("repo"), F.concat(owner, F.lit("/"), repo).alias("full_name")))


def language_for(path: Column) -> Column:
    """python for .py paths, else null."""
    return F.when(path.endswith(".py"), F.lit("python"))


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def is_validation(symbol: Column) -> Column:
    """Whether a symbol's name has one of the stems of checking code; false for null."""
    return F.coalesce(symbol.rlike(VALIDATION), F.lit(False))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def split_lines(text: Column) -> Column:
    """The lines of a text at any line end, without an empty one after the last; [] for ''."""
    parts = F.split(text, LINE_ENDS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def slice_lines(lines: Column, start: Column, end: Column) -> Column:
    """Lines start..end, counted from 1, joined by newlines; '' if there are none."""
    return F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(end - F.greatest(start, F.lit(1)) + 1, F.lit(0))), "\n")


def tokenize_code(text: Column) -> Column:
    """Identifiers and numbers in lower case; one with underscores is followed by its parts."""
    found = F.transform(F.regexp_extract_all(text, F.lit(CODE_TOKEN), 1), F.lower)
    parts = lambda t: F.when(t.contains("_"), F.concat(F.array(t), F.filter(F.split(t, "_"), lambda x: x != ""))).otherwise(F.array(t))
    return F.when(text.contains("_"), F.flatten(F.transform(found, parts))).otherwise(found)


def added_text(patch: Column) -> Column:
    """The patch's added lines without their plus, except those that begin +++."""
    added = F.filter(split_lines(patch), lambda x: x.startswith("+") & ~x.startswith("+++"))
    return F.array_join(F.transform(added, lambda x: F.substring(x, 2, 1 << 30)), "\n")


def truncate_text(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(TRUNCATED))).otherwise(text)


def excerpt(lines: Column, start: Column, end: Column, pad: int = 4) -> Column:
    """Numbered lines from pad before start to pad after end, within the file; '' for null lines.

    Lines that aren't a column yet are made once for the row here, and not once for each line that is shown.
    """
    low = F.greatest(F.lit(1), start - pad)
    shown = F.slice(lines, low, F.greatest(end + pad - low + 1, F.lit(0)))
    return F.coalesce(F.array_join(F.transform(shown, lambda x, i: F.concat((low + i).cast("string"), F.lit(": "), x)), "\n"), F.lit(""))


def line_anchor(repo_url: Column, sha: Column, path: Column, start: Column, end: Column) -> Column:
    """Link to a file's lines at a commit."""
    tail = F.when(start == end, F.concat(F.lit("#L"), start.cast("string"))).otherwise(F.concat(F.lit("#L"), start.cast("string"), F.lit("-L"), end.cast("string")))
    return F.concat(repo_url, F.lit("/blob/"), sha, F.lit("/"), path, tail)


def review_duration(started: Column, completed: Column) -> Column:
    """Whole seconds, halves up and never negative, as `42s` or `3m 5s`; null if either end is missing."""
    seconds = F.greatest(F.lit(0), F.floor((F.unix_millis(completed) - F.unix_millis(started)) / 1000 + 0.5))
    short = F.concat(seconds.cast("string"), F.lit("s"))
    long = F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s"))
    return F.when(started.isNotNull() & completed.isNotNull(), F.when(seconds < 60, short).otherwise(long))


def l2_normalize(vector: Column) -> Column:
    """The vector at unit length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))
