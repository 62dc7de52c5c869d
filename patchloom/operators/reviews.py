"""Changed files of a review with their symbols, and the queries that retrieval starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import added_text, language_for, slice_lines, split_lines
from .diffs import parse_file_patches
from .retrieval import MAX_QUERIES, MAX_QUERY_CHARS
from .symbols import enclosing_symbols


def head_sources(files: DataFrame, contents: DataFrame) -> DataFrame:
    """The head text of Python files that weren't removed: files joined with contents (repository_id, path, sha, source)."""
    wanted = files.where((language_for(F.col("filename")) == "python") & (F.col("status") != "removed"))
    texts = contents.where("source is not null").select("repository_id", F.col("path").alias("filename"), F.col("sha").alias("head_sha"), "source")
    return wanted.join(texts, ["repository_id", "filename", "head_sha"])


def changed_file_rows(files: DataFrame, parsed: DataFrame, keys: tuple[str, ...] = ("review_id", "filename")) -> DataFrame:
    """Files with patch lines, language, counts, and the parsed source's symbols (null without a source).

    parsed: the keys, source and symbols, from parse_symbols. symbol_names are those of symbols that the change touches.
    """
    rows = parse_file_patches(files).join(parsed.select(*keys, "source", "symbols"), list(keys), "left")
    touched = F.when(F.col("source").isNotNull() & (F.size("added_ranges") > 0), enclosing_symbols(F.col("symbols"), F.col("added_ranges")))
    names = F.coalesce(F.transform(touched, lambda s: s["qualified_name"]), F.array().cast("array<string>"))
    return rows.withColumns({"language": language_for(F.col("filename")), "additions": F.size("added_lines"), "deletions": F.size("removed_lines"), "symbol_names": names})


def build_queries(changed: DataFrame) -> DataFrame:
    """review_id, seq and text: the first MAX_QUERIES pieces of changed code of each review, by file and symbol.

    A file with a source that isn't empty and added ranges gives the body of each symbol that they touch, and nothing if there is none;
    any other gives its added text. Pieces are cut first and blank ones dropped.
    """
    df = changed.withColumn("__lines", split_lines(F.col("source")))
    bodies = F.transform(enclosing_symbols(F.col("symbols"), F.col("added_ranges")), lambda s: slice_lines(F.col("__lines"), s["start_line"], s["end_line"]))
    pieces = F.when((F.col("source") != "") & (F.size("added_ranges") > 0), bodies).otherwise(F.array(added_text(F.col("patch"))))
    rows = df.select("review_id", "file_pos", F.posexplode(pieces).alias("piece", "text")).withColumn("text", F.substring("text", 1, MAX_QUERY_CHARS))
    order = W.partitionBy("review_id").orderBy("file_pos", "piece")
    return rows.where(~F.col("text").rlike(r"^\s*$")).withColumn("seq", F.row_number().over(order) - 1).where(F.col("seq") < MAX_QUERIES).select("review_id", "seq", "text")
