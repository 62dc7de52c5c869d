"""Python symbols and chunks. A small Arrow helper parses each file once; all else works on the array that it returns.

Parsing is the standard library's; a file with syntax errors keeps the definitions that a scanner of its lines finds round
them (recovery.py), and one without any is one chunk. Of two top-level classes of one name, the first one's functions are the class's; a second one is one chunk, however long.
"""

from __future__ import annotations

import ast
import io
import keyword
import tokenize
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, is_test_path, slice_lines, split_lines
from ..tables import append_columns
from .recovery import recovered_symbols, recovered_words

SYMBOLS = "array<struct<seq:int,name:string,kind:string,start_line:int,end_line:int,parent:string,qualified_name:string,top_level:boolean,member_of:string>>"
LARGE_CLASS_LINES = 80


def _symbols(source: str | None) -> list[dict] | None:
    """Functions and classes in source order, each with its innermost class; None for null."""
    if source is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return recovered_symbols(source)
    out: list[dict] = []
    classes: set[str] = set()
    open_ = [(child, None, True, None) for child in reversed(tree.body)]
    while open_:
        node, parent, top, owner = open_.pop()
        inner, members = parent, frozenset()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            is_class = isinstance(node, ast.ClassDef)
            kind = "class" if is_class else "method" if parent else "function"
            start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            out.append({"seq": len(out), "name": node.name, "kind": kind, "start_line": start, "end_line": node.end_lineno, "parent": parent, "qualified_name": f"{parent}.{node.name}" if parent else node.name, "top_level": top, "member_of": None if is_class else owner})
            if is_class:
                inner = node.name
                if top and node.name not in classes:
                    classes.add(node.name)
                    members = frozenset(map(id, node.body))
        open_ += [(child, inner, False, node.name if id(child) in members else None) for child in reversed(list(ast.iter_child_nodes(node)))]
    return out


def _identifiers(source: str | None) -> list[str]:
    found: dict[str, None] = {}
    try:
        for token in tokenize.generate_tokens(io.StringIO(source or "").readline):
            if token.type == tokenize.NAME and not keyword.iskeyword(token.string):
                found[token.string] = None
    except (tokenize.TokenError, SyntaxError, IndentationError):
        found |= dict.fromkeys(w for w in recovered_words(source or "") if not keyword.iskeyword(w))
    return list(found)


def parse_symbols(files: DataFrame, source: str = "source", identifiers: bool = False) -> DataFrame:
    """files with `symbols` (null if the source is null) and, if asked for, `identifiers`, which take another pass."""
    made = {"symbols": (SYMBOLS, _symbols)} | ({"identifiers": ("array<string>", _identifiers)} if identifiers else {})
    fields = ", ".join(f"{name} {kind}" for name, (kind, _) in made.items())
    return append_columns(files, source, fields, lambda sources: [[f(s) for s in sources] for _, f in made.values()])


def top_level_symbols(symbols: Column) -> Column:
    return F.filter(symbols, lambda s: s["top_level"])


def class_method_symbols(symbols: Column, class_name: Column) -> Column:
    """Functions in the body of the first top-level class of that name."""
    return F.filter(symbols, lambda s: s["member_of"] == class_name)


def defined_names(symbols: Column) -> Column:
    return F.array_distinct(F.transform(symbols, lambda s: s["name"]))


def enclosing_symbols(symbols: Column, ranges: Column) -> Column:
    """Symbols that overlap a range, in symbol order."""
    return F.filter(symbols, lambda s: F.exists(ranges, lambda r: (s["end_line"] >= r["start"]) & (s["start_line"] <= r["end"])))


def chunk_files(parsed: DataFrame, path: str = "file_path", source: str = "source") -> DataFrame:
    """Chunks of parsed files: module header, functions, classes; large classes as context and methods.

    A file without text gives none; one without symbols is one module chunk.
    """
    ints = lambda *x: [c.cast("int") for c in x]
    span = lambda kind, name, start, end: F.struct(kind.alias("chunk_type"), name.alias("symbol_name"), *[c.alias(n) for c, n in zip(ints(start, end), ("start_line", "end_line"), strict=True)])
    none, text = F.lit(None).cast("string"), lambda s: F.lit(s)
    df = parsed.withColumn("__lines", split_lines(F.coalesce(F.col(source), F.lit("")))).where(F.size("__lines") > 0)
    lines, tops = F.col("__lines"), F.coalesce(top_level_symbols(F.col("symbols")), F.expr(f"cast(array() as {SYMBOLS})"))
    blank = lambda start, end: slice_lines(lines, start, end).rlike(r"^\s*$")
    df = df.withColumn("__tops", tops)
    whole = span(text("module"), none, F.lit(1), F.size(lines))
    first = F.get("__tops", F.lit(0))["start_line"]
    header = F.when((F.size("__tops") > 0) & (first > 1) & ~blank(F.lit(1), first - 1), F.array(span(text("module"), none, F.lit(1), first - 1)))

    def spans_of(t: Column) -> Column:
        methods = F.when(t["kind"] == "class", F.filter("symbols", lambda s: (s["member_of"] == t["name"]) & (s["start_line"] >= t["start_line"]) & (s["end_line"] <= t["end_line"])))
        large = (t["kind"] == "class") & (t["end_line"] - t["start_line"] + 1 > LARGE_CLASS_LINES) & (F.size(methods) > 0)
        before = F.get(methods, F.lit(0))["start_line"] - 1
        context = F.when((before >= t["start_line"]) & ~blank(t["start_line"], before), F.array(span(text("class_context"), t["name"], t["start_line"], before)))
        parts = F.transform(methods, lambda m: span(text("method"), m["qualified_name"], m["start_line"], m["end_line"]))
        return F.when(large, F.concat(F.coalesce(context, F.slice(parts, F.lit(1), F.lit(0))), parts)).otherwise(F.array(span(t["kind"], t["name"], t["start_line"], t["end_line"])))

    body = F.flatten(F.transform("__tops", spans_of))
    every = F.when(F.size("__tops") > 0, F.concat(F.coalesce(header, F.slice(body, F.lit(1), F.lit(0))), body)).otherwise(F.array(whole))
    keep = [c for c in parsed.columns if c not in (source, "symbols", "identifiers")]
    out = df.withColumn("__spans", every).select(*keep, "__lines", F.posexplode("__spans").alias("seq", "s")).select(*keep, "__lines", "seq", "s.*")
    content = slice_lines(F.col("__lines"), F.col("start_line"), F.col("end_line"))
    out = out.withColumn("content", content).drop("__lines")
    return out.withColumn("content_hash", content_hash(F.col("content"))).withColumn("is_test", is_test_path(F.col(path)))
