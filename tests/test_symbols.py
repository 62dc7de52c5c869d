import os
import random
import sysconfig

from pyspark.sql import functions as F

from patchloom.operators import recovery, symbols

SAMPLE = '''import os


def top(a):
    return a


@deco
class Thing:
    @prop
    def one(self):
        def inner():
            pass
        return inner

    async def two(self):
        return os.path

    class Inner:
        def three(self):
            pass


if True:
    def conditional():
        pass
'''
#: A few lines more than fit in a chunk of its own: three functions with long bodies.
LARGE = "@register\nclass Wide(Base):\n    'Doc.'\n\n" + "".join(f"    def part{i}(self, x):\n" + "        x += 1\n" * 24 + "        return x\n\n" for i in range(3))


def parsed(spark, *sources):
    return symbols.parse_symbols(spark.createDataFrame([(f"pkg/f{i}.py", s) for i, s in enumerate(sources)], "file_path string, source string"), identifiers=True)


def test_symbols(spark):
    row = parsed(spark, SAMPLE).first()
    got = [(s["qualified_name"], s["kind"], s["start_line"], s["end_line"], s["top_level"]) for s in row["symbols"]]
    assert got == [
        ("top", "function", 4, 5, True), ("Thing", "class", 8, 21, True), ("Thing.one", "method", 10, 14, False), ("Thing.inner", "method", 12, 13, False),
        ("Thing.two", "method", 16, 17, False), ("Thing.Inner", "class", 19, 21, False), ("Inner.three", "method", 20, 21, False), ("conditional", "function", 25, 26, False),
    ]
    assert {"os", "top", "a", "deco", "Thing", "prop", "path"} <= set(row["identifiers"])
    df = parsed(spark, SAMPLE)
    ranges = F.array(F.struct(F.lit(17).alias("start"), F.lit(17).alias("end")))
    names = lambda c: F.transform(c, lambda s: s["name"])
    r = df.select(names(symbols.enclosing_symbols(F.col("symbols"), ranges)), names(symbols.class_method_symbols(F.col("symbols"), F.lit("Thing"))), names(symbols.top_level_symbols(F.col("symbols"))), symbols.defined_names(F.col("symbols"))).first()
    assert r[0] == ["Thing", "two"] and r[1] == ["one", "two"] and r[2] == ["top", "Thing"] and len(r[3]) == 8


def test_chunks(spark):
    df = symbols.chunk_files(parsed(spark, SAMPLE, LARGE, "", "x = (1\ny = 2\n", "x = 1\ny = 2\n", None, "@d\ndef f():\n    pass\n"))
    got = {}
    for r in df.orderBy("file_path", "seq").collect():
        got.setdefault(r["file_path"], []).append((r["chunk_type"], r["symbol_name"], r["start_line"], r["end_line"]))
        assert len(r["content_hash"]) == 64
    assert got["pkg/f0.py"] == [("module", None, 1, 3), ("function", "top", 4, 5), ("class", "Thing", 8, 21)]
    assert got["pkg/f1.py"] == [("class_context", "Wide", 1, 4), ("method", "Wide.part0", 5, 30), ("method", "Wide.part1", 32, 57), ("method", "Wide.part2", 59, 84)]
    assert got["pkg/f3.py"] == [("module", None, 1, 2)] and got["pkg/f4.py"] == [("module", None, 1, 2)] and got["pkg/f6.py"] == [("function", "f", 1, 3)]
    assert "pkg/f2.py" not in got and "pkg/f5.py" not in got


MODERN = '''f = lambda x: x
y = 1 if f else 2
z = sorted([3, 1], key=lambda t: (t, [u for u in range(t)]))
match y:
    case 1:
        def in_case():
            return lambda: (yield)
class A(metaclass=type("M", (type,), {})):
    g = lambda self: self
    class B:
        def b(self): return 1 if self else 2
    def a(self):
        try:
            def c(): pass
        finally:
            pass
class A:
    def second(self): pass
'''


def test_expressions_have_bodies_too(spark):
    row = parsed(spark, MODERN).first()
    assert [(s["qualified_name"], s["kind"], s["member_of"]) for s in row["symbols"]] == [
        ("in_case", "function", None), ("A", "class", None), ("A.B", "class", None), ("B.b", "method", None), ("A.a", "method", "A"), ("A.c", "method", None), ("A", "class", None), ("A.second", "method", None),
    ]


BROKEN = """import os

def kept(a, b=(1, 2)):
    print "old", a
    return f"{a!r:>{b}} {'(' + "x"}"

@deco(
    1)
class C:
    def open_(self, x:
        if x:
            return [x
    async def after(self):
        s = '''never
        def inside(): pass

        return s)

    x = 1 +
def last(): return "unterminated
y = 3 $ 4
class D(Base): pass
"""


def test_files_that_do_not_parse(spark):
    row = parsed(spark, BROKEN).first()
    got = [(s["qualified_name"], s["kind"], s["start_line"], s["end_line"], s["top_level"], s["member_of"]) for s in row["symbols"]]
    assert got == [
        ("kept", "function", 3, 5, True, None), ("C", "class", 7, 19, True, None), ("C.open_", "method", 10, 12, False, "C"), ("C.after", "method", 13, 17, False, "C"),
        ("C.inside", "method", 15, 15, False, None), ("last", "function", 20, 20, True, None), ("D", "class", 22, 22, True, None),
    ]
    assert {"os", "kept", "print", "deco", "after", "inside", "Base", "y"} <= set(row["identifiers"]) and not {"def", "unterminated"} & set(row["identifiers"])
    chunks = [(r["chunk_type"], r["symbol_name"], r["start_line"], r["end_line"]) for r in symbols.chunk_files(parsed(spark, BROKEN)).orderBy("seq").collect()]
    assert chunks == [("module", None, 1, 2), ("function", "kept", 3, 5), ("class", "C", 7, 19), ("function", "last", 20, 20), ("class", "D", 22, 22)]


def test_recovery_takes_no_time_with_the_square():
    assert len(recovery.recovered_symbols("def f(:\n    x = [1, (2\n" * 3000)) == 3000
    assert recovery.recovered_symbols("((((((\n" * 50_000) == [] and recovery.recovered_symbols("") == []


def standard_library():
    folder = sysconfig.get_paths()["stdlib"]
    for name in sorted(n for n in os.listdir(folder) if n.endswith(".py")):
        with open(f"{folder}/{name}", encoding="utf-8", errors="replace") as f:
            yield name, f.read()


def test_the_scanner_equals_the_parser_and_keeps_the_rest_of_broken_files():
    draw = random.Random(1)
    for name, source in standard_library():
        want = symbols._symbols(source)
        assert recovery.recovered_symbols(source) == want, name
        tops = [s for s in want if s["top_level"]]
        if tops:
            at = draw.choice(tops)["end_line"]  # a line that no parser takes, behind a definition
            lines = source.split("\n")
            broken = "\n".join([*lines[:at], draw.choice(["print 'x', y)", "x = = 'it", "if ("]), *lines[at:]])
            moved = [s | {k: s[k] + (s[k] > at) for k in ("start_line", "end_line")} for s in want]
            assert symbols._symbols(broken) == moved, name


def test_the_standard_library(spark):
    sources = list(standard_library())
    rows = spark.createDataFrame(sources, "file_path string, source string").repartition(8)
    found = symbols.parse_symbols(rows)
    assert len(sources) > 100 and found.where("symbols is null").count() == 0
    chunks = symbols.chunk_files(found).selectExpr("file_path", "chunk_type", "start_line", "end_line", "length(content) as n").collect()
    assert {r["file_path"] for r in chunks} == {n for n, s in sources if s} and all(r["n"] > 0 and r["start_line"] <= r["end_line"] for r in chunks)
