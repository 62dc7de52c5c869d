"""Symbols of Python files that don't parse: a scanner of logical lines, strings, brackets and indentation.

A definition's body is the lines below it that are indented more; its end is the last line of the last of these. What
can't be right is passed over, so that the rest of the file keeps its definitions: a string that doesn't end stops at
its line's end (a long one at its opening quotes); a logical line whose brackets don't close is cut after its first
physical line, or, if it begins a definition, after the first that ends with a colon; an extra bracket is nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

TOKEN = re.compile(r"""(?P<comment>\#[^\n]*)|(?P<prefix>\w*)(?P<quote>\"\"\"|'''|"|')|(?P<word>\w+)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<joined>\\\r?\n)|(?P<line>\n)|(?P<other>[^\w\#'"()\[\]{}\\\n]+|\\)""")
HEADER = re.compile(r"(?:(?:async\s+)?(?P<def>def)|class)\s+(?P<name>[^\W\d]\w*)\s*[(\[:]")
BEGINS = re.compile(r"[ \t\f]*(?:(?:async\s+)?def\s+\w+\s*[(\[]|class\s+\w+\s*[(\[:]|@\w[\w.]*\s*(?:\(|$))", re.MULTILINE)
#: Physical lines after which open brackets count as never closed, so that no file takes time with its square.
MOST_LINES = 1000
STRING_PREFIXES = {"", "r", "u", "b", "f", "br", "rb", "fr", "rf", "t", "tr", "rt"}


@dataclass
class Logical:
    """A logical line: indentation, first and last physical line, its code without strings and comments, and its words."""

    indent: int
    first: int
    last: int
    code: str
    words: list[str]


def _indent(text: str) -> int:
    width = 0
    for c in text:
        if c == " ":
            width += 1
        elif c == "\t":
            width = width // 8 * 8 + 8
        elif c == "\f":
            width = 0
        else:
            break
    return width


def _interpolated(s: str, i: int, quote: str, words: list[str]) -> int:
    """The end of an f-string whose text begins at i; -1 if it has none."""
    while i < len(s):
        if s.startswith(quote, i):
            return i + len(quote)
        c = s[i]
        if c == "\n" and len(quote) == 1:
            return -1
        if c == "\\":
            i += 1 if s[i + 1 : i + 2] in ("{", "}") else 2
        elif c == "{" and s[i + 1 : i + 2] != "{":
            i = _field(s, i + 1, quote, words)
            if i < 0:
                return -1
        else:
            i += 2 if c == "{" else 1
    return -1


def _field(s: str, i: int, quote: str, words: list[str]) -> int:
    """The end of a replacement field, after its brace."""
    depth = 0
    while i < len(s) and (t := TOKEN.match(s, i)):
        i = t.end()
        if t["open"]:
            depth += 1
        elif t["close"]:
            if depth == 0:
                return i if t["close"] == "}" else -1
            depth -= 1
        elif t["quote"]:
            if depth == 0 and t["quote"] == quote and not t["prefix"] and _rest_is_text(s, i):
                return -1
            i = _string(s, t, words)
            if i < 0:
                return -1
        elif t["word"]:
            words.append(t["word"])
        elif t["other"] and depth == 0 and ":" in t["other"]:
            return _format(s, t.start() + t["other"].index(":") + 1, quote, words)
    return -1


def _rest_is_text(s: str, i: int) -> bool:
    """Whether a quote inside of a field is rather the string's end: no other quote follows in the line."""
    end = s.find("\n", i)
    return not any(q in s[i : end if end >= 0 else len(s)] for q in "'\"")


def _format(s: str, i: int, quote: str, words: list[str]) -> int:
    while i < len(s):
        if s[i] == "}":
            return i + 1
        if s[i] == "{":
            i = _field(s, i + 1, quote, words)
            if i < 0:
                return -1
        elif s.startswith(quote, i) or (s[i] == "\n" and len(quote) == 1):
            return -1
        else:
            i += 1
    return -1


_ENDS = {q: re.compile(rf"(?:[^\\{q[0]}{'' if len(q) > 1 else chr(92) + 'n'}]|\\.|{q[0]}(?!{q[0]}{q[0]}))*?{q}" if len(q) > 1 else rf"(?:[^\\{q}\n]|\\.)*{q}", re.DOTALL) for q in ('"""', "'''", '"', "'")}


def _string(s: str, t: re.Match, words: list[str]) -> int:
    """The end of the string that the token begins; -1 if it has none."""
    prefix, quote = t["prefix"].lower(), t["quote"]
    if prefix not in STRING_PREFIXES:
        words.append(t["prefix"])
        prefix = ""
    if "f" in prefix or prefix.startswith("t") or prefix == "rt":
        return _interpolated(s, t.end(), quote, words)
    end = _ENDS[quote].match(s, t.end())
    return end.end() if end else -1


def logical_lines(source: str) -> list[Logical]:
    s = source.replace("\r\n", "\n").replace("\r", "\n")
    if not s.endswith("\n"):
        s += "\n"
    out: list[Logical] = []
    pos, line = 0, 1
    stuck: set[int] = set()  # physical lines with a bracket that was seen not to close
    while pos < len(s):
        begin, first = pos, line
        opened: list[int] = []
        indent, closed = _indent(s[pos : pos + 400]), True
        code: list[str] = []
        words: list[str] = []
        cuts: list[tuple[int, int, str, int]] = []  # where physical lines end: next position and line, the code and words so far
        while pos < len(s):
            t = TOKEN.match(s, pos)
            assert t is not None
            start, pos = pos, t.end()
            if t["line"]:
                line += 1
                cuts.append((pos, line, "".join(code), len(words)))
                if not opened:
                    break
                begins = BEGINS.match(s, pos) and _indent(s[pos : pos + 400]) <= indent
                if begins or len(cuts) == MOST_LINES or opened[-1] in stuck and not HEADER.match(cuts[0][2].strip()):
                    closed = False
                    break
                code.append(" ")
            elif t["joined"]:
                line += 1
                code.append(" ")
            elif t["quote"]:
                end = _string(s, t, words)
                if end < 0:  # the rest of the line, or of long quotes nothing, is the string
                    end = pos if len(t["quote"]) == 3 else s.index("\n", pos)
                line += s.count("\n", start, end)
                code.append(("" if t["prefix"].lower() in STRING_PREFIXES else t["prefix"]) + '""')
                pos = end
            elif t["comment"]:
                continue
            else:
                if t["open"]:
                    opened.append(line)
                elif t["close"] and opened:
                    opened.pop()
                if t["word"]:
                    words.append(t["word"])
                code.append(t[0])
        if not closed or opened:
            stuck.update(opened)
        if (not closed or opened) and len(cuts) > 1:
            header = HEADER.match("".join(code).strip())
            cut = next((c for c in cuts if c[2].rstrip().endswith(":")), cuts[0]) if header else cuts[0]
            pos, line, text, n = cut
            code, words = [text], words[:n]
        text = "".join(code).strip()
        if text:
            out.append(Logical(indent, first, line - 1, text, words))
        assert pos > begin
    return out


def recovered_symbols(source: str) -> list[dict]:
    """The definitions of a file, in the form of the parsed ones."""
    out: list[dict] = []
    open_: list[tuple[int, dict | None]] = []  # indentation and definition of the lines above
    tops: set[str] = set()
    whole: set[int] = set()  # first top-level classes of their name, whose functions are members
    decorator: tuple[int, int] | None = None
    for at in logical_lines(source):
        while open_ and open_[-1][0] >= at.indent:
            open_.pop()
        for _, symbol in open_:
            if symbol:
                symbol["end_line"] = at.last
        if at.code.startswith("@"):
            decorator = decorator if decorator and decorator[0] == at.indent else (at.indent, at.first)
            open_.append((at.indent, None))
            continue
        header = HEADER.match(at.code)
        symbol = None
        if header:
            owners = [x for _, x in open_ if x and x["kind"] == "class"]
            parent = owners[-1]["name"] if owners else None
            is_class = not header["def"]
            name = header["name"]
            member = not is_class and len(open_) == 1 and open_[0][1] is not None and open_[0][1]["seq"] in whole
            start = decorator[1] if decorator and decorator[0] == at.indent else at.first
            symbol = {"seq": len(out), "name": name, "kind": "class" if is_class else "method" if parent else "function", "start_line": start, "end_line": at.last, "parent": parent, "qualified_name": f"{parent}.{name}" if parent else name, "top_level": not open_, "member_of": open_[0][1]["name"] if member else None}
            if is_class and not open_ and name not in tops:
                tops.add(name)
                whole.add(symbol["seq"])
            out.append(symbol)
        decorator = None
        open_.append((at.indent, symbol))
    return out


def recovered_words(source: str) -> list[str]:
    """Every name of a file once, in order."""
    return list(dict.fromkeys(w for at in logical_lines(source) for w in at.words if not w[0].isdigit()))
