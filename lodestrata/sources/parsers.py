"""Parser plug-in: source files to symbol rows, and a built-in extractor by patterns and balanced brackets.

A parser is a function from (path, text) to rows (type, name, start_line, end_line, start_byte, end_byte, full_declaration,
full_definition, comment). A grammar-based one can take the place of the built-in one; each file is one call, so files are the unit
of distribution and nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.parse import balanced
from lodestrata.session import ship

COLUMNS = ["type", "name", "start_line", "end_line", "start_byte", "end_byte", "full_declaration", "full_definition", "comment"]
_DDL = "path string, type string, name string, start_line int, end_line int, start_byte int, end_byte int, full_declaration string, full_definition string, comment string"

_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|//[^\n]*", re.S)
_STRING = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'')
_INCLUDE = re.compile(r"^[ \t]*#[ \t]*include[ \t]*(<[^>\n]+>|\"[^\"\n]+\")", re.M)
_MACRO = re.compile(r"^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)(?:[^\n\\]|\\\n|\\.)*", re.M)
_NAME = re.compile(r"[A-Za-z_]\w*")

# Kinds of Rust items and how they open.
RUST_ITEMS = {"fn": "Function", "struct": "Struct", "enum": "Enum", "const": "Const", "static": "Static", "type": "TypeAlias", "union": "Union", "mod": "Module", "macro_rules!": "Macro"}
_RUST = re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:(?:async|unsafe|const|extern(?:[ \t]+\"[^\"]*\")?)[ \t]+)*(?P<kw>fn|struct|enum|const|static|type|union|mod|macro_rules!)[ \t]+(?:mut[ \t]+)?(?P<name>[A-Za-z_]\w*)|^[ \t]*(?:unsafe[ \t]+)?impl\b(?P<impl>[^{;]*)", re.M)


class _Places:
    """Line numbers and byte offsets of places in a text, from tables made once."""

    def __init__(self, text: str) -> None:
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.bytes = None if text.isascii() else np.concatenate([[0], np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in text])])

    def line(self, at: int) -> int:
        """How many line ends stand ahead of the place."""
        return bisect_left(self.breaks, at)

    def byte(self, at: int) -> int:
        return at if self.bytes is None else int(self.bytes[at])


def _masked(text: str) -> str:
    """The text with comments and literals blanked, at the same offsets."""
    blank = lambda m: re.sub(r"[^\n]", " ", m.group())
    return _STRING.sub(blank, _COMMENT.sub(blank, text))


def _statements(code: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, brace) of top-level statements: up to a semicolon or the end of a body; brace is the body's offset or -1."""
    i, n, start, brace = 0, len(code), None, -1
    while i < n:
        c = code[i]
        if start is None:
            if c.isspace() or c in ";}":
                i += 1
                continue
            if c == "#":
                while i < n and (code[i] != "\n" or code[i - 1] == "\\"):
                    i += 1
                continue
            start, brace = i, -1
        if c in "{([":
            end = balanced(code, i)
            if end < 0:
                yield start, n, i if c == "{" else brace
                return
            if c == "{":
                brace = i if brace < 0 else brace
                head = code[start:i]
                # A body ends a function; braces of types and initialisers go on to the semicolon.
                if "(" in head and "=" not in head and not re.match(r"\s*(?:typedef|struct|union|enum)\b[^()]*$", head):
                    yield start, end, i
                    start, i = None, end
                    continue
            i = end
            continue
        if c == ";":
            yield start, i + 1, brace
            start = None
        i += 1
    if start is not None:
        yield start, n, brace


def _notes_ahead(text: str, comments: list[tuple[int, int]], start: int) -> str:
    """The comments (spans in order) that end at most three lines ahead of ``start``, one after the other, joined."""
    out, k = [], bisect_right(comments, start, key=lambda c: c[1]) - 1
    while k >= 0:
        gap = text[comments[k][1] : start]
        if gap.strip() or gap.count("\n") > 3:
            break
        out.append(text[slice(*comments[k])])
        start, k = comments[k][0], k - 1
    return " ".join(reversed(out))


def declared_name(head: str) -> str:
    """The name a declarator declares: ``(*name)``, else the name ahead of the parameters, else the last one [H23]."""
    m = re.search(r"\(\s*\*+\s*([A-Za-z_]\w*)", head)
    if m:
        return m.group(1)
    m = re.search(r"([A-Za-z_]\w*)\s*\(", head)
    if m:
        return m.group(1)
    names = _NAME.findall(re.sub(r"\[[^\]]*\]|=.*|:\s*\d+", "", head, flags=re.S))
    return names[-1] if names else ""


def parse_c(path: str, text: str) -> list[tuple]:
    """The top-level elements of a C file: functions, structs (and unions), enums, typedefs, variables, macros and includes."""
    code, rows, places, comments = _masked(text), [], _Places(text), [m.span() for m in _COMMENT.finditer(text)]

    def add(kind: str, name: str, a: int, b: int, declaration: str, definition: str = "") -> None:
        whole = text[a:b]
        rows.append((kind, name, places.line(a) + 1, places.line(b) + (0 if whole.endswith("\n") else 1), places.byte(a), places.byte(b), declaration, definition, _notes_ahead(text, comments, a)))

    for m in _INCLUDE.finditer(text):
        if code[m.start() : m.start(1)].strip():
            add("includes", m.group(1)[1:-1], m.start(), m.end(), m.group().strip())
    for m in _MACRO.finditer(code):
        add("macros", m.group(1), m.start(), m.end(), text[m.start() : m.end()].strip())
    flat = re.sub(r"^[ \t]*#(?:[^\n\\]|\\\n|\\.)*", lambda m: re.sub(r"[^\n]", " ", m.group()), code, flags=re.M)
    for a, b, brace in _statements(flat):
        head = flat[a : brace if brace >= 0 else b]
        whole, first = text[a:b], (_NAME.match(head) or [""])[0]
        if first == "typedef":
            add("typedefs", declared_name(re.sub(r"\{.*\}", " ", flat[a:b], flags=re.S).rstrip("; \n")), a, b, whole, whole if brace >= 0 else "")
        elif brace >= 0 and re.match(r"(?:static\s+|extern\s+|const\s+)*(?:struct|union|enum)\b[^()=]*$", head):
            kind = "enums" if re.search(r"\benum\b", head) else "structs"
            names = [n for n in _NAME.findall(head) if n not in ("struct", "union", "enum", "static", "extern", "const")]
            add(kind, names[-1] if names else f"anonymous_{kind[:-1]}", a, b, whole, whole)
        elif "(" in head and "=" not in head.split("(")[0] and not re.match(r"(?:return|if|for|while|switch)\b", head):
            is_body = brace >= 0 and flat[b - 1] == "}"
            add("functions", declared_name(head), a, b, text[a:brace].strip() if is_body else whole, whole if is_body else "")
        elif first and (brace < 0 or "=" in head) and len(_NAME.findall(head)) > 1:
            add("variables", declared_name(head.split("=")[0].rstrip("; \n")), a, b, whole, "")
    return sorted(rows, key=lambda r: (r[4], r[0]))


def parse_rust(path: str, text: str) -> list[tuple]:
    """The items of a Rust file, nested ones included; an impl is listed under the type it is for [S25, H29 to H32]."""
    code, rows, places, comments = _masked(text), [], _Places(text), [m.span() for m in _COMMENT.finditer(text)]
    for m in _RUST.finditer(code):
        a = m.start() + len(m.group()) - len(m.group().lstrip())
        brace, stop = code.find("{", m.end()), code.find(";", m.end())
        if brace >= 0 and (stop < 0 or brace < stop or m.group("impl") is not None):
            end = balanced(code, brace)
        else:
            end = stop + 1
        end = end if end > 0 else len(text)
        if m.group("impl") is not None:
            target = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", m.group("impl").split(" where ")[0])).split(" for ")[-1]
            names = _NAME.findall(target)
            kind, name = "Impl", names[-1] if names else ""
        else:
            kind, name = RUST_ITEMS[m.group("kw")], m.group("name")
        rows.append((kind, name, places.line(a) + 1, places.line(end) + 1, places.byte(a), places.byte(end), text[a : brace if a < brace < end else end].strip(), text[a:end], _notes_ahead(text, comments, a)))
    return rows


PARSERS: dict[str, Callable[[str, str], list[tuple]]] = {"c": parse_c, "h": parse_c, "rs": parse_rust}


def parse_files(files: DataFrame, parser: Callable[[str, str], list[tuple]] | None = None) -> DataFrame:
    """(path, type, name, start_line, ..., comment) of files (path, text); a file the parser can't read gives no rows.

    Without a parser the extension chooses a built-in one; other files give no rows. Null and empty texts give none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"]):
                fn = parser or PARSERS.get(path.rsplit(".", 1)[-1].lower())
                if fn is None:
                    continue
                try:
                    rows += [(path, *r) for r in fn(path, text)]
                except (ValueError, IndexError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=["path", *COLUMNS])

    ship(files.sparkSession)
    return files.select("path", "text").where((F.length("text") > 0) & F.col("path").isNotNull()).mapInPandas(run, _DDL)
