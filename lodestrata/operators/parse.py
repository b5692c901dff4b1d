"""Parsing of text into typed rows: value tables, templates, tool calls, balanced segments."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import strip_think, tool_call
from lodestrata.session import ship

# What counts as a group and as a value of a value-only table.
ROW_GROUP = r"\{([^{}]+)\}"
ROW_VALUE = r"""("[^"]*"|'[^']*'|[^,"']+)"""

_CAST = {"int": "bigint", "float": "double", "str": "string"}


def value_rows(text: Column, fields: dict[str, str]) -> Column:
    """array<struct>: the groups ``{a, b}`` of a text as typed rows [X8, X9].

    Values may be quoted, then commas belong to them. Groups with another number of values, or with a value that doesn't fit
    its type, are dropped; a closing comma is allowed.
    """
    groups = F.regexp_extract_all(strip_think(text), F.lit(ROW_GROUP), F.lit(1))

    def row(g: Column) -> Column:
        raw = F.filter(F.transform(F.regexp_extract_all(g, F.lit(ROW_VALUE), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
        return F.transform(raw, lambda x: F.regexp_replace(x, r"""^["']|["']$""", ""))

    rows = F.filter(F.transform(groups, row), lambda r: F.size(r) == len(fields))

    def value(x: Column, kind: str) -> Column:
        """Whole numbers must be written as such: ``1.5`` is no int."""
        if kind == "int":
            return F.when(F.trim(x).rlike(r"^[+-]?\d+$"), x.try_cast("bigint"))
        return x.try_cast(_CAST[kind])

    typed = F.transform(rows, lambda r: F.struct(*[value(r[i], t).alias(n) for i, (n, t) in enumerate(fields.items())]))
    return F.filter(typed, lambda s: _all_there(s, list(fields)))


def _all_there(s: Column, names: list[str]) -> Column:
    ok = F.lit(True)
    for n in names:
        ok = ok & s[n].isNotNull()
    return ok


def json_rows(text: Column, field: str, fields: dict[str, str]) -> Column:
    """array<struct>: the rows of a JSON table ``{field: [{...}, ...]}``; rows that lack a value or have one of another type are dropped; no table gives an empty array."""
    ddl = f"{field} array<struct<" + ",".join(f"{n}:string" for n in fields) + ">>"
    rows = F.coalesce(F.from_json(strip_think(text), ddl)[field], F.array().cast("array<struct<" + ",".join(f"{n}:string" for n in fields) + ">>"))
    typed = F.transform(rows, lambda r: F.struct(*[r[n].try_cast(_CAST[t]).alias(n) for n, t in fields.items()]))
    return F.filter(typed, lambda s: _all_there(s, list(fields)))


def _cells(r: Column, fields: list[str]) -> list[Column]:
    return [r[f].cast("string") for f in fields]


def to_tsv(rows: Column, fields: list[str]) -> Column:
    """A table as tab-separated text; '' without rows [X10, X11]."""
    body = F.array_join(F.transform(rows, lambda r: F.concat_ws("\t", *_cells(r, fields))), "\n")
    return F.when(F.size(rows) > 0, F.concat(F.lit("\t".join(fields) + "\n"), body)).otherwise(F.lit(""))


def to_csv(rows: Column, fields: list[str]) -> Column:
    """A table as CSV text, quoted where needed [X10]."""

    def cell(c: Column) -> Column:
        return F.when(c.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    body = F.array_join(F.transform(rows, lambda r: F.concat_ws(",", *map(cell, _cells(r, fields)))), "\r\n")
    return F.when(F.size(rows) > 0, F.concat(F.lit(",".join(fields) + "\r\n"), body)).otherwise(F.lit(""))


def to_markdown(rows: Column, fields: list[str]) -> Column:
    """A table in markdown [X12]."""
    head = "| " + " | ".join(fields) + " |\n| " + " | ".join("---" for _ in fields) + " |\n"
    body = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("| "), F.concat_ws(" | ", *_cells(r, fields)), F.lit(" |"))), "\n")
    return F.when(F.size(rows) > 0, F.concat(F.lit(head), body)).otherwise(F.lit(""))


def to_json_table(rows: Column, field: str) -> Column:
    """A table as ``{field: [...]}`` [X13]."""
    return F.to_json(F.struct(rows.alias(field)))


# Templates -------------------------------------------------------------------------------------------------

_FIELD = re.compile(r"\{(\w+)(?::([^{}]+))?\}")
_TRUE, _FALSE = {"true", "1", "yes"}, {"false", "0", "no"}


def compile_template(template: str) -> list[tuple[str, str, str]]:
    """(literal ahead, field, type) of a template such as ``score={n:int}; name={s}``, and last the literal behind, with no field [X5]."""
    parts, at = [], 0
    for m in _FIELD.finditer(template):
        parts.append((template[at : m.start()], m.group(1), (m.group(2) or "str").strip()))
        at = m.end()
    return [*parts, (template[at:], "", "")]


def balanced(text: str, start: int) -> int:
    """The end of the bracketed segment that starts at ``start``; brackets within strings don't count; -1 if it doesn't close [F18]."""
    pairs, stack, quote, i = {"{": "}", "[": "]", "(": ")"}, [], "", start
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c in pairs:
            stack.append(pairs[c])
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack:
                return i + 1
        i += 1
    return -1


def convert(value: str, kind: str):
    """The typed value of a field's text; raises ValueError if it doesn't fit. Lists and maps must be JSON; nothing is evaluated."""
    v = value.strip()
    if kind.startswith("str:regex="):
        if not re.fullmatch(kind[10:], v):
            raise ValueError(f"{v!r} doesn't match {kind[10:]!r}")
        return v
    if kind == "int":
        return int(v)
    if kind == "float":
        return float(v)
    if kind == "bool":
        if v.lower() in _TRUE | _FALSE:
            return v.lower() in _TRUE
        raise ValueError(f"{v!r} is no bool")
    if kind == "str":
        return v
    if kind == "any":
        try:
            return json.loads(v)
        except ValueError:
            return v
    data = json.loads(v)
    wanted = {"dict": dict, "json": (dict, list), "list[str]": list, "list[int]": list}.get(kind)
    if wanted is None or not isinstance(data, wanted) or (kind == "list[str]" and not all(isinstance(x, str) for x in data)) or (kind == "list[int]" and not all(isinstance(x, int) and not isinstance(x, bool) for x in data)):
        raise ValueError(f"{v!r} is no {kind}")
    return data


class Unfit(ValueError):
    """Why a text isn't in the form of a template."""


def parse_template(text: str, template: str) -> dict | None:
    """The fields of a text in the form of a template, or null [X6]."""
    return validate_text(text, template)[0]


def validate_text(text: str, template: str) -> tuple[dict | None, str | None, str | None]:
    """(fields, matched part, reason): the fields of a text in the form of a template, or why there are none [X7].

    Each occurrence of the first literal is tried in turn, up to the last occurrence of the closing literal; a field ends at
    the next literal, a JSON field with its balanced segment, the last field at the closing literal. Of several failures the last one is told.
    """
    parts = compile_template(template)
    first, last = parts[0][0], parts[-1][0]
    at, matched, reason = text.find(first), None, f"no {first!r} ahead of a {last!r}"
    while at >= 0:
        end = text.rfind(last, at) if last else len(text)
        if end >= 0:
            matched = text[at : end + len(last)]
            try:
                return _match(text, at, parts), matched, None
            except Unfit as e:
                reason = str(e)
        at = text.find(first, at + 1) if first else -1
    return None, matched, reason


def _match(text: str, at: int, parts: list[tuple[str, str, str]]) -> dict:
    out, pos = {}, at + len(parts[0][0])
    for k, (_, field, kind) in enumerate(parts[:-1]):
        after = parts[k + 1][0]
        if kind in ("dict", "json", "list[str]", "list[int]") and pos < len(text) and text[pos] in "{[":
            end = balanced(text, pos)
            if end < 0 or not text.startswith(after, end):
                raise Unfit(f"{field}: no balanced segment ahead of {after!r}")
        elif k == len(parts) - 2:
            end = text.rfind(after, pos) if after else len(text)
        else:
            end = text.find(after, pos) if after else len(text)
        if end < 0:
            raise Unfit(f"{field}: no {after!r} behind it")
        try:
            out[field] = convert(text[pos:end], kind)
        except ValueError as e:
            raise Unfit(f"{field}: {e}") from None
        pos = end + len(after)
    return out


def parse_texts(df: DataFrame, id_col: str, text_col: str, template: str) -> DataFrame:
    """(id, success, data): each text against the template; data is JSON, null where it fails. Think blocks are left out first."""
    return validated_texts(df, id_col, text_col, template).select(id_col, "success", "data")


def validated_texts(df: DataFrame, id_col: str, text_col: str, template: str) -> DataFrame:
    """(id, success, data, matched, raw, reason): each text against the template, with the part that was tried, the text and why it fails [X7].

    data is JSON, null where it fails, reason null where it doesn't. Think blocks are left out first. A null text fails without a reason.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [validate_text(t, template) if t is not None else (None, None, None) for t in b["text"]]
            data = [None if g[0] is None else json.dumps(g[0], ensure_ascii=False) for g in got]
            yield pd.DataFrame({"id": b["id"], "success": [g[0] is not None for g in got], "data": data, "matched": [g[1] for g in got], "raw": b["text"], "reason": [g[2] for g in got]})

    src = df.select(F.col(id_col).alias("id"), strip_think(F.col(text_col)).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    ship(src.sparkSession)
    return src.mapInPandas(run, f"id {kind}, success boolean, data string, matched string, raw string, reason string").withColumnRenamed("id", id_col)


def function_span(code: str, name: str) -> tuple[int, int] | None:
    """(start, end) of ``fn name`` up to its balanced brace [F21]."""
    m = re.search(rf"\bfn\s+{re.escape(name)}\b", code)
    if not m:
        return None
    brace = code.find("{", m.end())
    end = balanced(code, brace) if brace >= 0 else -1
    return (m.start(), end) if end > 0 else None


def header_body_tail(code: str) -> tuple[str, str, str] | None:
    """What stands ahead of the first brace, within it, and behind its counterpart [F22]."""
    brace = code.find("{")
    end = balanced(code, brace) if brace >= 0 else -1
    return (code[:brace], code[brace + 1 : end - 1], code[end:]) if end > 0 else None


def use_blocks(code: str) -> list[str]:
    """The ``use`` declarations of a Rust file with the attributes ahead of them [F24]."""
    return [m.group().strip() for m in re.finditer(r"(?:^[ \t]*#\[[^\]]*\][ \t]*\n)*^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+[^;]+;", code, re.M)]


def segments(length: Column, spans: Column) -> Column:
    """array<struct<start,end,gap>>: a text of this length as alternating gaps and spans in order; overlapping spans are cut at the end of the one ahead [F25]."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,gap:boolean>>").alias("out"))

    def seg(a: Column, b: Column, gap: bool) -> Column:
        return F.filter(F.array(F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(gap).alias("gap"))), lambda x: x["start"] < x["end"])

    def step(s: Column, x: Column) -> Column:
        lo = F.greatest(s["at"], x["start"])
        hi = F.greatest(lo, F.least(x["end"], length))
        return F.struct(hi.cast("int").alias("at"), F.concat(s["out"], seg(s["at"], lo, True), seg(lo, hi, False)).alias("out"))

    done = F.aggregate(F.array_sort(spans), start, step)
    return F.concat(done["out"], seg(done["at"], length, True))


def unified_diff(df: DataFrame, id_col: str, before: str, after: str, most_chars: int = 1800, most_lines: int = 40) -> DataFrame:
    """(id, diff): unified differences, cut to a number of lines and characters [F26, F27]."""
    import difflib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x, y in zip(b["x"], b["y"]):
                lines = list(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), "before", "after", lineterm=""))
                text = "\n".join(lines[:most_lines]) + ("\n..." if len(lines) > most_lines else "")
                out.append(text[:most_chars] + ("..." if len(text) > most_chars else ""))
            yield pd.DataFrame({"id": b["id"], "diff": out})

    src = df.select(F.col(id_col).alias("id"), F.col(before).alias("x"), F.col(after).alias("y"))
    kind = src.schema["id"].dataType.simpleString()
    ship(src.sparkSession)
    return src.mapInPandas(run, f"id {kind}, diff string").withColumnRenamed("id", id_col)


class Tools:
    """Registered functions that tool calls in texts may name [X1 to X4]."""

    def __init__(self) -> None:
        self.known: dict = {}

    def register(self, fn):
        self.known[fn.__name__] = fn
        return fn

    def call(self, name: str, args: dict):
        """The function's result, its arguments brought to their annotated types; unknown names and arguments raise ValueError."""
        import inspect

        if name not in self.known:
            raise ValueError(f"unknown tool {name!r}")
        params = inspect.signature(self.known[name], eval_str=True).parameters
        extra = set(args) - set(params)
        if extra:
            raise ValueError(f"{name} has no argument {', '.join(sorted(extra))}")
        given = {}
        for p in params.values():
            if p.name in args:
                kind = p.annotation if p.annotation in (int, float, str, bool) else None if p.annotation is not p.empty else str
                given[p.name] = kind(args[p.name]) if kind else args[p.name]
            elif p.default is p.empty:
                raise ValueError(f"{name} lacks the argument {p.name}")
        return self.known[name](**given)

    def interpret(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, name, result): what the tool call in each text gives; a text that holds none has null for both, an error its message."""
        tools = self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for n, a in zip(b["name"], b["args"]):
                    if n is None:
                        out.append(None)
                        continue
                    try:
                        out.append(str(tools.call(n, json.loads(a))))
                    except (ValueError, TypeError) as e:
                        out.append(f"error: {e}")
                yield pd.DataFrame({"id": b["id"], "name": b["name"], "result": out})

        src = df.select(F.col(id_col).alias("id"), tool_call(F.col(text_col)).alias("c")).select("id", "c.name", "c.args")
        kind = src.schema["id"].dataType.simpleString()
        ship(src.sparkSession)
        return src.mapInPandas(run, f"id {kind}, name string, result string").withColumnRenamed("id", id_col)
