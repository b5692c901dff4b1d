"""Scalar functions on text, as column expressions. Names in brackets refer to the operator inventory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.model import is_blank

# Patterns of the published line and reference counts.
INLINE_COMMENT = r"//.*|/\*.*?\*/"
DOUBLE_QUOTED = r'"(?:\\"|.)*?"'
SINGLE_QUOTED = r"'(?:\\'|.)*?'"
SAFE_REFERENCE = r"&(?!mut\b)\w+|&\s*mut\s+\w+|\b(?:Cell|RefCell|String|str|Vec|Box)\b"
RAW_POINTER_BEHIND_WORD = r"\b\*(?:const|mut)\b"


def non_blank(c: Column) -> Column:
    """The text, or null if it is empty or blank."""
    return F.when(~is_blank(c), c)


def primary_text(definition: Column, declaration: Column) -> Column:
    """The definition, else the declaration, else '' [F38, first form]."""
    return F.coalesce(F.nullif(definition, F.lit("")), F.nullif(declaration, F.lit("")), F.lit(""))


def char_cost(definition: Column, declaration: Column, name: Column) -> Column:
    """Length of the primary text; an empty text costs the length of its name [B10]."""
    return F.length(F.coalesce(F.nullif(definition, F.lit("")), F.nullif(declaration, F.lit("")), name, F.lit("")))


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, rounded up, at least 1 [W3]."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4)).cast("int")


def strip_comment_marks(c: Column) -> Column:
    """Comment text without ``//``, ``/*`` and ``*/`` [F8]."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^\s*//[/!]*|^\s*/\*+<?|\*+/\s*$", ""), r"\n\s*\*+ ?", "\n"))


def scrub_code(line: Column) -> Column:
    """A code line without inline comments and the contents of literals [F3]."""
    no_strings = F.regexp_replace(F.regexp_replace(line, INLINE_COMMENT, ""), DOUBLE_QUOTED, '""')
    return F.regexp_replace(F.regexp_replace(no_strings, SINGLE_QUOTED, "''"), r"^\s+|\s+$", "")


def safe_ref_count(line: Column) -> Column:
    """Shared and mutable references and owning types [F4]."""
    return F.regexp_count(line, F.lit(SAFE_REFERENCE))


def unsafe_ref_count(line: Column) -> Column:
    """Raw pointers behind a word character only, as the published metrics count them [F5]."""
    return F.regexp_count(line, F.lit(RAW_POINTER_BEHIND_WORD))


def raw_pointer_count(line: Column) -> Column:
    """All spellings of raw pointer types: the corrected count beside F5."""
    return F.regexp_count(line, F.lit(r"\*\s*(?:const|mut)\b"))


def line_count(c: Column) -> Column:
    """Lines of a text; a trailing line end opens no further line, an empty text has none [F6]."""
    unix = F.regexp_replace(c, r"\r\n?", "\n")
    return F.when(unix == "", 0).otherwise(F.size(F.split(unix, "\n", -1)) - F.when(unix.endswith("\n"), 1).otherwise(0))


def function_name(c: Column) -> Column:
    """The name in front of the parameter list, or '' [F9]."""
    return F.regexp_extract(c, r"([A-Za-z_]\w*)\s*\([^;{]*", 1)


def signature(c: Column) -> Column:
    """What stands ahead of the first brace, trimmed [F11]."""
    return F.trim(F.substring_index(c, "{", 1))


def typedef_name(c: Column) -> Column:
    """``(*name)``, else the last identifier ahead of the semicolon [F12]."""
    pointer = F.regexp_extract(c, r"\(\s*\*\s*([A-Za-z_]\w*)\s*\)", 1)
    last = F.regexp_extract(c, r"([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)?;\s*$", 1)
    return F.coalesce(F.nullif(pointer, F.lit("")), F.nullif(last, F.lit("")), F.lit(""))


def include_name(c: Column) -> Column:
    """The file of an include directive [F13]."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s*#\s*include\s*", ""), r'^[<"]|[>"]\s*$', "")


def truncate(c: Column, limit: int, marker: str = "...") -> Column:
    """The text, or its first ``limit`` characters and a marker [F14]."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(marker))).otherwise(c)


def clip(c: Column, limit: int) -> Column:
    """The text, or its first ``limit`` characters and how many are left [F15]."""
    left = F.length(c) - limit
    return F.when(left > 0, F.concat(F.substring(c, 1, limit), F.lit("... ["), left.cast("string"), F.lit(" more]"))).otherwise(c)


def error_locations(c: Column) -> Column:
    """All ``--> file:line:column`` of a compiler's output as array<struct<file,line,col>> [F16]."""
    hits = F.regexp_extract_all(c, F.lit(r"(--> [^\s:]+:\d+:\d+)"), F.lit(1))
    return F.transform(
        hits,
        lambda x: F.struct(
            F.regexp_extract(x, r"--> ([^\s:]+):", 1).alias("file"),
            F.regexp_extract(x, r":(\d+):\d+$", 1).cast("int").alias("line"),
            F.regexp_extract(x, r":(\d+)$", 1).cast("int").alias("col"),
        ),
    )


def output_signature(c: Column) -> Column:
    """A digest of the trimmed, non-blank lines of an output [F17, repaired: always defined]."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.sha2(F.array_join(lines, "\n"), 256)


def strip_think(c: Column) -> Column:
    """Text without paired think blocks and orphan think tags [F19]."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""), r"(?i)</?think>", ""))


def replace_checked(c: Column, old: str, new: str, replace_all: bool = False) -> Column:
    """struct(text, hits, done): the replacement is done if the old text occurs, and only once unless ``replace_all`` [F29]."""
    hits = ((F.length(c) - F.length(F.replace(c, F.lit(old), F.lit("")))) / len(old)).cast("int")
    done = (hits > 0) if replace_all else (hits == 1)
    return F.struct(F.when(done, F.replace(c, F.lit(old), F.lit(new))).otherwise(c).alias("text"), hits.alias("hits"), done.alias("done"))


def pair_encode(name: Column, path: Column) -> Column:
    """``name|path``, or the bare name without a path [P23]."""
    return F.when(F.coalesce(path, F.lit("")) == "", name).otherwise(F.concat_ws("|", name, strip_dots(path)))


def pair_decode(c: Column) -> Column:
    """struct(name, path): the parts of ``name|path``; null path for a bare name [P23, S19]."""
    parts = F.split(c, r"\|", 2)
    return F.struct(F.trim(parts[0]).alias("name"), F.when(F.size(parts) == 2, F.nullif(strip_dots(F.trim(parts[1])), F.lit(""))).alias("path"))


def strip_dots(path: Column) -> Column:
    """``\\`` becomes ``/``; all leading dots and slashes go, as characters: ``../x`` is ``x`` [P23]."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^[./]+", "")


def rust_path(path: Column) -> Column:
    """``x.c`` is ``x_c.rs``, ``x.h`` is ``x_h.rs``; other paths stay [P24, P25]."""
    return F.regexp_replace(path, r"\.([chCH])$", "_$1.rs")


def module_name(c: Column) -> Column:
    """Dashes and dots become underscores, a leading digit gets ``m_`` [P26]."""
    flat = F.regexp_replace(c, r"[-.]", "_")
    return F.when(flat.rlike(r"^\d"), F.concat(F.lit("m_"), flat)).otherwise(flat)


def common_suffix(a: Column, b: Column) -> Column:
    """How many trailing parts two paths share up to the first difference [J3]."""
    x, y = F.reverse(F.split(a, "/")), F.reverse(F.split(b, "/"))
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    # The first place that differs ends the count; without one all places of the shorter path count.
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first > 0, first - 1).otherwise(F.size(same))


def dep_fits(dep_type: Column, kind: Column) -> Column:
    """Whether a symbol of this type can be what a dependency of that type refers to [J2]."""
    return (
        F.when(dep_type == "function_call", kind == "functions")
        .when(dep_type == "type_reference", kind.isin("structs", "typedefs"))
        .when(dep_type == "macro_use", kind == "macros")
        .when(dep_type == "enum_use", kind == "enums")
        .when(dep_type == "variable_use", kind == "variables")
        .otherwise(F.lit(True))
    )


def percent_value(c: Column) -> Column:
    """The number of a percent text such as ``12.34%`` [F2]."""
    return F.regexp_replace(c, r"%\s*$", "").try_cast("double")


def query_text(fields: list[tuple[str, Column]]) -> Column:
    """``field: value`` lines in the given order [F33]."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in fields])


def declared_text(*candidates: Column, definition: Column) -> Column:
    """The first non-blank candidate, else the first non-blank line of the definition, else '' [H2]."""
    lines = F.filter(F.split(F.coalesce(definition, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in candidates], F.when(F.size(lines) > 0, F.element_at(lines, 1)), F.lit(""))


def canonical_json(c: Column) -> Column:
    """A JSON object of scalars with its keys in order, values as text: a marker for removing repeats [U6]."""
    entries = F.array_sort(F.map_entries(F.from_json(c, "map<string,string>")))
    return F.to_json(F.map_from_entries(entries))


def tool_call(c: Column) -> Column:
    """struct(name, args): a tool call in JSON, plain or within code fences, in either of two shapes; null if it is none [F32]."""
    bare = F.trim(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*|\s*```$", ""))
    name = F.coalesce(F.get_json_object(bare, "$.tool_call.name"), F.get_json_object(bare, "$.name"))
    args = F.coalesce(F.get_json_object(bare, "$.tool_call.args"), F.get_json_object(bare, "$.args"), F.lit("{}"))
    return F.when(name.isNotNull(), F.struct(name.alias("name"), args.alias("args")))


def severity(c: Column) -> Column:
    """Severity names and numbers as 1 (error) to 4 (hint); null if unknown [P20]."""
    names = {"error": 1, "err": 1, "fatal": 1, "critical": 1, "warning": 2, "warn": 2, "information": 3, "info": 3, "hint": 4, "debug": 4}
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[F.lower(F.trim(c))], F.when(c.try_cast("int").between(1, 4), c.try_cast("int")))
