"""Symbol keys, types and paths: the shared normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Raw symbol type names and the six types they stand for.
SYMBOL_TYPES = {
    "functions": "functions",
    "function": "functions",
    "function_declaration": "functions",
    "function_definition": "functions",
    "function_proto": "functions",
    "function_prototype": "functions",
    "typedefs": "typedefs",
    "typedef": "typedefs",
    "typedef_declaration": "typedefs",
    "typedef_definition": "typedefs",
    "macros": "macros",
    "macro": "macros",
    "macro_definition": "macros",
    "variables": "variables",
    "variable": "variables",
    "variable_declaration": "variables",
    "variable_definition": "variables",
    "global_variable": "variables",
    "structs": "structs",
    "struct": "structs",
    "struct_declaration": "structs",
    "struct_definition": "structs",
    "union": "structs",
    "union_declaration": "structs",
    "union_definition": "structs",
    "enums": "enums",
    "enum": "enums",
    "enum_declaration": "enums",
    "enum_definition": "enums",
}

# Dependency types.
DEP_TYPES = ("function_call", "type_reference", "variable_use", "macro_use", "enum_use", "struct_member")

_BLANK = r"^[\s\p{Z}\x{FEFF}]*$"


def is_blank(c: Column) -> Column:
    """True for null, empty and all-white text (ideographic and no-break blanks included)."""
    # A text that opens with a visible ASCII sign isn't blank; only the rest is held against the pattern.
    return c.isNull() | (~F.substring(c, 1, 1).between("!", "~") & c.rlike(_BLANK))


_NORMAL = tuple(sorted(set(SYMBOL_TYPES.values())))


def normal_type(c: Column) -> Column:
    """The type without surrounding blanks and quotes; known spellings map, in any case, to one of six names."""
    bare = F.regexp_replace(c, r"^[\s'\"]+|[\s'\"]+$", "")
    pairs = [x for kv in sorted(SYMBOL_TYPES.items()) for x in (F.lit(kv[0]), F.lit(kv[1]))]
    # Nearly all values are in normal form already and need neither pattern nor map.
    return F.when(c.isin(*_NORMAL), c).otherwise(F.coalesce(F.create_map(*pairs)[F.lower(bare)], bare))


def normal_path(c: Column) -> Column:
    """``\\`` becomes ``/`` and one leading ``./`` goes."""
    slashed = F.translate(c, "\\", "/")
    return F.when(slashed.startswith("./"), F.substring(slashed, F.lit(3), F.length(slashed))).otherwise(slashed)


def normal_key(c: Column) -> Column:
    """``name:type:path`` in normal form; null for null and blank keys. A key without three parts stays, trimmed."""
    rest = F.substr(c, F.instr(c, ":") + 1)
    cut = F.instr(rest, ":")
    full = F.concat_ws(":", F.substring_index(c, ":", 1), normal_type(F.substring(rest, F.lit(1), cut - 1)), normal_path(F.substr(rest, cut + 1)))
    return F.when(cut > 0, full).when(is_blank(c), F.lit(None)).otherwise(F.trim(c)).cast("string")


def key_of(name: Column, kind: Column, path: Column) -> Column:
    """The key of separate columns."""
    return F.concat_ws(":", name, normal_type(kind), normal_path(path))
