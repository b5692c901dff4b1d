"""Dependency edges from the texts of symbols.

Every line of a definition is scrubbed of comments and literals, and every identifier on it is read together with what stands right
ahead of and behind it. That tells calls, members and types; plain identifiers are told by what the registry has under their name.
Names declared locally are left out. Uses are then resolved to one symbol each, and repeats go.

Scale: one pass over the texts, all in built-in expressions; what is joined and shuffled are narrow uses, distinct per symbol.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import scrub_code
from lodestrata.operators.joins import ranked_resolution
from lodestrata.operators.predicates import C_BUILTINS, C_KEYWORDS, is_library_name, looks_like_macro

#: An identifier with a word or sign ahead that makes it a type or member, and with the bracket of a call behind.
IDENTIFIER = r"(?:\b(?:struct|union|enum)\s+|->\s*|\.\s*)?[A-Za-z_]\w*(?:\s*\()?"
#: A declaration: qualifiers, the type, what parts it from the name, the name, and what follows.
DECLARATION = r"^\s*(?:(?:static|const|extern|register|volatile|unsigned|signed|struct|union|enum)\s+)*([A-Za-z_]\w*)([\s*]+)([A-Za-z_]\w*)\s*(=|;|,|\[)"
#: One parameter that isn't a pointer.
PARAMETER = r"^\s*(?:(?:const|unsigned|signed|struct|union|enum)\s+)*[A-Za-z_]\w*\s+([A-Za-z_]\w*)\s*$"
#: Words that open a statement like a type does.
STATEMENT_WORDS = ("return", "goto", "else", "case", "typedef", "sizeof")


def definition_lines(symbols: DataFrame) -> DataFrame:
    """(key, kind, line_no, line, of, apart, declared, ends): the scrubbed lines of each definition; the last four are those of a declaration, or ''.

    symbols: (key, type, start_line, text). Lines within a comment that spans lines, which open with a star, are left out.
    """
    rows = symbols.select("key", F.col("type").alias("kind"), F.coalesce("start_line", F.lit(0)).alias("start_line"), F.posexplode(F.split("text", "\n")).alias("row", "raw"))
    rows = rows.where(~F.col("raw").rlike(r"^\s*(?:\*(?:\s|/|$)|/\*[^/]*$)")).select("key", "kind", (F.col("start_line") + F.col("row")).alias("line_no"), scrub_code(F.col("raw")).alias("line"))
    parts = {n: F.regexp_extract("line", DECLARATION, i) for i, n in enumerate(("of", "apart", "declared", "ends"), 1)}
    rows = rows.select("*", *[v.alias(k) for k, v in parts.items()])
    real = ~F.col("of").isin(*STATEMENT_WORDS)
    return rows.select("key", "kind", "line_no", "line", *[F.when(real, F.col(k)).otherwise("").alias(k) for k in parts])


def local_names(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """(key, name): variables declared on lines of functions, and their parameters; pointers and arrays don't count."""
    own = lines.where((F.col("kind") == "functions") & (F.col("declared") != "") & ~F.col("apart").contains("*") & (F.col("ends") != "[")).select("key", F.col("declared").alias("name"))
    listed = symbols.where("type = 'functions'").select("key", F.explode(F.split(F.regexp_extract("text", r"\(([^()]*)\)", 1), ",")).alias("p"))
    params = listed.select("key", F.regexp_extract("p", PARAMETER, 1).alias("name")).where("name <> ''")
    return own.unionByName(params).distinct()


def extracted_uses(symbols: DataFrame, registry: DataFrame) -> DataFrame:
    """(key, name, line_no, dep_type): the uses of registered names in each text, distinct [G12].

    symbols: (key, type, start_line, text), one row per key; registry: (name, type, reg_order). Keywords, builtin functions and local names are no uses.
    A call of a macro is a call and a use of the macro; a call of a member is a call and a use of the member. The type of a
    declaration is a type reference; other plain identifiers within one are left out, calls and members are not.
    """
    texts = symbols.where("key is not null and text <> ''").select("key", "type", "start_line", "text")
    lines = definition_lines(texts)
    hits = lines.select("key", "line_no", "of", "declared", F.explode(F.regexp_extract_all("line", F.lit(f"({IDENTIFIER})"), F.lit(1))).alias("m"))
    lead, call = F.regexp_extract("m", r"^(->|\.|(?:struct|union|enum)\b)", 1), F.col("m").endswith("(")
    name = F.regexp_extract("m", r"([A-Za-z_]\w*)\s*\(?$", 1)
    hits = hits.select("key", "line_no", "of", "declared", lead.alias("lead"), call.alias("call"), name.alias("name")).where(~F.col("name").isin(*C_KEYWORDS, *C_BUILTINS)).distinct()

    # What the registry has under a name: whether a macro, and the first type that isn't a variable's.
    telling = F.when(F.col("type") != "variables", F.struct("reg_order", "type"))
    kinds = registry.groupBy("name").agg(F.max((F.col("type") == "macros").cast("int")).alias("is_macro"), F.min(telling)["type"].alias("known"))
    met = hits.join(kinds, "name").join(local_names(texts, lines).withColumn("local", F.lit(True)), ["key", "name"], "left")
    macro = looks_like_macro(F.col("name")) | (F.col("is_macro") == 1)
    member, typed, local = F.col("lead").isin("->", "."), F.col("lead").isin("struct", "union", "enum"), F.coalesce("local", F.lit(False))
    declaring = F.col("declared") != ""
    plain = F.when(macro, "macro_use").when(F.col("known") == "functions", "function_call").when(F.col("known").isin("structs", "typedefs"), "type_reference").when(F.col("known") == "enums", "enum_use").otherwise("variable_use")
    kinds_of = (
        F.when(typed, F.array(F.lit("type_reference")))
        .when(member & F.col("call"), F.array(F.lit("function_call"), F.lit("struct_member")))
        .when(member, F.array(F.lit("struct_member")))
        .when(local, F.array().cast("array<string>"))
        .when(F.col("call") & macro, F.array(F.lit("function_call"), F.lit("macro_use")))
        .when(F.col("call"), F.array(F.lit("function_call")))
        .when(declaring & (F.col("name") == F.col("of")), F.array(F.lit("type_reference")))
        .when(declaring, F.array().cast("array<string>"))
        .otherwise(F.array(plain))
    )
    return met.select("key", "name", "line_no", F.explode(kinds_of).alias("dep_type")).distinct()


def extracted_edges(symbols: DataFrame, registry: DataFrame) -> DataFrame:
    """(src, dst, dep_type, start_line, end_line): the distinct edges that the texts give [G15, G16].

    symbols: (key, type, path, start_line, text); registry: (name, key, type, path, reg_order). A use is resolved to the best symbol of its name
    (``joins.ranked_resolution``), one of the C library to none, and one that is the symbol itself is left out.
    """
    uses = extracted_uses(symbols, registry).where(~is_library_name(F.col("name")))
    paths = symbols.where("key is not null").select("key", "path").distinct()
    placed = uses.join(paths, "key").select(F.struct("key", "line_no", "dep_type").alias("use_id"), "name", F.col("key").alias("src"), "path", "dep_type")
    found = ranked_resolution(placed, registry)
    return found.select(F.col("use_id.key").alias("src"), F.col("target").alias("dst"), "use_id.dep_type", F.col("use_id.line_no").alias("start_line"), F.col("use_id.line_no").alias("end_line")).distinct()


def extraction_counts(symbols: DataFrame, registry: DataFrame) -> DataFrame:
    """(dep_type, found, added, repeated_percent): uses found and edges left of them per type [G16]."""
    found = extracted_uses(symbols, registry).groupBy("dep_type").agg(F.count("*").alias("found"))
    added = extracted_edges(symbols, registry).groupBy("dep_type").agg(F.count("*").alias("added"))
    both = found.join(added, "dep_type", "left").select("dep_type", "found", F.coalesce("added", F.lit(0)).alias("added"))
    return both.withColumn("repeated_percent", (F.col("found") - F.col("added")) * 100.0 / F.col("found"))
