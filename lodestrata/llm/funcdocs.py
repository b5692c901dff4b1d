"""Functions paired with their documentation.

Method: parse the documentation tags of each function, resolve inherited documentation by iterative joins, drop what
stays empty. C has no classes, so what a function can inherit is the documentation it names with a copy tag
(``@copydoc name``, ``@inheritdoc name``): every round joins the functions still waiting with those that came to be documented in
the round before, of the same name and project, until a round documents none; so chains of any length are followed, and cycles
end. The rounds are run only if some comment holds such a tag. The step from comment to "what it says" is one pass of a
line-wise parser over Arrow batches.

Scale: the parse needs no shuffle; pairs are shuffled once by symbol_id, to drop repeated rows. Where there are tags, the parsed functions
are kept once in the shared checkpoint folder, and the rounds carry names and ids alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.model import normal_type
from lodestrata.session import checkpointed, ship

# Words and phrases that say nothing about what a function does.
PLACEHOLDERS = frozenset(
    """todo, to do, tbd, fixme, xxx, n/a, na, none, nil, no comment, no description, no documentation, undocumented, description, comment, comments,
    documentation, doc, docs, function, functions, func, method, helper, helper function, internal, internal function, private, public, static, inline,
    extern, forward, forward declaration, declaration, prototype, definition, implementation, stub, placeholder, see above, see below, see header, see implementation,
    same as above, ditto, self explanatory, self-explanatory, obvious, wip, work in progress, deprecated, unused, empty, 无, 暂无, 待补充, 待定, 同上, 略, 空,
    补充说明, 未完成, 没有注释, 无注释, 说明, 描述, 函数, 内部, keine, keine beschreibung, siehe oben, aucune, aucun, rien, voir ci-dessus""".replace("\n", " ").split(",")
)
PLACEHOLDERS = frozenset(" ".join(p.split()) for p in PLACEHOLDERS)

# Headings that part a source file.
HEADINGS = frozenset(
    """init, initialization, initialisation, setup, teardown, cleanup, helpers, helper functions, utilities, utils, private functions, public functions, static functions,
    internal functions, private, public, public api, private api, api, accessors, getters, setters, getters and setters, implementation, prototypes, function prototypes,
    forward declarations, declarations, definitions, globals, constants, types, includes, macros, callbacks, main, misc, tests, constructors, destructors,
    内部函数, 公共接口, 公共函数, 私有函数, 辅助函数, 初始化, 工具函数, 全局变量, 接口""".replace("\n", " ").split(",")
)
HEADINGS = frozenset(" ".join(p.split()) for p in HEADINGS)

_CODE_WORDS = {"if", "for", "while", "switch", "return", "else", "do", "goto", "break", "continue", "int", "char", "void", "static", "const", "unsigned", "struct", "long", "double", "bool"}

_COPY = re.compile(r"[@\\]\{?(?:copydoc|copybrief|copydetails|inheritdoc|inheritDoc)\}?[ \t]*([A-Za-z_]\w*)?")
_TAG = re.compile(r"[@\\](param|tparam|returns?|retval|brief|details|short|fn|note|see|sa|file|ingroup|defgroup|addtogroup|name|internal|private|static|throws?|author|date|version|since|deprecated|todo|bug)\b(?:\[[^\]]*\])?")
_RULE = re.compile(r"[-=*~/#_.+<>|!:\\]{3,}")
_NOTES = [  # notes to tools, licences, generated code
    re.compile(r"\b(?:NOLINT(?:NEXTLINE|BEGIN|END)?)\b(?:\([^)]*\))?"),
    re.compile(r"(?i)-?\blint\s+-[a-z]\d*\w*(?:\([^)]*\))?|\b-?(?:e|esym)\(\d+[^)]*\)"),
    re.compile(r"\bcppcheck-suppress(?:-begin|-end|-file)?\b(?:\s+|\[)?[A-Za-z]+\]?"),
    re.compile(r"\bclang-format\s+(?:on|off)\b|\bclang-tidy\b[^\n]*"),
    re.compile(r"\b(?:LCOV|GCOV|GCOVR)_EXCL_\w+"),
    re.compile(r"\bcoverity\s*\[[^\]]*\](?:\s*:\s*\w+)?"),
    re.compile(r"\b(?:PVS|SONAR|NOSONAR|ISTANBUL|SPLINT|IWYU\s+pragma)\b[:\s-]*\S*"),
    re.compile(r"(?i)\bpragma\s+[^\n]*|@suppress\S*|\bfallthrough\b"),
    re.compile(r"SPDX-[\w-]+\s*:\s*[^\s]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+\S+)*"),
    re.compile(r"(?i)(?:copyright\s*(?:\(c\)|©)?|\(c\)|©)\s*\d{4}(?:\s*[-–,]\s*\d{4})*[^.\n]*?(?:(?:authors|contributors|inc|ltd|gmbh)\b\.?|\.|$)", re.M),
    re.compile(r"(?i)all rights reserved\.?"),
    re.compile(r"(?i)\b(?:licen[sc]ed under|released under|distributed under|this (?:file|software|program|source code) is (?:part of|licensed|distributed|free software)|permission is hereby granted|redistribution and use)\b[^.\n]*\.?(?=\s|$)"),
    re.compile(r"(?i)\bsee (?:the )?(?:COPYING|LICEN[SC]E)\b[^.\n]*\.?"),
    re.compile(r"(?i)\b(?:this (?:file|code) (?:was|is) )?(?:auto(?:matically)?[- ]?)generated(?: function)?(?: (?:stub|code|file|by \S+))*\.?(?: do not (?:edit|modify)[^.\n]*\.?)?"),
    re.compile(r"(?i)\bthis (?:file|code) (?:was|is) generated\b[^.\n]*\.?"),
    re.compile(r"(?i)\bgenerated (?:code|file|stub|by \S+|from \S+)\.?|\bdo not (?:edit|modify)\b[^.\n]*\.?"),
    re.compile(r"自动生成(?:的?(?:代码|文件))?[，。]?(?:请勿(?:编辑|修改)[。]?)?"),
]
_TODO = re.compile(r"(?:\b(?:TODO|FIXME|XXX|TBD|HACK|todo|fixme)\b|待补充|待办)(?:\([^)]*\))?[ \t]*[:：-]?[ \t]*")
_OPENERS = re.compile(r"^[ \t]*(?:/\*[*!]*<?|//[/!]*<?|\*+(?!/)|/(?=[=*\-~]{3}))[ \t]?")
_CLOSERS = re.compile(r"[ \t]*\*+/[ \t]*$")
_WORD = re.compile(r"[^\W\d_]")
_PARAM_ONLY = re.compile(r"^[A-Za-z_]\w*$")
_CJK = re.compile(r"[㐀-鿿豈-﫿]")


def is_code(line: str) -> bool:
    """Whether a line of a comment is disabled code."""
    s = line.strip()
    if re.match(r"#\s*(?:define|if|ifdef|ifndef|else|endif|include|undef)\b", s):
        return True
    if not re.search(r"[;{}]\s*$", s) or _CJK.search(s):
        return False
    if re.match(r"[\w\s*&\[\].>-]*(?:[-+*/|&^%]?=)[^=].*[;{]\s*$|[\w.>-]+\s*\(.*\)\s*[;{]|[{}]", s):
        return True
    first = re.match(r"[A-Za-z_]\w*", s)
    return bool(first and first.group() in _CODE_WORDS and re.search(r"[(=;{]", s))


def said(comment: str, name: str) -> str:
    """What is left of a comment beyond signs, rules, the function's name, placeholders, to-dos, notes to tools,
    licence lines, headings, disabled code, notes of generated code and tags without a description; '' if nothing."""
    kept = []
    text = comment.replace("\r\n", "\n").replace("\r", "\n").replace("﻿", "")
    for p in _NOTES:
        text = p.sub(" ", text)
    spoken = re.compile(rf"\b(?:the\s+)?{_spelled(name)}\b(?:\s*\(\s*\))?(?:\s+function\b)?", re.I) if name else None
    for line in text.split("\n"):
        line = _CLOSERS.sub("", line)
        before = None
        while before != line:
            before, line = line, _OPENERS.sub("", line)
        if is_code(line):
            continue
        line = _RULE.sub("\n", line)
        for part in line.split("\n"):
            if _bare(part) in HEADINGS:
                continue
            part = _without_todo(part)
            part = _COPY.sub(" ", part)
            for bit in _tagged_parts(part):
                if spoken:
                    own = spoken.sub(" ", bit)
                    # A name within a sentence belongs to it; a name that opens a line or is all of it says nothing.
                    empty = not _WORD.search(own) or _bare(own) in PLACEHOLDERS
                    bit = own if empty or spoken.match(bit.strip()) else bit
                bare = _bare(bit)
                if not bare or not _WORD.search(bare) or bare in PLACEHOLDERS or bare in HEADINGS:
                    continue
                kept.append(" ".join(bit.split()).strip(" :-–"))
    return "\n".join(kept)


def _spelled(name: str) -> str:
    return r"[_\s]".join(re.escape(p) for p in name.split("_") if p) if name.strip("_") else re.escape(name)


def _bare(s: str) -> str:
    s = re.sub(r"^\W+|\W+$", "", s.replace("_", " ") if not _WORD.search(s) else s)
    s = " ".join(s.lower().split())
    return re.sub(r"^(?:function|func|method|routine|name)\s*[:：]\s*", "", s) if ":" in s or "：" in s else s


def _without_todo(part: str) -> str:
    """Without to-do marks and what they ask for: words up to the next sentence, which a capital or a CJK sign opens."""
    m = _TODO.search(part)
    while m:
        rest = part[m.end() :]
        if m.group().startswith("待"):
            asked = 0
        else:
            n = re.match(r"(?:补充说明|补充注释|写注释|[^\sA-Z㐀-鿿][^\s]*(?:\s+|$))*", rest)
            asked = n.end() if n else 0
        part = part[: m.start()] + " " + rest[asked:]
        m = _TODO.search(part, m.start())
    return part


def _tagged_parts(part: str) -> list[str]:
    """The text ahead of the first tag and the descriptions of the tags, without tags that describe nothing."""
    out, at, tags = [], 0, list(_TAG.finditer(part))
    out.append(part[: tags[0].start()] if tags else part)
    for k, m in enumerate(tags):
        body = part[m.end() : tags[k + 1].start() if k + 1 < len(tags) else len(part)]
        tag = m.group(1)
        if tag in ("param", "tparam", "retval", "throw", "throws"):
            body = re.sub(r"^\s*(?:\[[^\]]*\])?\s*[\w.,*&\[\]]+", "", body, count=1)
        elif tag in ("fn", "file", "ingroup", "defgroup", "addtogroup", "name", "author", "date", "version", "since", "todo", "bug", "internal", "private", "static", "see", "sa"):
            body = ""
        out.append(body)
    return out


def outer_comments(declaration: str) -> str:
    """The comments ahead of and behind the declaration; those among the parameters or within the code are left out."""
    spans, depth, i, n = [], 0, 0, len(declaration)
    code_from, code_to = None, 0
    while i < n:
        two = declaration[i : i + 2]
        if two in ("/*", "//"):
            end = declaration.find("*/", i + 2) if two == "/*" else declaration.find("\n", i)
            end = n if end < 0 else end + (2 if two == "/*" else 0)
            spans.append((i, end))
            i = end
            continue
        c = declaration[i]
        if c in "\"'":
            j = i + 1
            while j < n and declaration[j] != c:
                j += 2 if declaration[j] == "\\" else 1
            code_from, code_to, i = i if code_from is None else code_from, min(j + 1, n), j + 1
            continue
        if not c.isspace():
            code_from, code_to = i if code_from is None else code_from, i + 1
        i += 1
    if code_from is None:
        return "\n".join(declaration[a:b] for a, b in spans)
    return "\n".join(declaration[a:b] for a, b in spans if b <= code_from or a >= code_to)


def documentation(declaration: str | None, comment: str | None) -> str:
    """The comment or, if that is null or blank, the comments around the declaration."""
    own = comment if comment is not None and comment.replace("﻿", "").strip() else None
    return own if own is not None else outer_comments(declaration or "")


def parse_functions(symbols: DataFrame) -> DataFrame:
    """(symbol_id, name, project, full_declaration, documentation, said, copy_of) of the function rows with a non-blank declaration.

    ``said`` is '' for trivial documentation; ``copy_of`` is the function whose documentation is asked for, if any.
    """
    src = symbols.where(normal_type(F.col("type")) == "functions").where(F.col("full_declaration").rlike(r"[^\s\p{Z}\x{FEFF}]"))
    src = src.select("symbol_id", F.coalesce("name", F.lit("")).alias("name"), "project", "full_declaration", "comment")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            docs = [documentation(d, c) for d, c in zip(b["full_declaration"], b["comment"])]
            copies = [m.group(1) if m else None for m in map(_COPY.search, docs)]
            yield pd.DataFrame(
                {
                    "symbol_id": b["symbol_id"], "name": b["name"], "project": b["project"], "full_declaration": b["full_declaration"],
                    "documentation": docs, "said": [said(d, n) for d, n in zip(docs, b["name"])], "copy_of": copies,
                }
            )

    return src.mapInPandas(parse, "symbol_id bigint, name string, project string, full_declaration string, documentation string, said string, copy_of string")


def inherited(parsed: DataFrame) -> DataFrame:
    """(symbol_id, heir): for each undocumented function that names another one, the documented function whose documentation it takes over.

    The nearest documented function along the names is taken, the one of least symbol_id if there are several as near. A name stands for
    all functions of that name in the project, with all that they name.
    """
    known = parsed.where("said <> '' and name <> '' and symbol_id is not null").groupBy("project", "name").agg(F.min("symbol_id").alias("by"))
    links = checkpointed(parsed.where("said = '' and copy_of is not null").select("symbol_id", "project", "name", F.col("copy_of").alias("next")).distinct())
    fresh = known = checkpointed(known)
    while True:
        at = fresh.select(F.col("project").alias("p"), F.col("name").alias("n"), "by")
        met = links.join(at, F.col("project").eqNullSafe(F.col("p")) & (F.col("next") == F.col("n"))).groupBy("project", "name").agg(F.min("by").alias("by"))
        had = known.select(F.col("project").alias("p"), F.col("name").alias("n"))
        fresh = checkpointed(met.join(had, F.col("project").eqNullSafe(F.col("p")) & (F.col("name") == F.col("n")), "left_anti"))
        if fresh.isEmpty():
            break
        known = checkpointed(known.unionByName(fresh))
    at = known.select(F.col("project").alias("p"), F.col("name").alias("n"), F.col("by").alias("heir"))
    return links.join(at, F.col("project").eqNullSafe(F.col("p")) & (F.col("next") == F.col("n"))).groupBy("symbol_id").agg(F.min("heir").alias("heir"))


def function_pairs(symbols: DataFrame) -> DataFrame:
    """(symbol_id, full_declaration, documentation, description): functions paired with what their documentation says.

    Functions whose documentation is empty or trivial are dropped, as are blank declarations. Repeated symbol_ids come out
    once; rows without symbol_id are kept under null, once for all. An empty table gives no rows, other columns are ignored.
    Documentation that only names another function takes over that one's, through any number of steps; a cycle of names documents nothing.
    """
    ship(symbols.sparkSession)
    parsed = parse_functions(symbols)
    asks = F.concat_ws(" ", "comment", "full_declaration").rlike(r"[@\\]\{?(?:copydoc|copybrief|copydetails|inherit[dD]oc)")
    tagged = not symbols.where(asks).limit(1).isEmpty()
    if tagged:
        parsed = checkpointed(parsed)
    pairs = parsed.where("said <> ''").select("symbol_id", "full_declaration", "documentation", F.col("said").alias("description"))
    if tagged:
        heirs = inherited(parsed)
        texts = pairs.select(F.col("symbol_id").alias("heir"), "documentation", "description").dropDuplicates(["heir"])
        waiting = parsed.where("said = '' and copy_of is not null").select("symbol_id", "full_declaration").dropDuplicates(["symbol_id"])
        pairs = pairs.unionByName(waiting.join(heirs, "symbol_id").join(texts, "heir").select("symbol_id", "full_declaration", "documentation", "description"))
    return pairs.dropDuplicates(["symbol_id"])
