import pytest

from lodestrata.llm import funcdocs as D

TRIVIAL = [
    "", " ", "　\n", "/* */", "/** */", "//", "///", "/**\n *\n */", "/*******/", "~~~~~~~~", "...", "foo_bar", "foo_bar()", "/* foo_bar */", "foo bar", "Foo bar function.", "the foo_bar function", "Function: foo_bar",
    "@brief foo_bar", "@fn foo_bar", "@brief", "@param n\n@return", "/**\n * @param[in] n\n * @param[out] m\n */", "\\brief\n\\param n", "TODO", "// TODO(dev): comment", "TODO: document", "FIXME add description", "XXX check this later",
    "todo write docs", "TODO 补充说明", "待补充", "无", "暂无", "n/a", "None", "no comment", "No description", "undocumented", "NOLINT", "NOLINTNEXTLINE(bugprone)", "lint -e534", "cppcheck-suppress unusedFunction", "clang-format off",
    "LCOV_EXCL_START", "coverity[dead_code]", "SPDX-License-Identifier: Pelt-1.2", "Copyright (c) 2021 the x authors. All rights reserved.", "(C) 2019-2024 y contributors", "Licensed under the Open Reed License, see COPYING for details.",
    "Auto-generated function stub", "autogenerated by cproto", "This file was generated. Do not edit.", "自动生成", "Generated code", "***** Init *****", "/* ---- Private functions ---- */", "内部函数", "Public API", "static", "(private)", "Internal.",
    "forward declaration", "helper", "description", "#define A 1", "int deda = 2477;", "// free(foo_bar); foo_bar = NULL;", "return foo_bar(x);", "if (x) { y(9); }", "/=====\n** NOLINTNEXTLINE\n=====/",
]
TELLING = [
    "Counts raw entries.", "// Frees the block.", "/** Waits for the list. */", "/**< Swaps both halves. */", "foo_bar: Swaps both halves.", "foo_bar() -- Frees the mask.", "foo_bar - Frees it now", "@brief  Waits for the ring.", "\\brief 释放所有节点。",
    "TODO: rename Copies up to 4073 bytes.", "FIXME Grows the packet.", "NOLINTNEXTLINE 调用者负责释放返回的内存。", "Copyright (c) 2021 the x authors. All rights reserved. 调用者负责释放返回的内存。", "Licensed under the Open Reed License, see COPYING for details. Frees it.",
    "SPDX-License-Identifier: Pelt-1.2\nSwaps both halves.", "/====\n** XXX check this later\n** Counts first entries.\n====/", "Entfernt den ältesten Eintrag.", "@return zero on success", "Must be called before foo_bar is shared.", "/* int a = 1; */\n/* Frees it. */",
]


@pytest.mark.parametrize("comment", TRIVIAL)
def test_trivial(comment):
    assert D.said(comment, "foo_bar") == ""


@pytest.mark.parametrize("comment", TELLING)
def test_telling(comment):
    assert D.said(comment, "foo_bar")


@pytest.mark.parametrize(
    "decl,want",
    [
        ("/** Frees it. */ void f(int a /* owned */);", "/** Frees it. */"), ("void f(int a /* owned */);  /**< Frees it. */", "/**< Frees it. */"), ("// a\n// b\nvoid f(void)", "// a\n// b"),
        ("void f(\n  int a, // first\n  int b) // tail", "// tail"), ("void f(char *s = \"/* no */\");", ""), ("/* only */", "/* only */"), ("", ""), ("void f(void) /* open", "/* open"),
    ],
)
def test_outer_comments(decl, want):
    assert D.outer_comments(decl) == want


SYM = "symbol_id bigint, name string, type string, project string, full_declaration string, comment string, documentation string"


def test_pairs(spark):
    data = [
        (1, "f", " 'Function' ", "p", "void f();", "Frees it."), (1, "f", " 'Function' ", "p", "void f();", "Frees it."), (2, "f", "macros", "p", "#define F", "Frees it."), (3, "g", "function_proto", "p", " ", "Frees it."),
        (4, "g", "function_proto", "p", None, "Frees it."), (5, "h", "functions", "p", "// Waits.\nvoid h();", " "), (6, "h", "functions", "p", "// Waits.\nvoid h();", "TODO"), (7, "i", "functions", "p", "void i(int a /* Frees a. */);", None),
        (8, "j", "functions", "p", "void j();", "@copydoc f"), (9, "k", "functions", "p", "void k();", "@copydoc j"), (10, "l", "functions", "q", "void l();", "@copydoc f"), (11, "m", "functions", "p", "void m();", "@copydoc m"), (12, None, None, None, None, None),
        (13, None, "functions", None, "x" * 100_000, "Waits."),
    ]
    df = spark.createDataFrame([(*d, "clash") for d in data], SYM)
    got = {x.symbol_id: x.description for x in D.function_pairs(df).collect()}
    assert got == {1: "Frees it.", 5: "Waits.", 8: "Frees it.", 9: "Frees it.", 13: "Waits."}
    assert len(D.function_pairs(df).collect()) == len(got)
    assert D.function_pairs(df.where("false")).collect() == []


def test_long_chains_and_cycles(spark):
    chain = [(i, f"c{i}", "functions", "p", f"void c{i}();", "Frees it." if i == 0 else f"@copydoc c{i - 1}", None) for i in range(21)]
    ring = [(100 + i, f"r{i}", "functions", "p", f"void r{i}();", f"@copydoc r{(i + 1) % 5}", None) for i in range(5)]
    fork = [(200, "s", "functions", "p", "static void s();", "@copydoc r0", None), (201, "s", "functions", "p", "static void s();", "@copydoc c20", None), (202, "t", "functions", "p", "void t();", "@copydoc s", None), (203, "u", "functions", None, "void u();", "@copydoc v", None), (204, "v", "functions", None, "void v();", "Waits.", None)]
    got = {x.symbol_id: x.description for x in D.function_pairs(spark.createDataFrame(chain + ring + fork, SYM)).collect()}
    assert got == {**{i: "Frees it." for i in range(21)}, 201: "Frees it.", 202: "Frees it.", 203: "Waits.", 204: "Waits."}
