"""Column functions on chosen cases."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import python as P
from docloom.functions import text as T


def values(spark, column, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(column(F.col("t"))).collect()]


def test_frontmatter_needs_a_line_before_its_end(spark):
    assert values(spark, T.body_of, "---\na: b\n---\nx", "---\n---\nx", "---\r\na: b\r\n---", "x\n---\na: b\n---\n") == ["x", "---\n---\nx", "", "x\n---\na: b\n---\n"]


def test_truncate_cuts_at_a_late_space(spark):
    assert values(spark, lambda c: T.truncate(c, 10), "0123456789", "0123456 89x", "01 3456789x", "abcdefgh  xyz") == ["0123456789", "0123456…", "01 3456789…", "abcdefgh…"]


def test_first_sentence_skips_markup(spark):
    cases = {"# Head\n\n> quote\n| a | b |\nReal one. Two.": "Real one.", "```\ncode. x\n```\nAfter!": "After!", "v1.2 is out? yes": "v1.2 is out?", "\n\n": "", "```\nopen fence. x": "```\nopen fence. x".split("\n")[0]}
    assert values(spark, T.first_sentence, *cases) == list(cases.values())


def test_cells(spark):
    assert values(spark, T.sanitize_cell, "a\t b\n c", "  ﻿ ", "") == ["a b c", "-", "-"]
    assert values(spark, T.normalize_kind, "BigQuery  Table!", "__", "Ünï") == ["bigquery_table", "-", "n"]
    assert values(spark, T.stale_date, " 2024-02-31 ", "2024-2-3", "soon") == ["2024-02-31", "", ""]


@pytest.mark.parametrize(
    "target, path, want",
    [
        ("./b.md", "a/x.md", "a/b.md"),
        ("../b", "a/x.md", "b.md"),
        ("../../../b.MD", "a/x.md", "b.MD"),
        ("/r/s.md#part", "a/x.md", "r/s.md"),
        ("#part", "a/x.md", None),
        ("mailto:x@y", "a/x.md", None),
        ("b%20c.md?q", "x.md", "b c.md"),
        ("b+c.md", "x.md", "b+c.md"),
        ("b%zz.md", "x.md", "b%zz.md"),
    ],
)
def test_resolve_target(spark, target, path, want):
    assert spark.range(1).select(T.resolve_target(F.lit(target), F.lit(path))).first()[0] == want


def test_links_in_fences_and_images_count(spark):
    assert values(spark, T.link_targets, '![i](a.png) [x]( b.md "T" )\n```\n[y](c.md)\n```') == [["a.png", "b.md", "c.md"]]


def test_heading_title_after_fence(spark):
    assert values(spark, T.heading_title, "text\n## A  b \nc", "```\n# x\n```\n# y", "none") == ["A b", "", ""]


def test_find_offsets_fold_only_where_offsets_stay(spark):
    assert values(spark, lambda c: T.find_offsets(c, "Ab"), "abABab", "aaa", "") == [[0, 2, 4], [], []]
    assert values(spark, lambda c: T.find_offsets(c, ".E"), "a.E.e\\E") == [[1, 3]]


def test_tokens_agree_with_the_exact_tokenizer(spark):
    texts = ["Café au läit, Ñuñez 42x", "Żółw ß ı", "a_b-c"]
    for text, found in zip(texts, values(spark, T.tokens, *texts)):
        assert found == P.terms(text)
    vetted = spark.createDataFrame([("café",), ("日本",), ("ﬁ",), ("x",)], "t string").select(T.is_vetted(F.col("t"))).collect()
    assert [r[0] for r in vetted] == [True, False, False, True]
    assert P.terms("ﬁsh ½ 日本 İ") == ["fish", "1", "2", "日本", "i"]


def test_every_vetted_letter_folds_alike(spark):
    letters = [chr(c) for c in range(0xA0, 0x250)]
    rows = spark.createDataFrame([(c, f"x{c}y {c}") for c in letters], "c string, t string").select("c", "t", T.is_vetted(F.col("t")).alias("v"), T.tokens(F.col("t")).alias("k")).collect()
    assert [r["c"] for r in rows if r["v"] and r["k"] != P.terms(r["t"])] == []


def test_sections():
    body = "intro\n# A\nx\n```\n# no\n```\n## A\n# A 2\n# Body\n"
    assert [(n, body[s:e]) for n, s, e in P.sections(body)] == [("body", "intro\n"), ("a", "# A\nx\n```\n# no\n```\n"), ("a_2", "## A\n"), ("a_2_2", "# A 2\n"), ("body_2", "# Body\n")]
    assert P.sections("") == []
    assert P.sections("```\n# x\n") == [("body", 0, 8)]


def test_window_start():
    filler = "z" * 3000
    assert P.window_start(f"{filler} alpha beta {filler}", "alpha beta") == 3001 - (2000 - 10) // 2
    assert P.window_start("alphabet", "alpha") is None
    assert P.window_start("", "x") is None
    text = f"alpha {filler} alpha beta"
    assert P.window_start(text, "beta alpha") == len(text) - 2000


def test_yaml_heads():
    assert P.parse_head("type: T\ngrain: 3\nok: yes\n") == ({"type": "T", "grain": None, "ok": "yes"}, None)
    assert P.parse_head("- a\n")[1] == "frontmatter is not a mapping"
    assert P.parse_head("a: [\n")[1].startswith("invalid YAML frontmatter: ")
    assert P.parse_head('d: "a\\tb"\n')[0] == {"d": "a\tb"}
