"""Blocks of Markdown documents, hostile inputs, growth with the size of a document."""

import time

import pytest
from prosegauge.operators.markdown import structure
from prosegauge.plans.audit import audit

#: Name -> (document, its paragraphs, its headings).
SHAPES = {
    "fences end at their own kind": ("~~~\n```\n~~~\n\nshown", ["shown"], []),
    "a longer fence holds a shorter": ("````\n```\ncode\n````\nshown", ["shown"], []),
    "a closing fence has no info": ("```\n``` x\n```\nshown", ["shown"], []),
    "ticks in the info open no fence": ("``` a`b\nshown", ["``` a`b\nshown"], []),
    "a fence ends with its quote": ("> ```\n> code\nshown", ["shown"], []),
    "a fence in an item": ("- ```\n  code\n  ```\n- two", ["two"], []),
    "a comment over lines": ("one\n<!-- a\nb --> two\nthree", ["one", "two\nthree"], []),
    "a comment cut short": ("<!--> shown", ["shown"], []),
    "a comment stays in its quote": ("> <!-- a\nshown", ["shown"], []),
    "a declaration": ("<!DOCTYPE html>\nshown", ["shown"], []),
    "lazy lines": ("> one\ntwo\n\nthree", ["one\ntwo", "three"], []),
    "nested quotes": ("> > one\n> two\n>\n> three", ["one\ntwo", "three"], []),
    "items": ("- one\n- two\n  more\n\n  deeper", ["one", "two\nmore", "deeper"], []),
    "only 1 interrupts": ("in the year\n2024. It rained\n1. item", ["in the year\n2024. It rained", "item"], []),
    "an empty mark interrupts nothing": ("one\n*\ntwo", ["one\n*\ntwo"], []),
    "tasks": ("- [ ] do it\n- [x] done", ["do it", "done"], []),
    "code in an item": ("-     code\n\n  text", ["text"], []),
    "alerts": ("> [!WARNING]\n> careful\n\n> text\n> [!NOTE]", ["careful", "text\n[!NOTE]"], []),
    "setext": ("Head\nline\n===\nbody\n---", [], ["Head line", "body"]),
    "atx": ("# One #\n####### no\n#x\n## ", ["####### no\n#x"], ["One", ""]),
    "rules": ("one\n***\ntwo\n- - -\nthree", ["one", "two", "three"], []),
    "indented": ("    code\n\ntext\n    more", ["text\nmore"], []),
    "front matter": ("---\na: b\n---\ntext", ["text"], []),
    "no front matter": ("---\nplain words here\n---\ntext", ["text"], ["plain words here"]),
    "tables": ("a | b\n- | -\nc | d\ntext", ["a | b", "| -\nc | d\ntext"], []),
    "tables with cells": ("|a|b|\n|-|-|\n|c|d|\ntext", ["text"], []),
    "definitions": ("[x]: /y\n[X]: </y z> 'title'\n[^n]: note\ntext [x]", ["[^n]: note\ntext x"], []),
    "links": ("see [a\nb](c\nd) e ![f [g](h)](i)", ["see a\nb\n e f g"], []),
    "unclosed": ("see [a](b and [c", ["see [a](b and [c"], []),
    "code and escapes": ("`[a](b)` \\[c](d) `` ` ``", ["`[a](b)`\x04 [c](d) `` ` ``\x04"], []),
    "tags": ("a <b title='>'>c</b> <!-- d --> e < f", ["a  c    e < f"], []),
    "tabs": ("\tcode\n-\titem\n\n\tmore", ["item", "more"], []),
}


@pytest.mark.parametrize("name", SHAPES)
def test_shapes(name):
    text, paragraphs, headings = SHAPES[name]
    got = structure(text)
    assert ([b["text"] for b in got["blocks"]], [h["text"] for h in got["headings"]]) == (paragraphs, headings)


def test_lines_of_blocks():
    text = "---\na: b\n---\n\n> one\n> two\n\n```\nx\n```\n- item\n\n<!--\n-->\nlast"
    assert [(b["line"], b["text"]) for b in structure(text)["blocks"]] == [(5, "one\ntwo"), (11, "item"), (15, "last")]


LINKS = {
    "See [click\nhere](/x)": ["click\nhere"],
    "See [here][a] [b] [c][]\n\n[a]: /x\n[c]: /z": ["here", "c"],
    "[![alt](i.png)](/x)": ["![alt](i.png)", "alt"],
    "`[here](/x)` \\[here](/x) <!-- [here](/x) -->": [],
    "[a]( ) [b]()": [],
}


@pytest.mark.parametrize("text", LINKS)
def test_links(text):
    assert [x["label"] for x in structure(text)["links"]] == LINKS[text]


HOSTILE = {
    "empty lines in front": "\n" * 1_000_000 + "We shall go.",
    "blank lines between": "x\n" + " \n" * 1_000_000 + "We shall go.",
    "backticks": "`" * 200_000 + " x",
    "uneven backticks": "` `` " * 20_000,
    "brackets": "[" * 200_000,
    "open links": "[a](" * 50_000,
    "markers": "*" * 200_000,
    "stop and markers": "a." + "*" * 1_000_000 + " B",
    "quotes": "> " * 20_000 + "x",
    "items": "- " * 20_000 + "x",
    "nested labels": "[" * 200_000 + "x" + "](y)" * 200_000,
    "nested images": "![" * 50_000 + "x" + "](y)" * 50_000,
    "nested references": "[" * 50_000 + "x" + "][]" * 50_000 + "\n\n[x]: /y",
    "nested labels over lines": "[ \n" * 50_000 + "x" + "](y)" * 50_000,
    "deep items": "\n".join("  " * k + "- x" for k in range(1500)),
    "comments": "<!-- x --> y " * 20_000,
    "open comments": "<!-- " * 50_000,
    "tags": "<a href='x'>" * 20_000,
    "tables": "|a||\n|-|-|\n\n" * 10_000,
    "dots": "a. " * 200_000,
    "capitals": "ABC " * 100_000,
    "one word": "w" * 2_000_000,
    "letters of two kinds": "eé" * 500_000,
    "control characters": "\x01\x02 shall \x03\x04.",
}


def test_hostile_documents_neither_fail_nor_stall(spark):
    corpus = spark.createDataFrame(list(HOSTILE.items()), "doc string, text string").repartition(8)
    began = time.time()
    found = {(r.doc, r.line) for r in audit(corpus).where("rule = 'legalese'").collect()}
    assert found == {("empty lines in front", 1_000_001), ("blank lines between", 1_000_002), ("control characters", 1)}
    assert time.time() - began < 180


def test_long_labels_are_judged_alike(spark):
    """Labels are cut where no rule reads on: blank ones, vague ones and addresses are found at any length."""
    gap = " " * 3000
    texts = {
        f"[{gap}](/x)": "link has no text",
        f"[click{gap}here](/x)": '"click here"',
        f"[**{gap}https://a.b/{'c' * 2000}**](/x)": "https://a.b/ccc",
        f"[click here {'and more ' * 300}](/x)": None,
        f"[{'and more ' * 300}click here](/x)": None,
        f"![{gap}](/x)": "image has no alternative text",
        f"![{'a view ' * 300}](/x)": None,
        "[a [b](/c) " + "d " * 600 + "](/e)": None,
    }
    rows = audit(spark.createDataFrame(list(enumerate(texts)), "doc bigint, text string"), only=["link-text", "image-alt"]).collect()
    got = {r.doc: r.detail for r in rows}
    for k, want in enumerate(texts.values()):
        assert (want is None) == (k not in got) and (want is None or want in got[k]), k


def test_nested_links_and_items_in_reasonable_time():
    def seconds(make, n):
        began = time.time()
        out = structure(make(n))
        return time.time() - began, sum(len(x["label"]) for x in out["links"])

    for make in (lambda n: "[" * n + "x" + "](y)" * n, lambda n: "[`" * n + "a" + "](x)" * n):
        took, size = seconds(make, 30_000)
        assert took < 15 and size < 300 * 30_000
    assert seconds(lambda n: "\n".join("  " * k + "- x" for k in range(n)), 2000)[0] < 10


def test_findings_far_down_have_their_line(spark):
    text = "ok\n\n" * 3000 + " ".join(["word"] * 31) + ".\n\n" + "ok\n\n" * 3000 + "We shall utilise it in order to go."
    rows = audit(spark.createDataFrame([(1, text)], "doc bigint, text string")).collect()
    assert {(r.rule, r.line) for r in rows} == {("sentence-length", 6001), ("legalese", 12003), ("complex-word", 12003), ("wordy-phrase", 12003)}


@pytest.mark.parametrize("rule", ["sentence-length", "complex-word"])
def test_growth_is_linear(spark, rule):
    line = " ".join(["word"] * 31) + ". utilise\n"

    def seconds(n):
        corpus = spark.createDataFrame([(1, line * n)], "doc bigint, text string")
        began = time.time()
        assert audit(corpus, only=[rule]).count() >= n - 1
        return time.time() - began

    base = min(seconds(10) for _ in range(2))
    small, large = (max(0.3, min(seconds(n) for _ in range(2)) - base) for n in (4000, 12000))
    assert large / small < 5


def test_white_space_beyond_ascii(spark):
    text = "One\u00a0two. Three\u2003four\u00a0shall.\n\u00a0\nUtilise\ufeffit."
    rows = audit(spark.createDataFrame([(1, text), (2, text + "\n\n# x")], "doc bigint, text string")).collect()
    want = {("legalese", 1), ("complex-word", 3)}
    assert {(r.rule, r.line) for r in rows if r.doc == 1} == want == {(r.rule, r.line) for r in rows if r.doc == 2}


ACRONYMS = {
    "The EBITDA report is ready.\n\nA gap.\n\nEarnings before interest, taxes, depreciation and amortisation (EBITDA) is it.": ["EBITDA"],
    "The EBITDA report (draft) is ready.": ["EBITDA"],
    "EBITDA means (earnings before interest, taxes, depreciation and amortisation).": [],
    "The result changed because (EBITDA fell sharply).": ["EBITDA"],
    "The appendix labels the measure (EBITDA). Later, EBITDA appears.": ["EBITDA"],
    "# Cascading Style Sheets (CSS)\n\nCSS helps.": [],
    "| Cascading Style Sheets (CSS) | x |\n|---|---|\n| a | b |\n\nCSS helps.": [],
    "- Cascading Style Sheets (CSS)\n\nCSS helps.": [],
    "```\nCascading Style Sheets (CSS)\n```\n\nCSS helps.": ["CSS"],
    "Cascading of the in to a an on for and of the in to a an on for Style Sheets (CSS) helps. CSS is.": [],
    "CSS (Cascading of the in to a an on for and of the in to a an on for and of the Style Sheets) helps.": [],
    "CSS (Cascading Style Sheets and more) helps.": ["CSS"],
}


def test_acronyms_are_defined_anywhere_that_shows(spark):
    corpus = spark.createDataFrame(list(enumerate(ACRONYMS)), "doc bigint, text string")
    got = {}
    for r in audit(corpus, only=["acronym-undefined"]).collect():
        got.setdefault(r.doc, []).append(r.detail.split('"')[1])
    assert got == {k: v for k, v in enumerate(ACRONYMS.values()) if v}
