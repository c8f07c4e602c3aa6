"""HTML extraction: hostile markup, hidden text at any depth, spanned cells, tables of odd rows."""

import random
import re

import pytest
from prosegauge.llm.html_text import DEPTH, extract, page_text


@pytest.mark.parametrize("depth", [0, 5, DEPTH - 2, DEPTH, DEPTH + 50])
@pytest.mark.parametrize("hide", ["hidden", "style='display:none'", "style='visibility: hidden'"])
def test_hidden_text_never_shows_at_any_depth(depth, hide):
    down, up = "<div>" * depth, "</div>" * depth
    assert "".join(page_text(f"{down}a<div {hide}>SECRET<div>SECRET</div>SECRET</div>b{up}c").split()) == "abc"
    inside = f"<div {hide}>{down}SECRET{up}SECRET</div>shown"
    assert page_text(inside) == "shown"


def test_visible_inside_hidden_shows():
    assert page_text("<div style='visibility:hidden'>no <b style='visibility:visible'>yes</b> no</div>z") == "yes\nz"
    assert page_text("<div style='display:none'>no <b style='visibility:visible'>no</b></div>z") == "z"


def test_spans_that_are_no_numbers():
    assert page_text("<table><tr><td colspan='²'>a<td rowspan=x>b<td colspan=-3>c</table>") == "a  b  c"
    assert page_text(f"<table><tr><td colspan={'9' * 5000}>a<td>b</table>") == "a  b"


def test_rows_below_a_spanned_cell_keep_their_columns():
    assert page_text("<table><tr><td rowspan=2>aa<td>b<tr><td>c<tr><td>d<td>e</table>") == "aa  b\n    c\nd   e"
    assert page_text("<table><tbody><tr><td rowspan=0>aa<td>b<tr><td>c</tbody><tbody><tr><td>d</table>") == "aa  b\n    c\nd"


def test_quotes_open_values_only_after_an_equals_sign():
    assert page_text('<p title=5">one</p> two <a href="x">three</a>').split() == ["one", "two", "three"]
    assert page_text("<p it's>one</p> two").split() == ["one", "two"]
    assert page_text('<p title="a > b">one') == "one"


BITS = ["<div>", "</div>", "<p>", "</p>", "<table>", "<tr>", "<td rowspan=2>", "<td colspan=3>", "</table>", "<li>", "<ul>", "</ul>", "<b>", "</b>", " word ", "<!-- c -->", "<", "&amp;", "<pre>", "</pre>", "<td>", "<th>", "<button>", "<span hidden>SECRET</span>", "<div style='display:none'>SECRET</div>", "<script>SECRET</script>"]


def test_random_markup_never_fails_and_shows_no_hidden_text():
    rng = random.Random(1)
    for _ in range(400):
        page = "".join(rng.choice(BITS) for _ in range(rng.randrange(300)))
        # An opening sign with a name right after it would make a tag of its own; here none does.
        page = re.sub(r"<(?=<)", "", page)
        text = page_text(page)
        assert "SECRET" not in text and text.count("word") == page.count(" word ")


def test_odd_tables_of_pages(spark):
    rows = [(None, "<p>x", "k"), (1, None, "k"), (1, None, "k"), (2, "<p>y", None), (2, "<p>y", None), (3, "<div>w</div>" * 40000, "k")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string, text string").selectExpr("*", "1 as n_chars")
    got = sorted(((r.page_id, r.n_chars, r.text[:3]) for r in extract(pages).collect()), key=str)
    assert got == sorted([(None, 1, "x"), (1, 0, ""), (1, 0, ""), (2, 1, "y"), (2, 1, "y"), (3, 79999, "w\nw")], key=str)
    assert extract(pages.limit(0)).count() == 0


def test_what_shows_and_what_does_not():
    for page, want in {
        "<p aria-hidden=true>icon</p>": "icon",
        "<form><input type=submit value=Send><input type=text value=x></form>": "Send",
        "<p style=\"content:'display:none'\">shown</p>": "shown",
        "<p style='DISPLAY : none !important'>gone</p>": "",
        "<p style='color:red;display:none;display:block'>shown</p>": "shown",
        "<dialog>gone</dialog><dialog open>shown</dialog>": "shown",
    }.items():
        assert page_text(page).strip() == want, page


def test_tables_do_not_grow():
    wide = "<table><tr><td>" + "x" * 100_000 + "<td>y" + "<tr><td>a<td>b" * 1000 + "</table>"
    text = page_text(wide)
    assert len(text) < 120_000 and text.count("a  b") == 1000
    spans = "<table>" + "<tr><td rowspan=65534>a" * 3000 + "</table>"
    assert len(page_text(spans)) < 50 * len(spans)
    tall = "<table><tr>" + "<td>a" * 2000 + "<td>" + "b<br>" * 5000 + "</table>"
    assert len(page_text(tall)) < 50 * len(tall)


def plain_table(rows):
    """Each cell at the place where its column begins, a column as wide as its widest cell of up to 60 characters."""
    width = [max([len(r[k]) for r in rows if k < len(r) and len(r[k]) <= 60], default=0) for k in range(max(map(len, rows)))]
    out = []
    for r in rows:
        line = ""
        for k, cell in enumerate(r):
            if cell:
                at = sum(w + 2 for w in width[:k])
                line = line.ljust(max(at, len(line) + 2) if line else at) + cell
        out.append(line)
    return "\n".join(out)


def test_tables_equal_a_plain_layout():
    import random

    rng = random.Random(8)
    for _ in range(300):
        rows = [["x" * rng.choice([0, 1, 2, 3, 9, 60, 61, 75]) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 5))]
        page = "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
        got = page_text(page)
        assert got.strip("\n") == plain_table(rows).strip("\n"), rows
