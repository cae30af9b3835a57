import re
import time
from html import unescape

import pytest

from sparrowsql.llm import html_text
from sparrowsql.llm.common import table

CASES = [
    ("", ""),
    ("plain  text\n here", "plain text here"),
    ("<p>a<p>b", "a\n\nb"),
    ("<div>a</div><div>b<br>c</div>", "a\nb\nc"),
    ("<ul><li>x<li>y</ul>z", "- x\n- y\n\nz"),
    ("<ol start=3><li>x<ul><li>in</ul><li>y</ol>", "3. x\n   - in\n4. y"),
    ("<table><tr><td>a<td>bbb<tr><td>cc<td>d</table>", "a  | bbb\ncc | d"),
    ("<table><tr><th colspan=2>wide one<tr><td>a<td>b</table>", "wide one\na | b"),
    ("<table><tr><td>a<table><tr><td>i<td>j</table><td>b</table>", "a i | j | b"),
    ("<table><tr><td>日本<td>x<tr><td>abcd<td>y</table>", "日本 | x\nabcd | y"),
    ("<pre>  a\n b</pre>", "  a\n b"),
    ("a<script>var t='</p>';x</script>b<style>p{}</style><!-- c -->d", "abd"),
    ("<head><title>T</title></head><body>x", "x"),
    ("<p hidden>no</p><p style='display: none'>no</p><p>yes", "yes"),
    ("<style>.gone, #x{display:none}</style><p class='a gone'>no</p><b id=x>no</b>yes", "yes"),
    ("<details><summary>S</summary>gone</details><details open><summary>T</summary>shown</details>", "S\nT\nshown"),
    ("&lt;b&gt; &amp;amp; &eacute;", "<b> &amp; é"),
    ("<b>a</b><i> b</i>", "a b"),
    ("<dl><dt>T<dd>D<dt>U<dd>E</dl>", "T\n  D\nU\n  E"),
    ("a < b <c", "a < b"),
    ("<h1>H<h2>G</h2>t", "H\n\nG\n\nt"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_cases(page, text):
    assert html_text.render(page) == text


def test_deep_and_long_pages():
    assert html_text.render("<div>" * 50_000 + "x") == "x"
    assert html_text.render("<table><tr><td>" * 300 + "x").strip() == "x"
    assert len(html_text.render("<p>word " * 50_000)) == 50_000 * 6 - 2
    for broken in ("<", "</", "<a href='", "<!--", "<table><td></table></tr></p>", "<li></ul>", "</li></table>", "<td>a</td>", "<![CDATA["):
        html_text.render(broken)


def brute_words(page):
    """Words that stand outside head, script, style and comments, by deletion."""
    page = re.sub(r"(?s)<!--.*?-->|<(script|style|title)\b.*?</\1>", "", page)
    return re.sub(r"<[^>]*>", lambda m: "" if re.match(r"</?(b|a|i)\b", m[0]) else " ", page)


def test_all_visible_words_in_order(spark, sf):
    pages = table(spark, sf, "pages")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        want = unescape(brute_words(r.html)).split()
        said = [w for w in got[r.page_id].split() if w != "-"]
        assert said == [w for w in want if w != "-"]


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "<p>x", "c"), (3, "<p>x", "d"), (3, "<p>x", "d")]
    frame = spark.createDataFrame(rows, "page_id long, html string, text string")
    assert sorted((str(r.page_id), r.text) for r in html_text.extract(frame).collect()) == [("1", ""), ("2", ""), ("3", "x"), ("3", "x"), ("None", "x")]
    assert html_text.extract(frame.limit(0)).count() == 0


SHEETS = [
    ("@media print { .side { display:none } .x{color:red} }", "side\nx\nlast"),
    ("@media print { body {display:none} }", "side\nx\nlast"),
    ("@media screen and (max-width: 600px) { .side{display:none} } .x{display:none}", "side\nlast"),
    ("@media screen { .side{display:none} } @media all{.x{display:none}}", "last"),
    ("@media print, only screen { .side{display:none} }", "x\nlast"),
    ("@media not print { .side{display:none} } @media not screen { .x{display:none} }", "x\nlast"),
    ("@media print { @supports (display:grid) { .x{display:none} } } .side{display:none}", "x\nlast"),
    ("@layer a { @media screen { .side{color:red; display:none} } }", "x\nlast"),
    ("@font-face { font-family: a } @keyframes k { from {display:none} } .side{display:none}", "x\nlast"),
    ("@import 'a;{b'; .side::before{content:'}'} .x{display:none", "side\nlast"),
    (".side { color:red; .x { display:none } }", "side\nx\nlast"),
    ("@media print {" * 5000 + ".x{display:none}", "side\nx\nlast"),
]


@pytest.mark.parametrize(("sheet", "text"), SHEETS)
def test_sheets_hide_what_a_screen_hides(sheet, text):
    assert html_text.render(f"<style>{sheet}</style><body><p class=side>side</p><p class=x>x</p><p>last").replace("\n\n", "\n") == text


DRAWN = [
    ("a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b", "a x=1 b"),
    ("<math><semantics><mi>x</mi><annotation>\\x</annotation></semantics></math>", "x"),
    ("<svg><title>t</title><desc>d</desc><defs><text>no</text></defs><text>A<tspan>B</tspan></text><text>C</text><path d='M0'/></svg>z", "AB\nC\nz"),
    ("<svg><foreignObject><p>in</p><desc>shown</desc></foreignObject></svg>", "in\n\nshown"),
    ("<p>x<desc>y</desc>", "xy"),
    ("<style media=print>p{display:none}</style><p>x", "x"),
]


@pytest.mark.parametrize(("page", "text"), DRAWN)
def test_drawings_and_formulas(page, text):
    assert html_text.render(page) == text


HARD = [
    "<div>", "<p><button><div>", "<ul><li>", "<ol><li>x", "<table><tr><td>", "<table><tr><td>x", "<span><li>", "<p><b>", "</p>", "</div>", "<h1>", "<dl><dd>",
    "<a ", "<a b='", '<a b="x', "<!--", "<![CDATA[", "<td colspan=1000>x", "<tr><td>a<td>b", "&amp;", "<blockquote>q", "<details><summary>s", "<svg><text>t", "<style>a{", "<option>",
]


@pytest.mark.parametrize("part", HARD)
def test_time_and_text_grow_with_the_page(part):
    took, size = {}, {}
    for n in (4_000, 4_000, 40_000):
        page = (part * (n // len(part) + 1)) * 4 + "'\"" + "x" * n + "<td>" * 3 + "y"
        began = time.perf_counter()
        size[n] = len(html_text.render(page))
        took[n] = time.perf_counter() - began
    assert took[40_000] < 30 * took[4_000] + 0.3
    assert size[40_000] < 12 * size[4_000] + 1_000


def test_layout_bounds_drop_no_text():
    assert html_text.render("<ul><li>" * 100 + "deep").split()[-1] == "deep"
    long = "w" * 500
    assert html_text.render(f"<table><tr><td>{long}<td>b<tr><td>c<td>d</table>") == f"{long} | b\nc{' ' * 119} | d"
    assert html_text.render("<table><tr><td>" * 12 + "in" + "<td>side</table>" * 12).count("side") == 12


def test_quotes_count_after_an_equals_sign_only():
    assert html_text.render("<p class=it's>a</p><p it's>b</p>") == "a\n\nb"
    assert html_text.render("a<p title='x > y'>b<p title=\"it's\">c") == "a\n\nb\n\nc"
