import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import htmltext
from tickloom.llm.htmltext import render

CASES = {
    None: "", "": "", "plain": "plain", "<p>a<p>b": "a\n\nb", "<div>a<div>b</div>c</div>": "a\nb\nc", "a <b> b </b> c": "a b c", "a<b>b</b>c": "abc", "a<br><br>b": "a\n\nb",
    "<title>t</title><script>if (a</b) x</script><style>p{}</style>x<!-- c -->y": "xy", "<p hidden>h</p><p style='color:red; DISPLAY : none'>n</p>v": "v",
    "<div style='visibility:hidden'>a<i style='visibility:visible'>b</i></div>": "b", "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "- a\n- b\n  - c\n- d",
    "<ol start=9><li>a<li value=20>b<li>c</ol>": "9. a\n20. b\n21. c", "<ul><li><p>a</p><p>b</p></ul>": "- a\n\n  b", "<pre>\n a  b\n</pre>": " a  b",
    "<table><tr><td>a<td>bb<tr><td>cccc<td>d</table>": "a     bb\ncccc  d", "<table><caption>t</caption><tr><th colspan=2>h<tr><td>1<td>2</table>": "t\nh\n1  2",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a  b\n   c", "<table><tr><td>x<br>y<td>z</table>": "x  z\ny", "<table><tr><td>文字<td>b<tr><td>a<td>c</table>": "文字  b\na     c",
    "<table><tr><td><table><tr><td>in</table><td>out</table>": "in  out", "&amp; &eacute; &#233; &nope;": "& é é &nope;", "<dl><dt>t<dd>d</dl>": "t\n  d", "a</p>b": "a\n\nb", "</div>x": "x",
    "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns", "<p>a<table><tr><td>b</table>c": "a\n\nb\n\nc", "<select><option>a<option>b</select>": "a\nb", "<noscript>n</noscript><template>t</template>v": "v",
}


@pytest.mark.parametrize("html", CASES)
def test_rendering(html):
    assert render(html) == CASES[html]


MARKUP = st.lists(st.sampled_from(["<![", "<![foo[", "<![>", "<![cdata[", "<![if x]>", "]]>", "]>", "<!", "<!--", "-->", "<?", "</", "<p", " x='", "'", ">", "<td rowspan=3>", "<table>", "</table>", "<li>", "<svg>", "&#0;", "&", "text", "\n"]), max_size=25).map("".join)


@settings(max_examples=300, deadline=None)
@given(MARKUP)
def test_no_markup_raises(html):
    assert isinstance(render(html), str)


def test_unknown_sections_are_comments_and_long_rowspans_hold():
    assert render("<![foo[x]]>y") == "y" and render("<![>a") == "a" and render("a<![if x]>b<![endif]>c") == "abc"
    rows = render("<table><tr><td rowspan=3000>a<td>0" + "".join(f"<tr><td>{i}" for i in range(1, 1500)) + "</table>").split("\n")
    assert len(rows) == 1500 and rows[0] == "a  0" and rows[1499] == "   1499"


def test_deep_and_long_pages():
    assert render("<div><b>" * 20_000 + "x" + "<ul><li>" * 5_000 + "y").replace("-", " ").split() == ["x", "y"]
    assert "x" in render("<div>" * 50_000 + "x") and len(render("<p>" + "word " * 200_000)) == 999_999


def test_query_rows(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None), (2, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text")
    assert sorted((tuple(r) for r in htmltext.extract(pages).collect()), key=str) == sorted([(1, "u", "a"), (1, "u", "a"), (None, None, ""), (2, "v", "")], key=str)
    assert htmltext.extract(pages.filter("false")).collect() == []


FOREIGN = {
    "a<svg><title>t</title><desc>d</desc><defs><text>no</text></defs><g>no<text>Label</text><text x=1>two <tspan>parts</tspan></text></g></svg>b": "a Label two parts b",
    "<p>x = <math><mi>a</mi><mo>+</mo><mn>1</mn><semantics><annotation>tex</annotation></semantics></math>.": "x = a+1.",
    "<body><svg width=1 /><p>text": "text", "<svg><path d='M0'/><text>in</text><circle/></svg> out": "in out", "<div/>x<span/>y": "xy", "<svg><g><text>s<p>out</svg>x": "s\n\noutx",
    "<svg><foreignObject><div>d</div><p>e</foreignObject></svg>f": "d\n\ne\n\nf", "<svg><text hidden>h</text><text><![CDATA[c < d]]></text></svg>": "c < d", "<svg/><svg/>z<math/>": "z",
    "<head><title>T</title><b>x<p>rest": "x\n\nrest", "<head><title>T</title>\n text <i>more</i>": "text more", "<head><meta charset=u><link rel=x><style>s</style><title>T</title></head>a": "a",
    "<head><title>T</title><svg/><body>a": "a", "<head><head>x": "x", "<svg><text display=none>n</text><text visibility=hidden>h</text><text>v</text></svg>": "v", "<html><head><script>s</script><body>a": "a",
}


@pytest.mark.parametrize("html", FOREIGN)
def test_svg_math_and_unclosed_heads(html):
    assert render(html) == FOREIGN[html]


def test_foreign_text_survives_depth():
    assert render("<svg>" + "<g>" * 5_000 + "<text>x</text><path/><text>y</text></svg>z").split() == ["x", "y", "z"]
