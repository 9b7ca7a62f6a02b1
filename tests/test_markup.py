from quillstack.functions import markup
from quillstack.functions.markup import Tree, plain, sanitized
from quillstack.operators import pages


def shape(text):
    t = Tree(text)
    return [(e.tag, e.depth, t.inner_html(i)) for i, e in enumerate(t.elements)]


def test_what_is_left_open():
    assert shape("<ul><li>a<li>b<ul><li>c</ul></ul>x") == [("ul", 0, "<li>a<li>b<ul><li>c</ul>"), ("li", 1, "a"), ("li", 1, "b<ul><li>c</ul>"), ("ul", 2, "<li>c"), ("li", 3, "c")]
    assert shape("<p>one<p>two<div>three</p></div>") == [("p", 0, "one"), ("p", 0, "two"), ("div", 0, "three</p>")]
    assert shape("<table><tr><td>1<td>2<tr><td>3</table>")[1:] == [("tr", 1, "<td>1<td>2"), ("td", 2, "1"), ("td", 2, "2"), ("tr", 1, "<td>3"), ("td", 2, "3")]
    assert shape('<b>x</i></b></b><br>a<img src="a>b">') == [("b", 0, "x</i>"), ("br", 0, ""), ("img", 0, "")]
    assert shape("") == [] and shape("<") == [] and shape("a < b") == [] and shape("<script>if (a<b) '</p>'</script><p>x") == [("script", 0, "if (a<b) '</p>'"), ("p", 0, "x")]


def test_nested_entries_end_where_they_end(spark):
    html = '<p><b>Tutorials:</b></p>\n<div class="a session-entry b"><div><i>In <b>two</b> divs</i></div><b>Speakers</b>: Ann (X) and Bo<br><div><p>A text that is long</p><p>short</p></div></div><div class="www_sectiontitle">Posters</div><div class="session-entry"><i>Keynote: B</i></div><p><b>Bold</b> and not</p>'
    got = pages.session_entries(spark.createDataFrame([(1, html), (2, None), (3, "")], "id long, html string"), "id", "html").orderBy("pos").collect()
    assert [tuple(r)[1:] for r in got] == [(1, "tutorial", "In two divs", "Ann (X) and Bo", "A text that is long", "", ""), (3, "keynote", "B", "", "", "", "")]


def test_sanitized():
    assert sanitized('<p onclick="x()" class="c">a &lt; b<script>alert(1)</script><img src=x onerror=y><!-- c --></p>') == '<p class="c">a &lt; b<img src="x"></p>'
    assert sanitized('<a href="java&#10;script:x()">a</a><a HREF="/b?x=1&amp;y" target=me>b</a>', base="https://e.org/c/") == '<a>a</a><a href="https://e.org/b?x=1&amp;y" target="_blank" rel="noopener noreferrer">b</a>'
    assert sanitized('<img src="data:image/png;base64,x"><img src="data:text/html,x"><svg><use xlink:href=" vbscript:x"></svg>') == '<img src="data:image/png;base64,x"><img><svg><use></use></svg>'
    assert sanitized("<div><form>gone<p>too</form>stays<style>p{}</style></div><iframe>x") == "<div>stays</div>"
    assert sanitized("<x-a><b id=i>t</b></x-a>", allowed=frozenset({"b"}), attributes=frozenset()) == "<b>t</b>"
    assert sanitized(None) == "" and sanitized("<b>" * 3000 + "deep") == "<b>" * 3000 + "deep" + "</b>" * 3000
    once = sanitized("<ul><li>a<li>b</ul><p>c<p>d &amp;amp;")
    assert once == sanitized(once) == "<ul><li>a</li><li>b</li></ul><p>c</p><p>d &amp;amp;</p>"


def test_references_without_a_semicolon(spark):
    from pyspark.sql import functions as F

    from quillstack.functions.text import strip_markup

    texts = ["a&amp;&amp", "a &amp b &copy; &ampx; &amp>c", "&am &a &quo &#39 &#39; &#x27g &lt", "a&b < c &amp d", "&amp;amp &nosuch; &amp;lt;i&amp;gt;"]
    kept = ["a&amp;&amp", "a &amp b © &ampx; &amp&gt;c", "&amp;am &amp;a &amp;quo &#39 ' &#x27g &lt", "a&amp;b &lt; c &amp d", "&amp;amp &amp;nosuch; &amp;lt;i&amp;gt;"]
    assert [sanitized(f"<p>{x}</p>") for x in texts] == [f"<p>{x}</p>" for x in kept]
    # a browser shows the same, and so does what resolves ended references only
    assert [plain(sanitized(x)) for x in texts] == [plain(x) for x in texts]
    d = spark.createDataFrame([(x, sanitized(x)) for x in texts], "a string, b string")
    assert [r for r in d.select(strip_markup("a").alias("a"), strip_markup("b").alias("b")).collect() if r.a != r.b] == []
    assert sanitized('<a href="java&#115cript:x()">x</a>') == "<a>x</a>" and sanitized("x &lt<b") == "x &lt&lt;b"


def test_sections_and_lists():
    assert list(markup.sections("<h3 id=a>T</h3>\n<h4>S</h4> <p>A<b>x</b></p><h3>no id</h3><h4>S</h4><p>A</p><h3 id=b>T</h3>text<h4>S</h4><p>A</p>")) == [(0, "T", "S", "A<b>x</b>")]
    assert list(markup.listed_meetings('<ul><li><a href="2020-03/">March</a> - Here - There - Canceled</li><li><a href="x/">no</a></li><li><b><a href=\'2021-04-05\'>Day</a></b></ul>')) == [(0, "2020-03", "March", "Here - There"), (2, "2021-04-05", "Day", "")]
    assert markup.first_link('<a>slides</a><a href="v"><b>My</b> Video</a><a href="s">The Slides</a>', "slide") == "s" and markup.first_link("", "video") == ""
    assert plain("a&amp;amp;b<br>c<script>x</script> d") == "a&b c d"
