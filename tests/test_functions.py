from pyspark.sql import functions as F

from weftline.functions import html, numbers, text, urls


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]


def check(spark, cases, column):
    rows = [(i, given) for i, (given, _) in enumerate(cases)]
    got = dict(values(spark, rows, "i int, v string", F.col("i"), column(F.col("v"))))
    assert [got[i] for i in range(len(cases))] == [expected for _, expected in cases]


def one(spark, value, column):
    return values(spark, [(value,)], "v string", column(F.col("v")))[0][0]


TOKENS = [
    ("The  quick Fox\u000bjumps", ["the", "quick", "fox", "jumps"]),
    (" 　﻿ ", []),
    ("", []),
    (None, []),
    ("Don't stop, now.", ["don't", "stop,", "now."]),
    ("\tlead and trail\n", ["lead", "and", "trail"]),
]


def test_tokens(spark):
    check(spark, TOKENS, text.tokens)


RAW_TOKENS = [("", [""]), (" A b ", ["", "A", "b", ""]), ("A", ["A"])]


def test_raw_tokens(spark):
    check(spark, RAW_TOKENS, text.raw_tokens)


def test_weights(spark):
    rows = [(0, 4, 0, 4), (1, 4, 1, 4), (2, 4, 3, 4), (1, 0, 1, 4), (1, 4, 4, 4)]
    got = values(
        spark,
        rows,
        "c long, t long, df long, n long",
        text.term_frequency(F.col("c"), F.col("t")),
        text.inverse_document_frequency(F.col("df"), F.col("n")),
    )
    assert got == [(0.0, 0.0), (0.25, 1.0), (0.5, 0.0), (0.0, 1.0), (0.25, 0.0)]


CLAMP_LIMIT = [("5", 5), ("0", 10), ("-3", 1), ("99", 50), ("12x", 12), ("abc", 10), (None, 10), ("", 10), (" 7", 7),
 ("9" * 60, 50), ("-" + "9" * 60, 1), ("1.9", 1), ("0x1f", 31), (" 0X0A", 10), ("0x", 10), ("0x0", 10), ("-0x5", 1), ("0xfff", 50), ("+0x7g", 7)]


def test_clamp_limit(spark):
    check(spark, CLAMP_LIMIT, text.clamp_limit)


PARAGRAPH_TEXT = [
    ("<p>One</p><p> Two <b>bold</b> </p>", "One Two bold"),
    ("<p>open <p>next<div>out</div>tail", "open next"),
    ('<script>var t="</p><p>no";</script><p>yes</p>', "yes"),
    ("<p>a<!-- <p>hidden</p> -->b</p>", "ab"),
    ("<p>Tom &amp; Jerry &lt;3 &#65;&#x42;&copy;</p>", "Tom & Jerry <3 AB©"),
    ("<p>&amp;lt;</p>", "&lt;"),
    ("<p>&unknown; &amp</p>", "&unknown; &"),
    ("<p>&notit; &notin; &copy2 &ampamp;x &#65 &#x41;&#128;&#0;&#99999999999; &NotEqualTilde; AT&T</p>",
     "¬it; ∉ ©2 &amp;x A A€\ufffd\ufffd ≂̸ AT&T"),
    ("<p></p><p> </p><p>x</p>", "x"),
    ("<P class='a'>Cap</P>", "Cap"),
    ("<pre>no</pre><param><p>yes<br>no gap</p>", "yesno gap"),
    ("<p>one<article>in</article><p>two", "one two"),
    ("no paragraphs", ""),
    ("", ""),
    (None, ""),
    ("<p>in</p>out<p>in2</p>", "in in2"),
    # stray end tags close nothing; those of open elements close the paragraph inside
    ("<p>a</div>b</ul>c</h2>d</li>e", "abcde"),
    ("<div><p>a</div>b</p>", "a"),
    ("<section><div><p>a</section>b", "a"),
    ("<p>a</body>b</html>c", "abc"),
    ("<p>a<body>b<html>c", "abc"),
    # list items close items, but not through a list; other neighbours
    ("<ul><li><p>a<li>b<p>c</ul>d", "a c"),
    ("<ul><li><ul><p>a</li>b</ul>c</li>d", "ab"),
    ("<dl><dt><p>a<dd><p>b<dt>c</dl>d", "a b"),
    ("<h1>x<p>a</h2>b<p>c", "a c"),
    ("<div><p>a<hr>b</div><p>c", "a c"),
    # parts of tables count inside a table only, cells bound the search
    ("<p>a<td>b<tr>c", "abc"),
    ("<div><table><tr><td><p>a</div>b<td>c<p>d<tr><td>e</table>f", "ab d"),
    ("<table><tr><td><p>a</table>b<p>c", "a c"),
    # a button bounds paragraphs; unfinished tags at the end go
    ("<p>a<button><div>b</div></button>c", "abc"),
    ("<button><p>a<button>b", "a"),
    ("<p>a<b", "a"),
    ("<p>a</p", "a"),
    ("<p>1 < 2 <", "1 < 2 <"),
    ("".join(f"<li><p>{n}</div>." for n in range(200)), " ".join(f"{n}." for n in range(200))),
]


def test_paragraph_text(spark):
    check(spark, PARAGRAPH_TEXT, html.paragraph_text)


PARAGRAPH_TEXT_KEEP_EMPTY = [
    ("<p>a</p><p></p><p>b</p>", "a  b"),
    ("<p> a </p>", "a"),
    ("<p></p><p>b</p>", " b"),
    ("<p>a</p><p></p>", "a "),
    ("<p>a<div>x</div></p>", "a "),
    ("</p><p>a</p></p>", " a "),
    ("", ""),
]


def test_paragraph_text_keep_empty(spark):
    check(spark, PARAGRAPH_TEXT_KEEP_EMPTY, html.paragraph_text_keep_empty)


PAGE_TITLE = [
    ("<title> A &amp; B </title><h1>H</h1>", "A & B"),
    ("<title> </title><h1>H <i>x</i></h1>", "H x"),
    ("<h1>one<h2>two</h2></h1>", "one"),
    ("<h1>one</h3>two</h1>", "one"),
    ("<h2>none</h2>", "Untitled"),
    ("", "Untitled"),
    (None, "Untitled"),
]


def test_page_title(spark):
    check(spark, PAGE_TITLE, html.page_title)


def test_link_values(spark):
    page = (
        '<a href="/a?x=1&amp;y=2">1</a><A HREF=\'b\'>2</A><a class="c>d" href=plain>3</a><a name="n">no</a>'
        '<!-- <a href="/hidden"> --><abbr href="/no">x</abbr><a href="">e</a><a href="has space">4</a>'
        '<a href="?a&copy=1&copyb&reg&lt;">5</a>'
    )
    assert one(spark, page, html.link_values) == ["/a?x=1&y=2", "b", "plain", "", "has space", "?a&copy=1&copyb®<"]


BASE = "https://example.com/dir/sub/page.html?x=1"


RESOLVED = [
    ("other.html", "https://example.com/dir/sub/other.html"),
    ("./b", "https://example.com/dir/sub/b"),
    ("../a", "https://example.com/dir/a"),
    ("../../../../a", "https://example.com/a"),
    ("..", "https://example.com/dir/"),
    ("a/./b/../c", "https://example.com/dir/sub/a/c"),
    ("/root", "https://example.com/root"),
    ("?q=2", "https://example.com/dir/sub/page.html?q=2"),
    ("#top", "https://example.com/dir/sub/page.html?x=1"),
    ("", "https://example.com/dir/sub/page.html?x=1"),
    ("//Other.org/x", "https://other.org/x"),
    ("http://other.org", "http://other.org/"),
    ("HTTP://OTHER.org:80/Z?k#f", "http://other.org/Z?k"),
    ("https://other.org:443/", "https://other.org/"),
    ("https://other.org:8443/", "https://other.org:8443/"),
    ("https:rel", "https://example.com/dir/sub/rel"),
    ("a b", "https://example.com/dir/sub/a%20b"),
    ("/für", "https://example.com/f%C3%BCr"),
    ("/\U0001f600", "https://example.com/%F0%9F%98%80"),
    ("/already%20done", "https://example.com/already%20done"),
    ("/q?a='b c'", "https://example.com/q?a=%27b%20c%27"),
    ("\\back\\slash", "https://example.com/back/slash"),
    ("ftp://x/y", None),
    ("https://bad host/", None),
    ("https://x:99999/", None),
    ("https://", None),
]


def test_with_resolved(spark):
    links = spark.createDataFrame([(h, BASE) for h, _ in RESOLVED], "h string, b string")
    got = {r.h: r.url for r in urls.with_resolved(links, "h", "b", "url").collect()}
    assert got == {h: u for h, u in RESOLVED if u is not None}


def test_usable_href(spark):
    rows = [("mailto:x",), (" javascript:void(0)",), ("tel:1",), ("MAILTO:x",), ("#f",), (" ",), (None,)]
    got = values(spark, rows, "h string", urls.usable_href(F.col("h")))
    assert [g[0] for g in got] == [False, False, False, True, True, False, False]


def test_directory_prefix(spark):
    rows = [("https://a.b/x/y/N-0.html",), ("https://a.b/",), ("https://a.b/x?u=/z/",)]
    got = values(spark, rows, "u string", urls.directory_prefix(F.col("u")))
    assert [g[0] for g in got] == ["https://a.b/x/y/", "https://a.b/", "https://a.b/"]


def test_encode_component(spark):
    assert one(spark, "https://a.b/c d?e=f&g=(h)*!'~ü", urls.encode_component) == (
        "https%3A%2F%2Fa.b%2Fc%20d%3Fe%3Df%26g%3D(h)*!'~%C3%BC"
    )


LENIENT_NUMBER = [("", 0.0), (" 12.5 ", 12.5), ("abc", None), (None, None), ("1e3", 1000.0), ("0x10", 16.0), ("12px", None),
 (".5", 0.5), ("-1", -1.0)]


def test_lenient_number(spark):
    check(spark, LENIENT_NUMBER, numbers.lenient_number)


def test_hosts_outside_ascii(spark):
    labels = ["bücher", "münchen-ost", "例え", "пример", "ñandú", "ü", "a-ü-b", "日本語テスト", "mañana", "ΑΒΓ".lower(), "straße", "👍x👎👍", "ليهمابتكلموشعربي؟", "ü" * 30, "0ö9"]
    got = spark.createDataFrame([(x,) for x in labels], "x string").select("x", urls.punycode(F.col("x")).alias("p")).collect()
    assert {r.x: r.p for r in got} == {x: x.encode("punycode").decode() for x in labels}
    hosts = {"www.bücher.example": "www.xn--bcher-kva.example", "例え。テスト": "xn--r8jz45g.xn--zckzah", "plain.org": "plain.org", "": ""}
    got = spark.createDataFrame([(x,) for x in hosts], "x string").select("x", urls.ascii_host(F.col("x")).alias("p")).collect()
    assert {r.x: r.p for r in got} == hosts


def test_links_to_hosts_outside_ascii(spark):
    links = {
        "http://Bücher.example/ä?q=ö": "http://xn--bcher-kva.example/%C3%A4?q=%C3%B6", "//BÜCHER.example:80/x": "http://xn--bcher-kva.example/x", "http://b%C3%BCcher.example/": "http://xn--bcher-kva.example/",
        "https://例え.テスト:8443": "https://xn--r8jz45g.xn--zckzah:8443/", "http://ex%61mple.org/": "http://example.org/", "http://bad%20host/": None, "http://bad%2Fhost/": None, "http://%zz/": None,
    }
    rows = spark.createDataFrame([(h, "http://h.com/") for h in links], "href string, base string")
    got = {r.href: r.u for r in urls.with_resolved(rows, "href", "base", "u").collect()}
    assert got == {h: u for h, u in links.items() if u}
