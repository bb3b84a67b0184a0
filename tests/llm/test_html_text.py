import time

from tracemill.llm.html_text import extract, host_of, main_text, parse

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header>Site head</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy now.</div>
<div class="cookie-notice">We use cookies</div><main><article class="post-17"><h1>Title &amp; more</h1><p><b>First <i>bo</i>ld
 line.<br>After<p>Second&nbsp;&eacute;t&#233; 1 < 2.</p><form>Mail <input></form><ul><li>one<li>two <a href=x>link</a></ul><blockquote>Quote</blockquote>
<aside>Side</aside><div class="comments"><p>Reader says</p></div></article></main><div id="sidebar">Links</div><footer>&copy; x</footer></body></html>"""


def test_article():
    assert extract(PAGE, None) == "Title & more First bold line. After Second été 1 < 2. one two link Quote"
    path = next(n.path for n in parse(PAGE)[1] if n.tag == "article")
    assert path == "/html/body.has-sidebar/main/article.post-#" and extract(PAGE, path) == extract(PAGE, None)


def test_whole_article():
    page = "<html><body><nav>Menu</nav>{}</body></html>"
    p = lambda w, n: "<p>" + f"{w} " * n + "</p>"
    said = lambda *parts: " ".join(" ".join([w] * n) for w, n in parts)
    links = "<ul>" + "<li><a href=x>linked words</a></li>" * 5 + "</ul>"
    for body, want in [
        ("<article><h1>Head</h1><div>" + p("long", 90) + "</div></article>", said(("Head", 1), ("long", 90))),
        ("<main><section>" + p("long", 90) + "</section><section>" + p("short", 5) + "</section></main>", said(("long", 90), ("short", 5))),
        ("<article><h1>Head</h1><article>" + p("inner", 90) + "</article>" + p("tail", 2) + "</article>", said(("Head", 1), ("inner", 90), ("tail", 2))),
        ("<main><h1>Head</h1><article>" + p("long", 90) + "</article></main>", said(("Head", 1), ("long", 90))),
        ("<div><div class='a'>" + p("short", 5) + "</div><div class='b'>" + p("long", 90) + "</div></div>", said(("short", 5), ("long", 90))),
        ("<div class='k'>" + p("first", 30) + "</div><div class='k'>" + p("second", 90) + "</div><div class='k'>" + links + "</div>", said(("first", 30), ("second", 90))),
        ("<div><div class='a'>" + links + "</div><div class='b'>" + p("long", 90) + "</div></div>", said(("long", 90))),
        ("<main><div>" + links + "</div><article>" + p("long", 90) + "</article></main>", said(("long", 90))),
    ]:
        own = max(parse(page.format(body))[1], key=lambda n: -1 if n.outside else n.score * n.bonus).path
        assert extract(page.format(body), None) == extract(page.format(body), own) == want


def test_broken():
    for page in ["", None, "<", "<p", "a<b", "</div></p>x", "<!-- open", "<script>never closed", '<p class="x>text', "<div>" * 3000 + "deep", "&#x110000; &bogus;"]:
        extract(page, "/html/body")
    assert extract("just text", None) == "just text" and extract("a <!-- b --> c", None) == "a c"
    assert host_of("HTTP://u:p@A.Example.com:80/x") == "a.example.com" and host_of(None) == host_of("x") == ""


def test_consensus(spark):
    page = "<html><body><div class='box'>{}</div><div class='text'>{}</div></body></html>"
    long, short = "<p>" + "words here " * 20 + "</p>", "<p>brief text.</p>"
    rows = [(i, "http://h.org/%d" % i, page.format(short, long), 0) for i in range(5)]
    # by itself the last page would choose its promotional box; its host's path says otherwise
    rows += [(9, "http://h.org/9", page.format(long, short), 0), (10, None, None, 0), (11, "http://z.org", "", 1), (9, "http://h.org/9", page.format(long, short), 0)]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(3)).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and text[9] == "brief text." and text[0] == ("words here " * 20).strip() and text[10] == text[11] == ""
    assert all(r.n_chars == len(r.text) for r in got)
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrappers():
    """Forms and marked elements around the article are not taken for what is outside it."""
    body = "<h1>Head</h1>" + "<p>" + "word " * 80 + "</p>"
    want = "Head " + ("word " * 80).strip()
    comments = "<div class='comments'>" + "<article class='comment'><p>reader says much</p></article>" * 60 + "</div>"
    for page in [
        f"<form id=aspnetForm><nav>Menu</nav><div class=content>{body}</div></form>",
        f"<div class='page-with-comments social-enabled'><article>{body}</article>{comments}</div>",
        f"<div class='header-fixed'><div>{body}</div></div>",
        f"<div class='has-comments comments-open'><main>{body}</main></div>{comments}",
        f"<div class='sidebar-right'><div class='form'><article>{body}</article></div></div><div class='related'><article><p>other one</p></article></div>",
    ]:
        assert extract(f"<html><body>{page}</body></html>", None) == want, page
    # a form or comments beside the article stay outside, however long
    assert extract(f"<body><article>{body}</article>{comments}<form><p>{'mail ' * 20}</p></form></body>", None) == want


def test_deep_nesting():
    started = time.process_time()
    for tag in ("div", "span", "article", "div class=comments"):
        assert extract(f"<{tag}>" * 100_000 + "deep", None) in ("deep", "")
    assert time.process_time() - started < 60


def test_sentences_and_headlines_stay():
    for page, want in [
        ("<article><p>before <span class='menu-item'>dish</span> after</p></article>", "before dish after"), ("<article><p class='ad-free-note'>note</p><p>x y z</p></article>", "note x y z"),
        ("<article><header><h1>Headline</h1><p>By line</p></header><p>body text</p></article>", "Headline By line body text"),
        ("<article><header>meta</header><h1>T</h1><p>body</p></article>", "T body"), ("<body><header><h1>Site</h1></header><article><p>body</p></article></body>", "body"),
        ("<article><p>one</p><span class='advert'>Buy</span><p>two</p></article>", "one two"),
    ]:
        assert extract(page, None) == want, page


def test_broken_markup_takes_linear_time():
    for unit in ('<a "', "<a ", '<a ">"', "<a<a", "<div class=\"x\" <b '>", "<!-", '</ "', "<p title='", "<article><header>"):
        for tail in ("", ">"):
            began = time.process_time()
            extract(unit * (500_000 // len(unit)) + tail, None)
            assert time.process_time() - began < 4, unit


def test_quotes_in_tags():
    assert extract("<p title='a > b'>one</p><p title=\"x'>two</p>", None) == "one two"
    assert extract("<p title=\"a>one</p>", None) == "one" and extract("a < b > c <d", None) == "a < b > c <d"
