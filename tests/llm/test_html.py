import time

from codeloom.llm import html_extract as h
from codeloom.llm.dom import blocks, parse, tree_match

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><script>var a="</p><p>no";</script><style>p{}</style></head>
<body class="with-sidebar"><div id="cookie-notice">We use cookies</div><header><h2>Site name</h2></header><nav><a href=1>Home</a></nav>
<div class="wrap"><div class="story"><h1>%s</h1><p>%s&nbsp;one<br>two <b>three<p>%s</p><div class="ad">Buy now %s</div><p>Share this story with your friends</p>
<ul><li>a<li>b</ul><form><input><button>Go</button></form><section class="comments"><article><p>First! %s</p></article></section></div>
<aside>Popular</aside></div><footer>&copy; %s</footer>"""


def _page(k):
    return PAGE % (f"Title {k}", f"Body text number {k} that is long enough", f"More words of page {k}", k, k * 7, k)


def test_wrapper():
    spec = h.induce([_page(k) for k in range(5)])
    assert spec["path"][-2:] == ["div.wrap", "div.story"]
    got = h.main_text(_page(9), h.Wrapper(spec))
    assert got == "Title 9\n\nBody text number 9 that is long enough one two three\n\nMore words of page 9"  # the list is the same on all pages: template
    assert "Buy" not in got and "First!" not in got and "Popular" not in got and "cookies" not in got


def test_title_and_lead_beside_the_body_stay():
    def page(k):
        body = f"Sentences of page {k} that go on for long. " * 20
        return f"<body><div class=top><p>Same on all pages</p></div><div class=post><h1>Title {k}</h1><p class=lead>Lead {k}</p><div class=body><p>{body}</p><p>End {k}</p></div></div><footer>{k}</footer>"

    got = h.main_text(page(9), h.Wrapper(h.induce([page(k) for k in range(5)])))
    assert got.startswith("Title 9\n\nLead 9\n\nSentences of page 9") and got.endswith("End 9") and "Same" not in got


def test_slugs_of_an_article_are_no_notices():
    kept = ["<h2 id=related-work>A</h2>", "<section id=social-impact>B</section>", "<h2 id=search-algorithms>C</h2>", "<p id=notice-period>D</p>", "<h3 id=comments>E</h3>", "<div class=has-sidebar>F</div>"]
    gone = ["<div id=cookie-notice>x</div>", "<div class='ad ad-300x250'>x</div>", "<div class=related-posts>x</div>", "<section id=comments>x</section>", "<div role=navigation>x</div>", "<p class=advert>x</p>"]
    assert h.main_text("<article>" + "".join(kept + gone) + "</article>", None) == "\n\n".join("ABCDEF")


def _bare(k, n=5, extra=""):
    """No class, id or element says what is the article: only what varies from page to page does."""
    words = [f"Paragraph {j} of page {k} goes on with words of its own, {k * 31 + j} of them." for j in range(n)]
    return (
        "<body><div><p>Daily paper</p><div><p>All the news since 1901</p><p>Read by millions</p></div></div><div><div><h1>Title %d</h1>%s<p>Would you like to support us? <b>Give today</b></p>"
        "%s</div><div><h3>About us</h3><p>We are a small paper with a large heart.</p></div></div><div><p>All rights with us</p></div></body>"
    ) % (k, "".join(f"<p>{w}</p>" for w in words), extra)


def test_only_induction_tells_template_from_content():
    w = h.Wrapper(h.induce([_bare(k, 3 + k) for k in range(5)]))
    page = _bare(9, 4)
    want = "Title 9\n\n" + "\n\n".join(f"Paragraph {j} of page 9 goes on with words of its own, {9 * 31 + j} of them." for j in range(4))
    assert h.main_text(page, w) == want
    plain = h.main_text(page, None)  # the word list alone takes the template for content
    assert plain != want and "Daily paper" in plain and "support us" in plain and "About us" in plain
    own = _bare(9, 4, "<p>Would you like to support us? <b>Not today</b></p>")  # as the template, but for a word
    assert h.main_text(own, w).endswith("Would you like to support us? Not today")


def test_near_copies_are_no_template():
    """Two pages, or more that are nearly the same, keep what they share."""
    for n in (2, 4):
        pages = [_bare(1, 8, f"<p>{k}</p>") for k in range(n)]
        spec = h.induce(pages)
        assert "Paragraph 7 of page 1" in h.main_text(pages[0], h.Wrapper(spec) if spec else None)


def test_wide_and_broken_pages_take_linear_time():
    begin = time.monotonic()
    wide = ["<body><div class=post>" + "".join(f"<p>{k} {j}</p>" for j in range(50_000)) + "</div><p>Same</p></body>" for k in range(2)]
    assert h.main_text(wide[0], h.Wrapper(h.induce(wide))).count("\n\n") == 49_999
    mixed = ["<body>" + "".join(f"<{'div' if (j * k) % 3 else 'p'}>{k * j}<b>x</b></{'div' if (j * k) % 3 else 'p'}>" for j in range(3000)) + "</body>" for k in range(1, 4)]
    w = h.Wrapper(h.induce(mixed))
    assert h.main_text(mixed[0].replace("<body>", "<body class=other>"), w)
    for bit in ("<a ", "<a '", "<a \">\" ", "<!", "<!--", "<script>", "<p <p ", "</x", "<div class='a b", "<header>", "<a b c "):
        page = bit * (1_000_000 // len(bit))
        h.main_text(page, None)
        h.main_text(page + ">", w)
    assert time.monotonic() - begin < 90


def test_anchored_match_keeps_order():
    one = "".join(f"<p>{j}</p>" for j in range(700)) + "<p>anchor</p>" + "<div>a</div>" * 5
    two = "".join(f"<p>x{j}</p>" for j in range(650)) + "<p>anchor</p>" + "<div>b</div>" * 5
    pairs = [(x, y) for x, y in tree_match(parse(one), parse(two)) if x.tag != "#"]
    assert len(pairs) == 656 and any(x.own_text() == y.own_text() == "anchor" for x, y in pairs)
    exact = tree_match(parse(one), parse(two), cells=10**7)
    assert len(exact) == 657


def test_page_of_another_shape_is_aligned():
    w = h.Wrapper(h.induce([_page(k) for k in range(5)]))
    shifted = _page(9).replace('<div class="wrap">', '<div class="wrap wide">')
    assert h.main_text(shifted, w).startswith("Title 9")


def test_references_of_equal_text_make_no_template():
    assert h.induce([_page(1)] * 4) is None
    assert "Body text number 1" in h.main_text(_page(1), None)


def test_odd_pages():
    assert h.main_text(None, None) == "" and h.main_text("", None) == ""
    assert h.main_text("plain &lt;text&#33;", None) == "plain <text!"
    assert h.main_text("<p>a<p>b<div>c<b>d</div", None).startswith("a\n\nb\n\nc")
    assert h.main_text("<div>" * 3000 + "deep", None) == "deep"
    assert h.main_text("<p>x" * 2000, None).count("x") == 2000
    assert blocks([parse("<ul><li>a<ul><li>b</ul><li>c</ul>")], lambda n: False) == ["a", "b", "c"]
    assert h.main_text("<p>a < b and <3 > 2", None) == "a < b and <3 > 2"


def test_tree_matching_is_largest():
    a, b = parse("<div><p>1</p><ul></ul><p>2</p></div>"), parse("<div><ul></ul><p>3</p></div>")
    assert [(x.label, y.label) for x, y in tree_match(a, b)][:2] == [("#", "#"), ("div", "div")] and len(tree_match(a, b)) == 4


def test_hosts():
    assert [h.host(u) for u in ("http://A.b:80/x", "https://u@c.d?q", "//e.f#g", "x", None, "")] == ["a.b", "c.d", "e.f", "", "", ""]


def test_operator(spark, sf):
    rows = [(k, f"http://h{k % 2}.org/{k}", _page(k), "x") for k in range(12)] + [(None, None, None, None), (3, "http://h1.org/3", _page(3), "x"), (99, None, "<article>lone</article>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(4)
    one, two = h.extract(pages), h.extract(pages, broadcast_bytes=0)
    got = sorted(map(tuple, one.collect()), key=str)
    assert got == sorted(map(tuple, two.collect()), key=str) and len(got) == len(rows)
    by = {r.page_id: r.text for r in one.collect()}
    assert by[None] == "" and by[99] == "lone" and by[5].startswith("Title 5\n\nBody text number 5")
    assert h.extract(pages.limit(0)).count() == 0
    out = h.op10_html_extraction(spark, sf).collect()
    assert all(r.n_chars == len(r.text) and r.text for r in out) and len(out) == spark.read.parquet(f"{sf}/pages.parquet").count()
