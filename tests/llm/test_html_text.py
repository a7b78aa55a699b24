import random
import time
from collections import Counter
from html.parser import HTMLParser

import duckdb

from basketry.llm import html_text as h

from .helpers import rows_of

PLAIN = h.Weights({}, 1.0)


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, p, "t", 1) for i, u, p in rows], "page_id long, url string, html string, text string, context long")


def test_articles_of_real_pages(spark):
    """Pages of the test data hold documents: every line comes back."""
    con = duckdb.connect()
    docs = dict(con.execute("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    lines = {" ".join(x.split()) for t in docs.values() for x in t.split("\n")}
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = h.extract(pages).collect()
    assert len(got) == pages.count()
    found = [x for r in got for x in r["text"].split("\n")[1:]]
    assert sum(x in lines for x in found) / len(found) > 0.99
    assert all(r["n_chars"] == len(r["text"]) for r in got)


ARTICLE = "".join(f"<p>The <em>first</em> words of paragraph {i} go on &amp; on,\n with   more of them.</p>" for i in range(4))
WANT = "\n".join(f"The first words of paragraph {i} go on & on, with more of them." for i in range(4))


def page(body):
    return f"<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_boilerplate_goes():
    furniture = [
        "<nav><ul><li><a href=/>Home</a></li><li>News today and more</li></ul></nav>", "<header><p>Site name and motto</p></header>", "<footer><p>&copy; all rights are reserved here</p></footer>",
        "<aside><p>Read this other thing too</p></aside>", '<div class="cookie-notice"><p>We use cookies on this site</p></div>', '<div class="ad">Buy these fine shoes now</div>',
        "<form><label>Your name</label><textarea>text</textarea></form>", "<script>if (a < b) { document.write('<p>no</p>') }</script>", "<!-- <p>hidden</p> -->",
        '<section id="comments"><h3>Comments</h3><p>I do not agree with this at all</p></section>', '<div hidden><p>unseen words</p></div>', "<noscript>turn it on</noscript>",
    ]
    rng = random.Random(2)
    for _ in range(50):
        before, after = rng.sample(furniture, 4), rng.sample(furniture, 4)
        assert h.main_text(page("".join(before) + f"<article>{ARTICLE}</article>" + "".join(after)), PLAIN) == WANT
    inner = ARTICLE.replace("</p><p>The <em>first</em> words of paragraph 2", '</p><div class="ad">Buy now</div><aside>More</aside><p>The <em>first</em> words of paragraph 2')
    assert h.main_text(page(f"<article>{inner}</article>"), PLAIN) == WANT


def test_articles_of_other_shapes():
    lists = "<ul><li>one thing to note</li><li>another thing to note</li></ul><table><tr><td>cell one</td><td>cell two</td></tr></table><blockquote>said somebody once</blockquote>"
    want = "The title of it all\n" + WANT + "\none thing to note\nanother thing to note\ncell one\ncell two\nsaid somebody once"
    body = "<header><h1>The title of it all</h1></header>" + ARTICLE + lists
    for shape in ("<main>{}</main>", "<article>{}</article>", '<div id="main">{}</div>', "<main><article data-id='ad'>{}</article></main>"):
        for weights in (PLAIN, h.Weights({"p": 3.0, "h1": 3.0}, 1.0)):
            assert h.main_text(page("<nav><ul><li>Home</li></ul></nav>" + shape.format(body) + '<div style="display: none">gone for good</div><div class="header">Site</div>'), weights) == want


def test_lists_in_menus_don_t_teach_lists(spark):
    rows = [(i, "u", page(f"<nav><ul><li>Home and away</li></ul></nav><article>{ARTICLE}</article><div>Stray words outside of it</div>")) for i in range(5)]
    weights = h.learn(pages_of(spark, rows))
    assert "li" not in weights.by_context and weights.by_context["p"] > 1 > 0 > weights.by_context["div"]


def test_broken_markup_and_references():
    assert h.main_text("<p>one <b>two<p>three</b> four<br>five", PLAIN) == "one two\nthree four\nfive"
    assert h.main_text("a &lt;b&gt; &eacute;&#233;&#xe9; &nope; x", PLAIN) == "a <b> ééé &nope; x"
    assert h.main_text("<p title='a > b'>text</p></div></p>", PLAIN) == "text"
    assert h.main_text(None, PLAIN) == h.main_text("", PLAIN) == h.main_text("<p></p>", PLAIN) == ""
    assert h.main_text("<script>x", PLAIN) == "" and h.main_text("plain", PLAIN) == "plain" and h.main_text("2 < 3 words", PLAIN) == "2 < 3 words"
    long = "<p>" + "word " * 200_000 + "</p>"
    assert len(h.main_text(long, PLAIN)) == 999_999
    assert h.main_text("<div>" * 5000 + "deep words" + "</div>" * 5000, PLAIN) == "deep words"


def test_best_run_against_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        x = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        s, e = h.best_run(x)
        assert sum(x[s:e]) == max([0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i, len(x) + 1))])


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "u", "<p>text here</p>"), (2, "u", ""), (2, "u", "")]
    assert rows_of(h.extract(pages_of(spark, rows)).select("page_id", "url", "text", "n_chars")) == sorted([(1, None, "", 0), (None, "u", "text here", 9), (2, "u", "", 0), (2, "u", "", 0)], key=repr)
    assert h.extract(pages_of(spark, [])).count() == 0


def test_long_furniture_inside_keeps_both_sides():
    lead, last = " ".join(f"lead{i}" for i in range(80)), "Five words end the article."
    links = lambda tag, n: f"<{tag}><ul>" + "".join(f"<li><a href='#{i}'>Entry number {i}</a></li>" for i in range(n)) + f"</ul></{tag}>"
    pictures = "<nav>" + "<a href='#'><img src=x></a>" * 200 + "</nav>"
    for weights in (PLAIN, h.Weights({"p": 3.0}, 1.0)):
        for inner in (links("nav", 60), links("aside", 300), "<aside>" + "Buy " * 40 + "</aside>", '<div class="ad">' + "Buy " * 400 + "</div>", pictures):
            for shape in ("<article>{}</article>", "<main>{}</main>"):
                for a, b in ((lead, WANT), (WANT, last), ("A short lead.", WANT + WANT), (WANT, "End.")):
                    assert h.main_text(page(shape.format(f"<p>{a}</p>{inner}<p>{b}</p>")), weights) == " ".join(a.split()) + "\n" + " ".join(b.split())
            # without main or article the whole element costs a bounded sum
            assert h.main_text(page(f"<div><p>{lead}</p>{inner}<p>{WANT}</p></div>"), weights) == lead + "\n" + " ".join(WANT.split())


def test_wrappers_with_listed_words():
    plain = f"<div class='content'>{ARTICLE}</div>"
    boxes = "<div class='sidebar'><p>Other things to read today</p></div><div class='cookie-notice'>We use cookies</div>"
    for weights in (PLAIN, h.Weights({"p": 3.0}, 1.0)):
        for around in ("<div class='layout with-sidebar'>{}</div>", "<div class='post has-comments'>{}</div>", "<div id='page' class='no-ads'>{}</div>", "<form action='/'>{}</form>", "<div class='has-menu'><form id='f'>{}</form></div>"):
            for content in (f"<main>{ARTICLE}</main>", f"<article>{ARTICLE}</article>", f"<main><article>{ARTICLE}</article></main>", plain):
                nav = "<nav><a href=/>Home</a></nav>"
                for body in (around.format(content), nav + around.format(content + boxes), nav + around.format(content) + boxes, around.format(nav + content)):
                    assert h.main_text(page(body), weights) == WANT, body
    for inside in ("<main><div class='post has-comments'>{}</div></main>", "<article><div class='no-ads'>{}</div></article>", "<main><div class='with-sidebar'><article>{}</article></div></main>"):
        assert h.main_text(page("<div>Stray</div>" + inside.format(plain) + boxes), h.Weights({"div": -3.0}, 1.0)) == WANT
    # a short heading outside doesn't make the rest furniture
    assert h.main_text(page(f"<h1>The title</h1><div class='post has-comments'>{plain}</div>"), PLAIN) == "The title\n" + WANT
    # an unclosed nav doesn't take main along
    assert h.main_text(page(f"<nav><ul><li>Home<main>{ARTICLE}</main>"), PLAIN) == WANT


def test_sections_with_listed_words_still_go():
    replies = "<section class='comments'>" + "<article class='reply'><p>I do not agree with this at all</p></article>" * 20 + "</section>"
    for body in (f"<article>{ARTICLE}</article>{replies}", f"<article>{ARTICLE}{replies}</article>", f"<div class='has-ads'><article>{ARTICLE}</article>{replies}</div>", f"<div>{ARTICLE}</div><div class='comments'>{ARTICLE * 9}</div>"):
        assert h.main_text(page(body), PLAIN) == WANT, body
    assert h.main_text(page(f"<div hidden><main>{ARTICLE}</main></div>"), PLAIN) == ""


class Reference(HTMLParser):
    """The article of a page with one, by the standard library's parser: its text in blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks, self.skip = 0, [""], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.skip += tag in ("script", "style")
        if tag in h.BLOCKS:
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.skip -= tag in ("script", "style")
        if tag in h.BLOCKS:
            self.blocks.append("")

    def handle_data(self, data):
        if self.depth > 0 and not self.skip:
            self.blocks[-1] += data


def reference(page):
    parser = Reference()
    parser.feed(page)
    parser.close()
    return "\n".join(x for x in (" ".join(b.split()) for b in parser.blocks) if x)


def test_against_another_extractor(spark):
    """Recall and precision of article lines, page by page."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: reference(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in h.extract(pages).collect()}
    assert got.keys() == want.keys()
    lines = lambda t: Counter((i, x) for i, text in t.items() for x in text.split("\n"))
    both = (lines(got) & lines(want)).total()
    assert both / lines(want).total() >= 0.99 and both / lines(got).total() >= 0.99
    assert sum(got[i] == want[i] for i in want) / len(want) >= 0.98


def test_names_are_learnt(spark):
    """Names that no list has become furniture; listed ones that wrap articles don't stay it."""
    other = "".join(f"<p>Words of a strip number {i} that isn't the article.</p>" for i in range(6))
    make = lambda i: page(f"<div class='zone-q7'>{other}</div><div class='zone-q7 strip'>{other}</div><article><div class='widget'>{ARTICLE}</div></article>")
    weights = h.learn(pages_of(spark, [(i, "u", make(i)) for i in range(8)]))
    assert weights.names["strip"] <= h.FURNITURE_FROM < weights.names["widget"] and weights.tags["p"] <= h.TAG_WEIGHT
    body = f"<div>{ARTICLE}</div><div class='strip'>{other}</div>"
    assert h.main_text(page(body), weights) == WANT != h.main_text(page(body), PLAIN)
    # an advert in articles doesn't make adverts content
    ads = h.learn(pages_of(spark, [(i, "u", page(f"<article>{ARTICLE}<div class='ad'>Buy now</div></article>")) for i in range(50)]))
    assert ads.is_furniture({"ad"})


def test_names():
    names = {
        "no-sidebar": "", "has-comments": "", "related-work": "work", "related-posts": "related", "social-science": "science", "widget-area": "widget", "login-required": "required",
        "share-count": "count", "banner-off": "off", "cookieNotice": "notice", "site-footer": "footer", "main-content": "main", "content": "content", "SIDEBAR": "sidebar", "12": "",
    }
    assert {n: h.name_of(n) for n in names} == names


def test_elements_that_are_named_like_furniture_but_hold_the_page():
    for name in ("content no-sidebar", "post has-comments", "related-work", "social-science", "widget-area", "notice-board", "banner-off", "login-required"):
        for shape in ("<div class='{}'>{}</div>", "<main><div class='{}'>{}</div></main>", "<article><div class='{}'>{}</div></article>", "<form class='{}'>{}</form>"):
            assert h.main_text(page(shape.format(name, ARTICLE)), PLAIN) == WANT, (name, shape)


def test_every_block_of_the_run_stays():
    body = ARTICLE + "<blockquote>" + "quoted words " * 5 + "</blockquote>" + ARTICLE
    for shape in ("<article>{}</article>", "<div>{}</div>"):
        assert h.main_text(page(shape.format(body)), h.Weights({"blockquote": -2.0, "p": 2.0})) == WANT + "\n" + ("quoted words " * 5).strip() + "\n" + WANT


def test_raw_elements_and_white_space():
    assert h.main_text("<p>İstanbul one</p><SCRIPT>x</p></Script ><p>two\u0085three four</p><style>p{}</styles></style><p>five</p>", PLAIN) == "İstanbul one\ntwo three four\nfive"
    times = []
    for n in (4_000, 16_000):
        long, began = "<p>İ a</p>" + "<SCRIPT>x</SCRIPT><p>w</p>" * n, time.perf_counter()
        assert h.main_text(long, PLAIN).count("\n") == n
        times.append(time.perf_counter() - began)
    assert times[1] < 16 * times[0]


PARA = "".join(f"<p>Sentence number {i} of the article has a fair number of words in it, with <a href='#'>a link</a> too.</p>" for i in range(5))
LINES = [f"Sentence number {i} of the article has a fair number of words in it, with a link too." for i in range(5)]
SHAPES = {
    f"<body class='single has-sidebar'><header class='site-header'><a href='/'>Site</a><nav><ul><li><a>Home</a></li></ul></nav></header><main><article><header><h1>Title here</h1></header><div class='share-buttons'><a>Tweet</a></div>{PARA}"
    "<figure><img><figcaption>A picture of it</figcaption></figure><aside class='related'><h2>Related</h2><a>Other story</a></aside><pre>code  here</pre></article><section id='comments'><h2>Comments</h2><div class='comment'><p>I disagree wholeheartedly with this.</p>"
    "</div><form><textarea></textarea><button>Post</button></form></section></main><aside><p>Sidebar words</p></aside><footer><p>Copyright 2024</p></footer>": ["Title here", *LINES, "A picture of it", "code here"],
    f"<div id='header'><a>Logo</a></div><div class='cookie-banner'>We use cookies to improve. <button>OK</button></div><div id='nav'><a>World</a></div><div id='wrapper'><div id='content' class='col-main'><h1>Headline of it</h1><div class='story'>{PARA}</div>"
    f"<div class='ad-slot'>Buy now cheap</div>{PARA}</div><div id='sidebar' class='sidebar'><ul><li><a>One story</a></li></ul></div></div><div id='footer'>About us Contact</div>": ["Headline of it", *LINES, *LINES],
    f"<div id='page' class='site'><div id='masthead' class='site-header'>My blog tagline</div><div id='content'><div class='post has-post-thumbnail'><h1 class='entry-title'>Entry</h1><div class='entry-content'>{PARA}</div></div><div id='comments' class='comments-area'>"
    "<ol class='comment-list'><li class='comment'><p>Nice post, thanks for it all.</p></li></ol></div><div id='secondary' class='widget-area'><div class='widget'>Search archives</div></div></div></div>": ["Entry", *LINES],
    f"<form id='form1' action='x'><div class='menu'><a>Home</a><a>About</a></div><div class='main-content'>{PARA}</div><div class='footer'>(c)</div></form>": LINES,
    "<article><h1>Soup</h1><table><tr><td>Salt</td><td>2 g</td></tr></table><ol><li>Boil.</li><li>Eat.</li></ol></article>": ["Soup", "Salt", "2 g", "Boil.", "Eat."],
    f"<article><div class='notice'>Subscribe to read more.</div>{PARA}<div role='complementary'>extra</div><form class='newsletter'><label>Your mail</label></form><p>The end.</p></article>": [*LINES, "The end."],
}


def test_pages_of_many_shapes(spark):
    taught = h.learn(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    for weights in (PLAIN, taught):
        for page_, want in SHAPES.items():
            assert h.main_text(page(page_), weights).split("\n") == want
