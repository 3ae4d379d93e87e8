"""Page extraction against hand-made pages and, on the given pages, against what the article element holds."""

import html
import re
import time

from knowntime.llm import html_extract as he

WEIGHTS = {"p": 3.0, "h1": 3.0, "boiler:nav": -4.0, "boiler:footer": -3.0, "boiler:ad": -3.0, "+p": -0.1, "-p": -0.1}

PAGE = """<!DOCTYPE html><html><head><title>No title</title><style>p{}</style><script>var a="</p><p>no";</script></head>
<body class=home><header class="site-header"><a href=/>Home of words</a></header><nav><ul><li><a>one</a></li><li>two</li></ul></nav>
<div class="cookie-notice"><p>We use cookies, many of them, to track you.</p></div>
<div id=main-content><h1>A &amp; B</h1><!-- <p>hidden</p> --><p>First&nbsp;  line<br>goes <b>on</b>.</p>
<div class="ad"><p>Buy this now and be happy for ever after.</p></div><p>Second<p>Third &lt;x&gt; 1 < 2</p>
<ul><li>item one</li><li>item two</li></ul><aside><p>Related words here</p></aside>
<form><label>Name</label><input><button>Send</button></form></div>
<section class="comments"><p>Great post, I loved every single word of it!</p></section>
<footer><p>&copy; 2020 all of us</p></footer></body></html>"""


def test_page_without_article_element():
    assert he.main_text(PAGE, WEIGHTS) == "A & B\nFirst line goes on.\nSecond\nThird <x> 1 < 2\nitem one\nitem two"


def test_article_keeps_its_own_header_and_short_last_block():
    page = "<body><nav>menu here</nav><article><header><h1>Title</h1></header><p>Some words that count a lot.</p><p>End.</p></article><footer>foot</footer>"
    assert he.main_text(page, WEIGHTS) == "Title\nSome words that count a lot.\nEnd."


def test_hints_on_wrappers_and_inside_names_do_not_empty_a_page():
    inner = "<nav>menu here</nav>{}<h1>Title</h1><p>Some words that count a lot.</p>{}<div class='ad-container'><p>Buy this now.</p></div>"
    text = "Title\nSome words that count a lot."
    for name in ("has-sidebar", "no-sidebar", "with-comments", "search-results", "sidebar"):
        assert he.main_text(f'<body class="{name}">' + inner.format("<div>", "</div>") + "</body>", WEIGHTS) == text
        assert he.main_text(f'<body><div class="{name}">' + inner.format("<article>", "</article>") + "</div></body>", WEIGHTS) == text
    for name in ("post no-comments", "comments"):
        assert he.main_text("<body>" + inner.format(f'<article class="{name}">', "</article>") + "</body>", WEIGHTS) == text
    for name in ("has-sidebar", "no-sidebar", "with-comments", "search-results"):
        assert he.main_text(f'<body><div class="{name}">' + inner.format("", "") + "</div></body>", WEIGHTS) == text
    late = "<div class=comments><article><p>Great post, I loved it!</p></article></div>"
    assert he.main_text("<body>" + inner.format("<article>", "</article>") + late + "</body>", WEIGHTS) == text


def test_attributes_are_read_whole():
    text = "Words of an article that count. More of them."
    body = "<p>Words of an article that count.{} More of them.</p>"
    for tag in ('<article data-title="The hidden valley">', '<article title="hidden">', "<article data-hidden>", '<article data-class="ad" data-id=nav>',
                "<article title='a > b' class=post>", '<article class = "post" ="odd" / x>', '<article title="never closed class=post>'):
        assert he.main_text(tag + body.format("") + "</article>", WEIGHTS) == text, tag
    for tag in ('<p title="hidden gems of Rome">', '<p data-id="comment">', "<p data-class=ad>", "<p xhidden>"):
        assert he.main_text(f"<div><p>First words here.</p>{tag}Second words.</p></div>", WEIGHTS) == "First words here.\nSecond words.", tag
    for tag in ("<p hidden>", "<p class=ad>", "<p ID='comment'>", '<p style="color:red;display : none">', "<p aria-hidden=true>"):
        assert he.main_text(f"<div><p>First words here.</p>{tag}Second words.</p></div>", WEIGHTS) == "First words here.", tag


def test_elements_without_content_do_not_eat_the_page():
    for odd in ("<svg/>", "<math />", "<iframe src=x />", "<object/>", "<canvas/>", "<svg>", "<iframe src=x>", "<object><object>", "<select>", "<svg viewBox='0 > 1'><path/></svg >"):
        assert he.main_text(f"<div><p>First words{odd} here.</p><p>Second words.</p></div>", WEIGHTS) == "First words here.\nSecond words.", odd
    assert he.main_text("<div><p>First words here.</p><script>var x='</p>';<p>no", WEIGHTS) == "First words here."
    assert he.main_text("<p>First words here.</p><a href=", WEIGHTS) == "First words here."


def test_hostile_pages_take_linear_time():
    n = 1 << 20
    pages = {"open": "<p>Words here.</p>" + "<a" * (n // 2), "quotes": "<p>Words here.</p>" + '<a "' * (n // 4) + ">", "values": "<p>Words here.</p>" + '<a b="c' * (n // 7),
             "single": "<p>Words here.</p>" + "<a b='" * (n // 6) + ">", "nested": "<div>" * (n // 5) + "<p>Words here.</p>", "inline": "<p>Words here.</p>" + "<b>" * 8000 + "<p>x" * 100_000,
             "closers": "<p>Words here.</p>" + "<div>" * 8000 + "</x>" * 100_000, "raw": "<p>Words here.</p>" + "<svg>" * (n // 5), "comments": "<p>Words here.</p>" + "<!--" * (n // 4),
             "signs": "<p>Words here.</p>" + "<" * n, "declared": "<p>Words here.</p>" + "<!x" * (n // 3)}
    for name, page in pages.items():
        start = time.thread_time()
        text = he.main_text(page, WEIGHTS)
        assert text.startswith("Words here."), name
        assert time.thread_time() - start < 6, name    # about a second on an idle machine


def test_labelled_pages_outweigh_a_hint():
    page = "<article><div class=notice>" + "<p>Every word stands in a notice here.</p>" * 20 + "</div></article>"
    for pages, kept in ((1, False), (60, True)):
        weights = he.weigh(he.count_features([page] * pages))
        assert (weights["boiler:notice"] > 0) is kept


def test_pages_without_content():
    assert he.main_text("", WEIGHTS) == ""
    assert he.main_text("<nav>only a menu</nav>", WEIGHTS) == ""
    assert he.main_text("plain words", WEIGHTS) == "plain words"
    assert he.main_text("<p>open <b>never closed", WEIGHTS) == "open never closed"
    assert he.main_text("<script>endless", WEIGHTS) == ""


def test_given_pages_equal_their_articles(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in pages.join(he.extract_pages(pages), ["page_id", "url"]).collect():
        blocks = re.split("</?(?:p|h1)>", re.search("(?s)<article>(.*?)</article>", r.html)[1].replace("<br>", " "))
        want = "\n".join(b for b in (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks) if b)
        assert r.text == want and r.n_chars == len(want)


def test_held_out_pages_without_article_tags(spark, sf):
    """Weights of half the pages find the same text in the others when their article tags are taken away."""
    rows = spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").collect()
    weights = he.weigh(he.count_features([r.html for r in rows[::2]]))
    bare = [re.sub("</?article>", "", r.html) for r in rows[1::2]]
    same = sum(he.main_text(b, weights) == he.main_text(r.html, weights) for b, r in zip(bare, rows[1::2]))
    assert same >= 0.95 * len(bare)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>words of a page</p>", "y")]
    out = he.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out) == [(0, "words of a page", 15), (1, "", 0), (1, "", 0)]
    assert he.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
