import html as escapes
import re

import pytest

from corpusplan.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><script>var a = "<p>no</p>";</script></head><body class="header">
<header><h1>Site name</h1><ul><li><a href=/a>One</a><li><a href='/b>c'>Two</a></ul></header>
<nav><p>Menu words that are long enough to look like text of an article</p></nav>
<div class="cookie-notice"><p>We use cookies to make this page work as well as it can for you.</p></div>
<article class=post><h1>The title</h1><p>First &lt;b&gt; paragraph,<br>with   white\n space &amp;amp; <a href=x>a link</a> inside.
<p>Second paragraph is <b>not closed and goes on for a while.
<div class="ad-box">Buy now, this is a fine advert with many words in it.</div>
<h2>Part</h2><p>Short.</p><form><label>Your name</label><input name=q><button>Send it</button></form>
<div id="comments"><p>A reader says that this was a good article about many things.</p></div>
</article><aside><p>Related words beside the article, of some length and no value.</p></aside>
<footer>&copy; Somebody, all rights reserved and some more words here</footer></body></html>"""
WANT = ["The title", "First <b> paragraph, with white space &amp; a link inside.", "Second paragraph is not closed and goes on for a while.",
        "Part", "Short."]


@pytest.fixture(scope="module")
def tree(spark):
    return html.train(spark)


def test_a_page_with_everything(tree):
    assert html.main_text(PAGE, tree).split("\n") == WANT


def test_unclosed_and_unseen_parts(tree):
    page = """<article><header class="entry-header"><h1>A title of an article that is rather longer than ten words are</h1></header>
        <p class="ad">Sponsored words that nobody wants to read at all<p>The first paragraph of the text, which stays in.
        <h2>A heading not closed<p>The second paragraph of the text, which stays as well.</p>
        <p hidden>Words that nobody sees on the page at any time</p><div style="display: none">Nor these words here, ever</div>
        <ul><li class="promo">Promoted item of a list<li>An item of the list in the article</ul></article>"""
    assert html.main_text(page, tree).split("\n") == [
        "A title of an article that is rather longer than ten words are", "The first paragraph of the text, which stays in.",
        "A heading not closed", "The second paragraph of the text, which stays as well.", "An item of the list in the article"]


def test_tree_fits_its_table(tree):
    right = sum((html.decide(tree, row[:-1]) >= 0.5) == bool(row[-1]) for row in html.LABELLED)
    assert right >= 0.95 * len(html.LABELLED)


def test_odd_pages(spark, tree):
    pages = [None, "", "<", "<<<>>>", "<p", "just text of a page without any tags but with enough words", "<script>x", "<!-- <p>a</p>",
             "</div></p>", "<a href='x>" * 500, "<div " + "a='\"" * 2000, "&#x0; &#55555555; &nosuch; &amp", "<p>" + "w " * 100_000]
    table = spark.createDataFrame([(i, "u", p, 1) for i, p in enumerate(pages)], "page_id long, url string, html string, text int")
    out = {r.page_id: r for r in html.extract(table, tree=tree).collect()}
    assert len(out) == len(pages) and all(r.n_chars == len(r.text) for r in out.values())
    assert out[0].text == out[1].text == out[6].text == out[7].text == ""
    assert out[5].text == pages[5] and out[12].text == " ".join(["w"] * 100_000)
    assert html.extract(table.limit(0), tree=tree).count() == 0


def test_articles_of_the_test_pages(spark, tree):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html.extract(table, tree=tree).collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(escapes.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?p>|</?h1>", body)]
        assert r.text == "\n".join(p for p in parts if p)


def test_open_heads_raw_text_and_stray_quotes(tree):
    article = "<article><p>It's the text of an article that says enough words to be one.</p><p>The last one's words.</p></article>"
    want = ["It's the text of an article that says enough words to be one.", "The last one's words."]
    for lead in ("<html><head><title>T</title><noscript><img src=x></noscript><body>", "<head><meta charset=utf-8><style>p > a {}</style>",
                 "<script>for(i=0;i<n;i++){/* don't */}</script>", "<style>a<b{content:'}</style>", '<div title=5" wide>',
                 '<div class=a">', "<head><script>if (a<b) '</head>'</script></head>"):
        assert html.main_text(lead + article, tree).split("\n") == want, lead
    assert html.main_text("<head><title>Only a head</title><script>'</script>", tree) == ""


def test_wrappers_are_no_side_parts(tree):
    text = "The text of an article that says enough words to be one, and it goes on for some more words."
    article = f"<article><p>{text}</p></article>"
    for page in (f'<div class="no-sidebar">{article}</div>', f'<div class="layout with-sidebar">{article}</div>',
                 f'<article class="post has-comments"><p>{text}</p></article>', f"<form id=aspnetForm><div>{article}</div></form>",
                 f"<form><div><p>{text}</p></div></form>", f'<div class="overflow hidden-xs" title="a hidden gem"><p>{text}</p></div>',
                 f'<div class="sidebar wrap"><main><p>{text}</p></main><aside><p>Related words beside it</p></aside></div>'):
        assert html.main_text(page, tree) == text, page
    for part in (f'<div class="comments"><p>{text}</p></div>', f"<div hidden><p>{text}</p></div>", f'<div class="related"><p>{text}</p></div>'):
        assert html.main_text(article + part, tree) == text, part
    assert html.main_text(f'<div class="comments"><p>{text}</p></div>', tree) == ""


def test_text_of_articles_is_kept(tree):
    first = "The first paragraph of the text, which has enough words to stay in."
    last = "The last paragraph of the text, which has enough words to stay in as well."

    def article(middle):
        return html.main_text(f"<nav><a href=/>Home</a></nav><article><p>{first}</p>{middle}<p>{last}</p></article>", tree).split("\n")

    for empty in ("<!-->", "<!--->", "<!-- a > b --!>", "<!---->", "<!-- x -->"):
        assert article(empty) == [first, last], empty
    for part in ('<p class="share-price">{}</p>', '<div class="ad-free">{}</div>', '<p class="comment-worthy sign">{}</p>',
                 '<div id="form-and-function">{}</div>', '<section class="legal-history">{}</section>'):
        assert article(part.format("Ten words that are part of the article, whatever it says.")) == [
            first, "Ten words that are part of the article, whatever it says.", last], part
    for part in ('<div class="ad-box">{}</div>', '<div class="share-buttons">{}</div>', '<div class="post-footer">{}</div>',
                 '<div class="ad-300x250">{}</div>', '<div class="related-articles">{}</div>', '<div class="cookie-notice">{}</div>'):
        assert article(part.format("Ten words that are no part of it, whatever they say.")) == [first, last], part
    items = "".join(f'<li><a href="/{n}">{n}</a></li>' for n in ("One", "Two", "Three", "Four"))
    assert article(f"<ul>{items}</ul>") == [first, "One", "Two", "Three", "Four", last]


def test_links_go_on_over_blocks(tree):
    text = "The text of an article that says enough words to be one, and it goes on for some more words."
    menu = "".join(f'<a href="/{n}"><div>{n} news of today</div></a>' for n in ("Sports", "World", "Local", "Money"))
    assert html.main_text(f"<div>{menu}</div><div><p>{text}</p></div>", tree) == text
    found = html.blocks(f'<div>{menu}</div><a name="top"><p>{text}</p><div><a href=x>open<p>linked words</div><p>free words</p>')
    assert [(b.text, b.density) for b in found] == [(f"{n} news of today", 1.0) for n in ("Sports", "World", "Local", "Money")] + [
        (text, 0.0), ("open", 1.0), ("linked words", 1.0), ("free words", 0.0)]
