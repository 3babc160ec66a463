import random
import re
import time
from collections import Counter
from html import unescape
from itertools import product

import pytest

from shotlake.llm import html_text as H


def test_cut_is_a_minimum():
    for seed in range(60):
        rng = random.Random(seed)
        n = rng.randint(1, 8)
        costs = [rng.uniform(-2, 2) for _ in range(n)]
        links = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        value = lambda side: sum(max(c, 0) if not s else max(-c, 0) for c, s in zip(costs, side)) + sum(w for i, j, w in links if side[i] != side[j])
        assert abs(value(H.min_cut(costs, links)) - min(map(value, product([True, False], repeat=n)))) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>A</a></li></ul></nav><div class="cookie-notice"><p>We use cookies on this site to make it work for you and others.</p></div><!-- <p>no</p> -->
<article><h1>The  title &amp; more</h1><p>First &lt;b&gt; paragraph<br>goes
 on.<p><b>Second</b> one &#233;.</p><div class="ad">Buy this now and get one more for free, only this week!</div><ul><li>point one</li><li>point two</li></ul><blockquote>Said so.</blockquote></article>
<aside><p>Read also a long teaser about something else that is not part of the page.</p></aside><form><label>Mail</label><input></form>
<div id="comments"><p>First! What a great article, I liked it very much indeed, thank you all.</p></div><footer>&copy; x</footer></body></html>"""


def test_page():
    assert H.main_text(PAGE) == "The title & more\n\nFirst <b> paragraph goes on.\n\nSecond one é.\n\npoint one\n\npoint two\n\nSaid so."


def test_broken_markup():
    assert H.main_text(None) == H.main_text("") == H.main_text("<p>") == ""
    assert H.main_text("<article><p>Words that <i>never close") == "Words that never close"
    assert H.main_text("<article><p>a b c <!-- open") == "a b c"
    assert H.main_text('<article><p>some text < and <a href="x>y</p>') .startswith("some text < and")
    assert isinstance(H.main_text("<" * 2000 + "&" * 2000 + "<div>" * 3000), str)


def template(html):
    """The main text of the given pages' own markup, read plainly: the article's blocks."""
    inside = re.search(r"<article>(.*?)</article>", html, re.S)
    parts = re.split(r"</?(?:p|h[1-6]|ul|ol|li|div|blockquote)[^>]*>", inside[1] if inside else "")
    return "\n\n".join(t for t in (" ".join(unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in parts) if t)


def test_given_pages_like_a_plain_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert [r.page_id for r in pages if H.main_text(r.html) != template(r.html)] == []


CASES = {
    "layout names around the article": ('<div class="layout has-sidebar"><div class="content-sidebar-wrap"><article><p>Some words here.</p></article><div class="sidebar"><p>Words in the column beside it, a good deal of them.</p></div></div></div>', "Some words here."),
    "a header inside the article": ('<article><header class="entry-header"><h1>The title</h1></header><p id="reply-to-critics">Some words.</p></article>', "The title\n\nSome words."),
    "attributes that only look like marks": ('<article><div data-hidden="false"><p>One.</p></div><p title="a hidden valley">Two.</p><div title="class=ad" data-class="ad">Three.</div></article>', "One.\n\nTwo.\n\nThree."),
    "text inside skipped elements": ('<article><p>Some words</p><button><span>Subscribe now</span></button><svg><g><text>no</text></g></svg><p>and <svg><path d="x"/></svg>more.</p></article>', "Some words\n\nand more."),
    "a form around the page": ("<form id=aspnetForm><article><p>Some words.</p></article></form>", "Some words."),
    "a form around a page without an article": (f"<form><div><p>{'Some words. ' * 30}</p></div></form>", ("Some words. " * 30).strip()),
    "comments longer than the article": (f'<article><p>Short.</p></article><section id="comments"><article class="comment"><p>{"Long comment. " * 60}</p></article></section>', "Short."),
    "articles in an aside": (f'<div class="post-content"><p>{"Real text of it. " * 12}</p></div><aside><article><p>{"Teaser of another. " * 4}</p></article></aside>', ("Real text of it. " * 12).strip()),
    "utility classes": ('<article class="overflow-hidden md:text-center"><div class="hidden md:block"><p>Some words.</p></div></article>', "Some words."),
    "classes of topics": ('<article class="post-7 post category-newsletter tag-social-comments"><p>Some words.</p><div class="comment-body"><p>A comment of a reader.</p></div></article>', "Some words."),
    "hidden parts": ('<article><p>Seen.</p><div hidden><p>Not seen.</p></div><p style="display: none">Nor this.</p><p>And <span hidden>not</span>seen.</p></article>', "Seen.\n\nAnd seen."),
    "a link that ends inside a block": ('<article><a href="/x"><div><p>Some words of it</a> and a good many more of them to read here.</p></div></article>', "Some words of it and a good many more of them to read here."),
    "comments and references": ("<article><p>a<!-->b<!-- no -->c&#x41;&eacute;&lt;i&gt;</p></article>", "abcAé<i>"),
}


TOPICS = ['id="navigation-basics"', 'id="cookie-recipes"', 'id="menus"', 'id="notices"', 'class="ad-hoc-queries"', 'class="banner-year"', 'id="search-trees"', 'id="footer-design"']


@pytest.mark.parametrize("attribute", TOPICS)
def test_sections_named_after_topics_stay(attribute):
    section = f"<section {attribute}><h2>Its heading here</h2><p>{'Prose of the section goes on. ' * 14}</p></section>"
    html = f"<body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{'First part of it. ' * 12}</p>{section}<p>{'Last part of it. ' * 12}</p></article></body>"
    found = H.main_text(html)
    assert "Its heading here" in found and ("Prose of the section goes on. " * 14).strip() in found and "Home" not in found


@pytest.mark.parametrize("attribute", ['class="ad-slot"', 'class="comment-body"', 'id="comments"', 'class="cookie-notice"', 'class="newsletter-signup"', 'class="advert" id="navigation-basics"', 'id="comment-list"'])
def test_furniture_inside_the_article_goes(attribute):
    n = 3 if "ad-slot" in attribute else 14
    html = f"<article><h1>Title</h1><p>{'First part of it. ' * 12}</p><div {attribute}><p>{'Words that are none of it. ' * n}</p></div><p>{'Last part of it. ' * 12}</p></article>"
    assert "none of it" not in H.main_text(html)


def test_short_pages_keep_their_text():
    assert H.main_text("<div><p>Yes.</p><p>No it is not so.</p></div>") == "Yes.\n\nNo it is not so."
    assert H.main_text("<nav><a href=/>Home</a></nav><footer>x</footer>") == "" == H.main_text('<ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul>')


def test_precision_and_recall_with_topic_sections():
    """Labelled pages whose sections are named after topics that furniture is named after as well."""
    rng = random.Random(21)
    names = ["navigation-basics", "cookie-recipes", "menus", "notices", "ad-hoc-queries", "banner-year", "search-trees", "widget-makers", "share-prices", "newsletter-history", "alerts", "popup-books"]
    hit = got = want = 0
    for _ in range(300):
        html, blocks = labelled(rng)
        title, text = words(rng, 2, 6), words(rng, 45, 120)
        attribute = rng.choice(["id", "class"]) if "-" in (name := rng.choice(names)) else "id"
        section = f'<section {attribute}="{name}"><h2>{title}</h2><p>{text}</p></section>'
        if "<article" not in html:
            continue
        spot = html.rindex("</h1>") + 5 if html.count("</h1>") == 1 else html.index("</h1>") + 5
        found, true = Counter(H.main_text(html[:spot] + section + html[spot:]).split("\n\n")), Counter([*blocks, title, text])
        weigh = lambda c: sum(n * len(t.split()) for t, n in c.items())
        hit, got, want = hit + weigh(found & true), got + weigh(found), want + weigh(true)
    print(f"precision {hit / got:.4f}, recall {hit / want:.4f} of words")
    assert want > 10_000 and hit / got > 0.97 and hit / want > 0.97


@pytest.mark.parametrize("name", CASES)
def test_markup(name):
    html, want = CASES[name]
    assert H.main_text(html) == want


@pytest.mark.parametrize("html", ["<div>a " * 100_000, "<ul>" + "<div>" * 20_000 + "<li>a" * 20_000, "<p>w w w</p><li>w w</li>" * 20_000, '<a href="x\' ' * 20_000, "<b><p>x</b>" * 20_000, "<a><div>x</a>" * 20_000], ids=["open", "list", "short blocks", "quotes", "inline", "links"])
def test_linear(html):
    began = time.perf_counter()
    H.main_text(html)
    assert time.perf_counter() - began < 20


def words(rng, low, high):
    return " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high))).capitalize() + "."


def labelled(rng):
    """A page with a main text that is known: markup of several kinds of sites, with furniture around and inside."""
    title, body = words(rng, 3, 9), []
    for _ in range(rng.randint(1, 9)):
        kind = rng.random()
        body.append(("p", words(rng, 12, 90)) if kind < 0.7 else ("h2", words(rng, 2, 6)) if kind < 0.8 else ("li", words(rng, 3, 14)) if kind < 0.9 else ("blockquote", words(rng, 5, 20)))
    wrap = lambda tag, text: f"<ul><li>{text}</li></ul>" if tag == "li" else f"<{tag}>{text}</{tag}>"
    inside = [wrap(*b) for b in body]
    extras = [f'<div class="ad-slot">{words(rng, 4, 20)}</div>', f'<div class="related-posts"><h3>{words(rng, 1, 3)}</h3><ul><li><a href=/x>{words(rng, 4, 9)}</a></li></ul></div>', f'<div class="share-buttons"><a href=#>{words(rng, 1, 2)}</a></div>', f'<div class="newsletter-signup"><p>{words(rng, 8, 25)}</p></div>', f'<aside><p>{words(rng, 10, 40)}</p></aside>', f'<form action=/s><label>{words(rng, 2, 5)}</label><input></form>']
    for x in rng.sample(extras, rng.randint(0, 3)):
        inside.insert(rng.randint(0, len(inside)), x)
    nav = "".join(f"<li><a href=/{i}>{words(rng, 1, 2)}</a></li>" for i in range(rng.randint(3, 9)))
    comments = "".join(f'<div class="comment"><p>{words(rng, 5, 60)}</p></div>' for _ in range(rng.randint(0, 6)))
    side = "".join(f"<div class=widget><h3>{words(rng, 1, 3)}</h3><p>{words(rng, 5, 40)}</p></div>" for _ in range(rng.randint(0, 3)))
    cookie = f'<div class="cookie-banner" role="dialog"><p>{words(rng, 10, 40)}</p></div>' if rng.random() < 0.5 else ""
    head = f"<html><head><title>{title}</title><script>if (a < b) c('</p>');</script></head><body>"
    foot = f"<footer><p>&copy; {words(rng, 3, 25)}</p></footer></body></html>"
    text = "".join(inside)
    html = rng.choice([
        lambda: f'{head}<header><a href=/>{words(rng, 1, 3)}</a></header><nav><ul>{nav}</ul></nav>{cookie}<main><article><h1>{title}</h1>{text}</article></main><aside>{side}</aside><section id="comments">{comments}</section>{foot}',
        lambda: f'{head}<div id="page" class="site has-sidebar"><div class="site-header"><ul class="main-menu">{nav}</ul></div>{cookie}<div id="primary" class="content-area"><div class="post hentry"><h1 class="entry-title">{title}</h1><div class="entry-content">{text}</div></div><div id="comments" class="comments-area">{comments}</div></div><div id="secondary" class="sidebar widget-area">{side}</div></div>{foot}',
        lambda: f'{head}<div class="navbar"><ul>{nav}</ul></div><div class="container"><div class="row"><div class="col-md-8"><article class="post"><header><h1>{title}</h1></header>{text}<div class="comments">{comments}</div></article></div><div class="col-md-4 sidebar">{side}</div></div></div>{cookie}{foot}',
        lambda: f'{head}<form id="aspnetForm"><div role="navigation"><ul>{nav}</ul></div><div role="main"><h1>{title}</h1>{text}</div><div role="complementary">{side}</div><div class="disqus-thread">{comments}</div></form>{foot}',
        lambda: f'{head}<table><tr><td class="menu"><ul>{nav}</ul></td><td><h1>{title}</h1>{text}</td><td class="sidebar">{side}</td></tr></table><div id="respond">{comments}</div>{foot}',
    ])()
    return html, [title, *(t for _, t in body)]


def test_precision_and_recall_on_labelled_pages():
    rng = random.Random(11)
    hit = got = want = 0
    for _ in range(600):
        html, blocks = labelled(rng)
        found, true = Counter(H.main_text(html).split("\n\n")), Counter(blocks)
        weigh = lambda c: sum(n * len(t.split()) for t, n in c.items())
        hit, got, want = hit + weigh(found & true), got + weigh(found), want + weigh(true)
    print(f"precision {hit / got:.4f}, recall {hit / want:.4f} of words")
    assert hit / got > 0.97 and hit / want > 0.97


def test_rows(spark):
    rows = [(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, None), (2, "v", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract_text(pages).collect()
    assert sorted(r.text for r in got) == sorted([H.main_text(PAGE)] * 2 + [""] * 2)
    assert H.extract_text(pages.limit(0)).count() == 0
