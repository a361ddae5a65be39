"""Main text of pages written by hand, of hard pages in time, and points by brute force."""

import random
import time

import pytest

from paperloom.llm import htmltext

FIRST = "The river rose overnight, and by morning, as the keeper noted, it had reached the second step of the mill."
SECOND = "Nobody had seen it so high & so brown, not even in the year of the long rain, when the bridge was lost."
THIRD = "The miller moved his sacks to the loft, his neighbours helped him, and by noon the lower room was empty."
TALK = "I was there, and it was not that high, believe me, says a reader of this page, who has seen worse, far worse."
BODY = f"<p>{FIRST}</p><p>{SECOND.replace('&', '&amp;')}</p><p>{THIRD}</p>"
TEXT = [FIRST, SECOND, THIRD]
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>'
FOOT = "<footer><p>All rights reserved, and so on, by the owners of this page.</p></footer>"
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Entry number {i}</a></li>' for i in range(6)) + "</ul>"

PAGES = {
    "plain": (f'<html><head><title>t</title><style>p {{}}</style></head><body>{NAV}<div id="content"><h1>High water</h1><p>{FIRST}</p><script>var x = "</p>";</script>{BODY}</div>{FOOT}</body></html>', ["High water", FIRST, *TEXT]),
    "white space": (f"<article><p> {FIRST.replace(' ', chr(10) + '  ')} </p><p>a<br>b &eacute;&#233;&#xe9;</p></article>", [FIRST, "a b ééé"]),
    "page in a form": (f'<body><form action="/" id="aspnet">{NAV}<input name="x"><div class="content"><h1>High water</h1>{BODY}</div><select><option>Pick one</option></select></form></body>', ["High water", *TEXT]),
    "form in the article": (f'<article>{BODY}<form><label>Your mail</label><input><button>Send</button><p>We send you news, every day, at no cost.</p></form></article>', TEXT),
    "headings with ids": (f'<article><h1>High water</h1><h2 id="search">The search</h2><p>{FIRST}</p><h2 id="related-work">Related work</h2><p>{SECOND.replace("&", "&amp;")}</p></article>', ["High water", "The search", FIRST, "Related work", SECOND]),
    "section of the article": (f'<article><h1>High water</h1><section>{BODY}</section><section id="related-work"><h2>Related work</h2><p>{FIRST}</p></section><section id="discussion"><h2>Discussion</h2><p>{THIRD}</p></section></article>', ["High water", *TEXT, "Related work", FIRST, "Discussion", THIRD]),
    "related posts": (f'<article>{BODY}<div class="related-posts"><p>Read also about the bridge, the mill, and the rain.</p></div></article>', TEXT),
    "named comments": (f'<div id="content">{BODY}</div><div class="comments"><p>{TALK}</p><p>{TALK}</p></div>', TEXT),
    "comments longer than the article": (f'<div class="post">{BODY}</div><section id="comments">' + f"<p>{TALK}</p>" * 30 + "</section>", TEXT),
    "comments without names": (f"<article><h1>High water</h1>{BODY}</article><div><div><p>{TALK}</p></div><div><p>{TALK}</p></div></div>", ["High water", *TEXT]),
    "comments below a heading": (f"<div><h1>High water</h1>{BODY}<h3>2 Comments</h3><div><p>{TALK}</p></div><p>{TALK}</p></div>", ["High water", *TEXT]),
    "comments below a heading of their own": (f"<div>{BODY}<div><div><h3>Kommentare (2)</h3></div><div><p>{TALK}</p></div></div></div>", TEXT),
    "an article about comments": (f"<article><h1>Comments</h1><h2>Comments</h2>{BODY}</article>", ["Comments", "Comments", *TEXT]),
    "articles in the article": (f"<article>{BODY}<article><p>{TALK}</p></article></article>", TEXT),
    "discussion with comments": (f'<article>{BODY}<section class="discussion"><div class="reply"><p>{TALK}</p></div></section></article>', TEXT),
    "nested body of a long article": (f'<article><header><h1>High water</h1></header><div class="article-body">{BODY * 8}</div><p>{FIRST}</p></article>', ["High water", *TEXT * 8, FIRST]),
    "lists, tables and code": (f"<article>{BODY}<ul><li>first item<li>second item</ul><table><tr><td>a</td><td>b</td></tr></table><pre>x = 1</pre><figure><figcaption>A mill</figcaption></figure></article>", [*TEXT, "first item", "second item", "a b", "x = 1", "A mill"]),
    "short paragraphs": (f"<article>{BODY}<p>No.</p><p>Yes, it is.</p></article>", [*TEXT, "No.", "Yes, it is."]),
    "menu and sidebar by name": (f'<div class="page-menu">{MENU}</div><div class="sidebar"><p>{TALK}</p></div><div class="story">{BODY}</div>', TEXT),
    "menu without a name": (f"<div>{MENU}</div><div>{BODY}</div>", TEXT),
    "notices and adverts inside": (f'<article><div class="cookie-notice">We use cookies, as all do.</div><p>{FIRST}</p><div class="ad">Buy this, buy that, buy more.</div><aside>By the way, a thing.</aside><p>{THIRD}</p><p class="notice">Please note, or not.</p></article>', [FIRST, THIRD]),
    "words of menus in the text": (f'<article><p>{FIRST} Choose <span class="menu">File</span>, then <b class="search">Find</b>.</p></article>', [FIRST + " Choose File, then Find."]),
    "header of the site": (f'<body><header><h1>The Daily Mill</h1><p>News, weather and more of the valley, each day.</p></header><div class="page-header"><p>Since 1901</p></div><div>{BODY}</div></body>', TEXT),
    "header of the article": (f'<body><div class="wrap"><div class="article-header"><h1>High water</h1></div><div class="article-body">{BODY}</div></div></body>', ["High water", *TEXT]),
    "deep nesting": ("<div>" * 300 + BODY + "</div>" * 300, TEXT),
    "unclosed tags": (f"<article><h1>High water<p>{FIRST}<p><b>{THIRD}</article>", ["High water", FIRST, THIRD]),
    "roles": (f'<div role="navigation">{MENU}</div><div role="main"><h1>High water</h1>{BODY}</div><div role="contentinfo">Owned by someone, somewhere.</div>', ["High water", *TEXT]),
    "hidden parts": (f'<article>{BODY}<p hidden>not seen, at all</p><div style="display: none">nor this, here</div><p aria-hidden="true">nor that</p></article>', TEXT),
    "text without tags": ("just text, &lt;b&gt; and more < less", ["just text, <b> and more < less"]),
    "only a menu": (NAV, []),
    "tag without end": (f"<article>{BODY}<p>end <a href='x", [*TEXT, "end"]),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_pages_by_hand(name):
    html, blocks = PAGES[name]
    assert htmltext.main_blocks(html) == blocks


HARD = {
    "tags without end": "<a " * 350_000,
    "one end for many": "<a " * 350_000 + ">",
    "quotes": '<a ">' * 200_001,
    "open inline elements": "<b>" * 100_000 + "<div>x</div>" * 60_000,
    "inline below a heading": "<h1><div>" + "<b>" * 100_000 + "<div>x</div>" * 60_000,
    "ends that don't match": "<i><div>" + "<b>" * 100_000 + "</i>" * 150_000,
    "raw without end": "<title>" * 140_000 + "x>",
    "items": "<ul>" + "<li>x" * 180_000,
    "headings over comments": "<p>a</p>" + "<h2>Comments</h2>" * 55_000,
    "nested parts": '<div class="comment">' * 45_000 + "<h1>x",
    "depth": "<div>" * 60_000 + "<p>text, here</p>" * 40_000,
}


@pytest.mark.parametrize("name", sorted(HARD))
def test_hard_pages_are_linear(name):
    """A page of twice the length takes about twice the time; a square would take four times."""

    def seconds(html: str) -> float:
        start = time.process_time()
        htmltext.main_text(html)
        return time.process_time() - start

    page = HARD[name][: len(HARD[name]) // 2]
    half = min(seconds(page[: len(page) // 2]) for _ in range(2))
    assert min(seconds(page) for _ in range(2)) < 3 * half + 0.5


def test_points_by_brute_force():
    """Points of every container against a walk from each paragraph to the root."""
    draw = random.Random(3)

    def part(depth: int) -> str:
        if depth == 0 or draw.random() < 0.3:
            words = ", ".join(draw.choice(["a", "some words here", "more"]) for _ in range(draw.randrange(6)))
            return draw.choice([f"<p>{words}</p>", f"<p>{words} <a>link</a></p>", f"<b>{words}</b>", words])
        return f"<div>{''.join(part(depth - 1) for _ in range(draw.randrange(4)))}</div>"

    for _ in range(60):
        order = htmltext.in_page_order(htmltext.parse(part(6)))
        htmltext.measure(order)
        points = {id(e): 0.0 for e in order}
        for e in order:
            texts, linked, todo = [], 0, [(x, False) for x in e.items]
            while todo:
                x, link = todo.pop()
                if isinstance(x, str):
                    texts.append(x)
                    linked += len(" ".join(x.split())) if link else 0
                elif x.name not in htmltext.BLOCKS:
                    todo.extend((y, link or x.name == "a") for y in x.items)
            size = sum(len(" ".join(t.split())) for t in texts)
            if size and e.name in htmltext.RUNNING:
                earned = (sum(t.count(",") for t in texts) + size**0.5 / 5) * (1 - linked / size)
                up = e if e.name in htmltext.CONTAINERS else e.parent
                while up is not None:
                    points[id(up)] += earned
                    earned /= 2
                    up = up.parent
        for e in order:
            assert e.points == pytest.approx(points[id(e)])


def test_rows_and_nulls(spark):
    html, blocks = PAGES["plain"]
    pages = spark.createDataFrame([(1, "u", html, 5), (2, None, None, 5), (3, "u", "", 5), (1, "u", html, 5), (None, "u", " ", 5)], "page_id long, url string, html string, n_chars int")
    got = sorted(htmltext.extract(pages).collect(), key=lambda r: r.page_id or 0)
    text = "\n\n".join(blocks)
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(None, "", 0)] + [(1, text, len(text))] * 2 + [(2, "", 0), (3, "", 0)]


def test_empty_table(spark):
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
