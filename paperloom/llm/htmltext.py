"""Main text of web pages by tree scoring.

The page becomes a tree of elements (implied end tags included). Each paragraph earns points for its
length and its commas, less the share of its text that stands in links, and passes them to its
ancestors: all to the parent, half to the next, a quarter to the one above, and so on without end. A
container's points are discounted by the share of its text that stands in links. The container with
the most points is kept, with those of its siblings that read like the same article; its blocks are
the text.

Scripts, styles, controls, ``nav``, ``aside``, ``footer`` and hidden parts are never text. What class
names, ids, roles, ``form`` and ``header`` say is evidence: such a part is set apart unless it holds
the article itself, and headings are never judged by their own names. Comments are told by names, by
the heading before them, or as articles inside the article.

Every step is linear in the length of the page: places of open elements are kept by name, sizes and
points are added up once from the leaves to the root.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html li main menu nav ol optgroup option p pre search section select summary table tbody tfoot thead tr ul caption".split()
)
NEVER = frozenset(
    "head script style noscript template textarea title xmp iframe noembed noframes nav aside footer button select input label legend menu"
    " dialog svg math canvas object applet audio video map datalist search optgroup option".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main section div td body blockquote center details form".split())
RUNNING = frozenset("p pre blockquote td li dd div section article main body center form details figcaption".split())
LISTS = frozenset("ul ol dl table".split())
#: Elements whose id is taken for a name of their purpose; elsewhere ids are mostly anchors.
NAMED_BY_ID = frozenset("div section form ul ol dl table header".split())
#: A start tag of the key ends an open element of these names, up to one of the scope.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
# Words in class names, ids and roles that tell what a part of a page is for.
APART = frozenset(
    "ad ads adsense adslot advert adverts advertisement advertisements advertising adbox adunit sponsor sponsored sponsors promo promos promotion"
    " promoted banner banners cookie cookies consent gdpr notice notices alert popup popups modal overlay lightbox newsletter subscribe"
    " subscription signup paywall sidebar sidebars aside rail widget widgets related recommended recommendation recommendations share sharing"
    " social nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar topbar footer colophon copyright login register"
    " search searchbox form disclaimer outbrain taboola trending popular tagcloud contentinfo complementary".split()
)
#: Inside a line only these count.
ADVERTS = frozenset("ad ads adsense adslot advert adverts advertisement advertisements advertising adbox adunit sponsor sponsored sponsors promoted".split())
HEADERS = frozenset("header masthead sitehead".split())
TALK = frozenset("comment comments commentlist comm disqus replies reply respond shoutbox".split())
#: These name readers' talk only where a part inside is named so too: an article may have a discussion.
MAYBE_TALK = frozenset("discussion discussions response responses reader readers feedback thread".split())
HINTS = frozenset("article articles body content contents entry main post story text page prose".split())
#: Words that may stand beside those above in a name without changing what it tells.
BESIDE = frozenset(
    "area aside bar block blocks body bottom box boxes button buttons center col column container content contents footer global group header holder home"
    " icons inline inner item items left link links list lists lower main message messages module modules out outer page panel placeholder position"
    " post posts primary region right row secondary section sections side site slot space stories sticky sub text title top unit unordered up upper user"
    " wide wrap wrapper zone articles article story reader readers entry form news feed view views ul div layer leaderboard skyscraper rectangle".split()
)
BUT = frozenset("with has no without not and js".split())
ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "main": "main", "article": "article", "dialog": "dialog", "search": "search"}
#: With one of these a header is the article's own.
OWN = frozenset("article entry post story content".split())
#: Headings over readers' comments, in lower case without numbers and marks.
TALK_TITLES = frozenset(
    ("comments|reader comments|readers comments|user comments|leave a comment|leave a reply|post a comment|join the conversation"
     "|kommentare|leserkommentare|kommentar schreiben|commentaires|laisser un commentaire|comentarios|deja un comentario").split("|")
)

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
UNENDED = re.compile(r"<[a-zA-Z/!?]")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NOT_LETTERS = re.compile(r"[\W\d_]+")

#: A form, and a part set apart by its names, is spared if it has at least this share of all points.
FORM_SHARE, PART_SHARE = 0.5, 0.8
#: Lists with a greater share of links are menus; inside an article.
MENU, MENU_INSIDE = 0.6, 0.9


NOTHING: frozenset[str] = frozenset()


class Element:
    __slots__ = ("apart", "attributes", "hidden", "in_link", "inline", "items", "linked", "name", "parent", "points", "raw", "size", "told", "whole")

    def __init__(self, name: str, parent: Element | None, attributes: str = ""):
        self.name, self.parent, self.raw = name, parent, attributes
        self.attributes: dict[str, str] = {}
        self.items: list[Element | str] = []
        self.told: set[str] | frozenset[str] = NOTHING
        self.apart = self.hidden = self.in_link = False
        self.points = self.whole = 0.0
        self.size = self.linked = 0
        self.inline = (0, 0, 0)


class Open:
    """The open elements, with the places of each name and of blocks among them."""

    def __init__(self, root: Element):
        self.stack = [root]
        self.where: dict[str, list[int]] = {}
        self.blocks = [0]

    def add(self, e: Element) -> None:
        at = len(self.stack)
        self.stack.append(e)
        self.where.setdefault(e.name, []).append(at)
        if e.name in BLOCKS:
            self.blocks.append(at)

    def cut(self, at: int) -> None:
        """Ends the elements from place ``at`` on."""
        for e in reversed(self.stack[at:]):
            self.where[e.name].pop()
            if e.name in BLOCKS:
                self.blocks.pop()
        del self.stack[at:]

    def last(self, names) -> int:
        """The place of the innermost open element of the names; 0 if there's none."""
        return max((self.where[n][-1] for n in names if self.where.get(n)), default=0)

    def close(self, name: str) -> None:
        at = self.last(HEADINGS if name in HEADINGS else (name,))
        # An inline end tag doesn't end blocks.
        if at and (name in BLOCKS or at > self.blocks[-1]):
            self.cut(at)

    def make_room(self, name: str) -> None:
        """Ends what a start tag ends by implication."""
        if name in BLOCKS:
            top = self.stack[self.blocks[-1]].name
            if top == "p" or (name in HEADINGS and top in HEADINGS):
                self.cut(self.blocks[-1])
        if name in ENDS:
            ended, scope = ENDS[name]
            border = self.last(scope)
            first = [w[i] for w in map(self.where.get, ended) if w and (i := bisect_right(w, border)) < len(w)]
            if first:
                self.cut(min(first))


def parse(html: str) -> Element:
    """The page's tree. Comments, declarations and the text of scripts and the like are left out.

    A tag whose quotes don't close ends at its first ``>``; so do all that follow it. A raw element
    that isn't closed takes the rest of the page if it's a script or a style, and nothing otherwise.
    """
    root = Element("#root", None)
    open_ = Open(root)
    at, n, last_gt = 0, len(html), html.rfind(">")
    quotes_close, unclosed = True, set()
    while at < n:
        lt = html.find("<", at)
        if lt < 0 or lt > last_gt:
            # No tag ends from here on: the text up to one that begins.
            begins = UNENDED.search(html, at)
            open_.stack[-1].items.append(html[at : begins.start() if begins else n])
            break
        if lt > at:
            open_.stack[-1].items.append(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 2 if html.startswith("<!-->", lt) else lt + 4)
            at = n if end < 0 else end + 3
            continue
        if html[lt + 1 : lt + 2] in ("!", "?"):
            at = html.find(">", lt) + 1
            continue
        if not html[lt + 1 : lt + 3].strip("/")[:1].isalpha():
            open_.stack[-1].items.append("<")
            at = lt + 1
            continue
        m = TAG.match(html, lt) if quotes_close else None
        if not m:
            m = LOOSE.match(html, lt)
            quotes_close = quotes_close and not m
        if not m:
            open_.stack[-1].items.append("<")
            at = lt + 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            open_.close(name)
            continue
        open_.make_room(name)
        e = Element(name, open_.stack[-1], m[3])
        if name in RAW:
            end = None if name in unclosed else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+>?", re.I).search(html, at)
            if end:
                at = end.end()
            elif name in ("script", "style"):
                at = n
            else:
                unclosed.add(name)
            continue
        open_.stack[-1].items.append(e)
        if name not in VOID and not (m[3].endswith("/") and name not in BLOCKS and name in ("svg", "path", "use")):
            open_.add(e)
    return root


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw.strip() else {}


def in_page_order(root: Element) -> list[Element]:
    """All elements, parents first; attributes are read on the way, and what they tell."""
    order, todo = [], [root]
    while todo:
        e = todo.pop()
        order.append(e)
        if e.raw:
            e.attributes = _attributes(e.raw)
            role = ROLES.get(e.attributes.get("role", "").strip().lower())
            if role and e.name in ("div", "section", "ul", "ol", "span"):
                e.name = role
            if "class" in e.attributes or "id" in e.attributes:
                e.told = purpose(e)
        todo.extend(x for x in reversed(e.items) if isinstance(x, Element))
    return order


def names_of(e: Element) -> Iterator[list[str]]:
    """The words of each class, and of the id where it names a purpose, without those that say the opposite."""
    given = e.attributes.get("class", "").split()
    if e.name in NAMED_BY_ID:
        given = given + e.attributes.get("id", "").split()
    for name in given:
        parts = [p.lower() for p in NAME_PARTS.findall(name)]
        if parts and not BUT & set(parts):
            yield parts


def purpose(e: Element) -> set[str]:
    """What the names say: ``apart``, ``advert``, ``header``, ``talk``, ``maybe talk``, ``hint``.

    A name sets a part apart only if all its words tell so or are of the kind that stands beside them:
    ``related-posts`` does, ``related-work`` doesn't.
    """
    told = set()
    for parts in names_of(e):
        words = set(parts)
        if TALK & words and words <= TALK | MAYBE_TALK | BESIDE | APART:
            told.add("talk")
        elif HEADERS & words and words <= HEADERS | BESIDE and not OWN & words:
            told.add("header")
        elif APART & words and words <= APART | BESIDE | HEADERS:
            told.add("apart")
            if ADVERTS & words:
                told.add("advert")
        if MAYBE_TALK & words and words <= MAYBE_TALK | BESIDE:
            told.add("maybe talk")
        if HINTS & words:
            told.add("hint")
    return told


def _density(e: Element) -> float:
    return e.linked / e.size if e.size else 0.0


def measure(order: list[Element]) -> None:
    """Adds up, without parts that are set apart: the size of text and of its linked part, paragraph points and what ancestors get of them.

    ``whole`` is the sum of all points below and in an element, ``points`` what its paragraphs pass to it.
    """
    for e in order:
        up = e.parent
        e.hidden = e.apart or (up is not None and up.hidden)
        e.in_link = e.name == "a" or (up is not None and up.in_link)
        size = commas = 0
        if not e.hidden:
            for x in e.items:
                if isinstance(x, str):
                    size += len(" ".join(x.split()))
                    commas += x.count(",")
        e.size, e.linked = size, size if e.in_link else 0
        # Length, commas and linked length of the text outside the element's own blocks.
        e.inline = (size, commas, e.linked)
        e.points = e.whole = 0.0
    for e in reversed(order):
        earned = 0.0
        size, commas, linked = e.inline
        if size and e.name in RUNNING:
            earned = (commas + (size**0.5) / 5) * (1 - linked / size)
        e.whole += earned
        if e.name in CONTAINERS:
            e.points += earned
            passed = e.points / 2
        else:
            passed = e.points / 2 + earned
        up = e.parent
        if up is not None:
            up.size += e.size
            up.linked += e.linked
            up.whole += e.whole
            up.points += passed
            if size and e.name not in BLOCKS:
                a, b, c = up.inline
                up.inline = (a + size, b + commas, c + linked)


def _flags(order: list[Element]) -> dict[str, set[int]]:
    """Elements that hold a title (``h1``), an article (``article`` or ``main``), or a part named as readers' talk; and those inside an article."""
    found: dict[str, set[int]] = {"title": set(), "article": set(), "talk": set(), "inside": set()}
    for e in order:
        if e.parent is not None and (e.parent.name in ("article", "main") or id(e.parent) in found["inside"]):
            found["inside"].add(id(e))
    for e in reversed(order):
        if e.parent is None or e.hidden:
            continue
        up = id(e.parent)
        if e.name == "h1" or id(e) in found["title"]:
            found["title"].add(up)
        if e.name in ("article", "main") or id(e) in found["article"]:
            found["article"].add(up)
        if id(e) in found["talk"] or "talk" in e.told or "maybe talk" in e.told:
            found["talk"].add(up)
    return found


def set_apart(order: list[Element]) -> dict[str, set[int]]:
    """Marks the parts that aren't the article's; gives the flags that it went by."""
    for e in order:
        if e.attributes:
            style = e.attributes.get("style")
            hidden = "hidden" in e.attributes or e.attributes.get("aria-hidden") == "true" or bool(style and NO_DISPLAY.search(style))
            e.apart = e.name in NEVER or hidden
        else:
            e.apart = e.name in NEVER
    measure(order)
    flags = _flags(order)
    total = order[0].whole or 1.0
    articles: dict[int, Element] = {}  # the outermost article above
    begun = False
    talks: list[Element] = []
    for e in order:
        above = articles.get(id(e.parent)) if articles and e.parent is not None else None
        if above is not None or e.name == "article":
            articles[id(e)] = above if above is not None else e
        if e.hidden or e.parent is None or e.name in ("html", "body", "main"):
            continue
        if e.name in HEADINGS:
            # Before the article has begun, comments are its subject.
            if begun and e.name != "h1" and _is_talk_title(e):
                talks.append(e)
            continue
        begun = begun or (e.name in ("p", "pre", "blockquote") and e.whole > 0)
        names, holds = e.told, id(e) in flags["title"] or id(e) in flags["article"]
        if e.name not in BLOCKS:
            e.apart = "advert" in names or ("talk" in names and e.name != "a")
        elif e.name == "form":
            e.apart = not holds and e.whole / total < FORM_SHARE
        elif "talk" in names and not (e.name == "article" and above is None and "hint" in names):
            e.apart = id(e) not in flags["title"]
        elif "maybe talk" in names and id(e) in flags["talk"]:
            e.apart = not holds
        elif e.name == "article" and above is not None:
            e.apart = e.whole < 0.5 * above.whole  # articles inside an article are comments on it
        elif "apart" in names and e.name != "article":
            e.apart = not holds and e.whole / total < PART_SHARE
        elif ("header" in names or e.name == "header") and id(e) not in flags["inside"]:
            e.apart = id(e) not in flags["article"] and e.whole / total < FORM_SHARE
        elif e.name in LISTS:
            e.apart = _density(e) > (MENU_INSIDE if above is not None else MENU)
    _drop_talk(talks)
    return flags


def _is_talk_title(e: Element) -> bool:
    if not 0 < e.size <= 60:
        return False
    text, todo = [], [e]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            text.append(x)
        else:
            todo.extend(reversed(x.items))
    return NOT_LETTERS.sub(" ", unescape("".join(text)).lower().replace("'", "").replace("’", "")).strip() in TALK_TITLES


def _drop_talk(titles: list[Element]) -> None:
    """Sets apart each heading over comments, with what follows beside it up to another heading as high."""
    levels: dict[int, str] = {}
    parents: dict[int, Element] = {}
    for e in titles:
        top = e
        while top.parent.size == e.size and top.parent.name in ("div", "section", "header", "hgroup"):
            top = top.parent  # the heading stands alone in a part
        levels[id(top)] = e.name
        parents[id(top.parent)] = top.parent
    for parent in parents.values():
        level = None
        for x in parent.items:
            if isinstance(x, Element):
                if id(x) in levels:
                    level = levels[id(x)]
                elif level and x.name in HEADINGS and x.name <= level:
                    level = None
                x.apart = x.apart or level is not None


def blocks_of(e: Element) -> list[str]:
    """The text of each block, in page order, white space normalised. Parts that are set apart are left out."""
    out: list[str] = []
    inline: list[str] = []

    def end() -> None:
        text = " ".join(unescape("".join(inline)).split())
        inline.clear()
        if text:
            out.append(text)

    todo: list[tuple[Element | str | None, bool]] = [(e, True)]
    while todo:
        x, shown = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            if shown:
                inline.append(x)
        elif x.apart:
            inline.append(" ")
            if x.name in BLOCKS:
                end()
        else:
            if x.name == "header":
                shown = False  # of a header inside the article only the headings are read
            shown = shown or x.name in HEADINGS
            if x.name in BLOCKS:
                end()
                todo.append((None, shown))
            elif x.name in ("br", "td", "th", "img"):
                inline.append(" ")
            todo.extend((y, shown) for y in reversed(x.items))
    end()
    return out


def best_container(order: list[Element]) -> tuple[Element | None, float]:
    """The container with the most points after the discount for links, and those points."""
    best, most = None, 0.0
    for e in order:
        if e.hidden or e.name not in CONTAINERS or not e.size:
            continue
        points = e.points + (8 if e.name in ("article", "main") else 0) + (3 if "hint" in e.told else 0)
        points *= (1 - _density(e)) * (1.5 if e.name in ("article", "main") else 1.0) * (0.5 if {"apart", "talk", "header"} & e.told else 1.0)
        if points > most:
            best, most = e, points
    return best, most


def main_blocks(html: str | None) -> list[str]:
    """The article's blocks; none for a page without text.

    Of an article or main element around the best container all parts are kept that aren't set apart.
    Elsewhere, of the parts beside the best container those that read like it, headings that lead to
    them, lists, tables and the like between them, and headings of a part before them that has the
    title.
    """
    if not html:
        return []
    root = parse(html)
    order = in_page_order(root)
    flags = set_apart(order)
    measure(order)
    if not root.size:
        return []
    best, most = best_container(order)
    if best is None:
        return blocks_of(root)
    up, whole = best, None
    while up is not None and (whole is None or whole.name != "article"):
        if up.name == "article" or (up.name == "main" and whole is None):
            whole = up
        up = up.parent
    best = whole or best
    around = best.parent
    if around is None or best.name in ("body", "main") or around.name in ("article", "main"):
        return blocks_of(best)
    kept = {id(x) for x in around.items if x is best or (isinstance(x, Element) and not x.apart and _kin(x, best, most))}
    places = [i for i, x in enumerate(around.items) if id(x) in kept]
    leads, titled = False, id(best) in flags["title"]
    shown: list[list[str]] = []
    for i in range(len(around.items) - 1, -1, -1):
        x = around.items[i]
        if isinstance(x, str):
            leads = leads and not x.strip()
        elif id(x) in kept:
            shown.append(blocks_of(x))
            leads = True
        elif not x.apart and x.size:
            if x.name in HEADINGS:
                # Nothing but headings stands between it and a kept part.
                if leads and _density(x) < 0.25:
                    shown.append(blocks_of(x))
                    titled = titled or x.name == "h1"
            else:
                leads = False
                if places[0] < i < places[-1] and _density(x) < 0.25 and (x.name in LISTS or x.name in ("pre", "figure")):
                    shown.append(blocks_of(x))
                elif i < places[0] and not titled and id(x) in flags["title"]:
                    shown.append([b for h in in_page_order(x) if h.name in HEADINGS and not h.hidden for b in blocks_of(h)])
                    titled = True
    return [b for part in reversed(shown) for b in part]


def _kin(e: Element, best: Element, most: float) -> bool:
    """Whether a sibling of the best container belongs to its article."""
    if not e.size or _density(e) >= 0.25:
        return False
    if e.name == "p":
        return e.size > 80 or (e.linked == 0 and best.name not in ("article", "main"))
    alike = e.name == best.name and e.attributes.get("class") == best.attributes.get("class")
    if best.name == "article":
        return alike and e.points >= 0.2 * best.points  # what else stands beside an article isn't it
    return e.name in CONTAINERS and e.points >= (0.2 if alike else 0.35) * most


def main_text(html: str | None) -> str:
    return "\n\n".join(main_blocks(html))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages(page_id, url, html)``.

    Null html gives an empty text; null ids and urls stay null; repeated rows stay; other columns are
    ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_numpy(zero_copy_only=False).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
