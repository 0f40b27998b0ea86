"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into flat blocks at block-level tags. A block has its words, its link density (share of words in
links), those of the blocks before and after it, whether it is a heading, and two marks of what its containers say of
themselves (tag, class, id, role): as the article's, or as something else's. A tree grown on the blocks of the small
labelled pages in EXAMPLES decides which blocks are the article's; the marks are two features among nine.
A page is independent of all others, so pages are extracted where they are read, without a shuffle.

Scripts, styles, titles, comments in the markup and form controls have no blocks. <br> is white space. A character
reference is decoded after the markup is taken apart, so &lt;p&gt; is text. White space in a block becomes one space;
blocks are joined by an empty line. Null, empty and text-free pages give an empty text. Unclosed containers end with
the page, an unclosed script, style or title takes what follows with it (as in a browser), and any other unclosed
control is ignored. Repeated rows and ids are extracted alike; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is never markup.
_RAW = "script|style|title|textarea|iframe|noembed|xmp"
#: Elements without text of the page, which may hold markup. Of the last two, none holds another.
_SILENT = frozenset("noscript template svg object math canvas audio video button select".split())
_FLAT = frozenset(("button", "select"))
_PIECES = re.compile(rf"<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z).*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|<[!?][^>]*>?|<(?=[/a-zA-Z])[^>]*(?:>|\Z)", re.S | re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
#: Tags whose start and end are followed, since what they hold depends on them.
_HOLDERS = frozenset("article main section div nav aside header footer form ul ol dl table body fieldset figure details dialog menu blockquote".split())
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
#: Words in a class, id or role that tell of other things than the article, wherever they stand.
_BAD = frozenset(
    "nav navbar navigation menu menus menubar topbar breadcrumb breadcrumbs pagination pager footer foot bottom sidebar side aside rail widget widgets related recommended more trending popular ad ads advert adverts advertisement advertising "
    "sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay dialog newsletter subscribe subscription signup login share sharing social toolbar comment comments reply replies respond disqus discussion "
    "search searchbox form copyright legal disclaimer skip masthead complementary contentinfo tags meta hidden tracking".split()
)
_GOOD = frozenset("article content post entry story main body text articlebody maincontent postcontent entrycontent storybody prose".split())
_LASTING = frozenset("comment comments reply replies respond disqus discussion sidebar cookie cookies consent".split())


@dataclass
class Block:
    text: str
    words: int
    linked: float
    heading: bool
    bad: bool
    good: bool


def _says(tag: str, attributes: str, within_good: bool) -> tuple[bool | None, bool]:
    """Whether the container is the article's (None: it doesn't say), and if a no holds for all that it has."""
    words: set[str] = set()
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return False, True
        if name in ("class", "id", "role"):
            words.update(re.split(r"[^a-z0-9]+", value))
    if tag == "main":
        return True, False
    if tag in ("nav", "aside", "footer", "form", "menu", "dialog") or words & _LASTING:
        return False, True
    if tag == "article":
        return True, False
    if tag == "header" and not within_good:
        return False, True
    if words & _BAD:
        return False, False
    return (True, False) if words & _GOOD else (None, False)


class _Closings:
    """Where the silent elements of a page end."""

    def __init__(self, page: str):
        self.page, self.places = page, {}

    def after(self, tag: str, at: int) -> int:
        """The end of the element whose start tag ends at this place; the place itself if it isn't closed."""
        if tag not in self.places:
            found = [(m.start(), m.end(), m[1] == "/") for m in re.finditer(rf"<(/?){tag}(?=[\s/>])[^>]*>", self.page, re.I)]
            self.places[tag] = [f[0] for f in found], found
        starts, found = self.places[tag]
        for k in range(bisect_left(starts, at), len(found)):
            if found[k][2]:
                return found[k][1]
            if tag in _FLAT:
                break
        return at


def blocks(page: str | None) -> list[Block]:
    """The page's text blocks in order."""
    found: list[Block] = []
    holders: list[tuple[str, bool | None, bool]] = []
    words: list[str] = []
    linked = link = 0
    heading = False
    at, page = 0, page or ""
    closings = _Closings(page)

    def add(raw: str) -> None:
        nonlocal linked
        words.append(raw)
        if link:
            linked += len(html.unescape(raw).split())

    def close() -> None:
        nonlocal words, linked
        text = " ".join(html.unescape("".join(words)).split())
        if text:
            n = len(text.split())
            last = next((says for _, says, _ in reversed(holders) if says is not None), None)
            bad = last is False or any(lasting for _, _, lasting in holders)
            found.append(Block(text, n, min(1.0, linked / n), heading, bad, last is True and not bad))
        words, linked = [], 0

    for piece in _PIECES.finditer(page):
        if piece.start() < at:
            continue
        if piece.start() > at:
            add(page[at : piece.start()])
        at = piece.end()
        tag = piece[3].lower() if piece[3] else None
        if tag is None:
            if piece[1]:
                words.append(" ")
            continue
        if tag in _SILENT:
            words.append(" ")
            if not piece[2] and not piece[4].rstrip().endswith("/"):
                at = closings.after(tag, at)
            continue
        if tag in _INLINE:
            if tag == "a":
                link = 0 if piece[2] else 1
            elif tag == "br":
                words.append(" ")
            continue
        close()
        if re.fullmatch(r"h[1-6]", tag):
            heading = not piece[2]
        elif tag in ("p", "div", "li", "td"):
            heading = False
        if tag in _HOLDERS:
            if piece[2]:
                for k in range(len(holders) - 1, -1, -1):
                    if holders[k][0] == tag:
                        del holders[k:]
                        break
            elif not piece[4].rstrip().endswith("/"):
                holders.append((tag, *_says(tag, piece[4], any(says for _, says, _ in holders))))
    add(page[at:])
    close()
    return found


def features(found: list[Block]) -> np.ndarray:
    """words, link density of the block, the one before and the one after; heading, bad and good containers."""
    n = len(found)
    out = np.zeros((n, 9))
    own = np.array([(b.words, b.linked) for b in found]).reshape(n, 2)
    out[:, :2] = own
    out[1:, 2:4] = own[:-1]
    out[:-1, 4:6] = own[1:]
    out[:, 6:] = np.array([(b.heading, b.bad, b.good) for b in found]).reshape(n, 3)
    return out


#: Small labelled pages: of each line, the first character tells if its blocks are the article's (+) or not (-).
EXAMPLES = [
    """-<body><nav><ul><li><a href=x>Home</a></li><li><a href=x>News of the day</a></li><li><a href=x>About</a></li></ul></nav>
-<div class="ad">Buy two and pay for one, only this week in all our shops.</div>
+<article><h1>The river rose again</h1><p>For the third time this year the river left its bed and the lower streets stood under water until the evening.</p>
+<p>No one was hurt.</p><p>The mayor said that the new wall, for which the council has paid more than two million, had held in most places but not at the old bridge.</p>
+<h2>What comes next</h2><p>More rain is due on <a href=x>Friday</a>.</p></article>
-<footer>Copyright 2020 The Paper. All rights reserved.</footer>""",
    """-<body><header><div class="logo">Daily Notes</div><a href=x>Sign in</a></header>
-<div class="cookie-notice">We use cookies to give you the best experience on our pages and to learn how they are used. <a href=x>Learn more</a></div>
+<div class="post-content"><h1>On bread</h1><p>Good bread needs time more than anything else, and a little salt.</p><p>Wait.</p><ul><li>Flour, one kilogram of it</li><li>Water, as much as it takes</li></ul>
+<blockquote>My grandmother never measured anything in her life, and her bread was the best in the village.</blockquote></div>
-<div id="sidebar"><h3>Most read</h3><ul><li><a href=x>Ten ways to cook an egg that you have not tried</a></li><li><a href=x>Why salt</a></li></ul></div>
-<section class="comments"><h3>Comments</h3><p>I tried this last week and my whole family liked it very much, thank you for writing it down.</p><p>Nice.</p></section>
-<form><p>Leave your name and your address to get our letter every week.</p></form><footer><a href=x>Imprint</a> <a href=x>Contact</a></footer>
-<div class="legal"><p>All texts on these pages were written with great care, but we can't promise that they are right, whole or up to date, and we don't answer for the pages of others to which ours lead; whoever uses them does so at their own risk, and the law of the place in which we have our seat holds for all that follows from it, unless a judge decides that another one must be applied.</p></div>""",
    """-<body><table><tr><td><a href=x>Start</a></td><td><a href=x>Archive</a></td><td><a href=x>Links</a></td></tr></table>
+<h1>A walk in the hills</h1><p>We left the house before the sun was up and took the path that leads along the stream to the upper meadows, where the cows stay all summer and where, so my father used to say, the grass tastes of salt because the sea once stood there, long before there were any people to see it.</p>
+<p>After an hour we came to the hut and sat down on the bench before it to eat what we had brought with us.</p>
+<p>From there one sees the whole valley, the two lakes and, if the air is clear, even the towers of the city far away in the south.</p>
-<p><a href=x>Older</a> <a href=x>Newer</a></p><p>Powered by <a href=x>Pages</a></p>
-<div id="comments"><p>We took the same path two weeks ago with our three children and were surprised how easy it was for them, though the last part before the hut is rather steep and wet after rain, so that one should take good shoes and a stick, and leave early enough to be back before the storms that come in from the west on most summer days at about four.</p><p>Lovely.</p></div>
-<div class="related"><p>Last year we walked around the two lakes, from the mill to the old church and back on the other side, which takes about five hours if one does not stop too often on the way.</p></div>
-<p>Copyright by the authors</p>""",
    """-<body><div class="menu"><a href=x>Shop</a> <a href=x>Help</a></div><div class="breadcrumb"><a href=x>Home</a> / <a href=x>Garden</a></div>
+<main><h1>How to cut a hedge</h1><p>Cut in late June.</p><p>Use a line, and step back often to see whether the top is level from where the neighbours stand.</p><p>Short cuts.</p></main>
-<aside><h3>About us</h3><p>We have sold tools for gardens since 1921 and we love to help people who have questions about them.</p></aside>
-<div class="newsletter"><p>Get our letter with advice for every month of the year, free of charge and without any duty.</p></div>
-<div class="cookie-banner"><p>This page and the firms that we work with store small files on your device to count visits, to keep your choices and to show you things that you may like; you can change your mind at any time.</p></div>""",
    """-<body><p><a href=x>Log in</a></p><p>Menu</p>
+<p>The library will stay closed from Monday to Wednesday while the new shelves are put up in the large reading room on the first floor and the old lamps, most of which have not worked for years, give way to new ones that use a tenth of the power and light the tables better.</p>
+<p>Books that are due on these days can be brought back on Thursday at no cost, and those who need a book at once may ask at the town hall next door, where two hundred of the most wanted ones will stand in the hall on the left until the work is done and the doors can open again.</p>
-<p><a href=x>Terms</a> | <a href=x>Privacy</a> | <a href=x>Jobs</a></p>""",
    """-<body><div id="top"><p><a href=x>Front page</a></p><p>Sections</p><p><a href=x>Town</a> <a href=x>Sport</a></p></div>
+<div id="page"><h1>New bench for the park</h1><p>It is green.</p><p>It stands by the pond.</p><p>Four people can sit on it.</p></div>
-<p><a href=x>Park opens</a></p><p>More</p><p><a href=x>Pond cleaned after ten years</a></p>""",
    """+<article><h1>Soup</h1><p>Cut the onions.</p><p>Fry them in <a href=x>butter</a> until they are brown.</p>
-<p><a href=x>Ten more soups for cold days</a></p><ul><li><a href=x>Leek soup</a></li><li><a href=x>Pea soup</a></li></ul>
+<p>Add water and salt, and let it boil for twenty minutes.</p><p>Serve hot.</p></article>
-<aside><p>Our cook has worked in three large houses and now writes for us every week.</p></aside>""",
    """-<header><a href=x>Start</a> <a href=x>Blog</a></header>
+<main><h1>Notes on a long train ride</h1><p>The train left an hour late, and no one could say why.</p><p>We slept.</p>
-<p><a href=x>The night train</a> <a href=x>The day train</a> <a href=x>All trains</a></p>
+<p>In the morning there was snow on the hills, and tea for all who were awake.</p><p>Read what <a href=x>others</a> wrote of the same line and see how little has changed in it.</p></main>
-<footer><p>Written with care in a small room by the sea.</p></footer>""",
    """-<body><table><tr><td><a href=x>Prices</a></td><td>Ask us</td><td><a href=x>Way to us</a></td></tr></table>
+<h1>Our workshop</h1><p>We mend chairs.</p><p>We also mend tables and old beds, if the wood is sound and the worm has not been in it for too long.</p><p>Come by.</p>
-<p><a href=x>Chairs</a> | <a href=x>Tables</a></p><p>Made by us</p><p><a href=x>Imprint</a></p>""",
    """-<body><p><a href=x>Skip</a></p><p>Search</p><p><a href=x>Advanced</a></p>
+<div id=wrap><h2>Rules of the house</h2><p>Doors close at ten.</p><p>Guests sign the book by the door when they come and when they go, and leave the key with the porter.</p><p>No dogs.</p><p>Those who break a thing tell us, and pay half of what it cost.</p></div>
-<p><a href=x>Print</a></p><p>Page 3 of 7</p><p><a href=x>Next page</a></p>""",
    """-<div class="banner"><p>Sale ends on Sunday, so come soon and bring your friends along with you.</p></div><nav><a href=x>Home</a></nav>
+<article class="post tags-garden"><h1>Roses</h1><p>Roses want sun.</p><p>Cut them back in March, before the buds open, to three or four eyes, and burn what was sick.</p>
-<p>Roses: <a href=x>buy</a> <a href=x>compare</a> <a href=x>ask us</a></p>
+<p>Water them in the evening.</p></article>
-<div class="comments"><p>Mine froze.</p><p>Thank you, this helped me a great deal with the old ones behind the house.</p></div>""",
]

#: Pages that the tree isn't grown on, labelled in the same way: they measure it.
HELD_OUT = [
    """-<body><ul class="menu"><li><a href=x>One</a></li><li><a href=x>Two things</a></li></ul><div class="promo">Join now and save.</div>
+<div class="entry-content"><h1>Clouds</h1><p>They come from the west.</p><p>Most bring rain, some bring hail, and a few bring nothing but shade for an hour or two.</p><p>Look up.</p>
-<p><a href=x>Kinds of clouds</a></p>
+<p>The high ones are ice.</p></div>
-<div id="sidebar"><p>Weather for today: dry, with wind from the south.</p></div><footer>All rights kept</footer>""",
    """-<body><p><a href=x>Index</a></p><p>Go to</p><p><a href=x>Letters</a></p>
+<h1>A letter from the coast</h1><p>Dear all, the house is cold but the view makes up for it, and the stove works if one feeds it every hour through the night.</p><p>We stay.</p><p>The shop in the village has bread on Mondays and Fridays, fish when the boats were out, and stamps when the postman remembered to bring them.</p>
-<p><a href=x>Older letters</a> <a href=x>Newer letters</a></p>""",
    """-<header><div>The Daily</div></header>
+<main><h1>Bridge opens</h1><p>The new bridge is open.</p><p>It took six years and cost twice what was planned.</p>
-<ul><li><a href=x>Bridge in figures</a></li><li><a href=x>Old bridge</a></li></ul>
+<p>The old one will go in May.</p></main>
-<div class="newsletter"><p>News of the day in your box every morning at seven.</p></div><footer><p>Write to us at the old address.</p></footer>""",
]


def labelled_table(pages: list[str] = EXAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of labelled pages."""
    rows, labels = [], []
    for page in pages:
        lines = page.split("\n")
        found = blocks("".join(x[1:] for x in lines))
        rows.append(features(found))
        labels += [x[0] == "+" for k, x in enumerate(lines) for _ in range(len(blocks("".join(y[1:] for y in lines[: k + 1]))) - len(blocks("".join(y[1:] for y in lines[:k]))))]
    return np.concatenate(rows), np.array(labels, float)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 5, least: int = 2):
    """A decision tree by Gini impurity: a number, or (feature, bound, tree up to the bound, tree beyond it)."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return float(y.mean())
    best = (y.mean() * (1 - y.mean()) * len(y) - 1e-9, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bound in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= bound
            if min(low.sum(), (~low).sum()) < least:
                continue
            impurity = sum(p.mean() * (1 - p.mean()) * len(p) for p in (y[low], y[~low]))
            if impurity < best[0] - 1e-12:
                best = impurity, f, bound
    if best[1] is None:
        return float(y.mean())
    low = x[:, best[1]] <= best[2]
    return best[1], float(best[2]), grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def scores(tree, x: np.ndarray) -> np.ndarray:
    """The tree's share of article blocks for each row."""
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, bound, low, high = tree
    return np.where(x[:, f] <= bound, scores(low, x), scores(high, x))


def main_text(page: str | None, tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    keep = scores(tree, features(found)) >= 0.5
    return "\n\n".join(b.text for b, k in zip(found, keep.tolist(), strict=True) if k)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    tree = grow(*labelled_table())
    page_type = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["page_id", "url"]].copy()
            out["text"] = [main_text(p, tree) for p in batch["html"]]
            out["n_chars"] = out["text"].str.len().astype("int64") if len(out) else pd.Series([], dtype="int64")
            yield out

    return pages.select(F.col("page_id").cast("string"), "url", "html").mapInPandas(run, "page_id string, url string, text string, n_chars long").withColumn("page_id", F.col("page_id").cast(page_type))
