"""HTML extraction: pages with known texts, the tree, and the tables' pages against a plain reading of their articles."""

from __future__ import annotations

from html.parser import HTMLParser

import pytest

from docspark.llm.html_text import EXAMPLES, HELD_OUT, blocks, extract_text, grow, labelled_table, main_text, scores


@pytest.fixture(scope="module")
def tree():
    return grow(*labelled_table())


def _splits(tree) -> set[int]:
    return set() if isinstance(tree, float) else {tree[0]} | _splits(tree[2]) | _splits(tree[3])


def test_tree_uses_densities_and_neighbours(tree):
    x, y = labelled_table()
    assert ((scores(tree, x) >= 0.5) == y).mean() > 0.97
    # link density of the block and of both neighbours
    assert {1, 3, 5} <= _splits(tree)


def test_held_out_labels(tree):
    x, y = labelled_table(HELD_OUT)
    assert ((scores(tree, x) >= 0.5) == y).mean() >= 0.95 and not set(HELD_OUT) & set(EXAMPLES)


@pytest.mark.parametrize(
    "page,wanted",
    [
        ("<html><head><title>T</title><body><article><p>Hello there all", "Hello there all"),
        ("<head><meta charset=utf-8><title>a <b> c</title><style>p{}</style><article><p>x y z</p></article>", "x y z"),
        ("<article><p>one two</p><button>Press<p>three four</p></article>", "one two\n\nPress\n\nthree four"),
        ("<article><p>one two</p><button>Press</button><p>three</p><select><option>1</select></article>", "one two\n\nthree"),
        ("<article><button>a<p>kept</p><button>gone</button></article>", "a\n\nkept"),
        ("<article><p>a</p><svg><title>s</title><text>t</text></svg><p>b</p><script>x<y", "a\n\nb"),
        ("<article class='post tags-news'><p>Hello you all</p></article>", "Hello you all"),
        ("<main class='post-meta-box'><p>Hello you all</p></main>", "Hello you all"),
        ("<body><div id=page><h1>T</h1><p>Short one.</p><p>Short two.</p></div>", "T\n\nShort one.\n\nShort two."),
        ("<article><p>First of them.</p><p><a href=x>a b</a> <a href=x>c d</a></p><p>Last of them.</p></article>", "First of them.\n\nLast of them."),
        ("<body><p>no end <b>of it", "no end of it"),
        ("<article><p>1 &lt; 2 &amp;amp; &#233;&nbsp;x</p>", "1 < 2 &amp; é x"),
        ("plain words", "plain words"),
    ],
)
def test_page(tree, page, wanted):
    assert main_text(page, tree) == wanted


def test_many_unclosed_controls(tree):
    assert len(blocks("<article>" + "<p>w</p><button>" * 3000)) == 3000


class _Article(HTMLParser):
    """The article's blocks, as a plain parser sees them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts, self.out = 0, [], []

    def _end(self):
        text = " ".join("".join(self.parts).split())
        self.out += [text] if text else []
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        elif tag != "b":
            self._end()
            self.depth += tag == "article"

    def handle_endtag(self, tag):
        if tag != "b":
            self._end()
            self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def test_table_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in extract_text(pages).collect()}
    for r in pages.collect():
        plain = _Article()
        plain.feed(r.html or "")
        plain.close()
        plain._end()
        text = "\n\n".join(plain.out)
        assert got[r.page_id] == (text, len(text))


def test_other_columns(spark):
    rows = [(1, "u", "<article><p>a b</p>", "x", 7), (1, "u", "<article><p>a b</p>", "x", 7), (None, None, None, None, None)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "a b", 3), (1, "a b", 3)]
