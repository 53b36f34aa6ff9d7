"""Blocks against the parser of the standard library, main texts against written ones."""

import random
import time
from html import escape
from html.parser import HTMLParser

from statloom.llm import main_text
from tests.llm.conftest import prose


class Plain(HTMLParser):
    """Texts between the elements that start a line, for pages whose tags are all closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.held, self.linked, self.link, self.unseen = [], "", "", 0, 0

    def line(self):
        text = " ".join(self.held.split())
        if text:
            self.out.append((text, len(text.split()), len(self.linked.split())))
        self.held = self.linked = ""

    def handle_starttag(self, tag, attrs):
        if tag in main_text.LINES or tag == "hr":
            self.line()
        if tag == "br":
            self.handle_data(" ")
        self.link += tag == "a"
        self.unseen += tag in main_text.UNSEEN | main_text.RAW

    def handle_endtag(self, tag):
        if tag in main_text.LINES:
            self.line()
        if tag == "a":
            self.link -= 1
            self.linked += " "
        self.unseen -= tag in main_text.UNSEEN | main_text.RAW

    def handle_data(self, data):
        if not self.unseen:
            self.held += data
            self.linked += data if self.link else ""


def plain(page):
    parser = Plain()
    parser.feed(page)
    parser.close()
    parser.line()
    return parser.out


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 5)):
        kind = rng.random()
        if kind < 0.4:
            out.append(escape(prose(rng, rng.randint(1, 9))) + rng.choice(["", " ", "\n", "&amp;", "&eacute;", "&#8212;", "&nbsp;"]))
        elif kind < 0.5:
            out.append(rng.choice(["<script>if (a<b) '<p>'</script>", "<style>p > a {}</style>", "<!-- <p>gone</p> -->", "<br>", "<hr/>", "<img alt='a > b' src=x>", "<svg><path d='m'/></svg>"]))
        elif kind < 0.6:
            out.append(f"<a href=\"/x?a=1&b=2\">{prose(rng, 2)}</a>")
        elif kind < 0.7:
            tag = rng.choice(["b", "em", "span", "code"])
            out.append(f"<{tag} title='it is'>{prose(rng, 2)}</{tag}>")
        elif depth < 5:
            tag = rng.choice(["div", "section", "ul", "table", "article", "blockquote", "DIV"])
            out.append(f'<{tag} data-x="1 > 0" class=a>{random_page(rng, depth + 1)}</{tag.lower()}\n>')
    return "".join(out)


def test_blocks_equal_the_standard_parser():
    rng = random.Random(1)
    for _ in range(400):
        page = random_page(rng)
        assert [(b.text, b.words, b.linked) for b in main_text.blocks(page)] == plain(page)


def texts(page):
    return [b.text for b in main_text.blocks(page)]


def test_open_elements_and_damaged_markup():
    assert texts("<p>one<p>two<ul><li>a<li>b<ul><li>c</ul><li>d</ul>tail") == ["one", "two", "a", "b", "c", "d", "tail"]
    assert texts("a < b and c <3 d <p>x</div></p></q>y") == ["a < b and c <3 d", "x", "y"]
    assert texts('<p title="never closed>gone <p>gone') == []
    assert texts("<p title=it's>kept</p><P ID='x'>too") == ["kept", "too"]
    assert texts("<script>never closed <p>gone") == texts("<!-- never closed <p>gone") == []
    assert texts("<td>1<td>2<tr><td>3") == ["1", "2", "3"]
    assert texts("<button>no<div>no</div></button><div hidden>no</div><div style='display: none'>no<p>no</div>yes") == ["yes"]
    assert [(b.text, b.linked) for b in main_text.blocks("<div><a href=x>open link</div><div>after</div>")] == [("open link", 2), ("after", 0)]
    assert texts("fish&amp;chips &lt;p&gt; caf&eacute;&#x21;") == ["fish&chips <p> café!"]


PAGE = """<!DOCTYPE html><html><head><title>No title</title><style>p{{}}</style></head><body class="has-sidebar">
<header><div class="logo"><a href="/">Site</a></div></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice">We use cookies. {long}</div>
<article class="post"><header><h1>The &amp; title</h1></header><p>{first}
   broken <b>line</b><br>and on<p>Short.<aside>Beside: {long}</aside><blockquote>A quote</blockquote><p>{second}</p>
<div class="share"><a href="#">Share</a> <a href="#">Like</a></div></article>
<form action="/"><label>Your name</label><p>{long}</p></form>
<section class="comments"><h3>2 comments</h3><article class="comment"><p>{long}</p></article></section>
<div id="sidebar"><p>{long}</p></div><footer>&copy; {long}</footer></body></html>"""


def test_article_without_what_stands_beside_it(spark):
    rng = random.Random(2)
    long, first, second = prose(rng, 70), prose(rng, 40), prose(rng, 300)
    page = PAGE.format(long=long, first=first, second=second)
    plain_page = f"<body><div><a href=/>Home</a></div><div><a href=/x>More</a></div><div>{first}</div><p>{second}</p><div class=ad>{long}</div>"
    rows = [(1, "u", page), (1, "u", page), (None, None, None), (2, "v", ""), (3, "w", "<p></p> <!-- x -->"), (4, None, plain_page)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, k0 int, text string")
    got = main_text.extract(pages).collect()
    want = "\n".join(["The & title", f"{first} broken line and on", "Short.", "A quote", second])
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, "u", want, len(want))] * 2 + [(None, None, "", 0), (2, "v", "", 0), (3, "w", "", 0), (4, None, f"{first}\n{second}", len(first) + len(second) + 1)]))
    assert main_text.extract(pages.filter("false")).count() == 0


def test_long_pages_take_time_in_proportion():
    for piece in ("<p>a b c", "<div>", '<a "', "< ", "&amp;<b>", "<li>x", "</p>", "<script>"):
        begun = time.perf_counter()
        list(main_text.blocks(piece * 200_000))
        assert time.perf_counter() - begun < 20


def test_tree_fits_its_table_and_learns_a_rule():
    rows = main_text.labelled_blocks()
    assert len(rows) <= 200 and all(main_text._label(main_text.default_tree(), x) == y for x, y in rows)
    rng = random.Random(3)
    data = [((rng.random(), rng.random()), 0) for _ in range(200)]
    data = [(x, int(x[0] > 0.5 and x[1] <= 0.3)) for x, _ in data]
    tree = main_text.grow(data)
    assert all(main_text._label(tree, x) == y for x, y in data) and main_text.grow([]) == 0 and main_text.grow([((1.0,), 1)] * 3) == 1
