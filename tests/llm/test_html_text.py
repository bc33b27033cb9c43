from __future__ import annotations

import pytest

from casewright.llm.html_text import LABELLED, Node, blocks_of, extract, grow, main_text, train

TREE = train()

PAGE = """<!DOCTYPE html><html><head><title>Site</title><style>p{}</style><script>var t="<p>no</p>";</script></head>
<body class="home"><header><a href="/">Site</a></header><nav><ul><li><a href=1>One</a></li></ul></nav><!-- <p>gone</p> -->
<div class="cookie-notice"><p>We use cookies on this site and so on and so forth, for many more words.</p></div>
<article><h1>The  title</h1><p>Short.</p><p>Some &lt;text&gt; &amp; <a href="x>y">a link</a>,
over&nbsp;lines</p><div class="ad">Buy this</div><ul><li>First<li>Second</ul><blockquote>Quoted</blockquote>
<form><label>Name</label><input></form><table><tr><td>1<td>2</table>
<section id="comments"><article class="comment"><p>A very long comment by a reader who writes many words about it all.</p></article></section>
</article><aside><p>Related words</p></aside><footer>&copy; Site</footer></body></html>"""


def test_article_alone():
    assert main_text(PAGE, TREE).split("\n") == ["The title", "Short.", "Some <text> & a link, over lines", "First", "Second", "Quoted", "1", "2"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("   ", ""),
        ("<article><p>cut of</article", "cut of"),
        ("<article><p><b>bold<br><p>next <i>one", "bold\nnext one"),
        ("<article>a &am <a href='never closed>b</article>", "a &am b"),
        ("<article>1 < 2 and <3 & 4 > 3</article>", "1 < 2 and <3 & 4 > 3"),
        ("<main><p>x<!-- a --> y<!-- open", "x y"),
        ("<article><p>a</p><script>b", "a"),
        ("<div class=ad>long advert " + "word " * 90 + "</div><article><p>a</p></article>", "a"),
        ("<article><span class='share'>Share</span> text</article>", "text"),
        ("<article><p>&#x41;&#66;&quot;&unknown;</p></article>", 'AB"&unknown;'),
        ("<nav>deep</nav><article>x", "x"),
    ],
)
def test_odd_markup(page, text):
    assert main_text(page, TREE) == text


def test_a_page_without_a_marked_article():
    long = "word " * 60
    page = f"<div><a href=1>Home</a> <a href=2>News</a></div><div>Headline here</div><div>{long}</div><p>ok.</p><div>{long}</div><div><a href=3>Imprint</a></div>"
    assert main_text(page, TREE).split("\n") == ["Headline here", long.strip(), "ok.", long.strip()]


LONG = " ".join(["a long sentence of an article that goes on"] * 4)
MENU = "<ul><li><a href=1>Home</a><li><a href=2>World news</a><li><a href=3>Sport</a></ul>"


def test_names_against_the_text():
    heading_alone = f"{MENU}<h1 class='entry-title'>A headline</h1><p>{LONG}</p><p>{LONG}</p>"
    assert main_text(heading_alone, TREE).split("\n") == ["A headline", LONG, LONG]
    assert main_text(f"<div class='search-result-story content'><p>{LONG}</p></div>", TREE) == LONG
    assert main_text(f"<article><div class='social-reply'><p>{LONG}</p></div></article>", TREE) == LONG
    # the same names around short or linked text
    assert main_text(f"<article><p>{LONG}</p><div class='social-share'>Share this</div><p>{LONG}</p></article>", TREE) == f"{LONG}\n{LONG}"
    assert main_text(f"<article><p>{LONG}</p><div class='search'>{MENU}</div></article>", TREE) == LONG
    # a heading named by its own text; lists of links inside the article without a name
    page = f"<article><p>{LONG}</p><h2 id='related-work'>Related work</h2><p>{LONG}</p>{MENU}</article>"
    assert main_text(page, TREE).split("\n") == [LONG, "Related work", LONG]
    assert main_text(f"<article><p>{LONG}</p><p><a href=1>See here</a></p><p>{LONG}</p></article>", TREE).split("\n")[1] == "See here"


#: Held-out pages, labelled by hand: each block with 1 (article) or 0.
HELD_OUT = [
    [("<div class='topbar'>", "Call us today", 0), (MENU, "Home", 0), ("<div id='story'><h1>", "Floods in the north", 1), ("</h1><p>", LONG, 1),
     ("</p><h2>", "What comes next", 1), ("</h2><p>", LONG, 1), ("</p><blockquote>", "We are tired, said one of them.", 1), ("</blockquote></div><div class='newsletter'>", LONG, 0)],
    [("<main><nav><a>", "Start", 0), ("</a></nav><h1>", "Recipe", 1), ("</h1><li>", "Two eggs", 1), ("</li><li>", "Salt", 1), ("</li><p>", LONG, 1),
     ("</p><section class='comments'><p>", LONG, 0), ("</p></section></main><footer>", "All rights", 0)],
    [("<table><tr><td><a href=1>", "Index", 0), ("</a><td><a href=2>", "Archive", 0), ("</a><tr><td><p>", LONG, 1), ("</p><p>", LONG + " " + LONG, 1), ("</p></table><p><a href=3>", "Contact", 0)],
    [("<div class='post'><p>", LONG, 1), ("</p><p>", "Yes.", 1), ("</p><div class='ads'>", "Buy shoes now", 0), ("</div><p>", LONG, 1), ("</p></div><aside>", LONG, 0), ("</aside><div>", "Printed on paper", 0)],
    [("<article><h1 id='search'>", "Search engines", 1), ("</h1><p>", LONG, 1), ("</p><pre>", "x = 1", 1), ("</pre><p>", LONG, 1), ("</p><ul><li><a>", "Older", 0), ("</a><li><a>", "Newer", 0),
     ("</a><li><a>", "Random", 0), ("</a></ul></article><div>", "Powered by paper", 0)],
]


def test_held_out_blocks():
    right = found = wanted = 0
    for page in HELD_OUT:
        texts = main_text("".join(f"{markup}{text}" for markup, text, _ in page), TREE).split("\n")
        want = [text for _, text, kept in page if kept]
        right += sum(min(texts.count(text), want.count(text)) for text in set(want))
        found, wanted = found + len(texts), wanted + len(want)
    assert right / found >= 0.9, (right, found)
    assert right / wanted >= 0.9, (right, wanted)


def test_words_and_links_of_blocks_and_neighbours_decide():
    def features(node: Node) -> set[int]:
        return set() if node.low is None else {node.feature} | features(node.low) | features(node.high)

    assert features(TREE) >= {0, 1, 3, 4, 5}
    # inside a marked article: equal but for the words, the links, or the neighbours' links
    inside = {"long": (60, 0, 30, 0, 9, 0, 0.5, 1), "short": (3, 0, 30, 0, 9, 0, 0.5, 1)}
    assert TREE.decide(inside["long"]) and not TREE.decide(inside["short"])
    alone, listed = (3, 1.0, 30, 0.0, 30, 0.0, 0, 1), (3, 1.0, 30, 0.0, 30, 1.0, 0, 1)
    assert TREE.decide(alone) and not TREE.decide(listed) and TREE.decide((3, 0.0, *listed[2:]))


def test_unfinished_markup_is_read_in_linear_time():
    assert main_text("<a href=" + "'\"" * 200_000, TREE) == ""
    assert len(blocks_of("<" * 200_000)) == 1
    assert main_text("<article>" + "<div>" * 20_000 + "x", TREE) == "x"


def test_tree_fits_its_table_and_handles_equal_rows():
    assert all(TREE.decide(row[:-1]) == bool(row[-1]) for row in LABELLED)
    import numpy as np

    assert grow(np.zeros((3, 8)), np.array([1.0, 0, 1])) == Node(True)


def test_edge_cases(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (3, "", "", "x"), (None, "v", "<article>" + "y " * 300_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = extract(df)
    assert found.columns == ["page_id", "url", "text"]
    texts = sorted((r["page_id"] or 0, len(r["text"])) for r in found.collect())
    one = len(main_text(PAGE, TREE))
    assert texts == [(0, 599_999), (1, one), (1, one), (2, 0), (3, 0)]
    assert extract(df.limit(0)).collect() == []
