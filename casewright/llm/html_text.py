"""Main text of web pages: flat text blocks, their neighbours' words and link density, and a trained decision tree."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from casewright.llm.common import steps

TOKEN = re.compile(
    r"""(?P<skip><!--.*?(?:-->|\Z)|<(?P<raw>script|style|title|textarea)\b[^>]*+(?:>|\Z).*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*+(?:>|\Z))"""
    r"""|<(?P<close>/?)(?P<name>[a-z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|(?P<cut></?[a-z][^>]*+(?:>|\Z))""",
    re.S | re.I,
)
HINTS = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements and words of class, id or role that stand for something other than the article.
SHELL_TAGS = frozenset(
    "nav header footer aside form button select option noscript template svg iframe dialog menu object".split()
)
SHELL_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead topbar footer sidebar aside widget widgets "
    "related recommended recommendations ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner "
    "cookie cookies consent notice notices gdpr popup modal overlay alert newsletter subscribe subscription signup login "
    "comment comments commentlist replies respond disqus copyright pagination pager toolbar contentinfo complementary "
    "dialog".split()
)
#: Words that name parts of articles about as often.
DOUBTFUL_WORDS = frozenset("header share sharing social reply search form".split())
#: Words inside of which a nested article is not the page's article.
CLOSED_WORDS = frozenset(
    "aside sidebar widget widgets related recommended recommendations comment comments commentlist replies respond "
    "disqus footer complementary contentinfo".split()
)
CORE_TAGS = frozenset(["article", "main"])
CORE_WORDS = frozenset("article post entry story main content articlebody postbody entrybody".split())
CONTAINERS = frozenset("article center div main section table tbody td tr".split())
#: How surely the markup says that a block is not of the article: a heading's own name, a doubtful name, a clear one.
HEADING, DOUBTFUL, CLEAR = 0.25, 0.5, 1.0
#: What marks the article: nothing, the name of a container, its tag.
NAMED, TAGGED = 1, 2
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass
class Block:
    """Text between two block-level tags."""

    shell: float
    core: int
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    text: str = ""
    words: int = 0
    density: float = 0.0


def _hints(rest: str) -> set[str]:
    found: set[str] = set()
    if "=" in rest:
        for groups in HINTS.findall(rest):
            found.update(WORDS.findall("".join(groups).lower()))
    return found


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order. Broken markup is read leniently: an end tag closes up to its start tag."""
    stack: list[tuple[str, float, bool, int]] = []  # name, shell, closed, core
    opened: Counter[str] = Counter()
    shell, closed, core = 0.0, False, 0
    links = 0
    found: list[Block] = []
    block = Block(0.0, 0)

    def flush() -> None:
        nonlocal block
        if block.parts:
            found.append(block)
        block = Block(shell, core)

    def leave() -> str:
        """Close the innermost element; what is around it holds again."""
        nonlocal shell, closed, core
        name = stack.pop()[0]
        opened[name] -= 1
        _, shell, closed, core = stack[-1] if stack else ("", 0.0, False, 0)
        return name

    def say(text: str) -> None:
        if text:
            if not block.parts:
                block.shell, block.core = shell, core
            block.parts.append(text)
            if links:
                block.linked.append(text)

    at = 0
    for token in TOKEN.finditer(page):
        say(page[at : token.start()])
        at = token.end()
        if token["name"] is None:
            continue
        name, ends = token["name"].lower(), bool(token["close"])
        if name == "br":
            say(" ")
            continue
        if name not in INLINE:
            flush()
            links = 0
        if name == "a":
            links = 0 if ends else 1
        if name in VOID:
            continue
        if ends:
            if opened[name]:
                flush()
                while leave() != name:
                    pass
            continue
        hints = _hints(token["rest"])
        named = hints if name not in ("body", "html") else set()
        clear = name in SHELL_TAGS or bool(named & SHELL_WORDS)
        doubtful = bool(named & DOUBTFUL_WORDS)
        is_core = TAGGED if name in CORE_TAGS else NAMED if name in CONTAINERS and named & CORE_WORDS else 0
        if name in INLINE and not clear and not doubtful:
            continue
        if name in SELF_CLOSING and stack and stack[-1][0] in SELF_CLOSING[name]:
            leave()
        if name in HEADINGS:  # its name is often its own text
            if shell < CLEAR and (shell or clear or doubtful):
                shell = HEADING
        elif clear:
            shell, closed = CLEAR, closed or name in ("aside", "footer") or bool(named & CLOSED_WORDS)
        elif is_core and not closed:
            shell, core = DOUBTFUL if doubtful else 0.0, max(core, is_core)
        elif doubtful:
            shell = max(shell, DOUBTFUL)
        flush()  # an inline advert ends a block as well
        stack.append((name, shell, closed, core))
        opened[name] += 1
    say(page[at:])
    flush()
    kept = []
    for b in found:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
        if b.text:
            b.words = b.text.count(" ") + 1
            linked = len(" ".join(html.unescape(" ".join(b.linked)).split()).split()) if b.linked else 0
            b.density = min(1.0, linked / b.words)
            kept.append(b)
    return kept


COLUMNS = ("words", "density", "words before", "density before", "words after", "density after", "shell", "place")
#: Hand-labelled blocks: the features of COLUMNS and whether the block is article text. ``shell``: how surely names and
#: tags around the block say menu, header, footer, sidebar, notice, advert, form or comments. ``place``: 1 inside of
#: what marks the article, 0.5 on a page without a mark, 0.25 outside of a container whose name alone marks it and that
#: holds most of the text, 0 outside of one that a tag marks.
LABELLED = (
    # inside the article: paragraphs, headings, lists, one-word paragraphs, linked words
    (9, 0.0, 1, 1.0, 34, 0.0, 0, 1, 1),
    (85, 0.0, 9, 0.0, 60, 0.02, 0, 1, 1),
    (1, 0.0, 85, 0.0, 42, 0.0, 0, 1, 1),
    (12, 0.5, 3, 1.0, 70, 0.0, 0, 1, 1),
    (24, 0.1, 1, 0.0, 8, 0.0, 0, 1, 1),
    (6, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1),
    (11, 0.0, 6, 1.0, 2, 1.0, 0, 1, 1),
    (4, 0.0, 1, 1.0, 5, 0.5, 0, 1, 1),
    (15, 0.9, 7, 0.0, 10, 0.0, 0, 1, 1),
    (1, 0.0, 1, 0.0, 1, 0.0, 0, 1, 1),
    (8, 0.0, 12, 0.0, 11, 1.0, 0, 1, 1),
    (40, 0.7, 5, 0.0, 3, 0.0, 0, 1, 1),
    (2, 0.0, 120, 0.0, 2, 0.0, 0, 1, 1),
    (140, 0.0, 2, 0.0, 9, 0.3, 0, 1, 1),
    (4, 1.0, 40, 0.0, 30, 0.0, 0, 1, 1),
    (9, 1.0, 25, 0.0, 60, 0.0, 0, 1, 1),
    (2, 1.0, 7, 0.0, 14, 0.0, 0, 1, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1),
    (5, 0.0, 1, 1.0, 1, 0.0, 0, 1, 1),
    (2, 0.0, 5, 0.0, 4, 0.0, 0, 1, 1),
    (3, 0.0, 2, 0.0, 1, 0.0, 0, 1, 1),
    (4, 0.0, 6, 0.0, 2, 0.0, 0, 1, 1),
    (1, 0.0, 4, 0.0, 3, 1.0, 0, 1, 1),
    (7, 0.0, 2, 1.0, 4, 0.0, 0, 1, 1),
    (2, 0.0, 9, 0.0, 0, 0.0, 0, 1, 1),
    (12, 0.0, 3, 0.0, 5, 0.0, 0, 1, 1),
    (16, 0.0, 20, 0.0, 18, 0.0, 0, 1, 1),
    (22, 0.0, 7, 0.0, 1, 1.0, 0, 1, 1),
    (6, 0.2, 150, 0.0, 13, 0.0, 0, 1, 1),
    (10, 0.0, 220, 0.0, 2, 0.0, 0, 1, 1),
    (3, 0.0, 130, 0.0, 160, 0.0, 0, 1, 1),
    (19, 0.3, 26, 0.0, 6, 0.0, 0, 1, 1),
    (31, 0.0, 2, 0.0, 1, 0.0, 0, 1, 1),
    (5, 0.4, 14, 0.1, 33, 0.0, 0, 1, 1),
    (260, 0.0, 4, 0.0, 0, 0.0, 0, 1, 1),
    (1, 0.0, 200, 0.0, 7, 0.2, 0, 1, 1),
    (8, 0.0, 0, 0.0, 3, 0.0, 0, 1, 1),
    (2, 0.0, 2, 1.0, 70, 0.0, 0, 1, 1),
    (4, 0.5, 3, 0.0, 2, 0.0, 0, 1, 1),
    (14, 0.0, 1, 0.0, 10, 1.0, 0, 1, 1),
    (9, 0.0, 55, 0.3, 0, 0.0, 0, 1, 1),
    (5, 1.0, 90, 0.0, 70, 0.0, 0, 1, 1),
    (3, 1.0, 120, 0.0, 0, 0.0, 0, 1, 1),
    (7, 0.7, 60, 0.0, 6, 0.0, 0, 1, 1),
    (1, 0.0, 90, 0.0, 0, 0.0, 0, 1, 1),
    (1, 0.0, 60, 0.0, 0, 0.0, 0, 1, 1),
    (1, 0.0, 300, 0.0, 0, 0.0, 0, 1, 1),
    (3, 0.0, 20, 0.0, 12, 1.0, 0, 1, 1),
    (5, 0.0, 60, 0.0, 4, 1.0, 0, 1, 1),
    (2, 0.0, 30, 0.0, 2, 0.9, 0, 1, 1),
    (6, 0.1, 3, 1.0, 5, 1.0, 0, 1, 1),
    (1, 0.0, 2, 1.0, 1, 1.0, 0, 1, 1),
    (3, 1.0, 12, 0.0, 20, 0.0, 0, 1, 1),
    (6, 1.0, 4, 0.0, 35, 0.0, 0, 1, 1),
    (1, 1.0, 18, 0.0, 8, 0.0, 0, 1, 1),
    (10, 1.0, 70, 0.0, 1, 0.0, 0, 1, 1),
    (2, 1.0, 28, 0.0, 26, 0.0, 0, 1, 1),
    # inside the article against it: lists of links without a name
    (3, 1.0, 40, 0.0, 3, 1.0, 0, 1, 0),
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 1, 0),
    (4, 1.0, 3, 1.0, 5, 1.0, 0, 1, 0),
    (6, 1.0, 4, 1.0, 0, 0.0, 0, 1, 0),
    (2, 1.0, 2, 1.0, 50, 0.0, 0, 1, 0),
    (3, 1.0, 2, 0.0, 4, 1.0, 0, 1, 0),
    (1, 1.0, 30, 0.0, 2, 1.0, 0, 1, 0),
    (1, 1.0, 2, 1.0, 1, 1.0, 0, 1, 0),
    (5, 1.0, 12, 1.0, 8, 1.0, 0, 1, 0),
    (2, 1.0, 1, 1.0, 90, 0.0, 0, 1, 0),
    (3, 1.0, 80, 0.0, 1, 1.0, 0, 1, 0),
    (8, 1.0, 6, 0.9, 140, 0.0, 0, 1, 0),
    (4, 1.0, 100, 0.0, 6, 1.0, 0, 1, 0),
    (2, 1.0, 60, 0.0, 9, 0.9, 0, 1, 0),
    # doubtful names: words and links decide
    (45, 0.0, 12, 0.0, 80, 0.0, 0.5, 1, 1),
    (60, 0.02, 0, 0.0, 0, 0.0, 0.5, 1, 1),
    (30, 0.0, 5, 0.0, 0, 0.0, 0.5, 1, 1),
    (28, 0.1, 2, 1.0, 30, 0.0, 0.5, 1, 1),
    (50, 0.0, 0, 0.0, 44, 0.0, 0.5, 0.5, 1),
    (2, 0.0, 50, 0.0, 60, 0.0, 0.5, 1, 0),
    (1, 0.0, 0, 0.0, 1, 0.0, 0.5, 1, 0),
    (1, 0.0, 40, 0.0, 1, 0.0, 0.5, 1, 0),
    (3, 1.0, 40, 0.0, 2, 1.0, 0.5, 1, 0),
    (8, 0.0, 70, 0.0, 35, 0.0, 0.5, 1, 0),
    (30, 0.8, 60, 0.0, 40, 0.0, 0.5, 1, 0),
    (4, 0.0, 3, 1.0, 0, 0.0, 0.5, 0.5, 0),
    (40, 0.0, 6, 0.0, 20, 0.0, 0.5, 0, 0),
    (2, 0.0, 0, 0.0, 45, 0.0, 0.5, 0, 0),
    (40, 0.0, 50, 0.0, 60, 0.0, 0.5, 1, 1),
    (90, 0.0, 30, 0.0, 8, 0.0, 0.5, 1, 1),
    (36, 0.0, 110, 0.0, 140, 0.0, 0.5, 1, 1),
    (24, 0.05, 20, 0.0, 66, 0.0, 0.5, 1, 1),
    (70, 0.0, 2, 0.0, 0, 0.0, 0.5, 1, 1),
    (3, 0.0, 25, 0.0, 28, 0.0, 0.5, 1, 0),
    (6, 0.0, 10, 0.0, 90, 0.0, 0.5, 1, 0),
    (9, 0.3, 120, 0.0, 15, 0.0, 0.5, 1, 0),
    (1, 1.0, 40, 0.0, 2, 1.0, 0.5, 1, 0),
    (1, 1.0, 2, 1.0, 60, 0.0, 0.5, 1, 0),
    # headings with such names: what follows decides
    (3, 0.0, 60, 0.0, 50, 0.0, 0.25, 1, 1),
    (6, 0.0, 0, 0.0, 25, 0.0, 0.25, 1, 1),
    (2, 0.0, 80, 0.0, 90, 0.1, 0.25, 1, 1),
    (4, 0.0, 9, 0.0, 30, 0.0, 0.25, 0.5, 1),
    (2, 0.0, 70, 0.0, 3, 1.0, 0.25, 1, 0),
    (3, 0.0, 45, 0.0, 5, 1.0, 0.25, 1, 0),
    (1, 0.0, 90, 0.0, 0, 0.0, 0.25, 1, 0),
    (2, 0.0, 50, 0.0, 40, 0.0, 0.25, 0, 0),
    (2, 0.0, 33, 0.0, 36, 0.0, 0.25, 1, 1),
    (5, 0.0, 24, 0.0, 27, 0.0, 0.25, 1, 1),
    (3, 0.0, 12, 0.0, 41, 0.0, 0.25, 1, 1),
    (1, 0.0, 100, 0.0, 18, 0.0, 0.25, 1, 1),
    (7, 0.0, 40, 0.0, 75, 0.0, 0.25, 1, 1),
    (2, 0.0, 20, 0.0, 4, 1.0, 0.25, 1, 0),
    # outside of a container whose name alone marks it: an article in two parts, and what is not
    (70, 0.0, 9, 0.0, 90, 0.0, 0, 0.25, 1),
    (55, 0.0, 60, 0.0, 48, 0.0, 0, 0.25, 1),
    (48, 0.05, 80, 0.0, 3, 0.0, 0, 0.25, 1),
    (8, 0.0, 4, 1.0, 66, 0.0, 0, 0.25, 0),
    (3, 1.0, 2, 1.0, 9, 0.0, 0, 0.25, 0),
    (12, 0.0, 40, 0.0, 0, 0.0, 0, 0.25, 0),
    (20, 0.3, 50, 0.0, 4, 1.0, 0, 0.25, 0),
    (5, 0.0, 2, 1.0, 3, 0.0, 0, 0.25, 0),
    # inside a shell: menus, footers, long adverts and comments, forms
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0),
    (2, 1.0, 1, 1.0, 9, 0.0, 1, 0.5, 0),
    (7, 0.0, 1, 1.0, 10, 0.0, 1, 0, 0),
    (45, 0.0, 12, 0.0, 80, 0.0, 1, 1, 0),
    (60, 0.02, 80, 0.0, 31, 0.0, 1, 1, 0),
    (11, 0.0, 66, 0.0, 0, 0.0, 1, 0, 0),
    (30, 0.1, 70, 0.0, 0, 0.0, 1, 0.5, 0),
    (3, 0.0, 50, 0.0, 2, 0.0, 1, 1, 0),
    (18, 0.0, 5, 0.0, 7, 0.0, 1, 0.5, 0),
    (1, 0.0, 60, 0.0, 90, 0.0, 1, 1, 0),
    (70, 0.0, 3, 0.0, 110, 0.0, 1, 0, 0),
    (90, 0.0, 40, 0.0, 55, 0.0, 1, 0.5, 0),
    (20, 0.0, 9, 0.0, 48, 0.0, 1, 0.5, 0),
    (35, 0.3, 70, 0.0, 64, 0.0, 1, 0, 0),
    (9, 0.0, 20, 0.0, 77, 0.0, 1, 1, 0),
    (5, 1.0, 30, 0.0, 52, 0.0, 1, 0.5, 0),
    (25, 0.0, 60, 0.0, 25, 0.0, 1, 1, 0),
    (80, 0.0, 25, 0.0, 5, 0.0, 1, 1, 0),
    (6, 0.0, 45, 0.0, 50, 0.0, 1, 1, 0),
    (15, 0.0, 15, 0.0, 16, 0.0, 1, 1, 0),
    (120, 0.0, 90, 0.0, 85, 0.0, 1, 1, 0),
    (10, 0.0, 8, 0.0, 38, 0.0, 1, 1, 0),
    (50, 0.0, 4, 0.0, 120, 0.0, 1, 1, 0),
    (38, 0.0, 150, 0.0, 0, 0.0, 1, 1, 0),
    (2, 0.0, 30, 0.0, 200, 0.0, 1, 1, 0),
    (65, 0.0, 65, 0.0, 60, 0.0, 1, 0.25, 0),
    (28, 0.0, 33, 0.0, 75, 0.0, 1, 0.5, 0),
    (55, 0.0, 8, 0.0, 9, 0.0, 1, 0.25, 0),
    (100, 0.0, 5, 0.0, 0, 0.0, 1, 0.5, 0),
    (8, 0.0, 0, 0.0, 65, 0.0, 1, 0.5, 0),
    # outside of an article that a tag marks
    (8, 0.0, 4, 1.0, 66, 0.0, 0, 0, 0),
    (70, 0.0, 9, 0.0, 90, 0.0, 0, 0, 0),
    (25, 0.0, 90, 0.0, 50, 0.0, 0, 0, 0),
    (3, 0.0, 60, 0.0, 58, 0.0, 0, 0, 0),
    (8, 0.0, 1, 1.0, 9, 0.0, 0, 0, 0),
    (40, 0.0, 8, 0.0, 9, 0.0, 0, 0, 0),
    (4, 1.0, 4, 1.0, 25, 0.0, 0, 0, 0),
    (14, 0.2, 90, 0.0, 0, 0.0, 0, 0, 0),
    (90, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0),
    (4, 1.0, 90, 0.0, 70, 0.0, 0, 0, 0),
    (3, 1.0, 12, 0.0, 60, 0.0, 0, 0, 0),
    (7, 1.0, 120, 0.0, 0, 0.0, 0, 0, 0),
    (6, 1.0, 30, 0.0, 25, 0.0, 0, 0.25, 0),
    (2, 1.0, 80, 0.0, 90, 0.0, 0, 0.5, 0),
    # pages without a marked article: words and links of the block and its neighbours decide
    (60, 0.0, 50, 0.0, 70, 0.0, 0, 0.5, 1),
    (35, 0.05, 8, 0.0, 55, 0.0, 0, 0.5, 1),
    (110, 0.1, 3, 1.0, 6, 0.0, 0, 0.5, 1),
    (28, 0.0, 2, 1.0, 3, 1.0, 0, 0.5, 1),
    (20, 0.2, 44, 0.0, 18, 0.0, 0, 0.5, 1),
    (18, 0.0, 60, 0.0, 5, 0.0, 0, 0.5, 1),
    (9, 0.0, 48, 0.0, 52, 0.0, 0, 0.5, 1),
    (4, 0.0, 70, 0.0, 65, 0.0, 0, 0.5, 1),
    (1, 0.0, 33, 0.0, 80, 0.1, 0, 0.5, 1),
    (7, 0.0, 3, 1.0, 60, 0.0, 0, 0.5, 1),
    (10, 0.0, 0, 0.0, 45, 0.0, 0, 0.5, 1),
    (6, 0.0, 40, 0.1, 22, 0.0, 0, 0.5, 1),
    (2, 1.0, 0, 0.0, 2, 1.0, 0, 0.5, 0),
    (3, 1.0, 2, 1.0, 40, 0.0, 0, 0.5, 0),
    (14, 0.9, 50, 0.0, 12, 0.8, 0, 0.5, 0),
    (2, 1.0, 0, 0.0, 2, 0.0, 0, 0.5, 0),
    (3, 1.0, 0, 0.0, 60, 0.0, 0, 0.5, 0),
    (1, 1.0, 60, 0.0, 0, 0.0, 0, 0.5, 0),
    (4, 1.0, 9, 0.0, 30, 0.0, 0, 0.5, 0),
    (12, 0.8, 45, 0.0, 50, 0.0, 0, 0.5, 0),
    (40, 0.8, 4, 1.0, 5, 1.0, 0, 0.5, 0),
    (25, 0.6, 30, 0.0, 4, 1.0, 0, 0.5, 0),
    (5, 0.0, 3, 1.0, 2, 1.0, 0, 0.5, 0),
    (6, 0.0, 70, 0.0, 0, 0.0, 0, 0.5, 0),
    (8, 0.1, 2, 1.0, 0, 0.0, 0, 0.5, 0),
    (3, 0.0, 3, 0.0, 3, 0.0, 0, 0.5, 0),
    (11, 0.2, 4, 0.5, 3, 1.0, 0, 0.5, 0),
)


@dataclass(frozen=True)
class Node:
    """A test of one feature, or a leaf with its answer."""

    answer: bool
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def decide(self, features: tuple[float, ...]) -> bool:
        node = self
        while node.low is not None and node.high is not None:
            node = node.low if features[node.feature] <= node.limit else node.high
        return node.answer


def grow(x: np.ndarray, y: np.ndarray) -> Node:
    """A decision tree by Gini impurity, split until pure; ties go to the first feature and the lower limit."""
    answer = bool(2 * y.sum() >= len(y))
    if y.min() == y.max():
        return Node(answer)

    def impurity(part: np.ndarray) -> float:
        share = part.mean()
        return len(part) * share * (1 - share)

    best = None
    for feature in (1, 0, 3, 5, 2, 4, 7, 6):  # links and words of the block, its neighbours', what markup names
        values = np.unique(x[:, feature])
        for limit in (values[1:] + values[:-1]) / 2:
            left = x[:, feature] <= limit
            cost = impurity(y[left]) + impurity(y[~left])
            if best is None or cost < best[0] - 1e-12:
                best = (cost, feature, float(limit), left)
    if best is None:
        return Node(answer)
    _, feature, limit, left = best
    return Node(answer, feature, limit, grow(x[left], y[left]), grow(x[~left], y[~left]))


def train(labelled: tuple[tuple[float, ...], ...] = LABELLED) -> Node:
    rows = np.array(labelled, dtype=np.float64)
    return grow(rows[:, :-1], rows[:, -1])


def main_text(page: str, tree: Node) -> str:
    """The blocks that the tree takes for article text, one a line."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    own = [b for b in blocks if b.shell < CLEAR]
    tagged = any(b.core == TAGGED for b in own)
    named = not tagged and 2 * sum(b.words for b in own if b.core) >= sum(b.words for b in own) > 0
    least = TAGGED if tagged else NAMED if named else TAGGED + 1
    outside = 0.0 if tagged else 0.25 if named else 0.5
    edge = Block(0.0, 0)
    kept = []
    for before, b, after in zip([edge, *blocks[:-1]], blocks, [*blocks[1:], edge], strict=True):
        place = 1.0 if b.core >= least else outside
        if tree.decide((b.words, b.density, before.words, before.density, after.words, after.density, b.shell, place)):
            kept.append(b.text)
    return "\n".join(kept)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", tree: Node | None = None) -> DataFrame:
    """The pages with their main text in place of the markup.

    Pages are read where they lie, each whole. Character references are decoded, white space inside a block becomes
    one space, blocks are joined by one line feed. Null or empty pages, and pages without article text, give the
    empty text. Repeated rows give equal texts; a column with the text's name is replaced; an empty table gives an
    empty result.
    """
    chosen = tree or train()
    others = [c for c in pages.columns if c not in (html_col, text_col)]
    kept = pages.select(*others, F.col(html_col).alias(text_col))
    schema = StructType([*[pages.schema[c] for c in others], StructField(text_col, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text_col):
            texts = [main_text(p or "", chosen) for p in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], batch.schema.names)

    return kept.mapInArrow(run, schema)
