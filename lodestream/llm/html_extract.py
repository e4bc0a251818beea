"""Main text of web pages: flat text blocks, features of each block and its neighbours, a small decision tree.

The page is cut into blocks at block-level tags. A block has its word count and link density, those of the
blocks before and after it, its share of the page's words, and what its ancestors say: furniture by tag or role,
furniture by the whole words of their class and id names, article, heading. A decision tree, grown on the blocks of the
small labelled pages below, tells main text from the rest; nothing else is dropped, and no length is capped.
The pages are taken as they stand, without their names, and without any marks: on pages that say nothing of their parts the tree goes by
link density, word counts and the neighbours' counts and densities.

Defined cases: null identifiers are carried like others; null and empty pages, and pages without main text, give the empty string; unclosed, stray and
overlapping tags are tolerated; references are decoded; an empty table gives an empty result; repeated rows
are extracted alike; only the columns named are read, so other columns cannot clash.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.tables import table

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+>"""
    r"""|<([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>|<([a-zA-Z][^\s/>]*+)([^>]*+)>|</?[a-zA-Z][^>]*+\Z""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|\b(hidden)\b""")
_NAME_PART = re.compile(r"[a-z]+")

#: Elements whose content is no text of the page.
UNSEEN = frozenset("script style noscript template iframe object embed svg canvas audio video head title textarea select option datalist".split())
#: Of these, the ones whose content is not markup.
RAW = frozenset("script style noscript iframe textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img br math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded msub msup msubsup munder mover munderover mtable mtr mtd".split())
#: Elements that a new one of the same kind closes.
SELF_CLOSING = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6".split())
SCOPES = frozenset("ul ol dl table div section article body".split())
FURNITURE = frozenset("nav header footer aside form button menu dialog fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
#: Parts of class and id names that mark furniture, and those that mark the article.
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright dialog disclaimer discussion disqus footer gdpr "
    "header hidden legal login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related "
    "replies reply respond search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription tags toc toolbar widget widgets".split()
)
ARTICLE_NAMES = frozenset("article content entry main post story".split())
#: Names of what readers write, tags that say furniture by themselves, and elements whose own marks never count.
READER_NAMES = frozenset("comment comments discussion disqus replies reply respond".split())
FURNITURE_TAGS = FURNITURE - {"form", "fieldset"}
WHOLE = frozenset("html body main".split())


@dataclass(slots=True)
class Block:
    text: str
    words: int
    linked: int
    tagged: bool
    named: bool
    article: bool
    heading: int  # 6 for h1 to 1 for h6, else 0


@dataclass(slots=True)
class Element:
    tag: str
    above: int
    depth: int
    by_tag: bool
    by_name: bool
    article: bool
    main: bool
    readers: bool
    titles: bool  # a heading in a header of an article
    words: int = 0  # without links, as all counts here
    open_words: int = 0  # of them, those under no marked element within
    open_article: bool = False
    holds_article: bool = False
    holds_main: bool = False
    tagged: bool = False  # with those above
    named: bool = False

    @property
    def marked(self) -> bool:
        return self.by_tag or self.by_name

    @property
    def furniture(self) -> bool:
        return self.tagged or self.named


def _judge(elements: list[Element]) -> None:
    """Which elements are furniture, by their own marks or those above.

    Marks of html, body, main and of what holds main do not count. Nor do marks by name, role or form of an element
    that has more words than all text outside furniture, and holds an article or, where no article is outside, most of
    the page's words. Names of readers' comments count wherever an article is outside.
    """
    for e in elements:
        e.open_words = e.words
    for e in reversed(elements):
        e.open_article |= e.article and e.open_words > 0
        e.holds_article |= e.article
        e.holds_main |= e.main
        if e.above >= 0:
            up = elements[e.above]
            up.words += e.words
            up.holds_article |= e.holds_article
            up.holds_main |= e.holds_main
            if not e.marked:
                up.open_words += e.open_words
                up.open_article |= e.open_article
    total = sum(e.words for e in elements if e.above < 0)
    clean = sum(e.open_words for e in elements if e.above < 0 and not e.marked)
    clean_article = any(e.open_article for e in elements if e.above < 0 and not e.marked)
    for _, level in groupby(sorted(elements, key=lambda e: e.depth), key=lambda e: e.depth):
        freed = []
        for e in level:
            up = elements[e.above] if e.above >= 0 else None
            above = up
            if up is not None and up.furniture and e.titles and not elements[up.above].furniture:
                above = None
            e.tagged, e.named = above is not None and above.tagged, above is not None and above.named
            if e.marked and not e.furniture:
                soft = e.tag not in FURNITURE_TAGS and e.words > clean and not (e.readers and clean_article)
                if e.tag in WHOLE or e.holds_main or soft and (e.holds_article or not clean_article and 2 * e.words > total):
                    freed.append(e)
                    continue
            e.tagged, e.named = e.tagged or e.by_tag, e.named or e.by_name
        clean += sum(e.open_words for e in freed)
        clean_article |= any(e.open_article for e in freed)


def _marks(tag: str, attributes: str) -> tuple[bool, bool, bool, bool, bool, bool]:
    """What an element says of itself: unseen, furniture by tag or role, furniture by name, article, main, written by readers."""
    unseen, furniture, named, article = tag in UNSEEN, tag in FURNITURE, False, tag in ("article", "main")
    main, readers = tag == "main", False
    if attributes:
        for name, value, hidden in _ATTRIBUTE.findall(attributes):
            name = name.lower()
            value = value.strip("\"'").lower()
            if hidden or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                unseen = True
            elif name == "role":
                furniture |= value in FURNITURE_ROLES
                article |= value in ("main", "article")
                main |= value == "main"
            elif name in ("class", "id"):
                parts = set(_NAME_PART.findall(value))
                named |= bool(parts & FURNITURE_NAMES)
                readers |= bool(parts & READER_NAMES)
                article |= bool(parts & ARTICLE_NAMES) and not parts & FURNITURE_NAMES
    return unseen, furniture, named, article, main, readers


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []  # tag; with its ancestors: unseen, article; place in elements
    opened: defaultdict[str, list[int]] = defaultdict(list)  # the places in the stack of a tag, and under "" those of scopes
    endless: set[str] = set()  # formulas' sources that no tag closes any more
    elements: list[Element] = [Element("", -1, 0, False, False, False, False, False, False)]  # the page
    within: list[int] = []  # the element of each block
    pieces: list[str] = []
    linked: list[str] = []
    in_link, at = False, 0

    def end_block() -> None:
        nonlocal pieces, linked
        if pieces:
            words = html.unescape("".join(pieces)).split()
            if words:
                _, article, inner = stack[-1][1:] if stack else (False, False, 0)
                heading = max((7 - int(s[0][1]) for s in stack[-2:] if s[0] in HEADINGS), default=0)
                out.append(Block(" ".join(words), len(words), min(len(words), len(html.unescape(" ".join(linked)).split())), False, False, article, heading))
                within.append(inner)
                elements[inner].words += out[-1].words - out[-1].linked
            pieces, linked = [], []

    def text(part: str) -> None:
        if part and not (stack and stack[-1][1]):
            pieces.append(part)
            if in_link:
                linked.append(part)

    def push(tag: str, attributes: str) -> None:
        above = stack[-1][1:] if stack else (False, False, 0)
        unseen, furniture, named, article, main, readers = _marks(tag, attributes)
        titles = tag in HEADINGS and len(stack) > 1 and stack[-1][0] == "header" and stack[-2][2]
        opened[tag].append(len(stack))
        if tag in SCOPES:
            opened[""].append(len(stack))
        stack.append((tag, above[0] or unseen, above[1] or article, len(elements)))
        elements.append(Element(tag, above[2], elements[above[2]].depth + 1, furniture, named, article, main, readers, titles))

    def pop(place: int) -> None:
        """Close the elements of the stack from this place on."""
        for tag, *_ in stack[place:]:
            opened[tag].pop()
            if tag in SCOPES:
                opened[""].pop()
        del stack[place:]

    def last(tag: str) -> int:
        return opened[tag][-1] if opened[tag] else -1

    size = len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        closing, opening, attributes, badly_quoted, rest = found.groups()
        opening, attributes = opening or badly_quoted, attributes or rest or ""
        if opening:
            tag = opening.lower()
            if tag in VOID:
                if tag == "br":
                    text(" ")
                elif tag == "hr":
                    end_block()
                continue
            if tag == "a":
                in_link = True
                continue
            if tag in INLINE:
                continue
            if tag in ("annotation", "annotation-xml"):  # a formula's source beside the formula
                close = None if tag in endless else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if close:
                    at = close.end()
                else:
                    endless.add(tag)
                continue
            end_block()
            if tag in SELF_CLOSING:
                place = max(last(tag), last("p") if tag in HEADINGS else -1)
                if place > last(""):
                    pop(place)
            elif stack and stack[-1][0] == "p":
                pop(len(stack) - 1)
            push(tag, attributes)
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                at = close.start() if close else size
        elif closing:
            tag = closing.lower()
            if tag == "a":
                in_link = False
            elif tag == "p" and not opened["p"]:
                end_block()
            elif tag not in INLINE and opened[tag]:
                end_block()
                pop(last(tag))
                in_link = False
    end_block()
    _judge(elements)
    for block, inner in zip(out, within):
        block.tagged, block.named = elements[inner].tagged, elements[inner].named
    return out


FEATURES = ("words", "density", "words before", "density before", "words after", "density after", "share of the page", "page has marks", "page has an article", "tagged", "named", "article", "heading")


def features(found: list[Block]) -> list[tuple]:
    """Of each block of a page what the tree looks at; shares are of the words outside furniture and links."""
    density = [b.linked / b.words for b in found]
    plain = sum(b.words - b.linked for b in found if not (b.tagged or b.named)) or 1
    article = any(b.article and not (b.tagged or b.named) for b in found)
    marks = article or any(b.tagged or b.named for b in found)
    out = []
    for i, b in enumerate(found):
        before = (found[i - 1].words, density[i - 1]) if i else (0, 0.0)
        after = (found[i + 1].words, density[i + 1]) if i + 1 < len(found) else (0, 0.0)
        out.append((b.words, density[i], *before, *after, b.words / plain, int(marks), int(article), int(b.tagged), int(b.named), int(b.article), b.heading))
    return out


_MENU = "<nav><ul><li><a href=1>{x1}</a><li><a href=1>{x2}</a><li><a href=1>{x1}</a></ul></nav>"
_PLAIN_MENU = "<div><a href=1>{x1}</a> <a href=1>{x2}</a> <a href=1>{x1}</a></div>"
_FOOTER = "<footer><p>{x5} <a href=1>{x2}</a></p><p>{x8}</p></footer>"
#: The labelled pages: {m9} stands for nine words of main text, {x9} for nine of anything else.
LABELLED = [
    # articles among menus, footers, adverts, notices, forms
    _MENU + "<article><h1>{m6}</h1><p>{m40}</p><div class=ad>{x12}</div><p>{m55}</p><ul><li>{m3}<li>{m8}</ul><p>{m7}</p></article>" + _FOOTER,
    "<div class=cookie-notice>{x30}<button>{x2}</button></div>" + _MENU + "<article><header><h1>{m9}</h1><p class=byline>{x4}</p></header><p>{m120}</p><h2>{m3}</h2><p>{m2}</p><blockquote>{m15}</blockquote></article><aside><h3>{x2}</h3><p>{x40}</p></aside>" + _FOOTER,
    _PLAIN_MENU + "<article><div class=post-header><h1>{m7}</h1></div><p>{m60}</p><div class=related><h3>{x2}</h3><a href=1>{x6}</a></div></article><div class=comments><h3>{x2}</h3><p>{x50}</p><p>{x9}</p></div>" + _FOOTER,
    "<article><div class=page-header><h1>{m7}</h1></div><p>{m60}</p><div class=search-box><h2>{x2}</h2><p>{x20}</p></div><p>{m30}</p></article>",
    "<p>{x9}</p><article><div class=header-title><h1>{m3}</h1></div><p>{m20}</p><div class=subscribe><h2>{x3}</h2><p>{x30}</p></div></article>",
    _MENU + "<article><div class=entry-header><h1>{m4}</h1></div><p>{m25}</p><p>{m30}</p><div class=newsletter-signup><h3>{x4}</h3><p>{x14}</p></div></article><form>{x3}<input></form>",
    "<header><h1>{x3}</h1><p>{x6}</p></header><main><article><h2>{m5}</h2><p>{m18}</p><p><a href=1>{m3}</a></p><p>{m12} <a href=1>{m9}</a></p><p><a href=1>{m6}</a></p></article><section class=comments><p>{x70}</p></section></main>" + _FOOTER,
    "<article><p>{m5}</p></article><footer>{x4}</footer>",
    "<article><h1>{m2}</h1></article>" + _PLAIN_MENU,
    _MENU + "<div class=breadcrumbs><a href=1>{x1}</a> {x1}</div><article><h1>{m8}</h1><p>{m3}</p><p>{m200}</p><table><tr><td>{m1}<td>{m2}</table><div class=share>{x3}</div></article><p>{x20}</p><p>{x6}</p>",
    "<article><h1>{m5}</h1><p>{m45}</p><aside><p>{x25}</p></aside><p>{m50}</p><section class=comments><h3>{x2}</h3><p>{x30}</p></section></article>" + _FOOTER,
    "<p>{x9}</p><article><h1>{m6}</h1><div class=advert><h3>{x3}</h3><p>{x45}</p></div><p>{m35}</p></article><p>{x60}</p>",
    "<article><p>{m4}</p><p>{m60}</p></article>",
    _MENU + "<article><h1>{m3}</h1><p>{m30}</p><p>{m20}</p><p>{m3}</p></article>",
    "<article><h1>{m5}</h1><nav><a href=1>{x3}</a> <a href=1>{x2}</a></nav><p>{m40}</p><div class=toc>{x9}</div><p>{m50}</p><ul><li><a href=1>{m3}</a><li><a href=1>{m5}</a></ul></article>",
    _MENU + "<article><h1>{m5}</h1><p>{m300}</p><p>{m200}</p><p>{m4}</p></article>",
    "<article><p>{m150}</p><p>{m6}</p><p>{m3}</p></article>",
    _MENU + "<div class=ad>{x9}</div><article><h1>{m5}</h1><p>{m90}</p><p>{m2}</p><p>{m400}</p><p>{m1}</p><p>{m2}</p></article>",
    "<div class=promo>{x10}</div><article><p>{m2}</p><p>{m20}</p><footer>{x6}</footer></article>",
    "<article><h2>{m4}</h2><p>{m15}</p><p>{m80}</p></article><div>{x3}</div>",
    # running text without an article element
    "<h1>{m4}</h1><p>{m50}</p><p>{m40}</p>",
    "<p>{m30}</p><p>{m20}</p><p>{m6}</p>",
    _PLAIN_MENU + "<div><h1>{m5}</h1><p>{m60}</p><p>{m45}</p><p>{m9}</p><p>{m80}</p></div><div>{x3} <a href=1>{x2}</a></div>",
    _MENU + "<h1>{m6}</h1><p>{m35} <a href=1>{m1}</a></p><p>{m60}</p><h2>{m2}</h2><p>{m30}</p><p>{m3}</p><p>{m40}</p>" + _FOOTER,
    "<div class=header>{x4}</div><div><p>{m24}</p><p>{m16}</p><p>{m18}</p></div><div class=sidebar><h3>{x2}</h3><p>{x110}</p></div><div class=footer>{x7}</div>",
    "<div><a href=1>{x2}</a></div><div><a href=1>{x4}</a></div><div>{m90}</div><div><a href=1>{x3}</a> {x1}</div><div>{x4}</div>",
    _PLAIN_MENU + "<h1>{m7}</h1><div>{m50}<br>{m40}</div><div>{m70}</div>" + _PLAIN_MENU + "<div>{x2}</div>",
    # a menu before running text that ends the page, also if its last block has most of the words
    _MENU + "<h1>{m5}</h1><p>{m40}</p><p>{m30}</p>",
    _MENU + "<p>{m10}</p><p>{m90}</p>",
    # short pages
    "<p>{m5}</p><p>{m6}</p>",
    "<p>{m12}</p>",
    "<h1>{m2}</h1><p>{m7}</p><p>{m4}</p>",
    _MENU + "<p>{m8}</p><p>{m5}</p>" + _FOOTER,
    "<div>{m1}</div>",
    # nothing but lists of links and scraps
    _PLAIN_MENU + _PLAIN_MENU + "<div><a href=1>{x12}</a> {x1}</div><div><a href=1>{x14}</a></div>",
    _MENU + _FOOTER,
    "<div class=login><p>{x9}</p></div><form>{x12}</form>",
]


#: The labelled pages are taken as they stand and with other numbers of words: factors for main text and for the rest.
FACTORS = ((1, 1), (0.3, 1), (2.5, 1), (1, 0.4), (1, 3), (0.3, 3), (4, 0.5))


def unnamed(page: str) -> str:
    """A labelled page without class names."""
    return re.sub(r" class=[\w-]+", "", page)


def unmarked(page: str) -> str:
    """A labelled page in which no element says what it is: only headings, paragraphs, lists and links are left."""
    return re.sub(r"<(/?)(?:nav|footer|aside|header|article|section|form|main)\b[^>]*>", r"<\1div>", unnamed(page))


def labelled_rows(*forms) -> list[tuple]:
    """The features of the labelled pages' blocks, then 1 for main text; of the pages as they stand, or in other forms."""
    rows = []
    for main, rest in FACTORS:
        count = lambda m: max(1, round(int(m[2]) * (main if m[1] == "m" else rest)))  # noqa: B023, E731
        for page in LABELLED:
            for form in forms or (str,):
                found = blocks(re.sub(r"\{([mx])(\d+)\}", lambda m: " ".join([m[1]] * count(m)), form(page)))
                rows += [(*f, int(b.text[0] == "m")) for f, b in zip(features(found), found)]
    return rows


def grow(rows: list[tuple], depth: int = 8, least: int = 10):
    """A classification tree by Gini impurity: a leaf's class, or (feature, threshold, tree up to it, tree beyond).

    A leaf has at least so many rows.
    """
    return _grown(np.array(rows, np.float64), depth, least)


def _grown(rows: np.ndarray, depth: int, least: int):
    n, ones = len(rows), int(rows[:, -1].sum())
    best, major = (np.inf,), int(2 * ones > n)
    if depth == 0 or ones in (0, n):
        return major
    for k in range(rows.shape[1] - 1):
        order = np.argsort(rows[:, k], kind="stable")
        value, left = rows[order, k], np.cumsum(rows[order, -1])[:-1]
        size = np.arange(1, n)
        cost = left * (1 - left / size) + (ones - left) * (1 - (ones - left) / (n - size))
        fits = np.flatnonzero((value[1:] > value[:-1]) & (size >= least) & (n - size >= least))
        if len(fits):
            at = fits[cost[fits].argmin()]
            if cost[at] < best[0] - 1e-9:
                best = (cost[at], k, float((value[at] + value[at + 1]) / 2))
    if len(best) == 1:
        return major
    _, k, at = best
    below = rows[:, k] <= at
    left, right = _grown(rows[below], depth - 1, least), _grown(rows[~below], depth - 1, least)
    return left if left == right and isinstance(left, int) else (k, at, left, right)


def decide(tree, row: tuple) -> int:
    while not isinstance(tree, int):
        k, at, left, right = tree
        tree = left if row[k] <= at else right
    return tree


def whole_tree():
    """The first question is whether the page says anything of its parts; the trees below are grown on the pages that do, and on those that don't."""
    rows, k = labelled_rows(str, unnamed, unmarked), FEATURES.index("page has marks")
    return (k, 0.5, grow([r for r in rows if not r[k]]), grow([r for r in rows if r[k]]))


TREE = whole_tree()


def main_text(page: str | None, tree=TREE) -> str:
    """The blocks that the tree takes for main text, one a line."""
    found = blocks(page or "")
    return "\n".join(b.text for b, f in zip(found, features(found)) if decide(tree, f))


def extract(pages: DataFrame, *, html_column: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per page the carried columns, text and n_chars (code points)."""
    source = pages.select(*[F.col(c) for c in carry], F.col(html_column).cast("string").alias("__page"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size = 0, max(1, min(200, batch.num_rows))
            while at < batch.num_rows:
                part = batch.slice(at, size)
                texts = [main_text(p) for p in part.column(len(carry)).to_pylist()]
                columns = [part.column(k) for k in range(len(carry))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*carry, "text", "n_chars"])
                at += size

    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in carry)
    return source.mapInArrow(run, f"{schema}, text string, n_chars long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


#: The article element of pages like those of the test tables, by regular expressions.
OP8_SQL = r"""
WITH articles AS (SELECT page_id, url, regexp_replace(regexp_extract(COALESCE(html, ''), '<article>(.*?)</article>', 1, 's'), '<div class="ad">.*?</div>', '<p>', 'gs') AS body FROM pages),
plain AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '<!--.*?-->', '', 'gs'), '[ \n\r\t]+', ' ', 'g'), '<br[^>]*>', ' ', 'g'),
         '</?(p|h1|div|ul|li)( [^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS body FROM articles),
lines AS (SELECT page_id, url, [x FOR x IN list_transform(string_split(html_unescaped, chr(10)), lambda b: trim(regexp_replace(b, ' +', ' ', 'g'))) IF x <> ''] AS blocks
          FROM (SELECT *, replace(replace(replace(replace(replace(replace(body, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS html_unescaped FROM plain))
SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, CAST(length(array_to_string(blocks, chr(10))) AS BIGINT) AS n_chars FROM lines
"""
