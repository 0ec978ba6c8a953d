"""HTML extraction: two passes of block rules over whole pages.

A page is cut into blocks at block-level tags. Pass one decides blocks: those inside
menus, footers, side bars, notices, adverts, forms or reader comments (by tag, role or
class name) are bad. A class name counts when all its parts say so (``site-footer``), or its
last one does and none names a state (``has-sidebar`` doesn't count), and never for an element
that holds the page's article or, where it has none, most of its text. For all other blocks stop-word density, length and link density decide, as
in published block classifiers, with lower thresholds inside an article, and short or
middling blocks stay ambiguous. Pass two gives an ambiguous block outside the article the
label of the nearest neighbour outside that its own text decided (without any: good on a
page that has no article, else bad); one inside is good unless the decided blocks on both
sides of it are lists of links.

Defined results: a null or empty page has an empty text; nothing is dropped from a good
block, whatever its length; tags that are never closed end with the element around them, and
a menu, footer or the like that is never closed ends where an article begins; of neighbours
at equal distance the one before decides, for a heading the one after;
repeated rows give repeated results; other columns are ignored or kept as stated; an
empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Markup: comments, declarations, and tags with quoted attributes.
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*)(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_LETTERS = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)

# Element names by what they mean for blocks.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea title".split())
BAD_TAGS = frozenset("head nav footer aside form menu button select option label fieldset dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
ARTICLE = frozenset(("article", "main"))
LINKED_TO = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre li dt dd figcaption caption".split())
#: Parts of class names, ids and roles of what is not the article.
BAD_NAMES = frozenset(
    (
        "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
        "footer header masthead cookie cookies consent gdpr notice alert comment comments disqus reply replies respond share sharing social related recommended "
        "newsletter subscribe signup login popup modal overlay widget toolbar pagination pager contentinfo complementary search skip"
    ).split()
)
#: Parts of names that change nothing about what the other parts say, and such as name a state of the page or of a wrapper.
BESIDE = frozenset(
    (
        "site page global main top bottom left right upper lower primary secondary inner outer wrapper wrap container content box bar block area section region panel slot unit zone "
        "list item items links link row col column group holder body title text image post posts article articles stories story entry mobile desktop sticky fixed small large btn button "
        "icon icons logo form field fields count meta info bottom middle center full width"
    ).split()
)
STATES = frozenset("has with no non not without is layout none off on open opened closed enabled disabled hide hidden show shown visible".split())
#: Names of reader comments, which may be longer than the article.
COMMENTS = frozenset("comment comments reply replies respond disqus".split())
#: Share of the text around it (the article's, or the page's) that a name does not take away.
MOST = 0.6
#: Frequent short words of the languages that the corpus declares.
STOP_WORDS = frozenset(
    (
        "a an and are as at be by for from had has have he her his i in is it not of on or she that the their they this to was we were which will with you "
        "der die das den dem des ein eine einer einem einen und oder in im ist nicht mit auf für von zu zum zur sich auch als an aus bei nach wie wir sie es war "
        "le la les un une des du de et ou en dans est pour par sur pas plus que qui au aux ce cette il elle nous vous ne se avec sont "
        "el los las una unos unas y o del al en es por para con no que se su sus lo como más pero fue ha"
    ).split()
)

LINK_DENSITY, LONG, STOP_LOW, STOP_HIGH = 0.4, 140, 0.15, 0.30
#: Share of these that is asked for inside an article; link density may be higher by as much.
INSIDE = 0.5


@dataclass
class Block:
    text: str
    tag: str
    linked: int
    inside: bool
    bad: bool
    good: bool | None = None
    rule: str = ""


@dataclass
class Element:
    """An open tag and what the page says about it as a whole."""

    name: str
    parent: Element | None
    attributes: str
    start: int
    #: characters of text inside, whether the tag was closed, and whether an article begins inside
    held: int = 0
    closed: bool = False
    article: bool = False
    bad: bool = False
    inside: bool = False


def _tokens(attributes: str, ids: bool = True) -> list[list[str]]:
    """Class names, ids and roles, each as its parts."""
    found = []
    for m in _ATTRIBUTE.finditer(attributes):
        if ids or m[1].lower() != "id":
            found += [parts for token in (m[2] or m[3] or m[4] or "").lower().split() if (parts := [x for x in re.split(r"[^a-z]+", token) if x])]
    return found


def _named_bad(parts: list[str]) -> bool:
    """Whether a name says that its element is not the article."""
    others = [x for x in parts if x not in BAD_NAMES]
    return len(others) < len(parts) and (BESIDE.issuperset(others) or (parts[-1] in BAD_NAMES and STATES.isdisjoint(parts)))


def _is_comment(e: Element) -> bool:
    return any(not COMMENTS.isdisjoint(parts) and _named_bad(parts) for parts in _tokens(e.attributes))


def _parse(page: str, ended: frozenset[int]) -> tuple[list[Element], list[tuple[Element, str | None, int]]]:
    """The page's elements, and its texts with their element and number of links around; None where a block ends.

    An article ends elements that start at the positions of ``ended``.
    """
    root = Element("", None, "", -1)
    stack, elements, events, at, links = [root], [root], [], 0, 0

    def add(raw: str) -> None:
        if raw:
            text = html.unescape(raw)
            stack[-1].held += len(text.strip())
            events.append((stack[-1], text, links))

    def close(depth: int) -> None:
        nonlocal links
        links -= sum(e.name == "a" for e in stack[depth:])
        del stack[depth:]

    while True:
        m = _MARKUP.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        start, at, name = m.start(), m.end(), (m[2] or "").lower()
        if not name:
            continue
        if name in RAW:
            if not m[1] and not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?:\s[^>]*)?/?>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "br":
            events.append((stack[-1], " ", 0))
            continue
        if name not in INLINE:
            events.append((stack[-1], None, 0))
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if depth and not (name in INLINE and any(e.name not in INLINE for e in stack[depth:])):
                stack[depth].closed = True
                close(depth)
        elif name not in VOID:
            if name == "p" and any(e.name == "p" for e in stack):  # a paragraph ends the one before it, with what is open inside
                depth = max(i for i, e in enumerate(stack) if e.name == "p")
                if all(e.name in INLINE or e.name == "p" for e in stack[depth:]):
                    close(depth)
            if name in ARTICLE and (depth := next((i for i, e in enumerate(stack) if e.start in ended), 0)):
                close(depth)
            elements.append(Element(name, stack[-1], m[3], start))
            stack.append(elements[-1])
            links += name == "a"
    events.append((stack[-1], None, 0))
    return elements, events


def _judge(elements: list[Element]) -> None:
    """Tell which elements are bad, and which are inside an article."""
    for e in reversed(elements):
        e.article = e.article or (e.name in ARTICLE and not _is_comment(e))
        if e.parent is not None:
            e.parent.held += e.held
            # what stands in an aside or a footer is not the page's article
            e.parent.article |= e.article and e.name not in BAD_TAGS
    root = elements[0]
    around = {id(root): root}
    for e in elements[1:]:
        up = e.parent
        around[id(e)] = up if up.inside and up.name in ARTICLE else around[id(up)]
        e.bad, e.inside = up.bad, up.inside
        if e.name in ARTICLE:
            comment = _is_comment(e)
            e.bad, e.inside = e.bad or comment, not (e.bad or comment)
        elif e.name in BAD_TAGS or (e.name == "header" and not e.inside):
            e.bad = True
        elif e.name not in ("html", "body") and e.attributes:
            # a heading's or a paragraph's id is a place to link to and says nothing about its kind
            if not e.bad and any(_named_bad(parts) for parts in _tokens(e.attributes, e.name not in LINKED_TO)):
                whole = around[id(e)]
                most = e.held > MOST * whole.held and (whole is not root or not root.article) and not _is_comment(e)
                e.bad = not (e.article or most)
            e.bad = e.bad or bool(_HIDDEN.search(e.attributes))


def blocks(page: str | None) -> list[Block]:
    """The page's blocks in order, with white space joined; blocks without text are left out."""
    page = page or ""
    elements, events = _parse(page, frozenset())
    open_ended = {e.start for e in elements if e.name in BAD_TAGS and not e.closed}
    if open_ended and any(e.name in ARTICLE for e in elements):
        elements, events = _parse(page, frozenset(open_ended))
    _judge(elements)
    found: list[Block] = []
    pieces: list[str] = []
    linked = 0
    for element, text, links in events:
        if text is not None:
            pieces.append(text)
            linked += len(text.strip()) if links else 0
            continue
        joined = " ".join("".join(pieces).split())
        if joined:
            e = element
            while e.name in INLINE:
                e = e.parent
            found.append(Block(joined, e.name, linked, element.inside, element.bad))
        pieces, linked = [], 0
    return found


def _one(found: list[Block]) -> None:
    """Pass one: label what structure, links, stop words or length decide; the rest stays ambiguous."""
    density = [b.linked / len(b.text) for b in found]
    heavy = [not b.bad and d > (LINK_DENSITY / INSIDE if b.inside else LINK_DENSITY) for b, d in zip(found, density, strict=True)]
    for i, b in enumerate(found):
        words = b.text.lower().split()
        stop = sum(w in STOP_WORDS for w in _LETTERS.findall(b.text.lower())) / len(words)
        ease = INSIDE if b.inside else 1
        # one linked block in an article can be its text, a run of them is a list of links
        listed = any(heavy[k] and found[k].inside for k in (i - 1, i + 1) if 0 <= k < len(found))
        if b.bad:
            b.good, b.rule = False, "structure"
        elif heavy[i]:
            if listed or not b.inside:
                b.good, b.rule = False, "links"
        elif (len(b.text) >= LONG * ease and stop >= STOP_LOW * ease) or (stop >= STOP_HIGH * ease and len(words) >= 8 * ease and not b.linked):
            b.good, b.rule = True, "stop words"
        elif len(b.text) >= LONG and not b.inside and b.linked:
            b.good, b.rule = False, "length"


def _two(region: list[Block], inside: bool, default: bool) -> None:
    """Pass two: label what is ambiguous in a region by its decided neighbours there."""
    # what structure marked bad says nothing about what stands beside it
    decided = [i for i, b in enumerate(region) if b.good is not None and b.rule != "structure"]
    labels = [region[k].good for k in decided]
    after = 0
    for i, b in enumerate(region):
        while after < len(decided) and decided[after] < i:
            after += 1
        if b.good is None:
            near = [j for j in (after - 1, after) if 0 <= j < len(decided)]
            b.rule = "neighbours" if near else "membership"
            if inside:
                # an article's start and end count as good
                b.good = len(near) < 2 or any(labels[j] for j in near)
                continue
            # the nearer neighbour decides; at equal distance a heading follows what comes after it
            heading = re.fullmatch(r"h[1-6]", b.tag) is not None
            near.sort(key=lambda j: (abs(decided[j] - i), (decided[j] < i) if heading else (decided[j] > i)))
            b.good = labels[near[0]] if near else default


def classify(found: list[Block]) -> list[Block]:
    """Label blocks in two passes; ``rule`` names what decided each."""
    _one(found)
    article = [b for b in found if b.inside and not b.bad]
    _two(article, True, True)
    _two([b for b in found if b.bad or not b.inside], False, not article)
    return found


def main_text(page: str | None) -> str:
    return " ".join(b.text for b in classify(blocks(page)) if b.good)


@F.arrow_udf(T.StringType())
def _main_text(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p) for p in pages.to_pylist()], pa.string())


_BLOCKS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("tag", T.StringType()), T.StructField("linked", T.IntegerType()), T.StructField("good", T.BooleanType()), T.StructField("rule", T.StringType())]))


@F.arrow_udf(_BLOCKS)
def _labelled(pages: pa.Array) -> pa.Array:
    rows = [[{"text": b.text, "tag": b.tag, "linked": b.linked, "good": b.good, "rule": b.rule} for b in classify(blocks(p))] for p in pages.to_pylist()]
    return pa.array(rows, pa.list_(pa.struct([("text", pa.string()), ("tag", pa.string()), ("linked", pa.int32()), ("good", pa.bool_()), ("rule", pa.string())])))


def extract(df: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """The same rows with the page's main text in place of (or beside) its markup column."""
    return df.withColumn(text_col, _main_text(F.col(html_col)))


def labelled_blocks(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id, blocks)``: every block of each page with its label, for inspection and tuning."""
    return df.select(id_col, _labelled(F.col(html_col)).alias("blocks"))
