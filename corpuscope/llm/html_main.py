"""Main text of web pages by site template removal.

Every page is parsed into elements; each element with text gets a hash of its subtree (tags and text). Spark counts per host on how many
pages with different content a subtree occurs, and subtrees that recur on at least ``LEAST_PAGES`` are deleted from all pages of the host,
whatever the number of its pages. Parts of a sentence or a table row (``WITHIN_TEXT``: a word in bold, a cell) recur in articles too; such a subtree by
itself has to recur on ``SHARE`` of the pages as well, while the blocks around it need not. What the markup itself names as no article (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, comments) goes as well, and where a page has an article or main element, only its text counts. Names are whole class names and ids, or compounds
of them with words of place and shape (``site-header``, ``comment-list``; not ``share-price``). What holds the article is kept whatever its name, and so is a form that holds over half of the
text, or a named element that holds nearly all of it.

The subtrees found are handed out as one list where they are few; otherwise they go to the pages by a join on host and page, which gives the same
rows. Copies of a page count once, so a copied article is no template.

Cases: null html counts as empty and gives an empty text; broken markup is read leniently (omitted, unclosed and stray tags, missing quotes), and the time a page takes grows with its
length, however long it is and however deep its elements are nested; a null or odd url has the host of its text before the path; equal rows give equal results; an empty table gives no
rows; columns of other names are left out, whatever they are called. White space is what Python's ``str.split`` takes for it, so a no-break space counts.
"""

from __future__ import annotations

import html
import re

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.base import map_text, salted_join, small_enough
from corpuscope.session import cut_lineage

SHARE, LEAST_PAGES = 0.3, 8
#: up to so many subtrees in all are handed out as a list; a physical choice only
LISTED = 200_000
#: what share of the text protects a form, and an element that only its name calls no article
FORM_SHARE, NAMED_SHARE = 0.5, 0.9

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
#: void elements inside a line of text
INLINE_VOID = frozenset("img input wbr".split())
#: what may stand in a head; anything else ends it
HEAD_ONLY = frozenset("base basefont bgsound link meta noscript script style template title".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
WITHIN_TEXT = INLINE | {"td", "th"}
FORMS = frozenset(["form", "fieldset"])
GONE = frozenset("head nav footer aside form button select option menu dialog object canvas audio video fieldset".split()) | RAW
NAMES = frozenset("nav navbar navigation menu header masthead topbar footer sidebar ad ads advert adverts advertisement advertising banner promo promotion sponsor "
                  "sponsored notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login comment comments "
                  "disqus replies share sharing social related recommended breadcrumb breadcrumbs widget widgets toolbar pagination pager skip alert".split())
#: words of place before, and of shape behind, one of the names
BEFORE = frozenset("site global main top bottom left right side sticky fixed mobile desktop primary secondary user google".split())
BEHIND = frozenset("bar bars box boxes list lists link links wrap wrapper container area section block blocks slot slots unit units button buttons icon icons form inner outer left right top bottom "
                   "item items panel menu thread row col column group holder region zone".split())
#: names that an article may use for its own head, and those that no share of the text protects
OWN_HEAD = frozenset("header masthead topbar banner".split())
READERS = frozenset("comment comments disqus replies".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^"'>])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[^<]++|<""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|itemprop|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s"'/]|\Z)""", re.I)
_NAME = re.compile(r"[^a-z0-9]+")


class Element:
    """``inside``: a (an article around or itself), m (only a main element), or empty; ``weight``: characters of its text that may be article."""

    __slots__ = ("tag", "up", "named", "own_head", "readers", "hidden", "main", "inside", "holds", "kids", "key", "lost", "weight")

    def __init__(self, tag: str, up: Element | None, attributes: str):
        self.tag, self.up, self.kids, self.key, self.lost, self.weight = tag, up, [], None, None, 0
        self.named = self.own_head = self.readers = self.hidden = self.holds = False
        self.main = tag if tag in ("article", "main") else ""
        if attributes and not attributes.isspace():
            for name, value in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'").lower()
                if name in ("class", "id"):
                    self._name(value)
                elif name == "role":
                    self.named |= value in ROLES
                    self.main = self.main or ("main" if value == "main" else "")
                elif name == "itemprop":
                    self.main = self.main or ("article" if value == "articlebody" else "")
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                    self.hidden = True
        around = up.inside if up is not None else ""
        self.inside = "a" if around == "a" or self.main == "article" else "m" if around or self.main else ""

    def _name(self, value: str) -> None:
        for token in value.split():
            words = [w for w in _NAME.split(token) if w]
            while len(words) > 1 and words[-1] in BEHIND:
                words.pop()
            while len(words) > 1 and words[0] in BEFORE:
                words.pop(0)
            if words and NAMES.issuperset(words):
                if OWN_HEAD.issuperset(words):
                    self.own_head = True
                else:
                    self.named = True
                    self.readers |= not READERS.isdisjoint(words)


def parse(page: str | None) -> tuple[list[Element], list[tuple[int, Element, str]]]:
    """The elements, the root first and each before what is in it, and the pieces of text: (number of the block, innermost element, text as written)."""
    page = page or ""
    root = Element("", None, "")
    here, block, at, end = root, 0, 0, len(page)
    elements, head = [root], None
    is_open: dict[str, int] = {}  # how many elements of a tag are open: nobody looks for an end or a parent that is not there
    pieces: list[tuple[int, Element, str]] = []
    match = _TOKEN.match

    def leave(upto: Element) -> Element:
        """Ends the elements inside ``upto``."""
        nonlocal head
        node = here
        while node is not upto:
            is_open[node.tag] -= 1
            if node is head:
                head = None
            node = node.up
        return upto

    while at < end:
        token = match(page, at)
        at = token.end()
        tag = token[2] or token[5]
        if not tag:
            text = token[0]
            if text[0] != "<" or len(text) == 1 or text.startswith("<![CDATA["):
                if text.startswith("<!["):
                    text = html.escape(text[9:-3] if text.endswith("]]>") else text[9:])
                if here is head and not text.isspace():
                    here = leave(head.up)
                pieces.append((block, here, text))
                here.kids.append(text)
            continue
        tag, closing = tag.lower(), token[1] or token[4]
        inline = tag in INLINE
        if not inline and tag not in INLINE_VOID:
            block += 1
        if closing:
            if not is_open.get(tag):
                continue
            found = here
            while found is not root and found.tag != tag:
                if inline and found.tag not in INLINE:  # a stray inline end does not close a block
                    found = root
                    break
                found = found.up
            if found is not root:
                here = leave(found.up)
            continue
        if head is not None and tag not in HEAD_ONLY:
            here = leave(head.up)
        if tag in VOID:
            if tag not in INLINE_VOID:
                here.kids.append(" ")
            continue
        if not inline:
            here = leave(_implied(here, root, tag, is_open))
        here, parent = Element(tag, here, token[3] or token[6] or ""), here
        elements.append(here)
        is_open[tag] = is_open.get(tag, 0) + 1
        if tag == "head" and head is None:
            head = here
        parent.kids.append(here)
        if here.main:
            above = parent
            while above is not None and not above.holds:
                above.holds = True
                above = above.up
        if (token[3] or token[6] or "").endswith("/") and tag in ("svg", "math"):
            here = leave(parent)
        elif tag in RAW:
            stop = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            at = stop.start() if stop else end
    for _, node, text in pieces:
        node.weight += len(text) - text.count(" ")
    for node in reversed(elements[1:]):
        if not (node.tag in GONE and node.tag not in FORMS) and not node.hidden:
            node.up.weight += node.weight
    return elements, pieces


def _implied(here: Element, root: Element, tag: str, is_open: dict[str, int]) -> Element:
    """The element that a block-level ``tag`` opens in, after the ends that it implies."""
    closes, stops = CLOSES.get(tag, ()), WITHIN.get(tag, ())
    left = is_open.get("p", 0) + sum(is_open.get(c, 0) for c in closes)
    found = target = here
    while left and found is not root and found.tag not in stops:
        if found.tag in closes or found.tag == "p":
            target = found.up
            left -= 1
        elif found.tag not in INLINE and not closes:
            break
        found = found.up
    return target


def subtree_keys(elements: list[Element]) -> list[Element]:
    """Elements with text, children first; each gets the hash of its tags and text as ``key``."""
    out = []
    for node in reversed(elements):
        parts = [k if isinstance(k, str) else k.key for k in node.kids]
        inner = "\x01".join(" ".join(p.split()) for p in parts if p is not None).strip("\x01")
        if inner:
            node.key = f"{node.tag}\x02{xxhash.xxh3_64_hexdigest(inner.encode('utf-8', 'surrogatepass'))}"
            out.append(node)
    return out


def _number(node: Element) -> int:
    """63 bits of hash; the lowest bit tells the elements ``WITHIN_TEXT``."""
    return (xxhash.xxh3_64_intdigest(node.key.encode()) & ~1 | (node.tag in WITHIN_TEXT)) - 2**63


def _lost(node: Element | None, total: int) -> bool:
    """Whether an element is no article text by its own markup or by that of an element around it; ``total`` is the weight of the page."""
    trail = []
    while node is not None and node.lost is None:
        trail.append(node)
        node = node.up
    lost = bool(node is not None and node.lost)
    for node in reversed(trail):
        node.lost = lost = lost or node.hidden or _by_tag(node, total) or _by_name(node, total)
    return lost


def _by_tag(node: Element, total: int) -> bool:
    if node.tag in FORMS:
        return not node.holds and node.weight <= FORM_SHARE * total
    return node.tag in GONE or node.tag == "header" and node.up.inside != "a" and not node.holds


def _by_name(node: Element, total: int) -> bool:
    if not node.named and not (node.own_head and node.up is not None and node.up.inside != "a") or node.holds or node.tag in ("html", "body", ""):
        return False
    return node.readers or node.tag in GONE or node.weight <= NAMED_SHARE * total or bool(node.inside)


def main_text(page: str | None, templates: frozenset[int] = frozenset()) -> str:
    """The article of a page without subtrees whose hash number is in ``templates``."""
    return _without(page, templates)[0]


def _without(page: str | None, templates: frozenset[int]) -> tuple[str, int]:
    """The main text, and the number of different subtrees that were deleted."""
    elements, pieces = parse(page)
    deleted = set()
    if templates:
        for node in subtree_keys(elements):
            if _number(node) in templates and not (node.main or node.holds):
                node.lost = True
                deleted.add(_number(node))
    total = elements[0].weight
    live = [p for p in pieces if not _lost(p[1], total)]
    for kinds in ("a", "am"):
        inside = [p for p in live if p[1].inside and p[1].inside in kinds]
        if inside:
            live = inside
            break
    else:
        live = [p for p in live if not _menu_link(p[1])]
    blocks: dict[int, list[str]] = {}
    for block, _, text in live:
        blocks.setdefault(block, []).append(text)
    texts = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    return " ".join(t for t in texts if t), len(deleted)


def _menu_link(node: Element) -> bool:
    """A list item's link: without an article element, lists of links count as menus."""
    return node.tag == "a" and node.up is not None and node.up.tag == "li" and all(isinstance(k, Element) or not k.strip() for k in node.up.kids)


def page_subtrees(page: str | None) -> tuple[int, list[int]]:
    """A number for the content of a page, and the distinct hash numbers of its subtrees."""
    elements, _ = parse(page)
    keys = sorted({_number(n) for n in subtree_keys(elements) if n.up is not None and not (n.main or n.holds)})
    return xxhash.xxh3_64_intdigest(main_text(page).encode("utf-8", "surrogatepass")) - 2**63, keys


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#]*)", 1))


def _seen(pages: DataFrame) -> DataFrame:
    """``host``, ``page`` (hash of the html), ``content`` and ``subtrees`` of every page."""
    rows = pages.select(host(pages["url"]).alias("host"), F.xxhash64(pages["html"].cast("string")).alias("page"), pages["html"].cast("string").alias("html"))
    return map_text(rows, "html", "content long, subtrees array<long>", lambda texts: [page_subtrees(t) for t in texts])


def _recurring(seen: DataFrame, share: float, least: int) -> DataFrame:
    """``host`` and ``subtree`` of the subtrees that recur."""
    seen = seen.withColumn("subtrees", F.concat(F.array(F.lit(None).cast("long")), "subtrees"))  # the null subtree counts the pages
    each = seen.select("host", "content", F.explode_outer("subtrees").alias("subtree")).distinct()
    counts = each.groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    total = counts.where("subtree IS NULL").select("host", F.col("n").alias("of"))
    block = F.col("subtree").bitwiseAND(F.lit(1)) == 0
    return counts.where("subtree IS NOT NULL").join(total, "host").where(block | (F.col("n") >= share * F.col("of"))).select("host", "subtree")


def site_templates(pages: DataFrame, share: float = SHARE, least: int = LEAST_PAGES) -> DataFrame:
    """``host`` and ``templates``: hash numbers of the subtrees that recur on its pages."""
    return _recurring(_seen(pages), share, least).groupBy("host").agg(F.sort_array(F.collect_list("subtree")).alias("templates"))


def extract(pages: DataFrame, share: float = SHARE, least: int = LEAST_PAGES) -> DataFrame:
    """Per row: ``page_id``, ``url``, ``text`` and ``n_templates`` (different subtrees deleted on the page)."""
    seen = cut_lineage(_seen(pages))  # narrow, and read twice: the pages are parsed once for it
    found = cut_lineage(_recurring(seen, share, least))
    rows = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), host(pages["url"]).alias("host"),
                        F.xxhash64(pages["html"].cast("string")).alias("page"), pages["html"].cast("string").alias("html"))
    if small_enough(found, LISTED):
        known: dict[str, set[int]] = {}
        for r in found.collect():
            known.setdefault(r["host"], set()).add(r["subtree"])
        lists = pages.sparkSession.sparkContext.broadcast({h: frozenset(v) for h, v in known.items()})
        cells = rows.select("page_id", "url", F.struct("html", "host").alias("cell"))
        return map_text(cells, "cell", "text string, n_templates long", lambda cells: [_without(c["html"], lists.value.get(c["host"], frozenset())) for c in cells])
    each = seen.select("host", "page", F.explode_outer("subtrees").alias("subtree")).where("subtree IS NOT NULL").distinct()
    hits = salted_join(each, found, ["host", "subtree"], F.col("page")).groupBy("host", "page").agg(F.collect_list("subtree").alias("templates"))
    # a page with a large share of all rows is one key of this join, which Spark splits; every page but for those without any subtree meets one row
    both = rows.join(hits, ["host", "page"], "left")
    both = both.select("page_id", "url", F.struct("html", F.coalesce("templates", F.array().cast("array<long>")).alias("templates")).alias("cell"))
    return map_text(both, "cell", "text string, n_templates long", lambda cells: [_without(c["html"], frozenset(c["templates"])) for c in cells])
