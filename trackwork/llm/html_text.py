"""Main text of web pages by tree scoring (operator 2)."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwork.llm.tables import in_batches, kind
from trackwork.llm.tokens import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: Elements that hold no article text. Of formulas only the annotations repeat what is shown.
DROPPED = frozenset(
    "annotation annotation-xml aside button canvas datalist dialog footer form head header iframe input label menu meter nav noscript object "
    "option progress script select style svg template textarea title video audio".split()
)
#: Words of a class, id or role that mark page furniture. What is named so weighs little, and goes unless the best container is in it.
FURNITURE = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion promoted cookie cookies consent gdpr "
    "adsbygoogle adsense adslot adunit banner notice notices notification notifications announcement alert dialog popup modal "
    "overlay sidebar sidebars sidenav aside menu menus menubar nav navbar topnav topbar navigation breadcrumb breadcrumbs pager "
    "pagination footer colophon copyright masthead toolbar share sharing social newsletter subscribe subscription signup login "
    "form skip related recommended widget comment comments reply replies respond disqus contentinfo complementary search".split()
)
#: Of these, an id says nothing: it may name the subject of a section.
SUBJECTS = frozenset(
    "ad ads advert advertising sponsor promotion cookie cookies consent gdpr banner notice notices notification notifications "
    "announcement alert dialog menu menus navigation pagination copyright share sharing social newsletter subscription login "
    "form skip related recommended comment reply respond complementary search header".split()
)
#: What follows one of these is a part that the element has and not its own kind: "with-sidebar".
HAVING = frozenset("has have with without no".split())
#: With one of these, such a word may describe a frame around the article: "layout has-sidebar".
FRAME = frozenset("layout wrapper wrap container page content main row col column grid site".split())
#: With one of these beside it, "header" names the head of the article and not of the page.
OWN_HEAD = frozenset("article post entry story content title".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table div article section body".split())
WHOLE = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Text of their own: names do not count against these, nor against inline elements.
UNNAMED = HEADINGS | {"p", "blockquote", "pre", "html", "body"}
#: What text counts outside an element that is named as furniture, and in its points.
NAMED_WEIGHT = 0.1
LEAST, PER_CHARS, MOST = 25, 100, 3
SIBLING_SHARE, LINKED = 0.2, 0.25
WORDS = re.compile(r"[a-z]+")


def _furniture(attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
    """Whether an element is named as page furniture, and whether it may be a frame all the same."""
    named = frame = False
    for key, value in attrs:
        if key not in ("class", "id", "role") or not value:
            continue
        parts = [WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", part).lower()) for part in value.split()]
        found = {w for part in parts for w in part[: next((i for i, w in enumerate(part) if w in HAVING), len(part))]}
        frame |= not found.isdisjoint(FRAME)
        if key == "id":  # a slug of other words is a title
            named |= found <= FURNITURE | FRAME and not found.isdisjoint(FURNITURE - SUBJECTS)
        else:
            named |= not found.isdisjoint(FURNITURE) or ("header" in found and found.isdisjoint(OWN_HEAD))
    return named, named and frame


class Page(HTMLParser):
    """Block elements of a page as a tree, and its text in page order.

    Inline elements are no nodes unless they are links or hold no text of the article, so unclosed ones do no harm.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.dropped, self.linked = ["#"], [0], [False], [False]
        self.named, self.frames = [False], [False]
        self.open = [0]
        self.block = 0
        self.texts: list[tuple[int, int, str]] = []  # node, block, text

    def _push(self, tag: str, named: bool, frame: bool) -> None:
        top = self.open[-1]
        self.open.append(len(self.tags))
        self.tags.append(tag)
        self.parents.append(top)
        self.dropped.append(tag in DROPPED)
        self.named.append(named)
        self.frames.append(frame)
        self.linked.append(tag == "a" or self.linked[top])

    def _close(self, tags, until=frozenset()) -> None:
        """Close the innermost open element of ``tags``, with all in it, unless one of ``until`` is nearer."""
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.tags[self.open[i]]
            if tag in tags:
                del self.open[i:]
                return
            if tag in until:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.block += 1
            self._close({"p"}, SCOPES - {"p"})
        if tag in CLOSED_BY:
            self._close(CLOSED_BY[tag], SCOPES - CLOSED_BY[tag])
        if tag in ("br", "td", "th"):
            self.texts.append((self.open[-1], self.block, " "))
        if tag not in VOID and (tag in DROPPED or tag in BLOCKS or tag == "a"):
            named, frame = _furniture(attrs) if tag in BLOCKS and tag not in UNNAMED else (False, False)
            self._push(tag, named, frame)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.block += 1
        if any(self.tags[i] == tag for i in self.open):
            self._close({tag})

    def handle_data(self, data):
        self.texts.append((self.open[-1], self.block, data))


def _settle(page: Page) -> None:
    """Keep frames around an article, and drop all that is inside a dropped element."""
    for i, tag in enumerate(page.tags):
        if (tag in WHOLE or tag == "h1") and not page.named[i]:
            above = page.parents[i]
            while above:
                page.named[above] &= not page.frames[above]
                above = page.parents[above]
    for i in range(1, len(page.tags)):
        page.dropped[i] |= page.dropped[page.parents[i]]


def _holder(page: Page, node: int) -> int:
    """The nearest element around ``node`` that can be a container."""
    while node and page.tags[node] not in BLOCKS:
        node = page.parents[node]
    return node


def _scores(page: Page) -> tuple[list[float], list[float], list[float]]:
    """Points, characters and characters in links of every node; what is named as furniture adds little to those above."""
    count = len(page.tags)
    points, chars, links = [0.0] * count, [0.0] * count, [0.0] * count
    weight = [1.0] * count  # of a text, with all names around it
    for i in range(1, count):
        weight[i] = weight[page.parents[i]] * (NAMED_WEIGHT if page.named[i] else 1)
    paragraphs: dict[int, tuple[int, list[str]]] = {}
    for node, block, text in page.texts:
        if not page.dropped[node] and not text.isspace():
            size = len(text.strip())
            chars[node] += size
            links[node] += size * page.linked[node]
            paragraphs.setdefault(block, (_holder(page, node), []))[1].append(text)
    for node in range(count - 1, 0, -1):  # children come after their parents
        passed = NAMED_WEIGHT if page.named[node] else 1
        chars[page.parents[node]] += chars[node] * passed
        links[page.parents[node]] += links[node] * passed
    for holder, pieces in paragraphs.values():
        text = "".join(pieces)
        if len(text) < LEAST:
            continue
        given = weight[holder] * (1 + text.count(",") + text.count("，") + min(len(text) / PER_CHARS, MOST))
        at = holder if page.tags[holder] in ("div", "section", "article", "main", "body", "#") else page.parents[holder]
        while True:  # half as much for each step up
            points[at] += given
            if not at:
                break
            at, given = page.parents[at], given / 2
    return points, chars, links


def _inside_whole(page: Page, node: int) -> bool:
    """Whether an article or main holds ``node`` but is not it."""
    node = page.parents[node]
    while node and page.tags[node] not in WHOLE:
        node = page.parents[node]
    return bool(node)


def main_text(html: str | None) -> str:
    """Blocks of the main container and its qualifying siblings, in page order, one per line."""
    page = Page()
    page.feed(html or "")
    page.close()
    _settle(page)
    points, chars, links = _scores(page)
    thin = [1 - links[i] / chars[i] if chars[i] else 0.0 for i in range(len(points))]
    value = [p * t for p, t in zip(points, thin)]
    usable = [i for i in range(len(value)) if not page.dropped[i]]
    best = max(usable, key=lambda i: (value[i], -i))
    if not value[best]:  # no paragraph: the first whole article, else all there is
        best = next((i for i in usable if page.tags[i] in WHOLE), 0)
    above, around = best, best
    while around:  # the best container is an article's, whatever it and those around it are called
        page.named[around], around = False, page.parents[around]
    for i in range(1, len(points)):
        page.dropped[i] |= page.named[i] or page.dropped[page.parents[i]]
    while above and page.tags[above] not in WHOLE:
        above = page.parents[above]
    top = above or best
    roots = {top}
    while top and page.tags[top] != "main":
        for i in usable:
            if i and page.parents[i] == page.parents[top] and i != top and not page.dropped[i] and thin[i] > 1 - LINKED:
                text = page.tags[i] in HEADINGS or page.tags[i] in ("p", "blockquote", "pre")
                if text or value[i] >= SIBLING_SHARE * value[best]:
                    roots.add(i)
        top = page.parents[top]
        if not _inside_whole(page, top):
            break
    kept = [False] * len(points)
    blocks: dict[int, list[str]] = {}
    for i in range(len(points)):
        kept[i] = not page.dropped[i] and (i in roots or (i > 0 and kept[page.parents[i]]))
    for node, block, text in page.texts:
        if kept[node]:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(pieces).split()) for pieces in blocks.values())
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page.

    The text is the article without page furniture, character references decoded and white space inside a
    block turned into one blank; a line break inside a block is white space, cells of a table row are parts of one
    block. Null or empty html and pages without text give an empty text; null ids and urls are kept;
    repeated rows are extracted each; an empty table gives none; other columns are not read.
    """
    schema = f"{id_column} {kind(pages, id_column)}, {url} {kind(pages, url)}, text string"

    def read(batches):
        for batch in batches:
            for part in slices(batch):
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=[id_column, url, "text"])

    found = in_batches(pages.select(id_column, url, F.col(html).cast("string"))).mapInArrow(read, schema)
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
