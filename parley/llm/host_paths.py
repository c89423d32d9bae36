"""Main-text extraction from HTML with container paths that the pages of a host agree on."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import broadcast_if_small, materialise

#: Elements without an end tag, elements whose content is not markup, and elements that end a block of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg object select option".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
CONTAINER = frozenset("html body main article section div td center".split())
#: Elements, roles and words of class names or ids that mark what is not the article.
NOT_ARTICLE = frozenset("nav aside footer form button dialog menu head".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert form menu menubar".split())
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
MARKS = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie "
    "cookies footer gdpr menu modal nav navbar navigation newsletter notice popup promo promotion recommended related "
    "share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Elements that hold a piece of an article rather than a part of a page: marks drop them only if they are whole class names
#: of ``FOREIGN``, have a word of ``SURELY``, or are lists of links.
PIECES = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre hr figure figcaption caption legend summary tr tbody thead tfoot span a em strong b i small".split())
FOREIGN = COMMENTS | frozenset("ad ads advert adverts advertisement advertising consent cookie cookies newsletter promo promotion sponsor sponsored".split())
SURELY = frozenset("advert adverts advertisement advertising consent cookie cookies disqus gdpr newsletter sponsored".split())
#: Class names and ids of headers of a site, not of an article.
HEADERS = frozenset("header masthead site-header page-header top-header global-header".split())
#: A container is entered if it holds this share of the text around it; a host's path is taken if its text is this share of what
#: the page's own best container has.
MAIN_SHARE, FAIR_SHARE = 0.6, 0.1
#: Share of a page's text from which comments are what the page is about.
COMMENTS_SHARE = 0.9

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Stands between the labels of a path.
PATH = "\x1f"
_SPLIT = re.compile(r"[^a-z0-9]+")


def attributes(rest: str) -> dict[str, str]:
    """Attributes of a tag by their names in lower case; the first of a name counts. Values are no names."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _label(tag: str, names: dict[str, str]) -> str:
    """Tag and classes with digits generalised, so that numbered classes of one template look alike."""
    classes = sorted({re.sub(r"\d+", "#", c) for c in names.get("class", "").split()})
    return ".".join([tag, *classes])


class Page:
    """Blocks of a page's text and the containers they stand in. Tolerates missing end tags and cut pages."""

    def __init__(self, html: str) -> None:
        self.blocks: list[tuple[str, int]] = []
        #: Of each container: tag and generalised classes, number of the one around it, tag.
        self.containers: list[tuple[str, int, str]] = [("", -1, "")]
        self.links = [0]
        #: Containers that by their element, role, class or id are not the article; those among them that hold comments, and
        #: those that are small pieces of a page, which go only if they are links or foreign.
        self.marked: set[int] = set()
        self.comments: set[int] = set()
        self.pieces: set[int] = set()
        self._read(html)
        self._settle()

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, container, skipped, in a link
        open_tags: dict[str, int] = {}  # open elements of each tag, so that no tag is looked for in vain
        open_blocks: list[int] = []  # their places in the stack
        pieces: list[str] = []
        at, size = 0, len(html)
        last = html.rfind(">") + 1  # no tag ends beyond it

        def flush() -> None:
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    self.blocks.append((text, stack[-1][1]))
                pieces.clear()

        def close(k: int) -> None:
            if open_blocks and open_blocks[-1] >= k:
                flush()
            while open_blocks and open_blocks[-1] >= k:
                open_blocks.pop()
            for tag, *_ in stack[k:]:
                open_tags[tag] -= 1
            del stack[k:]

        while at < size:
            found = _TAG.search(html, at, last) if at < last else None
            end = found.start() if found else size
            if end > at and not stack[-1][2]:
                piece = html[at:end]
                if "&" in piece:
                    piece = unescape(piece)
                pieces.append(piece)
                if stack[-1][3]:
                    self.links[stack[-1][1]] += len(piece.strip())
            if not found:
                break
            at = found.end()
            tag = (found[2] or found[5] or "").lower()
            if not tag:
                continue
            if found[1] or found[4]:
                if open_tags.get(tag):
                    close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
                elif tag in BLOCK:
                    flush()
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif not stack[-1][2]:
                    pieces.append(" ")
                continue
            rest = found[3] if found[2] else found[6]
            if tag in RAW:
                over = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = over.end() if over else size
                continue
            if tag in BLOCK:
                flush()
                if open_blocks:
                    open_tag = stack[open_blocks[-1]][0]
                    if open_tag == "p" or open_tag == tag and tag in ("li", "td", "th", "tr") or {open_tag, tag} <= {"dt", "dd"}:
                        close(open_blocks[-1])
            _, inside, skipped, link = stack[-1]
            names = attributes(rest) if rest else {}
            if not skipped:
                # What is not shown and what is pressed is skipped; whether other suspects go is settled at the end of the page.
                skipped = tag == "button" or "hidden" in names or names.get("aria-hidden", "").lower() == "true"
                whole = set(f"{names.get('class', '')} {names.get('id', '')}".lower().split()) if names else set()
                words = {w for name in whole for w in _SPLIT.split(name)}
                in_article = bool(open_tags.get("article") or open_tags.get("main"))
                open_page = tag not in ("html", "body", "main")
                foreign = bool(whole & FOREIGN or words & SURELY)
                suspect = (
                    tag in NOT_ARTICLE
                    or open_page and bool(words & MARKS)
                    or open_page and tag != "article" and not in_article and (tag == "header" or bool(whole & HEADERS))
                    or names.get("role", "").lower() in ROLES
                )
                if (tag in CONTAINER or suspect) and not skipped:
                    self.containers.append((_label(tag, names), inside, tag))
                    self.links.append(0)
                    inside = len(self.containers) - 1
                    if suspect:
                        self.marked.add(inside)
                        if words & COMMENTS:
                            self.comments.add(inside)
                        if tag in PIECES and not foreign:
                            self.pieces.add(inside)
            if tag in BLOCK:
                open_blocks.append(len(stack))
            open_tags[tag] = open_tags.get(tag, 0) + 1
            stack.append((tag, inside, skipped, link or tag == "a"))
        flush()

    def _settle(self) -> None:
        """Drop marked containers, but for wrappers, after all of them have been measured.

        Those are: around an unmarked article or main element; on pages that have none, with most of the page's text;
        inside an article or main element, with most of its text. Containers that are mostly links, and comments
        that are not nearly all of the page, are no wrappers. Small pieces stay unless they are mostly links.
        """
        n = len(self.containers)
        size, links = [0] * n, list(self.links)
        for text, c in self.blocks:
            size[c] += len(text)
        self.main = [c not in self.marked and tag in ("article", "main") for c, (_, _, tag) in enumerate(self.containers)]
        dropped = [False] * n
        if self.marked:
            around_main, within = list(self.main), [False] * n  # within: a marked container or inside one
            inside_main = [-1] * n  # the innermost main element around a container
            for c in range(1, n):
                around = self.containers[c][1]
                within[c] = within[around] or c in self.marked and c not in self.pieces
                inside_main[c] = around if self.main[around] else inside_main[around]
            beside = any(m and not within[c] for c, m in enumerate(self.main))
            for c in range(n - 1, 0, -1):
                around = self.containers[c][1]
                size[around] += size[c]
                links[around] += links[c]
                around_main[around] |= around_main[c]
            for c in range(1, n):
                main = inside_main[c]
                linked = 2 * links[c] > size[c]
                if c in self.pieces:
                    wrapper = not linked
                elif linked and not around_main[c]:
                    wrapper = False
                elif c in self.comments and size[c] < COMMENTS_SHARE * size[0] and not around_main[c]:
                    wrapper = False
                elif main >= 0:
                    wrapper = 2 * size[c] > size[main]
                else:
                    wrapper = not beside and (around_main[c] or not around_main[0] and 2 * size[c] > size[0])
                dropped[c] = dropped[self.containers[c][1]] or c in self.marked and not wrapper
        self.blocks = [(text, c) for text, c in self.blocks if not dropped[c]]
        self.links = [0 if gone else k for k, gone in zip(self.links, dropped)]
        self.main = [tag in ("article", "main") and not gone for (_, _, tag), gone in zip(self.containers, dropped)]

    def path(self, c: int) -> str:
        """Labels from the page to a container; no label has the character between them, as it counts as white space."""
        out = []
        while c > 0:
            out.append(self.containers[c][0])
            c = self.containers[c][1]
        return PATH.join(reversed(out))

    def at(self, path: str) -> set[int]:
        """Containers that have a path."""
        labels = path.split(PATH) if path else []
        depth = [0] * len(self.containers)  # labels that agree from the page on, -1 once one does not
        for c, (label, around, _) in enumerate(self.containers[1:], 1):
            d = depth[around]
            depth[c] = d + 1 if 0 <= d < len(labels) and labels[d] == label else -1
        return {c for c, d in enumerate(depth) if d == len(labels)}

    def best(self) -> int:
        """The container that holds the article: inwards from the page while one container has most of the text.

        Link text counts against a container. The first article or main element on the way ends the search. Other
        containers are entered only if what lies beside them is no text or mostly links, so headings and neighbours stay.
        """
        weight = [-2 * n for n in self.links]
        for text, c in self.blocks:
            weight[c] += len(text)
        own, main = list(weight), list(self.main)
        inner: list[list[int]] = [[] for _ in weight]
        for c in range(len(weight) - 1, 0, -1):
            inner[self.containers[c][1]].append(c)
            weight[self.containers[c][1]] += max(weight[c], 0)
            main[self.containers[c][1]] |= main[c]
        at = 0
        while not self.main[at]:
            ahead = max(inner[at], key=lambda c: (weight[c], -c), default=None)
            if ahead is None or weight[ahead] < MAIN_SHARE * weight[at] or weight[ahead] <= 0:
                break
            if not main[ahead] and (own[at] > 0 or any(weight[c] > 0 for c in inner[at] if c != ahead)):
                break
            at = ahead
        return at

    def text(self, chosen: set[int]) -> str:
        """Blocks inside the chosen containers, in page order."""
        inside = [False] * len(self.containers)
        for c, (_, around, _) in enumerate(self.containers):
            inside[c] = c in chosen or around >= 0 and inside[around]
        return "\n".join(text for text, c in self.blocks if inside[c])


def main_text(html: str, path: str | None = None) -> str:
    """Text of the containers with the given path; of the page's own best container where that has much more."""
    page = Page(html)
    own = page.text({page.best()})
    if path is not None:
        found = page.text(page.at(path))
        if found and len(found) >= FAIR_SHARE * len(own):
            return found
    return own


def host_of(url: F.Column) -> F.Column:
    """Host of a URL in lower case, empty if there is none."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the container path that most pages of the host score best; ties go to more text, then by path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, sizes = [], []
            for html in batch.column("html"):
                page = Page(html.as_py() or "")
                best = page.best()
                paths.append(page.path(best))
                sizes.append(len(page.text({best})))
            yield pa.RecordBatch.from_pydict({"host": batch.column("host"), "path": pa.array(paths, pa.string()), "chars": pa.array(sizes, pa.int64())})

    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, chars long")
    tally = votes.where("chars > 0").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("chars").alias("chars"))
    order = W.partitionBy("host").orderBy(F.desc("votes"), F.desc("chars"), "path")
    return tally.withColumn("place", F.row_number().over(order)).where("place = 1").select("host", "path")


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page: (page_id, url, text, n_chars).

    Each page's containers are scored, pages vote by host on generalised tag-class paths, and each page is read again
    with its host's winning path. Hosts' winners are broadcast only if they are small; else the pages are joined by
    host, where adaptive execution splits a hot host. A page without such a path, or with less than a
    tenth of its own best container's text in it, gives the text of the latter. Null or empty html gives an empty text of 0 characters; a null or odd url belongs
    to the nameless host. White space is what Unicode calls so. Repeated rows give repeated results; further columns
    are ignored.
    """
    winners = broadcast_if_small(materialise(winning_paths(pages), "paths"))
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("_host"))
    joined = rows.join(winners, F.col("_host") == F.col("host"), "left").select("page_id", "url", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "", p.as_py()) for h, p in zip(batch.column("html"), batch.column("path"))]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    return joined.mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")
