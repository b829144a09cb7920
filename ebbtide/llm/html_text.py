"""Main text of web pages by consensus paths of each host.

First pass: every page looks for the container of its article, the deepest one that
has nearly all paragraph text, less link text; it does not go below an article, nor
below a container with a headline or paragraph of its own. The page votes for the
tag-class path of that container. Digits in class names are generalised, so that
`post-17` and `post-18` are one path; ids are left out. Votes are summed up per host
and path in Spark, partially in each task, and the best paths of a host are ranked.
Second pass: a page takes the elements at the best path that it has, or its own
container if that is around them and has much more; sections are merged into the
container around, and it is widened to the headline and lead outside of it. A page
that has none of the paths takes its own container.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import extended, written

KEPT_PATHS = 5  # paths of a host that the second pass tries in turn

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<[!?][^>]*+>?""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
RAW = frozenset("script style noscript template textarea title svg iframe select option button annotation annotation-xml".split())
VERBATIM = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article main section div td body".split())
BOILER = frozenset("nav form menu dialog".split()) | RAW
UNSURE = frozenset("aside footer header".split())      # left out, but inside the article an aside or header only if low in text or mostly links
NEARLY_ALL = 0.9
WHOLE_PAGE = frozenset(("", "body"))
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCKS - {"body", "html"}
#: Whole class or id names, perhaps numbered, of parts of a page that are not its article; of tags that group other elements.
LEFT_OUT = frozenset("""ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promoted banner nav navbar
navigation menu breadcrumb breadcrumbs sidebar side footer header masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login share
sharing social related recommended widget widgets comment comments disqus replies reactions search toolbar pagination pager ad-container ad-slot ad-banner ad-box
ad-wrapper main-nav site-nav top-nav main-menu nav-menu nav-bar site-header page-header site-footer page-footer left-sidebar right-sidebar sidebar-left sidebar-right
cookie-banner cookie-notice cookie-consent consent-banner newsletter-signup share-buttons social-share social-links related-posts related-articles
comment-list comment-section comments-area promo-box search-form search-box""".split())
NUMBER = re.compile(r"[-_]?\d+$")
#: Of those, and with more words around, names that no part of an article has: they go at any length, by class or id, wherever they are.
NEVER = frozenset("""ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promoted nav navbar navigation breadcrumb
breadcrumbs sidebar footer cookie cookies consent gdpr newsletter signup share sharing comments disqus ad-container ad-slot ad-banner ad-box ad-wrapper main-nav site-nav
top-nav main-menu nav-menu nav-bar site-footer page-footer left-sidebar right-sidebar sidebar-left sidebar-right cookie-banner cookie-notice cookie-consent consent-banner
newsletter-signup share-buttons social-share social-links comment-list comment-section comments-area promo-box search-form search-box""".split())
NEVER_BY_CLASS = NEVER | frozenset("notice comment replies reactions subscribe toolbar pagination pager social login menu search".split())
COMMENTS = re.compile(r"(?!(?:with|has|no|without|show|hide|see|view)[-_])(?:[a-z]+[-_])?comments(?:[-_](?:list|area|section|wrapper|container|box|thread|block))?"
                      r"|comment[-_](?:list|area|section|wrapper|container|box|thread|block|form)|(?:[a-z]+[-_])?newsletter(?:[-_](?:signup|box|form|block|wrapper|container))?")
NAMED = frozenset("div section aside ul ol dl table tbody tr td header footer center fieldset details figure".split())
LOW_TEXT = 140          # characters that a part inside the article has at least, with links in less than half of its text
ROLES = frozenset("search dialog form menu navigation".split())
UNSURE_ROLES = frozenset("banner contentinfo complementary alert".split())
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "path", "out", "link", "parent", "at", "box", "block", "unsure", "mark")

    def __init__(self, tag: str, path: str, out: bool, link: bool, parent, at: int):
        self.tag, self.path, self.out, self.link, self.parent, self.at = tag, path, out, link, parent, at
        self.box = self if parent is None or tag in CONTAINERS else parent.box      # the container that it is or is in
        self.block = self if parent is None or tag in BLOCKS else parent.block
        self.unsure = parent.unsure if parent else None     # the outermost element around that is left out if it is not article text
        self.mark = 0       # 1 if its id, 2 if its tag, role or class says so, 3 if it is never article text


def parsed(page: str) -> tuple[list[Node], list[tuple[Node, list[str], bool]]]:
    """Elements in page order, and blocks of text: (innermost element, pieces, all in links)."""
    root = Node("", "", False, False, None, 0)
    nodes, blocks, stack = [root], [], [root]
    pieces: list[str] = []
    linked = False

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            blocks.append((holder, pieces, linked))
        pieces, linked = [], False

    holder, at = root, 0
    token = TOKEN.search
    while True:
        found = token(page, at)
        text = page[at:found.start()] if found else page[at:]
        top = stack[-1]
        if text and not top.out:
            if not pieces:
                holder, linked = top, True
            pieces.append(text)
            linked &= top.link or not text.strip()
        if not found:
            flush()
            return nodes, blocks
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            if tag in BLOCKS:
                flush()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    if tag in BLOCKS or not any(n.tag in CONTAINERS for n in stack[depth + 1:]):
                        del stack[depth:]
                    break
            continue
        if tag == "br":
            pieces.append(" ") if pieces else None
            continue
        if tag in BLOCKS:
            flush()
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in ("p", "li") and (stack[depth].tag == "p" or tag == "li"):
                    del stack[depth:]
                    break
                if stack[depth].tag in BLOCKS:
                    break
        parent = stack[-1]
        role, classes, ids = "", "", ""
        if found[3] and "=" in found[3]:
            got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(found[3])}
            classes, ids, role = got.get("class", ""), got.get("id", ""), got.get("role", "").lower()
        if found[3].endswith("/") and tag not in BLOCKS | CONTAINERS | BOILER:
            continue
        left = tag in BOILER or role in ROLES
        by_class = (tag in UNSURE and not (tag == "header" and inside(parent))) or role in UNSURE_ROLES or (tag in NAMED and named(classes))
        path = parent.path
        if tag in BLOCKS and tag not in ("p", "li"):
            label = re.sub(r"\d+", "#", ".".join(sorted(classes.lower().split())))
            path += "/" + tag + ("." + label if label else "")
        node = Node(tag, path, parent.out or left, parent.link or tag == "a", parent, len(nodes))
        never = (tag == "footer" or role == "contentinfo" or tag in NAMED and (named(classes, NEVER_BY_CLASS) or named(ids, NEVER) or
                 any(COMMENTS.fullmatch(x) for x in f"{classes} {ids}".lower().split())))
        node.mark = 3 if never else 2 if by_class else 1 if tag in NAMED and named(ids) else 0
        node.unsure = part_of(node)
        nodes.append(node)
        if tag in VERBATIM:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.append(node)


def named(names: str, known: frozenset[str] = LEFT_OUT) -> bool:
    return any(NUMBER.sub("", x) in known for x in names.lower().split())


def part_of(node: Node) -> Node | None:
    """The outermost part around an element that is left out if it is not article text; one that is never article text goes first."""
    up = node.parent.unsure
    return node if node.mark == 3 and (up is None or up.mark != 3) or node.mark and up is None else up


def inside(node: Node | None) -> bool:
    while node is not None:
        if node.tag in ("article", "main"):
            return True
        node = node.parent
    return False


def clean(pieces: list[str]) -> str:
    return SPACE.sub(" ", html.unescape("".join(pieces))).strip()


class Page:
    """What the containers of a page hold, by their numbers."""

    def __init__(self, page: str):
        self.nodes, blocks = parsed(page)
        texts = [n for n in self.nodes if n.tag in ("article", "main") and not inside(n.parent)]
        if len(texts) == 1 and texts[0].unsure is not None:     # a telling name around the only article does not count
            for node, within in zip(self.nodes, self.within(texts), strict=True):
                if within:
                    node.unsure = None if node is texts[0] else part_of(node)
        everything = [(holder, text, linked) for holder, pieces, linked in blocks if (text := clean(pieces))]
        self.blocks = [b for b in everything if b[0].unsure is None]
        self.unsure = len(self.blocks) < len(everything)
        if not any(not linked for _, _, linked in self.blocks):     # nothing else: then it is the article
            self.blocks, self.unsure = everything, False
        self.everything = everything
        self.own = [0.0] * len(self.nodes)
        self.prose = [False] * len(self.nodes)
        for holder, text, linked in self.blocks:
            at = holder.box.at
            self.own[at] += (-0.5 if linked else 1.0) * len(text)
            self.prose[at] |= not linked and holder.block.tag in PROSE
        self.total = [max(0.0, x) for x in self.own]
        self.inner: dict[int, list[Node]] = {}
        for node in reversed(self.nodes[1:]):
            if node.box is node:
                around = node.parent.box.at
                self.total[around] += self.total[node.at]
                self.inner.setdefault(around, []).append(node)

    def shown(self, region: list[bool]) -> list[tuple[Node, str, bool]]:
        """All blocks, with those of unsure parts inside the article that have text of their own."""
        if not self.unsure:
            return self.blocks
        text: dict[int, int] = {}
        links: dict[int, int] = {}
        for holder, words, linked in self.everything:
            if holder.unsure is not None:
                (links if linked else text).setdefault(holder.unsure.at, 0)
                (links if linked else text)[holder.unsure.at] += len(words)

        def kept(part: Node | None) -> bool:
            if part is None:
                return True
            own = text.get(part.at, 0)
            if part.mark == 3:
                return False
            return region[part.parent.at] and (part.mark == 1 or own >= LOW_TEXT and own > links.get(part.at, 0))
        return [b for b in self.everything if kept(b[0].unsure)]

    def within(self, roots: list[Node]) -> list[bool]:
        """Of each element, whether it is in one of the roots."""
        chosen, out = {n.at for n in roots}, []
        for node in self.nodes:
            out.append(node.at in chosen or (node.parent is not None and out[node.parent.at]))
        return out

    def at_path(self, path: str) -> list[Node]:
        """The outermost containers at a path that hold text."""
        same = [n for n in self.nodes if n.box is n and n.path == path]
        if not same:
            return []
        inside_ = self.within(same)
        full = set()
        for holder, _, _ in self.blocks:
            node, top = holder if inside_[holder.at] else None, None
            while node is not None and inside_[node.at]:
                node, top = node.parent, node
            if top is not None:
                full.add(top.at)
        return [n for n in same if n.at in full]

    def article(self) -> list[Node]:
        """The page's own choice: elements of one path, most often one; none if it has no text but links."""
        if not self.total[0]:
            return []
        for tag in ("article", "main"):
            groups: dict[str, float] = {}
            outer = self.within([n for n in self.nodes if n.tag == tag])
            for n in self.nodes:
                if n.tag == tag and not outer[n.parent.at]:
                    groups[n.path] = groups.get(n.path, 0.0) + self.total[n.at]
            if groups:
                best = max(groups, key=lambda k: (groups[k], k))
                if groups[best] >= 0.5 * self.total[0]:
                    return self.at_path(best)
        node = self.nodes[0]
        while True:
            own = max(0.0, self.own[node.at])
            if self.prose[node.at] and (node.tag not in WHOLE_PAGE or own > 0.5 * self.total[node.at]):
                return [node]
            inner = max(self.inner.get(node.at, ()), key=lambda n: (self.total[n.at], -n.at), default=None)
            # Paragraphs of the body itself are added to any choice.
            rest = self.total[node.at] - (own if node.tag in WHOLE_PAGE else 0.0)
            if inner is None or not self.total[inner.at] or self.total[inner.at] < NEARLY_ALL * rest:
                return [node]
            if (node.tag not in WHOLE_PAGE or inner.tag == "section") and any(self.like(n, inner) and self.total[n.at] for n in self.inner[node.at] if n is not inner):
                return [node]
            node = inner

    @staticmethod
    def like(a: Node, b: Node) -> bool:
        """Parts of one text, as far as their tags say."""
        return a.path == b.path or a.tag == b.tag == "section"

    def widened(self, chosen: list[Node]) -> list[Node]:
        """Siblings merged into their container if they are nearly all of it; then the outermost container with a headline or lead of its own."""
        size, semantic = sum(self.total[n.at] for n in chosen), chosen[0].tag in ("article", "main")
        around, single = chosen[0].parent, len(chosen) == 1
        while around is not None and around.box.tag not in WHOLE_PAGE:
            box = around.box
            if single or all(self.within([box])[n.at] for n in chosen):
                if self.prose[box.at] or (not single and size >= NEARLY_ALL * self.total[box.at]) or (box.tag in ("article", "main") and not semantic):
                    chosen, single, semantic = [box], True, semantic or box.tag in ("article", "main")
            around = box.parent
        return chosen


def votes(page: str) -> dict[str, float]:
    """The page's one vote; half of one for the whole body."""
    chosen = Page(page).article()
    return {chosen[0].path: 0.5 if chosen[0].tag in WHOLE_PAGE else 1.0} if chosen else {}


def main_text(page: str, paths: list[str]) -> str:
    seen = Page(page)
    own = seen.article()
    chosen = next(filter(None, map(seen.at_path, paths)), own)
    if not chosen:
        return ""
    if len(own) == 1 and own[0].tag not in WHOLE_PAGE:
        inside_own = seen.within(own)
        if all(inside_own[n.at] for n in chosen) and sum(seen.total[n.at] for n in chosen) < NEARLY_ALL * seen.total[own[0].at]:
            chosen = own
    roots = seen.widened(chosen)
    region = seen.within(roots)
    shown = seen.shown(region if roots[0].tag not in WHOLE_PAGE else [False] * len(region))
    headed = any(region[holder.at] and holder.block.tag == "h1" for holder, _, _ in shown)
    return "\n\n".join(text for holder, text, linked in shown
                       if region[holder.at] or (not linked and (holder.box.tag in WHOLE_PAGE and holder.block.tag in PROSE or not headed and holder.block.tag == "h1")))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums: dict[tuple[str, str], float] = {}
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            for path, share in votes(page.as_py()).items():
                sums[host, path] = sums.get((host, path), 0.0) + share
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()),
                                          pa.array(list(sums.values()), pa.float64())], names=["host", "path", "share"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py() or "", paths.as_py() or []) for page, paths in zip(batch.column("html"), batch.column("paths"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])


def consensus_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html", kept: int = KEPT_PATHS) -> DataFrame:
    """host, paths: the paths of each host, most votes first; ties by path."""
    hosted = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html")).where("html is not null")
    ballots = hosted.mapInArrow(_vote, "host string, path string, share double")
    # Shares are summed as whole millionths, so that the order of tasks cannot tip a tie.
    tally = ballots.groupBy("host", "path").agg(F.sum(F.round(F.col("share") * 1e6).cast("bigint")).alias("votes"))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    best = tally.withColumn("place", place).where(F.col("place") <= kept)
    return best.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("paths"))


def host_of(url_col: str):
    """Lower-case host, without port and user; '' if the url is null or has none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def main_texts(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Each row of pages as struct `row`, with text.

    Null or empty pages give an empty text; pages without a host vote together
    under the empty name; repeated pages each vote and each get their row. An
    empty table gives no rows. Left-out parts are scripts, forms, navigation and parts of
    a telling class or id outside the article; inside it comments, adverts, navigation,
    newsletters, notices, share boxes, sidebars and footers go at any length, and an
    aside, header or related part only if it is low in text or mostly links.
    """
    paths = written(pages.sparkSession, consensus_paths(pages, url_col, html_col), "host-paths")
    rows = pages.select(F.struct("*").alias("row"), F.col(html_col).alias("html"), host_of(url_col).alias("host"))
    row_type = pages.select(F.struct("*").alias("row")).schema
    return rows.join(paths, "host", "left").select("row", "html", "paths").mapInArrow(_extract, extended(row_type, "text string"))
