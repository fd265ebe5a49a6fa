"""HTML extraction by composite text density.

Every node gets a density of characters per tag, lowered by its links; a node's density sum is that of
its children. The node of the largest sum is the article's body, and the least density on its path to
``body`` is the threshold that other branches must reach to count too.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select audio video canvas".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul caption head".split())
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "head", "body", "option", "legend"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSE_WITHIN = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Elements, roles and words of class or id that mark what is not the article.
CHROME_TAGS = frozenset("nav footer aside form fieldset label dialog menu head".split()) | RAW
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CHROME_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup comment comments commentlist respond replies disqus share sharing social breadcrumb breadcrumbs pagination pager related recommended widget login search".split()
)
#: Words that may stand beside those in a name ("site-header", "cookie-box"); any other makes it tell of something else ("notice-period").
FRAME_WORDS = frozenset("site main top bottom left right inner outer box bar list area block wrapper wrap container region panel link links primary secondary global sticky fixed body count thread slot unit button buttons form icons inline".split())
#: Words that prose inside an article may bear as well; they mark it only if it has links.
SOFT_WORDS = frozenset("search related recommended".split())
#: Headings of reader comments, and headings that are such only over a row of signed items.
COMMENT_HEADING = re.compile(r"(?i)\s*(?:(?:\d+ )?(?:reader |readers' |user )?(?:comments?|kommentare?|commentaires?|comentarios?)|leave a (?:comment|reply)|what (?:our |the )?readers (?:say|said|think))\s*(?:\(\d+\)|:)?\s*")
REPLIES_HEADING = re.compile(r"(?i)\s*(?:\d+ )?(?:responses|replies|discussion)\s*(?:\(\d+\)|:)?\s*")
#: Elements, and words of class, that sign an item with its author or time.
SIGNED_TAGS = frozenset("time cite address footer".split())
SIGNED_WORDS = frozenset("author user username avatar date time posted comment reply byline".split())
#: An article beside or below the winner counts from this share of its text; a signed or linked article is a part of the page's from that share of the longest one's.
ARTICLE_SHARE, PART_SHARE = 1 / 3, 1 / 4
UNSEEN = re.compile(r"(?i)(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
COMMENT_WORDS = frozenset("comment comments commentlist respond replies disqus".split())
COMMENT_ENDS = COMMENT_WORDS - {"comment"}
KEPT_TAGS = frozenset("html body article main h1".split())
#: Elements that hold a link list or menu as a whole.
LISTING = frozenset("ul ol dl div section table center details".split())
ARTICLE_ROLES = frozenset(("main", "article"))

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")
WORDS = re.compile(r"[a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "signed", "items", "chrome", "marks", "article", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.items = tag, parent, []
        found: dict[str, str] = {}
        for k, *values in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
            found.setdefault(k.lower(), "".join(values))
        roles = set(WORDS.findall(found.get("role", "").lower()))
        names = [WORDS.findall(CAMEL.sub("-", x).lower()) for x in f"{found.get('class', '')} {found.get('id', '')}".split()]
        named = {w for x in names if all(w in CHROME_WORDS or w in FRAME_WORDS or w.isdigit() for w in x) for w in x}
        named |= {x[-1] for x in names if x and x[-1] in COMMENT_ENDS}  # "post-comments"
        if any(k == "data-ad" or k.startswith("data-ad-") for k in found):
            named.add("ad")
        self.signed = tag in SIGNED_TAGS or any(w in SIGNED_WORDS for x in names for w in x)
        self.article = tag in ("article", "main") or bool(roles & ARTICLE_ROLES) or found.get("itemprop", "").lower() == "articlebody"
        plain = tag not in KEPT_TAGS and tag not in HEADINGS and not self.article
        self.chrome = tag in CHROME_TAGS or plain and ("hidden" in found or bool(roles & CHROME_ROLES) or bool(UNSEEN.search(found.get("style", ""))))
        #: Words of class or id (and an article's roles) that make the node chrome, unless unmark() finds the article in it.
        self.marks = named & CHROME_WORDS if plain and not self.chrome else frozenset()
        if self.article and tag != "main" and not self.chrome:  # an article's own mark is a whole name, "comment-..." or its role: "comments-open" tells of something else
            own = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
            self.marks = CHROME_WORDS & {x.split("-")[0] if x.startswith("comment-") else x for x in own} | roles & CHROME_ROLES
        if tag == "header" and not self.chrome:
            self.chrome = not any(x.article for x in self.above())

    def above(self) -> Iterator[Node]:
        node = self.parent
        while node:
            yield node
            node = node.parent


def parse(html: str) -> Node:
    """A tree of the page, forgiving as browsers are: unclosed p, li, table parts and inline elements end where they must."""
    root = Node("html", None)
    open_, at = [root], 0
    while at < len(html):
        m = TOKEN.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            open_[-1].items.append(unescape(text))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                open_[-1].items.append(m[0][9:].removesuffix("]]>"))
            continue
        if m[1] or m[4]:
            k = next((k for k in range(len(open_) - 1, 0, -1) if open_[k].tag == tag), 0)
            if k and not (tag not in BLOCK and any(x.tag in BLOCK for x in open_[k + 1 :])):
                del open_[k:]
            continue
        attributes = m[3] if m[3] is not None else m[6] or ""
        if tag in RAW:
            if tag != "svg" or not attributes.endswith("/"):  # HTML closes no other of these by a slash
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            open_[-1].items.append(" ")
            continue
        if tag in ("html", "body") and any(x.tag == tag for x in open_):
            continue
        if tag in CLOSES_P:
            _close(open_, {"p"}, {"table", "td", "th", "li", "div", "article", "section", "main", "blockquote", "aside", "nav", "footer", "header", "form"})
        if tag in CLOSED_BY:
            _close(open_, CLOSED_BY[tag], CLOSE_WITHIN[tag])
        if tag == "body":
            _close(open_, {"head"}, set())
        node = Node(tag, open_[-1], attributes)
        open_[-1].items.append(node)
        if tag not in VOID:
            open_.append(node)
    return root


def _close(open_: list[Node], tags: set[str], within: set[str]) -> None:
    for k in range(len(open_) - 1, 0, -1):
        if open_[k].tag in tags:
            del open_[k:]
            return
        if open_[k].tag in within:
            return


def _nodes(root: Node) -> list[Node]:
    """All nodes that are not chrome, parents first."""
    out = [root]
    for node in out:
        out.extend(x for x in node.items if isinstance(x, Node) and not x.chrome)
    return out


def _remarks(root: Node) -> None:
    """Mark the containers that open with a heading of reader comments and hold more than it."""
    for node in _nodes(root):
        if node.tag in HEADINGS and node.parent and node.parent.tag in LISTING and not node.parent.article:
            first = next((x for x in node.parent.items if isinstance(x, Node) or x.strip()), None)
            said = "".join(x for x in node.items if isinstance(x, str))
            if first is node and len(node.parent.items) > 1 and (COMMENT_HEADING.fullmatch(said) or REPLIES_HEADING.fullmatch(said) and _signed_row(node.parent)):
                node.parent.marks = node.parent.marks | {"comments"}


def _below(node: Node) -> Iterator[Node]:
    """node and all below it that is not chrome, and what signs it even if that is."""
    todo = [node]
    for x in todo:
        yield x
        todo.extend(y for y in x.items if isinstance(y, Node) and (not y.chrome or y.signed))


def _signed_row(node: Node) -> bool:
    """Whether node, or a list in it, holds two items or more of one kind that bear an author or a time."""
    for holder in (node, *(x for x in node.items if isinstance(x, Node) and x.tag in LISTING)):
        kinds: dict[str, int] = {}
        for x in holder.items:
            if isinstance(x, Node) and x.tag not in HEADINGS and any(y.signed for y in _below(x)):
                kinds[x.tag] = kinds.get(x.tag, 0) + 1
        if any(n > 1 for n in kinds.values()):
            return True
    return False


def _nested(root: Node) -> None:
    """Mark the articles inside an article whose own text is more than theirs: they are what readers wrote."""
    nodes = _nodes(root)
    if sum(n.tag == "article" for n in nodes) < 2:
        return
    home: dict[Node, Node | None] = {}  # the nearest article a node is in
    chars: dict[Node, int] = {}
    inner: dict[Node, int] = {}
    for n in nodes:
        home[n] = n.parent if n.parent and n.parent.tag == "article" else home.get(n.parent)
        own = n if n.tag == "article" else home[n]
        if own is not None:
            chars[own] = chars.get(own, 0) + sum(len(x) - x.count(" ") - x.count("\n") for x in n.items if isinstance(x, str))
    whole = dict(chars)
    for n in reversed(nodes):
        if n.tag == "article" and (up := home[n]) is not None:
            whole[up] = whole.get(up, 0) + whole.get(n, 0)
            inner[up] = inner.get(up, 0) + whole.get(n, 0)
    for n in nodes:
        if n.tag == "article" and (up := home[n]) is not None and chars.get(up, 0) > inner.get(up, 0):
            n.marks = n.marks | {"comments"}


def unmark(root: Node) -> None:
    """Make nodes marked by class or id chrome, but not one that holds an article or most of the page's text outside links.

    Such a mark often tells of what else stands in a wrapper ("has-sidebar"). Inside an article, what holds another one is no
    wrapper. Comments are chrome where an article stands beside them. Marked articles stay where no other is on the page.
    """
    nodes = _nodes(root)
    if not any(n.marks for n in nodes):
        return
    plain, held, linked = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), {}
    for n in nodes:
        linked[n] = n.tag == "a" or n.parent in linked and linked[n.parent]
    for n in reversed(nodes):
        if not linked[n]:
            plain[n] += sum(len(x) - x.count(" ") - x.count("\n") for x in n.items if isinstance(x, str))
        held[n] += n.article and not n.marks and plain[n] > 0
        if n.parent:
            plain[n.parent] += plain[n]
            held[n.parent] += held[n]
    around, within = {None: 0}, {None: False}
    for n in nodes:
        up = n.parent
        around[n] = around[up] + (n.article and not n.marks and plain[n] > 0)
        within[n] = within[up] or n.article and n.tag != "main"
        if n.marks:
            beside = held[root] - held[n] - around[up]
            keep = plain[n] * 2 > plain[root] or held[n] > 0 and not within[up] or n.article and not held[root]
            keep = keep or within[up] and n.marks <= SOFT_WORDS and all(x.tag != "a" for x in _below(n))
            n.chrome = not keep or beside > 0 and bool(n.marks & COMMENT_WORDS)


def weigh(root: Node) -> list[Node]:
    """Settle what is chrome and set every other node's density and density sum."""
    _remarks(root)
    _nested(root)
    unmark(root)
    nodes = _nodes(root)
    for n in nodes:
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        n.total = 0.0
    for n in reversed(nodes):
        n.chars += sum(len(x) - x.count(" ") - x.count("\n") for x in n.items if isinstance(x, str))
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags + 1
        if p := n.parent:
            p.chars, p.tags = p.chars + n.chars, p.tags + n.tags + 1
            p.link_chars, p.link_tags = p.link_chars + n.link_chars, p.link_tags + n.link_tags
    ratio = root.link_chars / max(1, root.chars)
    for n in nodes:
        c, t, lc, lt = n.chars, max(1, n.tags), n.link_chars, n.link_tags
        base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
        n.density = c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt)), base) if c and base > 1 else c / t * math.log(max(1.0, c * t)) if c else 0.0
        if n.parent:
            n.parent.total += n.density
    return nodes


def bodies(root: Node) -> list[Node]:
    """The subtrees that form the article, in page order; what does not belong to them is taken out of the tree.

    The node of the largest sum counts. If it is in an article element, or such elements below it hold ARTICLE_SHARE of its text, these count instead, with their siblings of the same
    tag that are no comments or teasers; else a branch beside its path to the body counts if it reaches the threshold and is not mostly
    links, and so do headings of the page. Link lists below the threshold go, but not from an article, nor from under a heading.
    """
    nodes = weigh(root)
    text = [n for n in nodes if n.chars]
    if not text:
        return []
    best = max(text, key=lambda n: n.total)
    if best.total == 0.0:
        best = max(text, key=lambda n: n.density)
    above = [best, *best.above()]
    lifted = next((n for n in above if n.article), None)
    if not lifted:
        below = [n for n in nodes if n.article and n.chars and not any(x.article and x.tag != "main" for x in n.above()) and best in n.above()]
        below = [n for n in below if n.tag != "main" or not any(x.article and n in x.above() for x in below)]
        if sum(n.chars - n.link_chars for n in below) >= ARTICLE_SHARE * max(1, best.chars - best.link_chars):
            lifted = max(below, key=lambda n: n.chars, default=None)
    if lifted:
        threshold = min(n.density for n in above[: above.index(lifted) + 1]) if lifted in above else lifted.density
        found = [n for n in nodes if n is lifted or n.article and n.chars and n.tag == lifted.tag and n.parent is lifted.parent]
        longest = max(n.chars for n in found)
        found = [n for n in found if n is lifted or n.chars >= PART_SHARE * longest or not _foreign(n)]
    else:
        path = [n for n in above if n.tag not in ("html", "body")] or [best]
        threshold = min(n.density for n in path)
        for inner, outer in zip(above, above[1:]):
            outer.items = [x for run in _runs(outer) if _counts(run, inner, threshold) for x in run]
        found = [root]
    for n in found:
        if not (n.article and n.tag != "main"):
            _drop_links(n, threshold)
    return found


def _foreign(article: Node) -> bool:
    """Whether a short article is signed as a comment is, or leads elsewhere as a teaser does."""
    return any(x is not article and x.signed or x.tag == "a" and x.parent and (x.parent.tag in HEADINGS or any(y.tag in HEADINGS for y in x.items if isinstance(y, Node))) for x in _below(article))


def _inline(x: Node | str) -> bool:
    """Whether x is text or an inline element without blocks in it."""
    todo = [x]
    for y in todo:
        if isinstance(y, Node) and not y.chrome:
            if y.tag in BLOCK:
                return False
            todo.extend(y.items)
    return True


def _runs(node: Node) -> list[list[Node | str]]:
    """The items of a node, with text and the inline elements in it as one."""
    out: list[list[Node | str]] = []
    last = False
    for x in node.items:
        inline = _inline(x)
        if inline and last:
            out[-1].append(x)
        else:
            out.append([x])
        last = inline
    return out


def _counts(run: list[Node | str], inner: Node, threshold: float) -> bool:
    """Whether a branch beside inner, a child on the path, belongs to the article; text right in a node of the path does unless it is mostly links."""
    if inner in run:
        return True
    nodes = [x for x in run if isinstance(x, Node) and not x.chrome]
    links = sum(x.link_chars for x in nodes)
    if len(run) == 1 and nodes:
        return nodes[0].tag in ("h1", "h2", "h3") or nodes[0].density >= threshold and links * 2 < nodes[0].chars
    return links * 2 <= sum(x.chars for x in nodes) + sum(len("".join(x.split())) for x in run if isinstance(x, str))


def _drop_links(top: Node, threshold: float) -> None:
    """Take out the containers below top that are mostly links and do not reach the threshold."""
    todo = [top]
    for node in todo:
        kept, headed = [], False
        for x in node.items:
            if isinstance(x, str) or x.chrome or headed or not (x.tag in LISTING and x.link_chars * 2 >= x.chars > 0 and x.density < threshold):
                kept.append(x)
            if isinstance(x, Node) or x.strip():
                headed = isinstance(x, Node) and x.tag in HEADINGS and x.tag != "h1"
        node.items = kept
        todo.extend(x for x in node.items if isinstance(x, Node) and not x.chrome)


def blocks(node: Node) -> list[str]:
    """The texts of the blocks below node in page order, white space made one blank."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        if text := " ".join("".join(line).split()):
            out.append(text)
        line.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            line.append(x)
        elif x.chrome and x is not node:
            line.append(" ")
        elif x.tag == "br":
            line.append(" ")
        else:
            block = x.tag in BLOCK
            if block:
                end()
                todo.append(None)
            todo.extend(reversed(x.items))
    end()
    return out


def main_text(html: str | None) -> str:
    """The article's blocks, one a line; empty for null, empty or article-less pages."""
    if not html:
        return ""
    found = bodies(parse(html))
    return "\n".join(x for n in found for x in blocks(n))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text and n_chars (code points).

    A null or empty page, or one without an article, has an empty text. Any length is read whole; repeated
    and null ids are rows of their own; other columns are ignored. Pages are independent, so there is no shuffle.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h if isinstance(h, str) else None) for h in batch.html]
            yield pd.DataFrame({"page_id": batch.page_id, "url": batch.url, "text": texts, "n_chars": [len(t) for t in texts]})

    return rows.mapInPandas(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
