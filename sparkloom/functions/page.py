"""The text of a page as a reader sees it: block breaks, cell separators, no chrome, no reference sections."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, functions as F

from .answer import decode_residual
from .text import each

#: Elements that end a line, cells, elements without visible text, elements without content.
BLOCKS = frozenset(
    "address article aside blockquote details dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CELLS = frozenset(["td", "th"])
SKIPPED = frozenset("script style noscript template".split())
#: Elements that may stand in the head; any other ends it.
HEAD = frozenset("base link meta noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What is removed before reading: elements, classes and a role, and sections by their heading.
REMOVED = frozenset("script style noscript nav footer form aside".split())
REMOVED_CLASSES = frozenset("mw-editsection mw-references-wrap reflist references navbox catlinks".split())
REFERENCES = re.compile(r"(?i)^(?:references|bibliography|external links|further reading|notes|citations)$")
#: Characters an article needs, and its least share of the whole page.
ARTICLE_CHARS, ARTICLE_SHARE = 120, 0.55
#: An open element on the left ends where one on the right begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}


class _Node:
    __slots__ = ("tag", "attrs", "children", "gone")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children, self.gone = tag, attrs, [], False


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        top = self.open[-1].tag
        if (top == "p" and tag in BLOCKS) or (top == "head" and tag not in HEAD) or tag in ENDS.get(top, ()):
            self.open.pop()
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        # an end tag without a start within the last 64 open elements is ignored
        for k in range(len(self.open) - 1, max(0, len(self.open) - 65), -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def _nodes(root: _Node) -> list[_Node]:
    """All elements that are not gone, in no set order."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        found.append(node)
        todo.extend(c for c in node.children if isinstance(c, _Node) and not c.gone)
    return found


def _prune(root: _Node) -> None:
    for node in _nodes(root):
        classes = node.attrs.get("class", "").split()
        node.gone = node.tag in REMOVED or not REMOVED_CLASSES.isdisjoint(classes) or (node.tag == "sup" and "reference" in classes) or node.attrs.get("role") == "navigation"
    for node in _nodes(root):
        cutting = None
        for child in node.children:
            if not isinstance(child, _Node) or child.gone:
                continue
            if cutting and child.tag != cutting:
                child.gone = True
                continue
            cutting = None
            if child.tag in ("h2", "h3") and REFERENCES.match(re.sub(r"\[.*?\]", "", block_text(child)).strip()):
                child.gone, cutting = True, child.tag


def block_text(root: _Node) -> str:
    """Text with a line break at each block's ends (two in a row at most) and a bar between cells."""
    out: list[str] = []
    breaks, after_break, bar = 0, False, False  # what the text so far ends with
    todo: list[_Node | str | None] = [root]
    while todo:
        node = todo.pop()
        if node is None or isinstance(node, _Node) and (node.tag == "br" or node.tag in BLOCKS):
            if breaks < 2:
                out.append("\n")
                breaks, after_break = breaks + 1, True
        elif isinstance(node, _Node) and node.tag in CELLS and out and not after_break and not bar:
            out.append(" | ")
            breaks, after_break, bar = 0, False, True
        if isinstance(node, str):
            out.append(node)
            said = node.rstrip()
            space = node[len(said) :]
            plain = space.rstrip(" \t\n")
            if said:
                after_break, bar = False, said[-1] == "|"
            if said or plain:
                breaks = 0
            breaks += space.count("\n", len(plain))
            after_break = after_break or "\n" in space
        elif node is not None and node.tag not in SKIPPED:
            if node.tag in BLOCKS:
                todo.append(None)
            todo.extend(c for c in reversed(node.children) if isinstance(c, str) or not c.gone)
    return "".join(out)


#: Names that tell of what is no article, names that save them, and names that weigh for and against.
UNLIKELY = re.compile(r"(?i)-ad-|banner|breadcrumbs|combx|comment|community|cover-wrap|disqus|extra|footer|gdpr|header|legends|menu|related|remark|replies|rss|shoutbox|sidebar|skyscraper|social|sponsor|supplemental|ad-break|agegate|pagination|pager|popup")
MAYBE = re.compile(r"(?i)and|article|body|column|content|main|shadow")
GOOD = re.compile(r"(?i)article|body|content|entry|hentry|h-entry|main|page|pagination|post|text|blog|story")
BAD = re.compile(r"(?i)-ad-|hidden|^hid$| hid$| hid |^hid |banner|combx|comment|com-|contact|footer|gdpr|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget")
UNLIKELY_ROLES = frozenset("menu menubar complementary navigation alert alertdialog dialog".split())
SCORED = frozenset("section h2 h3 h4 h5 h6 p td pre".split())
BREAKING = frozenset("blockquote dl div img ol p pre table ul".split())
START = {"div": 5, "pre": 3, "td": 3, "blockquote": 3} | dict.fromkeys("address ol ul dl dd dt li form".split(), -3) | dict.fromkeys("h1 h2 h3 h4 h5 h6 th".split(), -5)
#: Characters of a paragraph that counts, ancestors that it counts for, weight of a name, and what a sibling must reach of the best score.
PARAGRAPH, ANCESTORS, NAME_WEIGHT, SIBLING_SHARE, SIBLING_LEAST = 25, 5, 25, 0.2, 10


class _Scores:
    """Scores of the elements of a tree as places of its article: each paragraph counts for those that hold it, the nearer the more."""

    def __init__(self, body: _Node, names: bool, unlikely: bool) -> None:
        self.names, self.body = names, body
        self.above: dict[_Node, _Node] = {}
        self.chars: dict[_Node, int] = {}
        self.links: dict[_Node, int] = {}
        self.commas: dict[_Node, int] = {}
        self.score: dict[_Node, float] = {}
        self.out: set[_Node] = set()
        self.order = [body]
        for node in self.order:
            for child in node.children:
                if isinstance(child, _Node) and not child.gone:
                    if unlikely and self._unlikely(child):
                        self.out.add(child)
                        continue
                    self.above[child] = node
                    self.order.append(child)
        for node in reversed(self.order):  # children stand behind their parents
            own = "".join(c for c in node.children if isinstance(c, str))
            self.chars[node] = self.chars.get(node, 0) + len(" ".join(own.split()))
            self.commas[node] = self.commas.get(node, 0) + own.count(",")
            if node.tag == "a":
                self.links[node] = self.chars[node]
            if up := self.above.get(node):
                for table in (self.chars, self.links, self.commas):
                    table[up] = table.get(up, 0) + table.get(node, 0)
        for node in self.order:
            if self._paragraph(node) and self.chars[node] >= PARAGRAPH:
                gain = 2 + self.commas[node] + min(self.chars[node] // 100, 3)
                for level, up in enumerate(self.ancestors(node)):
                    if up not in self.score:
                        self.score[up] = START.get(up.tag, 0) + self.weight(up)
                    self.score[up] += gain / (1 if level == 0 else 2 if level == 1 else level * 3)

    def _unlikely(self, node: _Node) -> bool:
        name = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"
        odd = UNLIKELY.search(name) and not MAYBE.search(name) and node.tag not in ("a", "body", "main", "article")
        return bool(odd) or node.attrs.get("role") in UNLIKELY_ROLES

    def _paragraph(self, node: _Node) -> bool:
        """A scored element, or a div with text and no block in it."""
        return node.tag in SCORED or node.tag == "div" and not any(isinstance(c, _Node) and c.tag in BREAKING for c in node.children) and any(isinstance(c, str) and c.strip() for c in node.children)

    def ancestors(self, node: _Node) -> list[_Node]:
        out = []
        while len(out) < ANCESTORS and (node := self.above.get(node)) is not None:
            out.append(node)
        return out

    def weight(self, node: _Node) -> int:
        out = 0
        for name in (node.attrs.get("class", ""), node.attrs.get("id", "")) if self.names else ():
            out += NAME_WEIGHT * (bool(GOOD.search(name)) - bool(BAD.search(name)))
        return out

    def link_share(self, node: _Node) -> float:
        return self.links.get(node, 0) / self.chars[node] if self.chars.get(node) else 0.0

    def chosen(self) -> list[_Node]:
        """The element of the best score and those of its siblings that belong to it, in page order; the body where nothing scores."""
        if not self.score:
            return [self.body]
        final = {n: s * (1 - self.link_share(n)) for n, s in self.score.items()}
        top = max(final, key=final.__getitem__)
        while (up := self.above.get(top)) is not None and up is not self.body and sum(isinstance(c, _Node) and not c.gone for c in up.children) == 1:
            top = up  # a wrapper of nothing else may have the siblings
        if (up := self.above.get(top)) is None:
            return [top]
        best = final.get(top, max(final.values()))
        least = max(SIBLING_LEAST, best * SIBLING_SHARE)
        named = top.attrs.get("class", "")
        return [c for c in up.children if isinstance(c, _Node) and not c.gone and c not in self.out and (c is top or self._joins(c, final, least, best * SIBLING_SHARE if named and c.attrs.get("class", "") == named else 0.0))]

    def _joins(self, node: _Node, final: dict[_Node, float], least: float, bonus: float) -> bool:
        if node in final and final[node] + bonus >= least:
            return True
        if node.tag != "p":
            return False
        chars, share = self.chars.get(node, 0), self.link_share(node)
        said = block_text(node).strip()
        return chars > 80 and share < 0.25 or 0 < chars <= 80 and share == 0 and re.search(r"\.(?: |$)", said) is not None


def article_text(body: _Node) -> str:
    """The text of the page's article by the scores of its paragraphs; where that is short, without regard to names, and of short ones the longest."""
    tried = []
    for names, unlikely in ((True, True), (True, False), (False, False)):
        scores = _Scores(body, names, unlikely)
        for n in scores.out:
            n.gone = True
        text = "\n".join(block_text(n) for n in scores.chosen()).strip()
        for n in scores.out:
            n.gone = False
        if len(text) >= ARTICLE_CHARS:
            return text
        tried.append(text)
    return max(tried, key=len)


def read_page(html: str) -> str:
    """The article's text where it holds enough of the page, else the whole page's."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    nodes = _nodes(tree.root)
    body = next((n for n in nodes if n.tag == "body"), tree.root)
    for n in nodes:
        n.gone = n.tag in ("head", "title")
    _prune(tree.root)
    whole = block_text(body).strip()
    inner = article_text(body)
    return inner if inner and len(inner) >= len(whole) * ARTICLE_SHARE else whole


def page_reading(html: Column) -> Column:
    """What is indexed of a page; null html reads as empty."""

    read = each(html, lambda h: read_page(h) if h else "", "string", pa.string())
    text = F.regexp_replace(decode_residual(read), " ", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"[ \t]*\n[ \t]*", "\n")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+\z", "")
