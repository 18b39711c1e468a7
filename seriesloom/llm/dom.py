"""A small reader of HTML as it comes: trees of elements and texts, and the blocks of text in them."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

# Elements of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: An element that opens ends these if they are open, unless one of the second set stands between.
ENDS = {
    **{t: (frozenset({"p"}), frozenset({"button", "td", "th", "caption", "table", "div", "article", "section", "li", "body"})) for t in BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "caption"}},
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table", "tbody", "thead", "tfoot"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "body": (frozenset({"head"}), frozenset()),
}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")

_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!|;|$)", re.I)


class Node:
    """An element: tag, names (classes, id, role in lower case), and what it holds."""

    __slots__ = ("tag", "names", "hidden", "children", "parent")

    def __init__(self, tag: str, names: tuple[str, ...] = (), hidden: bool = False, parent: Node | None = None):
        self.tag, self.names, self.hidden, self.parent = tag, names, hidden, parent
        self.children: list[Node | str] = []

    @property
    def label(self) -> str:
        """Tag and names without digits, by which nodes of two pages are alike."""
        return ".".join([self.tag, *(re.sub(r"\d+", "", n) for n in self.names)])


def parse(text: str | None) -> Node:
    """The tree of a page; unclosed and misplaced tags are borne as browsers do, in the main."""
    root = Node("#root")
    node, at, text = root, 0, text or ""
    while at < len(text):
        m = _TOKEN.match(text, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][:4] != "<!--" and m[0][:2] not in ("<!", "<?"):
                node.children.append(m[0])
            continue
        tag = tag.lower()
        if m[1]:
            open_ = node
            while open_.parent is not None and open_.tag != tag:
                if open_.tag in ("td", "th", "table") and tag not in BLOCK:
                    break
                open_ = open_.parent
            if open_.tag == tag:
                node = open_.parent
            continue
        if tag in ENDS:
            closes, bounds = ENDS[tag]
            open_ = node
            while open_.parent is not None and open_.tag not in bounds and open_.tag not in closes:
                open_ = open_.parent
            if open_.tag in closes:
                node = open_.parent
        names, hidden = [], False
        if m[3]:
            for a in _ATTRIBUTE.finditer(m[3]):
                name = a[1].lower()
                if name == "hidden" or name == "style" and _UNSEEN.search(a[2] or a[3] or a[4] or ""):
                    hidden = True
                elif name in ("class", "id", "role"):
                    names += (a[2] or a[3] or a[4] or "").lower().split()
        new = Node(tag, tuple(names), hidden, node)
        node.children.append(new)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>|\Z", re.I).search(text, at)
            new.children.append(text[at : end.start()])
            at = end.end()
        elif tag not in VOID and not m[3].endswith("/"):
            node = new
    return root


def blocks(root: Node, skip) -> Iterator[tuple[Node, str]]:
    """The blocks of text below ``root`` in page order, each with the block element it stands in.

    Character references are decoded, white space becomes single blanks, elements for which
    ``skip`` is true are left out, and empty blocks too.
    """
    parts: list[str] = []

    def finished(owner: Node) -> Iterator[tuple[Node, str]]:
        line = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if line:
            yield owner, line

    todo: list[tuple[Node, int]] = [(root, 0)]
    owners = [root]
    while todo:
        node, k = todo.pop()
        if k == len(node.children):
            if node.tag in BLOCK:
                yield from finished(owners.pop())
            continue
        todo.append((node, k + 1))
        child = node.children[k]
        if isinstance(child, str):
            parts.append(child)
        elif child.tag == "br":
            parts.append(" ")
        elif not skip(child):
            if child.tag in BLOCK:
                yield from finished(owners[-1])
                owners.append(child)
            todo.append((child, 0))
        elif child.tag in BLOCK:
            yield from finished(owners[-1])
    yield from finished(root)
