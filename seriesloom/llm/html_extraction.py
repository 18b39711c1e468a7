"""Main text of web pages by wrapper induction.

Pages of one host share a template. For each host and layout (the set of elements near the top
of a page) the page with the smallest tree is the seed, and the tree of every page is aligned
with it by simple tree matching: the most pairs of nodes with equal labels that keep parents and
order. Aligned nodes are the same node of the wrapper; a node that the seed lacks is known by its
path of labels. For each node all different pages are counted: a text is template if at least
half of the pages that have its node have it there, in the layout or, by path, in the host as a
whole. All other texts are slots.

Applied to every page of the host, the wrapper yields all slots in page order, wherever they
stand, without what a page marks as something else: menus, headers and footers, side bars,
notices, adverts, forms, scripts, styles and comments. Paragraphs and headings without a name in
an article or main element are text of the article however many pages share them. Pages with the
same text in all blocks count once, so copies of an article do not make it template; and where
template takes most of the paragraphs and headings of a page that marks no article (near
copies), those stay.

How it is laid out: one pass reads the pages and writes their blocks and the shape of their
tree. Seeds are an aggregate of the shapes. Blocks meet seeds, counts and template as rows, by
shuffle; no list of a host's nodes or texts is ever in one row, task or the driver. Blocks that
stay in any case, and pages of such blocks only, are not shuffled at all.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.dom import BLOCK, Node, blocks, parse
from seriesloom.session import cut_lineage

MAIN_SHARE = 0.8
TEMPLATE_SHARE = 0.5
#: Fewest different pages that make a text template, outside and inside an article or main element.
LEAST, LEAST_INSIDE = 2, 3
LAYOUT_DEPTH = 3
# Elements and names that are not the article.
_NOT_TEXT = frozenset("head title script style noscript template iframe svg textarea form button select nav menu footer aside dialog".split())
_NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies"
    " copyright disqus dialog footer form header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted"
    " promotion related reply replies search share sharing sidebar site-footer site-header social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Names that say what they are behind any first word: ``user-comments``, ``gdpr-banner``.
_CLEAR = frozenset(
    "ads advert adverts advertisement banner breadcrumb breadcrumbs comments commentlist consent cookie cookies disqus footer masthead modal nav navbar"
    " navigation newsletter pagination popup promo sidebar sponsored toolbar widget widgets".split()
)
#: First words that leave the other names in force: ``main-menu`` is no text, ``lunch-menu`` is.
_PLACES = frozenset(
    "article blog bottom drop dropdown entry global hamburger left main mobile page post primary reader right secondary side site story sub tertiary top user visitor web".split()
)
#: What a name with one of these words holds is more than the other words say: ``no-sidebar``, ``content-sidebar-wrap``.
_NEGATIONS = frozenset("content has have hide is js no not show with without".split())
#: Headers of a text hold its title.
_TITLED = frozenset("article blog entry page post story".split())
#: Second words of a hyphenated name that leave its first word in force: ``share-buttons`` is no text, ``share-price`` is.
_PARTS = frozenset(
    "area bar block body box button buttons container content form holder icons inner item items label link links list message outer overlay panel"
    " placeholder posts row section slot stories teaser teasers thread tools top bottom left right unit widget wrap wrapper".split()
)
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption article main body section".split())


#: Elements that hold text themselves; their names do not speak against them.
_TEXT = frozenset("html body main article p h1 h2 h3 h4 h5 h6 hgroup blockquote pre dt dd figcaption".split())


def not_text(node: Node) -> bool:
    """Whether tag or attributes of an element, whatever its names, leave no text of the article in it."""
    if node.tag in ("html", "body"):
        return False
    if node.tag in _NOT_TEXT or node.hidden:
        return True
    if node.tag == "header":  # that of an article holds its title
        up = node.parent
        while up is not None and up.tag not in ("article", "main"):
            up = up.parent
        return up is None
    return False


def not_article(node: Node) -> bool:
    """Whether an element says of itself that it is no part of the article; names only count on containers."""
    if not_text(node):
        return True
    if node.tag in _TEXT or not node.names:
        return False
    if node.tag not in BLOCK:  # an inline element in a heading or paragraph is part of it
        up = node.parent
        while up is not None and up.tag not in BLOCK:
            up = up.parent
        if up is not None and up.tag in _TEXT - {"html", "body", "main", "article"}:
            return False
    return any(map(_not_article_name, node.names))


def _not_article_name(name: str) -> bool:
    if name in _NOT_ARTICLE:
        return True
    words = [w for w in re.split(r"[-_]+", name) if w and not w.isdigit()]
    if words and words[0] in _NOT_ARTICLE and all(w in _PARTS or w in _NOT_ARTICLE for w in words):
        return True
    while words and words[-1] in _PARTS:
        words.pop()
    if len(words) < 2 or _NEGATIONS.intersection(words):
        return False
    *first, last = words
    if last in _CLEAR:
        return last != "banner" or first[-1] not in _TITLED
    if last == "header" and first[-1] in _TITLED:
        return False
    return last in _NOT_ARTICLE and all(w in _PLACES or w in _NOT_ARTICLE for w in first)


def path_of(node: Node) -> str:
    """Labels from the root to a node."""
    labels = []
    while node.parent is not None:
        labels.append(node.label)
        node = node.parent
    return "/".join(reversed(labels))


class Folded:
    """A node of a folded tree: block elements only, like siblings in a row are one."""

    __slots__ = ("label", "children", "shape", "at")

    def __init__(self, label: str):
        self.label, self.shape, self.at = label, 0, 0
        self.children: list[Folded] = []


class Shapes(NamedTuple):
    """The different subtrees of a page, children before parents, the page last."""

    labels: list[str]
    children: list[list[int]]

    def sizes(self) -> list[int]:
        """Nodes of each subtree."""
        out: list[int] = []
        for below in self.children:
            out.append(1 + sum(out[c] for c in below))
        return out


def fold(root: Node) -> tuple[Shapes, dict[int, int]]:
    """The shape of a page and, by ``id`` of a block element, its number in page order in the folded tree."""
    top = Folded("#root")
    owner = {id(root): top}
    todo = [(root, top, True)]
    while todo:
        node, out, is_root = todo.pop()
        if not is_root and node.tag in BLOCK:
            if not out.children or out.children[-1].label != node.label:
                out.children.append(Folded(node.label))
            out = owner[id(node)] = out.children[-1]
        todo += [(child, out, False) for child in reversed(node.children) if isinstance(child, Node)]
    order, walk = [], [top]
    while walk:
        folded = walk.pop()
        order.append(folded)
        walk += folded.children
    known: dict[tuple, int] = {}
    for folded in reversed(order):
        folded.shape = known.setdefault((folded.label, *(c.shape for c in folded.children)), len(known))
    shapes = Shapes([k[0] for k in known], [list(k[1:]) for k in known])
    sizes = shapes.sizes()
    for folded in order:
        at = folded.at + 1
        for child in folded.children:
            child.at = at
            at += sizes[child.shape]
    return shapes, {key: folded.at for key, folded in owner.items()}


def match(a: Shapes, b: Shapes) -> tuple[dict, dict]:
    """Simple tree matching of all pairs of subtrees that can meet: the most pairs of nodes that two
    share in order, and the steps that lead there (one bit each for "skip in a" and "skip in b")."""
    last = (len(a.labels) - 1, len(b.labels) - 1)
    wanted = {last} if a.labels[-1] == b.labels[-1] else set()
    todo = list(wanted)
    while todo:
        x, y = todo.pop()
        alike = defaultdict(set)
        for d in b.children[y]:
            alike[b.labels[d]].add(d)
        for c in set(a.children[x]):
            fresh = {(c, d) for d in alike.get(a.labels[c], ())} - wanted
            wanted |= fresh
            todo += fresh
    score: dict[tuple[int, int], int] = {}
    steps: dict[tuple[int, int], list] = {}
    for x, y in sorted(wanted):  # children come before parents
        below, others = a.children[x], b.children[y]
        row, taken = np.zeros(len(others) + 1, np.int64), []
        weights: dict[int, np.ndarray] = {}
        for c in below if others else ():
            if c not in weights:
                weights[c] = np.array([score.get((c, d), 0) for d in others], np.int64)
            new = np.zeros_like(row)
            new[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights[c]))
            taken.append((np.packbits(new[1:] == row[1:]), np.packbits(new[1:] == new[:-1])))
            row = new
        score[x, y], steps[x, y] = int(row[-1]) + 1, taken
    return score, steps


def _bit(packed: np.ndarray, k: int) -> bool:
    return bool(packed[k >> 3] >> (7 - (k & 7)) & 1)


def aligned(a: Shapes, b: Shapes) -> Iterator[tuple[int, int]]:
    """The pairs of a best simple tree matching, as numbers of nodes in page order."""
    score, steps = match(a, b)
    if not score:
        return
    sizes_a, sizes_b = a.sizes(), b.sizes()
    todo = [(len(a.labels) - 1, len(b.labels) - 1, 0, 0)]
    while todo:
        x, y, at, of = todo.pop()
        yield at, of
        below, others, taken = a.children[x], b.children[y], steps[x, y]
        if not taken:
            continue
        starts = np.cumsum([at + 1, *(sizes_a[c] for c in below)])
        targets = np.cumsum([of + 1, *(sizes_b[d] for d in others)])
        i, j = len(below), len(others)
        while i and j:
            if _bit(taken[i - 1][0], j - 1):
                i -= 1
            elif _bit(taken[i - 1][1], j - 1):
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((below[i], others[j], int(starts[i]), int(targets[j])))


@lru_cache(maxsize=512)
def places(page: str, seed: str) -> dict[int, int]:
    """By number of a page's node the number of the seed's node that it is aligned with; shapes are JSON."""
    return dict(aligned(Shapes(*json.loads(page)), Shapes(*json.loads(seed))))


class Block(NamedTuple):
    """A block of a page: its text, whether it is plain (an unnamed paragraph, heading or the like),
    the path of its element and the number of that element in the folded tree."""

    line: str
    plain: bool
    path: str
    at: int


class Page(NamedTuple):
    """A page as the wrapper sees it; ``shape`` is JSON."""

    layout: int
    shape: str
    blocks: list[Block]


def number(*parts: str) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def read_page(page: str | None) -> Page:
    """Layout, shape and the blocks of a page that it does not mark as something else.

    If names leave nothing of a page, they are not asked.
    """
    root = parse(page)
    found = list(blocks(root, not_article)) or list(blocks(root, not_text))
    shapes, at = fold(root)
    paths: dict[int, str] = {}
    out = []
    for owner, line in found:
        if id(owner) not in paths:
            paths[id(owner)] = path_of(owner)
        out.append(Block(line, owner.tag in _PROSE and not owner.names, paths[id(owner)], at[id(owner)]))
    return Page(number(*sorted(_skeleton(root))), json.dumps(shapes, separators=(",", ":")), out)


def digest(page: Page) -> int:
    return number(*(b.line for b in page.blocks))


def node_numbers(host: str, layout: int, shape: str, seed: str, at: list[int], paths: list[int]) -> Iterator[tuple[int, int]]:
    """Per block the number of its node in the host and in the layout."""
    place = places(shape, seed)
    for k, path in zip(at, paths):
        known = ("node", str(place[k])) if k in place else ("path", str(path))
        yield number("host", host, str(path)), number("layout", host, str(layout), *known)


def _skeleton(root: Node) -> set[str]:
    """Paths of the block elements near the top of a page, other than plain text."""
    out, todo = set(), [(root, "", 0)]
    while todo:
        node, path, depth = todo.pop()
        for child in node.children:
            if isinstance(child, Node) and child.tag in BLOCK and (child.tag not in _TEXT or child.tag in ("html", "body", "main", "article")):
                below = f"{path}/{child.label}"
                out.add(below)
                if depth + 1 < LAYOUT_DEPTH:
                    todo.append((child, below, depth + 1))
    return out


def inside(path: str) -> bool:
    """Whether an article or main element is on a path."""
    return any(label.split(".", 1)[0] in ("article", "main") for label in path.split("/"))


def least(path: str) -> int:
    return LEAST_INSIDE if inside(path) else LEAST


def guarded(block: Block) -> bool:
    """Whether a block is text of the article however many pages share it."""
    return block.plain and inside(block.path)


def keys(page: Page, seeds: dict[int, str]) -> list[tuple[tuple[int, int], ...]]:
    """Per block and scope the numbers of the node and of the node with this text."""
    every = node_numbers("", page.layout, page.shape, seeds.get(page.layout, page.shape), [b.at for b in page.blocks], [number(b.path) for b in page.blocks])
    return [tuple((n, number(str(n), str(number(b.line)))) for n in both) for b, both in zip(page.blocks, every)]


def induce(pages: list[str]) -> dict:
    """The wrapper of the pages of a host in memory: ``seeds`` by layout, ``template`` (numbers of nodes
    with their text) and ``main``, the path of the deepest element that has most of the slots' text."""
    every = {digest(found): found for found in map(read_page, pages)}
    seeds: dict[int, str] = {}
    for found in map(read_page, pages):
        seeds[found.layout] = min(seeds.get(found.layout, found.shape), found.shape, key=lambda x: (len(x), x))
    on, with_text, need = Counter(), Counter(), {}
    for found in every.values():
        numbered = keys(found, seeds)
        on.update({p for k in numbered for p, _ in k})
        with_text.update({x for k in numbered for x in k})
        for b, k in zip(found.blocks, numbered):
            need.update({x: least(b.path) for x in k})
    template = {k[1] for k, n in with_text.items() if n >= need[k] and n >= TEMPLATE_SHARE * on[k[0]]}
    weight: Counter = Counter()
    for found in every.values():
        for b, k in zip(found.blocks, keys(found, seeds)):
            if not any(t in template for _, t in k):
                labels = b.path.split("/")
                weight.update({"/".join(labels[:k]): len(b.line) for k in range(len(labels) + 1)})
    deep = [p for p, w in weight.items() if p and w >= MAIN_SHARE * weight[""] and p.split("/")[-1].split(".")[0] in ("html", "body", "main", "article", "div", "section", "td", "table")]
    return {"main": max(deep, key=lambda p: (p.count("/"), p), default=""), "seeds": seeds, "template": template}


def slots(lines: list[str], plain: list[bool], guard: list[bool], fixed: list[bool]) -> str:
    """The slots of a page in page order, joined by empty lines.

    If a page marks no article and less than half of its plain text is slots, the plain blocks all
    stay: the page is then more likely a near copy of others than a page made of template.
    """
    all_plain = sum(len(x) for x, p in zip(lines, plain) if p)
    left = sum(len(x) for x, p, f in zip(lines, plain, fixed) if p and not f)
    copied = not any(guard) and 2 * left < all_plain
    return "\n\n".join(x for x, p, g, f in zip(lines, plain, guard, fixed) if not f or g or copied and p)


def main_text(page: str | None, wrapper: dict) -> str:
    """The main text of a page under a wrapper in memory."""
    found = read_page(page)
    template = wrapper["template"]
    fixed = [any(t in template for _, t in k) for k in keys(found, wrapper.get("seeds", {}))]
    return slots([b.line for b in found.blocks], [b.plain for b in found.blocks], [guarded(b) for b in found.blocks], fixed)


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, host, text`` for every row of ``pages``.

    Null and malformed urls share a host. A null or empty page has an empty text; so has one
    without text outside marked elements. Hosts with one page have a wrapper without template.
    Texts of any length are read whole. Of pages with the smallest tree of a layout, the first
    tree in the order of its text is the seed. Repeated rows each give a row and count as one page;
    other columns are not read; an empty table gives no rows.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.monotonically_increasing_id().alias("row"), F.col(html).cast("string").alias("html"))
    kind = rows.schema[0].dataType.simpleString()
    link = rows.schema[1].dataType.simpleString()
    parts = {"line": pa.string(), "plain": pa.bool_(), "guard": pa.bool_()}
    # What decides on the blocks that may be template; the others never are, and need no node.
    open_parts = {"pos": pa.int32(), "least": pa.int32(), "at": pa.int32(), "path": pa.int64(), "same": pa.int64()}

    def lists(found: list[list[tuple]], types: dict[str, pa.DataType]) -> list[pa.Array]:
        edges = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        columns = list(zip(*(x for page in found for x in page))) or [()] * len(types)
        return [pa.ListArray.from_arrays(edges, pa.array(c, t)) for c, t in zip(columns, types.values())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256):  # a batch of long pages stays small
                batch = whole.slice(a, 256)
                found = [read_page(page.as_py()) for page in batch.column(4)]
                every = lists([[(b.line, b.plain, guarded(b)) for b in p.blocks] for p in found], parts)
                open_ = lists([[(k, least(b.path), b.at, number(b.path), number(b.line)) for k, b in enumerate(p.blocks) if not guarded(b)] for p in found], open_parts)
                facts = [pa.array([p.layout for p in found], pa.int64()), pa.array([digest(p) for p in found], pa.int64()), pa.array([p.shape for p in found], pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), *facts, *every, *open_], ["page_id", "url", "host", "row", "layout", "digest", "shape", *parts, *open_parts])

    fields = "line array<string>, plain array<boolean>, guard array<boolean>, pos array<int>, least array<int>, at array<int>, path array<bigint>, same array<bigint>"
    parsed = cut_lineage(rows.mapInArrow(read, f"page_id {kind}, url {link}, host string, row bigint, layout bigint, digest bigint, shape string, {fields}"))
    undecided = F.size("pos") > 0
    seeds = parsed.groupBy("host", "layout").agg(F.min(F.struct(F.length("shape").alias("n"), "shape")).alias("s")).select("host", "layout", F.col("s.shape").alias("seed"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "pos", "digest", "least", "node", "t"]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())

        def columns(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, types)], names)

        for batch in batches:
            out: list[tuple] = []
            for k in range(batch.num_rows):
                row, host, layout, alike, shape, seed, pos, need, at, paths, same = (c[k].as_py() for c in batch.columns)
                for i, both in enumerate(node_numbers(host, layout, shape, seed, at, paths)):
                    out += [(row, pos[i], alike, need[i], n, number(str(n), str(same[i]))) for n in both]
                    if len(out) > 20_000:
                        yield columns(out)
                        out = []
            yield columns(out)

    wanted = parsed.filter(undecided).join(seeds, ["host", "layout"]).select("row", "host", "layout", "digest", "shape", "seed", "pos", "least", "at", "path", "same")
    placed = cut_lineage(wanted.mapInArrow(place, "row bigint, pos int, digest bigint, least int, node bigint, t bigint"))
    # Different pages by node, and by node and text; pages alike in all blocks are one.
    seen = placed.select("node", F.explode(F.array(F.lit(None).cast("bigint"), "t")).alias("t"), "least", "digest")
    seen = seen.groupBy("node", "t", "digest").agg(F.max(F.when(F.col("t").isNotNull(), F.col("least"))).alias("least"))
    support = cut_lineage(seen.groupBy("node", "t").agg(F.count("*").alias("n"), F.max("least").alias("least")).filter("t IS NULL OR n >= least"))
    on = support.filter("t IS NULL AND n > 1").select("node", F.col("n").alias("pages"))
    template = support.filter("t IS NOT NULL").join(on, "node").filter(F.col("n") >= TEMPLATE_SHARE * F.col("pages")).select("t")
    hits = placed.select("row", "pos", "t").join(cut_lineage(template), "t", "left_semi").groupBy("row").agg(F.collect_set("pos").alias("hits"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = []
            for lines, plain, guard, found in zip(*(batch.column(k) for k in range(3, 7))):
                fixed = frozenset(found.as_py() or ())
                lines = lines.as_py()
                text.append(slots(lines, plain.as_py(), guard.as_py(), [k in fixed for k in range(len(lines))]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(text, pa.string())], ["page_id", "url", "host", "text"])

    columns = ["page_id", "url", "host", "line", "plain", "guard"]
    decided = parsed.filter(~undecided).select(*columns, F.lit(None).cast("array<int>").alias("hits"))
    joined = parsed.filter(undecided).join(hits, "row", "left").select(*columns, "hits")
    return decided.unionByName(joined).mapInArrow(apply, f"page_id {kind}, url {link}, host string, text string")
