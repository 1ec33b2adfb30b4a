"""Main text of web pages by a site style tree (operator 8).

The pages of a host are merged into a tree of element nodes (their path of tags and classes; elements
more than ``DEPTH`` levels down belong to their ancestor there). A node that m distinct pages have is
weighed by two entropies to the base m: of its presentation (the sequences of child elements that the
pages show below it) and of its content (for each distinct block of text below it, over the pages that
show it). As in a site style tree, with l presentations, the pages say

    shown = (1 - GAMMA^l) * presentation + GAMMA^l * (1 - mean entropy of the content)

so what all pages repeat alike is worth nothing and what each page has for itself is worth one. What the
markup says of an element joins in: its importance is w * markup + (1 - w) * shown. For furniture (menus,
footers, adverts and so on by element, role or name) markup is 0 and w at least ``SAID``; for article and
main elements it is 1 and w at least ``SAID``; for all others it is 1 and w falls with the pages as
``PRIOR`` / (``PRIOR`` + m - 1), so that few pages prove little. Branches under ``LEAST`` go, on every page.
If a page has text in an article or main element, only what is in there counts; should all go, the branches
that the markup does not call furniture stay.

Defined results: a null or empty html has an empty text; a page without url or alone on its host is its own
tree; repeated rows stay, a row each, and pages with the same html count once in the tree, so that copies
prove nothing; ties (an importance right at the limit) stay; pages of any length and depth are read whole;
an empty table gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html as entities

import re
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .storage import materialise

GAMMA, LEAST, SAID, PRIOR, DEPTH = 0.9, 0.3, 0.75, 3.0, 64
#: Removed branches that may be broadcast (8 bytes each); more are joined to the branches of each page.
BROADCAST_ROWS = 500_000

#: Fixed values of HTML: elements without content, those that hold no markup, those inside a line.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An element that opens closes these where they stand open, up to the nearest of the third group.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Page furniture by element, by role, and by the words of its class or id.
FURNITURE = set("nav footer aside form script style noscript template iframe svg canvas button select option input textarea dialog menu head title object audio video".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs masthead topbar "
    "footer cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login comment comments disqus reply replies respond "
    "share sharing social related recommended recommendations widget toolbar pagination pager skip hidden".split()
)
MAIN = {"article", "main"}
#: Names that mean the head of the page, unless they stand in an article or beside one of the others.
HEADS = {"header", "head", "heading"}
OF_ARTICLE = set("article post entry story content headline title blog news".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'<>]+)")
NAME_PART = re.compile(r"[A-Z]?[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element. ``id`` hashes its path, ``inside`` tells whether it lies in an article or main element."""

    __slots__ = ("tag", "id", "depth", "parent", "kind", "children", "inside")

    def __init__(self, tag: str, step: str, parent: "Node | None", kind: str):
        self.tag, self.parent, self.kind, self.children = tag, parent, kind, []
        self.depth = parent.depth + 1 if parent else 0
        self.inside = kind == "main" or parent is not None and parent.inside
        self.id = xxhash.xxh64_intdigest(step, parent.id) if parent and self.depth <= DEPTH else parent.id if parent else 0


_kinds: dict[tuple[str, str], tuple[str, str]] = {}


def _known(tag: str, attributes: str) -> tuple[str, str]:
    """Step of a path and kind (furniture, head, main or plain) of an element."""
    if (found := _kinds.get((tag, attributes))) is not None:
        return found
    given = {(m[1] or m[5]).lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    names = [re.sub(r"\d+", "0", x) for x in given.get("class", "").split()]
    words = {w.lower() for x in (given.get("class", ""), given.get("id", "")) for w in NAME_PART.findall(x)}
    words |= {w for x in (given.get("class", ""), given.get("id", "")) for w in re.split(r"[^a-z0-9]+", x.lower())}
    roles = set(given.get("role", "").lower().split())
    furniture = tag in FURNITURE or roles & ROLES or (words & NAMES and tag not in ("html", "body")) or "hidden" in given or given.get("aria-hidden") == "true" or HIDDEN.search(given.get("style", ""))
    head = tag == "header" or words & HEADS and not words & OF_ARTICLE and tag not in ("html", "body", "th", "thead", "h1", "h2", "h3", "h4", "h5", "h6")
    kind = "furniture" if furniture else "main" if tag in MAIN or "main" in roles else "head" if head else "plain"
    out = (".".join([tag, *sorted(names)]), kind)
    if len(_kinds) < 20_000:
        _kinds[tag, attributes] = out
    return out


def parse(html: str) -> Node:
    """The block elements of a page, with the pieces of text of each between its children. Inline elements are text."""
    root = Node("", "", None, "plain")
    at, pos, inline = root, 0, []
    for m in TAG.finditer(html):
        if m.start() < pos:
            continue  # inside raw text
        if m.start() > pos and not inline:
            at.children.append(html[pos : m.start()])
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in INLINE:
                if inline and tag == inline[-1]:
                    inline.pop()
                continue
            inline.clear()
            up = at
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                at = up.parent
            continue
        if tag in INLINE:
            if tag == "br":
                if not inline:
                    at.children.append(" ")
            elif tag not in VOID and not m[3].rstrip().endswith("/") and (inline or m[3] and _known(tag, m[3])[1] == "furniture"):
                inline.append(tag)  # text of an inline piece of furniture is passed over up to its end
            continue
        inline.clear()
        if tag in CLOSES:
            closed, stop = CLOSES[tag]
            up = at
            while up is not root and up.tag not in stop and up.tag not in closed:
                up = up.parent
            while up is not root and up.tag in closed:
                at = up.parent
                up = at
        else:
            up = at
            if up.tag == "p":
                at = up.parent
        step, kind = _known(tag, m[3])
        if kind == "head":  # of the page; that of an article goes with it
            kind = "plain" if at.inside else "furniture"
        node = Node(tag, f"{step}!" if kind == "furniture" else step, at, kind)
        at.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, pos)
            pos = end.end() if end else len(html)
        elif tag not in VOID and not (m[3].endswith("/") and tag in ("svg", "path")):
            at = node
    if pos < len(html) and not inline:
        at.children.append(html[pos:])
    return root


def blocks(root: Node) -> Iterator[tuple[Node, str]]:
    """Blocks of text of a page in its order, each with the element that holds it; scripts and styles have none."""
    at, todo, held = root, [(root, iter(root.children))], []
    while todo:
        at, rest = todo[-1]
        child = next(rest, None)
        if isinstance(child, str):
            held.append(child)
            continue
        if held:
            text = "".join(held)
            if "&" in text:
                text = entities.unescape(text)
            if text := " ".join(text.split()):
                yield at, text
            held = []
        if child is None:
            todo.pop()
        else:
            todo.append((child, iter(child.children)))


def host_of(url: str | None) -> str | None:
    try:
        return urlsplit(url or "").hostname or None
    except ValueError:
        return None


def _digest(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed) - (1 << 63)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _node_id(host: str, node: int) -> int:
    return _digest(host, node)


#: Kinds of nodes as numbers, what their markup says, and the least weight of that.
KINDS = {"plain": (0, 1.0, 0.0), "main": (1, 1.0, SAID), "furniture": (2, 0.0, SAID)}


def _shown(root: Node) -> dict[int, tuple[str, set[str], set[str]]]:
    """For each path of a page: its kind, the presentations and the texts below it. Furniture is a leaf."""
    out: dict[int, tuple[str, set[str], set[str]]] = {}
    todo = [root]
    while todo:
        node = todo.pop()
        below = [] if node.kind == "furniture" else [c for c in node.children if isinstance(c, Node)]
        steps = [c.id for i, c in enumerate(below) if not i or below[i - 1].id != c.id]
        if node.tag and node.tag not in ("html", "body"):
            out.setdefault(node.id, (node.kind, set(), set()))[1].add(" ".join(map(str, steps)))
        todo += below
    for node, text in blocks(root):
        lowest = node
        while lowest is not None:  # what stands in furniture is told by the furniture alone
            if lowest.kind == "furniture":
                node = None
            lowest = lowest.parent
        while node is not None:
            if node.id in out:
                out[node.id][2].add(text)
            up = node.parent
            while up is not None and up.id == node.id:  # elements far down are one node
                up = up.parent
            node = up
    return out


def evidence(pages: DataFrame) -> DataFrame:
    """node, kind, content (false: presentation) and feature, once for each distinct page that shows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, bool, int, int]] = []
            for url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if not html or not (host := host_of(url)):
                    continue
                own = _digest(html)
                for path, (kind, styles, texts) in _shown(parse(html)).items():
                    node, number = _node_id(host, path), KINDS[kind][0]
                    out.append((node, number, False, _digest("\n".join(sorted(styles))), own))
                    out += [(node, number, True, _digest(x), own) for x in texts]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int8(), pa.bool_(), pa.int64(), pa.int64()))], names=["node", "kind", "content", "feature", "page"])

    rows = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "node long, kind tinyint, content boolean, feature long, page long")
    return rows.distinct().drop("page")


def importance(rows: DataFrame) -> DataFrame:
    """node, pages and importance of every element node of every host."""
    counts = rows.groupBy("node", "content", "feature").agg(F.count("*").alias("k"), F.max("kind").alias("kind"))
    of = lambda content, x: F.sum(F.when(F.col("content") == content, x))
    log = F.log("k")
    nodes = counts.groupBy("node").agg(
        of(False, F.col("k")).alias("pages"), of(False, F.lit(1)).alias("styles"), of(False, F.col("k") * log).alias("style_log"),
        F.coalesce(of(True, F.lit(1)), F.lit(0)).alias("texts"), F.coalesce(of(True, log), F.lit(0.0)).alias("text_log"), F.max("kind").alias("kind"),
    )
    m = F.log(F.col("pages").cast("double"))
    shown = (m - F.col("style_log") / F.col("pages")) / m
    content = 1 - F.when(F.col("texts") > 0, F.col("text_log") / F.col("texts") / m).otherwise(1.0)
    left = F.pow(F.lit(GAMMA), F.col("styles"))
    told = F.when(F.col("pages") > 1, (1 - left) * shown + left * content).otherwise(1.0)
    said, least = (F.element_at(F.array(*(F.lit(x[i]) for x in KINDS.values())), F.col("kind") + 1) for i in (1, 2))
    w = F.greatest(least, PRIOR / (PRIOR + F.col("pages") - 1))
    return nodes.select("node", "pages", (w * said + (1 - w) * told).alias("importance"))


def alone(node: Node) -> bool:
    """The verdict of a tree of one page: what the markup says."""
    return node.kind == "furniture"


def main_text(html: str, removed: Callable[[Node], bool] = alone) -> str:
    """The text of a page. ``removed`` tells the nodes that its host's tree does without."""
    gone: dict[Node, bool] = {}

    def out(node: Node) -> bool:
        """Whether a node or one that it lies in is removed."""
        chain = []
        while node is not None and node.parent is not None and node not in gone:
            chain.append(node)
            node = node.parent
        known = node is not None and gone.get(node, False)
        for x in reversed(chain):
            gone[x] = known = known or removed(x)
        return known

    def furniture(node: Node) -> bool:
        while node is not None and node.kind != "furniture":
            node = node.parent
        return node is not None

    root = parse(html)
    kept = [(node, text) for node, text in blocks(root) if not out(node)]
    if own := [text for node, text in kept if node.inside]:
        return "\n".join(own)
    unmarked = [(node, text) for node, text in blocks(root) if not furniture(node)]
    if own := [text for node, text in unmarked if node.inside]:
        return "\n".join(own)
    return "\n".join(text for _, text in kept or unmarked)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    spark = pages.sparkSession
    low = materialise(importance(evidence(pages)).where(F.col("importance") < LEAST).select("node"), "low-branches")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    if low.count() <= BROADCAST_ROWS:
        nodes, beside = spark.sparkContext.broadcast(frozenset(r.node for r in low.collect())), False
    else:  # too many to hand to every task: each page takes the low ones of its own branches
        ids = rows.mapInArrow(_branches, "url string, page long, node long").join(low, "node", "left_semi").groupBy("url", "page").agg(F.collect_set("node").alias("low"))
        rows = rows.withColumn("page", F.xxhash64("html")).join(ids, ["url", "page"], "left").select("page_id", "url", "html", "low")
        nodes, beside = None, True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for url, html, *own in zip(*(c.to_pylist() for c in batch.columns[1:])):
                host = host_of(url)
                known = frozenset(own[0] or ()) if beside else nodes.value
                texts.append(main_text(html, alone if host is None else lambda node: _node_id(host, node.id) in known) if html else "")
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each element node of each page (by url and hash of the html)."""
    for batch in batches:
        out = []
        for url, html in zip(*(c.to_pylist() for c in batch.columns[1:])):
            if html and (host := host_of(url)):
                own = _signed(xxhash.xxh64_intdigest(html.encode("utf-8", "surrogatepass"), 42))  # as Spark's xxhash64
                out += [(url, own, _node_id(host, path)) for path in _shown(parse(html))]
        columns = list(zip(*out)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["url", "page", "node"])
