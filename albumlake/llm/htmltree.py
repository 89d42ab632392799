"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded from the root down.

The trees are trained on a bounded sample (SAMPLE_PAGES pages of any length, SAMPLE_NODES nodes spread over each), taught by the pages' own markup: nodes below
article or main are text; nodes outside them on a page that has one, and nodes below nav, header, footer, aside, forms
or elements named as advert, comment, menu, notice and the like are not; other nodes teach nothing. Decoding goes from the root: a node that the model rejects takes its whole subtree with
it, so an accepted node never hangs below a rejected one; text placed in the body itself counts only on a page without an
accepted article or main. Names of elements teach, but half of the examples hide them, so that the trees must do without.
Null and empty html give an empty text. Without trees (no pages, or nodes of one kind only) the markup rule itself decides.
Repeated rows get equal texts; extract_pages passes other columns on, its text replaces a column of that name.
"""

from __future__ import annotations

import html as ent
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quotas, stratified_sample, table

SAMPLE_PAGES, SAMPLE_NODES = 300, 400
# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style head title template noscript iframe svg math textarea select button form object canvas audio video".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var".split())
PARAGRAPH_ENDS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure figcaption details".split())
GOOD = re.compile(r"article|main|content|post|entry|story|body")
BAD = re.compile(r"\bad\b|ads|advert|banner|comment|cookie|consent|notice|menu|nav|footer|header|sidebar|widget|promo|share|social|related|subscribe|newsletter|popup|modal|breadcrumb|copyright|sponsor|disqus|reply|replies")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    attrs: str = ""
    depth: int = 0
    parent: Node | None = None
    place: int = 0
    children: list = field(default_factory=list)  # Node or str
    chars: int = 0
    link_chars: int = 0
    tags: int = 0
    elements: int = 0


def parse(html: str | None) -> Node:
    """A forgiving tree: unclosed elements end with their parents, raw text of script and style is dropped. A count of the
    open elements of each tag tells a close tag that matches nothing, so every step up leaves an element for good."""
    root = at = Node("root")
    opened: Counter[str] = Counter()

    def leave(node: Node) -> Node:
        below = at
        while below is not node.parent:
            opened[below.tag] -= 1
            below = below.parent
        return below

    src, pos = html or "", 0
    while pos < len(src):
        m = _TOKEN.match(src, pos)
        if m is None:  # an unfinished tag at the end of the page
            break
        pos = m.end()
        close, tag, attrs, text = m.groups()
        if text == "<" and re.match(r"/?[a-zA-Z]", src[pos : pos + 2]):  # a tag with an open quote, or none left to close it
            end = src.find(">", pos)
            pos = end + 1 if end >= 0 else len(src)
        elif text is not None:
            at.children.append(ent.unescape(text))
        elif tag is None:
            continue
        elif close:
            tag, node = tag.lower(), at
            if opened[tag] > 0:
                while node.tag != tag:
                    node = node.parent
                at = leave(node)
        else:
            tag = tag.lower()
            if tag in ("script", "style"):
                end = re.compile(f"</{tag}[^>]*>", re.I).search(src, pos)
                pos = end.end() if end else len(src)
                continue
            if tag in PARAGRAPH_ENDS or tag == "li":
                node = at
                while node.tag in INLINE and node.parent:
                    node = node.parent
                if node.tag == tag == "li" or node.tag == "p":
                    at = leave(node)
            names = " ".join(f"{a or b or c}" for k, a, b, c in _ATTR.findall(attrs) if k.lower() in ("id", "class", "role", "itemprop")).lower() if attrs else ""
            node = Node(tag, names, at.depth + 1, at, at.elements)
            at.elements += 1
            at.children.append(node)
            if tag not in VOID and not (attrs or "").rstrip().endswith("/"):
                at = node
                opened[tag] += 1
    return root


def measure(root: Node) -> list[Node]:
    """Nodes in page order, with subtree sums of characters, link characters and tags."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [c for c in reversed(n.children) if not isinstance(c, str)]
    for n in reversed(order):
        n.chars += sum(len(_SPACE.sub(" ", c).strip()) for c in n.children if isinstance(c, str))
        if n.tag == "a":
            n.link_chars = n.chars
        if n.parent:
            n.parent.chars += n.chars
            n.parent.link_chars += n.link_chars
            n.parent.tags += n.tags + 1
    return order


TAGS = ("article", "main", "nav", "header", "footer", "aside", "div", "section", "p", "ul", "li", "a", "h1", "table", "span", "form")


def sibling_counts(order: list[Node]) -> list[tuple[int, int]]:
    """Per node: element siblings (itself included), and those with its tag, both counted once per parent."""
    tags = {id(n): Counter(c.tag for c in n.children if not isinstance(c, str)) for n in order}
    total = {at: sum(c.values()) for at, c in tags.items()}
    return [(total[id(n.parent)], tags[id(n.parent)][n.tag]) if n.parent else (0, 0) for n in order]


def outside(order: list[Node]) -> list[bool]:
    """Per node: the page has an article or main, and the node is neither in nor above one."""
    lead = leading([n for n in order if n.tag in ("article", "main")])
    inside: dict[int, bool] = {}
    for n in order:
        inside[id(n)] = n.tag in ("article", "main") or bool(n.parent and inside[id(n.parent)])
    return [bool(lead) and not inside[id(n)] and id(n) not in lead for n in order]


#: The places of the features that read the names of elements.
NAMED = (10, 11, 12)


def features(n: Node, page_chars: int, siblings: tuple[int, int], out: bool) -> list[float]:
    up = n.parent
    return [
        out,
        n.chars, n.chars / max(n.tags + 1, 1), n.link_chars / max(n.chars, 1), n.chars / max(page_chars, 1), n.depth, n.tags,
        *siblings, n.place, bool(GOOD.search(n.attrs)), bool(BAD.search(n.attrs)), bool(up and BAD.search(up.attrs)),
        n.tag in INLINE, n.tag in SILENT, *(n.tag == t for t in TAGS), bool(up and up.tag == "article"), bool(up and up.tag == "body"),
    ]


def taught(order: list[Node]) -> list[int | None]:
    """1 text, 0 not text, None not known, from the page's own markup.

    On a page with a usable article or main, nodes outside it are not text; the elements that lead to it are taught as 1,
    for decoding must pass them, but hand nothing down. Elsewhere unnamed nodes are not known.
    """
    out: dict[int, int | None] = {}
    for n in order:
        above = out.get(id(n.parent)) if n.parent else None
        if n.tag in SILENT or n.tag in ("nav", "header", "footer", "aside") or BAD.search(n.attrs):
            out[id(n)] = 0
        elif above is not None:
            out[id(n)] = above
        else:
            out[id(n)] = 1 if n.tag in ("article", "main") else None
    lead = leading([n for n in order if out[id(n)] == 1 and n.tag in ("article", "main")])
    top = ("root", "html", "body")
    if lead:
        for n in order:
            if out[id(n)] is None and n.tag not in top:
                out[id(n)] = int(id(n) in lead)
    return [out[id(n)] for n in order]


def leading(nodes: list[Node]) -> set[int]:
    """ids of the nodes' ancestors."""
    lead: set[int] = set()
    for n in nodes:
        up = n.parent
        while up and id(up) not in lead:
            lead.add(id(up))
            up = up.parent
    return lead


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 16) -> dict:
    """Second-order boosting of the logistic loss; splits are searched over quantile bins."""
    base = float(np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3))) if len(y) else 0.0
    score, trees = np.full(len(y), base), []
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T] if len(y) else []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        for j, edges in enumerate(cuts if left and len(rows) > 10 else []):
            slot = np.searchsorted(edges, x[rows, j], "left")
            cg, ch = np.cumsum(np.bincount(slot, g[rows], len(edges) + 1)), np.cumsum(np.bincount(slot, h[rows], len(edges) + 1))
            gain = (cg**2 / (ch + 1) + (gs - cg) ** 2 / (hs - ch + 1) - gs**2 / (hs + 1))[:-1]
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), j, edges[gain.argmax()])
        if best[1] is None:
            return float(-rate * gs / (hs + 1))
        low = x[rows, best[1]] <= best[2]
        return (best[1], float(best[2]), grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1))

    for _ in range(rounds if len(y) and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(np.arange(len(y)), p - y, p * (1 - p), depth))
        score += tree_values(trees[-1], x)
    return {"base": base, "trees": trees}


def tree_values(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    j, cut, low, high = tree
    return np.where(x[:, j] <= cut, tree_values(low, x), tree_values(high, x))


def page_examples(html: str | None, nodes: int = SAMPLE_NODES) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a page's taught nodes, at most `nodes`: quotas() of each label, spread evenly over the page."""
    order = measure(parse(html))
    known = [(n, label, (s, o)) for n, label, s, o in zip(order, taught(order), sibling_counts(order), outside(order), strict=True) if label is not None and n.tag not in SILENT]
    if len(known) > nodes:
        kinds = [[k for k in known if k[1] == label] for label in (0, 1)]
        known = [k[i] for k, q in zip(kinds, quotas([len(k) for k in kinds], nodes), strict=True) for i in np.linspace(0, len(k) - 1, q).astype(int)]
    x = np.array([features(n, order[0].chars, *s) for n, _, s in known], np.float32).reshape(len(known), -1)
    if len(x):
        x[::2, NAMED] = 0
    return x, np.array([label for _, label, _ in known], np.float32)


def fit_extractor(pages: DataFrame) -> dict:
    """Pages of every length take part; their nodes' features are made on the executors, not the driver."""
    width = len(features(Node("p"), 1, (0, 0), False))

    def run(batches):
        for b in batches:
            made = [page_examples(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "x": [x.tobytes() for x, _ in made], "y": [y.tobytes() for _, y in made]})

    sample = stratified_sample(pages.select("page_id", "html").filter("html is not null"), "page_id", SAMPLE_PAGES)
    rows = sorted(sample.mapInPandas(run, "page_id long, x binary, y binary").collect(), key=lambda r: (r["page_id"], r["x"]))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(-1, width).astype(float)
    return fit_trees(x, np.frombuffer(b"".join(bytes(r["y"]) for r in rows), np.float32).astype(float))


def extract_all(htmls: list[str | None], model: dict) -> list[str]:
    """Texts of a few pages, whose nodes go through the trees together."""
    orders = [measure(parse(h)) for h in htmls]
    if not orders:
        return []
    x = np.array([features(n, o[0].chars, s, out) for o in orders for n, s, out in zip(o, sibling_counts(o), outside(o), strict=True)], float)
    if model["trees"]:
        score = model["base"] + sum(tree_values(t, x) for t in model["trees"])
    else:  # nothing was learned: the markup itself decides
        score = np.array([-1.0 if label == 0 else 0.0 for o in orders for label in taught(o)])
    ends = np.cumsum([len(o) for o in orders])
    return [decode(o, score[e - len(o) : e]) for o, e in zip(orders, ends, strict=True)]


def extract(html: str | None, model: dict) -> str:
    return extract_all([html], model)[0]


def decode(order: list[Node], score: np.ndarray) -> str:
    """Text of the accepted nodes, from the root down."""
    root = order[0]
    accepted = {id(n): n.tag not in SILENT and s >= 0 for n, s in zip(order, score, strict=True)}
    # Wrappers that lead to an accepted article or main carry no decision, nor do plain inline elements; elsewhere a
    # rejected node ends its subtree.
    lead = leading([n for n in order if n.tag in ("article", "main") and accepted[id(n)]])

    def passes(n: Node) -> bool:
        if n.tag in ("root", "html", "body", "br"):
            return True
        if n.tag in INLINE:
            return not n.attrs and all(isinstance(c, str) or c.tag in INLINE or c.tag in VOID for c in n.children)
        return id(n) in lead and n.tag not in ("nav", "header", "footer", "aside")

    keep = {id(n): n.tag not in SILENT and (accepted[id(n)] or passes(n)) for n in order}
    blocks, line = [], []

    def flush():
        text = _SPACE.sub(" ", "".join(line)).strip()
        if text:
            blocks.append(text)
        line.clear()

    todo: list = [root]
    while todo:
        n = todo.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            line.append(n)
        elif n.tag == "br":
            line.append(" ")
        elif keep[id(n)]:
            # Beside an accepted article, text in the body itself is not the page's own.
            inner = [c for c in reversed(n.children) if not (lead and n.tag in ("root", "html", "body") and isinstance(c, str))]
            if n.tag in INLINE:
                todo += inner
            else:
                flush()
                todo += [None, *inner]
        elif n.tag not in INLINE:
            flush()
    flush()
    return "\n".join(blocks)


def extract_pages(pages: DataFrame, model: dict) -> DataFrame:
    """pages plus text."""
    held = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def run(htmls: pd.Series) -> pd.Series:
        return pd.Series([t for lo in range(0, len(htmls), 32) for t in extract_all(list(htmls.iloc[lo : lo + 32]), held.value)], dtype=object)

    return pages.withColumn("text", run("html"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    made = extract_pages(pages, fit_extractor(pages))
    return made.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
