"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html as markup
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from ._arrays import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose text is never part of an article.
HARD = frozenset("head script style noscript template title nav footer aside form button select textarea iframe object svg canvas dialog menu map audio video noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input".split())
CLOSES = {  # an open element (value) ends where one of these begins
    **dict.fromkeys("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(), ("p",)),
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"),
}
SCOPE = frozenset("ul ol dl table body html article section div blockquote td th".split())  # implied ends do not reach beyond these
#: Words in class, id or role that name page furniture.
FURNITURE = frozenset((
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo complementary cookie cookies copyright disqus dialog discussion feedback footer form gdpr "
    "header masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup social "
    "sponsor sponsored subscribe subscription toolbar widget widgets alert").split())
OWN = frozenset("article entry post story content headline title".split())  # beside header, footer: parts of the article itself
BODY = re.compile(r"<(?:article|main)[\s>]", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?P<end>>|\Z)|</[^A-Za-z>][^>]*>|</>", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
RADIUS = 2


class Node:
    __slots__ = ("name", "parent", "path", "out", "soft", "number", "key")

    def __init__(self, name, parent, attrs, number):
        a = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in ATTR.finditer(attrs)} if attrs.strip(" /") else {}
        words = set(re.split(r"[^a-z0-9]+", " ".join(a.get(k, "") for k in ("class", "id", "role")).lower()))
        inline = name in INLINE
        self.name, self.parent, self.number = name, parent, number
        self.key = name + ("." + a["class"] if a.get("class") else "")
        self.path = (parent.path if parent else "") + ("" if inline else "/" + self.key)
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")) is not None
        # A header inside an article carries its heading; elsewhere it is the page's.
        page_header = name == "header" and not any(x.name in ("article", "main") for x in _up(parent))
        self.out = name in HARD or hidden or page_header or bool(parent and parent.out)
        self.soft = bool(words & FURNITURE - ({"header", "banner"} if words & OWN else set()))


def _up(node):
    while node is not None:
        yield node
        node = node.parent


class Block:
    __slots__ = ("node", "text", "linked", "marks")

    def __init__(self, node, text, linked):
        self.node, self.text, self.linked = node, text, linked
        self.marks = len(PUNCTUATION.findall(text))


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order: runs of text between block-level tags with their element, references decoded and white space collapsed."""
    count, node, found = 0, Node("", None, "", 0), []
    parts: list[tuple[str, Node]] = []
    start = node

    def flush():
        kept = [(t, n) for t, n in parts if not n.out and not any(x.soft for x in _up(n) if x.name in INLINE)]
        text = " ".join("".join(t for t, _ in kept).split())
        if text:
            linked = len(" ".join("".join(t for t, n in kept if any(x.name == "a" for x in _up(n))).split()))
            found.append(Block(next(x for x in _up(start) if x.name not in INLINE), text, min(linked, len(text))))
        parts.clear()

    def add(text):
        if text:
            parts.append((text, node))

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            add(markup.unescape(page[at:]))
            break
        if m.start() > at:
            add(markup.unescape(page[at:m.start()]))
        at = max(m.end(), m.start() + 1)
        if m["cdata"] is not None:
            add(m["cdata"])
        if not m["name"] or m["end"] != ">":
            continue
        name = m["name"].lower()
        if m["close"]:
            holder = next((x for x in _up(node) if x.name == name), None)
            if holder is None or holder.parent is None:
                continue
            if name in INLINE and any(x.name not in INLINE for x in _between(node, holder)):
                continue  # an inline end tag does not end the blocks inside
            if name not in INLINE:
                flush()
            node = holder.parent
            start = node if name not in INLINE else start
            continue
        if name == "br" or name == "img" or name == "wbr":
            add(" " if name == "br" else "")
            continue
        if name not in INLINE:
            flush()
            for x in _up(node):
                if x.name in CLOSES.get(name, ()):
                    node = x.parent
                    break
                if x.name in SCOPE or x.parent is None:
                    break
            start = node
        if name in VOID:
            continue
        count += 1
        new = Node(name, node, m["attrs"], count)
        if name in RAW:
            stop = re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else size
            continue
        node = new
        if name not in INLINE:
            start = node
    flush()
    return found


def _between(low, high):
    while low is not high:
        yield low
        low = low.parent


def path_ratios(blocks: list[Block]) -> dict[str, float]:
    """Fused ratio of each tag path: mean text length times mean punctuation, less what is link text."""
    length, marks, linked, n = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for b in blocks:
        p = b.node.path
        length[p] += len(b.text)
        marks[p] += b.marks
        linked[p] += b.linked
        n[p] += 1
    return {p: length[p] / n[p] * (marks[p] / n[p] + 0.1) * (1 - linked[p] / length[p]) for p in n}


def content_blocks(blocks: list[Block]) -> list[Block]:
    """Blocks of the article: threshold the smoothed path ratios, find the element that holds the selected text, and take its blocks without furniture."""
    named = [b for b in blocks if any(x.name in ("article", "main") for x in _up(b.node))]
    pool = named or blocks
    total = sum(len(b.text) for b in pool)
    inside: dict[int, int] = defaultdict(int)
    for b in pool:
        for x in _up(b.node):
            inside[x.number] += len(b.text)
    furniture = lambda b: any(x.soft and x.name not in ("html", "body", "main") and 2 * inside[x.number] < total for x in _up(b.node))
    pool = [b for b in pool if not furniture(b)]
    if not pool:
        return []
    ratio = path_ratios(pool)
    raw = [math.log1p(ratio[b.node.path]) for b in pool]
    kernel = [math.exp(-(k * k) / 2) for k in range(-RADIUS, RADIUS + 1)]
    smooth = []
    for i in range(len(raw)):
        near = [(raw[i + k], kernel[k + RADIUS]) for k in range(-RADIUS, RADIUS + 1) if 0 <= i + k < len(raw)]
        smooth.append(sum(v * w for v, w in near) / sum(w for _, w in near))
    middle = sum(smooth) / len(smooth)
    spread = math.sqrt(sum((s - middle) ** 2 for s in smooth) / len(smooth))
    floor = max(raw) / 2 if spread > 0 else 0.0
    chosen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for b, s in zip(pool, smooth):
        chosen[b.node.path][s >= min(floor, middle + spread)] += 1
    paths = {p for p, (no, yes) in chosen.items() if yes >= no}
    weight: dict[int, int] = defaultdict(int)
    nodes = {}
    for b in pool:
        if b.node.path in paths:
            for x in _up(b.node):
                weight[x.number] += len(b.text)
                nodes[x.number] = x
    picked = sum(len(b.text) for b in pool if b.node.path in paths)
    holder = max((x for k, x in nodes.items() if 10 * weight[k] >= 9 * picked), key=lambda x: x.number, default=None)
    while holder is not None and holder.name in ("p", "li", "td", "tr", "tbody", "ul", "ol", "blockquote", "dd", "dt") and holder.parent is not None:
        holder = holder.parent  # a single long paragraph stands for the element around it
    article = next((x for x in _up(holder) if x.name in ("article", "main")), holder)
    links = defaultdict(lambda: [0, 0])
    for b in pool:
        links[b.node.path][0] += b.linked
        links[b.node.path][1] += len(b.text)
    menu = lambda b: b.node.name == "li" and 5 * links[b.node.path][0] >= 4 * links[b.node.path][1]
    return [b for b in pool if any(x is article for x in _up(b.node)) and not menu(b)]


def extract(page: str | None) -> str:
    """Main text of one page: blocks joined by line feeds; empty for null, empty or article-less pages."""
    if not page:
        return ""
    blocks = blocks_of(page)
    if BODY.search(page) and not any(x.name in ("article", "main") for b in blocks for x in _up(b.node)):
        return ""  # the article is there and empty
    return "\n".join(b.text for b in content_blocks(blocks))


def main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """All columns of `pages` but the html, with the main text of every whole page as `text` (own columns text and n_chars are replaced) and its code points.

    A null or empty page has an empty text; repeated rows come out repeated. No shuffle; memory is one page and its blocks.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    keep = [c for c in pages.columns if c not in (column, "text", "n_chars")]
    source = pages.select(*keep, column)
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, column):
            texts = [extract(h) for h in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(b.columns[:-1], arrow)), pa.array(texts, pa.string()).cast(arrow[-2].type), pa.array([len(t) for t in texts], pa.int64())], schema=arrow)

    return source.mapInArrow(run, schema)


def op2_html_extraction(spark, folder: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html"))
