"""Main text of web pages by site style trees.

The pages of one host are merged into a style tree: a node is a path of block elements with their class names.  Content
importance of a node: one minus the mean entropy of its distinct texts over the m pages that have it, ln(k)/ln(m) for a text on k pages; texts
on every page carry nothing.  Equal pages count once, on a host and over all hosts, so that copies do not look like boilerplate.  Presentation importance: the entropy of the child sequences below it.  The composite of a
node takes in the contents of the leaves beneath it.  A host with few pages leans on the same path over all hosts.  Branches
below the threshold are removed from every page of the host.

The tree is built from whole pages.  What markup says outright holds as well: navigation, footers, asides, forms, scripts and the like, and class names or roles of adverts,
menus, notices or comments mark noise; if a page has article (else main) elements with text, only they can hold the main text; they
themselves and an article's own paragraphs and headings are never removed by the tree, so mirrored articles stay whole.

Defined cases: NULL and empty pages give an empty text; broken markup is read as browsers do in the main (implied ends of p, li, dd
and table cells, unknown end tags ignored, an unfinished tag at the end dropped); a URL without a host shares the empty host; repeated
pages count once in the tree and each gets its text; an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorate.llm.common import BROADCAST_ROWS, stored, with_arrays

THRESHOLD = 0.5
PRESENTATION = 0.2  # weight of presentation in the composite importance
LEAN = 20.0  # pages that the path over all hosts counts for

# Fixed values of HTML: elements by their role in a page.
BLOCKS = set("html body article main section div header footer nav aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary fieldset legend hr menu dialog".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
NOISE_TAGS = set("nav footer aside form head script style title textarea noscript template iframe object svg math button select option dialog canvas audio video map menu noembed noframes xmp".split())
CLOSES_P = BLOCKS - {"html", "body", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "li", "dt", "dd"} | {"li", "dt", "dd"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
NOISE_WORDS = set("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation footer breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments disqus reply replies widget toolbar pagination pager".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
KEPT = {"html", "body", "article", "main"}
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre".split())  # inside an article the tree removes other blocks only

REST = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))|\b(hidden)\b""")
HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
RAW_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
WORDS = re.compile(r"[a-z]+")


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m.group(1).lower() if m else ""


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", s, ""), ("open", tag, attributes) and ("close", tag, "") in page order, in linear time."""
    at, n, plain = 0, len(page), False
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        m = NAME.match(page, lt + 1)
        if not m:
            if page[lt + 1:lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                yield "text", "<", ""
                at = lt + 1
            continue
        r = None if plain else REST.match(page, m.end())
        if r:
            end = r.end()
        else:
            plain = True  # an unclosed quotation mark: from here on a tag ends at the next sign
            end = page.find(">", m.end()) + 1
            if end == 0:
                return
        name = m.group().lower()
        if name[0] == "/":
            yield "close", name[1:], ""
        else:
            yield "open", name, page[m.end():end - 1]
            if name in RAW:
                e = RAW_ENDS[name].search(page, end)
                yield "close", name, ""
                end = e.start() if e else n
        at = end


class Node:
    __slots__ = ("tag", "path", "gone", "zone", "children", "texts")

    def __init__(self, tag: str, path: int, gone: bool, zone: int):
        self.tag, self.path, self.gone, self.zone, self.children, self.texts = tag, path, gone, zone, [], []


def _marks(tag: str, attributes: str, zone: int) -> tuple[bool, str]:
    """Whether an element is noise by its markup, and its class names."""
    if tag in NOISE_TAGS or (tag == "header" and not zone):
        return True, ""
    if not attributes.strip():
        return False, ""
    classes, noise = "", False
    for name, a, b, c, hidden in ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        name = name.lower()
        if hidden or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            noise = True
        elif name in ("class", "id"):
            words = set(WORDS.findall(value))
            noise |= tag not in ("html", "body", "article", "main") and bool(words & NOISE_WORDS) or (not zone and tag not in ("html", "body") and bool(words & {"header", "masthead"}))
            noise |= tag == "article" and bool(words & {"comment", "comments", "reply", "related", "ad", "advert", "sponsored"})
            if name == "class":
                classes = " ".join(sorted(WORDS.findall(value)))
        elif name == "role":
            noise |= value in NOISE_ROLES
    return noise, classes


def read(page: str | None, host: int = 0, removed: np.ndarray | None = None, visit=None) -> str:
    """Main text of one page.  ``removed`` holds sorted keys of removed branches; ``visit(node)`` sees every closed block."""
    root = Node("", host & (2**64 - 1), False, 0)
    stack, depth, open_ = [root], 0, Counter()
    zones: list[list[str]] = [[], [], []]

    def close() -> None:
        node = stack.pop()
        open_[node.tag] -= 1
        if node.tag in BLOCKS:
            for z in zones:
                z.append(" ")
            if visit:
                visit(node, stack)

    for kind, value, attributes in tokens(page or ""):
        top = stack[-1]
        if kind == "text":
            if top.gone and (not visit or top.tag in RAW):
                continue
            s = html.unescape(value) if "&" in value else value
            if not top.gone:
                zones[top.zone].append(s)
            if visit and not s.isspace():
                next(n for n in reversed(stack) if n.tag in BLOCKS or n is root).texts.append(s)
        elif kind == "open":
            if value == "br" or value == "hr":
                zones[top.zone].append(" ")
            if value in VOID:
                continue
            if value in CLOSES_P and open_["p"]:
                k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p"), 0)
                if not any(n.tag in ("table", "article", "section", "div", "aside", "nav", "td", "th", "li") for n in stack[k + 1:]):
                    while len(stack) > k:
                        close()
            if value in SIBLINGS:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in LIMITS[value]:
                        break
                    if stack[i].tag in SIBLINGS[value]:
                        while len(stack) > i:
                            close()
                        break
            top = stack[-1]
            noise, classes = _marks(value, attributes, top.zone)
            zone = 2 if value == "article" else max(top.zone, 1 if value == "main" else 0)
            path = top.path
            if value in BLOCKS:
                path = xxhash.xxh3_64_intdigest(f"{value}.{classes}", seed=path)
                for z in zones:
                    z.append(" ")
                top.children.append(value)
            gone = top.gone or noise
            if not gone and removed is not None and value in BLOCKS and value not in KEPT and not (zone == 2 and value in PROSE) and len(removed):
                key = np.int64(path if path < 2**63 else path - 2**64)
                i = np.searchsorted(removed, key)
                gone = i < len(removed) and removed[i] == key
            stack.append(Node(value, path, bool(gone), zone))
            open_[value] += 1
        elif open_[value]:
            while stack[-1].tag != value:
                close()
            close()
    while len(stack) > 1:
        close()
    for z in (2, 1):
        text = " ".join("".join(zones[z]).split())
        if text:
            return text
    return " ".join("".join(zones[0]).split())


def _signed(x: int) -> int:
    return x if x < 2**63 else x - 2**64


def weighted(pages: DataFrame, url: str, page: str) -> DataFrame:
    """(url, page, on_host, on_all): each page with one over the number of its copies, so that equal pages add up to one."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), HOST.pattern, 1))
    rows = pages.select(F.col(url).alias("u"), F.col(page).alias("h"), host.alias("host"), F.md5(F.coalesce(F.col(page), F.lit("")).cast("binary")).alias("mark"))
    own = rows.groupBy("host", "mark").agg(F.count(F.lit(1)).alias("c"))
    own = stored(own.join(own.groupBy("mark").agg(F.sum("c").alias("a")).filter("a > 1"), "mark"))
    count = own.count()
    rows = rows.join(F.broadcast(own) if count <= BROADCAST_ROWS else own, ["host", "mark"], "left")
    return rows.select("u", "h", *[(F.lit(1.0) / F.coalesce(c, F.lit(1))).alias(name) for c, name in (("c", "on_host"), ("a", "on_all"))])


def style_counts(pages: DataFrame, url: str, page: str) -> DataFrame:
    """(kind, host, path, item, n, a): distinct pages (of the host in n, a share of those of all hosts in a) by node (0), by node and text (1), by node and child sequence (2), tree edges (3: item is an ancestor)."""
    def run(batches):
        for b in batches:
            counts: dict[tuple, list[float]] = {}
            for u, h, on_host, on_all in zip(*[b.column(k).to_pylist() for k in range(4)]):
                host = _signed(xxhash.xxh3_64_intdigest(host_of(u)))
                seen = set()

                def visit(node: Node, stack: list[Node]) -> None:
                    path = _signed(node.path)
                    seen.add((0, path, 0))
                    if node.children:
                        seen.add((2, path, _signed(xxhash.xxh3_64_intdigest(" ".join(dict.fromkeys(node.children))))))
                    if node.texts:
                        seen.add((1, path, _signed(xxhash.xxh3_64_intdigest(" ".join("".join(node.texts).split())))))
                        for up in [node, *stack]:
                            if up.tag in BLOCKS:
                                seen.add((3, path, _signed(up.path)))

                read(h, 0, None, visit)
                for k, p, i in seen:
                    n = counts.setdefault((k, host, p, i), [0.0, 0.0])
                    n[0] += on_host
                    n[1] += on_all
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int8()), *[pa.array([k[j] for k in keys], pa.int64()) for j in (1, 2, 3)], *[pa.array([counts[k][j] for k in keys], pa.float64()) for j in (0, 1)]],
                                             names=["kind", "host", "path", "item", "n", "a"])

    rows = weighted(pages, url, page).mapInArrow(run, "kind byte, host long, path long, item long, n double, a double")
    return stored(rows.groupBy("kind", "host", "path", "item").agg(F.round(F.sum("n")).cast("long").alias("n"), F.sum("a").alias("a")))


def importance(counts: DataFrame, by: list[str]) -> DataFrame:
    """(*by, m, imp): composite importance of every node, by host and path or by path alone."""
    n = F.sum("n") if "host" in by else F.round(F.sum("a")).cast("long")
    rows = counts.groupBy("kind", *[c for c in by if c != "path"], "path", "item").agg(n.alias("n"))
    nodes = rows.filter("kind = 0").select(*by, F.col("n").alias("m"))
    texts = rows.filter("kind = 1").groupBy(*by).agg(F.count(F.lit(1)).alias("l"), F.sum(F.log("n")).alias("s"))
    leaf = texts.join(nodes, by).withColumn("c", F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("l") * F.log("m"))).otherwise(1.0))
    edges = rows.filter("kind = 3").select(*by, F.col("item").alias("up"))
    inner = (leaf.join(edges, by).withColumn("w", F.col("l").cast("double")).groupBy(*[c for c in by if c != "path"], F.col("up").alias("path"))
             .agg((F.sum(F.col("c") * F.col("w")) / F.sum("w")).alias("content")))
    parts = rows.filter("kind = 2").groupBy(*by).agg(F.sum("n").alias("k"), F.sum(F.col("n") * F.log("n")).alias("kk"))
    shape = parts.select(*by, F.when(F.col("k") > 1, (F.log("k") - F.col("kk") / F.col("k")) / F.log("k")).otherwise(1.0).alias("shape"))
    return (nodes.join(inner, by, "left").join(shape, by, "left")
            .select(*by, "m", (F.coalesce("content", F.lit(1.0)) * (1 - PRESENTATION) + F.coalesce("shape", "content", F.lit(1.0)) * PRESENTATION).alias("imp")))


def noise_branches(pages: DataFrame, url: str = "url", page: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """(host, path) of the branches to remove; host is a hash of the host name."""
    counts = style_counts(pages, url, page)
    own = importance(counts, ["host", "path"])
    whole = importance(counts, ["path"]).select("path", F.col("imp").alias("pooled"))
    lean = (F.col("m") * F.col("imp") + LEAN * F.col("pooled")) / (F.col("m") + LEAN)
    return stored(own.join(whole, "path").filter(lean < threshold).select("host", "path"))


def extract(pages: DataFrame, url: str = "url", page: str = "html", threshold: float = THRESHOLD, most: int = BROADCAST_ROWS) -> DataFrame:
    """Append text and n_chars.  Up to ``most`` removed branches are sent to the tasks; with more, hosts are taken in as many
    blocks as needed, each with its own pass over its pages."""
    branches = noise_branches(pages, url, page, threshold)
    blocks = max(1, -(-branches.count() // most))
    out = None
    for k in range(blocks):
        own = branches if blocks == 1 else branches.filter(F.pmod("host", F.lit(blocks)) == k)
        keys: dict[int, list[int]] = {}
        for r in own.toLocalIterator():
            keys.setdefault(r.host, []).append(r.path)
        shared = pages.sparkSession.sparkContext.broadcast({h: np.sort(np.array(p, dtype=np.int64)) for h, p in keys.items()})

        def run(urls: pa.Array, html_: pa.Array, shared=shared, k=k) -> list[pa.Array]:
            texts = []
            for u, h in zip(urls.to_pylist(), html_.to_pylist()):
                host = _signed(xxhash.xxh3_64_intdigest(host_of(u)))
                texts.append(read(h, 0, shared.value.get(host)) if host % blocks == k else None)
            return [pa.array(texts, pa.string()), pa.array([None if t is None else len(t) for t in texts], pa.int64())]

        part = with_arrays(pages, [url, page], [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], run)
        part = part if blocks == 1 else part.filter("text is not null")
        out = part if out is None else out.unionByName(part)
    return out
