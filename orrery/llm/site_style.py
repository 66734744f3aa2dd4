"""Main text of web pages by site style trees: what a host's pages share in form and words is not their content."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.scratch import Scratch, aside, extended, others
from orrery.llm.urls import host

#: Weight of one more form of a node, as the method has it.
GAMMA = 0.9
#: A branch of this importance or less is a template's.
LOW = 0.2
#: Within a marked article a branch is a template's only if it is nearly constant over so many pages.
LOW_INSIDE, PAGES_INSIDE = 0.05, 8
#: Nodes on a smaller share of a host's pages are judged by the page alone; so a host has at most nodes-a-page / SUPPORT branches to remove.
SUPPORT = 0.02
#: Removable branches that may go to every task, in some 30 MB.
MOST_BRANCHES = 200_000

# What elements are (fixed values of the format).
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "noembed", "noframes", "xmp", "template"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: An open element that a start tag ends, and up to where it is looked for.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
# Names by which pages mark what is not their text.
_NOISE_TAGS = {"nav", "aside", "footer", "form", "button", "select", "dialog", "svg", "canvas", "object", "audio", "video", "map", "menu", "head", "datalist", "math"}
_NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar", "tablist"}
_NOISE_WORDS = {"ad", "ads", "aside", "banner", "nav", "navbar", "subnav", "topnav", "sidenav", "reply", "replies", "respond", "consent", "gdpr", "notice", "notices", "widget", "widgets", "login", "signup", "toolbar", "pager", "pagination", "copyright", "share", "sharing", "sharebar", "social", "skip", "hidden"}
_NOISE_STARTS = ("advert", "breadcrumb", "comment", "cookie", "disqus", "footer", "menu", "modal", "navig", "newsletter", "popup", "promo", "recommend", "related", "sidebar", "sponsor", "subscri", "teaser")
_HEADER_WORDS = {"header", "masthead", "topbar"}
_CONTENT_WORDS = {"article", "articlebody", "post", "entry", "story", "content", "maincontent", "main"}

_WRITTEN = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "article", "main"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+[^>]*)>?""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+))|\b(hidden)\b""", re.S)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Node:
    tag: str
    above: int  # the parent's place, -1 for the root
    path: str
    marks: frozenset[str] = frozenset()  # noise, comment, header, region, content
    children: list[str] = field(default_factory=list)


@dataclass
class Block:
    node: int
    text: str
    linked: int  # characters within links


def _marks(tag: str, attributes: str) -> tuple[str, frozenset[str]]:
    """An element's name within a path, and what its tag, role, class and id say of it."""
    out: set[str] = set()
    if tag in _NOISE_TAGS:
        out.add("noise")
    if tag == "header":
        out.add("header")
    if tag in ("article", "main"):
        out.add("region")
    if not attributes or attributes.isspace():
        return tag, frozenset(out)
    label = tag
    for name, x, y, z, alone in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), x or y or z
        if alone or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDES.search(value)):
            out.add("noise")
        elif name == "role":
            if value.lower() in _NOISE_ROLES:
                out.add("noise")
            elif value.lower() in ("main", "article"):
                out.add("region")
        elif name == "itemprop" and value.lower() == "articlebody":
            out.add("content")
        elif name in ("class", "id"):
            for c in sorted(value.split())[:8]:
                label += ("." if name == "class" else "#") + re.sub(r"\d{3,}|/", "0", c)
                words = [w.lower() for w in _NAMES.findall(c)]
                if not words or words[0] in ("has", "no", "with", "without", "is"):
                    continue
                if any(w.startswith("comment") or w == "disqus" for w in words):
                    out |= {"noise", "comment"}
                elif any(w in _NOISE_WORDS or w.startswith(_NOISE_STARTS) for w in words):
                    out.add("word")
                elif any(w in _HEADER_WORDS for w in words):
                    out.add("header")
                elif any(w in _CONTENT_WORDS for w in words):
                    out.add("content")
    return label, frozenset(out)


def parse(html: str) -> tuple[list[Node], list[Block]]:
    """The elements of a page in order, and its blocks of text: what stands between starts and ends of block elements.

    Missing end tags are supplied as browsers do for paragraphs, list items, cells and terms; unknown
    end tags are passed over. Character references are decoded, white space becomes one blank.
    """
    nodes, blocks = [Node("#", -1, "")], []
    stack, text, at, linked = [0], [], 0, 0
    seen: dict[tuple[str, str], tuple[str, frozenset[str]]] = {}

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join("".join(text).split())
            if words:
                k = len(stack) - 1
                while k and nodes[stack[k]].tag in _INLINE:
                    k -= 1
                blocks.append(Block(stack[k], words, min(linked, len(words))))
            text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        raw = entities.unescape(raw) if "&" in raw else raw
        text.append(raw)
        if any(nodes[i].tag == "a" for i in stack[-3:]):
            linked += len(raw.strip())

    def close(names: set[str], stop: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[k]].tag
            if tag in names:
                del stack[k:]
                return
            if tag in stop:
                return

    while (m := _TOKEN.search(html, at)) is not None:
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        end, tag, attributes = m[1], m[2], m[3]
        if tag is None:  # comment, declaration
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if end:
            if tag in _INLINE:
                for k in range(len(stack) - 1, 0, -1):
                    name = nodes[stack[k]].tag
                    if name == tag:
                        del stack[k:]
                    if name == tag or name not in _INLINE:
                        break
            elif tag not in ("body", "html", "p", "br") or (tag == "p" and any(nodes[i].tag == "p" for i in stack)):
                flush()
                close({tag}, {"td", "th"} - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else set())
            continue
        if tag in _RAW:
            found = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)", re.I).search(html, at)
            at = found.start() if found else len(html)
            stop = html.find(">", at)
            at = len(html) if stop < 0 else stop + 1
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in _INLINE:
            flush()
            names, stop = _ENDS.get(tag, (set(), set()))
            if names:
                close(names, stop)
            close({"p"}, {"td", "th", "li", "table", "article", "section", "div", "body", "button"})
        label = seen.get((tag, attributes))
        if label is None:
            label = seen[tag, attributes] = _marks(tag, attributes)
        up = nodes[stack[-1]]
        if tag not in _INLINE:
            if not up.children or up.children[-1] != label[0]:
                up.children.append(label[0])
            path = f"{up.path}/{label[0]}" if up.path else label[0]
        else:
            path = up.path
        nodes.append(Node(tag, stack[-1], path, label[1]))
        stack.append(len(nodes) - 1)
    if at < len(html):
        add(html[at:])
    flush()
    return nodes, blocks


def identity(text: str) -> int:
    """Spark's xxhash64 of a string."""
    n = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), 42)
    return n - (n >> 63 << 64)


def _inherited(nodes: list[Node], own: list[bool]) -> list[bool]:
    """Whether a node or one above it is marked; parents come first."""
    out: list[bool] = []
    for n, mine in zip(nodes, own, strict=True):
        out.append(mine or (n.above >= 0 and out[n.above]))
    return out


def _shares(nodes: list[Node], blocks: list[Block], hard: list[bool]) -> list[int]:
    """How many characters outside links stand below each node."""
    out, gone = [0] * len(nodes), _inherited(nodes, hard)
    for b in blocks:
        if not gone[b.node]:
            out[b.node] += len(b.text) - b.linked
    for i in range(len(nodes) - 1, 0, -1):
        out[nodes[i].above] += out[i]
    return out


def _holders(nodes: list[Node], held: list[bool]) -> list[bool]:
    """Whether a node lies above a marked one."""
    out = [False] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        if held[i] or out[i]:
            out[nodes[i].above] = True
    return out


def main_text(html: str, template: dict[int, tuple[float, int]]) -> str:
    """The text of a page's article. ``template``: importance and pages of its host's branches of low importance, by path.

    Blocks go that stand in elements whose tag, role, class or id names a menu, header, footer, sidebar,
    notice, advert, form or comment; a class or form that holds the marked article does not count. If a
    page marks an article (or a main part, or by class a content part), only what stands there is kept.
    Of the rest, branches of low importance go, within a marked article those of LOW_INSIDE but for headings and paragraphs. Where these
    hold most of the marked text, or all paragraphs, the host's pages are copies of each other and none goes.
    """
    nodes, blocks = parse(html)
    if not blocks:
        return ""
    hard = [("noise" in n.marks and n.tag != "form" and n.tag not in ("html", "body")) for n in nodes]
    outside = _inherited(nodes, hard)
    region = ["region" in n.marks and "word" not in n.marks and not o for n, o in zip(nodes, outside, strict=True)]
    articles = [r and n.tag == "article" for n, r in zip(nodes, region, strict=True)]
    has_text = lambda inside: any(inside[b.node] for b in blocks)
    if any(articles) and has_text(_inherited(nodes, articles)):
        region = articles
    named = any(region)
    if not named:  # by class or id: the outermost content part
        named_part = ["content" in n.marks and "word" not in n.marks and n.tag not in _INLINE and not o for n, o in zip(nodes, outside, strict=True)]
        region = named_part if has_text(_inherited(nodes, named_part)) else region
    holds = _holders(nodes, region)
    inside = _inherited(nodes, region) if any(region) else [True] * len(nodes)
    body = ("html", "body", "article", "main")
    # names of classes, headers and forms count where they do not hold the article; a header within it has its title
    soft = [not holds[i] and n.tag not in body and ("word" in n.marks or n.tag == "form" or ("header" in n.marks and not (any(region) and inside[i]))) for i, n in enumerate(nodes)]
    if not any(region):  # nor where they hold most of what is no link
        share = _shares(nodes, blocks, hard)
        soft = [a and ("header" in n.marks or 2 * x <= share[0]) for a, n, x in zip(soft, nodes, share, strict=True)]
    noise = _inherited(nodes, [a or b for a, b in zip(hard, soft, strict=True)])
    kept = [b for b in blocks if inside[b.node] and not noise[b.node]]
    if not kept and any(region):
        kept = [b for b in blocks if not noise[b.node]]
        inside, named = [True] * len(nodes), False
    if not any(region):  # nothing says where the text is: lists and parts that are links only are menus
        kept = [b for b in kept if nodes[b.node].tag == "p" or b.linked * 10 < len(b.text) * 8] or kept
    if template and kept:
        low = [_is_low(template.get(identity(n.path)), named and inside[i], n.tag) for i, n in enumerate(nodes)]
        gone = _inherited(nodes, low)
        left = [b for b in kept if not gone[b.node]]
        size = lambda x: sum(len(b.text) for b in x)
        if 2 * size(left) >= size(kept) or (not any(region) and any(len(b.text) - b.linked >= 100 for b in left)):
            kept = left
    return " ".join(b.text for b in kept)


def _is_low(found: tuple[float, int] | None, inside: bool, tag: str) -> bool:
    """Whether a branch goes; headings and paragraphs of a marked article stay."""
    if found is None or not inside:
        return found is not None
    return tag not in _WRITTEN and found[0] <= LOW_INSIDE and found[1] >= PAGES_INSIDE


def site(url: Column) -> Column:
    """The host whose pages are merged; null without one."""
    return F.nullif(host(url), F.lit(""))


def _pages(pages: DataFrame, url_col: str, html_col: str) -> tuple[DataFrame, str, str]:
    at, text = aside(pages, "site"), aside(pages, "html")
    return pages.withColumns({at: site(F.col(url_col).cast("string")), text: F.col(html_col).cast("string")}), at, text


def _node_rows(pages: DataFrame, at: str, text: str) -> DataFrame:
    """(site, path, form, words): each page's nodes once with their form, the children's names, and once with each of their blocks' words, as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                sites, paths, nodes_of, forms, words = [], [], [], [], []
                for where, html in zip(b.column(at).slice(i, 256).to_pylist(), b.column(text).slice(i, 256).to_pylist(), strict=True):
                    nodes, blocks = parse(html or "")
                    form: dict[str, set[str]] = {}
                    for n in nodes[1:]:
                        if n.tag not in _INLINE:
                            form.setdefault(n.path, set()).add(" ".join(n.children))
                    for path, seen in form.items():
                        sites.append(where), paths.append(path), nodes_of.append(identity(path)), forms.append(identity("|".join(sorted(seen)))), words.append(None)
                    for path, said in {(nodes[x.node].path, identity(x.text)) for x in blocks}:
                        sites.append(where), paths.append(None), nodes_of.append(identity(path)), forms.append(None), words.append(said)
                yield pa.RecordBatch.from_arrays([pa.array(sites, pa.string()), pa.array(paths, pa.string()), pa.array(nodes_of, pa.int64()), pa.array(forms, pa.int64()), pa.array(words, pa.int64())], ["site", "path", "node", "form", "words"])

    return pages.where(F.col(at).isNotNull()).select(at, text).mapInArrow(run, "site string, path string, node long, form long, words long")


def style_trees(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(site, path, node long, n_pages long, presentation, content, importance double): the nodes of each host's merged page trees.

    A node is a path of elements, named by tag, class and id (numbers of three digits count as one), over all pages of a host; node is its hash.
    presentation: the entropy of its forms (the names of its children in order), in logarithms of
    n_pages, the pages that have it; 0 if all look alike. content: one less the mean entropy of the
    blocks of text below it over the pages, so 0 if every page says the same, 1 if each block is one
    page's; null without text. importance weighs presentation by 1 - GAMMA**forms, content by the rest.
    A node of one page has importance 1. Pages without a host form no tree; null html has no nodes.
    """
    df, at, text = _pages(pages, url_col, html_col)
    scratch = Scratch(pages.sparkSession, "style")
    rows = scratch.save(_node_rows(df, at, text).groupBy("site", "node", "path", "form", "words").agg(F.count("*").alias("n")))
    forms = rows.where("form is not null")
    of_node = forms.groupBy("site", "node", "path").agg(F.sum("n").alias("n_pages"), F.count("*").alias("l"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    entropy = F.when(F.col("n_pages") > 1, F.greatest(F.lit(0.0), (F.log("n_pages") - F.col("nlogn") / F.col("n_pages")) / F.log("n_pages"))).otherwise(1.0)
    of_node = of_node.select("site", "node", "path", "n_pages", "l", entropy.alias("presentation"))
    said = rows.where("words is not null").groupBy("site", "node").agg(F.sum("n").alias("blocks"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    leaf = of_node.join(said, ["site", "node"])
    # a block on k of m pages has entropy log k / log m
    leaf = leaf.select("site", "path", "blocks", F.when(F.col("n_pages") > 1, F.greatest(F.lit(0.0), F.col("blocks") - F.col("nlogn") / F.log("n_pages"))).otherwise(F.col("blocks")).alias("told"))
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.xxhash64(F.array_join(F.slice(F.split(F.col("path"), "/"), F.lit(1), k), "/")))
    below = leaf.select("site", F.explode(above).alias("node"), "blocks", "told").groupBy("site", "node").agg((F.sum("told") / F.sum("blocks")).alias("content"))
    out = of_node.join(below, ["site", "node"], "left")
    weight = F.pow(F.lit(GAMMA), F.col("l"))
    importance = F.when(F.col("n_pages") == 1, 1.0).otherwise((1 - weight) * F.col("presentation") + weight * F.coalesce("content", F.lit(0.0)))
    return out.select("site", "path", "node", "n_pages", "presentation", "content", importance.alias("importance"))


_TEMPLATE = "array<struct<node: long, importance: double, n_pages: long>>"


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(site, branches): each host's branches of importance LOW or less that hold text, on SUPPORT of its pages or more."""
    scratch = Scratch(pages.sparkSession, "template")
    trees = scratch.save(style_trees(pages, url_col, html_col))
    size = trees.groupBy("site").agg(F.max("n_pages").alias("most"))
    low = trees.join(size, "site").where((F.col("importance") <= LOW) & F.col("content").isNotNull() & (F.col("n_pages") >= SUPPORT * F.col("most")))
    # bounded: a host's nodes on SUPPORT of its pages are as many as a page's nodes / SUPPORT
    return low.groupBy("site").agg(F.collect_list(F.struct("node", "importance", "n_pages")).alias("branches"))


def extract(pages: DataFrame, keep: list[str] | None = None, url_col: str = "url", html_col: str = "html", most: int = MOST_BRANCHES) -> DataFrame:
    """``pages`` (its ``keep`` columns) with text string, the main text, and n_chars long, its code points.

    See ``main_text`` for what stays. Null and empty html, and pages of menus alone, give the empty
    string; a null url, or one without a host, is judged by the page alone. Repeated rows and ids are
    each extracted; an empty table stays empty. Columns of the new names, in any case, are replaced.
    Templates go to every task if they are ``most`` branches or fewer, else pages meet theirs by host.
    """
    new = ("text", "n_chars")
    keep = others(pages.columns if keep is None else keep, new)
    df, at, html = _pages(pages, url_col, html_col)
    found = Scratch(pages.sparkSession, "branches").save(templates(pages, url_col, html_col))
    n = found.agg(F.sum(F.size("branches"))).first()[0] or 0
    few = aside(pages, "branches")
    known = found.select(F.col("site").alias(at), F.col("branches").alias(few))
    rows = df.select(*keep, at, html).join(F.broadcast(known) if n <= most else known, at, "left").select(*keep, html, few)
    schema = extended(pages, keep, "text string, n_chars long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [main_text(h, {x["node"]: (x["importance"], x["n_pages"]) for x in t or ()}) if h else "" for h, t in zip(part.column(html).to_pylist(), part.column(few).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], [*keep, *new])

    return rows.mapInArrow(run, T.StructType(schema))
