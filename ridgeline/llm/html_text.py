"""Main text of web pages by a site style tree.

All pages of a host are merged into one tree of style nodes: an element's path of tags, classes and ids. For each
node the entropy of its presentations (the child tags that pages give it) and of its contents (the texts that pages
put there) tells how important it is: where all pages show the same, both are low. Counting is a plain aggregation in
Spark. Nodes of low importance, and those whose tag, role, class or id says that they are navigation, adverts or the
like, are cut from each page; the text of what remains of the article is the result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import join_groups, written

PAGES = 4  # occurrences of a node before its entropy tells anything, whatever the size of its host
LOW = 0.2  # importance below which a node is cut
PRESENTATION = 0.1  # weight of presentation against content

# Elements by kind, and words that name what isn't article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body head html li dd dt td th tr tbody thead tfoot option optgroup legend".split())
DROPPED = frozenset("script style noscript template svg math iframe object embed canvas audio video form button select textarea input nav footer aside menu dialog head title noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "comment comments respond disqus replies cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login popup modal overlay related recommended "
    "share sharing social widget toolbar pagination pager search skip tags copyright legal disclaimer".split()
)
MAIN = frozenset("article content main post entry story maincontent".split())
#: Words that say nothing by themselves: inside an article a name of several words is noise only if the rest is of these.
NEUTRAL = MAIN | frozenset("area bar block body bottom box btn button buttons container footer group header inline inner item items left link links list outer panel region right row section site slot text title top unit widget wrap wrapper zone".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_STOP = re.compile("[\"'>]")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[^a-z0-9]+")
_ENDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "option": ("select",)}


@dataclass(slots=True)
class Node:
    tag: str
    style: str = ""
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes and texts
    path: int = 0


def parse(source: str) -> Node:
    """A tree of elements; unclosed and stray tags are tolerated, as browsers do in the common cases."""
    root = Node("#root")
    stack, raw = [root], None
    open_tags: dict[str, int] = {}
    ends: dict[int, int] = {}
    at, end, plain_end = 0, len(source), -1

    def say(text: str) -> None:
        if text:
            stack[-1].children.append(html.unescape(text) if "&" in text else text)

    while at < end:
        if raw is not None:
            m = re.compile(f"</{raw}[^>]*+>", re.I).search(source, at)
            stack[-1].children.append(source[at : m.start() if m else end])
            _count(open_tags, stack.pop(), -1)
            at, raw = m.end() if m else end, None
            continue
        start = source.find("<", at)
        if start < 0:
            say(source[at:])
            break
        say(source[at:start])
        if source.startswith(("<!", "<?"), start):
            long = source.startswith("<!--", start)
            stop = source.find("-->" if long else ">", start + (4 if long else 2))
            at = end if stop < 0 else stop + (3 if long else 1)
            continue
        closing = source.startswith("</", start)
        m = _NAME.match(source, start + 1 + closing)
        if m is None:
            say("<")
            at = start + 1
            continue
        name, after = m[0], m.end()
        stop = _tag_end(source, after, ends)
        if stop < 0:  # a quote that is never closed: the tag ends at the next >
            if plain_end < after:  # where it is past the tag before, it is this one's too
                plain_end = source.find(">", after)
                plain_end = end if plain_end < 0 else plain_end
            stop = plain_end
        rest, at = source[after:stop], stop + 1
        name = name.lower()
        if closing:
            if open_tags.get(name):
                while True:
                    gone = stack.pop()
                    _count(open_tags, gone, -1)
                    if gone.tag == name:
                        break
            continue
        if name in CLOSES_P and (name not in ("table",)):
            _close(open_tags, stack, ("p",), ("td", "th", "table", "button", "object", "caption"))
        if name in _ENDS:
            _close(open_tags, stack, ("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,), _ENDS[name])
            if name == "tr":
                _close(open_tags, stack, ("tr",), ("table",))
        found = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(rest)} if rest.strip(" /\n\t\r") else {}
        node = Node(name, f"{name}.{'.'.join(sorted(found.get('class', '').lower().split()))}#{found.get('id', '').lower()}", found)
        node.path = xxhash.xxh64_intdigest(node.style, stack[-1].path)
        stack[-1].children.append(node)
        if name in VOID or rest.rstrip().endswith("/") and name in ("svg", "path"):
            continue
        stack.append(node)
        _count(open_tags, node, 1)
        if name in RAW:
            raw = name
    return root


def _tag_end(source: str, at: int, ends: dict[int, int]) -> int:
    """The next > outside quotes from a place outside them, or -1. ends: what is known of places behind closing quotes, so
    that tags which run into each other go over a quote once, not each of them to the end of the page."""
    passed = []
    while True:
        m = _STOP.search(source, at)
        if m is None or m[0] == ">":
            found = m.start() if m else -1
            break
        close = source.find(m[0], m.end())
        if close < 0:
            found = -1
            break
        at = close + 1
        if at in ends:
            found = ends[at]
            break
        passed.append(at)
    for place in passed:
        ends[place] = found
    return found


def _count(open_tags: dict[str, int], node: Node, n: int) -> None:
    open_tags[node.tag] = open_tags.get(node.tag, 0) + n


def _close(open_tags: dict[str, int], stack: list[Node], tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
    if not any(open_tags.get(t) for t in tags):
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            for node in stack[i:]:
                _count(open_tags, node, -1)
            del stack[i:]
            return
        if stack[i].tag in scope:
            return


def named_noise(node: Node, in_article: bool) -> bool:
    """Whether tag, role, class or id say that a node isn't article text."""
    if node.tag in DROPPED or (node.tag == "header" and not in_article) or "hidden" in node.attributes:
        return True
    a = node.attributes
    if not a or node.tag in ("html", "body", "main", "article"):
        return node.tag == "article" and any(_noise(n, True) and {"comment", "comments", "reply"} & set(_PARTS.split(n)) for n in f"{a.get('class', '')} {a.get('id', '')}".lower().split())
    if a.get("role", "").lower() in ROLES or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    return any(_noise(name, in_article) for name in f"{a.get('class', '')} {a.get('id', '')}".lower().split())


def _noise(name: str, in_article: bool) -> bool:
    """Whether a class or an id names noise: as a whole, or by a word of it. Inside an article one word isn't enough
    ("legal-analysis", "share-price"); the others must be noise too or say nothing ("share-buttons")."""
    if _PARTS.sub("", name) in NAMES:
        return True
    parts = [p for p in _PARTS.split(name) if p]
    return any(p in NAMES for p in parts) and (not in_article or all(p in NAMES or p in NEUTRAL or p.isdigit() for p in parts))


def blocks(node: Node, cut: frozenset[int], in_article: bool = False) -> list[str]:
    """Texts of the blocks of a tree in order, without what is cut, white space collapsed, none empty."""
    out: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(buffer).split()):
            out.append(text)
        buffer.clear()

    stack: list[tuple[object, bool]] = [(node, in_article)]
    while stack:
        item, inside = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            buffer.append(item)
        else:
            if item is not node and (named_noise(item, inside) or signed(item.path) in cut and item.tag not in ("html", "body", "article", "main")):
                if item.tag in BLOCK:
                    flush()
                continue
            inside = inside or item.tag == "article"
            if item.tag == "br":
                buffer.append(" ")
            if item.tag in BLOCK:
                flush()
                stack.append((None, inside))
            stack.extend((c, inside) for c in reversed(item.children))
    flush()
    return out


def signed(path: int) -> int:
    return path - (1 << 64) if path >= 1 << 63 else path


def walk(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))


def outermost(root: Node, wanted) -> list[Node]:
    """The wanted nodes in page order that lie neither in one another nor in what isn't article text."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node is not root and named_noise(node, False):
            continue
        if wanted(node):
            found.append(node)
        else:
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return found


def main_text(source: str, cut: frozenset[int]) -> str:
    """The blocks of all articles in page order, joined by one newline; "" if there are none.

    A page without articles has its main elements, without these the outermost ones whose class or id says so, else all
    that is left of it.
    """
    root = parse(source)
    named = lambda n: MAIN & {*_PARTS.split(f"{n.attributes.get('class', '')} {n.attributes.get('id', '')}".lower())}
    kinds = (
        lambda n: n.tag == "article",
        lambda n: n.tag == "main" or n.attributes.get("role", "").lower() == "main",
        lambda n: n.tag in ("div", "section", "td") and n.attributes and named(n),
    )
    for wanted in kinds:
        if found := [t for n in outermost(root, wanted) for t in blocks(n, cut, True)]:
            return "\n".join(found)
    return "\n".join(blocks(root, cut))


def style_nodes(source: str) -> list[tuple[int, int, int]]:
    """(path, presentation, content) of each style node of a page that has text: hashes of child tags and of texts."""
    root, out = parse(source), {}
    texts: dict[int, list[str]] = {}
    order = [*walk(root)]
    for node in reversed(order):
        own = "".join("".join(texts.pop(id(c), [])) if isinstance(c, Node) else c for c in node.children) if node.tag not in ("script", "style") else ""
        texts[id(node)] = [own, " "]
        if node.tag != "#root" and node.tag not in DROPPED and (clean := " ".join(own.split())):
            shown = ",".join(c.style for c in node.children if isinstance(c, Node))
            before = out.get(node.path, (0, 0))
            out[node.path] = (xxhash.xxh64_intdigest(shown, before[0]), xxhash.xxh64_intdigest(clean.encode("utf-8", "surrogatepass"), before[1]))
    return [(signed(p), signed(a), signed(b)) for p, (a, b) in out.items()]


def site_tree(pages: DataFrame) -> DataFrame:
    """host, path, pages, importance of the merged tree of pages (host, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(host, *node) for host, source in zip(b["host"], b["html"], strict=True) for node in style_nodes(source)]
            yield pd.DataFrame(rows, columns=["host", "path", "shown", "content"])

    nodes = pages.select("host", "html").mapInPandas(run, "host string, path long, shown long, content long")
    # One pass: rows by (node, kind, value), then by node. Partial sums come first, so a host with most pages is no hot key.
    seen = nodes.select("host", "path", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("shown").alias("v")), F.struct(F.lit(1).alias("kind"), F.col("content").alias("v")))).alias("x"))
    counts = seen.groupBy("host", "path", "x.kind", "x.v").agg(F.count("*").alias("n"))
    spread = counts.groupBy("host", "path").agg(*(F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(f"m{k}") for k in (0, 1)), *(F.sum(F.when(F.col("kind") == k, F.col("n") * F.log("n"))).alias(f"s{k}") for k in (0, 1)))
    entropy = lambda k: F.when(F.col(f"m{k}") > 1, (F.log(f"m{k}") - F.col(f"s{k}") / F.col(f"m{k}")) / F.log(f"m{k}")).otherwise(1.0)
    return spread.select("host", "path", F.col("m0").alias("pages"), (PRESENTATION * entropy(0) + (1 - PRESENTATION) * entropy(1)).alias("importance"))


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = PAGES) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    A style node is cut by its importance alone, once `least_pages` pages have it; the share of its host's pages that it
    stands on doesn't count. A host's cut nodes are its templates' repeated parts, each shared by pages, held as one list.

    Null html counts as empty and gives "". Pages whose url is null or has no host form one host of their own. Repeated
    rows count as pages of their own. Empty table: no rows.
    """
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.coalesce(F.lower(F.try_parse_url(F.col(url_col), F.lit("HOST"))), F.lit("")).alias("host"))
    hosts = pages.groupBy("host").agg(F.count("*").alias("of"))
    low = site_tree(pages).where((F.col("pages") >= least_pages) & (F.col("importance") < LOW)).groupBy("host").agg(F.collect_list("path").alias("cut"))
    groups = written(hosts.join(low, "host", "left"), "hosts")
    total = groups.agg(F.coalesce(F.sum("of"), F.lit(0))).first()[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(h, frozenset(c.tolist()) if c is not None else frozenset()) for h, c in zip(b["html"], b["cut"], strict=True)]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return join_groups(pages, groups, "host", "of", total).select("page_id", "url", "html", "cut").mapInPandas(run, f"page_id {df.schema[id_col].dataType.simpleString()}, url string, text string, n_chars long")
