"""Main text of web pages: same-host pages are merged into a site style tree whose unimportant branches are cut.

A page is read once into blocks of text, each with the path of tags and classes that leads to it. Per host the paths of
all pages form the style tree. A node matters as its presentation (how its children are laid out) and its content
(which texts stand there) differ between pages: entropies, as for a lottery over the host's pages. What the markup
itself declares (a nav, an article) goes before the statistics, since menus and adverts may differ on every page too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from textquarry.llm.common import small_side, stored

# Share of a node's importance that comes from its children; below LEAST a branch is cut; hosts with fewer than
# MIN_PAGES pages at a node say nothing about it.
DECAY, LEAST, MIN_PAGES = 0.9, 0.3, 5
# Deeper nodes share their ancestor's place in the style tree.
LONGEST_PATH = 2000

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe object svg math canvas select title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt "
                   "ruby s samp small span strike strong sub sup time tt u var wbr br".split())
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form "
                     "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
# Elements whose end tag may be left out: what a new one closes, and what stops the search.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
NOISE_TAGS = frozenset("nav footer aside form dialog button menu".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NOISE_WORDS = frozenset("ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored sponsors promo "
                        "promotion nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar aside rail "
                        "cookie cookies consent gdpr notice notices banner popup modal overlay toast newsletter subscribe "
                        "subscription signup login comment comments commentlist disqus reply replies respond reactions "
                        "share sharing social related recommended pagination pager widget widgets toolbar masthead "
                        "header topbar skip".split())
# These may name a page's or an article's wrapper or head, and count only outside the article.
HEAD_WORDS = frozenset({"header", "banner", "masthead"})
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond reactions".split())
# Words that name no content of their own: a class of noise words and these is one whole noise class.
FRAME_WORDS = frozenset("area bar block box button buttons card container group holder inner item items link links list "
                        "form outer panel posts row section slot thread unit wrap wrapper".split())
# Ids of these are targets of links and name their topic.
NAMED_BY_TOPIC = frozenset("h1 h2 h3 h4 h5 h6 p".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
                  r"|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_SEPARATORS = str.maketrans("/.", "||")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class _Node:
    __slots__ = ("tag", "path", "parent", "inline", "owner", "mute", "noise", "head", "main", "inside", "comments",
                 "children", "chars", "linked", "links")

    def __init__(self, tag: str, path: str, parent: "_Node | None", inline: bool = False):
        self.tag, self.path, self.parent, self.inline = tag, path, parent, inline
        self.owner = parent.owner if inline else self  # the block the text belongs to
        self.mute = inline and parent.mute
        self.noise = self.head = False
        self.main = ""
        self.inside = parent is not None and (parent.inside or parent.main != "")  # an article or main element
        self.comments = parent is not None and parent.comments
        self.children: list[str] = []
        self.chars = self.linked = self.links = 0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text else {}  # the last of a name


def _noise_classes(classes: str) -> set[str]:
    """Noise words of the classes that say nothing else."""
    found: set[str] = set()
    for name in classes.split():
        words = set(_WORD.findall(_CAMEL.sub(" ", name).lower()))
        if words <= NOISE_WORDS | FRAME_WORDS:
            found |= words & NOISE_WORDS
    return found


def _describe(node: _Node, attributes: dict[str, str]) -> None:
    """What tag, class, id and role say about a node."""
    if not attributes:
        node.main = node.tag if node.tag in ("article", "main") else ""
        node.noise, node.head = node.tag in NOISE_TAGS or (node.main == "article" and node.comments), node.tag == "header"
        return
    classes = attributes.get("class", "")
    named = classes + " " + ("" if node.tag in NAMED_BY_TOPIC else attributes.get("id", ""))
    words = set(_WORD.findall(_CAMEL.sub(" ", named).lower())) if named != " " else set()
    role = attributes.get("role", "").lower()
    if node.tag == "article" or role == "article":
        node.main = "article"
    elif node.tag == "main" or role == "main":
        node.main = "main"
    if words and node.tag not in ("html", "body"):
        if node.main:  # only a comment is an article that is none
            node.noise = node.main == "article" and (node.comments or bool(COMMENT_WORDS & _noise_classes(classes)))
        elif node.inside:
            node.noise = node.head = bool(_noise_classes(classes) - HEAD_WORDS)
        else:
            plain = words & NOISE_WORDS
            node.noise = bool(plain - HEAD_WORDS)
            node.head = bool(plain)
        node.comments |= not node.main and bool(words & COMMENT_WORDS) and node.noise
    elif node.main == "article":
        node.noise = node.comments
    node.noise |= node.tag in NOISE_TAGS or role in NOISE_ROLES - {"banner"}
    node.head |= node.tag == "header" or role == "banner"
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(
            r"display\s*:\s*none", attributes.get("style", "")):
        node.noise = True


def _classes(names: str) -> list[str]:
    """Up to three classes for a node's label, those without digits first; none has a separator of labels or paths."""
    return sorted(names.translate(_SEPARATORS).split(), key=lambda c: (any(x.isdigit() for x in c), c))[:3] if names else []


def read_page(html: str) -> list[tuple[str, str, bool, str, str]]:
    """Blocks in page order: text, path of the block's node, whether the markup calls it noise, the main part it stands
    in ('article', 'main' or ''), and the layout of the node's children as read so far."""
    root = _Node("", "", None)
    stack, nodes, open_tags = [root], [root], Counter()
    blocks: list[tuple[str, _Node]] = []
    pieces: list[str] = []
    links = 0

    def flush() -> None:
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                blocks.append((text, stack[-1].owner))

    def pop_to(i: int) -> None:
        if not all(n.inline for n in stack[i:]):
            flush()
        open_tags.subtract([n.tag for n in stack[i:]])
        del stack[i:]

    at, search = 0, _TAG.search
    while True:
        m = search(html, at)
        start = m.start() if m else len(html)
        top = stack[-1]
        if start > at and not top.mute:
            text = html[at:start]
            pieces.append(text)
            if not text.isspace():
                top.owner.chars += len(text)
                if links:
                    top.owner.linked += len(text)
        if not m:
            break
        at = m.end()
        closing, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            inline = tag in INLINE
            for i in range(len(stack) - 1, 0, -1) if open_tags[tag] else ():
                if stack[i].tag == tag:
                    pop_to(i)
                    break
                if inline and not stack[i].inline:
                    break
            if tag == "a":
                links = 0
        elif tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at) if not rest.endswith("/") else None
            if end:
                at = end.end()
            elif tag in ("script", "style", "textarea", "title") and not rest.endswith("/"):
                at = len(html)
        elif tag == "br":
            pieces.append(" ")
        elif tag in VOID:
            if tag == "hr":
                flush()
        elif tag in INLINE:
            if tag == "a":
                links = 1
                top.owner.links += 1
            node = _Node(tag, "", top, True)
            if rest:
                _describe(node, _attributes(rest))
                node.mute |= node.noise
            stack.append(node)
            open_tags[tag] += 1
        else:
            flush()
            if tag in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        pop_to(i)
                        break
                    if not stack[i].inline:
                        break
            elif tag in CLOSES and any(open_tags[x] for x in CLOSES[tag][0]):
                ends, stops = CLOSES[tag]
                low = 0
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in ends:
                        low = i
                    if stack[i].tag in stops:
                        break
                if low:
                    pop_to(low)
            while stack[-1].inline:  # an inline element left open ends where a block starts
                open_tags[stack.pop().tag] -= 1
            links = 0
            attributes = _attributes(rest)
            parent = stack[-1]
            label = tag + "".join(f".{c}" for c in _classes(attributes.get("class", "")))
            node = _Node(tag, f"{parent.path}/{label}" if len(parent.path) < LONGEST_PATH else parent.path, parent)
            _describe(node, attributes)
            if not parent.children or parent.children[-1] != label:
                parent.children.append(label)
            stack.append(node)
            nodes.append(node)
            open_tags[tag] += 1
    flush()
    return _judged(blocks, nodes)


def _judged(blocks: list[tuple[str, _Node]], nodes: list[_Node]) -> list[tuple[str, str, bool, str, str]]:
    sums = {id(n): [n.chars, n.linked, n.links] for n in nodes}
    nearest: dict[int, int] = {}  # the main part a node stands in
    for n in nodes:  # parents come before their children
        if n.main and not n.noise:
            nearest[id(n)] = id(n)
        elif n.parent is not None and id(n.parent) in nearest:
            nearest[id(n)] = nearest[id(n.parent)]
    holds_main = {nearest[id(node)] for _, node in blocks if id(node) in nearest}
    for n in reversed(nodes):
        if n.parent is not None:
            for k in range(3):
                sums[id(n.parent)][k] += sums[id(n)][k]
            if id(n) in holds_main:
                holds_main.add(id(n.parent))
    verdicts: dict[int, tuple[bool, str]] = {}

    def verdict(node: _Node) -> tuple[bool, str]:
        """Noise, and the main part the node stands in; what holds above holds below."""
        line: list[_Node] = []
        n: _Node | None = node
        while n is not None and id(n) not in verdicts:
            line.append(n)
            n = n.parent
        noise, main = verdicts[id(n)] if n is not None else (False, "")
        for n in reversed(line):
            if n.main and not n.noise and not noise:
                main = "article" if "article" in (main, n.main) else n.main
            chars, linked, links = sums[id(n)]
            holds = id(n) in holds_main
            noise |= n.noise and not (holds and n.tag not in NOISE_TAGS)
            noise |= not main and n.head and not holds
            noise |= not main and n.tag in ("ul", "ol", "div", "table") and links >= 3 and linked >= 0.7 * chars
            verdicts[id(n)] = noise, main
        return noise, main

    return [(text, node.path, *verdict(node), " ".join(node.children)) for text, node in blocks]


BLOCKS = "array<struct<text:string,path:string,noise:boolean,main:string,layout:string>>"
_BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("path", pa.string()), ("noise", pa.bool_()), ("main", pa.string()),
                              ("layout", pa.string())]))


def page_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """The rows without ``html``, with ``blocks`` as read from the markup (null html has none) and a number, ``row``."""
    others = [c for c in pages.columns if c != html]
    kept = [f"k{i}" for i in range(len(others))]
    rows = pages.select(*[F.col(c).alias(k) for c, k in zip(others, kept)], F.col(html).alias("html"))
    names = ("text", "path", "noise", "main", "layout")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                numbers = pa.array(range(row, row + part.num_rows), pa.int64())
                row += part.num_rows
                found = [[dict(zip(names, b)) for b in read_page(h)] if h else [] for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in kept] + [pa.array(found, _BLOCKS), numbers], [*kept, "blocks", "row"])

    schema = ", ".join([f"{k} {t}" for k, t in rows.dtypes if k != "html"] + [f"blocks {BLOCKS}", "row long"])
    return rows.mapInArrow(read, schema).toDF(*others, "blocks", "row")


def candidates(read: DataFrame) -> DataFrame:
    """The rows with ``part``, the main part that the text stands in ('article', 'main' or ''), and ``texts`` of the blocks there that the markup
    does not call noise. In ``blocks`` a hash stands for every text: the style tree asks only which are equal."""
    good = F.filter("blocks", lambda b: ~b["noise"])
    part = (F.when(F.exists(good, lambda b: b["main"] == "article"), "article")
            .when(F.exists(good, lambda b: b["main"] == "main"), "main").otherwise(""))
    texts = F.transform(F.filter("blocks", lambda b: ~b["noise"] & (b["main"] == F.col("part"))), lambda b: b["text"])
    hashed = F.transform("blocks", lambda b: F.struct(F.xxhash64(b["text"]).alias("text"), *[b[c].alias(c) for c in ("path", "noise", "main", "layout")]))
    return read.withColumn("part", part).withColumn("texts", texts).withColumn("blocks", hashed)


def own_classes(read: DataFrame) -> DataFrame:
    """``row`` and ``own``: the classes that only this page of its host has, on hosts with pages enough to be judged.

    Counted in the tasks first, so that a class on all pages of a large host is a row per task."""
    labels = F.array_distinct(F.flatten(F.transform("blocks", lambda b: F.split(F.concat_ws(" ", F.replace(b["path"], F.lit("/"), F.lit(" ")), b["layout"]), " "))))
    classes = F.array_distinct(F.flatten(F.transform(F.filter(labels, lambda x: F.contains(x, F.lit("."))), lambda x: F.slice(F.split(x, "[.]"), 2, 3))))
    each = read.select("host", "row", F.explode(classes).alias("class"))
    single = each.groupBy("host", "class").agg(F.count("*").alias("m"), F.min("row").alias("row")).where("m = 1")
    pages = read.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= MIN_PAGES)
    return single.join(pages, "host", "left_semi").groupBy("row").agg(F.collect_list("class").alias("own"))


def shared_labels(read: DataFrame, own: DataFrame) -> DataFrame:
    """The rows with the classes in ``own`` left out of paths and layouts."""
    def less(path: Column, separator: str) -> Column:
        def label(x: Column) -> Column:
            return F.array_join(F.filter(F.split(x, "[.]"), lambda c, i: (i == 0) | ~F.array_contains("own", c)), ".")
        return F.array_join(F.transform(F.split(path, separator), label), separator)

    joined = read.join(own, "row", "left")
    cleaned = F.transform("blocks", lambda b: F.struct(b["text"].alias("text"), less(b["path"], "/").alias("path"), b["noise"].alias("noise"),
                                                       b["main"].alias("main"), less(b["layout"], " ").alias("layout")))
    return joined.withColumn("blocks", F.when(F.col("own").isNull(), F.col("blocks")).otherwise(cleaned)).drop("own")


def distinct_pages(read: DataFrame) -> DataFrame:
    """One row of each group of equal pages of a host: copies say nothing about what a site's pages share."""
    first = read.groupBy("host", F.xxhash64("blocks").alias("h")).agg(F.min("row").alias("row"))
    return read.join(first.select("row"), "row", "left_semi")


def style_tree(blocks: DataFrame) -> DataFrame:
    """The merged tree of each host: one row per (host, path) with the pages that have it, the entropy of its layouts
    over those pages and the mean evenness of its texts, both 0 to 1, to the base of the pages.

    Counts are made per text and per layout first, in the tasks before the shuffle, so that a host with a third of all
    pages is spread over its paths and texts.
    """
    hashed = lambda name: F.transform("blocks", lambda b: F.struct(b["path"].alias("path"), F.xxhash64(b[name]).alias(name)))
    # A line that one page repeats is one page's line.
    each = blocks.select("host", F.inline(F.array_distinct(hashed("text"))))
    paths = F.array_distinct(F.transform("blocks", lambda b: b["path"]))
    nodes = blocks.select("host", F.explode(paths).alias("path")).groupBy("host", "path").agg(F.count("*").alias("m"))
    base = F.log(F.greatest(F.col("m"), F.lit(2)))
    texts = each.groupBy("host", "path", "text").agg(F.count("*").alias("c"))
    texts = texts.groupBy("host", "path").agg(F.sum(F.col("c") * F.log("c")).alias("tl"), F.sum("c").alias("tn"))
    laid = blocks.select("host", F.inline(hashed("layout")))
    layouts = laid.groupBy("host", "path", "layout").agg(F.count("*").alias("c"))
    layouts = layouts.groupBy("host", "path").agg(F.sum(F.col("c") * F.log("c")).alias("ll"), F.sum("c").alias("ln"))
    at = ["host", "path"]
    tree = nodes.join(texts, at).join(layouts, at)
    return tree.select(*at, "m", F.least(F.lit(1.0), F.col("tl") / F.col("tn") / base).alias("evenness"),
                       F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.log("ln") - F.col("ll") / F.col("ln")) / base)).alias("layouts"))


def _branches(rows: pd.DataFrame) -> list[str]:
    """Paths to cut: the highest nodes of the tree where neither they nor any node below is important, judged on enough pages."""
    own = {p: (m, 1 - e, s) for p, m, e, s in zip(rows["path"], rows["m"], rows["evenness"], rows["layouts"])}
    every = {p.rsplit("/", k)[0] if k else p for p in own for k in range(p.count("/"))} - {""}
    children: dict[str, list[str]] = {}
    for p in every:
        children.setdefault(p.rpartition("/")[0], []).append(p)
    importance: dict[str, float] = {}
    highest: dict[str, float] = {}
    pages: dict[str, int] = {}
    for p in sorted(every, key=lambda p: -p.count("/")):
        below = children.get(p, [])
        m, content, layout = own.get(p, (0, 0.0, 0.0))
        pages[p] = max([m, *(pages[c] for c in below)])
        if below:
            decay = DECAY ** len(below)
            parts = [importance[c] for c in below] + [content] * (p in own)
            importance[p] = (1 - decay) * layout + decay * max(parts)
        else:
            importance[p] = content
        highest[p] = max([importance[p], *(highest[c] for c in below)])
    cut: list[str] = []
    for p in sorted(every, key=lambda p: p.count("/")):
        if highest[p] < LEAST and pages[p] >= MIN_PAGES and not any(p.startswith(c + "/") for c in cut):
            cut.append(p)
    return cut


def unimportant(tree: DataFrame) -> DataFrame:
    """``host`` and ``cut``, the paths of its branches to remove; a host's tree has as many rows as paths, not pages."""
    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "cut": [_branches(rows)]})

    return tree.groupBy("host").applyInPandas(judge, "host string, cut array<string>").where(F.size("cut") > 0)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def main_text(pages: DataFrame) -> DataFrame:
    """``text`` and ``n_chars`` (code points) of every page, beside page_id and url.

    Input: page_id, url, html. Null, empty and text-free html gives the empty text; a null or hostless url is a host of
    its own; repeated rows are pages of their own. Kept are the blocks in an article that the markup does not call noise;
    without an article those in the main element, without either those of the body; always outside the branches that the
    host's style tree of all blocks finds unimportant. An article or main element that would lose all its text keeps it.
    Blocks are joined by one line feed.
    """
    read = stored(candidates(page_blocks(pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html"))), "blocks", "zstd")
    own = small_side(stored(own_classes(read), "own"))
    labels = stored(shared_labels(read.select("host", "row", "blocks"), own), "labels", "zstd")
    low = small_side(stored(unimportant(style_tree(distinct_pages(labels))), "branches"))
    joined = shared_labels(read, own).join(low, "host", "left")
    standing = F.filter("blocks", lambda b: ~b["noise"] & (b["main"] == F.col("part")))
    blocks = F.zip_with(standing, "texts", lambda b, t: F.struct(b["path"].alias("path"), t.alias("text")))
    joined = joined.select("page_id", "url", blocks.alias("blocks"), "part", F.coalesce("cut", F.array().cast("array<string>")).alias("cut"))
    chosen = F.filter("blocks", lambda b: ~F.exists(
        "cut", lambda c: F.startswith(F.concat(b["path"], F.lit("/")), F.concat(c, F.lit("/")))))
    joined = joined.withColumn("chosen", F.when(F.size("cut") == 0, F.col("blocks")).otherwise(chosen))
    kept = F.when((F.size("chosen") == 0) & (F.col("part") != ""), F.col("blocks")).otherwise(F.col("chosen"))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return joined.select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))
