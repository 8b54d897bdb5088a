"""Main text of web pages by site template removal.

Each page's elements are built into a tree and each subtree is hashed. Spark counts, for each host, the distinct pages
on which a subtree's hash occurs; what recurs on many pages of its host is template and is deleted first, wherever in the
body it stands and whatever it calls itself. Of blocks of links the shape counts as well, since their words differ by page. The rest of the body is the
text. Prose inside an article or main element (paragraphs, headings, list items and so on) stays however often it
recurs: copies of an article on a host do not make it template. Of what is left, menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and comments that name themselves by tag, role or class go as well,
since adverts and readers' comments need not recur.

A host of fewer than LEAST_PAGES distinct pages shows no recurrence. There the text is that of the page's main part
(its article or main element, or else its body), without what names itself as something else.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by one
space; nothing else is dropped or capped. Null, empty and text-less pages give an empty text. A null or odd url counts
as a host of its own kind (the empty host). Rows of a host with the same html count as one page, so copies of a page do
not make its article template. Markup may be broken: open elements are closed as a browser would. Empty tables give
empty results. Extra columns stay, but input columns called text, n_chars or n_template give way to the results.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A subtree is template if it is on at least so many pages of its host and on this share of them.
LEAST_PAGES, LEAST_SHARE = 5, 0.1
#: Distinct recurring subtrees up to which the table of them is broadcast.
BROADCAST_ROWS = 200_000

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|([^\s=/>\"']+)", re.S)

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
DROPPED = frozenset("script style noscript template iframe svg math canvas object embed audio video map head title nav footer aside form button select option textarea input dialog menu menuitem xmp noembed noframes".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption table tr tbody thead tfoot dl ul ol".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSED_BY_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table div section article main body select td th".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets related recommended share sharing social comment comments disqus reply replies respond "
    "footer header masthead pagination pager toolbar login search skiplink".split()
)
NOT = frozenset("no with without has not".split())
KEPT = frozenset("html body main article".split())


class Node:
    __slots__ = ("tag", "names", "items", "parent", "dropped", "main")

    def __init__(self, tag: str, parent: Node | None, names: tuple[str, ...] = (), dropped: bool = False, main: bool = False):
        self.tag, self.parent, self.names, self.items, self.dropped, self.main = tag, parent, names, [], dropped, main


def boilerplate(tag: str, attributes: dict[str, str], names: tuple[str, ...]) -> bool:
    """Does an element name itself as something other than content?"""
    if tag in DROPPED:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return tag not in KEPT - {"article"}
    if attributes.get("role") in ROLES:
        return tag not in KEPT
    if tag in ("html", "body", "main"):
        return False
    for name in names:
        parts = [p for p in re.split(r"[-_]+", name) if p]
        if parts and not NOT & set(parts) and (parts[0] in NAMES or parts[-1] in NAMES):
            return tag not in INLINE or parts[0] in NAMES
    return False


def parse(text: str) -> Node:
    """The tree of a page. Text is kept undecoded between elements."""
    top = Node("#", None)
    at, here = 0, top
    low = None
    find = TOKEN.search
    while m := find(text, at):
        if m.start() > at:
            here.items.append(text[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            node = here
            while node is not top and node.tag != tag:
                node = node.parent
            if node is not top:
                here = node.parent
            continue
        raw = m[3] if m[2] else m[6]
        attributes, names = {}, ()
        if raw and not raw.isspace():
            attributes = {(a or c).lower(): references.unescape(b.strip("\"'")) for a, b, c in ATTRIBUTE.findall(raw)}
            names = tuple((attributes.get("class", "") + " " + attributes.get("id", "")).lower().split())
        if tag in CLOSES_P:
            node = here
            while node is not top and (node.tag == "p" or node.tag in INLINE):
                if node.tag == "p":
                    here = node.parent
                    break
                node = node.parent
        elif tag in CLOSED_BY_OWN:
            node = here
            while node is not top and (node.tag in CLOSED_BY_OWN[tag] or node.tag not in SCOPES):
                if node.tag in CLOSED_BY_OWN[tag]:
                    here = node.parent
                    if tag != "tr" or node.tag == "tr":
                        break
                node = node.parent
        if tag == "body" or tag in CLOSES_P:
            while here.tag == "head":
                here = here.parent
        node = Node(tag, here, names, boilerplate(tag, attributes, names), tag == "main" or attributes.get("role") == "main")
        if tag in VOID:
            if tag in ("br", "hr"):
                here.items.append(" ")
            continue
        here.items.append(node)
        if tag in RAW:
            if low is None:
                low = text.lower()
                if len(low) != len(text):  # a letter whose lower case is longer
                    low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
            end = low.find("</" + tag, at)
            if tag not in DROPPED:
                node.items.append(text[at : end if end >= 0 else len(text)])
            at = len(text) if end < 0 else (low.find(">", end) + 1 or len(text))
        elif not (raw or "").rstrip().endswith("/") or tag not in ("svg", "path"):
            here = node
    if at < len(text):
        here.items.append(text[at:])
    return top


def subtrees(top: Node) -> list[tuple[Node, int, int, int, int, bool]]:
    """(element, hash, shape hash, characters, characters in links, holds prose) of each element, children first."""
    out, known = [], {}
    stack = [(top, False)]
    while stack:
        node, seen = stack.pop()
        if not seen:
            stack.append((node, True))
            stack.extend((x, False) for x in node.items if isinstance(x, Node))
            continue
        content, shape, chars, linked, prose = [node.tag, *node.names], [node.tag, *node.names], 0, 0, node.tag in PROSE
        for x in node.items:
            if isinstance(x, Node):
                h, s, c, k, p = known[id(x)]
                content.append(str(h))
                if x.tag not in INLINE and shape[-1] != str(s):
                    shape.append(str(s))
                chars, linked, prose = chars + c, linked + k, prose or p
            elif words := x.split():
                content.append(" ".join(words))
                chars += sum(map(len, words))
        if node.tag == "a":
            linked = chars
        h, s = (xxhash.xxh64_intdigest("\x1f".join(x).encode("utf-8", "surrogatepass")) for x in (content, shape))
        known[id(node)] = h, s, chars, linked, prose
        out.append((node, h, s, chars, linked, prose))
    return out


def main_parts(top: Node) -> list[Node]:
    """The page's main elements: articles, those in a main element if there is one; else main; else everything."""

    def find(node: Node, wanted) -> list[Node]:
        out, stack = [], [node]
        while stack:
            x = stack.pop()
            if x.dropped:
                continue
            if x is not node and wanted(x):
                out.append(x)
            else:
                stack.extend(y for y in reversed(x.items) if isinstance(y, Node))
        return out

    mains = find(top, lambda x: x.main)
    return [a for m in mains or [top] for a in find(m, lambda x: x.tag == "article")] or mains or [top]


def removable(top: Node, parts: list[Node]) -> Iterator[tuple[Node, int, int]]:
    """Elements that are template if their hash recurs: containers and, outside the main part, anything but a line's
    inner markup. Of menus (mostly links) the shape counts as well, since their words differ by page. With their characters."""
    inside = {id(p) for p in parts if p is not top}
    above = set()
    for p in parts:
        while p is not None:
            above.add(id(p))
            p = p.parent
    within: dict[int, bool] = {}
    found = subtrees(top)
    for node, *_ in reversed(found):  # parents first
        within[id(node)] = id(node) in inside or (node.parent is not None and within.get(id(node.parent), False))
    for node, h, s, chars, linked, prose in found:
        if not chars or id(node) in above or node.tag in INLINE or node.tag in RAW or node.tag in ("html", "head", "body", "main", "article"):
            continue
        dense = 2 * linked > chars
        if within[id(node)] and prose and not dense:
            continue
        yield node, h, chars
        if dense and not within[id(node)]:
            yield node, s ^ 0x5BD1E995, chars


def within_main(node: Node) -> bool:
    while node is not None and not (node.main or node.tag == "article"):
        node = node.parent
    return node is not None


def delete_template(top: Node, gone: frozenset[int]) -> int:
    """Take the subtrees whose hash is in gone out of the page, whatever they are; returns the characters of their words."""
    deleted = {id(node): (node, chars) for node, h, chars in removable(top, main_parts(top)) if h in gone}
    out = 0
    for node, chars in deleted.values():
        above = node.parent
        node.parent.items = [x for x in node.parent.items if x is not node]
        while above is not None and id(above) not in deleted:
            above = above.parent
        out += chars if above is None else 0  # else counted with the subtree it is in
    return out


def text_of(parts: list[Node]) -> str:
    """White-space-normal text of the elements, without what names itself as something else."""
    out: list[str] = []
    for part in parts:
        stack: list = [part]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            if x.dropped and x is not part:
                continue
            if x.tag == "header" and x is not part:
                if part.tag in ("#", "body") and not within_main(x):
                    continue
                heads = [y for y in x.items if isinstance(y, Node) and y.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "div")]
                stack.extend([" ", *reversed(heads), " "])
                continue
            if x.tag in INLINE:
                stack.extend(reversed(x.items))
            else:
                stack.append(" ")
                stack.extend(reversed(x.items))
                stack.append(" ")
        out.append(" ")
    return " ".join(references.unescape("".join(out)).split())


def host_of(url: str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(pages: DataFrame) -> DataFrame:
    """host and gone, the hashes of its recurring subtrees, of hosts with LEAST_PAGES distinct pages or more.

    pages: host, html, weight (1 / rows of the host with this html), so that sums count distinct pages. A task sums its
    pages before the shuffle. A host has at most 1 / LEAST_SHARE times as many recurring hashes as a page has elements,
    so a host's list is bounded however many pages it has.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(host, h, w) for host, text, w in zip(b.host, b.html, b.weight, strict=True) if text for top in [parse(text)] for h in {np.uint64(h).astype(np.int64) for _, h, _ in removable(top, main_parts(top))}]
            yield pd.DataFrame(rows, columns=["host", "hash", "n"]).astype({"hash": "int64", "n": "float64"}).groupby(["host", "hash"], as_index=False).n.sum()

    found = pages.select("host", "html", "weight").mapInPandas(count, "host string, hash long, n double")
    seen = found.groupBy("host", "hash").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_PAGES - 1e-6)
    sizes = common.settle(pages.groupBy("host").agg(F.round(F.sum("weight")).alias("pages")).where(F.col("pages") >= LEAST_PAGES))
    gone = seen.join(sizes, "host").where(F.col("n") >= LEAST_SHARE * F.col("pages") - 1e-6).groupBy("host").agg(F.collect_list("hash").alias("gone"))
    return sizes.join(gone, "host", "left").select("host", F.coalesce("gone", F.array().cast("array<bigint>")).alias("gone"))


def main_text(text: str | None, gone: frozenset[int] | None) -> tuple[str, int]:
    """The text of a page, and the characters that went with its host's template; gone is None where the host shows none."""
    if not text:
        return "", 0
    top = parse(text)
    if gone is None:
        return text_of(main_parts(top)), 0
    deleted = delete_template(top, gone)
    return text_of([top]), deleted


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with text, n_chars (code points) and n_template (characters of words that recurrence on the host removed)."""
    common.small_batches(pages.sparkSession)
    row = F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("_row")
    text = F.col(f"`{html}`")
    hosted = pages.select(row, host_of(url).alias("_host"), F.xxhash64(text).alias("_digest"))
    copies = hosted.groupBy("_host", "_digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    weighed = common.join_measured(hosted, copies, ["_host", "_digest"], "left")
    known = templates(weighed.select(F.col("_host").alias("host"), F.col("_row")[html].alias("html"), (1.0 / F.coalesce("_n", F.lit(1))).alias("weight")))
    joined = common.join_measured(hosted, known.withColumnRenamed("host", "_host"), ["_host"], "left", BROADCAST_ROWS // 10)

    @F.pandas_udf("text string, n_template long")
    def read(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out, sets = [], {}
        for own, hashes in zip(texts, gone, strict=True):
            bad = None
            if hashes is not None and (bad := sets.get(key := hashes.tobytes())) is None:
                bad = sets[key] = frozenset(hashes.astype(np.uint64).tolist())
            out.append(main_text(own, bad))
        return pd.DataFrame(out, columns=["text", "n_template"])

    done = joined.select("_row", read(F.col("_row")[html], F.col("gone")).alias("_read"))
    kept = [F.col("_row")[c].alias(c) for c in pages.columns if c not in ("text", "n_chars", "n_template")]
    found = F.col("_read.text")
    return done.select(*kept, found.alias("text"), F.length(found).cast("long").alias("n_chars"), F.col("_read.n_template").alias("n_template"))
