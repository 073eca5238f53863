"""Main-text extraction with site style trees.

Pages of one host are merged into a style tree: a node is the path of presentation styles (tag,
classes, id) from the root. For each node the counts over the host's pages of (a) the sequences of child styles
and (b) the texts below it are aggregated, and their entropies, divided by that of all different
pages, give the importance of its presentation and of its content. Both are drawn towards 1 as if PRIOR more pages differed, so that few
pages say little. A branch that nearly every page repeats has low importance and is removed from each page.

Two kinds of knowledge come before the entropies: elements that are never main text by their meaning (scripts,
navigation, footers, forms, classes that are made of words such as "ad" or "comments" and of none with a meaning of its own, articles that are
comments) have importance 0, as what they hold may differ on every page. All other
branches are judged by the tree, inside and outside of articles and main elements. These are only a prior: where a page has no
important one, a repeated one stays as it is, as copies of an article are no template. All walks are loops, so that markup may be nested to any depth.

Only per-node sums are shuffled, pre-aggregated by each task; a hot host weighs no more than its number of
different nodes and texts. The removed nodes of a host are joined by host, broadcast if measured to be small.

Defined results: null or empty html gives an empty text; without tags the whole html is one block; markup
cut off at the end of a page is dropped; repeated pages are treated alike; null or broken urls have no
host and are cleaned by meaning only; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, isolated, written

#: Pages that are taken to differ besides those seen. With them a node needs five equal pages to fall below THRESHOLD.
PRIOR = 1.6
THRESHOLD = 0.25
GAMMA = 0.9
LOW_BROADCAST = 32 << 20
SALTS = 32

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*?)(/?)>|<[!?][^>]*(?:>|$)|</?[a-zA-Z][^>]*$|</?$", re.S)
_NAMED = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes")}

#: Fixed values of the HTML standard: elements without content, and elements that break a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup"}
CLOSED_BY_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
#: Elements that hold no main text by their meaning.
NEVER = frozenset("head script style noscript template iframe object svg canvas nav footer aside form button select textarea input label dialog menu title".split())
#: Words of names of page furniture.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion promotions banner banners nav navs navbar navigation menu menus breadcrumb breadcrumbs sidebar footer foot header masthead "
    "topbar toolbar cookie cookies consent gdpr notice notices popup popups modal overlay newsletter subscribe subscription signup login share shares sharing social related recommend recommended recommendation recommendations comment comments "
    "commentlist disqus reply replies respond pagination pager widget widgets copyright legal search skip hidden sr".split()
)
#: Words that add no meaning of their own to such a name.
NEUTRAL = frozenset(
    "area articles bar block body bottom box boxes button buttons by child column container content crumbs desktop fixed follow form global group holder icon icons inner item items js last layer left level line link links list lists main mobile more of only outer "
    "page panel parent posts primary right row secondary section side site slot small sticky stories sub the this to top trail unit us user view wide wrap wrapper".split()
)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
LANDMARKS = frozenset(("article", "main"))
#: Class of an article that is a comment.
COMMENT = re.compile(r"(?:^|\s)(?:user-?)?(?:comments?|repl(?:y|ies))(?:[_-]\w+)*(?:$|\s)", re.I)


class Node:
    __slots__ = ("tag", "style", "parent", "children", "items", "never", "key", "mass")

    def __init__(self, tag, style, parent, never):
        self.tag, self.style, self.parent, self.never = tag, style, parent, never
        self.children: list[Node] = []
        self.items: list = []  # texts and child nodes in page order
        self.key, self.mass = 0, 0


@lru_cache(maxsize=100_000)
def furniture(value: str) -> bool:
    """Whether one of the names in a class or id is made of FURNITURE, and at most of NEUTRAL words besides."""
    for name in value.split():
        parts = {x.lower() for x in _PART.findall(name)}
        if parts & FURNITURE and parts <= FURNITURE | NEUTRAL:
            return True
    return False


def _style(tag: str, attributes: str) -> tuple[str, bool]:
    """The presentation style of an element and whether its names say that it is no main text."""
    never = tag in NEVER
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return tag, never
    style = tag
    for name, a, b, c in _NAMED.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            style += ("." if name == "class" else "#") + re.sub(r"\d+", "", value)
            never = never or tag == "article" and name == "class" and bool(COMMENT.search(value))
            never = never or tag not in ("html", "body", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6") and furniture(value)
        elif name == "role":
            never = never or value.lower() in ROLES
        elif name == "style":
            never = never or "display:none" in value.replace(" ", "").lower()
        else:
            never = never or name == "hidden" or value.lower() == "true"
    return style, never


def parse(html: str) -> Node:
    """A forgiving parser: implied end tags, raw text elements, unclosed and cut-off markup."""
    root = now = Node("#root", "", None, False)
    at, end = 0, len(html)
    while at < end:
        found = _TOKEN.search(html, at)
        text = html[at : found.start() if found else end]
        if text:
            now.items.append(text)
        if found is None:
            break
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            node = now
            while node is not root and node.tag != tag:
                if tag == "p" and node.tag in BLOCK and node.tag != "p":
                    node = root  # an end tag of a paragraph doesn't reach out of its block
                    break
                node = node.parent
            if node is not root:
                now = node.parent
            continue
        if tag in CLOSES_P:
            node = now
            while node is not root and node.tag != "p" and node.tag not in ("button", "table", "td", "th", "object"):
                node = node.parent
            if node.tag == "p":
                now = node.parent
        if tag in CLOSED_BY_SAME:
            node, scope = now, CLOSED_BY_SAME[tag]
            same = (tag,) if tag not in ("dt", "dd", "td", "th") else ("dt", "dd") if tag[0] == "d" else ("td", "th")
            while node is not root and node.tag not in same and node.tag not in scope:
                node = node.parent
            if node.tag in same:
                now = node.parent
        if tag == "body":
            while now is not root and now.tag != "html":
                now = now.parent
        style, never = _style(tag, found[3])
        if tag == "header":
            node = now
            while node is not root and node.tag not in LANDMARKS:
                node = node.parent
            never = never or node is root
        node = Node(tag, style, now, never)
        now.children.append(node)
        now.items.append(node)
        if tag in _RAW_END:
            close = _RAW_END[tag].search(html, at)
            node.items.append(html[at : close.start() if close else end])
            at = close.end() if close else end
        elif tag not in VOID and not (found[4] and tag in ("svg", "path")):
            now = node
    return root


def _hash(value: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(value) - (1 << 63)


def walked(root: Node) -> list[Node]:
    """All nodes, parents first, in page order; each gets the key of its path of styles."""
    import xxhash

    order, stack = [], [root]
    while stack:
        node = stack.pop()
        node.key = xxhash.xxh3_64_intdigest(node.style, node.parent.key if node.parent is not None else 0)
        order.append(node)
        stack += reversed(node.children)
    return order


def features(root: Node):
    """(path, children's styles, content) hashes of every block with text; scripts and the like have none."""
    import xxhash

    out = []
    for node in reversed(walked(root)):
        parts = []  # of the content: runs of text without their white space, and children with text
        for x in node.items:
            if isinstance(x, Node):
                if x.mass and x.tag not in _RAW_END:
                    parts.append(x.mass)
            elif run := " ".join(x.split()):
                parts.append(xxhash.xxh3_64_intdigest(run) | 1)
        node.mass = 0 if not parts else parts[0] if len(parts) == 1 else xxhash.xxh3_64_intdigest(np.array(parts, dtype=np.uint64).tobytes()) | 1
        if node.mass and node.parent is not None and node.tag in BLOCK:
            out.append((_signed(node.key), _hash("|".join(c.style for c in node.children)), _signed(node.mass)))
    return out


def _signed(key: int) -> int:
    return key - (1 << 63)


def main_text(root: Node, low: frozenset | set, only_landmarks: bool = True) -> str:
    """Blocks of what is left, white space collapsed, joined by line ends.

    ``only_landmarks`` takes nothing outside of the page's articles or main elements, if it has one; :func:`extract` judges the whole page.
    """
    blocks: list[str] = []
    line: list[str] = []
    walked(root)

    def end_block() -> None:
        if line:
            text = " ".join(unescape("".join(line)).split())
            if text:
                blocks.append(text)
            line.clear()

    found, stack = [], [root]  # the outermost landmarks
    while stack:
        node = stack.pop()
        if node.tag in LANDMARKS and not node.never:
            found.append(node)
        elif not node.never:
            stack += reversed(node.children)
    repeated = {node for node in found if _signed(node.key) in low}
    unjudged = repeated if len(repeated) == len(found) else set()
    stays = unjudged or set(found) - repeated
    around: set[Node] = set()
    for node in stays:
        while node.parent is not None and node.parent not in around:
            around.add(node := node.parent)

    def entered(node: Node, judged: bool):
        """What is left to write of a node: its items, whether they are judged, whether it is gone but for its landmarks, whether it is a block."""
        if node.never:
            return None
        judged = judged and node not in unjudged
        gone = judged and node.parent is not None and _signed(node.key) in low
        if gone and node not in around:
            return None
        if node.tag in BLOCK:
            end_block()
        return iter(node.items), judged, gone, node.tag in BLOCK

    def write(start: Node) -> None:
        open_ = [first] if (first := entered(start, True)) else []
        while open_:
            items, judged, gone, block = open_[-1]
            for item in items:
                if not isinstance(item, Node):
                    if not gone:
                        line.append(item)
                elif gone and item not in stays and item not in around:
                    continue  # of a repeated branch only the landmarks that stay are left
                elif item.tag in ("br", "wbr"):
                    line.append(" " if item.tag == "br" else "")
                elif inner := entered(item, judged):
                    open_.append(inner)
                    break
            else:
                open_.pop()
                if block:
                    end_block()

    for start in found if found and only_landmarks else [root]:
        write(start)
        end_block()
    return "\n".join(blocks)


def host(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _features():
    from collections import Counter

    def run(batches):
        held: Counter = Counter()

        def flush():
            rows = list(zip(*((*k, n) for k, n in held.items()), strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), *(pa.array(c, pa.int64()) for c in rows[1:])], ["host", "kind", "path", "value", "n"])

        for batch in batches:
            for site, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for path, children, text in set(features(parse(html))):
                    held[site, 0, path, children] += 1
                    held[site, 1, path, text] += 1
                if len(held) > 300_000:
                    yield flush()
        if held:
            yield flush()

    return run


def node_importance(pages: DataFrame) -> DataFrame:
    """(host, path, pages, presentation, content, importance) of the style tree's nodes."""
    counted = pages.where("host <> '' AND html IS NOT NULL").select("host", "html").mapInArrow(_features(), "host string, kind long, path long, value long, n long")
    values = counted.groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"))
    entropy = F.ln(F.sum("n").cast("double")) - F.sum(F.col("n") * F.ln(F.col("n").cast("double"))) / F.sum("n")
    kinds = values.groupBy("host", "path", "kind").agg(F.sum("n").alias("pages"), entropy.alias("entropy"))
    share = F.when(F.col("pages") > 1, F.greatest(F.lit(0.0), F.col("entropy")) / F.ln(F.col("pages").cast("double"))).otherwise(0.0)
    scaled = kinds.withColumn("share", share)
    both = scaled.groupBy("host", "path").agg(F.max("pages").alias("pages"), F.max(F.when(F.col("kind") == 0, F.col("share"))).alias("presentation"), F.max(F.when(F.col("kind") == 1, F.col("share"))).alias("content"))
    seen = (1 - GAMMA) * F.col("presentation") + GAMMA * F.col("content")
    return both.withColumn("importance", (F.col("pages") * seen + F.lit(PRIOR)) / (F.col("pages") + F.lit(PRIOR)))


def _extracted():
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(parse(html), frozenset(low or ()), False) if html else "" for html, low in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return one


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""
    own = isolated(pages, page_id="page_id", url="url", html="html")
    named = own.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host().alias("host"))
    low = written(node_importance(named).where(F.col("importance") < threshold).select("host", "path"), "low-importance")
    by_host = low.groupBy("host").agg(F.collect_set("path").alias("low"))  # a host's different repeated nodes, however many its pages
    size = low.agg(F.sum(F.octet_length("host") + 16)).first()[0] or 0
    if size <= LOW_BROADCAST:
        joined = named.join(F.broadcast(by_host), "host", "left")
    else:
        # A host may have a third of all pages: each is met in SALTS parts.
        salted = named.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        joined = salted.join(by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")
    return arrow_map(joined.select("page_id", "url", "html", "low"), _extracted, "page_id long, url string, text string, n_chars long")


def op4(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
