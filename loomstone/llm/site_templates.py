"""Main text of web pages, without what a site's template repeats.

A page is read by a tolerant tokeniser into elements; each element's subtree (tags, attributes, text) has a
64-bit hash. Spark counts for every host the different pages (by the hash of their main text) on which a
subtree occurs. A subtree is template if it recurs on at least ``least`` different pages of its host, and
on ``share`` of them or, unless it is a paragraph or heading, on ``many``, so that a section of a large host is
found as well. Inside the page's article (article, main, or role main) ``inner`` of the pages are asked for, as
articles of a site share passages too: that goes for paragraphs and all other elements but headings and inline ones,
which belong to the text around them. Beside that, elements that are no content by their nature are
deleted on every page: by tag (nav, header, footer, aside, form, script, style, ...), or by a word of class,
id or role (ad, menu, sidebar, cookie, comments, ...), or as a form. Names of layout ("has-sidebar") don't count, in an article
only names that consist of such words do ("share-buttons", not "social-history"), elsewhere such words must end or lead the name.
A wrapper named like this, or a form, gives way if the only article is inside of it, or if it holds more than half of the page's text and that mostly
outside of links; names of comments, notices, adverts or menus never do.

The text is the article's if there is one, else the body's: character references decoded, white space
inside a block made one space, blocks trimmed, empty ones dropped, joined by one space.

Keys of templates go to the workers as sorted arrays while there are at most ``most_keys`` (8 bytes each);
beyond that, every page's own template keys are joined to it by page. Both ways give the same texts.
Null and empty pages have the text "". A null url is a host of its own. Rows with equal page_id and
html are alike.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import Steps
from .common import map_slices

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
DROP = frozenset("head nav header footer aside script style noscript iframe template svg math canvas object embed audio video button select option textarea input dialog menu label fieldset title meta link base".split())
BLOCK = frozenset("address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
MAIN = frozenset(("article", "main"))
#: Opening one of the first closes an open one of the second, up to the nearest of the third.
CLOSES = {**{t: ({"p"}, {"button", "table", "td"}) for t in BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "summary", "html", "body"}}, "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
NOISE = frozenset(
    "ad ads adv advert advertisement advertisements adsense adslot banner sponsor sponsored promo promotion promoted popup modal overlay cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager sidebar side aside footer header masthead topbar toolbar widget widgets share sharing social related recommended recommendations comment comments disqus reply replies respond search searchbox contentinfo complementary".split()
)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z0-9]+")


# Words beside those of NOISE in names of such elements, of layout states, and names of comments.
GENERIC = frozenset("box block area list section container wrapper wrap bar item items panel link links inner outer top bottom left right button buttons form slot unit text title group col column row banner inline count thread icon icons post page site main global primary secondary sticky".split())
LAYOUT = frozenset("has with no without is not hide show".split())
COMMENTS = frozenset("comment comments reply replies respond disqus".split())
INLINE = frozenset("h1 h2 h3 h4 h5 h6 b i em strong br span a".split())


#: Words of NOISE that also name places of a layout, which may turn out to hold the page's text.
PLACES = frozenset("sidebar side aside header masthead topbar toolbar footer widget widgets related social banner promo complementary".split())
#: Words that make a name one of such elements wherever they lead.
LEADING = frozenset("ad ads advert adsense cookie cookies gdpr newsletter sponsored".split())


def noisy(names: str, inside: bool) -> bool:
    """Whether a class, id or role names no content: all its words do; or, outside of an article, its last telling word or a leading one does.

    So "share-buttons" and "site-footer" do, "widgets-explained" and "related-none" don't."""
    for token in names.split():
        words = _WORD.findall(token)
        if any(w in NOISE for w in words) and words[0] not in LAYOUT:
            telling = [w for w in words if w not in GENERIC and not w.isdigit()]
            if all(w in NOISE for w in telling) or not inside and (words[0] in LEADING or telling[-1] in NOISE):
                return True
    return False


class Node:
    """An element: ``noise`` by its tag or as hidden, ``soft`` by its names or as a form; ``firm`` if it is so whatever it holds."""

    __slots__ = ("tag", "attrs", "kids", "noise", "soft", "firm", "main", "key", "parent", "inside")

    def __init__(self, tag: str, attrs: str, parent: "Node | None"):
        self.tag, self.attrs, self.parent, self.kids, self.key = tag, attrs, parent, [], 0
        self.noise, self.soft, self.firm, self.main = tag in DROP, tag == "form", False, tag in MAIN
        self.inside = parent is not None and (parent.inside or parent.main)
        if attrs and not self.noise:
            for m in _ATTR.finditer(attrs):
                name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if name == "hidden" or name == "aria-hidden" and value == "true":
                    self.noise = True
                elif name == "role" and value == "main":
                    self.main = True
                elif name in ("hidden", "aria-hidden") or tag in ("html", "body"):
                    continue
                elif tag in MAIN:
                    self.firm |= any(w in COMMENTS for w in _WORD.findall(value))
                    self.soft |= self.firm
                elif noisy(value, self.inside):
                    self.soft = True
                    self.firm |= any(w in NOISE and w not in PLACES for w in _WORD.findall(value))


def parse(source: str) -> Node:
    """Tree of a page. Kids are nodes and decoded texts; ends without a start are ignored, open elements end with their parent."""
    root = at = Node("", "", None)
    pos, depth_tags = 0, {}
    raw_end: dict[str, re.Pattern] = {}
    while True:
        m = _TAG.search(source, pos)
        text = source[pos : m.start() if m else len(source)]
        if text:
            at.kids.append(entities.unescape(text) if "&" in text else text)
        if not m:
            return root
        pos = m.end()
        if m["cdata"]:
            at.kids.append(m["cdata"])
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if depth_tags.get(tag, 0):
                while at.tag != tag:
                    depth_tags[at.tag] -= 1
                    at = at.parent
                depth_tags[tag] -= 1
                at = at.parent
            continue
        if tag in CLOSES:
            close, stop = CLOSES[tag]
            if any(depth_tags.get(c, 0) for c in close):
                n, hit = at, None
                while n.parent is not None and n.tag not in stop:
                    if n.tag in close:
                        hit = n
                        break
                    # Only inline elements may stand between, so that a block's own paragraphs close alone.
                    if n.tag in BLOCK and n.tag not in close:
                        break
                    n = n.parent
                if hit is not None:
                    while True:
                        depth_tags[at.tag] -= 1
                        last, at = at, at.parent
                        if last is hit:
                            break
        node = Node(tag, m["attrs"].strip(), at)
        at.kids.append(node)
        if tag in VOID or m["attrs"].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = raw_end.setdefault(tag, re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I)).search(source, pos)
            node.kids.append(source[pos : end.start() if end else len(source)])
            pos = end.end() if end else len(source)
            continue
        at = node
        depth_tags[tag] = depth_tags.get(tag, 0) + 1


def walk(root: Node) -> list[Node]:
    """All elements, parents first; no recursion, as pages may nest deeply."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(k for k in reversed(n.kids) if not isinstance(k, str))
    return out


def hash_subtrees(root: Node, host: str) -> list[Node]:
    """The elements in document order; key is the hash of host and subtree."""
    order = walk(root)
    seed = xxhash.xxh3_64_intdigest(host.encode("utf-8", "surrogatepass"))
    for n in reversed(order):
        h = xxhash.xxh3_64(f"{n.tag} {n.attrs}".encode("utf-8", "surrogatepass"), seed)
        for k in n.kids:
            h.update(" ".join(k.split()).encode("utf-8", "surrogatepass") if isinstance(k, str) else k.key.to_bytes(8, "little"))
        n.key = h.intdigest()
    return order


def settle(order: list[Node]) -> None:
    """Soft elements that hold more than half of a page's text, most of it outside of links, are its layout, not noise.

    Firm ones (comments, notices, adverts, menus) stay noise, however long, and text in these isn't weighed."""
    size: dict[int, tuple[int, int]] = {}
    for n in reversed(order):
        if n.noise or n.firm:
            size[id(n)] = (0, 0)
            continue
        own = sum(len(" ".join(k.split())) for k in n.kids if isinstance(k, str))
        kids = [size[id(k)] for k in n.kids if not isinstance(k, str)]
        whole = own + sum(k for k, _ in kids)
        size[id(n)] = (whole, whole if n.tag == "a" else sum(k for _, k in kids))
    whole = size[id(order[0])][0]
    for n in order:
        if n.soft and not n.firm:
            held, linked = size[id(n)]
            n.soft = not (2 * held > whole and 2 * linked <= held)


def main_nodes(order: list[Node]) -> list[Node]:
    """The articles that hold the page's content: of the outermost ones outside of noise those in the fewest soft elements;
    without any, the root."""
    found: list[tuple[int, Node]] = []
    depth: dict[int, int] = {}  # soft elements around what may hold an article
    for n in order:
        if n.parent is not None and id(n.parent) not in depth or n.noise:
            continue
        soft = (depth[id(n.parent)] if n.parent is not None else 0) + n.soft
        if n.main:
            found.append((soft, n))
        else:
            depth[id(n)] = soft
    least = min((soft for soft, _ in found), default=0)
    return [n for soft, n in found if soft == least] or order[:1]


def blocks(nodes: list[Node], dropped, soft: bool = True) -> list[str]:
    """Texts of the blocks below the nodes, without noise (soft noise too, as told) and elements that ``dropped`` names."""
    out: list[str] = []
    part: list[str] = []

    def flush():
        if part:
            text = " ".join("".join(part).split())
            if text:
                out.append(text)
            part.clear()

    for top in nodes:
        todo: list = [(top, False)]
        while todo:
            n, ends = todo.pop()
            if isinstance(n, str):
                part.append(n)
            elif ends:
                flush()
            elif n is top or not (n.noise or soft and n.soft or dropped(n)):
                if n.tag in BLOCK:
                    flush()
                    todo.append((n, True))
                todo.extend((k, False) for k in reversed(n.kids))
            elif n.tag in BLOCK:  # what is left out still parts the texts around it
                flush()
        flush()
    return out


def main_text(nodes: list[Node], dropped) -> str:
    """The text of the blocks; soft noise stays if there is no other text."""
    return " ".join(blocks(nodes, dropped) or blocks(nodes, dropped, soft=False))


def host_of(url) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", url) if isinstance(url, str) else None
    return m[1].rpartition("@")[2].lower() if m else ""


def page(source, url):
    order = hash_subtrees(parse(source if isinstance(source, str) else ""), host_of(url))
    settle(order)
    return order, main_nodes(order)


def candidates(order: list[Node], mains: list[Node]) -> tuple[set[int], int]:
    """Keys of the content's subtrees that aren't deleted anyway, and the hash of its text."""
    whole = xxhash.xxh3_64_intdigest(main_text(mains, lambda n: False).encode("utf-8", "surrogatepass"))
    inner, keys = {id(n) for n in mains}, set()
    for n in order:
        if n.parent is not None and id(n.parent) in inner and not (n.noise or n.soft):
            inner.add(id(n))
            keys.add(n.key)
    return keys, whole


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _counted(batches):
    """(host, key, page, article, kind) of the content's subtrees for each different page of a slice, and the page itself (kind 0).

    Kind 1 is for paragraphs, headings and inline elements, 2 for others."""
    for batch in batches:
        rows = set()
        for source, url in zip(batch["html"], batch["url"]):
            order, mains = page(source, url)
            inside, whole = candidates(order, mains)
            host, whole = _signed(xxhash.xxh3_64_intdigest(host_of(url).encode("utf-8", "surrogatepass"))), _signed(whole)
            article = mains[0] is not order[0]
            rows.update((host, _signed(n.key), whole, article, 1 if n.tag == "p" or n.tag in INLINE else 2) for n in order if n.key in inside and not n.noise)
            rows.add((host, 0, whole, article, 0))
        yield pd.DataFrame(list(rows), columns=["host", "key", "page", "article", "kind"])


def templates(pages: DataFrame, step: Steps, least: int = 8, share: float = 0.3, inner: float = 0.6, many: int = 200) -> DataFrame:
    """(key, article): subtrees to delete, in pages with and without an article."""
    rows = map_slices(pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), _counted, "host long, key long, page long, article boolean, kind int")
    # The distinct rows are dealt by all columns, and the counts after them are partial sums, so no subtree is one task's work.
    sliced = rows.distinct().groupBy("host", "key", "article", "kind").agg(F.count("*").alias("n"))
    sliced = step(sliced.where(f"kind = 0 or n >= {least}"), "subtrees")
    hosts = sliced.where("kind = 0").select(F.col("host").alias("h"), F.col("article").alias("a"), F.col("n").alias("pages"))
    hit = sliced.where("kind > 0").join(hosts, (F.col("host") == F.col("h")) & (F.col("article") == F.col("a")))
    asked = F.when(F.col("article"), inner * F.col("pages")).when(F.col("kind") == 1, share * F.col("pages")).otherwise(F.least(share * F.col("pages"), F.lit(many)))
    return hit.where(F.col("n") >= asked).select("key", "article").distinct()


def _is_template(node: Node, keys: set[int] | frozenset, article: bool) -> bool:
    return node.key in keys and not (article and node.tag in INLINE)


def _extract(keys_of):
    def run(batches):
        for batch in batches:
            texts = []
            for k, (source, url) in enumerate(zip(batch["html"], batch["url"])):
                order, mains = page(source, url)
                article = mains[0] is not order[0]
                keys = keys_of(batch, k, article)
                texts.append(main_text(mains, (lambda n: _is_template(n, keys, article)) if keys else (lambda n: False)))
            yield pd.DataFrame({"page_id": batch["page_id"].to_numpy(), "url": batch["url"].to_numpy(), "text": texts, "n_chars": [len(t) for t in texts]})

    return run


def _from_arrays(arrays: dict[bool, np.ndarray]):
    """Keys by whether a page has an article; the sets are made in the worker."""
    sets: dict[bool, frozenset] = {}

    def keys_of(batch, k, article):
        if article not in sets:
            sets[article] = frozenset(arrays[article].view(np.uint64).tolist())
        return sets[article]

    return keys_of


def extract(pages: DataFrame, most_keys: int = 1_000_000, **limits) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages."""
    step = Steps(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = step(templates(rows, step, **limits), "templates")
    step.drop_all_but(found)
    shape = "page_id long, url string, text string, n_chars long"
    if found.count() <= most_keys:
        table = found.toArrow()  # columns, no row objects
        key, article = table["key"].to_numpy(), table["article"].to_numpy()
        arrays = {flag: np.sort(key[article == flag]) for flag in (True, False)}
        return map_slices(rows, _extract(_from_arrays(arrays)), shape)
    marked = rows.withColumn("digest", F.xxhash64("url", "html"))
    own = map_slices(marked, _page_keys, "page_id long, digest long, key long, article boolean").distinct().join(found, ["key", "article"])
    own = own.groupBy("page_id", "digest").agg(F.collect_set("key").alias("keys")).withColumnsRenamed({"page_id": "p", "digest": "d"})
    joined = marked.join(own, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").drop("p", "d")
    listed = lambda batch, k, article: frozenset(int(x) & (2**64 - 1) for x in (batch["keys"].iloc[k] if batch["keys"].iloc[k] is not None else ()))
    return map_slices(joined, _extract(listed), shape)


def _page_keys(batches):
    for batch in batches:
        rows = []
        for pid, digest, source, url in zip(batch["page_id"], batch["digest"], batch["html"], batch["url"]):
            order, mains = page(source, url)
            rows += [(pid, digest, _signed(k), mains[0] is not order[0]) for k in candidates(order, mains)[0]]
        yield pd.DataFrame(rows, columns=["page_id", "digest", "key", "article"])
