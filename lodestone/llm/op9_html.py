"""Main text of web pages by a site style tree.

1. Every page is parsed into a tree of block elements, whose nodes are named by host and path (tag, class,
   id, role, and place among its like). Pages of one host so merge into one tree, held as a table.
2. A node's presentation importance is the entropy of the styles (rows of child elements, repeats taken as
   one) that its pages show there; its content importance is the mean, over the texts below it, of one less
   the entropy with which the text is spread over pages; both to the base of the number of its pages. Leaves
   have the second only; other nodes mix the two by DECAY to the power of their number of styles. Exact
   copies of a page count as one page; a node of one page has importance 1.
3. The tree's weight of a node is that importance times its relative importance: how much of its text
   repeats over pages (one less its content importance) against the best of its siblings, both with one part
   in its number of pages added, so that few pages prove little. A bar with texts from a pool of hundreds has
   so a low weight beside an article, on a host of any size.
4. Every branch of every page has that weight times a prior from its markup: NOISE if it is a menu, header,
   footer, aside, form, advert, notice or comment by tag, role, class or id, or stands outside the article that
   the page declares; 1 otherwise; prose inside a declared article, the article and what it stands in are kept.
   Branches below LEAST are removed. The states of a layout (has-sidebar, comments-open) are no names of
   noise, and no class name on what holds a declared article removes it, but those of comments and teasers do.

The tree is never collected: counts are aggregated by node and text, with partial sums in each task, and only
the names of nodes with a low weight leave the cluster, as sorted hashes, if there are at most MAX_BROADCAST of
them; otherwise each page's nodes meet them in a shuffled join. Nodes of fewer than MIN_PAGES pages have their
prior alone: on two pages a copied article looks like a bar.

Defined results: null, empty and textless pages have an empty text and 0 characters; a null url is a host of
its own name; page ids may repeat or be null; pages cut off anywhere are read as if their elements ended
there; extra columns stay, those that clash with text or n_chars are replaced; no pages, no rows.
"""

import html as _html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import col, give_back, packed, read_table, stored, unpacked, with_own

NAME = "op9_site_style_tree"
DECAY = 0.9
#: Branches of less weight go; the prior of branches that their markup tells to be noise.
LEAST, NOISE = 0.3, 0.25
MIN_PAGES = 3
#: Names of low weight that go to every worker, eight bytes each.
MAX_BROADCAST = 1 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript template xmp noembed noframes".split())
#: Elements inside a line of text: they neither end a block nor make a node, unless they are declared noise.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
NOISE_TAGS = frozenset("nav header footer aside form script style head noscript template iframe button select textarea dialog menu object svg video audio canvas".split())
#: Inside an article these are its own heading, not the site's.
SITE_TAGS = frozenset(["header"])
#: Parts of a class or id that name noise: those of layout, and those that hold whole articles of others.
LAYOUT_NAMES = frozenset(
    "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar "
    "footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription share sharing social login signin signup "
    "pagination pager widget toolbar skip skiplink tracking".split()
)
OTHERS_NAMES = frozenset("comment comments commentlist disqus respond replies reply related recommended teaser teasers".split())
#: With one of these beside it, a name tells the page's state, not what the element is.
STATES = frozenset("has no not with without is open closed enabled disabled active inactive on off left right top bottom count allowed".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ROOT_NAMES = re.compile(r"(?:^|\s)(?:articleBody)(?:$|\s)")
#: A start tag of one of these ends an open paragraph.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WALLS = frozenset("html body table td th ul ol dl div article main section nav aside header footer form".split())
_JUDGED_INSIDE = frozenset(["div", "section"])


def named(attribute: str) -> str:
    """What a class or id tells of its element: "others", "layout" or nothing."""
    found = ""
    for token in attribute.lower().split():
        parts = set(re.split(r"[-_]+|(?<=[a-z])\d+$", token.replace("side-bar", "sidebar"))) - {"", None}
        if not parts & STATES:
            if parts & OTHERS_NAMES:
                return "others"
            if parts & LAYOUT_NAMES:
                found = "layout"
    return found

_MARK = re.compile(r"""<(?:!--(?:.*?-->|.*)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(>?)|[!?/][^>]*>?)""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Page:
    """Block nodes of a page, and its blocks of text in order, each with its node; node 0 is the page itself."""

    def __init__(self, source: str, host: str):
        self.tag, self.parent, self.name = ["#page"], [-1], [xxhash.xxh64_intdigest(host)]
        #: own: what markup tells of a node: "" nothing, "tag" (or role), "form", "layout", "others"; root: whether it declares an article.
        self.own, self.root, self.kids, self.style = [""], [False], [{}], [[]]
        self.blocks = []
        self._read(source)
        self._priors()

    @staticmethod
    def _attrs(attrs: str) -> dict:
        found = {}
        if attrs.strip():
            for m in _ATTR.finditer(attrs):
                if (k := m[1].lower()) in ("class", "id", "role", "itemprop", "hidden"):
                    found.setdefault(k, _html.unescape(m[2] or m[3] or m[4] or ""))
        return found

    @staticmethod
    def _told(tag: str, found: dict) -> str:
        role = found.get("role", "").lower()
        if "hidden" in found or role in NOISE_ROLES or tag in NOISE_TAGS and tag != "form":
            return "tag"
        if tag in ("html", "body", "main"):
            return ""
        told = {named(found[k]) for k in ("class", "id") if k in found}
        return "others" if "others" in told else "layout" if "layout" in told and tag != "article" else "form" if tag == "form" else ""

    def _node(self, parent: int, tag: str, found: dict) -> int:
        kind = tag + "".join(f"|{k}={found[k]}" for k in ("class", "id", "role") if k in found)
        k = self.kids[parent].get(kind, 0)
        self.kids[parent][kind] = k + 1
        if not self.style[parent] or self.style[parent][-1] != kind:
            self.style[parent].append(kind)
        self.tag.append(tag)
        self.parent.append(parent)
        self.name.append(xxhash.xxh64_intdigest(f"{kind}|{k}", self.name[parent]))
        self.own.append(self._told(tag, found))
        role = found.get("role", "").lower()
        self.root.append(tag in ("article", "main") or role in ("main", "article") or bool(ROOT_NAMES.search(found.get("itemprop", ""))))
        self.kids.append({})
        self.style.append([])
        return len(self.tag) - 1

    def _priors(self) -> None:
        """noise: nodes in a branch that markup tells to be noise; inside: nodes of a declared article; holds: what one stands in."""
        n = len(self.tag)
        hard = [False] * n  # in a branch that no article below it saves
        for k in range(1, n):
            inside = self.root[self.parent[k]]
            told = self.own[k] if not (inside and self.tag[k] in SITE_TAGS) else ""
            hard[k] = hard[self.parent[k]] or told in ("tag", "others")
            self.root[k] = not hard[k] and (self.root[k] or inside)
            if told != self.own[k]:
                self.own[k] = told
        self.holds = [False] * n
        for k in range(n - 1, 0, -1):
            if self.root[k] or self.holds[k]:
                self.holds[self.parent[k]] = True
        self.inside, self.declared = self.root, any(self.root)
        self.noise = [False] * n
        for k in range(1, n):
            saved = self.holds[k] and not self.inside[self.parent[k]]
            self.noise[k] = self.noise[self.parent[k]] or self.own[k] in ("tag", "others") or (self.own[k] != "" and not saved)

    def _read(self, source: str) -> None:
        stack, text, at, end = [("#page", 0)], [], 0, len(source)

        def flush():
            if text:
                line = " ".join(_html.unescape("".join(text)).split())
                text.clear()
                if line:
                    self.blocks.append((stack[-1][1], line))

        while at < end:
            m = _MARK.search(source, at)
            if m is None:
                text.append(source[at:])
                break
            if m.start() > at:
                text.append(source[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            if not m[4]:  # an open quote: the tag ends at the next mark, or never
                at = source.find(">", at) + 1
                if not at:
                    break
            tag = tag.lower()
            if m[1]:
                if tag == "br" or tag == "p" and not any(t == "p" for t, _ in stack):
                    text.append(" ")
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        if tag not in INLINE or stack[k][1] != stack[k - 1][1]:
                            flush()
                        del stack[k:]
                        break
                    if tag in INLINE and stack[k][0] not in INLINE:
                        break
                continue
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)", re.I).search(source, at)
                at = close.start() if close else end
                if close:
                    at = source.find(">", close.end()) + 1 or end
                continue
            if tag in INLINE:
                if tag == "br":
                    text.append(" ")
                elif tag not in VOID and ("class" in m[3] or "id" in m[3] or "role" in m[3] or "hidden" in m[3]):
                    if self._told(tag, found := self._attrs(m[3])):
                        flush()
                        stack.append((tag, self._node(stack[-1][1], tag, found)))
                    else:
                        stack.append((tag, stack[-1][1]))
                continue
            flush()
            if tag in VOID:
                continue
            ends = _ENDS.get(tag, set()) | {"p"}
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                    if "p" in ends and len(ends) == 1:
                        break
                elif stack[k][0] in _WALLS and not (tag in ("tr",) and stack[k][0] in ("td", "th")):
                    break
            if not m[3].rstrip().endswith("/") or tag not in ("path", "circle", "rect", "use"):
                stack.append((tag, self._node(stack[-1][1], tag, self._attrs(m[3]))))
        flush()

    def above(self, node: int):
        while node > 0:
            yield node
            node = self.parent[node]

    def judged(self):
        """Nodes that the tree has: all but what stands inside noise."""
        return [k > 0 and not (self.noise[k] and self.noise[self.parent[k]]) and self.tag[k] not in ("html", "body") for k in range(len(self.tag))]

    def facts(self):
        """(node's name, hash, whether of a style, parent's name, whether noise) once for each style shown and text held; the last two go with styles."""
        out, judged = set(), self.judged()
        for k in range(1, len(self.tag)):
            if judged[k]:
                out.add((self.name[k], xxhash.xxh64_intdigest("\0".join(self.style[k]), 1), True, self.name[self.parent[k]], self.noise[k]))
        for node, line in self.blocks:
            h = xxhash.xxh64_intdigest(line, 2)
            for k in self.above(node):
                if judged[k]:
                    out.add((self.name[k], h, False, 0, False))
        return out

    def prior(self, k: int) -> float:
        """NOISE, 1, or without bound for what a declared article keeps."""
        if self.noise[k]:
            return NOISE
        p = self.parent[k]
        if self.inside[k]:
            return 1.0 if self.inside[p] and self.tag[k] in _JUDGED_INSIDE else np.inf
        if self.holds[k] or self.tag[k] in ("html", "body"):
            return np.inf
        return NOISE if self.declared else 1.0

    def main(self, unimportant, prior: bool = True) -> str:
        """Blocks of text that stay, given which names the tree weighs below LEAST; without the prior, by the tree alone."""
        gone = [False] * len(self.tag)
        for k in range(1, len(self.tag)):
            p = self.prior(k) if prior else 1.0 if self.tag[k] not in ("html", "body") else np.inf
            # a weight is at most 1, so noise goes; one of LEAST or more keeps what has no prior against it
            gone[k] = gone[self.parent[k]] or p < LEAST or p == 1.0 and unimportant(self.name[k])
        bare = self.declared and prior  # text in no element is outside the article
        return "\n".join(line for node, line in self.blocks if not gone[node] and (self.inside[node] or not bare))


def host(url) -> str:
    """Host of a URL, lower case, without user and port; of none, the empty host."""
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _facts(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            rows, pages = [], []
            for url, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                facts = Page(source or "", host(url)).facts()
                rows += facts
                pages += [xxhash.xxh64_intdigest(source or "")] * len(facts)
            names, hashes, styles, ups, noises = zip(*rows) if rows else [()] * 5
            long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([long(names), long(hashes), pa.array(styles, pa.bool_()), long(ups), pa.array(noises, pa.bool_()), long(pages)], ["name", "h", "style", "up", "noise", "page"])
    give_back()


def style_tree(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The merged tree: (name, up, noise, pages, presentation, content, importance, relative, weight) of each node."""
    facts = pages.select(col(url), col(html)).mapInArrow(_facts, "name bigint, h bigint, style boolean, up bigint, noise boolean, page bigint")
    seen = facts.distinct().groupBy("name", "h", "style").agg(F.count(F.lit(1)).alias("n"), F.max("up").alias("up"), F.max("noise").alias("noise"))
    # of a node: its pages are the sum over styles, as each page shows one style there
    texts, n = ~F.col("style"), F.col("n").cast("double")
    nodes = seen.groupBy("name").agg(
        F.max(F.when(F.col("style"), F.col("up"))).alias("up"),
        F.max("noise").alias("noise"),
        F.sum(F.when(F.col("style"), F.col("n"))).alias("pages"),
        F.count_if("style").alias("styles"),
        F.sum(F.when(F.col("style"), n * F.log(n))).alias("style_log"),
        F.count_if(texts).alias("texts"),
        F.sum(F.when(texts, F.log(n))).alias("text_log"),
    )
    m = F.col("pages").cast("double")
    many = F.col("pages") > 1
    nodes = nodes.withColumn("presentation", F.when(many, (F.log(m) - F.col("style_log") / m) / F.log(m)).otherwise(1.0))
    nodes = nodes.withColumn("content", F.when(~many, 1.0).when(F.col("texts") == 0, 0.0).otherwise(1 - F.col("text_log") / F.greatest(F.col("texts"), F.lit(1)) / F.log(m)))
    mixed = F.pow(F.lit(DECAY), F.col("styles").cast("double"))
    nodes = nodes.withColumn("importance", F.when(many, (1 - mixed) * F.col("presentation") + mixed * F.col("content")).otherwise(1.0))
    best = nodes.where("NOT noise AND texts > 0").groupBy("up").agg(F.max("content").alias("best"))
    nodes = nodes.join(best, "up", "left")
    own, least = 1 - F.col("content"), 1 - F.greatest("content", F.coalesce("best", F.col("content")))
    nodes = nodes.withColumn("relative", F.when(F.col("texts") == 0, 1.0).otherwise((1 / m + least) / (1 / m + own)))
    return nodes.select("name", "up", "noise", "pages", "presentation", "content", "importance", "relative", (F.col("importance") * F.col("relative")).alias("weight"))


def _text(names, prior):
    def run(batches):
        known = names.value if names is not None else None
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part, texts = batch.slice(i, 512), []
                given = part.column(3) if known is None else None
                for k, (url, source) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    page = Page(source or "", host(url))
                    if known is None:
                        some = {x % (1 << 64) for x in given[k].as_py() or ()}
                    else:
                        own = np.array(page.name, np.uint64)
                        some = set(own[known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own].tolist()) if len(known) else ()
                    texts.append(page.main(some.__contains__, prior))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["own", "text", "n_chars"])
        give_back()

    return run


def extract(
    pages: DataFrame, url: str = "url", html: str = "html", least: float = LEAST, min_pages: int = MIN_PAGES, max_broadcast: int = MAX_BROADCAST, prior: bool = True
) -> DataFrame:
    """pages with text and n_chars, without the html; without the prior the tree decides alone."""
    poor = stored(style_tree(pages, url, html).where((F.col("weight") < least) & (F.col("pages") >= min_pages)).select("name"), "op9-poor")
    rows = packed(pages, ("text", "n_chars", html), url=col(url), html=col(html))
    if poor.count() <= max_broadcast:
        names = pages.sparkSession.sparkContext.broadcast(np.sort(np.asarray(poor.toArrow().column("name")).view(np.uint64)))
    else:
        # each page's nodes meet the names; pages are told apart by 128 bits of their source and host
        names, keys = None, [F.xxhash64("url", "html").alias("k1"), F.xxhash64("html", "url", F.lit(1)).alias("k2")]
        held = rows.select(*keys, "url", "html").mapInArrow(_names, "k1 bigint, k2 bigint, name bigint").distinct()
        held = held.join(poor, "name").groupBy("k1", "k2").agg(F.collect_set("name").alias("names"))
        rows = rows.select("own", "url", "html", *keys).join(held, ["k1", "k2"], "left").select("own", "url", "html", "names")
    return unpacked(rows.mapInArrow(_text(names, prior), with_own(rows, "text string, n_chars bigint")), "text", "n_chars")


def _names(batches):
    for batch in batches:
        for k1, k2, url, source in zip(*(c.to_pylist() for c in batch.columns)):
            names = np.array(sorted(set(Page(source or "", host(url)).name[1:])), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([k1] * len(names), pa.int64()), pa.array([k2] * len(names), pa.int64()), pa.array(names)], ["k1", "k2", "name"])


def query(spark, sf_dir):
    return extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
