"""Web pages: extraction, links, deduplication, crawl frontier.

Extraction needs a parser, so it is one Arrow pass over pages; what follows it is native.
"""

import hashlib
import json
import re
import unicodedata
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.urls import host, normalize_url, resolve
from lodestone.sources.shared import shared_dir

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Elements and names of page furniture.
REMOVED = frozenset("script style noscript template nav footer aside iframe canvas svg form dialog".split())
CONTAINS = ("cookie", "advert", "sidebar", "menu")
CONTAINS_CLASS = ("breadcrumb",)
WORDS = frozenset(["ad"])
BLOCKS = frozenset("p li blockquote pre".split())
HEADINGS = frozenset("h2 h3 h4 h5 h6".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
MAX_JSON = 256_000


class _Tree(HTMLParser):
    """Nodes as [tag, attributes, children]; texts are children too."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["#", {}, []]
        self.stack = [self.root]

    def _close(self, *tags, walls=("div", "td", "ul", "ol", "body", "article", "main", "section")):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] in tags:
                del self.stack[k:]
                return
            if self.stack[k][0] in walls:
                return

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES_P:
            self._close("p")
        if tag == "li":
            self._close("li")
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.stack[-1][2].append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.stack.pop()

    def handle_endtag(self, tag):
        self._close(tag, walls=())

    def handle_data(self, data):
        self.stack[-1][2].append(data)


def _walk(node):
    todo = [node]
    while todo:
        x = todo.pop()
        if not isinstance(x, str):
            yield x
            todo.extend(reversed(x[2]))


def _text(node) -> str:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo.extend(reversed(x[2]))
    return "".join(out)


def _furniture(node) -> bool:
    tag, attrs, _ = node
    if tag in REMOVED or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    names = {k: attrs.get(k, "") for k in ("class", "id")}
    low = [v.lower() for v in names.values()]
    return any(c in v for c in CONTAINS for v in low) or any(c in low[0] for c in CONTAINS_CLASS) or bool(WORDS & set(names["class"].split())) or bool(WORDS & set(names["id"].split()))


def _prune(node):
    todo = [node]
    while todo:
        x = todo.pop()
        x[2] = [c for c in x[2] if isinstance(c, str) or not _furniture(c)]
        todo.extend(c for c in x[2] if not isinstance(c, str))


def one_line(s: str) -> str:
    return " ".join(s.split())


def compact(blocks) -> list[str]:
    """Blocks without empty ones and without repeats that stand next to each other."""
    out = []
    for b in map(one_line, blocks):
        if b and (not out or out[-1] != b):
            out.append(b)
    return out


def extract_page(html: str | None, url: str | None) -> dict:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    nodes = list(_walk(tree.root))
    first = lambda test: next((n for n in nodes if test(n)), None)
    meta = lambda k, v: next((n[1].get("content", "") for n in nodes if n[0] == "meta" and n[1].get(k) == v), None)
    data = []
    for n in nodes:
        if n[0] == "script" and n[1].get("type", "").lower() == "application/ld+json":
            body = _text(n).strip()
            if body and len(body) <= MAX_JSON:
                try:
                    found = json.loads(body)
                    data += [json.dumps(x) for x in (found if isinstance(found, list) else [found])]
                except ValueError:
                    pass
    title = meta("property", "og:title")
    if title is None:
        t = first(lambda n: n[0] == "title")
        title = _text(t) if t else ""
    described = meta("name", "description")
    described = meta("property", "og:description") if described is None else described
    lang = first(lambda n: n[0] == "html")
    link = first(lambda n: n[0] == "link" and n[1].get("rel") == "canonical")
    canonical = (resolve(link[1].get("href"), url) if link else resolve(url)) or url
    links = list(dict.fromkeys(x for n in nodes if n[0] == "a" and "href" in n[1] and (x := resolve(n[1]["href"].strip(), url))))
    _prune(tree.root)
    nodes = list(_walk(tree.root))
    root = next((n for n in nodes if n[0] in ("main", "article") or n[1].get("role") == "main"), None) or next((n for n in nodes if n[0] == "body"), tree.root)
    inner = list(_walk(root))
    h1 = next((n for n in inner if n[0] == "h1"), None)
    blocks = compact(_text(n) for n in inner if n[0] in BLOCKS and n is not root)
    content = "\n\n".join(blocks) if blocks else one_line(_text(root))
    return {
        "title": one_line(title),
        "description": one_line(described or "") or None,
        "heading": one_line(_text(h1)) or None if h1 else None,
        "sections": compact(_text(n) for n in inner if n[0] in HEADINGS),
        "content": content,
        "canonical_url": canonical,
        "language": one_line(lang[1].get("lang", "")).lower() or None if lang else None,
        "structured_data": data,
        "links": links,
        "content_hash": hashlib.sha256(unicodedata.normalize("NFKC", content).encode()).hexdigest(),
    }


EXTRACTED = "title string, description string, heading string, sections array<string>, content string, canonical_url string, language string, structured_data array<string>, links array<string>, content_hash string"


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages without the html, with struct page."""

    @F.pandas_udf(EXTRACTED)
    def run(h: pd.Series, u: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract_page(a, b) for a, b in zip(h, u)], columns=[x.split()[0] for x in EXTRACTED.split(", ")])

    return pages.select(*[c for c in pages.columns if c != html], run(F.col(html), F.col(url)).alias("page"))


def links(extracted: DataFrame, id: str = "page_id") -> DataFrame:
    return extracted.select(id, F.explode("page.links").alias("link"))


def compact_blocks(blocks):
    """compact() of an array column."""
    lines = F.filter(F.transform(blocks, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.filter(lines, lambda x, i: (i == 0) | (x != F.get(lines, i - 1)))


def deduplicate(docs: DataFrame, content: str, id: str) -> DataFrame:
    """The first document, by id, of each content; empty contents are left out. The least id per hash is found before documents are joined."""
    hashed = docs.where(F.coalesce(F.col(content), F.lit("")) != "").withColumn("content_hash", F.sha2(F.col(content), 256))
    first = hashed.groupBy("content_hash").agg(F.min(id).alias(id))
    return hashed.join(first, ["content_hash", id], "left_semi")


def crawled_documents(extracted: DataFrame) -> DataFrame:
    """Documents of pages, with the digest of the canonical URL for id."""
    return extracted.select(F.sha2("page.canonical_url", 256).alias("id"), F.col("page.canonical_url").alias("url"), "page.title", "page.heading", "page.content", "page.language", "page.content_hash")


@dataclass(frozen=True)
class CrawlLimits:
    """Bounds of a crawl."""

    # Defaults, and the ranges below.
    max_depth: int = 3
    max_pages: int = 100
    concurrency: int = 2
    delay_ms: float = 500.0

    def __post_init__(self):
        for name, low, high, whole in (("max_depth", 0, 20, True), ("max_pages", 1, 10_000, True), ("concurrency", 1, 20, True), ("delay_ms", 0, 60_000, False)):
            n = getattr(self, name)
            if (whole and not isinstance(n, int)) or not low <= n <= high:
                raise ValueError(f"{name} is {n}, outside {low} to {high}")


def frontier(edges: DataFrame, seeds: DataFrame, max_depth: int = 3, max_pages: int | None = None) -> DataFrame:
    """(url, depth) by breadth first over edges(url, link), one join a level; each level is a checkpoint in the shared folder."""
    shared_dir(edges.sparkSession)
    if edges.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        edges.sparkSession.sparkContext.setCheckpointDir(shared_dir(edges.sparkSession))
    edges = edges.select(normalize_url(F.col("url")).alias("url"), normalize_url(F.col("link")).alias("link")).where("url IS NOT NULL AND link IS NOT NULL").distinct()
    level = seeds.select(normalize_url(F.col("url")).alias("url")).where("url IS NOT NULL").distinct().withColumn("depth", F.lit(0)).checkpoint()
    seen = level
    for d in range(1, max_depth + 1):
        new = edges.join(level.select("url"), "url").select(F.col("link").alias("url")).distinct().join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(d))
        level = new.checkpoint()
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen if max_pages is None else seen.orderBy("depth", "url").limit(max_pages)


def by_host(pages: DataFrame, url: str = "url") -> DataFrame:
    return pages.groupBy(host(F.col(url)).alias("host")).agg(F.count(F.lit(1)).alias("pages"))


def first_pages(pages: DataFrame, per_host: int, url: str = "url", id: str = "page_id") -> DataFrame:
    w = Window.partitionBy(host(F.col(url))).orderBy(id)
    return pages.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_host).drop("n")
