import hashlib
import html
import random
import re

import numpy as np

from lodestone.llm import op3_warc, op9_html
from lodestone.llm.op9_html import DECAY, Page, extract, host, style_tree


def main(source):
    return Page(source, "h").main(lambda name: False)


def test_blocks_and_furniture():
    assert main("<nav>menu</nav><article><h1>T &amp; U</h1><p>one\n two<br>three<p><b>four<br><p>five</article><footer>f</footer>") == "T & U\none two three\nfour\nfive"
    assert main("<article>1 < 2 &lt; 3<span class='ad'>buy</span> <a href=x>l</a>ink<ul><li>a<li>b</ul><div class=comments><p>no</div></article>tail") == "1 < 2 < 3\nlink\na\nb"
    assert main("<article>x<script>if(a<b)'</p>'</script>y<!-- <p>no --> z<style>p{}</style>") == "xy z"
    assert main("<article><header><h1>Title</h1></header>text</article><header>Site</header>") == "Title\ntext"
    assert main("<main><form>f</form>m<aside>s</aside></main>") == "m"
    assert [main(x) for x in ("", "   ", "<p>", "<", "plain &copy text", "<div title=\"a>b")] == ["", "", "", "<", "plain © text", "b"]
    assert [host(u) for u in (None, "", "http://User@Ex.COM:80/x", "//h/p", "nonsense")] == ["", "", "ex.com", "h", ""]


def test_tables_lists_and_long_text():
    assert main("<article><table><tr><td>a<td>b<tr><td>c</table>" + "<p>w" * 5000 + "</article>") == "\n".join(["a", "b", "c"] + ["w"] * 5000)
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert main(f"<article>{deep}</article>") == "x"


def rows(n):
    r = random.Random(1)
    words = lambda k: " ".join("w%d" % r.randrange(10_000) for _ in range(k))
    return [(i, f"http://{'big' if i % 3 else 'small'}.example/{i}", f"<html><body><div>Same bar on each page</div><div><p>{words(20)}<p>{words(15)}</div><div>Terms and more</div></body></html>") for i in range(n)]


def test_tree_removes_unimportant_branches(spark):
    data = rows(40)
    pages = spark.createDataFrame(data, "page_id bigint, url string, html string")
    want = {i: "\n".join(re.findall(r"<p>([^<]*)", h)) for i, _, h in data}
    for most in (1 << 20, 0):  # names by broadcast, and by join
        got = extract(pages, max_broadcast=most).collect()
        assert {r.page_id: r.text for r in got} == want
        assert all(r.n_chars == len(r.text) for r in got)
    tree = style_tree(pages).collect()
    assert all(-1e-9 <= r.importance <= 1 + 1e-9 for r in tree)


def test_importance_by_hand(spark):
    # two pages of one host: one text of a node is shared, one differs
    pages = spark.createDataFrame([(k, "http://h/", f"<div><p>same</p></div><section>{k}</section>") for k in range(2)], "page_id bigint, url string, html string")
    got = sorted((round(r.content, 6), round(r.presentation, 6), r.pages) for r in style_tree(pages).collect())
    assert got == [(0.0, 0.0, 2), (0.0, 0.0, 2), (1.0, 0.0, 2)]


def test_class_names_do_not_erase_articles():
    article = "<article><h1>t</h1><p>a</p><p>b</p></article>"
    whole = {
        f'<div class="site-content has-sidebar">{article}</div>': "t\na\nb",
        '<article class="post comments-open"><p>a</p></article>': "a",
        '<div class="no-sidebar"><p>a</p></div>': "a",
        '<main id="search"><p>a</p></main>': "a",
        f'<form id="aspnetForm">{article}<input></form>': "t\na\nb",
        '<article><p class="legal">It is the law.</p><p>b</p></article>': "It is the law.\nb",
        f'<div class="sidebar-wrapper"><div class="menu">m</div>{article}</div>': "t\na\nb",
        f'{article}<div class="comments"><article class="comment">no</article></div><aside><article>no</article></aside>': "t\na\nb",
        '<div class="comments"><article><p>said a reader</p></article></div><div><p>text</p></div>': "text",
        f'<form class="newsletter">mail</form>{article}<div id="comment-12">no</div>': "t\na\nb",
    }
    for source, text in whole.items():
        assert main(source) == text, source


def brute_tree(pages):
    """The style tree node by node, in plain Python: {name: (pages, presentation, content, importance, relative, weight)}."""
    import math

    styles, texts, up, noise = {}, {}, {}, {}
    for url, source in {(host(u), s) for _, u, s in pages}:
        p = Page(source, url)
        judged = p.judged()
        for k in range(1, len(p.tag)):
            if judged[k]:
                styles.setdefault(p.name[k], {}).setdefault(source, "\0".join(p.style[k]))
                up[p.name[k]], noise[p.name[k]] = p.name[p.parent[k]], p.noise[k]
        for node, line in p.blocks:
            for k in p.above(node):
                if judged[k]:
                    texts.setdefault(p.name[k], {}).setdefault(line, set()).add(source)
    content, out = {}, {}
    for name, of in styles.items():
        m, held = len(of), texts.get(name, {})
        content[name] = 1.0 if m == 1 else 0.0 if not held else sum(1 - math.log(len(x)) / math.log(m) for x in held.values()) / len(held)
    for name, of in styles.items():
        m, kinds = len(of), list(of.values())
        if m == 1:
            presentation = importance = 1.0
        else:
            share = [kinds.count(s) / m for s in set(kinds)]
            presentation = -sum(x * math.log(x) for x in share) / math.log(m)
            importance = (1 - DECAY ** len(share)) * presentation + DECAY ** len(share) * content[name]
        best = max([content[x] for x in styles if up[x] == up[name] and not noise[x] and x in texts] + [content[name]])
        relative = (1 / m + 1 - best) / (1 / m + 1 - content[name]) if name in texts else 1.0
        out[name] = (m, presentation, content[name], importance, relative, importance * relative)
    return out


def test_tree_like_brute_force(spark):
    r = random.Random(4)
    bars = ["Home and away", "News of the day", "Terms"]
    data = [(i, f"http://{'ab'[i % 5 == 0]}/", f"<nav>{r.choice(bars)}</nav><div class=x><p>{r.random()}<p>{r.choice(bars)}</div>" + f"<section><p>{i % 7}</section>" * r.randrange(3) + "<div>end</div>") for i in range(60)]
    data += [(100 + i, "http://a/", data[1][2]) for i in range(5)]
    got = {x.name % (1 << 64): x for x in style_tree(spark.createDataFrame(data, "page_id bigint, url string, html string")).collect()}
    want = brute_tree(data)
    assert got.keys() == want.keys()
    for name, w in want.items():
        x = got[name]
        assert np.allclose((x.pages, x.presentation, x.content, x.importance, x.relative, x.weight), w, atol=1e-9)


def test_tree_alone_on_pages_without_declarations(spark):
    """A large host's pages with every telling tag made a div: the tree removes every bar, and of the rest what repeats."""
    import pyarrow.parquet as pq

    rows = [r for r in pq.read_table("/root/testdata/sf0.1/pages.parquet").to_pylist() if host(r["url"]) == "blog.tionsh.example.com"]
    plain = lambda h: re.sub(r'<(/?)(?:article|nav|footer|div class="ad")', r"<\1div", h)
    want = {r["page_id"]: main(r["html"]) for r in rows}
    data = [(r["page_id"], r["url"], plain(r["html"])) for r in rows]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(data, "page_id bigint, url string, html string")).collect()}
    assert len(want) > 300 and all(set(got[k].split("\n")) <= set(want[k].split("\n")) | {""} for k in want)
    assert sum(map(len, got.values())) > 0.8 * sum(map(len, want.values()))
    assert sum(main(h) == want[k] for k, _, h in data) == 0  # without the tree, bars stay on each page


def test_copied_articles_stay_and_odd_rows(spark):
    art = "<article><p>copied text here</p></article>"
    data = [(k, "http://h/", art, "clash") for k in range(30)] + [(None, None, None, None), (1, "http://h/", "", None), (1, None, "<p>lone", None)]
    got = extract(spark.createDataFrame(data, "page_id bigint, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(r.text for r in got.collect()) == ["", ""] + ["copied text here"] * 30 + ["lone"]
    assert extract(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_test_pages_like_a_regular_expression(spark):
    import pyarrow.parquet as pq

    for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        article = re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert Page(r["html"], host(r["url"])).main(lambda name: False) == "\n".join(filter(None, parts))


def test_warc_round_trip(spark):
    r = random.Random(2)
    big = "".join(r.choice("abc \n\r") for _ in range(300_000))
    data = [(5, "http://a/é?q=1 2", "same"), (3, "http://b", "same"), (9, None, "same"), (1, "u", None), (2, "u", ""), (4, "u", "Content-Length: 3\r\n\r\nx"), (6, "u", big), (7, "u", "ünï"), (7, "u", "ünï"), (None, "u", "same")]
    pages = spark.createDataFrame([(*x, "extra") for x in data], "page_id bigint, url string, html string, path string").repartition(3)
    for least in (0, 4, 5):
        files = op3_warc.normalise(op3_warc.write_archives(pages, min_revisit=least), keep=least == 0)
        got = sorted(((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to, bytes(x.payload)) for x in op3_warc.read_archives(files).collect()), key=str)
        want = []
        for i, _, h in data:
            p = (h or "").encode()
            first = min((j for j, _, g in data if (g or "") == (h or "") and j is not None), default=None)
            again = len(p) >= least and i != first
            want.append((i, len(p), op3_warc.digest32(p), "revisit" if again else "response", first if again else None, b"" if again else p))
        assert got == sorted(want, key=str)
    assert op3_warc.read_archives(op3_warc.normalise(op3_warc.write_archives(pages.limit(0)))).collect() == []


def test_warc_members_stand_alone(spark):
    import gzip

    pages = spark.createDataFrame([(k, "u", f"page {k}") for k in range(5)], "page_id bigint, url string, html string").coalesce(1)
    (f,) = op3_warc.normalise(op3_warc.write_archives(pages)).collect()
    with open(f.path, "rb") as a, open(f.path + ".idx") as b:
        data, index = a.read(), [tuple(map(int, x.split("\t"))) for x in b]
    assert len(index) == f.records == 5 and sum(n for _, n in index) == len(data)
    for at, n in index:
        x = op3_warc.parse(gzip.decompress(data[at : at + n]))
        assert x["payload"] == f"page {x['id']}".encode()
    assert op3_warc.digest32(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and len(hashlib.sha1(b"").digest()) == 20 and np.uint8(0) == 0
    assert op9_html.NAME.startswith("op9_")


def test_normalise_deletes_only_what_it_was_given(spark, tmp_path):
    import os

    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(k, "u", f"page {k}") for k in range(5)], "page_id bigint, url string, html string").coalesce(1)
    (f,) = op3_warc.write_archives(pages).collect()
    own = tmp_path / "own.warc.gz"
    own.write_bytes(open(f.path, "rb").read())
    (tmp_path / "other.txt").write_text("stays")
    files = spark.createDataFrame([(str(own), 5)], "path string, records bigint")
    assert op3_warc.normalise(files).count() == 1 and own.exists()
    new = op3_warc.normalise(files, keep=False)
    assert op3_warc.read_archives(new).agg(F.count("page_id")).first()[0] == 5
    assert sorted(os.listdir(tmp_path)) == ["other.txt"]


def test_inflating_is_bounded():
    import gzip
    import io

    r = random.Random(3)
    for data in (b"", b"a" * 50_000_000, r.randbytes(3_000_000), b"x" * (op3_warc.CHUNK * 2)):
        parts = list(op3_warc._inflated(io.BytesIO(gzip.compress(data, 1))))
        assert b"".join(parts) == data and all(len(p) <= op3_warc.CHUNK for p in parts)
    many = [r.randbytes(r.randrange(3000)) for _ in range(500)]
    assert b"".join(op3_warc._inflated(io.BytesIO(b"".join(map(gzip.compress, many))))) == b"".join(many)
