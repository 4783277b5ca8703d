import random

import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.op8_simhash import fingerprint, keep_one, links, masks, near_duplicates


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint():
    r = random.Random(1)
    for n in (0, 1, 3, 4, 5, 300):
        t = " \n".join(r.choice(["A", "b", "ÄC", "d"]) for _ in range(n))
        assert fingerprint(t.encode()) == plain(t)


def test_masks_cover_every_pair():
    r = random.Random(2)
    m, second = masks(4), masks(4, second=True)
    assert len(m) == len(second) == 31 and not set(m) & set(second)
    for _ in range(3000):
        d = sum(1 << b for b in r.sample(range(64), r.randrange(1, 5)))
        assert any(d & x == 0 for x in m)


@pytest.mark.parametrize("limit", [4096, 3])
def test_links_like_brute_force(spark, limit):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(12)]
    fps = {0, 1, (1 << 64) - 1}
    for _ in range(400):
        x = r.choice(base)
        for b in r.sample(range(64), r.randrange(0, 7)):
            x ^= 1 << b
        fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), bucket_limit=limit)[0].collect()
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    assert all(((e.a ^ e.b) & (1 << 64) - 1).bit_count() <= 4 for e in got)
    assert classes([(e.a, e.b) for e in got], signed) == classes(near, signed)


def test_components(spark):
    r = random.Random(4)
    edges = [(k, k + 1) for k in range(200)] + [(r.randrange(300, 600), r.randrange(300, 600)) for _ in range(200)] + [(700, 700), (None, 3)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == classes(real, {n for e in real for n in e})
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_documents(spark):
    r = random.Random(5)
    texts = [" ".join("w%d" % r.randrange(900) for _ in range(r.choice([2, 60, 200]))) for _ in range(30)]
    rows = [(k, t, 1) for k, t in enumerate(texts * 2)] + [(100, None, 1), (101, "", 2), (102, " \n", 3), (None, texts[0], 4), (3, texts[3], 5)]
    rows += [(200 + k, t + " tail", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id int")
    got = sorted(((x.id is None, x.id, x.fp, x.component_id) for x in near_duplicates(docs).collect()), key=str)
    fps = [plain(t) for _, t, _ in rows]
    n = len(rows)
    root = classes([(a, b) for a in range(n) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4], range(n))
    least = {}
    for k in range(n):
        if rows[k][0] is not None:
            least[root[k]] = min(least.get(root[k], 10**9), rows[k][0])
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    assert got == sorted(((rows[k][0] is None, rows[k][0], signed[k], least[root[k]]) for k in range(n)), key=str)
    kept = sorted(x.doc_id for x in keep_one(docs).where(F.col("doc_id").isNotNull()).collect())
    assert kept == sorted(set(least.values()))
    assert keep_one(docs.limit(0)).collect() == []


def test_keep_one_of_shared_and_null_ids(spark):
    r = random.Random(9)
    a, b, c, d = (" ".join("w%d" % r.randrange(900) for _ in range(80)) for _ in range(4))
    rows = [(5, a), (5, b), (3, a), (None, b), (None, c), (None, c), (7, d), (7, d), (8, None), (None, "")]
    for k in range(3):
        docs = spark.createDataFrame(r.sample(rows, len(rows)), "doc_id bigint, text string").repartition(k + 1)
        extra = keep_one(docs.selectExpr("*", "1 AS id", "2 AS row", "3 AS t", "4 AS own", "5 AS __row", "6 AS k"))
        assert extra.columns[2:] == ["id", "row", "t", "own", "__row", "k"] and {tuple(x)[2:] for x in extra.collect()} == {(1, 2, 3, 4, 5, 6)}
        assert sorted(map(tuple, keep_one(docs).collect()), key=str) == sorted([(3, a), (5, b), (None, c), (7, d), (8, None)], key=str)


def test_very_long_text(spark):
    r = random.Random(10)
    long = " ".join("w%d" % r.randrange(5000) for _ in range(300_000))
    rows = [(1, long), (2, long.upper()), (3, "x" * 2_000_000), (4, None)]
    got = {x.id: (x.fp, x.component_id) for x in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == got[2] and got[1][1] == 1 and got[3][1] == 3 and got[4] == (0, 4)
