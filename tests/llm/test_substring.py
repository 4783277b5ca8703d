import random
from collections import Counter

import pytest

from lodestone.llm import op4_substring
from lodestone.llm.op4_substring import substring_dedup

SCHEMA = "doc_id bigint, text string, n_words string, extra int"


def brute(rows, window):
    texts = [(r[1] or "").encode().split() for r in rows]
    seen = Counter(tuple(t[i : i + window]) for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = set()
        for i in range(len(t) - window + 1):
            if seen[tuple(t[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(t), len(gone), b" ".join(w for k, w in enumerate(t) if k not in gone).decode()))
    return out


def corpus(seed, window):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "ä", "dé", "x.", "w%d" % r.randrange(400)])
    passages = [[word() for _ in range(window + r.randrange(-2, 12))] for _ in range(4)]
    rows = []
    for k in range(60):
        t = []
        for _ in range(r.randrange(0, 5)):
            t += [word() for _ in range(r.randrange(0, 3 * window))]
            t += r.choice(passages) if r.random() < 0.5 else []
        rows.append((k, r.choice([" ", "\n", " \t ", "\x0b"]).join(t), "clash", k))
    rows += [rows[3], (None, None, None, None), (None, "", None, 1), (77, " ", "", 2), (78, "same " * 200, "", 3), (79, "one", "", 4)]
    return rows


# the bitmap alone, the join alone, and the join of the probes that a bitmap of few words lets pass
@pytest.mark.parametrize("limit", [1 << 24, 0, 64])
@pytest.mark.parametrize("window", [3, 8, 35])
def test_like_brute_force(spark, window, limit):
    rows = corpus(window, window)
    out = substring_dedup(spark.createDataFrame(rows, SCHEMA), window, max_filter_blocks=limit)
    got = sorted((str(r.extra), r.doc_id is None, r.n_words, r.n_removed, r.kept_text) for r in out.collect())
    want = sorted((str(r[3]), r[0] is None, *b) for r, b in zip(rows, brute(rows, window)))
    assert got == want


def test_empty_table(spark):
    out = substring_dedup(spark.createDataFrame([], "doc_id bigint, text string"))
    assert out.collect() == []
    assert out.columns == ["doc_id", "text", "n_words", "n_removed", "kept_text"]


def test_hot_blocks(spark, monkeypatch):
    """A passage in most rows: its probes are hits without the join."""
    monkeypatch.setattr(op4_substring, "HOT_PARTS", 64)
    rows = [(k, " ".join([f"w{k}x{j}" for j in range(k % 7)] + [f"p{j}" for j in range(40)] + [f"v{k}x{j}" for j in range(9)]), None, k) for k in range(80)]
    got = {r.extra: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(spark.createDataFrame(rows, SCHEMA), 8, max_filter_blocks=0).collect()}
    assert got == dict(enumerate(brute(rows, 8)))
