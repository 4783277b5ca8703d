import random

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import tiktoken
from pyspark.sql import functions as F

from lodestone.llm import op2_bpe, op7_language, op10_mixing
from lodestone.llm.op10_mixing import Mix, budgets, mixed

SF = "/root/testdata/sf0.001"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = op7_language.identify(docs.withColumn("held_out", op7_language.held_out(F.col("doc_id"))), op7_language.fit_documents(docs))
    rows = out.where("held_out AND lang IS NOT NULL").select("lang", "lang_pred", "score").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark):
    train = [(f"{w} " * 5, lang) for w, lang in (("the house and the", "en"), ("der und die das", "de"), ("el la los que", "es")) for _ in range(4)] + [(None, "en"), ("no label", None), ("123", "en")]
    model = op7_language.fit(spark.createDataFrame(train, "text string, lang string"))
    assert set(model[0]) == {"en", "de", "es"}
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 34 !", "x"), (4, "the house", "x"), (4, "the house", "x"), (5, "漢字" * 30, "x"), (6, "und " * 60_000, "x")], "doc_id bigint, text string, score string")
    got = sorted((r.doc_id, r.lang_pred, r.rejected, round(r.score, 6)) for r in op7_language.identify(rows, model).collect())
    assert [g[:3] for g in got[:3]] == [(1, "und", True), (2, "und", True), (3, "und", True)]
    assert got[3] == got[4] and got[3][1] == "en" and not got[3][2]
    assert got[5][2] and got[6][1] == "de"
    assert op7_language.fit(spark.createDataFrame([], "text string, lang string")) is None
    assert {r.lang_pred for r in op7_language.identify(rows, None).collect()} == {"und"}
    assert op7_language.identify(rows.limit(0), model).collect() == []


def test_language_like_plain_nearest_centroid(spark):
    """Every document of a small table against centroids one by one, with n-grams counted in plain Python."""
    import math

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    langs, centroids, low, idf = model = op7_language.fit_documents(docs)

    def grams(text):
        out, run = {}, [ord(c) if c.isalpha() else 0 for c in text.lower()]
        run = [c for k, c in enumerate(run) if k == 0 or c or run[k - 1]]
        for n in (1, 2, 3):
            for k in range(len(run) - n + 1):
                part = run[k : k + n]
                if any(part):
                    g = part[0]
                    for c in part[1:]:
                        g = (g * 0x9E3779B1 + c) % 2**64
                    place = (g + n) * 0x9E3779B97F4A7C15 % 2**64 >> 51
                    out[place] = out.get(place, 0) + 1
        return out

    for r in op7_language.identify(docs, model).collect():
        g = grams(r.text or "")
        if not g:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0, True)
            continue
        x = {k: math.log1p(n) * idf[k] for k, n in g.items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        sims = [sum(v * float(c[k]) for k, v in x.items()) / size for c in centroids]
        near = max(range(len(sims)), key=sims.__getitem__)
        assert abs(sims[near] - r.score) < 1e-4 and any(langs[k] == r.lang_pred for k in range(len(sims)) if sims[k] > sims[near] - 1e-4)
        least = max(op7_language.FLOOR, op7_language.REJECT * low[near][op7_language.length_class(len(g))])
        assert abs(sims[near] - least) < 1e-4 or r.rejected == (sims[near] < least)


def test_language_rejects_noise_and_unknown_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, r = op7_language.fit_documents(docs), random.Random(3)
    noise = ["".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(400)), "Все люди рождаются свободными и равными в своем достоинстве и правах.", "漢字仮名交じり文" * 9]
    noise += ["Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler."]
    out = op7_language.identify(spark.createDataFrame([(t,) for t in noise], "text string"), model)
    assert [x.rejected for x in out.collect()] == [True] * len(noise)
    kept = op7_language.identify(docs.where("text rlike '[A-Za-z]'"), model)
    assert kept.where("rejected").count() == 0


def same_model(a, b):
    return a[0] == b[0] and all(np.array_equal(x, y) for x, y in zip(a[1:], b[1:]))


def test_language_copies_are_one_candidate(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    once = [(" ".join(word() for _ in range(9)), f"l{k % 8}") for k in range(24)]
    copies = once + [t for t in once[:8] for _ in range(100)]
    kinds = "text string, lang string"
    got = op7_language.fit(spark.createDataFrame(copies, kinds), per_lang=5)
    assert set(got[0]) == {f"l{k}" for k in range(8)}
    assert same_model(got, op7_language.fit(spark.createDataFrame(once, kinds), per_lang=5))


def test_language_learns_every_label(spark, monkeypatch):
    name = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(3))
    rows = spark.createDataFrame([(name(k) * 3, name(k)) for k in range(430)], "text string, lang string")
    model = op7_language.fit(rows)
    assert model[0] == sorted(name(k) for k in range(430))
    assert all(r.lang == r.lang_pred for r in op7_language.identify(rows, model).collect())
    two = spark.createDataFrame([(f"{w} {x}", w) for w in ("aaa", "bbb") for x in ("c", "d", "e", "f")], "text string, lang string")
    assert len(op7_language.fit(two)[0]) == 8
    monkeypatch.setattr(op7_language, "MAX_CENTROIDS", 1)
    assert op7_language.fit(two)[0] == ["aaa", "bbb"]


def give(nodes, budget):
    """Whole-number water filling of {name: (weight, cap)}."""
    out, open_ = {}, dict(nodes)
    while open_:
        w = sum(x for x, _ in open_.values())
        full = [k for k, (x, c) in open_.items() if budget * x > c * w]
        if not full:
            return out | {k: min(c, budget * x // w) for k, (x, c) in open_.items()}
        for k in full:
            out[k] = open_.pop(k)[1]
        budget -= sum(out[k] for k in full)
    return out


def test_budgets_like_water_filling(spark):
    r, mix = random.Random(5), Mix(percent=150)
    leaves = [(d, lang, s, r.choice([0, 3, 50, 1000, 40_000])) for d in ("web", "books", "other") for lang in ("en", "de", "(none)") for s in ("a", "b", "c", "d") if r.random() < 0.8]
    got = {tuple(x)[:3]: x.give for x in budgets(spark.createDataFrame(leaves, "domain string, lang_node string, source_node string, tokens bigint"), mix).select("domain", "lang_node", "source_node", "give").collect()}
    cap = lambda test: mix.max_epochs * sum(n for *k, n in leaves if test(k))
    top = give({d: (mix.domain_weights[d], cap(lambda k: k[0] == d)) for d in {x[0] for x in leaves}}, sum(x[3] for x in leaves) * mix.percent // 100)
    for d, b in top.items():
        langs = {x[1] for x in leaves if x[0] == d}
        for lang, c in give({x: (mix.lang_weights.get(x, 1), cap(lambda k: k[:2] == [d, x])) for x in langs}, b).items():
            for s, n in give({x[2]: (1, mix.max_epochs * x[3]) for x in leaves if x[:2] == (d, lang)}, c).items():
                assert got[d, lang, s] == n


def test_mixture_respects_budgets(spark):
    r = random.Random(6)
    rows = [(k, "w " * r.randrange(0, 60), r.choice(["en", "de", None]), "src0" if k % 3 else r.choice(["src1", "src13", "src17", "new", None]), "clash") for k in range(900)]
    rows += [(7, rows[7][1], rows[7][2], rows[7][3], "again"), (None, "w w", "en", "src0", ""), (901, None, "en", "src0", "")]
    mix = Mix(bucket_digits=1)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, copies string")
    out = mixed(docs, mix).collect()
    assert len(out) == len(rows)
    leaf = {}
    for x in out:
        a = leaf.setdefault((x.domain, x.lang_node, x.source_node), [0, 0])
        a[0] += x.n_tokens
        a[1] += x.n_tokens * x.copies
    plan = {tuple(x)[:3]: x.give for x in budgets(spark.createDataFrame([(*k, n) for k, (n, _) in leaf.items()], "domain string, lang_node string, source_node string, tokens bigint"), mix).select(*op10_mixing.LEAF, "give").collect()}
    for k, (n, took) in leaf.items():
        assert plan[k] - 60 < took <= plan[k], (k, n, took, plan[k])
    assert mixed(docs.limit(0)).collect() == []
    assert sorted(map(str, mixed(docs.repartition(7), mix).collect())) == sorted(map(str, out))


def test_pipeline_stages_on_documents(spark):
    """Each stage on its own input, against what it must do there."""
    import corpus_pipeline
    from lodestone.llm.op4_substring import substring_dedup
    from lodestone.llm.op8_simhash import near_duplicates
    from tests.llm.test_substring import brute

    docs = spark.createDataFrame(pq.read_table(f"{SF}/documents.parquet").to_pandas())
    a = corpus_pipeline.language(spark, docs, SF).cache()
    assert a.columns == corpus_pipeline.COLUMNS and a.count() >= 0.95 * docs.count()
    b = corpus_pipeline.near_dedup(spark, a, SF).cache()
    assert {r.doc_id for r in b.collect()} == {r.component_id for r in near_duplicates(a).collect()}
    c = corpus_pipeline.substring(spark, b, SF).cache()
    texts = {r.doc_id: r.text for r in b.collect()}
    want = dict(zip(texts, brute([(k, t) for k, t in texts.items()], 35)))
    for r in c.collect():
        assert r.text == (texts[r.doc_id] if want[r.doc_id][1] == 0 else want[r.doc_id][2]) and r.n_chars == len(r.text)
    assert substring_dedup(b).count() == c.count() == b.count()
    d = corpus_pipeline.mixing(spark, c, SF).cache()
    copies = {r.doc_id: r.copies for r in mixed(c).collect()}
    got = {}
    for r in d.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: n for k, n in copies.items() if n}
    ranks = op2_bpe.ranks(P.path(op2_bpe.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text_of = {r.doc_id: r.text for r in d.collect()}
    out = corpus_pipeline.encode(spark, d, SF).collect()
    assert len(out) == d.count() and all(r.ids == library.encode_ordinary(text_of[r.doc_id]) for r in out)


def test_pipeline_run_on_odd_tables(spark, tmp_path):
    """run() itself, with the tables written between the stages."""
    import os

    import corpus_pipeline
    from lodestone.llm import common

    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    odd = [(1, None, None, None, None), (None, "A sentence of words.", "en", "src1", 20), (2, "", "en", None, 0), (2, "A sentence of words.", None, "src1", 20), (3, "und der die " * 400, "de", "src2", 4800)]
    for k, rows in enumerate((odd, [])):
        spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        before = len(common._written)
        out = corpus_pipeline.run(spark, f"{tmp_path}/{k}")
        assert len(common._written) - before <= len(corpus_pipeline.STAGES) - 1  # a table a stage, no more
        assert {r.doc_id for r in out.collect()} <= {None, 1, 2, 3}
    assert os.path.isdir(tmp_path)


def test_pipeline_odd_tables(spark):
    import corpus_pipeline

    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    odd = [(1, None, None, None, None), (None, "A sentence of words.", "en", "src1", 20), (2, "", "en", None, 0), (2, "A sentence of words.", None, "src1", 20), (3, "und der die " * 400, "de", "src2", 4800)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, kinds)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.collect()
