"""Extra columns of any name stay as they are, on every branch of every operator."""

import public_tokenizers as P
import pytest

from lodestone.llm import op2_bpe, op4_substring, op6_tokens, op7_language, op8_simhash, op9_html, op10_mixing

NAMES = (
    "t own none name key bucket whole left end before took upto n e k1 k2 k found at run h aligned home __t __w __url __html __names __row names page up noise style "
    "id row fp root least least_row node p lang_node_ cap budget w give open url_ K1 OWN Bucket"
).split()
PASSAGE = " ".join(f"w{k}" for k in range(60))
TEXTS = [f"one two {PASSAGE}", f"three {PASSAGE} four five", None, "", "The house and the man of the city " * 4, "der und die das " * 9]


def with_extras(spark, rows, schema):
    names, seen = [], set()
    for c in NAMES:
        if c.lower() not in seen:
            names.append(c)
            seen.add(c.lower())
    return spark.createDataFrame(rows, schema).selectExpr("*", *[f"{k} AS `{c}`" for k, c in enumerate(names)]), {c: k for k, c in enumerate(names)}


def runs(spark):
    docs, extras = with_extras(spark, [(k, t, "en", "src1") for k, t in enumerate(TEXTS)], "doc_id bigint, text string, lang string, source string")
    model = lambda: op7_language.fit(spark.createDataFrame([(t, "en") for t in TEXTS], "text string, lang string"))
    pages, page_extras = with_extras(spark, [(k, "http://h/", f"<div>{t}</div><article>{t}</article>") for k, t in enumerate(TEXTS)], "page_id bigint, url string, html string")
    return {
        "bpe": (docs, extras, lambda d: op2_bpe.encoded(d, P.path(op2_bpe.VOCABULARY))),
        "bpe native": (docs, extras, lambda d: op2_bpe.encode_native(d, P.path(op2_bpe.VOCABULARY))),
        "substring": (docs, extras, op4_substring.substring_dedup),
        "substring join": (docs, extras, lambda d: op4_substring.substring_dedup(d, max_filter_blocks=0)),
        "counts": (docs, extras, lambda d: op6_tokens.token_counts(d, P.path(op6_tokens.MODEL))),
        "language": (docs, extras, lambda d: op7_language.identify(d, model())),
        "keep one": (docs, extras, op8_simhash.keep_one),
        "tree": (pages, page_extras, op9_html.extract),
        "tree join": (pages, page_extras, lambda d: op9_html.extract(d, max_broadcast=-1)),
        "mixing": (docs, extras, op10_mixing.mixed),
    }


@pytest.mark.parametrize("name", ["bpe", "bpe native", "substring", "substring join", "counts", "language", "keep one", "tree", "tree join", "mixing"])
def test_extra_columns_stay(spark, name):
    df, extras, operator = runs(spark)[name]
    out = operator(df)
    assert [c for c in df.columns if c != "html"] == [c for c in out.columns if c in df.columns]
    rows = out.collect()
    assert rows and all({c: r[c] for c in extras} == extras for r in rows)
    plain = operator(df.drop(*extras))
    assert sorted(map(str, plain.collect())) == sorted(map(str, out.drop(*extras).collect()))
