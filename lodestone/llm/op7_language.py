"""Language ID: nearest of several clustered centroids per language, by cosine over TF-IDF n-gram vectors.

Features are counts of letter 1-, 2- and 3-grams (lower case, other characters as one gap), hashed to DIMS
places, with sublinear term frequency, inverse document frequency and unit length. Each language's training
vectors are clustered by spherical k-means; a text gets the language of the most similar centroid. It is
rejected if it is farther from it than texts of that language and length are: a quarter of the sample is held
out of the clusters, and of its texts and their excerpts, in steps of length by factors of two, the LOW quantile
of the similarities is taken; REJECT of it is the least that a text needs.

The model is fitted on at most about SAMPLE_PER_LANG labelled texts a language, those with the least text
hashes, each once however many copies it has; it learns from text and label alone. Every label with a letter in its texts is learned; many
labels have fewer centroids each (MAX_CENTROIDS), so that the size is at most the greater of MAX_CENTROIDS and
the number of labels, times DIMS.

Defined results: null texts and texts without a letter are und with score 0, not rejected by distance but
for want of a language; rows without a label are not learned from; with nothing to learn from all are und;
repeated rows get equal results; extra columns stay, those that clash with lang_pred, score or rejected are
replaced.
"""

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import col, drop_stored, give_back, packed, read_table, stored, unpacked, with_own

NAME = "op7_language_id"
DIMS = 1 << 13
SAMPLE_PER_LANG = 600
CLUSTERS = 4
#: Centroids of all languages together up to which each has CLUSTERS; beyond, each has fewer, and one at least.
MAX_CENTROIDS = 1600
#: Quantile of the similarities of held-out texts of a length, and the share of it below which a text is rejected.
LOW, REJECT = 0.01, 0.4
#: The least similarity of any text: letters that the training texts lack reach less.
FLOOR = 0.03
#: Lengths are told apart by the power of two of their distinct n-grams, up to this one; excerpts have these numbers of words.
LENGTHS = 12
EXCERPTS = (1, 2, 4, 8, 16, 32, 64, 128)
_CHARS = 1 << 18
_letters = None


def _letter_table():
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a text; all zero if it has no letter."""
    out = np.zeros(DIMS, np.int64)
    low = text.lower()
    for k in range(0, len(low), _CHARS):
        c = np.frombuffer(low[max(0, k - 2) : k + _CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(_letter_table()[c], c, 0).astype(np.uint64)
        c = c[np.concatenate([[True], (c[1:] > 0) | (c[:-1] > 0)])]
        g, letter = c, c > 0
        for n in (1, 2, 3):
            if n > 1:
                if len(c) < n:
                    break
                g = g[:-1] * np.uint64(0x9E3779B1) + c[n - 1 :]
                letter = letter[:-1] | (c[n - 1 :] > 0)
            x = (g[letter] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            out += np.bincount((x >> np.uint64(51)).astype(np.int64), minlength=DIMS)
    return out


def vectors(rows: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    x = np.stack(rows).astype(np.float32)
    np.log1p(x, out=x)
    x *= idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def length_class(grams: int) -> int:
    return min(LENGTHS, max(0, int(grams).bit_length() - 1))


def _sparse(batches):
    """Counts of each text, its kind (-1: for the clusters, 0: held out) and, of those held out, of excerpts (kind 1)."""
    for batch in batches:
        langs, kinds, at, n = [], [], [], []

        def add(lang, kind, c):
            if c.any():
                langs.append(lang)
                kinds.append(kind)
                at.append(np.flatnonzero(c).astype(np.int32))
                n.append(c[at[-1]])

        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            h = xxhash.xxh64_intdigest(text)
            add(lang, 0 if h % 4 == 0 else -1, counts(text))
            if h % 4 == 0:
                parts = text.split()
                for size in EXCERPTS:
                    if 2 * size <= len(parts):
                        for k in range(4):
                            start = xxhash.xxh64_intdigest(text, 1 + k) % (len(parts) - size + 1)
                            add(lang, 1, counts(" ".join(parts[start : start + size])))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(kinds, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int64()))], ["lang", "kind", "at", "n"])


def _cluster(clusters, idf):
    """Spherical k-means of one language's vectors: its centroids, and by length the low quantile of held-out similarities."""

    def run(table):
        def dense(rows):
            for at, n in zip(rows.column("at"), rows.column("n")):
                row = np.zeros(DIMS, np.int64)
                row[at.values.to_numpy()] = n.values.to_numpy()
                yield row

        kind = table.column("kind").to_numpy()
        own = list(dense(table.filter(pa.array(kind < 0))))
        # few texts: those held out are clustered as well
        x = vectors(own if len(own) >= 8 * clusters else list(dense(table.filter(pa.array(kind < 1)))), idf)
        del own
        x = x[sorted(range(len(x)), key=lambda k: x[k].tobytes())]  # whatever order the rows came in
        k = min(clusters, len(x))
        c = x[:1]
        while len(c) < k:  # farthest first
            c = np.concatenate([c, x[[int(np.argmin((x @ c.T).max(1)))]]])
        for _ in range(12):
            near = (x @ c.T).argmax(1)
            c = np.stack([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(k)])
            c /= np.sqrt((c * c).sum(1, keepdims=True))
        low = least_similar(dense(table.filter(pa.array(kind >= 0))), c, idf)
        lang = table.column("lang")[0].as_py()
        del x
        give_back()
        return pa.table({"lang": pa.array([lang] * k, pa.string()), "centroid": pa.array(list(c), pa.list_(pa.float32())), "low": pa.array([low] * k, pa.list_(pa.float64()))})

    return run


def least_similar(rows, centroids, idf) -> list[float]:
    """By length class, the LOW quantile of the rows' similarities to their nearest centroid; classes with few rows take the last below."""
    found = [[] for _ in range(LENGTHS + 1)]
    while part := list(itertools.islice(rows, 128)):
        for r, s in zip(part, (vectors(part, idf) @ centroids.T).max(1).tolist()):
            found[length_class(np.count_nonzero(r))].append(s)
    out, last = [], 0.0
    for sims in found:
        last = max(last, float(np.quantile(sims, LOW))) if len(sims) >= 8 else last
        out.append(last)
    return out


def fit(rows: DataFrame, per_lang: int = SAMPLE_PER_LANG, clusters: int = CLUSTERS):
    """A model (langs, centroids, low, idf) from rows(lang, text); None if there is nothing to learn from."""
    # copies of a text, which are drawn together, are one candidate
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = stored(rows.select("lang", "h").distinct().groupBy("lang").count(), "op7-sizes")
    # a row is taken if its hash, uniform from 0 to 1, is below 1.2 times the share wanted of its language
    unit = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.join(F.broadcast(sizes), "lang").where(unit < 1.2 * per_lang / F.col("count")).dropDuplicates(["lang", "h"])  # sizes: a row a label
    sample = stored(drawn.select("lang", "text").mapInArrow(_sparse, "lang string, kind int, at array<int>, n array<bigint>"), "op7-sample")
    df = np.zeros(DIMS)
    texts = sample.where("kind < 1")
    total = texts.count()
    if not total:
        return None
    for r in texts.select(F.explode("at").alias("at")).groupBy("at").count().collect():
        df[r["at"]] = r["count"]
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    clusters = max(1, min(clusters, MAX_CENTROIDS // sample.select("lang").distinct().count()))
    got = sample.groupBy("lang").applyInArrow(_cluster(clusters, idf), "lang string, centroid array<float>, low array<double>").toArrow()
    drop_stored(sizes, sample)
    langs, low = got.column("lang").to_pylist(), np.array(got.column("low").to_pylist())
    centroids = np.concatenate([c.flatten().to_numpy() for c in got.column("centroid").chunks]).reshape(-1, DIMS)
    order = sorted(range(len(langs)), key=lambda k: (langs[k], centroids[k].tobytes()))
    return [langs[k] for k in order], centroids[order], low[order], idf


def _predict(model):
    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            langs, scores, rejected = [], [], []
            for i in range(0, batch.num_rows, 128):
                rows = [counts(t.as_py()) if t.is_valid else np.zeros(DIMS, np.int64) for t in texts[i : i + 128]]
                some = [r.any() and model.value is not None for r in rows]
                sims = None
                if any(some):
                    names, centroids, low, idf = model.value
                    sims = vectors(rows, idf) @ centroids.T
                for k, ok in enumerate(some):
                    j = int(sims[k].argmax()) if ok else 0
                    langs.append(names[j] if ok else "und")
                    scores.append(min(1.0, max(0.0, float(sims[k][j]))) if ok else 0.0)
                    rejected.append(not ok or scores[-1] < max(FLOOR, REJECT * low[j][length_class(np.count_nonzero(rows[k]))]))
            own = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], [*batch.schema.names[:-1], "lang_pred", "score", "rejected"])
        give_back()

    return run


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected."""
    rows = packed(docs, ("lang_pred", "score", "rejected"), t=col(text))
    out = rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), with_own(rows, "lang_pred string, score double, rejected boolean"))
    return unpacked(out, "lang_pred", "score", "rejected")


def fit_documents(docs: DataFrame):
    """The model of the documents that are not held out."""
    return fit(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text"))


def query(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), fit_documents(docs))
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")
