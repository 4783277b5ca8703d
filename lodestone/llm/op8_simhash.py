"""SimHash near-dedup by covering locality-sensitive hashing.

Every bit of the 64 has a nonzero vector of radius + 1 bits. Table v, for each nonzero v, looks only at the
bits whose vector has an odd product with v. The vectors of any radius differing bits span fewer than
radius + 1 dimensions, so some v is orthogonal to all of them and the pair collides in that table: no pair
within the radius is missed, whatever it looks like.

Equal fingerprints are one node, so groups of copies cost one row a table. Buckets are compared inside
sorted partitions and yield a spanning forest of their links, never all pairs. Buckets beyond bucket_limit
nodes are split by a second cover with other vectors, which holds for their pairs as the first does; only
what is beyond the limit there too is dealt as pairs of tiles, which any number of tasks share.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any others; rows may
repeat and ids may come twice; a null id is never a component's name unless it has no other; extra columns
stay, those that clash with fingerprint or component_id are replaced.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import col, drop_stored, give_back, packed, read_table, stored, unpacked
from lodestone.llm.components import components
from lodestone.llm.wordhash import slices

NAME = "op8_simhash_near_dedup"
RADIUS = 4
SHINGLE = 4
BUCKET_LIMIT = 4096
_STEP = 1 << 18


def masks(radius: int = RADIUS, second: bool = False) -> list[int]:
    """The bits of 64 that each of the 2**(radius + 1) - 1 tables looks at, with the vectors of the first or the second cover."""
    top = (1 << radius + 1) - 1
    vector = [1 + (11 * i + 5 * (i // top) if second else i) % top for i in range(64)]
    return [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() % 2) for v in range(1, top + 1)]


def _hashes(text: bytes, size: int) -> list[int]:
    parts = text.lower().split()
    if len(parts) < size:
        return [xxhash.xxh64_intdigest(b" ".join(parts), 42)] if parts else []
    whole = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[: len(parts) - size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(whole[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist())]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the hashes of the text's shingles, repeats included."""
    h = np.array(_hashes(text, size), np.uint64)
    count = np.zeros(64, np.int64)
    for k in range(0, len(h), _STEP):
        count += np.unpackbits(h[k : k + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int32)
    return int(np.packbits(2 * count > len(h), bitorder="little").view(np.uint64)[0]) if len(h) else 0


def _fingerprints(size):
    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for i, n, data, offsets in slices(batch, "t"):
                data = data.tobytes()
                for k in range(n):
                    out[i + k] = fingerprint(data[offsets[k] : offsets[k + 1]], size)
            own = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(out.view(np.int64))], [*batch.schema.names[:-1], "fp"])
        give_back()

    return run


def _forest(new, fp, radius, own=None):
    """Edges of a spanning forest of the links within each run of rows; own: which pairs of sides a run compares."""
    n = len(fp)
    begin = np.flatnonzero(new)
    end = np.repeat(np.append(begin[1:], n), np.diff(np.append(begin, n)))
    parent = np.arange(n)

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b, d = [], [], 1
    at = np.flatnonzero(np.arange(n) + d < end)
    while len(at):
        near = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= radius]
        if len(near):
            x, y = parent[near], parent[near + d]
            while True:
                x2, y2 = parent[x], parent[y]
                if (x2 == x).all() and (y2 == y).all():
                    break
                x, y = x2, y2
            apart = x != y
            for i, p, q in zip(near[apart].tolist(), x[apart].tolist(), y[apart].tolist()):
                p, q = find(p), find(q)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    a.append(i)
                    b.append(i + d)
        d += 1
        at = at[at + d < end[at]]
    return fp[a].view(np.int64), fp[b].view(np.int64)


def _buckets(radius, limit):
    """Of rows (t, key, fp) sorted by t and key: links as (a, b, null), and buckets beyond the limit as (t, key, size)."""

    def run(batches):
        held, last, size = [], None, 0  # rows of the last bucket, up to the limit, and its size

        def flush(t, key, fp, new):
            a, b = _forest(new, fp, radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "n"])

        def hot(t, key, n):
            return pa.RecordBatch.from_arrays([pa.array([int(t)], pa.int64()), pa.array([int(key)], pa.int64()), pa.array([int(n)], pa.int64())], ["a", "b", "n"])

        for batch in batches:
            t, key, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(t):
                continue
            fp = fp.view(np.uint64)
            new = np.concatenate([[True], (t[1:] != t[:-1]) | (key[1:] != key[:-1])])
            edges = np.append(np.flatnonzero(new), len(t))
            if last == (t[0], key[0]):  # the bucket goes on
                size += edges[1]
                if size <= limit:
                    held.append(fp[: edges[1]].copy())
                else:
                    held = []
                edges = edges[1:]
                if len(edges) == 1:
                    continue
            if last is not None:
                if size > limit:
                    yield hot(*last, size)
                elif size > 1:
                    x = np.concatenate(held)
                    yield flush(None, None, x, np.arange(len(x)) == 0)
            whole = np.diff(edges)[:-1]
            for k in np.flatnonzero(whole > limit):
                yield hot(t[edges[k]], key[edges[k]], whole[k])
            some = np.repeat((whole > 1) & (whole <= limit), whole)
            span = slice(edges[0], edges[-2])
            if some.any():
                yield flush(None, None, fp[span][some], new[span][some])
            last, size = (t[edges[-2]], key[edges[-2]]), edges[-1] - edges[-2]
            held = [fp[edges[-2] :].copy()] if size <= limit else []
        if last is not None and size > limit:
            yield hot(*last, size)
        elif last is not None and size > 1:
            x = np.concatenate(held)
            yield flush(None, None, x, np.arange(len(x)) == 0)

    return run


def _tiles(radius):
    def run(_, table):
        fp = table.column("fp").to_numpy().view(np.uint64)
        a, b = _forest(np.arange(len(fp)) == 0, fp, radius)
        return pa.table({"a": a, "b": b})

    return run


def links(fps: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (a, b) between distinct fingerprints fps(fp bigint), enough to connect all that lie within the radius, and the tables they are read from."""
    sign = lambda m: m - (1 << 64) if m >> 63 else m
    deal = lambda second: F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(sign(m))).alias("key")) for t, m in enumerate(masks(radius, second))]))
    compare = lambda rows: stored(rows.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(_buckets(radius, bucket_limit), "a bigint, b bigint, n bigint"), "op8-links")
    heavy = lambda found: found.where("n IS NOT NULL").select(F.col("a").cast("int").alias("t"), F.col("b").alias("key"), F.ceil(F.col("n") / bucket_limit).cast("int").alias("tiles"))
    rows = fps.select("fp", deal(False).alias("r")).select("r.t", "r.key", "fp")
    found = [compare(rows)]
    edges, hot = found[0].where("n IS NULL").select("a", "b"), heavy(found[0])
    if hot.limit(1).count():
        # the bucket goes into the second key by its hash: a collision puts strangers side by side, which their distance tells apart
        again = rows.join(hot.drop("tiles"), ["t", "key"]).select(F.xxhash64("t", "key").alias("bucket"), "fp", deal(True).alias("r"))
        rows = again.select("r.t", F.xxhash64("bucket", "r.key").alias("key"), "fp")
        found.append(compare(rows))
        edges, hot = edges.union(found[1].where("n IS NULL").select("a", "b")), heavy(found[1])
        if hot.limit(1).count():
            dealt = rows.join(hot, ["t", "key"])
            own = F.pmod(F.xxhash64("fp"), "tiles").cast("int")
            dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            dealt = dealt.select("t", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")
            edges = edges.union(dealt.groupBy("t", "key", "x", "y").applyInArrow(_tiles(radius), "a bigint, b bigint"))
    return edges, found


def _classes(fps: DataFrame, radius: int, bucket_limit: int) -> DataFrame:
    """(fp, root, component_id) of each fingerprint of fps(id, fp); components that share an id have roots of their own."""
    nodes = stored(fps.groupBy("fp").agg(F.min("id").alias("least")), "op8-nodes")
    edges, made = links(nodes.select("fp"), radius, bucket_limit)
    root = components(edges)
    named = nodes.join(root, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = stored(named, "op8-roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    out = stored(named.join(least, "root").select("fp", "root", "component_id"), "op8-classes")
    drop_stored(nodes, *made, root, named)
    return out


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, id: str = "doc_id", text: str = "text", bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(id, fp, component_id) of each row of docs."""
    fps = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    fps = stored(fps.mapInArrow(_fingerprints(shingle), "id bigint, fp bigint"), "op8-fingerprints")
    return fps.join(_classes(fps, radius, bucket_limit), "fp").select("id", "fp", "component_id")


def hex16(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs without all but one row of each group: that with the smallest id, a null id last, and of those the smallest hash of the row."""
    whole = [col(c) for c in docs.columns]
    rows = packed(docs, (), id=F.col("doc_id"), row=F.xxhash64(*whole, *[c.isNull() for c in whole]), t=F.coalesce("text", F.lit("")))
    fps = stored(rows.select("id", "row", "t").mapInArrow(_fingerprints(SHINGLE), "id bigint, row bigint, fp bigint"), "op8-fingerprints")
    classes = _classes(fps, radius, BUCKET_LIMIT)
    of = fps.join(classes.select("fp", "root"), "fp")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("k")
    kept = stored(of.groupBy("root").agg(least).select(F.col("k.id").alias("least"), F.col("k.row").alias("least_row")), "op8-kept")
    drop_stored(fps, classes)
    out = rows.drop("t").join(kept, F.col("id").eqNullSafe(F.col("least")) & (F.col("row") == F.col("least_row")), "left_semi")
    return unpacked(out.dropDuplicates(["id", "row"]))


def query(spark, sf_dir):
    out = near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), hex16(F.col("fp")).alias("fingerprint"), "component_id")
