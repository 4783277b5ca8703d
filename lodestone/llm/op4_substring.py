"""Substring dedup by fixed-block anchors: remove every word in a window of words that occurs twice or more.

1. Index: each document is cut into non-overlapping blocks of 18 words; distinct block hashes are counted.
2. Probe: every rolling window of 18 words is looked up. Any window of 35 words that also starts elsewhere
   holds, in its other occurrence, a whole aligned block (2 * 18 - 1 = 35), so it holds a hit.
   The index goes out as a bitmap of a size fixed by max_filter_blocks; beyond that size a coarser bitmap of
   the same bytes drops most probes without a match, and those left meet the index in a shuffled join. Blocks
   that make up more than one part in HOT_PARTS of all, of which there are fewer than HOT_PARTS, go out as a
   list: their probes are hits at once, so no hash is hot in the join. A false hit costs a candidate, never a
   wrong result.
3. Extension: around the hits, every 35-word window is given a 96-bit hash and dealt by it, packed in buckets
   whose number follows the corpus; equal windows prove each other repeated. Consecutive repeated windows make the maximal repeats, whose words go.

No pairs are made. Windows that repeat within a slice of documents (a few megabytes) are settled there and
send one row on, so a passage in a third of all documents sends one row a slice.

Defined results: null, empty and blank texts have no words and lose none; equal rows count as two
occurrences; rows are told apart by id and 64 bits of the text's hash, those without an id by 128, so an id may
come twice (rows that share both are one text and lose the same words); null ids are allowed; extra columns
stay, those that clash with n_words, n_removed or kept_text are replaced. Windows are equal if 96 bits of
hash are: of w distinct windows, some pair is taken for equal by chance with odds of w * w / 2 ** 97, one in
15 million for 10 ** 11 windows.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import col, drop_stored, give_back, packed, read_table, stored, unpacked, with_own
from lodestone.llm.wordhash import Words, mix, slices, windows

NAME = "op4_substring_dedup"
WINDOW = 35
#: Index size up to which the bitmap is broadcast: it has at most 4 bytes a block, twice.
MAX_FILTER_BLOCKS = 1 << 24
#: The bitmap thins the probes of the join up to this many times as many blocks; beyond, it would let nearly all pass.
THINNED = 16
#: Blocks more frequent than one in so many are told to all workers: half a megabyte at most.
HOT_PARTS = 1 << 16
#: Windows of the corpus for each bucket; only the candidates among them reach it.
BUCKET_ROWS = 1 << 20

_KEY = "k1 bigint, k2 bigint"


def _two(key):
    return np.asarray(key.to_numpy(zero_copy_only=False))


def _masks(h):
    m = np.zeros(len(h), np.uint64)
    for k in range(4):
        m |= np.uint64(1) << ((h >> np.uint64(36 + 6 * k)) & np.uint64(63))
    return m


def _starts(words, length, window):
    """Whether length words of one document with at least window words start at each word."""
    n = len(words.starts) - length + 1
    if n <= 0:
        return np.zeros(0, bool)
    size = np.diff(words.first)
    doc = np.repeat(np.arange(len(size)), size)
    ok = doc[:n] == doc[length - 1 :]
    return ok & (size[doc[:n]] >= window)


def _aligned(words, block):
    size = np.diff(words.first)
    return (np.arange(len(words.starts)) - np.repeat(words.first[:-1], size)) % block == 0


def _index(block, window):
    def run(batches):
        for batch in batches:
            for _, _, data, offsets in slices(batch, "t"):
                w = Words(data, offsets)
                ok = _starts(w, block, window)
                at = np.flatnonzero(ok & _aligned(w, block)[: len(ok)])
                if len(at):
                    h, n = np.unique(windows(w.hashes(0), block, 0)[at], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return run


def _hits(bits, p, aligned):
    """Whether the bitmaps (of all blocks, of those that come twice) hold the probes p; aligned ones are in the index themselves."""
    once, twice = bits
    m, word = _masks(p), np.where(aligned, twice[(p & np.uint64(len(twice) - 1)).astype(np.int64)], once[(p & np.uint64(len(once) - 1)).astype(np.int64)])
    return (word & m) == m


def _probe_rows(block, window, bits, hot):
    """The probes, for the join: hash, whether aligned, whether hot (dealt by place then), document and word."""

    def run(batches):
        for batch in batches:
            k1, k2 = _two(batch.column(0)), _two(batch.column(1))
            for i, n, data, offsets in slices(batch, "t"):
                w = Words(data, offsets)
                ok = _starts(w, block, window)
                if not ok.any():
                    continue
                h, aligned = windows(w.hashes(0), block, 0), _aligned(w, block)[: len(ok)]
                at = np.flatnonzero(ok if bits is None else ok & _hits(bits.value, h, aligned))
                if len(at):
                    doc = np.repeat(np.arange(n), np.diff(w.first))[at]
                    h, place = h[at], (at - w.first[doc]).astype(np.int32)
                    sure = np.isin(h, hot.value)
                    h = np.where(sure, mix(k1[i + doc].view(np.uint64) ^ mix(k2[i + doc].view(np.uint64)) ^ place.astype(np.uint64)), h)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(aligned[at]), pa.array(sure), pa.array(k1[i + doc]), pa.array(k2[i + doc]), pa.array(place)],
                        ["h", "aligned", "hot", "k1", "k2", "at"],
                    )
        give_back()

    return run


def _candidates(block, window, bits, buckets):
    """Candidate windows, packed by bucket of their hash; repeats within the slice are settled at once, as runs."""

    def run(batches):
        for batch in batches:
            k1, k2 = _two(batch.column(0)), _two(batch.column(1))
            given = batch.column(3) if bits is None else None
            for i, n, data, offsets in slices(batch, "t"):
                w = Words(data, offsets)
                ok = _starts(w, block, window)
                if not ok.any():
                    continue
                h = w.hashes(0)
                if bits is not None:
                    hit = ok & _hits(bits.value, windows(h, block, 0), _aligned(w, block)[: len(ok)])
                else:
                    hit = np.zeros(len(ok), bool)
                    for d in range(n):
                        if given[i + d].is_valid:
                            hit[w.first[d] + np.asarray(given[i + d].values)] = True
                fits = _starts(w, window, window)
                if not len(fits) or not hit.any():
                    continue
                c = np.concatenate([[0], np.cumsum(hit)])
                at = np.flatnonzero(fits)
                at = at[c[at + window - block + 1] > c[at]]
                if not len(at):
                    continue
                doc = np.repeat(np.arange(n), np.diff(w.first))[at]
                a, b = windows(h, window, 0)[at], (windows(w.hashes(1), window, 1)[at] >> np.uint64(32)).astype(np.uint32)
                at -= w.first[doc]
                order = np.lexsort((b, a))
                x, y = a[order], b[order]
                new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
                size = np.diff(np.append(np.flatnonzero(new), len(a)))
                multi = np.zeros(len(a), bool)
                multi[order] = np.repeat(size > 1, size)
                one = np.zeros(len(a), bool)
                one[order[new]] = True  # one row for each distinct window, in the order of the text
                bucket = ((a >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                one = np.flatnonzero(one)
                one = one[np.argsort(bucket[one], kind="stable")]
                cut = np.flatnonzero(np.diff(bucket[one])) + 1
                yield _packed([(int(bucket[r[0]]), a[r], b[r], multi[r], doc[r], at[r], None) for r in np.split(one, cut)], k1[i : i + n], k2[i : i + n])
                s = np.flatnonzero(multi)
                if len(s):
                    begin = np.flatnonzero(np.concatenate([[True], (at[s][1:] != at[s][:-1] + 1) | (doc[s][1:] != doc[s][:-1])]))
                    length = np.diff(np.append(begin, len(s)))
                    s = s[begin]
                    yield _packed([(int(a[s[0]] >> np.uint64(32)) % buckets, a[:0], b[:0], multi[:0], doc[s], at[s], length)], k1[i : i + n], k2[i : i + n])
        give_back()

    return run


_PACKED = "bucket int, k1 array<bigint>, k2 array<bigint>, n array<int>, a binary, b binary, multi binary, at binary, run binary"


def _packed(groups, k1, k2):
    """One row for each bucket: its documents' keys and rows, hashes, and positions as compressed steps."""
    cols = [[] for _ in range(9)]
    for bucket, a, b, multi, doc, at, run in groups:
        new = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        step = np.diff(at, prepend=0).astype(np.int32)
        row = (bucket, k1[doc[new]], k2[doc[new]], np.diff(np.append(new, len(doc))).astype(np.int32), a.tobytes(), b.tobytes(), np.packbits(multi).tobytes(), zlib.compress(step.tobytes(), 1), b"" if run is None else zlib.compress(run.astype(np.int32).tobytes(), 1))
        for c, x in zip(cols, row):
            c.append(x)
    kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in _PACKED.split(", ")])


def _settled(table):
    """Of one bucket: runs settled before, and the windows whose hash comes twice or is known to, as (k1, k2, document, at, run)."""
    keys1, keys2, docs, ats, runs, hashes1, hashes2, multis = ([] for _ in range(8))
    total = 0
    for row in table.to_pylist():
        n = np.array(row["n"], np.int64)
        at = np.cumsum(np.frombuffer(zlib.decompress(row["at"]), np.int32)).astype(np.int32)
        keys1.append(np.array(row["k1"], np.int64))
        keys2.append(np.array(row["k2"], np.int64))
        docs.append(np.repeat(np.arange(total, total + len(n)), n))
        total += len(n)
        ats.append(at)
        settled = bool(row["run"])
        runs.append(np.frombuffer(zlib.decompress(row["run"]), np.int32) if settled else np.zeros(len(at), np.int32))
        # settled runs get hashes that meet no other
        hashes1.append(np.zeros(len(at), np.uint64) if settled else np.frombuffer(row["a"], np.uint64))
        hashes2.append(np.zeros(len(at), np.uint32) if settled else np.frombuffer(row["b"], np.uint32))
        multis.append(np.zeros(len(at), bool) if settled else np.unpackbits(np.frombuffer(row["multi"], np.uint8), count=len(at)).astype(bool))
    k1, k2, doc, at, run, a, b, multi = (np.concatenate(x) for x in (keys1, keys2, docs, ats, runs, hashes1, hashes2, multis))
    open_ = np.flatnonzero(run == 0)
    order = open_[np.lexsort((b[open_], a[open_]))]
    x, y = a[order], b[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])[: len(order)]
    if len(order):
        group = np.cumsum(new) - 1
        known = (np.bincount(group) > 1) | (np.bincount(group, multi[order]) > 0)
        order = order[known[group] & ~multi[order]]
    go = np.sort(np.concatenate([np.flatnonzero(run > 0), order]))
    doc, at, run = doc[go], at[go], np.maximum(run[go], 1)
    return k1[doc], k2[doc], doc, at, run


def _settle(buckets):
    """What a bucket of windows found, packed by bucket of documents."""

    def run(table):
        k1, k2, doc, at, length = _settled(table)
        home = (mix(k1.view(np.uint64) ^ k2.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        cut = np.flatnonzero(np.diff(home[order])) + 1
        cols = [[] for _ in _PACKED_FOUND.split(", ")]
        for r in np.split(order, cut) if len(order) else []:
            row = (int(home[r[0]]), *(zlib.compress(x[r].astype(t).tobytes(), 1) for x, t in ((k1, np.int64), (k2, np.int64), (at, np.int32), (length, np.int32))))
            for c, x in zip(cols, row):
                c.append(x)
        return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int32()] + [pa.binary()] * 4)], [x.split()[0] for x in _PACKED_FOUND.split(", ")])

    return run


_PACKED_FOUND = "home int, k1 binary, k2 binary, at binary, run binary"


def _gather(table):
    """One row for each document of a bucket."""
    k1, k2, at, run = (np.concatenate([np.frombuffer(zlib.decompress(x.as_py()), t) for x in table.column(c)]) for c, t in (("k1", np.int64), ("k2", np.int64), ("at", np.int32), ("run", np.int32)))
    order = np.lexsort((at, k2, k1))
    k1, k2, at, run = k1[order], k2[order], at[order], run[order]
    new = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
    ends = pa.array(np.append(new, len(k1)).astype(np.int32))
    return pa.table({"k1": k1[new], "k2": k2[new], "at": pa.ListArray.from_arrays(ends, pa.array(at)), "run": pa.ListArray.from_arrays(ends, pa.array(run))})


def _remove(window):
    def run(batches):
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            texts, found = batch.column(batch.schema.get_field_index("t")), batch.column(batch.schema.get_field_index("found"))
            size, gone, kept = [], [], []
            for t, f in zip(texts, found):
                parts = t.as_py().encode().split()
                n = len(parts)
                if f.is_valid and n:
                    at, length = (np.asarray(f[k].values) for k in ("at", "run"))
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + length + window - 1, -1)
                    keep = np.cumsum(step[:n]) == 0
                    left = [parts[k] for k in np.flatnonzero(keep)]
                else:
                    left = parts
                size.append(n)
                gone.append(n - len(left))
                kept.append(b" ".join(left).decode())
            own = [batch.column(k) for k in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], [*batch.schema.names[:-2], "n_words", "n_removed", "kept_text"])
        give_back()

    return run


def _filter_bits(index: DataFrame, blocks: int, most: int):
    """The index as two arrays of at most `most` 64-bit words, four bits a block in each: of all blocks, and of those that come twice."""
    mask = F.lit(0).cast("long")
    for k in range(4):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftright", F.col("h"), F.lit(36 + 6 * k)).bitwiseAND(F.lit(63)).cast("int")))

    def bits(rows: DataFrame, n: int):
        slots = 1 << max(10, min(most.bit_length() - 1, (max(n, 1) - 1).bit_length() - 1))
        got = rows.select(F.col("h").bitwiseAND(F.lit(slots - 1)).alias("slot"), mask.alias("m")).groupBy("slot").agg(F.bit_or("m").alias("m")).toArrow()
        out = np.zeros(slots, np.uint64)
        out[got.column("slot").to_numpy()] = got.column("m").to_numpy().view(np.uint64)
        return out

    twice = index.where("n > 1")
    return index.sparkSession.sparkContext.broadcast((bits(index, blocks), bits(twice, twice.count())))


def substring_dedup(docs: DataFrame, window: int = WINDOW, id: str = "doc_id", text: str = "text", max_filter_blocks: int = MAX_FILTER_BLOCKS) -> DataFrame:
    """docs with n_words, n_removed and kept_text, the words outside repeated windows joined by one space."""
    block = (window + 1) // 2
    given = col(text)
    k1, k2 = F.coalesce(col(id).cast("long"), F.xxhash64(given, F.lit("no id"))), F.xxhash64(given)
    keys = docs.select(k1.alias("k1"), k2.alias("k2"), F.coalesce(given, F.lit("")).alias("t"))
    index = stored(keys.select("t").mapInArrow(_index(block, window), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")), "op4-index")
    blocks, total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = _filter_bits(index, blocks, max(2, max_filter_blocks // 2)) if blocks <= THINNED * max_filter_blocks else None
    if blocks <= max_filter_blocks:
        probed = keys
        drop_stored(index)
    else:
        hot = index.where(F.col("n") > max(1, total // HOT_PARTS)).select("h").toArrow()  # fewer than HOT_PARTS: their counts sum to total at most
        hot = docs.sparkSession.sparkContext.broadcast(np.sort(hot.column("h").to_numpy().view(np.uint64)))
        probes = keys.mapInArrow(_probe_rows(block, window, bits, hot), f"h bigint, aligned boolean, hot boolean, {_KEY}, at int")
        real = F.col("hot") | (F.col("n").isNotNull() & (~F.col("aligned") | (F.col("n") > 1)))
        hits = probes.join(index, "h", "left").where(real).groupBy("k1", "k2").agg(F.sort_array(F.collect_set("at")).alias("at"))
        probed, bits = keys.join(hits, ["k1", "k2"], "left"), None
    buckets = max(16, blocks * block // BUCKET_ROWS)
    found = probed.mapInArrow(_candidates(block, window, bits, buckets), _PACKED).groupBy("bucket").applyInArrow(_settle(buckets), _PACKED_FOUND)
    found = found.groupBy("home").applyInArrow(_gather, f"{_KEY}, at array<int>, run array<int>").withColumn("found", F.struct("at", "run")).drop("at", "run")
    rows = packed(docs, ("n_words", "n_removed", "kept_text"), k1=k1, k2=k2, t=F.coalesce(given, F.lit("")))
    joined = rows.join(found, ["k1", "k2"], "left").select("own", "t", "found")
    out = joined.mapInArrow(_remove(window), with_own(joined, "n_words bigint, n_removed bigint, kept_text string"))
    return unpacked(out, "n_words", "n_removed", "kept_text")


def query(spark, sf_dir):
    out = substring_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
