"""Byte-level BPE: encoding by ranks, one pre-token at a time, and decoding by joining pieces.

Two forms with the same results. encode_native is the method in DataFrame functions alone: inside each row, the
distinct pre-tokens of every CHUNK of them are encoded once each by a fold over the word's byte ids that merges,
again and again, the leftmost pair of lowest rank, looked up in a literal rank map (row displacement: three array
reads a pair); nothing is shuffled, but a fold that Spark interprets takes some 13 times the time of encoded(), beyond
what the query may take (README), so the query takes that. encoded() does the same merges in Arrow batches: each task encodes the
distinct words that it meets and keeps them in a table of at most CACHED_BYTES, which ends with the task.

Defined results: null and empty texts have no ids and decode to no bytes; rows are encoded one by one, so
ids may repeat or be null; a text of any length is held one row at a time; extra columns stay, those that
clash with ids, n_tokens, ids_sha256 or decoded_sha256 are replaced; an empty table gives an empty one.
"""

import base64
import functools
import hashlib
import heapq
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import col, give_back, packed, read_table, unpacked, with_own

NAME = "op2_byte_bpe"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of the words that a task keeps, with what a table's entry costs, and the longest word that it keeps, in characters.
CACHED_BYTES, LONGEST = 64 << 20, 64
_ENTRY = 250
#: Rows whose ids are handed on together.
_ROWS = 256
#: Pre-tokens of a row among which distinct ones are encoded once, in the native form.
CHUNK = 256
_NONE = 1 << 30
#: Words up to this many bytes are merged without a heap.
_SHORT = 40
_SLOTS = 1 << 20
_STRIDE = 40503
_MADE = ("ids", "n_tokens", "ids_sha256", "decoded_sha256")


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def pieces(path: str, table: dict[bytes, int] | None = None) -> list[bytes]:
    """Bytes by id."""
    table = ranks(path) if table is None else table
    out = [b""] * (max(table.values()) + 1)
    for piece, i in table.items():
        out[i] = piece
    return out


def _merge_short(word: bytes, table: dict[bytes, int]) -> list[int]:
    """merge() by looking at every pair each time."""
    parts = [word[i : i + 1] for i in range(len(word))]
    found = [table.get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while found and (low := min(found)) < _NONE:
        i = found.index(low)
        parts[i] += parts.pop(i + 1)
        del found[i]
        if i < len(found):
            found[i] = table.get(parts[i] + parts[i + 1], _NONE)
        if i:
            found[i - 1] = table.get(parts[i - 1] + parts[i], _NONE)
    return [table[x] for x in parts]


def merge(word: bytes, table: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the leftmost pair of lowest rank is merged until none is left."""
    if word in table:
        return [table[word]]
    if len(word) <= _SHORT:
        return _merge_short(word, table)
    end = list(range(1, len(word) + 1))  # of the part that starts at a byte
    before = list(range(-1, len(word) - 1))
    get = table.get
    heap = [(r, i, i + 2) for i in range(len(word) - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, j = heapq.heappop(heap)
        mid = end[i]
        if mid < 0 or mid >= len(word) or end[mid] != j or mid >= j:
            continue  # one of the two parts is no longer there
        end[i], end[mid] = j, -1
        if j < len(word):
            before[j] = i
            if (x := get(word[i : end[j]])) is not None:
                heapq.heappush(heap, (x, i, end[j]))
        if (p := before[i]) >= 0 and (x := get(word[p:j])) is not None:
            heapq.heappush(heap, (x, p, j))
    out, i = [], 0
    while i < len(word):
        out.append(table[word[i : end[i]]])
        i = end[i]
    return out


class Words(dict):
    """Ids of words, as little-endian unsigned 32-bit integers; encodes what it lacks. When half the room is full the words are set aside: those met again come back, the others go at the next turn."""

    def __init__(self, table, room=CACHED_BYTES):
        super().__init__()
        self.table, self.room, self.used, self.aside = table, room, 0, {}

    def __missing__(self, word):
        packed = self.aside.get(word)
        if packed is None:
            ids = merge(word.encode(), self.table)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= LONGEST:
            size = _ENTRY + 4 * len(word) + len(packed)
            if self.used + size > self.room // 2:
                self.aside, self.used = dict(self), 0
                self.clear()
            self.used += size
            self[word] = packed
        return packed


def _encode(path, pattern, with_ids):
    def run(batches):
        table = ranks.__wrapped__(path)  # no table outlives its task
        piece, get = pieces.__wrapped__(path, table).__getitem__, Words(table).__getitem__
        find = regex.compile(pattern).findall
        for whole in batches:
            for i in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(i, _ROWS)
                ids, counts, shas, backs = [], [], [], []
                for t in batch.column(batch.num_columns - 1):
                    packed = b"".join(map(get, find(t.as_py() or "")))
                    numbers = np.frombuffer(packed, "<u4")
                    back = hashlib.sha256()
                    for k in range(0, len(numbers), 1 << 16):
                        back.update(b"".join(map(piece, numbers[k : k + (1 << 16)].tolist())))
                    if with_ids:
                        ids.append(packed)
                    counts.append(len(numbers))
                    shas.append(hashlib.sha256(packed).hexdigest())
                    backs.append(back.hexdigest())
                made = [pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(backs, pa.string())]
                if with_ids:
                    ends = np.cumsum([0, *counts]).astype(np.int32)
                    made.insert(0, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], *_MADE[1 - with_ids :]])
        del table, piece, get
        give_back()

    return run


def encoded(docs: DataFrame, path: str, text: str = "text", pattern: str = public_tokenizers.PATTERN, with_ids: bool = True) -> DataFrame:
    """docs with ids array<int> (if asked for), n_tokens, ids_sha256 and, of the ids decoded again, decoded_sha256."""
    rows = packed(docs, _MADE, t=col(text))
    made = "ids array<int>, " * with_ids + "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return unpacked(rows.mapInArrow(_encode(path, pattern, with_ids), with_own(rows, made)), *_MADE[1 - with_ids :])


@functools.cache
def _pairs(path: str):
    """Row displacement of the merges: place[a], and at (place[a] + b * stride) mod slots the first id and the merged id."""
    table, rows = ranks(path), {}
    for piece, merged in table.items():
        for k in range(1, len(piece)):
            a, b = table.get(piece[:k]), table.get(piece[k:])
            if a is not None and b is not None:
                rows.setdefault(a, []).append((b, merged))
    place, owner, value = np.zeros(max(table.values()) + 1, np.int64), np.full(_SLOTS, -1), np.zeros(_SLOTS, np.int64)
    rng = np.random.default_rng(0)
    for a in sorted(rows, key=lambda a: (-len(rows[a]), a)):
        b, merged = (np.array(x) for x in zip(*rows[a]))
        while True:
            place[a] = rng.integers(_SLOTS)
            at = (place[a] + b * _STRIDE) % _SLOTS
            if (owner[at] < 0).all():
                break
        owner[at], value[at] = a, merged
    return place, owner, value


def _literal(values, kind="int") -> Column:
    """An array that the optimizer folds to one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _let(value: Column, made) -> Column:
    """made(value), with value worked out once."""
    return F.get(F.transform(F.array(value), made), 0)


_NO_INTS = "array<int>"


def encode_word(word: Column, path: str) -> Column:
    """Ids of one pre-token of a byte at least: a fold over its bytes, each step with the parts and the ranks of their pairs."""
    table = ranks(path)
    place, owner, value = _pairs(path)
    single = _literal([table[bytes([b])] for b in range(256)])
    place_, owner_, value_ = _literal(place), _literal(owner), _literal(value)
    none = F.array().cast(_NO_INTS)
    code, n = F.hex(F.encode(word, "UTF-8")), F.octet_length(word)
    bytes_ = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(single, F.conv(F.substring(code, 2 * i + 1, F.lit(2)), 16, 10).cast("int")))

    def rank(a: Column, b: Column) -> Column:
        at = (F.get(place_, a) + b * _STRIDE) % _SLOTS
        return F.when(F.get(owner_, at) == a, F.get(value_, at)).otherwise(_NONE)

    def state(ids: Column) -> Column:
        pairs = F.zip_with(F.slice(ids, 1, F.size(ids) - 1), F.slice(ids, 2, F.size(ids)), rank)
        return F.struct(ids.alias("parts"), F.when(F.size(ids) > 1, pairs).otherwise(none).alias("ranks"))

    def merged(s: Column, low: Column, i: Column) -> Column:
        """The state with parts i and i + 1 as one: only the ranks beside it are looked up again."""
        p, r, size = s["parts"], s["ranks"], F.size(s["parts"])
        left = F.when(i > 1, F.concat(F.slice(r, F.lit(1), i - 2), F.array(rank(F.get(p, i - 2), low)))).otherwise(none)
        right = F.when(i + 1 < size, F.concat(F.array(rank(low, F.get(p, i + 1))), F.slice(r, i + 2, size))).otherwise(none)
        parts = F.concat(F.slice(p, F.lit(1), i - 1), F.array(low), F.slice(p, i + 2, size))
        return F.struct(parts.alias("parts"), F.concat(left, right).alias("ranks"))

    def step(s: Column, _: Column) -> Column:
        again = lambda low: F.when(low < _NONE, _let(F.array_position(s["ranks"], low).cast("int"), lambda i: merged(s, low, i))).otherwise(s)
        return _let(F.coalesce(F.array_min(s["ranks"]), F.lit(_NONE)), again)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), _let(bytes_, state), step, lambda s: s["parts"])


def pretokens(text: Column, pattern: str = public_tokenizers.PATTERN) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + pattern), F.lit(0))


def encode_text(text: Column, path: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Ids of a text: of each chunk of pre-tokens, the distinct ones are folded once and the others take theirs."""
    none = F.array().cast(_NO_INTS)

    def chunk(words: Column) -> Column:
        coded = lambda d: F.map_from_arrays(d, F.transform(d, lambda w: encode_word(w, path)))
        return _let(_let(F.array_distinct(words), coded), lambda m: F.flatten(F.transform(words, lambda w: m[w])))

    def whole(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(words) - 1, F.lit(CHUNK))
        return F.when(F.size(words) > 0, F.flatten(F.transform(starts, lambda i: chunk(F.slice(words, i + 1, CHUNK))))).otherwise(none)

    return _let(pretokens(text, pattern), whole)


def decode_native(ids: Column, path: str) -> Column:
    """The bytes of a sequence of ids."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(_literal([p.hex() for p in pieces(path)], "string"), i)), ""))


def encode_native(docs: DataFrame, path: str, text: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """encoded() in DataFrame functions alone."""
    rows = packed(docs, _MADE, ids=encode_text(col(text), path, pattern))
    little = _literal([int(i).to_bytes(4, "little").hex() for i in range(len(pieces(path)))], "string")
    whole = F.unhex(F.array_join(F.transform("ids", lambda i: F.get(little, i)), ""))
    made = F.size("ids").cast("long").alias("n_tokens"), F.sha2(whole, 256).alias("ids_sha256"), F.sha2(decode_native(F.col("ids"), path), 256).alias("decoded_sha256")
    return unpacked(rows, "ids", *made)


def query(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs, public_tokenizers.path(VOCABULARY), with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
